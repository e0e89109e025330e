"""Document preparation on Spark: clean, chunk, dedupe, score, report."""

from __future__ import annotations

import sys
from importlib import metadata

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so a cluster needs
# no copy of the package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .api import chunk_text, clean_text, dedupe_chunks, score_chunks  # noqa: E402
from .errors import TextmillError  # noqa: E402
from .operators.score import clear_scorers, register_scorer  # noqa: E402
from .plans.pipeline import Pipeline, PipelineResult  # noqa: E402
from .types import Chunk, ChunkMetadata, DedupeResult, PipelineStats, Scorer, Tokenizer  # noqa: E402

try:
    __version__ = metadata.version("textmill")
except metadata.PackageNotFoundError:
    __version__ = "0.0.0"

__all__ = [
    "Chunk",
    "ChunkMetadata",
    "DedupeResult",
    "Pipeline",
    "PipelineResult",
    "PipelineStats",
    "Scorer",
    "TextmillError",
    "Tokenizer",
    "chunk_text",
    "clean_text",
    "clear_scorers",
    "dedupe_chunks",
    "register_scorer",
    "score_chunks",
]
