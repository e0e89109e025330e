"""The primitives, for Python values and for Spark's.

Each takes either what Spark computes with (a Column, or a DataFrame with `text`) and
returns the same, lazily; or plain strings, for which a small job is run at once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import spark_job
from .functions import chunking
from .functions import text as T
from .operators import dedupe as D
from .operators.score import score
from .operators.tables import with_index
from .plans.pipeline import active_session
from .types import Chunk, DedupeResult, Tokenizer


def _one(column, text: str, what: str):
    with spark_job(what):
        return active_session().createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


def clean_text(text: str | Column) -> str | Column:
    """Normalise Unicode, decode entities, strip markup and collapse white space."""
    if isinstance(text, Column):
        return T.clean(text)
    if not isinstance(text, str):
        raise TypeError("clean_text needs a string")
    return _one(T.clean, text, "clean_text")


def chunk_text(text: str | Column, chunk_size: int = 512, overlap: int = 64, preserve_headings: bool = True, *, mode: str = "word", tokenizer: Tokenizer | None = None):
    """Chunks of a text, by words or by the tokens of a tokenizer."""
    cut = lambda c: chunking.chunk(c, chunk_size, overlap, preserve_headings, mode=mode, tokenizer=tokenizer)
    if isinstance(text, Column):
        return cut(text)
    if not isinstance(text, str):
        raise TypeError("chunk_text needs a string")
    chunking.check_config(chunk_size, overlap)
    return list(_one(cut, text, "chunk_text"))


def _listed(chunks: Iterable[str]) -> list[str]:
    if isinstance(chunks, (str, bytes)) or not hasattr(chunks, "__iter__"):
        raise TypeError("chunks must be an iterable of strings")
    out = list(chunks)
    if not all(isinstance(c, str) for c in out):
        raise TypeError("every chunk must be a string")
    return out


def _frame(chunks: list[str]) -> DataFrame:
    return active_session().createDataFrame(list(enumerate(chunks)), "index long, text string")


def _checked(df: DataFrame) -> DataFrame:
    if dict(df.dtypes).get("text") != "string":
        raise TypeError("the text column must be a string")
    return df


def dedupe_chunks(chunks: Iterable[str] | DataFrame, *, return_stats: bool = False, near_duplicate_threshold: float = 0.9, exact: bool = True, normalized: bool = True, near_duplicates: bool = True, order: list[str] | None = None):
    """Chunks without duplicates, the first of each kept.

    Of a DataFrame with `text`, and `index` or the columns of `order` to sort by, a
    Deduped of DataFrames is returned; of strings, those retained or, with
    return_stats, a DedupeResult."""
    flags = (near_duplicate_threshold, exact, normalized, near_duplicates)
    if isinstance(chunks, DataFrame):
        rows = _checked(chunks)
        return D.dedupe(with_index(rows, *order) if order else rows, *flags)
    texts = _listed(chunks)
    D.check_config(*flags)
    with spark_job("dedupe_chunks"):
        found = D.dedupe(_frame(texts), *flags)
        retained = [r.text for r in found.retained.orderBy("index").collect()]
        if not return_stats:
            return retained
        removed = [r.asDict() for r in found.removed.orderBy("index").collect()]
    groups: dict[int, dict] = {}
    for r in removed:
        group = groups.setdefault(r["retained_index"], {"retained_index": r["retained_index"], "retained_chunk": r["retained_chunk"], "duplicates": []})
        group["duplicates"].append(r)
    return DedupeResult(retained, [r["chunk"] for r in removed], len(removed), len(removed) / len(texts) if texts else 0.0, list(groups.values()), removed)


def score_chunks(chunks: Iterable[str] | DataFrame):
    """Scores and warnings of chunks, with all registered scorers."""
    if isinstance(chunks, DataFrame):
        return score(_checked(chunks))
    texts = _listed(chunks)
    with spark_job("score_chunks"):
        return [Chunk(r.text, r.tokens, r.score, list(r.warnings)) for r in score(_frame(texts)).orderBy("index").collect()]
