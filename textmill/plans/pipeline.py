"""The pipeline: load, clean, chunk, dedupe, score, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reports
from ..errors import spark_job
from ..functions.chunking import check_config
from ..functions.text import clean
from ..operators import stats as A
from ..operators.chunk import chunk_rows
from ..operators.dedupe import Deduped, dedupe
from ..operators.score import score
from ..operators.tables import checkpointed, numbered, ordered
from ..sources import files
from ..types import Chunk, ChunkMetadata, PipelineStats

Progress = Callable[[str, int, int], None]


def active_session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@dataclass
class PipelineResult:
    """DataFrames of a run, and the same as Python values, collected when asked for.

    chunk_table has the retained chunks in `index` order with their place and, when
    scored, tokens, score and warnings; duplicates is the dedupe's result or None."""

    documents: DataFrame
    chunk_table: DataFrame
    duplicates: Deduped | None
    scored: bool
    warn_if_empty: bool = True
    _fixed: dict = field(default_factory=dict)

    @cached_property
    def stats_table(self) -> DataFrame:
        """One row of statistics."""
        total = self.documents.agg(F.count("*").alias("total_documents"))
        ratio = self.duplicates.stats.select("duplicate_ratio") if self.duplicates else None
        ratio = ratio.agg(F.coalesce(F.max("duplicate_ratio"), F.lit(0.0)).alias("duplicate_ratio")) if ratio is not None else total.select(F.lit(0.0).alias("duplicate_ratio"))
        one = lambda df: df.withColumn("_k", F.lit(1))
        joined = one(total).join(one(A.chunk_stats(self.chunk_table)), "_k").join(one(ratio), "_k")  # a row each
        return joined.select("total_documents", "total_chunks", "average_chunk_size", "duplicate_ratio", "low_quality_chunk_count")

    @cached_property
    def stats(self) -> PipelineStats:
        with spark_job("stats"):
            return PipelineStats.of(self.stats_table.first())

    @cached_property
    def _rows(self) -> list:
        """All chunks, on the driver: for results that fit there. chunk_table doesn't."""
        with spark_job("chunks"):
            return self.chunk_table.orderBy("index").collect()

    @property
    def chunks(self) -> list[str]:
        return [r.text for r in self._rows]

    @property
    def scored_chunks(self) -> list[Chunk]:
        if not self.scored:
            return []
        return [Chunk.of(r) for r in self._rows]

    @property
    def chunk_metadata(self) -> list[ChunkMetadata]:
        return [ChunkMetadata.of(r) for r in self._rows]

    @cached_property
    def warnings(self) -> list[str]:
        return ["no_chunks_created"] if self.warn_if_empty and not self.stats.total_chunks else []

    def save_report(self, path: str) -> None:
        reports.save(self, path)


@dataclass(slots=True)
class Pipeline:
    """Prepare documents. `report` changes nothing; reports are written on request."""

    clean: bool = True
    chunk_size: int = 512
    overlap: int = 64
    dedupe: bool = True
    score: bool = True
    report: bool = True

    def check(self) -> None:
        check_config(self.chunk_size, self.overlap)

    def chunks_of(self, docs: DataFrame, *keep: str) -> DataFrame:
        """Chunk rows of docs (source_document, doc_order, text), with their places.
        No shuffle: each document is cleaned, cut and searched where it lies."""
        if self.clean:
            docs = docs.withColumn("text", clean(F.col("text")))
        return chunk_rows(docs.select("source_document", "doc_order", *keep, "text"), chunk_size=self.chunk_size, overlap=self.overlap, single_line=self.clean)

    def run_documents(self, docs: DataFrame) -> PipelineResult:
        """Run over a DataFrame with source_document, doc_order (sortable) and text."""
        self.check()
        chunks = self.indexed(docs)
        found = dedupe(chunks, settled=True) if self.dedupe else None
        kept = found.retained if found else chunks
        return PipelineResult(docs, score(kept) if self.score else kept, found, self.score)

    def indexed(self, docs: DataFrame) -> DataFrame:
        """The chunks of docs with their number over all. Documents are put in order
        before they are cut, so the order is found without cutting them."""
        return numbered(self.chunks_of(ordered(docs, "doc_order")))

    def run(self, source: str | DataFrame, *, progress: Progress | None = None, spark: SparkSession | None = None) -> PipelineResult:
        """Run over a raw text, a file, a folder, or a DataFrame of documents.

        progress(stage, current, total) is called for each document once all are cleaned
        and cut, and before and after the stages over all chunks; with it, each stage is
        run before the next is planned."""
        if not isinstance(source, (str, DataFrame)):
            raise TypeError("the source must be a path, a text or a DataFrame")
        self.check()
        docs = source if isinstance(source, DataFrame) else files.load(spark or active_session(), source)
        with spark_job("pipeline"):
            if progress is None:
                return self.run_documents(docs)
            chunks = self.indexed(docs)  # runs here
            total = docs.count()
            for i in range(total):
                progress("clean", i + 1, total)
            found = None
            if self.dedupe:
                progress("dedupe", 0, 1)
                found = dedupe(chunks, settled=True)
                chunks = checkpointed(found.retained)
                progress("dedupe", 1, 1)
            progress("score", 0, 1)
            result = PipelineResult(docs, checkpointed(score(chunks)) if self.score else chunks, found, self.score)
            progress("score", 1, 1)
            return result

    def stream(self, source: str, *, batch_size: int = 50, progress: Progress | None = None, spark: SparkSession | None = None):
        """One result per batch of files; see streaming.batches."""
        from ..streaming.batches import file_batches

        return file_batches(self, source, batch_size, progress, spark)
