"""Documents in batches, with duplicates removed across them.

A chunk is dropped if its text, or its case-folded words, occurred in an earlier
batch; near duplicates are looked for within a batch only. Three forms give the same
chunks: a generator over files, one plan over a table with a batch column, and a
Structured Streaming query whose hashes seen so far are kept in a table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import spark_job
from ..functions.text import normalized_hash
from ..operators.dedupe import dedupe, first_batch
from ..operators.score import score
from ..operators.stats import chunk_stats
from ..operators.tables import checkpointed, shared_folder, with_index
from ..sources import files

if TYPE_CHECKING:
    from ..plans.pipeline import Pipeline, PipelineResult, Progress

SEEN = "hash string"


class Seen:
    """Hashes of earlier batches, a Parquet table in the folder all executors share.

    Each batch is a folder of its own that is replaced whole, so a batch that is run
    again after a failure neither sees itself nor is recorded twice."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}"

    def before(self, batch: int) -> DataFrame:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(conf).exists(folder):
            return self.spark.createDataFrame([], SEEN)
        return self.spark.read.schema("hash string, batch long").parquet(self.path).where(F.col("batch") < batch).select("hash")

    def record(self, hashes: DataFrame, batch: int) -> None:
        hashes.distinct().write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def unseen(chunks: DataFrame, seen: Seen, batch: int) -> DataFrame:
    """The batch's chunks that no earlier batch had, recorded as seen."""
    hashed = chunks.withColumn("_hash", normalized_hash(F.col("text")))
    fresh = checkpointed(hashed.join(seen.before(batch).withColumnRenamed("hash", "_hash"), "_hash", "left_anti"))
    seen.record(fresh.select(F.col("_hash").alias("hash")), batch)
    return fresh.drop("_hash")


def file_batches(pipeline: Pipeline, source: str, batch_size: int = 50, progress: Progress | None = None, spark: SparkSession | None = None) -> Iterator[PipelineResult]:
    """A result for each batch of files in path order. Batches of which no chunk is
    left yield nothing. Arguments are checked when the first batch is asked for."""
    from ..plans.pipeline import PipelineResult, active_session

    if not isinstance(source, str):
        raise TypeError("a stream's source must be a path")
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    pipeline.check()
    paths, root = files.stream_files(source)
    spark = spark or active_session()
    seen = Seen(spark)
    tell = progress or (lambda *_: None)
    total = -(-len(paths) // batch_size)
    for k in range(total):
        part = paths[k * batch_size : (k + 1) * batch_size]
        for i in range(len(part)):
            tell("clean", k * batch_size + i + 1, len(paths))
        with spark_job(f"batch {k + 1}"):
            docs = files.read_files(spark, part, root)
            chunks = pipeline.chunks_of(docs)
            found = None
            if pipeline.dedupe:
                chunks = unseen(chunks, seen, k)
            if chunks.isEmpty():
                continue
            chunks = with_index(chunks, "doc_order", "chunk_index")
            if pipeline.dedupe:
                tell("dedupe", k + 1, total)
                found = dedupe(chunks, settled=True)
                chunks = found.retained
            tell("score", k + 1, total)
            result = PipelineResult(docs, score(chunks) if pipeline.score else chunks, found, pipeline.score, warn_if_empty=False)
        yield result


def batched(pipeline: Pipeline, docs: DataFrame, batch: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """All batches in one plan: retained chunks (scored if the pipeline scores) with
    their batch, and statistics by batch. docs: source_document, doc_order, text and
    the batch column, an increasing number. Batches without chunks have no row."""
    chunks = pipeline.chunks_of(docs, batch)
    ratio = None
    if pipeline.dedupe:
        chunks = first_batch(chunks, batch, normalized_hash(F.col("text")))
        chunks = with_index(chunks, batch, "doc_order", "chunk_index")
        found = dedupe(chunks, scope=batch, settled=True)
        chunks, ratio = found.retained, found.stats.select(batch, "duplicate_ratio")
    if pipeline.score:
        chunks = score(chunks, scope=batch)
    sizes = docs.groupBy(batch).agg(F.count("*").alias("total_documents"))
    stats = chunk_stats(chunks, batch).join(sizes, batch)
    stats = stats.join(ratio, batch) if ratio is not None else stats.withColumn("duplicate_ratio", F.lit(0.0))
    return chunks, stats.select(batch, "total_documents", "total_chunks", "average_chunk_size", "duplicate_ratio", "low_quality_chunk_count")


def start(pipeline: Pipeline, docs: DataFrame, out: str, seen_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A Structured Streaming query over a stream of documents (source_document,
    doc_order, text): each micro-batch is prepared as a batch and written to
    out/batch=N. Batches are replaced whole, so a repeated one is not doubled."""
    spark = docs.sparkSession

    def prepare(rows: DataFrame, batch: int) -> None:
        chunks = pipeline.chunks_of(rows)
        if pipeline.dedupe:
            chunks = with_index(unseen(chunks, Seen(spark, seen_path), batch), "doc_order", "chunk_index")
            chunks = dedupe(chunks, settled=True).retained
        else:
            chunks = with_index(chunks, "doc_order", "chunk_index")
        chunks = score(chunks) if pipeline.score else chunks
        chunks.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return docs.writeStream.foreachBatch(prepare).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
