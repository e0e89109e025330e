"""Aggregates over documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import LOW_QUALITY
from ..functions.text import python_word_count

RECOMMENDATIONS = (
    ("duplicates", "Many chunks repeat one another: look at the sources before embedding them."),
    ("low_quality", "Some chunks score low: read them, then adjust cleaning or the chunk size."),
    ("small_chunks", "Chunks are small on average: a larger chunk_size may serve better."),
    ("boilerplate", "Site boilerplate was found: remove it with rules for its sources."),
    ("long_chunks", "Some chunks are very long: lower chunk_size or split by structure."),
)


def chunk_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """total_chunks, average_chunk_size and, where chunks are scored, the number of low scores."""
    low = F.coalesce(F.count_if(F.col("score") < LOW_QUALITY), F.lit(0)) if "score" in chunks.columns else F.lit(0)
    return chunks.groupBy(*by).agg(
        F.count("*").alias("total_chunks"),
        F.coalesce(F.avg(python_word_count(F.col("text"))), F.lit(0.0)).alias("average_chunk_size"),
        low.cast("long").alias("low_quality_chunk_count"),
    )


def warning_histogram(scored: DataFrame) -> DataFrame:
    """How many chunks have each warning. Alike arrays are counted first: exploding those
    of every chunk would have them made once more for a test of their size."""
    alike = scored.groupBy("warnings").agg(F.count("*").alias("n"))
    return alike.select(F.explode("warnings").alias("warning"), "n").groupBy("warning").agg(F.sum("n").alias("chunks"))


def warning_flags(scored: DataFrame) -> DataFrame:
    """One row: whether any chunk has the warnings that recommendations look at."""
    has = lambda name: F.coalesce(F.bool_or(F.array_contains("warnings", name)), F.lit(False))
    return scored.agg(has("boilerplate").alias("boilerplate"), has("too_long").alias("too_long"))


def recommendations(stats: DataFrame, flags: DataFrame) -> DataFrame:
    """One row with the array of recommendation names, in their order."""
    rules = (
        (F.col("duplicate_ratio") > 0.1, "duplicates"),
        (F.col("low_quality_chunk_count") > 0, "low_quality"),
        ((F.col("average_chunk_size") < 80) & (F.col("total_chunks") > 0), "small_chunks"),
        (F.col("boilerplate"), "boilerplate"),
        (F.col("too_long"), "long_chunks"),
    )
    one = stats.withColumn("_k", F.lit(1)).join(flags.withColumn("_k", F.lit(1)), "_k")  # a row each
    return one.select(F.array_compact(F.array(*(F.when(when, F.lit(name)) for when, name in rules))).alias("recommendations"))


def chunk_summary(scored: DataFrame) -> DataFrame:
    """One line about each chunk, as reports show it."""
    named = F.when(F.size("warnings") > 0, F.array_join("warnings", ", ")).otherwise("none")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = F.concat(F.lit("Score: "), text("score"), F.lit("  Tokens: "), text("tokens"), F.lit("  Warnings: "), named, F.lit("  Source: "), text("source_document"), F.lit("  Index: "), text("chunk_index"), F.lit("  Offsets: "), text("start_offset"), F.lit(".."), text("end_offset"))
    return scored.withColumn("summary", line)
