"""Tables of documents as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table. One that would be read in fewer tasks than there are cores, such as a
    single file of one row group, is spread over them; a large one is read as it is."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(df: DataFrame, text: str, key: str) -> DataFrame:
    """source_document, doc_order, text of any table with a text and an ordered key."""
    if dict(df.dtypes).get(text) != "string":
        raise TypeError(f"column {text} must be a string")
    return df.select(F.col(key).cast("string").alias("source_document"), F.col(key).alias("doc_order"), F.col(text).alias("text"))
