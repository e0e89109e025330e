"""What the operators share of Spark: checkpoints, tables and size checks."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import mix


#: Rows of one value that a task may hold, whatever their share.
HOT_ROWS = 100_000
#: Rows of a table of numbers or short strings that may be broadcast.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only where the
    session names none, as in tests, one is made here."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not str(sc.master).startswith("local") or str(sc.master).startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textmill-checkpoint-"))
        named = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return str(named).rstrip("/")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and checkpoints that nothing refers to any more, and
    give the memory that this process and the driver's JVM have freed back to the system."""
    gc.collect()
    _collected(spark)
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library, which has no such call
            pass


def _collected(spark: SparkSession) -> None:
    """A full collection of the driver's JVM after which a fifth of its heap is free, not
    the usual seven tenths, and its freed native memory is returned. The JVM's settings
    are as before then; one that lacks these calls only collects."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    beans = jvm.java.lang.management.ManagementFactory
    named = jvm.java.lang.Class.forName

    def call(kind: str, target, name: str, types: list[str], *values):
        # Through the interface, since the class that implements it isn't exported.
        classes, given = gateway.new_array(jvm.java.lang.Class, len(types)), gateway.new_array(jvm.java.lang.Object, len(types))
        for k, (t, v) in enumerate(zip(types, values)):
            classes[k], given[k] = named(t), v
        return named(kind).getMethod(name, classes).invoke(target, given)

    text, hotspot = "java.lang.String", "com.sun.management.HotSpotDiagnosticMXBean"
    before: dict[str, str] = {}
    try:
        options = beans.getPlatformMXBean(named(hotspot))
        for name, value in (("MinHeapFreeRatio", "10"), ("MaxHeapFreeRatio", "20")):
            old = call(hotspot, options, "getVMOption", [text], name).getValue()
            call(hotspot, options, "setVMOption", [text, text], name, value)
            before[name] = old
    except Py4JError:
        pass
    jvm.System.gc()
    try:
        for name in reversed(before):
            call(hotspot, options, "setVMOption", [text, text], name, before[name])
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call("javax.management.MBeanServer", beans.getPlatformMBeanServer(), "invoke", ["javax.management.ObjectName", text, "[Ljava.lang.Object;", "[Ljava.lang.String;"], commands, "systemTrimNativeHeap", None, None)
    except Py4JError:
        pass


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id's text is 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that df doesn't have; names that start alike
    keep to the ones given."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def lookup(rows: DataFrame, table: DataFrame, on: list[str], copies: str, how: str = "left", most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined ("left" or "inner") with table, which has one row for each value of
    `on` and says in `copies` how many of rows have it. The rows don't move where the
    table is counted to have most_rows at most. Else values of more than a thousandth of rows, at most a
    thousand, are broadcast, and only the rest meets by shuffle. A null in `on` finds
    nothing; no column of table but `on` may be one of rows."""
    table = checkpointed(table)
    found = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(copies), F.lit(0)).alias("total")).first()
    if found.n <= most_rows:
        return rows.join(F.broadcast(table), on, how)
    values = [c for c in table.columns if c not in on]
    most = max(HOT_ROWS, found.total // 1000)
    hot, salt, met = fresh(rows.join(table.limit(0), on), "hot", "salt", "met")
    few = table.where(F.col(copies) > most).select(*on, F.struct(*values).alias(hot))
    cold = table.where(F.col(copies) <= most)
    if few.isEmpty():
        return rows.join(cold, on, how)
    # Rows that have met their value must not meet under it again.
    spread = F.when(F.col(hot).isNull(), F.lit(-1)).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
    both = rows.join(F.broadcast(few), on, "left").withColumn(salt, spread)
    both = both.join(cold.withColumns({salt: F.lit(-1).cast("long"), met: F.lit(True)}), [*on, salt], "left")
    if how == "inner":
        both = both.where(F.col(hot).isNotNull() | F.col(met))
    return both.select(*rows.columns, *[F.coalesce(F.col(hot)[c], F.col(c)).alias(c) for c in values])


def drawn(rows: DataFrame, by: str, most: int) -> DataFrame:
    """For each value of `by` at most so many distinct doc_ids, those of the least
    hashes: columns `by` and doc_id. rows: `by` and doc_id, a long, neither null.

    Every partition sends on only its own least ones, so a value that fills the table
    costs no more than another."""
    name = rows.schema[by]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[object, np.ndarray] = {}
        for batch in batches:
            values, codes = np.unique(batch.column(by).to_numpy(zero_copy_only=False), return_inverse=True)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for k, v in enumerate(values.tolist()):
                both = np.unique(np.concatenate([best.get(v, ids[:0]), ids[codes == k]]))
                best[v] = both[np.lexsort((both, _scattered(both)))[:most]]
        for v, ids in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(ids)).cast(batch.column(by).type), pa.array(ids), pa.array(_scattered(ids).view(np.int64))], names=[by, "doc_id", "h"])

    schema = T.StructType([name, T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType())])
    found = rows.select(by, "doc_id").mapInArrow(least, schema).distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy("h", "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select(by, "doc_id")


def _scattered(ids: np.ndarray) -> np.ndarray:
    """A hash of each id; its order, as a signed number, is that of the draw."""
    return (mix(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(1)).astype(np.uint64)


def small(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; stops counting soon after."""
    return df.limit(most + 1).count() <= most


def bounded_broadcast(df: DataFrame, most: int) -> DataFrame:
    """A broadcast hint only where the counted rows are few enough."""
    return F.broadcast(df) if small(df, most) else df
