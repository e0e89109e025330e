"""Order keys, checkpoints and joins that the operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task may hold, whatever their share.
HOT_ROWS = 100_000
#: Rows of a table of numbers or short strings that may be broadcast.
BROADCAST_ROWS = 100_000
#: Rows of a table of texts that may be broadcast.
WIDE_ROWS = 1_000
#: Bits of a row's number within its partition, as Spark numbers rows.
_LOCAL = (1 << 33) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where a session that runs
    in this process alone names none, one is made; a cluster must name its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and (not str(sc.master).startswith("local") or str(sc.master).startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="textmill-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def lookup(rows: DataFrame, table: DataFrame, on: list[str], copies: str, how: str = "left", wide: bool = False) -> DataFrame:
    """rows joined ("left" or "inner") with table, which has one row for each value of
    `on` and says in `copies` how many of rows have it. The rows don't move where the
    table is counted small. Else values of more than a thousandth of rows, at most a
    thousand, are broadcast, and only the rest meets by shuffle. wide: the table has long
    texts, so no more than a thousand rows are small. A null in `on` finds nothing; no
    column of table but `on` may be one of rows."""
    table = checkpointed(table)
    found = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(copies), F.lit(0)).alias("total")).first()
    if found.n <= (WIDE_ROWS if wide else BROADCAST_ROWS):
        return rows.join(F.broadcast(table), on, how)
    values = [c for c in table.columns if c not in on]
    most = max(HOT_ROWS, found.total // 1000)
    few = table.where(F.col(copies) > most)
    cold = table.where(F.col(copies) <= most)
    if few.isEmpty():
        return rows.join(cold, on, how)
    hot, salt, met = fresh(rows.join(table.limit(0), on), "hot", "salt", "met")
    few = few.select(*on, F.struct(*values).alias(hot))
    # Rows that have met their value must not meet under it again.
    spread = F.when(F.col(hot).isNull(), F.lit(-1)).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
    both = rows.join(F.broadcast(few), on, "left").withColumn(salt, spread)
    both = both.join(cold.withColumns({salt: F.lit(-1).cast("long"), met: F.lit(True)}), [*on, salt], "left")
    if how == "inner":
        both = both.where(F.col(hot).isNotNull() | F.col(met))
    return both.select(*rows.columns, *[F.coalesce(F.col(hot)[c], F.col(c)).alias(c) for c in values])


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """df with its partitions, and the rows in each, in the given order."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def numbered(df: DataFrame, name: str = "index") -> DataFrame:
    """df, whose partitions and rows are in order, with a dense number from 0.

    Only the partitions' counts reach the driver, so nothing is numbered in one task. The
    result is checkpointed, for its partitions must not move between count and numbering."""
    at, part, before = fresh(df, "at", "part", "before")
    placed = checkpointed(df.withColumn(at, F.monotonically_increasing_id()))
    offset, offsets = 0, []
    for row in placed.groupBy(F.shiftright(at, 33).alias(part)).count().orderBy(part).collect():
        offsets.append((row[part], offset))
        offset += row["count"]
    table = df.sparkSession.createDataFrame(offsets, f"{part} long, {before} long")
    joined = placed.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(table), part)
    return joined.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit(_LOCAL))).drop(at, part, before)


def with_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """df with a dense number from 0 in the given order."""
    return numbered(ordered(df, *order), name)
