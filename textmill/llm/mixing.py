"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a target in words. A source whose target reaches its size is taken
whole as often as it fits (once or twice); the words that remain are fitted by
choosing documents. For that, documents are only counted by exact length. First each
length gives its proportional share, then a bounded-knapsack table of dynamic
programming over lengths hits what is left as closely as any choice can. Which
documents of a length are taken is drawn by a seeded hash of their ids.

Only counts by (source, length) leave the documents; one source's counts are at most
one row per distinct length. What is drawn comes down to a rule for each source and
length: a bucket of hashes, and the last hash in it. The documents themselves look
their rule up and are not moved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, bounded_broadcast, checkpointed, fresh, lookup

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CEILING = 2.0
#: Documents of one source and length that are ranked in one group.
GROUP = 50_000
#: Sources that are dealt their targets on the driver, two numbers each; more are dealt by Spark.
SOURCES = 100_000
#: Words that the table of dynamic programming spans at most.
TABLE = 1 << 22
FIRST = -(2**63)
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> list[float]:
    """Words to take of each source, by its place in the order of sources.

    `share` of all words is dealt by weight; a source stops at `ceiling` times its
    size, and what it cannot take is dealt again, until none is above."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weight[i] for i in open_)
        full = [i for i in open_ if left * weight[i] / total >= ceiling * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in sorted(full):
            out[i] = ceiling * sizes[i]
        left = max(0.0, left - sum(out[i] for i in full))
        open_ -= set(full)
    return out


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near
    to `budget` as the table allows, and never above it.

    All but a span of four times the greatest length, or of TABLE words if that is
    less, is dealt in proportion. What that leaves is filled with the longest lengths
    that fit until it is within the span; then reach[s] says which step first made the
    sum s. A budget within the span is fitted by the table alone, as closely as any
    choice can."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    take = np.zeros(len(lengths), np.int64)
    useful = (lengths > 0) & (counts > 0)
    total = int((lengths * counts)[useful].sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return np.where(useful, counts, 0)
    order = [i for i in np.argsort(-lengths, kind="stable") if useful[i]]
    span = min(4 * int(lengths[order[0]]), TABLE)
    take[useful] = [int(c) * max(0, budget - span) // total for c in counts[useful]]
    left = budget - int((lengths * take).sum())
    for i in order:
        if left <= span:
            break
        k = min(int(counts[i] - take[i]), (left - span) // int(lengths[i]) + 1, left // int(lengths[i]))
        take[i] += k
        left -= k * int(lengths[i])
    if left == 0 or left > span:  # nothing more, or no length that still fits
        return take
    reach = np.full(left + 1, -1, np.int32)
    reach[0] = -2
    steps: list[tuple[int, int]] = []
    for i in reversed(order):
        size, spare = int(lengths[i]), min(int(counts[i] - take[i]), left // int(lengths[i]))
        k = 1
        while spare > 0 and reach[left] == -1:
            k = min(k, spare)
            w = k * size
            if w <= left:
                made = (reach[: left + 1 - w] != -1) & (reach[w:] == -1)
                reach[w:][made] = len(steps)
                steps.append((i, k))
            spare -= k
            k *= 2
        if reach[left] != -1:
            break
    at = int(np.flatnonzero(reach != -1)[-1])
    while at:
        i, k = steps[reach[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def aims(totals: DataFrame) -> DataFrame:
    """The target of every source: totals (source, source_size) with target. Sources are
    weighted in the order of their code points, null last."""
    spark = totals.sparkSession
    schema = "source string, source_size long, target double"
    ordered = totals.orderBy(F.col("source").asc_nulls_last())
    rows = ordered.limit(SOURCES + 1).collect()
    if len(rows) <= SOURCES:
        goal = targets([r.source_size for r in rows])
        return spark.createDataFrame([(r.source, r.source_size, float(g)) for r, g in zip(rows, goal)], schema)
    # The same rounds as in `targets`, each an aggregate over the sources.
    placed = checkpointed(totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, n = [], 0
    for r in placed.groupBy("part").count().orderBy("part").collect():
        before.append((r.part, n))
        n += r["count"]
    at = F.pmod(F.col("before") + F.col("nth"), F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (at + 1).cast("int"))
    state = placed.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part").select("source", "source_size", weight.alias("w"), F.lit(None).cast("double").alias("target"))
    left = SHARE * float(state.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        state = checkpointed(state)
        total = state.where("target is null").agg(F.sum("w")).first()[0]
        if not total:
            break
        share = F.lit(left) * F.col("w") / F.lit(total)
        top = F.lit(CEILING) * F.col("source_size")
        full = F.col("target").isNull() & (share >= top)
        gone = state.where(full).agg(F.sum(top), F.count("*")).first()
        if not gone[1]:
            state = state.withColumn("target", F.coalesce("target", share))
            break
        state = state.withColumn("target", F.when(full, top).otherwise(F.col("target")))
        left = max(0.0, left - gone[0])
    return state.select("source", "source_size", "target")


PLAN = "source string, size long, n long, source_size long, target double, whole long, extra long"


def plan(counts: DataFrame) -> DataFrame:
    """For each (source, size): the source's size and target, how often all of its
    documents are taken, and how many are taken once more. counts: source, size, n."""
    goals = aims(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))).withColumnRenamed("source", "s")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        whole = min(int(target // size), int(CEILING)) if size else 0
        budget = int(round(target - whole * size)) if whole < CEILING else 0
        pdf = pdf.sort_values("size")
        extra = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget)
        return pdf.assign(whole=whole, extra=extra)[["source", "size", "n", "source_size", "target", "whole", "extra"]]

    joined = counts.join(bounded_broadcast(goals, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "source_size", "target")
    return joined.groupBy("source").applyInPandas(fit, PLAN)


def _draw(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text")


def rules(sized: DataFrame) -> DataFrame:
    """What is taken of each (source, size): source, size, n, source_size, target, whole,
    buckets, and the rows taken once more: those of a bucket before `bucket`, and in it
    those before or at (draw, doc_id); of the `same` rows at that place only `few`.
    sized: doc_id, source, size, draw."""
    counts = checkpointed(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    planned = checkpointed(plan(counts).withColumn("buckets", F.ceil(F.col("n") / GROUP).cast("long")))
    part = planned.where((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).select("source", "size", "n", "extra", "buckets")
    asked = _met(sized, part, "inner").withColumn("bucket", F.pmod("draw", "buckets"))
    own = asked.groupBy("source", "size", "bucket").agg(F.count("*").alias("own"), F.first("extra").alias("extra"))
    until = F.sum("own").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    # The bucket in which the quota runs out, one of each group.
    last = own.withColumn("until", until).where((F.col("until") >= F.col("extra")) & (F.col("until") - F.col("own") < F.col("extra")))
    last = checkpointed(last.select("source", "size", "bucket", (F.col("extra") - F.col("until") + F.col("own")).alias("quota"), F.col("own").alias("n")))
    inside = _met(sized, part.select("source", "size", "n", "buckets"), "inner").withColumn("bucket", F.pmod("draw", "buckets")).drop("n", "buckets")
    inside = _met(inside, last, "inner", "bucket")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", F.coalesce("doc_id", F.lit(FIRST))))
    ranked = inside.withColumn("rank", rank)
    keys = ["source", "size", "bucket", "draw", "doc_id"]
    cut = ranked.groupBy(*keys).agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.first("quota").alias("quota")).where("first <= quota and quota <= last")
    cut = cut.select("source", "size", "bucket", F.col("draw").alias("until_draw"), F.coalesce("doc_id", F.lit(FIRST)).alias("until_id"), (F.col("quota") - F.col("first") + 1).alias("few"), (F.col("last") - F.col("first") + 1).alias("same"))
    s, z = F.col("source").eqNullSafe(F.col("_s")), F.col("size") == F.col("_z")
    return planned.join(cut.withColumnsRenamed({"source": "_s", "size": "_z"}), s & z, "left").drop("_s", "_z")


def _met(rows: DataFrame, table: DataFrame, how: str, *more: str) -> DataFrame:
    """rows joined with a table by source, null being one, size, and more; both keep
    them, and table's `n` counts its rows."""
    null, name = fresh(rows, "null", "name")
    safe = lambda df: df.withColumns({null: F.col("source").isNull(), name: F.coalesce("source", F.lit(""))})
    return lookup(safe(rows), safe(table).drop("source"), [null, name, "size", *more], "n", how).drop(null, name)


def _taken(rows: DataFrame, found: DataFrame, into: str) -> DataFrame:
    """rows (doc_id, source, size, draw, and others) with source_size, target and, as
    `into`, how often the row is taken."""
    met = _met(rows, found, "inner").withColumn("at", F.pmod("draw", "buckets"))
    here = F.struct(F.col("draw"), F.coalesce(F.col("doc_id"), F.lit(FIRST)).alias("doc_id"))
    end = F.struct(F.col("until_draw").alias("draw"), F.col("until_id").alias("doc_id"))
    more = F.when(F.col("bucket").isNull(), F.col("extra") > 0).otherwise((F.col("at") < F.col("bucket")) | ((F.col("at") == F.col("bucket")) & (here <= end)))
    met = met.withColumn("tie", F.coalesce((F.col("at") == F.col("bucket")) & (here == end) & (F.col("few") < F.col("same")), F.lit(False)))
    met = met.withColumn(into, F.col("whole") + more.cast("long"))
    # Rows that repeat one another whole, of which only some are taken once more.
    nth = F.row_number().over(Window.partitionBy("source", "size", "draw", "doc_id").orderBy(F.lit(1)))
    ties = met.where("tie").withColumn(into, F.col("whole") + (nth <= F.col("few")).cast("long"))
    both = met.where("not tie")
    if not found.where("few < same").isEmpty():
        both = both.unionByName(ties)
    return both.select(*rows.columns, "source_size", "target", into)


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), _draw(seed).alias("draw"), *more)


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken.

    Input: doc_id, text, source; other columns are ignored. The same rows give the
    same mix. Null and empty texts have size 0 and nothing is taken of them. A null
    source is a source of its own, last in order. Documents of equal id and size in
    one source are told apart by their text's hash; of rows that repeat one another
    whole any are drawn, which changes no row of the result. An empty table gives no
    rows. Texts are counted whole, however long.

    A hot source of one length doesn't meet in one task: rules are broadcast where they
    are counted few, and hot ones always; each group is spread over hash buckets of
    about 50,000 documents and only the bucket where the quota runs out is ranked."""
    sized = checkpointed(_sized(docs, seed))
    out = _taken(sized, checkpointed(rules(sized)), "copies")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The per-document result of the mix."""
    return mix(docs)


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of docs that the mix takes, with `copies`, how often (1 or 2).

    Input as in `mix`, any other columns kept but one named copies, which is replaced;
    null and empty texts are not taken. The rows stay where they are."""
    found = checkpointed(rules(checkpointed(_sized(docs, seed))))
    row = F.struct(*[F.col(c) for c in docs.columns if c != "copies"]).alias("row")
    out = _taken(_sized(docs, seed, row), found, "copies").where("size > 0 and copies > 0")
    return out.select("row.*", F.col("copies").cast("int").alias("copies"))
