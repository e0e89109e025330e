"""Duplicate chunks: exact, normalised and near, the first occurrence wins.

The result is that of a scan in order that compares each chunk with those retained so
far. It is reached without a scan: chunks of one normalised text stand or fall by
their first one; near duplicates among those are edges found by a prefix-filtered
shingle join; and the scan's choice is the lexicographically first maximal independent
set of the edges, settled in rounds of all chunks whose earlier neighbours are settled.

Until the rows are put together, chunks are only numbers: their index, hashes of their
texts, and their shingles as sorted 64-bit hashes, written once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, normalize_for_dedupe, round3
from .tables import checkpointed, fresh, lookup

EPSILON = 1e-9
#: Counts by which shingles are ordered, rarest first.
CELLS = 1 << 20
#: A prefix hash of more chunks than CROWD may be settled by its leaders.
CROWD = 100
#: Chunks of one hash or family that a task holds at once; more meet in parts.
PART = 1000
#: Rows of a few numbers that may be broadcast (some 40 MB).
NUMBERS = 1_000_000


def check_config(threshold: float, exact: bool, normalized: bool, near_duplicates: bool) -> None:
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)):
        raise TypeError("near_duplicate_threshold must be a number")
    if not 0 <= threshold <= 1:
        raise ValueError("near_duplicate_threshold must be from 0 to 1")
    for name, flag in (("exact", exact), ("normalized", normalized), ("near_duplicates", near_duplicates)):
        if not isinstance(flag, bool):
            raise TypeError(f"{name} must be a bool")


@dataclass
class Deduped:
    """rows: those given. gone: index, retained_index, kind and similarity of those that
    are removed, and the scope column where there is one. Texts are joined when asked for."""

    rows: DataFrame
    gone: DataFrame
    scope: list[str]

    @cached_property
    def retained(self) -> DataFrame:
        """The rows kept, all columns."""
        return self.rows.join(_sendable(self.gone.select("index")), "index", "left_anti").select(*self.rows.columns)

    @cached_property
    def removed(self) -> DataFrame:
        """index, chunk, retained_index, retained_chunk, kind, similarity, and the scope."""
        # Only the texts of duplicates and of what they repeat are sent.
        named = self.rows.select("index", F.col("text").alias("chunk")).join(_sendable(self.gone), "index")
        return lookup(named, self._texts(F.count("*").alias("c")).drop(*self.scope), ["retained_index"], "c", "inner", wide=True).select(*self.scope, "index", "chunk", "retained_index", "retained_chunk", "kind", "similarity")

    def _texts(self, *counted: Column) -> DataFrame:
        """Retained chunks with duplicates, and what is counted of these."""
        of = checkpointed(self.gone.groupBy(*self.scope, "retained_index").agg(*counted))
        text = self.rows.select(F.col("index").alias("retained_index"), F.col("text").alias("retained_chunk"))
        return text.join(_sendable(of), "retained_index")

    @property
    def groups(self) -> DataFrame:
        """One row per retained chunk with duplicates, in the order of first_duplicate;
        its members are the rows of `removed` with its retained_index."""
        return self._texts(F.count("*").alias("duplicates"), F.min("index").alias("first_duplicate")).select(*self.scope, "retained_index", "retained_chunk", "duplicates", "first_duplicate")

    @property
    def stats(self) -> DataFrame:
        """total, retained and duplicate counts and the duplicate ratio, by scope."""
        both = self.rows.select(*self.scope, F.lit(0).alias("gone")).unionByName(self.gone.select(*self.scope, F.lit(1).alias("gone")))
        gone = F.coalesce(F.sum("gone"), F.lit(0)).cast("long")
        total = (F.count("*") - gone).alias("total")
        return both.groupBy(*self.scope).agg(total, (F.count("*") - 2 * gone).alias("retained_count"), gone.alias("duplicate_count"), F.coalesce(F.try_divide(gone, F.count("*") - gone), F.lit(0.0)).alias("duplicate_ratio"))


def _sendable(table: DataFrame) -> DataFrame:
    """table, of a few numbers a row, with a broadcast hint where its rows are counted few."""
    return F.broadcast(table) if table.limit(NUMBERS + 1).count() <= NUMBERS else table


def _sets(chunks: DataFrame, by: list[str]) -> DataFrame:
    """The sorted hashes of each row's shingles and their number, of rows (index, norm)."""
    word = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    triples = lambda h: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - 2), lambda i: F.xxhash64(h[i - 1], h[i], h[i + 1])))
    several = let(word(F.split("norm", " ")), lambda h: F.when(F.size(h) < 3, F.array(F.xxhash64("norm"))).otherwise(triples(h)))
    hashed = F.array_sort(several)
    return checkpointed(chunks.where("norm <> ''").select(*by, "index", hashed.alias("set")).withColumn("n", F.size("set")))


def _cells(shingle: np.ndarray) -> np.ndarray:
    return (shingle.view(np.uint64) >> np.uint64(44)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles fall in each of CELLS cells; at most a row a cell is sent to
    the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(_cells(batch.column("set").flatten().to_numpy()), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    few = sets.select("set").coalesce(sets.sparkSession.sparkContext.defaultParallelism)  # a table of cells each
    rows = few.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def _prefixes(sets: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """The hashes that each set is looked up by: index, n, h.

    Sets of size n can only reach the threshold if they share one of the first
    n - ceil(threshold * n) + 1 shingles of one global order. That order is by how often
    a shingle's cell is met, the rarest first, so a common phrase is in a prefix only
    where a chunk holds little else."""
    often = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))  # CELLS numbers
    keep = [*by, "index", "n"]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = batch.column("set"), batch.column("n").to_numpy().astype(np.int64)
            value, owner = found.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            order = np.lexsort((value, often.value[_cells(value)], owner))
            nth = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
            length = n - np.ceil(threshold * n - EPSILON).astype(np.int64) + 1
            first = nth < length[owner]
            row = pa.array(owner[first])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in keep), pa.array(value[order][first])], names=[*keep, "h"])

    schema = T.StructType([*(sets.schema[c] for c in keep), T.StructField("h", T.LongType())])
    return sets.select(*keep, "set").mapInArrow(heads, schema)


def _meeting(heads: DataFrame, by: list[str]) -> DataFrame:
    """Of heads those whose hash several chunks have: c says how many, lo which is first.
    Hashes meet here once; what only one chunk has goes no further."""
    alike = Window.partitionBy(*by, "h")
    seen = heads.withColumns({"c": F.count("*").over(alike), "lo": F.min(F.struct("index", "n")).over(alike)})
    return checkpointed(seen.where("c > 1"))


def _met(left: DataFrame, right: DataFrame, t: float, by: list[str], ordered: bool = False) -> DataFrame:
    """Pairs a of left and b of right (of _meeting, and nothing of theirs left out) that
    by their prefixes may reach the threshold; with `ordered` only those with a < b.

    What two sets have in common is in both prefixes up to where one of these ends, and
    behind it there is no more than the rest of that set. So it is at most the number of
    prefix hashes they share and the larger rest, and most pairs that met by chance go
    before their sets are sent. A crowded hash is met in parts."""
    parts = F.ceil(F.col("c") / PART).cast("int")
    x = left.select(*by, "h", F.pmod(F.xxhash64("index"), parts).cast("int").alias("part"), F.col("index").alias("a"), F.col("n").alias("na"))
    y = right.select(*by, "h", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("index").alias("b"), F.col("n").alias("nb"))
    both = x.join(y, [*by, "h", "part"]).where(F.least("na", "nb") >= t * F.greatest("na", "nb") - EPSILON)
    if ordered:
        both = both.where("a < b")
    rest = lambda n: F.ceil(t * F.col(n) - EPSILON) - 1
    most = F.col("m") + F.greatest(rest("na"), rest("nb"))
    met = both.groupBy(*by, "a", "b", "na", "nb").agg(F.count("*").alias("m"))
    return met.where((1 + t) * most >= t * (F.col("na") + F.col("nb")) - EPSILON * 1000).select(*by, "a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, t: float, by: list[str]) -> DataFrame:
    """a, b, similarity of the distinct pairs (a, b) whose full sets reach the threshold.

    Chunks of one family meet with all their pairs: a pair goes to the first chunk that
    its a is paired with, and each set is sent there once, however many pairs wait for
    it. A family of more than PART chunks is met in parts."""
    pairs = checkpointed(pairs)
    first = pairs.groupBy(*by, F.col("b").alias("a")).agg(F.min("a").alias("first"))
    named = pairs.join(first, [*by, "a"], "left").withColumn("family", F.coalesce("first", "a")).drop("first")
    many = lambda x: F.ceil(F.approx_count_distinct(x) / PART).cast("int")
    large = named.groupBy(*by, "family").agg(many("a").alias("ma"), many("b").alias("mb"), F.count("*").alias("c")).where(F.col("c") >= PART)
    parts = lambda x, m: F.pmod(F.xxhash64(x), F.coalesce(m, F.lit(1)))
    key = F.xxhash64(*by, "family", parts("a", "ma"), parts("b", "mb")).alias("key")
    sent = checkpointed(lookup(named, large, [*by, "family"], "c").select(*by, key, "a", "b"))
    asked = checkpointed(sent.select(*by, "key", F.explode(F.array("a", "b")).alias("index")).distinct())
    none = F.lit(None)
    rows = sets.join(_sendable(asked), [*by, "index"]).select(*by, "key", F.lit(0).alias("pair"), F.col("index").alias("a"), none.cast("long").alias("b"), "set")
    rows = rows.union(sent.select(*by, "key", F.lit(1), "a", "b", none.cast("array<long>")))
    schema = T.StructType([*(sets.schema[c] for c in by), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for families in _whole(batches):
            found, waiting = (families.filter(pc.equal(families.column("pair"), x)) for x in (0, 1))
            similarity = _similarities(found, waiting)
            keep = similarity >= t
            if keep.any():
                out = waiting.take(pa.array(np.flatnonzero(keep)))
                yield from pa.Table.from_arrays([*(out.column(c) for c in [*by, "a", "b"]), pa.array(similarity[keep])], names=schema.names).to_batches()

    return rows.repartition("key").sortWithinPartitions("key", "pair").mapInArrow(similar, schema)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of whole keys; rows of a key follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.flatnonzero(key == key[-1])[0])
        if held and (cut or held[-1].column("key")[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _similarities(sets: pa.Table, pairs: pa.Table) -> np.ndarray:
    """The similarity of each pair (key, a, b) of sets (key, a, set); -1 where they share
    nothing."""
    listed = sets.column("set").combine_chunks()
    n = pc.list_value_length(listed).to_numpy().astype(np.int64)
    start = np.cumsum(n) - n
    values, code = np.unique(listed.flatten().to_numpy(), return_inverse=True)
    keys, ids = np.unique(sets.column("key").to_numpy()), np.unique(sets.column("a").to_numpy())
    name = lambda key, index: np.searchsorted(keys, key) * len(ids) + np.searchsorted(ids, index)
    own = name(sets.column("key").to_numpy(), sets.column("a").to_numpy())
    order = np.argsort(own)
    a, b = (order[np.searchsorted(own[order], name(pairs.column("key").to_numpy(), pairs.column(x).to_numpy()))] for x in ("a", "b"))
    shared = np.zeros(len(a), np.int64)
    marked = np.zeros(len(values), bool)
    by_a = np.argsort(a, kind="stable")
    bounds = np.flatnonzero(np.diff(a[by_a], prepend=-1, append=-1)) if len(a) else []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        mine = code[start[a[by_a[lo]]] :][: n[a[by_a[lo]]]]
        marked[mine] = True
        for at in range(lo, hi, PART):
            some = by_a[at : min(hi, at + PART)]
            size = n[b[some]]
            first = np.cumsum(size) - size
            place = np.arange(size.sum()) + np.repeat(start[b[some]] - first, size)
            shared[some] = np.add.reduceat(marked[code[place]], first, dtype=np.int64)
        marked[mine] = False
    return np.where(shared > 0, shared / (n[a] + n[b] - shared), -1.0)


def near_pairs(chunks: DataFrame, threshold: float, scope: list[str] | None = None) -> DataFrame:
    """All pairs a < b of rows (index, norm) whose shingle sets share at least one
    member and have similarity >= threshold: a, b, similarity, and the scope."""
    by, t = scope or [], float(threshold)
    sets = _sets(chunks, by)
    met = _meeting(_prefixes(sets, t, by), by)
    return _verified(_met(met, met, t, by, ordered=True), sets, t, by)


def _thinned(met: DataFrame, sets: DataFrame, t: float, by: list[str]) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Settle crowded buckets without forming their pairs: what is left of met, the
    chunks surely kept and those surely removed (None where there was no round).

    A chunk that is the earliest in every bucket it is in meets no earlier candidate,
    so a scan keeps it; whatever in its buckets reaches the threshold with it is
    removed. Both leave, in pairs linear in the buckets' sizes, and the next round
    looks at the rest: a family of near copies is gone after its first member led. A
    family that is merely alike would lose one member a round, so there is a next round
    only where the last one halved the pairs, and none where rows outnumber them."""
    kept = removed = last = None
    while True:
        crowded = met.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.when(F.col("c") > CROWD, (F.col("c") - 1) / 2)), F.lit(0.0)).alias("pairs")).first()
        if crowded.pairs <= (CROWD // 100) * crowded.rows or (last is not None and crowded.pairs > last / 2):
            return met, kept, removed
        last = crowded.pairs
        leads = F.every(F.col("index") == F.col("lo.index"))
        leaders = checkpointed(met.groupBy(*by, "index").agg(leads.alias("leads")).where("leads").select(*by, "index"))
        like = F.least("n", "lo.n") >= t * F.greatest("n", "lo.n") - EPSILON
        behind = met.where((F.col("index") > F.col("lo.index")) & like).select(*by, F.col("lo.index").alias("a"), F.col("index").alias("b")).distinct()
        pairs = behind.join(_sendable(leaders.withColumnRenamed("index", "a")), [*by, "a"], "left_semi")
        hit = checkpointed(_verified(pairs, sets, t, by).select(*by, F.col("b").alias("index")).distinct())
        kept = leaders if kept is None else kept.union(leaders)
        removed = hit if removed is None else removed.union(hit)
        met = _meeting(met.select(*by, "index", "n", "h").join(_sendable(leaders.union(hit)), [*by, "index"], "left_anti"), by)


def first_independent(edges: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Which nodes of the edges (a < b) a scan in order would retain: node, kept.

    Each round settles every node whose earlier neighbours are settled; the number of
    rounds is that of the longest chain of dependencies, short for chance orders."""
    scope = scope or []
    on = [*scope, "b"]
    nodes = edges.select(*scope, F.col("a").alias("node")).union(edges.select(*scope, F.col("b").alias("node"))).distinct()
    state = checkpointed(nodes.withColumn("s", F.lit(0)))  # 0 open, 1 kept, 2 removed
    while True:
        earlier = edges.join(state.withColumnRenamed("node", "a"), [*scope, "a"])
        seen = earlier.groupBy(*on).agg(F.max((F.col("s") == 1).cast("int")).alias("kept"), F.max((F.col("s") == 0).cast("int")).alias("open")).withColumnRenamed("b", "node")
        new = F.when(F.col("s") != 0, F.col("s")).when(F.col("kept") == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        state = checkpointed(state.join(seen, [*scope, "node"], "left").select(*scope, "node", new.alias("s")))
        if state.where("s = 0").isEmpty():
            return state.select(*scope, "node", (F.col("s") == 1).alias("kept"))


def _near(reps: DataFrame, t: float, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of rows (index, norm) with distinct normalised texts those that a scan removes as
    near duplicates (index), and which retained ones each of them is near: index, r,
    similarity."""
    sets = _sets(reps, by)
    met = _meeting(_prefixes(sets, t, by), by)
    rest, kept, gone = _thinned(met, sets, t, by)
    edges = checkpointed(_verified(_met(rest, rest, t, by, ordered=True), sets, t, by))
    state = first_independent(edges, by)
    lost = state.where("not kept").select(*by, F.col("node").alias("index"))
    if gone is not None:
        lost = checkpointed(lost.union(gone))
        # What the removed ones resemble is looked for among all that are kept.
        fallen = _sendable(lost)
        left = met.join(fallen, [*by, "index"], "left_anti")
        beside = _verified(_met(left, met.join(fallen, [*by, "index"], "left_semi"), t, by), sets, t, by)
        return lost, beside.withColumnsRenamed({"b": "index", "a": "r"})
    stays = state.where("kept").select(*by, F.col("node").alias("r"))
    both = edges.select(*by, F.col("a").alias("index"), F.col("b").alias("r"), "similarity").union(edges.select(*by, F.col("b").alias("index"), F.col("a").alias("r"), "similarity"))
    return lost, both.join(stays, [*by, "r"])


def dedupe(chunks: DataFrame, near_duplicate_threshold: float = 0.9, exact: bool = True, normalized: bool = True, near_duplicates: bool = True, scope: str | None = None, settled: bool = False) -> Deduped:
    """Remove duplicates among rows with `index` (a distinct number that gives the
    order) and `text`; with a scope column, within each of its values only. `settled`
    says that the rows are cheap to read again, as those of `with_index` are.

    Of equally similar retained chunks the earliest counts. A text that fills the table
    is counted before it is moved, and its rows then stay where they are."""
    t = near_duplicate_threshold
    check_config(t, exact, normalized, near_duplicates)
    by = [scope] if scope else []
    rows = chunks if settled else checkpointed(chunks)
    norm = normalize_for_dedupe(F.col("text"))
    by_norm = normalized or near_duplicates
    # 128 bits of each text's key stand for it.
    halves = lambda kind, x: [F.xxhash64(F.lit(kind), x), F.xxhash64(F.lit(kind + "'"), x)]
    hashed = rows.select(*by, "index", F.xxhash64("text").alias("t0"), F.xxhash64(F.lit("t"), "text").alias("t1"), norm.alias("norm"))
    text_key = halves("t", F.struct("t0", "t1")) if exact else halves("i", F.col("index"))
    keys = [F.when(F.col("norm") != "", n).otherwise(x) for n, x in zip(halves("n", F.col("norm")), text_key)] if by_norm else text_key
    keyed = hashed.select(*by, "index", "t0", "t1", (F.col("norm") != "").alias("worded"), keys[0].alias("k0"), keys[1].alias("k1"))
    keyed = checkpointed(keyed)
    on = [*by, "k0", "k1"]
    groups = keyed.groupBy(*on).agg(F.min(F.struct("index", "t0", "t1")).alias("first"), F.count("*").alias("copies"))
    # Only keys that repeat are looked up; any other chunk is its own first.
    twice = groups.where("copies > 1").select(*on, F.col("first.index").alias("rep"), F.struct("first.t0", "first.t1").alias("rep_text"), "copies")
    own = lookup(keyed, twice, on, "copies").select(*by, "index", "worded", F.coalesce("rep", "index").alias("rep"), (F.struct("t0", "t1") == F.col("rep_text")).alias("same"))
    own = checkpointed(own)
    copied = own.where("index <> rep")
    lost = beside = None
    if near_duplicates:
        first = rows.join(_sendable(copied.select("index")), "index", "left_anti").select(*by, "index", norm.alias("norm"))
        lost, beside = _near(first, t, by)
    kind = F.when(F.col("same"), "exact") if exact else F.when(F.lit(False), "exact")
    if normalized:
        kind = kind.when(F.col("worded"), "normalized")
    if lost is None:
        gone = copied.select(*by, "index", F.col("rep").alias("retained_index"), kind.otherwise("near_duplicate").alias("kind"), F.lit(1.0).alias("similarity"))
    else:
        lost = lost.select(F.col("index").alias("rep"), F.lit(True).alias("lost"))
        of = own.groupBy("rep").agg(F.count("*").alias("c")).join(lost, "rep")
        fate = lookup(own, of, ["rep"], "c")
        gone = fate.where("lost is null and index <> rep").select(*by, "index", F.col("rep").alias("retained_index"), kind.otherwise("near_duplicate").alias("kind"), F.lit(1.0).alias("similarity"))
        fallen = fate.where("lost").select(*by, "index", "rep")
        near = fallen.join(beside.withColumnRenamed("index", "rep"), [*by, "rep"]).where("r < index")
        best = near.groupBy(*by, "index").agg(F.min(F.struct((-F.col("similarity")).alias("less"), F.col("r"))).alias("x"))
        gone = gone.unionByName(best.select(*by, "index", F.col("x.r").alias("retained_index"), F.lit("near_duplicate").alias("kind"), round3(-F.col("x.less")).alias("similarity")))
    return Deduped(rows, checkpointed(gone), by)


def first_batch(chunks: DataFrame, batch: str, seen: Column) -> DataFrame:
    """Rows whose `seen` hash occurs in no earlier batch. Counting is by hash and batch
    first, and only hashes of several batches are looked up, so a hash that fills the
    input isn't gathered."""
    hash_, b, first, n = fresh(chunks, "seen", "batch", "first", "copies")
    marked = checkpointed(chunks.withColumn(hash_, seen))
    often = marked.groupBy(hash_).agg(F.min(batch).alias(first), F.max(batch).alias(b), F.count("*").alias(n)).where(F.col(first) < F.col(b)).drop(b)
    return lookup(marked, often, [hash_], n).where(F.col(first).isNull() | (F.col(batch) == F.col(first))).select(*chunks.columns)
