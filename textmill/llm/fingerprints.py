"""Document fingerprints by consistent weighted sampling.

A text's terms are its 2-word shingles, weighted by how often they occur (a text
of one word has that word). For each of K samples every term draws r and c from
Gamma(2, 1) and beta from the unit interval, the same in every text; with
t = floor(ln w / r + beta) its rank is ln c - r (t - beta) - r, and the term of
lowest rank, with its t, is the sample. Two texts share a sample with a
probability equal to their generalised Jaccard similarity, so the share of equal
samples estimates it (standard error at most 0.044 for K = 128).

The draws come from a pool of 2**18 triples sorted by the rank that they give at
weight 1. A term's position is the upper half of a 64-bit product, so at weight 1,
by far the most frequent, the least rank is simply the least position and needs
no look-up; the position's lower bits tell terms of one triple apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

K = 128
POOL_BITS = 18
FIRST = -(2**63)

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_pool: dict[str, np.ndarray] = {}


def pool() -> dict[str, np.ndarray]:
    if not _pool:
        rng = np.random.default_rng(190210)
        n = 1 << POOL_BITS
        r, c, beta = rng.gamma(2.0, 1.0, n), rng.gamma(2.0, 1.0, n), rng.random(n)
        rank = np.log(c) + r * beta - r
        order = np.argsort(rank, kind="stable")
        _pool.update(r=r[order], lc=np.log(c)[order], beta=beta[order], rank=rank[order])
        _pool.update(a=rng.integers(1, 2**63, K, dtype=np.uint64) * B.U64(2) + B.U64(1), b=rng.integers(0, 2**63, K, dtype=np.uint64))
    return _pool


def weighted_terms(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct term hashes of each text, their counts, and the texts' bounds."""
    data, off = B.flat(strings)
    starts, ends, bounds = B.words(data, off)
    h = B.span_hash(data, starts, ends)
    rows = len(off) - 1
    count = np.diff(bounds)
    row = B.row_of(bounds)
    inner = np.ones(len(h), bool)
    inner[bounds[1:][count > 1] - 1] = False
    at = np.flatnonzero(inner)
    if not len(at):
        return np.empty(0, B.U64), np.empty(0), np.zeros(rows + 1, np.int64)
    alone = count[row[at]] == 1
    term = np.where(alone, B.mix(h[at]), B.pair_hash(h[at], h[np.minimum(at + 1, len(h) - 1)]))
    # One sort of a single integer: the text's number above 64 - bits of the hash.
    bits = B.U64(max(1, int(rows - 1).bit_length()))
    key = np.sort((row[at].astype(B.U64) << (B.U64(64) - bits)) | (term >> bits))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.diff(np.append(first, len(key))).astype(float)
    key = key[first]
    owner = (key >> (B.U64(64) - bits)).astype(np.int64)
    # The hash must not depend on how many texts share the batch.
    kept = (key << bits) & B.U64(0xFFFFFFFFFFE00000)
    return B.mix(kept), weight, np.searchsorted(owner, np.arange(rows + 1))


def samples(strings: pa.Array) -> np.ndarray:
    """K samples of each text as 32-bit marks; a text without terms has all bits set."""
    p = pool()
    term, weight, bounds = weighted_terms(strings)
    rows = len(bounds) - 1
    out = np.full((K, rows), 0xFFFFFFFF, np.uint32)
    if not len(term):
        return out.T
    owner = B.row_of(bounds)
    light, heavy = weight == 1, np.flatnonzero(weight > 1)
    lt, lo = term[light], owner[light]
    l_rows, l_starts = np.unique(lo, return_index=True)
    ht, ho, lw = term[heavy], owner[heavy], np.log(weight[heavy])
    h_rows, h_starts = np.unique(ho, return_index=True)
    h_len = np.diff(np.append(h_starts, len(heavy)))
    shift, low = B.U64(32), np.uint32(32 - POOL_BITS)
    value, high = np.empty(len(lt), B.U64), np.empty(len(lt), np.uint32)
    for k in range(K):
        best, mark = np.full(rows, np.inf), np.zeros(rows, B.U64)
        if len(lt):
            np.multiply(lt, p["a"][k], out=value)
            value += p["b"][k]
            value >>= shift
            high[:] = value
            least = np.minimum.reduceat(high, l_starts)
            best[l_rows], mark[l_rows] = p["rank"][least >> low], least
        if len(ht):
            x = ((ht * p["a"][k] + p["b"][k]) >> shift).astype(np.uint32)
            i = x >> low
            r, beta = p["r"][i], p["beta"][i]
            t = np.floor(lw / r + beta)
            rank = p["lc"][i] - r * (t - beta) - r
            least = np.minimum.reduceat(rank, h_starts)
            # Of equal ranks the lowest position counts, whatever the order of terms.
            tied = np.where(rank == np.repeat(least, h_len), x.astype(B.U64) | (t.astype(B.U64) << shift), B.U64(2**64 - 1))
            won = np.minimum.reduceat(tied, h_starts)
            better = least < best[h_rows]
            best[h_rows[better]], mark[h_rows[better]] = least[better], won[better]
        has = best < np.inf
        out[k, has] = (B.mix(mark[has] + B.U64(k)) >> shift).astype(np.uint32)
    return out.T


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many, or all, of the following one."""
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; a row with tail set only ends its block."""
    carry: list[tuple] = []
    for batch in B.slices(batches):
        rows = carry + list(zip(batch.column("doc_id").to_pylist(), batch.column("tail").to_pylist(), (t or "" for t in batch.column("text").to_pylist())))
        carry = rows[-1:]
        if len(rows) < 2:
            continue
        texts = [r[2] for r in rows]
        own = np.array([not r[1] for r in rows[:-1]])
        changed = [edited(texts[i], texts[i + 1]) if own[i] else "" for i in range(len(rows) - 1)]
        s = samples(pa.array(texts, pa.string()))
        e = samples(pa.array(changed, pa.string()))
        at = np.flatnonzero(own)
        s_bytes, e_bytes = s.astype(">u4"), e.astype(">u4")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in at], pa.int64()),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(changed[i].encode("utf-8", "surrogatepass")).hexdigest() for i in at], pa.string()),
                pa.array([s_bytes[i].tobytes().hex() for i in at], pa.string()),
                pa.array([e_bytes[i].tobytes().hex() for i in at], pa.string()),
                pa.array((s[:-1] == e).mean(1)[at]),
                pa.array((s[:-1] == s[1:]).mean(1)[at]),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def _places(cuts: np.ndarray, at: pd.Series, h: pd.Series) -> np.ndarray:
    """The block of each (id, hash of the text). An id that is several cuts has as many
    blocks more, its texts' hashes in order."""
    x = at.to_numpy(np.int64)
    low, high = np.searchsorted(cuts, x, "left"), np.searchsorted(cuts, x, "right")
    share = ((h.to_numpy(np.int64) >> 40) + (1 << 23)) * np.maximum(high - low, 0) >> 24
    return np.where(high - low > 1, low + 1 + share.clip(0), high)


def fingerprints(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, one row a document.

    Input: doc_id, text; other columns are ignored. A null text counts as empty;
    the fingerprint of a text without words has all bits set and is alike only to
    its own kind. Rows of equal doc_id follow each other by a hash of the text, then by
    the text; a null doc_id comes first. One document alone follows itself. A text of
    any length is read whole. An empty table gives no rows.

    Ids are read first, alone, to cut them into blocks of about equal size; an id, or
    null, that fills several blocks is cut by the hashes of its texts. Then the texts are
    shuffled once: every document goes to its block, and the first of each block also
    ends the block before. Only ids and block numbers reach the driver, one per block."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("at"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(sorted(int(x) for x in keyed.select("at").approxQuantile("at", [i / blocks for i in range(1, blocks)], 0.1 / blocks)) if blocks > 1 else [], np.int64)

    @F.pandas_udf("int")
    def block(at: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(_places(cuts, at, h).astype(np.int32))

    first = F.min(F.struct("at", "h")).alias("first")
    firsts = sorted((r.block, r.first.at, r.first.h) for r in keyed.select(block("at", "h").alias("block"), "at", "h").groupBy("block").agg(first).collect())
    before = {(at, h): firsts[i - 1][0] for i, (_, at, h) in enumerate(firsts)}

    @F.pandas_udf("int")
    def ending(at: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([before.get(x, -1) for x in zip(at.tolist(), h.tolist())], dtype="int32")

    placed = keyed.select("doc_id", "text", "at", "h", block("at", "h").alias("block"), ending("at", "h").alias("ends"))
    own = F.struct(F.col("block"), F.lit(0).alias("tail"))
    tail = F.struct(F.col("ends").alias("block"), F.lit(1).alias("tail"))
    spread = placed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "at", "h", F.explode(F.when(F.col("ends") >= 0, F.array(own, tail)).otherwise(F.array(own))).alias("x"))
    ordered = spread.select("doc_id", "text", "at", "h", "x.block", "x.tail").repartition("block").sortWithinPartitions("block", "tail", "at", "h", "text")
    return ordered.select("doc_id", "tail", "text").mapInArrow(_pairs, SCHEMA)
