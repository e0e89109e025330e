"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may be found with up to e = floor(0.2 n) word edits. It is split
into e + 1 pieces; whichever e words are edited, one piece stays whole. Pieces are
found exactly, by hashes of the texts' word n-grams of the pieces' few lengths. Each
hit fixes where the item would lie, and Myers' bit-parallel algorithm gives the edit
distance to the best matching stretch of words there, for many hits at once. An item
of fewer than five words has no error to spare and is found as it stands.

Words are lower-cased runs of letters, digits and marks of any script, so case,
punctuation and layout don't matter; where a script puts no space between words, each
character is a word. The items travel to the documents, never the documents: the texts
are read once and not shuffled. Items go in blocks whose size is bounded, each block
with a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B

ERRORS = 0.2
#: Words of items that one pass over the texts looks for.
BLOCK_WORDS = 2_000_000
#: Hits that are compared at once.
LANES = 1 << 15


def tokens(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the bounds of each text's words."""
    data, off = B.flat(pc.utf8_lower(pc.fill_null(strings, "")))
    starts, ends, bounds = B.letter_words(data, off)
    return B.span_hash(data, starts, ends), bounds


def ngrams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each position that has as many after it."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, B.U64)
    out = h[:n].copy()
    for d in range(1, size):
        out = out * B.BASE2 + h[d : d + n]
    return B.mix(out + B.U64(size))


def pieces(n: int, errors: float = ERRORS) -> list[tuple[int, int]]:
    """Start and length of the e + 1 pieces of an item of n words, e = floor(errors * n)."""
    parts = int(errors * n + 1e-9) + 1
    edge = [i * n // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def best_match(pattern: dict[int, int], m: int, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of a pattern of m words to any stretch of text, and the
    first end of such a stretch. pattern: bit mask of each word's places (Myers 1999)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, word in enumerate(text):
        eq = pattern.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
    return best, end


@dataclass
class Items:
    """A block of benchmark items, ready to search: their words and, by length of
    piece, the pieces' sorted hashes with the item and place of each. `places` are the
    bit masks of the (item, word) pairs in `pairs` for items of up to 64 words."""

    ids: list[int]
    words: list[np.ndarray]
    size: np.ndarray
    most: np.ndarray
    table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    pairs: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None], errors: float = ERRORS) -> Items:
        h, bounds = tokens(pa.array(texts, pa.string()))
        words = [h[a:b] for a, b in zip(bounds, bounds[1:])]
        size = np.diff(bounds)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(words):
            for start, n in pieces(len(w), errors) if len(w) else ():
                found.setdefault(n, []).append((int(ngrams(w[start : start + n], n)[0]), i, start))
        table = {}
        for n, rows in found.items():
            rows.sort()
            table[n] = (np.array([r[0] for r in rows], B.U64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        row = B.row_of(bounds)
        short = size[row] <= 64
        key = B.pair_hash(row[short].astype(B.U64), h[short])
        bit = B.U64(1) << (np.arange(len(h)) - bounds[row])[short].astype(B.U64)
        order = np.argsort(key, kind="stable")
        key, bit = key[order], bit[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        places = np.bitwise_or.reduceat(bit, first) if len(key) else bit
        return cls(ids, words, size, np.floor(errors * size + 1e-9).astype(np.int64), table, key[first], places)

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, item number and the word where the item would begin, of every
        piece that occurs; each combination once."""
        found = []
        for size, (hashes, item, start) in self.table.items():
            grams = ngrams(h, size)
            if not len(grams):
                continue
            # A table of 16 hash bits passes over nearly all n-grams without a search.
            seen = np.zeros(1 << 16, bool)
            seen[(hashes >> B.U64(48)).astype(np.int64)] = True
            at = np.flatnonzero(seen[(grams >> B.U64(48)).astype(np.int64)])
            low, high = np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right")
            row = np.searchsorted(bounds, at, "right") - 1
            hit = (high > low) & (at + size <= bounds[row + 1])
            at, low, n, row = at[hit], low[hit], (high - low)[hit], row[hit]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            piece = np.repeat(low, n) + nth
            found.append(np.stack([np.repeat(row, n), item[piece], np.repeat(at, n) - start[piece]]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        row, item, begin = np.concatenate(found, axis=1)
        order = np.lexsort((begin, item, row))
        row, item, begin = row[order], item[order], begin[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] != begin[:-1])
        return row[new], item[new], begin[new]

    def distances(self, h: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As best_match, of items of up to 64 words in the stretches h[a:b]: one bit
        vector a hit, all moved on a word at a time, the longest stretches first."""
        order = np.argsort(a - b, kind="stable")
        item, a, length = item[order], a[order], (b - a)[order]
        one = B.U64(1)
        m = self.size[item]
        top = one << (m - 1).astype(B.U64)
        full = top | (top - one)
        plus, minus, key = full.copy(), np.zeros(len(m), B.U64), item.astype(B.U64)
        score, best, end = m.copy(), m.copy(), np.zeros(len(m), np.int64)
        live = np.searchsorted(-length, -np.arange(1, (length[0] if len(m) else 0) + 1), "right")
        for j, k in enumerate(live):
            pair = B.pair_hash(key[:k], h[a[:k] + j])
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            eq = np.where(self.pairs[at] == pair, self.places[at], B.U64(0))
            p, n, f = plus[:k], minus[:k], full[:k]
            xv = eq | n
            xh = (((eq & p) + p) ^ p) | eq
            ph = n | (~(xh | p) & f)
            mh = p & xh
            score[:k] += (ph & top[:k] != 0).astype(np.int64) - (mh & top[:k] != 0)
            better = score[:k] < best[:k]
            best[:k][better], end[:k][better] = score[:k][better], j + 1
            ph, mh = (ph << one) & f, (mh << one) & f
            plus[:k], minus[:k] = mh | (~(xv | ph) & f), ph & xv
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return best[back], end[back]

    def search(self, strings: pa.Array) -> np.ndarray:
        """A column (text number, item number, distance, end word, item words, text
        words) of each match. Of equal distances the first end counts."""
        h, bounds = tokens(strings)
        row, item, begin = self.hits(h, bounds)
        most = self.most[item]
        a, b = np.maximum(bounds[row], begin - most), np.minimum(bounds[row + 1], begin + self.size[item] + most)
        best, end = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        short = np.flatnonzero(self.size[item] <= 64)
        for k in range(0, len(short), LANES):
            x = short[k : k + LANES]
            best[x], end[x] = self.distances(h, item[x], a[x], b[x])
        for k in np.flatnonzero(self.size[item] > 64):
            best[k], end[k] = best_match(self.masks(int(item[k])), int(self.size[item[k]]), h[a[k] : b[k]].tolist())
        ok = np.flatnonzero(best <= most)
        order = ok[np.lexsort(((a + end)[ok], best[ok], item[ok], row[ok]))]
        new = np.ones(len(order), bool)
        new[1:] = (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1])
        x = order[new]
        return np.stack([row[x], item[x], best[x], (a + end)[x] - bounds[row[x]], self.size[item[x]], np.diff(bounds)[row[x]]])

    def masks(self, i: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for k, w in enumerate(self.words[i].tolist()):
            out[w] = out.get(w, 0) | 1 << k
        return out


def item_blocks(benchmark: DataFrame, errors: float = ERRORS) -> Iterator[Items]:
    """The items in blocks of bounded size, streamed to the driver one by one."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for row in benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text) // 4 + 1
        if size >= BLOCK_WORDS:
            yield Items.of(ids, texts, errors)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of(ids, texts, errors)


MATCHES = "doc_id long, item_id long, distance long, end_word long, item_words long, doc_words long"


def matches(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """Every (document, item) whose item occurs in the document's text with at most
    floor(errors * words) word edits: the distance and the word after the match.

    Input: doc_id, text of docs; item_id, text of benchmark; other columns are
    ignored. Null and empty texts, and items without a word, match nothing. An item of
    fewer than five words must occur as it is. Of stretches with equal distance the
    one that ends first is reported. Items of equal text each match; repeated rows of
    docs give repeated results. Texts are searched whole, however long; a long text is a
    batch of its own. Empty tables give no rows."""
    spark = docs.sparkSession
    found = None
    for block in item_blocks(benchmark, errors):
        shared = spark.sparkContext.broadcast(block)  # bounded by BLOCK_WORDS

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in B.slices(batches):
                hits = items.search(batch.column("text"))
                found = [batch.column("doc_id").take(pa.array(hits[0])), pa.array([items.ids[i] for i in hits[1]], pa.int64()), *map(pa.array, hits[2:])]
                yield pa.RecordBatch.from_arrays(found, names=["doc_id", "item_id", "distance", "end_word", "item_words", "doc_words"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, MATCHES)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], MATCHES) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of docs, all columns kept, whose text holds no benchmark item.

    Input as in `matches`. Null and empty texts stay; repeated rows stay or go together;
    no column is added, so no name can clash; an empty table stays empty."""
    spark = docs.sparkSession
    for block in item_blocks(benchmark, errors):
        shared = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in B.slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[shared.value.search(batch.column("text"))[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(rows, T.StructType(docs.schema.fields))
    return docs
