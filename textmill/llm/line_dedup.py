"""Line dedup by overlapping windows of three consecutive lines.

Every window of three lines is hashed, repeated windows are found over all
documents, and all occurrences but the first, in the order of doc_id and position,
lose what they cover; overlapping windows merge into longer removals.

A text is read twice. First as its own lines that hold a word: any three of them,
however short or long, are a window. Then as phrases, for running text has repeats
that begin and end inside lines: the words are cut after those whose hash is the least
within three words on either side, and any three phrases of 16 words or more together
are a window (fewer recur by chance). Such cuts depend on nothing but the words around
them, so two copies of a passage are cut alike wherever they stand, seven words apart on
average. Where words repeat so that none is least, a phrase ends after eight words.

Within each partition all but the first occurrence of a window are settled at once;
only first occurrences are shuffled, so a window that fills a third of all lines
costs one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .shared import fresh

LINES = 3
RADIUS = 3
#: Least number of words in a window of phrases.
PHRASE_WORDS = 16
#: A phrase of more words than this is cut every STRIDE words.
FAR, STRIDE = 24, 8
#: Bits of a place: the text's mark, 1 for phrases, the line or phrase.
POSITION_BITS, MARK_BITS = 29, 33
#: Windows held back in one partition before first occurrences are sent on.
HELD = 4_000_000
FIRST = -(2**63)

BREAK = np.zeros(256, bool)
BREAK[[0x0A, 0x0D]] = True

Units = dict[str, np.ndarray]


def _units(at: np.ndarray, n: int, h: np.ndarray, starts: np.ndarray, row: np.ndarray, wb: np.ndarray) -> Units:
    """Units that begin at the words `at` and reach to the next: the `hash` of each one's
    words, its first `byte`, its number of `words`, the `row` of its text, and per text
    the `bounds` of its units."""
    count = np.diff(np.append(at, n))
    up, down = B.powers(B.BASE2, n + 1)
    total = np.zeros(n + 1, B.U64)
    np.cumsum(h * up[:n], out=total[1:])
    value = B.mix((total[at + count] - total[at]) * down[at] + count.astype(B.U64))
    return {"hash": value, "byte": starts[at], "words": count, "row": row[at], "bounds": np.searchsorted(at, wb)}


def units(data: np.ndarray, off: np.ndarray) -> tuple[Units, Units]:
    """The lines and the phrases of all texts."""
    starts, ends, wb = B.words(data, off)
    n = len(starts)
    if not n:
        none = np.empty(0, np.int64)
        empty = {"hash": np.empty(0, B.U64), "byte": none, "words": none, "row": none, "bounds": np.zeros(len(off), np.int64)}
        return empty, empty
    row = B.row_of(wb)
    h = B.span_hash(data, starts, ends)
    passed = np.cumsum(BREAK[data])[starts]
    head = np.ones(n, bool)
    head[1:] = row[1:] != row[:-1]
    own = head.copy()
    own[1:] |= passed[1:] != passed[:-1]
    lines = _units(np.flatnonzero(own), n, h, starts, row, wb)
    following = np.append(h[1:], B.U64(0))
    following[wb[1:][np.diff(wb) > 0] - 1] = 0
    x = B.pair_hash(h, following)
    least = np.ones(n, bool)
    for d in range(1, RADIUS + 1):
        apart = row[d:] != row[:-d]
        least[d:] &= (x[d:] < x[:-d]) | apart
        least[:-d] &= (x[:-d] <= x[d:]) | apart
    at = np.flatnonzero(head | least)
    size = np.diff(np.append(at, n))
    more = np.where(size > FAR, (size - 1) // STRIDE, 0)
    nth = np.arange(len(at) + more.sum()) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    return lines, _units(np.repeat(at, more + 1) + nth * STRIDE, n, h, starts, row, wb)


def windows(found: Units, words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of at least so many words, and the number of its first unit
    among all units given."""
    h, row = found["hash"], found["row"]
    if len(h) < LINES:
        return np.empty(0, B.U64), np.empty(0, np.int64)
    at = np.flatnonzero(row[LINES - 1 :] == row[: 1 - LINES])
    value, count = h[at], found["words"][at]
    for d in range(1, LINES):
        value = B.pair_hash(value, h[at + d])
        count = count + found["words"][at + d]
    return value[count >= words], at[count >= words]


WINDOWS = "hash long, doc_id long, place long, settled boolean"


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0

    def firsts() -> Iterator[pa.RecordBatch]:
        h, doc, place = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, doc, h))
        h, doc, place = h[order], doc[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        # Rows that repeat a document whole are the same occurrence.
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        same = (doc == doc[head]) & (place == place[head]) & ~new
        keep = np.flatnonzero(~same)
        for k in range(0, len(keep), 1 << 18):
            part = keep[k : k + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(doc[part]), pa.array(place[part]), pa.array(~new[part])], names=["hash", "doc_id", "place", "settled"])

    for batch in B.slices(batches):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        marks = batch.column("mark").to_numpy(zero_copy_only=False).astype(np.int64)
        for kind, found in enumerate(units(*B.flat(batch.column("text")))):
            value, at = windows(found, PHRASE_WORDS if kind else 0)
            row = found["row"][at]
            held.append((value ^ B.U64(kind), ids[row], (marks[row] << (POSITION_BITS + 1)) + (kind << POSITION_BITS) + (at - found["bounds"][row])))
            count += len(value)
        if count >= HELD:
            yield from firsts()
            held, count = [], 0
    if count:
        yield from firsts()


def cut(strings: pa.Array, covered: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts without the words of the windows that start at the units `covered`
    (lines, or phrases with POSITION_BITS set); and a column of n_lines,
    lines_removed, n_words, words_removed for each. A removal that reaches the text's
    end takes the white space before it."""
    data, off = B.flat(strings)
    lines, phrases = units(data, off)
    rows = len(off) - 1
    starts, _, wb = B.words(data, off)
    flat = covered.values.to_numpy(zero_copy_only=False) if len(covered.values) else np.empty(0, np.int64)
    edge = covered.offsets.to_numpy()
    owner = np.repeat(np.arange(rows), np.diff(edge))
    flat = flat[edge[0] : edge[-1]].astype(np.int64)
    gone = np.zeros(len(starts), bool)
    for kind, found in enumerate((lines, phrases)):
        mine = (flat >> POSITION_BITS) == kind
        at = found["bounds"][owner[mine]] + (flat[mine] & ((1 << POSITION_BITS) - 1))
        dead = np.zeros(len(found["hash"]), bool)
        for d in range(LINES):
            dead[at + d] = True
        gone |= np.repeat(dead, found["words"])
    counts = np.zeros((4, rows), np.int64)
    counts[0] = np.diff(lines["bounds"])
    counts[2] = np.diff(wb)
    out = strings.to_pylist() if len(flat) else None
    if out is None:
        return strings, counts
    lost = np.concatenate([[0], np.cumsum(gone)])
    counts[3] = lost[wb[1:]] - lost[wb[:-1]]
    if len(starts):
        first = np.cumsum(lines["words"]) - lines["words"]
        empty = np.concatenate([[0], np.cumsum(lost[first + lines["words"]] - lost[first] == lines["words"])])
        counts[1] = empty[lines["bounds"][1:]] - empty[lines["bounds"][:-1]]
    for i in np.flatnonzero(counts[3]).tolist():
        a, b = int(wb[i]), int(wb[i + 1])
        change = np.flatnonzero(np.diff(np.concatenate([[True], gone[a:b], [True]]).astype(np.int8)))
        place = np.append(starts[a:b], off[i + 1])
        parts = [data[off[i] : place[0]].tobytes(), *(data[place[x] : place[y]].tobytes() for x, y in zip(change[::2], change[1::2]))]
        text = b"".join(parts).decode()
        out[i] = text.rstrip(" \t\n\r\x0b\x0c") if gone[b - 1] else text
    return pa.array(out, pa.string()), counts


def _keyed(docs: DataFrame, key: str, mark: str) -> DataFrame:
    """docs with the id, null as FIRST, and a hash of the text. Texts without a letter
    have no windows, so they are spread instead of meeting under one hash."""
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    spread = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    hashed = F.when(empty, spread).otherwise(F.xxhash64("text").bitwiseAND(F.lit((1 << MARK_BITS) - 1)))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias(key), hashed.alias(mark), *docs.columns)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Later occurrences: _id, _mark, and the units at which they start."""
    found = _keyed(docs.select("doc_id", "text"), "_id", "_mark").select(F.col("_id").alias("doc_id"), F.col("_mark").alias("mark"), "text").mapInArrow(_window_rows, WINDOWS)
    # Settled rows are later than another of their partition; they need no comparison
    # and get hashes of their own so that none of them meets in one place.
    own = F.when(F.col("settled"), F.xxhash64("doc_id", "place"))
    spread = found.withColumn("hash", F.coalesce(own, F.col("hash"))).withColumn("own", own)
    least = F.min(F.struct("doc_id", "place")).over(Window.partitionBy("hash", "own"))
    later = spread.withColumn("least", least).where("settled or struct(doc_id, place) <> least")
    pos = F.col("place").bitwiseAND(F.lit((1 << (POSITION_BITS + 1)) - 1)).cast("int")
    marked = later.select(F.col("doc_id").alias("_id"), F.shiftright("place", POSITION_BITS + 1).alias("_mark"), pos.alias("pos"))
    return marked.groupBy("_id", "_mark").agg(F.collect_set("pos").alias("_covered"))


ADDED = ("n_lines", "lines_removed", "n_words", "words_removed")


def line_dedup(docs: DataFrame) -> DataFrame:
    """All rows of docs with what is left of each text.

    Input: doc_id, text and any other columns, all kept; `text` is replaced and
    n_lines, lines_removed, n_words, words_removed are appended (an input column of
    such a name is replaced). A line counts as removed when all its words are. Null
    texts stay null and empty ones empty. Rows that repeat a document with id and
    text are one document and are cut alike; rows of one id with different texts
    are ordered by a hash of the text. A null doc_id comes first. An empty table
    gives no rows. Texts of any length are read whole; one of over a mebibyte is a
    batch of its own."""
    names = [c for c in docs.columns if c not in ADDED]
    key, mark, covered = fresh(docs, "id", "mark", "covered")
    where = repeated_windows(docs).withColumnsRenamed({"_id": key, "_mark": mark, "_covered": covered})
    keyed = _keyed(docs, key, mark).join(where, [key, mark], "left").select(*names, covered)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in ADDED])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            found = batch.column(len(names))
            spots = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)), found.flatten())
            text, counts = cut(batch.column(names.index("text")), spots)
            columns = [text if c == "text" else batch.column(k) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, counts)], names=[*names, *ADDED])

    return keyed.mapInArrow(rows, schema)
