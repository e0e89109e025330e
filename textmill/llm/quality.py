"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. A passage goes into the network as the
hashes of its words and word pairs, whose embeddings are learned with the rest and
averaged, and as how often one class of byte follows another, word length, repetition.
A tanh layer h encodes it; gated attention a = softmax(w . (tanh(V h) * sigm(U h)))
weighs the passages of a bag, and a logistic unit scores the weighted sum of their
encodings. Labels belong to documents only, so the attention learns which passages
speak for them. Trained in numpy by Adam on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .shared import checkpointed, drawn, held_out, release

PASSAGE = 64
CLASSES = 9
EXTRA = 6
DIM = CLASSES * CLASSES + EXTRA
HIDDEN, GATE = 16, 8
#: Words and word pairs share so many embeddings of so many numbers.
BUCKETS, EMBED = 1 << 13, 8

KIND = np.full(256, 6, np.uint8)  # 6: other ASCII signs
KIND[97:123] = 0
KIND[65:91] = 1
KIND[48:58] = 2
KIND[[0x20, 0x09, 0x0B, 0x0C]] = 3
KIND[[0x0A, 0x0D]] = 4
KIND[[ord(c) for c in ".,;:?!'\"-()"]] = 5
KIND[0:9] = KIND[14:32] = 8
KIND[128:] = 7


Bags = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def passages(strings: pa.Array) -> Bags:
    """Feature rows of all passages, the embeddings that each one's words and pairs
    have, the bounds of each passage's embeddings and of each text's passages.

    A text without words has one passage, all zeros, with no embedding."""
    data, off = B.flat(strings)
    starts, ends, bounds = B.words(data, off)
    rows = len(off) - 1
    count = np.diff(bounds)
    parts = np.maximum(1, -(-count // PASSAGE))
    pb = np.concatenate([[0], np.cumsum(parts)])
    out = np.zeros((pb[-1], DIM), np.float32)
    if not len(starts):
        return out, np.empty(0, np.int32), np.zeros(pb[-1] + 1, np.int64), pb
    row = B.row_of(bounds)
    part = pb[row] + (np.arange(len(starts)) - bounds[row]) // PASSAGE
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    named = part[first]
    # Bytes from a passage's first word up to the next passage's, or the text's end.
    begin, until = starts[first], np.empty(len(first), np.int64)
    until[:-1] = np.minimum(begin[1:], off[row[first[:-1]] + 1])
    until[-1] = off[row[first[-1]] + 1]
    kind = KIND[data].astype(np.int32)
    move = np.empty(len(data), np.int32)
    move[0] = 3 * CLASSES + kind[0]
    move[1:] = kind[:-1] * CLASSES + kind[1:]
    move[begin] = 3 * CLASSES + kind[begin]
    size = until - begin
    inside = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(inside[-1]) + np.repeat(begin - inside[:-1], size)
    cell = np.repeat(np.arange(len(first), dtype=np.int32) * (CLASSES * CLASSES), size) + move[at]
    table = np.bincount(cell, minlength=len(first) * CLASSES * CLASSES).reshape(len(first), -1)
    out[named, : CLASSES * CLASSES] = np.sqrt(table / size[:, None])
    h = B.span_hash(data, starts, ends)
    words = np.diff(np.append(first, len(starts))).astype(np.float32)
    again = np.zeros(len(h), bool)
    for back in (1, 2, 3, 4):
        again[back:] |= (h[back:] == h[:-back]) & (row[back:] == row[:-back])
    length = (ends - starts).astype(np.float32)
    local = np.repeat(np.arange(len(first), dtype=np.uint64), words.astype(np.int64))
    key = np.sort((local << B.U64(40)) | (h >> B.U64(24)))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    distinct = np.bincount((key[new] >> B.U64(40)).astype(np.int64), minlength=len(first))
    mean = np.add.reduceat(length, first) / words
    extra = out[:, CLASSES * CLASSES :]
    extra[named, 0] = np.add.reduceat(again.astype(np.float32), first) / words
    extra[named, 1] = distinct / words
    extra[named, 2] = np.log1p(mean)
    extra[named, 3] = np.log1p(np.maximum.reduceat(length, first))
    extra[named, 4] = np.log1p(words) / 4
    extra[named, 5] = 1
    # Each word is followed by the pair that it ends, within a passage.
    pair = np.empty(len(h), B.U64)
    pair[0] = 0
    pair[1:] = B.pair_hash(h[:-1], h[1:])
    both = np.stack([B.mix(h), pair], 1)
    there = np.ones(both.shape, bool)
    there[first, 1] = False
    seen = np.bincount(part, minlength=pb[-1])
    return out, (both[there] >> B.U64(64 - BUCKETS.bit_length() + 1)).astype(np.int32), np.concatenate([[0], np.cumsum(np.maximum(2 * seen - 1, 0))]), pb


def embedded(table: np.ndarray, token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The mean of each passage's embeddings; zeros where it has none."""
    out = np.zeros((len(bounds) - 1, table.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k in range(table.shape[1]):  # a column at a time keeps the temporaries small
            out[full, k] = np.add.reduceat(table[:, k][token], bounds[:-1][full])
        out[full] /= np.diff(bounds)[full, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class QualityModel:
    """Parameters of the network; `shift` moves the sample's class odds to the corpus's."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict = field(default_factory=dict)
    shift: float = 0.0
    constant: float | None = None

    def forward(self, x: np.ndarray, m: np.ndarray, bounds: np.ndarray) -> dict:
        """x: features, m: mean embeddings of the passages, bounds: of the bags."""
        p, s = self.p, bounds[:-1]
        n = np.diff(bounds)
        h = np.tanh(x @ p["w1"] + m @ p["w2"] + p["b1"])
        v, u = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, s), n))
        a = e / np.repeat(np.add.reduceat(e, s), n)
        z = np.add.reduceat(a[:, None] * h, s, axis=0)
        return {"x": x, "m": m, "n": n, "s": s, "h": h, "v": v, "u": u, "a": a, "z": z, "logit": z @ p["o"] + p["c"]}

    def score(self, strings: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(strings), self.constant)
        x, token, tb, bounds = passages(strings)
        if len(bounds) == 1:
            return np.empty(0)
        logit = self.forward((x - self.mean) * self.scale, embedded(self.p["e"], token, tb), bounds)["logit"].astype(float) + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def fit(strings: pa.Array, labels: np.ndarray, odds: float | None = None, **how) -> QualityModel:
    """Train on whole texts and 0/1 labels. `odds` are the corpus's odds of label 1."""
    return fit_bags(passages(strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings), labels, odds, **how)


def _ranges(bounds: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Members of the picked ranges."""
    n = np.diff(bounds)[pick]
    return np.arange(n.sum()) + np.repeat(bounds[pick] - np.cumsum(n) + n, n)


def fit_bags(bags: Bags, labels: np.ndarray, odds: float | None = None, epochs: int = 30, seed: int = 11) -> QualityModel:
    """Train on bags of passages and 0/1 labels."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(DIM), np.ones(DIM), constant=float(y.mean()) if len(y) else 1.0)
    x, token, tb, bounds = bags
    mean = x.mean(0)
    scale = 1 / (x.std(0) + 0.02)
    x = ((x - mean) * scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"w1": draw(DIM, HIDDEN), "w2": draw(EMBED, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "w": draw(GATE), "o": draw(HIDDEN), "c": np.zeros((), np.float32)}
    p["e"] = (0.1 * rng.standard_normal((BUCKETS, EMBED))).astype(np.float32)
    model = QualityModel(mean, scale, p)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, size, decay = 0, 64, 1e-3
    for epoch in range(epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
        order = rng.permutation(len(y))
        for at in range(0, len(order), size):
            pick = np.sort(order[at : at + size])
            rows = _ranges(bounds, pick)
            t, tn = token[_ranges(tb, rows)], np.concatenate([[0], np.cumsum(np.diff(tb)[rows])])
            f = model.forward(x[rows], embedded(p["e"], t, tn), np.concatenate([[0], np.cumsum(np.diff(bounds)[pick])]))
            g = backward(p, f, (_sigmoid(f["logit"]) - y[pick]) / len(pick), t, tn)
            step += 1
            for k in p:
                d = g[k] + decay * p[k] if p[k].ndim > 1 else g[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    if odds:
        model.shift = float(np.log(odds) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def backward(p: dict, f: dict, d: np.ndarray, token: np.ndarray, tb: np.ndarray) -> dict:
    """Gradients of the loss for d = dloss/dlogit of each bag."""
    n, s, h, a, v, u = (f[k] for k in ("n", "s", "h", "a", "v", "u"))
    dz = d[:, None] * p["o"]
    per = np.repeat(dz, n, axis=0)
    dh = a[:, None] * per
    da = (per * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, s), n))
    dg = de[:, None] * p["w"]
    dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
    dh += dv @ p["v"].T + du @ p["u"].T
    dx = dh * (1 - h * h)
    count = np.diff(tb)
    each = np.repeat(dx @ p["w2"].T / np.maximum(count, 1)[:, None], count, axis=0)
    ge = np.stack([np.bincount(token, each[:, k], BUCKETS) for k in range(each.shape[1])], 1)
    return {"w1": f["x"].T @ dx, "w2": f["m"].T @ dx, "b1": dx.sum(0), "v": h.T @ dv, "u": h.T @ du, "w": (v * u).T @ de, "o": f["z"].T @ d, "c": d.sum(), "e": ge}


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, per_text: int = 32) -> QualityModel:
    """Fit on at most `per_text` passages, spread over the whole text, of at most
    `sample` labelled documents, half of each label, drawn by a hash of their ids. Only
    these passages' features and word hashes reach the driver. Rows held out and null
    labels teach nothing; a document labelled more than once counts by its mean label;
    of rows that share an id one is drawn."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    known = checkpointed(known)
    totals = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    ids = F.broadcast(checkpointed(drawn(known, "quality", sample // 2)))  # at most `sample` pairs of numbers

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            x, token, tb, pb = passages(batch.column("text"))
            out = []
            for a, b in zip(pb, pb[1:]):
                at = np.unique(a + np.arange(min(per_text, b - a)) * (b - a) // min(per_text, b - a))
                out.append((x[at].tobytes(), token[_ranges(tb, at)].tobytes(), np.diff(tb)[at].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *(pa.array(c, pa.binary()) for c in zip(*out))], names=["doc_id", "quality", "x", "token", "count"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").select("doc_id", "quality", "text").mapInArrow(bags, "doc_id long, quality int, x binary, token binary, count binary")
    rows = found.groupBy("doc_id", "quality").agg(F.min(F.struct("x", "token", "count")).alias("bag")).select("doc_id", "quality", "bag.*").toArrow().sort_by("doc_id")
    whole = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
    count = whole("count", np.int32)
    size = np.array([len(c) // 4 for c in rows.column("count").to_pylist()], np.int64)
    bounds = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    odds = totals.get(1, 0) / totals[0] if totals.get(0) and totals.get(1) else None
    release(docs.sparkSession)
    return fit_bags((whole("x", np.float32).reshape(-1, DIM), whole("token", np.int32), bounds(count), bounds(size)), rows.column("quality").to_numpy(), odds)


def with_score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """docs, all columns kept, with the score of each whole text as `name`, which no
    column of docs may have. Null and empty texts are scored as one empty passage;
    repeated rows score alike; an empty table gives no rows."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already has a column {name}")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            score = pa.array(model.score(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, name])

    return docs.mapInArrow(rows, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 4000) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.

    Input: doc_id, text of docs; doc_id, quality of labels; other columns are
    ignored. Null and empty texts get the score of a bag with one empty passage;
    repeated rows score alike; texts of any length are read whole. With no labels, or labels of one kind only, the
    score is that kind's value (1 without any label). Empty tables give no rows."""
    model = train(docs, labels, sample)
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "score")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
