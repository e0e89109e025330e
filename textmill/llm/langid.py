"""Language identification by a bidirectional gated recurrent network over bytes.

The lower-cased bytes of a text are cut into windows of 96. In each window one
gated recurrent unit reads forwards and one backwards; both states at a position
give the probabilities of the languages there, so every byte of the whole text is
labelled. A document's probabilities are the mean over its positions. Trained in
numpy by backpropagation through time (Adam) on a bounded sample.
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
from .shared import checkpointed, drawn, held_out

WINDOW = 96
HIDDEN = 8
UND = "und"
ALPHA = np.zeros(256, bool)
ALPHA[[*range(65, 91), *range(97, 123)]] = True


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, padded with 0, with their lengths and their texts."""
    size = np.diff(off)
    parts = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = off[owner] + nth * WINDOW
    length = np.minimum(off[owner + 1] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    out = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)
    return out, length, owner


def lowered(strings: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(pc.fill_null(strings, ""))


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: a tanh-like squashing at a third of its cost."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


@dataclass
class LangModel:
    """Languages and parameters: per direction xw (3H, 256), hw (3H, H), hb (H, 1),
    out (C, H); and bias (C, 1). Gates in order: update, reset, candidate. Arrays
    have the windows along their last axis. Gates are 0.5 + 0.5 x / (1 + |x|)."""

    langs: list[str]
    p: dict = field(default_factory=dict)

    def states(self, x: np.ndarray, way: str, keep: bool = False, live: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """The state after each of the steps of x (T, N): an array (T, H, N). Where
        `live` (T, N) is 0, at padding, the state stays 0."""
        p, n = self.p, x.shape[1]
        xw, hw, hb = p["xw" + way], p["hw" + way], p["hb" + way]
        H = hb.shape[0]
        h = np.zeros((H, n), np.float32)
        hs = np.empty((len(x), H, n), np.float32)
        saved = []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            g = xw.take(x[t], axis=1)
            a = hw @ h
            zr = g[: 2 * H]
            zr += a[: 2 * H]
            s = _squash(zr)
            zr = s * 0.5
            zr += 0.5
            inner = a[2 * H :]
            inner += hb
            c = zr[H:] * inner
            c += g[2 * H :]
            _squash(c)
            if keep:
                saved.append((h, s, zr, inner, c))
            new = h - c
            new *= zr[:H]
            new += c
            if live is not None:
                new *= live[t]
            hs[t] = h = new
        return hs, saved

    def probabilities_at(self, x: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (T, C, N) of the languages at each position of x (T, N)."""
        p = self.p
        e = p["outf"] @ self.states(x, "f")[0]
        e += p["outb"] @ self.states(x, "b", live=live)[0]
        return _softmax(e, p["bias"])

    def probabilities(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sum over a window's positions of each language's probability: (N, C)."""
        xt = np.ascontiguousarray(x.T)
        live = (np.arange(len(xt))[:, None] < length).astype(np.float32) if length.min() < len(xt) else None
        e = self.probabilities_at(xt, live)
        if live is not None:
            e *= live[:, None, :]
        return e.sum(0).T.astype(np.float64)

    def predict(self, strings: pa.Array, block: int = 2048) -> tuple[list[str], np.ndarray]:
        """Language and its pooled probability for each whole text."""
        texts = len(strings)
        data, off = B.flat(lowered(strings))
        total = np.zeros((texts, max(1, len(self.langs))))
        x, length, owner = windows(data, off)
        # Full windows go together; the rest by length, so that few steps are padding.
        order = np.argsort(-length, kind="stable")
        full = int((length == WINDOW).sum())
        starts = [*range(0, full, block), *range(full, len(order), block)] if self.langs else []
        for at, end in zip(starts, [*starts[1:], len(order)]):
            pick = order[at:end]
            most = int(length[pick[0]])
            np.add.at(total, owner[pick], self.probabilities(x[pick, :most], length[pick]))
        letters = np.zeros(texts, bool)
        ascii_letter = np.concatenate([[0], np.cumsum(ALPHA[data])])
        letters |= ascii_letter[off[1:]] > ascii_letter[off[:-1]]
        for i in np.flatnonzero(~letters & (np.diff(off) > 0)):
            letters[i] = any(map(str.isalpha, strings[int(i)].as_py()))
        size = np.maximum(np.diff(off), 1)
        best = total.argmax(1)
        score = np.where(letters, total[np.arange(texts), best] / size, 0.0)
        names = [self.langs[b] if ok and self.langs else UND for b, ok in zip(best, letters)]
        return names, np.clip(score, 0.0, 1.0)


def _softmax(e: np.ndarray, bias: np.ndarray) -> np.ndarray:
    e += bias
    e -= e.max(1, keepdims=True)
    np.exp(e, out=e)
    e /= e.sum(1, keepdims=True)
    return e


def _backward(model: LangModel, x: np.ndarray, way: str, saved: list, dh_out: np.ndarray, live: np.ndarray) -> dict:
    """Backpropagation through time of one direction; dh_out (T, H, N) is dloss/dstate."""
    hw = model.p["hw" + way]
    H = hw.shape[1]
    gh, gb = np.zeros_like(hw), np.zeros((H, 1), np.float32)
    dh = np.zeros(dh_out.shape[1:], np.float32)
    into = np.empty((len(x), 3 * H, x.shape[1]), np.float32)
    steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
    for t, (h, s, zr, inner, c) in zip(reversed(steps), reversed(saved)):
        dh = (dh + dh_out[t]) * live[t]
        z, r = zr[:H], zr[H:]
        slope = 0.5 * (1 - np.abs(s)) ** 2
        dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
        dg = into[t]
        dg[:H] = dh * (h - c) * slope[:H]
        dg[H : 2 * H] = dc * inner * slope[H:]
        dg[2 * H :] = dc
        da = dg.copy()
        da[2 * H :] *= r
        gh += da @ h.T
        gb += da[2 * H :].sum(1, keepdims=True)
        dh = dh * z + hw.T @ da
    byte = x.ravel()
    order = np.argsort(byte, kind="stable")
    value = into.transpose(0, 2, 1).reshape(-1, 3 * H)[order]
    seen, first = np.unique(byte[order], return_index=True)
    gx = np.zeros((256, 3 * H), np.float32)
    gx[seen] = np.add.reduceat(value, first, axis=0)
    return {"xw" + way: gx.T, "hw" + way: gh, "hb" + way: gb}


def gradients(model: LangModel, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of every position's label, and its gradients."""
    p = model.p
    xt = np.ascontiguousarray(x.T)
    live = (np.arange(len(xt))[:, None] < length).astype(np.float32)
    (hf, sf), (hb, sb) = model.states(xt, "f", True, live), model.states(xt, "b", True, live)
    e = _softmax(p["outf"] @ hf + p["outb"] @ hb, p["bias"])
    weight = ((np.arange(len(xt))[:, None] < length) / length.sum()).astype(np.float32)
    n = np.arange(len(y))
    loss = -float((np.log(e[:, y, n] + 1e-9) * weight).sum())
    e[:, y, n] -= 1
    e *= weight[:, None, :]
    g = {"outf": np.einsum("tcn,thn->ch", e, hf, optimize=True), "outb": np.einsum("tcn,thn->ch", e, hb, optimize=True), "bias": e.sum((0, 2))[:, None]}
    g |= _backward(model, xt, "f", sf, p["outf"].T @ e, live)
    g |= _backward(model, xt, "b", sb, p["outb"].T @ e, live)
    return loss, g


def fit(strings: pa.Array, langs: list[str], **how) -> LangModel:
    """Train on whole texts and their languages."""
    data, off = B.flat(lowered(strings))
    x, length, owner = windows(data, off)
    return fit_windows(x, length, [langs[i] for i in owner], sorted(set(langs)), **how)


def fit_windows(x: np.ndarray, length: np.ndarray, langs: list[str], names: list[str], steps: int = 400, batch: int = 192, hidden: int = HIDDEN, seed: int = 5) -> LangModel:
    """Train on windows and their languages; each step draws evenly by language."""
    if len(names) < 2:
        return LangModel(names, _initial(len(names), hidden, seed)) if names else LangModel([])
    model = LangModel(names, _initial(len(names), hidden, seed))
    place = {v: k for k, v in enumerate(names)}
    y = np.array([place[v] for v in langs], np.int64)
    by = [np.flatnonzero((y == k) & (length > 0)) for k in range(len(names))]
    if not any(map(len, by)):
        return model
    rng = np.random.default_rng(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rate = 0.02 * 0.5 * (1 + np.cos(np.pi * step / steps)) + 2e-4
        pick = np.concatenate([rng.choice(b, -(-batch // len(names))) for b in by if len(b)])
        most = int(length[pick].max())
        _, g = gradients(model, x[pick, :most], length[pick], y[pick])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.995 * m2[k] + 0.005 * v * v
            model.p[k] = (model.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
    return model


def _initial(classes: int, hidden: int, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *s: (rng.standard_normal(s) * scale).astype(np.float32)
    p = {"bias": np.zeros((classes, 1), np.float32)}
    for way in "fb":
        p["xw" + way] = draw(0.4, 3 * hidden, 256)
        p["xw" + way][:hidden] += 1.5  # start by remembering
        p["hw" + way] = draw(1 / np.sqrt(hidden), 3 * hidden, hidden)
        p["hb" + way] = np.zeros((hidden, 1), np.float32)
        p["out" + way] = draw(0.3, classes, hidden)
    return p


def train(docs: DataFrame, per_language: int = 400, per_text: int = 64, languages: int = 256) -> LangModel:
    """Fit on at most `per_text` windows, spread over the whole text, of at most
    `per_language` documents of each language, drawn by a hash of their ids; of more
    than `languages` languages those with most documents drawn, then the first by name.
    Only these windows reach the driver. Rows held out, null texts and null languages
    teach nothing; of rows that share an id and a language one is drawn."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = checkpointed(drawn(known, "lang", per_language))
    most = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    ids = F.broadcast(ids.join(F.broadcast(most), "lang"))  # at most per_language * languages rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            data, off = B.flat(lowered(batch.column("text")))
            x, length, owner = windows(data, off)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            out = []
            for a, b in zip(bounds, bounds[1:]):
                at = a + np.unique(np.arange(min(per_text, b - a)) * (b - a) // max(1, min(per_text, b - a)))
                out.append([x[i, : length[i]].tobytes() for i in at])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(out, pa.list_(pa.binary()))], names=["lang", "doc_id", "cut"])

    found = known.join(ids, ["lang", "doc_id"]).select("lang", "doc_id", "text").mapInArrow(cut, "lang string, doc_id long, cut array<binary>")
    rows = found.groupBy("lang", "doc_id").agg(F.min("cut").alias("cut")).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    pieces = [(lang, w) for lang, ws in zip(rows.column("lang").to_pylist(), rows.column("cut").to_pylist()) for w in ws]
    x = np.zeros((len(pieces), WINDOW), np.uint8)
    for i, (_, w) in enumerate(pieces):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    return fit_windows(x, np.array([len(w) for _, w in pieces], np.int64), [lang for lang, _ in pieces], sorted(set(rows.column("lang").to_pylist())))


def with_language(docs: DataFrame, model: LangModel) -> DataFrame:
    """doc_id with lang_pred and score of each whole text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            names, score = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)


def languages(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """Predict every whole text's language: doc_id, held_out, lang_pred, score.

    Input: doc_id, text, lang; other columns are ignored, and lang only trains.
    Null texts and texts without a letter are `und` with score 0, and so is all
    when no language is known; with one known language, that one is predicted. Of
    equally probable languages the first by name is predicted. Repeated rows are
    predicted alike; texts of any length are read whole; an empty table gives no rows."""
    out = with_language(docs, train(docs, per_language))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
