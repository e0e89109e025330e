"""Operators against plain versions that share no code with them but hashes of words."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from textmill.llm import bytesops as B
from textmill.llm import decontaminate as D
from textmill.llm import langid, license_scan, quality, url_filter
from textmill.llm import line_dedup as L

from .helpers import CLASHES, frame, nasty_texts, untouched, words

M = (1 << 64) - 1


def word_hash(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(B.span_hash(data, np.array([0]), np.array([len(data)]))[0])


def pair_hash(a, b):
    return int(B.pair_hash(np.array([a], np.uint64), np.array([b], np.uint64))[0])


# Line dedup


def plain_units(text):
    """Lists of (first word, end) of the lines and of the phrases, and the words with
    their places."""
    found = [(m.group(), m.start()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(found)
    line = [len(re.findall(r"[\n\r]", (text or "")[:at])) for _, at in found]
    heads = [i for i in range(n) if i == 0 or line[i] != line[i - 1]]
    h = [word_hash(w) for w, _ in found]
    x = [pair_hash(h[i], h[i + 1] if i + 1 < n else 0) for i in range(n)]
    cuts = []
    for i in range(n):
        before = [x[j] for j in range(max(0, i - 3), i)]
        after = [x[j] for j in range(i + 1, min(n, i + 4))]
        if i == 0 or (all(x[i] < v for v in before) and all(x[i] <= v for v in after)):
            cuts.append(i)
    phrases = []
    for a, b in zip(cuts, [*cuts[1:], n]):
        phrases += [a, *range(a + 8, b, 8)] if b - a > 24 else [a]
    spans = lambda at: list(zip(at, [*at[1:], n])) if n else []
    return found, spans(heads), spans(phrases)


def plain_line_dedup(docs):
    seen, first, out = {}, {}, {}
    parsed = {i: plain_units(t) for i, t in docs}
    for kind in (1, 2):
        for i, _ in sorted(docs):
            found, units = parsed[i][0], parsed[i][kind]
            for k in range(len(units) - 2):
                a, b = units[k][0], units[k + 2][1]
                if kind == 1 or b - a >= 16:
                    key = (kind, tuple(tuple(w for w, _ in found[p:q]) for p, q in units[k : k + 3]))
                    if key in seen:
                        first.setdefault(i, set()).update(range(a, b))
                    seen[key] = True
    for i, t in docs:
        found, lines, _ = parsed[i]
        gone = first.get(i, set())
        if gone:
            at = [p for _, p in found] + [len(t)]
            left = t[: at[0]] + "".join(t[at[k] : at[k + 1]] for k in range(len(found)) if k not in gone)
            t = left.rstrip(" \t\n\r\x0b\x0c") if len(found) - 1 in gone else left
        out[i] = (t, len(lines), sum(all(k in gone for k in range(a, b)) for a, b in lines), len(found), len(gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [words(rng, rng.randrange(1, 6)) for _ in range(6)]
    passages = [words(rng, rng.randrange(55, 120), 10**6) for _ in range(3)]
    texts = [t for t in nasty_texts() if len(t or "") < 20_000]
    for _ in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.5 else words(rng, rng.randrange(1, 60)) for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts)), words(rng, 30) + " " + rng.choice(passages) + " " + words(rng, 30))
        texts.append(rng.choice(["\n", "\r\n"]).join(parts))
    texts += ["Der " * 200, "so so so " * 40 + "\n" + "so so so " * 40, "a b " * 90]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    out = L.line_dedup(df)
    assert out.columns == [*[c for c in df.columns if c not in L.ADDED], *L.ADDED]
    found = out.collect()
    assert untouched(found, L.ADDED)
    assert {r.doc_id: (r.text, r.n_lines, r.lines_removed, r.n_words, r.words_removed) for r in found} == plain_line_dedup(rows)


# Decontamination


def plain_words(text):
    """Runs of letters, digits and marks; characters of unspaced scripts by themselves."""
    import unicodedata

    out, now = [], ""
    for c in (text or "").lower():
        inside = unicodedata.category(c)[0] in "LNM"
        alone = inside and any(a <= ord(c) <= b for a, b in B.UNSPACED)
        if (not inside or alone) and now:
            out.append(now)
            now = ""
        if alone:
            out.append(c)
        elif inside:
            now += c
    return out + [now] if now else out


def plain_best(item, text):
    """Least word edit distance of the item to any stretch, and the first such end."""
    row, best = list(range(len(item) + 1)), (len(item), 0)
    for j, w in enumerate(text, 1):
        new = [0]
        for i, a in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (a != w)))
        row = new
        if row[-1] < best[0]:
            best = (row[-1], j)
    return best


def test_decontamination(spark):
    rng = random.Random(2)
    items = [[f"w{rng.randrange(30)}" for _ in range(n)] for n in (1, 2, 3, 4, 5, 8, 12, 20, 40, 64, 65, 90)]
    bench = [" ".join(x) for x in items] + [None, "", "“?!” —", "北京是中国的首都", "Über-große Äpfel"]
    texts = [t for t in nasty_texts() if len(t or "") < 20_000]
    for _ in range(50):
        t = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 60))]
        for item in rng.sample(items, rng.randrange(0, 3)):
            k = rng.randrange(len(t) + 1)
            t = t[:k] + [w if rng.random() > 0.12 else "zz" for w in item if rng.random() > 0.05] + t[k:]
        texts.append(rng.choice([" ", ", ", "\n", " — ", "”“"]).join(t).upper())
    texts += ["据说北京是中国的首都。", "北京，是中国 的首府", "the “über große — äpfel” here", "uber grosse"]
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(map(plain_words, bench)):
            if x:
                k, end = plain_best(x, plain_words(t))
                if k <= int(0.2 * len(x) + 1e-9):
                    want[d, i] = (k, end, len(x), len(plain_words(t)))
    df = frame(spark, texts)
    table = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.end_word, r.item_words, r.doc_words) for r in D.matches(df, table).collect()}
    assert got == want
    n = len(texts)
    assert {(n - 4, 15), (n - 3, 15), (n - 2, 16)} <= set(got) and (n - 1, 16) not in got
    assert {d for d, _ in want} == set(range(n)) - {r.doc_id for r in D.clean(df, table).collect()}


# Quality


def test_quality_forward_pass():
    """One document at a time, one passage at a time, one number at a time."""
    texts = ["Some words here. And more of them, said twice. " * 30, "LOUD 12 $$$ zz zz " * 90, "ok", "", None, "x " * 64, "x " * 65]
    m = quality.fit(pa.array(texts[:3]), np.array([1, 0, 1]), epochs=2)
    got = m.score(pa.array(texts, pa.string()))
    for t, s in zip(texts, got):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        parts = [w[i : i + 64] for i in range(0, len(w), 64)] or [[]]
        x, _, _, _ = quality.passages(pa.array([t], pa.string()))
        assert len(x) == len(parts)
        h, e = [], []
        for k, part in enumerate(parts):
            rows = []
            for i, word in enumerate(part):
                if i:
                    rows.append(pair_hash(word_hash(part[i - 1]), word_hash(word)) >> 51)
                rows.append(int(B.mix(np.array([word_hash(word)], np.uint64))[0]) >> 51)
            mean = np.mean([m.p["e"][r] for r in rows], axis=0) if rows else np.zeros(quality.EMBED)
            v = [math.tanh(sum((x[k, i] - m.mean[i]) * m.scale[i] * m.p["w1"][i, j] for i in range(quality.DIM)) + sum(mean[i] * m.p["w2"][i, j] for i in range(quality.EMBED)) + m.p["b1"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(np.dot(v, m.p["v"][:, g])) / (1 + math.exp(-np.dot(v, m.p["u"][:, g]))) for g in range(quality.GATE)]
            h.append(v)
            e.append(math.exp(np.dot(gate, m.p["w"])))
        z = [sum(a * v[j] for a, v in zip(e, h)) / sum(e) for j in range(quality.HIDDEN)]
        logit = np.dot(z, m.p["o"]) + m.p["c"] + m.shift
        assert abs(s - 1 / (1 + math.exp(-logit))) < 1e-3, t


# Language


def test_language_forward_pass():
    """A byte at a time, from either end of each window."""
    texts = ["the cat sat on the mat, twice " * 5, "le chat est là", "é" * 70, "Aa1"]
    m = langid.fit(pa.array(["the cat sat"] * 4 + ["le chat est"] * 4), ["en"] * 4 + ["fr"] * 4, steps=5)
    names, scores = m.predict(pa.array(texts))
    squash = lambda v: v / (1 + np.abs(v))
    for t, name, score in zip(texts, names, scores):
        data = t.lower().encode()
        total = np.zeros(len(m.langs))
        for at in range(0, len(data), langid.WINDOW):
            window = data[at : at + langid.WINDOW]
            states = {}
            for way, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
                h, H = np.zeros(langid.HIDDEN), langid.HIDDEN
                for i in order:
                    g, a = m.p["xw" + way][:, window[i]], m.p["hw" + way] @ h
                    z, r = (0.5 + 0.5 * squash(g[:H] + a[:H])), (0.5 + 0.5 * squash(g[H : 2 * H] + a[H : 2 * H]))
                    c = squash(g[2 * H :] + r * (a[2 * H :] + m.p["hb" + way][:, 0]))
                    h = z * h + (1 - z) * c
                    states[way, i] = h
            for i in range(len(window)):
                e = np.exp(m.p["outf"] @ states["f", i] + m.p["outb"] @ states["b", i] + m.p["bias"][:, 0])
                total += e / e.sum()
        assert name == m.langs[int(total.argmax())] and abs(score - total.max() / len(data)) < 1e-4


# Licences


def test_licence_scores():
    """Every line and window by itself, its n-grams looked up one by one."""
    rng = random.Random(1)
    m = license_scan.fit([words(rng, 30) for _ in range(40)])
    text = "\n".join([words(rng, 5), "Released under the MIT License.", "", words(rng, 90) + " Licensed under the Apache License, Version 2.0.", "end"])
    h, bounds, row, line = license_scan.paragraph_words(pa.array([text]))
    a, b = license_scan.spans(bounds, row, line)
    blocks = [(0, 10), (10, len(h))]
    lines = [(0, 5), (5, 10), (10, len(h) - 1), (len(h) - 1, len(h))]
    want = list(lines)
    for size, step in license_scan.WINDOWS:
        for x, y in blocks:
            k = x
            while True:
                want.append((k, min(y, k + size)))
                if k + size >= y:
                    break
                k += step
    assert list(zip(a.tolist(), b.tolist())) == [*lines, *[s for s in want[4:]]]
    place = {int(v): i for i, v in enumerate(m.vocabulary)}
    logits, _ = m.logits(m.sums(h), a, b)
    for x, y, got in zip(a.tolist(), b.tolist(), logits):
        total, grams = np.zeros(len(m.classes)), 0
        for n in (1, 2, 3):
            for i in range(x, y - n + 1):
                grams += 1
                value = int(B.mix(h[i : i + 1])[0])
                for d in range(1, n):
                    value = pair_hash(value, int(h[i + d]))
                if value in place:
                    total += m.weight[place[value]]
        assert np.allclose(got, total / math.sqrt(max(1, grams)) + m.bias, atol=1e-3)
    assert [(r[1], r[2]) for r in m.scan(pa.array([text]))] == [(1, "MIT"), (3, "Apache-2.0")]


def test_licence_calibration_and_unseen_licences():
    rng = random.Random(3)
    m = license_scan.fit([words(rng, 30) for _ in range(60)])
    assert m.calibration_error < 0.1
    unseen = [
        "This file may be used pursuant to the Common Development and Distribution terms.",
        "Copyright 2021 Acme Inc. Use of the Acme program requires a licence from Acme.",
        "Released under the Foobar Community License, version 7.",
        "This software is distributed under the terms of the Nethack General Public License.",
    ]
    assert [[r[2] for r in m.scan(pa.array([f"{words(rng, 30)}\n{t}\n{words(rng, 30)}"]))] for t in unseen] == [["unknown"]] * 4


# URL rules


def test_every_frequent_set_is_covered_by_a_mined_rule(spark):
    """All subsets of all token sets are counted; pages that any set blocks with enough
    confidence and support must be blocked by a rule, whose figures must be true."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        tokens = {f"a{rng.randrange(3)}", f"b{rng.randrange(3)}"} | ({"x", "y"} if rng.random() < 0.3 else {rng.choice("xyz")})
        bad = {"x", "y"} <= tokens and "a1" in tokens or rng.random() < 0.1
        rows.append((sorted(tokens), bool(bad)))
    sets = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    rules = url_filter.mine(sets, confidence=0.6, support=0.02, pages=5, lift=1.0).collect()
    count = {}
    for tokens, bad in rows:
        for k in range(1, len(tokens) + 1):
            for s in itertools.combinations(tokens, k):
                n, b = count.get(s, (0, 0))
                count[s] = (n + 1, b + bad)
    good = [set(s) for s, (n, b) in count.items() if b >= 8 and b / n >= 0.6]
    assert rules and good
    for r in rules:
        n, b = count[tuple(r.tokens)]
        assert abs(r.confidence - b / n) < 1e-12 and abs(r.support - b / len(rows)) < 1e-12 and b / n >= 0.6
        assert r.key == min(r.tokens, key=lambda t: (count[(t,)][0], t))
    for tokens, bad in rows:
        if bad and any(s <= set(tokens) for s in good):
            assert any(set(r.tokens) <= set(tokens) for r in rules)
    for a, b in itertools.permutations(rules, 2):
        assert not (set(a.tokens) < set(b.tokens) and a.confidence >= b.confidence)


@pytest.mark.parametrize("n", [4, 25])
def test_shared_paths_do_not_explode(spark, n):
    rng = random.Random(n)
    url = lambda i: "http://x.spam.net/" + "/".join(f"w{j}" for j in range(n) if rng.random() < 0.9) + f"/{i}" if i < 60 else f"http://y.ok.net/{i}"
    pages = spark.createDataFrame([(i, url(i)) for i in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    rules = url_filter.mine(url_filter.labelled(pages, labels)).collect()
    assert 0 < len(rules) < 50
    assert {r.page_id for r in url_filter.judge(pages, labels).collect() if r.verdict == "block"} == set(range(60))
    long = pages.limit(1).selectExpr("page_id", "'http://z.net/' || repeat('abc/', 100000) as url")
    assert url_filter.judge(long, labels).first().verdict == "allow"


def test_clashing_names_are_many():
    assert len(CLASHES) > 40
