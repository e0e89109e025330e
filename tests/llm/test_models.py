"""Quality, language, licences and URL rules: what is learned, and held-out accuracy."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from textmill.llm import langid, license_scan, quality, url_filter
from textmill.llm.shared import table

from .helpers import frame, nasty_texts, words

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_quality_gradients():
    rng = np.random.default_rng(0)
    texts = pa.array(["Some words here. And more of them, said twice." * 20, "LOUD!! LOUD!! " * 90, "ok", ""])
    x, token, tb, bounds = quality.passages(texts)
    m = quality.fit(texts, np.array([1, 0, 1, 0]), epochs=1)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    x, y = (x - m.mean) * m.scale, np.array([1.0, 0.0, 1.0, 0.0])
    mean = lambda: np.stack([m.p["e"][token[a:b]].mean(0) if b > a else np.zeros(quality.EMBED) for a, b in zip(tb, tb[1:])])
    loss = lambda: float(np.logaddexp(0, z := m.forward(x, mean(), bounds)["logit"]).sum() - (y * z).sum())
    f = m.forward(x, mean(), bounds)
    g = quality.backward(m.p, f, 1 / (1 + np.exp(-f["logit"])) - y, token, tb)
    for k, v in m.p.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        if k == "e":
            at = (int(token[3]), at[1])
        old, e = v[at], 1e-5
        up = (m.p.__setitem__(k, _set(v, at, old + e)), loss())[1]
        down = (m.p.__setitem__(k, _set(v, at, old - e)), loss())[1]
        m.p[k] = _set(v, at, old)
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-4 + 1e-3 * abs(g[k][at]), k


def _set(v, at, x):
    v = np.array(v)
    v[at] = x
    return v


@tables
def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if out(r.doc_id)]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert np.mean([a for a, b in held if b == 1]) > 0.98


def test_quality_edges(spark):
    df = frame(spark, nasty_texts())
    labels = spark.createDataFrame([(0, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(df, labels).collect()} == {1.0}
    assert {r.score for r in quality.quality_scores(df, labels.limit(0)).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(16)] * 2, "doc_id long, quality int, score int")
    rows = quality.quality_scores(df, both).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(frame(spark, []), both).collect() == []
    model = quality.train(df, both)
    assert quality.with_score(df, model, "mine").columns == [*df.columns, "mine"]
    a, b = model.score(pa.array(["same text", "same text"]))
    assert a == b
    # A text's score doesn't depend on the batch it comes in.
    alone = [float(model.score(pa.array([t], pa.string()))[0]) for t in nasty_texts()]
    assert np.allclose(alone, model.score(pa.array(nasty_texts(), pa.string())), atol=1e-5)


def test_language_gradients():
    rng = np.random.default_rng(0)
    m = langid.LangModel(["a", "b", "c"], {k: v.astype(float) for k, v in langid._initial(3, 4, 1).items()})
    x, length, y = rng.integers(1, 256, (5, 7)).astype(np.uint8), np.array([7, 7, 5, 3, 7]), np.array([0, 1, 2, 1, 0])
    _, g = langid.gradients(m, x, length, y)
    for k, v in m.p.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        if k.startswith("xw"):
            at = (at[0], int(x[0, 1]))
        old = v[at]
        v[at] = old + 1e-3
        up = langid.gradients(m, x, length, y)[0]
        v[at] = old - 1e-3
        down = langid.gradients(m, x, length, y)[0]
        v[at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4


@tables
def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs.select("doc_id", "lang").collect() if out(r.doc_id)]
    assert all(got[i].held_out == out(i) for i in got) and np.mean([a == b for a, b in held]) > 0.98


def test_language_edges(spark):
    df = frame(spark, nasty_texts(), lang=lambda k: ["en", "fr", None][k % 3])
    rows = {r.doc_id: r for r in langid.languages(df).collect()}
    assert len(rows) == df.count()
    assert all(rows[i].lang_pred == "und" for i in (0, 1, 2, 12)) and all(rows[i].lang_pred in ("en", "fr") for i in (3, 6, 9, 11, 15))
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert {r.lang_pred for r in langid.languages(frame(spark, ["a", "b"], lang=None)).collect()} == {"und"}
    assert langid.languages(frame(spark, [])).collect() == []
    model = langid.fit(pa.array(["the cat sat"] * 4 + ["le chat est"] * 4), ["en"] * 4 + ["fr"] * 4, steps=5)
    together = model.predict(pa.array(nasty_texts(), pa.string()))[1]
    assert np.allclose(together, [model.predict(pa.array([t], pa.string()))[1][0] for t in nasty_texts()], atol=1e-5)


def test_licences(spark):
    rng = random.Random(1)
    plain = [words(rng, 30) for _ in range(60)]
    model = license_scan.fit(plain)
    for name, notices in license_scan.TEMPLATES.items():
        for parts in notices:
            hit = model.scan(pa.array([words(rng, 12) + "\n" + " ".join(parts)]))
            assert [(h[1], h[2]) for h in hit] == [(1, name)], (name, parts, hit)
    changed = model.scan(pa.array(["this was released under the mit license , thanks"]))
    assert changed[0][2] == "MIT" and changed[0][4] >= 0.6
    unknown = model.scan(pa.array(["Released under the Foobar Community License, version 7."]))
    assert unknown[0][2] == "unknown"
    assert model.scan(pa.array([*plain, None, "", "To the."])) == []


def test_licence_scan_edges(spark):
    texts = [*nasty_texts(), "x y\nLicensed under the Apache License, Version 2.0.\nz"]
    rows = license_scan.license_scan(frame(spark, texts)).collect()
    assert [(r.doc_id, r.paragraph, r.family) for r in rows] == [(len(texts) - 1, 1, "Apache-2.0")]
    assert license_scan.license_scan(frame(spark, [])).collect() == []


URLS = {
    "http://X.org/a": ("x.org", "/a", "org/", "allow"),
    "https://a.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
    "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "ftp://y.com/de/": ("y.com", "/de/", "com/de/", "block"),
    "http://y.com/fr/://b": ("y.com", "/fr/://b", "com/fr/", "allow"),
    "http://org": ("org", "", None, "allow"),
    "http://org?/": ("org", "", None, "allow"),
    "no scheme.org/es/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://É.net/Ü": ("É.net", "/Ü", None, "allow"),
}


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).orderBy("page_id").collect()]
    assert got == list(URLS.values())
    assert url_filter.judge(pages.limit(0), labels).collect() == []


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        host, q = rng.choice(["a", "b", "c"]), rng.choice(["?ad=1", "?x=2", ""])
        rows.append((i, f"http://{host}.site.net/{rng.choice(['p', 'q'])}/{i}{q}"))
        bad = host == "a" and q == "?ad=1" and rng.random() < 0.95
        labels.append((i, 0 if bad else 1, 0))
    rows += [(i, None) for i in range(600, 603)] + rows[:5]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([*labels, (700, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rules = [set(r.tokens) for r in url_filter.mine(url_filter.labelled(pages, labels), 0.8, 0.01).collect()]
    assert rules and all({"first=a"} & r or {"domain=a.site.net"} & r for r in rules)
    tokens = {r.url: set(r.t) for r in pages.where("url is not null").select("url", url_filter.tokens_of(pages.url).alias("t")).collect()}
    got = url_filter.judge(pages, labels, 0.8, 0.01).collect()
    assert len(got) == len(rows)
    want = {i: "block" if u and any(r <= tokens[u] for r in rules) else "allow" for i, u in rows}
    assert {r.page_id: r.verdict for r in got} == want
    blocked = [u for i, u in rows if want[i] == "block"]
    assert blocked and all("http://a." in u and "ad=1" in u for u in blocked)
