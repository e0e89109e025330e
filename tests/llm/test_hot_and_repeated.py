"""Keys that most rows share, repeated rows, long conversations, bounded samples."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import chat, langid, license_scan, mixing, quality, shared
from textmill.llm import decontaminate as D
from textmill.llm import fingerprints as P
from textmill.llm import near_dup as N

from .helpers import frame, nasty_texts, untouched, words


@pytest.fixture
def hot(monkeypatch):
    """Tables as if they were too large to broadcast, keys as if they were hot."""
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "HOT_ROWS", 20)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_of_a_key_that_nine_of_ten_rows_have(spark, hot, how):
    rows = spark.createDataFrame([(k, "hot" if k % 10 else f"cold{k}" if k % 20 else None, 1) for k in range(1000)], "id long, key string, _salt int")
    table = spark.createDataFrame([("hot", 900, "x"), *((f"cold{k}", 1, f"y{k}") for k in range(10, 600, 20))], "key string, c long, value string")
    out = shared.lookup(rows, table, ["key"], "c", how)
    got = {r.id: r.value for r in out.collect()}
    want = {k: "x" if k % 10 else f"y{k}" if k % 20 and k < 600 else None for k in range(1000)}
    assert got == (want if how == "left" else {k: v for k, v in want.items() if v})
    assert set(out.columns) == {"id", "key", "_salt", "c", "value"}
    # None of the shuffles gathers the hot key: its rows meet the broadcast table.
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_near_duplicates_with_hot_classes_and_hubs(spark, hot):
    rng = random.Random(8)
    base = words(rng, 100)
    near = lambda: " ".join(w if rng.random() > 0.01 else "zz" for w in base.split())
    texts = [base] * 300 + [None, ""] * 20 + [near() for _ in range(40)] + [words(rng, 30) for _ in range(10)]
    got = collections.Counter((r.component_id, r.kept) for r in N.near_duplicates(frame(spark, texts)).collect())
    assert got[0, False] == 339 and got[0, True] == 1 and sum(got.values()) == len(texts)


def test_mix_of_one_hot_source_and_length(spark, hot, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 30)
    texts = [f"a b c{k}" for k in range(500)] + ["one two"] * 7 + [None, ""] * 50
    df = frame(spark, texts, source=lambda k: "hot" if k < 500 else "other")
    rows = mixing.mixed(df).collect()
    assert len(rows) == len(texts) and sorted(rows) == sorted(mixing.mixed(df.repartition(5)).collect())
    taken = sum(r.taken for r in rows if r.doc_id < 500)
    goal = next(r.target for r in rows if r.doc_id == 0)
    assert abs(taken - goal) <= 3
    picked = mixing.mixed_documents(df).collect()
    assert untouched(picked, ["copies"])
    assert collections.Counter(r.doc_id for r in picked for _ in range(int(r.copies))) == {r.doc_id: r.taken // r["size"] for r in rows if r.taken}


def test_targets_by_spark_are_those_of_the_driver(spark, monkeypatch):
    rng = random.Random(1)
    sizes = [(f"s{k:03}", rng.randrange(0, 5000)) for k in range(40)] + [(None, 77)]
    totals = spark.createDataFrame(sizes, "source string, source_size long")
    want = {r.source: r.target for r in mixing.aims(totals).collect()}
    monkeypatch.setattr(mixing, "SOURCES", 3)
    got = {r.source: r.target for r in mixing.aims(totals).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_fingerprints_of_one_id(spark):
    """Nine of ten rows share an id; they follow each other by a hash of their texts."""
    texts = [f"text number {k}" for k in range(90)] + [f"other {k}" for k in range(10)]
    ids = [7] * 90 + [0, 1, 2, 3, 4, 100, 101, 102, 103, 104]
    df = frame(spark, texts, ids=ids)
    placed = df.select(F.coalesce(F.col("doc_id"), F.lit(0)).alias("at"), F.xxhash64("text").alias("h"), "text").collect()
    order = sorted(placed, key=lambda r: (r.at, r.h, r.text))
    after = {r.text: order[(k + 1) % len(order)].text for k, r in enumerate(order)}
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in after.items())
    assert sorted(r.edited_sha256 for r in P.fingerprints(df, blocks=8).collect()) == want
    cuts = np.array([7] * 6)
    blocks = P._places(cuts, df.select("doc_id").toPandas().doc_id, df.select(F.xxhash64("text").alias("h")).toPandas().h)
    assert len(set(blocks[:90])) == 6


# Conversations


def late(turns):
    """Marks all that was said once a conversation has more than 65 turns."""
    return ("[long]" if len(turns) > 65 else "") + "".join(f"{r}:{t};" for r, t in turns)


def test_a_rewrite_after_many_turns_is_found(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(70)] + [(2, k, "assistant", "x") for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.formatted(df, late).collect()}
    assert got[1].rewrites == [65] and got[2].rewrites == []
    assert got[1].turn_spans[0] is None and got[1].formatted == late([r[2:] for r in rows[:70]])
    assert [got[1].formatted[a:b] for a, b in got[1].loss_spans] == ["t65", "t67", "t69"]
    assert [got[2].formatted[a:b] for a, b in got[2].loss_spans] == ["x", "x", "x"]

    class Late(chat.MarkedTemplate):
        append_only = False

        def __call__(self, turns):
            return ("!" if len(turns) > 65 else "") + super().__call__(turns)

    found = {r.conv_id: r for r in chat.digests(df, Late()).collect()}
    assert found[1].rewrites == 1 and found[1].turns_sha256 is None and found[1].n_turns == 70
    assert found[2].rewrites == 0 and found[2].n_turns == 3


def test_long_conversations_of_an_append_only_template(spark, monkeypatch):
    monkeypatch.setattr(chat, "HELD", 300)
    rng = random.Random(1)
    turns = [(rng.choice(["user", "assistant"]), "<" * rng.randrange(9) + "é\n" * rng.randrange(3)) for _ in range(400)]
    t, probe, out = chat.MarkedTemplate(), chat.Probe(chat.MarkedTemplate()), ""
    for turn in turns:
        span = probe.add(turn)
        out += probe.output[span.start - probe.base :]
        a, b = probe.text_of(turn)
        assert t.unescape(out[a:b]) == turn[1]
    assert out == t(turns) and not probe.rewrites and len(probe.turns) < 30
    assert [out[s.start : s.end] for s in probe.spans] == [t([x]) for x in turns]

    class Liar(chat.MarkedTemplate):
        def __call__(self, turns):
            return ("!" if len(turns) > 1 and turns[-1][1] == "z" else "") + super().__call__(turns)

    probe = chat.Probe(Liar())
    for turn in [*turns, ("user", "z")]:
        probe.add(turn)
    assert probe.rewrites == [400]


def test_a_stored_conversation_of_the_probe_gives_way(spark):
    df = spark.createDataFrame([(-7, 0, "user", "mine"), (3, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.n_turns for r in chat.digests(chat.with_probe(df)).collect()} == {-7: 2, 3: 1}


# Samples


def test_samples_are_bounded_in_rows_and_bytes(spark):
    rng = random.Random(2)
    texts = [words(rng, 3000) for _ in range(3)] * 40 + [words(rng, 20) for _ in range(200)]
    ids = [1, 2, 3] * 40 + list(range(10, 210))
    df = frame(spark, texts, ids=ids, lang=lambda k: "en" if k % 2 else "fr")
    chosen = shared.drawn(df.select("lang", "doc_id"), "lang", 5).collect()
    assert collections.Counter(r.lang for r in chosen) == {"en": 5, "fr": 5} and len(set(chosen)) == 10
    assert sorted(chosen) == sorted(shared.drawn(df.repartition(7).select("lang", "doc_id"), "lang", 5).collect())
    seen = {}
    fit = langid.fit_windows
    try:
        langid.fit_windows = lambda x, length, langs, names: seen.update(n=len(x), names=names) or fit(x, length, langs, names, steps=1)
        langid.train(df, per_language=5, per_text=4)
        assert seen["n"] <= 2 * 5 * 4 and seen["names"] == ["en", "fr"]
        langid.train(df, per_language=5, per_text=4, languages=1)
        assert len(seen["names"]) == 1
    finally:
        langid.fit_windows = fit
    labels = spark.createDataFrame([(i, i % 2, 0) for i in sorted(set(ids))] * 3, "doc_id long, quality int, toxic int")
    bags = quality.fit_bags
    try:
        quality.fit_bags = lambda b, y, odds: seen.update(docs=len(y), most=int(np.diff(b[3]).max())) or bags(b, y, odds, epochs=1)
        quality.train(df, labels, sample=20, per_text=3)
        assert seen["docs"] <= 20 and seen["most"] <= 3
    finally:
        quality.fit_bags = bags


# Repeated rows


def test_repeated_rows_and_nulls(spark):
    texts = [*nasty_texts(), "Released under the MIT License."] * 2
    df = frame(spark, texts, ids=list(range(len(texts) // 2)) * 2)
    bench = spark.createDataFrame([(1, "two words"), (None, "one")], "item_id long, text string")
    found = collections.Counter((r.doc_id, r.item_id) for r in D.matches(df, bench).collect())
    assert found == {(3, None): 2, (4, None): 2, (5, 1): 2}
    kept = D.clean(df, bench).collect()
    assert len(kept) == len(texts) - 6 and untouched(kept)
    assert collections.Counter((r.doc_id, r.family) for r in license_scan.license_scan(df).collect()) == {(16, "MIT"): 2}
    for rows in (langid.languages(df).collect(), quality.quality_scores(df, spark.createDataFrame([(i, i % 2) for i in range(17)], "doc_id long, quality int")).collect()):
        assert len(rows) == len(texts) and len(set(rows)) == len(texts) // 2
    with pytest.raises(ValueError):
        quality.with_score(df, quality.fit(pa.array(["a"]), np.array([1])), "score")


def test_texts_that_share_an_id(spark):
    """They are linked through the id, and so is what either is near."""
    rows = N.near_duplicates(frame(spark, ["a b c", "x y z", "a b c", "x y z", None], ids=[5, 5, 7, 8, 5])).collect()
    assert {r.doc_id: r.component_id for r in rows} == {5: 5, 7: 5, 8: 5}
