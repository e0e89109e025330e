"""Fingerprints, mixing, chat formatting, the pipeline and the registered queries."""

import collections
import hashlib
import importlib.util
import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from textmill.llm import chat, mixing
from textmill.llm import fingerprints as P
from textmill.llm.shared import table

from .helpers import frame, nasty_texts, untouched, words

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def bag(text):
    w = text.split()
    return collections.Counter(zip(w, w[1:]))


def test_samples_estimate_weighted_similarity():
    rng = random.Random(0)
    errors = []
    for v in (5, 20, 300) * 12:
        a = words(rng, 300, v).split()
        b = a[: rng.randrange(300)] + words(rng, 150, v).split()
        a, b = " ".join(a), " ".join(b)
        s = P.samples(pa.array([a, b]))
        assert (s[1] == P.samples(pa.array([b]))[0]).all()  # not a matter of the batch
        x, y = bag(a), bag(b)
        errors.append((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.18


@pytest.mark.parametrize("blocks", [1, 7])
def test_fingerprints_against_brute_force(spark, blocks):
    rng = random.Random(1)
    texts = nasty_texts() + [words(rng, rng.randrange(0, 40)) for _ in range(40)]
    ids = rng.sample(range(-500, 5000), len(texts))
    got = {r.doc_id: r for r in P.fingerprints(frame(spark, texts, ids=ids), blocks=blocks).collect()}
    rows = sorted(zip(ids, (t or "" for t in texts)))
    assert len(got) == len(rows)
    marks = lambda t: P.samples(pa.array([t], pa.string()))[0]
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = marks(t), marks(changed), marks(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == a.astype(">u4").tobytes().hex() and r.edited_fingerprint == b.astype(">u4").tobytes().hex()
        assert r.near_edited == (a == b).mean() and r.near_next == (a == c).mean()


def test_fingerprints_edges(spark):
    assert P.fingerprints(frame(spark, [])).collect() == []
    one = P.fingerprints(frame(spark, ["alone in here"])).first()
    assert one.near_next == 1.0
    rows = P.fingerprints(frame(spark, ["b", "a", "x", None], ids=[5, 5, None, None])).collect()
    assert len(rows) == 4


# Mixing


def test_budget_is_met_as_closely_as_any_choice_can():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 6)
        lengths, counts = np.array(rng.sample(range(1, 15), n)), np.array([rng.randrange(0, 4) for _ in range(n)])
        total = int((lengths * counts).sum())
        budget = rng.randrange(0, total + 3)
        take = mixing.fit_budget(lengths, counts, budget)
        best = max(s for s in (sum(a * b for a, b in zip(lengths, c)) for c in itertools.product(*(range(c + 1) for c in counts))) if s <= budget)
        assert (take <= counts).all() and (take >= 0).all()
        spent = int((lengths * take).sum())
        assert spent == best if budget <= 4 * lengths[counts > 0].max(initial=0) else spent <= budget
    lengths, counts = np.arange(1, 3000), np.full(2999, 40)
    total = int((lengths * counts).sum())
    assert int((mixing.fit_budget(lengths, counts, total // 3) * lengths).sum()) == total // 3


def test_targets():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    t = mixing.targets([10, 1000, 1000, 500])
    assert t[0] == 20 and abs(sum(t) - 1.5 * 2510) < 1e-6 and all(x <= 2 * s + 1e-9 for x, s in zip(t, [10, 1000, 1000, 500]))
    assert t[3] == 1000 and abs(t[1] / t[2] - 2) < 1e-9


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 7)  # several buckets a group
    rng = random.Random(2)
    names = ["a", "b", "c", "é", None, "hot"]
    texts = nasty_texts() + [words(rng, rng.choice([3, 3, 3, 10, rng.randrange(40)])) for _ in range(600)]
    source = lambda k: "hot" if k % 3 == 0 else names[k % len(names)]
    df = frame(spark, texts, source=source)
    rows = mixing.mixed(df).collect()
    assert sorted(rows) == sorted(mixing.mixed(df.repartition(3)).collect())
    assert len(rows) == len(texts)
    size = {k: len((t or "").translate({11: " ", 12: " "}).replace("\x1c", "~").split()) for k, t in enumerate(texts)}
    order = sorted({source(k) for k in size}, key=lambda s: (s is None, s or ""))
    total = {s: sum(v for k, v in size.items() if source(k) == s) for s in order}
    goal = dict(zip(order, mixing.targets([total[s] for s in order])))
    taken = collections.Counter()
    for r in rows:
        s = source(r.doc_id)
        assert (r["size"], r.source_size, r.target) == (size[r.doc_id], total[s], goal[s])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in order)
    picked = mixing.mixed_documents(df)
    assert picked.columns == [*[c for c in df.columns if c != "copies"], "copies"]
    assert sum(r.copies * size[r.doc_id] for r in picked.collect()) == sum(taken.values())


def test_mix_edges(spark):
    assert mixing.mixed(frame(spark, [])).collect() == [] and mixing.mixed_documents(frame(spark, [])).collect() == []
    assert {r.taken for r in mixing.mixed(frame(spark, [None, "", " "])).collect()} == {0}
    same = frame(spark, ["a b c"] * 10, ids=[1] * 10)
    assert sum(r.taken for r in mixing.mixed(same).collect()) == 45
    assert sum(r.copies for r in mixing.mixed_documents(same).collect()) == 15


# Chat


def test_round_trip_of_any_text():
    rng = random.Random(3)
    t = chat.MarkedTemplate()
    bits = ["<", ">", "\\", "\n", "turn ", "</turn>", "<turn user>", "a", "é", "n", "🙂"]
    for _ in range(500):
        turns = [("".join(rng.choices(bits, k=rng.randrange(4))), "".join(rng.choices(bits, k=rng.randrange(9)))) for _ in range(rng.randrange(5))]
        assert [(r, x) for r, x, *_ in t.parse(t(turns))] == turns


def test_spans_and_rewritten_history():
    probe = chat.Probe(chat.MarkedTemplate())
    turns = [("user", "a"), ("assistant", "b <"), ("user", "")]
    spans = [probe.add(t) for t in turns]
    assert [probe.output[s.start : s.end] for s in spans] == [chat.MarkedTemplate()([t]) for t in turns] and not probe.rewrites
    counted = chat.Probe(lambda ts: f"[{len(ts)}]" + "".join(x for _, x in ts))
    for t in turns:
        counted.add(t)
    assert counted.rewrites == [1, 2] and not counted.spans[0].intact
    last = chat.Probe(lambda ts: "".join(x for _, x in ts) + "<end>")
    for t in turns[:2]:
        last.add(t)
    assert last.rewrites == [1] and last.spans[1].start == 1


def test_digests(spark):
    rng = random.Random(4)
    rows = [(1, k, rng.choice(["user", "assistant", "system", None]), rng.choice(["<x>", "\\", None, "", "é\n"])) for k in range(200)]
    rows += [(None, 0, "assistant", "no id"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(df.repartition(5)).collect()}
    template = chat.MarkedTemplate()
    for conv in (1, 2, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: v[0] if conv == 1 else v)
        said = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(said)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].formatted_chars == len(template([(r, x) for _, r, x in own]))
    whole = {r.conv_id: r for r in chat.formatted(df).collect()}
    spans = "".join(template.unescape(whole[1].formatted[a:b]) for a, b in whole[1].loss_spans)
    assert hashlib.sha256(spans.encode()).hexdigest() == got[1].loss_sha256
    assert chat.digests(df.limit(0)).collect() == []
    assert chat.digests(chat.with_probe(df.limit(0))).first().n_turns == 2


# The registered queries


@tables
def test_pipeline(spark):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no pipeline here")
    import corpus_pipeline as C

    docs = table(spark, SF, "documents")
    out = C.run(spark, SF)
    rows = out.collect()
    assert out.columns == [*docs.columns, "copies"] and len({r.doc_id for r in rows}) == len(rows) > 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    bench = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert all(not any(b in r.text for b in bench) for r in rows)
    assert {r.doc_id for r in rows} < set(texts)
    nasty = frame(spark, nasty_texts(), source=lambda k: None if k % 2 else "s")
    for name, stage in C.STAGES:
        after = stage(spark, nasty, SF)
        assert after.columns == nasty.columns or name == C.STAGES[-1][0]
        assert stage(spark, nasty.limit(0), SF).count() == 0
        assert untouched(after.collect(), ["copies"])


def test_queries_are_registered():
    from textmill.llm import queries

    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
