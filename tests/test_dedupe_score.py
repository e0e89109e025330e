import random

import pytest
from pyspark.sql import functions as F

import textmill
from textmill.operators import dedupe as D
from textmill.operators.dedupe import dedupe
from textmill.operators.score import blend, score
from textmill.operators.tables import with_index


def norm(t):
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).split())


def grams(n):
    w = n.split()
    return {n} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def scan(chunks, t, exact, normalized, near):
    """Compare each chunk with those retained so far, in order."""
    kept, gone = [], []
    for i, text in enumerate(chunks):
        n, g = norm(text), grams(norm(text))
        hit = None
        if exact:
            hit = next(((r, "exact", 1.0) for r in kept if chunks[r] == text), None)
        if hit is None and normalized and n:
            hit = next(((r, "normalized", 1.0) for r in kept if norm(chunks[r]) == n), None)
        if hit is None and near:
            best = [(-len(g & h) / len(g | h), r) for r in kept for h in [grams(norm(chunks[r]))] if g & h]
            best = [b for b in best if -b[0] >= t]
            if best:
                s, r = min(best)
                hit = (r, "near_duplicate", int(-s * 1000 + 0.5) / 1000)
        if hit:
            gone.append((i, *hit))
        else:
            kept.append(i)
    return kept, gone


@pytest.mark.parametrize("t,exact,normalized,near", [(0.9, True, True, True), (0.34, True, True, True), (0.5, False, False, True), (0.2, True, False, True), (0.0, False, True, True), (1.0, True, True, True), (0.9, True, False, False), (0.9, False, False, False)])
@pytest.mark.parametrize("crowd", [100, 1])
def test_against_a_scan(spark, monkeypatch, t, exact, normalized, near, crowd):
    if crowd == 1 and (not near or t in (0.0, 1.0)):
        pytest.skip("no bucket to be crowded")
    monkeypatch.setattr(D, "CROWD", crowd)  # at 1, leaders settle every bucket
    rng = random.Random(int(t * 100) + exact)
    rows, want, base = [], [], 0
    for case in range(25):  # cases side by side, kept apart by the scope
        chunks = []
        for _ in range(rng.randrange(1, 14)):
            if chunks and rng.random() < 0.6:
                w = rng.choice(chunks).split() or ["!!!"]
                w[rng.randrange(len(w))] = rng.choice("abcdefg")
                chunks.append(rng.choice([" ", "  "]).join(w).replace("a", rng.choice("aA")))
            else:
                chunks.append(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 9))) or rng.choice(["!!!", "??", ""]))
        kept, gone = scan(chunks, t, exact, normalized, near)
        rows += [(case, base + i, c) for i, c in enumerate(chunks)]
        want += [(case, base + i, base + r, kind, s) for i, r, kind, s in gone]
        base += len(chunks)
    found = dedupe(spark.createDataFrame(rows, "case int, index long, text string"), t, exact, normalized, near, scope="case")
    got = sorted((r.case, r["index"], r.retained_index, r.kind, r.similarity) for r in found.removed.collect())
    assert got == sorted(want)
    assert found.retained.count() == len(rows) - len(want)


def test_chain_and_later_match(spark):
    a = "a b c d e f g h i j k l"
    b = "a b c d e f g h i j x y"
    c = "q r c d e f g h i j x y"
    assert textmill.dedupe_chunks([a, b, c], near_duplicate_threshold=0.6) == [a, c]


def test_result_lists(spark):
    r = textmill.dedupe_chunks(["a", "a", "b"], return_stats=True)
    row = {"index": 1, "chunk": "a", "retained_index": 0, "retained_chunk": "a", "kind": "exact", "similarity": 1.0}
    assert (r.retained_chunks, r.removed_chunks, r.duplicate_count, r.duplicate_ratio) == (["a", "b"], ["a"], 1, pytest.approx(1 / 3))
    assert r.duplicate_groups == [{"retained_index": 0, "retained_chunk": "a", "duplicates": [row]}] and r.duplicate_metadata == [row]
    assert textmill.dedupe_chunks([], return_stats=True).duplicate_ratio == 0.0


def test_checks():
    for bad in ("text", ["ok", None], 3):
        with pytest.raises(TypeError):
            textmill.dedupe_chunks(bad)
        with pytest.raises(TypeError):
            textmill.score_chunks(bad)
    with pytest.raises(ValueError):
        textmill.dedupe_chunks(["a"], near_duplicate_threshold=1.5)
    with pytest.raises(TypeError):
        textmill.dedupe_chunks(["a"], exact=1)


def test_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 37 % 1000).alias("k"))
    rows = with_index(df, "k").orderBy("k").collect()
    assert [r["index"] for r in rows] == list(range(1000))


def test_scores(spark):
    plate = textmill.score_chunks(["Home Login About Contact Privacy Policy"] * 2)
    assert plate[0].warnings == ["too_short", "duplicate_likelihood", "boilerplate"]
    same, useful, code, blank = textmill.score_chunks(["status " * 20, "This is a useful chunk with several distinct words for testing quality.", "# Heading\n```x = 1```", ""])
    assert same.score < 0.4 and "low_information_density" in same.warnings
    assert useful.tokens == 12 and 0 <= useful.score <= 1
    assert blank.tokens == 0 and code.tokens == 5
    # Punctuation alone has an empty normal form: no duplicate to dedupe, but to score.
    assert all("duplicate_likelihood" in c.warnings for c in textmill.score_chunks(["!!!", "???"]))
    assert textmill.score_chunks([]) == []


def test_custom_scorers(spark):
    textmill.clear_scorers()
    try:
        with pytest.raises(ValueError):
            textmill.register_scorer("none", weight=0)
        with pytest.raises(TypeError):
            textmill.register_scorer("none")(3)

        @textmill.register_scorer("half", weight=0.5)
        def half(text):
            return 0.25

        base = score(spark.createDataFrame([("alpha beta",)], "text string"), scorers=[]).first().score
        assert textmill.score_chunks(["alpha beta"])[0].score == round(0.5 * base + 0.125, 3)
        assert isinstance(half, textmill.Scorer)
    finally:
        textmill.clear_scorers()
    assert blend(0.8, "x", [("fails", 0.5, lambda t: 1 / 0)]) == 0.65
    assert blend(0.8, "x", [("nan", 0.5, lambda t: float("nan"))]) == 0.9
    assert blend(0.8, "x", [("a", 0.8, lambda t: 5), ("b", 0.7, lambda t: 1)]) == 1.0
