"""Families of chunks that are merely alike: their rounds and the pairs that are formed."""

from textmill.operators import dedupe as D

COMMON = " ".join(f"common{i}" for i in range(42))


def _family(size: int) -> list[tuple[int, str]]:
    return [(i, f"{COMMON} " + " ".join(f"own{i}x{k}" for k in range(18))) for i in range(size)]


def test_rounds_do_not_grow_with_a_family(spark, monkeypatch):
    calls = []
    verified = D._verified
    monkeypatch.setattr(D, "_verified", lambda *a: calls.append(1) or verified(*a))
    monkeypatch.setattr(D, "CROWD", 10)
    chunks = [*_family(40), (40, _family(1)[0][1] + " more")]
    found = D.dedupe(spark.createDataFrame(chunks, "index long, text string"), 0.6)
    assert [(r["index"], r.retained_index) for r in found.removed.collect()] == [(40, 0)]
    assert found.retained.count() == 40
    assert len(calls) <= 3  # one for each member before


def test_pairs_that_cannot_reach_the_threshold_are_not_met(spark):
    rows = spark.createDataFrame([*_family(5), (5, _family(1)[0][1] + " more")], "index long, norm string")
    sets = D._sets(rows, [])
    met = D._meeting(D._prefixes(sets, 0.6, []), [])
    assert [tuple(r) for r in D._met(met, met, 0.6, [], ordered=True).collect()] == [(0, 5)]
    assert [(r.a, r.b) for r in D.near_pairs(rows, 0.6).collect()] == [(0, 5)]


def test_groups_of_parts_and_of_keys_over_batches(spark, monkeypatch):
    """A family in several parts, its rows over several batches, against all pairs."""
    monkeypatch.setattr(D, "PART", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        texts = [" ".join(f"w{j}" for j in range(30) if j != i) for i in range(12)] + ["x y z", "x y z u"]
        got = {(r.a, r.b): r.similarity for r in D.near_pairs(spark.createDataFrame(list(enumerate(texts)), "index long, norm string"), 0.4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    grams = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    want = {(a, b): len(x & y) / len(x | y) for a, x in enumerate(grams) for b, y in enumerate(grams) if a < b and x & y}
    assert got == {k: v for k, v in want.items() if v >= 0.4}
