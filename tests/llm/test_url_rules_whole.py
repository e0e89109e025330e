"""Rules of any tokens of a page are found, however many others are more telling."""

import itertools
import random

from textmill.llm import url_filter


def _minimal(rows, least, sure):
    count = {}
    for tokens, bad in rows:
        for k in range(1, len(tokens) + 1):
            for s in itertools.combinations(sorted(tokens), k):
                n, b = count.get(s, (0, 0))
                count[s] = (n + 1, b + bad)
    good = [set(s) for s, (n, b) in count.items() if b >= least and b / n >= sure]
    return {frozenset(s) for s in good if not any(r < s for r in good)}


def test_pair_behind_thirteen_more_telling_tokens(spark):
    names = [f"c{k:02}" for k in range(13)]
    rows = [([*[c for k, c in enumerate(names) if k != i], "x", "y"], True) for i in range(13) for _ in range(3)]
    rows += [(names, False)] * 60 + [(["x", "z"], False)] * 100 + [(["y", "z"], False)] * 100
    rules = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert {frozenset(r.tokens) for r in rules} >= {frozenset("xy")}
    assert {r.confidence for r in rules if set(r.tokens) == {"x", "y"}} == {1.0}
    assert {frozenset(r.tokens) for r in rules} == _minimal(rows, 20, 0.5)


def test_rules_are_all_minimal_sets(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = []
        for _ in range(300):
            tokens = {t for t in "abcdefgh" if rng.random() < 0.5}
            rows.append((sorted(tokens), len(tokens & set("abc")) > 1 and rng.random() < 0.7 or rng.random() < 0.1))
        rules = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.6, 0.01, 8, 1.0).collect()
        assert rules and {frozenset(r.tokens) for r in rules} == _minimal(rows, 8, 0.6)
