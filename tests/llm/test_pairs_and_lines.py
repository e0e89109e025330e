"""Near duplicates, line dedup, decontamination."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from textmill.llm import bytesops as B
from textmill.llm import decontaminate as D
from textmill.llm import line_dedup as L
from textmill.llm import near_dup as N

from .helpers import frame, nasty_texts, words


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                k = len(sets[x] & sets[y])
                if 100 * k >= 80 * (len(sets[x]) + len(sets[y]) - k):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in text.split())


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    texts = nasty_texts()
    for _ in range(25):  # groups of edits of edits, so that chains form
        family = [words(rng, rng.choice([1, 2, 3, 5, 20, 120]))]
        for _ in range(rng.randrange(0, 6)):
            family.append(edited(rng, rng.choice(family), rng.choice([0, 0.02, 0.05, 0.1])))
        texts += family
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_in_one_hot_group(spark):
    rng = random.Random(8)
    base = words(rng, 100)
    texts = [base] * 50 + [edited(rng, base, 0.01) for _ in range(150)] + [words(rng, 50) for _ in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_components(enumerate(texts))


@pytest.mark.parametrize("small", [1, 4])
def test_links_within_crowded_buckets(spark, monkeypatch, small):
    """Texts that are merely alike fill the buckets of those that are linked."""
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "HUB_EDGES", 3)
    rng = random.Random(9)
    texts = []
    for size in (40, 90):
        base = words(rng, size)
        family = [base] + [edited(rng, base, rng.choice([0.05, 0.08, 0.11])) for _ in range(40)]
        texts += family + [edited(rng, rng.choice(family), 0.04) for _ in range(20)]
    rng.shuffle(texts)
    called = []
    prefix = N._by_prefix
    monkeypatch.setattr(N, "_by_prefix", lambda *a: called.append(1) or prefix(*a))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_components(enumerate(texts)) and called


def test_near_duplicates_repeated_rows_null_ids_and_empty_table(spark):
    df = frame(spark, ["a b c", "a b c", "x", "x"], ids=[4, 4, None, 2])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 4, True), (4, 4, True), (None, 2, True), (2, 2, True)], key=str)
    assert N.near_duplicates(frame(spark, [])).collect() == []


def test_packed_estimate_is_close(spark):
    rng = random.Random(3)
    texts = []
    for share in (0.02, 0.05, 0.1, 0.2):
        base = words(rng, 600, 10**6)
        texts += [base, edited(rng, base, share)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    marks = next(N.signature_rows(iter([rows])))
    df = spark.createDataFrame([(marks.column("packed")[i].as_py(), marks.column("packed")[i + 1].as_py()) for i in range(0, len(texts), 2)], "a array<long>, b array<long>")
    for k, r in enumerate(df.select(N.estimate("a", "b").alias("e")).collect()):
        a, b = shingle_set(texts[2 * k]), shingle_set(texts[2 * k + 1])
        assert abs(r.e - len(a & b) / len(a | b)) < 0.16


# Line dedup


def test_passages_inside_lines_go_and_other_text_stays(spark):
    rng = random.Random(6)
    passage = words(rng, 56, 10**6)
    host = [words(rng, 80, 10**6) for _ in range(20)]
    texts = [" ".join([h[: len(h) // 2], passage, h[len(h) // 2 :]]) for h in host] + [words(rng, 300, 10**6) for _ in range(10)]
    out = {r.doc_id: r for r in L.line_dedup(frame(spark, texts)).collect()}
    assert out[0].text == texts[0]
    for i in range(1, 20):
        assert 30 <= out[i].words_removed <= 56, i
        assert passage not in out[i].text
    assert all(out[i].text == texts[i] for i in range(20, 30))


def test_three_lines_and_short_lines(spark):
    texts = ["alpha\nbeta\ngamma\nown", "mine\nalpha\nbeta\ngamma", "alpha\nbeta\nother", "x\nx\nx\nx\nx"]
    out = [r.text for r in L.line_dedup(frame(spark, texts)).orderBy("doc_id").collect()]
    assert out == [texts[0], "mine", texts[2], "x"]
    same = L.line_dedup(frame(spark, ["a\nb\nc", "a\nb\nc"], ids=[3, 3])).collect()
    assert [r.text for r in same] == ["a\nb\nc"] * 2
    long = "\n".join(words(random.Random(k), 40) for k in range(3))  # lines of any length are lines
    assert [r.words_removed for r in L.line_dedup(frame(spark, [long, "own words\n" + long])).orderBy("doc_id").collect()] == [0, 120]
    assert L.line_dedup(frame(spark, [])).collect() == []


# Decontamination


def test_decontamination_of_empty_tables_and_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, "a b c d e f g h"), (3, "one two three four five six")], "item_id long, text string")
    assert D.matches(frame(spark, ["x"]), bench.limit(0)).collect() == []
    assert D.matches(frame(spark, []), bench).collect() == []
    monkeypatch.setattr(D, "BLOCK_WORDS", 5)
    df = frame(spark, ["One, two three; four five six!", "a b c d e f g h one two three four five six"])
    assert sorted((r.doc_id, r.item_id) for r in D.matches(df, bench).collect()) == [(0, 1), (0, 3), (1, 1), (1, 2), (1, 3)]
    assert D.clean(df, bench).collect() == []


@pytest.mark.parametrize("n", [1, 4, 5, 9, 10, 63, 64, 200])
def test_pieces_cover_the_item(n):
    parts = D.pieces(n)
    assert len(parts) == n // 5 + 1 and sum(s for _, s in parts) == n and min(s for _, s in parts) >= 1


def test_span_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"xx hello yy hello", np.uint8)
    h = B.span_hash(data, np.array([3, 12]), np.array([8, 17]))
    assert h[0] == h[1]
