import random
import re

import pytest
from pyspark.sql import functions as F

import textmill
from textmill.functions import chunking as C
from textmill.operators.chunk import chunk_rows, place_chunks


def model_units(text, headings):
    units, lines, code = [], [], False

    def push():
        unit = "\n".join(lines).strip()
        if unit:
            units.append(unit)
        lines.clear()

    for line in re.split("\r?\n", text):
        bare = line.strip()
        if bare.startswith("```"):
            lines.append(line)
            code = not code
            if not code:
                push()
        elif code:
            lines.append(line)
        elif not bare:
            push()
        else:
            if headings and bare.startswith("#"):
                push()
            lines.append(line)
    push()
    return units


def model_windows(w, size, overlap):
    out, at = [], 0
    while w:
        out.append(" ".join(w[at : at + size]))
        if at + size >= len(w):
            return out
        at += size - overlap
    return out


def model_chunks(text, size, overlap, headings):
    out, now = [], []
    for unit in model_units(text, headings):
        w = unit.split()
        if len(w) > size:
            if now:
                out.append(" ".join(now))
            now = []
            out += model_windows(w, size, overlap)
            continue
        if now and len(now) + len(w) > size:
            out.append(" ".join(now))
            now = now[max(0, len(now) - overlap) :]
        now = now + w
    return out + ([" ".join(now)] if now else [])


@pytest.mark.parametrize("size,overlap,headings", [(3, 1, True), (4, 0, True), (5, 3, False), (1, 0, True)])
def test_word_chunks_against_a_model(spark, size, overlap, headings):
    rng = random.Random(size)
    bits = ["a", "b c", "d", "\n", "\n\n", "\r\n", " ", "```", "# h", "#", "```py\n", "  "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.x for r in df.select("i", C.chunk(F.col("t"), size, overlap, headings).alias("x")).orderBy("i").collect()]
    assert got == [model_chunks(t, size, overlap, headings) for t in texts]


def test_literals(spark):
    five = "one two three four five"
    assert textmill.chunk_text(five, 2, 0) == ["one two", "three four", "five"]
    assert textmill.chunk_text(five, 3, 1) == ["one two three", "three four five"]
    assert textmill.chunk_text("# Heading\n\nbody text", 10, 0, False) == ["# Heading body text"]
    assert textmill.chunk_text("a b c\n\nd e f", 3, 1) == ["a b c", "c d e f"]  # the carry may exceed the size
    assert textmill.chunk_text("", 3, 1) == []


def tokens(text):
    return re.findall(r"\w+|[^\w\s]", text)


def test_token_chunks(spark):
    cut = lambda t, size, overlap: textmill.chunk_text(t, size, overlap, mode="token", tokenizer=tokens)
    assert cut("alpha, beta gamma.", 3, 0) == ["alpha, beta", "gamma."]
    assert cut("alpha, beta gamma.", 3, 1) == ["alpha, beta", "beta gamma."]
    assert cut("a,b,c,d e", 2, 1) == ["a,b,c,d", "e"]
    assert isinstance(tokens, textmill.Tokenizer)
    with pytest.raises(TypeError):
        textmill.chunk_text("hello", mode="token")
    with pytest.raises(TypeError):
        textmill.chunk_text("hello", mode="token", tokenizer=lambda t: 3)


def test_configuration():
    for bad in ((0, 0), (2, 2), (2, -1)):
        with pytest.raises(ValueError):
            textmill.chunk_text("hello", *bad)
    with pytest.raises(ValueError):
        textmill.chunk_text("hello", mode="byte")
    with pytest.raises(TypeError):
        textmill.chunk_text(3)


def test_offsets(spark):
    rng = random.Random(9)
    texts = ["a a a a", "A B A C", "", None] + [" ".join(rng.choice("ab") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    texts += ["".join(rng.choice(["a", "bb", " ", "\n", "\n\n", "  "]) for _ in range(20)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    rows = chunk_rows(df, chunk_size=2, overlap=1).orderBy("d", "chunk_index").collect()
    for d, text in enumerate(texts):
        own = [(r.text, r.start_offset, r.end_offset) for r in rows if r.d == d]
        assert own == (place_chunks(text, [o[0] for o in own]) if text else [])
    assert [(r.start_offset, r.end_offset) for r in chunk_rows(df.where("d = 0"), chunk_size=2, overlap=0).orderBy("chunk_index").collect()] == [(0, 3), (2, 5)]
    assert place_chunks("x\ny z", ["x y", "gone"]) == [("x y", 0, 3), ("gone", 1, 1)]
