import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

import textmill
from textmill.functions import text as T


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


WHITE = "\t\n\x0b\x0c\r \x85\xa0      　"


def model_clean(t):
    """Character by character, written from the description of the behaviour."""
    t = unicodedata.normalize("NFKC", t)
    t = html.unescape(t) if "&" in t else t
    out, i = [], 0
    while i < len(t):
        if t[i] != "<":
            out.append(t[i])
            i += 1
            continue
        end = t.find(">", i)
        if end < 0:
            out.append(t[i:])
            break
        m = re.match(rf"[{WHITE}]*(script|style)(?=[{WHITE}/]|$)", t[i + 1 : end], re.I | re.A)
        out.append(" ")
        if not m:
            i = end + 1
            continue
        close = re.search(f"</{m[1]}", t[end + 1 :], re.I | re.A)
        after = t.find(">", end + 1 + close.start()) if close else -1
        if after < 0:
            break
        i = after + 1
    return " ".join(w for w in re.split(f"[{WHITE}]+", "".join(out)) if w)


def test_clean_against_a_model(spark):
    rng = random.Random(4)
    bits = ["<", ">", "</", "script", "STYLE", "style ", "/", " ", "\n", "&lt;", "&amp;", "&copy", "a", "bc", "é", "＜", "​", "ﬁ", "<b>", "<script>", "</script>", "<style/>", "</styles >", "　", "!--"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(1500)]
    assert column(spark, texts, T.clean) == [model_clean(t) for t in texts]


def test_clean_literals_and_null(spark):
    cases = {
        "hello\n\n  world": "hello world",
        "<h1>Hello</h1><p>world</p>": "Hello world",
        "<p>Tom &amp; Jerry</p>": "Tom & Jerry",
        "a < b > c": "a c",
        "<b>a</b>b": "a b",
        "&amp;lt;": "&lt;",
        "x\x1cy": "x\x1cy",
        "": "",
    }
    assert column(spark, [*cases, None], T.clean) == [*cases.values(), None]
    assert textmill.clean_text("ＡＢＣ") == "ABC"
    with pytest.raises(TypeError):
        textmill.clean_text(None)


def test_normalising(spark):
    got = column(spark, ["Hello,  World_1!", "ΑΣ Σ", "!!!", "İx", "Straße ²"], T.normalize_for_dedupe)
    assert got == ["hello world_1", "ας σ".replace("ς", "σ"), "", "i x", "straße ²"]
    a, b = column(spark, ["Straße\n X", "STRASSE x"], T.normalized_hash)
    assert a == b
    assert column(spark, ["Σς ß", "K"], T.casefold) == ["σσ ss", "k"]


def test_shingles_and_similarity(spark):
    assert column(spark, ["", "a", "a b", "a b c", "a b c a b c"], T.shingles) == [[], ["a"], ["a b"], ["a b c"], ["a b c", "b c a", "c a b"]]
    df = spark.createDataFrame([(["a"], ["a", "b"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]
