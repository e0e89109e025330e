"""Score terms against their plain forms, and what is computed once."""

import random

from pyspark.sql import functions as F

from textmill.functions import scoring as S
from textmill.functions.text import W, lowered
from textmill.operators.score import score
from textmill.operators.stats import warning_histogram


def test_headings_and_lists_as_the_plain_patterns(spark):
    rng = random.Random(5)
    pieces = ["#", "##", "-", "*", "1", "12", ".", " ", " ", "\n", "a", "\u3000", "\x85", "😀", "\r\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9))) for _ in range(6000)]
    t = F.col("text")
    plain = t.rlike(f"(^|[{W}])#+[{W}]+[^{W}]"), t.rlike(f"(^|[{W}])([-*]|[0-9]+\\.)([{W}]|$)")
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", *(p.alias(f"p{i}") for i, p in enumerate(plain)), S.has_heading(t).alias("h"), S.has_list(t).alias("l"))
    assert rows.where("p0 <> h or p1 <> l").collect() == []
    assert rows.where("h").count() > 100 and rows.where("l").count() > 100


def test_lower_case_with_sigmas(spark):
    rows = spark.createDataFrame([("ΑΣ Σ ΣΑΣ.",), ("İ ß Ä",)], "text string")
    old = F.lower(F.translate("text", "Σ", "σ"))
    assert rows.where(lowered(F.col("text")) != old).count() == 0


def test_white_space_is_made_plain_once_a_chunk(spark):
    """The pattern for it occurs once in the plan, beside those of the other terms."""
    chunks = spark.createDataFrame([("a b",), ("c  d",)], "text string")
    scored = score(chunks, scorers=[])
    plan = warning_histogram(scored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text") == 1
    assert sorted((r.warning, r.chunks) for r in warning_histogram(scored).collect()) == [("too_short", 2)]
