"""Quality scores of chunks: Column to Column.

All arithmetic is in doubles and in a fixed order, so scores are reproducible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import W, let, letters_of, normalize_whitespace, round3

TERMS = ("home", "login", "sign in", "privacy policy", "terms of service", "contact", "copyright")
TERMS_NEEDED = 4
LOW_QUALITY = 0.5


def length_score(tokens: Column) -> Column:
    t = tokens.cast("double")
    return (
        F.when(tokens == 0, 0.0)
        .when((tokens >= 80) & (tokens <= 700), 1.0)
        .when(tokens < 80, F.greatest(t / 80.0, F.lit(0.2)))
        .otherwise(F.greatest(1.0 - (t - 700.0) / 700.0, F.lit(0.2)))
    )


def density_of(flat: Column, letters: Column | None = None) -> Column:
    """density_score of a text whose words are one space apart; letters_of may be given."""
    letters = (letters_of(flat) if letters is None else letters).cast("double")
    n = F.length(flat).cast("double") - letters + 1.0
    distinct = F.size(F.array_distinct(F.split(F.lower(flat), " "))).cast("double")
    raw = distinct / n * 0.7 + F.least(letters / n / 5.0, F.lit(1.0)) * 0.3
    return F.when(flat == "", 0.0).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def density_score(text: Column) -> Column:
    """Share of distinct words, and how long words are."""
    return let(normalize_whitespace(text), lambda flat: density_of(flat))


# Both begin at a character that is rare, and only there look at what is around it.


def has_heading(text: Column) -> Column:
    return text.rlike(f"#(?<![^{W}]#)#*[{W}]+[^{W}]")


def has_list(text: Column) -> Column:
    return text.rlike(f"[-*0-9](?<![^{W}].)(?:(?<=[-*])|(?<=[0-9])[0-9]*\\.)(?![^{W}])")


def structure_score(text: Column) -> Column:
    return F.when(text.contains("```") | has_heading(text), 1.0).when(has_list(text), 0.85).otherwise(0.75)


def is_boilerplate(text: Column) -> Column:
    return holds_terms(F.lower(text))


def holds_terms(low: Column) -> Column:
    """is_boilerplate of a text in lower case."""
    return sum((low.contains(t).cast("int") for t in TERMS), F.lit(0)) >= TERMS_NEEDED


def warnings(tokens: Column, density: Column, duplicated: Column, boilerplate: Column) -> Column:
    rules = (
        (tokens < 20, "too_short"),
        (tokens > 900, "too_long"),
        (density < 0.45, "low_information_density"),
        (duplicated, "duplicate_likelihood"),
        (boilerplate, "boilerplate"),
    )
    return F.array_compact(F.array(*(F.when(when, F.lit(name)) for when, name in rules)))


def penalty(tokens: Column, density: Column, duplicated: Column, boilerplate: Column) -> Column:
    """The warnings' penalties, added in the warnings' order."""
    out = F.lit(0.0)
    for when, cost in (((tokens < 20) | (tokens > 900), 0.05), (density < 0.45, 0.15), (duplicated, 0.15), (boilerplate, 0.25)):
        out = out + F.when(when, cost).otherwise(0.0)
    return out


def final_score(tokens: Column, density: Column, structure: Column, duplicated: Column, boilerplate: Column) -> Column:
    raw = length_score(tokens) * 0.3 + density * 0.3 + F.when(duplicated, 0.35).otherwise(1.0) * 0.2 + structure * 0.2
    x = raw - penalty(tokens, density, duplicated, boilerplate)
    return round3(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))

