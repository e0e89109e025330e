"""Scoring chunks, with duplicates counted over all of them, and custom scorers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.shipping import by_value
from ..functions.text import count_of, kept_words, letters_of, lowered, normalize_whitespace
from .tables import fresh, lookup

Scorers = list[tuple[str, float, Callable[[str], float]]]
_registered: Scorers = []


def register_scorer(name: str, *, weight: float = 0.1):
    """Decorator that adds a custom scorer of a chunk's text to every later scoring."""
    if not 0 < weight <= 1:
        raise ValueError("weight must be over 0 and at most 1")

    def add(scorer: Callable[[str], float]):
        if not callable(scorer):
            raise TypeError("a scorer must be callable")
        _registered.append((name, weight, scorer))
        return scorer

    return add


def clear_scorers() -> None:
    _registered.clear()


def registered_scorers() -> Scorers:
    return list(_registered)


def _clamped(x: float) -> float:
    return 1.0 if math.isnan(x) else max(0.0, min(1.0, x))


def _round3(x: float) -> float:
    """Three decimals, halves of the product by 1,000 away from zero, as round3 and SQL
    have it; x is not negative."""
    whole = math.floor(x * 1000.0)
    return (whole + (x * 1000.0 - whole >= 0.5)) / 1000.0


def blend(base: float, text: str, scorers: Scorers) -> float:
    """The base score with the custom ones. A scorer that fails counts as 0.5."""
    total = max(0.0, 1.0 - min(sum(w for _, w, _ in scorers), 1.0)) * base
    for _, weight, scorer in scorers:
        try:
            value = _clamped(float(scorer(text)))
        except Exception:  # noqa: BLE001 - any failure of a user's scorer is neutral
            value = 0.5
        total += weight * value
    return _round3(_clamped(total))


def _blended(scorers: Scorers):
    for _, _, scorer in scorers:
        by_value(scorer)

    @F.pandas_udf("double")
    def blended(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for base, text in batches:
            yield pd.Series([blend(b, t, scorers) for b, t in zip(base, text)], dtype="float64")

    return blended


def score(chunks: DataFrame, scorers: Scorers | None = None, scope: str | None = None) -> DataFrame:
    """chunks (with `text`) plus tokens, score and warnings.

    A chunk is likely a duplicate if another one, in its scope, has the same normalised
    text. Those texts are counted by hash; only the repeated ones are looked up, and a
    text that fills the table doesn't meet in one task. Columns tokens, score and
    warnings of chunks are replaced."""
    by = [scope] if scope else []
    scorers = registered_scorers() if scorers is None else scorers
    k0, k1, n, flat, low, letters, density, structure, plate = fresh(chunks, "norm0", "norm1", "copies", "flat", "low", "letters", "density", "structure", "plate")
    text = F.col("text")
    # What several terms are made of is a column of its own, so it is made once.
    bare = chunks.withColumns({flat: normalize_whitespace(text), low: lowered(text)})
    norm = kept_words(F.col(low))
    keyed = bare.withColumns({k0: F.xxhash64(norm), k1: F.xxhash64(F.lit("n"), norm)})  # 128 bits
    often = keyed.groupBy(*by, k0, k1).agg(F.count("*").alias(n)).where(F.col(n) > 1)
    terms = {"tokens": count_of(F.col(flat), F.col(letters)), density: S.density_of(F.col(flat), F.col(letters)), structure: S.structure_score(text), plate: S.holds_terms(F.col(low))}
    parts = lookup(keyed.withColumn(letters, letters_of(F.col(flat))).withColumns(terms).drop(flat, low, letters), often, [*by, k0, k1], n)
    common = (F.col(n).isNotNull(), F.col(plate))
    out = parts.withColumns(
        {
            "score": S.final_score(F.col("tokens"), F.col(density), F.col(structure), *common),
            "warnings": S.warnings(F.col("tokens"), F.col(density), *common),
        }
    )
    if scorers:
        out = out.withColumn("score", _blended(scorers)(F.col("score"), text))
    return out.select(*[c for c in chunks.columns if c not in ("tokens", "score", "warnings")], "tokens", "score", "warnings")
