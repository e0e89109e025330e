"""Cleaning and normalising text: Column to Column."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A class tests its members one after another, so those beyond Latin-1 stand behind one
# range that fails at once for most characters; single characters are tested together.
_HIGH = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
#: Unicode White_Space but the plain space, as the inside of a Java character class.
W_BUT_SPACE = r"\t\n\x0B\f\r\x85\xA0" + _HIGH
#: Unicode White_Space.
W = " " + W_BUT_SPACE
#: What Python's str.split splits on: four separators more.
W_WIDE = r"\x1C\x1D\x1E\x1F" + W_BUT_SPACE
W_PY = " " + W_WIDE

_MARKUP = "(?s)" + "|".join(
    [rf"<[{W}]*(?i:{name})(?:[{W}/][^>]*)?>(?:.*?</(?i:{name})[^>]*>|.*)" for name in ("script", "style")] + ["<[^>]*>"]
)
_DECODABLE = "&(#|[A-Za-z])"
#: Characters that NFKC may change: all but ASCII and the composed Latin-1 letters.
_UNSTABLE = r"[\x{80}-\x{10FFFF}&&[^\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it. A plain column
    expression would be computed again for every element that a lambda visits."""
    return F.transform(F.array(value), body)[0]


def trim(text: Column) -> Column:
    """Without White_Space at either end."""
    return F.regexp_replace(text, f"^[{W}]+|[{W}]+$", "")


#: Runs of white space but the single plain space, which can stay as it is.
_RUNS = f"[{W_BUT_SPACE}][{W}]*| [{W}]+"
_RUNS_PY = f"[{W_WIDE}][{W_PY}]*| [{W_PY}]+"
_KEPT = r"a-z0-9_[\x{80}-\x{10FFFF}&&[\p{IsAlphabetic}\p{N}]]"


def normalize_whitespace(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(text, _RUNS, " "))


def words(text: Column) -> Column:
    """The words of a text; none for a blank one."""
    none = F.array().cast("array<string>")
    return let(normalize_whitespace(text), lambda flat: F.when(flat == "", none).otherwise(F.split(flat, " ")))


def letters_of(flat: Column) -> Column:
    """Number of characters but spaces."""
    return F.length(F.replace(flat, F.lit(" "), F.lit("")))


def count_of(flat: Column, letters: Column | None = None) -> Column:
    """Number of words of a text whose words are one space apart; letters_of may be given."""
    letters = letters_of(flat) if letters is None else letters
    return F.when(flat == "", 0).otherwise(F.length(flat) - letters + 1).cast("long")


def _count(flat: Column) -> Column:
    return let(flat, lambda t: count_of(t))


def word_count(text: Column) -> Column:
    return _count(normalize_whitespace(text))


def python_word_count(text: Column) -> Column:
    """Number of words as Python's str.split counts them."""
    return _count(F.trim(F.regexp_replace(text, _RUNS_PY, " ")))


def strip_markup(text: Column) -> Column:
    """Tags, and script and style blocks with what they hold, become one space each.

    A tag runs to the next `>`; a `<` without one stays. An unclosed script or style
    block takes the rest of the text."""
    return F.when(text.contains("<"), F.regexp_replace(text, _MARKUP, " ")).otherwise(text)


def _decode(text: str) -> str:
    composed = unicodedata.normalize("NFKC", text)
    return html.unescape(composed) if "&" in composed else composed


@F.pandas_udf(StringType())
def _decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(_decode, na_action="ignore")


def decode(text: Column) -> Column:
    """NFKC, then HTML entities, each once. Only rows that either may change go
    through Python; the others reach it as null and cost next to nothing."""
    needs = (text.contains("&") & text.rlike(_DECODABLE)) | text.rlike(_UNSTABLE)
    return F.coalesce(_decoded(F.when(needs, text)), text)


def clean(text: Column) -> Column:
    """Decode, strip markup, collapse white space. Null stays null."""
    return normalize_whitespace(strip_markup(decode(text)))


def normalize_for_dedupe(text: Column) -> Column:
    """Lower case; letters, digits and underscores kept, all else one space."""
    return kept_words(lowered(text))


def lowered(text: Column) -> Column:
    """Lower case; a final sigma isn't special here."""
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def kept_words(low: Column) -> Column:
    """normalize_for_dedupe of a text in lower case."""
    return F.trim(F.regexp_replace(low, f"[^ {_KEPT}][^{_KEPT}]*| [^{_KEPT}]+", " "))


def shingles(normalized: Column) -> Column:
    """The set of three-word shingles of a normalised text; of fewer words, the whole
    text; of an empty one, nothing."""
    one = F.array(normalized)

    def several(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat_ws(" ", w[i - 1], w[i], w[i + 1])))

    made = let(F.split(normalized, " "), lambda w: F.when(F.size(w) < 3, one).otherwise(several(w)))
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(made)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets, 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def round3(x: Column) -> Column:
    """Three decimals, halves away from zero."""
    return F.round(x * 1000.0) / 1000.0


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


@F.pandas_udf(StringType())
def _casefolded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(str.casefold, na_action="ignore")


def casefold(text: Column) -> Column:
    """Python's casefold. Latin letters need only lower case and ß; rows that hold
    anything beyond go through Python."""
    needs = text.rlike(r"[^\x{0}-\x{B4}\x{B6}-\x{FF}]")
    fast = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.coalesce(_casefolded(F.when(needs, text)), fast)


def normalized_hash(text: Column) -> Column:
    """Hash of the case-folded words; punctuation counts, unlike in dedupe."""
    return F.sha2(F.trim(F.regexp_replace(casefold(text), _RUNS_PY, " ")), 256)
