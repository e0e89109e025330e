"""Small tables with everything that may go wrong in one."""

from __future__ import annotations

import random

#: Names that operators use inside, added or given out, as columns of the input.
CLASHES = (
    "score hash bucket copies mark n size at h rank nth tie row gone hot salt met null name draw target few same until_draw until_id "
    "n_lines lines_removed n_words words_removed component component_id kept n_shingles key hub members "
    "_score _covered _gone _n _copies _k _draw _all _id _mark _hot _salt _met _null _name _hash _norm"
).split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} double" for c in CLASHES)


def words(rng: random.Random, n: int, v: int = 500) -> str:
    return " ".join(f"w{rng.randrange(v)}" for _ in range(n))


def nasty_texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    long = words(rng, 30_000)
    base = words(rng, 200)
    near = base.split()
    near[50] = "changed"
    return [None, "", " \n\t ", "one", "One", "two words", base, base, " ".join(near), long, long, "é" * 1000, "12345 !!!", "a\x0bb\x1cc", "x\n" * 40, "🙂 ü ß İ"]


def frame(spark, texts, lang="en", source="src0", ids=None):
    """Documents with clashing extra columns, whose values must stay."""
    ids = range(len(texts)) if ids is None else ids
    own = tuple(k + 0.5 for k in range(len(CLASHES)))
    rows = [(i, t, lang(k) if callable(lang) else lang, source(k) if callable(source) else source, len(t or ""), *own) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def untouched(rows, but=()) -> bool:
    """Whether all clashing columns of the rows still hold the input's values."""
    return all(r[c] == k + 0.5 for r in rows for k, c in enumerate(CLASHES) if c not in but)
