"""URL filters: fixed host and path rules, and association rules mined from labels.

A URL is a set of tokens: scheme, host labels and domains, path words, file type,
query keys and values, fragment. Over the labelled pages all token sets are found that
imply the block label with enough confidence, support and lift and contain no smaller
such set: each token's pages are mined apart with the commoner tokens beside it, as in
FP-growth, without a limit on a page's tokens or on sets. These are the rules; a page is
blocked exactly if any such token set, minimal or not, is among its tokens. Each rule is filed in an inverted index under its rarest token, so a URL
meets only rules that share such a token with it, and then all of the rule's tokens are
compared. Pages stay where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

#: (host, path, verdict); the longest rule that fits decides.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule (as text, host then path) that fits, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL."""
    host, path = host_of(url), path_of(url)
    label = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(label), F.lit(1))), lambda i: F.concat(F.lit("domain="), F.array_join(F.slice(label, i, F.size(label)), ".")))
    words = F.transform(F.filter(F.split(path, r"[/._-]+"), lambda w: F.length(w) > 0), lambda w: F.concat(F.lit("path="), F.when(w.rlike("^[0-9]+$"), F.lit("#")).otherwise(w)))
    query = F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda q: F.length(q) > 0)
    keys = F.transform(query, lambda q: F.concat(F.lit("key="), F.substring_index(q, "=", 1)))
    values = F.transform(query, lambda q: F.concat(F.lit("query="), q))
    kind = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    fragment = F.regexp_extract(url, r"(?s)#(.*)$", 1)
    one = F.array(
        F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        F.when(F.size(label) > 2, F.concat(F.lit("first="), label[0])),
        F.when(kind != "", F.concat(F.lit("type="), kind)),
        F.when(fragment != "", F.concat(F.lit("fragment="), fragment)),
        F.when(path.endswith("/"), F.lit("ends=/")),
    )
    return F.array_distinct(F.array_compact(F.concat(one, domains, words, keys, values)))


def document_of(url: Column) -> Column:
    """The document a page shows: the first number that is a whole path segment, or
    begins the last one, as in /en/825.html."""
    return F.try_to_number(F.nullif(F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:[/.]|$)", 1), F.lit("")), F.lit("9" * 18)).cast("long")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Token sets of the labelled pages, and whether each is to be blocked: its document
    is of low quality or toxic."""
    bad = F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc")).agg(bad.alias("bad"))
    shown = pages.where(F.col("url").isNotNull()).select(document_of(F.col("url")).alias("doc"), tokens_of(F.col("url")).alias("tokens")).where("doc is not null")
    return shown.join(known, "doc").select("tokens", (F.col("bad") == 1).alias("bad"))


Index = dict[str, list[tuple[int, frozenset[str]]]]


def fitting(index: Index) -> Callable[[list[str]], list[int]]:
    """For a set of tokens the numbers of the rules that it holds whole."""

    def of(tokens: list[str]) -> list[int]:
        own = set(tokens)
        return [i for t in own for i, wanted in index.get(t, ()) if wanted <= own]

    return of


def _matched(index: Index):
    found = fitting(index)

    @F.pandas_udf("array<int>")
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else found(t))

    return matched


def _shard(least: int, sure: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Searches the sets whose rarest token is the shard's. Its rows: key, rest (the
    page's commoner tokens, by rank), n and bad of such pages."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        n, bad = rows["n"].to_numpy(), rows["bad"].to_numpy()
        sizes = rows["rest"].map(len).to_numpy()
        flat = np.concatenate([np.empty(0, np.int64), *rows["rest"]]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        tokens, starts = np.unique(flat[order], return_index=True)
        holders = np.split(np.repeat(np.arange(len(rows)), sizes)[order], starts[1:])
        found = []
        stack = [(np.arange(len(rows)), (int(rows["key"].iloc[0]),), 0)]
        while stack:
            among, prefix, start = stack.pop()
            all_n = n[among].sum()
            for k in range(start, len(tokens)):
                own = np.intersect1d(among, holders[k], assume_unique=True)
                own_n, own_bad = int(n[own].sum()), int(bad[own].sum())
                if own_bad < least or own_n == all_n:  # too rare, or the token adds nothing
                    continue
                whole = (*prefix, int(tokens[k]))
                if own_bad / own_n >= sure:
                    found.append((whole, own_n, own_bad))
                else:
                    stack.append((own, whole, k + 1))
        return pd.DataFrame({"ranks": pd.Series([list(f[0]) for f in found], dtype=object), "n": pd.Series([f[1] for f in found], dtype=np.int64), "bad": pd.Series([f[2] for f in found], dtype=np.int64)})

    return search


def _sets(sets: DataFrame, least: int, sure: float, often: dict, pages: int) -> list[tuple[list[str], int, int]]:
    """All sets of `least` or more blocked pages, `sure` or more of their pages, that
    contain no other such set, and some that do: tokens, pages, blocked pages.

    Tokens that are such sets alone, or that all pages have, are in no other. For the rest
    each page is filed under each of its tokens with the commoner ones beside it, and each
    token's pages, alike ones counted together, are searched depth first."""
    alone = [([t], n, b) for t, (n, b) in often.items() if b / n >= sure]
    rest = sorted((t for t, (n, b) in often.items() if b / n < sure and n < pages), key=lambda t: (often[t][0], t))
    rank = {t: k for k, t in enumerate(rest)}

    @F.pandas_udf("array<int>")
    def ranks(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda own: sorted(rank[t] for t in own if t in rank))

    alike = sets.select(ranks("tokens").alias("ranks"), "bad").groupBy("ranks").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    beside = alike.select("ranks", "n", "bad", F.posexplode("ranks").alias("at", "key")).select("key", F.expr("slice(ranks, at + 2, size(ranks))").alias("rest"), "n", "bad")
    beside = beside.groupBy("key", "rest").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    found = beside.groupBy("key").applyInPandas(_shard(least, sure), "ranks array<int>, n long, bad long").collect()
    return alone + [([rest[k] for k in r.ranks], r.n, r.bad) for r in found]


def mine(sets: DataFrame, confidence: float = 0.5, support: float = 0.0005, pages: int = 20, lift: float = 1.2) -> DataFrame:
    """Rules for blocking: rule_id, tokens, key (the rarest token), confidence, support.

    A rule holds on blocked pages that are at least `support` of the labelled ones and
    at least `pages`; of the labelled pages that it fits at least `confidence`, and
    `lift` times the share among all, are blocked. A set that contains another rule fits
    no further page and is none. Frequent tokens, at most the tokens of 1 / support pages,
    and rules are held on the driver. Of equally rare tokens the first by name is the key.
    Without labelled or blocked pages there is no rule; repeated pages count as often as
    they occur."""
    spark = sets.sparkSession
    sets = checkpointed(sets)
    sizes = sets.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    schema = "rule_id long, tokens array<string>, key string, confidence double, support double"
    least = int(max(pages, -(-support * sizes.n // 1)))
    if sizes.bad < least:
        return spark.createDataFrame([], schema)
    counted = sets.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    often = {r.token: (r.n, r.bad) for r in counted.where(F.col("bad") >= least).collect()}
    sure = max(confidence, lift * sizes.bad / sizes.n)
    good = [(sorted(tokens), b / n, b / sizes.n) for tokens, n, b in _sets(sets, least, sure, often, sizes.n)]
    # From small to large: a set that contains a rule adds nothing.
    kept: list[tuple[int, list[str], str, float, float]] = []
    small: Index = {}
    for tokens, c, s in sorted(good, key=lambda g: (len(g[0]), g[0])):
        if not fitting(small)(tokens):
            key = min(tokens, key=lambda t: (often[t][0], t))
            small.setdefault(key, []).append((len(kept), frozenset(tokens)))
            kept.append((len(kept), tokens, key, c, s))
    return spark.createDataFrame(kept, schema)


def judge(pages: DataFrame, labels: DataFrame, confidence: float = 0.5, support: float = 0.0005) -> DataFrame:
    """Verdict on every page's url: page_id, host, path, rule, verdict.

    Input: page_id, url of pages; doc_id, quality, toxic of labels; other columns are
    ignored. A null url, or one without ://, has an empty host and path; no fixed rule
    fits it and the mined rules judge what tokens it has. Null label values block
    nothing. Of fixed rules the longest counts, so none tie; a page is blocked if any
    mined rule fits. Repeated urls are judged alike, long ones whole. Without labels
    nothing is mined and what no fixed rule decides is allowed. An empty table gives no
    rows."""
    pages = pages.select("page_id", "url")
    rules = mine(labelled(pages, labels), confidence, support).collect()
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumns({"rule": rule, "known": verdict})
    method = F.lit("allow")
    if rules:
        index: Index = {}
        for r in rules:
            index.setdefault(r.key, []).append((r.rule_id, frozenset(r.tokens)))
        asked = F.when(F.col("known").isNull() & F.col("url").isNotNull(), tokens_of(F.col("url")))
        method = F.when(F.size(_matched(index)(asked)) > 0, "block").otherwise("allow")
    return parsed.select("page_id", "host", "path", "rule", F.coalesce("known", method).alias("verdict"))
