"""DuckDB's side of the catalogue: pieces of SQL and what is built from them."""

from __future__ import annotations

WHITE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"

STRIPPED = r"""regexp_replace(regexp_replace({},
  '(?s)<\s*(?i:script)([\s/][^>]*)?>(.*?</(?i:script)[^>]*>|.*)|<\s*(?i:style)([\s/][^>]*)?>(.*?</(?i:style)[^>]*>|.*)', ' ', 'g'),
  '<[^>]*>', ' ', 'g')"""
DECODED = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
CLEAN_PAGE = WHITE.format(STRIPPED.format(DECODED.format("html")))

_ROWS = "SELECT doc_id, lang, source, {} FROM documents"
_MARKED = """'marked' AS variant, CASE lang WHEN 'en' THEN '# ' || lang || chr(10) || chr(10) || text
  WHEN 'fr' THEN '```' || chr(10) || text || chr(10) || '```' WHEN 'de' THEN '1. ' || text ELSE '- item ' || text END AS text"""
STRUCTURED = "\n  UNION ALL ".join(
    _ROWS.format(x) for x in (_MARKED, "'plate', text || ' Home Login Sign in Privacy policy Contact'", "'again', repeat('again ', 30)", "'short', source || ' ' || lang")
)

TERMS = ("home", "login", "sign in", "privacy policy", "terms of service", "contact", "copyright")


def windows(w: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"[array_to_string({w}[i * {step} + 1 : i * {step} + {size}], ' ') for i in range(0, 1 + CAST(ceil(greatest(len({w}) - {size}, 0) / {step}.0) AS BIGINT))]"


def chunks(size: int, overlap: int, source: str = "SELECT doc_id AS id, text FROM documents", flat: str = WHITE.format("text")) -> str:
    """CTEs up to c(id, chunk_index, text, index) and doc(id, flat)."""
    step = size - overlap
    return f"""src AS ({source}), doc AS (SELECT id, {flat} AS flat FROM src),
w AS (SELECT id, string_split(flat, ' ') AS w FROM doc WHERE flat <> ''),
k AS (SELECT id, w, unnest(range(0, 1 + CAST(ceil(greatest(len(w) - {size}, 0) / {step}.0) AS BIGINT))) AS i FROM w),
c AS (SELECT id, i AS chunk_index, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS text,
  row_number() OVER (ORDER BY id, i) - 1 AS "index" FROM k)"""


def shingle_sets(rows: str) -> str:
    """CTEs s(scope, idx, g) and n(scope, idx, n) over rows with scope, idx, norm."""
    return f"""sh AS (SELECT scope, idx, string_split(norm, ' ') AS w FROM {rows} WHERE norm <> ''),
s AS (SELECT DISTINCT scope, idx, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS g FROM sh),
n AS (SELECT scope, idx, count(*) AS n FROM s GROUP BY ALL)"""


def edges(rows: str, threshold: float) -> str:
    """CTEs up to e(scope, a, b, similarity)."""
    return f"""{shingle_sets(rows)},
p AS (SELECT x.scope, x.idx AS a, y.idx AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.scope = y.scope AND x.idx < y.idx GROUP BY ALL),
e AS (SELECT p.scope, a, b, k::DOUBLE / (x.n + y.n - k) AS similarity FROM p JOIN n x ON x.idx = a JOIN n y ON y.idx = b
  WHERE k::DOUBLE / (x.n + y.n - k) >= {threshold}e0)"""


def deduped(threshold: float | None, exact: bool = True, normalized: bool = True, scoped: bool = False) -> str:
    """CTEs over c(index, text, and scope if scoped): kept(idx) and gone(idx, text, retained_index, kind, similarity)."""
    scope = "scope" if scoped else "0 AS scope"
    by_norm = normalized or threshold is not None
    key = f"CASE WHEN {'norm <> ' + chr(39) * 2 if by_norm else 'false'} THEN 'n' || norm ELSE {chr(39)}t{chr(39) + ' || text' if exact else 'i' + chr(39) + ' || idx'} END"
    base = f"""b0 AS (SELECT {scope}, "index" AS idx, text, {NORM.format("text")} AS norm FROM c),
b1 AS (SELECT *, {key} AS key FROM b0),
b AS (SELECT *, min(idx) OVER (PARTITION BY scope, key) AS rep FROM b1),
reps AS (SELECT * FROM b WHERE idx = rep)"""
    kind = f"CASE {'WHEN b.text = r.text THEN ' + chr(39) + 'exact' + chr(39) if exact else ''} {'WHEN b.norm <> ' + chr(39) * 2 + ' THEN ' + chr(39) + 'normalized' + chr(39) if normalized else ''} {'WHEN false THEN ' + chr(39) * 2 if not (exact or normalized) else ''} ELSE 'near_duplicate' END"
    if threshold is None:
        return f"""{base},
kept AS (SELECT idx FROM reps),
gone AS (SELECT b.scope, b.idx, b.text, b.rep AS retained_index, {kind} AS kind, 1e0 AS similarity FROM b JOIN b r ON r.idx = b.rep WHERE b.idx <> b.rep)"""
    return f"""{base}, {edges("reps", threshold)},
node AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM (SELECT a AS x FROM e UNION SELECT b FROM e)),
near AS (SELECT node.k, node.x, coalesce((SELECT list(a) FROM e WHERE e.b = node.x), []) AS before FROM node),
walk AS (SELECT 0::BIGINT AS k, CAST([] AS BIGINT[]) AS chosen
  UNION ALL SELECT near.k, CASE WHEN list_has_any(near.before, walk.chosen) THEN walk.chosen ELSE list_append(walk.chosen, near.x) END
  FROM walk JOIN near ON near.k = walk.k + 1),
chosen AS (SELECT unnest(chosen) AS x FROM (SELECT chosen FROM walk ORDER BY k DESC LIMIT 1)),
lost AS (SELECT x FROM node EXCEPT SELECT x FROM chosen),
kept AS (SELECT idx FROM reps WHERE idx NOT IN (SELECT x FROM lost)),
both_ AS (SELECT a AS rep, b AS r, similarity FROM e UNION ALL SELECT b, a, similarity FROM e),
best AS (SELECT b.scope, b.idx, b.text, y.r, y.similarity, row_number() OVER (PARTITION BY b.idx ORDER BY y.similarity DESC, y.r) AS k
  FROM b JOIN lost ON lost.x = b.rep JOIN both_ y ON y.rep = b.rep JOIN chosen ON chosen.x = y.r WHERE y.r < b.idx),
gone AS (SELECT b.scope, b.idx, b.text, b.rep AS retained_index, {kind} AS kind, 1e0 AS similarity
  FROM b JOIN b r ON r.idx = b.rep WHERE b.idx <> b.rep AND b.rep NOT IN (SELECT x FROM lost)
  UNION ALL SELECT scope, idx, text, r, 'near_duplicate', round(similarity * 1000) / 1000 FROM best WHERE k = 1)"""


def scores(rows: str, scope: str = "") -> str:
    """CTEs up to scored(rows' columns, tokens, density, structure, twice, plate, length, score, warnings)."""
    by = f"{scope}, " if scope else ""
    plate = " + ".join(f"contains(lower(text), '{t}')::INT" for t in TERMS)
    return f"""q0 AS (SELECT *, {WHITE.format("text")} AS flat, {NORM.format("text")} AS nrm FROM {rows}),
q1 AS (SELECT *, CASE WHEN flat = '' THEN 0 ELSE len(string_split(flat, ' ')) END AS tokens, count(*) OVER (PARTITION BY {by}nrm) > 1 AS twice FROM q0),
q2 AS (SELECT *, {plate} >= 4 AS plate,
  CASE WHEN flat = '' THEN 0e0 ELSE least(greatest(len(list_distinct(string_split(lower(flat), ' ')))::DOUBLE / tokens::DOUBLE * 0.7e0
    + least(length(replace(flat, ' ', ''))::DOUBLE / tokens::DOUBLE / 5e0, 1e0) * 0.3e0, 0e0), 1e0) END AS density,
  CASE WHEN contains(text, '```') OR regexp_matches(text, '(^|\\s)#+\\s+\\S') THEN 1e0
    WHEN regexp_matches(text, '(^|\\s)([-*]|[0-9]+\\.)(\\s|$)') THEN 0.85e0 ELSE 0.75e0 END AS structure,
  CASE WHEN tokens = 0 THEN 0e0 WHEN tokens BETWEEN 80 AND 700 THEN 1e0 WHEN tokens < 80 THEN greatest(tokens::DOUBLE / 80e0, 0.2e0)
    ELSE greatest(1e0 - (tokens::DOUBLE - 700e0) / 700e0, 0.2e0) END AS length FROM q1),
scored AS (SELECT *, round(least(greatest(length * 0.3e0 + density * 0.3e0 + CASE WHEN twice THEN 0.35e0 ELSE 1e0 END * 0.2e0 + structure * 0.2e0
    - (0e0 + CASE WHEN tokens < 20 OR tokens > 900 THEN 0.05e0 ELSE 0e0 END + CASE WHEN density < 0.45e0 THEN 0.15e0 ELSE 0e0 END
      + CASE WHEN twice THEN 0.15e0 ELSE 0e0 END + CASE WHEN plate THEN 0.25e0 ELSE 0e0 END), 0e0), 1e0) * 1000e0) / 1000e0 AS score,
  list_filter_nulls_placeholder AS warnings FROM q2)""".replace(
        "list_filter_nulls_placeholder",
        "[x for x in [CASE WHEN tokens < 20 THEN 'too_short' END, CASE WHEN tokens > 900 THEN 'too_long' END, CASE WHEN density < 0.45e0 THEN 'low_information_density' END, CASE WHEN twice THEN 'duplicate_likelihood' END, CASE WHEN plate THEN 'boilerplate' END] if x IS NOT NULL]",
    )


def packed(units: str, size: int, overlap: int) -> str:
    """CTEs up to out(conv_id, chunk_index, text) from units(conv_id, k, w), by greedy packing."""
    step = windows("u.w", size, overlap)
    return f"""RECURSIVE {units},
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS done, CAST([] AS VARCHAR[]) AS now FROM units
  UNION ALL
  SELECT u.conv_id, u.k,
    CASE WHEN len(u.w) > {size} THEN list_concat(p.done, CASE WHEN len(p.now) > 0 THEN [array_to_string(p.now, ' ')] ELSE [] END, {step})
      WHEN len(p.now) > 0 AND len(p.now) + len(u.w) > {size} THEN list_append(p.done, array_to_string(p.now, ' ')) ELSE p.done END,
    CASE WHEN len(u.w) > {size} THEN [] WHEN len(p.now) > 0 AND len(p.now) + len(u.w) > {size}
      THEN list_concat(p.now[greatest(len(p.now) - {overlap}, 0) + 1 : len(p.now)], u.w) ELSE list_concat(p.now, u.w) END
  FROM p JOIN units u ON u.conv_id = p.conv_id AND u.k = p.k + 1),
l AS (SELECT conv_id, CASE WHEN len(now) > 0 THEN list_append(done, array_to_string(now, ' ')) ELSE done END AS all_
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS last FROM p) WHERE last = 1),
out AS (SELECT conv_id, i - 1 AS chunk_index, all_[i] AS text FROM (SELECT conv_id, all_, unnest(range(1, len(all_) + 1)) AS i FROM l))"""
