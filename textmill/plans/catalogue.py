"""Every query of the engine and, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions.chunking import chunk
from ..operators import stats as A
from ..operators.chunk import chunk_rows
from ..operators.dedupe import dedupe, near_pairs
from ..operators.score import score
from ..operators.tables import checkpointed, numbered, ordered
from ..sources.tables import documents, parquet
from ..streaming.batches import batched
from . import oracle as O
from .pipeline import Pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "documents")


def structured(spark: SparkSession, sf: str) -> DataFrame:
    """Every document whole: as a text with a heading, a fence or a list, by language;
    and, as rows more, with boilerplate at its end; a repeated word and a short text."""
    t, nl, lang = F.col("text"), "\n", F.col("lang")
    marked = (
        F.when(lang == "en", F.concat(F.lit("# "), "lang", F.lit(nl * 2), t))
        .when(lang == "fr", F.concat(F.lit("```" + nl), t, F.lit(nl + "```")))
        .when(lang == "de", F.concat(F.lit("1. "), t))
        .otherwise(F.concat(F.lit("- item "), t))
    )
    variants = {"marked": marked, "plate": F.concat(t, F.lit(" Home Login Sign in Privacy policy Contact")), "again": F.repeat(F.lit("again "), 30), "short": F.concat("source", F.lit(" "), "lang")}
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), x.alias("text")) for v, x in variants.items())))
    return docs(spark, sf).select("doc_id", "lang", "source", rows.alias("v")).select("doc_id", "lang", "source", "v.variant", "v.text")


def chunk_table(spark: SparkSession, sf: str, size: int = 512, overlap: int = 64, offsets: bool = False, order: bool = False) -> DataFrame:
    source = ordered(docs(spark, sf), "doc_id") if order else docs(spark, sf)
    cleaned = source.select("doc_id", T.clean(F.col("text")).alias("text"))
    return chunk_rows(cleaned, chunk_size=size, overlap=overlap, single_line=True, offsets=offsets)


def indexed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(chunk_table(spark, sf, order=True))


# Cleaning and normalising


@query("clean_whitespace_documents", f"SELECT doc_id, {O.WHITE.format('text')} AS text FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query("strip_html_pages", f"SELECT page_id, {O.WHITE.format(O.STRIPPED.format('html'))} AS text FROM pages")
def _(spark, sf):
    return parquet(spark, sf, "pages").select("page_id", T.normalize_whitespace(T.strip_markup(F.col("html"))).alias("text"))


@query("clean_pages", f"SELECT page_id, {O.CLEAN_PAGE} AS text FROM pages")
def _(spark, sf):
    return parquet(spark, sf, "pages").select("page_id", T.clean(F.col("html")).alias("text"))


_BLOCKS = "(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>"


@query("script_style_blocks_pages", f"SELECT page_id, len(regexp_extract_all(html, '{_BLOCKS}'))::BIGINT AS blocks FROM pages")
def _(spark, sf):
    return parquet(spark, sf, "pages").select("page_id", F.regexp_count("html", F.lit(_BLOCKS)).cast("long").alias("blocks"))


@query("normalize_documents", f"SELECT doc_id, {O.NORM.format('text')} AS norm FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_for_dedupe(F.col("text")).alias("norm"))


@query("normalized_hash_documents", r"SELECT doc_id, sha256(text) AS content_hash, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS normalized_hash FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), T.normalized_hash(F.col("text")).alias("normalized_hash"))


@query(
    "fingerprint_sizes",
    f"WITH r AS (SELECT 0 AS scope, doc_id AS idx, {O.NORM.format('text')} AS norm FROM documents), {O.shingle_sets('r')} SELECT doc_id, coalesce(n.n, 0)::BIGINT AS shingles FROM documents LEFT JOIN n ON n.idx = doc_id",
)
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.shingles(T.normalize_for_dedupe(F.col("text")))).cast("long").alias("shingles"))


@query(
    "jaccard_pairs_benchmark_documents",
    f"""WITH r AS (SELECT 0 AS scope, doc_id AS idx, {O.NORM.format('text')} AS norm FROM documents
  UNION ALL SELECT 1, item_id, {O.NORM.format('text')} FROM benchmark), {O.shingle_sets('r')},
p AS (SELECT x.idx AS item_id, y.idx AS doc_id, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.scope = 1 AND y.scope = 0 GROUP BY ALL)
SELECT item_id, doc_id, k::DOUBLE / (x.n + y.n - k) AS similarity FROM p JOIN n x ON x.scope = 1 AND x.idx = item_id JOIN n y ON y.scope = 0 AND y.idx = doc_id""",
)
def _(spark, sf):
    def grams(df: DataFrame, key: str, n: str) -> DataFrame:
        # The set's size goes with each member; beside explode it would be computed again for every row.
        sized = T.let(T.shingles(T.normalize_for_dedupe(F.col("text"))), lambda s: F.transform(s, lambda g: F.struct(g.alias("g"), F.size(s).alias("n"))))
        return df.select(key, F.explode(sized).alias("x")).select(key, F.col("x.g").alias("g"), F.col("x.n").alias(n))

    d, b = grams(docs(spark, sf), "doc_id", "nd"), grams(parquet(spark, sf, "benchmark"), "item_id", "nb")
    shared = d.join(b, "g").groupBy("item_id", "doc_id", "nd", "nb").agg(F.count("*").alias("k"))
    return shared.select("item_id", "doc_id", (F.col("k") / (F.col("nd") + F.col("nb") - F.col("k"))).alias("similarity"))


# Chunking


def _chunks_sql(size: int, overlap: int) -> str:
    return f"WITH {O.chunks(size, overlap)} SELECT id AS doc_id, chunk_index, text FROM c"


for _name, _size, _overlap in (("chunk_documents", 512, 64), ("chunk_small", 64, 8), ("chunk_no_overlap", 128, 0)):

    @query(_name, _chunks_sql(_size, _overlap))
    def _(spark, sf, size=_size, overlap=_overlap):
        return chunk_table(spark, sf, size, overlap)


_SEPARATE = r"""t AS (SELECT conv_id, turn, role, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
a AS (SELECT conv_id, 2 * turn AS o, ['#', role] AS w FROM t UNION ALL SELECT conv_id, 2 * turn + 1, w FROM t),
units AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS k, w FROM a)"""


def _conversations(spark: SparkSession, sf: str, line: Column, between: Column) -> DataFrame:
    """One text per conversation: its turns, in order, each a line or more."""
    t = parquet(spark, sf, "conversations").where("trim(text) <> ''").select("conv_id", "turn", F.concat(line, between).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "")
    return t.groupBy("conv_id").agg(joined.alias("text"))


def _chunked(df: DataFrame, **how) -> DataFrame:
    return chunk_rows(df, offsets=False, **how)


@query("chunk_structural_conversations", f"WITH {O.packed(_SEPARATE, 50, 8)} SELECT conv_id, chunk_index, text FROM out")
def _(spark, sf):
    line = F.concat(F.lit("# "), "role", F.lit("\n\n"), "text")
    return _chunked(_conversations(spark, sf, line, F.lit("\n\n")), chunk_size=50, overlap=8)


_TOGETHER = r"""t AS (SELECT conv_id, turn, '# ' || role || ' ' || text AS text FROM conversations WHERE trim(text) <> ''),
a AS (SELECT conv_id, turn // 2 AS o, string_split(trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '\s+', ' ', 'g')), ' ') AS w FROM t GROUP BY ALL),
units AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS k, w FROM a)"""


@query("chunk_no_headings", f"WITH {O.packed(_TOGETHER, 90, 10)} SELECT conv_id, chunk_index, text FROM out")
def _(spark, sf):
    line = F.concat(F.lit("# "), "role", F.lit("\n"), "text")
    odd = F.when(F.col("turn") % 2 == 1, F.lit("\n\n")).otherwise(F.lit("\n"))
    return _chunked(_conversations(spark, sf, line, odd), chunk_size=90, overlap=10, preserve_headings=False)


def punctuation_tokens(text: str) -> list[str]:
    return re.findall(r"\w+|[^\w\s]", text)


punctuation_tokens.by_word = True  # no token spans white space


@query("chunk_token_mode")
def _(spark, sf):
    cut = chunk(F.col("text"), 256, 32, mode="token", tokenizer=punctuation_tokens)
    return structured(spark, sf).select("doc_id", "variant", F.posexplode(cut).alias("chunk_index", "text"))


@query(
    "chunk_offsets",
    f"""WITH RECURSIVE {O.chunks(64, 8)},
o AS (SELECT c.id, 0::BIGINT AS chunk_index, instr(flat, c.text) - 1 AS start_offset, length(c.text) AS n FROM c JOIN doc USING (id) WHERE c.chunk_index = 0
  UNION ALL SELECT c.id, c.chunk_index, o.start_offset + instr(substr(doc.flat, o.start_offset + 2), c.text), length(c.text)
  FROM o JOIN c ON c.id = o.id AND c.chunk_index = o.chunk_index + 1 JOIN doc ON doc.id = c.id)
SELECT id AS doc_id, chunk_index, start_offset::BIGINT AS start_offset, (start_offset + n)::BIGINT AS end_offset FROM o""",
)
def _(spark, sf):
    return chunk_table(spark, sf, 64, 8, offsets=True).select("doc_id", "chunk_index", "start_offset", "end_offset")


# Duplicates

_GONE = "SELECT gone.idx AS \"index\", gone.text AS chunk, gone.retained_index, r.text AS retained_chunk, gone.kind, gone.similarity FROM gone JOIN c r ON r.\"index\" = gone.retained_index"


def _dedupe_sql(select: str, threshold: float | None, **how) -> str:
    return f"WITH RECURSIVE {O.chunks(512, 64)}, {O.deduped(threshold, **how)} {select}"


@query("dedupe_exact", _dedupe_sql(_GONE, None, normalized=False))
def _(spark, sf):
    return dedupe(indexed_chunks(spark, sf), normalized=False, near_duplicates=False, settled=True).removed


@query("dedupe_normalized", _dedupe_sql(_GONE, None))
def _(spark, sf):
    return dedupe(indexed_chunks(spark, sf), near_duplicates=False, settled=True).removed


@query("dedupe_removed", _dedupe_sql(_GONE, 0.9))
def _(spark, sf):
    return dedupe(indexed_chunks(spark, sf), settled=True).removed


@query("dedupe_removed_06", _dedupe_sql(_GONE, 0.6))
def _(spark, sf):
    return dedupe(indexed_chunks(spark, sf), 0.6, settled=True).removed


@query("dedupe_near_only_06", _dedupe_sql(_GONE, 0.6, exact=False, normalized=False))
def _(spark, sf):
    return dedupe(indexed_chunks(spark, sf), 0.6, exact=False, normalized=False, settled=True).removed


@query("dedupe_retained", _dedupe_sql('SELECT "index", id AS doc_id, chunk_index, c.text FROM c JOIN kept ON kept.idx = c."index"', 0.9))
def _(spark, sf):
    return dedupe(indexed_chunks(spark, sf), settled=True).retained.select("index", "doc_id", "chunk_index", "text")


@query("dedupe_stats", _dedupe_sql("SELECT (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM kept) AS retained_count, (SELECT count(*) FROM gone) AS duplicate_count, (SELECT count(*) FROM gone)::DOUBLE / (SELECT count(*) FROM c) AS duplicate_ratio", 0.9))
def _(spark, sf):
    return dedupe(indexed_chunks(spark, sf), settled=True).stats


@query("dedupe_groups", _dedupe_sql("SELECT gone.retained_index, r.text AS retained_chunk, count(*) AS duplicates, min(gone.idx) AS first_duplicate FROM gone JOIN c r ON r.\"index\" = gone.retained_index GROUP BY ALL", 0.6))
def _(spark, sf):
    return dedupe(indexed_chunks(spark, sf), 0.6, settled=True).groups


_PAIR_ROWS = f"r AS (SELECT 0 AS scope, \"index\" AS idx, {O.NORM.format('text')} AS norm FROM c)"

for _name, _t in (("dedupe_near_pairs", 0.9), ("dedupe_near_pairs_06", 0.6)):

    @query(_name, f"WITH {O.chunks(512, 64)}, {_PAIR_ROWS}, {O.edges('r', _t)} SELECT a, b, similarity FROM e")
    def _(spark, sf, t=_t):
        return near_pairs(indexed_chunks(spark, sf).select("index", T.normalize_for_dedupe(F.col("text")).alias("norm")), t)


#: A ~ B and B ~ C but not A ~ C: a scan keeps A and C.
CHAIN = ["a b c d e f g h i j k l", "a b c d e f g h i j x y", "q r c d e f g h i j x y"]


@query("dedupe_chain", "SELECT 1::BIGINT AS \"index\", 0::BIGINT AS retained_index, 'near_duplicate' AS kind, 0.667::DOUBLE AS similarity")
def _(spark, sf):
    rows = spark.createDataFrame(list(enumerate(CHAIN)), "index long, text string")
    return dedupe(rows, 0.6).removed.select("index", "retained_index", "kind", "similarity")


# Scores

_VIEW = f"v AS ({O.STRUCTURED})"
_SCORED = f"WITH {_VIEW}, {O.scores('v')} "


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return score(structured(spark, sf), scorers=[])


def _part(name: str, select: str, column: Callable[[Column], Column]) -> None:
    @query(name, f"{_SCORED} SELECT doc_id, variant, {select} FROM scored")
    def _(spark, sf):
        return structured(spark, sf).select("doc_id", "variant", column(F.col("text")))


_part("score_length", "length AS length_score", lambda t: S.length_score(T.word_count(t)).alias("length_score"))
_part("score_density", "density AS density_score", lambda t: S.density_score(t).alias("density_score"))
_part("score_structure", "structure AS structure_score", lambda t: S.structure_score(t).alias("structure_score"))
_part("score_boilerplate", "plate AS boilerplate", lambda t: S.is_boilerplate(t).alias("boilerplate"))
_part("score_tokens", "tokens::BIGINT AS tokens", lambda t: T.word_count(t).alias("tokens"))


@query("score_warnings", _SCORED + "SELECT doc_id, variant, warnings FROM scored")
def _(spark, sf):
    return _scored(spark, sf).select("doc_id", "variant", "warnings")


@query("score_full", _SCORED + "SELECT doc_id, variant, tokens::BIGINT AS tokens, score, array_to_string(warnings, ',') AS warnings FROM scored")
def _(spark, sf):
    return _scored(spark, sf).select("doc_id", "variant", "tokens", "score", F.array_join("warnings", ",").alias("warnings"))


@query("score_with_duplicates", f"WITH {O.chunks(512, 64)}, {O.scores('c')} SELECT id AS doc_id, chunk_index, score, twice AS duplicated FROM scored")
def _(spark, sf):
    scored = score(checkpointed(chunk_table(spark, sf)), scorers=[])  # read twice, cut once
    return scored.select("doc_id", "chunk_index", "score", F.array_contains("warnings", "duplicate_likelihood").alias("duplicated"))


def vowel_share(text: str) -> float:
    return sum(c in "aeiou" for c in text) / len(text)


#: 0.7 of the base score, 0.2 of the share of vowels, and 0.5 of a scorer that fails.
@query("custom_scorer_blend", _SCORED + "SELECT doc_id, variant, round((greatest(0e0, 1e0 - (0.2e0 + 0.1e0)) * score + 0.2e0 * (length(regexp_replace(text, '[^aeiou]', '', 'g')) / length(text)) + 0.1e0 * 0.5e0) * 1000e0) / 1000e0 AS score FROM scored")
def _(spark, sf):
    return score(structured(spark, sf), scorers=[("vowels", 0.2, vowel_share), ("broken", 0.1, lambda text: 1 / 0)]).select("doc_id", "variant", "score")


@query("warning_histogram", _SCORED + "SELECT warning, count(*) AS chunks FROM (SELECT unnest(warnings) AS warning FROM scored) GROUP BY 1")
def _(spark, sf):
    return A.warning_histogram(_scored(spark, sf))


# Pipelines


def _run(spark: SparkSession, sf: str):
    return Pipeline().run_documents(documents(docs(spark, sf), "text", "doc_id"))


_PIPE = f"WITH RECURSIVE {O.chunks(512, 64)}, {O.deduped(0.9)}, kc AS (SELECT c.* FROM c JOIN kept ON kept.idx = c.\"index\"), {O.scores('kc')} "
_STATS = "(SELECT count(*) FROM src) AS total_documents, count(*) AS total_chunks, coalesce(avg(tokens), 0e0)::DOUBLE AS average_chunk_size, (SELECT count(*) FROM gone)::DOUBLE / (SELECT count(*) FROM c) AS duplicate_ratio, count(*) FILTER (score < 0.5e0) AS low_quality_chunk_count"


@query("pipeline_stats_documents", f"{_PIPE} SELECT {_STATS} FROM scored")
def _(spark, sf):
    return _run(spark, sf).stats_table


@query("pipeline_chunks", f"{_PIPE} SELECT id::VARCHAR AS source_document, chunk_index, text, tokens::BIGINT AS tokens, score, array_to_string(warnings, ',') AS warnings FROM scored")
def _(spark, sf):
    return _run(spark, sf).chunk_table.select("source_document", "chunk_index", "text", "tokens", "score", F.array_join("warnings", ",").alias("warnings"))


@query("low_quality_chunks", f"{_PIPE} SELECT id::VARCHAR AS source_document, chunk_index, score FROM scored WHERE score < 0.5e0")
def _(spark, sf):
    return _run(spark, sf).chunk_table.where(F.col("score") < S.LOW_QUALITY).select("source_document", "chunk_index", "score")


@query("pipeline_by_source", f"{_PIPE} SELECT d.source, count(*) AS total_chunks, avg(tokens)::DOUBLE AS average_chunk_size, count(*) FILTER (score < 0.5e0) AS low_quality_chunk_count FROM scored JOIN documents d ON d.doc_id = scored.id GROUP BY 1")
def _(spark, sf):
    chunks = _run(spark, sf).chunk_table
    named = chunks.join(docs(spark, sf).select(F.col("doc_id").cast("string").alias("source_document"), "source"), "source_document")
    return A.chunk_stats(named, "source")


_PAGES = f"WITH RECURSIVE {O.chunks(512, 64, 'SELECT page_id AS id, html FROM pages', O.CLEAN_PAGE)}, {O.deduped(0.9)}, kc AS (SELECT c.* FROM c JOIN kept ON kept.idx = c.\"index\"), {O.scores('kc')} "


@query("pipeline_stats_pages", f"{_PAGES} SELECT {_STATS} FROM scored")
def _(spark, sf):
    return Pipeline().run_documents(documents(parquet(spark, sf, "pages"), "html", "page_id")).stats_table


@query("recommendations", f"{_PIPE}, st AS (SELECT {_STATS}, bool_or(list_contains(warnings, 'boilerplate')) AS bp, bool_or(list_contains(warnings, 'too_long')) AS tl FROM scored) SELECT concat_ws(',', CASE WHEN duplicate_ratio > 0.1e0 THEN 'duplicates' END, CASE WHEN low_quality_chunk_count > 0 THEN 'low_quality' END, CASE WHEN average_chunk_size < 80 AND total_chunks > 0 THEN 'small_chunks' END, CASE WHEN bp THEN 'boilerplate' END, CASE WHEN tl THEN 'long_chunks' END) AS recommendations FROM st")
def _(spark, sf):
    r = _run(spark, sf)
    return A.recommendations(r.stats_table, A.warning_flags(r.chunk_table)).select(F.array_join("recommendations", ",").alias("recommendations"))


@query(
    "report_rows",
    f"""WITH RECURSIVE {O.chunks(512, 64)}, {O.scores('c')},
o AS (SELECT c.id, 0::BIGINT AS chunk_index, instr(flat, c.text) - 1 AS s, length(c.text) AS n FROM c JOIN doc USING (id) WHERE c.chunk_index = 0
  UNION ALL SELECT c.id, c.chunk_index, o.s + instr(substr(doc.flat, o.s + 2), c.text), length(c.text)
  FROM o JOIN c ON c.id = o.id AND c.chunk_index = o.chunk_index + 1 JOIN doc ON doc.id = c.id)
SELECT id::VARCHAR AS source_document, chunk_index, 'Score: ' || score || '  Tokens: ' || tokens || '  Warnings: '
  || CASE WHEN len(warnings) > 0 THEN array_to_string(warnings, ', ') ELSE 'none' END || '  Source: ' || id || '  Index: ' || chunk_index || '  Offsets: ' || o.s || '..' || (o.s + o.n) AS summary
FROM scored JOIN o USING (id, chunk_index)""",
)
def _(spark, sf):
    rows = Pipeline(dedupe=False).run_documents(documents(docs(spark, sf), "text", "doc_id")).chunk_table
    return A.chunk_summary(rows).select("source_document", "chunk_index", "summary")


# Streams

BATCH = 50
_SEEN = f"""WITH RECURSIVE {O.chunks(512, 64)},
h AS (SELECT c.*, id // {BATCH} AS scope, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS seen FROM c),
fresh AS (SELECT * FROM (SELECT *, min(scope) OVER (PARTITION BY seen) AS first_ FROM h) WHERE scope = first_)"""


def _stream_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    return documents(d, "text", "doc_id").withColumn("batch_id", F.floor(F.col("doc_order") / BATCH))


@query("stream_cross_batch", f"{_SEEN} SELECT scope AS batch_id, id AS doc_order, chunk_index, text FROM fresh")
def _(spark, sf):
    from ..operators.dedupe import first_batch

    chunks = Pipeline().chunks_of(_stream_docs(spark, sf), "batch_id")
    return first_batch(chunks, "batch_id", T.normalized_hash(F.col("text"))).select("batch_id", "doc_order", "chunk_index", "text")


@query(
    "stream_batch_stats",
    f"""{_SEEN}, {O.deduped(0.9, scoped=True).replace('FROM c)', 'FROM fresh)', 1)},
kc AS (SELECT fresh.* FROM fresh JOIN kept ON kept.idx = fresh."index"), {O.scores('kc', 'scope')},
g AS (SELECT scope, count(*) AS gone FROM gone GROUP BY 1), t AS (SELECT scope, count(*) AS all_ FROM fresh GROUP BY 1),
d AS (SELECT id // {BATCH} AS scope, count(*) AS total_documents FROM src GROUP BY 1)
SELECT scored.scope AS batch_id, any_value(total_documents) AS total_documents, count(*) AS total_chunks, avg(tokens)::DOUBLE AS average_chunk_size,
  coalesce(any_value(g.gone), 0)::DOUBLE / any_value(t.all_) AS duplicate_ratio, count(*) FILTER (score < 0.5e0) AS low_quality_chunk_count
FROM scored JOIN d ON d.scope = scored.scope JOIN t ON t.scope = scored.scope LEFT JOIN g ON g.scope = scored.scope GROUP BY 1""",
)
def _(spark, sf):
    return batched(Pipeline(), _stream_docs(spark, sf))[1]
