"""Queries for the operators of harmonisation, retrieval, segmentation and versioning, each over its whole tables, with the
SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions.text import expand_tokens
from tidewell.functions.dates import any_date, iso_date
from tidewell.operators import catalog, dense, evaluate, fusion, harmonize, lexical, segment
from tidewell.operators.index import LexicalIndex, index_of
from tidewell.operators.search import expand_query, hybrid_search, statute_search
from tidewell.operators.units import harmonize_units
from tidewell.plans.problems import FACTOR_SQL, UNITS_SQL
from tidewell.session import table
from tidewell.sources.html import page_blocks, page_links
from tidewell.sources.links import LinkPattern, match_links
from tidewell.sources.statute_xml import TOPIC_HINTS, hints_of, parse_statutes

QUERIES = {}
SQL: dict[str, str] = {}

BM25_QUERY = ["policy", "rate", "inflation", "rate", "cuts"]
TFIDF_QUERY = "policy rate inflation target"
ANCHORS = ("Rate Statement", "Minutes")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# DuckDB spellings of shared expressions
_DATE = """CASE WHEN regexp_matches(trim({c}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?$') THEN try_strptime(substr(trim({c}), 1, 10), '%Y-%m-%d')::DATE
    WHEN regexp_matches(trim({c}), '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN try_strptime(trim({c}), '%m/%d/%Y')::DATE END"""
_WORDS = "list_filter(string_split_regex(lower(text), '[\\s\\x{a0}]+'), lambda t: t <> '')"
_TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


def _feed_a(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "canonical").where(F.col("data_source").startswith("FED"))
    return c.select("key_plot_id", F.col("collection_date").alias("date"), F.col("concentration_value").cast("string").alias("pcr_conc_lin"), F.col("normalization_method").alias("normalization"))


def _feed_b(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "canonical").where(~F.coalesce(F.col("data_source").startswith("FED"), F.lit(False)))
    return c.select(
        "site_id", F.col("jurisdiction").alias("reporting_jurisdiction"), F.col("collection_date").alias("sample_collect_date"), F.col("target_name").alias("pcr_target"),
        F.col("concentration_value").cast("string").alias("pcr_target_avg_conc"), F.col("concentration_unit").alias("pcr_target_units"), F.col("normalization_method").alias("other_norm_name"), "data_source",
    )


def _combined(spark: SparkSession, sf: str) -> DataFrame:
    a = harmonize.apply_mapping(harmonize.enrich(_feed_a(spark, sf), table(spark, sf, "feed_a_meta")), harmonize.feed_a_mapping())
    b = harmonize.apply_mapping(_feed_b(spark, sf), harmonize.feed_b_mapping())
    return harmonize.combine(a, b)


_COMBINED = f"""WITH a AS (SELECT m.wwtp_id AS site_id, m.reporting_jurisdiction AS jurisdiction, strftime({_DATE.format(c='c.collection_date')}, '%Y-%m-%d') AS collection_date,
    'sars-cov-2' AS target_name, c.concentration_value, CASE WHEN c.normalization_method = 'flow-population' THEN 'copies/l' ELSE 'ratio (microbial-normalized)' END AS concentration_unit,
    c.normalization_method, 'FEED_A' AS data_source FROM canonical c LEFT JOIN (SELECT DISTINCT * FROM feed_a_meta) m ON c.key_plot_id = m.key_plot_id WHERE starts_with(c.data_source, 'FED')),
    b AS (SELECT site_id, jurisdiction, strftime({_DATE.format(c='collection_date')}, '%Y-%m-%d') AS collection_date, lower(trim(target_name)) AS target_name, concentration_value,
    lower(trim(concentration_unit)) AS concentration_unit, normalization_method, 'FEED_B' AS data_source FROM canonical WHERE NOT coalesce(starts_with(data_source, 'FED'), false)),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b) """


@query(_COMBINED + "SELECT * FROM u")
def harmonize_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Two feeds, mapped, enriched, and put together."""
    return _combined(spark, sf)


@query(_COMBINED + """SELECT count(*) AS n_rows, count(DISTINCT site_id) AS n_sites, count(DISTINCT data_source) AS n_sources, count(*) FILTER (concentration_value IS NULL) AS n_missing_values,
    count(*) FILTER (collection_date IS NULL) AS n_missing_dates FROM u""")
def feed_profile(spark: SparkSession, sf: str) -> DataFrame:
    return harmonize.profile(_combined(spark, sf))


@query("SELECT row_id, site_id FROM canonical WHERE site_id IS DISTINCT FROM 'W00000417'")
def exclude_source_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    return harmonize.exclude_source(table(spark, sf, "canonical"), "site_id", "W00000417").select("row_id", "site_id")


@query("SELECT row_id FROM canonical WHERE lower(trim(target_name)) = 'rsv'")
def target_filter(spark: SparkSession, sf: str) -> DataFrame:
    return harmonize.only_target(table(spark, sf, "canonical"), "target_name", "RSV").select("row_id")


@query("SELECT concentration_unit AS value, count(*) AS n FROM canonical WHERE concentration_unit IS NOT NULL GROUP BY 1")
def unit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return harmonize.value_counts(table(spark, sf, "canonical"), "concentration_unit")


@query("SELECT normalization_method AS value, count(*) AS n FROM canonical GROUP BY 1")
def method_counts_with_null(spark: SparkSession, sf: str) -> DataFrame:
    return harmonize.value_counts(table(spark, sf, "canonical"), "normalization_method", with_null=True)


@query("SELECT source AS a, lang AS b, count(*) AS n, CASE WHEN grouping(source) = 1 THEN 3 ELSE 0 END AS gid FROM documents GROUP BY GROUPING SETS ((source, lang), ())")
def doc_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return harmonize.two_key_inventory(table(spark, sf, "documents"), "source", "lang").select(F.col("source").alias("a"), F.col("lang").alias("b"), "n", F.col("gid").cast("int").alias("gid"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IS NOT NULL")
def json_scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type is not null").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT DISTINCT * FROM feed_a_meta WHERE key_plot_id IN (SELECT key_plot_id FROM canonical)")
def semi_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return harmonize.lookup_metadata(table(spark, sf, "canonical"), table(spark, sf, "feed_a_meta"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def new_ids_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have no vector yet."""
    return catalog.new_rows(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query(f"SELECT row_id, strftime({_DATE.format(c='collection_date')}, '%Y-%m-%d') AS day FROM canonical")
def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "canonical").select("row_id", iso_date("collection_date").alias("day"))


@query(UNITS_SQL + f""", v AS (SELECT lower(trim(target_name)) AS target, {_DATE.format(c='collection_date')} AS d, CASE WHEN regexp_matches(t, 'log') THEN pow(10.0, concentration_value) ELSE concentration_value END * {FACTOR_SQL} AS v
    FROM canonical JOIN t USING (row_id) WHERE t IS NOT NULL AND NOT regexp_matches(t, 'ratio|of pmmov|per copy|pmmov copies|dry|dw'))
    SELECT target, strftime(date_trunc('month', d), '%Y-%m-%d') AS month, CAST(format('{{:.8e}}', median(v)) AS DOUBLE) AS median_value, count(*) AS n FROM v GROUP BY ALL""")
def monthly_median(spark: SparkSession, sf: str) -> DataFrame:
    """Medians in copies per litre of all readings that state a unit of that quantity, in whatever spelling and scale."""
    rows = harmonize_units(table(spark, sf, "canonical")).where("common_unit = 'copies/l' and common_value is not null")
    out = harmonize.monthly_median(rows, any_date("collection_date"), F.col("common_value"), F.lower(F.trim("target_name")).alias("target"))
    return out.withColumn("median_value", F.format_string("%.8e", "median_value").cast("double"))


@query("SELECT o_orderkey, round(100.0 * o_totalprice / max(o_totalprice) OVER (PARTITION BY o_orderpriority), 6) AS pct_of_peak FROM orders")
def pct_of_peak(spark: SparkSession, sf: str) -> DataFrame:
    return harmonize.percent_of_peak(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").select("o_orderkey", F.round("pct_of_peak", 6).alias("pct_of_peak"))


def _bm25_sql(tail: str) -> str:
    many = {t: BM25_QUERY.count(t) for t in BM25_QUERY}
    q = ", ".join(f"('{t}', {n})" for t, n in many.items())
    return f"""WITH tok AS (SELECT doc_id, source, {_WORDS} AS ts FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, source, len(ts) AS dl, ts FROM tok),
    c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d), df AS (SELECT t, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(ts)) AS t FROM d) GROUP BY t),
    w AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, c), m AS (SELECT avg(idf) AS mi FROM w), q(t, qn) AS (VALUES {q}),
    k AS (SELECT q.t, qn, CASE WHEN idf < 0 THEN 0.25 * mi ELSE idf END AS idf FROM q JOIN w USING (t), m),
    p AS (SELECT doc_id, source, dl, t, count(*) AS tf FROM (SELECT doc_id, source, dl, unnest(ts) AS t FROM d) GROUP BY ALL),
    s AS (SELECT doc_id, source, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN k USING (t), c GROUP BY 1, 2) {tail}"""


def _index(spark: SparkSession, sf: str, kind: str) -> LexicalIndex:
    """The kept index of documents: fitted by whichever query comes first, loaded by all others."""
    return index_of(spark, f"{sf}/documents.parquet", kind, "doc_id", "text")


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf, "bm25").bm25(BM25_QUERY).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""WITH tok AS (SELECT doc_id, {_WORDS} AS ts FROM documents WHERE text IS NOT NULL), c AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
    df AS (SELECT t, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(ts)) AS t FROM tok) GROUP BY t), w AS (SELECT ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, c)
    SELECT 'bm25' AS kind, any_value(n) AS n_docs, count(*) AS n_terms, round(any_value(avgdl), 6) AS mean_length, round(avg(idf), 6) AS mean_idf FROM w, c""")
def lexical_index(spark: SparkSession, sf: str) -> DataFrame:
    """What the kept index knows of its corpus."""
    return _index(spark, sf, "bm25").table("corpus").select(F.lit("bm25").alias("kind"), "n_docs", "n_terms", F.round("avgdl", 6).alias("mean_length"), F.round("mean_idf", 6).alias("mean_idf"))


@query(_bm25_sql("SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 30"))
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf).orderBy(F.desc("score"), "doc_id").limit(30)


@query(_bm25_sql("SELECT doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM s WHERE score > 0) WHERE rn <= 2 ORDER BY score DESC, doc_id LIMIT 30"))
def bm25_doc_cap(spark: SparkSession, sf: str) -> DataFrame:
    scored = _bm25(spark, sf).where("score > 0").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return lexical.capped_top(scored, F.col("source"), [F.desc("score"), F.col("doc_id")], 2, 30).select("doc_id", "source", "score")


_GRAMS = f"""tok AS (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, unnest(list_concat(ts, CASE WHEN len(ts) > 1 THEN list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]) ELSE [] END)) AS t FROM tok),
    p AS (SELECT doc_id, t, count(*) AS tf FROM g GROUP BY ALL)"""


@query(f"""WITH {_GRAMS}, n AS (SELECT count(*) AS n FROM tok), v AS (SELECT t, count(*) AS df FROM p GROUP BY t HAVING count(*) >= 2),
    i AS (SELECT t, ln((1 + n) / (1 + df)) + 1 AS idf FROM v, n), w AS (SELECT doc_id, t, (1 + ln(tf)) * idf AS w FROM p JOIN i USING (t)),
    norm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), q0 AS (SELECT {_TERMS} AS ts FROM (SELECT '{TFIDF_QUERY}' AS text)),
    qg AS (SELECT unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS t FROM q0), q AS (SELECT t, (1 + ln(count(*))) * any_value(idf) AS wq FROM qg JOIN i USING (t) GROUP BY t),
    qn AS (SELECT sqrt(sum(wq * wq)) AS qn FROM q)
    SELECT doc_id, round(sum(w * wq) / any_value(norm * qn), 6) AS score FROM w JOIN q USING (t) JOIN norm USING (doc_id), qn GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 30""")
def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    s = _index(spark, sf, "tfidf").tfidf(TFIDF_QUERY).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
    return s.orderBy(F.desc("score"), "doc_id").limit(30)


@query(f"WITH {_GRAMS} SELECT t AS term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM p GROUP BY t HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 100000")
def tfidf_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    v = _index(spark, sf, "tfidf").table("terms")
    return v.orderBy(F.desc("total"), "term").limit(100_000).select("term", "df", "total")


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector with the smallest id (one row)."""
    return list(table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0])


_COSINE = """WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) /
    (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]))), 6) AS score FROM embeddings, q) """


def _dense(spark: SparkSession, sf: str, predicate=None) -> DataFrame:
    return dense.similar(table(spark, sf, "embeddings"), _query_vector(spark, sf), predicate=predicate).withColumn("score", F.round("score", 6))


@query(_COSINE + "SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 50")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.top(_dense(spark, sf), 50)


@query(_COSINE + "SELECT vec_id, score FROM s WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 20")
def dense_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The filter goes below the top-k."""
    return dense.top(_dense(spark, sf, F.col("label") == 3), 20).select("vec_id", "score")


@query(_COSINE + "SELECT vec_id, score FROM (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 50) WHERE label <> 3")
def dense_post_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The filter stays above the top-k."""
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    return dense.top(_dense(spark, sf), 50).join(labels, "vec_id").where("label <> 3").select("vec_id", "score")


_RANKS = _COSINE + """, d AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM s QUALIFY r <= 50),
    p AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id DESC) AS r FROM embeddings QUALIFY r <= 30),
    f AS (SELECT coalesce(d.vec_id, p.vec_id) AS vec_id, d.r AS dense_rank, p.r AS sparse_rank, coalesce(1.0 / (d.r + 60), 0) + coalesce(1.0 / (p.r + 60), 0) AS score FROM d FULL JOIN p ON d.vec_id = p.vec_id) """


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    order = [F.col("label"), F.desc("vec_id")]
    second = dense.ranked(e.orderBy(*order).limit(30), "vec_id", order)
    return fusion.fuse(dense.top(_dense(spark, sf), 50), second, "vec_id")


@query(_RANKS + "SELECT vec_id, coalesce(dense_rank, 0) AS dense_rank, coalesce(sparse_rank, 0) AS sparse_rank, round(score, 9) AS score FROM f")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("dense_rank", "sparse_rank")]
    return _fused(spark, sf).select("vec_id", *ranks, F.round("score", 9).alias("score"))


@query(_RANKS + """, b AS (SELECT f.vec_id, label, round(CASE WHEN label IN (1, 2) THEN score * 2 ELSE score END, 9) AS score FROM f JOIN embeddings USING (vec_id))
    SELECT vec_id, label, score FROM b QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1 ORDER BY score DESC, vec_id LIMIT 12""")
def boost_dedup(spark: SparkSession, sf: str) -> DataFrame:
    fused = _fused(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    boosted = fusion.boost(fused, F.col("label"), [1, 2]).withColumn("score", F.round("score", 9))
    return fusion.best_per_document(boosted, "label", "vec_id", 12).select("vec_id", "label", "score")


@query("""WITH d AS (SELECT DISTINCT o_orderpriority, o_orderdate FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) - 1 AS i,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM d) SELECT o_orderpriority, o_orderdate FROM r
    WHERE n <= 5 OR i IN (n // 2 - 2, n // 2 - 1, n // 2, CAST(round_even(0.6 * (n - 1), 0) AS BIGINT), n - 1)""")
def temporal_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.checkpoints(table(spark, sf, "orders"), "o_orderdate", "o_orderpriority")


def _bm25_on(rows: str, key: str, query: list[str]) -> str:
    """CTEs that end in s(key, score), over rows(key, text)."""
    many = {t: query.count(t) for t in query}
    q = ", ".join(f"('{t}', {n})" for t, n in many.items())
    return f"""tok AS (SELECT {key}, {_WORDS} AS ts FROM {rows} WHERE text IS NOT NULL), d AS (SELECT {key}, len(ts) AS dl, ts FROM tok), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
    df AS (SELECT t, count(*) AS df FROM (SELECT {key}, unnest(list_distinct(ts)) AS t FROM d) GROUP BY t), w AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, c), m AS (SELECT avg(idf) AS mi FROM w), q(t, qn) AS (VALUES {q}),
    k AS (SELECT q.t, qn, CASE WHEN idf < 0 THEN 0.25 * mi ELSE idf END AS idf FROM q JOIN w USING (t), m), p AS (SELECT {key}, dl, t, count(*) AS tf FROM (SELECT {key}, dl, unnest(ts) AS t FROM d) GROUP BY ALL),
    s AS (SELECT {key}, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM p JOIN k USING (t), c GROUP BY 1)"""


def _anchor_step(n: int, kind: str, rows: str = "ch", score: str = "0.0") -> str:
    """CTEs st{n}, of the ranking after a kind's anchors, and u{n}, of the slots used by then."""
    b, a = n - 1, n
    return f"""pool{a} AS (SELECT * FROM {rows} WHERE doc_type = '{kind}' AND date IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM st{b} WHERE doc_id IS NOT NULL)),
    f{a} AS (SELECT * FROM pool{a} QUALIFY row_number() OVER (PARTITION BY date ORDER BY pos, chunk_id) = 1), r{a} AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM f{a}),
    c{a} AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS turn FROM r{a} WHERE n <= 5 OR i IN (n // 2 - 2, n // 2 - 1, n // 2, CAST(round_even(0.6 * (n - 1), 0) AS BIGINT), n - 1)),
    o{a} AS (SELECT max(date) AS organic FROM st{b} WHERE doc_type = '{kind}'), z{a} AS (SELECT count(*) AS size FROM st0),
    pl{a} AS (SELECT size - used - turn AS slot, chunk_id, doc_id, doc_type, date, {score} AS score, used + turn AS now FROM c{a}, o{a}, z{a}, u{b} WHERE (organic IS NULL OR (SELECT max(date) FROM c{a}) > organic) AND size - used - turn >= 0),
    st{a} AS (SELECT * FROM st{b} WHERE slot NOT IN (SELECT slot FROM pl{a}) UNION ALL SELECT slot, chunk_id, doc_id, doc_type, date, score FROM pl{a}), u{a} AS (SELECT coalesce(max(now), any_value(used)) AS used FROM u{b} LEFT JOIN pl{a} ON true)"""


_CHUNKS = "ch AS (SELECT DISTINCT chunk_id, doc_id, doc_type, institution, date, text, doc_id || ' ' || printf('%09d', chunk_idx) AS pos FROM chunk)"


@query(f"""WITH {_CHUNKS}, {_bm25_on('ch', 'chunk_id', BM25_QUERY)}, b0 AS (SELECT ch.*, score FROM s JOIN ch USING (chunk_id) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) = 1),
    st0 AS (SELECT row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS slot, chunk_id, doc_id, doc_type, date, score FROM b0 ORDER BY score DESC, chunk_id LIMIT 12), u0 AS (SELECT 0 AS used),
    {", ".join(_anchor_step(n + 1, k) for n, k in enumerate(ANCHORS))} SELECT CAST(slot AS INTEGER) AS slot, chunk_id, doc_id, doc_type, date, round(score, 6) AS score FROM st{len(ANCHORS)}""")
def anchor_injection(spark: SparkSession, sf: str) -> DataFrame:
    """The best twelve chunks by BM25, one a document, with anchors of two kinds put into the last slots."""
    chunks, scored = _scored_chunks(spark, sf, BM25_QUERY)
    meta = chunks.select("chunk_id", "doc_id", "doc_type", "date", "pos")
    best = fusion.best_per_document(scored.where("score > 0").join(meta, "chunk_id"), "doc_id", "chunk_id", 12)
    ranked = best.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")) - 1)
    out = fusion.inject_anchors(ranked, meta, ANCHORS)
    return out.select("slot", "chunk_id", "doc_id", "doc_type", "date", F.round("score", 6).alias("score"))


def _chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks, without repeats, with their place in reading order."""
    return table(spark, sf, "chunk").dropDuplicates(["chunk_id"]).withColumn("pos", F.concat_ws(" ", "doc_id", F.format_string("%09d", "chunk_idx")))


def _chunk_index(spark: SparkSession, sf: str) -> LexicalIndex:
    return index_of(spark, f"{sf}/chunk.parquet", "bm25", "chunk_id", "text", docs=_chunk_rows(spark, sf))


def _scored_chunks(spark: SparkSession, sf: str, query: list[str]) -> tuple[DataFrame, DataFrame]:
    scores = _chunk_index(spark, sf).bm25(query).select(F.col("key").alias("chunk_id"), F.round("score", 9).alias("score"))
    return _chunk_rows(spark, sf), scores


@query("""WITH c AS (SELECT o_orderkey, o_totalprice / 1000.0 AS score, (o_custkey % 7) - 3.0 AS logit FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200),
    m AS (SELECT max(score) AS most FROM c) SELECT o_orderkey, round(0.7 * score / most + 0.3 / (1 + exp(-logit)), 6) AS blended FROM c, m ORDER BY blended DESC, o_orderkey LIMIT 20""")
def blend_rerank(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)
    c = c.select("o_orderkey", (F.col("o_totalprice") / 1000.0).alias("score"), (F.col("o_custkey") % 7 - F.lit(3.0)).alias("logit"))
    return fusion.blend(c).orderBy(F.desc("blended"), "o_orderkey").limit(20).select("o_orderkey", "blended")


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, trim(x) AS x, length(trim(x)) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM l WHERE length(trim(x)) >= 20),
    w AS (SELECT doc_id, pos, n AS size, 0 AS k FROM p WHERE pos = 1 UNION ALL SELECT p.doc_id, p.pos, CASE WHEN w.size + p.n > 1600 THEN p.n ELSE w.size + p.n END, w.k + CASE WHEN w.size + p.n > 1600 THEN 1 ELSE 0 END FROM w JOIN p ON p.doc_id = w.doc_id AND p.pos = w.pos + 1),
    t AS (SELECT doc_id, k, string_agg(x, chr(10) || chr(10) ORDER BY pos) AS body, max(pos) AS last FROM w JOIN p USING (doc_id, pos) GROUP BY 1, 2),
    f AS (SELECT t.*, p.x AS nx, regexp_extract(p.x, '(?s)^(.*?[.!?])(?:\\s|$)', 1) AS fs FROM t LEFT JOIN p ON p.doc_id = t.doc_id AND p.pos = t.last + 1)
    SELECT doc_id, k AS chunk_idx, 1 AS page_num, body || CASE WHEN nx IS NULL THEN '' ELSE chr(10) || chr(10) || CASE WHEN fs <> '' AND length(fs) <= 200 THEN fs ELSE substr(nx, 1, 200) END END AS text, printf('%s_%04d', CAST(doc_id AS VARCHAR), k) AS chunk_id FROM f""")
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy packing of every document's paragraphs."""
    return segment.pack_paragraphs(segment.paragraphs(table(spark, sf, "documents"), ["doc_id"]), ["doc_id"], doc="doc_id")


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections with nested subsections, from the latest rows of each act: a chunk without a paragraph is its subsection's intro."""
    rows = table(spark, sf, "statute_chunk").where("text is not null and section is not null").select("version_id", "act", "part", "division", "section", "subsection", "paragraph", "text").distinct()
    sub = rows.groupBy("version_id", "act", "section", F.coalesce("subsection", F.lit("")).alias("label")).agg(
        F.max("part").alias("part"), F.max("division").alias("division"), F.max(F.when(F.coalesce("paragraph", F.lit("")) == "", F.col("text"))).alias("intro"),
        F.array_sort(F.collect_list(F.when(F.coalesce("paragraph", F.lit("")) != "", F.struct(F.col("paragraph").alias("label"), "text")))).alias("paragraphs"),
    )
    return sub.groupBy("version_id", "section").agg(
        F.max("part").alias("part"), F.max("division").alias("division"), F.lit("note").alias("marginal_note"),
        F.array_sort(F.collect_list(F.struct("label", F.coalesce("intro", F.lit("")).alias("intro"), "paragraphs"))).alias("subsections"),
        F.lit("en").alias("language"), F.lit("2024-01-01").alias("valid_from"), F.lit("").alias("amending_act"),
    )


_SUBS = """WITH r AS (SELECT DISTINCT version_id, act, part, division, section, subsection, paragraph, text FROM statute_chunk WHERE text IS NOT NULL AND section IS NOT NULL),
    b AS (SELECT version_id, section, coalesce(subsection, '') AS label, max(part) AS part, max(division) AS division, max(text) FILTER (coalesce(paragraph, '') = '') AS intro,
    coalesce(list({'label': paragraph, 'text': text} ORDER BY paragraph, text) FILTER (coalesce(paragraph, '') <> ''), []) AS ps FROM r GROUP BY version_id, act, section, coalesce(subsection, '')),
    s AS (SELECT *, max(part) OVER w AS p0, max(division) OVER w AS d0, lead(label) OVER o AS nl, lead(intro) OVER o AS ni, lead(ps) OVER o AS np FROM b
        WINDOW w AS (PARTITION BY version_id, section), o AS (PARTITION BY version_id, section ORDER BY label)),
    t AS (SELECT *, 'note [' || concat_ws(', ', 'Part ' || nullif(p0, ''), 'Division ' || nullif(d0, '')) || ']' AS prefix,
        concat_ws(' ', nullif(intro, ''), nullif(array_to_string(list_transform(ps, lambda p: '(' || p.label || ') ' || p.text), ' '), '')) AS full_text FROM s),
    u AS (SELECT *, 'ITA s.' || section || CASE WHEN label <> '' THEN '(' || label || ')' ELSE '' END AS cite, CAST(floor(len(regexp_extract_all(full_text, '\\S+')) * 1.3) AS INTEGER) AS n FROM t WHERE trim(full_text) <> '') """
_WHOLE = "SELECT version_id, cite AS citation, prefix || ' — ' || trim(full_text) AS x FROM u WHERE n <= 400 OR len(ps) = 0"
_STRICT = _WHOLE + " UNION ALL SELECT version_id, cite || '(' || p.label || ')', prefix || ' — ' || trim('(' || p.label || ') ' || p.text) FROM (SELECT *, unnest(ps) AS p FROM u WHERE n > 400)"
_HIER = _WHOLE + """ UNION ALL SELECT version_id, cite || '(' || p.label || ')', prefix || CASE WHEN label <> '' THEN ' — s.' || section || '(' || label || ')' ELSE '' END || ' — ' ||
    trim(CASE WHEN i = 1 AND coalesce(intro, '') <> '' THEN intro || ' ' ELSE '' END || '(' || p.label || ') ' || p.text) FROM (SELECT *, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM u WHERE n > 400)"""
_SLIDING = """SELECT version_id, cite AS citation, prefix || ' — ' || trim(full_text || CASE WHEN len(np) > 0 THEN ' [overlap→' || nl || '] (' || np[1].label || ') ' || np[1].text
    WHEN coalesce(ni, '') <> '' THEN ' [overlap→' || nl || '] ' || substr(ni, 1, 200) ELSE '' END) AS x FROM u"""


def _digest(chunks: DataFrame) -> DataFrame:
    return chunks.select("citation", F.sha2("text", 256).alias("h"))


@query(_SUBS + f"SELECT citation, sha256(x) AS h FROM ({_STRICT})")
def section_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(segment.strict_subsections(_sections(spark, sf)))


@query(_SUBS + f"SELECT citation, sha256(x) AS h FROM ({_HIER})")
def section_hier(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(segment.hierarchical_subsections(_sections(spark, sf)))


@query(_SUBS + f"SELECT citation, sha256(x) AS h FROM ({_SLIDING})")
def section_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(segment.sliding_subsections(_sections(spark, sf)))


@query(_SUBS + f"""SELECT strategy, count(*) AS n_chunks, round(avg(n), 4) AS mean_tokens, max(n) AS most_tokens FROM (SELECT strategy, CAST(floor(len(regexp_extract_all(x, '\\S+')) * 1.3) AS INTEGER) AS n FROM
    (SELECT 'strict_subsection' AS strategy, x FROM ({_STRICT}) UNION ALL SELECT 'hierarchical', x FROM ({_HIER}) UNION ALL SELECT 'sliding_window', x FROM ({_SLIDING}))) GROUP BY 1""")
def strategy_report(spark: SparkSession, sf: str) -> DataFrame:
    return segment.strategy_report(segment.all_strategies(_sections(spark, sf)))


@query("""WITH n AS (SELECT doc_id, chunk_idx AS pos, chunk_id, CASE WHEN page_num % 3 = 1 THEN 1 WHEN page_num % 3 = 2 THEN 2 ELSE 0 END AS level FROM (SELECT DISTINCT doc_id, chunk_idx, chunk_id, page_num FROM chunk)),
    p AS (SELECT *, last_value(CASE WHEN level = 1 THEN chunk_id END IGNORE NULLS) OVER w AS part, count(*) FILTER (level = 1) OVER w AS k FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos, chunk_id ROWS UNBOUNDED PRECEDING))
    SELECT chunk_id, part, last_value(CASE WHEN level = 2 THEN chunk_id END IGNORE NULLS) OVER (PARTITION BY doc_id, k ORDER BY pos, chunk_id ROWS UNBOUNDED PRECEDING) AS division FROM p""")
def heading_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunk").select("doc_id", "chunk_idx", "chunk_id", "page_num").distinct()
    level = F.when(F.col("page_num") % 3 == 1, 1).when(F.col("page_num") % 3 == 2, 2).otherwise(0)
    nodes = rows.select("doc_id", F.struct("chunk_idx", "chunk_id").alias("pos"), "chunk_id", level.alias("level"))
    return segment.running_headings(nodes, label="chunk_id").select("chunk_id", "part", "division")


@query("SELECT doc_id, CASE WHEN s <> '' AND length(s) <= 200 THEN s ELSE substr(x, 1, 200) END AS first FROM (SELECT doc_id, trim(text, ' ') AS x, regexp_extract(trim(text, ' '), '(?s)^(.*?[.!?])(?:\\s|$)', 1) AS s FROM documents)")
def first_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.first_sentence("text").alias("first"))


@query("SELECT DISTINCT version_id, citation, act || ' s.' || section || CASE WHEN coalesce(subsection, '') <> '' THEN '(' || subsection || ')' ELSE '' END || CASE WHEN coalesce(paragraph, '') <> '' THEN '(' || paragraph || ')' ELSE '' END AS built FROM statute_chunk")
def citation_build(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "statute_chunk").select("version_id", "citation", T.citation("act", "section", "subsection", "paragraph").alias("built")).distinct()


@query("SELECT doc_id, 'sha256:' || sha256(text) AS h FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.sha256("text").alias("h"))


@query("""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
    FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(text)) AS h FROM documents WHERE text IS NOT NULL)""")
def uuid5_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.uuid5("text").alias("id"))


@query("SELECT version_id, citation, CAST(floor(len(regexp_extract_all(text, '\\S+')) * 1.3) AS INTEGER) AS n FROM statute_chunk WHERE text IS NOT NULL")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "statute_chunk").where("text is not null").select("version_id", "citation", T.estimated_tokens("text").alias("n"))


@query("""WITH o AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL AND lang = 'en'), n AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL AND domain = 'central_bank')
    SELECT count(*) FILTER (o.h IS NULL) AS added, count(*) FILTER (n.h IS NULL) AS removed, count(*) FILTER (o.h IS NOT NULL AND n.h IS NOT NULL) AS unchanged FROM o FULL JOIN n ON o.h = n.h""")
def version_delta(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("h", F.sha2("text", 256))
    return catalog.delta_sizes(docs.where("lang = 'en'"), docs.where("domain = 'central_bank'"), "h")


@query("""SELECT version_id, act, language, row_number() OVER (PARTITION BY act, language ORDER BY ingested_at DESC NULLS LAST, version_id) = 1 AS is_current, coalesce(chunk_count - chunks_added, -1) AS unchanged FROM ingestion_runs""")
def version_current(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.versions(table(spark, sf, "ingestion_runs")).select("version_id", "act", "language", "is_current", F.coalesce("unchanged", F.lit(-1)).alias("unchanged"))


@query("SELECT act, language, version_id FROM ingestion_runs QUALIFY row_number() OVER (PARTITION BY act, language ORDER BY ingested_at DESC NULLS LAST, version_id DESC) = 1")
def version_latest(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest_versions(table(spark, sf, "ingestion_runs").where("ingested_at is not null")).select("act", "language", "version_id")


@query("SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(text)) AS k FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1")
def upsert_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha1(F.concat(F.unhex(F.lit(T.UUID_NAMESPACE)), F.encode("text", "utf-8"))).alias("k"))
    return catalog.last_by_key(docs, ["k"], [F.col("doc_id")]).select("doc_id", "k")


@query("SELECT DISTINCT * FROM (SELECT doc_id, upper(format) AS format FROM document_record WHERE format = 'pdf' UNION ALL SELECT doc_id, format FROM document_record d WHERE NOT EXISTS (SELECT 1 FROM document_record n WHERE n.format = 'pdf' AND n.doc_id = d.doc_id))")
def catalogue_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "document_record").select("doc_id", "format")
    return catalog.upsert(old, old.where("format = 'pdf'").withColumn("format", F.upper("format")), ["doc_id"]).distinct()


@query("SELECT version_id, citation FROM statute_chunk WHERE NOT (coalesce(act, '') = 'AVT-00000' AND coalesce(language, '') = 'en')")
def partition_purge(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.purge(table(spark, sf, "statute_chunk"), act="AVT-00000", language="en").select("version_id", "citation")


@query("SELECT version_id, citation FROM statute_chunk WHERE valid_from <= '2022-06-01' AND (valid_to IS NULL OR valid_to > '2022-06-01')")
def asof_validity(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.valid_on(table(spark, sf, "statute_chunk"), "2022-06-01").select("version_id", "citation")


@query("SELECT DISTINCT r.doc_id, r.local_path FROM document_record r WHERE r.doc_id NOT IN (SELECT doc_id FROM chunk WHERE doc_id IS NOT NULL AND page_num > 1)")
def missing_files(spark: SparkSession, sf: str) -> DataFrame:
    """Records without a chunk beyond a first page."""
    records = table(spark, sf, "document_record").select("doc_id", "local_path").distinct()
    return catalog.missing_files(records, table(spark, sf, "chunk").where("page_num > 1"), "doc_id").select("doc_id", "local_path")


@query("SELECT topic AS value, count(*) AS n FROM eval_item WHERE topic IS NOT NULL GROUP BY 1")
def topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return harmonize.value_counts(table(spark, sf, "eval_item"), "topic")


_HITS = """WITH c AS (SELECT DISTINCT citation FROM statute_chunk WHERE citation IS NOT NULL), r AS (SELECT i.item_id, c.citation, row_number() OVER (PARTITION BY i.item_id ORDER BY md5(i.item_id || c.citation), c.citation) AS rank
    FROM eval_item i JOIN c ON split_part(c.citation, '(', 1) IN (SELECT split_part(unnest(i.expected_citations), '(', 1)) QUALIFY rank <= 10),
    h AS (SELECT i.item_id, i.topic, coalesce(min(CASE WHEN len(list_filter(i.expected_citations, lambda e: starts_with(lower(r.citation), lower(e)) OR starts_with(lower(e), lower(r.citation)))) > 0 THEN r.rank END), 0) AS rank
    FROM eval_item i LEFT JOIN r USING (item_id) GROUP BY 1, 2)
    SELECT coalesce(topic, 'overall') AS topic, round(avg(CASE WHEN rank BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_k, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0.0 END), 4) AS mrr, count(*) AS n
    FROM h GROUP BY GROUPING SETS ((topic), ())"""


@query(_HITS)
def eval_recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """Results are the citations of an expected section, in an arbitrary but fixed order, the first ten of each item."""
    items = table(spark, sf, "eval_item")
    cited = table(spark, sf, "statute_chunk").select("citation").where("citation is not null").distinct().withColumn("sec", F.split("citation", r"\(")[0])
    wanted = items.select("item_id", F.explode("expected_citations").alias("e")).select("item_id", F.split("e", r"\(")[0].alias("sec")).distinct()
    order = Window.partitionBy("item_id").orderBy(F.md5(F.concat(F.col("item_id").cast("string"), "citation")), "citation")
    results = wanted.join(cited, "sec").withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return evaluate.report(evaluate.first_hits(results, items), items)


@query("""WITH b AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_orderkey % 500 AS page, (l_partkey % 40)::DOUBLE AS x0, (l_suppkey % 30)::DOUBLE AS y0 FROM lineitem), t AS (SELECT p_partkey % 500 AS page, (p_size % 40)::DOUBLE AS x0, (p_partkey % 30)::DOUBLE AS y0 FROM part)
    SELECT id, ln FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND b.x0 < t.x0 + 12 AND t.x0 < b.x0 + 3 AND b.y0 < t.y0 + 9 AND t.y0 < b.y0 + 2)""")
def bbox_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x0"), F.col("y0")
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), (F.col("l_orderkey") % 500).alias("page"), (F.col("l_partkey") % 40).cast("double").alias("x0"), (F.col("l_suppkey") % 30).cast("double").alias("y0")).withColumns({"x1": x + 3, "y1": y + 2})
    t = table(spark, sf, "part").select((F.col("p_partkey") % 500).alias("page"), (F.col("p_size") % 40).cast("double").alias("x0"), (F.col("p_partkey") % 30).cast("double").alias("y0")).withColumns({"x1": x + 12, "y1": y + 9})
    return segment.outside_tables(b, t).select("id", "ln")


@query("""WITH c AS (SELECT DISTINCT chunk_id, institution, doc_type, date, page_num, title, text, doc_id, chunk_idx FROM chunk), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx, chunk_id) AS n FROM c)
    SELECT doc_id, md5(string_agg('[' || n || '] ' || concat_ws(' | ', institution, doc_type, date) || CASE WHEN coalesce(page_num, 0) <> 0 THEN ' | p.' || page_num ELSE '' END || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n)) AS h FROM r GROUP BY doc_id""")
def prompt_format(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunk").select("chunk_id", "institution", "doc_type", "date", "page_num", "title", "text", "doc_id", "chunk_idx").distinct()
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_idx", "chunk_id"))
    block = T.source_block(F.col("n"), F.col("institution"), F.col("doc_type"), F.col("date"), F.col("page_num"), F.col("title"), F.col("text"))
    r = c.withColumn("n", n).select("doc_id", F.struct("n", block.alias("b")).alias("s"))
    return r.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["b"]), "\n\n---\n\n")).alias("h"))


@query("SELECT doc_id, CASE WHEN length(text) > 450 THEN substr(text, 1, 450) || '…' ELSE text END AS shown FROM documents")
def source_preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.preview("text").alias("shown"))


@query("SELECT DISTINCT doc_id, CASE WHEN starts_with(local_path, '/') THEN 'https://files.example' || local_path ELSE 'https://files.example/' || local_path END AS address FROM document_record WHERE local_path IS NOT NULL")
def url_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_record").where("local_path is not null").select("doc_id", T.absolute_url("local_path", "https://files.example").alias("address")).distinct()


@query("SELECT DISTINCT doc_id FROM document_record WHERE date BETWEEN '2024-01-01' AND '2025-12-31'")
def date_range(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_record").where(F.col("date").between("2024-01-01", "2025-12-31")).select("doc_id").distinct()


@query("""SELECT (SELECT count(*) FROM statute_chunk) AS n_points, (SELECT version_id FROM ingestion_runs WHERE ingested_at IS NOT NULL ORDER BY ingested_at DESC, version_id DESC LIMIT 1) AS latest_version, 'ok' AS status""")
def index_health(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "ingestion_runs").where("ingested_at is not null")
    return catalog.health(table(spark, sf, "statute_chunk"), runs).select("n_points", "latest_version", "status")


_SEARCH = "Why did inflation lead to rate cuts"
_SINCE, _UNTIL = "2023-01-01", "2025-12-31"
_VECTOR = """qv AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), vs AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) /
    (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]))) AS cos FROM embeddings, qv)"""


def _vectors(spark: SparkSession, sf: str, chunks: DataFrame, vec_id) -> DataFrame:
    """A vector for each chunk: the tables have none of their own, so that of a number made from the chunk."""
    return chunks.select("chunk_id", vec_id.cast("long").alias("vec_id")).join(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id").select("chunk_id", "embedding")


_DATED = f"date >= '{_SINCE}' AND date <= '{_UNTIL}'"


@query(f"""WITH ch AS (SELECT DISTINCT chunk_id, doc_id, doc_type, date, text, doc_id || ' ' || printf('%09d', chunk_idx) AS pos, (chunk_idx * 37 + page_num * 11) % 100 AS vec_id FROM chunk), {_VECTOR},
    {_bm25_on('ch', 'chunk_id', expand_tokens(_SEARCH.lower().split()))}, dn0 AS (SELECT chunk_id, cos FROM ch JOIN vs USING (vec_id) ORDER BY cos DESC, chunk_id LIMIT 50),
    dn AS (SELECT chunk_id, row_number() OVER (ORDER BY cos DESC, chunk_id) AS r FROM dn0 JOIN ch USING (chunk_id) WHERE {_DATED}),
    sp0 AS (SELECT ch.*, score FROM s JOIN ch USING (chunk_id) WHERE score > 0 AND {_DATED} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, chunk_id) <= 2),
    sp AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, pos, chunk_id) AS r FROM sp0 QUALIFY r <= 30),
    fu AS (SELECT coalesce(dn.chunk_id, sp.chunk_id) AS chunk_id, dn.r AS dense_rank, sp.r AS sparse_rank, coalesce(1.0 / (dn.r + 60), 0) + coalesce(1.0 / (sp.r + 60), 0) AS raw FROM dn FULL JOIN sp ON dn.chunk_id = sp.chunk_id),
    fb AS (SELECT ch.*, dense_rank, sparse_rank, CASE WHEN doc_type IN {ANCHORS} THEN raw * 2 ELSE raw END AS score FROM fu JOIN ch USING (chunk_id)),
    b0 AS (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) = 1),
    st0 AS (SELECT row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS slot, chunk_id, doc_id, doc_type, date, score FROM b0 ORDER BY score DESC, chunk_id LIMIT 12), u0 AS (SELECT 0 AS used),
    ca AS (SELECT ch.chunk_id, ch.doc_id, ch.doc_type, ch.date, ch.pos, coalesce(fb.score, 0.0) AS own FROM ch LEFT JOIN fb USING (chunk_id) WHERE ch.{_DATED.replace("AND date", "AND ch.date")}),
    {", ".join(_anchor_step(n + 1, k, 'ca', 'own') for n, k in enumerate(ANCHORS))}
    SELECT CAST(slot AS INTEGER) AS slot, chunk_id, doc_type, coalesce(dense_rank, 0) AS dense_rank, coalesce(sparse_rank, 0) AS sparse_rank, round(t.score, 9) AS score FROM st{len(ANCHORS)} t LEFT JOIN fu USING (chunk_id)""")
def hybrid_query(spark: SparkSession, sf: str) -> DataFrame:
    """The whole hybrid chain over chunks: dense and lexical rankings, expanded terms, dates, fusion, boost, caps, anchors."""
    chunks = _chunk_rows(spark, sf)
    vectors = _vectors(spark, sf, chunks, (F.col("chunk_idx") * 37 + F.col("page_num") * 11) % 100)
    out = hybrid_search(chunks, vectors, _SEARCH, _query_vector(spark, sf), date_from=_SINCE, date_to=_UNTIL, anchors=ANCHORS, index=_chunk_index(spark, sf))
    ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("dense_rank", "sparse_rank")]
    return out.select("slot", "chunk_id", "doc_type", *ranks, F.round("score", 9).alias("score"))


_ASKED = "Can an allowable capital loss be applied against interest on borrowed money?"


@query(f"""WITH ch AS (SELECT DISTINCT version_id || ' ' || citation AS chunk_id, citation, text, length(text) % 100 AS vec_id FROM statute_chunk WHERE language = 'en' AND citation IS NOT NULL AND text IS NOT NULL), {_VECTOR},
    tok AS (SELECT chunk_id, {_TERMS} AS ts FROM ch), g AS (SELECT chunk_id, unnest(list_concat(ts, CASE WHEN len(ts) > 1 THEN list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]) ELSE [] END)) AS t FROM tok),
    p AS (SELECT chunk_id, t, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM tok), v AS (SELECT t, count(*) AS df FROM p GROUP BY t HAVING count(*) >= 2), i AS (SELECT t, ln((1 + n) / (1 + df)) + 1 AS idf FROM v, n),
    w AS (SELECT chunk_id, t, (1 + ln(tf)) * idf AS w FROM p JOIN i USING (t)), norm AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), q0 AS (SELECT {_TERMS} AS ts FROM (SELECT '{expand_query(_ASKED)}' AS text)),
    qg AS (SELECT unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS t FROM q0), q AS (SELECT t, (1 + ln(count(*))) * any_value(idf) AS wq FROM qg JOIN i USING (t) GROUP BY t), qn AS (SELECT sqrt(sum(wq * wq)) AS qn FROM q),
    s AS (SELECT chunk_id, round(sum(w * wq) / any_value(norm * qn), 9) AS score FROM w JOIN q USING (t) JOIN norm USING (chunk_id), qn GROUP BY chunk_id), sp AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM s QUALIFY r <= 200),
    dn AS (SELECT chunk_id, row_number() OVER (ORDER BY cos DESC, chunk_id) AS r FROM ch JOIN vs USING (vec_id) QUALIFY r <= 200),
    fu AS (SELECT coalesce(dn.chunk_id, sp.chunk_id) AS chunk_id, dn.r AS dense_rank, sp.r AS sparse_rank, coalesce(1.0 / (dn.r + 1), 0) + coalesce(1.0 / (sp.r + 1), 0) AS score FROM dn FULL JOIN sp ON dn.chunk_id = sp.chunk_id)
    SELECT chunk_id, citation, coalesce(dense_rank, 0) AS dense_rank, coalesce(sparse_rank, 0) AS sparse_rank, round_even(score, 6) AS score FROM (SELECT * FROM fu ORDER BY score DESC, chunk_id LIMIT 200) JOIN ch USING (chunk_id) ORDER BY round_even(score, 6) DESC, chunk_id LIMIT 10""")
def statute_query(spark: SparkSession, sf: str) -> DataFrame:
    """The whole statute chain over chunks of one language: the expanded query, TF-IDF and dense rankings, fused from rank zero."""
    rows = table(spark, sf, "statute_chunk").where("citation is not null and text is not null")
    chunks = rows.withColumn("chunk_id", F.concat_ws(" ", "version_id", "citation")).select("chunk_id", "citation", "text", "language").distinct()
    index = index_of(spark, f"{sf}/statute_chunk.parquet", "tfidf", "chunk_id", "text", language="language", docs=chunks)
    vectors = _vectors(spark, sf, chunks.where("language = 'en'"), F.length("text") % 100)
    out = statute_search(chunks, vectors, _ASKED, _query_vector(spark, sf), top_k=10, index=index)
    ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("dense_rank", "sparse_rank")]
    return out.select("chunk_id", "citation", *ranks, "score")


_HINT = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{told}' END" for p, told in TOPIC_HINTS)


@query(f"SELECT version_id, citation, concat_ws(' | ', {_HINT}) AS hints FROM (SELECT DISTINCT version_id, citation, text FROM statute_chunk WHERE text IS NOT NULL) WHERE concat_ws(' | ', {_HINT}) <> ''")
def topic_hints(spark: SparkSession, sf: str) -> DataFrame:
    """The hints of all rules, of the texts that have any."""
    rows = table(spark, sf, "statute_chunk").where("text is not null").select("version_id", "citation", "text").distinct()
    return rows.select("version_id", "citation", hints_of("text").alias("hints")).where("hints <> ''")


_ESC = "replace(replace({0}, '&', '&amp;'), '<', '&lt;')"


def _escaped(c: str):
    return F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page made of each document record: what a site would show of it."""
    r = table(spark, sf, "document_record").where("title is not null and doc_id is not null").select("doc_id", "title", "institution", F.regexp_replace("date", "-", "").alias("day")).distinct()
    html = F.concat(
        F.lit("<html><body><nav><p>a menu that is long enough to be text</p></nav><main><h1>"), _escaped("title"), F.lit("</h1>\n<table><tr><td>"), F.coalesce(_escaped("institution"), F.lit("")), F.lit("</td><td>the body that issued it</td></tr></table><p>Published as &quot;"),
        _escaped("title"), F.lit("&quot; in full</p><p>short</p><a href=\"/files/paper-"), F.coalesce("day", F.lit("x")), F.lit(".pdf\"> PDF </a><a href=\"/about\">About</a></main></body></html>"),
    )
    return r.select("doc_id", html.alias("html"))


_RECORDS = "WITH r AS (SELECT DISTINCT doc_id, title, institution, replace(date, '-', '') AS day FROM document_record WHERE title IS NOT NULL AND doc_id IS NOT NULL), "
_SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(_RECORDS + f"""b AS (SELECT doc_id, 0 AS n, 'table' AS kind, {_SQUEEZED.format("coalesce(institution, '')")} || ' | the body that issued it' AS text FROM r UNION ALL SELECT doc_id, 1, 'text', {_SQUEEZED.format("title")} FROM r
    UNION ALL SELECT doc_id, 2, 'text', 'Published as "' || {_SQUEEZED.format("title || chr(34) || ' in full'")} FROM r), k AS (SELECT * FROM b WHERE length(text) >= 20)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id, t ORDER BY n) - 1 AS INTEGER) AS pos, kind, text FROM (SELECT k.*, max(text) FILTER (n = 2) OVER (PARTITION BY doc_id) AS t FROM k)""")
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of the pages of document records: tables first, then headings and paragraphs; menus and short texts are left out."""
    return page_blocks(_pages(spark, sf), "doc_id")


@query(_RECORDS + """l AS (SELECT doc_id, 'https://site.example/files/paper-' || day || '.pdf' AS url, try_strptime(day, '%Y%m%d')::DATE AS d FROM r WHERE regexp_matches(coalesce(day, 'x'), '^\\d{8}$'))
    SELECT 'P' || strftime(d, '%Y%m%d') AS doc_id, 'paper' AS doc_type, strftime(d, '%Y-%m-%d') AS date, url FROM l WHERE d BETWEEN DATE '2020-01-01' AND DATE '2026-12-31' GROUP BY ALL""")
def link_records(spark: SparkSession, sf: str) -> DataFrame:
    """Typed records from the links of these pages, by a pattern, one for each address."""
    links = page_links(_pages(spark, sf), "doc_id").withColumnRenamed("doc_id", "page")
    pattern = LinkPattern(r"/paper-(\d{8})\.pdf$", "paper", "P", "MMMM d, yyyy")
    return match_links(links, [pattern], "https://site.example", "2020-01-01", "2026-12-31").select("doc_id", "doc_type", "date", "url")


_STATUTES = "SELECT DISTINCT version_id, section, coalesce(subsection, '') AS subsection, text FROM statute_chunk WHERE text IS NOT NULL AND section IS NOT NULL AND coalesce(paragraph, '') = '' AND trim(text) <> ''"


@query(f"""SELECT version_id, 'ITA s.' || section || CASE WHEN subsection <> '' THEN '(' || subsection || ')' ELSE '' END AS citation, CASE WHEN subsection <> '' THEN 'Rule [ITA s.' || section || '(' || subsection || ')]' ELSE 'Base [Part I]' END AS context,
    md5({_SQUEEZED.format("text")}) AS body FROM ({_STATUTES})""")
def statute_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Statute documents made of the rows of statute_chunk, one each, through the XML parser and back to chunks."""
    rows = table(spark, sf, "statute_chunk").where("text is not null and section is not null and coalesce(paragraph, '') = '' and trim(text) <> ''").select("version_id", "section", F.coalesce("subsection", F.lit("")).alias("subsection"), "text").distinct()
    told = F.concat(F.lit("<Text>"), _escaped("text"), F.lit("</Text>"))
    inner = F.when(F.col("subsection") != "", F.concat(F.lit("<Subsection><Label>("), F.col("subsection"), F.lit(")</Label><MarginalNote>Rule</MarginalNote>"), told, F.lit("</Subsection>"))).otherwise(told)
    xml = F.concat(
        F.lit("<Statute><Body><Heading level='1'><Label>I</Label></Heading><Section><Label>"), F.col("section"), F.lit("</Label><MarginalNote>Base</MarginalNote>"), inner, F.lit("<HistoricalNote>old</HistoricalNote></Section></Body></Statute>")
    )
    files = rows.select(xml.cast("binary").alias("content"), F.lit("en").alias("language"), F.col("version_id").alias("valid_from"), F.lit("").alias("amending_act"))
    out = parse_statutes(files)
    return out.select(F.col("valid_from").alias("version_id"), "citation", F.col("context_prefix").alias("context"), F.md5(F.expr("substring(text, length(context_prefix) + 4)")).alias("body"))


@query("SELECT jurisdiction AS value, min(row_id) AS first_seen FROM canonical GROUP BY 1")
def values_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values, null too, in the order in which they come first."""
    return harmonize.values_first_seen(table(spark, sf, "canonical"), "jurisdiction", "row_id")


@query("SELECT DISTINCT doc_type FROM document_record WHERE doc_type IS NOT NULL")
def document_types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_record").select("doc_type").where("doc_type is not null").distinct()


@query("""WITH c AS (SELECT DISTINCT version_id, act, language, citation, text FROM statute_chunk WHERE citation IS NOT NULL), o AS (SELECT act, language, version_id, row_number() OVER (PARTITION BY act, language ORDER BY ingested_at DESC, version_id DESC) AS n FROM ingestion_runs WHERE ingested_at IS NOT NULL),
    a AS (SELECT o.act, o.language, citation, md5(text) AS h FROM o JOIN c USING (version_id) WHERE n = 1), b AS (SELECT o.act, o.language, citation, md5(text) AS h FROM o JOIN c USING (version_id) WHERE n = 2)
    SELECT coalesce(a.act, b.act) AS act, coalesce(a.language, b.language) AS language, coalesce(a.citation, b.citation) AS citation, CASE WHEN b.citation IS NULL THEN 'added' WHEN a.citation IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.act = b.act AND a.language = b.language AND a.citation = b.citation WHERE a.h IS DISTINCT FROM b.h""")
def version_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that differ between the two newest versions of each act and language."""
    rows = table(spark, sf, "statute_chunk").where("citation is not null").select("version_id", "citation", "text").distinct()
    return catalog.version_diff(rows, table(spark, sf, "ingestion_runs").where("ingested_at is not null"))
