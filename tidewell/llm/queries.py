"""The queries of problems 5 to 10, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.dates import any_date
from tidewell.llm.leakage import leaked
from tidewell.llm.packing import pack, utilisation
from tidewell.llm.quality import STATS, junk_texts, text_quality
from tidewell.llm.quantiles import group_fields, percentiles
from tidewell.llm.split import renumbered, split_oversized
from tidewell.llm.tokens import clean_language, label_key, label_table, token_counts, token_totals, wrong_counts
from tidewell.operators.units import harmonize_units
from tidewell.plans.problems import FACTOR_SQL as _FACTOR
from tidewell.plans.problems import UNITS_SQL as _UNITS
from tidewell.session import table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(table(spark, sf, "chunk")).select("chunk_id").distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of every oversized chunk, numbered through their document."""
    chunks = table(spark, sf, "chunk")
    return renumbered(chunks, split_oversized(chunks))


def p5_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """What the pieces of each oversized chunk hold together without their overlaps, in characters that aren't white space, and
    whether each is within the limit and numbered without a gap."""
    cut = split_oversized(table(spark, sf, "chunk"))
    own = F.length(F.regexp_replace(F.substring("text", F.col("overlap_chars") + 1, F.length("text")), r"\s", ""))
    return cut.groupBy("chunk_id", "source_chunk_idx").agg(
        F.sum(own).alias("n_chars"), (F.max(F.length("text")) <= 1600).alias("within"), (F.max("chunk_idx") + 1 == F.countDistinct("chunk_idx")).alias("in_order"), (F.max("overlap_chars") <= 200).alias("overlaps")
    )


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return wrong_counts(table(spark, sf, "statute_chunk"), ["version_id", "citation"]).distinct()


def p6_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every text of both tables."""
    docs = token_counts(table(spark, sf, "documents"), ["doc_id"]).select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("id"), "n_tokens", "n_words")
    acts = token_counts(table(spark, sf, "statute_chunk"), ["version_id", "citation"])
    return docs.unionByName(acts.select(F.lit("statute_chunk").alias("origin"), F.concat_ws(" ", "version_id", "citation").alias("id"), "n_tokens", "n_words"))


def p6_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words and the estimate of every text of statute_chunk, from the same counts of distinct texts."""
    return token_counts(table(spark, sf, "statute_chunk"), ["version_id", "citation"]).select("version_id", "citation", "n_words", "n_estimate")


def p6_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and distinct texts of documents by source and cleaned language."""
    docs = table(spark, sf, "documents")
    return token_totals(docs, {"source": F.col("source"), "language": clean_language(F.col("lang"))}).select("source", "language", "n_texts", "n_distinct")


def p6_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Token budgets by source, institution, language and domain, in cleaned labels, over both tables."""
    docs, acts, runs = (table(spark, sf, t) for t in ("documents", "statute_chunk", "ingestion_runs"))
    named = label_table(docs, "institution")
    none = F.lit(None).cast("string")
    tagged = acts.join(runs.select("version_id", F.col("language").alias("run_language")).dropDuplicates(["version_id"]), "version_id", "left")
    both = docs.select("source", label_key(F.col("institution")).alias("inst"), clean_language(F.col("lang")).alias("language"), F.coalesce(F.lower(F.trim("domain")), F.lit("unknown")).alias("domain"), "text").unionByName(
        tagged.select(
            F.col("act").alias("source"), none.alias("inst"),
            F.when(clean_language(F.col("language")) == "und", clean_language(F.col("run_language"))).otherwise(clean_language(F.col("language"))).alias("language"),
            F.lit("statute").alias("domain"), "text",
        )
    )
    totals = token_totals(both, {c: F.col(c) for c in ("source", "inst", "language", "domain")})
    labels = totals.join(named.withColumnRenamed("key", "inst"), "inst", "left")
    return labels.groupBy("source", F.coalesce("label", F.lit("unknown")).alias("institution"), "language", "domain").agg(
        *(F.sum(c).alias(c) for c in ("n_texts", "n_distinct", "n_tokens", "n_tokens_distinct"))
    )


def p7_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles in common units by target, unit and day, and by month from the same sketches."""
    rows = harmonize_units(table(spark, sf, "canonical"), assume_common=False)
    group = [F.lower(F.trim("target_name")), F.coalesce("common_unit", F.lit("no stated unit"))]
    value = F.coalesce("common_value", F.when(F.col("common_unit").isNull(), F.col("concentration_value")))
    return percentiles(rows, group, any_date("collection_date", "2022-01-03", "2025-12-28"), value).select(
        "grain", *group_fields("target_name", "common_unit"), "period", "n", "p5", "p25", "p50", "p75", "p90", "p95", "p99", "p99_9"
    )


def p7_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many values without a stated unit the sketches of each target and period have taken in, and the exact extremes they
    keep; ``p7_counts_all`` has the values of every unit."""
    rows = harmonize_units(table(spark, sf, "canonical"), assume_common=False)
    group = [F.lower(F.trim("target_name")), F.coalesce("common_unit", F.lit("no stated unit"))]
    out = percentiles(rows, group, any_date("collection_date", "2022-01-03", "2025-12-28"), F.when(F.col("common_unit").isNull(), F.col("concentration_value")), q=(0.0, 1.0))
    return out.select("grain", *group_fields("target_name", "common_unit"), "period", "n", F.col("p0").alias("least"), F.col("p100").alias("most"))


def p7_counts_all(spark: SparkSession, sf: str) -> DataFrame:
    """How many values in common units the sketches of each target, unit and period have taken in, as in ``p7_percentiles``, and
    the extremes they keep, to eleven figures."""
    rows = harmonize_units(table(spark, sf, "canonical"), assume_common=False)
    group = [F.lower(F.trim("target_name")), F.coalesce("common_unit", F.lit("no stated unit"))]
    value = F.coalesce("common_value", F.when(F.col("common_unit").isNull(), F.col("concentration_value")))
    out = percentiles(rows, group, any_date("collection_date", "2022-01-03", "2025-12-28"), value, q=(0.0, 1.0))
    least, most = (F.format_string("%.10e", c).cast("double") for c in ("p0", "p100"))
    return out.select("grain", *group_fields("target_name", "common_unit"), "period", "n", least.alias("least"), most.alias("most"))


def p8_bins(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"))


def p8_utilisation(spark: SparkSession, sf: str) -> DataFrame:
    return utilisation(p8_bins(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked(table(spark, sf, "documents"), table(spark, sf, "eval_item")).select("item_id", "doc_id")


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each item that leaked, with the number of documents and the largest coverage."""
    return leaked(table(spark, sf, "documents"), table(spark, sf, "eval_item")).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("coverage").alias("most"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return junk_texts(table(spark, sf, "documents")).select("doc_id")


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return text_quality(table(spark, sf, "documents")).select("doc_id", *STATS, "p_prose", "is_prose")


QUERIES = {f.__name__: f for f in (p5_found, p5_pieces, p5_coverage, p6_found, p6_tokens, p6_words, p6_slices, p6_totals, p7_percentiles, p7_counts, p7_counts_all, p8_bins, p8_utilisation, p9_found, p9_items, p10_found, p10_statistics)}

_DAY = r"""CASE WHEN regexp_matches(trim(collection_date), '^\d{4}-\d{2}-\d{2}([T ].*)?$') THEN try_strptime(substr(trim(collection_date), 1, 10), '%Y-%m-%d')::DATE
    WHEN regexp_matches(trim(collection_date), '^\d{1,2}/\d{1,2}/\d{4}$') THEN try_strptime(trim(collection_date), '%m/%d/%Y')::DATE END"""

ORACLE_SQL = {
    "p5_coverage": r"""SELECT chunk_id, chunk_idx AS source_chunk_idx, length(regexp_replace(text, '\s', '', 'g')) AS n_chars, true AS within, true AS in_order, true AS overlaps
        FROM (SELECT DISTINCT chunk_id, chunk_idx, text FROM chunk WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 1600)""",
    "p6_words": r"""SELECT version_id, citation, coalesce(len(regexp_extract_all(text, '\S+')), 0) AS n_words, CAST(trunc(coalesce(len(regexp_extract_all(text, '\S+')), 0) * 1.3::DOUBLE) AS BIGINT) AS n_estimate FROM statute_chunk""",
    "p7_counts": _UNITS + f""", v AS (SELECT lower(trim(target_name)) AS target_name, {_DAY} AS d, concentration_value AS x FROM canonical JOIN t USING (row_id) WHERE t.t IS NULL),
        w AS (SELECT * FROM v WHERE d BETWEEN DATE '2022-01-03' AND DATE '2025-12-28')
        SELECT 'day' AS grain, target_name, 'no stated unit' AS common_unit, strftime(d, '%Y-%m-%d') AS period, count(*) AS n, min(x) AS least, max(x) AS most FROM w GROUP BY target_name, d
        UNION ALL SELECT 'month', target_name, 'no stated unit', strftime(date_trunc('month', d), '%Y-%m-%d'), count(*), min(x), max(x) FROM w GROUP BY target_name, date_trunc('month', d)""",
    # columns are taken through the CTEs of UNITS_SQL, as a join on row_id would multiply rows that share one
    "p7_counts_all": _UNITS.replace("SELECT row_id, concentration_value", "SELECT target_name, collection_date, concentration_value", 1).replace("SELECT row_id, CASE", "SELECT target_name, collection_date, concentration_value AS x, CASE", 1)
    + f""", v AS (SELECT lower(trim(target_name)) AS target_name, {_DAY} AS d,
            CASE WHEN t IS NULL THEN 'no stated unit' WHEN regexp_matches(t, 'ratio|of pmmov|per copy|pmmov copies') THEN 'ratio (microbial-normalized)' WHEN regexp_matches(t, 'dry|dw') THEN 'copies/g dry sludge' ELSE 'copies/l' END AS common_unit,
            CASE WHEN t IS NULL THEN x WHEN regexp_matches(t, 'log') THEN pow(10.0, x) * {_FACTOR} ELSE x * {_FACTOR} END AS x FROM t),
        w AS (SELECT * FROM v WHERE d BETWEEN DATE '2022-01-03' AND DATE '2025-12-28' AND NOT isnan(x) AND (common_unit = 'no stated unit' OR NOT isinf(x))),
        p AS (SELECT 'day' AS grain, * FROM w UNION ALL SELECT 'month', * REPLACE (date_trunc('month', d)::DATE AS d) FROM w)
        SELECT grain, target_name, common_unit, strftime(d, '%Y-%m-%d') AS period, count(*) AS n, CAST(format('{{:.10e}}', min(x)) AS DOUBLE) AS least, CAST(format('{{:.10e}}', max(x)) AS DOUBLE) AS most FROM p GROUP BY grain, target_name, common_unit, d""",
    "p6_slices": r"""WITH l AS (SELECT source, text, regexp_split_to_array(lower(trim(lang)), '[-_]')[1] AS b FROM documents),
        c AS (SELECT source, text, CASE WHEN b IS NULL OR b IN ('', 'und', 'unknown', 'n/a') THEN 'und' WHEN b = 'eng' THEN 'en' WHEN b IN ('fra', 'fre') THEN 'fr' WHEN b IN ('deu', 'ger') THEN 'de' WHEN b = 'spa' THEN 'es' ELSE b END AS language FROM l)
        SELECT source, language, count(*) AS n_texts, count(DISTINCT text) AS n_distinct FROM c GROUP BY 1, 2""",
    "p5_found": r"""SELECT DISTINCT chunk_id FROM chunk WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 1600""",
    "p6_found": r"""SELECT DISTINCT version_id, citation FROM statute_chunk
        WHERE token_count IS DISTINCT FROM
        CASE WHEN text IS NULL THEN 0 ELSE CAST(trunc(len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE) AS INTEGER) END""",
}
