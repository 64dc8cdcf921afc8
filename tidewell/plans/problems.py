"""The queries of problems 1 to 4, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.grid import missing_weeks, regular_weeks
from tidewell.operators.snapshots import change_counts, changed_values, snapshot_changes
from tidewell.operators.spikes import implausible_readings
from tidewell.operators.units import harmonize_units, off_unit_rows
from tidewell.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return implausible_readings(table(spark, sf, "canonical")).select("row_id").distinct()


def p1_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of each kind by site."""
    faults = implausible_readings(table(spark, sf, "canonical"), keep=("site_id",))
    return faults.groupBy("site_id", "fault").agg(F.countDistinct("row_id").alias("n_rows"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(table(spark, sf, "statute_chunk"), table(spark, sf, "ingestion_runs")).select("version_id", "citation", "change")


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return change_counts(p2_found(spark, sf))


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """Old and new values of the records that changed."""
    rows, runs = table(spark, sf, "statute_chunk"), table(spark, sf, "ingestion_runs")
    return changed_values(rows, runs, snapshot_changes(rows, runs)).select("version_id", "citation", "old_text", "new_text", "old_part", "new_part", "old_division", "new_division", "old_valid_to", "new_valid_to")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return missing_weeks(table(spark, sf, "canonical")).select("key_plot_id", "target_name", "week_start")


def p3_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The whole weekly grid with the readings of each week, weeks without one marked; ``p3_filled`` has the values."""
    g = regular_weeks(table(spark, sf, "canonical"))
    return g.select("key_plot_id", "target_name", "week_start", "n_readings", "is_missing")


def p3_filled(spark: SparkSession, sf: str) -> DataFrame:
    """The whole weekly grid with means in the common unit, filled and carried over weeks without a reading, to eleven figures."""
    g = regular_weeks(harmonize_units(table(spark, sf, "canonical"), assume_common=True), averaged="common_value")
    figures = [F.format_string("%.10e", c).cast("double").alias(c) for c in ("value_mean", "value_filled", "value_carried")]
    return g.select("key_plot_id", "target_name", "week_start", "n_readings", "is_missing", *(F.when(F.col(c).isNotNull(), x).alias(c) for c, x in zip(("value_mean", "value_filled", "value_carried"), figures)))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return off_unit_rows(table(spark, sf, "canonical")).select("row_id", "common_unit").distinct()


def p4_converted(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading with a stated unit, in the common unit of its quantity, to eight figures."""
    rows = harmonize_units(table(spark, sf, "canonical")).where("common_value is not null")
    return rows.select("row_id", "common_unit", F.format_string("%.7e", "common_value").cast("double").alias("common_value"))


QUERIES = {f.__name__: f for f in (p1_found, p1_faults, p2_found, p2_counts, p2_values, p3_found, p3_grid, p3_filled, p4_found, p4_converted)}

_RUNS = r"""WITH d AS (SELECT DISTINCT version_id FROM statute_chunk WHERE version_id IS NOT NULL),
    r AS (SELECT version_id, lag(version_id) OVER w AS prev FROM ingestion_runs JOIN d USING (version_id) WINDOW w AS (PARTITION BY act, language ORDER BY try_cast(ingested_at AS TIMESTAMPTZ) NULLS FIRST, version_id)),
    k AS (SELECT DISTINCT version_id, citation, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, part, division, valid_to FROM statute_chunk),
    c AS (SELECT r.version_id, n.citation, CASE WHEN o.version_id IS NULL THEN 'added' WHEN n.text IS DISTINCT FROM o.text OR n.part IS DISTINCT FROM o.part OR n.division IS DISTINCT FROM o.division
        OR n.valid_to IS DISTINCT FROM o.valid_to THEN 'changed' END AS change FROM r JOIN k n ON n.version_id = r.version_id LEFT JOIN k o ON o.version_id = r.prev AND o.citation IS NOT DISTINCT FROM n.citation WHERE r.prev IS NOT NULL
        UNION ALL SELECT r.version_id, o.citation, 'removed' FROM r JOIN k o ON o.version_id = r.prev WHERE NOT EXISTS (SELECT 1 FROM k n WHERE n.version_id = r.version_id AND n.citation IS NOT DISTINCT FROM o.citation)),
    f AS (SELECT * FROM c WHERE change IS NOT NULL) """
_GRID = r"""WITH r AS (SELECT key_plot_id, lower(trim(target_name)) AS target_name, CASE WHEN regexp_matches(trim(collection_date), '^\d{4}-\d{2}-\d{2}([T ].*)?$') THEN try_strptime(substr(trim(collection_date), 1, 10), '%Y-%m-%d')::DATE
    WHEN regexp_matches(trim(collection_date), '^\d{1,2}/\d{1,2}/\d{4}$') THEN try_strptime(trim(collection_date), '%m/%d/%Y')::DATE END AS d FROM canonical WHERE concentration_value IS NOT NULL),
    w AS (SELECT key_plot_id, target_name, date_trunc('week', d)::DATE AS wk, count(*) AS n FROM r WHERE d BETWEEN DATE '2022-01-03' AND DATE '2025-12-28' GROUP BY ALL),
    s AS (SELECT key_plot_id, target_name, generate_series(min(wk), max(wk), INTERVAL 7 DAY) AS wks FROM w GROUP BY 1, 2),
    g AS (SELECT key_plot_id, target_name, unnest(wks)::DATE AS wk FROM s) """

UNITS_SQL = r"""WITH c AS (SELECT row_id, concentration_value, lower(concentration_unit) AS u, regexp_replace(lower(normalization_method),
    '\(sample volume[^)]*\)|; flow given in[^;]*|; detection limit[^;]*|, surrogate spiked[^;]*|; recovery[^;]*|; duplicate wells[^;]*', '', 'g') AS m FROM canonical),
    t AS (SELECT row_id, CASE WHEN regexp_matches(u, 'cop|gc|cp/|ratio|pmmov') THEN u WHEN regexp_matches(m, 'cop|gc|cp/|ratio|percent of|ppm of|% of') THEN m END AS t FROM c WHERE concentration_value IS NOT NULL) """

FACTOR_SQL = r"""CASE WHEN regexp_matches(t, 'ratio|of pmmov|per copy|pmmov copies') THEN CASE WHEN regexp_matches(t, 'ppm|per million|10\^-6') THEN 1e-6 WHEN regexp_matches(t, 'per 1000|10\^-3') THEN 1e-3 WHEN regexp_matches(t, '%|percent') THEN 1e-2 ELSE 1.0 END
    ELSE CASE WHEN regexp_matches(t, '10\^6|1e6|mln|million') THEN 1e6 WHEN regexp_matches(t, '10\^3|x1000|thousand|kilocop') THEN 1e3 ELSE 1.0 END
        * CASE WHEN regexp_matches(t, 'dry|dw') THEN CASE WHEN regexp_matches(t, 'kg') THEN 1e-3 WHEN regexp_matches(t, 'mg') THEN 1e3 ELSE 1.0 END
          WHEN regexp_matches(t, '100 ?ml') THEN 1e1 WHEN regexp_matches(t, 'ml([^n]|$)|millilit') THEN 1e3 WHEN regexp_matches(t, 'm3|m\^3|cubic') THEN 1e-3 WHEN regexp_matches(t, 'gal') THEN 1 / 3.785411784 ELSE 1.0 END END"""

_FIGURES = "CASE WHEN {0} IS NOT NULL THEN CAST(format('{{:.10e}}', {0}) AS DOUBLE) END"
_FILLED = (
    UNITS_SQL
    + f""", v AS (SELECT row_id, CASE WHEN t IS NULL THEN x WHEN regexp_matches(t, 'log') THEN pow(10.0, x) * {FACTOR_SQL} ELSE x * {FACTOR_SQL} END AS v FROM (SELECT t.*, concentration_value AS x FROM t JOIN canonical USING (row_id))), """
    + _GRID.removeprefix("WITH ").replace("FROM canonical WHERE", ", v AS cv FROM canonical JOIN v USING (row_id) WHERE", 1).replace("count(*) AS n FROM r", "count(*) AS n, avg(CASE WHEN isinf(cv) THEN NULL ELSE cv END) AS m FROM r", 1)
    + """, j AS (SELECT g.key_plot_id, g.target_name, g.wk, w.n, w.m, last_value(w.wk IGNORE NULLS) OVER b AS lw, first_value(w.wk IGNORE NULLS) OVER a AS rw
        FROM g LEFT JOIN w ON w.key_plot_id IS NOT DISTINCT FROM g.key_plot_id AND w.target_name IS NOT DISTINCT FROM g.target_name AND w.wk = g.wk
        WINDOW b AS (PARTITION BY g.key_plot_id, g.target_name ORDER BY g.wk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY g.key_plot_id, g.target_name ORDER BY g.wk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    e AS (SELECT j.*, l.m AS lm, r.m AS rm FROM j JOIN w l ON l.key_plot_id IS NOT DISTINCT FROM j.key_plot_id AND l.target_name IS NOT DISTINCT FROM j.target_name AND l.wk = j.lw
        JOIN w r ON r.key_plot_id IS NOT DISTINCT FROM j.key_plot_id AND r.target_name IS NOT DISTINCT FROM j.target_name AND r.wk = j.rw),
    f AS (SELECT *, CASE WHEN n IS NOT NULL THEN m ELSE lm + (rm - lm) * (datediff('day', lw, wk) // 7) / (datediff('day', lw, rw) // 7) END AS filled, CASE WHEN n IS NOT NULL THEN m ELSE lm END AS carried FROM e)
    SELECT key_plot_id, target_name, strftime(wk, '%Y-%m-%d') AS week_start, coalesce(n, 0) AS n_readings, n IS NULL AS is_missing, """
    + ", ".join(f"{_FIGURES.format(c)} AS {n}" for c, n in (("m", "value_mean"), ("filled", "value_filled"), ("carried", "value_carried")))
    + " FROM f"
)

SQL = {
    "p3_filled": _FILLED,
    "p4_converted": UNITS_SQL.replace("SELECT row_id, CASE WHEN", "SELECT row_id, concentration_value AS v, CASE WHEN", 1) + f"""SELECT row_id, CASE WHEN regexp_matches(t, 'ratio|of pmmov|per copy|pmmov copies') THEN 'ratio (microbial-normalized)' WHEN regexp_matches(t, 'dry|dw') THEN 'copies/g dry sludge' ELSE 'copies/l' END AS common_unit,
        CAST(format('{{:.7e}}', common_value) AS DOUBLE) AS common_value FROM (SELECT *, CASE WHEN regexp_matches(t, 'log') THEN pow(10.0, v) ELSE v END * {FACTOR_SQL} AS common_value FROM t WHERE t IS NOT NULL)""",
    "p4_found": UNITS_SQL + r"""SELECT DISTINCT row_id, CASE WHEN regexp_matches(t, 'ratio|of pmmov|per copy|pmmov copies') THEN 'ratio (microbial-normalized)' WHEN regexp_matches(t, 'dry|dw') THEN 'copies/g dry sludge' ELSE 'copies/l' END AS common_unit
        FROM t WHERE regexp_matches(t, 'log|10\^|x1000|thousand|kilo|mln|million|1e6|ml|millilit|m3|m\^3|cubic|gal|kg|mg|percent|%|ppm|1000|x 10')""",
    "p2_found": _RUNS + "SELECT version_id, citation, change FROM f",
    "p2_counts": _RUNS + "SELECT version_id, count(*) FILTER (change = 'added') AS chunks_added, count(*) FILTER (change = 'removed') AS chunks_removed, count(*) FILTER (change = 'changed') AS chunks_changed FROM f GROUP BY 1",
    "p2_values": _RUNS + """, v AS (SELECT version_id, citation, max(text) AS text, max(part) AS part, max(division) AS division, max(valid_to) AS valid_to FROM k GROUP BY 1, 2)
        SELECT f.version_id, f.citation, o.text AS old_text, n.text AS new_text, o.part AS old_part, n.part AS new_part, o.division AS old_division, n.division AS new_division, o.valid_to AS old_valid_to, n.valid_to AS new_valid_to
        FROM f JOIN r USING (version_id) JOIN v n ON n.version_id = f.version_id AND n.citation IS NOT DISTINCT FROM f.citation JOIN v o ON o.version_id = r.prev AND o.citation IS NOT DISTINCT FROM f.citation WHERE f.change = 'changed'""",
    "p3_found": _GRID + "SELECT g.key_plot_id, g.target_name, strftime(g.wk, '%Y-%m-%d') AS week_start FROM g ANTI JOIN w ON g.key_plot_id = w.key_plot_id AND g.target_name = w.target_name AND g.wk = w.wk",
    "p3_grid": _GRID + "SELECT g.key_plot_id, g.target_name, strftime(g.wk, '%Y-%m-%d') AS week_start, coalesce(n, 0) AS n_readings, n IS NULL AS is_missing FROM g LEFT JOIN w ON g.key_plot_id = w.key_plot_id AND g.target_name = w.target_name AND g.wk = w.wk",
}
