"""Feeds onto one canonical table, and reports about it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.dates import iso_date
from tidewell.functions.text import clean_unit, normal_target, to_float
from tidewell.schemas import CANONICAL

FLOW_UNIT = "copies/l"
RATIO_UNIT = "ratio (microbial-normalized)"


def apply_mapping(raw: DataFrame, mapping: dict[str, Column]) -> DataFrame:
    """A projection onto the canonical columns, in their order; fields without a mapping are null."""
    return raw.select(*((mapping.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in CANONICAL))


def feed_a_mapping(source: str = "FEED_A", target: str = "sars-cov-2", flow_unit: str = FLOW_UNIT) -> dict[str, Column]:
    """A feed of one target whose unit follows from its normalization; anything but flow, null too, is a ratio.  ``flow_unit``
    is how the unit of flow-normalized values is to be spelt."""
    return {
        "site_id": F.col("wwtp_id"),
        "jurisdiction": F.col("reporting_jurisdiction"),
        "collection_date": iso_date("date"),
        "target_name": F.lit(target),
        "concentration_value": to_float("pcr_conc_lin"),
        "concentration_unit": F.when(F.col("normalization") == "flow-population", F.lit(flow_unit)).otherwise(F.lit(RATIO_UNIT)),
        "normalization_method": F.col("normalization"),
        "data_source": F.lit(source),
    }


def feed_b_mapping(source: str = "FEED_B", null_target: str | None = None) -> dict[str, Column]:
    """A feed that names its targets and units in its own spelling."""
    return {
        "site_id": F.col("site_id"),
        "jurisdiction": F.col("reporting_jurisdiction"),
        "collection_date": iso_date("sample_collect_date"),
        "target_name": normal_target("pcr_target", null_target),
        "concentration_value": to_float("pcr_target_avg_conc"),
        "concentration_unit": clean_unit("pcr_target_units"),
        "normalization_method": F.col("other_norm_name"),
        "data_source": F.lit(source),
    }


def lookup_metadata(keys: DataFrame, meta: DataFrame, key: str = "key_plot_id") -> DataFrame:
    """The distinct metadata rows of the keys at hand: a semi-join, so only keys travel."""
    return meta.distinct().join(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def enrich(measured: DataFrame, meta: DataFrame, key: str = "key_plot_id") -> DataFrame:
    """Left outer join; a key with several metadata rows gives a row for each, a null key finds none."""
    return measured.join(lookup_metadata(measured, meta, key), key, "left")


def exclude_source(df: DataFrame, column: str, value: str) -> DataFrame:
    """All rows but those with the value; rows with null stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def only_target(df: DataFrame, column: str, target: str | None) -> DataFrame:
    return df if target is None else df.where(normal_target(column) == target.strip().lower())


def combine(*feeds: DataFrame | None) -> DataFrame:
    """Union by name of the feeds that there are."""
    there = [f for f in feeds if f is not None]
    if not there:
        raise ValueError("no feed")
    return reduce(DataFrame.unionByName, there)


def first_rows(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows in a stated order; a plain limit has none."""
    return df.orderBy(*order).limit(limit)


def profile(df: DataFrame) -> DataFrame:
    """One row: counts of rows, sites, sources and missing values."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("site_id").alias("n_sites"),
        F.countDistinct("data_source").alias("n_sources"),
        F.count_if(F.col("concentration_value").isNull()).alias("n_missing_values"),
        F.count_if(F.col("collection_date").isNull()).alias("n_missing_dates"),
    )


def value_counts(df: DataFrame, column: str, with_null: bool = False) -> DataFrame:
    kept = df if with_null else df.where(F.col(column).isNotNull())
    return kept.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def values_first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """value, first_seen: distinct values, null too, with the place of the first; to be sorted by it for display."""
    return df.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first_seen"))


def two_key_inventory(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by two keys, and the total, as one pass of grouping sets."""
    return df.groupingSets([[F.col(a), F.col(b)], []], F.col(a), F.col(b)).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


def monthly_median(df: DataFrame, date: Column, value: Column, *groups: Column) -> DataFrame:
    """Exact median by month.  For tables where a group may be huge, use the sketches of the percentile operator."""
    return df.groupBy(*groups, F.date_format(F.trunc(date, "month"), "yyyy-MM-dd").alias("month")).agg(F.median(value).alias("median_value"), F.count(value).alias("n"))


def percent_of_peak(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each value as a percentage of its group's peak.  Peaks are pre-aggregated and joined, so a hot group isn't one task."""
    peaks = df.groupBy(group).agg(F.max(value).alias("peak"))
    on = df[group].eqNullSafe(peaks[group])
    return df.join(peaks, on).drop(peaks[group]).withColumn("pct_of_peak", F.try_divide(100.0 * F.col(value), F.col("peak"))).drop("peak")
