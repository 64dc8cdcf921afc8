"""Irregular readings onto a regular grid (problem 3).

A series is cut into time shards of ``shard`` weeks.  Readings shrink to one row per series and shard in one aggregate, which
combines them where they lie: a count and a sum for each week of the shard, so a shard is of one size whatever the number of
its readings.  A shard's summary is its last reading; a scan over the few shards of a series hands each one the last reading
before it, which is the state that it carries.  With it all shards are filled independently of one another, each up to its own
last reading.  The scan takes the shards' rows along: they are small, and to join carried states back to them would
compute the shards twice (1.9 instead of 0.6 x input on disk, by the check tool).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.dates import any_date, week_start


def regular_weeks(
    df: DataFrame,
    source: str = "key_plot_id",
    target: str = "target_name",
    date: str = "collection_date",
    value: str = "concentration_value",
    first: str = "2022-01-03",
    last: str = "2025-12-28",
    shard: int = 13,
    averaged: str | None = None,
) -> DataFrame:
    """One row per series and week from its first to its last reading.

    Columns: source, target (trimmed, lower case), ``week_start`` (a Monday, yyyy-MM-dd), ``n_readings``,
    ``value_mean`` (null without a reading), ``value_filled`` (the mean, else linear between the readings on either
    side), ``value_carried`` (the mean, else the last one before) and ``is_missing``.  A reading has a value that is
    neither null nor NaN and a readable date in [first, last].  The values are those of ``averaged`` (of ``value`` if not
    named); series mix units and scales, so it must be in the common unit wherever values are used.  A reading for which
    it is null counts, but adds nothing to the mean; a week of such readings only has null values, as have gaps that
    would be filled from it.  A null source or target is a series of its own; repeats
    count as readings of their week; a series of one week has one row; an empty table gives an empty result.  Extra
    columns are ignored."""
    day = any_date(date, first, last)
    v = F.col(value).cast("double")
    c = F.col(averaged or value).cast("double")
    origin = F.lit(first).cast("date")
    start = F.date_sub(origin, F.weekday(origin))
    readings = df.select(
        F.col(source).alias("__s"), F.lower(F.trim(target)).alias("__t"), F.floor(F.datediff(week_start(day), start) / 7).cast("int").alias("w"), v.alias("v"), c.alias("c")
    ).where(F.col("w").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    keyed = readings.select("__s", "__t", F.floor(F.col("w") / shard).cast("int").alias("shard"), (F.col("w") % shard).alias("i"), "c")
    here = [F.col("i") == i for i in range(shard)]
    shards = keyed.groupBy("__s", "__t", "shard").agg(
        *(F.count_if(x).alias(f"n{i}") for i, x in enumerate(here)), *(F.avg(F.when(x, F.col("c"))).alias(f"v{i}") for i, x in enumerate(here))
    )
    week = lambda i: F.struct((F.col("shard") * shard + i).alias("w"), F.col(f"n{i}").alias("n"), F.col(f"v{i}").alias("v"))
    shards = shards.select("__s", "__t", "shard", F.filter(F.array(*map(week, range(shard))), lambda x: x["n"] > 0).alias("weeks"))
    # carry states, by a scan over the shards, whose summary is the last reading
    series = Window.partitionBy("__s", "__t").orderBy("shard")
    carried = shards.withColumn("tail", F.element_at("weeks", -1)).withColumn("before", F.lag("tail").over(series)).drop("tail")
    # a shard fills from the reading before it (not included) to its own last one: the gaps between its readings
    points = F.when(F.col("before").isNotNull(), F.concat(F.array("before"), F.col("weeks"))).otherwise(F.col("weeks"))
    spans = carried.select("__s", "__t", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(points) - 1), lambda i: F.struct(
        F.when(i > 0, F.get(points, i - 1)).alias("left"), F.get(points, i).alias("right")))).alias("i", "span"), F.col("before").isNotNull().alias("led"))
    spans = spans.where((F.col("i") > 0) | ~F.col("led")).select("__s", "__t", F.col("span.left").alias("l"), F.col("span.right").alias("r"))
    w = F.explode(F.sequence(F.when(F.col("l.w").isNull(), F.col("r.w")).otherwise(F.col("l.w") + 1), F.col("r.w")))
    filled = spans.select("__s", "__t", "l", "r", w.alias("w"))
    here = F.col("w") == F.col("r.w")
    return filled.select(
        F.col("__s").alias(source),
        F.col("__t").alias(target),
        F.date_format(F.date_add(start, F.col("w") * 7), "yyyy-MM-dd").alias("week_start"),
        F.when(here, F.col("r.n")).otherwise(F.lit(0)).alias("n_readings"),
        F.when(here, F.col("r.v")).alias("value_mean"),
        F.when(here, F.col("r.v")).otherwise(_between(F.col("l"), F.col("r"), F.col("w"))).alias("value_filled"),
        F.when(here, F.col("r.v")).otherwise(F.col("l.v")).alias("value_carried"),
        (~here).alias("is_missing"),
    )


def _between(left: Column, right: Column, w: Column) -> Column:
    return left["v"] + (right["v"] - left["v"]) * (w - left["w"]) / (right["w"] - left["w"])


def missing_weeks(df: DataFrame, **kw: str) -> DataFrame:
    """source, target, week_start of the weeks without a reading."""
    return regular_weeks(df, **kw).where("is_missing")
