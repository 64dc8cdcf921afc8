"""Keyed tables: upserts, increments, purges, deltas, and the log of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.text import uuid5
from tidewell.session import file_system


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key isn't in ``new``, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with one key the last in order.  As an aggregate: rows of a hot key meet as partial maxima, not in one task."""
    rest = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return packed.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def content_points(chunks: DataFrame, text: str = "text", pos: str = "pos") -> DataFrame:
    """Rows keyed by the name-based UUID of their text: equal texts are one point, of which the last row stays."""
    return last_by_key(chunks.withColumn("point_id", uuid5(text)), ["point_id"], [F.col(pos)])


def new_rows(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return rows.join(existing.select(key), key, "left_anti")


def purge(table: DataFrame, **equal: str) -> DataFrame:
    """All rows but those that match every given value; rows with null in such a column stay."""
    match = F.lit(True)
    for c, v in equal.items():
        match = match & F.col(c).eqNullSafe(F.lit(v))
    return table.where(~match)


def replace_partition(rows: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite just the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def staged_overwrite(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Write beside the table, then put it in place by renames.  A failed job leaves the old table; after a failure between the
    two renames it lies beside its place, where :func:`read_or_empty` finds it, and is put back before the next write."""
    staged, aside = f"{path}.staged", f"{path}.old"
    fs, where = file_system(spark, path)
    at = lambda p: file_system(spark, p)[1]
    if not fs.exists(where) and fs.exists(at(aside)):
        fs.rename(at(aside), where)
    rows.write.mode("overwrite").parquet(staged)
    fs.delete(at(aside), True)
    if fs.exists(where):
        fs.rename(where, at(aside))
    fs.rename(at(staged), where)
    fs.delete(at(aside), True)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table, or the one that an interrupted write left beside it, or no rows of its schema where there is none yet."""
    fs, where = file_system(spark, path)
    if fs.exists(where):
        return spark.read.schema(schema).parquet(path)
    if fs.exists(file_system(spark, f"{path}.old")[1]):
        return spark.read.schema(schema).parquet(f"{path}.old")
    return spark.createDataFrame([], schema)


def delta_sizes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys added, removed and unchanged.  Null keys aren't keys.

    To be taken before the old table is overwritten."""
    o = old.where(F.col(key).isNotNull()).select(F.col(key)).distinct().withColumn("o", F.lit(1))
    n = new.where(F.col(key).isNotNull()).select(F.col(key)).distinct().withColumn("n", F.lit(1))
    return o.join(n, key, "full").agg(
        F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("unchanged")
    )


def versions(runs: DataFrame, act: str | None = None, language: str | None = None) -> DataFrame:
    """Runs, newest first, each with ``is_current`` (the newest of its act and language) and ``unchanged``."""
    kept = runs
    if act is not None:
        kept = kept.where(F.col("act") == act)
    if language is not None:
        kept = kept.where(F.col("language") == language)
    w = Window.partitionBy("act", "language").orderBy(F.desc("ingested_at"), "version_id")
    flagged = kept.withColumns({"is_current": F.row_number().over(w) == 1, "unchanged": F.col("chunk_count") - F.col("chunks_added")})
    return flagged.orderBy(F.desc("ingested_at"), "version_id")


def latest_versions(runs: DataFrame) -> DataFrame:
    return last_by_key(runs, ["act", "language"], [F.col("ingested_at"), F.col("version_id")])


def version_diff(rows: DataFrame, runs: DataFrame, key: str = "citation", text: str = "text", run: str = "version_id") -> DataFrame:
    """act, language, key, change: the rows that differ between the newest run of each act and language and the one before it."""
    w = Window.partitionBy("act", "language").orderBy(F.desc("ingested_at"), F.desc(run))
    order = runs.withColumn("__n", F.row_number().over(w)).where("__n <= 2").select("act", "language", run, F.col("__n").alias("n"))
    placed = rows.select(run, key, F.md5(text).alias("h")).join(order, run).groupBy("act", "language", key).agg(
        F.max(F.when(F.col("n") == 1, F.struct("h"))).alias("new"), F.max(F.when(F.col("n") == 2, F.struct("h"))).alias("old")
    )
    change = F.when(F.col("old").isNull(), F.lit("added")).when(F.col("new").isNull(), F.lit("removed")).when(~F.col("new.h").eqNullSafe(F.col("old.h")), F.lit("changed"))
    return placed.select("act", "language", key, change.alias("change")).where("change is not null")


def version_exists(runs: DataFrame, version_hash: str, act: str, language: str) -> bool:
    return not runs.where((F.col("version_hash") == version_hash) & (F.col("act") == act) & (F.col("language") == language)).isEmpty()


def valid_on(rows: DataFrame, day: str | Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows whose validity has begun by the day and hasn't ended; no end is for good."""
    d = F.lit(day) if isinstance(day, str) else day
    return rows.where((F.col(start) <= d) & (F.col(end).isNull() | (F.col(end) > d)))


def missing_files(catalogue: DataFrame, files: DataFrame, path: str = "local_path") -> DataFrame:
    return catalogue.join(files.select(path), path, "left_anti")


def health(index: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: points in the index, the newest run, and a state."""
    points = index.agg(F.count("*").alias("n_points"))
    newest = runs.agg(F.max_by("version_id", F.struct("ingested_at", "version_id")).alias("latest_version"), F.max("ingested_at").alias("latest_ingested_at"))
    state = F.when(F.col("n_points") == 0, "empty").when(F.col("latest_version").isNull(), "degraded").otherwise("ok")
    return points.join(F.broadcast(newest)).withColumn("status", state)
