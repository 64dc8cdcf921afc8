"""Exact cosine search over vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding", predicate: Column | None = None) -> DataFrame:
    """key, score against one query vector, which is a literal: a scan, with the filter pushed below it."""
    rows = vectors if predicate is None else vectors.where(predicate)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.where(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), q).alias("score")).where("score is not null")


def top(scores: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """The k best with their ranks from 1; ties go by key.  ``orderBy.limit`` keeps k rows a task."""
    best = scores.orderBy(F.desc("score"), key).limit(k)
    return ranked(best, key)


def ranked(rows: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Ranks of a result that has been limited before (a few dozen rows, so one partition is right)."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*(order or [F.desc("score"), F.col(key)]))))
