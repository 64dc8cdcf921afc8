"""Retrieval quality: rank of the first expected citation, recall and reciprocal rank, in one plan for all queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import normal_citation


def citation_match(found: Column, expected: Column, strict: bool = False) -> Column:
    """Whether one begins with the other, in normal form; ``strict``: and goes on with a bracket."""
    a, b = normal_citation(found), normal_citation(expected)
    if not strict:
        return a.startswith(b) | b.startswith(a)
    return (a == b) | a.startswith(F.concat(b, F.lit("("))) | b.startswith(F.concat(a, F.lit("(")))


def first_hits(results: DataFrame, items: DataFrame, item: str = "item_id", expected: str = "expected_citations", strict: bool = False) -> DataFrame:
    """item, rank of the first result that matches an expected citation, or 0.  Items without results are misses."""
    joined = items.select(item, expected).join(results.select(item, "citation", "rank"), item, "left")
    hit = F.exists(F.coalesce(F.col(expected), F.array().cast("array<string>")), lambda e: citation_match(F.col("citation"), e, strict))
    return joined.groupBy(item).agg(F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(0)).alias("rank"))


def report(hits: DataFrame, items: DataFrame, item: str = "item_id", topic: str = "topic", at: int = 3) -> DataFrame:
    """topic ('overall' for all), recall_at_k, mrr, n."""
    rank = F.col("rank")
    measures = [
        F.round(F.avg(F.when((rank >= 1) & (rank <= at), 1.0).otherwise(0.0)), 4).alias("recall_at_k"),
        F.round(F.avg(F.when(rank > 0, 1.0 / rank).otherwise(0.0)), 4).alias("mrr"),
        F.count("*").alias("n"),
    ]
    rows = hits.join(items.select(item, topic), item)
    return rows.groupBy(topic).agg(*measures).unionByName(rows.agg(*measures).withColumn(topic, F.lit("overall")))


def failures(hits: DataFrame, items: DataFrame, item: str = "item_id", at: int = 3) -> DataFrame:
    return hits.where((F.col("rank") == 0) | (F.col("rank") > at)).join(items, item)


def meets(overall: DataFrame, recall: float = 0.85, mrr: float = 0.75, topic: str = "topic") -> bool:
    """Whether the targets are reached (one row is read)."""
    row = overall.where(F.col(topic) == "overall").first()
    return bool(row and row["recall_at_k"] >= recall and row["mrr"] >= mrr)
