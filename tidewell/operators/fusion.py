"""Fusion of rankings, boosts, caps, anchors and reranking.  Inputs are top-k results: dozens of rows, whatever the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import rrf, sigmoid


def fuse(dense: DataFrame, sparse: DataFrame, key: str, k: int = 60, base: int = 1) -> DataFrame:
    """key, dense_rank, sparse_rank, score: reciprocal ranks added up; a missing rank adds nothing.

    Ranks come 1-based; ``base`` 0 counts them from zero, as some stores do."""
    d = dense.select(key, F.col("rank").alias("dense_rank"))
    s = sparse.select(key, F.col("rank").alias("sparse_rank"))
    shift = base - 1
    return d.join(s, key, "full").withColumn("score", rrf(F.col("dense_rank") + shift, k) + rrf(F.col("sparse_rank") + shift, k))


def boost(fused: DataFrame, kind: Column, kinds: Sequence[str], factor: float = 2.0) -> DataFrame:
    return fused.withColumn("score", F.when(kind.isin(*kinds), F.col("score") * factor).otherwise(F.col("score")))


def best_per_document(fused: DataFrame, doc: str, key: str, top_n: int) -> DataFrame:
    """The best chunk of each document, then the best of these; ties go by key."""
    w = Window.partitionBy(doc).orderBy(F.desc("score"), key)
    return fused.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn").orderBy(F.desc("score"), key).limit(top_n)


def checkpoint_positions(n: int) -> list[int]:
    """Which of n dates in order stand for the whole: all up to five, else around the middle, at three fifths, and the last."""
    if n <= 5:
        return list(range(n))
    return sorted({n // 2 - 2, n // 2 - 1, n // 2, round(0.6 * (n - 1)), n - 1})


def checkpoints(dates: DataFrame, date: str, *groups: str) -> DataFrame:
    """The same as a plan: rows of distinct dates by group, of which the checkpoints stay."""
    return _at_checkpoints(dates.select(*groups, date).where(F.col(date).isNotNull()).distinct(), date, *groups)


def _at_checkpoints(distinct: DataFrame, date: str, *groups: str) -> DataFrame:
    """Of rows with one date each (by group), those at the checkpoints.  A group's dates are one partition: as many as days."""
    w = Window.partitionBy(*groups).orderBy(date)
    whole = Window.partitionBy(*groups)
    n, i = F.count("*").over(whole), F.row_number().over(w) - 1
    middle = F.floor(n / 2)
    wanted = F.array(middle - 2, middle - 1, middle, F.bround(F.lit(0.6) * (n - 1)).cast("long"), n - 1)
    return distinct.withColumn("__keep", (n <= 5) | F.array_contains(wanted, i.cast("long"))).where("__keep").drop("__keep")


def inject_anchors(
    ranked: DataFrame, candidates: DataFrame, kinds: Sequence[str], key: str = "chunk_id", doc: str = "doc_id", kind: str = "doc_type", date: str = "date", pos: str = "pos"
) -> DataFrame:
    """Put chunks of the anchor kinds, at checkpoints over time, into the last slots of a ranking.

    ranked: slot (0-based), key, doc, kind, date, score.  candidates: key, doc, kind, date, pos, and score if they were
    scored.  Kinds go in order; each sees the ranking as the one before left it and goes on from its slot.  For each: of
    the chunks whose document isn't ranked, the first by ``pos`` of each date; nothing if the newest date of all is
    ranked already; else the checkpoint dates, newest first, each overwriting one slot from the end.  The ranking keeps
    its order.

    The ranking is a top-k result, and at most five rows a kind are put into it: these rows alone come to the driver.  Candidates
    are a table of any size: for each kind one filtered aggregate to dates, with the ranked documents as literals."""
    spark = ranked.sparkSession
    shape = ranked.select("slot", key, doc, kind, date, "score")
    state = {r["slot"]: tuple(r) for r in shape.collect()}
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in candidates.columns else F.lit(0.0)
    used, size = 0, len(state)
    for name in kinds:
        there = sorted({r[2] for r in state.values() if r[2] is not None})
        dates = [r[4] for r in state.values() if r[3] == name and r[4] is not None]
        pool = candidates.where((F.col(kind) == name) & F.col(date).isNotNull() & ~F.coalesce(F.col(doc).isin(there), F.lit(False)))
        first = pool.groupBy(date).agg(F.min_by(F.struct(F.col(key), F.col(doc), score.alias("score")), F.struct(pos, key)).alias("c"))
        chosen = _at_checkpoints(first, date).select(date, F.col(f"c.{key}"), F.col(f"c.{doc}"), F.col("c.score")).collect()
        chosen.sort(key=lambda r: r[0], reverse=True)
        if not chosen or (dates and chosen[0][0] <= max(dates)):
            continue
        base = used
        for turn, (at, k, d, x) in enumerate(chosen, 1):
            if (slot := size - base - turn) >= 0:
                state[slot] = (slot, k, d, name, at, x)
                used = base + turn
    return spark.createDataFrame([state[k] for k in sorted(state)], shape.schema)


def blend(candidates: DataFrame, fused: str = "score", logit: str = "logit", weight: float = 0.7) -> DataFrame:
    """weight * fused score over the largest + (1 - weight) * sigmoid of the reranker's logit, to six decimals.  Without
    a logit the fused score stays."""
    most = candidates.agg(F.max(fused).alias("most"))
    joined = candidates.join(F.broadcast(most))
    mixed = weight * F.try_divide(F.col(fused), F.col("most")) + (1 - weight) * sigmoid(F.col(logit))
    return joined.withColumn("blended", F.bround(F.coalesce(mixed, F.col(fused)), 6)).drop("most")
