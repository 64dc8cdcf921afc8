"""Texts into sequences of a fixed token capacity (problem 8): vector best-fit decreasing.

A text over the capacity is cut into full sequences and a rest; every rest and every other text is an item with three
demands: tokens, one document, and attention cost (tokens squared).  A text makes one item at most, so items are spread by a hash
of their row over shards of a fixed expected size, whatever the texts' lengths; full sequences stand alone and go in portions
of their own where a text has many.  Each shard is packed by itself: largest first, each into the open bin with the smallest
weighted norm of what would remain, among the bins with room in every dimension.  Only a shard's last few bins stay
partly empty, so the loss is about one bin in a thousand whatever the number of shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.distinct import content_hash, salt_of
from tidewell.llm.tokens import distinct_counts


@dataclass(frozen=True)
class Capacity:
    """What a bin holds at most; ``attention`` is the sum of squared lengths (by default one text of full length)."""

    tokens: int = 2048
    documents: int = 64
    attention: float = 2048.0**2


def best_fit(tokens: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, int]:
    """The bin of each item (sizes 1..capacity.tokens), and how many bins there are.  Ties go to the older bin."""
    n = len(tokens)
    limits = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    need = np.stack([tokens, np.ones(n), tokens.astype(float) ** 2], 1) / limits
    # a dimension weighs as much as the items ask of it
    weight = need.sum(0) / max(need.sum(), 1e-12)
    order = np.argsort(-tokens, kind="stable")
    left = np.ones((n, 3))  # room of the open bins, in shares of the capacity
    names = np.zeros(n, np.int64)
    bins = np.zeros(n, np.int64)
    opened = count = 0
    smallest = need[order[-1]] if n else None
    for step, i in enumerate(order):
        room = left[:opened]
        rest = room - need[i]
        fits = (rest >= -1e-9).all(1)
        if fits.any():
            norm = np.where(fits, (rest * rest) @ weight, np.inf)
            b = int(np.argmin(norm))
            left[b] = rest[b]
        else:
            b = opened
            left[b] = 1 - need[i]
            names[b] = count
            opened += 1
            count += 1
        bins[i] = names[b]
        if step % 256 == 255 and opened:  # bins without room for the smallest item are closed
            keep = np.flatnonzero((left[:opened] >= smallest - 1e-9).all(1))
            left[: len(keep)], names[: len(keep)] = left[keep], names[keep]
            opened = len(keep)
    return bins, count


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: Capacity | None = None, shard_items: int = 8192, few: int = 8, path: str | None = None) -> DataFrame:
    """bin, key, piece, token_start, n_tokens: where each text's tokens go.

    Every token of every text is in exactly one bin; bins keep all three capacities; a text is cut only if it alone
    exceeds the token capacity.  Null and empty texts have no tokens and no rows; repeated rows and repeated keys are
    packed each; an empty table gives an empty result.  A shard holds the pieces of about ``shard_items`` texts with at most ``few``
    full sequences each, or ``shard_items`` full sequences of one text.  ``capacity.attention`` must admit one text of full length."""
    c = capacity or Capacity()
    if c.attention < float(c.tokens) ** 2 or c.documents < 1:
        raise ValueError("a text of full length must fit a bin alone")
    # the row's number comes from the scan, so it stays the same when a task runs again
    rows = df.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("r"), content_hash(F.col(text)).alias("h"), salt_of(F.col(key)).alias("salt"))
    shards = max(1, -(-df.count() // shard_items))
    counts = distinct_counts(df, text, path, [key]).select("h", "salt", F.col("n_tokens").alias("t"))
    sized = rows.join(counts, ["h", "salt"]).where("t > 0")
    # one stream of pieces: full sequences and rests alike, so that texts are tokenized for a single branch
    pieces = sized.select("k", "r", "t", F.explode(F.sequence(F.lit(0), F.ceil(F.col("t") / c.tokens).cast("int") - 1)).alias("piece"))
    full = F.floor(F.col("t") / c.tokens)
    own = (full > few) & (F.col("piece") < full)
    shard = F.when(own, F.concat_ws(".", F.lit("d"), F.col("r"), F.floor(F.col("piece") / shard_items))).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("r", "piece"), F.lit(shards))))
    items = pieces.select(shard.alias("shard"), "k", "r", "piece", F.least(F.lit(c.tokens), F.col("t") - F.col("piece") * c.tokens).cast("int").alias("n"))
    kind = df.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "r", "piece"], ascending=[False, True, True], kind="stable")
        n = pdf["n"].to_numpy()
        whole = int((n == c.tokens).sum())  # full sequences come first and stand alone
        bins = np.concatenate([np.arange(whole), whole + best_fit(n[whole:], c)[0]])
        shard = pdf["shard"].iloc[0]
        return pd.DataFrame({"bin": [f"{shard}-{b}" for b in bins], "k": pdf["k"].to_numpy(), "piece": pdf["piece"].to_numpy(), "token_start": pdf["piece"].to_numpy().astype("int64") * c.tokens, "n_tokens": n})

    # a stated number of partitions, as shards are small in bytes and would be coalesced into few tasks
    tasks = min(shards, max(200, shards // 64))
    tasks = max(tasks, df.sparkSession.sparkContext.defaultParallelism)
    return items.repartition(tasks, "shard").groupBy("shard").applyInPandas(one, f"bin string, k {kind}, piece int, token_start long, n_tokens int").withColumnRenamed("k", key)


def utilisation(packed: DataFrame, capacity: Capacity | None = None) -> DataFrame:
    """One row: bins, tokens, the share of the token capacity that is used, and the largest of each load."""
    c = capacity or Capacity()
    bins = packed.groupBy("bin").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d"), F.sum(F.col("n_tokens").cast("double") ** 2).alias("a"))
    return bins.agg(
        F.count("*").alias("n_bins"), F.sum("t").alias("n_tokens"), (F.sum("t") / (F.count("*") * c.tokens)).alias("fill"),
        F.max("t").alias("most_tokens"), F.max("d").alias("most_documents"), F.max("a").alias("most_attention"),
    )
