"""Lexical scoring: BM25 (Okapi) and TF-IDF with cosine.

Statistics are tables; postings are made for query terms only, before anything is exploded: a document's array of tokens
is filtered to the query's, so what is shuffled is in proportion to matches, not to the corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import search_tokens, term_tokens, with_bigrams
from tidewell.session import materialize, spread


@dataclass(frozen=True)
class Bm25:
    """k1 and b as usual; epsilon: a term that more than half of all documents have gets this share of the mean idf."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def document_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, dl, tokens."""
    t = search_tokens(text)
    return spread(docs.where(F.col(text).isNotNull()).select(key, text)).select(F.col(key), F.size(t).alias("dl"), t.alias("tokens"))


def term_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, df over all documents: distinct terms of each document, counted with map-side combine."""
    return document_stats(docs, key, text).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25_scores(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", rules: Bm25 | None = None) -> DataFrame:
    """key, score of the documents that have a query term.  A query token that comes twice counts twice.

    Corpus size, mean length and mean idf are one-row tables; query terms are as many as the query has."""
    r = rules or Bm25()
    spark = docs.sparkSession
    many: dict[str, int] = {}
    for t in query:
        many[t] = many.get(t, 0) + 1
    terms = spark.createDataFrame(list(many.items()) or [("", 0)], "term string, qn int")
    stats = document_stats(docs, key, text)
    corpus = stats.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    idf = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighted = term_stats(docs, key, text).join(F.broadcast(corpus)).withColumn("idf", idf)
    mean = weighted.agg(F.avg("idf").alias("mean_idf"))
    known = weighted.join(F.broadcast(terms), "term").join(F.broadcast(mean)).select(
        "term", "qn", "avgdl", F.when(F.col("idf") < 0, r.epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf")
    )
    wanted = F.array(*map(F.lit, many)) if many else F.array().cast("array<string>")
    postings = stats.select(key, "dl", F.explode(F.filter("tokens", lambda t: F.array_contains(wanted, t))).alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    tf = F.col("tf")
    gain = F.col("qn") * F.col("idf") * tf * (r.k1 + 1) / (tf + r.k1 * (1 - r.b + r.b * F.col("dl") / F.col("avgdl")))
    return postings.join(F.broadcast(known), "term").groupBy(key).agg(F.sum(gain).alias("score"))


def capped_top(scores: DataFrame, group: Column, order: list[Column], per_group: int, limit: int) -> DataFrame:
    """The best rows with at most ``per_group`` of a group.  The window runs over matches; a rank filter in it is a
    top-k per group, which Spark prunes before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return scores.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_group).drop("__rn").orderBy(*order).limit(limit)


def _count_terms(key_type: pa.DataType, most: int):
    """Terms of up to ``most`` tokens of each document with their counts, counted where the document is: what leaves the task is
    one row for each distinct term, and needs no shuffle by document; and one without a term, with the number of tokens."""
    names = ["key", "lang", "term", "tf", "dl"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, langs, terms, counts, lengths = [], [], [], [], []
            for key, lang, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
                many: Counter = Counter(tokens)
                for n in range(2, most + 1):
                    many.update(map(" ".join, zip(*(tokens[k:] for k in range(n)))))
                size = len(many) + 1
                keys += [key] * size
                langs += [lang] * size
                lengths += [len(tokens)] * size
                terms += [*many.keys(), None]
                counts += [*many.values(), len(tokens)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(langs, pa.string()), pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())], names=names)

    return run


def count_terms(docs: DataFrame, tokens: Column, most: int) -> DataFrame:
    """key, lang, term, tf, dl of every document (key, lang, text): terms of 1 to ``most`` tokens, and a row without a term whose tf
    is the number of tokens."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["key"].dataType
    split = spread(docs).select("key", "lang", tokens.alias("tokens"))
    return split.mapInArrow(_count_terms(to_arrow_type(kind), most), f"key {kind.simpleString()}, lang string, term string, tf long, dl long")


def gram_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf of every document's 1- and 2-grams."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lit("").alias("lang"), F.col(text).alias("text"))
    return count_terms(rows, term_tokens("text"), 2).where("term is not null").select(F.col("key").alias(key), "term", "tf")


def vocabulary(docs: DataFrame, key: str, text: str, min_df: int = 2, most: int | None = 100_000) -> DataFrame:
    """term, df, total: 1- and 2-grams of at least ``min_df`` documents, the ``most`` frequent of them."""
    v = gram_counts(docs, key, text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    return v if most is None else v.orderBy(F.desc("total"), "term").limit(most)


def tfidf_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", min_df: int = 2, most: int | None = None) -> DataFrame:
    """key, score: cosine of (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1) vectors of 1- and 2-grams.

    Query terms outside of the vocabulary are dropped; a query without any gives no rows."""
    spark = docs.sparkSession
    held = docs.where(F.col(text).isNotNull())
    n = held.agg(F.count("*").alias("n_docs"))
    # written once: document frequencies, norms and the query's weights each read the columns they need
    grams = materialize(gram_counts(docs, key, text))
    v = grams.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    if most is not None:
        v = v.orderBy(F.desc("total"), "term").limit(most)
    idf = v.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    weight = (1 + F.log("tf")) * F.col("idf")
    q = spark.createDataFrame([(query,)], "q string").select(F.explode(with_bigrams(term_tokens("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    q = q.join(idf, "term").select("term", "idf", weight.alias("wq"))
    qn = q.agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("qnorm"))
    # only the query's terms meet here, and only documents that have one need a norm
    dots = grams.join(F.broadcast(q), "term").groupBy(key).agg(F.sum(weight * F.col("wq")).alias("dot"))
    norms = grams.join(idf, "term").groupBy(key).agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    return dots.join(norms, key).join(F.broadcast(qn)).select(key, (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))
