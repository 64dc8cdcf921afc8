"""Lexical indexes that are fitted once and kept: postings, terms and corpus statistics by language, for BM25 and TF-IDF.

A query reads the postings of its own terms only: they lie sorted by term and key over range partitions, so the filter on
terms prunes files and row groups, and a term that every document has is spread over files.  Nothing about the corpus is
computed again: mean lengths, document frequencies, the mean idf and the vectors' norms are in the tables.
"""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import search_tokens, term_tokens
from tidewell.operators.lexical import Bm25, count_terms
from tidewell.session import file_system, scratch, shared_dir


#: Of the tables' layout; kept indexes of another one are fitted anew.
LAYOUT = 1
#: Scores are rounded, so that equal documents tie, whatever the order of their sums, and ties go by key.
PLACES = 9


class LexicalIndex:
    """The tables ``postings``, ``terms`` and ``corpus`` under ``path``.  The corpus is written last: an index whose corpus isn't
    whole isn't there.  ``kind`` is 'bm25' or 'tfidf'; keys are of the documents' type."""

    def __init__(self, spark: SparkSession, path: str, kind: str):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def exists(self) -> bool:
        fs, where = file_system(self.spark, f"{self.path}/corpus/_SUCCESS")
        return fs.exists(where)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.table(name)

    def fit(self, docs: DataFrame, key: str, text: str, language: str | None = None, min_df: int = 2, most: int | None = None) -> LexicalIndex:
        """Fit on documents with a text; documents without a language are those of ''.  ``min_df`` and ``most`` (terms a language)
        bound the vocabulary of TF-IDF."""
        lang = F.coalesce(F.col(language), F.lit("")) if language else F.lit("")
        held = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), lang.alias("lang"), F.col(text).alias("text"))
        return self._fit_bm25(held) if self.kind == "bm25" else self._fit_tfidf(held, min_df, most)

    def _fit_bm25(self, docs: DataFrame) -> LexicalIndex:
        with scratch(self.spark) as keep:
            counted = keep(count_terms(docs, search_tokens("text"), 1))
            stats = counted.groupBy("lang").agg(F.count_if(F.col("term").isNull()).alias("n_docs"), F.avg(F.when(F.col("term").isNull(), F.col("tf"))).alias("avgdl"))
            postings = counted.where("term is not null").select("lang", "term", "key", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))
            self._put(postings.repartitionByRange("lang", "term", "key").sortWithinPartitions("lang", "term", "key"), "postings")
            df = postings.groupBy("lang", "term").agg(F.count("*").alias("df")).join(stats.select("lang", "n_docs"), "lang")
            # written before they are sorted, as a range partitioning reads what it sorts twice
            terms = keep(df.select("lang", "term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")))
            terms = self._put(terms.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term"), "terms")
            means = terms.groupBy("lang").agg(F.avg("idf").alias("mean_idf"), F.count("*").alias("n_terms"))
            self._put(stats.join(means, "lang", "left").coalesce(1), "corpus")
        return self

    def _fit_tfidf(self, docs: DataFrame, min_df: int, most: int | None) -> LexicalIndex:
        with scratch(self.spark) as keep:
            counted = keep(count_terms(docs, term_tokens("text"), 2))
            stats = counted.groupBy("lang").agg(F.count_if(F.col("term").isNull()).alias("n_docs"))
            grams = counted.where("term is not null")
            v = grams.groupBy("lang", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
            if most is not None:
                from pyspark.sql import Window

                place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "term"))
                v = v.withColumn("place", place).where(F.col("place") <= most).drop("place")
            terms = keep(v.join(stats, "lang").select("lang", "term", "df", "total", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf")))
            terms = self._put(terms.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term"), "terms")
            weighted = keep(grams.join(terms.select("lang", "term", "idf"), ["lang", "term"]).select("lang", "term", "key", ((1 + F.log("tf")) * F.col("idf")).alias("w")))
            norms = weighted.groupBy("lang", "key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
            unit = keep(weighted.join(norms, ["lang", "key"]).select("lang", "term", "key", (F.col("w") / F.col("norm")).alias("w")))
            self._put(unit.repartitionByRange("lang", "term", "key").sortWithinPartitions("lang", "term", "key"), "postings")
            self._put(stats.join(terms.groupBy("lang").agg(F.count("*").alias("n_terms")), "lang", "left").coalesce(1), "corpus")
        return self

    def _rows(self, name: str, terms: list[str], lang: str) -> DataFrame:
        return self.table(name).where((F.col("lang") == lang) & F.col("term").isin(terms))

    def _asked(self, many: dict[str, int]) -> Column:
        return F.create_map(*(F.lit(x) for pair in many.items() for x in pair))[F.col("term")] if many else F.lit(0)

    def bm25(self, query: list[str], lang: str = "", rules: Bm25 | None = None) -> DataFrame:
        """key, score of the documents that have a query term.  A query token that comes twice counts twice."""
        r = rules or Bm25()
        many = dict(Counter(query))
        corpus = self.table("corpus").where(F.col("lang") == lang)
        known = self._rows("terms", list(many), lang).join(F.broadcast(corpus.drop("lang"))).select(
            "term", self._asked(many).alias("qn"), "avgdl", F.when(F.col("idf") < 0, r.epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf")
        )
        tf = F.col("tf")
        gain = F.col("qn") * F.col("idf") * tf * (r.k1 + 1) / (tf + r.k1 * (1 - r.b + r.b * F.col("dl") / F.col("avgdl")))
        return self._rows("postings", list(many), lang).join(F.broadcast(known), "term").groupBy("key").agg(F.round(F.sum(gain), PLACES).alias("score"))

    def tfidf(self, query: str, lang: str = "") -> DataFrame:
        """key, score: the cosine with the query.  Terms that aren't in the vocabulary are dropped; without any there are no rows."""
        tokens = self.spark.range(1).select(term_tokens(F.lit(query)).alias("t")).first()[0]  # of the query, by the documents' tokenizer
        many = dict(Counter([*tokens, *map(" ".join, zip(tokens, tokens[1:]))]))
        q = self._rows("terms", list(many), lang).select("term", ((1 + F.log(self._asked(many))) * F.col("idf")).alias("wq"))
        norm = q.agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("qnorm"))
        dots = self._rows("postings", list(many), lang).join(F.broadcast(q), "term").groupBy("key").agg(F.sum(F.col("w") * F.col("wq")).alias("dot"))
        return dots.join(F.broadcast(norm)).select("key", F.round(F.col("dot") / F.col("qnorm"), PLACES).alias("score"))


def fingerprint(spark: SparkSession, path: str) -> str:
    """What tells one state of a folder or file of data from another: names, sizes and times of its files."""
    fs, where = file_system(spark, path)
    files, found = fs.listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


def index_of(spark: SparkSession, path: str, kind: str, key: str, text: str, language: str | None = None, docs: DataFrame | None = None, **kw) -> LexicalIndex:
    """The index of the table in ``path`` in this state, in the shared folder: fitted if it isn't there yet.  ``docs`` are the
    documents, if they aren't the table's rows as they are."""
    name = hashlib.md5(repr((LAYOUT, fingerprint(spark, path), kind, key, text, language, sorted(kw.items()), docs is not None)).encode()).hexdigest()
    index = LexicalIndex(spark, f"{shared_dir(spark)}/tidewell-index/{name}", kind)
    return index if index.exists() else index.fit(spark.read.parquet(path) if docs is None else docs, key, text, language, **kw)
