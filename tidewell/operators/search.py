"""The two search chains, and the functions an API would call."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import expand_tokens, normal_citation, source_block
from tidewell.operators import dense as dense_ops
from tidewell.operators.catalog import valid_on
from tidewell.operators.fusion import best_per_document, blend, boost, fuse, inject_anchors
from tidewell.operators.index import LexicalIndex
from tidewell.operators.lexical import bm25_scores, capped_top, tfidf_scores

#: Fixed values: (all of these patterns must be found, what is added to the query then), in order.
QUERY_RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    ((r"fraction",), "one-half half"),
    ((r"RRSP", r"convert|matur|option"), "maturity annuity RRIF retirement income fund maturity date annuitant 71 calendar year"),
    ((r"over.contribut|excess.*RRSP|RRSP.*excess",), "cumulative excess amount registered retirement savings plans tax payable individual over-contribution penalty Part X.1"),
    ((r"capital loss", r"applied|offset|against"), "allowable capital losses net capital loss deductible"),
    ((r"interest", r"borrowed"), "legal obligation interest paid borrowed money deductions permitted computing income business property"),
    ((r"employ\w*\s+income|income.*employ", r"include|comput"), "salary wages remuneration gratuities office employment"),
    ((r"royalt", r"non.resid|withhold"), "Part XIII rent royalty payment non-resident shall pay income tax"),
    ((r"Part XIII|withholding.*interest|interest.*withhold",), "Part XIII non-resident person shall pay income tax interest"),
    ((r"principal residence",), "principal residence gain disposition exempt years owned"),
)
#: The quotes around a term, how a question asks for its definition, and what is added to it.
_QUOTES = "'‘’“”"
_DEFINE = re.compile(rf"defin[a-z]*\s+(?:of\s+)?[{_QUOTES}]?([a-zA-Z][a-zA-Z\s\-]*?)[{_QUOTES}]?\s*(?:\?|under|in\s+the|$)", re.I)
DEFINITION = "Definition of '{term}' Part XVII ITA s.248 means"


def expand_query(query: str) -> str:
    """The query with the vocabulary its rules call for behind it."""
    added = []
    if (m := _DEFINE.search(query)) and 2 <= len(term := m[1].strip()) <= 40:
        added.append(DEFINITION.format(term=term))
    added += [more for patterns, more in QUERY_RULES if all(re.search(p, query, re.I) for p in patterns)]
    return " ".join([query, *added])


def chunk_filter(institution: str | None = None, doc_type: str | None = None, date_from: str | None = None, date_to: str | None = None, date: str = "date") -> Column:
    """The predicate of a search; what isn't given doesn't filter, and dates are inclusive."""
    p = F.lit(True)
    if institution:
        p = p & (F.col("institution") == institution)
    if doc_type:
        p = p & (F.col("doc_type") == doc_type)
    if date_from:
        p = p & (F.col(date) >= date_from)
    if date_to:
        p = p & (F.col(date) <= date_to)
    return p


def hybrid_search(
    chunks: DataFrame,
    vectors: DataFrame,
    query: str,
    query_vector: Sequence[float],
    top_n: int = 12,
    institution: str | None = None,
    doc_type: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    anchors: Sequence[str] = (),
    boost_factor: float = 2.0,
    dense_k: int = 50,
    sparse_k: int = 30,
    per_doc: int = 2,
    rrf_k: int = 60,
    index: LexicalIndex | None = None,
) -> DataFrame:
    """slot, chunk and its scores: dense and lexical rankings, fused, boosted, one chunk a document, anchors injected.

    chunks: chunk_id, doc_id, institution, doc_type, date, pos, text, ...; vectors: chunk_id, embedding.  Institution and
    kind filter before the dense top-k, dates after it; the lexical ranking is filtered whole and capped per document.
    ``index``: a kept BM25 index of the chunks by chunk_id; without it the corpus is read for this query."""
    from pyspark.sql import Window

    before = chunk_filter(institution, doc_type)
    whole = chunk_filter(institution, doc_type, date_from, date_to)
    meta = chunks.select("chunk_id", "doc_id", "institution", "doc_type", "date", "pos")
    allowed = vectors if institution is None and doc_type is None else vectors.join(meta.where(before).select("chunk_id"), "chunk_id", "left_semi")
    pool = dense_ops.top(dense_ops.similar(allowed, list(query_vector), "chunk_id"), dense_k, "chunk_id").drop("rank")
    d = dense_ops.ranked(pool.join(meta, "chunk_id").where(whole).select("chunk_id", "score"), "chunk_id")
    tokens = expand_tokens(query.lower().split())
    scores = bm25_scores(chunks, tokens, "chunk_id") if index is None else index.bm25(tokens).withColumnRenamed("key", "chunk_id")
    scored = scores.where("score > 0").join(meta, "chunk_id").where(whole)
    order = [F.desc("score"), F.col("pos"), F.col("chunk_id")]
    s = dense_ops.ranked(capped_top(scored, F.col("doc_id"), order, per_doc, sparse_k), "chunk_id", order)
    fused = fuse(d, s, "chunk_id", rrf_k).join(meta, "chunk_id")
    if anchors:
        fused = boost(fused, F.col("doc_type"), anchors, boost_factor)
    best = best_per_document(fused, "doc_id", "chunk_id", top_n)
    ranked = best.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")) - 1)
    if anchors and not doc_type:
        candidates = meta.where(whole).join(fused.select("chunk_id", "score"), "chunk_id", "left")
        ranked = inject_anchors(ranked, candidates, anchors)
    return ranked.join(fused.select("chunk_id", "dense_rank", "sparse_rank"), "chunk_id", "left").join(chunks.drop("doc_id", "institution", "doc_type", "date", "pos"), "chunk_id").orderBy("slot")


def statute_search(
    chunks: DataFrame,
    vectors: DataFrame,
    query: str,
    query_vector: Sequence[float],
    top_k: int = 5,
    language: str = "en",
    act: str | None = None,
    as_of: str | None = None,
    enforce_as_of: bool = False,
    logits: DataFrame | None = None,
    rrf_k: int = 2,
    rrf_base: int = 0,
    index: LexicalIndex | None = None,
) -> DataFrame:
    """The best chunks of one language: dense and TF-IDF rankings of top_k * 20 each, fused, and reranked where logits
    (chunk_id, logit) are given.  ``as_of`` filters only if told to.  A query without known terms is ranked by vectors alone.  ``index``: a kept TF-IDF index by
    language, whose statistics are those of the whole language; without it the kept chunks are fitted for this query."""
    kept = chunks.where(F.col("language") == language)
    if act:
        kept = kept.where(F.col("act") == act)
    if as_of and enforce_as_of:
        kept = valid_on(kept, as_of)
    pool = top_k * 20
    d = dense_ops.top(dense_ops.similar(vectors.join(kept.select("chunk_id"), "chunk_id", "left_semi"), list(query_vector), "chunk_id"), pool, "chunk_id")
    if index is None:
        scores = tfidf_scores(kept, expand_query(query), "chunk_id")
    else:
        scores = index.tfidf(expand_query(query), language).withColumnRenamed("key", "chunk_id").join(kept.select("chunk_id"), "chunk_id", "left_semi")
    s = dense_ops.top(scores, pool, "chunk_id")
    fused = fuse(d, s, "chunk_id", rrf_k, rrf_base).orderBy(F.desc("score"), "chunk_id").limit(pool)
    if logits is not None:
        fused = blend(fused.join(logits, "chunk_id", "left")).withColumn("score", F.col("blended")).drop("blended", "logit")
    best = fused.withColumn("score", F.bround("score", 6)).orderBy(F.desc("score"), "chunk_id").limit(top_k)
    return best.join(kept, "chunk_id").orderBy(F.desc("score"), "chunk_id")


def validate_request(query: str, top_k: int = 5, language: str = "en", as_of: str | None = None, clamp: bool = False) -> dict[str, object]:
    """The checks of a request; ``clamp`` brings top_k into range instead of refusing it."""
    if not 1 <= len(query) <= 2000:
        raise ValueError("query must have 1 to 2000 characters")
    if clamp:
        top_k = max(1, min(20, top_k))
    elif not 1 <= top_k <= 20:
        raise ValueError("top_k must be from 1 to 20")
    if language not in ("en", "fr"):
        raise ValueError("language must be en or fr")
    if as_of is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", as_of):
        raise ValueError("as_of must be yyyy-mm-dd")
    return {"query": query, "top_k": top_k, "language": language, "as_of": as_of}


def prompt(results: DataFrame, question: str, order: str = "slot") -> DataFrame:
    """One row: numbered sources in order, a rule, and the question."""
    block = F.struct(F.col(order).alias("o"), source_block(F.col(order) + 1, F.col("institution"), F.col("doc_type"), F.col("date"), F.col("page_num"), F.col("title"), F.col("text")).alias("b"))
    blocks = F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"])
    return results.agg(F.concat(F.lit("Sources:\n\n"), F.array_join(blocks, "\n\n---\n\n"), F.lit("\n\n" + "─" * 60 + "\n\nQuestion: " + question)).alias("prompt"))


def citations_equal(a: Column, b: Column) -> Column:
    return normal_citation(a) == normal_citation(b)
