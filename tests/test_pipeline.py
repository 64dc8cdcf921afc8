"""Kept indexes, loads of several steps, catalogues, two-hop links, and small display functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions.text import badge, rank_line
from tidewell.operators import catalog, lexical
from tidewell.operators.fusion import inject_anchors
from tidewell.operators.index import LexicalIndex, fingerprint, index_of
from tidewell.operators.pipeline import load_statutes, merge_catalogue, to_download
from tidewell.sources.links import hub_documents, titled
from tidewell.sources.statute_xml import consolidation_dates, hints_of, topic_hints

DOCS = [(1, "Rates rose. Rates fell!", "en"), (2, "rates held steady by the bank", "en"), (3, None, "en"), (4, "le taux a monté", "fr"), (5, "", "en"), (6, "the bank held", None)]


def test_index_scores_are_those_of_the_corpus(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    for kind in ("bm25", "tfidf"):
        index = LexicalIndex(spark, str(tmp_path / kind), kind)
        assert not index.exists()
        index.fit(docs, "doc_id", "text", **({"min_df": 1} if kind == "tfidf" else {}))
        assert index.exists()
        if kind == "bm25":
            got, want = index.bm25(["rates", "held", "held"]), lexical.bm25_scores(docs, ["rates", "held", "held"])
        else:
            got, want = index.tfidf("rates held the bank"), lexical.tfidf_scores(docs, "rates held the bank", min_df=1)
        a, b = {r["key"]: r["score"] for r in got.collect()}, {r["doc_id"]: r["score"] for r in want.collect()}
        assert a.keys() == b.keys() and a and all(math.isclose(a[k], b[k], abs_tol=1e-8) for k in a)
        assert (index.bm25([]) if kind == "bm25" else index.tfidf("zzz")).count() == 0


def test_index_by_language(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    index = LexicalIndex(spark, str(tmp_path / "i"), "bm25").fit(docs, "doc_id", "text", "lang")
    assert {(r["lang"], r["n_docs"]) for r in index.table("corpus").collect()} == {("en", 3), ("fr", 1), ("", 1)}
    assert [r["key"] for r in index.bm25(["held"], "en").collect()] == [2] and [r["key"] for r in index.bm25(["held"], "").collect()] == [6]
    empty = LexicalIndex(spark, str(tmp_path / "e"), "tfidf").fit(docs.limit(0), "doc_id", "text")
    assert empty.tfidf("rates").count() == 0


def test_index_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string").write.parquet(path)
    one = fingerprint(spark, path)
    first = index_of(spark, path, "bm25", "doc_id", "text")
    assert index_of(spark, path, "bm25", "doc_id", "text").path == first.path and first.bm25(["held"]).count() == 2
    spark.createDataFrame([(9, "held", "en")], "doc_id long, text string, lang string").write.mode("append").parquet(path)
    assert fingerprint(spark, path) != one and index_of(spark, path, "bm25", "doc_id", "text").bm25(["held"]).count() == 3


CHUNK = "act string, part string, division string, section string, subsection string, paragraph string, citation string, text string, context_prefix string, language string, valid_from string, valid_to string, amending_act string, version_hash string, token_count int, pos int"


def chunks(spark, *texts, act="ITA", language="en"):
    return spark.createDataFrame([(act, "", "", str(i), "", "", f"{act} s.{i}", t, "", language, "2024-01-01", None, "", "", 1, i) for i, t in enumerate(texts)], CHUNK)


def test_load_records_deltas_and_skips_what_is_there(spark, tmp_path):
    out = str(tmp_path / "kept")
    at = lambda d: dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc)
    r = load_statutes(spark, chunks(spark, "a a", "b b", "b b", "c c"), out, "ITA", "en", now=at(1)).first()
    assert (r["chunk_count"], r["chunks_added"], r["chunks_removed"]) == (3, 3, 0)
    load_statutes(spark, chunks(spark, "un", "deux", language="fr"), out, "ITA", "fr", now=at(2))
    r = load_statutes(spark, chunks(spark, "b b", "c c", "d d"), out, "ITA", "en", now=at(3)).first()
    assert (r["chunk_count"], r["chunks_added"], r["chunks_removed"]) == (3, 1, 1)
    again = load_statutes(spark, chunks(spark, "d d", "b b", "c c"), out, "ITA", "en", now=at(4)).collect()
    assert [x["version_id"] for x in again] == [r["version_id"]] and spark.read.parquet(f"{out}/runs").count() == 3
    points = spark.read.parquet(f"{out}/points")
    assert {(x["language"], x["text"]) for x in points.collect()} == {("en", "b b"), ("en", "c c"), ("en", "d d"), ("fr", "un"), ("fr", "deux")}
    assert LexicalIndex(spark, f"{out}/vocabulary", "tfidf").table("corpus").count() == 2


def test_an_interrupted_overwrite_is_recovered(spark, tmp_path):
    path = tmp_path / "t"
    catalog.staged_overwrite(spark, spark.range(3), str(path))
    path.rename(tmp_path / "t.old")  # what a failure between the two renames leaves
    assert catalog.read_or_empty(spark, str(path), spark.range(1).schema).count() == 3
    catalog.staged_overwrite(spark, spark.range(5), str(path))
    assert catalog.read_or_empty(spark, str(path), spark.range(1).schema).count() == 5 and not (tmp_path / "t.old").exists()


def test_catalogue_takes_new_documents_only(spark, tmp_path):
    path = str(tmp_path / "c")
    found = lambda *ids: spark.createDataFrame([(i, "Bank", "minutes", "2024-01-01", f"t {i}", f"u/{i}", "pdf") for i in ids], "doc_id string, institution string, doc_type string, date string, title string, url string, format string")
    assert merge_catalogue(spark, found("a", "b"), path) == 2 and merge_catalogue(spark, found("b", "c"), path) == 1 and merge_catalogue(spark, found("c"), path) == 0
    kept = spark.read.parquet(path)
    assert sorted(r["doc_id"] for r in kept.collect()) == ["a", "b", "c"]
    landed = spark.createDataFrame([("bank/b.pdf",)], "p string")
    assert {r["local_path"] for r in to_download(spark, kept, landed).collect()} == {"bank/a.pdf", "bank/c.pdf"}


def test_two_hops_and_titles(spark):
    schema = "page string, pos int, href string, link_text string"
    listing = spark.createDataFrame([("l", 0, "/news/rate-decision-of-july-15-2026/", "Decision"), ("l", 1, "/news/rate-note-of-may-2-2026/", "Note"), ("l", 2, "/about", "About")], schema)
    hubs = spark.createDataFrame([("https://s.example/news/rate-decision-of-july-15-2026/", 0, "/wp-content/other.pdf", "more"), ("https://s.example/news/rate-decision-of-july-15-2026/", 1, "/x/doc.pdf", "PDF")], schema)
    got = {r["address"]: (r["date"], r["pdf"]) for r in hub_documents(listing, hubs, "rate", "https://s.example", F.lit("slug")).collect()}
    assert len(got) == 2 and str(got["https://s.example/news/rate-decision-of-july-15-2026/"][0]) == "2026-07-15"
    assert got["https://s.example/news/rate-decision-of-july-15-2026/"][1] == "https://s.example/x/doc.pdf" and got["https://s.example/news/rate-note-of-may-2-2026/"][1] is None
    pages = spark.createDataFrame([("a", "<h1 class=x>One <b>two</b>\n three</h1><h1>no</h1>"), ("b", "<p>x</p>"), ("c", None)], "url string, html string")
    assert {r["url"]: r["title"] for r in titled(pages, F.lit("fallback")).collect()} == {"a": "One two three", "b": "fallback", "c": "fallback"}


def test_display(spark):
    df = spark.createDataFrame([(1, 3, "Bank of Somewhere"), (None, 2, "north office"), (None, None, None)], "d int, s int, i string")
    got = [tuple(r) for r in df.select(rank_line(F.col("d"), F.col("s")), badge("i", {"bank of somewhere": "BoS"})).collect()]
    assert got == [("dense #1, sparse #3", "BoS"), ("sparse #2", "NO"), ("", None)]


def test_hints_are_the_same_in_both_forms(spark):
    texts = ["interest on money that was borrowed", "a net capital loss, or rents, royalties", "Principal Residence", "nothing", "maturity date of a retirement savings plan"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(hints_of("t")).collect()] == [topic_hints(t) for t in texts]


def test_each_file_has_its_own_date(spark):
    xml = lambda d: bytearray(f"<S xmlns:l='urn:l' l:pit-date='{d}'/>".encode())
    df = spark.createDataFrame([(xml("2024-01-01"),), (xml("2025-02-02"),), (bytearray(b"<broken"),), (None,)], "content binary")
    assert [r["valid_from"] for r in consolidation_dates(df).collect()] == ["2024-01-01", "2025-02-02", "", ""]


def test_version_diff(spark):
    runs = spark.createDataFrame([("v1", "A", "en", "1"), ("v2", "A", "en", "2"), ("v3", "A", "en", "3"), ("w", "B", "en", "1")], "version_id string, act string, language string, ingested_at string")
    rows = spark.createDataFrame([("v1", "z", "q"), ("v2", "a", "x"), ("v2", "b", "y"), ("v2", "n", None), ("v3", "a", "xx"), ("v3", "c", "y"), ("v3", "n", None), ("w", "a", "x")], "version_id string, citation string, text string")
    got = {(r["act"], r["citation"], r["change"]) for r in catalog.version_diff(rows, runs).collect()}
    assert got == {("A", "a", "changed"), ("A", "b", "removed"), ("A", "c", "added"), ("B", "a", "added")}


@pytest.mark.parametrize("kinds", [("M", "S"), ("S", "M")])
def test_anchors_go_on_from_the_slot_before(spark, kinds):
    ranked = spark.createDataFrame([(i, f"c{i}", f"d{i}", "X", f"2020-01-0{i + 1}", 1.0 - i / 10) for i in range(4)], "slot int, chunk_id string, doc_id string, doc_type string, date string, score double")
    candidates = spark.createDataFrame([(f"{k}{n}", f"{k}{n}", k, f"2021-0{n}-01", "p") for k in "MS" for n in (1, 2)] + [("c0", "d0", "M", "2029-01-01", "p")], "chunk_id string, doc_id string, doc_type string, date string, pos string")
    out = [(r["slot"], r["chunk_id"]) for r in inject_anchors(ranked, candidates, kinds).orderBy("slot").collect()]
    a, b = kinds
    assert out == [(0, f"{b}1"), (1, f"{b}2"), (2, f"{a}1"), (3, f"{a}2")]
