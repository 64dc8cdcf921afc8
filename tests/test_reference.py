import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.functions import text as T
from tidewell.functions.dates import any_date
from tidewell.operators import catalog, dense, evaluate, fusion, harmonize, lexical, search, segment


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()[0]


@pytest.mark.parametrize(("text", "want"), [("2025-01-31T00:00:00.000", "2025-01-31"), ("01/31/2025", "2025-01-31"), ("1/5/2025", "2025-01-05"), ("bad", None), (None, None), ("00/00/2023", None), ("2023-02-30", None), (" 2025-01-31 ", "2025-01-31")])
def test_dates(spark, text, want):
    got = one(spark, text, any_date("x"))
    assert (got.isoformat() if got else None) == want


def test_small_functions(spark):
    assert one(spark, " Copies/L Influent ", T.clean_unit("x")) == "copies/l influent" and one(spark, None, T.clean_unit("x")) is None
    assert one(spark, "abc", T.to_float("x")) is None and one(spark, "NaN", T.to_float("x")) is None and one(spark, "1.5", T.to_float("x")) == 1.5
    assert one(spark, "a/monetary20250131a1.pdf", T.date_of_digits("x")) == dt.date(2025, 1, 31)
    assert one(spark, "/x-date-of-july-15-2026/", T.date_of_slug_or_title("x", F.lit(""))) == "2026-07-15"
    assert one(spark, "/x/", T.date_of_slug_or_title("x", F.lit("Date of March 5, 2026"))) == "2026-03-05"
    assert one(spark, "/a/b", T.absolute_url("x", "https://h.example/base")) == "https://h.example/a/b" and one(spark, "b", T.absolute_url("x", "https://h.example/base")) == "https://h.example/base/b"
    assert one(spark, " ".join("w" * 10), T.estimated_tokens("x")) == 13
    assert one(spark, "héllo", T.uuid5("x")) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "héllo"))
    assert one(spark, "½ of gain", T.fraction_words("x")) == "one-half of gain"
    assert one(spark, "Short one. Then more", T.first_sentence("x")) == "Short one." and one(spark, "y" * 250, T.first_sentence("x")) == "y" * 200
    assert one(spark, "20", T.citation(F.lit("ITA"), "x", F.lit("1"), F.lit("c"))) == "ITA s.20(1)(c)" and one(spark, "2", T.citation(F.lit("ITA"), "x", F.lit(""), F.lit(None))) == "ITA s.2"
    assert one(spark, "PART I", T.context_prefix(F.lit("n"), "x", F.lit("A"), F.lit("f"))) == "n [Part PART I, Division A]"
    assert one(spark, "PART I", T.context_prefix(F.lit(""), "x", F.lit(None), F.lit("f"), True)) == "[PART I]"
    assert one(spark, "", T.context_prefix(F.lit(None), "x", F.lit(""), F.lit("f"))) == "f"
    assert one(spark, "rate cuts", T.expanded_tokens(T.search_tokens("x"))) == ["rate", "cuts", "lower", "reduce", "target", "range", "easing", "basis", "points"] == T.expand_tokens(["rate", "cuts"])
    assert one(spark, "a bb cc", T.with_bigrams(T.term_tokens("x"))) == ["bb", "cc", "bb cc"] and one(spark, "", T.with_bigrams(T.term_tokens("x"))) == []
    rows = F.array(F.array(F.col("x"), F.lit(None)), F.array(F.lit(None), F.lit("")), F.array(F.lit("b"), F.lit("c")))
    assert one(spark, "a", T.piped(rows)) == "a | \nb | c"
    assert one(spark, "x" * 451, T.preview("x")) == "x" * 450 + "…"


def test_harmonize(spark):
    conc = spark.createDataFrame([("k1", "2025-01-31", "1.5", "flow-population"), ("k2", "bad", "abc", None), (None, None, None, "microbial")], schemas.FEED_A)
    meta = spark.createDataFrame([("k1", "w1", "j", "c", "1"), ("k1", "w2", "j", "c", "1"), ("k1", "w2", "j", "c", "1"), (None, "w9", "j", "c", "1")], schemas.FEED_A_META)
    out = harmonize.apply_mapping(harmonize.enrich(conc, meta), harmonize.feed_a_mapping())
    assert out.columns == [f.name for f in schemas.CANONICAL]
    got = {(r["site_id"], r["collection_date"], r["concentration_value"], r["concentration_unit"]) for r in out.collect()}
    assert got == {("w1", "2025-01-31", 1.5, "copies/l"), ("w2", "2025-01-31", 1.5, "copies/l"), (None, None, None, "ratio (microbial-normalized)")} and out.count() == 4
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert harmonize.exclude_source(df, "s", "a").count() == 2
    assert {r["value"]: r["n"] for r in harmonize.value_counts(df, "s", True).collect()} == {"a": 1, "b": 1, None: 1}
    assert schemas.drift(df, schemas.VECTOR).count() == 3 and schemas.conform(df, schemas.VECTOR).columns == ["chunk_id", "embedding"]
    assert harmonize.apply_mapping(conc.limit(0), {}).columns == out.columns
    with pytest.raises(ValueError, match="no feed"):
        harmonize.combine(None)


def bm25(docs, q, k1=1.5, b=0.75, eps=0.25):
    import math

    toks = {d: t.lower().split() for d, t in docs if t is not None}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for d, t in toks.items():
        for w in q:
            if tf := t.count(w):
                out[d] = out.get(d, 0) + idf[w] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
    return out


def test_bm25_against_python(spark):
    docs = [(1, "rate cut rate the"), (2, "the policy rate"), (3, "The"), (4, None), (5, ""), (6, "policy policy the the the")]
    q = ["rate", "the", "rate", "missing"]
    got = {r["doc_id"]: r["score"] for r in lexical.bm25_scores(spark.createDataFrame(docs, "doc_id long, text string"), q).collect()}
    want = bm25(docs, q)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert lexical.bm25_scores(spark.createDataFrame(docs, "doc_id long, text string"), []).count() == 0
    assert lexical.tfidf_scores(spark.createDataFrame(docs, "doc_id long, text string"), "unknown").count() == 0


def test_fusion_boost_dedup_and_caps(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, rank int")
    s = spark.createDataFrame([("a", 3), ("c", 1)], "chunk_id string, rank int")
    got = {r["chunk_id"]: r["score"] for r in fusion.fuse(d, s, "chunk_id").collect()}
    assert abs(got["a"] - (1 / 61 + 1 / 63)) < 1e-12 and abs(got["c"] - 1 / 61) < 1e-12
    zero = {r["chunk_id"]: r["score"] for r in fusion.fuse(d, s, "chunk_id", 2, 0).collect()}
    assert abs(zero["a"] - (1 / 2 + 1 / 4)) < 1e-12
    swapped = {r["chunk_id"]: r["score"] for r in fusion.fuse(s, d, "chunk_id").collect()}
    assert swapped == got
    b = fusion.boost(fusion.fuse(d, s, "chunk_id"), F.col("chunk_id"), ["c"])
    assert fusion.best_per_document(b.withColumn("doc", F.lit("x")), "doc", "chunk_id", 5).first()["chunk_id"] == "c"
    flood = spark.createDataFrame([("d1", f"c{i}", 1.0 / (i + 1)) for i in range(5)] + [("d2", "z", 0.01)], "doc string, c string, score double")
    assert [r["c"] for r in lexical.capped_top(flood, F.col("doc"), [F.desc("score"), F.col("c")], 2, 30).collect()] == ["c0", "c1", "z"]
    r = fusion.blend(spark.createDataFrame([("a", 0.5, 0.0), ("b", 1.0, 0.0), ("c", 0.2, None)], "k string, score double, logit double"))
    assert {x["k"]: x["blended"] for x in r.collect()} == {"a": 0.5, "b": 0.85, "c": 0.2}


@pytest.mark.parametrize(("n", "want"), [(5, [0, 1, 2, 3, 4]), (6, [1, 2, 3, 5]), (13, [4, 5, 6, 7, 12]), (14, [5, 6, 7, 8, 13])])
def test_checkpoints(spark, n, want):
    assert fusion.checkpoint_positions(n) == want
    dates = spark.createDataFrame([(f"2025-01-{i + 1:02d}",) for i in range(n)] * 2, "d string")
    assert sorted(int(r["d"][-2:]) - 1 for r in fusion.checkpoints(dates, "d").collect()) == want


def test_anchors(spark):
    ranked = spark.createDataFrame([(0, "r0", "x0", "Other", "2025-01-01", 3.0), (1, "r1", "x1", "Other", "2025-01-02", 2.0), (2, "r2", "x2", "Other", "2025-01-03", 1.0)], "slot int, chunk_id string, doc_id string, doc_type string, date string, score double")
    schema = "chunk_id string, doc_id string, doc_type string, date string, pos int"
    many = [(f"a{i}", f"da{i}", "A", f"2025-02-0{i + 1}", i) for i in range(5)]
    got = {r["slot"]: r["chunk_id"] for r in fusion.inject_anchors(ranked, spark.createDataFrame([*many, ("b", "db", "B", "2025-03-01", 9)], schema), ("A", "B")).collect()}
    assert got == {2: "a4", 1: "a3", 0: "a2"}  # newest first, and no slot is left for the second kind
    got = {r["slot"]: r["chunk_id"] for r in fusion.inject_anchors(ranked, spark.createDataFrame([("a", "da", "A", "2025-02-01", 2), ("a0", "da", "A", "2025-02-01", 1), ("b", "db", "B", "2025-03-01", 9)], schema), ("A", "B")).collect()}
    assert got == {0: "r0", 2: "a0", 1: "b"}
    with_a = ranked.withColumn("doc_type", F.when(F.col("slot") == 0, "A").otherwise(F.col("doc_type"))).withColumn("date", F.when(F.col("slot") == 0, "2025-09-01").otherwise(F.col("date")))
    got = {r["slot"]: r["chunk_id"] for r in fusion.inject_anchors(with_a, spark.createDataFrame(many, schema), ("A",)).collect()}
    assert got == {0: "r0", 1: "r1", 2: "r2"}  # the newest is ranked already


def pack(paras, limit=1600):
    import re

    def first(t):
        m = re.match(r"(?s)(.*?[.!?])(?:\s|$)", t)
        return m[1] if m and len(m[1]) <= 200 else t[:200]

    out, buf, size, page = [], [], 0, None
    for p, t in paras:
        if buf and size + len(t) > limit:
            out.append((page, "\n\n".join([*buf, first(t)])))
            buf, size = [], 0
        if not buf:
            page = p
        buf.append(t)
        size += len(t)
    return out + ([(page, "\n\n".join(buf))] if buf else [])


def test_packing_against_python(spark):
    import random

    rng = random.Random(0)
    docs = [(i, [(1 + k // 3, ("word. " * rng.randrange(4, 400)).strip()) for k in range(rng.randrange(0, 12))]) for i in range(30)] + [(99, [(1, "x" * 5000)]), (98, [(1, "a" * 1000), (1, "b" * 700), (2, "c" * 100)])]
    df = spark.createDataFrame(docs, "doc_id long, paras array<struct<page_num:int,text:string>>")
    got = {}
    for r in segment.pack_paragraphs(df, ["doc_id"], doc="doc_id").orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r["doc_id"], []).append((r["page_num"], r["text"]))
    assert got == {i: pack(p) for i, p in docs if p}


def test_boxes_and_headings(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (1, 5.0, 5.0, 6.0, 6.0), (2, 0.0, 0.0, 1.0, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([(1, 1.0, 0.0, 2.0, 1.0), (1, 5.5, 5.5, 9.0, 9.0)], b.schema)
    assert {(r["page"], r["x0"]) for r in segment.outside_tables(b, t).collect()} == {(1, 0.0), (2, 0.0)}
    n = spark.createDataFrame([("d", 0, 1, "I"), ("d", 1, 2, "A"), ("d", 2, 0, "s"), ("d", 3, 1, "II"), ("d", 4, 0, "s"), ("d", 5, 3, "z")], "doc_id string, pos int, level int, label string")
    got = {r["pos"]: (r["part"], r["division"]) for r in segment.running_headings(n).collect()}
    assert got[2] == ("I", "A") and got[4] == ("II", None) and got[5] == ("II", None)


def test_catalogue(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in catalog.upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert tuple(catalog.delta_sizes(spark.createDataFrame([("b",), ("c",), ("d",), (None,)], "h string"), spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "h string"), "h").first()) == (1, 1, 2)
    points = catalog.content_points(spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "text string, pos int"))
    assert {(r["text"], r["pos"]) for r in points.collect()} == {("t", 2), ("u", 3)}
    assert catalog.purge(spark.createDataFrame([("x", "en"), ("x", None), ("y", "en")], "act string, language string"), act="x", language="en").count() == 2
    runs = spark.createDataFrame([("1", "A", "en", "2024-01-01", 5, 2, "h"), ("2", "A", "en", "2024-02-01", 6, 1, "g"), ("3", "B", "fr", "2023-01-01", 1, 1, "h")], "version_id string, act string, language string, ingested_at string, chunk_count int, chunks_added int, version_hash string")
    assert {r["version_id"] for r in catalog.versions(runs).collect() if r["is_current"]} == {"2", "3"}
    assert [r["version_id"] for r in catalog.versions(runs, "A", "en").collect()] == ["2", "1"]
    assert catalog.version_exists(runs, "h", "A", "en") and not catalog.version_exists(runs, "h", "B", "en")
    rows = spark.createDataFrame([("2020-01-01", None), ("2020-01-01", "2021-01-01"), ("2023-01-01", None)], "valid_from string, valid_to string")
    assert catalog.valid_on(rows, "2022-01-01").count() == 1
    path = str(tmp_path / "t")
    assert catalog.read_or_empty(spark, path, old.schema).count() == 0
    catalog.staged_overwrite(spark, old, path)
    catalog.staged_overwrite(spark, catalog.upsert(catalog.read_or_empty(spark, path, old.schema), new, ["k"]), path)
    assert catalog.read_or_empty(spark, path, old.schema).count() == 3
    assert catalog.health(old.limit(0), runs).first()["status"] == "empty"


def test_evaluation(spark):
    items = spark.createDataFrame([(1, ["ITA s.5"], "t"), (2, ["ITA s.9(1)"], "t"), (3, [], "u"), (4, None, None)], "item_id long, expected_citations array<string>, topic string")
    results = spark.createDataFrame([(1, "ITA s.50(1)", 1), (2, "x", 1), (2, "ita  s.9(1)(a)", 4), (3, "ITA s.1", 1)], "item_id long, citation string, rank int")
    hits = evaluate.first_hits(results, items)
    assert {r["item_id"]: r["rank"] for r in hits.collect()} == {1: 1, 2: 4, 3: 0, 4: 0}
    assert {r["item_id"]: r["rank"] for r in evaluate.first_hits(results, items, strict=True).collect()}[1] == 0
    overall = {r["topic"]: r for r in evaluate.report(hits, items).collect()}
    assert overall["overall"]["recall_at_k"] == 0.25 and overall["overall"]["mrr"] == 0.3125 and overall["t"]["n"] == 2
    assert not evaluate.meets(evaluate.report(hits, items)) and evaluate.failures(hits, items).count() == 3


def test_search_chains(spark):
    chunks = spark.createDataFrame(
        [(f"c{i}", f"d{i // 2}", "I", "A" if i == 9 else "O", f"2025-01-{i + 1:02d}", i, f"policy rate cut number {i} " + "word " * i, 1, "T", "en", "ITA", "2020-01-01", None) for i in range(10)],
        "chunk_id string, doc_id string, institution string, doc_type string, date string, pos int, text string, page_num int, title string, language string, act string, valid_from string, valid_to string",
    )
    vectors = spark.createDataFrame([(f"c{i}", [1.0, float(i)]) for i in range(10)], "chunk_id string, embedding array<double>")
    out = search.hybrid_search(chunks, vectors, "rate cuts", [1.0, 0.0], top_n=4, anchors=("A",)).collect()
    assert [r["slot"] for r in out] == [0, 1, 2, 3] and len({r["doc_id"] for r in out}) == 4 and any(r["doc_type"] == "A" for r in out)
    late = search.hybrid_search(chunks, vectors, "rate cuts", [1.0, 0.0], date_from="2025-01-05", doc_type="O").collect()
    assert late and all(r["date"] >= "2025-01-05" for r in late)
    st = search.statute_search(chunks, vectors, "policy rate", [1.0, 0.0], 3, act="ITA", logits=spark.createDataFrame([("c5", 9.0)], "chunk_id string, logit double")).collect()
    assert len(st) == 3 and st[0]["score"] >= st[1]["score"]
    assert search.statute_search(chunks, vectors, "policy", [1.0, 0.0], 3, as_of="1900-01-01").count() == 3 and search.statute_search(chunks, vectors, "policy", [1.0, 0.0], 3, as_of="1900-01-01", enforce_as_of=True).count() == 0
    text = search.prompt(search.hybrid_search(chunks, vectors, "rate", [1.0, 0.0], top_n=2), "Why?").first()[0]
    assert text.startswith("Sources:\n\n[1] I | ") and text.endswith("Question: Why?") and "\n\n---\n\n[2]" in text
    assert "one-half half" in search.expand_query("Which fraction?") and "Definition of 'income'" in search.expand_query("define income under the act")
    assert search.validate_request("q", 50, clamp=True)["top_k"] == 20
    for bad in ({"query": ""}, {"query": "q", "top_k": 0}, {"query": "q", "language": "xx"}, {"query": "q", "as_of": "x"}):
        with pytest.raises(ValueError):
            search.validate_request(**bad)


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["score"] for r in dense.similar(v, [2.0, 0.0]).collect()} == {1: 1.0, 4: -1.0}
