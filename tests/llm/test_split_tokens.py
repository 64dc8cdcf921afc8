import random

import pytest

from tidewell.llm.split import cuts, pieces, renumbered, split_oversized
from tidewell.llm.tokens import clean_language, distinct_counts, estimate_tokens, label_table, token_counts, token_totals, tokenizer, wrong_counts, TOKENIZER_DIR, VOCABULARY

CHUNK = "chunk_id string, doc_id string, text string, page_num int, chunk_idx int, h string"


def text_of(seed, n):
    rng = random.Random(seed)
    out = []
    while sum(map(len, out)) + len(out) < n:
        out.append("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", "", ".", ",", ".\n", "\n\n", "\f"]))
    return " ".join(out)[:n].strip()


@pytest.mark.parametrize("seed", range(12))
def test_pieces_cover_in_order_within_the_limit(seed):
    text = text_of(seed, random.Random(seed).randrange(1601, 30_000))
    got = pieces(text)
    assert got[0][0] == got[0][1] == 0 and got[-1][2] == len(text)
    for (_, _, end), (start, cut, _) in zip(got, got[1:]):
        assert cut == end and 0 <= cut - start <= 200
    assert all(len(text[s:e]) <= 1600 for s, _, e in got)
    assert "".join(text[c:e] for _, c, e in got) == text  # round trip
    assert all(text[e - 1].isspace() or e == len(text) for _, _, e in got)  # a text with blanks is cut at blanks
    assert sum(c > s for s, c, _ in got[1:]) >= len(got) // 2


def test_strong_boundaries_are_preferred():
    sentence = "word " * 30 + "end. "
    text = (sentence * 5 + "\n\n") * 3
    marks = {text[c - 2 : c] for c in cuts(text)[1:-1]}
    assert marks == {"\n\n"}


def test_no_white_space_and_very_long_texts():
    assert all(e - s <= 1600 for s, _, e in pieces("x" * 50_000))
    long = text_of(1, 400_000)
    assert all(e - s <= 1600 for s, _, e in pieces(long))
    half = "x" * 40_000 + " " + "y" * 3
    assert "".join(half[c:e] for _, c, e in pieces(half)) == half


@pytest.mark.parametrize(("head", "tail"), [("a" * 1599, "b" * 20), ("a" * 20, "b" * 1599), ("a " * 5, "b" * 1595), ("a" * 1390 + " x", "b " * 10)])
def test_a_boundary_near_an_end_is_taken_if_the_pieces_are_legal(head, tail):
    text = head + " " + tail
    got = pieces(text.strip())
    assert all(len(text[s:e]) <= 1600 for s, _, e in got)
    assert all(text[e - 1].isspace() or e == len(text.strip()) for _, _, e in got)


@pytest.mark.parametrize("seed", range(6))
def test_only_words_over_the_limit_are_cut(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 8, 300, 1400, 1700, 5000]))) for _ in range(60)]
    text = " ".join(words)
    ends = {0}
    for w in words:
        ends.add(min(len(text), max(ends) + len(w) + 1))
    long = [(sum(len(x) + 1 for x in words[:k]), len(w)) for k, w in enumerate(words) if len(w) > 1600]
    for c in cuts(text)[1:-1]:
        assert c in ends or any(at < c < at + n for at, n in long), c


def test_many_boundaries_at_both_ends_of_an_endless_word():
    text = "a " * 20_000 + "x" * 200_000 + " b" * 20_000
    got = pieces(text)
    assert all(e - s <= 1600 for s, _, e in got) and "".join(text[c:e] for _, c, e in got) == text


def test_rows(spark):
    body = "a b. " * 500 + "\f" + "c d. " * 500
    data = [("1", "d", "  " + body + "\n", 3, 7, "q"), ("1", "d", "  " + body + "\n", 3, 7, "q"), ("2", "d", "x" * 1600, 1, 1, "q"), ("3", "d", None, 1, 1, "q"), ("4", "d", " " * 3000 + "x", 1, 1, "q"), ("5", None, "é" * 1601, 0, None, None)]
    out = split_oversized(spark.createDataFrame(data, CHUNK)).orderBy("chunk_id", "chunk_idx").collect()
    assert {r["chunk_id"] for r in out} == {"1", "5"}
    one = [r for r in out if r["chunk_id"] == "1"]
    assert [r["chunk_idx"] for r in one] == list(range(len(one))) and one[0]["page_num"] == 3 and one[-1]["page_num"] == 4 and one[0]["source_chunk_idx"] == 7
    assert all(0 < len(r["text"]) <= 1600 for r in out) and [r for r in out if r["chunk_id"] == "5"][0]["page_num"] == 0
    assert split_oversized(spark.createDataFrame([], CHUNK)).count() == 0


def test_numbers_run_through_the_document(spark):
    long = "word " * 1000
    data = [("a", "d", "short", 1, 0, None), ("b", "d", long, 1, 1, None), ("b", "d", long, 1, 1, None), ("c", "d", None, 1, 2, None), ("e", "d", long, 1, 3, None), ("f", None, long, 1, None, None)]
    df = spark.createDataFrame(data, CHUNK)
    for block in (1, 2, 1024):
        out = renumbered(df, split_oversized(df), block).collect()
        n = sum(r["chunk_id"] == "b" for r in out)
        assert n == 4 and sorted(r["chunk_idx"] for r in out if r["doc_id"] == "d") == [*range(1, 1 + n), *range(2 + n, 2 + 2 * n)]
        assert sorted(r["chunk_idx"] for r in out if r["chunk_id"] == "f") == list(range(n))


TEXTS = "id long, text string, h string, token_count int"


def test_counts_are_exact_and_joined_back(spark):
    texts = ["a b c", "a b c", "Der Leitzins stieg.", "", " \n ", None, "word " * 30_000, "x" * 150_000]
    data = [(i, t, "clash", None if i == 0 else estimate_tokens(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, TEXTS)
    encode = tokenizer(f"{TOKENIZER_DIR}/{VOCABULARY}")
    got = {r["id"]: r for r in token_counts(df, ["id", "h"]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts[:7]):
        assert got[i]["n_tokens"] == (len(encode(t)) if t else 0) and got[i]["n_estimate"] == int(len((t or "").split()) * 1.3)
    assert distinct_counts(df, keys=["id"]).select("h").distinct().count() == 6
    assert [r["id"] for r in wrong_counts(df, ["id"]).collect()] == [0]
    assert token_counts(spark.createDataFrame([], TEXTS), ["id"]).count() == 0


@pytest.mark.parametrize("sep", ["\n", " ", "\t\t", "  \n"])
def test_long_texts_are_tokenized_whole(sep):
    """Lines of one kind, of which each is known to have the same tokens, over and under 100,000 characters."""
    encode = tokenizer(f"{TOKENIZER_DIR}/{VOCABULARY}")
    unit = f"tokens{sep}"
    base, more = len(encode(unit * 100)), len(encode(unit * 101))
    assert len(encode(unit * 25_000)) == base + (25_000 - 100) * (more - base)
    assert len(encode("x" * 300_000)) > 0 and len(encode(" " * 300_000)) > 0


def test_hot_texts_are_spread_over_their_keys(spark):
    """Copies of a text meet its count in as many groups as there are salts, and no text is sent more than once a task."""
    from pyspark.sql import functions as F

    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "the same text").when(F.col("id") % 3 == 1, F.concat(F.lit("t "), "id")).alias("text")).repartition(3)
    counts = distinct_counts(df, keys=["id"])
    pairs = counts.groupBy("h").agg(F.count("*").alias("n"), F.countDistinct("salt").alias("s"), F.countDistinct("n_tokens").alias("t")).collect()
    assert max(r["n"] for r in pairs) == max(r["s"] for r in pairs) > 16 and {r["t"] for r in pairs} == {1}
    got = {r["id"]: r["n_words"] for r in token_counts(df, ["id"]).collect()}
    assert len(got) == 2000 and all(n == (3, 2, 0)[i % 3] for i, n in got.items())


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["Bank of North", "BANK OF NORTH", "The Bank of North", "Bank  of North", "Bank of North", "BoN", "BN", "Other Office", None, ""]], "i string")
    got = {r["key"]: r["label"] for r in label_table(df, "i").collect()}
    assert got["bon"] == got["bank of north"] == "Bank of North" and got["other office"] == "Other Office"
    langs = spark.createDataFrame([(x,) for x in ["en", " EN", "eng", "en-XX", "fra", "und", None, "", "xx"]], "l string").select(clean_language("l" and __import__("pyspark").sql.functions.col("l")).alias("c")).collect()
    assert [r["c"] for r in langs] == ["en", "en", "en", "en", "fr", "und", "und", "und", "xx"]


def test_totals_by_multiplicity(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("s", "a b")] * 50 + [("s", "c"), ("t", "a b"), ("t", None)], "source string, text string")
    got = {r["source"]: r for r in token_totals(df, {"source": F.col("source")}).collect()}
    assert got["s"]["n_texts"] == 51 and got["s"]["n_distinct"] == 2 and got["s"]["n_tokens"] == 50 * 2 + 1 and got["t"]["n_texts"] == 2 and got["t"]["n_tokens"] == 2
