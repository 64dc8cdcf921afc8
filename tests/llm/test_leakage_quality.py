import random

import numpy as np
import pytest

from tidewell.llm.boosting import Boosted
from tidewell.llm.holdout import labelled
from tidewell.llm.leakage import LeakRules, SeedIndex, leaked, matches, normal_words, tile
from tests.llm.hand_labels import JUNK, PROSE
from tidewell.llm.quality import COUNTS, STATS, _votes, count_matrix, fit, junk_texts, matrix, mixtures, probability, ratios, statistics, text_quality, train, weak_labels

RNG = random.Random(9)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 8))) for _ in range(3000)]


def prose(n, rng):
    return [rng.choice(VOCAB) for _ in range(n)]


def brute_matches(a, b, n):
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] and a[i] == b[j] and not (i and j and a[i - 1] and a[i - 1] == b[j - 1]):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and a[i + k]:
                    k += 1
                if k >= n:
                    out.add((k, i, j))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_matches_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 4, 40), rng.integers(0, 4, 60)
    assert set(matches(a, b, 3)) == brute_matches(list(a), list(b), 3)


def test_tiles_do_not_overlap_and_bridge_single_words():
    a = np.arange(1, 41)
    b = a.copy()
    b[10] = 99  # altered
    b = np.delete(b, 20)  # missing
    b = np.insert(b, 30, 98)  # added
    assert tile(a, b, 3, 10).sum() == 38
    twice = np.concatenate([a[:12], a[:12]])
    assert tile(twice, a[:12], 3, 10).sum() == 12  # one copy covers one stretch
    assert tile(a, np.concatenate([a[20:], np.zeros(1, int), a[:20]]), 3, 10).all()  # reordered
    assert not tile(a, np.concatenate([a[:8], [77, 78], a[8:16]]), 3, 10).any()  # short phrases


def test_normal_words():
    assert normal_words("Élan, d'été — 63,690 (One-off)\nx") == [b"elan", b"dete", b"63690", b"oneoff", b"x"]
    assert normal_words("Ω œuvre été")[-1] == b"ete" and normal_words("") == []


def test_copies_without_five_intact_words(spark):
    rng = random.Random(3)
    p = [prose(100, rng) for _ in range(3)]
    fifth = [w if k % 5 else "zzz" for k, w in enumerate(p[0])]
    part = [w if k % 4 else "zzz" for k, w in enumerate(p[1][:60])]
    docs = [(1, " ".join(prose(80, rng) + fifth + prose(80, rng))), (2, " ".join(prose(80, rng) + part)), (3, " ".join(w if k % 3 else "zzz" for k, w in enumerate(p[2])))]
    items = [(i + 1, " ".join(x)) for i, x in enumerate(p)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    assert {(r["item_id"], r["doc_id"]) for r in leaked(d, i).collect()} == {(1, 1), (2, 2)}


@pytest.mark.parametrize("pairs", [1, 50, 1_000_000])
def test_every_pair_that_tiles_to_the_share_is_scanned(pairs):
    rng = random.Random(5)
    few = VOCAB[:12]  # chance seeds everywhere
    items = [(i, [rng.choice(few).encode() for _ in range(40)]) for i in range(12)]
    texts = []
    for _ in range(60):
        words = rng.choice(items)[1]
        texts.append([w if rng.random() > 0.25 else rng.choice(VOCAB).encode() for w in words])
    index = SeedIndex(items, LeakRules(pairs=pairs))
    scanned = {(d, i): ids for d, i, ids in index.scan(texts)}
    whole = {(d, i) for d, t in enumerate(texts) for i in range(len(items)) if index.coverage(i, np.array([index.vocabulary.get(w, 0) for w in t]))[0] >= 0.4}
    assert whole and whole <= set(scanned)


def test_leaks(spark):
    rng = random.Random(1)
    items = [(i, " ".join(prose(100, rng))) for i in range(1, 8)]
    p = [x[1].split() for x in items]
    fill = lambda n: prose(n, rng)
    altered = p[2][:]
    for k in range(6, 100, 9):
        altered[k] = "zzz"
    docs = [
        (1, " ".join(fill(300) + p[0] + fill(300))),
        (2, " ".join(fill(50) + p[1][60:] + fill(20) + p[1][:40])),
        (3, " ".join(altered).upper() + "!"),
        (4, " ".join(fill(100) + p[3][:38] + fill(100))),
        (5, "\n".join(", ".join(p[4][i : i + 7]) for i in range(0, 100, 7))),
        (6, " ".join(w for k in range(0, 100, 6) for w in p[5][k : k + 6] + ["aa", "bb"])),
        (7, None), (8, "  "), (9, " ".join(fill(100_000) + p[6])), (10, " ".join(p[0])), (10, " ".join(p[0])), (None, " ".join(p[0])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS coverage", "2 AS item")
    i = spark.createDataFrame([*items, items[0], (99, None), (98, ""), (97, "too short")], "item_id long, passage string")
    want = {(1, 1), (2, 2), (3, 3), (5, 5), (7, 9), (1, 10), (1, None)}
    for block in (2000, 3):
        got = leaked(d, i, rules=LeakRules(block=block))
        assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == want and got.count() == len(want)
    assert leaked(d.limit(0), i).count() == 0 and leaked(d, i.limit(0)).count() == 0


def pairs_of(spark, docs, items, **rules):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    return {(r["item_id"], r["doc_id"]) for r in leaked(d, i, rules=LeakRules(**rules)).collect()}


def test_stock_is_counted_over_all_items_whatever_the_blocks(spark):
    rng = random.Random(2)
    stock = prose(50, rng)
    own = [prose(50, rng) for _ in range(4)]
    items = [(i, " ".join(stock + own[i])) for i in range(4)] + [(i, " ".join(prose(90, rng))) for i in range(4, 8)]
    docs = [(1, " ".join(prose(30, rng) + stock)), (2, " ".join(prose(30, rng) + own[1] + prose(20, rng))), (3, items[2][1]), (4, items[6][1])]
    want = {(1, 2), (2, 3), (6, 4)}  # the stock half alone is no case; the other half, and all of it, are
    for block in (2, 3, 2000):
        assert pairs_of(spark, docs, items, block=block) == want
    assert pairs_of(spark, docs, items[::-1], block=3, chunk=200) == want


def test_equal_and_near_equal_items_are_each_reported(spark):
    rng = random.Random(4)
    p, q = prose(80, rng), prose(80, rng)
    near = [[w if k != j else "zzz" for k, w in enumerate(q)] for j in (20, 41, 60)]
    items = [(i, " ".join(p)) for i in (1, 2, 3)] + [(i + 4, " ".join(x)) for i, x in enumerate(near)] + [(9, " ".join(prose(80, rng)))]
    docs = [(1, " ".join(prose(40, rng) + p)), (2, " ".join(p[:45] + prose(200, rng))), (3, " ".join(prose(60, rng) + q)), (4, " ".join(q[:50]))]
    want = {(i, d) for i in (1, 2, 3) for d in (1, 2)} | {(i, d) for i in (4, 5, 6) for d in (3, 4)}
    for block in (2, 2000):
        assert pairs_of(spark, docs, items, block=block) == want


@pytest.mark.parametrize("every", [4, 5, 6, 8])
def test_recall_with_single_altered_words(every):
    """Passages of 80 words of which 60 percent is copied, every n-th word altered: all of them reach the share."""
    rng = random.Random(every)
    found = 0
    for _ in range(50):
        p = [w.encode() for w in prose(80, rng)]
        copied = [w if k % every else b"zzz" for k, w in enumerate(p[:48])]
        index = SeedIndex([(1, p)], LeakRules())
        fill = [w.encode() for w in prose(100, rng)]
        found += any(True for _ in index.cases([fill + copied + fill]))
    assert found >= 45


def test_statistics_by_hand():
    s = dict(zip(STATS, statistics("The cat sat on the mat. It was warm.\n\nA list:\n- one\n- two")))
    assert s["n_words"] == 15 and s["n_lines"] == 4 and s["n_blocks"] == 2 and s["item_line_ratio"] == 0.5 and s["ended_line_ratio"] == 0.5
    assert statistics("  \n ")[1:] == (0.0,) * (len(STATS) - 1)
    assert len(statistics("x" * 1_000_000)) == len(STATS)


def test_counts_add_up():
    a, b = "The cat sat on the mat. It was warm.", "| x | 4 |\n| y | 5 |\n- one\n- two"
    both = count_matrix([a + "\n\n" + b])[0]
    parts = count_matrix([a, b]).sum(0)
    differ = {c for c, x, y in zip(COUNTS, both, parts) if x != y}
    assert differ <= {"length", "distinct"}
    c, y = mixtures(count_matrix([a, b]), np.array([1, 0]), 200)
    share = c[:, COUNTS.index("figure_chars")] / c[:, COUNTS.index("chars")]
    assert set(y) == {0.0, 1.0} and share[y == 1].max() < share[y == 0].min()


def test_weak_labels_agree_with_hand_labels():
    texts, hand = labelled()
    y = weak_labels(matrix(texts))
    sure = y >= 0
    assert 0.5 < sure.mean() < 1 and (y[sure] == np.array(hand)[sure]).mean() >= 0.97


@pytest.fixture(scope="module")
def hand():
    """Counts of hand-labelled documents, their labels, and a model that was fitted on others."""
    pytest.importorskip("pandas")
    import os

    import pandas as pd

    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the labelled documents aren't here")
    d = pd.read_parquet(path, columns=["doc_id", "text"])
    d = d[d.text.notna() & (d.text.fillna("").str.strip() != "")]
    checked = d.doc_id.isin(PROSE | JUNK)
    others = d[~checked].sort_values("doc_id").iloc[::3]
    model = fit(count_matrix(others.text.tolist()))
    held = d[checked]
    return held.doc_id.to_numpy(), count_matrix(held.text.tolist()), held.doc_id.isin(PROSE).to_numpy(), model


def test_hand_labelled_documents(hand):
    ids, c, prose, model = hand
    p = probability(model, ratios(c))
    assert len(ids) == len(PROSE | JUNK)
    assert ((_votes(ratios(c)) == 0).sum(0) > 0).all()  # each weak function abstains on some
    print("accuracy", ((p >= 0.5) == prose).mean(), "Brier", np.mean((p - prose) ** 2))
    assert ((p >= 0.5) == prose).mean() >= 0.98
    assert (p[~prose] < 0.5).mean() >= 0.97 and np.mean((p - prose) ** 2) <= 0.02


def test_trees_are_none_of_the_weak_functions(hand):
    """Each function alone, an abstention counted as prose, errs on documents that the trees have right."""
    ids, c, prose, model = hand
    right = (probability(model, ratios(c)) >= 0.5) == prose
    for k, vote in enumerate(_votes(ratios(c)).T):
        wrong = right & ((vote >= 0) != prose)
        assert wrong.any(), k
    # a list of phrases with common words, a mixture with more table than prose, prose in capitals
    named = {3319: False, 8738: False, 7002: False, 4937: True}
    at = {int(i): k for k, i in enumerate(ids)}
    for i, is_prose in named.items():
        assert (probability(model, ratios(c))[at[i]] >= 0.5) == is_prose, i


def test_mixtures_by_share(hand):
    """Prose and tables of hand-labelled documents put together: off a half by a tenth and more the trees are right."""
    _, c, prose, model = hand
    mc, my = mixtures(c, prose.astype(int), 2000, seed=99)
    p = probability(model, ratios(mc))
    assert ((p >= 0.5) == my).mean() >= 0.9


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted().fit(x[:2000], y[:2000]).calibrate(x[2000:2500], y[2000:2500])
    p = m.probability(x[2500:])
    assert ((p >= 0.5) == y[2500:]).mean() > 0.95
    assert abs(p.mean() - y[2500:].mean()) < 0.05


def test_quality_rows(spark):
    texts, hand = labelled()
    data = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, " \n", "x"), (902, texts[0], "x"), (902, texts[0], "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, p_prose string")
    out = text_quality(df).collect()
    assert len(out) == len(texts) + 2 and sum(r["doc_id"] == 902 for r in out) == 2
    right = [r["is_prose"] == bool(hand[r["doc_id"]]) for r in out if r["doc_id"] < 900]
    assert sum(right) / len(right) >= 0.95
    assert {r["doc_id"] for r in junk_texts(df).collect()} == {i for i, y in enumerate(hand) if not y}
    assert text_quality(df.limit(0)).count() == 0


def test_small_table_trains_on_the_holdout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train(docs, sample=60)
    x = matrix([r["text"] for r in docs.where("text is not null").collect() if r["text"].strip()])
    y = weak_labels(x)
    assert ((probability(model, x[y >= 0]) >= 0.5) == y[y >= 0]).mean() > 0.95
