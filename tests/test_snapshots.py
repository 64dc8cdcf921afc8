import random

import pytest

from tidewell.operators.snapshots import SnapshotIndex, change_counts, changed_values, snapshot_changes

ROWS = "version_id string, citation string, text string, part string, division string, valid_to string, extra string"
RUNS = "version_id string, act string, language string, ingested_at string, change string"


def brute(rows, runs):
    by = {}
    for v, c, text, *rest in (r[:6] for r in rows):
        by.setdefault(v, {}).setdefault(c, set()).add((None if text is None else " ".join(text.split()), *rest))
    out = set()
    for scope in {r[1:3] for r in runs}:
        order = [r[0] for r in sorted((r for r in runs if r[1:3] == scope), key=lambda r: (r[3], r[0])) if r[0] in by]
        for old, new in zip(order, order[1:]):
            for c in by[old].keys() | by[new].keys():
                a, b = by[old].get(c), by[new].get(c)
                if a != b:
                    out.add((new, c, "added" if a is None else "removed" if b is None else "changed"))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    runs, rows = [], []
    for act in ("A", "B"):
        for k in range(6):
            v = f"{act}{k}"
            runs.append((v, act, "en", f"2024-0{1 + (k * 5) % 6}-01T00:00:00+00:00", "x"))
            if k == 3:
                continue  # a run without rows
            for c in range(40):
                if rng.random() < 0.8:
                    t = f"text {c} {rng.random() < 0.2}"
                    row = (v, f"s.{c}" if c else None, t.replace(" ", rng.choice([" ", "  ", "\n", "\t"])), "1", rng.choice(["A", None, ""]) if c % 9 == 0 else "A", None, "e")
                    rows += [row] * rng.choice([1, 1, 2])
    rows.append((None, "s.1", "t", "1", "A", None, "e"))
    rows.append(("unknown", "s.1", "t", "1", "A", None, "e"))
    got = snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(runs, RUNS))
    assert {tuple(r) for r in got.select("version_id", "citation", "change").collect()} == brute([r for r in rows if r[0]], runs)
    assert got.count() == len(brute([r for r in rows if r[0]], runs))
    assert change_counts(got).count() > 0


def test_change_in_one_of_many_rows_of_a_key(spark, tmp_path):
    runs = [("v1", "A", "en", "2024-01-01T00:00:00+00:00", "x"), ("v2", "A", "en", "2024-02-01T00:00:00+00:00", "x")]
    rows = [("v1", f"s.{c}", f"text {c} {k}", "1", "A", None, "e") for c in range(40) for k in range(12)]
    # in one row of each key but the last ten: another text, one row less, or one row more
    rows += [("v2", f"s.{c}", f"text {c} {k}" + (" new" if c < 10 and k == c else ""), "1", "A", None, "e") for c in range(40) for k in range(12) if not (10 <= c < 20 and k == c - 10)]
    rows += [("v2", f"s.{c}", f"text {c} more", "1", "A", None, "e") for c in range(20, 30)]
    rows += [("v2", "s.39", "text 39 5", "1", "A", None, "e")] * 2  # repeats are no change
    df = spark.createDataFrame(rows, ROWS)
    got = {tuple(r) for r in snapshot_changes(df, spark.createDataFrame(runs, RUNS)).select("version_id", "citation", "change").collect()}
    assert got == brute(rows, runs) == {("v2", f"s.{c}", "changed") for c in range(30)}
    index = SnapshotIndex(spark, str(tmp_path / "i"), ["citation"], ["text", "part"], buckets=4)
    index.swap(df.where("version_id = 'v1'"))
    assert {tuple(r) for r in index.probe(df.where("version_id = 'v2'")).select("citation", "change").collect()} == {(f"s.{c}", "changed") for c in range(30)}


def test_empty_tables(spark):
    assert snapshot_changes(spark.createDataFrame([], ROWS), spark.createDataFrame([], RUNS)).count() == 0


def test_index_probe_fetch_and_swap(spark, tmp_path):
    schema = "citation string, text string, part string"
    index = SnapshotIndex(spark, str(tmp_path / "i"), ["citation"], ["text", "part"], buckets=4)
    first = spark.createDataFrame([("a", "x y", "1"), ("b", "z", "1"), ("c", None, None)], schema)
    assert {tuple(r) for r in index.probe(first).select("citation", "change").collect()} == {("a", "added"), ("b", "added"), ("c", "added")}
    index.swap(first)
    second = spark.createDataFrame([("a", "x  y", "1"), ("b", "zz", "1"), ("d", "q", "1")], schema)
    changes = index.probe(second)
    assert {tuple(r) for r in changes.select("citation", "change").collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    assert [r["text"] for r in index.fetch(changes, first).collect()] == ["z"]
    index.swap(second)
    assert index.probe(second).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_three_rows_a_key_and_runs_that_miss_buckets(spark, parts):
    """Random histories with several distinct rows a key; runs so small that most buckets have no row of them."""
    rng = random.Random(parts)
    runs, rows = [], []
    for act in "ABC":
        for k in range(7):
            v = f"{act}{k}"
            runs.append((v, act, "fr", f"2023-0{k + 1}-01 00:00:00", "x"))
            size = 2 if k in (2, 6) else 60
            for c in rng.sample(range(60), size):
                for j in range(3):
                    rows.append((v, f"s.{c}", f"t {c} {j} {rng.random() < 0.1 and j == 1}", "1", "A", None, "e"))
    df = spark.createDataFrame(rows, ROWS).repartition(parts)
    got = [tuple(r) for r in snapshot_changes(df, spark.createDataFrame(runs, RUNS)).select("version_id", "citation", "change").collect()]
    assert set(got) == brute(rows, runs) and len(got) == len(set(got))


def test_values_are_fetched_for_changed_keys_only(spark):
    runs = spark.createDataFrame([("v1", "A", "en", "2024-01-01 00:00:00", "x"), ("v2", "A", "en", "2024-02-01 00:00:00", "x")], RUNS)
    rows = spark.createDataFrame(
        [("v1", "a", "x  y", "1", "A", None, "e"), ("v2", "a", "x y", "2", "A", None, "e"), ("v1", "b", "q", "1", "A", None, "e"), ("v2", "b", " q", "1", "A", None, "e"), ("v2", "c", "n", "1", "A", None, "e"), ("v1", None, "k", "1", "A", None, "e"), ("v2", None, "k", "1", "A", "2020", "e")],
        ROWS,
    )
    out = changed_values(rows, runs, snapshot_changes(rows, runs)).collect()
    assert {(r["citation"], r["old_text"], r["new_text"], r["old_part"], r["new_part"], r["old_valid_to"], r["new_valid_to"]) for r in out} == {("a", "x y", "x y", "1", "2", None, None), (None, "k", "k", "1", "1", None, "2020")}


def test_a_failure_between_the_writes_leaves_the_old_index(spark, tmp_path):
    schema = "citation string, text string, part string"
    index = SnapshotIndex(spark, str(tmp_path / "i"), ["citation"], ["text", "part"], buckets=4)
    first = spark.createDataFrame([(f"s.{i}", f"t {i}", "1") for i in range(50)], schema)
    second = spark.createDataFrame([(f"s.{i}", f"t {i}", "2") for i in range(40)], schema)
    assert index.current() is None and index.probe(first).count() == 50
    index.swap(first)
    index.write(second)  # the table of the next generation is there, its marker isn't
    assert index.probe(first).count() == 0 and index.probe(second).groupBy("change").count().count() == 2
    index.swap(second)  # what the failed one left is overwritten
    assert index.probe(second).count() == 0 and index.probe(first).count() == 50
    for _ in range(3):
        index.swap(first)
    assert len(index.generations()) == 2 and index.probe(first).count() == 0
    number = index.write(second)
    index.commit(number)
    with pytest.raises(FileExistsError):
        index.commit(number)


def test_an_unreadable_index_is_an_error(spark, tmp_path):
    index = SnapshotIndex(spark, str(tmp_path / "i"), ["citation"], ["text"], buckets=2)
    first = spark.createDataFrame([("a", "x")], "citation string, text string")
    index.swap(first)
    (tmp_path / "i" / "00000009.holds").touch()  # a marker without its table
    with pytest.raises(Exception, match="(?i)path|exist"):
        index.probe(first).count()
