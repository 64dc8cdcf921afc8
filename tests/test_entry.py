"""Every query against its SQL, over the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as e
from tidewell.plans import problems, reference

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.7g}" if isinstance(v, float) else str(v).removesuffix("+00:00")


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(problems.SQL | reference.SQL))
def test_against_sql(spark, sf, con, name):
    df = e.queries()[name](spark, sf)
    cur = con.execute(e.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["p1_found", "p1_faults", "p4_found", "p4_converted", "anchor_injection", "chunk_pack", "strategy_report"])
def test_rows_only(spark, sf, name):
    assert e.queries()[name](spark, sf).count() > 0


def test_units_against_plain_python(spark, sf):
    from tidewell.functions.units import to_common

    from tidewell.operators.units import harmonize_units

    # the query rounds for its SQL; the operator doesn't
    got = {r["row_id"]: (r["common_value"], r["common_unit"]) for r in harmonize_units(spark.read.parquet(f"{sf}/canonical.parquet")).where("common_value is not null").collect()}
    assert got.keys() == {r["row_id"] for r in e.queries()["p4_converted"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/canonical.parquet").collect():
        want = to_common(r["concentration_value"], r["concentration_unit"], r["normalization_method"]) if r["concentration_value"] is not None else None
        assert (r["row_id"] in got) == (want is not None)
        if want:
            assert math.isclose(got[r["row_id"]][0], want[0], rel_tol=1e-9, abs_tol=1e-12) and got[r["row_id"]][1] == want[1]
