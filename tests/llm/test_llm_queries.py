"""The llm queries that SQL can express against their SQL, and all others for rows, over the smallest tables."""

import datetime as dt
import glob
import math
import os
import re

import pytest

from tidewell.llm.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return "~" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.7g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_counts_of_every_unit(spark, sf):
    """Each dated reading is counted, stated unit or not, against plain Python; ``p7_percentiles`` has the same counts."""
    from tidewell.functions.units import to_common

    want = {}
    for r in spark.read.parquet(f"{sf}/canonical.parquet").collect():
        text = (r["collection_date"] or "").strip()
        try:
            day = dt.datetime.strptime(text, "%m/%d/%Y").date() if "/" in text else dt.date.fromisoformat(text[:10]) if re.fullmatch(r"\d{4}-\d{2}-\d{2}([T ].*)?", text) else None
        except ValueError:
            day = None
        if r["concentration_value"] is None or day is None or not dt.date(2022, 1, 3) <= day <= dt.date(2025, 12, 28):
            continue
        value, unit = to_common(r["concentration_value"], r["concentration_unit"], r["normalization_method"]) or (r["concentration_value"], "no stated unit")
        name = r["target_name"] and r["target_name"].strip().lower()
        for grain, first in (("day", day), ("month", day.replace(day=1))):
            want.setdefault((grain, name, unit, first.isoformat()), []).append(value)
    key = ("grain", "target_name", "common_unit", "period")
    got, shares, unstated = ({tuple(r[k] for k in key): r for r in QUERIES[q](spark, sf).collect()} for q in ("p7_counts_all", "p7_percentiles", "p7_counts"))
    assert got.keys() == want.keys() == shares.keys()
    for k, x in want.items():
        assert got[k]["n"] == len(x) == shares[k]["n"]
        assert math.isclose(got[k]["least"], min(x), rel_tol=1e-9) and math.isclose(got[k]["most"], max(x), rel_tol=1e-9)
    assert {k: r["n"] for k, r in unstated.items()} == {k: len(x) for k, x in want.items() if k[2] == "no stated unit"}
    assert len({k[2] for k in got}) == 4 and sum(r["n"] for r in unstated.values()) < 0.1 * sum(r["n"] for r in got.values())
