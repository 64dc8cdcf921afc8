import datetime as dt
import math
import random
import re

from tidewell.operators.grid import missing_weeks, regular_weeks

SCHEMA = "key_plot_id string, target_name string, collection_date string, concentration_value double, w int"


def test_against_brute_force(spark):
    rng = random.Random(2)
    data = []
    for p in ("a", "b", None):
        for _ in range(60):
            d = dt.date(2022, 1, 3) + dt.timedelta(rng.randrange(0, 1450))
            text = rng.choice([d.isoformat(), d.strftime("%m/%d/%Y"), d.isoformat() + "T00:00:00.000", "TBD", "2099-01-01", None]) if rng.random() < 0.3 else d.isoformat()
            data.append((p, rng.choice(["rsv", " RSV "]), text, rng.choice([1.0, 2.0, None, float("nan")]), 1))
    data += data[:10]
    seen = {}
    for p, t, text, v, _ in data:
        if v is None or v != v or text in (None, "TBD", "2099-01-01"):
            continue
        d = dt.datetime.strptime(text[:10], "%m/%d/%Y" if "/" in text else "%Y-%m-%d").date()
        if d <= dt.date(2025, 12, 28):
            seen.setdefault(p, {}).setdefault(d - dt.timedelta(d.weekday()), []).append(v)
    want = {}
    for p, weeks in seen.items():
        w = min(weeks)
        while w <= max(weeks):
            want[p, w.isoformat()] = weeks.get(w)
            w += dt.timedelta(7)
    df = spark.createDataFrame(data, SCHEMA)
    for shard in (1, 5, 26):
        got = {(r["key_plot_id"], r["week_start"]): r for r in regular_weeks(df, shard=shard).collect()}
        assert got.keys() == want.keys()
        for k, values in want.items():
            assert got[k]["n_readings"] == len(values or []) and got[k]["is_missing"] == (values is None) and got[k]["target_name"] == "rsv"
            assert got[k]["value_filled"] is not None and got[k]["value_carried"] is not None
            if values:
                assert abs(got[k]["value_mean"] - sum(values) / len(values)) < 1e-9


def test_filling_between_shards(spark):
    df = spark.createDataFrame([("a", "t", "2022-01-03", 0.0, 1), ("a", "t", "2022-12-05", 48.0, 1)], SCHEMA)
    got = {r["week_start"]: r for r in regular_weeks(df, shard=4).collect()}
    assert len(got) == 49 and got["2022-01-10"]["value_filled"] == 1.0 and got["2022-01-10"]["value_carried"] == 0.0 and got["2022-11-28"]["value_filled"] == 47.0


def test_empty_and_single(spark):
    assert missing_weeks(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([("a", "t", "2022-03-01", 5.0, 1)], SCHEMA)
    assert regular_weeks(one).count() == 1 and missing_weeks(one).count() == 0


def test_values_of_the_query_against_brute_force_in_common_units(spark, sf):
    import __spark_entry__ as e
    from tidewell.functions.units import to_common

    seen = {}
    for r in spark.read.parquet(f"{sf}/canonical.parquet").collect():
        text, v = (r["collection_date"] or "").strip(), r["concentration_value"]
        form = "%Y-%m-%d" if re.fullmatch(r"\d{4}-\d\d-\d\d([T ].*)?", text) else "%m/%d/%Y" if re.fullmatch(r"\d{1,2}/\d{1,2}/\d{4}", text) else None
        if v is None or math.isnan(v) or form is None:
            continue
        try:
            d = dt.datetime.strptime(text[:10], form).date()
        except ValueError:
            continue
        if not dt.date(2022, 1, 3) <= d <= dt.date(2025, 12, 28):
            continue
        common = to_common(v, r["concentration_unit"], r["normalization_method"])
        t = r["target_name"] and r["target_name"].strip().lower()
        seen.setdefault((r["key_plot_id"], t), {}).setdefault(d - dt.timedelta(d.weekday()), []).append(common[0] if common else v)
    want = {}
    for (p, t), weeks in seen.items():
        means = {w: sum(x) / len(x) for w, x in weeks.items()}
        w = min(weeks)
        while w <= max(weeks):
            left, right = max(x for x in weeks if x <= w), min(x for x in weeks if x >= w)
            share = (w - left) / (right - left) if left != right else 0.0
            want[p, t, w.isoformat()] = (len(weeks.get(w, [])), w not in weeks, means.get(w), means[left] + (means[right] - means[left]) * share, means[left])
            w += dt.timedelta(7)
    got = {tuple(r[:3]): tuple(r[3:]) for r in e.queries()["p3_filled"](spark, sf).collect()}
    assert got.keys() == want.keys()
    for k, (n, missing, *values) in want.items():
        assert got[k][:2] == (n, missing)
        for a, b in zip(got[k][2:], values):
            assert (a is None) == (b is None) and (b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_mixed_units_of_a_series(spark):
    from tidewell.operators.units import harmonize_units

    schema = "key_plot_id string, target_name string, collection_date string, concentration_value double, concentration_unit string, normalization_method string"
    data = [("a", "t", "2022-01-03", 3.0, "log10 copies/L", None), ("a", "t", "2022-01-04", 3.0, "copies/mL", None), ("a", "t", "2022-01-17", 4000.0, None, None), ("a", "t", "2022-01-24", 1e6, "log10 copies/L", None)]
    g = regular_weeks(harmonize_units(spark.createDataFrame(data, schema), assume_common=True), averaged="common_value")
    got = {r["week_start"]: (r["n_readings"], r["value_mean"], r["value_filled"], r["value_carried"]) for r in g.collect()}
    assert got == {"2022-01-03": (2, 2000.0, 2000.0, 2000.0), "2022-01-10": (0, None, 3000.0, 2000.0), "2022-01-17": (1, 4000.0, 4000.0, 4000.0), "2022-01-24": (1, None, None, None)}
