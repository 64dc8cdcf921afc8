import datetime as dt

import numpy as np
import pytest

from tidewell.operators.spikes import SpikeRules, implausible_readings, judge_series, phase_space

SCHEMA = "row_id long, key_plot_id string, target_name string, collection_date string, concentration_value double, concentration_unit string, normalization_method string, received_at timestamp"


def series(n=120, seed=1, sd=0.08):
    rng = np.random.default_rng(seed)
    return 10 ** (5 + 0.4 * np.sin(np.arange(n) / 15) + rng.normal(0, sd, n))


def judged(c):
    return judge_series(c.copy(), c, c, c, SpikeRules())


def cases(c):
    opened, lo, hi, stuck = judged(c)
    return {int(i) for i in np.flatnonzero(opened & ((c < lo) | (c > hi) | (stuck == c)))}


def test_single_and_double_spikes_both_ways():
    c = series()
    c[30] *= 30
    c[60] /= 40
    c[90:92] *= 25
    assert cases(c) == {30, 60, 90, 91}


def test_no_case_in_ordinary_scatter():
    assert cases(series(400, 3)) == set()


def test_level_that_moves_and_stays_is_no_case():
    c = series()
    c[70:] *= 20
    assert cases(c) == set()


def test_stuck_run_is_a_case_and_five_are_not():
    c = series()
    c[40:46] = c[40]
    c[80:85] = c[80]
    assert cases(c) == set(range(40, 46))


def test_floor_is_no_case_but_a_rare_zero_is():
    c = series()
    c[::5] = 20000.0
    assert cases(c) == set()
    c = series()
    c[50] = 0.0
    assert cases(c) == {50}
    c = series()
    c[::6] = 0.0
    assert cases(c) == set()


def test_long_stuck_run_with_two_chance_near_equals_is_no_floor():
    c = series()
    x = float(10 ** np.round(np.log10(np.sort(c)[45]), 3))  # under the median, in the middle of a bin of three places
    c[40:50] = x
    c[10], c[100] = x * 1.0003, x * 0.9997
    assert cases(c) == set(range(40, 50))
    c[10], c[100] = x, x
    assert cases(c) == set(range(40, 50))


def test_chance_repeats_of_an_ordinary_value_are_no_floor():
    c = series()
    x = float(np.sort(c)[30])
    c[[10, 40, 70, 85, 100]] = x
    c[20:27] = x
    assert cases(c) == set(range(20, 27))


def test_floor_with_long_runs_is_no_case():
    c = series()
    x = float(c.min()) / 1.2
    for a, b in ((5, 14), (50, 58), (90, 99)):
        c[a:b] = x
    assert cases(c) == set()
    c = series()
    c[::6], c[30:40] = x, x
    c[61:67] *= 1.0 + 1e-9 * np.arange(6)
    c[72] = x * 1.0001  # the floor in rounded figures of another unit
    assert cases(c) == set()


def test_short_series_do_not_crash():
    for n in range(1, 6):
        assert cases(series(n)) == set()


def spiked():
    c = series(300, 7)
    c[[20, 77, 150]] *= 30
    c[200:202] /= 25
    return c


@pytest.mark.parametrize("answer", [True, False])
def test_ellipsoids_decide(monkeypatch, answer):
    """Neither an ellipsoid that all samples are outside of nor one that holds them all gives the spikes."""
    c = spiked()
    assert cases(c) == {20, 77, 150, 200, 201}
    monkeypatch.setattr("tidewell.operators.spikes.phase_space", lambda u, *rest: np.full(len(u), answer))
    assert cases(c) == set()


def test_iteration_finds_a_spike_behind_larger_ones():
    c = series(300, 7)
    c[100:102] *= 1e6
    c[104] *= 12
    assert cases(c) == {100, 101, 104}


def test_three_and_more_in_a_row_are_a_level_that_moved():
    c = series(200, 3)
    c[90:94] *= 15
    assert cases(c) == set()


def test_spike_beside_a_level_that_moves():
    c = series(200, 3)
    c[100:] *= 6
    c[97] *= 40
    assert cases(c) == {97}


def test_floor_of_one_season_is_no_case():
    c = series(240, 4)
    x = float(c.min()) / 3
    c[100:140:2] = x
    c[120:128] = x
    assert cases(c) == set()


def test_correction_is_put_in_its_samples_place():
    c = series()
    low, high = c.copy(), c.copy()
    high[40] *= 30  # a second reading of the day is off
    high[60] *= 1.5
    opened, lo, hi, _ = judge_series(c.copy(), c, low, high, SpikeRules())
    assert {int(i) for i in np.flatnonzero(opened & (high > hi))} == {40}


def test_phase_space_flags_a_jump():
    u = np.random.default_rng(0).normal(0, 1, 300)
    u[150] = 40
    assert phase_space(u)[150]


def rows(c, plot="p", start=dt.date(2023, 1, 1)):
    at = dt.datetime(2024, 1, 1)
    return [(i + 1, plot, " RSV" if i % 7 == 0 else "rsv", (start + dt.timedelta(3 * i)).isoformat(), float(x), "gc/L", None, at) for i, x in enumerate(c)]


def test_rows_repeats_units_and_bad_dates(spark):
    c = series()
    c[30] *= 30
    data = rows(c)
    data[31] = (*data[31][:4], data[31][4] / 1000, "copies/mL", None, data[31][7])  # another scale is no spike
    data.append((1001, *data[30][1:]))  # a repeat of the case
    data.append((1002, *data[30][1:4], float(c[29]), *data[30][5:]))  # its correction
    data.append((1003, "p", "rsv", "unknown", -5.0, "gc/L", None, None))  # negative, undated
    data.append((1004, "p", "rsv", "2099-01-01", 1e30, "gc/L", None, None))
    data.append((1005, None, None, None, None, None, None, None))
    data.append((1006, "p", "rsv", data[5][3], -3.0, "log10 copies/L", None, data[5][7]))  # negative only as a logarithm, and far too low
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS k1", "2 AS day", "3 AS v")
    got = {(r["row_id"], r["fault"]) for r in implausible_readings(df).collect()}
    assert got == {(31, "high"), (1001, "high"), (1003, "negative"), (1006, "low")}
    assert implausible_readings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    c = series(200, 5)
    c[20] *= 40
    c[100:107] = c[100]
    data = [r for p in range(12) for r in [(x[0] + 1000 * p, f"p{p}", *x[2:]) for x in rows(c, start=dt.date(2022, 2, 1))]]
    a = {r[0] for r in implausible_readings(spark.createDataFrame(data, SCHEMA).repartition(1)).select("row_id").collect()}
    b = {r[0] for r in implausible_readings(spark.createDataFrame(data, SCHEMA).repartition(7)).select("row_id").collect()}
    assert a == b and len(a) == 12 * 8


@pytest.mark.parametrize("value", [float("nan"), None])
def test_missing_values_are_no_cases(spark, value):
    df = spark.createDataFrame([(1, "p", "rsv", "2023-01-01", value, "gc/L", None, None)], SCHEMA)
    assert implausible_readings(df).count() == 0
