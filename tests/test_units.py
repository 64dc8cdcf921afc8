import math

import pytest

from tidewell.functions.units import PER_MARKER, PER_MASS, PER_VOLUME, SECOND_SIZES, SIZES, Affine, build_edges, compose, conversion_table, node, parse_method, parse_unit, to_common
from tidewell.operators.units import harmonize_units, off_unit_rows

SCHEMA = "row_id long, concentration_value double, concentration_unit string, normalization_method string"


@pytest.mark.parametrize(
    ("unit", "value", "common", "base"),
    [
        ("GC / L", 5.0, 5.0, PER_VOLUME), ("copies per liter sewage", 5.0, 5.0, PER_VOLUME), ("Copies/ml", 5.0, 5000.0, PER_VOLUME), ("gc per 100mL", 5.0, 50.0, PER_VOLUME),
        ("copies/m^3 waste water", 5000.0, 5.0, PER_VOLUME), ("gc per US gallon", 3.785411784, 1.0, PER_VOLUME), ("10^6 gc/L", 0.5, 5e5, PER_VOLUME), ("x1000 gc/L", 2.0, 2000.0, PER_VOLUME),
        ("kilocopies per litre", 2.0, 2000.0, PER_VOLUME), ("mln copies per litre", 2.0, 2e6, PER_VOLUME), ("log10(gc/L)", 3.0, 1000.0, PER_VOLUME), ("log copies/l waste water (base 10)", 2.0, 100.0, PER_VOLUME),
        ("log10 gc per mL", 1.0, 1e4, PER_VOLUME), ("copies/kg dw", 1000.0, 1.0, PER_MASS), ("gc/mg dry solids", 1.0, 1000.0, PER_MASS), ("thousand copies/g dry sludge", 1.0, 1000.0, PER_MASS),
        ("Ratio", 0.5, 0.5, PER_MARKER), ("percent of PMMoV", 5.0, 0.05, PER_MARKER), ("ppm of PMMoV", 5.0, 5e-6, PER_MARKER), ("copies per million PMMoV copies", 5.0, 5e-6, PER_MARKER),
        ("ratio x 10^-3", 5.0, 5e-3, PER_MARKER), ("ratio, in percent", 5.0, 0.05, PER_MARKER), ("log10 of PMMoV ratio", -2.0, 0.01, PER_MARKER), ("copies per 250 ml", 1.0, 4.0, PER_VOLUME),
    ],
)
def test_parse_unit(unit, value, common, base):
    got, name = to_common(value, unit)
    assert name == base and math.isclose(got, common, rel_tol=1e-9)


@pytest.mark.parametrize("text", [None, "", "n/a", "see method", "other", "flow-population", "none; detection limit stated in copies/mL", "none, surrogate spiked at 1000 copies/mL", "flow-population (sample volume 100 mL)", "dry weight", "a" * 100_000])
def test_texts_without_a_unit(text):
    assert parse_unit(text) is None and parse_method(text) is None


@pytest.mark.parametrize("text", ["none; results in copies/mL", "none - lab reports copies/mL", "none (values expressed as copies/mL)", "none | unit of result = copies/mL", "none. Reported: copies/mL", "reported as copies/mL; none", "copies/mL, none"])
def test_unit_in_method(text):
    assert parse_method(text).key == "1|lin|0|0|ml"


def test_graph_is_consistent_and_bounded():
    rows = conversion_table()
    assert len(rows) < 5000 and len({r[0] for r in rows}) == len(rows)
    assert {r[0] for r in rows} == {n for u, v, _ in build_edges() for n in (u, v)}  # no unit without a way to its common one


def test_compositions_take_several_edges():
    to = compose(build_edges(), [node(log, 0, 0, u) for log in (False, True) for u in ("l", "g", "ratio")])
    hops = [h for _, _, h in to.values()]
    assert sum(h > 1 for h in hops) > 0.9 * len(hops)
    assert to[node(False, 3, 2, "ml")][2] >= 3 and to[node(False, 0, 0, "ml")][2] == 1
    for log in (False, True):
        root, f, _ = to[node(log, 6, 2, "gal")]
        want = 1e6 / 100 / 3.785411784
        assert math.isclose(10**f.b if log else f.a, want, rel_tol=1e-9) and root == node(log, 0, 0, "l")


@pytest.mark.parametrize("wrong", [("gal", "l", 3.785411874), ("ml", "l", 1e-2), ("mg", "g", 1e-2), ("kg", "g", 1e2), ("ul", "ml", 1e-2)])
def test_a_wrong_fact_is_caught_by_the_second_source(wrong):
    sizes = tuple(wrong if x[:2] == wrong[:2] else x for x in SIZES) + SECOND_SIZES
    with pytest.raises(ValueError, match="disagree"):
        compose(build_edges(sizes), [node(False, 0, 0, "l"), node(False, 0, 0, "g")])


@pytest.mark.parametrize("text", ["gc per 250 mL", "2.5e14 copies per 37 gallons", "copies per 5000 litres", "log10 copies per 250 ml", "300 copies/mg dry weight", "7 copies per 3 pmmov copies", "3e-20 gc/l"])
def test_every_unit_that_is_read_has_a_node(text):
    u = parse_unit(text)
    times, at = u.key.split("|", 1)
    row = {r[0]: r for r in conversion_table()}[at]
    x = 2.5
    got = 10 ** (row[3] * (x + math.log10(float(times))) + row[4]) if row[2] else row[3] * (float(times) * x) + row[4]
    want, base = to_common(x, text)
    assert math.isclose(got, want, rel_tol=1e-9) and row[1] == base


def test_inconsistent_cycle_is_refused():
    edges = build_edges()
    u, v, f = edges[0]
    with pytest.raises(ValueError, match="disagree"):
        compose([*edges, (u, v, Affine(f.a * 2, f.b))], [v, u])


def test_harmonize_rows(spark):
    rows = [(1, 2.0, "copies/mL", None), (2, None, "copies/mL", None), (3, float("nan"), "gc/L", None), (4, 3.0, "see method", "none; results in log10 copies/L"), (5, 7.0, None, None), (6, 7.0, "gc/L", "x; results in copies/mL"), (6, 7.0, "gc/L", "x; results in copies/mL"), (8, 5.0, "gc per 250 mL", None), (9, 5.0, "10 copies per 10 L", None), (7, 400.0, "log10 copies/L", None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS common_unit", "1 AS log", "2 AS a")
    out = {r["row_id"]: r for r in harmonize_units(df).collect()}
    assert out[1]["common_value"] == 2000.0 and out[1]["is_common_unit"] is False
    assert out[2]["common_value"] is None and out[3]["common_value"] is None and out[7]["common_value"] is None
    assert math.isclose(out[4]["common_value"], 1000.0) and out[5]["common_unit"] is None and out[6]["is_common_unit"]
    assert math.isclose(out[8]["common_value"], 20.0) and out[8]["is_common_unit"] is False and out[9]["is_common_unit"] and out[9]["common_value"] == 5.0
    assert out[1]["log"] == 1 and out[1]["a"] == 2
    found = sorted(r["row_id"] for r in off_unit_rows(df).collect())
    assert found == [1, 4, 7, 8]
    assert off_unit_rows(spark.createDataFrame([], SCHEMA)).count() == 0
