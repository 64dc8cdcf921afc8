"""Implausible readings of a series (problem 1): phase-space thresholding, stuck runs and bounds.

Three stages.  (1) Readings shrink to one row per series and day, by partial aggregation, so that a series that holds a
third of all rows still reaches one task as no more rows than there are days in the window.  (2) Each series is judged
in numpy: robust ellipsoids over the detrended logarithm and its first and second differences flag spikes, again and
again with the flagged samples taken out; what is inside makes the levels and the scatter, and only what is outside can be
a case, on which the definition's bounds then decide; zero-difference runs give stuck values.
The stage returns bounds only for the days on which some reading may lie outside of them.  (3) Rows are equi-joined
with these bounds on series and day (a series' rows spread over its days), and each row is tested against them, so
repeats and corrections are judged each by its own value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.dates import any_date
from tidewell.operators.units import harmonize_units


@dataclass(frozen=True)
class SpikeRules:
    """fold: a spike lies more than this factor off the level; scatter: and at least this many standard deviations of the
    series' logarithm; both: and at least this share of the fold off the levels before and after alike; side: samples on
    either side that make the level; wide: factor of the ellipsoid's axes, as levels are estimates and ordinary samples
    have to stay inside; rounds: of ellipsoids at most; stuck: consecutive samples with one
    recorded value; floor_share, floor_runs: the share of the samples and the number of separate runs, stuck ones not
    counted, from which on a repeated low value is the series' floor; floor_lowest: the number of samples, stuck runs not
    counted, that make the lowest value the floor wherever they lie; floor_under: the share of the samples (or two) that
    may lie under it; same: relative difference of common values that are one; rounding: that of a floor restated in
    another unit, in rounded figures or logarithms of four places."""

    fold: float = 4.0
    scatter: float = 8.0
    both: float = 0.8
    side: int = 3
    wide: float = 1.5
    rounds: int = 8
    stuck: int = 6
    floor_share: float = 0.04
    floor_runs: int = 3
    floor_lowest: int = 8
    floor_under: float = 0.02
    same: float = 1e-6
    rounding: float = 3e-4
    first: str = "2022-01-03"
    last: str = "2025-12-28"


def _median(x: np.ndarray) -> float:
    k = len(x) // 2
    if len(x) % 2:
        return float(np.partition(x, k)[k])
    p = np.partition(x, (k - 1, k))
    return float((p[k - 1] + p[k]) / 2)


def _mad(x: np.ndarray) -> float:
    x = x[np.isfinite(x)]
    return 1.4826 * _median(np.abs(x - _median(x))) if len(x) else 0.0


def _slope(x: np.ndarray) -> np.ndarray:
    """Central differences, one-sided at the ends."""
    out = np.empty(len(x))
    out[1:-1] = (x[2:] - x[:-2]) / 2
    out[0], out[-1] = x[1] - x[0], x[-1] - x[-2]
    return out


def _nanmedian(x: np.ndarray) -> np.ndarray:
    """Row medians without NaN; NaN for rows of NaN only."""
    x = np.sort(x, axis=1)
    n = np.sum(~np.isnan(x), axis=1)
    rows = np.arange(len(x))
    low, high = x[rows, np.maximum((n - 1) // 2, 0)], x[rows, np.minimum(n // 2, x.shape[1] - 1)]
    return np.where(n > 0, (low + high) / 2, np.nan)


@dataclass(frozen=True)
class Ellipsoid:
    """The robust ellipsoid of (u, du, d2u): semi-axes by the universal threshold times ``wide``, and the turn of the (u, d2u) plane."""

    s0: float
    s1: float
    s2: float
    theta: float

    @classmethod
    def of(cls, u: np.ndarray, wide: float = 1.0) -> Ellipsoid:
        d1 = _slope(u)
        d2 = _slope(d1)
        limit = wide * np.sqrt(2 * np.log(len(u)))
        theta = np.arctan2(float(u @ d2), float(u @ u)) if float(u @ u) else 0.0
        return cls(*(max(_mad(x), 1e-9) * limit for x in (u, d1, d2)), theta)

    def outside(self, u: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Whether points lie outside of the ellipsoid in one of its three planes."""
        s0, s1, s2 = self.s0, self.s1, self.s2
        out = (u / s0) ** 2 + (d1 / s1) ** 2 > 1
        out |= (d1 / s1) ** 2 + (d2 / s2) ** 2 > 1
        cos, sin = np.cos(self.theta), np.sin(self.theta)
        a, b = u * cos + d2 * sin, d2 * cos - u * sin
        c, s = cos**2, sin**2
        det = c * c - s * s
        if abs(det) > 1e-6:
            sa2, sb2 = (s0**2 * c - s2**2 * s) / det, (s2**2 * c - s0**2 * s) / det
            if sa2 > 0 and sb2 > 0:
                return out | (a * a / sa2 + b * b / sb2 > 1)
        return out | ((u / s0) ** 2 + (d2 / s2) ** 2 > 1)


def phase_space(u: np.ndarray, other: np.ndarray | None = None, e: Ellipsoid | None = None) -> np.ndarray:
    """Points that lie outside of the robust ellipsoid ``e`` (by default that of ``u``): those of u itself, or those that
    the series would have with ``other`` in the place of one of its values at a time."""
    if len(u) < 4:
        return np.ones(len(u), bool)
    d1 = _slope(u)
    d2 = _slope(d1)
    e = e or Ellipsoid.of(u)
    if other is None:
        return e.outside(u, d1, d2)
    # the first difference of a place doesn't hold its own value; the second holds half of it
    return e.outside(other, d1, d2 - (other - u) / 2)


def spikes_of(u: np.ndarray, flagged: np.ndarray, wide: float, most: int = 2, peaks: int = 5) -> np.ndarray:
    """Samples outside of the ellipsoid that are one or two in a row.

    ``flagged``: samples that gave way to the level in the rounds before.  A spike's differences take its neighbours out of
    the ellipsoid too: of a run of more than ``most`` samples the farthest gives way to the level, up to ``peaks`` times,
    and neighbours that are inside then are let go.  Where more than ``most`` in a row stay outside, the level moves, and
    they are let go, but for one or two that lie twice as far off as all the rest of them."""
    held = np.where(flagged, 0.0, u)
    e = Ellipsoid.of(held, wide) if len(u) >= 4 else None
    out = phase_space(held, u, e)
    taken = np.zeros(len(u), bool)
    for _ in range(peaks):
        begins, ends = _runs(out)
        size = np.where(taken | ~out, -1.0, np.abs(u))
        new = [i + int(np.argmax(size[i:j])) for i, j in zip(begins, ends) if j - i > most]
        new = [i for i in new if size[i] > 0]
        if not new:
            break
        taken[new] = True
        out &= phase_space(np.where(taken, 0.0, held), u, e)
    begins, ends = _runs(out)
    for i, j in zip(begins, ends):
        if j - i > most:
            size = np.sort(np.abs(u[i:j]))[::-1]
            ahead = [k for k in range(1, most + 1) if size[k - 1] >= 2 * size[k]]
            out[i:j] = np.abs(u[i:j]) >= size[ahead[-1] - 1] if ahead else False
    return out


def _runs(out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], out, [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scatter(x: np.ndarray) -> float:
    """The standard deviation of the noise in ``x``, of residuals off the two neighbours on either side, which slow
    movements don't touch; residuals beyond three robust deviations are left out, and made up for."""
    if len(x) < 9:
        return _mad(x)
    r = x[2:-2] - (x[:-4] + x[1:-3] + x[3:-1] + x[4:]) / 4
    inside = r[np.abs(r - _median(r)) <= 3 * _mad(r)]
    return float(np.std(inside)) / 0.9866 / np.sqrt(1.25) if len(inside) else 0.0


def _repeated(c: np.ndarray, same: float) -> list[np.ndarray]:
    """Places, in order, of each value that three or more samples have; from the lowest value on, without negative ones."""
    at = np.flatnonzero(c >= 0)
    at = at[np.argsort(c[at], kind="stable")]
    x = c[at]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(x) > same * x[1:]) + 1, [len(at)]))
    return [np.sort(at[edges[k] : edges[k + 1]]) for k in np.flatnonzero(np.diff(edges) >= 3)]


def judge_series(v: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, rules: SpikeRules) -> tuple[np.ndarray, ...]:
    """Bounds of one series, in order of its samples.

    v, c: recorded and common value of each day's sample; low, high: smallest and largest common value of the day's
    rows.  Returns (open, lo, hi, stuck): whether rows of the day must be tested, the bounds on common values, and the
    recorded value that is stuck on that day or NaN.  A zero is below every bound unless the series reports zeros as
    its floor; floors come back as bounds that admit them."""
    n = len(v)
    with np.errstate(divide="ignore", invalid="ignore"):
        l = np.where(c > 0, np.log10(np.where(c > 0, c, 1.0)), np.nan)
    rid = np.cumsum(np.r_[True, v[1:] != v[:-1]]) - 1
    run = np.bincount(rid)[rid]
    floor = np.zeros(n, bool)
    middle = _median(l[np.isfinite(l)]) if np.isfinite(l).any() else 0.0
    floors: list[float] = []
    for own in _repeated(c, rules.same):
        value = float(c[own[0]])
        long = run[own] >= rules.stuck
        # a stuck run is no evidence that its value is the floor (only of how long it lasted); three of them are, as a
        # fault doesn't repeat its value
        at = own if len(np.unique(rid[own[long]])) >= rules.floor_runs else own[~long]
        if len(at) < max(3, rules.floor_share * (n - len(own) + len(at))) or (value > 0 and np.log10(value) > middle):
            continue
        # samples of lower floors and of stuck runs say nothing about what is low
        under = np.count_nonzero((c >= 0) & (c < value * (1 - rules.rounding)) & ~floor & (run < rules.stuck))
        if under > max(2, rules.floor_under * n):
            continue
        runs = 1 + np.count_nonzero(np.diff(at) > 1)
        throughout = runs >= rules.floor_runs and own[-1] - own[0] >= n / 3
        if throughout or np.count_nonzero(~long) >= rules.floor_lowest:
            floors.append(value)
            floor |= np.abs(c - value) <= rules.rounding * value
    zero_floor = 0.0 in floors
    stuck = (run >= rules.stuck) & ~floor

    fold = np.log10(rules.fold)
    usable = np.isfinite(l) & ~floor
    flagged = np.zeros(n, bool)
    level, before, after, u = (np.full(n, np.nan) for _ in range(4))
    scatter = 0.0
    at = np.flatnonzero(usable)
    for turn in range(rules.rounds):
        clean = np.flatnonzero(usable & ~flagged & ~stuck)
        if len(clean) < 3:
            break
        lc = l[clean]
        scatter = _scatter(lc)
        # each sample's neighbours among those inside of the ellipsoids so far, itself left out
        place = np.searchsorted(clean, np.arange(n))
        own = np.zeros(n, int)
        own[clean] = 1
        pad = np.concatenate([np.full(rules.side, np.nan), lc, np.full(rules.side, np.nan)])
        b = np.stack([pad[place + k] for k in range(rules.side)], 1)
        a = np.stack([pad[place + rules.side + own + k] for k in range(rules.side)], 1)
        before, after, level = _nanmedian(b), _nanmedian(a), _nanmedian(np.concatenate([b, a], 1))
        # at either end the nearest sample stands for the side that isn't there
        before, after = np.where(np.isnan(before), a[:, 0], before), np.where(np.isnan(after), b[:, -1], after)
        # two spikes in a row are the level of a side as long as they aren't flagged, but not that of both
        u = _off(l, level, before, after, scatter if turn else np.inf)
        # each sample among neighbours of which the flagged and stuck ones gave way to the level
        now = np.zeros(n, bool)
        now[at] = spikes_of(u[at], (flagged | stuck)[at], rules.wide)
        if turn > rules.rounds // 2:
            now |= flagged
        if (now == flagged).all():
            break
        flagged = now
    off = max(fold, rules.scatter * scatter)
    lo, hi = _bounds(level, before, after, off, rules.both * fold)
    # readings of a day other than its sample, or none that has a logarithm, are put in its sample's place
    restated = np.zeros(n, bool)
    restated[at] = _restated(u, flagged | stuck, at, [low, high], level, before, after, scatter, rules.wide)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        lo, hi = np.where(np.isnan(lo), -np.inf, 10.0**lo), np.where(np.isnan(hi), np.inf, 10.0**hi)
        if floors:
            lowest = min(floors) * (1 - rules.rounding)
            # a day with a floor reading admits it; other days keep their bound for readings under the floor
            lo = np.where(floor, np.minimum(lo, lowest), lo)
            if zero_floor:
                lo = np.where(low == 0, 0.0, lo)
    # the ellipsoids name the days, the bounds of the definition decide on each of their readings; a zero or negative
    # sample has no place in phase space, and a floor is no sample of it
    tested = ((high > hi) | (low < lo)) & (flagged | ((low != high) & (restated | ~usable)) | ~np.isfinite(l) | (c == 0))
    return tested | stuck, lo, hi, np.where(stuck, v, np.nan)


def _off(l: np.ndarray, level: np.ndarray, before: np.ndarray, after: np.ndarray, scatter: float) -> np.ndarray:
    """How far samples lie off the level around them; where it moved by more than four deviations, off the nearer one of
    the levels before and after.  Zero without a level."""
    moved = np.abs(after - before) > 4 * scatter
    nearer = np.where(np.abs(l - before) < np.abs(l - after), l - before, l - after)
    r = np.where(moved, nearer, l - level)
    return np.where(np.isfinite(r), r, 0.0)


def _restated(u: np.ndarray, flagged: np.ndarray, at: np.ndarray, others: list[np.ndarray], level: np.ndarray, before: np.ndarray, after: np.ndarray, scatter: float, wide: float) -> np.ndarray:
    """Of the samples ``at``, those in whose place one of the other readings of the day would lie outside of the ellipsoid."""
    held = np.where(flagged, 0.0, u)[at]
    e = Ellipsoid.of(held, wide) if len(at) >= 4 else None
    out = np.zeros(len(at), bool)
    for other in others:
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(other > 0, np.log10(np.where(other > 0, other, 1.0)), np.nan)
        out |= phase_space(held, _off(x, level, before, after, scatter)[at], e) | ~np.isfinite(x[at])
    return out


def _bounds(level: np.ndarray, before: np.ndarray, after: np.ndarray, off: float, both: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithmic bounds: ``off`` from the level around, and ``both`` from the levels of either side."""
    side = np.stack([np.where(np.isnan(before), level, before), np.where(np.isnan(after), level, after)])
    return np.minimum(level - off, side.min(0) - both), np.maximum(level + off, side.max(0) + both)


_BOUNDS = "k1 long, k2 long, day int, lo double, hi double, stuck double"


def _judge(rules: SpikeRules):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("day", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("stuck", pa.float64())])
    names = ("k1", "k2", "day", "v", "c", "low", "high")

    def series(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, (np.diff(columns["k1"]) != 0) | (np.diff(columns["k2"]) != 0)])
        out = []
        for i, j in zip(start, np.r_[start[1:], len(columns["k1"])]):
            opened, lo, hi, stuck = judge_series(*(columns[x][i:j] for x in names[3:]), rules)
            if opened.any():
                at = np.flatnonzero(opened)
                out.append((columns["k1"][i + at], columns["k2"][i + at], columns["day"][i + at], lo[at], hi[at], stuck[at]))
        if not out:
            return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {x: batch.column(i).to_numpy(zero_copy_only=False) for i, x in enumerate(names)}
            if rest is not None:
                new = {x: np.concatenate([rest[x], new[x]]) for x in names}
            ends = np.flatnonzero((np.diff(new["k1"]) != 0) | (np.diff(new["k2"]) != 0))
            cut = ends[-1] + 1 if len(ends) else 0  # the last series may go on in the next batch
            if cut:
                yield series({x: a[:cut] for x, a in new.items()})
            rest = {x: a[cut:] for x, a in new.items()}
        if rest is not None and len(rest["k1"]):
            yield series(rest)

    return run


def implausible_readings(
    df: DataFrame,
    key: str = "row_id",
    source: str = "key_plot_id",
    target: str = "target_name",
    date: str = "collection_date",
    value: str = "concentration_value",
    received: str = "received_at",
    rules: SpikeRules | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``key``, the columns ``keep`` and ``fault`` (negative, high, low, stuck) of every row with a reading that can't be true.

    A series is one source and one target (trimmed, lower case; a null target is a series of its own).  A day's sample
    is its first received row; of rows received at the same instant any may stand for it, as all are judged each by
    its own value.  Rows without a value are never cases; rows without a readable date inside of [rules.first,
    rules.last] can't be ordered and are cases only when negative; rows without a stated unit are taken to be in the
    common unit.  Series of fewer than four samples have only negative and stuck cases.  An empty table gives an empty result;
    repeats of a row are judged alike.  Extra columns are ignored."""
    rules = rules or SpikeRules()
    named = [F.coalesce(x, F.lit("\0")) for x in (F.col(source), F.lower(F.trim(target)))]  # xxhash64 skips nulls
    rows = df.select(
        F.struct(key, *keep).alias("__kept"),
        F.xxhash64(*named).alias("k1"),
        F.xxhash64(F.lit(7), *named[::-1]).alias("k2"),
        F.unix_date(any_date(date, rules.first, rules.last)).alias("day"),
        F.col(value).cast("double").alias("v"),
        F.coalesce(F.unix_micros(F.col(received).cast("timestamp")), F.lit(2**62)).alias("at"),
        F.col("concentration_unit").alias("u"),
        F.col("normalization_method").alias("m"),
    ).where(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = harmonize_units(rows, "v", "u", "m", assume_common=True).select("__kept", "k1", "k2", "day", "v", "at", F.col("common_value").alias("c"))
    dated = rows.where("day is not null and c is not null")
    daily = dated.groupBy("k1", "k2", "day").agg(F.min_by("v", "at").alias("v"), F.min_by("c", "at").alias("c"), F.min("c").alias("low"), F.max("c").alias("high"))
    bounds = daily.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "day").mapInArrow(_judge(rules), _BOUNDS)
    # one pass over the rows: those without a bound can only be negative
    c = F.col("c")
    at = ["k1", "k2", "day"]
    judged = rows.where("c < 0 or (c >= 0 and day is not null)").join(bounds, at, "left").select(
        "__kept",
        F.when(c < 0, F.lit("negative")).when(F.col("v") == F.col("stuck"), F.lit("stuck")).when(c > F.col("hi"), F.lit("high")).when(c < F.col("lo"), F.lit("low")).alias("fault"),
    )
    return judged.where("fault is not null").select(*(F.col(f"__kept.{x}").alias(x) for x in (key, *keep)), "fault")
