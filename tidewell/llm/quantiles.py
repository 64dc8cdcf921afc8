"""Percentiles of large numeric columns by mergeable sketches of relative rank error (problem 7).

A sketch is a stack of relative-rank compactors (Cormode, Karnin, Liberty, Thaler, Vesely, 2021).  Level l holds values
of weight 2**l.  A full compactor sorts its buffer and passes every second value of its lower part to the next level;
the upper part, which holds the highest ranks, is protected, and how much of the lower part takes part follows the
binary schedule of the paper.  The error of a rank r then shrinks with n - r.  Percentiles under a half come from a second
sketch of the negated values, so the error shrinks towards either end: both tails are sharp.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialize

K = 32
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


class RelativeSketch:
    """Buffers by level; ``k`` is the section size.  Exact until more than 6k values have come in."""

    __slots__ = ("k", "n", "low", "high", "buffers", "states")

    def __init__(self, k: int = K):
        self.k, self.n, self.low, self.high = k, 0, math.inf, -math.inf
        self.buffers: list[np.ndarray] = [np.empty(0)]
        self.states: list[int] = [0]

    def _sections(self, level: int) -> int:
        """More sections the more compactions a level has seen."""
        return 3 + max(0, self.states[level].bit_length() - 3)

    def _capacity(self, level: int) -> int:
        return 2 * self.k * self._sections(level)

    def update(self, values: np.ndarray) -> RelativeSketch:
        """Values may be in any order; NaN must be left out.  Taken in portions, so memory stays bounded."""
        step = self._capacity(0)
        if len(values):
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        for i in range(0, len(values), step):
            self.buffers[0] = np.concatenate([self.buffers[0], values[i : i + step]])
            self.n += len(values[i : i + step])
            self._compress()
        return self

    def merge(self, other: RelativeSketch) -> RelativeSketch:
        while len(self.buffers) < len(other.buffers):
            self.buffers.append(np.empty(0))
            self.states.append(0)
        for level, (b, s) in enumerate(zip(other.buffers, other.states)):
            self.buffers[level] = np.concatenate([self.buffers[level], b])
            self.states[level] |= s
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self._compress()
        return self

    def _compress(self) -> None:
        level = 0
        while level < len(self.buffers):
            while len(self.buffers[level]) > self._capacity(level):
                self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        if level + 1 == len(self.buffers):
            self.buffers.append(np.empty(0))
            self.states.append(0)
        b = np.sort(self.buffers[level])
        state = self.states[level]
        sections = self._sections(level)
        trailing = (~state & (state + 1)).bit_length() - 1
        protect = self._capacity(level) // 2 + (sections - min(sections, trailing + 1)) * self.k
        cut = max(2, len(b) - protect) // 2 * 2  # an even number, so weights are kept whole
        # the coin: which of each two goes on; from the state, so a run can be repeated
        coin = (state * 0x9E3779B1 + level * 0x85EBCA77 + (self.n & 0xFFFF)) >> 7 & 1
        self.buffers[level + 1] = np.concatenate([self.buffers[level + 1], b[:cut][coin::2]])
        self.buffers[level] = b[cut:]
        self.states[level] = state + 1

    def quantiles(self, q: tuple[float, ...]) -> list[float]:
        """The smallest value whose estimated rank is at least ceil(q * n); the extremes are exact."""
        if not self.n:
            return [math.nan] * len(q)
        v = np.concatenate(self.buffers)
        w = np.concatenate([np.full(len(b), 1 << level, np.int64) for level, b in enumerate(self.buffers)])
        order = np.argsort(v, kind="stable")
        v, rank = v[order], np.cumsum(w[order])
        out = []
        for p in q:
            need = max(1, math.ceil(p * self.n - 1e-9))
            out.append(self.low if need == 1 else self.high if need >= self.n else float(v[min(len(v) - 1, np.searchsorted(rank, need))]))
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<IqddI", self.k, self.n, self.low, self.high, len(self.buffers))
        return head + b"".join(struct.pack("<IQ", len(b), s) for b, s in zip(self.buffers, self.states)) + b"".join(b.astype("<f8").tobytes() for b in self.buffers)

    @classmethod
    def from_bytes(cls, data: bytes) -> RelativeSketch:
        k, n, low, high, levels = struct.unpack_from("<IqddI", data)
        out = cls(k)
        out.n, out.low, out.high = n, low, high
        at = struct.calcsize("<IqddI")
        sizes = []
        out.states = []
        for _ in range(levels):
            size, state = struct.unpack_from("<IQ", data, at)
            sizes.append(size)
            out.states.append(state)
            at += struct.calcsize("<IQ")
        out.buffers = []
        for size in sizes:
            out.buffers.append(np.frombuffer(data, "<f8", size, at).astype(float))
            at += 8 * size
        return out


class TwoSided:
    """The values themselves up to 6k of them, then a sketch that is sharp at high ranks and a mirrored one for low ranks."""

    __slots__ = ("k", "values", "high", "low")

    def __init__(self, k: int = K):
        self.k, self.values = k, np.empty(0)
        self.high: RelativeSketch | None = None
        self.low: RelativeSketch | None = None

    @property
    def n(self) -> int:
        return len(self.values) if self.high is None else self.high.n

    def update(self, values: np.ndarray) -> TwoSided:
        if self.high is None:
            self.values = np.concatenate([self.values, values])
            if len(self.values) <= 6 * self.k:
                return self
            values, self.values = self.values, np.empty(0)
            self.high, self.low = RelativeSketch(self.k), RelativeSketch(self.k)
        self.high.update(values)
        self.low.update(-values)
        return self

    def merge(self, other: TwoSided) -> TwoSided:
        if other.high is None:
            return self.update(other.values)
        if self.high is None:
            mine, self.values = self.values, np.empty(0)
            self.high, self.low = other.high, other.low
            return self.update(mine)
        self.high.merge(other.high)
        self.low.merge(other.low)
        return self

    def quantiles(self, q: tuple[float, ...]) -> list[float]:
        """The value whose rank is ceil(q * n), from the sketch that is sharp on its side; exact for up to 6k values."""
        if self.high is None:
            x = np.sort(self.values)
            return [float(x[min(len(x), max(1, math.ceil(p * len(x) - 1e-9))) - 1]) if len(x) else math.nan for p in q]
        n = self.high.n
        low = [1 - (max(1, math.ceil(p * n - 1e-9)) - 1) / n for p in q]  # the same rank from the other end
        upper, lower = self.high.quantiles(q), self.low.quantiles(tuple(low))
        return [-b if p < 0.5 else a for p, a, b in zip(q, upper, lower)]

    def to_bytes(self) -> bytes:
        if self.high is None:
            return struct.pack("<BI", 0, self.k) + self.values.astype("<f8").tobytes()
        high = self.high.to_bytes()
        return struct.pack("<BII", 1, self.k, len(high)) + high + self.low.to_bytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> TwoSided:
        kind, k = struct.unpack_from("<BI", data)
        out = cls(k)
        if not kind:
            out.values = np.frombuffer(data, "<f8", offset=5).astype(float)
            return out
        size = struct.unpack_from("<I", data, 5)[0]
        out.high, out.low = RelativeSketch.from_bytes(data[9 : 9 + size]), RelativeSketch.from_bytes(data[9 + size :])
        return out


def _sketches(k: int, hold: int = 400_000):
    """Partial sketches of one map task: at most ``hold`` values are held back before they go into sketches."""
    schema = pa.schema([("g", pa.string()), ("day", pa.int32()), ("part", pa.int32()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        names: dict[str | None, int] = {}
        made: dict[tuple[int, int], TwoSided] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if not held:
                return
            g, d, v = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((v, d, g))
            g, d, v = g[order], d[order], v[order]
            start = np.flatnonzero(np.r_[True, (np.diff(g) != 0) | (np.diff(d) != 0)])
            for i, j in zip(start, np.r_[start[1:], len(g)]):
                key = (int(g[i]), int(d[i]))
                if key not in made:
                    made[key] = TwoSided(k)
                made[key].update(v[i:j])

        count = 0
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            ids = np.array([names.setdefault(x, len(names)) for x in codes.dictionary.to_pylist()] + [names.setdefault(None, len(names))], np.int64)
            index = codes.indices.fill_null(len(ids) - 1).to_numpy(zero_copy_only=False)
            held.append((ids[index], batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)))
            count += batch.num_rows
            if count >= hold:
                flush()
                count = 0
        flush()
        back = {i: x for x, i in names.items()}
        items = list(made.items())
        for i in range(0, len(items), 5000):
            some = items[i : i + 5000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([back[g] for (g, _), _ in some], pa.string()), pa.array([d for (_, d), _ in some], pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array([s.to_bytes() for _, s in some], pa.binary())],
                schema=schema,
            )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (g, day, part, sketch): one merged sketch for each (g, day)."""
    now: tuple | None = None
    sketch: TwoSided | None = None
    out: list[tuple] = []
    schema = None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        schema = pa.schema([("g", pa.string()), ("day", pa.int32()), ("part", pa.int32()), ("sketch", pa.binary())])
        for g, d, p, s in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now is None or now[:2] != (g, d):
                if now is not None:
                    out.append((*now, sketch.to_bytes()))
                now, sketch = (g, d, p), TwoSided.from_bytes(s)
            else:
                sketch.merge(TwoSided.from_bytes(s))
        if len(out) >= 5000:
            yield batch_of(out)
            out = []
    if now is not None:
        out.append((*now, sketch.to_bytes()))
    if out:
        yield batch_of(out)


_SKETCH = "g string, day int, part int, sketch binary"


def merge_sketches(sketches: DataFrame, fan: int = 16) -> DataFrame:
    """One sketch for each (g, day), in two steps: partial sketches of a group meet in ``fan`` places first, so a group to
    which every task of a large job contributes isn't merged by a single one."""
    salted = sketches.withColumn("part", F.pmod("part", F.lit(fan)))
    first = salted.repartition("g", "day", "part").sortWithinPartitions("g", "part", "day").mapInArrow(_merge_parts, _SKETCH)
    return first.repartition("g", "day").sortWithinPartitions("g", "day", "part").mapInArrow(_merge, _SKETCH)


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_merge``, for each (g, day, part): rows come sorted by (g, part, day)."""
    return _merge(batches)


def daily_sketches(df: DataFrame, group: Column | list[Column], day: Column, value: Column, k: int = K) -> DataFrame:
    """g, day (days since 1970), part, sketch: mergeable with the sketches of other days or deliveries.  Rows with a
    null day or a null or NaN value are left out; a null group is a group.

    ``group`` is one column, taken as text, or several, which g then holds as a JSON object that :func:`group_fields` reads."""
    v = value.cast("double")
    g = group.cast("string") if isinstance(group, Column) else F.to_json(F.struct(*(c.cast("string").alias(f"g{i}") for i, c in enumerate(group))), {"ignoreNullFields": "false"})
    rows = df.select(g.alias("g"), F.unix_date(day).alias("day"), v.alias("v")).where(F.col("day").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    return merge_sketches(rows.mapInArrow(_sketches(k), _SKETCH))


def group_fields(*names: str) -> list[Column]:
    """The columns of a group of several, nulls and all."""
    fields = F.from_json("g", ", ".join(f"g{i} string" for i in range(len(names))))
    return [fields[f"g{i}"].alias(n) for i, n in enumerate(names)]


def _evaluate(q: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [TwoSided.from_bytes(s) for s in batch.column("sketch").to_pylist()]
            values = list(zip(*(s.quantiles(q) for s in made))) if made else [()] * len(q)
            yield pa.RecordBatch.from_arrays(
                [batch.column("g").cast(pa.string()), batch.column("day").cast(pa.int32()), pa.array([s.n for s in made], pa.int64()), *(pa.array(v, pa.float64()) for v in values)],
                names=["g", "day", "n", *(_name(p) for p in q)],
            )

    return run


def _name(p: float) -> str:
    return "p" + f"{100 * p:g}".replace(".", "_")


def percentiles_of(sketches: DataFrame, q: tuple[float, ...] = PERCENTILES) -> DataFrame:
    return sketches.mapInArrow(_evaluate(q), f"g string, day int, n long, {', '.join(f'{_name(p)} double' for p in q)}")


def percentiles(df: DataFrame, group: Column | list[Column], day: Column, value: Column, q: tuple[float, ...] = PERCENTILES, k: int = K) -> DataFrame:
    """grain ('day' or 'month'), g, period (yyyy-MM-dd, the first day of a month), n and the percentiles.

    Months are merged from the daily sketches, which are written once to the shared folder."""
    daily = materialize(daily_sketches(df, group, day, value, k))
    month = F.unix_date(F.trunc(F.date_from_unix_date("day"), "month")).cast("int")
    monthly = merge_sketches(daily.select("g", month.alias("day"), F.col("day").alias("part"), "sketch"))
    out = percentiles_of(daily, q).withColumn("grain", F.lit("day")).unionByName(percentiles_of(monthly, q).withColumn("grain", F.lit("month")))
    return out.select("grain", "g", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("period"), "n", *(_name(p) for p in q))
