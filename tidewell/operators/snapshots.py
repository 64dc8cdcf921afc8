"""What changed between full snapshots of a table (problem 2).

An index of a snapshot holds, for each key, 128 bits of hash over its compared columns, and is bucketed by key.  A new
snapshot's rows probe the index of the one before it: keys that only the rows have were added, keys that only the index has
were removed, keys of another hash changed.  Then the new index takes the old one's place, and old values are fetched for
changed keys only.

:func:`snapshot_changes` takes a whole history through such an index: rows shrink to hashes and are partitioned by key, and
every bucket goes through the runs of a scope in their order, probing the index of the last run and swapping it for the
next.  A bucket holds the hashes of two snapshots of one scope at most, and no values.  :func:`changed_values` fetches.
:class:`SnapshotIndex` keeps the index on storage for deliveries that come one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def squeezed(c: Column | str) -> Column:
    """Text with every run of white space as one blank, and none at the ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x{1c}-\x{1f}\x{85}]+", " "))


def row_hash(*columns: Column) -> Column:
    """128 bits over the columns, null apart from every value."""
    return F.unhex(F.md5(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}).cast("binary")))


def _values(compared: tuple[str, ...] | list[str], text: tuple[str, ...]) -> list[Column]:
    return [squeezed(c) if c in text else F.col(c) for c in compared]


# ---------------------------------------------------------------------------------------------------------------
# a kept index


class SnapshotIndex:
    """A bucketed key-to-hash index of the last snapshot, kept as a table in ``path``.

    ``probe`` gives the changes of a new snapshot against it, ``fetch`` the old rows of changed keys, ``swap`` puts the new
    index in its place.  Where a snapshot has a key more than once with different values, the hash covers the sorted hashes of
    its distinct rows.  Generations are written beside one another, and a generation holds from the moment its marker,
    an empty file, is made, so a failure at any point leaves the index of before.  No other error than a path that isn't
    there means that there is no index yet."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], compared: list[str], text: tuple[str, ...] = ("text",), buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.compared = _values(compared, text)

    def index(self, df: DataFrame) -> DataFrame:
        """keys, h, bucket: one row for each key."""
        rows = df.select(*self.keys, F.hex(row_hash(*self.compared)).alias("h"))
        one = rows.groupBy(*self.keys).agg(F.unhex(F.md5(F.array_join(F.array_sort(F.collect_set("h")), "").cast("binary"))).alias("h"))
        return one.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _fs(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def generations(self) -> list[int]:
        """The generations with a marker, in order."""
        fs, where = self._fs()
        if not fs.exists(where):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return sorted(int(n.removesuffix(".holds")) for n in names if n.endswith(".holds"))

    def current(self) -> str | None:
        """The table of the newest generation that holds."""
        there = self.generations()
        return f"{self.path}/{there[-1]:08d}" if there else None

    def probe(self, new: DataFrame) -> DataFrame:
        """keys, bucket, change: 'added', 'removed' or 'changed'.  Without an index everything is added; null keys match null
        keys.  Index and rows meet bucket by bucket."""
        fresh = self.index(new)
        at = self.current()
        old = self.spark.read.schema(fresh.schema).parquet(at) if at else fresh.where("false")
        keys = ["bucket", *self.keys]
        o = old.select(*keys, F.col("h").alias("o_h"))
        n = fresh.select(*(F.col(k).alias(f"n_{k}") for k in keys), "h")
        on = [F.col("bucket") == F.col("n_bucket"), *(F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in self.keys)]
        change = F.when(F.col("o_h").isNull(), F.lit("added")).when(F.col("h").isNull(), F.lit("removed")).when(F.col("h") != F.col("o_h"), F.lit("changed"))
        both = o.join(n, on, "full").withColumn("change", change).where("change is not null")
        return both.select(*(F.when(F.col("o_h").isNull(), F.col(f"n_{k}")).otherwise(F.col(k)).alias(k) for k in (*self.keys, "bucket")), "change")

    def fetch(self, changes: DataFrame, old: DataFrame) -> DataFrame:
        """The old rows of the changed keys only."""
        wanted = changes.where("change = 'changed'").select(*(F.col(k).alias(f"w_{k}") for k in self.keys))
        return old.join(wanted, [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in self.keys], "left_semi")

    def write(self, new: DataFrame) -> int:
        """Write the next generation, which doesn't hold yet; what a failed one left in its place is overwritten."""
        number = (self.generations() or [0])[-1] + 1
        self.index(new).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{number:08d}")
        return number

    def commit(self, number: int) -> None:
        """Let a written generation hold, which is one atomic step, and delete those before the last."""
        fs, marker = self._fs(f"{number:08d}.holds")
        if not fs.createNewFile(marker):
            raise FileExistsError(f"{self.path}: generation {number} was put in place by another writer")
        for old in self.generations()[:-2]:
            fs.delete(self._fs(f"{old:08d}.holds")[1], False)
            fs.delete(self._fs(f"{old:08d}")[1], True)

    def swap(self, new: DataFrame) -> None:
        """Put the index of ``new`` in place of the one that holds."""
        self.commit(self.write(new))


# ---------------------------------------------------------------------------------------------------------------
# a whole history


def run_order(runs: DataFrame, delivered: DataFrame, run: str, scope: list[str], ingested: str) -> DataFrame:
    """run, scope_id, run_number: each run that delivered rows, numbered within its scope, whose id is its first run's.

    Runs of unreadable time come first; ties go by run.  The window sees one row per run; a scope's runs are one partition."""
    with_rows = runs.dropDuplicates([run]).join(delivered.select(run).where(F.col(run).isNotNull()).distinct(), run)
    w = Window.partitionBy(*scope).orderBy(F.expr(f"try_to_timestamp({ingested})").asc_nulls_first(), F.col(run))
    return with_rows.select(run, F.xxhash64(F.first(run).over(w)).alias("scope_id"), F.row_number().over(w).alias("run_number"))


_CHANGES = "scope_id long, run_number int, key string, change string"


def _through_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: rows (scope_id, run_number, key, h) sorted by all four.  Each run's rows probe the index of the run
    before; then the run's own index takes its place."""
    schema = pa.schema([("scope_id", pa.int64()), ("run_number", pa.int32()), ("key", pa.string()), ("change", pa.string())])
    at: tuple[int, int] | None = None  # the run that is being read
    index: dict = {}  # of the run before it in this scope
    new: dict = {}  # of the run that is being read
    key, many = None, []  # hashes of the key that is being read
    out: list[tuple] = []

    def close_key() -> None:
        if many:
            new[key] = many[0] if len(many) == 1 else hashlib.md5(b"".join(many)).digest()

    def removed(keys, run_number: int) -> None:
        out.extend((at[0], run_number, k, "removed") for k in keys)

    def close_run() -> None:
        """Probe the old index with the new one, and swap them."""
        nonlocal index, new
        scope, number = at
        if number > 1:
            for k, h in new.items():
                old = index.pop(k, None)
                if old is None:
                    out.append((scope, number, k, "added"))
                elif old != h:
                    out.append((scope, number, k, "changed"))
            removed(index, number)
        index, new = new, {}

    for batch in batches:
        for scope, number, k, h in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if at != (scope, number):
                if at is not None:
                    close_key()
                    close_run()
                    # a run without a row in this bucket, in the scope's middle or at its end, removes all of the bucket's keys; one
                    # after the scope's last run isn't in the order of runs, which these rows are joined with
                    if at[0] != scope or number > at[1] + 1:
                        removed(index, at[1] + 1)
                        index = {}
                at, key, many = (scope, number), k, [h]
            elif k != key:
                close_key()
                key, many = k, [h]
            elif h != many[-1]:
                many.append(h)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
    if at is not None:
        close_key()
        close_run()
        removed(index, at[1] + 1)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def snapshot_changes(
    rows: DataFrame,
    runs: DataFrame,
    key: str = "citation",
    compared: tuple[str, ...] = ("text", "part", "division", "valid_to"),
    text: tuple[str, ...] = ("text",),
    run: str = "version_id",
    scope: tuple[str, ...] = ("act", "language"),
    ingested: str = "ingested_at",
) -> DataFrame:
    """run, key, change: for each run with rows, what it added, removed or changed against the run with rows before it
    in its scope (the scope of the run table; that of the rows isn't trusted).

    Rows shrink to distinct (scope, run, key, hash) by partial aggregation, so repeats of a row, however many, are sent once a
    task; buckets are partitions by (scope, key).  A run without a predecessor has no changes; rows of unknown runs are
    ignored; a null key is a key; of several rows of a key the distinct ones count; columns that are null on both sides are
    equal; null and '' differ.  Empty tables give an empty result."""
    order = run_order(runs, rows, run, list(scope), ingested)
    hashed = rows.where(F.col(run).isNotNull()).select(F.col(run), F.col(key).cast("string").alias("key"), row_hash(*_values(compared, text)).alias("h"))
    placed = hashed.join(order, run).select("scope_id", "run_number", "key", "h").distinct()
    buckets = placed.repartition("scope_id", "key").sortWithinPartitions("scope_id", "run_number", "key", "h")
    changes = buckets.mapInArrow(_through_runs, _CHANGES)
    return changes.join(order, ["scope_id", "run_number"]).select(run, F.col("key").cast(rows.schema[key].dataType).alias(key), "change")


def changed_values(
    rows: DataFrame,
    runs: DataFrame,
    changes: DataFrame,
    key: str = "citation",
    compared: tuple[str, ...] = ("text", "part", "division", "valid_to"),
    text: tuple[str, ...] = ("text",),
    run: str = "version_id",
    scope: tuple[str, ...] = ("act", "language"),
    ingested: str = "ingested_at",
) -> DataFrame:
    """run, key and, for each compared column, ``old_`` and ``new_`` value: fetched for the changed keys of ``changes`` only,
    whose rows of the run and of the run before it are looked up.  Of several distinct rows of a key the largest stands."""
    order = run_order(runs, rows, run, list(scope), ingested)
    before = order.select(F.col(run).alias("__before"), "scope_id", (F.col("run_number") + 1).alias("run_number"))
    wanted = changes.where("change = 'changed'").select(run, F.col(key).alias("__key")).join(order, run).join(before, ["scope_id", "run_number"])
    sides = wanted.select(F.col(run).alias("__of"), "__key", F.explode(F.array(F.struct(F.col(run).alias("v"), F.lit(True).alias("new")), F.struct(F.col("__before").alias("v"), F.lit(False).alias("new")))).alias("side"))
    values = F.struct(*(c.alias(n) for n, c in zip(compared, _values(compared, text))))
    found = rows.select(run, key, values.alias("__v")).join(sides, (F.col(run) == F.col("side.v")) & F.col(key).eqNullSafe(F.col("__key")))
    one = found.groupBy("__of", "__key").agg(F.max(F.when(~F.col("side.new"), F.col("__v"))).alias("o"), F.max(F.when(F.col("side.new"), F.col("__v"))).alias("n"))
    return one.select(F.col("__of").alias(run), F.col("__key").alias(key), *(F.col(f"{s}.{c}").alias(f"{name}_{c}") for c in compared for s, name in (("o", "old"), ("n", "new"))))


def change_counts(changes: DataFrame, run: str = "version_id") -> DataFrame:
    """Records added, removed and changed for each run that has any."""
    return changes.groupBy(run).agg(*(F.count_if(F.col("change") == x).alias(f"chunks_{x}") for x in ("added", "removed", "changed")))
