"""Whole rows or texts, each distinct one once, without sorting texts and without a hot task for a hot text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(*columns: Column) -> Column:
    """128 bits over the columns, null apart from every value."""
    if len(columns) == 1:
        return F.unhex(F.md5(columns[0].cast("binary")))
    return F.unhex(F.md5(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}).cast("binary")))


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose hash (the first column) this task hasn't seen; it remembers 16 bytes a row, not texts."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, h in enumerate(batch.column(0).to_pylist()):
            if h not in seen:
                seen.add(h)
                keep.append(i)
        if len(keep) == batch.num_rows:
            yield batch
        elif keep:
            yield batch.take(pa.array(keep, pa.int64()))


def distinct_by_hash(df: DataFrame) -> DataFrame:
    """One row for each value of ``h``, the first column (16 bytes, not null).

    Copies are dropped within each map task first, so a text that a third of all rows share is sent once a task; then
    rows are partitioned by hash, and dropped again.  Which of equal rows stays doesn't matter, as they are equal."""
    once = df.mapInArrow(_first_seen, df.schema).repartition("h")
    return once.mapInArrow(_first_seen, df.schema)


def as_strings(column: pa.Array) -> list[str | None]:
    return pc.cast(column, pa.large_string()).to_pylist() if not pa.types.is_string(column.type) else column.to_pylist()


SALTS = 64


def salt_of(*keys: Column) -> Column:
    """A small number by a row's key, which spreads the copies of a hot text."""
    return F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, salt, text) whose pair this task hasn't seen, with the text only where it hasn't seen h."""
    seen: set[bytes] = set()
    sent: set[bytes] = set()
    for batch in batches:
        keep, text = [], []
        for i, (h, salt) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            pair = h + bytes((salt,))  # less to remember than a tuple
            if pair not in seen:
                seen.add(pair)
                keep.append(i)
                text.append(h not in sent)
                sent.add(h)
        if keep:
            some = batch.take(pa.array(keep, pa.int64()))
            column = some.column(2)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pc.if_else(pa.array(text), column, pa.scalar(None, column.type))], names=["h", "salt", "text"])


def distinct_pairs(df: DataFrame) -> DataFrame:
    """``df`` (h, salt, text) with each pair of h and salt once a task and the text once a task, partitioned by h: all pairs of a
    text meet where it is, and rows can be joined on both, so that those of a hot text are in as many groups as there are
    salts."""
    return df.mapInArrow(_first_pairs, df.schema).repartition("h")
