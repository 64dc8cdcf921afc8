"""Readings in the common unit of their quantity (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewell.functions.units import conversion_table, unit_key

_SEPARATOR = "\x1f"
_TABLE = "node string, common_unit string, log boolean, a double, b double"


@F.arrow_udf(StringType())
def _unit_keys(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each distinct text of a batch (unit, separator, method) is parsed once; the parser also remembers what it has seen."""
    for column in columns:
        coded = column.dictionary_encode()
        keys = pa.array([unit_key(*text.split(_SEPARATOR, 1)) for text in coded.dictionary.to_pylist()], pa.string())
        yield keys.take(coded.indices)


def harmonize_units(
    df: DataFrame, value: str = "concentration_value", unit: str = "concentration_unit", method: str = "normalization_method", assume_common: bool = False
) -> DataFrame:
    """Add ``common_value``, ``common_unit`` and ``is_common_unit`` to ``df``.

    The stated unit is parsed to a node of the conversion graph and a plain number before it (2.5 of "per 250 mL" is 1 / 2.5
    of "per 100 mL"), and the node equi-joined with the composed conversions.  The table has one row for each node of the
    grammar (a few thousand, whatever the data), so it is broadcast; every unit that is read has a node in it.

    No stated unit: the three columns are null (with ``assume_common``, the value passes through and the unit stays
    null).  Null, NaN or overflowing values: ``common_value`` is null.  Columns of ``df`` with these three names are
    replaced; all other columns pass through; repeated rows stay repeated."""
    spark = df.sparkSession
    out = ["common_value", "common_unit", "is_common_unit"]
    df = df.drop(*out)
    table = spark.createDataFrame(conversion_table(), _TABLE).select(*(F.col(c).alias(f"__cv_{c}") for c in ("node", "common_unit", "log", "a", "b")))
    x = F.col(value).cast("double")
    texts = F.concat(F.coalesce(F.col(unit).cast("string"), F.lit("")), F.lit(_SEPARATOR), F.coalesce(F.col(method).cast("string"), F.lit("")))
    keyed = df.withColumn("__unit_key", _unit_keys(texts)).withColumns(
        {"__times": F.substring_index("__unit_key", "|", 1).cast("double"), "__node": F.substring_index("__unit_key", "|", -4)}
    )
    joined = keyed.join(F.broadcast(table), F.col("__node") == F.col("__cv_node"), "left")
    log, a, b, times = (F.col(c) for c in ("__cv_log", "__cv_a", "__cv_b", "__times"))
    common = F.when(log, F.pow(F.lit(10.0), a * (x + F.log10(times)) + b)).otherwise(a * (times * x) + b)
    if assume_common:
        common = F.when(F.col("__unit_key").isNull(), x).otherwise(common)
    finite = F.when(F.abs(common) < float("inf"), common)
    same = ~log & (F.abs(a * times - 1) < 1e-12) & (b == 0)
    return joined.withColumns(
        {"common_value": finite, "common_unit": F.col("__cv_common_unit"), "is_common_unit": F.when(F.col("__unit_key").isNotNull(), F.coalesce(same, F.lit(False)))}
    ).drop("__unit_key", "__times", "__node", *table.columns)


def off_unit_rows(df: DataFrame, value: str = "concentration_value", unit: str = "concentration_unit", method: str = "normalization_method") -> DataFrame:
    """Rows with a value whose stated unit isn't the common unit of its quantity in scale."""
    return harmonize_units(df, value, unit, method).where(F.col(value).isNotNull() & ~F.col("is_common_unit"))
