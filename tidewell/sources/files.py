"""Landed files as tables.  Fetching is a step outside of Spark; these read what it left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.operators.harmonize import only_target
from tidewell.schemas import FEED_A, FEED_A_META, FEED_B, INGESTION_RUNS


def read_json_feed(spark: SparkSession, path: str, schema: StructType = FEED_A, limit: int | None = None, order: list[str] | None = None, lines: bool = False) -> DataFrame:
    """JSON records with a declared schema: fields that are missing are null.  ``lines``: one record a line, so that a file is
    split over tasks; else a file is an array, or records in any layout, and one task."""
    df = spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)
    return _limited(df, limit, order)


def read_csv_feed(spark: SparkSession, path: str, schema: StructType = FEED_B, target: str | None = None, target_column: str = "pcr_target", limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """CSV by header, all text.  The filter comes before the limit, and bytes that aren't UTF-8 are replaced."""
    head = spark.read.option("header", "true").csv(path).columns
    df = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    wanted = df.select(*((F.col(f.name) if f.name in head else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    return _limited(only_target(wanted, target_column, target), limit, order)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEED_A_META).option("multiLine", "true").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INGESTION_RUNS).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """url (the file's path) and html of saved pages."""
    return spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content of binary files, with the hash of the content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("version_hash"))


def union_of_files(spark: SparkSession, paths: list[str], read) -> DataFrame | None:
    """The union of the files that can be read; None if none can.  A file that fails is left out, and named by a warning."""
    import warnings

    out = None
    for p in paths:
        try:
            one = read(spark, p)
            one.schema  # noqa: B018 - analysis finds a missing file
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"{p} is left out: {e!s:.200}", stacklevel=2)
            continue
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_sample_json(df: DataFrame, path: str, order: list[str], n: int = 20) -> None:
    df.orderBy(*order).limit(n).write.mode("overwrite").json(path)


def _limited(df: DataFrame, limit: int | None, order: list[str] | None) -> DataFrame:
    if limit is None:
        return df
    return (df.orderBy(*order) if order else df).limit(limit)
