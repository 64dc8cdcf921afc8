"""Incremental ingest with Structured Streaming: landed chunk files into keyed tables, beyond what batch runs do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewell.operators.units import harmonize_units
from tidewell.session import file_system


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_new(stream: DataFrame, table: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append the rows of each batch whose key the table lacks, one for each key; a batch that is run again adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        fs, where = file_system(batch.sparkSession, table)
        if fs.exists(where):  # any other trouble with the table is an error
            fresh = fresh.join(batch.sparkSession.read.parquet(table).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_counts(stream: DataFrame, time: str = "received_at", lateness: str = "200 days") -> DataFrame:
    """Readings in common units by week of arrival and unit, as a windowed aggregate that late rows still reach."""
    common = harmonize_units(stream)
    return common.withWatermark(time, lateness).groupBy(F.window(time, "7 days", startTime="4 days"), "common_unit").agg(F.count("*").alias("n"), F.avg("common_value").alias("mean_value"))
