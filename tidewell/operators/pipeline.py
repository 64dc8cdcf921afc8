"""Loads of several steps: a statute into its kept tables, and scraped links into a catalogue.

Tables lie side by side under one folder: ``points`` (chunks by the name-based UUID of their text), ``runs`` (one row a load) and
``vocabulary`` (a TF-IDF index by language).  Deltas are taken before anything is overwritten."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.catalog import content_points, delta_sizes, new_rows, purge, read_or_empty, staged_overwrite, upsert, version_exists
from tidewell.operators.index import LexicalIndex
from tidewell.schemas import DOCUMENT_RECORD, INGESTION_RUNS
from tidewell.session import scratch


def load_statutes(
    spark: SparkSession, chunks: DataFrame, out: str, act: str, language: str, source: str = "", consolidated_as_of: str | None = None, amending_act: str = "", force: bool = False, now: dt.datetime | None = None
) -> DataFrame:
    """Load the chunks of one act and language: delta against what is there, purge of that act and language, upsert of points by
    content, the language's index, and a record of the run, which comes back as one row.

    A delivery whose text is that of a recorded run (by a hash over the set of its chunks) is not loaded again
    unless ``force``; the run of before comes back.  Each table is replaced by renames, the record last, so a load that failed is
    run again as a whole."""
    with scratch(spark) as keep:
        points = keep(content_points(chunks))
        # of distinct texts, so an exclusive or of their hashes stands for the set of them
        halves = [F.bit_xor(F.conv(F.substring(F.md5("text"), at, 15), 16, 10).cast("long")) for at in (1, 16)]
        whole = points.agg(F.count("*").alias("n"), *(h.alias(f"h{i}") for i, h in enumerate(halves))).first()
        digest = f"set:{whole['n']}-{whole['h0'] or 0:015x}{whole['h1'] or 0:015x}"
        runs = read_or_empty(spark, f"{out}/runs", INGESTION_RUNS)
        if not force and version_exists(runs, digest, act, language):
            return runs.where((F.col("version_hash") == digest) & (F.col("act") == act) & (F.col("language") == language))
        old = read_or_empty(spark, f"{out}/points", points.schema)
        mine = old.where((F.col("act") == act) & (F.col("language") == language))
        delta = delta_sizes(mine, points, "point_id").first()
        staged_overwrite(spark, upsert(purge(old, act=act, language=language), points, ["point_id"]), f"{out}/points")
        LexicalIndex(spark, f"{out}/vocabulary", "tfidf").fit(spark.read.parquet(f"{out}/points"), "point_id", "text", "language", most=100_000)
        at = (now or dt.datetime.now(dt.timezone.utc)).isoformat()
        told = {
            "version_id": f"{act}-{language}-{at}", "act": act, "language": language, "consolidated_as_of": consolidated_as_of, "ingested_at": at, "source_url": source, "version_hash": digest,
            "chunk_count": whole["n"], "chunks_added": delta["added"], "chunks_removed": delta["removed"], "amending_act": amending_act,
        }
        record = spark.createDataFrame([tuple(told.get(f.name) for f in INGESTION_RUNS)], INGESTION_RUNS)
        staged_overwrite(spark, keep(runs.unionByName(record)), f"{out}/runs")
        return spark.read.parquet(f"{out}/runs").where(F.col("version_id") == told["version_id"])


def merge_catalogue(spark: SparkSession, found: DataFrame, path: str) -> int:
    """Add the documents of ``found`` that the catalogue lacks; their number comes back.  Known documents stay as they are."""
    with scratch(spark) as keep:
        there = read_or_empty(spark, path, DOCUMENT_RECORD)
        fresh = keep(new_rows(found, there, "doc_id"))
        n = fresh.count()
        if n:
            rows = fresh.select(*((F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENT_RECORD))
            staged_overwrite(spark, keep(there.unionByName(rows)), path)
    return n


def to_download(spark: SparkSession, catalogue: DataFrame, landed: DataFrame, path: str = "local_path") -> DataFrame:
    """Records whose file hasn't landed yet (a list of paths), for a fetcher outside of Spark, with where each is to go."""
    wanted = catalogue.withColumn(path, F.coalesce(F.col(path), F.concat(F.lower("institution"), F.lit("/"), F.col("doc_id"), F.lit("."), F.coalesce(F.lower("format"), F.lit("pdf")))))
    return wanted.join(landed.select(F.col(landed.columns[0]).alias(path)), path, "left_anti")
