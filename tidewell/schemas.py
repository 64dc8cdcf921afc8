"""Declared schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _struct(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t) for n, t in fields])


def _strings(names: str) -> list[tuple[str, object]]:
    return [(n, StringType()) for n in names.split()]


CANONICAL = _struct(
    *_strings("site_id jurisdiction collection_date target_name"), ("concentration_value", DoubleType()), *_strings("concentration_unit normalization_method data_source")
)
FEED_A = _struct(*_strings("key_plot_id date pcr_conc_lin normalization"))
FEED_A_META = _struct(*_strings("key_plot_id wwtp_id reporting_jurisdiction county_names population_served"))
FEED_B = _struct(*_strings("site_id reporting_jurisdiction sample_collect_date pcr_target pcr_target_avg_conc pcr_target_units other_norm_name data_source"))
DOCUMENT_RECORD = _struct(*_strings("doc_id institution doc_type date title url local_path format"))
CHUNK = _struct(*_strings("chunk_id doc_id institution doc_type date title url text"), ("page_num", IntegerType()), ("chunk_idx", IntegerType()))
STATUTE_CHUNK = _struct(
    *_strings("act part division section subsection paragraph citation text context_prefix language valid_from valid_to amending_act version_hash"), ("token_count", IntegerType())
)
INGESTION_RUNS = _struct(
    *_strings("version_id act language consolidated_as_of ingested_at source_url version_hash"),
    ("chunk_count", IntegerType()), ("chunks_added", IntegerType()), ("chunks_removed", IntegerType()), ("amending_act", StringType()),
)
EVAL_ITEM = _struct(("item_id", LongType()), ("query", StringType()), ("expected_citations", ArrayType(StringType())), ("topic", StringType()))
VECTOR = _struct(("chunk_id", StringType()), ("embedding", ArrayType(FloatType())))
RETRIEVED = _struct(*_strings("citation text"), ("score", DoubleType()), *_strings("language valid_from valid_to amending_act section subsection paragraph part division"))
VERSION = _struct(*_strings("version_id act language ingested_at"), ("is_current", BooleanType()), ("unchanged", IntegerType()))
SECTION = StructType(
    [
        *(StructField(n, StringType()) for n in ("part", "division", "section", "marginal_note")),
        StructField(
            "subsections",
            ArrayType(
                StructType(
                    [
                        StructField("label", StringType()),
                        StructField("intro", StringType()),
                        StructField("paragraphs", ArrayType(StructType([StructField("label", StringType()), StructField("text", StringType())]))),
                    ]
                )
            ),
        ),
        *(StructField(n, StringType()) for n in ("language", "valid_from", "amending_act")),
    ]
)


def drift(df: DataFrame, declared: StructType) -> DataFrame:
    """column, declared, found: where a live table departs from its declared schema (a schema probe)."""
    live = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in declared}
    rows = [(c, want.get(c), live.get(c)) for c in sorted(live.keys() | want.keys()) if want.get(c) != live.get(c)]
    return df.sparkSession.createDataFrame(rows, "column string, declared string, found string")


def conform(df: DataFrame, declared: StructType) -> DataFrame:
    """The declared columns in their order; missing ones are null, others are dropped."""
    from pyspark.sql import functions as F

    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared))
