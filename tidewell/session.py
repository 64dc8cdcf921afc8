"""Session defaults and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings their own."""
    builder = SparkSession.builder.master(master).appName("tidewell").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (DEFAULTS | {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one, else a temporary one, for
    local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='tidewell-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    fs, where = file_system(spark, made)
    fs.deleteOnExit(where)
    return made


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its own."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = file_system(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends, and a lost executor costs no recomputation.

    The files are there as long as the application, as the result may be read at any time; they are deleted at its end."""
    return _written(df)[0]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``materialize`` for what nothing needs after the block: the files are deleted at its end."""
    made: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out, path = _written(df)
        made.append(path)
        return out

    try:
        yield keep
    finally:
        for path in made:
            fs, where = file_system(spark, path)
            fs.delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in at least as many partitions as there are cores: for steps of much CPU over a table that lies in
    few row groups.  A table of more partitions than cores, as any large one is, stays where it lies, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, so that it needn't be installed on them."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="tidewell-package-")) / "tidewell.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(where))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
