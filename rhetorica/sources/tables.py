"""Parquet table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder, lazily."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Taken from ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process
    (local tests) a temporary folder is made and recorded in the session. A cluster without a
    shared folder raises ``ValueError``.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rhetorica-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors and lets several branches of a plan read
    one result. An empty result keeps its schema. The table is removed when the application ends.
    free: the shuffle files of the write are removed as soon as it is over, not when the driver
    happens to collect its garbage (Spark 4.1 or later; has no effect before).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    _removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _removed_at_end(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked so that a join with it shuffles both sides.

    For rows that come from exploded arrays: Spark takes their size for that of the arrays' files, so
    it would build a broadcast of all of them on the driver. A side marked for broadcast still is.
    """
    return df.hint("merge")


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must be small; more than ``limit`` rows raise ``ValueError``."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; it is meant to be a small table")
    return rows


def sent_if_few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, which are counted first; else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if len(df.take(most + 1)) <= most else df
