"""Where intermediate tables go, and small pieces that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose checksum leaves this remainder modulo 3 are held out of all learning.
HELD_OUT = 1
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, a fresh temporary one if all run in one process, as in tests; on a cluster that is an error,
    for each machine would write to a folder of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost nothing.

    Spark is asked to delete the shuffle files of the step as soon as it has been written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.plumbline_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark keeps it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            remove(df.sparkSession, df.plumbline_path)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves the held-out remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == HELD_OUT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
