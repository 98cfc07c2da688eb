"""Tables that a computation uses several times: written once to the folder that driver and executors share.

A stage also ends the lineage, so a lost executor costs nothing that was done before it, and
plans stay small. Tables stay in the folder, as a returned result may still read them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process, a fresh temporary folder; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt over enough tasks for work that is heavy for its bytes, by keys or in turn.

    Spark joins small partitions of a shuffle by their bytes, so some ten thousand rows would all be worked on by one task; a
    number that is asked for stays as it is.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(rows: DataFrame, texts: dict[str, Column], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that made() adds to `texts`, worked out once for all rows whose texts are equal.

    Rows carry a digest of their texts. It is joined with what was made, which Spark broadcasts where it is small.
    """
    keys = {name: F.coalesce(t, F.lit("")) for name, t in texts.items()}
    parts = F.concat_ws("\u0003", *[x for name in keys for x in (F.length(name), F.col(name))])
    rows = staged(rows.withColumns(keys).withColumn("__digest", F.sha2(parts, 256)), "rows")  # read for the texts and for the join
    results = staged(made(spread(rows.select("__digest", *keys).distinct())).drop(*keys), "made")
    return rows.drop(*keys).join(results, "__digest").drop("__digest")
