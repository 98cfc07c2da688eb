"""Write rules of the metadata tables as joins: first wins, last wins, cascades, expiry, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(existing: DataFrame, new: DataFrame, *keys: str, order: str) -> DataFrame:
    """The new rows to append: one a key, the first by `order`, whose key does not exist."""
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")
    return first.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def upsert(existing: DataFrame, new: DataFrame, *keys: str, order: str) -> DataFrame:
    """The merged table: the last row of each key by `order`, new rows over existing ones."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def without(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def unexpired(rows: DataFrame, created: str, now: Column, seconds: int) -> DataFrame:
    return rows.where(F.col(created) >= now - F.make_dt_interval(secs=F.lit(seconds)))


def filename_digest(name: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), name).cast("binary"), 256)


def file_extension(name: Column) -> Column:
    """The extension in lower case without its dot, or `none` if absent or over ten characters."""
    found = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.]*)$", 1))
    return F.when((found == "") | (F.length(found) > 10), "none").otherwise(found)
