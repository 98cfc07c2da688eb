"""The typed value index of pages: amounts, percentages, periods and dates as written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as X

#: Published kinds in their order.
KINDS = ("currency", "percentage", "duration", "date")


def as_written(page: Column, raw: Column) -> Column:
    """The first occurrence of raw in the page whatever its case; raw itself where spacing was folded."""
    at = F.position(F.lower(raw), F.lower(page))
    return F.when(at > 0, F.substring(page, at, F.length(raw))).otherwise(raw)


def value_index(pages: DataFrame) -> DataFrame:
    """document_id, page_number, kind, value, ambiguous: values of each page once, the first in extraction order."""
    folded = pages.where(F.col("text").rlike("[0-9]") | F.lower("text").rlike("(day|week|month|year|hour)s?")).select("document_id", "page_number", "text", T.normalize(F.col("text")).alias("folded"))
    found = F.filter(X.written(F.col("folded"), True), lambda v: v["kind"].isin(*KINDS))
    rows = folded.select("document_id", "page_number", "text", F.posexplode(found).alias("pos", "v"))
    rows = rows.select("document_id", "page_number", "pos", "v.kind", as_written(F.col("text"), F.col("v.raw")).alias("value"), "v.ambiguous")
    first = Window.partitionBy("document_id", "page_number", "kind", F.lower("value")).orderBy("pos")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "pos")


def elsewhere(index: DataFrame) -> DataFrame:
    """document_id, kind, value, page_number and the other pages of the document with the same value, ascending."""
    pages = index.groupBy("document_id", "kind", "value").agg(F.sort_array(F.collect_set("page_number")).alias("pages"))
    rows = index.select("document_id", "kind", "value", "page_number").join(pages, ["document_id", "kind", "value"])
    return rows.withColumn("elsewhere", F.array_remove("pages", F.col("page_number"))).drop("pages")


def kind_counts(index: DataFrame) -> DataFrame:
    """Values by kind, with the row All for their total."""
    return index.rollup("kind").count().select(F.coalesce("kind", F.lit("All")).alias("kind"), F.col("count").alias("n"))
