"""What may be shown: attention, ids and counters of released findings, topics, and what is withheld."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as X
from ..functions import vocabulary as V


def attention(text: Column) -> Column:
    """info, review or high, from five features the text has."""
    folded = T.normalize(text)
    found = F.struct(folded.alias("t"), X.kinds_at(X.places(folded, True)).alias("kinds"))

    def level(x: Column) -> Column:
        money, period = F.array_contains(x["kinds"], "currency"), F.array_contains(x["kinds"], "duration")
        ban = T.has_any(x["t"], V.PROHIBITIONS)
        signals = [ban, T.has_any(x["t"], V.OBLIGATIONS), money, period | F.array_contains(x["kinds"], "date"), T.has_any(x["t"], V.CONSEQUENCES)]
        count = sum((s.cast("int") for s in signals[1:]), signals[0].cast("int"))
        return F.when((count >= 4) | (ban & (money | period)), "high").when(count >= 1, "review").otherwise("info")

    return F.get(F.transform(F.array(found), level), F.lit(0))  # values are read once, however often they are asked for


def numbered(findings: DataFrame, prefix: str = "f", group: str = "analysis_id") -> DataFrame:
    """findings with an id by their place among the released ones of their analysis, where they have none."""
    place = F.row_number().over(Window.partitionBy(group, "released").orderBy("pos"))
    made = F.when(F.col("released"), F.format_string(f"{prefix}_%03d", place))
    given = F.when(~T.is_blank(F.col("id")), F.col("id"))
    return findings.withColumn("finding_id", F.when(F.col("released"), F.coalesce(given, made)))


def withheld(findings: DataFrame, *keys: str) -> DataFrame:
    """Released and withheld findings by verification status."""
    out = F.col("released")
    return findings.groupBy(*keys).agg(
        F.count_if(out).alias("released"),
        F.count_if(~out).alias("withheld"),
        *[F.count_if(~out & (F.col("status") == s)).alias(s) for s in ("rejected", "unverified", "partially_verified")],
    )


def overview(findings: DataFrame, *keys: str) -> DataFrame:
    """For each key (an analysis, or none) the topics in fixed order with their findings; the eight named ones always, `other` only if it has any."""
    names = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(t).alias("topic")) for k, t in enumerate([*V.TOPICS, "other"])])
    every = (findings.select(*keys).distinct() if keys else findings.sparkSession.range(1)).select(*keys, F.explode(names).alias("t")).select(*keys, "t.*")
    grouped = findings.withColumn("topic", T.topic(F.col("label"))).groupBy(*keys, "topic").agg(F.sort_array(F.collect_list("finding_id")).alias("findings"))
    rows = every.join(grouped, [*keys, "topic"], "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<string>")))
    return rows.where((F.col("topic") != "other") | (F.size("findings") > 0)).select(*keys, "place", "topic", "findings")


def topics(labels: DataFrame) -> DataFrame:
    return labels.withColumn("topic", T.topic(F.col("label")))
