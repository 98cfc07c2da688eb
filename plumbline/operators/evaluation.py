"""Evaluation roll-ups: detection and false positives by group, threshold sweeps, coverage of mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _share(part, whole):
    return F.when(whole > 0, F.round(100.0 * part / whole, 1))


def scores(cases: DataFrame) -> DataFrame:
    """cases(family, category, flagged) by family, by category and in all: counts, misses and false alarms in per cent."""
    attack = F.col("family") == "attack"
    grouped = cases.groupingSets([["family"], ["category"], []], "family", "category").agg(
        F.count("*").alias("cases"),
        F.count_if(attack).alias("attacks"),
        F.count_if(attack & F.col("flagged")).alias("detected"),
        F.count_if(~attack).alias("legitimate"),
        F.count_if(~attack & ~F.col("flagged")).alias("released"),
    )
    return grouped.withColumn("missed_pct", _share(F.col("attacks") - F.col("detected"), F.col("attacks"))).withColumn("false_pct", _share(F.col("legitimate") - F.col("released"), F.col("legitimate")))


def sweep(cases: DataFrame, thresholds: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """cases(case_id, family, overlap) judged at each threshold: misses, false alarms, and cases that changed since the last one."""
    steps = F.array(*map(F.lit, thresholds))
    rows = cases.select("case_id", "family", "overlap", F.explode(steps).alias("threshold")).withColumn("flagged", F.col("overlap") < F.col("threshold"))
    before = F.lag("flagged").over(Window.partitionBy("case_id").orderBy("threshold"))
    rows = rows.withColumn("changed", before.isNotNull() & (before != F.col("flagged")))
    attack = F.col("family") == "attack"
    return rows.groupBy("threshold").agg(F.count_if(attack & ~F.col("flagged")).alias("missed"), F.count_if(~attack & F.col("flagged")).alias("false_alarms"), F.count_if("changed").alias("changed"))
