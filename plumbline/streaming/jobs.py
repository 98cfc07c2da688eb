"""Job events: the state of every job, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last event of each key; ties go to the greater `tie`. Partial maxima keep hot keys cheap."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("x")).select(key, "x.*")


def progress(events: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """A stream's events a key and minute, closed once the watermark passes."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 minute"), key).agg(F.count("*").alias("n"), F.max(at).alias("last"))


def once(events: DataFrame, *keys: str, at: str, late: str = "10 minutes") -> DataFrame:
    """A stream without repeated events; their keys are forgotten once the watermark passes."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def submissions(events: DataFrame) -> DataFrame:
    """events(document_id, seq, event, language) with the decision on each submit: new, reuse or conflict.

    A job is active from its submit until `completed` or `failed`. The same language reuses an
    active or completed job; another language conflicts with an active one and otherwise starts
    anew, as anything does after a failure. One document's events are folded in order.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "event", "language")))
    start = F.struct(F.lit("none").alias("state"), F.lit(None).cast("string").alias("language"), F.array().cast("array<struct<seq:bigint,decision:string>>").alias("out"))

    def step(s, e):
        submit = e["event"] == "submit"
        same = s["language"].eqNullSafe(e["language"])
        decision = F.when((s["state"] == "active") & ~same, "conflict").when(same & s["state"].isin("active", "completed"), "reuse").otherwise("new")
        state = F.when(submit, F.when(decision == "new", "active").otherwise(s["state"])).when(s["state"] == "active", e["event"]).otherwise(s["state"])
        language = F.when(submit & (decision == "new"), e["language"]).otherwise(s["language"])
        row = F.struct(e["seq"].cast("bigint").alias("seq"), decision.alias("decision"))
        return F.struct(state.alias("state"), language.alias("language"), F.when(submit, F.array_append(s["out"], row)).otherwise(s["out"]).alias("out"))

    folded = events.groupBy("document_id").agg(F.aggregate(ordered, start, step, lambda s: s["out"]).alias("out"))
    return folded.select("document_id", F.explode("out").alias("x")).select("document_id", "x.seq", "x.decision")
