"""A store of short-lived documents: created, read, used by jobs, deleted, and gone after a while.

The same rules in two forms. `outcomes` and `lifetimes` read a whole log in batch;
`DocumentStore` keeps one document's state in a stream and lets an event-time timer end it.

A document is there from its creation until it is deleted or created anew, and for `seconds`
at most. Reading it or submitting a job for it finds it or not; when it goes, its jobs are
forgotten with it.

Whether a document is there at an event depends on the `seconds` before it only. So the batch
form deals a log out by document and stretch of time, with creations and deletions in the
neighbouring stretches too: one document with very many events is spread over many tasks.

Events without a document or a time, and of unknown kinds, have no outcome. Events at the same
time are taken in the order of seq. Repeated rows are events each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTIONS = ("create", "get", "submit", "delete")
#: What an action comes to where the document is there, and where it is not.
THERE = {"create": "replaced", "get": "found", "submit": "accepted", "delete": "deleted"}
GONE = {"create": "created", "get": "not_found", "submit": "refused", "delete": "absent"}


def _named(action: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, name in names.items():
        out = F.when(action == key, name).otherwise(out)
    return out


def _placed(events: DataFrame, seconds: int) -> DataFrame:
    """Each event with the creation or deletion before it and after it, as far as these can matter."""
    changes = F.col("action").isin("create", "delete")
    stretch = F.floor(F.unix_seconds("ts") / seconds)
    near = F.when(changes, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    valid = events.where(F.col("document_id").isNotNull() & F.col("ts").isNotNull() & F.col("action").isin(*ACTIONS))
    rows = valid.select("document_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "action", F.explode(near).alias("off")).withColumn("stretch", stretch + F.col("off"))
    change = F.when(changes, F.struct("action", "ts", "seq"))
    by = Window.partitionBy("document_id", "stretch")
    first, last = (F.col("ts"), F.col("seq"), F.col("action")), (F.desc("ts"), F.desc("seq"), F.desc("action"))
    earlier, later = (by.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (first, last))
    rows = rows.withColumn("before", F.last(change, True).over(earlier)).withColumn("after", F.last(change, True).over(later))
    span = F.make_dt_interval(secs=F.lit(seconds))
    there = (F.col("before.action") == "create") & (F.col("before.ts") >= F.col("ts") - span)
    return rows.where("off = 0").withColumn("there", F.coalesce(there, F.lit(False))).drop("off", "stretch")


def outcomes(events: DataFrame, seconds: int) -> DataFrame:
    """document_id, ts, seq, action and outcome of events(document_id, ts, seq, action)."""
    found = F.when(F.col("there"), _named(F.col("action"), THERE)).otherwise(_named(F.col("action"), GONE))
    return _placed(events, seconds).select("document_id", "ts", "seq", "action", found.alias("outcome"))


def lifetimes(events: DataFrame, seconds: int, now: Column) -> DataFrame:
    """A row for each creation: created_at, seq, ended_at, how it ended (deleted, replaced, expired, or live at `now`), and the jobs that went with it."""
    placed = _placed(events, seconds)
    span = F.make_dt_interval(secs=F.lit(seconds))
    jobs = placed.where((F.col("action") == "submit") & F.col("there")).groupBy("document_id", F.col("before.seq").alias("seq")).agg(F.count("*").alias("jobs"))
    made = placed.where(F.col("action") == "create").join(jobs, ["document_id", "seq"], "left")
    expiry = F.col("ts") + span
    cut = F.coalesce(F.col("after.ts") <= expiry, F.lit(False))
    fate = F.when(cut & (F.col("after.action") == "delete"), "deleted").when(cut, "replaced").when(expiry < now, "expired").otherwise("live")
    ended = F.when(cut, F.col("after.ts")).when(expiry < now, expiry)
    return made.select("document_id", F.col("ts").alias("created_at"), "seq", ended.alias("ended_at"), fate.alias("fate"), F.coalesce("jobs", F.lit(0)).alias("jobs"))


def known_jobs(events: DataFrame, seconds: int, now: Column) -> DataFrame:
    """document_id, ts and seq of the jobs whose document is still there at `now`; the others were forgotten with theirs."""
    live = lifetimes(events, seconds, now).where("fate = 'live'").select("document_id", F.col("seq").alias("__made"))
    jobs = _placed(events, seconds).where((F.col("action") == "submit") & F.col("there"))
    return jobs.join(live, (jobs["document_id"] == live["document_id"]) & (F.col("before.seq") == F.col("__made"))).select(jobs["document_id"], "ts", "seq")


class DocumentStore(StatefulProcessor):
    """One document's creation time, creation's seq and number of jobs; its timer ends it."""

    SCHEMA = "document_id long, ts timestamp, seq long, action string, outcome string, jobs long"

    def __init__(self, seconds: int):
        self.span = pd.Timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("document", "created timestamp, jobs long")

    def _timer(self, created: pd.Timestamp) -> int:
        """The first whole millisecond at which it is no longer there."""
        return (created + self.span).value // 1_000_000 + 1

    def _ended(self, key: int, created: pd.Timestamp, jobs: int, outcome: str, at: pd.Timestamp, seq: int | None, action: str | None) -> tuple:
        self.handle.deleteTimer(self._timer(created))
        self.state.clear()
        return key, at, seq, action, outcome, jobs

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for event in pd.concat(list(rows)).sort_values(["ts", "seq", "action"]).itertuples(index=False):
            if event.action not in ACTIONS:
                continue
            held = self.state.get() if self.state.exists() else None
            created, jobs = (pd.Timestamp(held[0]), held[1]) if held else (None, 0)
            if held and event.ts > created + self.span and event.action in ("create", "delete"):  # its timer has not fired yet
                out.append(self._ended(key[0], created, jobs, "expired", created + self.span, None, None))
                held = None
            there = held is not None and event.ts <= created + self.span
            outcome = (THERE if there else GONE)[event.action]
            if there and event.action in ("create", "delete"):
                out.append(self._ended(key[0], created, jobs, outcome, event.ts, event.seq, event.action))
            else:
                out.append((key[0], event.ts, event.seq, event.action, outcome, None))
            if event.action == "create":
                self.state.update((event.ts.to_pydatetime(), 0))
                self.handle.registerTimer(self._timer(event.ts))
            elif there and event.action == "submit":
                self.state.update((created.to_pydatetime(), jobs + 1))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            created, jobs = self.state.get()
            created = pd.Timestamp(created)
            if self._timer(created) <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
                out.append((key[0], created + self.span, None, None, "expired", jobs))
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["document_id", "ts", "seq", "action", "outcome", "jobs"])
        return frame.astype({"document_id": "int64", "ts": "datetime64[us]", "seq": "Int64", "action": object, "outcome": object, "jobs": "Int64"})


def stream(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """outcomes() of a stream, with a row for each document that expires, and the jobs that ended documents had.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Events later than the watermark are dropped.
    """
    valid = events.where(F.col("document_id").isNotNull() & F.col("ts").isNotNull())
    keyed = valid.select("document_id", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "action").withWatermark("ts", late).groupBy("document_id")
    return keyed.transformWithStateInPandas(DocumentStore(seconds), DocumentStore.SCHEMA, "Append", "EventTime")
