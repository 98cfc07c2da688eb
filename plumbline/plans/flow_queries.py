"""Queries over events: the document store, stage flow, and rows of the metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flow
from ..sources import metadata
from ..streaming import store
from .queries import doc_pages
from .registry import query, table

DAY = 86_400


def store_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of a document store: a user is a document."""
    kind = F.col("event_type")
    action = F.when(kind == "signup", "create").when(kind == "purchase", "delete").when(kind == "click", "submit").otherwise("get")
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), "ts", F.col("event_id").alias("seq"), action.alias("action"))


_LOG = f"""e AS (SELECT user_id AS document_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'delete' WHEN 'click' THEN 'submit' ELSE 'get' END AS action FROM events),
c AS (SELECT *, CASE WHEN action IN ('create', 'delete') THEN {{'action': action, 'ts': ts, 'seq': seq}} END AS change FROM e),
p AS (SELECT *, last_value(change IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(change IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM c),
t AS (SELECT *, coalesce(b.action = 'create' AND b.ts >= ts - INTERVAL {DAY} SECOND, false) AS there FROM p)"""


@query("a18_store_outcomes", f"""WITH {_LOG} SELECT document_id, seq, action, CASE action WHEN 'create' THEN CASE WHEN there THEN 'replaced' ELSE 'created' END WHEN 'get' THEN CASE WHEN there THEN 'found' ELSE 'not_found' END
  WHEN 'submit' THEN CASE WHEN there THEN 'accepted' ELSE 'refused' END ELSE CASE WHEN there THEN 'deleted' ELSE 'absent' END END AS outcome FROM t""")
def _(spark, d):
    return store.outcomes(store_log(spark, d), DAY).select("document_id", "seq", "action", "outcome")


@query("i06_lifetimes", f"""WITH {_LOG}, j AS (SELECT document_id, b.seq AS seq, count(*) AS jobs FROM t WHERE action = 'submit' AND there GROUP BY ALL),
m AS (SELECT document_id, ts, seq, a, ts + INTERVAL {DAY} SECOND AS expiry, (SELECT max(ts) FROM events) AS now FROM t WHERE action = 'create')
SELECT document_id, seq, CASE WHEN a.ts <= expiry THEN a.ts WHEN expiry < now THEN expiry END AS ended_at, CASE WHEN a.ts <= expiry THEN CASE a.action WHEN 'delete' THEN 'deleted' ELSE 'replaced' END WHEN expiry < now THEN 'expired' ELSE 'live' END AS fate,
  coalesce(jobs, 0) AS jobs FROM m LEFT JOIN j USING (document_id, seq)""")
def _(spark, d):
    log = store_log(spark, d)
    newest = log.agg(F.max("ts")).first()[0]
    return store.lifetimes(log, DAY, F.lit(newest).cast("timestamp")).drop("created_at")


@query("i08_forgotten_jobs", f"""WITH {_LOG} SELECT document_id, seq FROM t WHERE action = 'submit' AND there AND NOT coalesce(a.ts <= b.ts + INTERVAL {DAY} SECOND, false) AND b.ts + INTERVAL {DAY} SECOND >= (SELECT max(ts) FROM events)""")
def _(spark, d):
    """Jobs that are still known at the end: those of documents that are still there."""
    log = store_log(spark, d)
    newest = log.agg(F.max("ts")).first()[0]
    return store.known_jobs(log, DAY, F.lit(newest).cast("timestamp")).select("document_id", "seq")


def stage_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as the log of analyses: a user's events of a week are the steps of one job, errors are failures."""
    job = F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)
    return table(spark, d, "events").select(job.alias("job_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"), "user_id")


_STAGES = "[" + ", ".join(f"'{s}'" for s in flow.STAGES) + "]"
_CATEGORIES = "[" + ", ".join(f"'{s}'" for s in flow.CATEGORIES) + "]"
_STEPS = f"""RECURSIVE s AS (SELECT user_id * 10 + (day(ts) - 1) // 7 AS job_id, event_id AS seq, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id, (day(ts) - 1) // 7 ORDER BY event_id) AS n FROM events),
r(job_id, step, seq, failed) AS (SELECT job_id, 1::BIGINT, seq, failed FROM s WHERE n = 1 UNION ALL
  SELECT s.job_id, s.n, s.seq, s.failed FROM r JOIN s ON s.job_id = r.job_id AND s.n = r.step + 1 WHERE NOT r.failed AND r.step < {len(flow.STAGES)}),
f AS (SELECT job_id, max(step) AS steps, bool_or(failed) AS broke FROM r GROUP BY job_id)"""


@query("i01_stage_flow", f"""WITH {_STEPS} SELECT job_id, seq, step::INT AS step, CASE WHEN NOT failed THEN {_STAGES}[step] END AS finished, CASE WHEN NOT failed THEN list_append({_STAGES}, 'done')[step + 1] END AS entered,
  CASE WHEN failed THEN {_CATEGORIES}[step] END AS category FROM r""")
def _(spark, d):
    return flow.reported(stage_log(spark, d))


@query("i07_job_ends", f"""WITH {_STEPS} SELECT job_id, steps, CASE WHEN NOT broke AND steps = {len(flow.STAGES)} THEN 'completed' ELSE 'failed' END AS status,
  list_append(list_prepend('queued', {_STAGES}), 'done')[CASE WHEN broke THEN steps WHEN steps = {len(flow.STAGES)} THEN steps + 2 ELSE steps + 1 END] AS stage,
  CASE WHEN broke THEN {_CATEGORIES}[steps] WHEN steps < {len(flow.STAGES)} THEN 'internal_error' END AS category FROM f""")
def _(spark, d):
    return flow.unfinished(flow.finished(stage_log(spark, d)))


@query("i10_notes_eligibility", f"""WITH {_STEPS}, n AS (SELECT user_id * 10 + (day(ts) - 1) // 7 AS job_id, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY 1)
SELECT job_id, CASE WHEN NOT broke AND steps = {len(flow.STAGES)} THEN CASE WHEN n < 2 THEN 'skipped' ELSE 'pending' END END AS notes FROM f JOIN n USING (job_id)""")
def _(spark, d):
    released = table(spark, d, "events").where("event_type = 'purchase'").select((F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)).alias("job_id"), F.col("event_id").alias("finding_id"))
    return flow.eligible_for_notes(flow.unfinished(flow.finished(stage_log(spark, d))), released, True)


@query("f06_latest_completed", f"""WITH {_STEPS}, l AS (SELECT job_id // 10 AS user_id, max(job_id) AS job_id FROM f GROUP BY 1)
SELECT user_id, job_id, NOT broke AND steps = {len(flow.STAGES)} AS available FROM l JOIN f USING (job_id)""")
def _(spark, d):
    jobs = flow.unfinished(flow.finished(stage_log(spark, d))).withColumn("user_id", F.floor(F.col("job_id") / 10))
    return flow.latest_completed(jobs, "user_id", "job_id", "job_id")


@query("a20_document_rows", r"""WITH c AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, len(regexp_extract_all(text, '[\x{0B80}-\x{0BFF}]')) AS t, len(regexp_extract_all(text, '[a-zA-ZÀ-ÖØ-öø-ɏ]')) AS l, len(regexp_extract_all(text, '\pL')) AS k FROM documents),
f AS (SELECT doc_id, source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '' ELSE '.tar.gz' END AS name FROM documents)
SELECT doc_id AS id, sha256('salt' || chr(0) || name) AS filename_sha256, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'none' ELSE 'gz' END AS file_extension, n AS page_count,
  CASE WHEN k = 0 THEN 'other' WHEN t / k >= 0.8 THEN 'ta' WHEN l / k >= 0.8 THEN 'en' WHEN t / k >= 0.05 AND l / k >= 0.05 THEN 'mixed' ELSE 'other' END AS detected_language, '2024-01-31' AS expires_on FROM c JOIN f USING (doc_id)""")
def _(spark, d):
    suffix = F.element_at(F.array(F.lit(".PDF"), F.lit(""), F.lit(".tar.gz")), (F.col("doc_id") % 3 + 1).cast("int"))
    named = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat("source", F.lit("/"), "doc_id", suffix).alias("filename"))
    rows = metadata.document_rows(named, doc_pages(spark, d), "salt", F.lit("2024-01-01").cast("timestamp"))
    return rows.withColumn("expires_on", F.date_format("expires_at", "yyyy-MM-dd")).drop("expires_at")


@query("a20_analysis_rows", f"""WITH {_STEPS}, e AS (SELECT user_id * 10 + (day(ts) - 1) // 7 AS id, count(*) FILTER (event_type = 'view') AS p, count(*) FILTER (event_type = 'view' AND value > 10) AS r,
  count(*) FILTER (event_type = 'click' AND value > 10) AS nr, count(*) FILTER (event_type = 'click' AND value <= 10) AS nw FROM events GROUP BY 1),
j AS (SELECT job_id AS id, NOT broke AND steps = {len(flow.STAGES)} AS done, CASE WHEN broke THEN {_CATEGORIES}[steps] WHEN steps < {len(flow.STAGES)} THEN 'internal_error' END AS kind FROM f)
SELECT id, id // 10 AS document_id, CASE WHEN done THEN 'completed' ELSE 'failed' END AS status, CASE WHEN done AND id % 3 <> 0 THEN 'p' || id % 3 END AS provider, CASE WHEN done AND id % 3 <> 0 THEN 'unknown' END AS model,
  CASE WHEN done AND id % 3 <> 0 AND id % 2 = 1 THEN 'r' END AS reasoning_provider, kind AS failure_kind, CASE WHEN done THEN p ELSE 0 END AS proposed_count, CASE WHEN done THEN r ELSE 0 END AS released_count,
  CASE WHEN done THEN p - r ELSE 0 END AS withheld_count, CASE WHEN done THEN nr ELSE 0 END AS notes_released_count, CASE WHEN done THEN nw ELSE 0 END AS notes_withheld_count FROM j JOIN e USING (id)""")
def _(spark, d):
    done = flow.unfinished(flow.finished(stage_log(spark, d)))
    k, none = F.col("job_id"), F.lit(None).cast("string")
    jobs = done.select(
        k.alias("id"), F.floor(k / 10).alias("document_id"), "status", F.lit("en").alias("language"), F.col("category").alias("failure_kind"), F.lit(0).alias("duration_ms"),
        F.when(k % 3 != 0, F.concat(F.lit("p"), k % 3)).alias("provider"), none.alias("model"), F.lit("r").alias("notes_provider"), none.alias("notes_model"), F.when(k % 2 == 1, "completed").otherwise("disabled").alias("notes_status"),
    )
    events = table(spark, d, "events").select((F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)).alias("analysis_id"), "event_type", (F.col("value") > 10).alias("released"))
    rows = metadata.analysis_rows(jobs, events.where("event_type = 'view'"), events.where("event_type = 'click'"))
    return rows.drop("duration_ms", "reasoning_model", "verification_policy_version", "language", "reasoning_status")
