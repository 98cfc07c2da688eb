"""Documents that expire, stage flow, metadata writes and counters, as streams and in batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import flow
from plumbline.sources import metadata
from plumbline.streaming import store

START = dt.datetime(2024, 1, 1)
EVENTS = "document_id long, ts timestamp, seq long, action string, stretch int, jobs string"


def _log(n, keys, seed=1):
    """Events in order of time, with ties, a hot document, and rows that have no outcome."""
    rng = random.Random(seed)
    rows, at = [], 0
    for k in range(n):
        at += rng.choice([0, 0, 1, 7, 40])
        rows.append((rng.choice([0] * keys + list(range(keys))), START + dt.timedelta(seconds=at), k, rng.choice([*store.ACTIONS, "get", "submit"]), 1, "x"))
    return rows


def _fold(rows, seconds):
    """What becomes of each event, and of each document, one event at a time."""
    held, out, ends = {}, [], []
    for key, ts, seq, action, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        if key in held and ts > held[key][0] + dt.timedelta(seconds=seconds):
            made, no, jobs = held.pop(key)
            ends.append((key, made, no, made + dt.timedelta(seconds=seconds), "expired", jobs))
        there = key in held
        out.append((key, ts, seq, action, (store.THERE if there else store.GONE)[action]))
        if action in ("create", "delete") and there:
            made, no, jobs = held.pop(key)
            ends.append((key, made, no, ts, "deleted" if action == "delete" else "replaced", jobs))
        if action == "create":
            held[key] = (ts, seq, 0)
        if action == "submit" and there:
            held[key] = (*held[key][:2], held[key][2] + 1)
    now = max(r[1] for r in rows)
    for key, (made, no, jobs) in held.items():
        gone = made + dt.timedelta(seconds=seconds) < now
        ends.append((key, made, no, made + dt.timedelta(seconds=seconds) if gone else None, "expired" if gone else "live", jobs))
    return out, ends


@pytest.mark.parametrize("seconds", [1, 30, 500])
def test_documents_are_there_for_a_while(spark, seconds):
    rows = _log(400, 7)
    odd = [(None, START, 900, "create", 1, "x"), (3, None, 901, "create", 1, "x"), (3, START, 902, None, 1, "x"), (3, START, 903, "rename", 1, "x")]
    events = spark.createDataFrame(rows + odd, EVENTS).repartition(3)
    want, ends = _fold(rows, seconds)
    assert sorted(map(tuple, store.outcomes(events, seconds).collect())) == sorted(want)
    lived = store.lifetimes(events, seconds, F.lit(max(r[1] for r in rows)).cast("timestamp")).collect()
    assert sorted(map(tuple, lived), key=str) == sorted(ends, key=str)
    assert store.outcomes(events.limit(0), seconds).count() == 0


def test_a_stream_of_documents_comes_to_the_same(spark, tmp_path):
    rows, seconds = _log(240, 5, seed=4), 60
    source, done = str(tmp_path / "in"), str(tmp_path / "out")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    end = (99, START + dt.timedelta(days=2), 999, "get", 1, "x")  # lets the watermark pass all the others
    after = (99, START + dt.timedelta(days=4), 1000, "get", 1, "x")
    try:
        for part in (rows[:100], rows[100:180], [*rows[180:], end], [after]):  # a restart from the checkpoint before each
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
            events = spark.readStream.schema(EVENTS).parquet(source)
            query = store.stream(events, seconds).writeStream.format("parquet").option("path", done).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset(provider)
    got = spark.read.parquet(done).where("document_id <> 99").collect()
    want, ends = _fold(rows, seconds)
    assert sorted((r["document_id"], r["ts"], r["seq"], r["action"], r["outcome"]) for r in got if r["action"]) == sorted(want)
    expired = [(r["document_id"], r["ts"], r["jobs"]) for r in got if not r["action"]]
    lapsed = [(k, made + dt.timedelta(seconds=seconds), jobs) for k, made, _, _, fate, jobs in ends if fate in ("expired", "live")]
    assert sorted(expired) == sorted(lapsed)
    assert sorted(r["jobs"] for r in got if r["outcome"] in ("deleted", "replaced")) == sorted(e[5] for e in ends if e[4] in ("deleted", "replaced"))


def _run(rows):
    """Steps of each job until it fails or is done."""
    jobs, out = {}, []
    for job, seq, failed, given in sorted(rows, key=lambda r: (r[1], not r[2])):
        if job is None:
            continue
        state = jobs.setdefault(job, {"n": 0, "passed": 0, "category": None})
        if state["category"] or state["passed"] == len(flow.STAGES):
            continue
        state["n"] += 1
        if failed:
            state["category"] = given or flow.CATEGORIES[state["n"] - 1]
        else:
            state["passed"] += 1
        k = state["n"]
        out.append((job, seq, k, None if failed else flow.STAGES[k - 1], None if failed else (*flow.STAGES, flow.DONE)[k], state["category"]))
    ends = []
    for job, s in jobs.items():
        done = s["passed"] == len(flow.STAGES)
        status = "failed" if s["category"] else "completed" if done else "running"
        ends.append((job, s["n"], status, flow.DONE if done else ("queued", *flow.STAGES)[s["passed"]], s["category"]))
    return out, ends


def test_jobs_stop_at_the_first_failure(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1] * 20 + list(range(40))), k, rng.random() < 0.12, rng.choice([None, "provider_timeout"])) for k in range(900)]
    rows += [(None, 1, False, None), (50, 1, None, None)]
    log = spark.createDataFrame([(*r, 1, "x") for r in rows], "job_id long, seq long, failed boolean, category string, step int, __n string").repartition(4)
    steps, ends = _run([(j, s, bool(f), c) for j, s, f, c in rows])
    assert sorted(map(tuple, flow.reported(log).collect()), key=str) == sorted(steps, key=str)
    assert sorted(map(tuple, flow.finished(log).collect()), key=str) == sorted(ends, key=str)
    assert "WindowGroupLimit" in flow.reported(log)._jdf.queryExecution().toString()  # few rows of a long log are shuffled
    last = {r["job_id"]: r for r in flow.unfinished(flow.finished(log)).collect()}
    assert all(r["status"] != "running" for r in last.values()) and last[50]["category"] == "internal_error"
    assert flow.finished(log.limit(0)).count() == 0


def test_notes_need_a_completed_job_and_two_findings(spark):
    jobs = spark.createDataFrame([(1, "completed"), (2, "completed"), (3, "failed"), (4, "completed")], "job_id long, status string")
    released = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b")], "job_id long, finding_id string")
    assert dict(flow.eligible_for_notes(jobs, released, True).collect()) == {1: "pending", 2: "skipped", 3: None, 4: "skipped"}
    assert dict(flow.eligible_for_notes(jobs, released, False).collect())[1] == "unavailable"


DOCUMENT = "id long, filename_sha256 string, page_count long, at long"


def test_batches_written_again_leave_the_table_as_it_was(spark, tmp_path):
    write = metadata.writer(str(tmp_path / "documents"))
    batches = [[(1, "a", 3, 1), (2, "b", 1, 2)], [(1, "c", 9, 3), (3, "d", 2, 4), (3, "e", 5, 5)], [(2, "f", 7, 6)]]
    for number, rows in enumerate(batches):
        write(spark.createDataFrame(rows, DOCUMENT), number)
    first = sorted(map(tuple, metadata.current(spark, str(tmp_path / "documents"), "documents", "at").collect()))
    assert first == [(1, "a", 3, 1), (2, "b", 1, 2), (3, "d", 2, 4)]
    for number in (1, 1, 2, 0):
        write(spark.createDataFrame(batches[number], DOCUMENT), number)
    assert sorted(map(tuple, metadata.current(spark, str(tmp_path / "documents"), "documents", "at").collect())) == first
    last = metadata.current(spark, str(tmp_path / "documents"), "analysis_jobs", "at").collect()
    assert sorted(map(tuple, last)) == [(1, "c", 9, 3), (2, "f", 7, 6), (3, "e", 5, 5)]


def test_a_stream_that_repeats_a_batch_writes_it_once(spark, tmp_path):
    source, table, state = str(tmp_path / "in"), str(tmp_path / "documents"), str(tmp_path / "state")
    failed = []

    def breaks(batch, number):
        metadata.writer(table)(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after writing")

    def run():
        spark.readStream.schema(DOCUMENT).parquet(source).writeStream.foreachBatch(breaks).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([(1, "a", 3, 1)], DOCUMENT).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([(1, "b", 3, 2), (2, "c", 4, 3)], DOCUMENT).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost after writing"):
        run()
    run()
    assert failed == [1]
    assert spark.read.parquet(f"{table}/batch=*").count() == 3
    assert sorted(map(tuple, metadata.current(spark, table, "documents", "at").collect())) == [(1, "a", 3, 1), (2, "c", 4, 3)]


def test_rows_of_failed_jobs_keep_nothing_that_was_proposed(spark):
    jobs = spark.createDataFrame(
        [(1, 7, "completed", "en", None, 5, "p", "m", "r", "n", "completed"), (2, 7, "failed", "en", "timeout", 5, "p", "m", "r", "n", None), (3, 8, "completed", "ta", None, None, " ", None, None, None, "disabled")],
        "id long, document_id long, status string, language string, failure_kind string, duration_ms long, provider string, model string, notes_provider string, notes_model string, notes_status string",
    )
    findings = spark.createDataFrame([(1, True), (1, False), (2, True), (None, True)], "analysis_id long, released boolean")
    notes = spark.createDataFrame([(1, True), (2, False)], "analysis_id long, released boolean")
    got = {r["id"]: r.asDict() for r in metadata.analysis_rows(jobs, findings, notes).collect()}
    assert (got[1]["provider"], got[1]["reasoning_model"], got[1]["proposed_count"], got[1]["released_count"], got[1]["withheld_count"], got[1]["notes_released_count"]) == ("p", "n", 2, 1, 1, 1)
    assert (got[2]["status"], got[2]["provider"], got[2]["proposed_count"], got[2]["failure_kind"]) == ("failed", None, 0, "timeout")
    assert (got[3]["provider"], got[3]["verification_policy_version"], got[3]["reasoning_status"], got[3]["released_count"]) == (None, None, "disabled", 0)
    released = spark.createDataFrame([(1, "f_001", "t", "c", "q", 2, None, "verified", True), (1, "f_002", "t", "c", "q", 2, None, "partially_verified", True)], "analysis_id long, finding_id string, type string, claim string, quote string, page int, section string, status string, explanation_verified boolean")
    assert [(r["analysis_job_id"], r["finding_id"], r["page_number"]) for r in metadata.finding_rows(released).collect()] == [(1, "f_001", 2)]
    answers = spark.createDataFrame([(1, "p", "m", "supported", "en", 2, 3, 0, "x"), (2, None, "m", "not_found", "ta", 0, 0, 0, None)], "document_id long, provider string, model string, status string, language string, evidence_count int, claims_checked int, claims_withheld int, translation string")
    assert [(r["provider"], r["answer_status"], r["translation_released"]) for r in metadata.answer_rows(answers).orderBy("document_id").collect()] == [("p", "supported", True), (None, "not_found", False)]


def test_documents_without_pages_or_names_have_rows(spark):
    documents = spark.createDataFrame([(1, "a.PDF"), (2, None), (3, "x")], "document_id long, filename string")
    pages = spark.createDataFrame([(1, "some words"), (1, "வணக்கம் உலகம்"), (3, None)], "document_id long, text string")
    got = {r["id"]: r for r in metadata.document_rows(documents, pages, "s", F.lit("2024-01-01").cast("timestamp")).collect()}
    assert (got[1]["file_extension"], got[1]["page_count"], got[1]["detected_language"]) == ("pdf", 2, "mixed")
    assert (got[2]["filename_sha256"], got[2]["page_count"], got[2]["detected_language"]) == (None, 0, "other")
    assert (got[3]["file_extension"], got[3]["page_count"], got[3]["detected_language"]) == ("none", 1, "other")
