"""Rows of the metadata tables, and writes of them from a stream that may be repeated.

Only figures and digests of documents are kept: no file name, no question, no answer. Released
findings are kept with their claim and quote, and only verified ones.

A micro-batch is written to a folder of its own, named after the batch, over whatever is there.
Spark repeats a batch with the same number and rows after a failure, so writing it again leaves
the table as it was. The table is read as all its batches under its rule: `first` (the first row
of a key stays, so a document recorded again does not live longer) or `last`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sinks import file_extension, filename_digest

#: Keys and rule of each table.
TABLES = {"documents": (("id",), "first"), "analysis_jobs": (("id",), "last"), "released_findings": (("analysis_job_id", "finding_id"), "first")}
POLICY_VERSION = "1"


def document_rows(documents: DataFrame, pages: DataFrame, salt: str, now: Column, days: int = 30) -> DataFrame:
    """id, filename_sha256, file_extension, page_count, detected_language, expires_at of documents(document_id, filename).

    pages(document_id, text) give the count and the language, by the scripts of all captured text. A document without pages
    has none, in language `other`; one without a file name has no digest.
    """
    letters = pages.select("document_id", *(c.alias(n) for n, c in T.letter_counts(F.col("text")).items()))
    counts = letters.groupBy("document_id").agg(F.count("*").alias("page_count"), *(F.sum(n).alias(n) for n in ("tamil", "latin", "letters")))
    rows = documents.select("document_id", "filename").join(counts, "document_id", "left").fillna(0, ["page_count", "tamil", "latin", "letters"])
    return rows.select(
        F.col("document_id").alias("id"),
        filename_digest(F.col("filename"), salt).alias("filename_sha256"),
        file_extension(F.col("filename")).alias("file_extension"),
        "page_count",
        T.script_of(F.col("tamil"), F.col("latin"), F.col("letters")).alias("detected_language"),
        (now + F.make_dt_interval(days=F.lit(days))).alias("expires_at"),
    )


def provenance(jobs: DataFrame) -> DataFrame:
    """jobs(provider, model, notes_provider, notes_model, notes_status, …) with the struct provenance.

    It is null without a provider; who wrote the notes is named only if they were written or tried.
    """
    ran = F.col("notes_status").isNotNull() & (F.col("notes_status") != "disabled")
    made = F.struct(
        F.col("provider").alias("provider"),
        F.coalesce("model", F.lit("unknown")).alias("model"),
        F.when(ran, F.col("notes_provider")).alias("reasoning_provider"),
        F.when(ran, F.col("notes_model")).alias("reasoning_model"),
        F.lit(POLICY_VERSION).alias("verification_policy_version"),
        F.lit("completed").alias("status"),
    )
    return jobs.withColumn("provenance", F.when(~T.is_blank(F.col("provider")), made))


def analysis_rows(jobs: DataFrame, findings: DataFrame, notes: DataFrame) -> DataFrame:
    """A row for each of jobs(id, document_id, status, language, failure_kind, duration_ms, provider, …), with its counts.

    findings(analysis_id, released) and notes(analysis_id, released) are counted for completed jobs; any other has none, and no
    provenance: what it proposed is not kept.
    """
    done = F.col("status") == "completed"
    counted = findings.groupBy(F.col("analysis_id").alias("id")).agg(F.count("*").alias("__p"), F.count_if("released").alias("__r"))
    noted = notes.groupBy(F.col("analysis_id").alias("id")).agg(F.count_if("released").alias("__nr"), F.count_if(~F.col("released")).alias("__nw"))
    rows = provenance(jobs).join(counted, "id", "left").join(noted, "id", "left")

    def kept(name: str) -> Column:
        return F.when(done, F.coalesce(name, F.lit(0))).otherwise(0).cast("long")

    named = [F.when(done, F.col(f"provenance.{c}")).alias(c) for c in ("provider", "model", "reasoning_provider", "reasoning_model", "verification_policy_version")]
    return rows.select(
        "id", "document_id", F.when(done, "completed").otherwise("failed").alias("status"), *named, F.when(done, F.col("language")).alias("language"),
        "failure_kind", "duration_ms", kept("__p").alias("proposed_count"), kept("__r").alias("released_count"), (kept("__p") - kept("__r")).alias("withheld_count"),
        F.when(done, F.col("notes_status")).alias("reasoning_status"), kept("__nr").alias("notes_released_count"), kept("__nw").alias("notes_withheld_count"),
    )


def finding_rows(released: DataFrame) -> DataFrame:
    """Rows of released(analysis_id, finding_id, type, claim, quote, page, section, status, explanation_verified); only verified ones are kept."""
    names = {"analysis_id": "analysis_job_id", "page": "page_number", "section": "section_reference", "status": "verification_status"}
    columns = ("analysis_id", "finding_id", "type", "claim", "quote", "page", "section", "status", "explanation_verified")
    return released.where("status = 'verified'").select(*(F.col(c).alias(names.get(c, c)) for c in columns))


def answer_rows(answers: DataFrame) -> DataFrame:
    """Figures of answers(document_id, provider, model, status, language, evidence_count, claims_checked, claims_withheld, translation)."""
    known = ~T.is_blank(F.col("provider"))
    return answers.select(
        "document_id", F.when(known, F.col("provider")).alias("provider"), F.when(known, F.col("model")).alias("model"), F.when(known, F.lit(POLICY_VERSION)).alias("verification_policy_version"),
        F.col("status").alias("answer_status"), F.col("language").alias("question_language"), "evidence_count", "claims_checked", "claims_withheld", F.col("translation").isNotNull().alias("translation_released"),
    )


def writer(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes each batch to its own folder under path, replacing what is there."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark: SparkSession, path: str, name: str, order: str) -> DataFrame:
    """The table under its rule: of each key the first or last row by batch, then by `order`."""
    keys, rule = TABLES[name]
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    place = (F.col("batch").cast("long"), F.col(order)) if rule == "first" else (F.desc(F.col("batch").cast("long")), F.desc(order))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*place))).where("__n = 1").drop("__n", "batch")
