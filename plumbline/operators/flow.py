"""Stage flow of analyses: what is reported while they run, where they stop, and how they end.

A log has one row for each step that ended: the stages are passed in fixed order, so the k-th
row of a job tells of the k-th stage. A step that ends well is reported as the stage that is
entered next; the first failure ends the job, and nothing after it counts. A job is completed
only if all stages were passed.

At most len(STAGES) rows of a job matter. They are taken by a rank limit, which Spark applies
before the shuffle too, so a job with very many rows sends few from each task.

Rows without a job are left out. Rows of equal seq are taken failures first. Repeated rows are
rows each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The stages in order, the one after the last, and the category of a failure in each.
STAGES = ("validating", "ingesting", "checking_coverage", "building_document_map", "analyzing", "verifying", "gating_output")
DONE = "done"
CATEGORIES = ("validation_error", "ingestion_error", "coverage_error", "internal_error", "provider_unavailable", "verification_error", "internal_error")
#: Notes need so many released findings at least.
NOTES_NEED = 2


def _of(names: tuple[str, ...], k: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), k)


def reported(log: DataFrame) -> DataFrame:
    """job_id, seq, step, finished, entered, category of log(job_id, seq, failed): the rows up to the first failure.

    A failed step has no finished and no entered stage; its category follows from the stage, where the log gives none.
    """
    given = F.col("category") if "category" in log.columns else F.lit(None).cast("string")
    failed = F.coalesce("failed", F.lit(False))
    rows = log.where("job_id is not null").select("job_id", F.col("seq").cast("long").alias("seq"), failed.alias("failed"), given.alias("given"))
    by = Window.partitionBy("job_id").orderBy("seq", F.desc("failed"), "given")
    first = rows.withColumn("step", F.row_number().over(by)).where(F.col("step") <= len(STAGES))
    before = F.max("failed").over(by.rowsBetween(Window.unboundedPreceding, -1))
    alive = first.withColumn("over", F.coalesce(before, F.lit(False))).where("not over")
    k = F.col("step")
    return alive.select(
        "job_id", "seq", "step",
        F.when(~F.col("failed"), _of(STAGES, k - 1)).alias("finished"),
        F.when(~F.col("failed"), _of((*STAGES, DONE), k)).alias("entered"),
        F.when(F.col("failed"), F.coalesce("given", _of(CATEGORIES, k - 1))).alias("category"),
    )


def finished(log: DataFrame) -> DataFrame:
    """job_id, steps, status (running, failed, completed), stage reached and category of each job of a log."""
    last = F.max_by(F.struct("finished", "category"), "step")
    jobs = reported(log).groupBy("job_id").agg(F.count("*").alias("rows"), F.max(F.when(F.col("category").isNull(), F.col("step"))).alias("passed"), last.alias("x"))
    passed = F.coalesce("passed", F.lit(0))
    status = F.when(F.col("x.category").isNotNull(), "failed").when(passed == len(STAGES), "completed").otherwise("running")
    stage = F.when(passed == len(STAGES), DONE).otherwise(_of(("queued", *STAGES), passed))
    return jobs.select("job_id", F.col("rows").alias("steps"), status.alias("status"), stage.alias("stage"), F.col("x.category").alias("category"))


def unfinished(jobs: DataFrame) -> DataFrame:
    """finished() for a log that has ended: a job that neither failed nor was completed failed, too."""
    broken = F.col("status") == "running"
    category = F.when(broken, "internal_error").otherwise(F.col("category"))
    return jobs.withColumn("category", category).withColumn("status", F.when(broken, "failed").otherwise(F.col("status")))


def eligible_for_notes(jobs: DataFrame, released: DataFrame, configured: bool) -> DataFrame:
    """job_id and notes: pending, skipped (too few released findings) or unavailable (no writer), for completed jobs; null for others.

    released(job_id, finding_id) has a row for each released finding.
    """
    counts = released.groupBy("job_id").agg(F.count("*").alias("__n"))
    few = F.coalesce("__n", F.lit(0)) < NOTES_NEED
    notes = F.when(F.col("status") == "completed", F.when(few, "skipped").when(~F.lit(configured), "unavailable").otherwise("pending"))
    return jobs.join(counts, "job_id", "left").select("job_id", notes.alias("notes"))


def latest_completed(jobs: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """For each key its latest job, and whether that one is completed; an earlier completed one does not count."""
    last = F.max_by(F.struct(tie, "status"), F.struct(at, tie))
    return jobs.groupBy(key).agg(last.alias("x")).select(key, F.col(f"x.{tie}").alias(tie), (F.col("x.status") == "completed").alias("available"))
