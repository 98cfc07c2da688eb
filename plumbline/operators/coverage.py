"""Pages, manifests and the coverage verdict, for all documents at once.

Pages are rows (document_id, page_number, status, text, image_count, failure_reason); a
document's verdict is one aggregate over them. Lists of page numbers grow with a single
document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def page_status(text: Column, images: Column) -> Column:
    """processed with text; unreadable with images only; else empty."""
    return F.when(~T.is_blank(text), "processed").when(F.coalesce(images, F.lit(0)) > 0, "unreadable").otherwise("empty")


def completed(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """pages with a failed row for every page from 1 to documents.expected_pages that is absent."""
    wanted = documents.where("expected_pages > 0").select("document_id", F.explode(F.sequence(F.lit(1), F.col("expected_pages"))).alias("page_number"))
    joined = wanted.join(pages, ["document_id", "page_number"], "left")
    missing = F.col("status").isNull()
    return joined.withColumn("failure_reason", F.when(missing, "page_missing").otherwise(F.col("failure_reason"))).withColumn("status", F.coalesce("status", F.lit("failed")))


def _numbers(condition: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(condition, F.col("page_number"))))


def manifest(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row a document: page numbers by status, missing ones, and the length of all text; documents without pages have one too if a list is given."""
    status = F.col("status")
    found = pages.groupBy("document_id").agg(
        F.count("*").cast("int").alias("total_pages"),
        _numbers(status.isin("processed", "empty")).alias("processed"),
        _numbers(status == "failed").alias("failed"),
        _numbers(status == "unreadable").alias("unreadable"),
        _numbers(status == "empty").alias("empty"),
        _numbers(F.col("failure_reason") == "page_missing").alias("missing"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_text_length"),
    )
    if documents is None:
        return found
    empty = {"total_pages": F.lit(0), "total_text_length": F.lit(0).cast("long")}
    rest = [F.coalesce(c, empty.get(c, F.array().cast("array<int>"))).alias(c) for c in found.columns if c != "document_id"]
    return documents.select("document_id").join(found, "document_id", "left").select("document_id", *rest)


def coverage(manifests: DataFrame, repaired: Column | None = None) -> DataFrame:
    """document_id, status, processed_pages and the blocking reasons in order."""
    repaired = F.lit(False) if repaired is None else F.coalesce(repaired, F.lit(False))
    total, failed, unreadable = F.col("total_pages"), F.size("failed"), F.size("unreadable")
    reasons = F.array_compact(
        F.array(
            F.when(total <= 0, "no_pages"),
            F.when(F.size("missing") > 0, "pages_missing"),
            F.when((failed > 0) & (F.size(F.array_except("failed", "missing")) > 0), "pages_failed"),
            F.when(unreadable > 0, "pages_unreadable"),
            F.when(repaired, "source_repaired"),
        )
    )
    status = (
        F.when((total <= 0) | (F.size("processed") == 0), "failed")
        .when((failed > 0) | (unreadable > 0) | (F.size("processed") != total), "incomplete")
        .when(repaired, "blocked_repaired")
        .otherwise("complete")
    )
    return manifests.select("document_id", status.alias("status"), F.size("processed").alias("processed_pages"), "failed", "unreadable", reasons.alias("blocking_reasons"))


def complete_only(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of documents whose coverage is complete."""
    return rows.join(verdicts.where("status = 'complete'").select("document_id"), "document_id", "left_semi")


def captured(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("status").isin("processed", "empty"))


def all_text(pages: DataFrame) -> DataFrame:
    """document_id and its captured pages' text, in page order, one page a line."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    return captured(pages).groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def payload(pages: DataFrame) -> DataFrame:
    """document_id and its pages between markers, with look-alikes of the markers in the text replaced."""
    body = T.squash_ends(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?i)<<<\s*(/?END\s+)?PAGE[^>]*>>>", "[page-marker removed]"))
    block = F.format_string("<<<PAGE %d>>>\n%s\n<<<END PAGE %d>>>", F.col("page_number"), body, F.col("page_number"))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", block.alias("block"))))
    return captured(pages).groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("payload"))


def script_by_document(pages: DataFrame) -> DataFrame:
    """document_id and the language its letters' scripts point to."""
    sums = pages.groupBy("document_id").agg(*[F.sum(c).alias(n) for n, c in T.letter_counts(F.col("text")).items()])
    return sums.select("document_id", T.script_of(F.col("tamil"), F.col("latin"), F.col("letters")).alias("language"))
