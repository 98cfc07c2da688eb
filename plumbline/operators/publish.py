"""From proposed findings to what may be published, with the counters of the same pass.

A finding is published only if its quote, its values, its claim and its explanation all stand.
What else is shown with it is confirmed or derived here: a section that its page bears, a label
that is no instruction, an explanation and a translation that passed, attention by the evidence.

Nulls count as empty texts. (analysis_id, pos) is a key. Findings of an analysis without a
decision are not published: they count as withheld and unverified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import looked_up
from ..sources.staging import once, spread, staged
from . import claims, coverage, findings, judgements, release

#: The reasons that concern the claim, and what a reader is told for each reason.
CLAIM_REASONS = ("claim_contradicted", "claim_unsupported", "evidence_instruction_like")
MESSAGES = {
    "missing_evidence": "This statement was not accompanied by any evidence from the document.",
    "empty_quote": "No quoted text was supplied for this statement.",
    "quote_too_long": "The quoted passage was too long to verify reliably.",
    "invalid_page": "The cited page does not exist in this document.",
    "page_not_extracted": "The cited page's text was never captured, so this could not be checked.",
    "quote_not_found": "The quoted text was not found on the cited page.",
    "numeric_mismatch": "A number in this statement does not match the document.",
    "currency_mismatch": "An amount in this statement does not match the document.",
    "date_mismatch": "A date in this statement does not match the document.",
    "date_ambiguous": "A date could not be read unambiguously, so it was not confirmed.",
    "claim_contradicted": "The quoted text says something materially different from this statement.",
    "claim_unsupported": "The quoted text does not establish what this statement says.",
    "evidence_instruction_like": "The quoted text is an instruction addressed to this assistant rather than a provision of the agreement, so it cannot support a statement about the document.",
    "explanation_contradicted": "The plain-language explanation says the opposite of the text it explains.",
}
CONFIRMED, UNCONFIRMED = "This statement is supported by the document.", "This statement could not be confirmed against the document."


def displayable(status: Column) -> Column:
    """Only a verified statement may be shown as a fact."""
    return F.coalesce(status == "verified", F.lit(False))


def message(status: Column, reasons: Column) -> Column:
    """What a reader is told about a status and its reasons; unknown reasons say nothing."""
    table = looked_up(MESSAGES)
    told = F.array_join(F.transform(reasons, lambda r: F.try_element_at(table, r)), " ")
    return F.when(displayable(status), CONFIRMED).when(F.coalesce(F.size(reasons), F.lit(0)) <= 0, UNCONFIRMED).otherwise(told)


def checked(proposals: DataFrame, pages: DataFrame) -> DataFrame:
    """proposals(analysis_id, pos, document_id, claim, page, quote, …) with status, reasons and context: first the evidence, then the claim on it.

    Terms that a document defines in conflicting ways are found once a document.
    """
    counts = pages.groupBy("document_id").agg(F.count("*").alias("page_count"))
    keyed = proposals.withColumn("finding_id", F.concat_ws(":", "analysis_id", "pos")).join(counts, "document_id", "left").fillna(0, ["page_count"])
    evidence = staged(findings.with_evidence(keyed, pages), "evidence")  # read for the verdicts and for the rows
    judged = judgements.checked_findings(evidence, claims.conflicting_definitions(coverage.all_text(claims.quoting(pages))), F.col("commands"))
    reasons = F.when(F.col("reason").isNotNull(), F.array_append("reasons", F.col("reason"))).otherwise(F.col("reasons"))
    return judged.withColumn("reasons", reasons).drop("reason", "page_count", "match", "commands")


def claim_reasons(rows: DataFrame) -> DataFrame:
    """How often each reason that concerns the claim occurs."""
    return rows.select(F.explode("reasons").alias("reason")).where(F.col("reason").isin(*CLAIM_REASONS)).groupBy("reason").agg(F.count("*").alias("n"))


def decided(rows: DataFrame, pages: DataFrame, language: str = "en") -> DataFrame:
    """checked() rows (with type, section, explanation, explanation_translation) with `released` and what is shown of each."""
    columns = rows.columns
    evidence = F.when(~T.is_blank(F.col("context")), F.col("context")).otherwise(F.coalesce("quote", F.lit("")))
    # what attention asks for does not depend on figures; rows are written there, and read for the explanations and for what is shown
    rows = once(rows, {"__shape": T.shape(evidence)}, lambda t: t.withColumn("__attention", release.attention(F.col("__shape"))))
    shown = rows.where(displayable(F.col("status")))
    explained = judgements.explanations(shown.select("finding_id", "explanation", "context"))
    explained = explained.select("finding_id", F.col("explanation").alias("__explanation"), "explanation_verified", F.col("reason").alias("__reason"))
    text = pages.where(F.col("status").isin("processed", "empty")).select("document_id", F.col("page_number").alias("page"), F.coalesce("text", F.lit("")).alias("__text"))
    joined = spread(rows.join(explained, "finding_id", "left"), "document_id", "page").join(text, ["document_id", "page"], "left")
    out = displayable(F.col("status")) & F.col("__reason").isNull()
    verified = out & F.coalesce("explanation_verified", F.lit(False))
    other = F.lit(language != "en") & (F.coalesce("__explanation", F.lit("")) != "")
    joined = joined.withColumn("__section", F.when(out, T.confirmed_section(F.col("section"), F.col("__text"))))
    refused = displayable(F.col("status")) & F.col("__reason").isNotNull()
    return joined.select(
        *[c for c in columns if c not in ("status", "reasons", "type", "section", "explanation", "explanation_translation")],
        F.when(refused, "rejected").otherwise(F.col("status")).alias("status"),
        F.when(refused, F.array_append("reasons", F.col("__reason"))).otherwise(F.col("reasons")).alias("reasons"),
        out.alias("released"),
        F.when(out, T.safe_type(F.col("type"))).alias("type"),
        F.col("__section").alias("section"),
        (out & ~T.is_blank(F.col("section")) & F.col("__section").isNull()).alias("citation_dropped"),
        F.when(out, F.coalesce("__explanation", F.lit(""))).alias("explanation"),
        verified.alias("explanation_verified"),
        F.when(out & other, judgements.translation(F.col("explanation_translation"), verified, F.col("context"))).alias("translation"),
        F.when(out, F.col("__attention")).alias("attention"),
    )


def counters() -> list[Column]:
    """Counters of decided() rows."""
    shown = F.col("released")
    return [
        F.count_if(shown).alias("released"),
        F.count_if(~shown).alias("withheld"),
        F.count_if("citation_dropped").alias("citations_dropped"),
        F.count_if(shown & (F.col("explanation") != "") & ~F.col("explanation_verified")).alias("explanations_unverified"),
    ]


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """decided() rows and their counters, which are gathered while the rows are written or read, without a second pass."""
    seen = Observation(name)
    return rows.observe(seen, *counters()), seen


def rendered(rows: DataFrame) -> DataFrame:
    """The released rows of decided(), numbered within their analysis, with what a reader is told."""
    return release.numbered(rows).where("released").withColumn("message", message(F.col("status"), F.col("reasons")))


def summaries(analyses: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each of analyses(analysis_id): proposed, released and withheld findings by status, and whether the evidence did not suffice.

    released is null in rows of an analysis without a decision: nothing of it is published, and all of it is unverified.
    """
    out, none = F.coalesce("released", F.lit(False)), F.col("released").isNull()
    by_status = [F.count_if(~out & F.when(none, s == "unverified").otherwise(F.col("status") == s)).alias(s) for s in ("rejected", "unverified", "partially_verified")]
    counts = rows.groupBy("analysis_id").agg(F.count("*").alias("proposed"), F.count_if(out).alias("released"), F.count_if(~out).alias("withheld"), *by_status)
    joined = analyses.select("analysis_id").distinct().join(counts, "analysis_id", "left").fillna(0)
    return joined.withColumn("insufficient_evidence", (F.col("proposed") > 0) & (F.col("released") == 0))
