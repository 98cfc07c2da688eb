"""Operators on small tables of clauses with known answers: each query and the SQL that states its rows."""

from __future__ import annotations

import clause_tables as fixtures
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions import values as X
from plumbline.functions import vocabulary as V
from plumbline.operators import claims, evaluation, findings, judgements, mutations, release
from plumbline.plans import oracle
from plumbline.sources import uploads
from plumbline.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("c02_numbers_in_clauses")
def _(spark, d):
    rows = spark.sql(fixtures.CASES).select("case_id", F.posexplode(X.numbers(F.col("claim"))).alias("pos", "v"))
    return rows.select("case_id", "pos", "v.*")


@query("c08_dates_in_clauses", """SELECT * FROM (VALUES ('c13', '1 march 2027', '2027-03-01', false), ('c14', '2027-05-01', '2027-05-01', false)) AS t(case_id, raw, resolved, ambiguous)""")
def _(spark, d):
    return spark.sql(fixtures.CASES).select("case_id", F.explode(X.dates(F.col("claim"))).alias("v")).select("case_id", "v.raw", F.col("v.resolved").cast("string").alias("resolved"), "v.ambiguous")


@query("c10_compare_values", "SELECT case_id, CASE WHEN case_id IN ('c02', 'c12', 'c13') THEN 'mismatch' ELSE 'match' END AS result FROM (" + fixtures.CASES + ")")
def _(spark, d):
    own, context = F.col("claim"), F.col("context")
    result = X.compare(X.numbers(own), X.dates(own), X.numbers(context), X.dates(context))["result"]
    return spark.sql(fixtures.CASES).select("case_id", result.alias("result"))


@query("b26_subject_overlap", f"SELECT case_id, {oracle.overlap('claim', 'context')} AS overlap FROM ({fixtures.CASES})")
def _(spark, d):
    return spark.sql(fixtures.CASES).select("case_id", T.overlap(F.col("claim"), F.col("context")).alias("overlap"))


def _issue(test: str, name: str) -> str:
    return f"CASE WHEN {test} THEN '{name}' END"


def _dropped(phrases) -> str:
    return f"({oracle.any_of('context', phrases)} AND NOT {oracle.any_of('claim', phrases)})"


def _added(phrases) -> str:
    return f"({oracle.any_of('claim', phrases)} AND NOT {oracle.any_of('context', phrases)})"


_XREF = "'" + V.CROSS_REFERENCE + "'"
_NEAR = f"""(len(list_filter(range(1, len({oracle.words('context')}) + 1), lambda k: list_contains({oracle.some_of(V.NEGATIONS)}, {oracle.words('context')}[k]) AND
  len(list_filter({oracle.words('context')}[greatest(k - 4, 1):k + 4], lambda w: length(w) > 2 AND NOT list_contains({oracle.some_of(V.STOPWORDS + V.NEGATIONS)}, w))) > 0 AND
  2 * len(list_filter({oracle.words('context')}[greatest(k - 4, 1):k + 4], lambda w: length(w) > 2 AND NOT list_contains({oracle.some_of(V.STOPWORDS + V.NEGATIONS)}, w) AND list_contains({oracle.content('claim')}, w))) >=
  len(list_filter({oracle.words('context')}[greatest(k - 4, 1):k + 4], lambda w: length(w) > 2 AND NOT list_contains({oracle.some_of(V.STOPWORDS + V.NEGATIONS)}, w))))) > 0
  OR ({oracle.any_of('context', V.PROHIBITIONS)} AND o >= 0.6))"""
_ISSUES = ", ".join([
    _issue("o < 0.5", "not_established_by_evidence"),
    _issue("case_id IN ('c02', 'c12', 'c13')", "value_not_in_evidence"),
    _issue(f"{oracle.negative('context')} AND NOT {oracle.negative('claim')} AND {_NEAR}", "negation_dropped"),
    _issue(f"{oracle.negative('claim')} AND NOT {oracle.negative('context')}", "negation_added"),
    _issue(f"{oracle.modality('claim')} <> 'none' AND {oracle.modality('context')} = 'none'", "modality_unsupported"),
    _issue(f"{oracle.modality('claim')} <> 'none' AND {oracle.modality('context')} <> 'none' AND {oracle.modality('claim')} <> {oracle.modality('context')}", "modality_changed"),
    _issue(_dropped(V.CONDITIONS), "condition_dropped"),
    _issue(_added(V.CERTAINTY), "certainty_unsupported"),
    _issue(f"{_dropped(V.RESTRICTIVE)} OR {_added(V.UNIVERSAL)}", "scope_broadened"),
    _issue(f"{oracle.any_of('claim', V.UNIVERSAL)} AND regexp_matches(lower(context), {_XREF}) AND NOT regexp_matches(lower(claim), {_XREF})", "unresolved_reference_dropped"),
    _issue(_dropped(V.EXCEPTIONS), "exception_dropped"),
    _issue(f"({_added(V.BEFORE)} AND {_dropped(V.AFTER)}) OR ({_added(V.AFTER)} AND {_dropped(V.BEFORE)})", "time_direction_changed"),
    _issue(_added(V.INDEFINITE), "time_limit_removed"),
    _issue(f"{oracle.any_of('context', V.REFERENCES)} AND o < 0.6", "evidence_only_references"),
])
_CHECKED = f"""WITH k AS (SELECT *, {oracle.overlap('claim', 'context')} AS o FROM ({fixtures.CASES})),
i AS (SELECT *, list_filter([{_ISSUES}], lambda x: x IS NOT NULL) AS i FROM k),
r AS (SELECT case_id, family, category, array_to_string(i, ',') AS issues, CASE WHEN len(i) = 0 THEN 'supported' WHEN list_has_any(i, {oracle.some_of(V.CONTRADICTIONS)}) AND o >= 0.6 THEN 'contradicted' ELSE 'unsupported' END AS status FROM i)"""


@query("g03_check_claim", f"{_CHECKED} SELECT case_id, issues, status FROM r")
def _(spark, d):
    return claims.check(spark.sql(fixtures.CASES)).select("case_id", F.array_join("issues", ",").alias("issues"), "status")


@query("g13_gate_answers", f"{_CHECKED} SELECT r.case_id AS answer_id, CASE WHEN status = 'supported' THEN 'supported' ELSE 'not_found' END AS status, CASE WHEN status = 'supported' THEN claim ELSE '' END AS released FROM r JOIN k USING (case_id)")
def _(spark, d):
    cases = spark.sql(fixtures.CASES)
    answers = cases.select(F.col("case_id").alias("answer_id"), F.col("claim").alias("answer"), F.lit(False).alias("not_found"))
    evidence = cases.select(F.col("case_id").alias("answer_id"), F.lit(0).alias("context_pos"), "context", F.lit("verified").alias("status"))
    return findings.gate(answers, evidence)


@query("e15_mutation_coverage")
def _(spark, d):
    return mutations.coverage(spark.sql(fixtures.CASES).where("family = 'legitimate'").select("case_id", "context"))


@query("e12_scores", f"""{_CHECKED}, f AS (SELECT family, category, status <> 'supported' AS flagged FROM r)
SELECT family, category, count(*) AS cases, count(*) FILTER (family = 'attack') AS attacks, count(*) FILTER (family = 'attack' AND flagged) AS detected, count(*) FILTER (family <> 'attack') AS legitimate,
  count(*) FILTER (family <> 'attack' AND NOT flagged) AS released,
  CASE WHEN count(*) FILTER (family = 'attack') > 0 THEN round(100.0 * count(*) FILTER (family = 'attack' AND NOT flagged) / count(*) FILTER (family = 'attack'), 1)::DOUBLE END AS missed_pct,
  CASE WHEN count(*) FILTER (family <> 'attack') > 0 THEN round(100.0 * count(*) FILTER (family <> 'attack' AND flagged) / count(*) FILTER (family <> 'attack'), 1)::DOUBLE END AS false_pct
FROM f GROUP BY GROUPING SETS ((family), (category), ())""")
def _(spark, d):
    return evaluation.scores(claims.check(spark.sql(fixtures.CASES)).select("family", "category", (F.col("status") != "supported").alias("flagged")))


@query("e14_threshold_sweep", f"""WITH k AS (SELECT case_id, family, {oracle.overlap('claim', 'context')} AS o FROM ({fixtures.CASES})),
t AS (SELECT *, o < threshold AS flagged FROM k, (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS threshold)),
l AS (SELECT *, lag(flagged) OVER (PARTITION BY case_id ORDER BY threshold) AS b FROM t)
SELECT threshold, count(*) FILTER (family = 'attack' AND NOT flagged) AS missed, count(*) FILTER (family <> 'attack' AND flagged) AS false_alarms, count(*) FILTER (b <> flagged) AS changed FROM l GROUP BY threshold""")
def _(spark, d):
    return evaluation.sweep(spark.sql(fixtures.CASES).select("case_id", "family", T.overlap(F.col("claim"), F.col("context")).alias("overlap")))


@query("f03_best_context", f"""WITH k AS (SELECT *, {oracle.overlap('claim', 'context')} AS o FROM (SELECT a.case_id, a.claim, b.context, CAST(substr(b.case_id, 2) AS INT) AS context_pos FROM ({fixtures.CASES}) a, ({fixtures.CASES}) b WHERE abs(CAST(substr(a.case_id, 2) AS INT) - CAST(substr(b.case_id, 2) AS INT)) <= 2))
SELECT case_id, max(o) AS best, arg_min(context_pos, (-o, context_pos)) AS context_pos FROM k GROUP BY case_id""")
def _(spark, d):
    cases = spark.sql(fixtures.CASES)
    number = F.substring("case_id", 2, 9).cast("int")
    a, b = cases.select("case_id", "claim", number.alias("n")), cases.select("context", number.alias("context_pos"))
    near = a.withColumn("context_pos", F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2))).join(b, "context_pos")
    scored = near.withColumn("o", T.overlap(F.col("claim"), F.col("context")))
    return scored.groupBy("case_id").agg(F.max("o").alias("best"), F.min_by("context_pos", F.struct(-F.col("o"), "context_pos")).alias("context_pos"))


@query("b48_topics", """SELECT * FROM (VALUES ('f_001', 'liability'), ('f_002', 'fees'), ('f_003', 'governing_law'), ('f_004', 'confidentiality'), ('f_005', 'other'), ('f_006', 'term'),
('f_007', 'notices'), ('f_008', 'other'), ('f_009', 'termination'), ('f_010', 'other')) AS t(finding_id, topic)""")
def _(spark, d):
    return release.topics(spark.sql(fixtures.LABELS)).select("finding_id", "topic")


@query("e09_overview", """SELECT * FROM (VALUES (0, 'parties', ''), (1, 'term', 'f_006'), (2, 'fees', 'f_002'), (3, 'termination', 'f_009'), (4, 'confidentiality', 'f_004'), (5, 'liability', 'f_001'),
(6, 'notices', 'f_007'), (7, 'governing_law', 'f_003'), (8, 'other', 'f_005,f_008,f_010')) AS t(place, topic, findings)""")
def _(spark, d):
    return release.overview(spark.sql(fixtures.LABELS)).withColumn("findings", F.array_join("findings", ","))


@query("b43_attention")
def _(spark, d):
    return spark.sql(fixtures.CASES).select("case_id", release.attention(F.col("context")).alias("attention"))


@query("a01_upload_checks", """SELECT * FROM (VALUES ('u1', 'lease.pdf', NULL), ('u2', 'My file_.PDF', NULL), ('u3', 'a.docx', 'unsupported_extension'), ('u4', 'a.pdf', 'unsupported_mime_type'), ('u5', 'a.pdf', 'signature_mismatch'),
('u6', 'a.pdf', 'empty_file'), ('u7', NULL, 'unsafe_filename'), ('u8', 'big.pdf', 'file_too_large')) AS t(upload_id, name, error)""")
def _(spark, d):
    error = uploads.first_error(F.col("name"), F.col("content_type"), F.col("size"), F.col("head").cast("binary"))
    return spark.sql(fixtures.UPLOADS).select("upload_id", T.sanitized_filename(F.col("name")).alias("name"), error.alias("error"))


@query("g05_conflicting_definitions", "SELECT * FROM (VALUES ('d1', 'business day'), ('d3', 'term')) AS t(document_id, term)")
def _(spark, d):
    return claims.conflicting_definitions(spark.sql(fixtures.DEFINITIONS))


@query("g06_check_findings", """SELECT * FROM (VALUES ('j1', 'verified', NULL), ('j2', 'rejected', 'evidence_instruction_like'), ('j3', 'rejected', 'evidence_instruction_like'),
('j4', 'rejected', 'claim_contradicted'), ('j5', 'rejected', 'evidence_instruction_like')) AS t(finding_id, status, reason)""")
def _(spark, d):
    rows = spark.sql(fixtures.JUDGED).select("finding_id", F.lit("d").alias("document_id"), "claim", "quote", "context", F.lit("verified").alias("status"))
    contested = spark.sql("SELECT 'd' AS document_id, 'business day' AS term")
    return judgements.checked_findings(rows, contested).select("finding_id", "status", "reason")


@query("b45_explanations", """SELECT * FROM (VALUES ('j1', '', false, 'explanation_contradicted'), ('j2', '', false, NULL), ('j3', '', false, 'evidence_instruction_like'),
('j4', 'The Tenant shall pay rent within 30 days.', true, NULL), ('j5', 'A weekday in London.', true, NULL)) AS t(finding_id, explanation, explanation_verified, reason)""")
def _(spark, d):
    return judgements.explanations(spark.sql(fixtures.JUDGED).select("finding_id", "explanation", "context"))


@query("b46_translations", "SELECT * FROM (VALUES ('j1', NULL), ('j2', 'x'), ('j3', NULL), ('j4', 'Rent in 30 days'), ('j5', 'A weekday')) AS t(finding_id, translation)")
def _(spark, d):
    shown = judgements.translation(F.col("translation"), F.col("finding_id") != "j3", F.col("context"))
    return spark.sql(fixtures.JUDGED).select("finding_id", shown.alias("translation"))


@query("g14_notes", """SELECT * FROM (VALUES ('a', 1, true, true, 'n_001'), ('a', 2, false, false, NULL), ('a', 3, true, false, 'n_002'), ('a', 4, false, false, NULL), ('a', 5, false, false, NULL),
('b', 1, false, false, NULL), ('b', 2, true, true, 'n_001')) AS t(analysis_id, pos, released, evidence_checked, note_id)""")
def _(spark, d):
    quotes = F.when(F.col("quoted") == "", F.array().cast("array<string>")).otherwise(F.array("quoted"))
    proposed = spark.sql(fixtures.NOTES).select("analysis_id", "pos", "text", F.split("ids", ",").alias("finding_ids"), quotes.alias("quotes"))
    return judgements.notes(proposed, spark.sql(fixtures.SHOWN))


_JOBS = "SELECT * FROM (VALUES ('d', 0, 'submit', 'en'), ('d', 1, 'submit', 'en'), ('d', 2, 'submit', 'ta'), ('d', 3, 'completed', NULL), ('d', 4, 'submit', 'en'), ('d', 5, 'submit', 'ta'), ('d', 6, 'failed', NULL), ('d', 7, 'submit', 'ta')) AS t(document_id, seq, event, language)"


@query("i04_submissions", "SELECT * FROM (VALUES ('d', 0, 'new'), ('d', 1, 'reuse'), ('d', 2, 'conflict'), ('d', 4, 'reuse'), ('d', 5, 'new'), ('d', 7, 'new')) AS t(document_id, seq, decision)")
def _(spark, d):
    return jobs.submissions(spark.sql(_JOBS))


