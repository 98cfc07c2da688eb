"""Checks that read each text once, against the SQL and against pairs that are read whole."""

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import claims, judgements
from plumbline.plans.registry import ORACLES, QUERIES

CUT = "The tenant shall pay the rent for the flat. However, the tenant shall not pay the rent twice."


def _folder(spark, path, texts):
    rows = [(k, t, "en", "made", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    return str(path)


def _as_sql(spark, d, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    made = c.sql(ORACLES[name])
    got = QUERIES[name](spark, d).select(*made.columns)
    return sorted(map(tuple, got.collect())), sorted(made.fetchall())


@pytest.mark.parametrize(
    "text",
    [
        f"The tenant shall pay the rent for the flat.\n{CUT}",
        "All tenants pay the rent.\nAll tenants pay rent by article dé, and live.",
        "All tenants pay the rent.\nThe rent of section\x0b5 is paid by all tenants.",
        "İn full the tenant pays.\nThe tenant pays in full.",
        "The tenant never pays K all.\nThe tenant pays Kall rents.",
    ],
)
def test_word_axes_are_those_of_the_sql(spark, tmp_path, text):
    got, want = _as_sql(spark, _folder(spark, tmp_path, [text]), "g03_axes")
    assert got == want and len(want) == 1


_PAIRS = [
    (f"{CUT} It is due. Rent of USD 5 is due within two days.", f"{CUT} Rent of USD 6 is due within three days. The landlord may not ask for more."),
    ("The landlord may ask for more.", f"{CUT} The landlord may not ask for more."), ("Studio 54 shall pay.", "Studio 45 shall pay. It is paid by the tenant."),
    ("Rent.", CUT), ("", CUT), (None, CUT), (CUT, None), (CUT, " "), (CUT, CUT), ("All of it is due by section 5. Pay USD 5.", "Pay USD 5 by section 5.\nNothing more is due."),
]


def test_explanations_and_findings_are_judged_alike_where_they_stand(spark, monkeypatch):
    rows = spark.createDataFrame([(str(k), "d", a, b) for k, (a, b) in enumerate(_PAIRS)], "finding_id string, document_id string, explanation string, context string")
    want = sorted(map(tuple, judgements.explanations(rows.drop("document_id")).collect()))
    given = rows.select("finding_id", "document_id", F.col("explanation").alias("claim"), F.substring("context", 1, 20).alias("quote"), "context", F.lit("verified").alias("status"))
    contested = spark.createDataFrame([], "document_id string, term string")
    found = sorted(map(str, judgements.checked_findings(given, contested).collect()))
    monkeypatch.setattr(claims, "once", None)  # no text is written between
    assert sorted(map(tuple, judgements.explanations(rows.drop("document_id"), alike=False).collect())) == want
    assert sorted(map(str, judgements.checked_findings(given, contested, alike=False).collect())) == found
    assert len({r.split("status=")[1] for r in found}) > 1
