"""The value index on texts whose values touch, against its SQL, and the patterns that are given up early."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions import values as X
from plumbline.functions import vocabulary as V
from plumbline.plans.registry import ORACLES, QUERIES
from plumbline.sources.staging import spread

TEXTS = [
    "at 12.34.178.142%%% of it", "42.144.35.254%%% and 1/2/2023.5% in 01/02/2024.5 days", "usd 1234.567 and 1234.567% or 1234.567 days",
    "5 dayé and 5 days内 in 10 years", "pay £1.400.000,00usd or 5%10 days\nusd 5inr 6 and thirty (20) days", "no value here", "",
]


def _documents(tmp_path, texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    return con


@pytest.mark.parametrize("name", ["c15_value_index", "d09_value_elsewhere", "e10_values_by_kind"])
def test_values_that_touch_are_listed_as_in_sql(spark, tmp_path, name):
    rng = random.Random(3)
    bits = ["5", "10", "1.000", "1234.567", "12.34.178.142", "2,500", "$", "£", "usd", "eur", "%", "%%%", "days", "month", "thirty days", "ten (10) days", "2024-01-05", "3 may 2020", "1/2/2023", ".", ",", "rs.", "é", "x", "years", "5%"]
    texts = TEXTS + ["".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    con = _documents(tmp_path, texts)
    want = con.sql(ORACLES[name])
    columns = want.columns
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))


def test_shared_beginnings_match_the_same_phrases():
    rng = random.Random(1)
    for phrases in (V.PROHIBITIONS, V.PERMISSIONS, V.CONDITIONS, V.EXCEPTIONS, V.RESTRICTIVE, V.UNIVERSAL, V.CERTAINTY, V.ROLES):
        plain = re.compile(r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(phrases, key=len, reverse=True))) + r")(?![a-z0-9])")
        pool = [*phrases, *(p[:-1] for p in phrases), *(p + "s" for p in phrases), "9"]
        for _ in range(500):
            text = "".join(rng.choice(pool) + rng.choice(["", " ", "-"]) for _ in range(rng.randrange(4)))
            assert bool(plain.search(text)) == bool(re.search(T.pattern_of(phrases), text)), text


def test_folded_characters_are_all_noticed():
    for c in (*V.ZERO_WIDTH, *V.LIGATURES, *V.PUNCTUATION):
        assert re.match(T._FOLDED, c), c


def test_small_tables_are_dealt_over_many_tasks(spark):
    rows = spread(spark.range(100), "id")
    assert rows.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_time_does_not_double_with_each_pattern(spark):
    texts = spark.range(400).select(F.format_string("the rent of usd %s is due on 3 may 2027, 5%% of it in two months", "id").alias("t"))
    found = texts.select(F.size(X.written(F.col("t"), True)).alias("n"), F.size(X.numbers(F.col("t"), True)).alias("m"))
    found.limit(1).collect()
    began = time.time()
    assert found.agg(F.min("n"), F.max("n"), F.min("m")).first() == (4, 4, 3)
    assert time.time() - began < 20  # each row asked for the types of all nested patterns, 2 ** 13 times
