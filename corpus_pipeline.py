"""A training corpus from the documents table: five stages, each an operator of plumbline.llm.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the
columns of documents. A stage's result is written and read again before the next.

1. language_id: the piece models learn from the rows' own languages; texts whose language
   cannot be told go, and those surely in another language than their row says get that one.
2. near_duplicates: of every group linked by a similarity of 0.8 or more (five-word shingles)
   the document with the smallest id stays.
3. pii: personal data and credentials are replaced by surrogates.
4. mixing: documents are put into the order of the Pfair schedule; the files of the result
   follow it.
5. packing: documents are cut and packed into sequences, which are numbered in that order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, language_id, mixing, packing, pii
from plumbline.llm.queries import vocabulary
from plumbline.llm.shared import materialise, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = language_id.load_pieces(vocabulary("piece_bpe_32k.model"))
    languages, model = language_id.learn(docs, pieces)
    return language_id.accept(docs, languages, model, pieces)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.surrogates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = mixing.mix(docs)
    return placed.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(*docs.columns)


def in_written_order(docs: DataFrame) -> DataFrame:
    """docs with `place`, the number of the row in the order of the files; docs that come from no file are written first."""
    name, row = F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")
    try:
        placed = docs.select("*", name, row)
    except AnalysisException:
        placed = materialise(docs, "ordered").select("*", name, row)
    before, starts = 0, []
    for file, n in sorted(placed.groupBy("__file").count().collect()):  # a row for each file
        starts.append((file, before))
        before += n
    first = docs.sparkSession.createDataFrame(starts, "__file string, __before long")
    return placed.join(F.broadcast(first), "__file").withColumn("place", F.col("__before") + F.col("__row")).select(*docs.columns, "place")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(in_written_order(docs), vocabulary("word_bpe_49k.json"), order="place")


STAGES = [
    ("language_id", by_language),
    ("near_duplicates", without_copies),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: The models of language_id are fitted numbers, which SQL cannot express; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
