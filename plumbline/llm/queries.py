"""The registered queries of this folder, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, ball_tree, fingerprint, html_extract, jaccard_join, language_id, line_rules, mixing, packing, pii, product_codes, quality, suffix_dedup
from .shared import held_out, table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = quality.score(docs, quality.learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likenesses."""
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pieces = language_id.load_pieces(vocabulary("piece_bpe_32k.model"))
    languages, model = language_id.learn(docs.where(~held_out(F.col("doc_id"))), pieces)
    found = language_id.identify(docs, languages, model, pieces)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when repeated strings of 100 bytes go."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found, by inner product, for every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and the number of entities replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.surrogates(docs, count="n_entities")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and packed into sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mix of all sources, weighted by the square root of their sizes."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every vector after ten rounds from eight centroids."""
    return ball_tree.cluster(table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, what its bad lines cost it, and whether it is kept."""
    return line_rules.clean(table(spark, sf_dir, "documents")).drop("by_punctuation", "by_navigation", "by_boilerplate", "clean_text")


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-byte code and error of every vector after four rounds."""
    return product_codes.encode(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_crf": op1_quality_crf,
    "op2_ann": op2_ann,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_html_extract": op4_html_extract,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_fingerprint": op7_fingerprint,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_ball_tree_clusters": op11_ball_tree_clusters,
    "op12_quality_rules": op12_quality_rules,
    "op13_product_codes": op13_product_codes,
}

ORACLES: dict[str, str] = {
    "op9_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op10_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_ball_tree_clusters": ball_tree.ORACLE_SQL,
    "op12_quality_rules": line_rules.ORACLE_SQL,
    "op13_product_codes": product_codes.ORACLE_SQL,
}
