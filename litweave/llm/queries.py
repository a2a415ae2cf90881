"""The registered queries of this package, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_trie, exact_dedup, language_id, merkle, packing, quality_svm, rotated_codes, simhash, substring_dedup, toxicity, url_rules, vector_dedup
from .sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is kept for testing; a null identifier is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _held_out(4, 2))
    scored = language_id.with_language(documents.drop("lang"), documents.where("not held_out"), F.col("text"))
    return scored.select("doc_id", "held_out", "language.lang_pred", "language.score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(documents, packing.word_count(F.col("text")))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_groups(_table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(_table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(documents).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.without_repeats(documents).select(
        "row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_toxicity(documents, _table(spark, sf_dir, "labels"), ~_held_out(5, 0))
    score = F.col("toxicity").alias("score")
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_svm.with_quality(documents, _table(spark, sf_dir, "labels"), ~_held_out(3, 1))
    score = F.col("quality_score").alias("score")
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # tells where the vocabulary files lie

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    file = bpe.shipped(spark, public_tokenizers.path("byte_bpe_50k.json"))
    encoded = documents.select("doc_id", bpe.encoder(file)("text").alias("ids"))
    decoded = encoded.select("doc_id", "ids", bpe.decoder(file)("ids").alias("decoded"))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    return merkle.verified(documents, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_packing, op3_vector_dedup, op4_simhash, op5_url_rules, op6_exact_dedup,
        op7_substring_dedup, op8_toxicity, op9_quality, op10_bpe, op11_nearest_vectors,
        op12_conversation_trie, op13_merkle_manifest,
    )
}
