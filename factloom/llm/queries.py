"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, minhash, mixing, quality_classifier, quality_rules, secrets, sentencepieces, suffix_dedup, toxicity, webp

#: The vocabulary that the SentencePiece query and stage use.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_training() -> F.Column:
    """Rows that labels may be learned from: crc32(doc_id as text) mod 5 is not 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"), 50).drop("kept")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_table(spark, sf_dir, "documents"), 0.8)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(documents.select("doc_id", "text"), secrets.fit(documents)))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.realise(_table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), *mixing.ADDED)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(_table(spark, sf_dir, "conversations"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality_classifier.label_model(documents)
    return quality_classifier.classify(documents.select("doc_id", "text"), model, quality_classifier.fit(documents, model))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.store(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), sentencepieces.load(MODEL))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    scorer = toxicity.fit(documents, _table(spark, sf_dir, "labels"), in_training())
    scored = toxicity.score(documents.select("doc_id", "text"), scorer)
    return scored.select("doc_id", (~in_training()).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_minhash_near_dedup, op3_secret_scan, op4_source_mixing, op5_quality_rules,
        op6_chat_formatting, op7_quality_classifier, op8_media_columns, op9_sentencepiece, op10_toxicity,
    )
}

ORACLES: dict[str, str] = {
    "op4_source_mixing": mixing.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op6_chat_formatting": chat.ORACLE,
}
