"""A training corpus from raw documents: five stages, each on all that the stage before kept.

Defined cases, for ``run`` and every stage: an empty table gives an empty one; null text counts as
empty, is kept by every filter unless its class has a smaller id, and has no tokens; rows with null
ids are documents like others, after all ids; of rows that are equal in id and text one passes
near-dedup; a text of any length is taken whole; columns beside those of documents pass through all
stages but the last, whatever their names, which gives doc_id, lang, source, n_tokens and token_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import minhash, mixing, secrets, sentencepieces, toxicity
from factloom.llm.components import settle
from factloom.llm.queries import MODEL, in_training


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go; it learns from the training rows of labels."""
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), in_training())
    return toxicity.keep_clean(docs, scorer)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return minhash.deduplicate(docs, 0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources are repeated, up to half as often again; every document stays."""
    return mixing.repeat(docs, max_repetition=1.5)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts."""
    return sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), sentencepieces.load(MODEL), digests=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Classifier, signatures and vocabulary search have no SQL form; tests hold the stages against
#: brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
