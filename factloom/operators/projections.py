"""Grouped summaries of observations: terms, spellings, targets, pairs, and their top N."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import model as M
from ..functions.scalars import whole_number
from .vocabulary import valid_pair


def _terms(observations: DataFrame) -> DataFrame:
    return observations.where((F.col("name") == M.TERM) & (F.col("value") != ""))


def terms_by_package(observations: DataFrame) -> DataFrame:
    """(packagePath, term, count, packages, nodeKinds, observationIds)."""
    t = _terms(observations).where(M.attribute("packagePath") != "")
    return t.groupBy(M.attribute("packagePath").alias("packagePath"), F.col("value").alias("term")).agg(
        F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set(M.attribute("nodeKind"))).alias("nodeKinds"), F.array_sort(F.collect_list("id")).alias("observationIds")
    )


def top(df: DataFrame, by: str, limit: int, *then: str) -> DataFrame:
    """The first ``limit`` rows of each ``by``, by count and then ``then``, with their rank; all
    rows where ``limit`` is 0 or less."""
    order = Window.partitionBy(by).orderBy(F.desc("count"), *then)
    ranked = df.withColumn("rank", F.row_number().over(order))
    return ranked if limit <= 0 else ranked.where(F.col("rank") <= limit)


def top_terms(observations: DataFrame, limit: int) -> DataFrame:
    return top(terms_by_package(observations), "packagePath", limit, "term")


def spellings(observations: DataFrame) -> DataFrame:
    """(term, original, count, rank): how a term is written."""
    s = _terms(observations).where(M.attribute("original") != "").groupBy(F.col("value").alias("term"), M.attribute("original").alias("original")).agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("id")).alias("observationIds"))
    return top(s, "term", 0, "original")


def by_target(observations: DataFrame) -> DataFrame:
    """(targetId, observationIds), the ids in order."""
    return observations.where("targetId <> ''").groupBy("targetId").agg(F.array_sort(F.collect_list("id")).alias("observationIds"))


def incomplete_by_package(observations: DataFrame) -> DataFrame:
    o = observations.where(F.col("name") == M.INCOMPLETE).withColumn("packagePath", M.strip(M.attribute("from"), "package:"))
    return o.where("packagePath <> ''").groupBy("packagePath").agg(F.array_sort(F.collect_list("id")).alias("observationIds"))


def _pairs(observations: DataFrame) -> DataFrame:
    return observations.where(valid_pair()).select("id", M.attribute("packagePath").alias("packagePath"), M.attribute("termA").alias("termA"), M.attribute("termB").alias("termB"), whole_number(M.attribute("count")).alias("n"))


def _pair_sums(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys, "termA", "termB").agg(F.sum("n").alias("count"), F.array_sort(F.collect_set("packagePath")).alias("packages"), F.array_sort(F.collect_list("id")).alias("observationIds"))


def pairs_by_package(observations: DataFrame) -> DataFrame:
    return _pair_sums(_pairs(observations), "packagePath").drop("packages")


def top_pairs(observations: DataFrame, limit: int) -> DataFrame:
    return top(pairs_by_package(observations), "packagePath", limit, "termA", "termB")


def pairs_by_term(observations: DataFrame) -> DataFrame:
    """Every pair under both of its terms, summed over packages."""
    p = _pairs(observations)
    return _pair_sums(p.withColumn("term", F.explode(F.array("termA", "termB"))), "term")
