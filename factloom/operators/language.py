"""Ubiquitous language: contexts of packages, known, discouraged and unknown terms, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import model as M
from ..functions.scalars import first_non_empty, split_words

# Node kinds that name concepts, and the advice of term warnings.
SYMBOL_KINDS = ("module", "function", "method", "type", "interface", "struct", "field")
ADVICE = "Update the configured ubiquitous language terms or rename the code element to match the context language."


def _set(values: list[str]) -> list[str]:
    return sorted({v.strip().lower() for v in values or [] if v.strip()})


def contexts(spark: SparkSession, config: dict) -> DataFrame | None:
    """Contexts as a small table, in order; None if the configuration has none."""
    rows = []
    for i, c in enumerate(config.get("contexts") or []):
        if c.get("id"):
            synonyms = {k.lower(): v.lower() for k, v in (c.get("synonyms") or {}).items()}
            rows.append((i, c["id"].lower(), list(c.get("packagePrefixes") or []), _set(c.get("terms")), synonyms, _set(c.get("discouragedTerms"))))
    if not rows:
        return None
    return spark.createDataFrame(rows, "pos int, ctx string, prefixes array<string>, known array<string>, synonyms map<string,string>, discouraged array<string>")


def in_context(packages: DataFrame, ctx: DataFrame) -> DataFrame:
    """Packages with the context of the longest prefix of their path, the earliest on ties.

    A prefix ends at a path element, so the path up to each "/" and the whole path are the keys of
    an equi join, whatever the number of prefixes."""
    prefixes = ctx.select("*", F.explode("prefixes").alias("prefix"))
    upto = F.transform(F.sequence(F.lit(1), F.size(F.split("packagePath", "/"))), lambda n: F.call_function("substring_index", F.col("packagePath"), F.lit("/"), n))
    hit = packages.withColumn("prefix", F.explode(upto)).join(prefixes, "prefix")
    best = Window.partitionBy("id").orderBy(F.length("prefix").desc(), "pos")
    return hit.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "prefix", "prefixes", "pos")


def classified(nodes: DataFrame, ctx: DataFrame, ignored: list[str]) -> DataFrame:
    """(package columns, ctx, term, class, nodeId): every distinct term that counts, per package,
    with the last node in order that holds it."""
    real = nodes.where((F.col("kind") == "package") & ~M.is_placeholder_node() & (F.col("packagePath") != ""))
    packages = in_context(real.select("id", "name", "packagePath", "trustLevel", "sourceFile", "lineRange"), ctx)
    own = packages.select(F.col("id").alias("pkg"), F.lit(0).alias("turn"), F.col("id").alias("nodeId"), F.col("packagePath").alias("words"))
    symbols = nodes.where(F.col("kind").isin(*SYMBOL_KINDS) & (F.col("packagePath") != "")).select(F.col("packagePath").alias("p"), F.col("id").alias("nodeId"), F.col("name").alias("words"))
    theirs = packages.select(F.col("id").alias("pkg"), "packagePath").join(symbols, F.col("packagePath") == F.col("p")).select("pkg", F.lit(1).alias("turn"), "nodeId", "words")
    raw = own.unionByName(theirs).select("pkg", "turn", "nodeId", F.posexplode(split_words("words")).alias("at", "raw"))
    terms = raw.join(packages.withColumnRenamed("id", "pkg"), "pkg")
    terms = terms.withColumn("term", first_non_empty(F.col("synonyms")[F.col("raw")], "raw")).where("term <> ''")
    if ignored:
        terms = terms.where(~F.col("term").isin(*ignored))
    kind = F.when(F.array_contains("discouraged", F.col("term")), "discouraged").when(F.array_contains("known", F.col("term")), "recognized").otherwise("unknown")
    keys = ("pkg", "ctx", "packagePath", "trustLevel", "sourceFile", "lineRange", "term")
    return terms.withColumn("class", kind).groupBy(*keys, "class").agg(F.max_by("nodeId", F.struct("turn", "nodeId", "at")).alias("nodeId"))


def evaluate(nodes: DataFrame, ctx: DataFrame, ignored: list[str], config_hash: str = "") -> dict[str, DataFrame]:
    """Labels, warnings and metrics."""
    real = nodes.where((F.col("kind") == "package") & ~M.is_placeholder_node() & (F.col("packagePath") != ""))
    packages = in_context(real.select("id", "packagePath", "trustLevel", "sourceFile", "lineRange"), ctx)
    found = classified(nodes, ctx, _set(ignored))
    label = lambda *c: [*c, F.lit("node").alias("targetKind"), "trustLevel", F.lit("fresh").alias("freshness")]
    in_ctx = packages.select(
        F.concat(F.lit("label:ddd.context:"), "id").alias("id"), F.lit("label").alias("kind"), F.lit("ddd.context").alias("name"), F.col("ctx").alias("value"),
        *label(F.col("id").alias("targetId"), F.lit("configured").alias("source"), F.array("id").alias("evidence")),
    )
    term = found.where("class = 'recognized'").select(
        F.concat(F.lit("label:ul.term:"), "pkg", F.lit(":"), "term").alias("id"), F.lit("label").alias("kind"), F.lit("ul.term").alias("name"), F.col("term").alias("value"),
        *label(F.col("pkg").alias("targetId"), F.lit("observed").alias("source"), F.array("pkg", F.concat(F.lit("context:"), "ctx")).alias("evidence")),
    )
    name = F.concat(F.lit("ul_"), "class", F.lit("_term"))
    warnings = found.where("class <> 'recognized'").select(
        F.concat(F.lit("warning:"), name, F.lit(":"), "pkg", F.lit(":"), "term").alias("id"), name.alias("kind"),
        F.concat("class", F.lit(" ubiquitous language term "), "term").alias("reason"), F.lit(ADVICE).alias("suggestedNextAction"),
        F.col("nodeId").alias("affectedNodeId"), F.array("pkg", "nodeId").alias("evidence"), "trustLevel", "sourceFile", "lineRange", F.lit("fresh").alias("freshness"),
    )
    counted = found.groupBy("pkg").agg(F.count_distinct(F.when(F.col("class") == "recognized", F.col("term"))).alias("good"), F.count_distinct("term").alias("all"))
    value = F.when(F.coalesce("all", F.lit(0)) == 0, F.lit(100)).otherwise(F.expr("(good * 100) div all"))
    metrics = packages.join(counted, packages["id"] == counted["pkg"], "left").select(
        F.concat(F.lit("metric:ubiquitous_language_alignment:"), "id").alias("id"), F.lit("metric").alias("kind"), F.lit("ubiquitous_language_alignment").alias("name"), value.cast("bigint").alias("value"),
        F.lit("percent").alias("unit"), F.col("packagePath").alias("scope"), F.col("id").alias("subject"), F.lit("ubiquitous_language").alias("analyzerId"), F.lit("ddd_classification").alias("stage"),
        F.lit("pass").alias("status"), F.lit("ubiquitous language alignment").alias("reason"), F.array("id").alias("evidence"), "trustLevel", F.lit(config_hash).alias("configurationHash"), "sourceFile", "lineRange",
    )
    return {"labels": in_ctx.unionByName(term), "warnings": warnings, "metrics": metrics}
