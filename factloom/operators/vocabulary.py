"""Vocabulary: terms, co-occurring pairs, language-zone candidates and bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions.scalars import first_non_empty, split_words, stem, whole_number

# Node kinds whose names hold vocabulary, and terms that name no concept.
TERM_KINDS = ("package", "file", "type", "interface", "struct", "function", "method", "field", "import", "unresolved_call")
STOP_TERMS = ("com", "example", "github", "gitlab", "go", "internal", "io", "net", "org", "testdata", "workspace")


def _attributes(**values) -> F.Column:  # noqa: ANN003
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))


def terms(nodes: DataFrame) -> DataFrame:
    """One observation per word of every real node's name (a file's is its stem)."""
    original = F.when((F.col("kind") == "file") & (F.col("sourceFile") != ""), stem("sourceFile")).otherwise(F.col("name"))
    named = nodes.where(~M.is_placeholder_node() & F.col("kind").isin(*TERM_KINDS)).withColumn("original", original)
    words = named.select("*", F.posexplode(split_words("original")).alias("idx", "token"))
    at = F.col("idx").cast("string")
    return words.select(
        M.observation_id("vocabulary", F.lit("term"), "id", at, "token").alias("id"),
        F.lit("observation").alias("kind"),
        F.lit(M.TERM).alias("name"),
        F.col("token").alias("value"),
        F.col("id").alias("targetId"),
        F.lit("node").alias("targetKind"),
        _attributes(original=F.col("original"), tokenIndex=at, nodeKind=F.col("kind"), packagePath=F.col("packagePath"), modulePath=F.col("modulePath")).alias("attributes"),
        F.array("id").alias("evidence"),
        F.lit("observed").alias("source"),
        "trustLevel",
        first_non_empty("freshness", F.lit("fresh")).alias("freshness"),
        "sourceFile",
        "lineRange",
    )


def incomplete_dependencies(edges: DataFrame) -> DataFrame:
    """One observation per import or dependency edge whose target is not known."""
    return edges.where(F.col("kind").isin("imports", "depends_on") & M.is_incomplete_edge()).select(
        M.observation_id("vocabulary", F.lit("incomplete_dependency"), "id").alias("id"),
        F.lit("observation").alias("kind"),
        F.lit(M.INCOMPLETE).alias("name"),
        F.col("to").alias("value"),
        F.col("id").alias("targetId"),
        F.lit("edge").alias("targetKind"),
        _attributes(edgeKind=F.col("kind"), **{"from": F.col("from"), "to": F.col("to")}, reason=F.col("reason")).alias("attributes"),
        F.array("id").alias("evidence"),
        F.lit("observed").alias("source"),
        "trustLevel",
        F.lit("fresh").alias("freshness"),
        "sourceFile",
        "lineRange",
    )


def cooccurrences(observations: DataFrame) -> DataFrame:
    """Pairs of different terms of one target, counted per package by occurrence.

    A target's words meet in one array, so pairs are made without a self join; its size is that
    of an identifier, not of the corpus."""
    t = observations.where(F.col("name") == M.TERM).select("id", "targetId", F.col("value").alias("term"), M.attribute("packagePath").alias("pkg"), M.trust_rank("trustLevel").alias("rank"))
    t = t.where("term <> '' and targetId <> '' and pkg <> ''")
    words = t.groupBy("targetId", "pkg").agg(F.collect_list(F.struct("term", "id", "rank")).alias("words")).where(F.size("words") > 1)
    a = words.select("pkg", "words", F.explode("words").alias("a"))
    b = a.select("pkg", "a", F.explode(F.filter("words", lambda w: w["term"] > F.col("a")["term"])).alias("b"))
    pairs = b.groupBy("pkg", F.col("a.term").alias("termA"), F.col("b.term").alias("termB")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.least("a.rank", "b.rank")).alias("rank"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a.id", "b.id"))))).alias("evidence"),
    )
    return pairs.select(
        M.observation_id("vocabulary_cooccurrence", "pkg", "termA", "termB").alias("id"),
        F.lit("observation").alias("kind"),
        F.lit(M.PAIR).alias("name"),
        F.concat_ws(" ", "termA", "termB").alias("value"),
        F.lit("").alias("targetId"),
        F.lit("").alias("targetKind"),
        _attributes(packagePath=F.col("pkg"), termA=F.col("termA"), termB=F.col("termB"), count=F.col("n").cast("string")).alias("attributes"),
        "evidence",
        F.lit("inferred").alias("source"),
        M.trust_of(F.col("rank")).alias("trustLevel"),
        F.lit("fresh").alias("freshness"),
        F.lit("").alias("sourceFile"),
        F.lit("").alias("lineRange"),
    )


def valid_pair() -> F.Column:
    a, b = M.attribute("termA"), M.attribute("termB")
    return (F.col("name") == M.PAIR) & (M.attribute("packagePath") != "") & (a != "") & (b != "") & (a != b) & (whole_number(M.attribute("count")) > 0)


def zone_candidates(observations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Packages whose vocabulary hangs together: at least two terms and one pair of them."""
    stop = lambda c: c.isin(*STOP_TERMS)
    pkg = M.attribute("packagePath").alias("pkg")
    rank = M.trust_rank("trustLevel").alias("rank")
    single = observations.where((F.col("name") == M.TERM) & (F.col("source") == "observed") & (F.col("value") != "") & (M.attribute("packagePath") != "") & ~stop(F.col("value")) & ~F.col("targetId").startswith("placeholder:"))
    single = single.select(pkg, F.array("value").alias("terms"), F.lit(0).cast("bigint").alias("n"), "id", rank)
    pair = observations.where(valid_pair() & (F.col("source") == "inferred") & ~stop(M.attribute("termA")) & ~stop(M.attribute("termB")) & ~F.col("targetId").startswith("placeholder:"))
    pair = pair.select(pkg, F.array(M.attribute("termA"), M.attribute("termB")).alias("terms"), whole_number(M.attribute("count")).alias("n"), "id", rank)
    real = nodes.where((F.col("kind") == "package") & ~M.is_placeholder_node() & (F.col("packagePath") != "")).groupBy("packagePath").agg(F.min("id").alias("nodeId"))
    ghosts = nodes.where(M.is_placeholder_node()).select(F.when(F.col("packagePath") != "", F.col("packagePath")).otherwise(M.strip("id", "placeholder:package:")).alias("pkg")).where("pkg <> ''").distinct()
    ghosts = ghosts.join(real, ghosts["pkg"] == real["packagePath"], "left_anti")
    found = single.unionByName(pair).join(ghosts, "pkg", "left_anti").groupBy("pkg").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"),
        F.sum("n").alias("n"),
        F.array_sort(F.collect_set("id")).alias("evidence"),
        F.min("rank").alias("rank"),
    )
    found = found.where("n > 0 and size(terms) >= 2").join(real, found["pkg"] == real["packagePath"], "left")
    node = F.coalesce("nodeId", F.lit(""))
    return found.select(
        M.observation_id("language_zone_candidate", "pkg", F.array_join("terms", "\0")).alias("id"),
        F.lit("observation").alias("kind"),
        F.lit(M.CANDIDATE).alias("name"),
        F.array_join("terms", " ").alias("value"),
        node.alias("targetId"),
        F.when(node != "", "node").otherwise("").alias("targetKind"),
        _attributes(packagePath=F.col("pkg"), terms=F.array_join("terms", ","), termCount=F.size("terms").cast("string"), cooccurrenceCount=F.col("n").cast("string")).alias("attributes"),
        "evidence",
        F.lit("inferred").alias("source"),
        M.trust_of(F.col("rank")).alias("trustLevel"),
        F.lit("fresh").alias("freshness"),
        F.lit("").alias("sourceFile"),
        F.lit("").alias("lineRange"),
    )


def bridges(observations: DataFrame, edges: DataFrame) -> DataFrame:
    """Complete package edges between two candidates."""
    c = observations.where((F.col("name") == M.CANDIDATE) & (M.attribute("packagePath") != "")).groupBy(M.attribute("packagePath").alias("pkg")).agg(F.min_by(F.struct("id", "trustLevel"), "id").alias("c"))
    src = c.select(F.col("pkg").alias("fromPkg"), F.col("c").alias("fc"))
    dst = c.select(F.col("pkg").alias("toPkg"), F.col("c").alias("tc"))
    e = edges.where(F.col("kind").isin("imports", "depends_on") & ~M.is_incomplete_edge() & F.col("from").startswith("package:") & F.col("to").startswith("package:"))
    e = e.withColumn("fromPkg", M.strip("from", "package:")).withColumn("toPkg", M.strip("to", "package:")).where("fromPkg <> toPkg and fromPkg <> '' and toPkg <> ''")
    e = e.join(src, "fromPkg").join(dst, "toPkg")
    return e.select(
        M.observation_id("bridge_symbol", "id", "fromPkg", "toPkg").alias("id"),
        F.lit("observation").alias("kind"),
        F.lit(M.BRIDGE).alias("name"),
        F.concat_ws(" -> ", "fromPkg", "toPkg").alias("value"),
        F.col("id").alias("targetId"),
        F.lit("edge").alias("targetKind"),
        _attributes(fromPackagePath=F.col("fromPkg"), toPackagePath=F.col("toPkg"), edgeKind=F.col("kind"), fromCandidateId=F.col("fc.id"), toCandidateId=F.col("tc.id")).alias("attributes"),
        F.array_sort(F.array("id", "fc.id", "tc.id")).alias("evidence"),
        F.lit("inferred").alias("source"),
        M.least_trust("trustLevel", "fc.trustLevel", "tc.trustLevel").alias("trustLevel"),
        F.lit("fresh").alias("freshness"),
        F.lit("").alias("sourceFile"),
        F.lit("").alias("lineRange"),
    )
