"""The registered queries over the star-schema tables, one per operator or family."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import example
from . import model as M
from .functions import scalars as S
from .operators import complexity, graph, language, policy, projections, reports, viewer, vocabulary
from .plans import analyzers, engine
from .plans.tables import folder, keep
from .sources import config, loads, workspace
from .sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

RULES = {
    "rules": [
        {"package": "ASIA/NATION_2", "allow": ["ASIA/NATION_7", "ASIA/NATION_12", "EUROPE/NATION_3"]},
        {"id": "no_africa", "package": "EUROPE/NATION_3", "deny": ["AFRICA/NATION_0", "AFRICA/NATION_5"]},
        {"package": "AMERICA/NATION_1", "deny": ["ASIA/NATION_2"], "allow": ["AMERICA/NATION_6", "ASIA/NATION_2"]},
        {"package": "AFRICA/NATION_5"},
        {"module": "EUROPE", "allowModules": ["ASIA", "AFRICA"]},
        {"id": "asia_alone", "module": "ASIA", "denyModules": ["AMERICA"]},
    ]
}
LANGUAGE = {
    "contexts": [
        {"id": "Gold", "packagePrefixes": ["ASIA", "EUROPE/NATION_3"], "terms": ["ring", "Gold ", "widget", "economy"], "synonyms": {"small": "little", "http": ""}, "discouragedTerms": ["little", "red"]},
        {"id": "west", "packagePrefixes": ["AMERICA", "EUROPE"], "terms": ["ring", "standard", "nation"], "discouragedTerms": ["promo"]},
        {"id": "late", "packagePrefixes": ["EUROPE"], "terms": ["x"]},
    ],
    "ignoredTerms": ["asia", "europe", "america"],
}
COUNTING = {"cyclomatic": {"warningThreshold": 24, "countSelectDefaultClauses": False, "countGotoStatements": True}}
HASH = "config"


#: Facts that were written once, by session and folder; every later query reads the tables.
WRITTEN: dict[tuple[str, str], dict[str, DataFrame | dict[str, DataFrame]]] = {}


class Facts(dict):
    """Base facts of the tables, derived ones made when first asked for.

    A section is written as a table once in a session and folder, so a query that uses it in many
    branches, or a later query, reads it instead of deriving it from the star schema again."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.t, self.spark = Tables(spark, sf_dir), spark
        self.written = WRITTEN.setdefault((spark.sparkContext.applicationId, sf_dir), {})

    def __missing__(self, section: str) -> DataFrame:
        if section not in self.written:
            made = getattr(self, section)()
            self.written[section] = {k: keep(d) for k, d in made.items()} if isinstance(made, dict) else keep(made)
        self[section] = out = self.written[section]
        return out

    def nodes(self) -> DataFrame:
        return self.t.nodes()

    def edges(self) -> DataFrame:
        return self.t.edges()

    def diagnostics(self) -> DataFrame:
        return self.t.diagnostics()

    def sourceRecords(self) -> DataFrame:  # noqa: N802
        return self.t.source_records()

    def words(self) -> DataFrame:
        return vocabulary.terms(self["nodes"])

    def pairs(self) -> DataFrame:
        return vocabulary.cooccurrences(self["words"])

    def candidates(self) -> DataFrame:
        return vocabulary.zone_candidates(self["words"].unionByName(self["pairs"]), self["nodes"])

    def bridges(self) -> DataFrame:
        return vocabulary.bridges(self["candidates"], self["edges"])

    def observations(self) -> DataFrame:
        parts = vocabulary.incomplete_dependencies(self["edges"]), self["pairs"], self["candidates"], self["bridges"]
        out = self["words"]
        for p in parts:
            out = out.unionByName(p)
        return out

    def decisions(self) -> DataFrame:
        return self.t.decisions()

    def measured(self) -> dict[str, DataFrame]:
        parsed = self["nodes"].where("kind = 'file' and not sourceFile like '%supplier_7.go'").select("sourceFile")
        return complexity.metrics(self["nodes"], self["decisions"], parsed, complexity.Counting.of(COUNTING), HASH)

    def metrics(self) -> DataFrame:
        return self["measured"]["metrics"]

    def judged(self) -> dict[str, DataFrame]:
        return policy.evaluate(self["edges"], policy.rules(self.spark, RULES), self["diagnostics"], HASH)

    def policyResults(self) -> DataFrame:  # noqa: N802
        return self["judged"]["policyResults"]

    def warnings(self) -> DataFrame:
        return self["judged"]["warnings"]

    def language(self) -> dict[str, DataFrame]:
        return language.evaluate(self["nodes"], language.contexts(self.spark, LANGUAGE), LANGUAGE["ignoredTerms"], HASH)

    def queries(self) -> DataFrame:
        q = complexity.policy_queries(self["policyResults"])
        for mode in ("package", "domain"):
            q = q.unionByName(complexity.complexity_queries(self["nodes"], self["metrics"], self["edges"], self["measured"]["diagnostics"], mode))
        return q


def flat(df: DataFrame, *names: str | Column) -> DataFrame:
    """Chosen columns, arrays joined by "|", whole numbers as bigint."""
    df = df.select(*names) if names else df
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        out.append((F.array_join(c, "|") if kind == "array<string>" else c.cast("bigint") if kind in ("int", "bigint") else c).alias(f.name))
    return df.select(*out)


def query(f: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Facts(spark, sf_dir))
    return f


def digest(c: str) -> Column:
    return F.md5(F.array_join(c, "|").cast("binary")).alias(c)


# ---- vocabulary ---------------------------------------------------------------------------


@query
def split_words(f: Facts) -> DataFrame:
    return f.t.symbols().select("id", F.posexplode(S.split_words("name")).alias("idx", "word")).select("id", F.col("idx").cast("bigint").alias("idx"), "word")


@query
def vocabulary_terms(f: Facts) -> DataFrame:
    return f["words"].select("id", "value", "targetId", "trustLevel", M.attribute("original").alias("original"), M.attribute("tokenIndex").alias("tokenIndex"), M.attribute("nodeKind").alias("nodeKind"), M.attribute("packagePath").alias("packagePath"))


@query
def incomplete_dependency(f: Facts) -> DataFrame:
    return vocabulary.incomplete_dependencies(f["edges"]).select("id", "value", "targetId", M.attribute("from").alias("source"), M.attribute("reason").alias("reason"))


@query
def terms_by_package(f: Facts) -> DataFrame:
    return flat(projections.terms_by_package(f["words"]), "packagePath", "term", "count", "nodeKinds")


@query
def top_terms_by_package(f: Facts) -> DataFrame:
    return flat(projections.top_terms(f["words"], 3), "packagePath", "term", "count", "rank")


@query
def spellings_by_term(f: Facts) -> DataFrame:
    return flat(projections.spellings(f["words"]), "term", "original", "count", "rank")


@query
def observations_by_target(f: Facts) -> DataFrame:
    return projections.by_target(f["words"]).select("targetId", digest("observationIds"))


@query
def incomplete_deps_by_package(f: Facts) -> DataFrame:
    return projections.incomplete_by_package(vocabulary.incomplete_dependencies(f["edges"])).select("packagePath", digest("observationIds"))


@query
def cooccurrence_pairs(f: Facts) -> DataFrame:
    return f["pairs"].select("id", "value", M.attribute("packagePath").alias("packagePath"), M.attribute("count").alias("count"), "trustLevel", digest("evidence"))


@query
def cooccurrences_by_package(f: Facts) -> DataFrame:
    return flat(projections.pairs_by_package(f["pairs"]), "packagePath", "termA", "termB", "count")


@query
def top_cooccurrences(f: Facts) -> DataFrame:
    return flat(projections.top_pairs(f["pairs"], 5), "packagePath", "termA", "termB", "count", "rank")


@query
def cooccurrences_by_term(f: Facts) -> DataFrame:
    return projections.pairs_by_term(f["pairs"]).select("term", "termA", "termB", F.col("count").cast("bigint").alias("count"), F.array_join("packages", "|").alias("packages"))


@query
def language_zone_candidates(f: Facts) -> DataFrame:
    return f["candidates"].select("id", "targetId", "targetKind", "value", M.attribute("termCount").alias("termCount"), M.attribute("cooccurrenceCount").alias("cooccurrenceCount"), "trustLevel", digest("evidence"))


@query
def bridge_symbols(f: Facts) -> DataFrame:
    return flat(f["bridges"], "id", "value", "targetId", "trustLevel", "evidence")


# ---- language, complexity, policy ---------------------------------------------------------


@query
def ubiquitous_language_labels(f: Facts) -> DataFrame:
    return flat(f["language"]["labels"], "id", "name", "value", "targetId", "source", "evidence", "trustLevel")


@query
def ubiquitous_language_warnings(f: Facts) -> DataFrame:
    return flat(f["language"]["warnings"], "id", "kind", "reason", "affectedNodeId", "evidence", "trustLevel")


@query
def ubiquitous_language_alignment(f: Facts) -> DataFrame:
    return flat(f["language"]["metrics"], "id", "value", "scope", "status", "trustLevel")


def _metric(f: Facts, name: str) -> DataFrame:
    return flat(f["metrics"].where(F.col("name") == name), "id", "value", "scope", "subject", "status", "threshold", "reason")


@query
def cyclomatic_metrics(f: Facts) -> DataFrame:
    return _metric(f, complexity.CYCLOMATIC)


@query
def decision_counts(f: Facts) -> DataFrame:
    return _metric(f, complexity.DECISIONS)


@query
def runtime_marker_counts(f: Facts) -> DataFrame:
    return _metric(f, complexity.MARKERS)


@query
def complexity_diagnostics(f: Facts) -> DataFrame:
    return flat(f["measured"]["diagnostics"], "level", "source", "reason", "status", "nodeId", "sourceFile", "evidence")


@query
def policy_results(f: Facts) -> DataFrame:
    return flat(f["policyResults"], "id", "ruleId", "status", "scope", "subject", "reason", "evidence", "trustLevel")


@query
def policy_warnings(f: Facts) -> DataFrame:
    return flat(f["warnings"], "id", "reason", "affectedEdgeId", "evidence", "suggestedNextAction")


@query
def violates_edges(f: Facts) -> DataFrame:
    return f["judged"]["edges"].select("id", F.col("from").alias("source"), F.col("to").alias("target"), "complete", "reason")


@query
def policy_diagnostics(f: Facts) -> DataFrame:
    return flat(f["judged"]["diagnostics"], "level", "source", "reason", "status", "policyResultId", "edgeId")


@query
def module_dependency_labels(f: Facts) -> DataFrame:
    return flat(policy.module_dependencies(f["edges"], None)["labels"], "id", "value", "targetId", "evidence")


@query
def missing_dependency_warnings(f: Facts) -> DataFrame:
    return flat(policy.module_dependencies(f["edges"], f["diagnostics"])["warnings"], "id", "reason", "evidence")


@query
def outdated_unknown(f: Facts) -> DataFrame:
    return flat(policy.module_dependencies(f["edges"], None, True)["warnings"], "id", "reason", "affectedEdgeId", "evidence")


@query
def policy_query(f: Facts) -> DataFrame:
    return flat(complexity.policy_queries(f["policyResults"]), "id", "status", "reason", "actualTrustLevel", "proofStatus", "evidence")


def _complexity(f: Facts, mode: str) -> DataFrame:
    q = complexity.complexity_queries(f["nodes"], f["metrics"], f["edges"], f["measured"]["diagnostics"], mode)
    return q.select("id", "status", "reason", "actualTrustLevel", "proofStatus", F.size("evidence").cast("bigint").alias("n"), digest("evidence"))


@query
def complexity_query_package(f: Facts) -> DataFrame:
    return _complexity(f, "package")


@query
def complexity_query_domain(f: Facts) -> DataFrame:
    return _complexity(f, "domain")


# ---- graph --------------------------------------------------------------------------------


def _late(f: Facts) -> DataFrame:
    """Nodes to which packages that edges hold for absent are added, as if found later."""
    late = f["nodes"].where("kind = 'placeholder'").where(F.length("packagePath") % 2 == 0)
    real = late.withColumns({"id": M.package_id("packagePath"), "kind": F.lit("package"), "synthetic": F.lit(False), "reason": F.lit("")})
    return f["nodes"].unionByName(real)


@query
def reconcile_placeholders(f: Facts) -> DataFrame:
    _, edges = graph.reconcile(_late(f), f["edges"])
    return edges.where("kind in ('imports', 'depends_on')").select("id", F.col("to").alias("target"), "complete", "reason")


@query
def reconciled_nodes(f: Facts) -> DataFrame:
    nodes, _ = graph.reconcile(_late(f), f["edges"])
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def upsert_nodes(f: Facts) -> DataFrame:
    """Parts as observations of their name, in order of their number."""
    p = f.t.read("part").select(
        F.concat(F.lit("type:"), "p_name").alias("id"), F.col("p_brand").alias("name"), F.element_at(F.array(*map(F.lit, M.TRUST)), (F.col("p_size") % 3 + 1).cast("int")).alias("trustLevel"),
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("r"), F.col("p_size").cast("string"))).otherwise("").alias("reason"), F.col("p_partkey").alias("seq"),
    )
    return graph.upsert_nodes(p).select("id", "name", "trustLevel", "reason")


@query
def upsert_edges(f: Facts) -> DataFrame:
    o = f.t.read("orders").select(F.concat(F.lit("edge:calls:"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("reason"), (F.col("o_orderstatus") == "F").alias("complete"), F.col("o_orderkey").alias("seq"))
    return graph.upsert_edges(o)


@query
def trust_upgrade(f: Facts) -> DataFrame:
    e = f["edges"].where("kind = 'imports'").select(M.strip("from", "package:").alias("p"), M.strip("to", "package:").alias("t"))
    loads = e.where(F.col("p").contains("NATION_1")).groupBy(F.col("p").alias("package")).agg(F.array_sort(F.collect_set(F.when(F.col("t") == "", F.lit("open")))).alias("errors"), F.array_sort(F.collect_set(F.when(F.col("t").contains("NATION_2"), F.col("t")))).alias("imports"))
    return graph.upgrade_trust(f["nodes"], loads).where("kind in ('package', 'placeholder')").select("id", "trustLevel", "reason")


@query
def validate_dangling_refs(f: Facts) -> DataFrame:
    facts = {"nodes": f["nodes"], "edges": f["edges"].where("kind <> 'declares'"), "policyResults": f["policyResults"], "warnings": f["warnings"]}
    return graph.dangling(facts)


@query
def classify_diagnostics(f: Facts) -> DataFrame:
    return f["diagnostics"].select("source", "reason", "status", "level")


@query
def source_hashes(f: Facts) -> DataFrame:
    d = f.t.read("documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return d.select("doc_id", S.content_hash(F.col("content")).alias("full"), S.short_hash(F.col("content")).alias("short"))


@query
def freshness_ledger(f: Facts) -> DataFrame:
    from .streaming.freshness import ledger

    return ledger(f.t.read("events").select(F.col("user_id").cast("string").alias("factId"), F.col("ts").alias("seen"), F.col("event_id").alias("seq"), F.col("event_type").alias("hash")))


@query
def simulated_change(f: Facts) -> DataFrame:
    files = f.t.read("documents").select(F.col("doc_id").cast("string").alias("sourceFile"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return engine.simulated_change(files).select("factId", "sourceFile", "oldHash", "newHash", "status", "reason")


@query
def parse_line_range(f: Facts) -> DataFrame:
    y = f["nodes"].where("lineRange <> ''").select("id", S.line_range("lineRange").alias("r"))
    return y.select("id", F.col("r.startLine").cast("bigint").alias("startLine"), F.col("r.endLine").cast("bigint").alias("endLine"))


@query
def source_block(f: Facts) -> DataFrame:
    d = f.t.read("documents").select(F.col("doc_id").cast("string").alias("sourceFile"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return viewer.source_block(d, "7", "2:1-5:1")


@query
def property_sections(f: Facts) -> DataFrame:
    """A section cut out of a JSON document."""
    return f.t.read("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# ---- reports ------------------------------------------------------------------------------


def _scope(f: Facts, **options: str) -> reports.Scope:
    return reports.Scope(f, reports.Options(**options))


@query
def stats_summary(f: Facts) -> DataFrame:
    return reports.summary(_scope(f))


@query
def stats_summary_in_module(f: Facts) -> DataFrame:
    return reports.summary(_scope(f, module="ASIA"))


@query
def stats_summary_in_package(f: Facts) -> DataFrame:
    return reports.summary(_scope(f, package="ASIA/NATION_2"))


@query
def stats_modules(f: Facts) -> DataFrame:
    return flat(reports.module_stats(_scope(f)))


@query
def stats_packages(f: Facts) -> DataFrame:
    return flat(reports.package_stats(_scope(f)))


@query
def stats_packages_in_package(f: Facts) -> DataFrame:
    return flat(reports.package_stats(_scope(f, package="ASIA/NATION_2")))


@query
def stats_files(f: Facts) -> DataFrame:
    return flat(reports.file_stats(_scope(f)))


@query
def stats_workspace(f: Facts) -> DataFrame:
    return flat(reports.workspace(f))


@query
def module_discovery(f: Facts) -> DataFrame:
    return flat(reports.discovery(f))


@query
def ddd_candidates(f: Facts) -> DataFrame:
    return flat(reports.zones(f)["candidates"].limit(50))


@query
def ddd_bridges(f: Facts) -> DataFrame:
    return flat(reports.zones(f)["bridges"].limit(50))


@query
def ddd_incomplete(f: Facts) -> DataFrame:
    out = reports.zones(f)["incompleteEvidence"].limit(50)
    return flat(out.withColumnsRenamed({"from": "source", "to": "target"}))


def _problem(f: Facts, section: str, *columns: str) -> DataFrame:
    return flat(reports.problems({section: f[section]})[section].limit(50), *columns)


@query
def problems_policy(f: Facts) -> DataFrame:
    return _problem(f, "policyResults", "id", "status", "reason")


@query
def problems_metrics(f: Facts) -> DataFrame:
    return _problem(f, "metrics", "id", "value", "reason")


@query
def problems_warnings(f: Facts) -> DataFrame:
    return _problem(f, "warnings", "id", "reason")


@query
def problems_queries(f: Facts) -> DataFrame:
    return _problem(f, "queries", "id", "status", "reason")


@query
def problems_diagnostics(f: Facts) -> DataFrame:
    return _problem(f, "diagnostics", "source", "reason", "status")


@query
def graph_filter_nodes(f: Facts) -> DataFrame:
    out = reports.filter_graph({"nodes": f["nodes"], "edges": f["edges"]}, ["NODES"], node_kinds=["package", "file", "nonsense"])
    return out["nodes"].select("id", "kind", "name")


@query
def graph_filter_edges(f: Facts) -> DataFrame:
    out = reports.filter_graph({"nodes": f["nodes"], "edges": f["edges"]}, ["ed-ges"], edge_kinds=["imports"])
    return out["edges"].select("id", "complete")


@query
def graph_filter_observations(f: Facts) -> DataFrame:
    out = reports.filter_graph({"observations": f["observations"]}, None, observation_names=[M.INCOMPLETE, M.BRIDGE])
    return out["observations"].select("id", "name", "value")


@query
def value_catalogue(f: Facts) -> DataFrame:
    return reports.catalogue(f.spark, analyzers.known_ids())


# ---- viewer -------------------------------------------------------------------------------


@query
def viewer_search(f: Facts) -> DataFrame:
    return viewer.search(f["nodes"], "RINGeco", "struct").select("id", "name")


@query
def viewer_code_scope(f: Facts) -> DataFrame:
    return viewer.code_scope(f["nodes"], "ASIA/NATION_2").select("id", "lineRange")


@query
def viewer_layout(f: Facts) -> DataFrame:
    return flat(viewer.layout(f["nodes"]))


def _functions(f: Facts) -> DataFrame:
    return f["nodes"].where("kind in ('function', 'method')")


@query
def viewer_containment(f: Facts) -> DataFrame:
    return viewer.contained(_functions(f), f["nodes"].where("kind in ('field', 'type')"))


@query
def viewer_suffix_match(f: Facts) -> DataFrame:
    calls = f["nodes"].where("kind = 'struct'").select(F.concat(F.lit("call:"), "id").alias("id"), F.concat(F.lit("pkg.svc."), "name").alias("name"))
    return viewer.name_matches(calls, _functions(f).select("id", "name"))


@query
def viewer_evidence(f: Facts) -> DataFrame:
    known = f["edges"].select("id", "kind").union(f["nodes"].select("id", "kind"))
    return viewer.evidence_of(f["policyResults"], known)


@query
def viewer_incident_edges(f: Facts) -> DataFrame:
    return viewer.incident(f["edges"], f["nodes"].where("kind in ('package', 'module')"))


@query
def viewer_visible_edges(f: Facts) -> DataFrame:
    return viewer.visible_edges(f["edges"], f["nodes"].where("kind in ('package', 'file')")).select("id", "kind")


@query
def viewer_neighbours(f: Facts) -> DataFrame:
    return viewer.neighbours(f["edges"], f["nodes"].where("kind = 'module'"))


@query
def viewer_summary(f: Facts) -> DataFrame:
    facts = {s: f[s] for s in ("nodes", "edges", "queries", "policyResults", "metrics", "diagnostics")}
    return viewer.tiles(facts)


@query
def viewer_feed(f: Facts) -> DataFrame:
    facts = {s: f[s] for s in ("queries", "policyResults", "metrics", "diagnostics")}
    ran = [("policy_evaluation", "completed", 7), ("rendering", "partial", 0)]
    facts["runs"] = f.spark.createDataFrame(ran, "stage string, status string, emittedFacts long")
    facts["pathJobs"] = f.spark.createDataFrame([("blocked", "no way")], "status string, blockingReason string")
    facts["freshness"] = f.t.read("part").select(F.col("p_name").alias("sourceFile"), F.when(F.col("p_size") > 25, "stale").otherwise("fresh").alias("status"))
    return flat(viewer.feed(facts))


@query
def viewer_related(f: Facts) -> DataFrame:
    return viewer.related(f["edges"].where("kind = 'imports'").select("id").union(f["edges"].select("id")))


@query
def viewer_list(f: Facts) -> DataFrame:
    return viewer.listed(f["nodes"]).select("id")


@query
def viewer_source_order(f: Facts) -> DataFrame:
    """Places in the order of the source list."""
    found = viewer.in_source_order(viewer.code_scope(f["nodes"], "", " Brass "))
    return _placed(found.select("id"), "id")


@query
def viewer_metric_filter(f: Facts) -> DataFrame:
    return viewer.with_status(f["metrics"], "warning").select("id", "status")


@query
def viewer_selection(f: Facts) -> DataFrame:
    return viewer.selection(f["policyResults"])


@query
def viewer_touched(f: Facts) -> DataFrame:
    return viewer.touched(f["edges"], viewer.selection(f["nodes"].where("kind = 'package'").select("id", F.array("id").alias("evidence"))))


@query
def viewer_choices(f: Facts) -> DataFrame:
    return viewer.choices(f["nodes"])


@query
def viewer_index(f: Facts) -> DataFrame:
    return viewer.fact_index({s: f[s] for s in ("nodes", "edges", "policyResults", "metrics")})


@query
def viewer_kind_counts(f: Facts) -> DataFrame:
    return viewer.by_kind(f["nodes"])


@query
def viewer_labels(f: Facts) -> DataFrame:
    d = f.t.read("documents")
    return d.select("doc_id", S.middle_cut("text", 24).alias("short"), F.md5(S.escape_html("text").cast("binary")).alias("escaped"))


# ---- plans and sinks ----------------------------------------------------------------------


def _placed(ordered: DataFrame, *names: str) -> DataFrame:
    """Rows with their place (from 1) in the order that ``ordered`` has."""
    rows = ordered.withColumn("at", F.monotonically_increasing_id())
    return rows.select(*names, F.row_number().over(Window.orderBy("at")).cast("bigint").alias("place"))


@query
def sorted_nodes(f: Facts) -> DataFrame:
    return _placed(engine.in_order({"nodes": f["nodes"]})["nodes"].select("id"), "id")


@query
def sorted_diagnostics(f: Facts) -> DataFrame:
    ordered = engine.in_order({"diagnostics": f["diagnostics"]})["diagnostics"]
    return _placed(ordered.select("source", "reason"), "source", "reason")


@query
def analyzer_order(f: Facts) -> DataFrame:
    result = analyzers.in_order({"diagnostics": f["judged"]["diagnostics"], "policyResults": f["policyResults"]})
    first = _placed(result["diagnostics"].select(F.concat_ws(":", "source", "reason").alias("fact")), "fact")
    return first.withColumn("part", F.lit("diagnostics")).unionByName(_placed(result["policyResults"].select(F.col("id").alias("fact")), "fact").withColumn("part", F.lit("policyResults")))


@query
def stats_order(f: Facts) -> DataFrame:
    lists = reports.stats(f)
    part = lambda s, k: _placed(lists[s].select(F.col(k).alias("key")), "key").withColumn("part", F.lit(s))
    return part("modules", "modulePath").unionByName(part("packages", "packagePath")).unionByName(part("files", "sourceFile"))


@query
def written_graph(f: Facts) -> DataFrame:
    """What the JSON sink wrote, read again: empty values are left out."""
    text = F.to_json(F.struct("id", "kind", F.nullif("reason", F.lit("")).alias("reason"), F.nullif("lineRange", F.lit("")).alias("lineRange")))
    return f["nodes"].select("id", text.alias("json"))


@query
def graph_summary(f: Facts) -> DataFrame:
    facts = {s: f[s] for s in ("nodes", "edges", "sourceRecords", "queries")} | {"pathJobs": M.empty(f.spark, "pathJobs"), "freshness": M.empty(f.spark, "freshness")}
    return engine.summarise(facts)


@query
def analyzer_plans(f: Facts) -> DataFrame:
    cases = [("all", [], []), ("closure", ["bridge_symbol"], []), ("cascade", [], ["vocabulary_cooccurrence"]), ("both", ["language_zone_candidate", " complexity "], ["vocabulary_extraction"]), ("unknown", ["nonsense"], []), ("none", ["complexity"], ["complexity"])]
    rows = []
    for name, include, skip in cases:
        try:
            rows += [(name, i, a.id) for i, a in enumerate(analyzers.plan(include, skip), 1)]
        except ValueError as e:
            rows.append((name, 0, str(e)))
    return f.spark.createDataFrame(rows, "name string, place long, id string")


@query
def analyzer_contracts(f: Facts) -> DataFrame:
    """Inputs, emitted kinds, needs and limits of every analyzer, in order."""
    rows = [(i, a.id, a.stage, "|".join(a.inputs), "|".join(a.emits), "|".join(a.needs), a.least_trust, a.most_trust, a.on_incomplete, len(analyzers.check_contract(a))) for i, a in enumerate(analyzers.ANALYZERS)]
    return f.spark.createDataFrame(rows, "place long, id string, stage string, inputs string, emits string, needs string, leastTrust string, mostTrust string, onIncomplete string, findings long")


@query
def contract_findings(f: Facts) -> DataFrame:
    good = analyzers.ANALYZERS[0]
    wrong = {
        "bare": {"id": "", "version": "", "stage": "", "inputs": (), "emits": ()}, "stage": {"stage": "guessing"}, "emits": {"emits": ("label", "rumour")}, "trust": {"least_trust": "type_resolved", "most_trust": "package_loaded"},
        "trust_name": {"least_trust": "hope", "most_trust": ""}, "modes": {"failure": "panic", "on_incomplete": "guess"}, "good": {},
    }
    rows = [(name, b) for name, given in wrong.items() for b in analyzers.check_contract(replace(good, **given))]
    return f.spark.createDataFrame(rows, "name string, finding string")


@query
def result_findings(f: Facts) -> DataFrame:
    """What the checks say of a result made of policy warnings, some of them spoilt."""
    a = replace(analyzers.ANALYZERS[0], emits=("warning",), most_trust="package_loaded")
    key = F.length("id") % 4
    w = f["warnings"].withColumn("_k", key)
    w = w.withColumn("trustLevel", F.when(F.col("_k") == 0, "type_resolved").when(F.col("_k") == 1, "").otherwise(F.col("trustLevel")))
    w = w.withColumn("kind", F.when(F.col("_k") == 2, "").otherwise(F.col("kind"))).withColumn("affectedEdgeId", F.when(F.col("_k") == 3, "edge:gone").otherwise("")).withColumn("affectedNodeId", F.lit("")).withColumn("evidence", F.array().cast("array<string>")).drop("_k")
    labels = policy.module_dependencies(f["edges"], None)["labels"]
    return analyzers.check_result(a, f["edges"].select("id").union(f["nodes"].select("id")), {"warnings": M.conform(w, "warnings"), "labels": M.conform(labels, "labels")})


@query
def unready_facts(f: Facts) -> DataFrame:
    a = replace(analyzers.ANALYZERS[0], inputs=("package", "placeholder", "imports", "depends_on"), on_incomplete="require_complete")
    return analyzers.unready(a, f)


@query
def metric_definitions(f: Facts) -> DataFrame:
    return f.spark.createDataFrame([(d.name, d.unit, d.scope) for d in complexity.DEFINITIONS], "name string, unit string, scope string")


@query
def package_loads(f: Facts) -> DataFrame:
    """Rows of a loader: those of one package are one."""
    rows = f["edges"].where("kind = 'imports'").select(M.strip("from", "package:").alias("package"), F.when(F.col("complete"), F.array()).otherwise(F.array("to")).cast("array<string>").alias("errors"), F.when(F.col("complete"), F.array("to")).alias("imports"))
    return flat(loads.clean(rows))


# ---- the example workspace ----------------------------------------------------------------


def _example(f: Facts) -> dict[str, DataFrame]:
    """All facts of the example workspace, through every stage; made once in a session."""
    key = (f.spark.sparkContext.applicationId, "example")
    if key not in WRITTEN:
        top = Path(folder(f.spark).removeprefix("file:")) / f"example-{uuid.uuid4().hex}"
        example.lay(top)
        WRITTEN[key] = engine.Build(f.spark, engine.Options(str(top / "night"), str(top), simulate_change=True)).run()
    return WRITTEN[key]


@query
def workspace_nodes(f: Facts) -> DataFrame:
    return _example(f)["nodes"].select("id", "kind", "trustLevel", "reason", "sourceFile", "lineRange", "packagePath", "modulePath")


@query
def workspace_edges(f: Facts) -> DataFrame:
    return _example(f)["edges"].select("id", "kind", "complete", "synthetic", "reason")


@query
def workspace_records(f: Facts) -> DataFrame:
    return _example(f)["sourceRecords"].select("id", "kind", "path", "sourceHash", "reason")


@query
def workspace_freshness(f: Facts) -> DataFrame:
    return _example(f)["freshness"].select("factId", "oldHash", "newHash", "status", "reason")


@query
def workspace_diagnostics(f: Facts) -> DataFrame:
    return _example(f)["diagnostics"].select("level", "source", "reason", "stage", "status")


@query
def workspace_runs(f: Facts) -> DataFrame:
    return flat(_example(f)["runs"], "stage", "analyzerId", "status", "emittedFacts", "diagnostics")


@query
def workspace_metrics(f: Facts) -> DataFrame:
    return flat(_example(f)["metrics"], "subject", "name", "value", "status")


@query
def workspace_policy(f: Facts) -> DataFrame:
    return flat(_example(f)["policyResults"], "ruleId", "subject", "status", "reason")


@query
def workspace_queries(f: Facts) -> DataFrame:
    return _example(f)["queries"].select("id", "status", "reason")


@query
def workspace_provenance(f: Facts) -> DataFrame:
    """Who made the rows of each section: every row has a run, and the run is listed."""
    facts, parts = _example(f), []
    runs = facts["runs"].select(F.col("runId").alias("_run"))
    for s in ("nodes", "edges", "observations", "metrics", "policyResults", "diagnostics", "queries"):
        rows = facts[s].join(runs, F.col("runId") == F.col("_run"), "left_semi")
        parts.append(rows.groupBy("producerId", "producerVersion").agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("section"), "producerId", "producerVersion", "n"))
    return reduce(DataFrame.unionByName, parts)


@query
def manifest_directives(f: Facts) -> DataFrame:
    """Directives of one go.mod per supplier, with blocks, comments and quotes, read back."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, name, n in batch.itertuples(index=False):
                m = workspace.manifest(f'module "{name}" // {n}\nrequire (\n\ta.test/n{n} v1 // indirect\n\n\tb.test/x v2\n)\nrequire c.test/y v3\nreplace a.test/n{n} => ../n{n}\n')
                out.append((key, m.module, "|".join(m.require), "|".join(m.replace), workspace.is_local(m.replace[0])))
            yield pd.DataFrame(out, columns=["s_suppkey", "module", "requires", "replaces", "isLocal"])

    return f.t.read("supplier").select("s_suppkey", "s_name", "s_nationkey").mapInPandas(run, "s_suppkey long, module string, requires string, replaces string, isLocal boolean")


@query
def config_sections(f: Facts) -> DataFrame:
    """Sections of a configuration as raw bytes, their hashes and the settings they hold."""
    raw = config.sections('{ "complexity": {"cyclomatic": {"warningThreshold": 7}},\n "moduleDependencyEnrichment" : {"networkAccess":"enabled"} , "ubiquitousLanguage": {}}')
    rows = [(k, v.decode(), config.hash_of(v), json.dumps(analyzers.config_of(v), separators=(",", ":"))) for k, v in raw.items()]
    rows.append(("absent", "", config.hash_of(None), json.dumps(analyzers.config_of(None))))
    return f.spark.createDataFrame(rows, "section string, raw string, hash string, settings string")
