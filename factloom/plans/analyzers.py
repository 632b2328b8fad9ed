"""Analyzers: contracts, order of work, checks of contracts and of results."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..operators import complexity, graph, language, policy, vocabulary

# Stages, failure modes and policies on incomplete input.
STAGES = (
    "source_discovery", "module_extraction", "syntax_extraction", "base_graph_assembly", "package_loading", "type_resolution", "module_dependency_enrichment",
    "third_party_behavior_labeling", "ddd_classification", "framework_extraction", "policy_evaluation", "complexity_metrics", "query_materialization", "rendering",
)
FAILURE_MODES = ("diagnostic",)
ON_INCOMPLETE = ("allow", "require_complete", "skip_incomplete_scope")


@dataclass
class Context:
    """What an analyzer gets: facts by section, its configuration and that one's hash."""

    spark: SparkSession
    facts: dict[str, DataFrame]
    config: dict
    config_hash: str = ""
    decisions: DataFrame | None = None
    parsed: DataFrame | None = None


Result = dict[str, DataFrame]


@dataclass(frozen=True)
class Analyzer:
    id: str
    stage: str
    inputs: tuple[str, ...]
    emits: tuple[str, ...]
    run: Callable[[Context], Result]
    section: str = ""
    needs: tuple[str, ...] = ()
    least_trust: str = "syntax_observed"
    most_trust: str = "syntax_observed"
    on_incomplete: str = "allow"
    failure: str = "diagnostic"
    version: str = "1"


def _moddep(c: Context) -> Result:
    return policy.module_dependencies(c.facts["edges"], c.facts["diagnostics"], bool(c.config.get("checkOutdatedModules")), c.config.get("networkAccess") or "disabled")


def _vocab(c: Context) -> Result:
    return {"observations": vocabulary.terms(c.facts["nodes"]).unionByName(vocabulary.incomplete_dependencies(c.facts["edges"]))}


def _language(c: Context) -> Result:
    ctx = language.contexts(c.spark, c.config)
    return {} if ctx is None else language.evaluate(c.facts["nodes"], ctx, c.config.get("ignoredTerms") or [], c.config_hash)


def _complexity(c: Context) -> Result:
    return complexity.metrics(c.facts["nodes"], c.decisions, c.parsed, complexity.Counting.of(c.config), c.config_hash)


def _policy(c: Context) -> Result:
    return {} if not c.config_hash else policy.evaluate(c.facts["edges"], policy.rules(c.spark, c.config), c.facts["diagnostics"], c.config_hash)


_HIGH = {"most_trust": "type_resolved"}
ANALYZERS = (
    Analyzer("module_dependency_enrichment", "module_dependency_enrichment", ("module", "depends_on", "diagnostic"), ("label", "warning"), _moddep, "moduleDependencyEnrichment"),
    Analyzer("vocabulary_extraction", "ddd_classification", (*vocabulary.TERM_KINDS, "imports", "depends_on"), ("observation",), _vocab, "vocabularyExtraction", **_HIGH),
    Analyzer("vocabulary_cooccurrence", "ddd_classification", ("observation",), ("observation",), lambda c: {"observations": vocabulary.cooccurrences(c.facts["observations"])}, "vocabularyCooccurrence", ("vocabulary_extraction",), **_HIGH),
    Analyzer("language_zone_candidate", "ddd_classification", ("observation", "package"), ("observation",), lambda c: {"observations": vocabulary.zone_candidates(c.facts["observations"], c.facts["nodes"])}, "languageZoneCandidate", ("vocabulary_extraction", "vocabulary_cooccurrence"), **_HIGH),
    Analyzer("bridge_symbol", "ddd_classification", ("observation", "imports", "depends_on"), ("observation",), lambda c: {"observations": vocabulary.bridges(c.facts["observations"], c.facts["edges"])}, "bridgeSymbol", ("language_zone_candidate",), **_HIGH),
    Analyzer("ubiquitous_language", "ddd_classification", ("module", "package", "function", "method", "type", "interface", "struct", "field"), ("label", "metric", "warning"), _language, "ubiquitousLanguage", on_incomplete="require_complete", **_HIGH),
    Analyzer("complexity", "complexity_metrics", ("function", "method"), ("metric", "diagnostic"), _complexity, "complexity", on_incomplete="require_complete"),
    Analyzer("dependency_policy", "policy_evaluation", ("package", "imports"), ("policy_result", "warning", "edge", "diagnostic"), _policy, "packageImportPolicy"),
)


class Registry:
    """Analyzers in the order they were registered."""

    def __init__(self) -> None:
        self._all: list[Analyzer] = []

    def register(self, analyzer: Analyzer) -> None:
        self._all.append(analyzer)

    def analyzers(self) -> tuple[Analyzer, ...]:
        """All of them, as a copy that later registrations do not change."""
        return tuple(self._all)


#: A result's rows in the order in which sinks list them.
ORDER = {"diagnostics": ("source", "reason")}


def in_order(result: Result) -> Result:
    """A result's tables, each by id, diagnostics by source and reason."""
    return {s: d.orderBy(*ORDER.get(s, ("id",))) for s, d in result.items()}


SECTION_KIND = {"labels": "label", "metrics": "metric", "warnings": "warning", "policyResults": "policy_result", "observations": "observation", "diagnostics": "diagnostic", "edges": "edge"}


def known_ids() -> list[str]:
    return sorted(a.id for a in ANALYZERS)


def plan(include: list[str] | None = None, skip: list[str] | None = None, analyzers: tuple[Analyzer, ...] = ANALYZERS) -> list[Analyzer]:
    """Analyzers to run, in order: the included ones with all they need, less the skipped ones and
    all that need those."""
    by_id = {a.id: a for a in analyzers}

    def ids(values: list[str] | None) -> set[str]:
        out = {v.strip() for v in values or [] if v.strip()}
        for v in sorted(out - by_id.keys()):
            raise ValueError(f"unknown analyzer {v!r}; known analyzers: {', '.join(sorted(by_id))}")
        return out

    wanted, out = ids(include), ids(skip)
    chosen: set[str] = set()
    todo = list(wanted or by_id)
    while todo:
        a = by_id[todo.pop()]
        if a.id not in chosen:
            chosen.add(a.id)
            todo += a.needs
    chosen -= out
    while lost := {i for i in chosen if not set(by_id[i].needs) <= chosen}:
        chosen -= lost
    return [a for a in analyzers if a.id in chosen]


def check_contract(a: Analyzer) -> list[str]:
    """What is wrong with an analyzer's contract."""
    bad = [f"analyzer metadata missing {n}" for n, v in (("id", a.id), ("version", a.version), ("stage", a.stage), ("input fact kinds", a.inputs), ("emitted fact kinds", a.emits)) if not v]
    if a.stage and a.stage not in STAGES:
        bad.append(f"analyzer metadata has unsupported stage {a.stage}")
    bad += [f"analyzer metadata has unsupported emitted fact kind {k}" for k in a.emits if k not in M.FACT_KINDS]
    for name, t in (("minimum required trust", a.least_trust), ("maximum emitted trust", a.most_trust)):
        if t not in M.TRUST:
            bad.append(f"analyzer metadata has unsupported {name} {t}" if t else f"analyzer metadata missing {name}")
    if a.least_trust in M.TRUST and a.most_trust in M.TRUST and M.TRUST.index(a.least_trust) > M.TRUST.index(a.most_trust):
        bad.append("analyzer metadata minimum required trust exceeds maximum emitted trust")
    if a.failure not in FAILURE_MODES:
        bad.append("analyzer metadata has unsupported failure mode")
    if a.on_incomplete not in ON_INCOMPLETE:
        bad.append("analyzer metadata has unsupported incomplete input policy")
    return bad


def unready(a: Analyzer, facts: dict[str, DataFrame]) -> DataFrame | None:
    """Ids (id) of input facts that are placeholders or incomplete, if the analyzer minds."""
    if a.on_incomplete == "allow":
        return None
    n = facts["nodes"].where(F.col("kind").isin(*a.inputs) & M.is_placeholder_node()).select("id")
    e = facts["edges"].where(F.col("kind").isin(*a.inputs) & M.is_incomplete_edge()).select("id")
    return n.union(e)


TARGETS = ("", "node", "edge", "policy_result", "metric", "observation")


def check_result(a: Analyzer, known: DataFrame, result: Result) -> DataFrame:
    """(reason): everything wrong with a result, given the ids (id) of all facts so far; it may be
    merged only if there is nothing."""
    spark = known.sparkSession
    extra = [SECTION_KIND[s] for s in result if SECTION_KIND[s] not in a.emits and not result[s].isEmpty()]
    total = spark.createDataFrame([(f"analyzer emitted undeclared fact kind {k}",) for k in extra], "reason string")
    top = M.TRUST.index(a.most_trust) + 1
    for section, df in result.items():
        if section == "diagnostics":
            tests = [(F.col("source") == "", F.lit("diagnostic missing source")), (F.col("reason") == "", F.lit("diagnostic missing reason"))]
        else:
            who = F.concat(F.lit(SECTION_KIND[section] + " "), "id")
            say = lambda *words: F.concat(who, *words)  # noqa: B023, E731
            tests = [
                (F.col("id") == "", F.lit(f"{SECTION_KIND[section]} missing id")), (F.col("kind") == "", say(F.lit(" missing kind"))), (F.col("trustLevel") == "", say(F.lit(" missing trust level"))),
                (M.trust_rank("trustLevel") > top, say(F.lit(" trust "), F.col("trustLevel"), F.lit(f" exceeds analyzer maximum {a.most_trust}"))),
            ]
            if "targetKind" in df.columns:
                tests.append((~F.col("targetKind").isin(*TARGETS), say(F.lit(" has unsupported target kind "), F.col("targetKind"))))
            if section == "observations":
                tests += [(F.col("name") == "", say(F.lit(" missing name"))), (~F.col("source").isin(*M.OBSERVATION_SOURCES), say(F.lit(" has unsupported source "), F.col("source")))]
            if section == "metrics":
                tests.append((F.col("subject") == "", say(F.lit(" missing subject"))))
            if section == "edges":
                tests.append(((F.col("from") == "") | (F.col("to") == ""), say(F.lit(" missing endpoints"))))
        wrong = F.filter(F.array(*(F.when(t, r) for t, r in tests)), lambda r: r.isNotNull())
        total = total.union(df.select(F.explode(wrong).alias("reason")))
    if any("id" in d.columns for d in result.values()):
        lost = graph.dangling(result, known)
        total = total.union(lost.select(F.concat("section", F.lit(" "), "id", F.lit(" references missing "), "role", F.lit(" "), "ref").alias("reason")))
    return total


def config_of(raw: bytes | None) -> dict:
    return json.loads(raw) if raw else {}
