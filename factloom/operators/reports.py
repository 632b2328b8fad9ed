"""Compact reports: stats with scopes, language zones, problems, filtered graph, value catalogue."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions.scalars import dirname, first_non_empty, split_list, whole_number

NOWHERE = "(unknown)"
NESTED = "single module scan: additional go.mod files were discovered under the project root but not indexed; pass --workspace-root to analyze a multi-module workspace"


@dataclass(frozen=True)
class Options:
    """Scope (module before package before file) and the number of items per list."""

    module: str = ""
    package: str = ""
    file: str = ""
    limit: int = 50

    def clean(self) -> Options:
        return Options(self.module.strip(), self.package.strip(), self.file.strip(), max(1, self.limit))


class Scope:
    """Which facts a report covers; package and node dimensions come from the unscoped nodes."""

    def __init__(self, facts: dict[str, DataFrame], options: Options) -> None:
        self.facts, self.o = facts, options.clean()
        nodes = facts["nodes"]
        known = nodes.where("packagePath <> '' and modulePath <> ''")
        self.packages = known.groupBy("packagePath").agg(F.min_by("modulePath", "id").alias("modulePath"))
        self.owners = nodes.where("modulePath <> ''").groupBy("id").agg(F.max("modulePath").alias("modulePath"))

    def with_module(self, df: DataFrame, path: Column, name: str) -> DataFrame:
        """``df`` with the module of a package path ("" if not known) as ``name``."""
        dim = self.packages.select(F.col("packagePath").alias("_p"), F.col("modulePath").alias("_m"))
        return df.withColumn("_k", path).join(dim, F.col("_k") == F.col("_p"), "left").withColumn(name, M.text("_m")).drop("_k", "_p", "_m")

    def with_owner(self, df: DataFrame, ref: Column, name: str) -> DataFrame:
        """The module of a fact id: its own path, else its node's, else its package's."""
        dim = self.owners.select(F.col("id").alias("_i"), F.col("modulePath").alias("_m"))
        df = df.withColumn("_r", ref).join(dim, F.col("_r") == F.col("_i"), "left").withColumn("_n", M.text("_m")).drop("_i", "_m")
        df = self.with_module(df, M.strip("_r", "package:", "placeholder:package:"), "_q")
        own = M.strip("_r", "module:", "placeholder:module:")
        return df.withColumn(name, first_non_empty(own, "_n", "_q")).drop("_r", "_n", "_q")

    def nodes(self) -> DataFrame:
        n, o = self.facts["nodes"], self.o
        if o.module:
            return n.where(F.col("modulePath") == o.module)
        if o.package:
            return n.where(F.col("packagePath") == o.package)
        return n.where(F.col("sourceFile") == o.file) if o.file else n

    def edges(self) -> DataFrame:
        e, o = self.facts["edges"], self.o
        if o.module:
            names = e.columns
            e = self.with_owner(self.with_owner(e, F.col("from"), "_a"), F.col("to"), "_b")
            return e.where((F.col("_a") == o.module) | (F.col("_b") == o.module)).select(*names)
        if o.package:
            path = lambda c: M.strip(c, "package:", "placeholder:package:")
            return e.where((path("from") == o.package) | (path("to") == o.package))
        return e.where(F.col("sourceFile") == o.file) if o.file else e

    def observations(self) -> DataFrame:
        x, o = self.facts["observations"], self.o
        if o.module:
            names = x.columns
            for k in ("packagePath", "fromPackagePath", "toPackagePath"):
                x = self.with_module(x, M.attribute(k), f"_{k}")
            for k in ("from", "to"):
                x = self.with_owner(x, M.attribute(k), f"_{k}")
            x = self.with_owner(x, F.col("targetId"), "_target")
            hit = reduce(lambda a, b: a | b, [F.col(c) == o.module for c in ("_packagePath", "_fromPackagePath", "_toPackagePath", "_from", "_to", "_target")])
            return x.where(hit | (M.attribute("modulePath") == o.module)).select(*names)
        if o.package:
            p = "package:" + o.package
            equal = reduce(lambda a, b: a | b, [M.attribute(k) == o.package for k in ("packagePath", "fromPackagePath", "toPackagePath")])
            inside = reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for c in (F.col("targetId"), M.attribute("from"), M.attribute("to"))])
            return x.where(equal | inside)
        return x.where(F.col("sourceFile") == o.file) if o.file else x


def _hits(df: DataFrame, key: Column, **counters: Column) -> DataFrame:
    """(key, one 0/1 column per counter), rows of one shape for later sums."""
    return df.select(key.alias("key"), *(c.cast("int").alias(n) for n, c in counters.items()))


def _sum(parts: list[DataFrame], counters: tuple[str, ...]) -> DataFrame:
    """Counters summed by key over all parts: one shuffle whatever the number of parts."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    key = F.when(F.col("key") == "", NOWHERE).otherwise(F.col("key"))
    return rows.groupBy(key.alias("key")).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counters))


SUMMARY = {"modules": "module", "packages": "package", "files": "file", "functions": "function", "methods": "method", "types": "type", "structs": "struct", "interfaces": "interface", "fields": "field", "imports": "import"}


def summary(scope: Scope) -> DataFrame:
    """One row of fourteen counts."""
    ghost = M.is_placeholder_node()
    real = lambda k: (F.col("kind") == k) & (~ghost if k in ("module", "package") else F.lit(True))
    n = scope.nodes().agg(*(F.count_if(real(k)).alias(c) for c, k in SUMMARY.items()), F.count_if(ghost).alias("placeholders"))
    e = scope.edges().agg(F.count(F.lit(1)).alias("edges"), F.count_if(M.is_incomplete_edge()).alias("incompleteEdges"))
    o = scope.observations().agg(F.count(F.lit(1)).alias("observations"))
    return n.join(e).join(o).select(*SUMMARY, "edges", "observations", "placeholders", "incompleteEdges")


def _edge_facts(scope: Scope) -> DataFrame:
    path = lambda c: M.strip(c, "package:", "placeholder:package:")
    e = scope.edges().where("kind = 'imports'").withColumn("fp", path("from")).withColumn("tp", path("to")).withColumn("open", M.is_incomplete_edge())
    return scope.with_module(scope.with_module(e, F.col("fp"), "fm"), F.col("tp"), "tm")


def _observation_facts(scope: Scope) -> DataFrame:
    pkg = first_non_empty(M.attribute("packagePath"), M.attribute("fromPackagePath"), M.strip(M.attribute("from"), "package:", "placeholder:package:"), M.strip("targetId", "package:", "placeholder:package:"))
    o = scope.observations().withColumn("pkg", pkg).withColumn("ofp", M.attribute("fromPackagePath")).withColumn("otp", M.attribute("toPackagePath"))
    for c, name in (("pkg", "pm"), ("ofp", "fm"), ("otp", "tm")):
        o = scope.with_module(o, F.col(c), name)
    return o


MODULE_COUNTS = ("packages", "files", "imports", "incompleteImports", "dependsOn", "dependedOnBy", "externalDependencies", "missingDependencies", "crossModuleImportsOut", "crossModuleImportsIn", "observations", "candidates", "bridgesIn", "bridgesOut")
PACKAGE_COUNTS = ("files", "functions", "methods", "types", "structs", "interfaces", "imports", "incompleteImports", "observations", "candidates", "bridgesIn", "bridgesOut")
FILE_COUNTS = ("functions", "methods", "types", "structs", "interfaces", "observations")


def module_stats(scope: Scope) -> DataFrame:
    n, e, o = scope.nodes(), _edge_facts(scope), _observation_facts(scope)
    real = ~M.is_placeholder_node()
    kind = lambda k: F.col("kind") == k
    one = F.lit(1)
    path = lambda c: M.strip(c, "module:", "placeholder:module:")
    d = scope.edges().where(kind("depends_on")).withColumn("fm", path("from")).withColumn("tm", path("to")).withColumn("ghost", F.col("to").startswith("placeholder:")).where("fm <> ''")
    across, linked = F.expr("fm <> '' and tm <> '' and fm <> tm"), F.expr("not ghost and tm <> '' and fm <> tm")
    bridge = o.where(F.col("name") == M.BRIDGE)
    parts = [
        _hits(n.where((kind("module") & real) | (kind("package") & real) | kind("file") | kind("import")), F.col("modulePath"), packages=kind("package"), files=kind("file"), imports=kind("import")),
        _hits(d.where("ghost"), F.col("fm"), missingDependencies=one),
        _hits(d.where(linked), F.col("fm"), dependsOn=one),
        _hits(d.where(linked), F.col("tm"), dependedOnBy=one),
        _hits(e.where("open and fm <> ''"), F.col("fm"), incompleteImports=one, externalDependencies=F.col("to").startswith("placeholder:") & (F.col("tm") == "")),
        _hits(e.where(across), F.col("fm"), crossModuleImportsOut=one),
        _hits(e.where(across), F.col("tm"), crossModuleImportsIn=one),
        _hits(o.where("pkg <> '' and pm <> ''"), F.col("pm"), observations=one, candidates=F.col("name") == M.CANDIDATE),
        _hits(bridge.where("fm <> ''"), F.col("fm"), bridgesOut=one),
        _hits(bridge.where("tm <> ''"), F.col("tm"), bridgesIn=one),
    ]
    counted = _sum(parts, MODULE_COUNTS)
    named = n.where(kind("module") & real)
    file = named.where("sourceFile <> ''").groupBy(F.col("modulePath").alias("key")).agg(F.min_by("sourceFile", "id").alias("sourceFile"))
    found = discovery(scope.facts).join(named.select("modulePath").distinct(), "modulePath", "left_semi").withColumnRenamed("modulePath", "key")
    out = counted.join(file, "key", "left").join(found, "key", "left")
    return out.select(F.col("key").alias("modulePath"), M.text("dir").alias("dir"), M.text("sourceFile").alias("sourceFile"), F.coalesce("reasons", F.array().cast("array<string>")).alias("discoveryReasons"), *MODULE_COUNTS)


def package_stats(scope: Scope) -> DataFrame:
    n, e, o = scope.nodes(), _edge_facts(scope), _observation_facts(scope)
    kind = lambda k: F.col("kind") == k
    one, bridge = F.lit(1), o.where(F.col("name") == M.BRIDGE)
    counted = n.where((kind("package") & ~M.is_placeholder_node()) | F.col("kind").isin("file", "function", "method", "type", "struct", "interface", "import"))
    parts = [
        _hits(counted, F.col("packagePath"), files=kind("file"), functions=kind("function"), methods=kind("method"), types=kind("type"), structs=kind("struct"), interfaces=kind("interface"), imports=kind("import")),
        _hits(e.where("open and fp <> ''"), F.col("fp"), incompleteImports=one),
        _hits(o.where("pkg <> ''"), F.col("pkg"), observations=one, candidates=F.col("name") == M.CANDIDATE),
        _hits(bridge.where("ofp <> ''"), F.col("ofp"), bridgesOut=one),
        _hits(bridge.where("otp <> ''"), F.col("otp"), bridgesIn=one),
    ]
    module = n.where(((kind("package") & ~M.is_placeholder_node()) | kind("file")) & (F.col("modulePath") != "")).groupBy(F.col("packagePath").alias("key")).agg(F.min_by("modulePath", "id").alias("modulePath"))
    out = _sum(parts, PACKAGE_COUNTS).join(module, "key", "left")
    return out.select(F.col("key").alias("packagePath"), M.text("modulePath").alias("modulePath"), *PACKAGE_COUNTS)


def file_stats(scope: Scope) -> DataFrame:
    n, o = scope.nodes(), scope.observations()
    kind = lambda k: F.col("kind") == k
    counted = n.where(F.col("kind").isin("file", "function", "method", "type", "struct", "interface"))
    parts = [
        _hits(counted, F.col("sourceFile"), functions=kind("function"), methods=kind("method"), types=kind("type"), structs=kind("struct"), interfaces=kind("interface")),
        _hits(o.where("sourceFile <> ''"), F.col("sourceFile"), observations=F.lit(1)),
    ]
    first = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("id"))), F.lit("")).alias(c)
    own = n.where(kind("file")).groupBy(F.col("sourceFile").alias("key")).agg(first("packagePath"), first("modulePath"))
    out = _sum(parts, FILE_COUNTS).join(own, "key", "left")
    return out.select(F.col("key").alias("sourceFile"), M.text("packagePath").alias("packagePath"), M.text("modulePath").alias("modulePath"), *FILE_COUNTS)


def discovery(facts: dict[str, DataFrame]) -> DataFrame:
    """(modulePath, dir, reasons) from module_discovery records, joined on the module's directory."""
    records = facts["sourceRecords"].where("kind = 'module_discovery'").select("path", F.explode_outer(split_list("reason")).alias("reason"))
    modules = facts["nodes"].where((F.col("kind") == "module") & ~M.is_placeholder_node()).groupBy(dirname("sourceFile").alias("path")).agg(F.min_by("modulePath", "id").alias("modulePath"))
    both = records.join(modules, "path").where("modulePath <> ''")
    return both.groupBy("modulePath").agg(F.min("path").alias("dir"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def workspace(facts: dict[str, DataFrame]) -> DataFrame:
    """One row about the roots, the go.mod files and whether nested modules were left out."""
    r = facts["sourceRecords"]
    last = lambda k, n: F.coalesce(F.max_by(F.when(F.col("kind") == k, F.col("path")), F.when(F.col("kind") == k, F.col("id"))), F.lit("")).alias(n)
    roots = r.agg(last("project_root", "projectRoot"), last("workspace_root", "workspaceRoot"), last("go_work", "goWorkPath"), F.array_sort(F.collect_list(F.when(F.col("kind") == "go_mod", F.col("path")))).alias("goModFiles"))
    count = facts["nodes"].agg(F.count_if((F.col("kind") == "module") & ~M.is_placeholder_node()).alias("indexedModules"))
    single = (F.col("projectRoot") != "") & (F.col("projectRoot") == F.col("workspaceRoot"))
    extra = F.size("goModFiles") - F.col("indexedModules")
    out = roots.join(count).withColumn("singleModuleScan", single)
    out = out.withColumn("ignoredNestedGoMods", F.when(single & (extra > 0), extra).otherwise(0).cast("bigint"))
    return out.withColumn("warning", F.when(F.col("ignoredNestedGoMods") > 0, NESTED).otherwise(""))


def stats(facts: dict[str, DataFrame], options: Options = Options()) -> dict[str, DataFrame]:
    scope = Scope(facts, options)
    return {
        "workspace": workspace(facts), "summary": summary(scope), "modules": module_stats(scope).orderBy("modulePath"),
        "packages": package_stats(scope).orderBy("modulePath", "packagePath"), "files": file_stats(scope).orderBy("modulePath", "packagePath", "sourceFile"),
    }


def zones(facts: dict[str, DataFrame], options: Options = Options()) -> dict[str, DataFrame]:
    """Candidates, bridges and incomplete evidence in scope, in order, without limit."""
    o = Scope(facts, options).observations()
    tail = (F.size("evidence").cast("bigint").alias("evidenceCount"), "trustLevel", F.col("id").alias("observationId"))
    at = lambda k, n=None: M.attribute(k).alias(n or k)
    number = lambda k: whole_number(M.attribute(k)).alias(k)
    c = o.where(F.col("name") == M.CANDIDATE).select(at("packagePath"), "targetId", split_list(M.attribute("terms")).alias("terms"), number("termCount"), number("cooccurrenceCount"), *tail)
    b = o.where(F.col("name") == M.BRIDGE).select(at("fromPackagePath"), at("toPackagePath"), at("edgeKind"), "targetId", *tail)
    i = o.where(F.col("name") == M.INCOMPLETE).select(at("from"), at("to"), at("edgeKind"), at("reason"), "targetId", *tail)
    return {
        "candidates": c.orderBy("packagePath", "observationId"), "bridges": b.orderBy("fromPackagePath", "toPackagePath", "edgeKind", "observationId"),
        "incompleteEvidence": i.orderBy("from", "to", "edgeKind", "observationId"),
    }


PROBLEMS = {"diagnostics": None, "policyResults": "status <> 'pass'", "metrics": "status = 'warning'", "warnings": None, "queries": "status <> 'pass'", "runs": "status <> 'completed'"}
ORDERS = {"diagnostics": ("source", "reason"), "runs": ("stage", "runId")}


def problems(facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is not in order, per section, whole and sorted."""
    return {s: (facts[s].where(test) if test else facts[s]).orderBy(*ORDERS.get(s, ("id",))) for s, test in PROBLEMS.items() if s in facts}


def limited(lists: dict[str, DataFrame], limit: int) -> tuple[dict[str, list[dict]], dict[str, int], bool]:
    """The first ``limit`` (1 at least) rows of each list, its full count, and whether any was cut."""
    limit = max(1, limit)
    counts = {k: v.count() for k, v in lists.items()}
    rows = {k: [r.asDict(True) for r in v.limit(limit).collect()] for k, v in lists.items()}
    return rows, counts, any(n > limit for n in counts.values())


# ---- filtered graph and catalogue ---------------------------------------------------------


def section_name(value: str) -> str:
    """The section that ``value`` names, whatever its case, blanks, dashes and underscores."""
    plain = value.lower().translate(str.maketrans("", "", "_- "))
    for s in M.SECTIONS:
        if s.lower() == plain:
            return s
    raise ValueError(f"unknown --json-sections value {value!r}")


FILTERS = {"node_kinds": ("nodes", "kind"), "edge_kinds": ("edges", "kind"), "observation_names": ("observations", "name")}


def filter_graph(facts: dict[str, DataFrame], sections: list[str] | None = None, **values: list[str]) -> dict[str, DataFrame | None]:
    """Chosen sections (others None), their rows filtered by kinds or names; no choice, no change."""
    chosen = {section_name(s) for s in sections} if sections else set(M.SECTIONS)
    out: dict[str, DataFrame | None] = {s: df if s in chosen else None for s, df in facts.items()}
    for option, wanted in values.items():
        section, column = FILTERS[option]
        if wanted and out.get(section) is not None:
            out[section] = out[section].where(F.col(column).isin(*wanted))
    return out


def catalogue(spark: SparkSession, analyzers: list[str]) -> DataFrame:
    """(category, value): every value that options and filters know."""
    groups = {
        "sections": M.SECTIONS, "nodeKinds": M.NODE_KINDS, "edgeKinds": M.EDGE_KINDS, "factKinds": M.FACT_KINDS, "statuses": M.STATUSES, "freshnessStatuses": M.FRESHNESS,
        "observationNames": M.OBSERVATION_NAMES, "observationSources": M.OBSERVATION_SOURCES, "trustLevels": M.TRUST, "analyzerIds": tuple(analyzers),
    }
    return spark.createDataFrame([(k, v) for k, vs in groups.items() for v in sorted(vs)], "category string, value string")
