"""Dependency policy with three outcomes, and module dependency enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M

# Advice of warnings.
ADVICE_FIX = "Update the code dependency or adjust the configured policy rule."
ADVICE_RESOLVE = "Resolve incomplete analysis evidence before treating this policy result as pass or fail."
ADVICE_MISSING = "Run go mod tidy, add the dependency, or resolve the import path."
ADVICE_OUTDATED = "Provide module metadata or enable a future metadata fetch implementation before treating this dependency as current."


def rules(spark: SparkSession, config: dict) -> DataFrame:
    """Rules as a small table (rule, kind, subject, allow, deny); of several for a subject the last."""
    found: dict[tuple[str, str], tuple] = {}
    for r in config.get("rules") or []:
        own = r.get("id") or (f"package_import:{r['package']}" if r.get("package") else f"module_dependency:{r.get('module', '')}")
        if r.get("package"):
            found["imports", r["package"]] = (own, "imports", r["package"], r.get("allow") or [], r.get("deny") or [])
        if r.get("module"):
            found["depends_on", r["module"]] = (own, "depends_on", r["module"], r.get("allowModules") or [], r.get("denyModules") or [])
    return spark.createDataFrame(list(found.values()), "rule string, ruleKind string, owner string, allow array<string>, deny array<string>")


def results(edges: DataFrame, rule_table: DataFrame, diagnostics: DataFrame | None, config_hash: str = "") -> DataFrame:
    """policyResults rows with edgeId, edgeFrom, edgeTo, edgeComplete beside. Order of the tests:
    incomplete is unknown, denied fails, outside a list of allowed ones fails, else pass."""
    imports = F.col("kind") == "imports"
    e = edges.where(F.col("kind").isin("imports", "depends_on"))
    e = e.withColumn("scope", F.when(imports, M.strip("from", "package:")).otherwise(M.strip("from", "module:")))
    e = e.withColumn("subject", F.when(imports, M.strip("to", "package:", "placeholder:package:")).otherwise(M.strip("to", "module:", "placeholder:module:")))
    e = e.where("subject <> ''").join(rule_table, (F.col("kind") == F.col("ruleKind")) & (F.col("scope") == F.col("owner")))
    denied = F.array_contains("deny", F.col("subject"))
    outside = (F.size("allow") > 0) & ~F.array_contains("allow", F.col("subject"))
    status = F.when(M.is_incomplete_edge(), "unknown").when(denied | outside, "fail").otherwise("pass")
    say = lambda a, b: F.when(imports, a).otherwise(b)
    reason = (
        F.when(M.is_incomplete_edge(), F.concat(say("import target incomplete for ", "module dependency target incomplete for "), "subject"))
        .when(denied, F.concat("scope", say(" imports denied package ", " depends on denied module "), "subject"))
        .when(outside, F.concat("scope", say(" imports package outside allow list ", " depends on module outside allow list "), "subject"))
        .otherwise(F.concat("scope", say(" import allowed for ", " module dependency allowed for "), "subject"))
    )
    own = F.lit("dependency_policy").alias("analyzerId"), F.lit("policy_evaluation").alias("stage"), F.lit(config_hash).alias("configurationHash"), F.lit("policy_result").alias("kind")
    out = e.select(
        F.concat_ws(":", F.lit("policy_result"), "rule", "id").alias("id"), F.col("rule").alias("ruleId"), status.alias("status"), "scope", "subject", reason.alias("reason"), F.array("id").alias("evidence"),
        "trustLevel", "sourceFile", "lineRange", *own, F.col("id").alias("edgeId"), F.col("from").alias("edgeFrom"), F.col("to").alias("edgeTo"), F.col("complete").alias("edgeComplete"),
    )
    if diagnostics is None:
        return out
    d = diagnostics.where(F.col("status").isin("missing_dependency", "import_cycle"))
    cycle, mark = F.col("status") == "import_cycle", F.concat_ws(":", "source", "reason")
    loading = d.select(
        F.concat(F.lit("policy_result:package_loading:"), "status", F.lit(":"), F.sha2(mark, 256)).alias("id"), F.concat(F.lit("package_loading:"), "status").alias("ruleId"),
        F.when(cycle, "fail").otherwise("unknown").alias("status"), F.regexp_replace("source", "^go/packages:", "").alias("scope"), F.col("source").alias("subject"),
        F.concat(F.when(cycle, "import cycle detected: ").otherwise("missing dependency: "), "reason").alias("reason"), F.array(mark).alias("evidence"), F.lit("syntax_observed").alias("trustLevel"),
        "sourceFile", "lineRange", *own, F.lit("").alias("edgeId"), F.lit("").alias("edgeFrom"), F.lit("").alias("edgeTo"), F.lit(False).alias("edgeComplete"),
    )
    return out.unionByName(loading)


def findings(found: DataFrame) -> dict[str, DataFrame]:
    """Diagnostics, warnings and violation edges of the results."""
    bad = found.where("status <> 'pass'")
    unknown = F.col("status") == "unknown"
    reason = F.concat(F.when(unknown, "policy_unknown: ").otherwise("policy_violation: "), "reason")
    diagnostics = bad.select(
        F.when(unknown, "warning").otherwise("error").alias("level"), F.concat(F.lit("policy:"), "scope").alias("source"), reason.alias("reason"), "stage", "analyzerId", "status",
        F.col("id").alias("policyResultId"), "edgeId", "sourceFile", "lineRange", "trustLevel",
    )
    warnings = bad.select(
        F.concat(F.lit("warning:"), "id").alias("id"), F.lit("policy_warning").alias("kind"), reason.alias("reason"), F.when(unknown, ADVICE_RESOLVE).otherwise(ADVICE_FIX).alias("suggestedNextAction"),
        F.col("edgeId").alias("affectedEdgeId"), F.when(F.col("edgeId") != "", F.array("id", "edgeId")).otherwise(F.array("id")).alias("evidence"), "trustLevel", "sourceFile", "lineRange", F.lit("fresh").alias("freshness"),
    )
    start = F.when(F.col("edgeFrom").startswith("package:") | F.col("edgeFrom").startswith("module:"), F.col("edgeFrom")).when(F.col("ruleId").startswith("module_dependency:"), M.module_id("scope")).otherwise(M.package_id("scope"))
    violations = found.where("status = 'fail' and edgeId <> '' and edgeTo <> ''").select(
        F.concat(F.lit("edge:violates:"), "id").alias("id"), start.alias("from"), F.col("edgeTo").alias("to"), F.lit("violates").alias("kind"), "trustLevel", F.lit(False).alias("synthetic"),
        F.col("edgeComplete").alias("complete"), "reason", "sourceFile", "lineRange",
    )
    return {"diagnostics": diagnostics, "warnings": warnings, "edges": violations}


def evaluate(edges: DataFrame, rule_table: DataFrame, diagnostics: DataFrame | None, config_hash: str = "") -> dict[str, DataFrame]:
    found = results(edges, rule_table, diagnostics, config_hash)
    return {"policyResults": found.drop("edgeId", "edgeFrom", "edgeTo", "edgeComplete"), **findings(found)}


def module_dependencies(edges: DataFrame, diagnostics: DataFrame | None, check_outdated: bool = False, network: str = "disabled") -> dict[str, DataFrame]:
    """A label per dependency edge; warnings for missing dependencies and, on request, for edges
    whose newest version cannot be known."""
    e = edges.where("kind = 'depends_on'")
    labels = e.select(
        F.concat(F.lit("label:module.dependency:"), "id").alias("id"), F.lit("label").alias("kind"), F.lit("module.dependency").alias("name"), F.lit("direct").alias("value"),
        F.col("id").alias("targetId"), F.lit("edge").alias("targetKind"), F.lit("observed").alias("source"), F.array("id").alias("evidence"), "trustLevel", F.lit("fresh").alias("freshness"),
    )
    parts = []
    if diagnostics is not None:
        mark = F.concat_ws(":", "source", "reason")
        parts.append(diagnostics.where("status = 'missing_dependency'").select(
            F.concat(F.lit("warning:missing_dependency:"), F.sha2(mark, 256)).alias("id"), F.lit("missing_dependency").alias("kind"), "reason", F.lit(ADVICE_MISSING).alias("suggestedNextAction"),
            F.lit("").alias("affectedEdgeId"), F.array(mark).alias("evidence"), F.lit("syntax_observed").alias("trustLevel"), "sourceFile", "lineRange", F.lit("fresh").alias("freshness"),
        ))
    if check_outdated:
        why = "network access is disabled" if network == "disabled" else "module metadata cache is not available"
        parts.append(e.select(
            F.concat(F.lit("warning:outdated_module:"), F.sha2("id", 256)).alias("id"), F.lit("outdated_module").alias("kind"), F.lit(f"outdated module check unknown because {why}").alias("reason"),
            F.lit(ADVICE_OUTDATED).alias("suggestedNextAction"), F.col("id").alias("affectedEdgeId"), F.array("id").alias("evidence"), "trustLevel", "sourceFile", "lineRange", F.lit("fresh").alias("freshness"),
        ))
    out = {"labels": labels}
    for p in parts:
        out["warnings"] = out["warnings"].unionByName(p) if "warnings" in out else p
    return out
