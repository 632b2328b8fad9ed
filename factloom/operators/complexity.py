"""Complexity metrics from decision rows, and query roll-ups over metrics and policy results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions.scalars import proof_status


@dataclass(frozen=True)
class Definition:
    name: str
    unit: str
    scope: str
    rules: tuple[str, ...]
    limits: tuple[str, ...]


CYCLOMATIC, DECISIONS, MARKERS = "cyclomatic_complexity", "decision_count", "runtime_marker_count"
DEFINITIONS = (
    Definition(CYCLOMATIC, "count", "function", ("one, and one more for each decision",), ("syntax only",)),
    Definition(DECISIONS, "count", "function", ("if, for, range, case, boolean operator",), ("syntax only",)),
    Definition(MARKERS, "count", "function", ("go, defer, send, receive",), ("select is not counted",)),
)


@dataclass(frozen=True)
class Counting:
    """What counts as a decision; ``decisions`` rows have a kind that these switch on or off."""

    threshold: int = 10
    boolean: bool = True
    switch_default: bool = True
    select_default: bool = True
    goto: bool = False

    @staticmethod
    def of(config: dict) -> Counting:
        c, base = (config or {}).get("cyclomatic") or {}, Counting()
        pick = lambda key, default: default if c.get(key) is None else bool(c[key])
        top = c.get("warningThreshold") or 0
        return Counting(
            top if top > 0 else base.threshold, pick("countBooleanOperators", base.boolean), pick("countSwitchDefaultClauses", base.switch_default),
            pick("countSelectDefaultClauses", base.select_default), pick("countGotoStatements", base.goto),
        )

    def kinds(self) -> list[str]:
        out = ["if", "for", "range", "case", "select_case"]
        for on, kind in ((self.boolean, "boolean"), (self.switch_default, "switch_default"), (self.select_default, "select_default"), (self.goto, "goto")):
            out += [kind] * on
        return out


MARKER_KINDS = ("go", "defer", "send", "receive")


def counts(decisions: DataFrame, counting: Counting) -> DataFrame:
    """(sourceFile, functionId, decisions, markers) from rows (sourceFile, functionId, kind)."""
    return decisions.groupBy("sourceFile", "functionId").agg(
        F.count_if(F.col("kind").isin(*counting.kinds())).alias("decisions"), F.count_if(F.col("kind").isin(*MARKER_KINDS)).alias("markers")
    )


def metrics(nodes: DataFrame, decisions: DataFrame, parsed: DataFrame | None, counting: Counting, config_hash: str = "") -> dict[str, DataFrame]:
    """Three metrics per function or method, a diagnostic per one over the threshold, and, where
    ``parsed`` (sourceFile) says which files could be read, an error for each that could not."""
    functions = nodes.where(F.col("kind").isin("function", "method") & (F.col("packagePath") != "") & (F.col("sourceFile") != ""))
    errors = None
    if parsed is not None:
        lost = functions.join(parsed.select("sourceFile").distinct(), "sourceFile", "left_anti").select("sourceFile").distinct()
        functions = functions.join(parsed.select("sourceFile").distinct(), "sourceFile", "left_semi")
        errors = lost.select(
            F.lit("error").alias("level"), F.col("sourceFile").alias("source"), F.lit("syntax snapshot missing for complexity analysis").alias("reason"), F.lit("complexity_metrics").alias("stage"), F.lit("complexity").alias("analyzerId"),
            F.lit("analysis_error").alias("status"), F.lit("").alias("nodeId"), "sourceFile", F.lit("").alias("lineRange"), F.lit("syntax_observed").alias("trustLevel"), F.array().cast("array<string>").alias("evidence"),
        )
    c = counts(decisions, counting).withColumnsRenamed({"sourceFile": "_file", "functionId": "_id"})
    rows = functions.join(c, (F.col("sourceFile") == F.col("_file")) & (F.col("id") == F.col("_id")), "left").fillna(0, ["decisions", "markers"])
    top = F.lit(counting.threshold).cast("bigint")
    number = lambda c: c.cast("string")
    value = F.col("decisions") + 1
    over = value > top
    three = F.array(
        F.struct(F.lit(CYCLOMATIC).alias("name"), value.alias("value"), F.when(over, "warning").otherwise("pass").alias("status"), top.alias("threshold"),
                 F.concat(F.lit("cyclomatic complexity "), number(value), F.when(over, " exceeds").otherwise(" is within"), F.lit(" threshold "), number(top)).alias("reason")),
        F.struct(F.lit(DECISIONS).alias("name"), F.col("decisions").alias("value"), F.lit("pass").alias("status"), F.lit(0).cast("bigint").alias("threshold"), F.concat(F.lit("decision count "), number(F.col("decisions"))).alias("reason")),
        F.struct(F.lit(MARKERS).alias("name"), F.col("markers").alias("value"), F.lit("pass").alias("status"), F.lit(0).cast("bigint").alias("threshold"), F.concat(F.lit("runtime marker count "), number(F.col("markers"))).alias("reason")),
    )
    out = rows.select("id", "packagePath", "sourceFile", "lineRange", F.explode(three).alias("m")).select(
        F.concat_ws(":", F.lit("metric"), "m.name", "id").alias("id"), F.lit("metric").alias("kind"), "m.name", "m.value", F.lit("count").alias("unit"), F.col("packagePath").alias("scope"), F.col("id").alias("subject"),
        F.lit("complexity").alias("analyzerId"), F.lit("complexity_metrics").alias("stage"), "m.status", "m.threshold", "m.reason", F.array("id").alias("evidence"), F.lit("syntax_observed").alias("trustLevel"),
        F.lit(config_hash).alias("configurationHash"), "sourceFile", "lineRange",
    )
    found = out.where("status = 'warning'").select(
        F.lit("warning").alias("level"), F.concat(F.lit("metric:"), "scope").alias("source"), "reason", "stage", "analyzerId", "status", F.col("subject").alias("nodeId"), "sourceFile", "lineRange", "trustLevel", F.array("id").alias("evidence"),
    )
    return {"metrics": out, "diagnostics": found if errors is None else found.unionByName(errors)}


# ---- roll-ups -----------------------------------------------------------------------------


def policy_queries(results: DataFrame) -> DataFrame:
    """One query per scope: fail before unknown before pass."""
    severity = F.when(F.col("status") == "fail", 2).when(F.col("status") == "unknown", 1).otherwise(0)
    per = results.where("scope <> ''").groupBy("scope").agg(F.max(severity).alias("worst"), F.min(M.trust_rank("trustLevel")).alias("rank"), F.array_sort(F.collect_list("id")).alias("evidence"))
    pick = lambda a, b, c: F.when(F.col("worst") == 2, a).when(F.col("worst") == 1, b).otherwise(c)
    status = pick("fail", "unknown", "pass")
    return per.select(
        F.concat(F.lit("query:policy:"), "scope").alias("id"), status.alias("status"), F.lit("package dependency policy").alias("query"),
        pick("policy_result_failed", "policy_result_unknown", "all_policy_results_passed").alias("reason"), "scope", F.lit("syntax_observed").alias("requiredTrustLevel"),
        M.trust_of(F.least("rank", F.lit(2))).alias("actualTrustLevel"), proof_status(status).alias("proofStatus"), "evidence",
    )


def complexity_queries(nodes: DataFrame, metrics: DataFrame, edges: DataFrame, diagnostics: DataFrame, mode: str, complexity_ran: bool = True) -> DataFrame:
    """One query per package scope or, with mode "domain", per importing package together with
    the packages it imports. Missing evidence makes a query unknown, whatever the metrics say."""
    m = metrics.where(f"name = '{CYCLOMATIC}' and scope <> ''")
    imports = edges.where((F.col("kind") == "imports") & F.col("from").startswith("package:"))
    if mode == "package":
        functions = nodes.where(F.col("kind").isin("function", "method") & (F.col("packagePath") != ""))
        scopes = functions.select(F.col("packagePath").alias("scope")).union(m.select("scope")).distinct()
        members = scopes.select("scope", F.col("scope").alias("member"))
    else:
        scopes = imports.select(M.strip("from", "package:").alias("scope")).where("scope <> ''").distinct()
        near = imports.where(F.col("to").startswith("package:")).select(M.strip("from", "package:").alias("scope"), M.strip("to", "package:").alias("member"))
        members = scopes.select("scope", F.col("scope").alias("member")).union(near.where("scope <> ''")).distinct()
    held = members.join(m.select(F.col("scope").alias("member"), "id", "subject", "status", M.trust_rank("trustLevel").alias("rank")), "member")
    base = held.groupBy("scope").agg(F.max((F.col("status") == "warning").cast("int")).alias("warned"), F.min("rank").alias("rank"), F.array_sort(F.collect_list("id")).alias("held"))
    out = scopes.join(base, "scope", "left")
    if complexity_ran:
        functions = nodes.where(F.col("kind").isin("function", "method")).join(m.select(F.col("subject").alias("id")), "id", "left_anti")
        gaps = [members.join(functions.select(F.col("packagePath").alias("member"), "id"), "member").select("scope", F.concat(F.lit("missing_complexity_metric:"), "id").alias("gap"))]
        broken = diagnostics.where("stage = 'complexity_metrics' and status = 'analysis_error' and sourceFile <> ''").select("sourceFile")
        files = nodes.where("sourceFile <> ''").select(F.col("packagePath").alias("member"), "sourceFile").distinct()
        gaps.append(members.join(files, "member").select("scope", "sourceFile").distinct().join(broken, "sourceFile").select("scope", F.concat(F.lit("complexity_analysis_error:"), "sourceFile").alias("gap")))
        if mode == "domain":
            e = imports.select(M.strip("from", "package:").alias("scope"), "id", "to", M.is_incomplete_edge().alias("open"))
            gaps.append(e.where("open").select("scope", F.concat(F.lit("incomplete_import_scope:"), "id").alias("gap")))
            gone = e.where("not open").join(nodes.select(F.col("id").alias("to")), "to", "left_anti")
            gaps.append(gone.select("scope", F.concat(F.lit("unresolved_import_scope:"), "to").alias("gap")))
        all_gaps = reduce(DataFrame.unionByName, gaps).groupBy("scope").agg(F.array_sort(F.collect_list("gap")).alias("gaps"))
        out = out.join(all_gaps, "scope", "left")
    else:
        out = out.withColumn("gaps", F.lit(None).cast("array<string>"))
    gap, none = F.col("gaps").isNotNull(), F.col("held").isNull()
    status = F.when(gap | none, "unknown").when(F.col("warned") == 1, "warning").otherwise("pass")
    reason = F.when(gap, "complexity_analysis_incomplete").when(none, "no_complexity_metrics_for_scope").when(F.col("warned") == 1, "complexity_metric_warning").otherwise("all_complexity_metrics_passed")
    nothing = F.array().cast("array<string>")
    evidence = F.when(~gap & none, F.array(F.lit("complexity_metrics_missing_for_scope"))).otherwise(F.concat(F.coalesce("held", nothing), F.coalesce("gaps", nothing)))
    return out.select(
        F.concat(F.lit(f"query:complexity:{mode}:"), "scope").alias("id"), status.alias("status"), F.lit(f"cyclomatic complexity {mode} threshold").alias("query"), reason.alias("reason"), "scope",
        F.lit("syntax_observed").alias("requiredTrustLevel"), M.trust_of(F.least(F.coalesce("rank", F.lit(1)), F.lit(1))).alias("actualTrustLevel"), proof_status(status).alias("proofStatus"), evidence.alias("evidence"),
    )
