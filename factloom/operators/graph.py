"""Upserts, reconciliation of placeholders, trust upgrades and union of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M


def upsert_nodes(nodes: DataFrame, order: str = "seq") -> DataFrame:
    """One row per id: the first row's values, the highest trust, the first reason that is not empty.

    ``order`` is the column that holds the order of arrival."""
    rest = [c for c in nodes.columns if c not in ("id", "trustLevel", "reason", order)]
    with_reason = F.when(F.col("reason") != "", F.col(order))
    first = nodes.groupBy("id").agg(
        F.min_by(F.struct(*rest), order).alias("row"),
        F.max(M.trust_rank("trustLevel")).alias("rank"),
        F.coalesce(F.min_by("reason", with_reason), F.lit("")).alias("reason"),
    )
    return first.select("id", *(F.col("row")[c].alias(c) for c in rest), M.trust_of(F.col("rank")).alias("trustLevel"), "reason")


def upsert_edges(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One row per id: the last row."""
    rest = [c for c in edges.columns if c not in ("id", order)]
    return edges.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("row")).select("id", *(F.col("row")[c].alias(c) for c in rest))


def reconcile(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point import and dependency edges at real nodes that turned up for their placeholders, and
    drop those placeholder nodes. A retargeted edge replaces one that had the id already."""
    real = nodes.where(~M.is_placeholder_node()).select(F.col("id").alias("real"))
    target = F.when(F.col("kind") == "imports", M.package_id(F.substring("to", len("placeholder:package:") + 1, 1 << 30)))
    target = target.when(F.col("kind") == "depends_on", M.module_id(F.substring("to", len("placeholder:module:") + 1, 1 << 30)))
    movable = ((F.col("kind") == "imports") & F.col("to").startswith("placeholder:package:")) | ((F.col("kind") == "depends_on") & F.col("to").startswith("placeholder:module:"))
    found = edges.withColumn("wanted", F.when(movable, target)).join(real, F.col("wanted") == F.col("real"), "left")
    hit = F.col("real").isNotNull()
    reason = F.when(F.col("kind") == "imports", "placeholder_reconciled_to_real_package").otherwise("placeholder_reconciled_to_real_module")
    moved = found.select(
        *(F.col(c) for c in edges.columns if c not in ("id", "to", "complete", "synthetic", "reason")),
        F.when(hit, M.edge_id(F.col("kind"), F.col("from"), F.col("real"))).otherwise(F.col("id")).alias("id"),
        F.when(hit, F.col("real")).otherwise(F.col("to")).alias("to"),
        F.when(hit, True).otherwise(F.col("complete")).alias("complete"),
        F.when(hit, False).otherwise(F.col("synthetic")).alias("synthetic"),
        F.when(hit, reason).otherwise(F.col("reason")).alias("reason"),
        hit.cast("int").alias("seq"),
    )
    known = real.where("real like 'package:%' or real like 'module:%'").select(F.regexp_replace("real", "^(package|module):", "placeholder:$1:").alias("id"))
    return nodes.join(known, "id", "left_anti"), upsert_edges(moved).select(*edges.columns)


def upgrade_trust(nodes: DataFrame, loads: DataFrame) -> DataFrame:
    """Raise package nodes by what loading showed. ``loads``: package, errors, imports (arrays).

    A package without errors is type-resolved and loses its reason; a package that a loaded one
    imports is package-loaded at least, unless it is known to have errors."""
    clean = loads.where(F.size("errors") == 0).select(M.package_id("package").alias("clean")).distinct()
    broken = loads.where(F.size("errors") > 0).select(F.col("package").alias("p"))
    used = loads.select(F.explode("imports").alias("p")).join(broken, "p", "left_anti").select(M.package_id("p").alias("used")).distinct()
    out = nodes.join(clean, nodes["id"] == F.col("clean"), "left").join(used, nodes["id"] == F.col("used"), "left")
    mine = F.col("clean").isNotNull() & ~M.is_placeholder_node()
    rank = F.when(mine, 3).when(F.col("used").isNotNull() & ~M.is_placeholder_node(), F.greatest(M.trust_rank("trustLevel"), F.lit(2))).otherwise(M.trust_rank("trustLevel"))
    return out.select(*(F.when(mine, "").otherwise(F.col("reason")).alias(c) if c == "reason" else M.trust_of(rank).alias(c) if c == "trustLevel" else F.col(c) for c in nodes.columns))


def known_ids(facts: dict[str, DataFrame]) -> DataFrame:
    """Distinct ids of all facts; a diagnostic is known as source:reason."""
    parts = [facts[s].select("id") for s in facts if "id" in facts[s].columns]
    if "diagnostics" in facts:
        parts.append(facts["diagnostics"].select(F.concat_ws(":", "source", "reason").alias("id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def references(facts: dict[str, DataFrame]) -> DataFrame:
    """(section, id, role, ref): every reference from a fact to a fact, one pass per section."""
    parts = []
    for section, df in facts.items():
        if "id" not in df.columns:
            continue
        one = lambda role, ref: F.struct(F.lit(role).alias("role"), ref.alias("ref"))
        refs = [F.when(F.col(f"`{c}`") != "", one(role, F.col(f"`{c}`"))) for c, role in (("targetId", "target"), ("from", "from"), ("to", "to"), ("affectedNodeId", "affected_node"), ("affectedEdgeId", "affected_edge")) if c in df.columns]
        if section == "metrics":
            refs.append(F.when(M.looks_like_fact(F.col("subject")), one("subject", F.col("subject"))))
        every = F.array(*refs) if refs else F.array().cast("array<struct<role:string,ref:string>>")
        if "evidence" in df.columns:
            every = F.concat(every, F.transform("evidence", lambda e: F.when(M.looks_like_fact(e), F.struct(F.lit("evidence").alias("role"), e.alias("ref")))))
        found = df.select(F.lit(section).alias("section"), "id", F.explode(F.filter(every, lambda r: r.isNotNull())).alias("r"))
        parts.append(found.select("section", "id", "r.role", "r.ref"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def dangling(facts: dict[str, DataFrame], known: DataFrame | None = None) -> DataFrame:
    """References to facts that do not exist, neither among ``facts`` nor ``known`` (id)."""
    ids = known_ids(facts) if known is None else known.union(known_ids(facts))
    return references(facts).join(ids.withColumnRenamed("id", "ref"), "ref", "left_anti").select("section", "id", "role", "ref")
