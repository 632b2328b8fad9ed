"""Exploration queries: search, layout, containment, matches by name, evidence, incident edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import model as M
from ..functions.scalars import line_range
from ..plans.tables import keep


def _holding(nodes: DataFrame, fields: tuple[str, ...], text: str) -> DataFrame:
    """Nodes whose fields, joined, hold ``text``, case aside."""
    text = text.strip().lower()
    whole = F.lower(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in fields)))
    return nodes.where(F.contains(whole, F.lit(text))) if text else nodes


def search(nodes: DataFrame, text: str = "", kind: str = "") -> DataFrame:
    """Nodes whose id, name, paths, reason or file hold ``text``, case aside; at most of one kind."""
    found = _holding(nodes, ("id", "name", "packagePath", "modulePath", "reason", "sourceFile"), text)
    return found.where(F.col("kind") == kind) if kind else found


def code_scope(nodes: DataFrame, package: str = "", text: str = "") -> DataFrame:
    """Functions, methods and open calls with a source, of one package at most, as the source list shows them."""
    found = nodes.where(F.col("kind").isin("function", "method", "unresolved_call") & (F.col("sourceFile") != ""))
    found = _holding(found, ("id", "name", "packagePath", "sourceFile"), text)
    return found.where(F.col("packagePath") == package) if package else found


def in_source_order(nodes: DataFrame) -> DataFrame:
    """Nodes by file, range and id as one string."""
    return nodes.orderBy(F.concat("sourceFile", "lineRange", "id"))


def listed(nodes: DataFrame, limit: int = 120) -> DataFrame:
    """The first nodes by id, which is all that the list shows."""
    return nodes.orderBy("id").limit(limit)


def with_status(facts: DataFrame, status: str = "") -> DataFrame:
    """Policy results or metrics of one status, or all of them."""
    return facts.where(F.col("status") == status) if status else facts


def selection(results: DataFrame) -> DataFrame:
    """(id, selected): the fact that is selected with a policy result: its first evidence, else itself."""
    return results.select("id", F.when(F.size("evidence") > 0, F.element_at("evidence", 1)).otherwise(F.col("id")).alias("selected"))


def touched(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """(selected, edgeId): edges at a selected node, the selected fact itself left out."""
    return incident(edges, selected.select(F.col("selected").alias("id")).distinct()).where("id <> edgeId").select(F.col("id").alias("selected"), "edgeId")


def choices(nodes: DataFrame) -> DataFrame:
    """(control, value): what the lists of kinds and packages offer."""
    one = lambda c: nodes.where(F.col(c) != "").select(F.lit(c).alias("control"), F.col(c).alias("value"))
    return one("kind").union(one("packagePath")).distinct()


def fact_index(facts: dict[str, DataFrame]) -> DataFrame:
    """(id, section, kind) of nodes, edges, policy results and metrics; a later section wins."""
    order = ("nodes", "edges", "policyResults", "metrics")
    rows = reduce(DataFrame.union, [facts[s].select("id", F.lit(i).alias("at"), F.lit(s).alias("section"), "kind") for i, s in enumerate(order) if facts.get(s) is not None])
    return rows.groupBy("id").agg(F.max_by(F.struct("section", "kind"), "at").alias("last")).select("id", "last.section", "last.kind")


def by_kind(facts: DataFrame, column: str = "kind") -> DataFrame:
    """(kind, n)."""
    return facts.groupBy(F.col(column).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, by: str, order: str) -> DataFrame:
    """``df`` with ``rank``, from 0, in the order of ``order`` among rows of equal ``by``.

    Rows are sorted over ranges, so a key with most of the rows is not ranked in one task: ranks
    within a range are added to the counts of the ranges before it."""
    cut = keep(df.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(order)) - 1
    both = cut.withColumn("_inside", inside).join(sizes, [by, "_range"])
    return both.withColumn("rank", F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def layout(nodes: DataFrame, width: int = 260, height: int = 58) -> DataFrame:
    """id, kind, x, y: a column for each kind, a row for each node in it."""
    kinds = nodes.select("kind").distinct()
    kinds = kinds.withColumn("col", F.row_number().over(Window.orderBy("kind")) - 1)
    rows = ranked(nodes.select("id", "kind"), "kind", "id")
    return rows.join(kinds, "kind").select("id", "kind", (F.lit(20) + F.col("col") * width).alias("x"), (F.lit(28) + F.col("rank") * height).alias("y"))


def contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(outerId, innerId): ranges of one file that hold other ranges of it.

    Lines are cut into strips of 64; an outer range is listed under each strip it touches and an
    inner one under the strip it starts in, so the join is an equi join of narrow keys."""
    r = lambda df, p: df.select(F.col("id").alias(f"{p}Id"), F.col("sourceFile").alias(f"{p}File"), line_range("lineRange").alias(p)).where(F.col(p).isNotNull() & (F.col(f"{p}File") != ""))
    strip = lambda c: F.floor(c / 64).cast("int")
    a = r(outer, "outer").withColumn("strip", F.explode(F.sequence(strip(F.col("outer.startLine")), F.greatest(strip(F.col("outer.startLine")), strip(F.col("outer.endLine"))))))
    b = r(inner, "inner").withColumn("at", strip(F.col("inner.startLine")))
    both = a.join(b, (F.col("outerFile") == F.col("innerFile")) & (F.col("strip") == F.col("at")))
    return both.where("outer.startLine <= inner.startLine and outer.endLine >= inner.endLine and outerId <> innerId").select("outerId", "innerId")


def name_matches(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(callId, functionId): functions whose name is the last part of a dotted callee."""
    c = calls.where(F.col("name").contains(".")).select(F.col("id").alias("callId"), F.substring_index("name", ".", -1).alias("short"))
    f = functions.where("name <> ''").select(F.col("id").alias("functionId"), F.col("name").alias("short"))
    return c.join(f, "short").select("callId", "functionId")


def evidence_of(facts: DataFrame, known: DataFrame) -> DataFrame:
    """(id, ref, kind): the evidence of policy results or metrics that is a node or edge."""
    return facts.select("id", F.explode("evidence").alias("ref")).join(known.select(F.col("id").alias("ref"), "kind"), "ref").select("id", "ref", "kind")


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, edgeId): edges that begin or end at the facts ``ids``; two equi joins, no OR."""
    one = lambda end: edges.select(F.col(end).alias("id"), F.col("id").alias("edgeId")).join(ids.select("id"), "id")
    return one("from").union(one("to")).distinct()


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    seen = nodes.select("id")
    return edges.join(seen.withColumnRenamed("id", "from"), "from", "left_semi").join(seen.withColumnRenamed("id", "to"), "to", "left_semi")


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Ids one edge away from ``start``, and those of ``start``."""
    s = start.select("id")
    out = edges.join(s.withColumnRenamed("id", "from"), "from", "left_semi").select(F.col("to").alias("id"))
    back = edges.join(s.withColumnRenamed("id", "to"), "to", "left_semi").select(F.col("from").alias("id"))
    return s.union(out).union(back).distinct()


def tiles(facts: dict[str, DataFrame]) -> DataFrame:
    """(tile, n): sizes of sections and what deserves a look."""
    counts = {s: (s, None) for s in ("nodes", "edges", "queries", "policyResults", "metrics", "diagnostics")}
    counts |= {"placeholders": ("nodes", M.is_placeholder_node()), "incompleteEdges": ("edges", M.is_incomplete_edge()), "metricWarnings": ("metrics", F.col("status") == "warning")}
    parts = []
    for name, (section, test) in counts.items():
        df = facts[section] if test is None else facts[section].where(test)
        parts.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tile"), "n"))
    return reduce(DataFrame.union, parts)


def _said(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def feed(facts: dict[str, DataFrame]) -> DataFrame:
    """(part, title, text, id) of seven sections one after the other; id is "" where nothing is selected."""
    c, none = F.col, F.lit("")
    rows = {
        "queries": (_said("Query: ", c("status")), _said(c("query"), " / ", c("reason")), none),
        "pathJobs": (_said("Path: ", c("status")), c("blockingReason"), none),
        "policyResults": (_said("Policy: ", c("status")), _said(c("ruleId"), " / ", c("subject")), c("id")),
        "metrics": (_said("Metric: ", c("status")), _said(c("name"), " = ", c("value").cast("string"), " ", c("unit"), " / ", c("subject")), c("id")),
        "freshness": (_said("Freshness: ", c("status")), c("sourceFile"), none),
        "diagnostics": (_said("Diagnostic: ", c("level")), c("reason"), none),
        "runs": (_said("Run: ", c("stage"), " / ", c("status")), _said(c("emittedFacts").cast("string"), " emitted facts"), none),
    }
    parts = [
        M.conform(facts[s], s).select(F.lit(i).alias("part"), title.alias("title"), text.alias("text"), ident.alias("id"))
        for i, (s, (title, text, ident)) in enumerate(rows.items())
        if facts.get(s) is not None
    ]
    return reduce(DataFrame.union, parts)


def related(candidates: DataFrame, limit: int = 8) -> DataFrame:
    """The first rows by id, each id once."""
    return candidates.dropDuplicates(["id"]).orderBy("id").limit(limit)


def source_block(files: DataFrame, source_file: str, ranges: str) -> DataFrame:
    """(sourceFile, block): the lines of a range, numbered; ``files`` has sourceFile and content."""
    f = files.where(F.col("sourceFile") == source_file).withColumn("r", line_range(F.lit(ranges)))
    lines = f.select("sourceFile", "r", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("i", "line"))
    lines = lines.where("i + 1 between r.startLine and r.endLine")
    text = F.concat(F.lpad((F.col("i") + 1).cast("string"), 4, " "), F.lit("  "), "line")
    return lines.groupBy("sourceFile").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda x: x["t"]), "\n").alias("block"))
