"""From a workspace to all facts: stages in order, analyzers, provenance, roll-ups, sinks."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException, ArithmeticException, NumberFormatException, PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions.scalars import classify_loading, short_hash
from ..operators import complexity, graph, reports
from ..sources import config as C
from ..sources import workspace as W
from . import analyzers as A
from .tables import keep


@dataclass
class Options:
    path: str
    workspace: str = ""
    base: str = ""
    config: str = ""
    include: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    simulate_change: bool = False


#: What an analyzer can do wrong itself; lost storage or executors are not findings about it.
OWN_FAULTS = (ValueError, TypeError, LookupError, AttributeError, ArithmeticError, AnalysisException, ArithmeticException, NumberFormatException, PythonException)
#: Partitions that grown sections are drawn together to.
PARTS = 200


def run_id(stage: str, analyzer: str, at: datetime) -> str:
    return f"run:{stage}:{analyzer}:{at:%Y%m%dT%H%M%S}.{at.microsecond:06d}000Z"


#: Fixed value: what a simulated edit adds to a file.
EDIT = "\n// simulated unsaved edit\n"


def simulated_change(files: DataFrame) -> DataFrame:
    """Freshness rows of files (sourceFile, content), as if each had an edit that is not indexed yet."""
    return files.select(
        F.concat(F.lit("file:"), "sourceFile").alias("factId"), "sourceFile", short_hash(F.col("content")).alias("oldHash"), short_hash(F.concat("content", F.lit(EDIT).cast("binary"))).alias("newHash"),
        F.lit("superseded").alias("status"), F.lit("simulated_changed_content_requires_reindex").alias("reason"), F.lit(M.EXTRACTOR).alias("extractorVersion"),
    )


class Build:
    """Facts by section, each stage's rows stamped with its run."""

    def __init__(self, spark: SparkSession, options: Options) -> None:
        self.spark, self.o = spark, options
        self.facts: dict[str, DataFrame] = {s: M.empty(spark, s) for s in M.SECTIONS}
        self.runs: list[tuple] = []
        self.notes: list[DataFrame] = []
        self.known = spark.createDataFrame([], "id string")

    def stamp(self, df: DataFrame, section: str, run: str, analyzer: str) -> DataFrame:
        """Provenance of rows that have none."""
        fresh = F.col("runId") == ""
        df = M.conform(df, section)
        values = {"producerId": analyzer, "producerVersion": "1", "createdAt": datetime.now(UTC).isoformat()}
        for c, v in values.items():
            df = df.withColumn(c, F.when(fresh, v).otherwise(F.col(c)))
        return df.withColumn("runId", F.when(fresh, run).otherwise(F.col("runId")))

    def add(self, result: dict[str, DataFrame], run: str, analyzer: str) -> int:
        n = 0
        for section, df in result.items():
            df = keep(self.stamp(df, section, run, analyzer))
            n += df.count()
            if section != "runs" and ("id" in df.columns or section == "diagnostics"):
                ident = F.concat_ws(":", "source", "reason").alias("id") if section == "diagnostics" else F.col("id")
                self.known = self.known.union(df.select(ident))
            both = self.facts[section].unionByName(df)
            if section == "edges":
                both = graph.upsert_edges(self.facts[section].withColumn("seq", F.lit(0)).unionByName(df.withColumn("seq", F.lit(1)))).select(*self.facts[section].columns)
            self.facts[section] = keep(both.coalesce(PARTS)) if len(self.runs) % 4 == 3 or section == "edges" else both
        return n

    def record(self, stage: str, analyzer: str, began: datetime, status: str, notes: DataFrame | None, n: int, config_hash: str = "") -> None:
        """``notes`` (source, reason) become the run's messages."""
        now = datetime.now(UTC).isoformat()
        run = run_id(stage, analyzer, began)
        if notes is not None:
            self.notes.append(notes.select(F.lit(run).alias("runId"), F.concat_ws(": ", "source", "reason").alias("note")))
        self.runs.append((len(self.runs), run, analyzer, "1", stage, "", config_hash, began.isoformat(), now, status, n))

    def noted(self, result: dict[str, DataFrame]) -> DataFrame | None:
        """(source, reason) of a result's diagnostics, if there are any."""
        if "diagnostics" not in result:
            return None
        notes = keep(result["diagnostics"].select("source", "reason"))
        return None if notes.isEmpty() else notes

    def stage(self, name: str, result: dict[str, DataFrame]) -> None:
        began = datetime.now(UTC)
        notes = self.noted(result)
        n = self.add(result, run_id(name, f"indexer.{name}", began), f"indexer.{name}")
        self.record(name, f"indexer.{name}", began, "completed" if notes is None else "partial", notes, n)

    def analyze(self, a: A.Analyzer, sections: dict[str, bytes], context: A.Context) -> None:
        """Contract, readiness, run, checks, merge: all of a result or nothing of it."""
        began, raw = datetime.now(UTC), sections.get(a.section)
        digest = C.hash_of(raw)
        status, result, wrong = "analysis_error", {}, None
        listed = lambda reasons: self.spark.createDataFrame([(r,) for r in reasons], "reason string")
        if bad := A.check_contract(a):
            wrong = listed(bad)
        elif (open_ := A.unready(a, self.facts)) is not None and not (open_ := keep(open_)).isEmpty():
            ids = open_.agg(F.sort_array(F.collect_list("id")).alias("evidence"))
            wrong, status = ids.select(F.concat(F.lit("analyzer requires complete input scope: "), F.array_join("evidence", ", ")).alias("reason"), "evidence"), "partial"
        else:
            try:
                context.config, context.config_hash, context.facts = A.config_of(raw), digest, self.facts
                result = {s: keep(M.conform(d, s)) for s, d in a.run(context).items()}
                found = keep(A.check_result(a, self.known, result))
                wrong = None if found.isEmpty() else found
            except OWN_FAULTS as e:  # an analyzer's failure is a finding, not the end
                wrong = listed([" ".join(str(e).split())[:500]])
        run = run_id(a.stage, a.id, began)
        if wrong is not None:
            kind = "analysis_skipped_incomplete_scope" if status == "partial" else "analysis_error"
            values = {"level": "warning" if status == "partial" else "error", "source": f"analyzer:{a.id}", "stage": a.stage, "analyzerId": a.id, "status": kind}
            wrong = wrong.withColumns({c: F.lit(v) for c, v in values.items()})
            self.add({"diagnostics": wrong}, run, a.id)
            self.record(a.stage, a.id, began, status, wrong, 0, digest)
            return
        n = self.add(result, run, a.id)
        notes = self.noted(result)
        self.record(a.stage, a.id, began, "completed" if notes is None else "partial", notes, n, digest)

    def ran(self) -> DataFrame:
        """The runs so far, in order, with their messages."""
        names = "seq int, runId string, analyzerId string, analyzerVersion string, stage string, inputGraphVersion string, configurationHash string, startedAt string, finishedAt string, status string, emittedFacts bigint"
        runs = self.spark.createDataFrame(self.runs, names)
        notes = reduce(DataFrame.union, self.notes, self.spark.createDataFrame([], "runId string, note string"))
        notes = notes.groupBy("runId").agg(F.sort_array(F.collect_list("note")).alias("diagnostics"))
        every = runs.join(notes, "runId", "left").withColumn("diagnostics", F.coalesce("diagnostics", F.array().cast("array<string>")))
        return keep(every.coalesce(1).sortWithinPartitions("seq").select(*M.schema("runs").names))

    def run(self, loads: DataFrame | None = None) -> dict[str, DataFrame]:
        """``loads`` (package, errors, imports) is what a Go loader found; without it structure decides."""
        spark, o = self.spark, self.o
        p = W.resolve(o.path, o.workspace, o.base)
        cfg = C.path_of(p.root, o.config)
        sections = C.load(cfg)
        base = W.base_facts(spark, p, cfg)
        rows = base["rows"]
        nodes = keep(graph.upsert_nodes(base["nodes"]))
        edges = keep(graph.upsert_edges(base["edges"]))
        self.stage("source_discovery", {"sourceRecords": base["sourceRecords"].where("kind <> 'module_discovery'"), "freshness": base["freshness"].where("not factId like 'source_record:module_discovery:%'")})
        self.stage("module_extraction", {"sourceRecords": base["sourceRecords"].where("kind = 'module_discovery'"), "freshness": base["freshness"].where("factId like 'source_record:module_discovery:%'"), "diagnostics": base["diagnostics"].where("level = 'warning'")})
        self.stage("syntax_extraction", {"diagnostics": base["diagnostics"].where("level = 'error'")})
        nodes, edges = map(keep, graph.reconcile(nodes, edges))
        entry = W.manifest((p.root / "go.mod").read_text()).module
        loads = W.structural_loads(nodes, edges, entry) if loads is None else loads
        errors = loads.select(F.concat(F.lit("go/packages:"), "package").alias("source"), F.explode("errors").alias("reason")).withColumn("status", classify_loading(F.col("reason")))
        errors = errors.select(F.when(F.col("status") == "import_cycle", "error").otherwise("warning").alias("level"), "source", "reason", "status", F.lit("package_loading").alias("stage"), F.lit("indexer.package_loading").alias("analyzerId"))
        self.stage("base_graph_assembly", {"nodes": graph.upgrade_trust(nodes, loads), "edges": edges})
        self.stage("package_loading", {"diagnostics": errors})
        context = A.Context(spark, self.facts, {}, "", rows.where("what = 'decision'").select("sourceFile", F.col("id").alias("functionId"), "kind"), rows.where("what = 'node' and kind = 'file'").select("sourceFile"))
        for a in A.plan(list(o.include), list(o.skip)):
            self.analyze(a, sections, context)
        queries = complexity.policy_queries(self.facts["policyResults"])
        ran = any(r[4] == "complexity_metrics" for r in self.runs)
        for mode in ("package", "domain"):
            queries = queries.unionByName(complexity.complexity_queries(self.facts["nodes"], self.facts["metrics"], self.facts["edges"], self.facts["diagnostics"], mode, ran))
        last: dict[str, DataFrame] = {"queries": queries}
        changed = p.root / "order" / "service.go"
        if o.simulate_change and changed.exists():
            one = spark.createDataFrame([(p.rel(changed), changed.read_bytes())], "sourceFile string, content binary")
            last["freshness"] = simulated_change(one)
        self.stage("query_materialization", last)
        self.facts["runs"] = self.ran()
        return self.facts


#: Sections that are written even when empty, and the order of rows.
ALWAYS = ("sourceRecords", "nodes", "edges", "observations", "labels", "warnings", "queries", "pathJobs", "freshness", "diagnostics", "runs", "policyResults", "metrics")


def in_order(facts: dict[str, DataFrame | None]) -> dict[str, DataFrame | None]:
    """Sections as sinks list them: by id, diagnostics by source and reason; queries, path jobs,
    freshness and runs stay as they came."""
    order = {"diagnostics": ("source", "reason"), "queries": (), "pathJobs": (), "freshness": (), "runs": ()}
    return {s: df if df is None or not (by := order.get(s, ("id",))) else df.orderBy(*by) for s, df in facts.items()}


def graph_chunks(facts: dict[str, DataFrame | None]) -> Iterator[str]:
    """Sections as one JSON object, two blanks a level, empty values left out; a row at a time, so
    what the driver holds does not grow with the graph."""
    ordered = in_order(facts)
    yield "{"
    for n, s in enumerate(ALWAYS):
        df = ordered.get(s)
        yield f"{',' if n else ''}\n  {json.dumps(s)}: "
        if df is None:
            yield "null"
            continue
        empty = True
        for r in df.toLocalIterator():
            row = {k: v for k, v in r.asDict(True).items() if v not in ("", None, [], {})}
            text = json.dumps(row, indent=2, ensure_ascii=False).replace("\n", "\n    ")
            yield f"{'[' if empty else ','}\n    {text}"
            empty = False
        yield "[]" if empty else "\n  ]"
    yield "\n}"


def graph_json(facts: dict[str, DataFrame | None]) -> str:
    """The graph as one string, for graphs that fit into the driver."""
    return "".join(graph_chunks(facts))


def write_graph(facts: dict[str, DataFrame | None], folder: str) -> list[str]:
    """Every section as JSON lines in a folder of its own, written by the executors; the folders."""
    out = []
    for s, df in in_order(facts).items():
        if df is not None:
            out.append(f"{folder.rstrip('/')}/{s}")
            df.write.mode("overwrite").json(out[-1])
    return out


def emit(name: str, text: str | Iterable[str], stdout: bool = False, folder: str = "") -> str:
    """Print, or write to ``folder`` (tmp/report by default); the path that was written, or ""."""
    chunks = [text] if isinstance(text, str) else text
    if stdout:
        for c in chunks:
            print(c, end="")
        print()
        return ""
    path = Path(folder or "tmp/report") / name
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8") as f:
        f.writelines(chunks)
        f.write("\n")
    return str(path)


def summarise(facts: dict[str, DataFrame]) -> DataFrame:
    """(part, name, value): node, edge and source record kinds counted, statuses of queries and path
    jobs, trust of packages, freshness statuses counted."""
    count = lambda part, section, c: facts[section].groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(part).alias("part"), "name", "value")
    value = lambda part, df, name, c: df.select(F.lit(part).alias("part"), F.col(name).alias("name"), F.col(c).alias("value"))
    parts = [
        count("nodeKinds", "nodes", "kind"), count("edgeKinds", "edges", "kind"), count("sourceRecordKinds", "sourceRecords", "kind"), count("freshnessStatuses", "freshness", "status"),
        value("queryStatuses", facts["queries"], "id", "status"), value("pathStatuses", facts["pathJobs"], "id", "status"), value("packageTrust", facts["nodes"].where("kind = 'package'"), "id", "trustLevel"),
        value("placeholders", facts["nodes"].where("kind = 'placeholder'"), "id", "reason"),
    ]
    return reduce(DataFrame.union, parts)


def register(facts: dict[str, DataFrame], prefix: str = "") -> None:
    """Every section as a temporary view for SQL."""
    for s, df in facts.items():
        df.createOrReplaceTempView(prefix + s)


def report(facts: dict[str, DataFrame], mode: str, options: reports.Options) -> str:
    """stats, zones or problems as JSON."""
    rows = lambda lists: {k: [r.asDict(True) for r in v.collect()] for k, v in lists.items()}
    if mode == "stats":
        out = rows(reports.stats(facts, options))
    elif mode == "ddd":
        lists, counts, cut = reports.limited(reports.zones(facts, options), options.limit)
        out = {"summary": counts | {"truncated": cut}, "stats": rows(reports.stats(facts, options)), **lists}
    else:
        lists, counts, cut = reports.limited(reports.problems(facts), options.limit)
        out = {"summary": counts | {"truncated": cut}, **lists}
    return json.dumps(out, indent=2, ensure_ascii=False)
