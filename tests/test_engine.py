"""A workspace from files to reports, through every stage and analyzer."""

import json
import threading
import urllib.error
import urllib.request
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from factloom import model as M
from factloom.example import lay
from factloom.operators import reports
from factloom.plans import analyzers as A
from factloom.plans import engine, viewer
from factloom.sources import blocks, loads


@pytest.fixture(scope="module")
def top(tmp_path_factory):
    return lay(tmp_path_factory.mktemp("ws"))


@pytest.fixture(scope="module")
def facts(spark, top):
    return engine.Build(spark, engine.Options(str(top / "night"), str(top), simulate_change=True)).run()


def count(facts, section, key):
    return {r[key]: r["count"] for r in facts[section].groupBy(key).count().collect()}


def test_workspace_facts(facts):
    assert count(facts, "nodes", "kind") == {"module": 3, "package": 5, "file": 5, "function": 4, "method": 1, "type": 1, "struct": 1, "interface": 1, "field": 2, "import": 5, "placeholder": 2, "runtime_marker": 4, "unresolved_call": 6}
    assert count(facts, "edges", "kind") == {"contains": 7, "declares": 8, "imports": 5, "calls": 6, "depends_on": 2, "violates": 1, "contains_runtime_marker": 4}
    assert count(facts, "sourceRecords", "kind") == {"user_entry": 1, "project_root": 1, "workspace_root": 1, "config": 1, "go_work": 1, "go_mod": 3, "go_file": 6, "module_discovery": 3}
    assert count(facts, "freshness", "status")["superseded"] == 1
    assert {r.reason for r in facts["diagnostics"].where("status = ''").collect()} == {"local replace path has no go.mod: mount", "(3, 10): bracket is not closed"}
    assert facts["runs"].where("status = 'analysis_error'").count() == 0 and facts["nodes"].where("runId = ''").count() == 0


def test_modules_and_trust(facts):
    nodes = {r.id: r for r in facts["nodes"].collect()}
    assert [nodes[f"module:obs.test/{m}"].reason for m in ("night", "lens", "spare")] == ["entry_module,go_work_use,workspace_scan", "go_work_use,workspace_scan", "workspace_scan"]
    assert nodes["placeholder:module:far.test/clock"].reason == "required_module_not_present_in_workspace"
    trust = {i.removeprefix("package:obs.test/"): r.trustLevel for i, r in nodes.items() if r.kind == "package"}
    assert trust == {"night": "type_resolved", "night/dome": "type_resolved", "night/order": "type_resolved", "lens/glass": "package_loaded", "spare": "syntax_observed"}
    # lens/glass comes first and imports a package that is parsed after it
    assert [r.reason for r in facts["edges"].where("id = 'edge:imports:package:obs.test/lens/glass->package:obs.test/night/dome'").collect()] == ["placeholder_reconciled_to_real_package"]


def test_analyzers_on_the_workspace(facts):
    assert count(facts, "policyResults", "status") == {"pass": 3, "fail": 1, "unknown": 1}
    value = {r.subject.split("/")[-1]: r.value for r in facts["metrics"].where("name = 'cyclomatic_complexity'").collect()}
    assert value == {"glass.Focus": 3, "night.Watch": 2, "dome.New": 1, "order.Queue": 3, "dome.*Dome.Open": 4}
    assert {r.subject.split("/")[-1]: r.value for r in facts["metrics"].where("name = 'runtime_marker_count' and value > 0").collect()} == {"order.Queue": 3}
    status = {r.id.removeprefix("query:"): r.status for r in facts["queries"].collect()}
    short = {k.replace("obs.test/", ""): v for k, v in status.items()}
    assert short == {
        "policy:lens/glass": "fail", "policy:night": "pass", "complexity:package:lens/glass": "pass", "complexity:package:night": "pass", "complexity:package:night/dome": "warning",
        "complexity:package:night/order": "pass", "complexity:domain:lens/glass": "unknown", "complexity:domain:night": "unknown",
    }
    assert {r.reason for r in facts["warnings"].where("kind = 'ul_discouraged_term'").collect()} == {"discouraged ubiquitous language term azimuth"}


def test_loads_of_a_loader_replace_structure(spark, top, tmp_path):
    (tmp_path / "loads.json").write_text('{"package": "obs.test/night/dome", "errors": ["import cycle not allowed"]}\n{"package": "obs.test/night", "imports": ["obs.test/lens/glass"]}\n{"errors": ["no package"]}\n')
    rows = loads.read(spark, str(tmp_path / "loads.json"))
    assert {(r.package, tuple(r.errors), tuple(r.imports)) for r in rows.collect()} == {("obs.test/night/dome", ("import cycle not allowed",), ()), ("obs.test/night", (), ("obs.test/lens/glass",))}
    rows.write.parquet(str(tmp_path / "loads.parquet"))
    facts = engine.Build(spark, engine.Options(str(top / "night"), str(top), include=("vocabulary_extraction",))).run(loads.read(spark, str(tmp_path / "loads.parquet")))
    trust = {r.name.removeprefix("obs.test/"): r.trustLevel for r in facts["nodes"].where("kind = 'package'").collect()}
    assert trust == {"night": "type_resolved", "night/dome": "syntax_observed", "night/order": "syntax_observed", "lens/glass": "package_loaded", "spare": "syntax_observed"}
    assert [(r.level, r.source) for r in facts["diagnostics"].where("status = 'import_cycle'").collect()] == [("error", "go/packages:obs.test/night/dome")]


def test_sinks(facts, tmp_path):
    graph = json.loads(engine.graph_json(reports.filter_graph(facts, ["edges", "pathJobs"], edge_kinds=["imports"])))
    assert [e["id"] for e in graph["edges"]] == sorted(e["id"] for e in graph["edges"]) and len(graph["edges"]) == 5
    assert graph["nodes"] is None and graph["pathJobs"] == [] and "reason" not in graph["edges"][-1]
    path = engine.emit("g.json", engine.graph_chunks(facts), folder=str(tmp_path / "out"))
    assert path.endswith("g.json") and len(json.loads((tmp_path / "out" / "g.json").read_text())["nodes"]) == 40
    folders = engine.write_graph({"nodes": facts["nodes"], "edges": None}, str(tmp_path / "parts"))
    assert [f.rsplit("/", 1)[1] for f in folders] == ["nodes"] and facts["nodes"].sparkSession.read.json(folders[0]).count() == 40
    problems = json.loads(engine.report({k: facts[k] for k in reports.PROBLEMS}, "problems", reports.Options(limit=1)))
    assert problems["summary"]["truncated"] and len(problems["policyResults"]) == 1
    summary = {(r.part, r.name): r.value for r in engine.summarise(facts).collect()}
    assert summary["nodeKinds", "function"] == "4" and summary["queryStatuses", "query:policy:obs.test/night"] == "pass" and summary["packageTrust", "package:obs.test/spare"] == "syntax_observed"


def test_blocks_of_source(top):
    assert blocks.read_block(str(top), "lens/glass/glass.go", "8:1-9:13").code == "   8  func Focus(n int) int {\n   9  \ttick.Wait()"
    assert blocks.read_block(str(top), "/lens//glass/../glass/glass.go").row() == {"file": "/lens/glass/glass.go", "lineRange": "", "startLine": 1, "endLine": 1, "code": "   1  package glass"}
    assert (b := blocks.read_block(str(top / "spare"), "box.go", "3:1-900:1")).endLine == 4 and b.startLine == 3
    for file, lines, wrong in (("", "", "missing"), ("../spare/../../x.go", "", "escapes"), ("../lens-other/x.go", "1:1-1:1", "escapes"), ("spare/box.go", "7", "invalid"), ("spare/box.go", "a:1-2:2", "invalid")):
        with pytest.raises(ValueError, match=wrong):
            blocks.read_block(str(top / "lens") if "lens-" in file else str(top), file, lines)


def test_viewer_service(facts, top):
    with viewer.server("localhost:0", facts, str(top)) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        at = f"http://localhost:{s.server_address[1]}"
        get = lambda path: urllib.request.urlopen(at + path, timeout=60).read().decode()
        assert "graph.json" in get("/")
        assert len(json.loads(get("/graph.json"))["edges"]) == 33
        assert json.loads(get("/source?file=spare/box.go&range=3:1-3:5"))["code"] == "   3  type Box []string"
        for path, code in (("/nothing", 404), ("/source?file=../x.go", 400), ("/source", 400), ("/source?file=none.go", 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path)
            assert e.value.code == code
        s.shutdown()


def test_registry_keeps_order_and_copies():
    r = A.Registry()
    for a in A.ANALYZERS[2::-1]:
        r.register(a)
    seen = r.analyzers()
    r.register(A.ANALYZERS[4])
    assert seen == A.ANALYZERS[2::-1] and len(r.analyzers()) == 4


def test_results_in_order(spark):
    rows = spark.createDataFrame([("b", "x"), ("a", "z"), ("a", "y")], "source string, reason string")
    ids = spark.createDataFrame([("k:2",), ("k:1",)], "id string")
    out = A.in_order({"diagnostics": rows, "warnings": ids})
    assert [tuple(r) for r in out["diagnostics"].collect()] == [("a", "y"), ("a", "z"), ("b", "x")] and [r.id for r in out["warnings"].collect()] == ["k:1", "k:2"]


def test_lost_storage_is_no_finding(spark, tmp_path):
    b = engine.Build(spark, engine.Options("."))
    context, first = A.Context(spark, b.facts, {}), A.ANALYZERS[0]

    def lost(c):
        c.spark.range(3).write.parquet(str(tmp_path / "gone"))
        df = c.spark.read.parquet(str(tmp_path / "gone"))
        for f in (tmp_path / "gone").glob("*.parquet"):
            f.unlink()
        return {"warnings": df.selectExpr("cast(id as string) as id")}

    with pytest.raises(Exception, match="(?i)does not exist|FAILED_READ_FILE"):
        b.analyze(replace(first, id="lost", run=lost), {}, context)

    def wrong(c):
        raise ValueError("no such rule")

    b.analyze(replace(first, id="wrong", run=wrong), {}, context)
    assert [(r.analyzerId, r.status) for r in b.ran().collect()] == [("wrong", "analysis_error")]


def test_findings_and_messages_are_not_cut(spark):
    b = engine.Build(spark, engine.Options("."))
    context = A.Context(spark, b.facts, {})
    many = spark.range(1200).selectExpr("concat('warning:', id) as id", "'' as kind", "'syntax_observed' as trustLevel")
    first = A.ANALYZERS[0]
    b.analyze(replace(first, id="bad", emits=("warning",), run=lambda c: {"warnings": many}, on_incomplete="allow"), {}, context)
    b.facts["nodes"] = M.conform(spark.range(150).selectExpr("concat('package:', id) as id", "'package' as kind", "true as synthetic", "'inferred' as trustLevel"), "nodes")
    b.analyze(replace(first, id="open", inputs=("package",), on_incomplete="require_complete"), {}, context)
    b.stage("some", {"diagnostics": spark.range(1100).selectExpr("'warning' as level", "concat('s', id) as source", "'r' as reason")})
    rows = {r.analyzerId: r for r in b.facts["diagnostics"].groupBy("analyzerId").agg(F.count("*").alias("n"), F.max(F.size("evidence")).alias("named"), F.max(F.size(F.split("reason", ", "))).alias("said")).collect()}
    assert rows["bad"].n >= 1200 and (rows["open"].n, rows["open"].named, rows["open"].said) == (1, 150, 150)
    assert [(r.analyzerId, r.status, len(r.diagnostics)) for r in b.ran().collect()] == [("bad", "analysis_error", rows["bad"].n), ("open", "partial", 1), ("indexer.some", "partial", 1100)]
