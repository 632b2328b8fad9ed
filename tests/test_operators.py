"""Operators on tiny tables: order of arrival, three outcomes, contracts, planner, ranges."""

import pytest
from pyspark.sql import functions as F

from factloom import model as M
from factloom.functions import scalars as S
from factloom.operators import graph, policy, reports, viewer, vocabulary
from factloom.plans import analyzers as A
from factloom.sources import config, workspace
from factloom.sources.gosyntax import parse


def by_rune(value):
    out, word = [], ""
    for i, c in enumerate(value):
        if not (c.isalpha() or c.isdecimal()):
            out, word = out + [word] * bool(word), ""
            continue
        before, after = value[i - 1] if i else "", value[i + 1] if i + 1 < len(value) else ""
        if word and c.isupper() and (before.islower() or before.isupper() and after.islower()):
            out, word = [*out, word], ""
        word += c.lower() if len(c.lower()) == 1 else "i"
    return out + [word] * bool(word)


WORDS = ["HTTPServerName", "snake_case-and/pathV2", "aBcD", "", "__", "XMLHttp2Go", "éÉtoileABc", "ΑΣ", "x9Y", "ABC"]


def test_split_words_reads_letter_by_letter(spark):
    got = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", S.split_words("w").alias("s")).collect()
    assert {r.w: r.s for r in got} == {w: by_rune(w) for w in WORDS}


@pytest.mark.parametrize(("text", "want"), [("", (1, 1)), ("9:1-17:2", (9, 17)), ("3-4", (3, 4)), ("a-b", None), ("1:2", None), ("1-2-3", None)])
def test_line_range(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(S.line_range("t").alias("r")).first().r
    assert (r and (r.startLine, r.endLine)) == want


def nodes(spark, *values):
    n = spark.createDataFrame([(i, k, name, t) for i, k, name, t in values], "id string, kind string, name string, trustLevel string")
    return M.conform(n.withColumn("packagePath", F.lit("a/b")), "nodes")


def edges(spark, *values):
    return M.conform(spark.createDataFrame(list(values), "id string, from string, to string, kind string, complete boolean, reason string").withColumn("trustLevel", F.lit("syntax_observed")), "edges")


def test_nodes_keep_their_first_row_and_edges_their_last(spark):
    n = nodes(spark, ("x", "type", "one", "syntax_observed"), ("x", "type", "two", "type_resolved")).withColumn("seq", F.when(F.col("name") == "one", 1).otherwise(2))
    r = graph.upsert_nodes(n.repartition(3)).first()
    assert (r["name"], r.trustLevel) == ("one", "type_resolved")
    e = edges(spark, ("e", "a", "b", "calls", True, "first"), ("e", "a", "b", "calls", True, "last")).withColumn("seq", F.when(F.col("reason") == "first", 1).otherwise(2))
    assert graph.upsert_edges(e).first().reason == "last"


def test_reconcile_moves_edges_and_drops_placeholders(spark):
    n = nodes(spark, ("package:p", "package", "p", "syntax_observed"), ("placeholder:package:p", "placeholder", "p", "syntax_observed"), ("placeholder:package:q", "placeholder", "q", "syntax_observed"))
    e = edges(spark, ("edge:imports:package:a->placeholder:package:p", "package:a", "placeholder:package:p", "imports", False, ""), ("edge:imports:package:a->placeholder:package:q", "package:a", "placeholder:package:q", "imports", False, ""))
    n, e = graph.reconcile(n, e)
    assert {r.id for r in n.collect()} == {"package:p", "placeholder:package:q"}
    assert {(r.to, r.complete, r.reason) for r in e.collect()} == {("package:p", True, "placeholder_reconciled_to_real_package"), ("placeholder:package:q", False, "")}


def test_pairs_do_not_depend_on_order(spark):
    n = nodes(spark, ("f1", "function", "payOrderNow", "type_resolved"), ("f2", "function", "orderPay", "syntax_observed"))
    pairs = {(r.value, r.attributes["count"], r.trustLevel, len(r.evidence)) for r in vocabulary.cooccurrences(vocabulary.terms(n.repartition(5))).collect()}
    assert ("order pay", "2", "syntax_observed", 4) in pairs and ("now order", "1", "type_resolved", 2) in pairs


def test_policy_has_three_outcomes(spark):
    e = edges(spark, *[(f"edge:imports:package:a->{t}", "package:a", t, "imports", ok, "") for t, ok in (("package:b", True), ("package:c", True), ("package:d", True), ("placeholder:package:e", False))])
    rules = policy.rules(spark, {"rules": [{"package": "a", "allow": ["b", "d"], "deny": ["d"]}]})
    out = policy.evaluate(e, rules, None)
    assert {r.subject: r.status for r in out["policyResults"].collect()} == {"b": "pass", "c": "fail", "d": "fail", "e": "unknown"}
    assert {r.to for r in out["edges"].collect()} == {"package:c", "package:d"}
    assert out["warnings"].count() == 3 and out["diagnostics"].where("level = 'warning'").count() == 1


def test_planner_closes_and_cascades():
    assert [a.id for a in A.plan(["bridge_symbol"])] == ["vocabulary_extraction", "vocabulary_cooccurrence", "language_zone_candidate", "bridge_symbol"]
    assert "bridge_symbol" not in [a.id for a in A.plan([], ["vocabulary_cooccurrence"])]
    with pytest.raises(ValueError, match="unknown analyzer"):
        A.plan(["nothing"])


def test_contracts_of_all_analyzers_hold():
    assert [A.check_contract(a) for a in A.ANALYZERS] == [[]] * 8
    assert len(A.check_contract(A.Analyzer("", "nowhere", (), ("odd",), None, least_trust="type_resolved", on_incomplete="?"))) >= 5


def test_result_with_a_lost_reference_is_wrong(spark):
    n = nodes(spark, ("package:p", "package", "p", "syntax_observed"))
    label = M.conform(spark.createDataFrame([("label:x", "label", "package:gone", "node", "type_resolved")], "id string, kind string, targetId string, targetKind string, trustLevel string"), "labels")
    reasons = [r.reason for r in A.check_result(A.ANALYZERS[0], n.select("id"), {"labels": label}).collect()]
    assert any("missing target package:gone" in r for r in reasons) and any("exceeds analyzer maximum" in r for r in reasons)


def test_sections_by_any_spelling():
    assert reports.section_name("Policy-results") == "policyResults"
    with pytest.raises(ValueError, match="unknown --json-sections"):
        reports.section_name("nope")


def test_containment_equals_brute_force(spark):
    spans = [(f"n{i}", "f", f"{a}:1-{b}:1") for i, (a, b) in enumerate([(1, 300), (2, 3), (64, 64), (63, 130), (128, 129), (10, 5), (70, 90)])]
    df = spark.createDataFrame(spans, "id string, sourceFile string, lineRange string")
    got = {(r.outerId, r.innerId) for r in viewer.contained(df, df).collect()}
    at = {i: tuple(int(p.split(":")[0]) for p in r.split("-")) for i, _, r in spans}
    assert got == {(a, b) for a in at for b in at if a != b and at[a][0] <= at[b][0] and at[a][1] >= at[b][1]}


def test_raw_sections_of_configuration():
    got = config.sections('{ "a" : {"x":  1},\n "b":[1, 2] }')
    assert got == {"a": b'{"x":  1}', "b": b"[1, 2]"}


SOURCE = b"""package shop

import (
\tp "example.com/pay"
)

type Cart struct {
\tItems, Sizes []int
\t*Base
\tLimit [4]string `tag`
}

func (c *Cart) Add(n int) error {
\tfor i := range c.Items {
\t\tif n > 0 && i < 3 || n == 2 {
\t\t\tp.Charge(n, func() int { return <-wait })
\t\t}
\t}
\tselect {
\tcase v := <-ch:
\t\tout <- v
\tdefault:
\t\tgo run(Cart{Items: []int{1}})
\t}
\tswitch x := y.(type) {
\tcase int, *Cart:
\t\tgoto end
\t}
end:
\tdefer close(ch)
\treturn nil
}
"""


def test_go_source():
    s = parse(SOURCE)
    assert (s.package, s.span(s.start, s.end)) == ("shop", "1:1-32:2")
    assert [(p, s.span(a, b)) for p, a, b in s.imports] == [("example.com/pay", "4:2-4:21")]
    (name, kind, *_, fields), = s.types
    assert (name, kind, [f[0] for f in fields]) == ("Cart", "struct", ["Items", "Sizes", "Limit"])
    (name, receiver, _, _, decisions), = s.functions
    assert (name, receiver) == ("Add", "*Cart")
    assert sorted(decisions) == sorted(["range", "if", "boolean", "boolean", "receive", "select_case", "receive", "send", "select_default", "go", "case", "goto", "defer"])
    assert [c[0] for c in s.calls] == ["p.Charge", "run"]
    with pytest.raises(SyntaxError):
        parse(b"package p\nfunc {")


def test_manifest_and_workspace(tmp_path, spark):
    def put(path, text):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("app/go.mod", 'module ex.org/app\n\nrequire (\n\tex.org/lib v1.0.0 // direct\n\tex.org/gone v0.1.0\n)\nreplace ex.org/lib => ../lib\nreplace ex.org/x => ../void\n')
    put("app/main.go", 'package main\n\nimport (\n\t"ex.org/app/zed"\n\t"ex.org/lib"\n\t"fmt"\n\t"ex.org/none/deep"\n)\n\nfunc main() { fmt.Println(zed.A()) }\n')
    put("app/zed/z.go", "package zed\n\nfunc A() int { return 1 }\n")
    put("app/.hidden/h.go", "package hidden\n")
    put("app/bad.go", "package main\nfunc {\n")
    put("lib/go.mod", "module ex.org/lib\n")
    put("lib/l.go", "package lib\n\ntype T struct{ Name string }\n")
    p = workspace.resolve(str(tmp_path / "app" / "main.go"), str(tmp_path))
    mods = workspace.modules(p)
    assert [(m, r) for m, _, r, _ in mods.rows] == [("ex.org/app", ["entry_module", "workspace_scan"]), ("ex.org/lib", ["go_mod_replace", "workspace_scan"])]
    assert mods.diagnostics == [("app/go.mod", "local replace path has no go.mod: void")]
    base = workspace.base_facts(spark, p)
    n, e = graph.reconcile(graph.upsert_nodes(base["nodes"]), graph.upsert_edges(base["edges"]))
    ids = {r.id for r in n.collect()}
    assert {"module:ex.org/lib", "placeholder:module:ex.org/gone", "package:ex.org/app/zed", "field:ex.org/lib.T.Name", "placeholder:package:ex.org/none/deep", "file:app/main.go"} <= ids
    assert not any("hidden" in i or i == "file:app/bad.go" for i in ids)
    found = {r.to: (r.complete, r.reason) for r in e.where("kind = 'imports'").collect()}
    assert found["package:ex.org/app/zed"] == (True, "placeholder_reconciled_to_real_package")
    assert found["package:fmt"] == (True, "") and found["placeholder:package:ex.org/none/deep"][0] is False
    assert base["diagnostics"].where("level = 'error'").first().source == "app/bad.go"
    with pytest.raises(FileNotFoundError):
        workspace.module_root(tmp_path.parent)


def test_stream_equals_ledger(spark, tmp_path):
    from factloom.streaming.freshness import ledger, stream

    seen = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, "x"), ("a", 3, 3, "y"), ("b", 1, 4, "z"), ("a", 4, 5, "x")], "factId string, seen int, seq bigint, hash string")
    seen.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream(spark.readStream.schema(seen.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda r: tuple(r)
    assert sorted(map(key, spark.table("fresh").collect())) == sorted(map(key, ledger(seen).collect()))
