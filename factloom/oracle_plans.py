"""SQL twins of the queries over plans, sinks and the explorer; parts that are constants stand as such."""

from __future__ import annotations

GHOST = "(synthetic OR kind = 'placeholder' OR starts_with(id, 'placeholder:'))"


def values(columns: str, text: str) -> str:
    """A constant table: a line is a row, its cells parted by " | "; a column ending in # is a number, in ? a truth value."""
    names = columns.split()
    cast = {"#": lambda v: f"{v}::BIGINT", "?": lambda v: v}
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    lines = [[c.strip() for c in line.split(" | ")] for line in text.strip("\n").splitlines()]
    rows = ", ".join("(" + ", ".join(cast.get(n[-1], quote)(v) for n, v in zip(names, line, strict=True)) + ")" for line in lines)
    return f"SELECT * FROM (VALUES {rows}) AS t({', '.join(n.rstrip('#?') for n in names)})"


_ESCAPED = "coalesce(text, '')"
for _plain, _entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
    _ESCAPED = f"replace({_ESCAPED}, '{_plain}', '{_entity}')"

PLANS = {
    "viewer_list": "SELECT id FROM nodes ORDER BY id LIMIT 120",
    "viewer_source_order": """SELECT id, row_number() OVER (ORDER BY sourceFile || lineRange || id) AS place FROM nodes
      WHERE kind IN ('function', 'method', 'unresolved_call') AND sourceFile <> '' AND contains(lower(concat_ws(' ', id, name, packagePath, sourceFile)), 'brass')""",
    "viewer_metric_filter": "SELECT id, status FROM cyclo WHERE status = 'warning'",
    "viewer_selection": "SELECT id, evidence[1] AS selected FROM results",
    "viewer_touched": """SELECT DISTINCT n.id AS selected, e.id AS edgeId FROM nodes n JOIN edges e ON n.id = e."from" OR n.id = e."to" WHERE n.kind = 'package'""",
    "viewer_choices": "SELECT DISTINCT 'kind' AS control, kind AS value FROM nodes UNION ALL SELECT DISTINCT 'packagePath', packagePath FROM nodes WHERE packagePath <> ''",
    "viewer_index": """SELECT id, 'nodes' AS section, kind FROM nodes UNION ALL SELECT id, 'edges', kind FROM edges UNION ALL SELECT id, 'policyResults', 'policy_result' FROM results
      UNION ALL SELECT id, 'metrics', 'metric' FROM cyclo UNION ALL SELECT 'metric:decision_count:' || subject, 'metrics', 'metric' FROM cyclo UNION ALL SELECT 'metric:runtime_marker_count:' || subject, 'metrics', 'metric' FROM cyclo""",
    "viewer_kind_counts": "SELECT kind, count(*) AS n FROM nodes GROUP BY 1",
    "viewer_labels": f"""SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 24 THEN coalesce(text, '') ELSE left(text, 12) || '…' || right(text, 11) END AS short, md5({_ESCAPED}) AS escaped FROM documents""",
    "sorted_nodes": "SELECT id, row_number() OVER (ORDER BY id) AS place FROM nodes",
    "sorted_diagnostics": "SELECT source, reason, row_number() OVER (ORDER BY source, reason) AS place FROM diagnostics",
    "analyzer_order": """WITH+ refusals AS (
        SELECT 'policy:' || scope AS source, CASE WHEN status = 'unknown' THEN 'policy_unknown: ' ELSE 'policy_violation: ' END || reason AS reason FROM results WHERE status <> 'pass')
      SELECT 'diagnostics' AS part, source || ':' || reason AS fact, row_number() OVER (ORDER BY source, reason) AS place FROM refusals
      UNION ALL SELECT 'policyResults', id, row_number() OVER (ORDER BY id) FROM results""",
    "written_graph": """SELECT id, '{"id":"' || id || '","kind":"' || kind || '"' || CASE WHEN reason <> '' THEN ',"reason":"' || reason || '"' ELSE '' END || CASE WHEN lineRange <> '' THEN ',"lineRange":"' || lineRange || '"' ELSE '' END || '}' AS json FROM nodes""",
    "graph_summary": """SELECT 'nodeKinds' AS part, kind AS name, count(*)::VARCHAR AS value FROM nodes GROUP BY 2 UNION ALL SELECT 'edgeKinds', kind, count(*)::VARCHAR FROM edges GROUP BY 2
      UNION ALL SELECT * FROM (VALUES ('sourceRecordKinds', 'project_root', '1'), ('sourceRecordKinds', 'workspace_root', '1'), ('sourceRecordKinds', 'go_mod', '8'), ('sourceRecordKinds', 'module_discovery', '5')) AS t
      UNION ALL SELECT 'queryStatuses', id, status FROM pqueries UNION ALL SELECT 'queryStatuses', id, status FROM cqueries
      UNION ALL SELECT 'packageTrust', id, trustLevel FROM nodes WHERE kind = 'package' UNION ALL SELECT 'placeholders', id, reason FROM nodes WHERE kind = 'placeholder'""",
    "viewer_feed": """SELECT 0::BIGINT AS part, 'Query: ' || status AS title, query || ' / ' || reason AS text, '' AS id
        FROM (SELECT status, 'package dependency policy' AS query, reason FROM pqueries UNION ALL SELECT status, 'cyclomatic complexity ' || mode || ' threshold', reason FROM cqueries)
      UNION ALL SELECT 1, 'Path: blocked', 'no way', ''
      UNION ALL SELECT 2, 'Policy: ' || status, ruleId || ' / ' || subject, id FROM results
      UNION ALL SELECT 3, 'Metric: ' || status, 'cyclomatic_complexity = ' || value || ' count / ' || subject, id FROM cyclo
      UNION ALL SELECT 3, 'Metric: pass', 'decision_count = ' || (value - 1) || ' count / ' || subject, 'metric:decision_count:' || subject FROM cyclo
      UNION ALL SELECT 3, 'Metric: pass', 'runtime_marker_count = ' || m || ' count / ' || id, 'metric:runtime_marker_count:' || id FROM measured
      UNION ALL SELECT 4, 'Freshness: ' || CASE WHEN p_size > 25 THEN 'stale' ELSE 'fresh' END, p_name, '' FROM part
      UNION ALL SELECT 5, 'Diagnostic: ' || level, reason, '' FROM diagnostics
      UNION ALL SELECT * FROM (VALUES (6, 'Run: policy_evaluation / completed', '7 emitted facts', ''), (6, 'Run: rendering / partial', '0 emitted facts', '')) AS t""",
    "viewer_neighbours": """WITH+ s AS (SELECT id FROM nodes WHERE kind = 'module')
      SELECT id FROM s UNION SELECT "to" FROM edges WHERE "from" IN (SELECT id FROM s) UNION SELECT "from" FROM edges WHERE "to" IN (SELECT id FROM s)""",
    "simulated_change": """SELECT 'file:' || doc_id AS factId, doc_id::VARCHAR AS sourceFile, substr(sha256(coalesce(text, '')), 1, 16) AS oldHash, substr(sha256(coalesce(text, '') || chr(10) || '// simulated unsaved edit' || chr(10)), 1, 16) AS newHash,
      'superseded' AS status, 'simulated_changed_content_requires_reindex' AS reason FROM documents""",
    "result_findings": """SELECT CASE length(id) % 4 WHEN 0 THEN 'warning ' || id || ' trust type_resolved exceeds analyzer maximum package_loaded' WHEN 1 THEN 'warning ' || id || ' missing trust level'
        WHEN 2 THEN 'warning ' || id || ' missing kind' ELSE 'warnings ' || id || ' references missing affected_edge edge:gone' END AS reason FROM pwarnings
      UNION ALL SELECT 'analyzer emitted undeclared fact kind label'""",
    "unready_facts": f"""SELECT id FROM nodes WHERE kind IN ('package', 'placeholder') AND {GHOST} UNION ALL SELECT id FROM edges WHERE kind IN ('imports', 'depends_on') AND (NOT complete OR starts_with("to", 'placeholder:'))""",
    "package_loads": """SELECT substr("from", 9) AS package, coalesce(array_to_string(list_sort(list(DISTINCT "to") FILTER (NOT complete)), '|'), '') AS errors,
      coalesce(array_to_string(list_sort(list(DISTINCT "to") FILTER (complete)), '|'), '') AS imports FROM edges WHERE kind = 'imports' GROUP BY 1""",
    "metric_definitions": values("name unit scope", """
cyclomatic_complexity | count | function
decision_count | count | function
runtime_marker_count | count | function
"""),
    "manifest_directives": """SELECT s_suppkey, s_name AS module, 'a.test/n' || s_nationkey || '|b.test/x|c.test/y' AS requires, '../n' || s_nationkey AS replaces, true AS isLocal FROM supplier""",
    "config_sections": """SELECT section, raw, CASE WHEN raw = '' THEN '' ELSE sha256(raw) END AS hash, CASE WHEN raw = '' THEN '{}' ELSE replace(raw, ' ', '') END AS settings
      FROM (VALUES ('complexity', '{"cyclomatic": {"warningThreshold": 7}}'), ('moduleDependencyEnrichment', '{"networkAccess":"enabled"}'), ('ubiquitousLanguage', '{}'), ('absent', '')) AS t(section, raw)""",
    "analyzer_plans": values("name place# id", """
all | 1 | module_dependency_enrichment
all | 2 | vocabulary_extraction
all | 3 | vocabulary_cooccurrence
all | 4 | language_zone_candidate
all | 5 | bridge_symbol
all | 6 | ubiquitous_language
all | 7 | complexity
all | 8 | dependency_policy
closure | 1 | vocabulary_extraction
closure | 2 | vocabulary_cooccurrence
closure | 3 | language_zone_candidate
closure | 4 | bridge_symbol
cascade | 1 | module_dependency_enrichment
cascade | 2 | vocabulary_extraction
cascade | 3 | ubiquitous_language
cascade | 4 | complexity
cascade | 5 | dependency_policy
both | 1 | complexity
unknown | 0 | unknown analyzer 'nonsense'; known analyzers: bridge_symbol, complexity, dependency_policy, language_zone_candidate, module_dependency_enrichment, ubiquitous_language, vocabulary_cooccurrence, vocabulary_extraction
"""),
    "contract_findings": values("name finding", """
bare | analyzer metadata missing id
bare | analyzer metadata missing version
bare | analyzer metadata missing stage
bare | analyzer metadata missing input fact kinds
bare | analyzer metadata missing emitted fact kinds
stage | analyzer metadata has unsupported stage guessing
emits | analyzer metadata has unsupported emitted fact kind rumour
trust | analyzer metadata minimum required trust exceeds maximum emitted trust
trust_name | analyzer metadata has unsupported minimum required trust hope
trust_name | analyzer metadata missing maximum emitted trust
modes | analyzer metadata has unsupported failure mode
modes | analyzer metadata has unsupported incomplete input policy
"""),
    # the example workspace, read off a run and checked against its files, and the catalogue
    "workspace_nodes": values("id kind trustLevel reason sourceFile lineRange packagePath modulePath", """
field:obs.test/night/dome.Dome.Azimuth | field | syntax_observed |  | night/dome/dome.go | 9:2-9:9 | obs.test/night/dome | obs.test/night
field:obs.test/night/dome.Dome.Side | field | syntax_observed |  | night/dome/dome.go | 8:2-8:6 | obs.test/night/dome | obs.test/night
file:lens/glass/glass.go | file | syntax_observed |  | lens/glass/glass.go | 1:1-14:2 | obs.test/lens/glass | obs.test/lens
file:night/dome/dome.go | file | syntax_observed |  | night/dome/dome.go | 1:1-21:2 | obs.test/night/dome | obs.test/night
file:night/order/service.go | file | syntax_observed |  | night/order/service.go | 1:1-10:2 | obs.test/night/order | obs.test/night
file:night/watch.go | file | syntax_observed |  | night/watch.go | 1:1-15:2 | obs.test/night | obs.test/night
file:spare/box.go | file | syntax_observed |  | spare/box.go | 1:1-3:18 | obs.test/spare | obs.test/spare
function:obs.test/lens/glass.Focus | function | syntax_observed |  | lens/glass/glass.go | 8:1-14:2 | obs.test/lens/glass | obs.test/lens
function:obs.test/night.Watch | function | syntax_observed |  | night/watch.go | 10:1-15:2 | obs.test/night | obs.test/night
function:obs.test/night/dome.New | function | syntax_observed |  | night/dome/dome.go | 12:1-12:57 | obs.test/night/dome | obs.test/night
function:obs.test/night/order.Queue | function | syntax_observed |  | night/order/service.go | 3:1-10:2 | obs.test/night/order | obs.test/night
import:obs.test/lens/glass:far.test/clock/tick | import | syntax_observed |  | lens/glass/glass.go | 4:2-4:23 | obs.test/lens/glass | obs.test/lens
import:obs.test/lens/glass:obs.test/night/dome | import | syntax_observed |  | lens/glass/glass.go | 5:2-5:23 | obs.test/lens/glass | obs.test/lens
import:obs.test/night:fmt | import | syntax_observed |  | night/watch.go | 4:2-4:7 | obs.test/night | obs.test/night
import:obs.test/night:obs.test/lens/glass | import | syntax_observed |  | night/watch.go | 6:2-6:23 | obs.test/night | obs.test/night
import:obs.test/night:obs.test/night/dome | import | syntax_observed |  | night/watch.go | 7:2-7:23 | obs.test/night | obs.test/night
interface:obs.test/night/dome.Shutter | interface | syntax_observed |  | night/dome/dome.go | 3:6-5:2 | obs.test/night/dome | obs.test/night
method:obs.test/night/dome.*Dome.Open | method | syntax_observed |  | night/dome/dome.go | 14:1-21:2 | obs.test/night/dome | obs.test/night
module:obs.test/lens | module | syntax_observed | go_work_use,workspace_scan | lens/go.mod |  |  | obs.test/lens
module:obs.test/night | module | syntax_observed | entry_module,go_work_use,workspace_scan | night/go.mod |  |  | obs.test/night
module:obs.test/spare | module | syntax_observed | workspace_scan | spare/go.mod |  |  | obs.test/spare
package:obs.test/lens/glass | package | package_loaded |  |  |  | obs.test/lens/glass | obs.test/lens
package:obs.test/night | package | type_resolved |  |  |  | obs.test/night | obs.test/night
package:obs.test/night/dome | package | type_resolved |  |  |  | obs.test/night/dome | obs.test/night
package:obs.test/night/order | package | type_resolved |  |  |  | obs.test/night/order | obs.test/night
package:obs.test/spare | package | syntax_observed |  |  |  | obs.test/spare | obs.test/spare
placeholder:module:far.test/clock | placeholder | syntax_observed | required_module_not_present_in_workspace |  |  |  | far.test/clock
placeholder:package:far.test/clock/tick | placeholder | syntax_observed | imported_package_outside_known_workspace |  |  | far.test/clock/tick | 
runtime_marker:night/order/service.go:4:2-4:19:defer_statement | runtime_marker | syntax_observed |  | night/order/service.go | 4:2-4:19 | obs.test/night/order | 
runtime_marker:night/order/service.go:5:2-9:3:select_statement | runtime_marker | syntax_observed |  | night/order/service.go | 5:2-9:3 | obs.test/night/order | 
runtime_marker:night/order/service.go:6:12-6:19:channel_receive | runtime_marker | syntax_observed |  | night/order/service.go | 6:12-6:19 | obs.test/night/order | 
runtime_marker:night/order/service.go:8:7-8:13:channel_receive | runtime_marker | syntax_observed |  | night/order/service.go | 8:7-8:13 | obs.test/night/order | 
struct:obs.test/night/dome.Dome | struct | syntax_observed |  | night/dome/dome.go | 7:6-10:2 | obs.test/night/dome | obs.test/night
type:obs.test/spare.Box | type | syntax_observed |  | spare/box.go | 3:6-3:18 | obs.test/spare | obs.test/spare
unresolved_call:lens/glass/glass.go:10:5-10:21:dome.New | unresolved_call | syntax_observed | call_target_not_type_resolved | lens/glass/glass.go | 10:5-10:21 | obs.test/lens/glass | 
unresolved_call:lens/glass/glass.go:9:2-9:13:tick.Wait | unresolved_call | syntax_observed | call_target_not_type_resolved | lens/glass/glass.go | 9:2-9:13 | obs.test/lens/glass | 
unresolved_call:night/watch.go:11:7-11:23:dome.New | unresolved_call | syntax_observed | call_target_not_type_resolved | night/watch.go | 11:7-11:23 | obs.test/night | 
unresolved_call:night/watch.go:13:15-13:24:d.Open | unresolved_call | syntax_observed | call_target_not_type_resolved | night/watch.go | 13:15-13:24 | obs.test/night | 
unresolved_call:night/watch.go:13:26-13:40:glass.Focus | unresolved_call | syntax_observed | call_target_not_type_resolved | night/watch.go | 13:26-13:40 | obs.test/night | 
unresolved_call:night/watch.go:13:3-13:41:fmt.Println | unresolved_call | syntax_observed | call_target_not_type_resolved | night/watch.go | 13:3-13:41 | obs.test/night | 
"""),
    "workspace_edges": values("id kind complete? synthetic? reason", """
edge:calls:package:obs.test/lens/glass->unresolved_call:lens/glass/glass.go:10:5-10:21:dome.New | calls | false | true | target_symbol_not_type_resolved
edge:calls:package:obs.test/lens/glass->unresolved_call:lens/glass/glass.go:9:2-9:13:tick.Wait | calls | false | true | target_symbol_not_type_resolved
edge:calls:package:obs.test/night->unresolved_call:night/watch.go:11:7-11:23:dome.New | calls | false | true | target_symbol_not_type_resolved
edge:calls:package:obs.test/night->unresolved_call:night/watch.go:13:15-13:24:d.Open | calls | false | true | target_symbol_not_type_resolved
edge:calls:package:obs.test/night->unresolved_call:night/watch.go:13:26-13:40:glass.Focus | calls | false | true | target_symbol_not_type_resolved
edge:calls:package:obs.test/night->unresolved_call:night/watch.go:13:3-13:41:fmt.Println | calls | false | true | target_symbol_not_type_resolved
edge:contains:package:obs.test/lens/glass->file:lens/glass/glass.go | contains | true | false | 
edge:contains:package:obs.test/night->file:night/watch.go | contains | true | false | 
edge:contains:package:obs.test/night/dome->file:night/dome/dome.go | contains | true | false | 
edge:contains:package:obs.test/night/order->file:night/order/service.go | contains | true | false | 
edge:contains:package:obs.test/spare->file:spare/box.go | contains | true | false | 
edge:contains:struct:obs.test/night/dome.Dome->field:obs.test/night/dome.Dome.Azimuth | contains | true | false | 
edge:contains:struct:obs.test/night/dome.Dome->field:obs.test/night/dome.Dome.Side | contains | true | false | 
edge:contains_runtime_marker:file:night/order/service.go->runtime_marker:night/order/service.go:4:2-4:19:defer_statement | contains_runtime_marker | true | false | 
edge:contains_runtime_marker:file:night/order/service.go->runtime_marker:night/order/service.go:5:2-9:3:select_statement | contains_runtime_marker | true | false | 
edge:contains_runtime_marker:file:night/order/service.go->runtime_marker:night/order/service.go:6:12-6:19:channel_receive | contains_runtime_marker | true | false | 
edge:contains_runtime_marker:file:night/order/service.go->runtime_marker:night/order/service.go:8:7-8:13:channel_receive | contains_runtime_marker | true | false | 
edge:declares:package:obs.test/lens/glass->function:obs.test/lens/glass.Focus | declares | true | false | 
edge:declares:package:obs.test/night->function:obs.test/night.Watch | declares | true | false | 
edge:declares:package:obs.test/night/dome->function:obs.test/night/dome.New | declares | true | false | 
edge:declares:package:obs.test/night/dome->interface:obs.test/night/dome.Shutter | declares | true | false | 
edge:declares:package:obs.test/night/dome->method:obs.test/night/dome.*Dome.Open | declares | true | false | 
edge:declares:package:obs.test/night/dome->struct:obs.test/night/dome.Dome | declares | true | false | 
edge:declares:package:obs.test/night/order->function:obs.test/night/order.Queue | declares | true | false | 
edge:declares:package:obs.test/spare->type:obs.test/spare.Box | declares | true | false | 
edge:depends_on:module:obs.test/night->module:obs.test/lens | depends_on | true | false | 
edge:depends_on:module:obs.test/night->placeholder:module:far.test/clock | depends_on | false | true | required_module_not_present_in_workspace
edge:imports:package:obs.test/lens/glass->package:obs.test/night/dome | imports | true | false | placeholder_reconciled_to_real_package
edge:imports:package:obs.test/lens/glass->placeholder:package:far.test/clock/tick | imports | false | true | import_target_not_parsed_or_loaded
edge:imports:package:obs.test/night->package:fmt | imports | true | false | 
edge:imports:package:obs.test/night->package:obs.test/lens/glass | imports | true | false | 
edge:imports:package:obs.test/night->package:obs.test/night/dome | imports | true | false | 
edge:violates:policy_result:glass_alone:edge:imports:package:obs.test/lens/glass->package:obs.test/night/dome | violates | true | false | obs.test/lens/glass imports denied package obs.test/night/dome
"""),
    "workspace_records": values("id kind path sourceHash reason", """
source_record:config:night/factloom.config.json | config | night/factloom.config.json | ef7db01ef9635297 | config_file
source_record:go_file:lens/glass/glass.go | go_file | lens/glass/glass.go | e0cb0b47b21b883a | workspace_scan
source_record:go_file:night/dome/dome.go | go_file | night/dome/dome.go | 8d822d0123210d13 | workspace_scan
source_record:go_file:night/dome/torn.go | go_file | night/dome/torn.go | a6886c41a7f29020 | workspace_scan
source_record:go_file:night/order/service.go | go_file | night/order/service.go | 757da606968c0bc4 | workspace_scan
source_record:go_file:night/watch.go | go_file | night/watch.go | 2e890c92e07a6c55 | workspace_scan
source_record:go_file:spare/box.go | go_file | spare/box.go | 5adde2dc5bc1a59c | workspace_scan
source_record:go_mod:lens/go.mod | go_mod | lens/go.mod | 6e12aa37dfc3c7c6 | workspace_scan
source_record:go_mod:night/go.mod | go_mod | night/go.mod | 8d397ff1d739aad2 | workspace_scan
source_record:go_mod:spare/go.mod | go_mod | spare/go.mod | e2a9e8ec484d7611 | workspace_scan
source_record:go_work:go.work | go_work | go.work | ee64cc364e321b29 | go_work_file
source_record:module_discovery:lens | module_discovery | lens |  | go_work_use,workspace_scan
source_record:module_discovery:night | module_discovery | night |  | entry_module,go_work_use,workspace_scan
source_record:module_discovery:spare | module_discovery | spare |  | workspace_scan
source_record:project_root:night | project_root | night |  | nearest_go_mod
source_record:user_entry:night | user_entry | night |  | entry_path
source_record:workspace_root:. | workspace_root | . |  | workspace_root
"""),
    "workspace_freshness": values("factId oldHash newHash status reason", """
file:night/order/service.go | 757da606968c0bc4 | 4ce8165289b0bc80 | superseded | simulated_changed_content_requires_reindex
source_record:config:night/factloom.config.json |  | ef7db01ef9635297 | fresh | source_discovered
source_record:go_file:lens/glass/glass.go |  | e0cb0b47b21b883a | fresh | source_discovered
source_record:go_file:night/dome/dome.go |  | 8d822d0123210d13 | fresh | source_discovered
source_record:go_file:night/dome/torn.go |  | a6886c41a7f29020 | fresh | source_discovered
source_record:go_file:night/order/service.go |  | 757da606968c0bc4 | fresh | source_discovered
source_record:go_file:night/watch.go |  | 2e890c92e07a6c55 | fresh | source_discovered
source_record:go_file:spare/box.go |  | 5adde2dc5bc1a59c | fresh | source_discovered
source_record:go_mod:lens/go.mod |  | 6e12aa37dfc3c7c6 | fresh | source_discovered
source_record:go_mod:night/go.mod |  | 8d397ff1d739aad2 | fresh | source_discovered
source_record:go_mod:spare/go.mod |  | e2a9e8ec484d7611 | fresh | source_discovered
source_record:go_work:go.work |  | ee64cc364e321b29 | fresh | source_discovered
source_record:module_discovery:lens |  |  | fresh | source_discovered
source_record:module_discovery:night |  |  | fresh | source_discovered
source_record:module_discovery:spare |  |  | fresh | source_discovered
source_record:project_root:night |  |  | fresh | source_discovered
source_record:user_entry:night |  |  | fresh | source_discovered
source_record:workspace_root:. |  |  | fresh | source_discovered
"""),
    "workspace_diagnostics": values("level source reason stage status", """
error | night/dome/torn.go | (3, 10): bracket is not closed |  | 
error | policy:obs.test/lens/glass | policy_violation: obs.test/lens/glass imports denied package obs.test/night/dome | policy_evaluation | fail
warning | lens/go.mod | local replace path has no go.mod: mount |  | 
warning | metric:obs.test/night/dome | cyclomatic complexity 4 exceeds threshold 3 | complexity_metrics | warning
warning | policy:obs.test/lens/glass | policy_unknown: import target incomplete for far.test/clock/tick | policy_evaluation | unknown
"""),
    "workspace_runs": values("stage analyzerId status emittedFacts# diagnostics", """
base_graph_assembly | indexer.base_graph_assembly | completed | 72 | 
complexity_metrics | complexity | partial | 16 | metric:obs.test/night/dome: cyclomatic complexity 4 exceeds threshold 3
ddd_classification | bridge_symbol | completed | 3 | 
ddd_classification | language_zone_candidate | completed | 5 | 
ddd_classification | ubiquitous_language | completed | 23 | 
ddd_classification | vocabulary_cooccurrence | completed | 43 | 
ddd_classification | vocabulary_extraction | completed | 52 | 
module_dependency_enrichment | module_dependency_enrichment | completed | 2 | 
module_extraction | indexer.module_extraction | partial | 7 | lens/go.mod: local replace path has no go.mod: mount
package_loading | indexer.package_loading | completed | 0 | 
policy_evaluation | dependency_policy | partial | 10 | policy:obs.test/lens/glass: policy_unknown: import target incomplete for far.test/clock/tick|policy:obs.test/lens/glass: policy_violation: obs.test/lens/glass imports denied package obs.test/night/dome
query_materialization | indexer.query_materialization | completed | 9 | 
source_discovery | indexer.source_discovery | completed | 28 | 
syntax_extraction | indexer.syntax_extraction | partial | 1 | night/dome/torn.go: (3, 10): bracket is not closed
"""),
    "workspace_metrics": values("subject name value# status", """
function:obs.test/lens/glass.Focus | cyclomatic_complexity | 3 | pass
function:obs.test/lens/glass.Focus | decision_count | 2 | pass
function:obs.test/lens/glass.Focus | runtime_marker_count | 0 | pass
function:obs.test/night.Watch | cyclomatic_complexity | 2 | pass
function:obs.test/night.Watch | decision_count | 1 | pass
function:obs.test/night.Watch | runtime_marker_count | 0 | pass
function:obs.test/night/dome.New | cyclomatic_complexity | 1 | pass
function:obs.test/night/dome.New | decision_count | 0 | pass
function:obs.test/night/dome.New | runtime_marker_count | 0 | pass
function:obs.test/night/order.Queue | cyclomatic_complexity | 3 | pass
function:obs.test/night/order.Queue | decision_count | 2 | pass
function:obs.test/night/order.Queue | runtime_marker_count | 3 | pass
method:obs.test/night/dome.*Dome.Open | cyclomatic_complexity | 4 | warning
method:obs.test/night/dome.*Dome.Open | decision_count | 3 | pass
method:obs.test/night/dome.*Dome.Open | runtime_marker_count | 0 | pass
package:obs.test/lens/glass | ubiquitous_language_alignment | 33 | pass
package:obs.test/night | ubiquitous_language_alignment | 50 | pass
package:obs.test/night/dome | ubiquitous_language_alignment | 14 | pass
package:obs.test/night/order | ubiquitous_language_alignment | 0 | pass
"""),
    "workspace_policy": values("ruleId subject status reason", """
glass_alone | far.test/clock/tick | unknown | import target incomplete for far.test/clock/tick
glass_alone | obs.test/night/dome | fail | obs.test/lens/glass imports denied package obs.test/night/dome
package_import:obs.test/night | fmt | pass | obs.test/night import allowed for fmt
package_import:obs.test/night | obs.test/lens/glass | pass | obs.test/night import allowed for obs.test/lens/glass
package_import:obs.test/night | obs.test/night/dome | pass | obs.test/night import allowed for obs.test/night/dome
"""),
    "workspace_queries": values("id status reason", """
query:complexity:domain:obs.test/lens/glass | unknown | complexity_analysis_incomplete
query:complexity:domain:obs.test/night | unknown | complexity_analysis_incomplete
query:complexity:package:obs.test/lens/glass | pass | all_complexity_metrics_passed
query:complexity:package:obs.test/night | pass | all_complexity_metrics_passed
query:complexity:package:obs.test/night/dome | warning | complexity_metric_warning
query:complexity:package:obs.test/night/order | pass | all_complexity_metrics_passed
query:policy:obs.test/lens/glass | fail | policy_result_failed
query:policy:obs.test/night | pass | all_policy_results_passed
"""),
    "workspace_provenance": values("section producerId producerVersion n#", """
diagnostics | complexity | 1 | 1
diagnostics | dependency_policy | 1 | 2
diagnostics | indexer.module_extraction | 1 | 1
diagnostics | indexer.syntax_extraction | 1 | 1
edges | dependency_policy | 1 | 1
edges | indexer.base_graph_assembly | 1 | 32
metrics | complexity | 1 | 15
metrics | ubiquitous_language | 1 | 4
nodes | indexer.base_graph_assembly | 1 | 40
observations | bridge_symbol | 1 | 3
observations | language_zone_candidate | 1 | 5
observations | vocabulary_cooccurrence | 1 | 43
observations | vocabulary_extraction | 1 | 52
policyResults | dependency_policy | 1 | 5
queries | indexer.query_materialization | 1 | 8
"""),
    "analyzer_contracts": values("place# id stage inputs emits needs leastTrust mostTrust onIncomplete findings#", """
0 | module_dependency_enrichment | module_dependency_enrichment | module|depends_on|diagnostic | label|warning |  | syntax_observed | syntax_observed | allow | 0
1 | vocabulary_extraction | ddd_classification | package|file|type|interface|struct|function|method|field|import|unresolved_call|imports|depends_on | observation |  | syntax_observed | type_resolved | allow | 0
2 | vocabulary_cooccurrence | ddd_classification | observation | observation | vocabulary_extraction | syntax_observed | type_resolved | allow | 0
3 | language_zone_candidate | ddd_classification | observation|package | observation | vocabulary_extraction|vocabulary_cooccurrence | syntax_observed | type_resolved | allow | 0
4 | bridge_symbol | ddd_classification | observation|imports|depends_on | observation | language_zone_candidate | syntax_observed | type_resolved | allow | 0
5 | ubiquitous_language | ddd_classification | module|package|function|method|type|interface|struct|field | label|metric|warning |  | syntax_observed | type_resolved | require_complete | 0
6 | complexity | complexity_metrics | function|method | metric|diagnostic |  | syntax_observed | syntax_observed | require_complete | 0
7 | dependency_policy | policy_evaluation | package|imports | policy_result|warning|edge|diagnostic |  | syntax_observed | syntax_observed | allow | 0
"""),
    "value_catalogue": values("category value", """
analyzerIds | bridge_symbol
analyzerIds | complexity
analyzerIds | dependency_policy
analyzerIds | language_zone_candidate
analyzerIds | module_dependency_enrichment
analyzerIds | ubiquitous_language
analyzerIds | vocabulary_cooccurrence
analyzerIds | vocabulary_extraction
edgeKinds | calls
edgeKinds | contains
edgeKinds | contains_runtime_marker
edgeKinds | declares
edgeKinds | depends_on
edgeKinds | imports
edgeKinds | violates
factKinds | diagnostic
factKinds | edge
factKinds | label
factKinds | metric
factKinds | observation
factKinds | policy_result
factKinds | warning
freshnessStatuses | fresh
freshnessStatuses | invalidated
freshnessStatuses | stale
freshnessStatuses | superseded
nodeKinds | field
nodeKinds | file
nodeKinds | function
nodeKinds | import
nodeKinds | interface
nodeKinds | method
nodeKinds | module
nodeKinds | package
nodeKinds | placeholder
nodeKinds | runtime_marker
nodeKinds | struct
nodeKinds | type
nodeKinds | unresolved_call
observationNames | vocabulary.bridge_symbol
observationNames | vocabulary.cooccurrence
observationNames | vocabulary.incomplete_dependency
observationNames | vocabulary.language_zone_candidate
observationNames | vocabulary.term
observationSources | configured
observationSources | imported
observationSources | inferred
observationSources | observed
sections | diagnostics
sections | edges
sections | freshness
sections | labels
sections | metrics
sections | nodes
sections | observations
sections | pathJobs
sections | policyResults
sections | queries
sections | runs
sections | sourceRecords
sections | warnings
statuses | analysis_error
statuses | completed
statuses | fail
statuses | partial
statuses | pass
statuses | unknown
statuses | warning
trustLevels | package_loaded
trustLevels | syntax_observed
trustLevels | type_resolved
"""),
}
