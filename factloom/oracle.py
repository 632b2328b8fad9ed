"""The registered queries in SQL over the same tables, written apart from the engine."""

from __future__ import annotations

from .oracle_plans import PLANS

RANK = lambda c: f"(CASE {c} WHEN 'syntax_observed' THEN 1 WHEN 'package_loaded' THEN 2 WHEN 'type_resolved' THEN 3 ELSE 0 END)"
TRUST = lambda r: f"(CASE {r} WHEN 1 THEN 'syntax_observed' WHEN 2 THEN 'package_loaded' WHEN 3 THEN 'type_resolved' ELSE '' END)"
INCOMPLETE = "(NOT complete OR synthetic OR starts_with(\"to\", 'placeholder:'))"
GHOST = "(synthetic OR kind = 'placeholder' OR starts_with(id, 'placeholder:'))"


def words(e: str) -> str:
    spaced = f"regexp_replace(regexp_replace({e}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({spaced}, '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: lower(x)), lambda x: x <> '')"


def after(c: str, *prefixes: str) -> str:
    return "(CASE " + " ".join(f"WHEN starts_with({c}, '{p}') THEN substr({c}, {len(p) + 1})" for p in prefixes) + " ELSE '' END)"


def seq(values: list[str], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{index}]"


PKG, MOD = ("package:", "placeholder:package:"), ("module:", "placeholder:module:")
DIGEST = lambda c, n: f"md5(array_to_string({c}, '|')) AS {n}"

FACTS = f"""
packages AS (
  SELECT n_nationkey, r_name AS module, r_name || '/' || n_name AS pkg, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000) AS real
  FROM nation JOIN region ON n_regionkey = r_regionkey
), symbols0 AS (
  SELECT *, lower(p_name[1]) || substr(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ''), 2) || upper(p_type[1]) || lower(p_type[2:]) AS camel,
    {seq(["method", "struct", "interface", "type", "field", "function"], "p_size % 6 + 1")} AS kind
  FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS sk FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
  JOIN supplier ON s_suppkey = sk JOIN packages ON s_nationkey = n_nationkey
), symbols1 AS (
  SELECT *, CASE WHEN p_size % 7 = 0 THEN 'HTTP' || upper(p_name[1]) || substr(camel, 2) ELSE camel END AS name FROM symbols0
), symbols AS (
  SELECT kind || ':' || pkg || '.' || name || '_' || p_partkey AS id, kind, name, pkg, module, p_partkey, pkg || '/supplier_' || sk || '.go' AS file,
    (p_partkey % 500 + 1) || ':1-' || (p_partkey % 500 + 1 + p_size) || ':2' AS lineRange FROM symbols1
), nodes AS (
  SELECT 'module:' || r_name AS id, 'module' AS kind, r_name AS name, 'syntax_observed' AS trustLevel, false AS synthetic, '' AS reason, r_name || '/go.mod' AS sourceFile, '' AS lineRange, '' AS packagePath, r_name AS modulePath FROM region
  UNION ALL SELECT 'package:' || pkg, 'package', pkg, {seq(["type_resolved", "package_loaded", "syntax_observed"], "n_nationkey % 3 + 1")}, false, '', pkg || '/doc.go', '1:1-3:1', pkg, module FROM packages WHERE real
  UNION ALL SELECT 'placeholder:package:' || pkg, 'placeholder', pkg, 'syntax_observed', true, 'imported_package_outside_known_workspace', '', '', pkg, '' FROM packages WHERE NOT real
  UNION ALL SELECT 'file:' || pkg || '/supplier_' || s_suppkey || '.go', 'file', pkg || '/supplier_' || s_suppkey || '.go', 'syntax_observed', false, '', pkg || '/supplier_' || s_suppkey || '.go', '1:1-600:1', pkg, module FROM supplier JOIN packages ON s_nationkey = n_nationkey
  UNION ALL SELECT id, kind, name, 'syntax_observed', false, '', file, lineRange, pkg, module FROM symbols
), trade AS (
  SELECT DISTINCT a.pkg AS ap, a.module AS am, a.real AS ar, b.pkg AS bp, b.module AS bm, b.real AS br
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN packages a ON a.n_nationkey = s_nationkey JOIN packages b ON b.n_nationkey = c_nationkey
), ends AS (
  SELECT 'imports' AS kind, 'package:' || ap AS "from", CASE WHEN br THEN 'package:' ELSE 'placeholder:package:' END || bp AS "to", br AS complete, CASE WHEN br THEN '' ELSE 'imported_package_outside_known_workspace' END AS reason, ap || '/import.go' AS sourceFile FROM trade WHERE ar
  UNION ALL SELECT DISTINCT 'depends_on', 'module:' || am, CASE WHEN bm = 'MIDDLE EAST' THEN 'placeholder:module:' ELSE 'module:' END || bm, bm <> 'MIDDLE EAST', CASE WHEN bm = 'MIDDLE EAST' THEN 'required_module_not_present_in_workspace' ELSE '' END, am || '/go.mod' FROM trade WHERE am <> bm
  UNION ALL SELECT 'contains', 'package:' || pkg, 'file:' || pkg || '/supplier_' || s_suppkey || '.go', true, '', pkg || '/supplier_' || s_suppkey || '.go' FROM supplier JOIN packages ON s_nationkey = n_nationkey WHERE real
  UNION ALL SELECT 'declares', 'file:' || file, id, true, '', file FROM symbols
), edges AS (
  SELECT 'edge:' || kind || ':' || "from" || '->' || "to" AS id, *, 'syntax_observed' AS trustLevel, false AS synthetic, '1:1-1:9' AS lineRange FROM ends
), diagnostics0 AS (
  SELECT 'go/packages:' || pkg AS source, {seq(["import cycle not allowed: ", "no required module provides package ", "missing go.sum entry for ", "syntax error near "], "c_custkey % 4 + 1")} || c_name AS reason,
    {seq(["import_cycle", "missing_dependency", "missing_dependency", "package_loading_diagnostic"], "c_custkey % 4 + 1")} AS status FROM customer JOIN packages ON c_nationkey = n_nationkey WHERE c_acctbal < -900
), diagnostics AS (
  SELECT CASE WHEN status = 'import_cycle' THEN 'error' ELSE 'warning' END AS level, * FROM diagnostics0
), decisions AS (
  SELECT s.file AS sourceFile, s.id AS functionId, unnest(list_filter([CASE WHEN l_returnflag = 'R' THEN 'if' END, CASE WHEN l_discount > 0.05 THEN 'case' END, CASE WHEN l_linestatus = 'O' THEN 'boolean' END,
    CASE WHEN l_quantity > 45 THEN 'goto' END, CASE WHEN l_linenumber = 1 THEN 'go' END, CASE WHEN l_linenumber = 2 THEN 'defer' END], lambda x: x IS NOT NULL)) AS kind
  FROM lineitem JOIN symbols s ON l_partkey = p_partkey WHERE s.kind IN ('function', 'method')
), named AS (
  SELECT *, CASE WHEN kind = 'file' AND sourceFile <> '' THEN regexp_replace(regexp_extract(sourceFile, '([^/]*)$', 1), '\\.[^.]*$', '') ELSE name END AS original
  FROM nodes WHERE NOT {GHOST} AND kind IN ('package', 'file', 'type', 'interface', 'struct', 'function', 'method', 'field', 'import', 'unresolved_call')
), terms0 AS (
  SELECT *, unnest({words("original")}) AS token, unnest(range(len({words("original")}))) AS idx FROM named
), terms AS (
  SELECT 'observation:vocabulary:' || sha256('term' || chr(0) || id || chr(0) || idx || chr(0) || token) AS id, token AS value, id AS targetId, trustLevel, original, idx::VARCHAR AS tokenIndex, kind AS nodeKind, packagePath, modulePath, sourceFile FROM terms0
), gaps AS (
  SELECT 'observation:vocabulary:' || sha256('incomplete_dependency' || chr(0) || id) AS id, "to" AS value, id AS targetId, "from" AS source, kind AS edgeKind, reason, trustLevel, sourceFile FROM edges WHERE kind IN ('imports', 'depends_on') AND {INCOMPLETE}
), pairs AS (
  SELECT 'observation:vocabulary_cooccurrence:' || sha256(a.packagePath || chr(0) || a.value || chr(0) || b.value) AS id, a.value || ' ' || b.value AS value, a.packagePath AS packagePath, a.value AS termA, b.value AS termB, count(*) AS n,
    {TRUST(f"min(least({RANK('a.trustLevel')}, {RANK('b.trustLevel')}))")} AS trustLevel, list_sort(list_distinct(list(a.id) || list(b.id))) AS evidence
  FROM terms a JOIN terms b ON a.targetId = b.targetId AND a.packagePath = b.packagePath AND a.value < b.value WHERE a.packagePath <> '' GROUP BY a.packagePath, a.value, b.value
), stops AS (
  SELECT unnest(['com', 'example', 'github', 'gitlab', 'go', 'internal', 'io', 'net', 'org', 'testdata', 'workspace']) AS t
), hints AS (
  SELECT packagePath AS pkg, [value] AS ts, 0 AS n, id, {RANK("trustLevel")} AS rank FROM terms WHERE packagePath <> '' AND value NOT IN (SELECT t FROM stops)
  UNION ALL SELECT packagePath, [termA, termB], n, id, {RANK("trustLevel")} FROM pairs WHERE termA NOT IN (SELECT t FROM stops) AND termB NOT IN (SELECT t FROM stops)
), realp AS (
  SELECT packagePath, min(id) AS nodeId FROM nodes WHERE kind = 'package' AND NOT {GHOST} GROUP BY 1
), zones AS (
  SELECT pkg, list_sort(list_distinct(flatten(list(ts)))) AS ts, sum(n)::BIGINT AS n, list_sort(list_distinct(list(id))) AS evidence, {TRUST("min(rank)")} AS trustLevel FROM hints
  WHERE pkg NOT IN (SELECT packagePath FROM nodes WHERE {GHOST} AND packagePath NOT IN (SELECT packagePath FROM realp)) GROUP BY 1
), candidates AS (
  SELECT 'observation:language_zone_candidate:' || sha256(pkg || chr(0) || array_to_string(ts, chr(0))) AS id, pkg, ts, n, evidence, trustLevel, coalesce(nodeId, '') AS targetId
  FROM zones LEFT JOIN realp ON pkg = packagePath WHERE n > 0 AND len(ts) >= 2
), bridges AS (
  SELECT 'observation:bridge_symbol:' || sha256(e.id || chr(0) || a.pkg || chr(0) || b.pkg) AS id, a.pkg || ' -> ' || b.pkg AS value, e.id AS targetId, a.pkg AS fp, b.pkg AS tp, e.kind AS edgeKind,
    {TRUST(f"least({RANK('e.trustLevel')}, {RANK('a.trustLevel')}, {RANK('b.trustLevel')})")} AS trustLevel, list_sort([e.id, a.id, b.id]) AS evidence
  FROM edges e JOIN candidates a ON e."from" = 'package:' || a.pkg JOIN candidates b ON e."to" = 'package:' || b.pkg WHERE e.kind IN ('imports', 'depends_on') AND e.complete AND a.pkg <> b.pkg
), observations AS (
  SELECT id, 'vocabulary.term' AS name, value, targetId, packagePath, '' AS fp, '' AS tp, '' AS source, modulePath, sourceFile, trustLevel FROM terms
  UNION ALL SELECT id, 'vocabulary.incomplete_dependency', value, targetId, '', '', '', source, '', sourceFile, trustLevel FROM gaps
  UNION ALL SELECT id, 'vocabulary.cooccurrence', value, '', packagePath, '', '', '', '', '', trustLevel FROM pairs
  UNION ALL SELECT id, 'vocabulary.language_zone_candidate', array_to_string(ts, ' '), targetId, pkg, '', '', '', '', '', trustLevel FROM candidates
  UNION ALL SELECT id, 'vocabulary.bridge_symbol', value, targetId, '', fp, tp, '', '', '', trustLevel FROM bridges
), counted AS (
  SELECT functionId, count(*) FILTER (kind IN ('if', 'case', 'boolean', 'goto')) AS d, count(*) FILTER (kind IN ('go', 'defer')) AS m FROM decisions GROUP BY 1
), measured AS (
  SELECT n.*, coalesce(d, 0) AS d, coalesce(m, 0) AS m FROM nodes n LEFT JOIN counted ON n.id = functionId WHERE kind IN ('function', 'method') AND NOT ends_with(sourceFile, 'supplier_7.go')
), cyclo AS (
  SELECT 'metric:cyclomatic_complexity:' || id AS id, d + 1 AS value, packagePath AS scope, id AS subject, CASE WHEN d + 1 > 24 THEN 'warning' ELSE 'pass' END AS status, 24::BIGINT AS threshold,
    'cyclomatic complexity ' || (d + 1) || CASE WHEN d + 1 > 24 THEN ' exceeds' ELSE ' is within' END || ' threshold 24' AS reason, sourceFile FROM measured
), lost AS (
  SELECT DISTINCT sourceFile FROM nodes WHERE kind IN ('function', 'method') AND ends_with(sourceFile, 'supplier_7.go')
), rules AS (
  SELECT * FROM (VALUES ('package_import:ASIA/NATION_2', 'imports', 'ASIA/NATION_2', ['ASIA/NATION_7', 'ASIA/NATION_12', 'EUROPE/NATION_3'], []::VARCHAR[]), ('no_africa', 'imports', 'EUROPE/NATION_3', [], ['AFRICA/NATION_0', 'AFRICA/NATION_5']),
    ('package_import:AMERICA/NATION_1', 'imports', 'AMERICA/NATION_1', ['AMERICA/NATION_6', 'ASIA/NATION_2'], ['ASIA/NATION_2']), ('package_import:AFRICA/NATION_5', 'imports', 'AFRICA/NATION_5', [], []),
    ('module_dependency:EUROPE', 'depends_on', 'EUROPE', ['ASIA', 'AFRICA'], []), ('asia_alone', 'depends_on', 'ASIA', [], ['AMERICA'])) AS t(rule, k, own, allow, deny)
), checked AS (
  SELECT 'policy_result:' || rule || ':' || id AS id, rule AS ruleId, own AS scope, regexp_replace("to", '^(placeholder:)?(package|module):', '') AS subject, id AS edgeId, "from" AS ef, "to" AS et, complete, trustLevel, k = 'imports' AS imp, allow, deny, NOT complete AS open
  FROM edges JOIN rules ON kind = k AND "from" = (CASE k WHEN 'imports' THEN 'package:' ELSE 'module:' END) || own
), results AS (
  SELECT id, ruleId, CASE WHEN open THEN 'unknown' WHEN list_contains(deny, subject) OR (len(allow) > 0 AND NOT list_contains(allow, subject)) THEN 'fail' ELSE 'pass' END AS status, scope, subject,
    CASE WHEN open THEN CASE WHEN imp THEN 'import target incomplete for ' ELSE 'module dependency target incomplete for ' END || subject
      WHEN list_contains(deny, subject) THEN scope || CASE WHEN imp THEN ' imports denied package ' ELSE ' depends on denied module ' END || subject
      WHEN len(allow) > 0 AND NOT list_contains(allow, subject) THEN scope || CASE WHEN imp THEN ' imports package outside allow list ' ELSE ' depends on module outside allow list ' END || subject
      ELSE scope || CASE WHEN imp THEN ' import allowed for ' ELSE ' module dependency allowed for ' END || subject END AS reason, [edgeId] AS evidence, trustLevel, edgeId, ef, et, complete FROM checked
  UNION ALL SELECT 'policy_result:package_loading:' || status || ':' || sha256(source || ':' || reason), 'package_loading:' || status, CASE WHEN status = 'import_cycle' THEN 'fail' ELSE 'unknown' END, substr(source, 13), source,
    CASE WHEN status = 'import_cycle' THEN 'import cycle detected: ' ELSE 'missing dependency: ' END || reason, [source || ':' || reason], 'syntax_observed', '', '', '', false FROM diagnostics WHERE status <> 'package_loading_diagnostic'
), pwarnings AS (
  SELECT 'warning:' || id AS id, CASE WHEN status = 'unknown' THEN 'policy_unknown: ' ELSE 'policy_violation: ' END || reason AS reason, edgeId AS affectedEdgeId, CASE WHEN edgeId <> '' THEN [id, edgeId] ELSE [id] END AS evidence,
    CASE WHEN status = 'unknown' THEN 'Resolve incomplete analysis evidence before treating this policy result as pass or fail.' ELSE 'Update the code dependency or adjust the configured policy rule.' END AS suggestedNextAction FROM results WHERE status <> 'pass'
), pqueries AS (
  SELECT 'query:policy:' || scope AS id, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'unknown') THEN 'unknown' ELSE 'pass' END AS status,
    CASE WHEN bool_or(status = 'fail') THEN 'policy_result_failed' WHEN bool_or(status = 'unknown') THEN 'policy_result_unknown' ELSE 'all_policy_results_passed' END AS reason,
    {TRUST(f"least(2, min({RANK('trustLevel')}))")} AS actualTrustLevel, list_sort(list(id)) AS evidence FROM results WHERE scope <> '' GROUP BY scope
), members AS (
  SELECT 'package' AS mode, packagePath AS scope, packagePath AS member FROM (SELECT packagePath FROM nodes WHERE kind IN ('function', 'method') UNION SELECT scope FROM cyclo)
  UNION SELECT 'domain', substr("from", 9), substr("from", 9) FROM edges WHERE kind = 'imports' UNION SELECT 'domain', substr("from", 9), substr("to", 9) FROM edges WHERE kind = 'imports' AND starts_with("to", 'package:')
), held AS (
  SELECT mode, m.scope, list_sort(list(id)) AS ev, bool_or(status = 'warning') AS warned FROM members m JOIN cyclo c ON c.scope = m.member GROUP BY 1, 2
), missing AS (
  SELECT mode, scope, 'missing_complexity_metric:' || id AS g FROM members JOIN nodes ON packagePath = member WHERE kind IN ('function', 'method') AND id NOT IN (SELECT subject FROM cyclo)
  UNION ALL SELECT * FROM (SELECT DISTINCT mode, scope, 'complexity_analysis_error:' || sourceFile FROM members JOIN nodes ON packagePath = member WHERE sourceFile IN (SELECT sourceFile FROM lost))
  UNION ALL SELECT 'domain', substr("from", 9), CASE WHEN complete THEN 'unresolved_import_scope:' || "to" ELSE 'incomplete_import_scope:' || id END FROM edges WHERE kind = 'imports' AND (NOT complete OR "to" NOT IN (SELECT id FROM nodes))
), cqueries AS (
  SELECT 'query:complexity:' || mode || ':' || scope AS id, mode, CASE WHEN gs IS NOT NULL OR ev IS NULL THEN 'unknown' WHEN warned THEN 'warning' ELSE 'pass' END AS status,
    CASE WHEN gs IS NOT NULL THEN 'complexity_analysis_incomplete' WHEN ev IS NULL THEN 'no_complexity_metrics_for_scope' WHEN warned THEN 'complexity_metric_warning' ELSE 'all_complexity_metrics_passed' END AS reason,
    CASE WHEN gs IS NULL AND ev IS NULL THEN ['complexity_metrics_missing_for_scope'] ELSE coalesce(ev, []) || coalesce(gs, []) END AS evidence
  FROM (SELECT DISTINCT mode, scope FROM members) LEFT JOIN held USING (mode, scope) LEFT JOIN (SELECT mode, scope, list_sort(list(g)) AS gs FROM missing GROUP BY 1, 2) USING (mode, scope)
), contexts AS (
  SELECT * FROM (VALUES (0, 'gold', 'ASIA', ['ring', 'gold', 'widget', 'economy'], ['little', 'red']), (0, 'gold', 'EUROPE/NATION_3', ['ring', 'gold', 'widget', 'economy'], ['little', 'red']),
    (1, 'west', 'AMERICA', ['ring', 'standard', 'nation'], ['promo']), (1, 'west', 'EUROPE', ['ring', 'standard', 'nation'], ['promo']), (2, 'late', 'EUROPE', ['x'], [])) AS t(pos, ctx, prefix, known, bad)
), placed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(prefix) DESC, pos) AS rn FROM nodes JOIN contexts ON packagePath = prefix OR starts_with(packagePath, prefix || '/') WHERE kind = 'package' AND NOT {GHOST}) WHERE rn = 1
), spoken AS (
  SELECT id AS pkg, 0 AS turn, id AS nodeId, packagePath AS w FROM placed UNION ALL
  SELECT p.id, 1, n.id, n.name FROM placed p JOIN nodes n ON p.packagePath = n.packagePath AND n.kind IN ('module', 'function', 'method', 'type', 'interface', 'struct', 'field')
), said0 AS (
  SELECT pkg, turn, nodeId, unnest({words("w")}) AS raw FROM spoken
), said AS (
  SELECT s.pkg, ctx, packagePath, trustLevel, turn, nodeId, known, bad, CASE WHEN ctx = 'gold' AND raw = 'small' THEN 'little' ELSE raw END AS term FROM said0 s JOIN placed p ON p.id = s.pkg
), classed AS (
  SELECT pkg, ctx, packagePath, trustLevel, term, CASE WHEN list_contains(bad, term) THEN 'discouraged' WHEN list_contains(known, term) THEN 'recognized' ELSE 'unknown' END AS class, arg_max(nodeId, (turn, nodeId)) AS nodeId
  FROM said WHERE term NOT IN ('asia', 'europe', 'america') GROUP BY ALL
), pkgmod AS (
  SELECT packagePath, arg_min(modulePath, id) AS modulePath FROM nodes WHERE packagePath <> '' AND modulePath <> '' GROUP BY 1
), impx AS (
  SELECT *, {after('"from"', *PKG)} AS fp, {after('"to"', *PKG)} AS tp, {INCOMPLETE} AS open FROM edges WHERE kind = 'imports'
), imp AS (
  SELECT x.*, coalesce(a.modulePath, '') AS fm, coalesce(b.modulePath, '') AS tm FROM impx x LEFT JOIN pkgmod a ON a.packagePath = fp LEFT JOIN pkgmod b ON b.packagePath = tp
), obs AS (
  SELECT o.*, coalesce(a.modulePath, '') AS fm, coalesce(b.modulePath, '') AS tm, coalesce(c.modulePath, '') AS pm FROM (SELECT *, CASE WHEN packagePath <> '' THEN packagePath WHEN fp <> '' THEN fp WHEN {after("source", *PKG)} <> '' THEN {after("source", *PKG)} ELSE {after("targetId", *PKG)} END AS pkg FROM observations) o
  LEFT JOIN pkgmod a ON a.packagePath = fp LEFT JOIN pkgmod b ON b.packagePath = tp LEFT JOIN pkgmod c ON c.packagePath = pkg
), deps AS (
  SELECT {after('"from"', *MOD)} AS fm, {after('"to"', *MOD)} AS tm, starts_with("to", 'placeholder:') AS ghost FROM edges WHERE kind = 'depends_on'
)
"""

_PSTAT = """
k AS (
  SELECT packagePath AS key, kind FROM {nodes} WHERE kind IN ('package', 'file', 'function', 'method', 'type', 'struct', 'interface', 'import')
  UNION ALL SELECT fp, 'open' FROM {imp} WHERE open AND fp <> '' UNION ALL SELECT pkg, 'obs' FROM {obs} WHERE pkg <> '' UNION ALL SELECT pkg, 'cand' FROM {obs} WHERE pkg <> '' AND name = 'vocabulary.language_zone_candidate'
  UNION ALL SELECT fp, 'out' FROM {obs} WHERE fp <> '' AND name = 'vocabulary.bridge_symbol' UNION ALL SELECT tp, 'in' FROM {obs} WHERE tp <> '' AND name = 'vocabulary.bridge_symbol'
)
SELECT k.key AS packagePath, coalesce(any_value(m.mp), '') AS modulePath, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'method') AS methods, count(*) FILTER (kind = 'type') AS types,
  count(*) FILTER (kind = 'struct') AS structs, count(*) FILTER (kind = 'interface') AS interfaces, count(*) FILTER (kind = 'import') AS imports, count(*) FILTER (kind = 'open') AS incompleteImports, count(*) FILTER (kind = 'obs') AS observations,
  count(*) FILTER (kind = 'cand') AS candidates, count(*) FILTER (kind = 'in') AS bridgesIn, count(*) FILTER (kind = 'out') AS bridgesOut
FROM k LEFT JOIN (SELECT packagePath AS key, arg_min(modulePath, id) AS mp FROM {nodes} WHERE kind IN ('package', 'file') AND modulePath <> '' GROUP BY 1) m ON m.key = k.key GROUP BY k.key
"""
_SUM = """
SELECT (SELECT count(*) FROM {n} WHERE kind = 'module') AS modules, (SELECT count(*) FROM {n} WHERE kind = 'package') AS packages, (SELECT count(*) FROM {n} WHERE kind = 'file') AS files, (SELECT count(*) FROM {n} WHERE kind = 'function') AS functions,
  (SELECT count(*) FROM {n} WHERE kind = 'method') AS methods, (SELECT count(*) FROM {n} WHERE kind = 'type') AS types, (SELECT count(*) FROM {n} WHERE kind = 'struct') AS structs, (SELECT count(*) FROM {n} WHERE kind = 'interface') AS interfaces,
  (SELECT count(*) FROM {n} WHERE kind = 'field') AS fields, (SELECT count(*) FROM {n} WHERE kind = 'import') AS imports, (SELECT count(*) FROM {e}) AS edges, (SELECT count(*) FROM {o}) AS observations,
  (SELECT count(*) FROM {n} WHERE synthetic) AS placeholders, (SELECT count(*) FROM {e} WHERE NOT complete) AS incompleteEdges
"""
_P = "ASIA/NATION_2"
_SCOPED = f"""
sn AS (SELECT * FROM nodes WHERE packagePath = '{_P}'), se AS (SELECT * FROM edges WHERE {after('"from"', *PKG)} = '{_P}' OR {after('"to"', *PKG)} = '{_P}'), si AS (SELECT * FROM imp WHERE fp = '{_P}' OR tp = '{_P}'),
so AS (SELECT * FROM obs WHERE packagePath = '{_P}' OR fp = '{_P}' OR tp = '{_P}' OR contains(targetId, 'package:{_P}') OR contains(source, 'package:{_P}') OR (name = 'vocabulary.incomplete_dependency' AND contains(value, 'package:{_P}')))
"""
_OWN = lambda c: f"(CASE WHEN {after(c, *MOD)} <> '' THEN {after(c, *MOD)} ELSE coalesce((SELECT max(n.modulePath) FROM nodes n WHERE n.id = {c} AND n.modulePath <> ''), (SELECT p.modulePath FROM pkgmod p WHERE p.packagePath = {after(c, *PKG)}), '') END)"
_MODULE = f"""
owner AS (SELECT id AS k, max(modulePath) AS m FROM nodes WHERE modulePath <> '' GROUP BY 1 UNION ALL SELECT 'placeholder:package:' || packagePath, modulePath FROM pkgmod UNION ALL SELECT 'package:' || packagePath, modulePath FROM pkgmod WHERE 'package:' || packagePath NOT IN (SELECT id FROM nodes)
  UNION ALL SELECT 'placeholder:module:' || r_name, r_name FROM region),
sn AS (SELECT * FROM nodes WHERE modulePath = 'ASIA'), se AS (SELECT * FROM edges WHERE "from" IN (SELECT k FROM owner WHERE m = 'ASIA') OR "to" IN (SELECT k FROM owner WHERE m = 'ASIA')),
so AS (SELECT * FROM obs WHERE modulePath = 'ASIA' OR packagePath IN (SELECT packagePath FROM pkgmod p WHERE p.modulePath = 'ASIA') OR fm = 'ASIA' OR tm = 'ASIA' OR targetId IN (SELECT k FROM owner WHERE m = 'ASIA') OR source IN (SELECT k FROM owner WHERE m = 'ASIA')
  OR (name = 'vocabulary.incomplete_dependency' AND value IN (SELECT k FROM owner WHERE m = 'ASIA')))
"""

SQL: dict[str, str] = {
    "split_words": f"SELECT id, unnest(range(len({words('name')}))) AS idx, unnest({words('name')}) AS word FROM symbols",
    "vocabulary_terms": "SELECT id, value, targetId, trustLevel, original, tokenIndex, nodeKind, packagePath FROM terms",
    "incomplete_dependency": "SELECT id, value, targetId, source, reason FROM gaps",
    "terms_by_package": "SELECT packagePath, value AS term, count(*) AS count, array_to_string(list_sort(list_distinct(list(nodeKind))), '|') AS nodeKinds FROM terms WHERE packagePath <> '' GROUP BY 1, 2",
    "top_terms_by_package": "SELECT * FROM (SELECT packagePath, value AS term, count(*) AS count, row_number() OVER (PARTITION BY packagePath ORDER BY count(*) DESC, value) AS rank FROM terms WHERE packagePath <> '' GROUP BY 1, 2) WHERE rank <= 3",
    "spellings_by_term": "SELECT value AS term, original, count(*) AS count, row_number() OVER (PARTITION BY value ORDER BY count(*) DESC, original) AS rank FROM terms GROUP BY 1, 2",
    "observations_by_target": f"SELECT targetId, {DIGEST('list_sort(list(id))', 'observationIds')} FROM terms GROUP BY 1",
    "incomplete_deps_by_package": f"SELECT substr(source, 9) AS packagePath, {DIGEST('list_sort(list(id))', 'observationIds')} FROM gaps WHERE starts_with(source, 'package:') GROUP BY 1",
    "cooccurrence_pairs": f"SELECT id, value, packagePath, n::VARCHAR AS count, trustLevel, {DIGEST('evidence', 'evidence')} FROM pairs",
    "cooccurrences_by_package": "SELECT packagePath, termA, termB, sum(n)::BIGINT AS count FROM pairs GROUP BY 1, 2, 3",
    "top_cooccurrences": "SELECT packagePath, termA, termB, n AS count, rank FROM (SELECT *, row_number() OVER (PARTITION BY packagePath ORDER BY n DESC, termA, termB) AS rank FROM pairs) WHERE rank <= 5",
    "cooccurrences_by_term": "SELECT term, termA, termB, sum(n)::BIGINT AS count, array_to_string(list_sort(list_distinct(list(packagePath))), '|') AS packages FROM (SELECT *, unnest([termA, termB]) AS term FROM pairs) GROUP BY 1, 2, 3",
    "language_zone_candidates": f"SELECT id, targetId, CASE WHEN targetId <> '' THEN 'node' ELSE '' END AS targetKind, array_to_string(ts, ' ') AS value, len(ts)::VARCHAR AS termCount, n::VARCHAR AS cooccurrenceCount, trustLevel, {DIGEST('evidence', 'evidence')} FROM candidates",
    "bridge_symbols": "SELECT id, value, targetId, trustLevel, array_to_string(evidence, '|') AS evidence FROM bridges",
    "ubiquitous_language_labels": "SELECT 'label:ddd.context:' || id AS id, 'ddd.context' AS name, ctx AS value, id AS targetId, 'configured' AS source, id AS evidence, trustLevel FROM placed UNION ALL SELECT 'label:ul.term:' || pkg || ':' || term, 'ul.term', term, pkg, 'observed', pkg || '|context:' || ctx, trustLevel FROM classed WHERE class = 'recognized'",
    "ubiquitous_language_warnings": "SELECT 'warning:ul_' || class || '_term:' || pkg || ':' || term AS id, 'ul_' || class || '_term' AS kind, class || ' ubiquitous language term ' || term AS reason, nodeId AS affectedNodeId, pkg || '|' || nodeId AS evidence, trustLevel FROM classed WHERE class <> 'recognized'",
    "ubiquitous_language_alignment": "SELECT 'metric:ubiquitous_language_alignment:' || p.id AS id, CASE WHEN count(term) = 0 THEN 100 ELSE (count(*) FILTER (class = 'recognized') * 100) // count(term) END::BIGINT AS value, p.packagePath AS scope, 'pass' AS status, p.trustLevel FROM placed p LEFT JOIN classed c ON c.pkg = p.id GROUP BY p.id, p.packagePath, p.trustLevel",
    "cyclomatic_metrics": "SELECT id, value, scope, subject, status, threshold, reason FROM cyclo",
    "decision_counts": "SELECT 'metric:decision_count:' || id AS id, d AS value, packagePath AS scope, id AS subject, 'pass' AS status, 0::BIGINT AS threshold, 'decision count ' || d AS reason FROM measured",
    "runtime_marker_counts": "SELECT 'metric:runtime_marker_count:' || id AS id, m AS value, packagePath AS scope, id AS subject, 'pass' AS status, 0::BIGINT AS threshold, 'runtime marker count ' || m AS reason FROM measured",
    "complexity_diagnostics": "SELECT 'warning' AS level, 'metric:' || scope AS source, reason, status, subject AS nodeId, sourceFile, id AS evidence FROM cyclo WHERE status = 'warning' UNION ALL SELECT 'error', sourceFile, 'syntax snapshot missing for complexity analysis', 'analysis_error', '', sourceFile, '' FROM lost",
    "policy_results": "SELECT id, ruleId, status, scope, subject, reason, evidence[1] AS evidence, trustLevel FROM results",
    "policy_warnings": "SELECT id, reason, affectedEdgeId, array_to_string(evidence, '|') AS evidence, suggestedNextAction FROM pwarnings",
    "violates_edges": "SELECT 'edge:violates:' || id AS id, ef AS source, et AS target, complete, reason FROM results WHERE status = 'fail' AND edgeId <> ''",
    "policy_diagnostics": "SELECT CASE WHEN status = 'unknown' THEN 'warning' ELSE 'error' END AS level, 'policy:' || scope AS source, CASE WHEN status = 'unknown' THEN 'policy_unknown: ' ELSE 'policy_violation: ' END || reason AS reason, status, id AS policyResultId, edgeId FROM results WHERE status <> 'pass'",
    "module_dependency_labels": "SELECT 'label:module.dependency:' || id AS id, 'direct' AS value, id AS targetId, id AS evidence FROM edges WHERE kind = 'depends_on'",
    "missing_dependency_warnings": "SELECT 'warning:missing_dependency:' || sha256(source || ':' || reason) AS id, reason, source || ':' || reason AS evidence FROM diagnostics WHERE status = 'missing_dependency'",
    "outdated_unknown": "SELECT 'warning:outdated_module:' || sha256(id) AS id, 'outdated module check unknown because network access is disabled' AS reason, id AS affectedEdgeId, id AS evidence FROM edges WHERE kind = 'depends_on'",
    "policy_query": "SELECT id, status, reason, actualTrustLevel, CASE WHEN status = 'unknown' THEN 'unknown' ELSE 'exists' END AS proofStatus, array_to_string(evidence, '|') AS evidence FROM pqueries",
    "complexity_query_package": f"SELECT id, status, reason, 'syntax_observed' AS actualTrustLevel, CASE WHEN status = 'unknown' THEN 'unknown' ELSE 'exists' END AS proofStatus, len(evidence)::BIGINT AS n, {DIGEST('evidence', 'evidence')} FROM cqueries WHERE mode = 'package'",
    "complexity_query_domain": f"SELECT id, status, reason, 'syntax_observed' AS actualTrustLevel, CASE WHEN status = 'unknown' THEN 'unknown' ELSE 'exists' END AS proofStatus, len(evidence)::BIGINT AS n, {DIGEST('evidence', 'evidence')} FROM cqueries WHERE mode = 'domain'",
    "reconcile_placeholders": """SELECT CASE WHEN hit THEN 'edge:imports:' || "from" || '->' || substr("to", 13) ELSE id END AS id, CASE WHEN hit THEN substr("to", 13) ELSE "to" END AS target, complete OR hit AS complete, CASE WHEN hit THEN 'placeholder_reconciled_to_real_' || CASE kind WHEN 'imports' THEN 'package' ELSE 'module' END ELSE reason END AS reason
      FROM (SELECT *, kind = 'imports' AND starts_with("to", 'placeholder:package:') AND length("to") % 2 = 0 AS hit FROM edges WHERE kind = 'imports'
        UNION ALL SELECT *, false FROM edges WHERE kind = 'depends_on' AND NOT starts_with("to", 'placeholder:')
      ) UNION ALL SELECT 'edge:depends_on:' || "from" || '->' || substr("to", 13), substr("to", 13), true, 'placeholder_reconciled_to_real_module' FROM edges WHERE kind = 'depends_on' AND starts_with("to", 'placeholder:')""",
    "reconciled_nodes": "SELECT kind, count(*) AS n FROM (SELECT kind FROM nodes WHERE NOT (kind = 'placeholder' AND length(packagePath) % 2 = 0) UNION ALL SELECT 'package' FROM nodes WHERE kind = 'placeholder' AND length(packagePath) % 2 = 0) GROUP BY 1",
    "upsert_nodes": f"SELECT 'type:' || p_name AS id, arg_min(p_brand, p_partkey) AS name, {TRUST('max(p_size % 3 + 1)')} AS trustLevel, coalesce(arg_min('r' || p_size, p_partkey) FILTER (p_size % 4 = 0), '') AS reason FROM part GROUP BY p_name",
    "upsert_edges": "SELECT 'edge:calls:' || o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS reason, arg_max(o_orderstatus, o_orderkey) = 'F' AS complete FROM orders GROUP BY o_custkey",
    "trust_upgrade": """SELECT id, CASE WHEN kind = 'package' AND clean THEN 'type_resolved' WHEN kind = 'package' AND used AND trustLevel = 'syntax_observed' THEN 'package_loaded' ELSE trustLevel END AS trustLevel, CASE WHEN kind = 'package' AND clean THEN '' ELSE reason END AS reason
      FROM (SELECT *, id IN (SELECT "from" FROM imp WHERE contains(fp, 'NATION_1') GROUP BY 1 HAVING NOT bool_or(NOT starts_with("to", 'package:'))) AS clean, id IN (SELECT "to" FROM imp WHERE contains(fp, 'NATION_1') AND complete AND contains(tp, 'NATION_2')) AND id NOT IN (SELECT "from" FROM imp WHERE contains(fp, 'NATION_1') AND NOT starts_with("to", 'package:')) AS used FROM nodes WHERE kind IN ('package', 'placeholder'))""",
    "validate_dangling_refs": """SELECT 'edges' AS section, id, 'from' AS role, "from" AS ref FROM edges WHERE kind <> 'declares' AND "from" NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'edges', id, 'to', "to" FROM edges WHERE kind <> 'declares' AND "to" NOT IN (SELECT id FROM nodes)""",
    "classify_diagnostics": "SELECT source, reason, status, level FROM diagnostics",
    "source_hashes": "SELECT doc_id, sha256(coalesce(text, '')) AS \"full\", substr(sha256(coalesce(text, '')), 1, 16) AS short FROM documents",
    "freshness_ledger": "SELECT user_id::VARCHAR AS factId, old AS oldHash, event_type AS newHash, CASE WHEN old = '' THEN 'fresh' ELSE 'superseded' END AS status, event_id AS seq FROM (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS old FROM events) WHERE old <> event_type",
    "parse_line_range": "SELECT id, split_part(split_part(lineRange, '-', 1), ':', 1)::BIGINT AS startLine, split_part(split_part(lineRange, '-', 2), ':', 1)::BIGINT AS endLine FROM nodes WHERE lineRange <> ''",
    "source_block": "SELECT sourceFile, string_agg(lpad(i::VARCHAR, 4, ' ') || '  ' || line, chr(10) ORDER BY i) AS block FROM (SELECT doc_id::VARCHAR AS sourceFile, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE doc_id = 7) WHERE i BETWEEN 2 AND 5 GROUP BY 1",
    "property_sections": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "stats_summary": _SUM.format(n="nodes", e="edges", o="observations"),
    "stats_summary_in_module": "WITH+" + _MODULE + _SUM.format(n="sn", e="se", o="so"),
    "stats_summary_in_package": "WITH+" + _SCOPED + _SUM.format(n="sn", e="se", o="so"),
    "stats_modules": """WITH+ k AS (
        SELECT modulePath AS key, kind FROM nodes WHERE kind IN ('module', 'package', 'file', 'import') UNION ALL SELECT fm, 'missing' FROM deps WHERE ghost UNION ALL SELECT fm, 'on' FROM deps WHERE NOT ghost AND fm <> tm UNION ALL SELECT tm, 'by' FROM deps WHERE NOT ghost AND fm <> tm
        UNION ALL SELECT fm, 'open' FROM imp WHERE open AND fm <> '' UNION ALL SELECT fm, 'ext' FROM imp WHERE open AND fm <> '' AND tm = '' AND starts_with("to", 'placeholder:') UNION ALL SELECT fm, 'xout' FROM imp WHERE fm <> '' AND tm <> '' AND fm <> tm UNION ALL SELECT tm, 'xin' FROM imp WHERE fm <> '' AND tm <> '' AND fm <> tm
        UNION ALL SELECT pm, 'obs' FROM obs WHERE pkg <> '' AND pm <> '' UNION ALL SELECT pm, 'cand' FROM obs WHERE pkg <> '' AND pm <> '' AND name = 'vocabulary.language_zone_candidate' UNION ALL SELECT fm, 'out' FROM obs WHERE fm <> '' AND name = 'vocabulary.bridge_symbol' UNION ALL SELECT tm, 'in' FROM obs WHERE tm <> '' AND name = 'vocabulary.bridge_symbol'
      ) SELECT key AS modulePath, key AS dir, key || '/go.mod' AS sourceFile, 'go_work|replace|workspace_walk' AS discoveryReasons, count(*) FILTER (kind = 'package') AS packages, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'import') AS imports, count(*) FILTER (kind = 'open') AS incompleteImports,
        count(*) FILTER (kind = 'on') AS dependsOn, count(*) FILTER (kind = 'by') AS dependedOnBy, count(*) FILTER (kind = 'ext') AS externalDependencies, count(*) FILTER (kind = 'missing') AS missingDependencies, count(*) FILTER (kind = 'xout') AS crossModuleImportsOut, count(*) FILTER (kind = 'xin') AS crossModuleImportsIn,
        count(*) FILTER (kind = 'obs') AS observations, count(*) FILTER (kind = 'cand') AS candidates, count(*) FILTER (kind = 'in') AS bridgesIn, count(*) FILTER (kind = 'out') AS bridgesOut FROM k GROUP BY key""",
    "stats_packages": "WITH+" + _PSTAT.format(nodes="nodes", imp="imp", obs="obs"),
    "stats_packages_in_package": "WITH+" + _SCOPED.rstrip() + "," + _PSTAT.format(nodes="sn", imp="si", obs="so"),
    "stats_files": """WITH+ k AS (SELECT sourceFile AS key, kind FROM nodes WHERE kind IN ('file', 'function', 'method', 'type', 'struct', 'interface') UNION ALL SELECT sourceFile, 'obs' FROM observations WHERE sourceFile <> '')
      SELECT k.key AS sourceFile, coalesce(any_value(packagePath), '') AS packagePath, coalesce(any_value(modulePath), '') AS modulePath, count(*) FILTER (k.kind = 'function') AS functions, count(*) FILTER (k.kind = 'method') AS methods, count(*) FILTER (k.kind = 'type') AS types,
        count(*) FILTER (k.kind = 'struct') AS structs, count(*) FILTER (k.kind = 'interface') AS interfaces, count(*) FILTER (k.kind = 'obs') AS observations FROM k LEFT JOIN (SELECT * FROM nodes WHERE kind = 'file') f ON f.sourceFile = k.key GROUP BY k.key""",
    "stats_workspace": """SELECT '.' AS projectRoot, '.' AS workspaceRoot, '' AS goWorkPath, array_to_string(list_sort(list(p)), '|') AS goModFiles, 5::BIGINT AS indexedModules, true AS singleModuleScan, 3::BIGINT AS ignoredNestedGoMods,
      'single module scan: additional go.mod files were discovered under the project root but not indexed; pass --workspace-root to analyze a multi-module workspace' AS warning FROM (SELECT r_name || '/go.mod' AS p FROM region UNION ALL SELECT r_name || '/nested/go.mod' FROM region WHERE r_regionkey < 3)""",
    "module_discovery": "SELECT r_name AS modulePath, r_name AS dir, 'go_work|replace|workspace_walk' AS reasons FROM region",
    "ddd_candidates": "SELECT pkg AS packagePath, targetId, array_to_string(ts, '|') AS terms, len(ts)::BIGINT AS termCount, n AS cooccurrenceCount, len(evidence)::BIGINT AS evidenceCount, trustLevel, id AS observationId FROM candidates ORDER BY packagePath, observationId LIMIT 50",
    "ddd_bridges": "SELECT fp AS fromPackagePath, tp AS toPackagePath, edgeKind, targetId, 3::BIGINT AS evidenceCount, trustLevel, id AS observationId FROM bridges ORDER BY 1, 2, 3, 7 LIMIT 50",
    "ddd_incomplete": "SELECT source, value AS target, edgeKind, reason, targetId, 1::BIGINT AS evidenceCount, trustLevel, id AS observationId FROM gaps ORDER BY 1, 2, 3, 8 LIMIT 50",
    "problems_policy": "SELECT id, status, reason FROM results WHERE status <> 'pass' ORDER BY id LIMIT 50",
    "problems_metrics": "SELECT id, value, reason FROM cyclo WHERE status = 'warning' ORDER BY id LIMIT 50",
    "problems_warnings": "SELECT id, reason FROM pwarnings ORDER BY id LIMIT 50",
    "problems_queries": "SELECT id, status, reason FROM (SELECT id, status, reason FROM pqueries UNION ALL SELECT id, status, reason FROM cqueries) WHERE status <> 'pass' ORDER BY id LIMIT 50",
    "problems_diagnostics": "SELECT source, reason, status FROM diagnostics ORDER BY source, reason LIMIT 50",
    "graph_filter_nodes": "SELECT id, kind, name FROM nodes WHERE kind IN ('package', 'file')",
    "graph_filter_edges": "SELECT id, complete FROM edges WHERE kind = 'imports'",
    "graph_filter_observations": "SELECT id, name, value FROM observations WHERE name IN ('vocabulary.incomplete_dependency', 'vocabulary.bridge_symbol')",
    "viewer_search": "SELECT id, name FROM nodes WHERE kind = 'struct' AND contains(lower(concat_ws(' ', nullif(id, ''), nullif(name, ''), nullif(packagePath, ''), nullif(modulePath, ''), nullif(reason, ''), nullif(sourceFile, ''))), 'ringeco')",
    "viewer_code_scope": "SELECT id, lineRange FROM nodes WHERE kind IN ('function', 'method') AND packagePath = 'ASIA/NATION_2'",
    "viewer_layout": "SELECT id, kind, (20 + (dense_rank() OVER (ORDER BY kind) - 1) * 260)::BIGINT AS x, (28 + (row_number() OVER (PARTITION BY kind ORDER BY id) - 1) * 58)::BIGINT AS y FROM nodes",
    "viewer_containment": """WITH+ r AS (SELECT id, kind, sourceFile, split_part(lineRange, ':', 1)::INT AS a, split_part(split_part(lineRange, '-', 2), ':', 1)::INT AS b FROM nodes WHERE kind IN ('function', 'method', 'field', 'type'))
      SELECT o.id AS outerId, i.id AS innerId FROM r o JOIN r i ON o.sourceFile = i.sourceFile AND o.a <= i.a AND o.b >= i.b WHERE o.kind IN ('function', 'method') AND i.kind IN ('field', 'type')""",
    "viewer_suffix_match": "SELECT 'call:' || a.id AS callId, b.id AS functionId FROM nodes a JOIN nodes b ON ends_with('pkg.svc.' || a.name, '.' || b.name) WHERE a.kind = 'struct' AND b.kind IN ('function', 'method')",
    "viewer_evidence": "SELECT r.id, edgeId AS ref, e.kind FROM results r JOIN edges e ON e.id = edgeId",
    "viewer_incident_edges": "SELECT DISTINCT n.id, e.id AS edgeId FROM nodes n JOIN edges e ON n.id = e.\"from\" OR n.id = e.\"to\" WHERE n.kind IN ('package', 'module')",
    "viewer_visible_edges": "SELECT id, kind FROM edges WHERE \"from\" IN (SELECT id FROM nodes WHERE kind IN ('package', 'file')) AND \"to\" IN (SELECT id FROM nodes WHERE kind IN ('package', 'file'))",
    "viewer_summary": """SELECT 'nodes' AS tile, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'queries', (SELECT count(*) FROM pqueries) + (SELECT count(*) FROM cqueries) UNION ALL SELECT 'policyResults', count(*) FROM results UNION ALL SELECT 'metrics', 3 * count(*) FROM cyclo
      UNION ALL SELECT 'diagnostics', count(*) FROM diagnostics UNION ALL SELECT 'placeholders', count(*) FROM nodes WHERE synthetic UNION ALL SELECT 'incompleteEdges', count(*) FROM edges WHERE NOT complete UNION ALL SELECT 'metricWarnings', count(*) FROM cyclo WHERE status = 'warning'""",
    "viewer_related": "SELECT id FROM edges ORDER BY id LIMIT 8",
}


def full(body: str) -> str:
    """A query with the CTEs of all facts before it."""
    if body.startswith("WITH+"):
        return f"WITH {FACTS.rstrip()}, {body[5:].lstrip()}"
    return f"WITH {FACTS.rstrip()} {body}"


def _placed(part: str, query: str, key: str, order: str) -> str:
    return f"SELECT '{part}' AS part, {key} AS key, row_number() OVER (ORDER BY {order}) AS place FROM ({full(SQL[query])})"


SQL |= PLANS
ORACLES = {name: full(body) for name, body in SQL.items()}
ORACLES["stats_order"] = " UNION ALL ".join((
    _placed("modules", "stats_modules", "modulePath", "modulePath"), _placed("packages", "stats_packages", "packagePath", "modulePath, packagePath"), _placed("files", "stats_files", "sourceFile", "modulePath, packagePath, sourceFile"),
))
