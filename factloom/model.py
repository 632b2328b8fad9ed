"""Fact tables, controlled vocabularies and identities.

Inside the engine an absent string is "", never null; sinks drop empty values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The controlled vocabularies of the fact model.
NODE_KINDS = ("module", "package", "file", "function", "method", "type", "interface", "struct", "field", "import", "placeholder", "runtime_marker", "unresolved_call")
EDGE_KINDS = ("contains", "declares", "imports", "calls", "depends_on", "violates", "contains_runtime_marker")
FACT_KINDS = ("label", "metric", "warning", "policy_result", "observation", "diagnostic", "edge")
STATUSES = ("pass", "fail", "warning", "unknown", "completed", "partial", "analysis_error")
DIAGNOSTIC_STATUSES = ("missing_dependency", "import_cycle", "package_loading_diagnostic", "analysis_skipped_incomplete_scope")
FRESHNESS = ("fresh", "stale", "superseded", "invalidated")
OBSERVATION_SOURCES = ("observed", "configured", "inferred", "imported")
TERM, INCOMPLETE, PAIR = "vocabulary.term", "vocabulary.incomplete_dependency", "vocabulary.cooccurrence"
CANDIDATE, BRIDGE = "vocabulary.language_zone_candidate", "vocabulary.bridge_symbol"
OBSERVATION_NAMES = (TERM, INCOMPLETE, PAIR, CANDIDATE, BRIDGE)
TRUST = ("syntax_observed", "package_loaded", "type_resolved")
TRUST_MEANINGS = {
    "syntax_observed": "seen in source text, names not resolved",
    "package_loaded": "its package was found and loaded",
    "type_resolved": "its package was loaded and its types resolved without error",
}
#: Beginnings of strings that name a fact and so must resolve.
FACT_PREFIXES = (
    "module", "package", "file", "import", "function", "method", "type", "interface", "struct", "field", "runtime_marker",
    "unresolved_call", "placeholder", "edge", "observation", "label", "metric", "warning", "policy_result", "source_record",
)
EXTRACTOR = "factloom/1"

META = ("producerId", "producerVersion", "runId", "createdAt")
_SPECIAL = {"synthetic": "boolean", "complete": "boolean", "attributes": "map<string,string>", "evidence": "array<string>", "knownSegments": "array<string>", "missing": "array<string>", "confidence": "double", "value#metrics": "bigint", "threshold": "bigint", "diagnostics#runs": "array<string>", "emittedFacts": "bigint"}
_COLUMNS = {
    "nodes": "id kind name trustLevel synthetic freshness reason sourceFile sourceHash lineRange extractorVersion packagePath modulePath",
    "edges": "id from to kind trustLevel synthetic complete reason sourceFile lineRange extractorVersion",
    "sourceRecords": "id kind path absPath sourceHash freshness reason trustLevel",
    "observations": "id kind name value targetId targetKind attributes evidence source confidence trustLevel freshness sourceFile lineRange",
    "labels": "id kind name value targetId targetKind source confidence evidence trustLevel freshness",
    "warnings": "id kind reason suggestedNextAction affectedNodeId affectedEdgeId evidence trustLevel sourceFile lineRange freshness",
    "queries": "id status query reason scope requiredTrustLevel actualTrustLevel proofStatus evidence",
    "pathJobs": "id status startNode targetNode knownSegments missing blockingReason requiredTrustLevel currentTrustLevel",
    "freshness": "factId sourceFile oldHash newHash status reason extractorVersion",
    "policyResults": "id kind ruleId analyzerId stage status scope subject reason evidence trustLevel configurationHash sourceFile lineRange",
    "metrics": "id kind name value unit scope subject analyzerId stage status threshold reason evidence trustLevel configurationHash sourceFile lineRange",
    "diagnostics": "level source reason stage analyzerId status policyResultId nodeId edgeId sourceFile lineRange trustLevel evidence",
    "runs": "runId analyzerId analyzerVersion stage inputGraphVersion configurationHash startedAt finishedAt status diagnostics emittedFacts",
}
SECTIONS = tuple(_COLUMNS)


def schema(section: str) -> T.StructType:
    names = _COLUMNS[section].split() + ([] if section == "runs" else list(META))
    kinds = [_SPECIAL.get(f"{n}#{section}") or _SPECIAL.get(n) if n != "value" or section == "metrics" else None for n in names]
    kinds = ["array<string>" if n == "diagnostics" else k for n, k in zip(names, kinds, strict=True)]
    return T.StructType([T.StructField(n, T._parse_datatype_string(k) if k else T.StringType()) for n, k in zip(names, kinds, strict=True)])


def conform(df: DataFrame, section: str) -> DataFrame:
    """``df`` in the section's column order; missing columns get the empty value of their type."""
    have, out = set(df.columns), []
    for f in schema(section):
        kind = f.dataType.simpleString()
        empty = {"string": F.lit(""), "boolean": F.lit(False), "bigint": F.lit(0), "double": F.lit(0.0), "array<string>": F.array(), "map<string,string>": F.create_map()}[kind].cast(f.dataType)
        out.append((F.coalesce(F.col(f"`{f.name}`").cast(f.dataType), empty) if f.name in have else empty).alias(f.name))
    return df.select(*out)


def empty(spark: SparkSession, section: str) -> DataFrame:
    return spark.createDataFrame([], schema(section))


# ---- expressions --------------------------------------------------------------------------


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def package_id(path: Column | str) -> Column:
    return F.concat(F.lit("package:"), path)


def module_id(path: Column | str) -> Column:
    return F.concat(F.lit("module:"), path)


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return F.concat(F.lit("edge:"), kind, F.lit(":"), source, F.lit("->"), target)


def observation_id(analyzer: str, *parts: Column) -> Column:
    """``observation:<analyzer>:`` and the SHA-256 of the parts joined by NUL."""
    return F.concat(F.lit(f"observation:{analyzer}:"), F.sha2(F.concat_ws("\0", *parts), 256))


def strip(c: Column | str, *prefixes: str) -> Column:
    """What follows the first of ``prefixes`` that the value begins with, else ""."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit("")
    for p in reversed(prefixes):
        out = F.when(c.startswith(p), F.substring(c, len(p) + 1, 1 << 30)).otherwise(out)
    return out


def trust_rank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return reduce(lambda out, t: F.when(c == t, TRUST.index(t) + 1).otherwise(out), TRUST, F.lit(0))


def trust_of(rank: Column) -> Column:
    return reduce(lambda out, i: F.when(rank == i + 1, F.lit(TRUST[i])).otherwise(out), range(len(TRUST)), F.lit(""))


def least_trust(*levels: Column | str) -> Column:
    return trust_of(F.least(*map(trust_rank, levels)))


def is_placeholder_node() -> Column:
    return F.col("synthetic") | (F.col("kind") == "placeholder") | F.col("id").startswith("placeholder:")


def is_incomplete_edge() -> Column:
    return ~F.col("complete") | F.col("synthetic") | F.col("to").startswith("placeholder:")


def looks_like_fact(c: Column) -> Column:
    return c.rlike("^(" + "|".join(FACT_PREFIXES) + "):")


def attribute(key: str) -> Column:
    return F.coalesce(F.col("attributes")[key], F.lit(""))
