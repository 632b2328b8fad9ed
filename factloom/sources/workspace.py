"""A Go workspace as base facts: discovery on the driver, parsing on the executors."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..plans.tables import keep
from .gosyntax import parse

# Reasons of discovery and of incomplete facts.
ENTRY, WALK, USE, REPLACE = "entry_module", "workspace_scan", "go_work_use", "go_mod_replace"
NOT_HERE, NO_FILES, OUTSIDE = "required_module_not_present_in_workspace", "package_imported_but_no_go_files_discovered", "imported_package_outside_known_workspace"
NOT_PARSED, NO_TARGET, NO_SYMBOL = "import_target_not_parsed_or_loaded", "call_target_not_type_resolved", "target_symbol_not_type_resolved"


@dataclass(frozen=True)
class Project:
    """Entry path, its module root, the workspace and the folder that paths are relative to."""

    entry: Path
    root: Path
    workspace: Path
    base: Path

    def rel(self, path: Path | str) -> str:
        return Path(os.path.relpath(path, self.base)).as_posix()


def module_root(start: Path) -> Path:
    for d in (start, *start.parents):
        if (d / "go.mod").exists():
            return d
    raise FileNotFoundError(f"no go.mod found at or above {start}")


def resolve(path: str, workspace: str = "", base: str = "") -> Project:
    if not path:
        raise ValueError("missing --path")
    entry = Path(os.path.abspath(path))
    if not entry.exists():
        raise FileNotFoundError(str(entry))
    root = module_root(entry if entry.is_dir() else entry.parent)
    ws = Path(os.path.abspath(workspace)) if workspace else root
    return Project(entry, root, ws, Path(os.path.abspath(base)) if base else ws)


def walk(top: Path) -> Iterator[Path]:
    """Files below ``top`` in lexical order, folders whose name begins with a dot left out."""
    if top.name.startswith("."):
        return
    for e in sorted(os.scandir(top), key=lambda e: e.name):
        if e.is_dir(follow_symlinks=False):
            yield from walk(Path(e.path))
        else:
            yield Path(e.path)


@dataclass
class Manifest:
    module: str = ""
    require: list[str] = field(default_factory=list)
    replace: list[str] = field(default_factory=list)
    use: list[str] = field(default_factory=list)


def manifest(text: str) -> Manifest:
    """Directives of a go.mod or go.work file, line or block form."""
    out, block = Manifest(), ""
    for raw in text.splitlines():
        words = [w.strip("\"`") for w in re.sub(r"//.*", "", raw).split()]
        if not words:
            continue
        if words == [")"]:
            block = ""
            continue
        if len(words) > 1 and words[1] == "(" and not block:
            block = words[0]
            continue
        key, rest = (block, words) if block else (words[0], words[1:])
        if not rest:
            continue
        if key == "module":
            out.module = rest[0]
        elif key == "require":
            out.require.append(rest[0])
        elif key == "use":
            out.use.append(rest[0])
        elif key == "replace" and "=>" in rest and rest.index("=>") + 1 < len(rest):
            out.replace.append(rest[rest.index("=>") + 1])
    return out


def is_local(path: str) -> bool:
    return path in (".", "..") or path.startswith(("./", "../", "/"))


@dataclass
class Modules:
    """Modules by path: (path, folder, reasons, requirements), in order; diagnostics."""

    rows: list[tuple[str, Path, list[str], list[str]]]
    diagnostics: list[tuple[str, str]]


def modules(p: Project) -> Modules:
    found: dict[Path, set[str]] = {}
    diagnostics: list[tuple[str, str]] = []
    add = lambda path, reason: found.setdefault(path, set()).add(reason)
    add(p.root / "go.mod", ENTRY)
    if p.workspace != p.root:
        for f in walk(p.workspace):
            if f.name == "go.mod":
                add(f, WALK)
    work = p.workspace / "go.work"
    if work.exists():
        for d in manifest(work.read_text()).use:
            f = Path(os.path.normpath(p.workspace / d)) / "go.mod"
            if f.exists():
                add(f, USE)
    todo, seen = sorted(found), set()
    while todo:
        f = todo.pop(0)
        if f in seen or not f.exists():
            continue
        seen.add(f)
        for target in manifest(f.read_text()).replace:
            if is_local(target):
                other = Path(os.path.normpath(f.parent / target)) / "go.mod"
                if other.exists():
                    add(other, REPLACE)
                    todo.append(other)
                else:
                    diagnostics.append((p.rel(f), f"local replace path has no go.mod: {p.rel(other.parent)}"))
    by_path: dict[str, tuple[Path, set[str], list[str]]] = {}
    for f in sorted(found):
        m = manifest(f.read_text())
        old = by_path.get(m.module)
        by_path[m.module] = (f.parent, found[f] | (old[1] if old else set()), m.require)
    return Modules(sorted(((k, d, sorted(r), q) for k, (d, r, q) in by_path.items()), key=lambda x: (x[0], str(x[1]))), diagnostics)


def short_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def source_records(spark: SparkSession, p: Project, config: Path | None, mods: Modules) -> tuple[DataFrame, DataFrame]:
    """sourceRecords and the freshness rows that go with them."""
    rows = [("user_entry", p.entry, "entry_path"), ("project_root", p.root, "nearest_go_mod"), ("workspace_root", p.workspace, "workspace_root")]
    if config is not None and config.exists():
        rows.append(("config", config, "config_file"))
    if (p.workspace / "go.work").exists():
        rows.append(("go_work", p.workspace / "go.work", "go_work_file"))
    for f in walk(p.workspace):
        if f.name == "go.mod":
            rows.append(("go_mod", f, "workspace_scan"))
        elif f.suffix == ".go":
            rows.append(("go_file", f, "workspace_scan"))
    rows += [("module_discovery", d, ",".join(r)) for _, d, r, _ in mods.rows]
    out = [(f"source_record:{k}:{p.rel(f)}", k, p.rel(f), str(f), short_hash(f.read_bytes()) if f.is_file() else "", "fresh", r, "syntax_observed") for k, f, r in rows]
    records = spark.createDataFrame(out, "id string, kind string, path string, absPath string, sourceHash string, freshness string, reason string, trustLevel string")
    fresh = records.select(F.col("id").alias("factId"), F.col("path").alias("sourceFile"), F.lit("").alias("oldHash"), F.col("sourceHash").alias("newHash"), F.lit("fresh").alias("status"), F.lit("source_discovered").alias("reason"), F.lit(M.EXTRACTOR).alias("extractorVersion"))
    return M.conform(records, "sourceRecords"), M.conform(fresh, "freshness")


PARSED = "what string, kind string, id string, name string, source string, target string, lineRange string, sourceFile string, sourceHash string, pkg string, module string, modPos int, at int"


def parse_rows(content: bytes, source_file: str, pkg: str, module: str, pos: int) -> list[tuple]:
    """Facts of one file as rows: nodes, edges, imports, decisions and errors."""
    hashed = short_hash(content)
    out: list[tuple] = []

    def put(what: str, kind: str, ident: str, name: str, a: str = "", b: str = "", span: str = "") -> None:
        out.append((what, kind, ident, name, a, b, span, source_file, hashed, pkg, module, pos, len(out)))

    try:
        s = parse(content)
    except SyntaxError as e:
        put("error", "", "", str(e))
        return out
    file, package = f"file:{source_file}", f"package:{pkg}"
    put("node", "package", package, pkg)
    put("node", "file", file, source_file.rsplit("/", 1)[-1], span=s.span(s.start, s.end))
    put("edge", "contains", "", "", package, file)
    for path, a, b in s.imports:
        put("import", "import", f"import:{pkg}:{path}", path, package, path, s.span(a, b))
    for name, kind, a, b, fields in s.types:
        ident = f"{kind}:{pkg}.{name}"
        put("node", kind, ident, name, span=s.span(a, b))
        put("edge", "declares", "", "", package, ident, s.span(a, b))
        for n, c, d in fields if kind == "struct" else ():
            f = f"field:{pkg}.{name}.{n}"
            put("node", "field", f, n, span=s.span(c, d))
            put("edge", "contains", "", "", ident, f, s.span(c, d))
    for name, receiver, a, b, decisions in s.functions:
        kind = "method" if receiver else "function"
        ident = f"{kind}:{pkg}.{receiver + '.' if receiver else ''}{name}"
        put("node", kind, ident, name, span=s.span(a, b))
        put("edge", "declares", "", "", package, ident, s.span(a, b))
        for d in decisions:
            put("decision", d, ident, name)
    for name, a, b in s.markers:
        ident = f"runtime_marker:{source_file}:{s.span(a, b)}:{name}"
        put("node", "runtime_marker", ident, name, span=s.span(a, b))
        put("edge", "contains_runtime_marker", "", "", file, ident, s.span(a, b))
    for name, a, b in s.calls:
        ident = f"unresolved_call:{source_file}:{s.span(a, b)}:{name}"
        put("node", "unresolved_call", ident, name, span=s.span(a, b))
        put("edge", "calls", "", "", package, ident, s.span(a, b))
    return out


def parsed(spark: SparkSession, p: Project, mods: Modules) -> DataFrame:
    """All files of all modules through the reader, in parallel; a file below several modules is
    read once for each."""
    dirs = spark.createDataFrame([(i, m, str(d)) for i, (m, d, _, _) in enumerate(mods.rows)] or [(0, "", "")], "modPos int, module string, dir string")
    tops = sorted({str(d) for _, d, _, _ in mods.rows})
    tops = [t for t in tops if not any(t.startswith(o + "/") for o in tops if o != t)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.go").load(tops)
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    # every folder above a file is a key, so files meet their modules in an equi join
    above = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.call_function("substring_index", F.col("path"), F.lit("/"), n)), lambda d: d != "")
    keyed = files.withColumn("dir", F.explode(above)).join(F.broadcast(dirs), "dir")
    inside = F.substring(F.col("path"), F.length("dir") + 1, F.length("path"))
    keyed = keyed.where(~inside.rlike(r"/\.[^/]*/"))
    rel = F.regexp_replace(inside, "/[^/]*$", "")
    keyed = keyed.withColumn("pkg", F.when(rel == "", F.col("module")).otherwise(F.concat("module", rel)))
    base = str(p.base)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARSED.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                rows += parse_rows(bytes(r.content), Path(os.path.relpath(r.path, base)).as_posix(), r.pkg, r.module, r.modPos)
            yield pd.DataFrame(rows, columns=names)

    return keyed.select("path", "content", "pkg", "module", "modPos").mapInPandas(run, PARSED)


def base_facts(spark: SparkSession, p: Project, config: Path | None = None) -> dict[str, DataFrame]:
    """nodes, edges (before reconciliation), sourceRecords, freshness, diagnostics, and parser rows.

    Order of arrival is (module, path with folders before dots, place in file): a node keeps its
    first row and an edge its last, and an import counts as not found where its package first
    arrives later."""
    mods = modules(p)
    records, fresh = source_records(spark, p, config, mods)
    # read once, used by many plans
    rows = keep(parsed(spark, p, mods)).withColumn("seq", F.struct("modPos", F.replace("sourceFile", F.lit("/"), F.lit("\0")).alias("key"), "at"))
    seen, none = F.lit("syntax_observed"), F.lit("")
    early = F.struct(F.lit(-1).alias("modPos"), F.lit("").alias("key"), F.lit(0).alias("at"))
    known = spark.createDataFrame([(i, m) for i, (m, _, _, _) in enumerate(mods.rows)] or [(0, "")], "owner int, owned string")

    def nodes(df: DataFrame, **c) -> DataFrame:  # noqa: ANN003
        base = {"trustLevel": seen, "synthetic": F.lit(False), "freshness": F.lit("fresh"), "reason": none, "sourceFile": none, "sourceHash": none, "lineRange": none, "extractorVersion": F.lit(M.EXTRACTOR), "packagePath": none, "modulePath": none, "seq": early}
        c = base | c
        return df.select(*(c[k].alias(k) for k in ("id", "kind", "name", *base)))

    def edges(df: DataFrame, **c) -> DataFrame:  # noqa: ANN003
        base = {"trustLevel": seen, "synthetic": F.lit(False), "complete": F.lit(True), "reason": none, "sourceFile": none, "lineRange": none, "extractorVersion": F.lit(M.EXTRACTOR), "seq": early}
        c = {"id": M.edge_id(c["kind"], c["from"], c["to"])} | base | c
        return df.select(*(c[k].alias(k) for k in ("id", "from", "to", "kind", *base)))

    mod_rows = [(m, p.rel(d / "go.mod"), short_hash((d / "go.mod").read_bytes()), ",".join(r)) for m, d, r, _ in mods.rows]
    mod = spark.createDataFrame(mod_rows, "m string, f string, h string, r string")
    names = {m for m, _, _, _ in mods.rows}
    req = spark.createDataFrame([(m, p.rel(d / "go.mod"), q, q in names) for m, d, _, qs in mods.rows for q in qs], "m string, f string, q string, here boolean")
    n = nodes(mod, id=M.module_id("m"), kind=F.lit("module"), name=F.col("m"), reason=F.col("r"), sourceFile=F.col("f"), sourceHash=F.col("h"), modulePath=F.col("m"))
    ghost_module = F.concat(F.lit("placeholder:module:"), "q")
    n = n.union(nodes(req.where("not here"), id=ghost_module, kind=F.lit("placeholder"), name=F.col("q"), synthetic=F.lit(True), reason=F.lit(NOT_HERE), modulePath=F.col("q")))
    e = edges(req, **{"from": M.module_id("m"), "to": F.when(F.col("here"), M.module_id("q")).otherwise(ghost_module), "kind": F.lit("depends_on"), "complete": F.col("here"), "synthetic": ~F.col("here"), "reason": F.when(F.col("here"), "").otherwise(NOT_HERE), "sourceFile": F.col("f")})
    own = rows.where("what = 'node'")
    call, pkg = F.col("kind") == "unresolved_call", F.col("kind") == "package"
    n = n.union(nodes(
        own, id=F.col("id"), kind=F.col("kind"), name=F.col("name"), synthetic=call, reason=F.when(call, NO_TARGET).otherwise(""), sourceFile=F.when(pkg, "").otherwise(F.col("sourceFile")),
        sourceHash=F.when(pkg | call, "").otherwise(F.col("sourceHash")), lineRange=F.col("lineRange"), packagePath=F.col("pkg"), modulePath=F.when(F.col("kind").isin("runtime_marker", "unresolved_call"), "").otherwise(F.col("module")), seq=F.col("seq"),
    ))
    link = F.col("kind") == "calls"
    e = e.union(edges(rows.where("what = 'edge'"), **{"from": F.col("source"), "to": F.col("target"), "kind": F.col("kind"), "complete": ~link, "synthetic": link, "reason": F.when(link, NO_SYMBOL).otherwise(""), "sourceFile": F.col("sourceFile"), "lineRange": F.col("lineRange"), "seq": F.col("seq")}))
    imports = rows.where("what = 'import'")
    n = n.union(nodes(imports, id=F.col("id"), kind=F.lit("import"), name=F.col("name"), sourceFile=F.col("sourceFile"), sourceHash=F.col("sourceHash"), lineRange=F.col("lineRange"), packagePath=F.col("pkg"), modulePath=F.col("module"), seq=F.col("seq")))
    # the first module, in order, whose path an import begins with
    parts = F.transform(F.sequence(F.lit(1), F.size(F.split("target", "/"))), lambda k: F.call_function("substring_index", F.col("target"), F.lit("/"), k))
    owners = imports.select("target", F.explode(parts).alias("owned")).distinct().join(known, "owned").groupBy("target").agg(F.min_by("owned", "owner").alias("ownerModule"))
    first = own.where("kind = 'package'").groupBy(F.col("pkg").alias("target")).agg(F.min("seq").alias("firstSeq"))
    i = imports.join(owners, "target", "left").join(first, "target", "left")
    plain = ~F.col("target").contains(".")
    here = plain | (F.col("ownerModule").isNotNull() & F.coalesce(F.col("firstSeq") < F.col("seq"), F.lit(False)))
    to = F.concat(F.when(here, "package:").otherwise("placeholder:package:"), "target")
    e = e.union(edges(i, **{"from": F.col("source"), "to": to, "kind": F.lit("imports"), "complete": here, "synthetic": ~here, "reason": F.when(here, "").otherwise(NOT_PARSED), "sourceFile": F.col("sourceFile"), "lineRange": F.col("lineRange"), "seq": F.col("seq")}))
    n = n.union(nodes(i.where(~here), id=to, kind=F.lit("placeholder"), name=F.col("target"), synthetic=F.lit(True), reason=F.when(F.col("ownerModule").isNull(), OUTSIDE).otherwise(NO_FILES), packagePath=F.col("target"), modulePath=M.text("ownerModule"), seq=F.col("seq")))
    errors = rows.where("what = 'error'").select(F.lit("error").alias("level"), F.col("sourceFile").alias("source"), F.col("name").alias("reason"))
    local = spark.createDataFrame([("warning", f, r) for f, r in mods.diagnostics], "level string, source string, reason string")
    return {"nodes": n, "edges": e, "sourceRecords": records, "freshness": fresh, "diagnostics": M.conform(local.union(errors), "diagnostics"), "rows": rows}


def structural_loads(nodes: DataFrame, edges: DataFrame, entry_module: str) -> DataFrame:
    """(package, errors, imports) for packages of the entry module, from structure alone: a
    package with an import that does not resolve has an error. Types are not checked."""
    own = nodes.where((F.col("kind") == "package") & (F.col("modulePath") == entry_module)).select("packagePath")
    i = edges.where("kind = 'imports'").select(M.strip("from", "package:").alias("p"), "to", M.is_incomplete_edge().alias("open"))
    i = own.join(i, F.col("packagePath") == F.col("p"), "left")
    path = M.strip("to", "package:", "placeholder:package:")
    return i.groupBy("packagePath").agg(
        F.array_sort(F.collect_set(F.when(F.col("open"), F.concat(F.lit("could not import "), path)))).alias("errors"), F.array_sort(F.collect_set(F.when(~F.col("open"), path))).alias("imports")
    ).withColumnRenamed("packagePath", "package")


