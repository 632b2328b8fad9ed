"""Command line: ``python -m factloom.plans.cli --path DIR --stats``. Exit 2 on wrong use, 1 on failure."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..operators import reports
from ..sources import loads, workspace
from . import analyzers, engine, viewer


def _list(value: str) -> list[str]:
    return [v.strip() for v in value.split(",") if v.strip()]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="factloom")
    for name in ("path", "workspace-root", "package-loads", "serve", "source-base", "config", "policy-config", "output-dir", "module", "package", "file"):
        p.add_argument(f"--{name}", default="")
    for name in ("analyzers", "skip-analyzers", "json-sections", "node-kinds", "edge-kinds", "observation-names"):
        p.add_argument(f"--{name}", type=_list, default=[])
    for name in ("json", "stats", "ddd-report", "problems", "list-values", "stdout", "simulate-change", "disable-complexity", "disable-policy-eval"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--limit", type=int, default=50)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    try:
        if a.list_values:
            rows = reports.catalogue(spark, analyzers.known_ids()).collect()
            print("\n".join(f"{r.category}\t{r.value}" for r in rows))
            return 0
        sections = [reports.section_name(s) for s in a.json_sections]
        skip = a.skip_analyzers + ["complexity"] * a.disable_complexity + ["dependency_policy"] * a.disable_policy_eval
        analyzers.plan(a.analyzers, skip)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    try:
        o = engine.Options(a.path, a.workspace_root, a.source_base, a.policy_config or a.config, tuple(a.analyzers), tuple(skip), a.simulate_change)
        facts = engine.Build(spark, o).run(loads.read(spark, a.package_loads) if a.package_loads else None)
        if a.serve:
            p = workspace.resolve(o.path, o.workspace, o.base)
            viewer.serve(a.serve, facts, str(p.base))
            return 0
        mode = "stats" if a.stats else "ddd" if a.ddd_report else "problems" if a.problems else "json"
        if mode == "json":
            chosen = reports.filter_graph(facts, sections, node_kinds=a.node_kinds, edge_kinds=a.edge_kinds, observation_names=a.observation_names)
            text = engine.graph_chunks(chosen)
        else:
            text = engine.report(facts, mode, reports.Options(a.module, a.package, a.file, a.limit))
        if path := engine.emit(f"{mode}.json", text, a.stdout, a.output_dir):
            print(path)
        return 0
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
