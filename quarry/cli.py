"""``python -m quarry.cli <analysis> <path>``: an analysis of a source tree, as JSON or Markdown."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import render
from quarry.operators import cohesion, complexity, hotspot, similarity
from quarry.operators.graph import checkpoint
from quarry.plans import analyses, reports
from quarry.sources import files as sources
from quarry.sources import git

ANALYSES = ("similarity", "wrapper", "cohesion", "complexity", "coupling", "function-graph", "context-span", "hotspot")


def arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("analysis", choices=ANALYSES)
    p.add_argument("path")
    p.add_argument("--format", choices=("json", "md"), default="json")
    p.add_argument("--top", type=int)
    p.add_argument("--threshold", type=float, default=0.85)
    p.add_argument("--min-lines", type=int, default=5)
    p.add_argument("--min-score", type=int)
    p.add_argument("--since")
    p.add_argument("--output", help="a file for the report instead of the standard output")
    p.add_argument("--statistics", action="store_true", help="with similarity: how many pairs each bound ruled out")
    p.add_argument("--entry-glob", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--diff-only", action="store_true")
    tests = p.add_mutually_exclusive_group()
    tests.add_argument("--only-tests", action="store_true")
    tests.add_argument("--exclude-tests", action="store_true")
    return p.parse_args(args)


def rust_root(spark: SparkSession, o: argparse.Namespace, tree: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """A crate's files under the names that its root's declarations give them, and its inline modules; of other trees, the files as they are.

    Declarations are followed through all files; those that the options leave out go afterwards."""
    root = sources.crate_root(o.path)
    if root is None or o.entry_glob:
        return tree, None
    folder = o.path if os.path.isdir(o.path) else os.path.dirname(o.path) or "."
    files, inline = analyses.rust_crate(sources.read_tree(spark, folder), os.path.relpath(root, folder).replace(os.sep, "/"))
    if os.path.isdir(o.path):
        kept = tree.select("file")
        files, inline = files.join(kept, "file", "left_semi"), inline.join(kept, "file", "left_semi")
    return files, inline


def run(spark: SparkSession, o: argparse.Namespace) -> dict:
    """The parts of a report in their order: numbers, texts and DataFrames. JSON has rows by file with their counts, Markdown one table."""
    whole = o.format == "json"
    head = {"root": o.path}

    def listed(rows: DataFrame, name: str, *order: str) -> dict:
        return reports.counts(rows, name).first().asDict() | {"files": reports.by_file(rows, name, *order)}

    by_function = o.analysis in ("similarity", "function-graph")
    tree = sources.read_tree(spark, o.path, only_tests=o.only_tests and not by_function, exclude_tests=o.exclude_tests, exclude=tuple(o.exclude))
    changes = git.changed_ranges(spark, o.path) if o.diff_only else None
    tests = {"only_tests": o.only_tests, "exclude_tests": o.exclude_tests}
    top, least = (o.top, o.min_score) if o.format == "md" else (None, None)  # JSON is whole
    if o.analysis == "complexity":
        units = checkpoint(analyses.complexity_units(tree, changes))
        if whole:
            found = listed(units, "function", "start_line")
            return head | {k: found[k] for k in ("file_count", "function_count")} | {"summary": complexity.summary(units), "files": found["files"]}
        return {"summary": complexity.summary(units), "functions": complexity.ranked(units, top, least or 0)}
    if o.analysis == "hotspot":
        scope = os.path.relpath(os.path.realpath(o.path), os.path.realpath(git.root(o.path) or o.path)).replace(os.sep, "/")
        if os.path.isdir(o.path) and scope != ".":  # churn has paths from the repository's root
            tree = tree.withColumn("file", F.concat(F.lit(scope + "/"), "file"))
        rows = hotspot.ranked(checkpoint(analyses.hotspots(tree, git.churn(spark, o.path, o.since))), top)
        return {"target": o.path, "repo_root": git.root(o.path)} | ({"since": o.since} if o.since else {}) | {"file_count": rows.count(), "summary": hotspot.summary(rows), "files": rows}
    if o.analysis == "cohesion":
        units = checkpoint(analyses.cohesion_units(tree, changes))
        return head | listed(units, "unit", "start_line") if whole else {"units": cohesion.ranked(units, top, least or 0)}
    if o.analysis == "wrapper":
        found = checkpoint(analyses.wrappers(tree, changes))
        return head | listed(found, "wrapper", "start_line") if whole else {"wrappers": found.orderBy("file", "start_line")}
    if o.analysis in ("coupling", "context-span"):
        tree, inline = rust_root(spark, o, tree)
        head = {"crate_root": o.path}
        if o.analysis == "context-span":
            spans = checkpoint(analyses.context_spans(tree, o.entry_glob, sources.go_module(o.path), inline))
            return head | {"module_count": spans.count(), "modules": spans.orderBy(F.desc("transitive"), F.desc("files"), F.desc("direct"), "path")}
        parts = analyses.coupled(tree, sources.go_module(o.path), inline)
        return head | {f"{k.rstrip('s')}_count": parts[k].count() for k in ("modules", "edges", "cycles")} | parts
    if o.analysis == "function-graph":
        nodes, edges, summary = analyses.call_graph(tree, **tests)
        n = summary.first()
        return {"schema_version": 1} | head | {"language": reports.language_label(tree).first()["language"], "node_count": n["node_count"], "edge_count": n["edge_count"], "nodes": nodes, "edges": edges, "summary": summary, "groups": reports.group_sizes(nodes)}
    opts = similarity.Options(threshold=o.threshold)
    found, pairs, clusters = analyses.similar(tree, opts, o.min_lines, changes, **tests)
    views = checkpoint(reports.cluster_views(found, pairs, clusters)).orderBy("cluster_id")
    views = views.limit(top) if top else views
    counted = {"statistics": similarity.statistics(found, opts)} if o.statistics else {}
    return head | {"function_count": found.count(), "threshold": o.threshold, "min_lines": o.min_lines, "cluster_count": clusters.count()} | counted | {"clusters": views}


def main(args: list[str]) -> int:
    o = arguments(args)
    spark = SparkSession.builder.appName("quarry").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    parts = run(spark, o)
    text = render.to_json(parts) if o.format == "json" else render.to_markdown(o.analysis, parts, o.top or 20)
    if o.output:
        Path(o.output).write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
