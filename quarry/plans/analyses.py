"""The eight analyses of a source tree. ``files``: file, lang, module, is_test_path, source (sources.files.read_tree)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import metrics, paths
from quarry.operators import callgraph, cohesion, complexity, coupling, diff, hotspot, imports, similarity, wrapper
from quarry.operators.graph import checkpoint, reachable_from
from quarry.sources.facts import extract


def complexity_units(files: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    units = complexity.with_metrics(extract(files, "units"))
    return diff.touched(units, changes) if changes is not None else units


def hotspots(files: DataFrame, churn: DataFrame) -> DataFrame:
    units = complexity_units(files).select(F.col("file").alias("path"), "loc", "cyclomatic", "cognitive")
    return hotspot.hotspots(churn, hotspot.file_complexity(files.select(F.col("file").alias("path")), units))


def cohesion_units(files: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    methods = extract(files, "methods").withColumn("unit_id", F.concat_ws("\x1f", "file", "kind", F.coalesce("trait_name", F.lit("")), "type_name", F.col("unit_start").cast("string")))
    methods = checkpoint(methods)
    units = methods.groupBy("unit_id").agg(*[F.first(c).alias(c) for c in ("file", "kind", "trait_name", "type_name")], F.first("unit_start").alias("start_line"), F.first("unit_end").alias("end_line"))
    units = diff.touched(units, changes) if changes is not None else units
    return units.join(cohesion.cohesion(methods), "unit_id").drop("unit_id")


def wrappers(files: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Thin wrappers with their reuse; reuse is known for Rust files only."""
    found = extract(files, "wrappers")
    found = diff.touched(found, changes) if changes is not None else found
    found = checkpoint(found)
    calls = extract(files.where("lang = 'rust'"), "calls").select("file", F.col("caller_qualified_name").alias("caller"), F.col("callee_name").alias("callee"), F.col("caller_module").alias("module"))
    calls = calls.withColumn("caller", F.when(F.col("caller").startswith(F.concat("module", F.lit("::"))), F.substring("caller", F.length("module") + 3, F.lit(1_000_000))).otherwise(F.col("caller"))).drop("module")
    rust = found.join(files.where("lang = 'rust'").select("file"), "file", "left_semi")
    reuse = wrapper.reuse(rust, calls).select("file", "name", F.struct("call_sites", "unique_callers", "same_file_only").alias("reuse"))
    return found.join(reuse, ["file", "name"], "left")


def functions(files: DataFrame, only_tests: bool = False, exclude_tests: bool = False) -> DataFrame:
    found = extract(files, "functions").join(files.select("file", "is_test_path"), "file").withColumn("is_test", F.col("is_test") | F.col("is_test_path")).drop("is_test_path")
    return found.where(F.col("is_test") if only_tests else ~F.col("is_test")) if only_tests or exclude_tests else found


def compared_body(tree: F.Column) -> F.Column:
    """The first child that is a ``Block``, else the whole tree."""
    labels, sizes = tree["labels"], tree["sizes"]
    starts = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1))), F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, i: F.when((s["at"] == i - 1) & (i <= F.size(sizes)), F.struct((s["at"] + F.get(sizes, i - 1)).alias("at"), F.concat(s["out"], F.array(i - 1)).alias("out"))).otherwise(s), lambda s: s["out"],
    )
    block = F.try_element_at(F.filter(starts, lambda i: F.get(labels, i) == "Block"), F.lit(1))
    cut = F.struct(F.slice(labels, block + 1, F.get(sizes, block)).alias("labels"), F.slice(sizes, block + 1, F.get(sizes, block)).alias("sizes"))
    return F.when(block.isNotNull(), cut).otherwise(tree)


def similar(files: DataFrame, opts: similarity.Options = similarity.Options(), min_lines: int = 5, changes: DataFrame | None = None, **tests: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions with idx, pairs, clusters). With changes, only pairs of which a side is touched."""
    found = functions(files, **tests).where(metrics.loc(F.col("start_line"), F.col("end_line")) >= min_lines)
    order = Window.orderBy("file", "start_line", "name")
    numbered = checkpoint(found.withColumn("tree", compared_body(F.col("tree"))).withColumn("idx", F.row_number().over(order).cast("long") - 1))
    pairs = similarity.similar_pairs(numbered, opts)
    if changes is not None:
        touched = diff.touched(numbered.select("idx", "file", "start_line", "end_line"), changes).select("idx")
        left, right = touched.select(F.col("idx").alias("i"), F.lit(True).alias("ti")), touched.select(F.col("idx").alias("j"), F.lit(True).alias("tj"))
        pairs = pairs.join(left, "i", "left").join(right, "j", "left").where("ti or tj").drop("ti", "tj")
    pairs = checkpoint(pairs)
    return numbered, pairs, similarity.ranked(similarity.clusters(pairs, opts.threshold))


def call_graph(files: DataFrame, **tests: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with degrees and complexity, edges, summary)."""
    found = functions(files, **tests)
    local = F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit("::"), "name")).otherwise(F.col("name"))
    nodes = found.select(F.concat_ws(":", "file", local, F.col("start_line").cast("string")).alias("id"), "name", "qualified_name", "file", "module", F.col("owner").alias("impl_owner"), "start_line", "end_line", "is_test", local.alias("local_name"))
    units = complexity_units(files).groupBy("file", F.col("name").alias("local_name"), "start_line", "end_line").agg(F.max(F.struct("cognitive", "cyclomatic", "max_nesting", "loc", "maintainability_index", "halstead_volume")).alias("u")).select("file", "local_name", "start_line", "end_line", "u.*")
    nodes = checkpoint(nodes.join(units, ["file", "local_name", "start_line", "end_line"], "left").drop("local_name"))
    edges = checkpoint(callgraph.edges(callgraph.resolve(extract(files, "calls"), nodes.select("id", "file", "qualified_name"))))
    return callgraph.degrees(nodes, edges).orderBy("file", "start_line", "name"), callgraph.ordered(edges), callgraph.summary(nodes, edges)


#: What a TypeScript import without an extension may stand for, in this order.
TS_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")


def ts_candidates(file: F.Column, segments: F.Column) -> F.Column:
    """The files that a relative import may mean: itself if it has an extension, else with each extension, else the folder's index."""
    folder = F.slice(F.split(file, "/"), F.lit(1), F.size(F.split(file, "/")) - 1)
    steps = F.filter(F.split(F.regexp_replace(F.array_join(segments, "/"), "[?#].*$", ""), "/"), lambda s: ~s.isin("", "."))
    ups = F.size(F.filter(steps, lambda s: s == ".."))
    path = F.concat(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - ups, F.lit(0))), F.filter(steps, lambda s: s != ".."))
    joined = F.array_join(path, "/")
    probes = F.array(*[F.concat(joined, F.lit(f".{e}")) for e in TS_EXTENSIONS], *[F.concat_ws("/", F.nullif(joined, F.lit("")), F.lit(f"index.{e}")) for e in TS_EXTENSIONS])
    return F.when(ups <= F.size(folder), F.when(F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit("")).rlike(r"^.+\."), F.array(joined)).otherwise(probes))


def rust_modules(files: DataFrame, root: str, crate: str = "crate") -> DataFrame:
    """(module, file, inline) of the modules that a crate's root file declares, its own among them: ``mod x;`` is ``x.rs`` or else ``x/mod.rs``.

    A round follows the declarations of the files found in the round before, so there are as many as modules are nested. A missing file is an error."""
    own = files.where("lang = 'rust'")
    mods = checkpoint(extract(own, "mods"))
    listed = own.select(F.col("file").alias("path"))
    front = known = checkpoint(own.where(F.col("file") == root).select(F.lit(crate).alias("module"), "file", F.lit(False).alias("inline")))
    if front.isEmpty():
        raise ValueError(f"no root file {root}")
    while not front.isEmpty():
        said = front.drop("inline").join(mods, "file").select(F.concat_ws("::", "module", "parent", "name").alias("child"), "module", "file", "name", "inline")
        home = F.nullif(F.regexp_replace(F.regexp_replace("file", r"(^|/)(lib|main|mod)\.rs$", ""), r"\.rs$", ""), F.lit(""))
        asked = said.where("not inline").select("child", F.concat_ws(" in ", "name", "file").alias("said"), F.array(F.concat_ws("/", home, F.concat("name", F.lit(".rs"))), F.concat_ws("/", home, F.concat("name", F.lit("/mod.rs")))).alias("candidates"))
        hit = imports.first_probe(asked, listed, "child")
        if lost := asked.join(hit, "child", "left_anti").select("said").first():
            raise ValueError(f"no file for module {lost['said']}")
        inside = said.where("inline").select(F.col("child").alias("module"), "file", "inline").distinct()
        front = checkpoint(hit.select(F.col("child").alias("module"), F.col("path").alias("file"), F.lit(False).alias("inline")).join(known.select("file"), "file", "left_anti").select("module", "file", "inline"))
        known = checkpoint(known.unionByName(inside).unionByName(front))
    return known


def rust_crate(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(files of the crate under their modules' names, its inline modules: path, file). References from an inline module count as its file's."""
    found = rust_modules(files, root)
    return files.drop("module").join(found.where("not inline").select("file", "module"), "file").select(*files.columns), found.where("inline").select(F.col("module").alias("path"), "file")


def module_edges(files: DataFrame, go_module: str | None = None, inline: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, modules): imports resolved to the tree's own modules by their longest known prefix, those of TypeScript by the files that they may mean.

    ``go_module``: the import path of a Go tree's root; ``inline``: further modules (path, file)."""
    modules = files.select(F.col("module").alias("path"), "file")
    modules = modules if inline is None else modules.unionByName(inline)
    found = extract(files, "imports").withColumn("key", F.monotonically_increasing_id())
    found = found.withColumn("name", F.explode_outer("names"))
    home = F.split("module", "::")
    is_package = F.col("file").rlike(r"(^|/)__init__\.py$")
    up = F.col("level") - F.when(is_package, 1).otherwise(0)
    package = F.slice(home, 1, F.greatest(F.size(home) - up, F.lit(0)))
    python = F.when(F.col("level") > 0, F.concat(package, "segments")).otherwise(F.col("segments"))
    python = F.when(F.col("kind") == "from", F.concat(python, F.array("name"))).otherwise(python)
    head = F.element_at("segments", 1)
    rust = F.when(head == "self", F.concat(home, F.slice("segments", 2, F.size("segments")))).when(head == "super", F.concat(F.slice(home, 1, F.greatest(F.size(home) - 1, F.lit(1))), F.slice("segments", 2, F.size("segments")))).when(head == "crate", F.concat(F.slice(home, 1, 1), F.slice("segments", 2, F.size("segments")))).otherwise(F.col("segments"))
    lang = paths.language(F.col("file"))
    whole = F.when(lang == "python", python).when(lang == "typescript", F.when(head.isin(".", "..") & (F.size("segments") > 1), F.col("segments"))).when(lang == "rust", rust).otherwise(F.col("segments"))
    refs = checkpoint(found.withColumn("segments", F.filter(whole, lambda s: s.isNotNull() & (s != ""))).withColumn("key", F.xxhash64("key", "name")))
    # a Go import is the tree's own if it lies below the tree's import path, and then names a folder
    above = F.array(*map(F.lit, go_module.split("/"))) if go_module else None
    inside = F.lit(False) if above is None else F.slice("segments", 1, F.size(above)) == above
    rest = F.lit("") if above is None else F.array_join(F.slice("segments", F.size(above) + 1, F.size("segments")), "::")
    go = refs.where((lang == "go") & inside).select("key", F.col("name").alias("symbol"), rest.alias("module")).join(modules.select(F.col("path").alias("module")).distinct(), "module")
    go = go.select("key", "module", "symbol")
    # a TypeScript import is the first file there is among those that it may mean
    ts = refs.where((lang == "typescript") & (F.size("segments") > 0))
    probed = imports.first_probe(ts.select("key", ts_candidates(F.col("file"), F.col("segments")).alias("candidates")), files.select(F.col("file").alias("path")), "key")
    probed = probed.join(modules.select(F.col("file").alias("path"), F.col("path").alias("module")), "path").join(ts.select("key", F.coalesce("name", F.lit("*")).alias("symbol")), "key").select("key", "module", "symbol")
    hit = imports.longest_prefix(refs.where(~lang.isin("go", "typescript")).select("key", "segments"), modules.select(F.col("path").alias("module")), "key")
    resolved = hit.unionByName(go).unionByName(probed).withColumnRenamed("module", "to")
    kind = F.when(F.col("kind").isin(*coupling.KINDS), F.col("kind")).otherwise("use")
    edges = refs.select("key", F.col("module").alias("from"), kind.alias("kind")).join(resolved, "key").select("from", "to", F.when(F.col("symbol") == "", F.col("to")).otherwise(F.col("symbol")).alias("symbol"), "kind")
    return checkpoint(coupling.normalised(edges)), modules


def coupled(files: DataFrame, go_module: str | None = None, inline: DataFrame | None = None) -> dict[str, DataFrame]:
    edges, modules = module_edges(files, go_module, inline)
    return {"modules": coupling.ranked(coupling.module_metrics(edges, modules)), "edges": coupling.ordered(edges), "pairs": coupling.pairs(edges).orderBy(F.desc("shared_symbols"), "a", "b"), "cycles": coupling.cycles(edges).orderBy(F.desc("size"), "members")}


def entered(files: DataFrame, entries: list[str], go_module: str | None = None) -> DataFrame:
    """The files that imports reach from files matching the globs. No match is an error."""
    edges, modules = module_edges(files, go_module)
    starts = modules.where(paths.excluded(F.col("file"), entries)).select(F.col("path").alias("node")).distinct()
    if starts.isEmpty():
        raise ValueError(f"no file matches {entries}")
    reached = reachable_from(edges.select(F.col("from").alias("src"), F.col("to").alias("dst")), starts)
    return files.join(reached.withColumnRenamed("node", "module"), "module", "left_semi").select(*files.columns)


def context_spans(files: DataFrame, entries: list[str] | None = None, go_module: str | None = None, inline: DataFrame | None = None) -> DataFrame:
    """With entry globs, of the modules that imports reach from them only."""
    edges, modules = module_edges(entered(files, entries, go_module) if entries else files, go_module, inline)
    return coupling.context_spans(edges, modules).orderBy(F.desc("transitive"), F.desc("files"), F.desc("direct"), "path")
