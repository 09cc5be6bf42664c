"""Adapters, source trees, analyses and events."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry import cli, render
from quarry.operators import similarity
from quarry.plans import analyses, reports
from quarry.sources import brace_source, facts, files, git, python_source
from quarry.streaming import hooks


@pytest.mark.parametrize("source,expected", [
    ("def noop():\n    x = 1 + 2\n", (1, 0, 0)), ("def f(x):\n    if x > 0:\n        return 1\n    else:\n        return 0\n", (2, 2, 1)),
    ("def f(x):\n    if x > 0:\n        return 1\n    elif x < 0:\n        return -1\n    else:\n        return 0\n", (3, 3, 1)), ("def f(x):\n    match x:\n        case 0: return 1\n        case 1: return 2\n        case _: return 3\n", (3, 1, 1)),
    ("def f(a, b, c):\n    return a and b or c\n", (3, 2, 0)), ("def f(x):\n    return 1 if x > 0 else 0\n", (2, 1, 1)), ("def f():\n    try:\n        g()\n    except E:\n        return 1\n", (2, 1, 1)),
    ("def f(a):\n    if a:\n        for x in a:\n            for y in x:\n                g(y)\n", (4, 6, 3)), ("def f(a):\n    if a:\n        while a:\n            a.pop()\n", (3, 3, 2)),
])
def test_python_complexity(source, expected):
    assert python_source.rows("units", source, "m")[0][3:6] == expected


@pytest.mark.parametrize("adapter,source,expected", [
    (brace_source.rust, "fn f(x: i32) -> i32 { if x > 0 { 1 } else if x < 0 { 2 } else { 0 } }", (3, 4, 2)), (brace_source.rust, "fn f(x: i32) -> i32 { match x { 0 => 1, 1 => 2, _ => 3 } }", (3, 1, 1)),
    (brace_source.go, "func F(a int) int {\n if a > 0 { return 1 } else if a < 0 { return 2 } else { return 3 }\n}", (3, 3, 1)), (brace_source.typescript, "function f(a) { for (const x of a) { if (x && a) { g(x); } } }", (4, 4, 2)),
])
def test_brace_complexity(adapter, source, expected):
    assert adapter("units", source, "m")[0][3:6] == expected


@pytest.mark.parametrize("source,name,callee,adapters", [("fn a(x: i32) -> i32 { b(x) }", "a", "b", []), ("fn a(x: i32) -> u64 { b(x).into() }", "a", "b", [".into()"]), ("fn a(x: i32) -> R { b(x)? }", "a", "b", ["?"]), ("fn a(x: i32) -> String { b(x).unwrap().to_string() }", "a", "b", [".unwrap()", ".to_string()"])])
def test_rust_wrappers(source, name, callee, adapters):
    (found,) = brace_source.rust("wrappers", source, "crate")
    assert (found[0], *found[3:5]) == (name, callee, adapters)


@pytest.mark.parametrize("body,adapters", [("b(x).try_into()", [".try_into()"]), ('b(x).expect("no")', [".expect()"]), ("b(x).map_err(|e| e.into())?", [".map_err()", "?"]), ("b(x).unwrap_or_default()", [".unwrap_or_default()"])])
def test_rust_adapters(body, adapters):
    (found,) = brace_source.rust("wrappers", f"fn a(x: i32) -> R {{ {body} }}", "crate")
    assert found[4] == adapters


def test_rust_calls_that_are_no_adapters():
    assert brace_source.rust("wrappers", "fn a(x: i32) -> R { b(x).collect() }", "crate") == []
    assert brace_source.rust("wrappers", "fn a(x: i32, y: i32) -> R { b(x).expect(y) }", "crate") == []
    shims = "impl T { fn new() -> T { T::default() } fn default() -> T { Self::new() } fn other() -> T { T::default() } }"
    assert [w[0] for w in brace_source.rust("wrappers", shims, "crate")] == ["T::other"]
    assert [w[0] for w in brace_source.rust("wrappers", "fn new(x: i32) -> R { b(x) }", "crate")] == ["new"]


def test_wrapper_limits():
    assert python_source.rows("wrappers", "def f(a, b=1):\n    return g(a, b)\n", "m") == []
    assert python_source.rows("wrappers", 'def f(a):\n    "doc"\n    return g(a)\n', "m") == []
    assert python_source.rows("wrappers", "class S:\n    def f(self, x):\n        return self.inner.g(x)\n", "m")[0][0] == "S::f"
    assert brace_source.typescript("wrappers", "function f(a) { return new K(a); }", "m") == []


def test_go_facts():
    source = 'package p\nimport m "a/b"\ntype T struct{ x int }\nfunc (t *T) Get(a int) int { return m.Add(a) }\nfunc TestX(t *testing.T) {}\n'
    functions = brace_source.go("functions", source, "p")
    assert [(f[0], f[3], f[6]) for f in functions] == [("Get", "T", False), ("TestX", None, True)]
    assert brace_source.go("wrappers", source, "p")[0][3] == "m.Add"
    assert brace_source.go("imports", source, "p")[0][2] == ["a", "b"]


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "tests").mkdir()
    same = "    total = 0\n    for x in xs:\n        if x:\n            total += x\n    return total\n"
    (tmp_path / "pkg/__init__.py").write_text("")
    (tmp_path / "pkg/helper.py").write_text("def helper(xs):\n" + same)
    (tmp_path / "pkg/main.py").write_text("from .helper import helper\n\ndef copy(xs):\n" + same + "\ndef local():\n    return 1\n\ndef caller():\n    local()\n    return helper([1])\n")
    (tmp_path / "pkg/broken.py").write_text("def (:\n")
    (tmp_path / "tests/test_x.py").write_text("def test_x():\n    assert True\n")
    (tmp_path / ".gitignore").write_text("skipped/\n*.gen.py\n")
    (tmp_path / "skipped").mkdir()
    (tmp_path / "skipped/a.py").write_text("x = 1\n")
    (tmp_path / "pkg/a.gen.py").write_text("x = 1\n")
    return tmp_path


def test_tree_is_walked_with_ignore_rules(spark, tree):
    found = files.read_tree(spark, str(tree), exclude_tests=True)
    assert sorted(r["file"] for r in found.collect()) == ["pkg/__init__.py", "pkg/broken.py", "pkg/helper.py", "pkg/main.py"]


def test_analyses(spark, tree):
    found = files.read_tree(spark, str(tree))
    nodes, edges, _ = analyses.call_graph(found)
    resolved = {(r["callee_name"], r["resolution"]) for r in edges.collect()}
    assert {("local", "resolved"), ("helper", "resolved")} <= resolved
    _, pairs, clusters = analyses.similar(found)
    assert [r["members"] for r in clusters.collect()] == [[0, 1]] and pairs.first()["similarity"] == pytest.approx(1.0)
    spans = {r["path"]: r["transitive"] for r in analyses.context_spans(found).collect()}
    assert spans["pkg::main"] == 1 and spans["pkg::helper"] == 0


def test_reports(spark, tree):
    parts = cli.run(spark, cli.arguments(["complexity", str(tree)]))
    found = json.loads(render.to_json(parts))
    assert (found["file_count"], found["function_count"]) == (3, 5) and found["root"] == str(tree) and found["summary"]
    assert [(f["file"], f["function_count"], [x["name"] for x in f["functions"]]) for f in found["files"]] == [("pkg/helper.py", 1, ["helper"]), ("pkg/main.py", 3, ["copy", "local", "caller"]), ("tests/test_x.py", 1, ["test_x"])]
    assert found["files"][0]["functions"][0]["cognitive"] == 3
    assert render.to_json(parts).endswith("}\n") and "| file |" in render.to_markdown("x", parts)


def test_report_counts(spark, tree):
    of = lambda *a: json.loads(render.to_json(cli.run(spark, cli.arguments([a[0], str(tree), *a[1:]]))))
    graph = of("function-graph")
    assert graph["language"] == "python" and graph["node_count"] == len(graph["nodes"]) == 5 and graph["edge_count"] == len(graph["edges"])
    assert graph["groups"] == [{"group": "pkg", "size": 4}, {"group": "tests", "size": 1}]
    coupled = of("coupling")
    assert (coupled["module_count"], coupled["edge_count"], coupled["cycle_count"]) == (5, 1, 0)
    assert of("context-span")["module_count"] == 5 and of("wrapper")["wrapper_count"] == 0 and (of("cohesion")["file_count"], of("cohesion")["unit_count"]) == (1, 1)
    similar = of("similarity", "--statistics")
    assert (similar["function_count"], similar["cluster_count"], similar["threshold"], similar["min_lines"]) == (2, 1, 0.85, 5)
    (cluster,) = similar["clusters"]
    assert cluster["size"] == 2 and [f["name"] for f in cluster["functions"]] == ["helper", "copy"]
    assert [(p["a"]["name"], p["b"]["name"], p["similarity"]) for p in cluster["pairs"]] == [("helper", "copy", pytest.approx(1.0))] and "type_overlap" not in cluster["pairs"][0]
    assert similar["statistics"] == {"candidate_pairs": 1, "exact_pairs": 1, "size_pairs": 0, "label_pairs": 0, "arity_pairs": 0, "shingle_pairs": 0, "scored_pairs": 0}


def test_report_to_a_file(spark, tree, tmp_path):
    assert cli.main(["function-graph", str(tree), "--output", str(tmp_path / "graph.json")]) == 0
    assert json.loads((tmp_path / "graph.json").read_text())["node_count"] == 5


def test_labels_and_groups(spark):
    of = lambda *langs: reports.language_label(spark.createDataFrame([(x,) for x in langs], "lang string")).first()["language"]
    assert [of(), of("go", "go"), of("go", "rust")] == ["unknown", "go", "mixed"]
    paths = spark.createDataFrame([(x,) for x in ("crates/a/x.rs", "crates/a/y.rs", "crates/b/x.rs", "web/x.ts", "alone.rs", "crates")], "file string")
    assert [tuple(r) for r in reports.group_sizes(paths).collect()] == [("a", 2), ("alone.rs", 1), ("b", 1), ("crates", 1), ("web", 1)]


def test_pairs_of_a_cluster_are_ordered(spark):
    functions = spark.createDataFrame([(i, "f.py", f"f{i}", i, i + 1, False) for i in range(4)], "idx long, file string, name string, start_line int, end_line int, is_test boolean")
    pairs = spark.createDataFrame([(1, 2, 0.9), (0, 2, 0.9), (0, 1, 0.95), (2, 3, 0.99)], "i long, j long, similarity double")
    clusters = spark.createDataFrame([(0, [0, 1, 2], 0.9, 0.95)], "cluster_id int, members array<long>, min_similarity double, max_similarity double")
    (row,) = reports.cluster_views(functions, pairs, clusters).collect()
    assert [(p["a"]["name"], p["b"]["name"]) for p in row["pairs"]] == [("f0", "f1"), ("f0", "f2"), ("f1", "f2")] and row["size"] == 3


def test_bounds_are_counted(spark):
    trees = [["A", "B"], ["A", "B"], ["A", "C"], ["A"] + ["B"] * 30]
    rows = [(i, {"labels": t, "sizes": [len(t)] + [1] * (len(t) - 1)}, None, False) for i, t in enumerate(trees)]
    found = spark.createDataFrame(rows, f"idx long, tree {facts.TREE}, signature {facts.SIGNATURE}, is_test boolean")
    counted = similarity.statistics(found).first().asDict()
    assert counted["candidate_pairs"] == 6 and counted["exact_pairs"] == 1 and counted["size_pairs"] == 3
    assert sum(v for k, v in counted.items() if k != "candidate_pairs") == 6


def test_sources_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "a.py").write_bytes(b"\xff\xfe")
    (tmp_path / "b.py").write_text("x = 1\n")
    with pytest.raises(files.UnsupportedExtension):
        files.read_tree(spark, str(tmp_path / "a.txt"))
    with pytest.raises(OSError):
        files.read_tree(spark, str(tmp_path / "a.py"))
    with pytest.raises(FileNotFoundError):
        files.read_tree(spark, str(tmp_path / "none"))
    assert files.read_source(str(tmp_path / "b.py")) == ("python", "x = 1\n")


def written(folder, texts):
    for path, text in texts.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)


def test_rust_module_tree(spark, tmp_path):
    written(tmp_path, {
        "Cargo.toml": '[package]\nname = "my-tool"\n', "src/lib.rs": "mod net;\nmod flat;\nmod inner {\n  pub mod deep { pub fn f() {} }\n}\nuse crate::flat::x;\n", "src/net/mod.rs": "pub mod tcp;\nuse crate::inner::deep::f;\n",
        "src/net/tcp.rs": "use super::super::flat::x;\n", "src/flat.rs": "pub fn x() {}\n", "src/unused.rs": "use crate::flat::x;\n",
    })
    parts = cli.run(spark, cli.arguments(["coupling", str(tmp_path)]))
    assert {r["path"] for r in parts["modules"].collect()} == {"crate", "crate::net", "crate::net::tcp", "crate::flat", "crate::inner", "crate::inner::deep"}
    assert {("crate", "crate::flat", "x"), ("crate::net", "crate::inner::deep", "f")} <= {(r["from"], r["to"], r["symbol"]) for r in parts["edges"].collect()}
    # other analyses name modules by the package, so that crates of one tree stay apart
    assert {r["file"]: r["module"] for r in files.read_tree(spark, str(tmp_path)).collect()}["src/net/tcp.rs"] == "my_tool::net::tcp"
    (tmp_path / "src/flat.rs").write_text("mod lost;\npub fn x() {}\n")
    with pytest.raises(ValueError, match="lost"):
        cli.run(spark, cli.arguments(["coupling", str(tmp_path)]))


def test_typescript_imports_are_probed(spark):
    texts = {
        "src/main.ts": "import { a as b } from './util';\nimport d from './both';\nimport './side.js?raw';\nimport * as n from '../lib';\nimport { z } from './none';\nimport { q } from '../../out';\nimport { w } from './data.json';\n",
        "src/util/index.ts": "export const a = 1;\n", "src/both.ts": "export default 1;\n", "src/both.js": "module.exports = 1;\n", "src/side.js": "1;\n", "lib/index.jsx": "export * from '../src/util/index';\n", "out.ts": "export const q = 1;\n",
    }
    found = files.described(spark.createDataFrame(list(texts.items()), "file string, source string"))
    edges = {(r["from"], r["to"], r["symbol"]) for r in analyses.coupled(found)["edges"].collect()}
    assert edges == {("src::main", "src::util::index", "a"), ("src::main", "src::both", "default"), ("src::main", "src::side", "*"), ("src::main", "lib::index", "*"), ("lib::index", "src::util::index", "*")}


def test_json_is_whole_and_markdown_is_cut(spark, tree):
    of = lambda *more: cli.run(spark, cli.arguments(["complexity", str(tree), "--top", "1", *more]))
    assert of("--format", "md")["functions"].count() == 1 and of()["function_count"] > 1


def test_git_sources(spark, tree):
    def run(*a):
        subprocess.run(["git", "-C", str(tree), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)

    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "1")
    (tree / "pkg/main.py").write_text((tree / "pkg/main.py").read_text() + "\nx = 1\n")
    changed = git.changed_ranges(spark, str(tree)).collect()
    assert len(changed) == 1 and changed[0]["start"] >= 14
    run("commit", "-qam", "2")
    assert {r["path"]: r["commits"] for r in git.churn(spark, str(tree)).collect()}["pkg/main.py"] == 2
    rows = cli.run(spark, cli.arguments(["hotspot", str(tree)]))["files"].collect()
    assert rows[0]["path"] == "pkg/main.py" and rows[0]["score"] == 6


def test_events(spark, tree, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    base = {"session_id": "s", "cwd": str(tree), "transcript_path": "t"}
    events = [
        base | {"hook_event_name": "PreToolUse", "tool_name": "Edit", "tool_input": json.dumps({"file_path": "pkg/main.py"})}, base | {"hook_event_name": "PreToolUse", "tool_name": "Bash", "tool_input": json.dumps({"command": "ls"})},
        base | {"hook_event_name": "PreToolUse", "tool_name": "apply_patch", "tool_input": json.dumps({"command": "*** Update File: a.py\n*** Add File: b.py\n"})}, {},
    ]
    (folder / "1.json").write_text("\n".join(map(json.dumps, events)) + "\n")
    lines = spark.read.text(str(folder))
    assert [r["valid"] for r in hooks.parsed(lines).collect()].count(False) == 1
    assert sorted(r["path"].rpartition("/")[2] for r in hooks.edited_paths(hooks.parsed(lines)).collect()) == ["a.py", "main.py"]
    seen = []
    hooks.listen(spark, str(folder), str(tmp_path / "check"), lambda event, n, found: seen.append((event, found["complexity"].count(), found["cohesion"].count()))).awaitTermination()
    assert seen and seen[0][0] == "PreToolUse"
    assert hooks.answer("SessionStart", "x")["hookSpecificOutput"]["additionalContext"] == "x" and hooks.answer("PostToolUse", "") == {}


def test_unreadable_texts_are_listed(spark, tree):
    from quarry.sources.facts import extract, unparsed

    found = files.read_tree(spark, str(tree))
    assert [r["file"] for r in unparsed(found).collect()] == ["pkg/broken.py"]
    assert extract(found, "units").where(F.col("file") == "pkg/broken.py").count() == 0


def test_go_imports_below_the_module_only(spark, tmp_path):
    for path, text in {"go.mod": "module example.org/app\n\ngo 1.22\n", "main.go": 'package main\nimport (\n "example.org/app/util"\n "other.net/x/util"\n "example.org/app/missing"\n)\nfunc main() { util.Run() }\n', "util/run.go": "package util\nfunc Run() {}\n", "sub/a.go": 'package sub\nimport "other.net/x/util"\nfunc A() { util.Run() }\n'}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    assert files.go_module(str(tmp_path / "sub")) == "example.org/app/sub"
    parts = cli.run(spark, cli.arguments(["coupling", str(tmp_path)]))
    assert {(r["from"], r["to"]) for r in parts["edges"].collect()} == {("", "util")}


def test_duplicates_within_edited_files(spark):
    one = "def {n}(xs):\n    total = 0\n    for x in xs:\n        total += x\n    return total\n\n"
    texts = {"a.py": one.format(n="f") + one.format(n="g"), "b.py": one.format(n="h"), "c.py": "def short():\n    return 1\n"}
    found = files.described(spark.createDataFrame(list(texts.items()), "file string, source string"))
    assert [r["members"] for r in hooks.similar_within(found).collect()] == [[0, 1]]


def test_sessions_that_start(spark, tree, tmp_path):
    folder = tmp_path / "starts"
    folder.mkdir()
    base = {"hook_event_name": "SessionStart", "session_id": "s", "transcript_path": "t"}
    (folder / "1.json").write_text("\n".join(json.dumps(base | {"cwd": c}) for c in (str(tree), "/no/such/folder")) + "\n")
    seen = []
    hooks.listen(spark, str(folder), str(tmp_path / "starts-check"), lambda event, n, found: seen.append((event, sorted(found)))).awaitTermination()
    assert seen == [("SessionStart", ["modules", "pairs"])]
    assert "additionalContext" in hooks.answer("PostToolUse", "x", "codex")["hookSpecificOutput"] and hooks.answer("PostToolUse", "x") == {"systemMessage": "x"}


def test_rust_coupling_and_entries(spark):
    texts = {
        "lib.rs": "pub mod a;\npub mod b;\n", "a.rs": "pub struct Foo;\npub trait Show {}\npub fn helper() {}\n",
        "b.rs": "use crate::a::{helper, Foo};\nuse crate::a;\npub fn run(x: Foo) { helper(); a::helper(); }\nimpl a::Show for Bar { fn show(&self) {} }\n", "main.ts": "import { x } from './util';\nfunction f() { return x(); }\n", "util.ts": "export function x() { return 1; }\n", "lone.ts": "export const y = 1;\n",
    }
    found = files.described(spark.createDataFrame(list(texts.items()), "file string, source string"))
    edges = {(r["from"], r["to"], r["symbol"], r["kind"]) for r in analyses.coupled(found)["edges"].collect()}
    assert {("crate::b", "crate::a", "Foo", "use"), ("crate::b", "crate::a", "Foo", "type"), ("crate::b", "crate::a", "helper", "use"), ("crate::b", "crate::a", "helper", "call"), ("main", "util", "x", "use")} <= edges
    assert {r["path"]: r["transitive"] for r in analyses.context_spans(found, ["main.ts"]).collect()} == {"main": 1, "util": 0}
    with pytest.raises(ValueError):
        analyses.context_spans(found, ["none.ts"])
    parts = hooks.session_start(found)
    assert parts["modules"].columns and parts["pairs"].first()["shared_symbols"] >= 2
