"""Operators against values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import metrics, paths
from quarry.operators import callgraph, cohesion, coupling, diff, graph, hotspot, similarity, wrapper


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_halstead_volume(spark):
    lit = F.lit
    assert one(spark, metrics.halstead_volume(lit(2), lit(2), lit(4), lit(4))) == 16.0
    assert one(spark, metrics.halstead_volume(lit(0), lit(0), lit(0), lit(0))) is None
    assert one(spark, metrics.saturating_product(lit(2**62), lit(4))) == 2**63 - 1


@pytest.mark.parametrize("path,expected", [("tests/api.rs", True), ("src/foo.cy.ts", True), ("pkg/conftest.py", True), ("src/foo_test.generated.rs", True), ("src/testsupport.rs", False), ("src/latest.rs", False), ("src/contest.rs", False), ("", False), ("src\\Tests\\x.rs", True)])
def test_test_paths(spark, path, expected):
    assert one(spark, paths.looks_like_test(F.lit(path))) is expected


@pytest.mark.parametrize("pattern,path,expected", [("*.ts", "a/b.ts", True), ("src/*.ts", "src/a.ts", True), ("a/**/b", "a/x/y/b", True), ("a/**/b", "a/b", True), ("{x,y}.go", "d/y.go", True), ("[!a].py", "a.py", False), ("fr", "x/fr", True), ("fr", "fry", False)])
def test_globs(spark, pattern, path, expected):
    assert one(spark, paths.excluded(F.lit(path), [pattern])) is expected


def test_names(spark):
    assert one(spark, paths.identifier_tokens(F.lit("parseHTTPRequest_v2"))) == ["parse", "httprequest", "v2"]
    assert one(spark, paths.parent(F.lit("a::b::c"))) == "a::b"
    assert one(spark, paths.parent(F.lit("a"))) is None
    assert one(spark, paths.module_path(F.lit("src/pkg/__init__.py"), F.lit("python"))) == "src::pkg"
    assert one(spark, paths.module_path(F.lit("src/net/mod.rs"), F.lit("rust"))) == "crate::net"
    assert one(spark, paths.patch_paths(F.lit("*** Update File: a.py\nx\n*** Add File: b.py "))) == ["a.py", "b.py"]


def test_hotspots_order_and_kept_zeros(spark):
    churn = spark.createDataFrame([("a", 3), ("b", 2), ("gone", 9)], "path string, commits long")
    files = spark.createDataFrame([("a", 1, 1, 1, 2), ("b", 1, 1, 1, 3), ("c", 0, 0, 0, 0)], "path string, function_count long, loc long, cyclomatic_max long, cognitive_max long")
    assert [(r["path"], r["score"]) for r in hotspot.ranked(hotspot.hotspots(churn, files)).collect()] == [("a", 6), ("b", 6), ("c", 0)]


def test_coupling_of_a_diamond(spark):
    edges = spark.createDataFrame([("a", "b", "x", "use"), ("a", "c", "x", "use"), ("b", "d", "y", "use"), ("c", "d", "y", "call"), ("c", "d", "y", "call"), ("d", "d", "z", "use")], ["from", "to", "symbol", "kind"])
    modules = spark.createDataFrame([(m, m) for m in "abcd"], ["path", "file"])
    found = {r["path"]: (r["fan_in"], r["fan_out"], r["ifc"]) for r in coupling.module_metrics(edges, modules).collect()}
    assert found == {"a": (0, 2, 0), "b": (1, 1, 1), "c": (1, 1, 1), "d": (2, 0, 0)}
    assert coupling.normalised(edges).count() == 4
    assert coupling.cycles(edges).count() == 0
    spans = {r["path"]: (r["direct"], r["transitive"], r["files"]) for r in coupling.context_spans(edges, modules).collect()}
    assert spans == {"a": (2, 3, 3), "b": (1, 1, 1), "c": (1, 1, 1), "d": (0, 0, 0)}


def test_cycles_and_components(spark):
    edges = spark.createDataFrame([("a", "b", "", "use"), ("b", "c", "", "use"), ("c", "a", "", "use"), ("c", "d", "", "use"), ("d", "e", "", "use"), ("e", "d", "", "use"), ("x", "a", "", "use")], ["from", "to", "symbol", "kind"])
    assert sorted((r["members"], r["size"]) for r in coupling.cycles(edges).collect()) == [(["a", "b", "c"], 3), (["d", "e"], 2)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], ["src", "dst"])
    assert {r["component"] for r in graph.components(chain).collect()} == {0, 100}
    empty = spark.createDataFrame([], "src long, dst long")
    assert graph.closure(empty).count() == 0 and graph.components(empty).count() == 0


def test_cohesion(spark):
    rows = [(1, 0, "bump", ["counter"], []), (1, 1, "current", ["counter"], []), (1, 2, "record", ["log"], []), (1, 3, "dump", ["log"], []), (2, 0, "a", [], ["b"]), (2, 1, "b", [], []), (2, 2, "idle", [], [])]
    methods = spark.createDataFrame(rows, "unit_id long, method_idx int, name string, fields array<string>, calls array<string>")
    found = {r["unit_id"]: r for r in cohesion.cohesion(methods).collect()}
    assert found[1]["lcom96"] == pytest.approx(2 / 3) and found[1]["lcom4"] == 2
    assert (found[2]["lcom96"], found[2]["component_count"], found[2]["inert_method_count"], found[2]["lcom4"]) == (None, 2, 1, 1)


def test_cohesion_by_rows(spark, monkeypatch):
    """Random units, null fields and a null unit against a reading by rows; methods without links do not take part in the search for components."""
    dice = random.Random(5)
    rows = [(u, m, f"m{m}", [dice.choice([*"abcdefgh", None]) for _ in range(dice.randrange(4))], [f"m{dice.randrange(9)}"] * dice.randrange(2)) for u in (1, 2, 3, None) for m in range(8)] + [(4, m, f"m{m}", [str(m)], []) for m in range(3)] + [(5, 0, "x", [], [])]
    methods = spark.createDataFrame(rows, "unit_id long, method_idx int, name string, fields array<string>, calls array<string>")
    searched = []
    monkeypatch.setattr(cohesion, "components", lambda links: searched.extend(links.collect()) or graph.components(links))
    found = {r["unit_id"]: tuple(r)[1:] for r in cohesion.cohesion(methods).collect()}
    assert searched and all(r["src"] != r["dst"] for r in searched)
    labels = {(r["unit_id"], r["method_idx"]): r["component"] for r in cohesion.method_components(methods.where("unit_id is not null")).collect()}
    for u in (1, 2, 3, 4, 5):
        own = {r[1]: r for r in rows if r[0] == u}
        group = {m: m for m in own}
        for _ in own:
            for a in own:
                for b in own:
                    if {x for x in own[a][3] if x} & {x for x in own[b][3] if x} or own[b][2] in own[a][4]:
                        group[a] = group[b] = min(group[a], group[b])
        assert {m: labels[u, m] for m in own} == group
        uses = [x for r in own.values() for x in set(r[3])]
        inert = sum(not r[3] and not r[4] and list(group.values()).count(group[m]) == 1 for m, r in own.items())
        lcom96 = (len(uses) / len(set(uses)) - len(own)) / (1.0 - len(own)) if uses and len(own) > 1 else None
        parts = len(set(group.values()))
        assert found[u] == (len(own), parts, inert, parts - inert, lcom96)
    assert set(found) == {1, 2, 3, 4, 5}


def test_wrapper_reuse(spark):
    wrappers = spark.createDataFrame([("wrap.rs", "render"), ("wrap.rs", "lonely")], ["file", "name"])
    calls = spark.createDataFrame([("caller.rs", "consumer", "render"), ("wrap.rs", "render", "render"), ("caller.rs", None, "render"), ("caller.rs", None, "render")], ["file", "caller", "callee"])
    found = {r["name"]: tuple(r)[2:] for r in wrapper.reuse(wrappers, calls).collect()}
    assert found == {"render": (3, 2, False), "lonely": (0, 0, True)}


def test_wrapper_reuse_by_rows(spark):
    """Null and empty files, unknown callers, full names that share a last segment, many files: against a reading by rows. Calls are made once, and their parts stay apart."""
    names, files = ["a::x", "b::x", "x", "y", "a::y"], ["f", "g", "", None]
    wrappers = [(f, n) for f in files[:3] for n in names[:4]] + [(None, "a::x"), ("f", "lonely")]
    calls = [(files[i * 7 % 4], [None, "", "main", *names][i * 5 % 8], ["x", "c::x", "y", None, "z"][i * i % 5]) for i in range(40)] + [("g", "y", "y"), (None, "y", "y"), ("f", "a::x", "q::w")]
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    frame = spark.createDataFrame(calls, "file string, caller string, callee string")
    out = wrapper.reuse(spark.createDataFrame(wrappers, "file string, name string"), frame.mapInArrow(count, frame.schema))
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    expected = []
    for f, n in wrappers:
        met = [c for c in calls if c[2] is not None and c[2].split("::")[-1] == n.split("::")[-1] and c[1] != n]
        expected.append((f, n, len(met), len({c[:2] for c in met}), f is None and not any(c[0] is not None for c in met) or f is not None and all(c[0] in (None, f) for c in met)))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, expected))
    assert made.value == len(calls)


def test_tasks_grow_with_rows(spark):
    assert graph.task_count(spark) == 4 and graph.task_count(spark, 10) == 4 and graph.task_count(spark, 2_500_001) == 11


CALL = "file string, caller_qualified_name string, caller_module string, caller_owner string, callee_name string, callee_path array<string>, receiver string, imports array<struct<alias:string,target:string,exported:string>>, line int"


def test_call_resolution(spark):
    nodes = spark.createDataFrame([("1", "f", "m::Service::helper"), ("2", "f", "m::Service::caller"), ("3", "g", "a::same"), ("4", "h", "b::same"), ("5", "g", "a::Foo::new"), ("6", "g", "a::deep::only")], ["id", "file", "qualified_name"])
    caller = "m::Service::caller"
    calls = [
        ("f", caller, "m", "Service", "helper", None, "self", [], 1), ("f", caller, "m", "Service", "same", ["same"], None, [], 2), ("f", caller, "m", "Service", "new", ["String", "new"], None, [], 3),
        ("f", caller, "m", "Service", "new", ["Foo", "new"], None, [], 4), ("f", caller, "m", "Service", "same", ["x", "same"], None, [("x", "a", None)], 5), ("f", caller, "a", None, "same", None, "expression", [], 6),
        ("f", caller, "m", None, None, None, None, [], 7), ("f", "m::nobody", "m", None, "same", ["same"], None, [], 8), ("f", None, "m", None, "only", ["only"], None, [], 9), ("f", caller, "a::deep", None, "same", ["super", "same"], None, [], 10),
    ]
    found = {r["line"]: (r["to"], r["resolution"]) for r in callgraph.resolve(spark.createDataFrame(calls, CALL), nodes).collect()}
    assert found == {1: ("1", "resolved"), 2: (None, "ambiguous"), 3: (None, "unresolved"), 4: ("5", "resolved"), 5: ("3", "resolved"), 6: ("3", "resolved"), 7: (None, "anonymous"), 9: ("6", "resolved"), 10: ("3", "resolved")}


def test_hunks_and_overlap(spark):
    lines = spark.createDataFrame([("f", "@@ -1,0 +3,2 @@"), ("f", "@@ -10 +20 @@ x"), ("f", "@@ -5,1 +7,0 @@"), ("f", "+a")], ["file", "line"])
    assert sorted((r["start"], r["end"]) for r in diff.hunks(lines).collect()) == [(3, 4), (20, 20)]
    spans = spark.createDataFrame([("f", 10, 12), ("f", 13, 20), ("g", 1, 50)], ["file", "start_line", "end_line"])
    changes = spark.createDataFrame([("f", 12, 12)], ["file", "start", "end"])
    assert [r["start_line"] for r in diff.touched(spans, changes).collect()] == [10]


def encode(tree):
    labels, sizes = [], []

    def add(t):
        at = len(labels)
        labels.append(t[0])
        sizes.append(1)
        for c in t[1]:
            add(c)
        sizes[at] = len(labels) - at

    add(tree)
    return labels, sizes


def n(label, *children):
    return label, list(children)


@pytest.mark.parametrize("a,b,costs,expected", [
    (n("R", n("A"), n("B"), n("C")), n("R"), (1, 1, 1), 3.0), (n("R", n("A")), n("R", n("A"), n("B", n("C"), n("D"))), (1, 1, 1), 3.0),
    (n("R", n("A")), n("R"), (1, 2.5, 1), 2.5), (n("R", n("X"), n("Y"), n("Z")), n("R", n("X")), (10, 2, 1), 4.0),
])
def test_tree_distance(a, b, costs, expected):
    assert similarity.tree_distance(*encode(a), *encode(b), *costs) == expected


def test_tree_similarity_and_clusters():
    opts = similarity.Options(rename=1.0, size_penalty=False)
    a, b = n("R", n("A"), n("B"), n("C"), n("D")), n("R", n("A"), n("B"), n("C"), n("Z"))
    assert similarity.tsed(*encode(a), *encode(b), opts) == pytest.approx(0.8)
    assert similarity.Options().body_threshold == pytest.approx(0.8125)
    assert similarity.complete_link([(0, 1, 0.9), (1, 2, 0.9)], 0.85) == [([0, 1], 0.9, 0.9)]
    assert similarity.complete_link([(0, 1, 0.9), (1, 2, 0.95), (0, 2, 0.86)], 0.85) == [([0, 1, 2], 0.86, 0.95)]


def test_bounds_never_drop_a_pair_that_reaches_the_threshold(spark):
    import random

    r = random.Random(5)

    def tree(depth):
        return r.choice("ABCDE"), [tree(depth - 1) for _ in range(r.randint(0, 3))] if depth else []

    def changed(t):
        return (r.choice("ABCDE") if r.random() < 0.15 else t[0], [changed(c) for c in t[1] if r.random() > 0.05])

    opts = similarity.Options(threshold=0.6)
    pairs = []
    for k in range(60):
        a = tree(3)
        b = changed(a) if k % 2 else tree(3)
        pairs.append((k, encode(a), encode(b)))
    rows = [(k, dict(zip(("labels", "sizes"), a)), dict(zip(("labels", "sizes"), b))) for k, a, b in pairs]
    frame = spark.createDataFrame(rows, "k int, a struct<labels:array<string>,sizes:array<int>>, b struct<labels:array<string>,sizes:array<int>>")
    kept = {row["k"] for row in similarity.with_bounds(frame, opts).collect()}
    reach = {k for k, a, b in pairs if similarity.tsed(*a, *b, opts) >= opts.body_threshold}
    assert reach <= kept and len(kept) < len(pairs)


def test_candidates_are_the_pairs_of_all_bands(spark):
    import random

    r = random.Random(3)
    shapes = [[f"L{r.randrange(9)}" for _ in range(k % 30)] for k in range(70)] + [["A"] * 9 + [f"L{k}"] for k in range(3)]
    trees = [(1000 - k, {"labels": shapes[k % len(shapes)], "sizes": [1] * len(shapes[k % len(shapes)])}) for k in range(260)]
    frame = spark.createDataFrame(trees, "idx long, tree struct<labels:array<string>,sizes:array<int>>")
    opts = similarity.Options()
    rows = opts.hashes // opts.bands
    plain = similarity.band_pairs(similarity.bands(similarity.signed(frame, F.col("tree.labels"), rows * opts.bands), opts.bands, rows))
    found = [(row["i"], row["j"]) for row in similarity.candidate_pairs(frame, opts).collect()]
    assert len(found) == len(set(found)) and set(found) == {(row["i"], row["j"]) for row in plain.collect()}
    with pytest.raises(ValueError, match=f"{len(found)} candidate pairs"):
        similarity.candidate_pairs(frame, similarity.Options(max_pairs=len(found) - 1))


def test_near_copies_meet_in_a_band(spark):
    import random

    r = random.Random(1)
    trees, wanted = [], []
    for k in range(120):
        labels = [f"L{r.randrange(16)}" for _ in range(40)]
        other = list(labels)
        other[r.randrange(40)] = "X"
        trees += [(2 * k, {"labels": labels, "sizes": [1] * 40}), (2 * k + 1, {"labels": other, "sizes": [1] * 40})]
        wanted.append((2 * k, 2 * k + 1))
    frame = spark.createDataFrame(trees, "idx long, tree struct<labels:array<string>,sizes:array<int>>")
    found = {(row["i"], row["j"]) for row in similarity.candidate_pairs(frame, similarity.Options()).collect()}
    assert len(found & set(wanted)) >= 0.95 * len(wanted) and len(found) < 2000


def test_signatures_hash_each_shingle_once(spark):
    import hashlib

    shapes = [None, [], ["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "a", "b", "c", "d"], ["", "x", "", "y"]]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(shapes)] + [(4, shapes[4]), (4, ["z"])], "idx long, labels array<string>")

    def plain(labels, k):
        runs = ["\x1f".join(labels[i : i + 3]) for i in range(max(len(labels) - 2, 1))] if labels else []
        x = [int(hashlib.md5(run.encode()).hexdigest()[:8], 16) for run in runs]
        return [min([(v * a + b) % similarity.PRIME for v in x], default=similarity.PRIME) for a, b in similarity.coefficients(k)]

    for k in (4, similarity.AGGREGATED + 1):
        signed = similarity.signed(frame, F.col("labels"), k)
        assert sorted((r["idx"], r["signature"]) for r in signed.collect()) == sorted((r["idx"], plain(r["labels"], k)) for r in frame.collect())
        # merged with the minima, the hashes would be made once per coefficient
        plan = signed._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") == 1 and not any("md5(" in line and str(similarity.PRIME) in line for line in plan.splitlines())


def test_large_trees_are_aligned_by_few_matches(spark, monkeypatch):
    import random

    r = random.Random(2)

    def tree(deep):
        inner = [n(f"g{k:02}", *[n(f"w{x:02}", *([n("z"), n("y", n("x"))] if deep and x % 9 == 0 else [])) for x in range(40) if r.random() < 0.9]) for k in range(20) if r.random() < 0.95]
        return n("R", *inner)

    def plain(a, b, rename, delete, insert):
        """By the recursion itself."""
        size = lambda t: 1 + sum(map(size, t[1]))
        row = [0.0]
        for y in b[1]:
            row.append(row[-1] + size(y) * insert)
        for x in a[1]:
            out = [row[0] + size(x) * delete]
            for k, y in enumerate(b[1]):
                out.append(min(row[k + 1] + size(x) * delete, out[-1] + size(y) * insert, row[k] + plain(x, y, rename, delete, insert)))
            row = out
        return row[-1] + (a[0] != b[0]) * rename

    made, leaves = [], similarity._align_leaves
    monkeypatch.setattr(similarity, "_align_leaves", lambda pairs, *rest: made.append(len(pairs)) or leaves(pairs, *rest))
    for deep, costs in ((False, (0.3, 1.0, 1.0)), (True, (0.3, 1, 2))):
        a, b = tree(deep), tree(deep)
        assert similarity.tree_distance(*encode(a), *encode(b), *costs) == pytest.approx(plain(a, b, *costs))
    assert sum(made) < 250  # of some 400 for the first pair alone
