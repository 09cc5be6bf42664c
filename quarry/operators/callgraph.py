"""A heuristic call graph: call sites meet function nodes by name.

nodes: id, file, qualified_name, and any more columns. calls: file, caller_qualified_name, caller_module, caller_owner, callee_name, callee_path
(array), receiver (null: a path call; ``self``: on the caller's own owner; ``expression``: on any other value), imports
(array of struct<alias, target>), line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import first_segment, last_segment, qualify

RESOLUTIONS = ("resolved", "unresolved", "ambiguous", "anonymous")
#: Names that lexical_candidates() gives at most.
MOST_CANDIDATES = 3


def alias_target(imports: Column, alias: Column) -> Column:
    """The target of the last import with that alias, or null."""
    return F.try_element_at(F.filter(imports, lambda i: i["alias"] == alias), F.lit(-1))["target"]


def lexical_candidates() -> Column:
    """Qualified names that a path call may mean, in order of preference, from the columns of ``calls``."""
    module, owner, name, path, imports = (F.col(c) for c in ("caller_module", "caller_owner", "callee_name", "callee_path", "imports"))
    n, head = F.size(path), F.element_at(path, 1)
    tail = F.slice(path, 2, F.greatest(n - 1, F.lit(0)))
    joined = lambda *parts: F.array_join(F.concat(*parts), "::")
    modules = F.split(module, "::")
    supers = F.size(F.filter(path, lambda s: s == "super"))
    above = F.when(supers < F.size(modules), joined(F.slice(modules, 1, F.greatest(F.size(modules) - supers, F.lit(1))), F.filter(path, lambda s: s != "super")))
    target = alias_target(imports, head)
    plain = F.array(qualify(module, F.when(n == 1, name).otherwise(F.array_join(path, "::"))), F.when(target.isNotNull(), joined(F.split(target, "::"), tail)), F.when((n == 1) & target.isNotNull(), target))
    found = (
        F.when(module.isNull() | name.isNull(), F.array().cast("array<string>"))
        .when(path.isNull() | (n == 0), F.array(qualify(module, name)))
        .when(head == "crate", F.array(F.array_join(path, "::")))
        .when(head == "self", F.array(joined(modules, tail)))
        .when(head == "super", F.array(above))
        .when(head == "Self", F.array(F.when(owner.isNotNull() & (n > 1), qualify(module, joined(F.array(owner), tail)))))
        .otherwise(plain)
    )
    return F.array_distinct(F.filter(found, lambda c: c.isNotNull()))


def resolve(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """``calls`` with from, to and resolution. Calls whose caller is named but is not exactly one node of their file are dropped.

    Every lookup is an equi-join with a table of one row per name, so a frequent name makes no pairs; only the two narrowing steps look at
    the nodes of a name, and they count them by crate and by path suffix before the join."""
    callers = nodes.groupBy(F.col("file").alias("__file"), F.col("qualified_name").alias("__caller")).agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("from")).where("__n = 1").drop("__n")
    sites = calls.join(callers, (F.col("file") == F.col("__file")) & (F.col("caller_qualified_name") == F.col("__caller")), "left").where("caller_qualified_name is null or from is not null").drop("__file", "__caller")
    qualified = nodes.groupBy(F.col("qualified_name").alias("__q")).agg(F.count(F.lit(1)).alias("__qn"), F.min("id").alias("__qid"))
    by_last = nodes.select("id", "qualified_name", last_segment(F.col("qualified_name")).alias("__l"))
    last = by_last.groupBy("__l").agg(F.count(F.lit(1)).alias("__ln"), F.min("id").alias("__lid"))
    # nodes of a name by crate: the crate is a qualified name's first segment
    crate = by_last.groupBy(F.col("__l").alias("__cl"), first_segment(F.col("qualified_name")).alias("__crate")).agg(F.count(F.lit(1)).alias("__cn"), F.min("id").alias("__cid"))
    # nodes by every suffix of their qualified name
    parts = F.split("qualified_name", "::")
    suffix = by_last.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))).alias("__suffix"))
    suffix = suffix.groupBy("__suffix").agg(F.count(F.lit(1)).alias("__sn"), F.min("id").alias("__sid"))

    is_self, is_value = F.col("receiver") == "self", F.col("receiver") == "expression"
    own = F.when(F.col("caller_module").isNotNull() & F.col("caller_owner").isNotNull() & F.col("callee_name").isNotNull(), F.array(qualify(F.col("caller_module"), F.concat("caller_owner", F.lit("::"), "callee_name"))))
    wanted = F.when(is_self, own).when(is_value, F.lit(None).cast("array<string>")).otherwise(lexical_candidates())
    sites = sites.withColumn("__wanted", wanted)
    hits = []
    for k in range(MOST_CANDIDATES):  # a join per rank, the first that is known counts
        found = qualified.select(F.col("__q").alias(f"__q{k}"), F.struct("__qn", "__qid").alias(f"__hit{k}"))
        sites = sites.withColumn(f"__own{k}", F.get("__wanted", F.lit(k))).join(found, F.col(f"__own{k}") == F.col(f"__q{k}"), "left").drop(f"__own{k}", f"__q{k}")
        hits.append(F.col(f"__hit{k}"))

    path = F.when(F.size("callee_path") > 1, F.array_join("callee_path", "::"))
    module_crate = F.nullif(first_segment(F.col("caller_module")), F.lit(""))
    out = sites.withColumn("__hit", F.coalesce(*hits))
    out = out.join(last, F.col("callee_name") == F.col("__l"), "left")
    out = out.join(crate, (F.col("callee_name") == F.col("__cl")) & (module_crate == F.col("__crate")), "left")
    out = out.join(suffix, path == F.col("__suffix"), "left")
    one = lambda n, i: F.struct(F.when(n == 1, i).alias("to"), F.when(n == 1, "resolved").otherwise("ambiguous").alias("resolution"))
    nothing = lambda what: F.struct(F.lit(None).cast("string").alias("to"), F.lit(what).alias("resolution"))
    hit = one(F.col("__hit.__qn"), F.col("__hit.__qid"))
    found = (
        F.when(F.col("callee_name").isNull(), nothing("anonymous"))
        .when(F.col("__hit").isNotNull(), hit)
        .when(is_self, nothing("unresolved"))
        .when(F.col("__ln").isNull(), nothing("unresolved"))
        .when(is_value, F.when(F.col("__ln") == 1, one(F.col("__ln"), F.col("__lid"))).when(F.col("__cn") == 1, one(F.col("__cn"), F.col("__cid"))).otherwise(nothing("ambiguous")))
        .when(path.isNotNull(), F.when(F.col("__sn").isNull(), nothing("unresolved")).otherwise(one(F.col("__sn"), F.col("__sid"))))
        .otherwise(one(F.col("__ln"), F.col("__lid")))
    )
    return out.withColumn("__found", found).select(*[F.col(f"`{c}`") for c in calls.columns], "from", "__found.to", "__found.resolution")


def edges(resolved: DataFrame) -> DataFrame:
    """from, to, callee_name, resolution, call_count, call_lines (sorted, different)."""
    return resolved.groupBy("from", "to", "callee_name", "resolution").agg(F.count(F.lit(1)).alias("call_count"), F.sort_array(F.collect_set("line")).alias("call_lines"))


def ordered(found: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, RESOLUTIONS)), F.col("resolution"))
    return found.orderBy(F.col("from").asc_nulls_first(), F.col("to").asc_nulls_first(), F.col("callee_name").asc_nulls_first(), rank)


def degrees(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` with incoming_call_count, outgoing_call_count, fan_in and fan_out."""
    out = found.where("from is not null").groupBy(F.col("from").alias("id")).agg(F.sum("call_count").alias("outgoing_call_count"), F.countDistinct(F.when(F.col("resolution") == "resolved", F.col("to"))).alias("fan_out"))
    into = found.where("to is not null").groupBy(F.col("to").alias("id")).agg(F.sum("call_count").alias("incoming_call_count"), F.countDistinct(F.when(F.col("resolution") == "resolved", F.col("from"))).alias("fan_in"))
    names = ["incoming_call_count", "outgoing_call_count", "fan_in", "fan_out"]
    return nodes.join(out, "id", "left").join(into, "id", "left").na.fill(0, names)


def summary(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """One row: nodes, edges, calls, and edges by resolution."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"))
    by = [F.count_if(F.col("resolution") == r).alias(f"{r}_edges") for r in RESOLUTIONS]
    e = found.agg(F.count(F.lit(1)).alias("edge_count"), F.coalesce(F.sum("call_count"), F.lit(0)).alias("call_count"), *by)
    return e.join(F.broadcast(n), F.lit(True))  # one row each


# what a viewer shows of a graph


def visible(nodes: DataFrame, query: str = "", hide_tests: bool = False, top: int | None = 140, metric: str = "centrality") -> DataFrame:
    """Nodes whose name, qualified name or file holds the query, the first ``top`` by metric."""
    centrality = F.col("incoming_call_count") + F.col("outgoing_call_count") + 2 * F.col("fan_in") + F.col("fan_out")
    out = nodes.withColumn("centrality", centrality)
    if query:
        q = F.lit(query.lower())
        texts = [c for c in ("name", "qualified_name", "file") if c in nodes.columns]
        hit = F.contains(F.lower(texts[0]), q)
        for c in texts[1:]:
            hit = hit | F.contains(F.lower(c), q)
        out = out.where(hit)
    if hide_tests and "is_test" in nodes.columns:
        out = out.where(~F.col("is_test"))
    out = out.orderBy(F.desc(metric), "id")
    return out if top is None else out.limit(top)


def shown_edges(found: DataFrame, shown: DataFrame, min_calls: int = 1, resolutions: tuple[str, ...] = RESOLUTIONS) -> DataFrame:
    """Edges between visible nodes."""
    ids = shown.select("id")
    some = found.where((F.col("call_count") >= min_calls) & F.col("resolution").isin(*resolutions))
    return some.join(ids, some["from"] == ids["id"], "left_semi").join(ids.withColumnRenamed("id", "other"), F.col("to") == F.col("other"), "left_semi")


def hidden_callers(found: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges into visible nodes from nodes that are not."""
    ids = shown.select("id")
    into = found.where("from is not null").join(ids, found["to"] == ids["id"], "left_semi")
    return into.join(ids.withColumnRenamed("id", "other"), F.col("from") == F.col("other"), "left_anti")


def open_calls(found: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges from visible nodes to nothing known."""
    ids = shown.select("id")
    return found.where("to is null").join(ids, found["from"] == ids["id"], "left_semi")
