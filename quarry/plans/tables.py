"""The engine's operators over facts made from the synthetic tables, each with SQL that gives the same rows.

Facts: a customer is a file and a unit, an order a function and a method, a supplier a field, an event a commit, a nation a module, a line a
reference from the customer's nation to the supplier's. Every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import metrics, paths
from quarry.operators import callgraph, cohesion, complexity, coupling, diff, hotspot, similarity, wrapper
from quarry.operators.graph import checkpoint, task_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _path(key: str) -> F.Column:
    return F.concat(F.lit("c"), F.col(key).cast("string"))


# hotspots and complexity

_UNITS = """units AS (SELECT 'c' || o_custkey AS path, o_orderkey, CAST(sum(l_quantity) AS BIGINT) AS loc, count(DISTINCT l_partkey) AS cyclomatic,
  CAST(sum(l_linenumber - 1) AS BIGINT) AS cognitive, max(l_linenumber) AS max_nesting FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""
_HOT = f"""WITH {_UNITS}, complexity AS (SELECT 'c' || c_custkey AS path, count(o_orderkey) AS function_count, CAST(coalesce(sum(loc), 0) AS BIGINT) AS loc,
  coalesce(max(cyclomatic), 0) AS cyclomatic_max, coalesce(max(cognitive), 0) AS cognitive_max FROM customer LEFT JOIN units ON path = 'c' || c_custkey GROUP BY 1),
 churn AS (SELECT 'c' || user_id AS path, count(*) AS commits FROM events {{where}} GROUP BY 1),
 hot AS (SELECT path, coalesce(commits, 0) AS commits, coalesce(function_count, 0) AS function_count, coalesce(loc, 0) AS loc, coalesce(cyclomatic_max, 0) AS cyclomatic_max,
  coalesce(cognitive_max, 0) AS cognitive_max, coalesce(commits, 0) * coalesce(cognitive_max, 0) AS score, function_count IS NOT NULL AS current FROM churn FULL JOIN complexity USING (path))"""


def _units(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("long").alias("loc"), F.countDistinct("l_partkey").alias("cyclomatic"), F.sum(F.col("l_linenumber") - 1).alias("cognitive"), F.max("l_linenumber").alias("max_nesting")
    )
    return lines.join(t.orders.select("o_orderkey", _path("o_custkey").alias("path")), F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")


def _hotspots(t: Tables, events: DataFrame) -> DataFrame:
    files = t.customer.select(_path("c_custkey").alias("path"))
    return hotspot.hotspots(hotspot.churn(events.select(_path("user_id").alias("path"))), hotspot.file_complexity(files, _units(t)))


@query(_HOT.format(where="") + " SELECT * EXCLUDE (current) FROM hot WHERE score > 0 OR current")
def hotspot_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return hotspot.ranked(_hotspots(t, t.events))


@query(_HOT.format(where="WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'") + " SELECT * EXCLUDE (current) FROM hot WHERE score > 0 OR current ORDER BY score DESC, commits DESC, path LIMIT 20")
def hotspot_since_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return hotspot.ranked(_hotspots(t, t.events.where("ts >= timestamp_ntz '2024-01-15 00:00:00'")), 20)


@query(_HOT.format(where="") + " SELECT count(*) AS files, max(score) AS max_score, max(commits) AS max_commits, max(cognitive_max) AS max_cognitive_max FROM hot WHERE score > 0 OR current")
def hotspot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return hotspot.summary(_hotspots(t, t.events))


_HALSTEAD = """tok AS (SELECT l_orderkey, count(DISTINCT l_returnflag || l_linestatus) AS n1, count(DISTINCT l_partkey) AS n2, count(*) AS big_n1, CAST(sum(l_quantity) AS BIGINT) AS big_n2,
   count(DISTINCT l_partkey) AS cyclomatic, CAST(sum(l_linenumber - 1) AS BIGINT) AS cognitive, CAST(sum(l_quantity) AS BIGINT) AS loc, max(l_linenumber) AS max_nesting FROM lineitem GROUP BY 1),
 vol AS (SELECT o_custkey, tok.*, CASE WHEN n1 + n2 >= 2 AND big_n1 + big_n2 > 0 THEN (big_n1 + big_n2) * log2(n1 + n2) END AS v FROM tok JOIN orders ON o_orderkey = l_orderkey),
 mi AS (SELECT *, CASE WHEN v > 0 THEN greatest(0.0, least(100.0, (171.0 - 5.2 * ln(v) - 0.23 * cyclomatic - 16.2 * ln(loc)) * 100.0 / 171.0)) END AS m FROM vol)"""


def _measured(t: Tables) -> DataFrame:
    """Complexity units of orders, with token counts and metrics."""
    tokens = t.lineitem.groupBy("l_orderkey").agg(
        F.countDistinct(F.concat("l_returnflag", "l_linestatus")).alias("n1"), F.countDistinct("l_partkey").alias("n2"), F.count(F.lit(1)).alias("big_n1"), F.sum("l_quantity").cast("long").alias("big_n2"),
        F.countDistinct("l_partkey").alias("cyclomatic"), F.sum(F.col("l_linenumber") - 1).alias("cognitive"), F.max("l_linenumber").alias("max_nesting"),
    )
    units = tokens.withColumn("start_line", F.lit(1).cast("long")).withColumn("end_line", F.col("big_n2"))
    return complexity.with_metrics(units).join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("file", F.col("o_custkey"))


@query(f"WITH {_HALSTEAD} SELECT l_orderkey, round(v, 6) AS halstead_volume, round(m, 6) AS maintainability_index FROM mi")
def halstead_and_maintainability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(Tables(spark, sf_dir)).select("l_orderkey", F.round("halstead_volume", 6).alias("halstead_volume"), F.round("maintainability_index", 6).alias("maintainability_index"))


_SUMMARY = """count(*) AS function_count, CAST(sum(loc) AS BIGINT) AS loc_total, CAST(max(max_nesting) AS BIGINT) AS max_nesting, max(cyclomatic) AS cyclomatic_max,
  quantile_disc(cyclomatic, 0.95) AS cyclomatic_p95, quantile_disc(cyclomatic, 0.5) AS cyclomatic_median, max(cognitive) AS cognitive_max, quantile_disc(cognitive, 0.95) AS cognitive_p95,
  quantile_disc(cognitive, 0.5) AS cognitive_median, round(min(m), 6) AS mi_min"""


@query(f"WITH {_HALSTEAD} SELECT o_custkey, {_SUMMARY} FROM mi GROUP BY o_custkey")
def complexity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity.summary(_measured(Tables(spark, sf_dir)), ["o_custkey"]).withColumn("mi_min", F.round("mi_min", 6))


@query(f"WITH {_HALSTEAD} SELECT l_orderkey, o_custkey, cyclomatic, cognitive FROM mi WHERE cognitive >= 3 ORDER BY cognitive DESC, cyclomatic DESC, o_custkey, l_orderkey LIMIT 50")
def complexity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _measured(Tables(spark, sf_dir)).withColumn("start_line", F.col("o_custkey")).withColumn("file", F.col("l_orderkey"))
    return complexity.ranked(units, 50, 3).select("l_orderkey", "o_custkey", "cyclomatic", "cognitive")


@query(f"""WITH {_HALSTEAD}, r AS (SELECT o_custkey, l_orderkey, cognitive, cyclomatic, row_number() OVER (PARTITION BY o_custkey ORDER BY cognitive DESC, cyclomatic DESC, l_orderkey) AS rank
  FROM mi WHERE cognitive >= 8 OR cyclomatic >= 10 OR max_nesting >= 4) SELECT * FROM r WHERE rank <= 5""")
def hook_floor_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _measured(Tables(spark, sf_dir)).withColumn("start_line", F.col("l_orderkey"))
    return complexity.worst_per_file(units).select("o_custkey", "l_orderkey", "cognitive", "cyclomatic", F.col("rank").cast("long").alias("rank"))


# coupling

_REFERENCES = """refs AS (SELECT 'n::' || c_nationkey AS "from", 'n::' || s_nationkey AS "to", p_brand AS symbol, CASE l_returnflag WHEN 'R' THEN 'use' WHEN 'A' THEN 'call' ELSE 'type' END AS kind,
   l_extendedprice AS price, o_orderpriority AS priority FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
 e AS (SELECT DISTINCT "from", "to", symbol, kind FROM refs WHERE "from" <> "to")"""
#: A sparse graph: each nation's dearest supplier nation by order priority.
_DEAREST = f"""{_REFERENCES}, d AS (SELECT "from", "to", priority AS symbol, 'use' AS kind FROM (SELECT "from", "to", priority, row_number() OVER (PARTITION BY "from", priority ORDER BY CAST(round(sum(price) * 100) AS BIGINT) DESC, "to") AS r
   FROM refs WHERE "from" <> "to" GROUP BY "from", "to", priority) WHERE r = 1),
 m AS (SELECT 'n::' || n_nationkey AS path, 'r' || n_regionkey AS file FROM nation), g AS (SELECT DISTINCT "from" AS a, "to" AS b FROM d)"""


def _references(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "use").when(F.col("l_returnflag") == "A", "call").otherwise("type")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", kind.alias("kind"))
    out = lines.join(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    nation = lambda c: F.concat(F.lit("n::"), F.col(c).cast("string"))
    return out.select(nation("c_nationkey").alias("from"), nation("s_nationkey").alias("to"), F.col("p_brand").alias("symbol"), "kind", F.col("l_extendedprice").alias("price"), F.col("o_orderpriority").alias("priority"))


def _modules(t: Tables) -> DataFrame:
    return t.nation.select(F.concat(F.lit("n::"), F.col("n_nationkey").cast("string")).alias("path"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file"))


def _dearest(t: Tables) -> DataFrame:
    sums = _references(t).where("`from` <> `to`").groupBy("from", "to", "priority").agg(F.round(F.sum("price") * 100).cast("long").alias("total"))
    best = sums.groupBy("from", "priority").agg(F.min_by("to", F.struct(-F.col("total"), F.col("to"))).alias("to"))
    return checkpoint(best.select("from", "to", F.col("priority").alias("symbol"), F.lit("use").alias("kind")))


@query(f"WITH {_REFERENCES} SELECT * FROM e")
def coupling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.ordered(coupling.normalised(_references(Tables(spark, sf_dir))))


def _metrics_sql(graph: str) -> str:
    return f"""WITH {_DEAREST}, w AS (SELECT DISTINCT "from" AS a, "to" AS b FROM {graph} WHERE "from" <> "to"), i AS (SELECT b AS path, count(*) AS n FROM w GROUP BY 1), o AS (SELECT a AS path, count(*) AS n FROM w GROUP BY 1)
 SELECT path, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, CAST(pow(coalesce(i.n, 0) * coalesce(o.n, 0), 2) AS BIGINT) AS ifc,
  round(CASE WHEN coalesce(i.n, 0) + coalesce(o.n, 0) > 0 THEN coalesce(o.n, 0) / (coalesce(i.n, 0) + coalesce(o.n, 0)) END, 6) AS instability FROM m LEFT JOIN i USING (path) LEFT JOIN o USING (path)"""


@query(_metrics_sql("refs"))
def coupling_module_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return coupling.ranked(coupling.module_metrics(_references(t), _modules(t)).withColumn("instability", F.round("instability", 6)))


@query(_metrics_sql("d"))
def coupling_sparse_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return coupling.module_metrics(_dearest(t), _modules(t)).withColumn("instability", F.round("instability", 6))


@query(f"""WITH {_REFERENCES} SELECT least("from", "to") AS a, greatest("from", "to") AS b, count(DISTINCT symbol) AS shared_symbols FROM e GROUP BY 1, 2""")
def coupling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.pairs(_references(Tables(spark, sf_dir))).orderBy(F.desc("shared_symbols"), "a", "b")


_CLOSURE = "c AS (SELECT a, b FROM g UNION SELECT c.a, g.b FROM c JOIN g ON c.b = g.a)"


@query(f"""WITH RECURSIVE {_DEAREST}, {_CLOSURE}, s AS (SELECT x.a AS node, min(x.b) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY 1 HAVING count(*) > 1)
 SELECT string_agg(node, ',' ORDER BY node) AS members, count(*) AS size FROM s GROUP BY component""")
def coupling_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.cycles(_dearest(Tables(spark, sf_dir))).select(F.array_join("members", ",").alias("members"), "size").orderBy(F.desc("size"), "members")


@query(f"""WITH {_DEAREST}, k AS (SELECT path FROM m WHERE file <> 'r0'), f AS (SELECT * FROM d WHERE "from" IN (SELECT path FROM k) AND "to" IN (SELECT path FROM k)) SELECT "from", "to", symbol, kind FROM f""")
def coupling_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return coupling.kept(_dearest(t), _modules(t).where("file <> 'r0'"))


@query(f"""WITH RECURSIVE {_DEAREST}, {_CLOSURE}, r AS (SELECT a, b FROM c WHERE a <> b)
 SELECT m.path, (SELECT count(*) FROM g WHERE g.a = m.path) AS direct, count(r.b) AS transitive, count(DISTINCT CASE WHEN h.file <> m.file THEN h.file END) AS files
 FROM m LEFT JOIN r ON r.a = m.path LEFT JOIN m h ON h.path = r.b GROUP BY m.path, m.file""")
def context_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return coupling.context_spans(_dearest(t), _modules(t)).orderBy(F.desc("transitive"), F.desc("files"), F.desc("direct"), "path")


# cohesion

_METHODS = """f AS (SELECT DISTINCT o_custkey AS unit_id, o_orderkey AS method_idx, l_suppkey AS field FROM orders JOIN lineitem ON l_orderkey = o_orderkey), all_m AS (SELECT o_custkey AS unit_id, o_orderkey AS method_idx FROM orders),
 link AS (SELECT DISTINCT x.unit_id, x.method_idx AS a, y.method_idx AS b FROM f x JOIN f y ON x.unit_id = y.unit_id AND x.field = y.field),
 reach AS (SELECT unit_id, method_idx AS a, method_idx AS b FROM all_m UNION SELECT reach.unit_id, reach.a, link.b FROM reach JOIN link ON link.unit_id = reach.unit_id AND link.a = reach.b),
 comp AS (SELECT unit_id, a AS method_idx, min(b) AS component FROM reach GROUP BY 1, 2)"""


def _methods(t: Tables) -> tuple[DataFrame, int]:
    """Methods, and tasks for the uses of their fields."""
    fields = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("fields"))
    none = F.array().cast("array<string>")
    orders = t.orders.select(F.col("o_custkey").alias("unit_id"), F.col("o_orderkey").alias("method_idx"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("name"))
    methods = orders.join(fields, F.col("method_idx") == F.col("l_orderkey"), "left").select("unit_id", "method_idx", "name", F.coalesce("fields", none).alias("fields"), none.alias("calls"))
    return methods, task_count(t.spark, t.lineitem.count())


@query(f"WITH RECURSIVE {_METHODS} SELECT * FROM comp")
def cohesion_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohesion.method_components(*_methods(Tables(spark, sf_dir)))


_LCOM = f"""WITH RECURSIVE {_METHODS}, n AS (SELECT unit_id, component, count(*) AS n, bool_and(comp.method_idx NOT IN (SELECT method_idx FROM f)) AS idle FROM comp GROUP BY 1, 2),
 four AS (SELECT unit_id, CAST(sum(n) AS BIGINT) AS method_count, count(*) AS component_count, count(*) FILTER (n = 1 AND idle) AS inert_method_count FROM n GROUP BY 1),
 mu AS (SELECT unit_id, avg(n) AS mean FROM (SELECT unit_id, field, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
 u AS (SELECT unit_id, method_count, component_count, inert_method_count, component_count - inert_method_count AS lcom4, round(CASE WHEN method_count >= 2 THEN (mean - method_count) / (1.0 - method_count) END, 6) AS lcom96
  FROM four LEFT JOIN mu USING (unit_id))"""


@query(_LCOM + " SELECT * FROM u")
def cohesion_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohesion.cohesion(*_methods(Tables(spark, sf_dir))).withColumn("lcom96", F.round("lcom96", 6))


@query(_LCOM + " SELECT * FROM u WHERE lcom4 >= 2 ORDER BY coalesce(lcom96, 1.0) DESC, lcom4 DESC, method_count DESC, unit_id LIMIT 20")
def cohesion_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohesion.ranked(cohesion.cohesion(*_methods(Tables(spark, sf_dir))).withColumn("lcom96", F.round("lcom96", 6)), 20)


# wrappers and calls


@query("""WITH w AS (SELECT 'b' || p_brand AS file, 'Owner::p' || p_partkey AS name, 'p' || p_partkey AS last FROM part), s AS (SELECT 'b' || p_brand AS file, 'p' || l_partkey AS callee, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'Owner::p' || (o_custkey + l_linenumber) END AS caller
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_suppkey)
 SELECT w.file, w.name, count(s.callee) AS call_sites, count(DISTINCT CASE WHEN s.callee IS NOT NULL THEN s.file || '/' || coalesce(s.caller, '-') END) AS unique_callers, coalesce(bool_and(s.file = w.file), true) AS same_file_only
 FROM w LEFT JOIN s ON s.callee = w.last AND (s.caller IS NULL OR s.caller <> w.name) GROUP BY 1, 2""")
def wrapper_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    wrappers = t.part.select(F.concat(F.lit("b"), "p_brand").alias("file"), F.concat(F.lit("Owner::p"), F.col("p_partkey").cast("string")).alias("name"))
    tasks = task_count(spark, t.lineitem.count())
    lines = t.lineitem.repartition(tasks, "l_orderkey").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.join(t.part.select("p_partkey", "p_brand"), F.col("l_suppkey") == F.col("p_partkey"))
    caller = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("Owner::p"), (F.col("o_custkey") + F.col("l_linenumber")).cast("string")))
    calls = lines.select(F.concat(F.lit("b"), "p_brand").alias("file"), caller.alias("caller"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("callee"))
    return wrapper.reuse(wrappers, calls, tasks)


#: Nodes are suppliers, in the crate of their nation; orders call a supplier by a short name that several may share.
_GRAPH = """nodes AS (SELECT 's' || s_suppkey AS id, 'f' || s_nationkey AS file, 'n' || s_nationkey || '::sup' || (s_suppkey // 3) AS qualified_name, 'sup' || (s_suppkey // 3) AS last FROM supplier),
 callers AS (SELECT file, qualified_name, min(id) AS id FROM nodes GROUP BY 1, 2 HAVING count(*) = 1),
 made AS (SELECT l_orderkey, l_linenumber, 'n' || c_nationkey AS crate, CASE WHEN l_returnflag <> 'N' THEN 'sup' || (l_suppkey // 2) END AS callee, CASE l_linestatus WHEN 'F' THEN 'expression' END AS receiver,
   CASE l_linenumber WHEN 3 THEN 'path' WHEN 4 THEN 'alias' ELSE 'plain' END AS form, 'f' || s_nationkey AS file, CASE WHEN l_linenumber > 1 THEN 'n' || s_nationkey || '::sup' || (l_suppkey // 3) END AS caller
   FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
 sites AS (SELECT made.*, callers.id AS "from" FROM made LEFT JOIN callers ON callers.file = made.file AND callers.qualified_name = made.caller WHERE caller IS NULL OR callers.id IS NOT NULL),
 q AS (SELECT qualified_name, count(*) AS n, min(id) AS id FROM nodes GROUP BY 1), l AS (SELECT last, count(*) AS n, min(id) AS id FROM nodes GROUP BY 1),
 r AS (SELECT sites.*, CASE WHEN callee IS NULL THEN 'anonymous' WHEN receiver IS NULL AND form <> 'path' AND q.n = 1 THEN 'resolved' WHEN receiver IS NULL AND form <> 'path' AND q.n > 1 THEN 'ambiguous' WHEN l.n IS NULL THEN 'unresolved'
    WHEN receiver IS NOT NULL THEN CASE WHEN l.n = 1 OR q.n = 1 THEN 'resolved' ELSE 'ambiguous' END WHEN form = 'path' THEN CASE WHEN q.n IS NULL THEN 'unresolved' WHEN q.n = 1 THEN 'resolved' ELSE 'ambiguous' END
    WHEN form = 'alias' THEN 'unresolved' WHEN l.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution,
   CASE WHEN callee IS NULL THEN NULL WHEN receiver IS NULL AND form <> 'path' AND q.n = 1 THEN q.id WHEN receiver IS NULL AND form <> 'path' AND q.n > 1 THEN NULL WHEN l.n IS NULL THEN NULL
    WHEN receiver IS NOT NULL THEN CASE WHEN l.n = 1 THEN l.id WHEN q.n = 1 THEN q.id END WHEN form = 'path' THEN CASE WHEN q.n = 1 THEN q.id END WHEN form = 'alias' THEN NULL WHEN l.n = 1 THEN l.id END AS "to"
  FROM sites LEFT JOIN q ON q.qualified_name = crate || '::' || callee LEFT JOIN l ON l.last = callee),
 ed AS (SELECT "from", "to", callee AS callee_name, resolution, count(*) AS call_count, list_sort(list(DISTINCT l_linenumber)) AS call_lines FROM r GROUP BY "from", "to", callee, resolution)"""


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Suppliers as functions of their nations; order lines as calls: plain, by a path (line 3), by an imported alias (line 4), on values, and outside functions (line 1)."""
    third = lambda c: F.concat(F.lit("sup"), F.expr(f"{c} div 3").cast("string"))
    crate = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    home = F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("file")
    nodes = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), home, F.concat(crate("s_nationkey"), F.lit("::"), third("s_suppkey")).alias("qualified_name"), third("s_suppkey").alias("name"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    callee = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("sup"), F.expr("l_suppkey div 2").cast("string")))
    caller = F.when(F.col("l_linenumber") > 1, F.concat(crate("s_nationkey"), F.lit("::"), third("l_suppkey")))
    path = F.when(F.col("l_linenumber") == 3, F.array(crate("c_nationkey"), callee)).when(F.col("l_linenumber") == 4, F.array(F.lit("x"), callee)).otherwise(F.array(callee))
    kind = "array<struct<alias:string,target:string,exported:string>>"
    imported = F.when(F.col("l_linenumber") == 4, F.array(F.struct(F.lit("x").alias("alias"), crate("c_nationkey").alias("target"), F.lit(None).cast("string").alias("exported"))).cast(kind)).otherwise(F.array().cast(kind))
    calls = lines.select(
        home, caller.alias("caller_qualified_name"), crate("c_nationkey").alias("caller_module"), F.lit(None).cast("string").alias("caller_owner"), callee.alias("callee_name"), F.when(callee.isNotNull(), path).alias("callee_path"),
        F.when(F.col("l_linestatus") == "F", "expression").alias("receiver"), imported.alias("imports"), F.col("l_linenumber").alias("line"), "l_orderkey",
    )
    return nodes, callgraph.resolve(calls, nodes)


@query(f"WITH {_GRAPH} SELECT l_orderkey, l_linenumber AS line, callee AS callee_name, \"to\", resolution FROM r")
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(Tables(spark, sf_dir))[1].select("l_orderkey", "line", "callee_name", "to", "resolution")


@query(f"WITH {_GRAPH} SELECT \"from\", \"to\", callee_name, resolution, call_count, array_to_string(call_lines, ',') AS call_lines FROM ed")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.ordered(callgraph.edges(_graph(Tables(spark, sf_dir))[1])).withColumn("call_lines", F.array_join(F.transform("call_lines", lambda x: x.cast("string")), ","))


_DEGREES = f"""WITH {_GRAPH}, ins AS (SELECT "to" AS id, sum(call_count) AS n, count(DISTINCT "from") FILTER (resolution = 'resolved') AS fan FROM ed GROUP BY 1),
 outs AS (SELECT "from" AS id, sum(call_count) AS n, count(DISTINCT "to") FILTER (resolution = 'resolved') AS fan FROM ed GROUP BY 1),
 deg AS (SELECT nodes.id, file, qualified_name, last AS name, CAST(coalesce(ins.n, 0) AS BIGINT) AS incoming_call_count, CAST(coalesce(outs.n, 0) AS BIGINT) AS outgoing_call_count, CAST(coalesce(ins.fan, 0) AS BIGINT) AS fan_in, CAST(coalesce(outs.fan, 0) AS BIGINT) AS fan_out
   FROM nodes LEFT JOIN ins ON ins.id = nodes.id LEFT JOIN outs ON outs.id = nodes.id)"""


@query(_DEGREES + " SELECT * FROM deg")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found = _graph(Tables(spark, sf_dir))
    return callgraph.degrees(nodes, callgraph.edges(found))


@query(f"""WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes) AS node_count, count(*) AS edge_count, CAST(sum(call_count) AS BIGINT) AS call_count, count(*) FILTER (resolution = 'resolved') AS resolved_edges,
 count(*) FILTER (resolution = 'unresolved') AS unresolved_edges, count(*) FILTER (resolution = 'ambiguous') AS ambiguous_edges, count(*) FILTER (resolution = 'anonymous') AS anonymous_edges FROM ed""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found = _graph(Tables(spark, sf_dir))
    return callgraph.summary(nodes, callgraph.edges(found))


@query(_DEGREES + " SELECT id, name, incoming_call_count + outgoing_call_count + 2 * fan_in + fan_out AS centrality FROM deg WHERE contains(lower(name), 'sup1') ORDER BY centrality DESC, id LIMIT 140")
def graph_view_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found = _graph(Tables(spark, sf_dir))
    return callgraph.visible(callgraph.degrees(nodes, callgraph.edges(found)).drop("file", "qualified_name"), "SUP1").select("id", "name", "centrality")


_SHOWN = f"WITH {_GRAPH}, shown AS (SELECT id FROM nodes WHERE file IN ('f1', 'f2', 'f3'))"


def _shown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, found = _graph(Tables(spark, sf_dir))
    return callgraph.edges(found), nodes.where("file in ('f1', 'f2', 'f3')").select("id")


@query(_SHOWN + """ SELECT "from", "to", callee_name, call_count FROM ed WHERE "to" IN (SELECT id FROM shown) AND "from" NOT IN (SELECT id FROM shown)""")
def graph_into_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.hidden_callers(*_shown(spark, sf_dir)).select("from", "to", "callee_name", "call_count")


@query(_SHOWN + """ SELECT "from", "to", callee_name, call_count FROM ed WHERE "to" IN (SELECT id FROM shown) AND "from" IN (SELECT id FROM shown) AND call_count >= 2 AND resolution = 'resolved'""")
def graph_shown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.shown_edges(*_shown(spark, sf_dir), 2, ("resolved",)).select("from", "to", "callee_name", "call_count")


@query(_SHOWN + """ SELECT "from", callee_name, resolution, call_count FROM ed WHERE "to" IS NULL AND "from" IN (SELECT id FROM shown)""")
def graph_open_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.open_calls(*_shown(spark, sf_dir)).select("from", "callee_name", "resolution", "call_count")


# spans, paths and names


@query("""WITH s AS (SELECT conv_id, role, min(turn) AS start_line, max(turn) AS end_line FROM conversations GROUP BY 1, 2), h AS (SELECT conv_id, turn AS first, turn + 1 AS last FROM conversations WHERE role = 'assistant')
 SELECT conv_id AS file, role, start_line, end_line FROM s WHERE EXISTS (SELECT 1 FROM h WHERE h.conv_id = s.conv_id AND first <= end_line AND start_line <= last)""")
def diff_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = Tables(spark, sf_dir).conversations
    spans = turns.groupBy(F.col("conv_id").alias("file"), "role").agg(F.min("turn").alias("start_line"), F.max("turn").alias("end_line"))
    return diff.touched(spans, turns.where("role = 'assistant'").select(F.col("conv_id").alias("file"), F.col("turn").alias("start"), (F.col("turn") + 1).alias("end")))


_URL_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def _page_paths(t: Tables) -> DataFrame:
    """Pages as paths: some are given test folders and file names by the digits of their ids."""
    plain = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    folder = F.when(F.col("page_id") % 7 == 0, "/Tests").when(F.col("page_id") % 11 == 0, "/__spec__").otherwise("/src")
    name = F.when(F.col("page_id") % 5 == 0, "/view.test.ts").when(F.col("page_id") % 13 == 0, "/conftest.py").when(F.col("page_id") % 3 == 0, "/latest.go").otherwise("/mod.rs")
    return t.pages.select("page_id", F.concat(plain, folder, name).alias("path"))


_PAGE_PATHS = f"""p AS (SELECT page_id, {_URL_PATH} || CASE WHEN page_id % 7 = 0 THEN '/Tests' WHEN page_id % 11 = 0 THEN '/__spec__' ELSE '/src' END ||
  CASE WHEN page_id % 5 = 0 THEN '/view.test.ts' WHEN page_id % 13 = 0 THEN '/conftest.py' WHEN page_id % 3 = 0 THEN '/latest.go' ELSE '/mod.rs' END AS path FROM pages)"""


@query(f"""WITH {_PAGE_PATHS}, x AS (SELECT *, string_split(lower(path), '/') AS parts FROM p)
 SELECT page_id, path, list_has_any(parts, {list(paths.TEST_DIRECTORIES)}) OR parts[-1] = 'conftest.py' OR list_has_any(regexp_split_to_array(regexp_replace(parts[-1], '\\.[^.]*$', ''), '[._-]'), {list(paths.TEST_NAME_PARTS)}) AS is_test FROM x""")
def path_test_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(Tables(spark, sf_dir)).withColumn("is_test", paths.looks_like_test(F.col("path")))


@query(f"WITH {_PAGE_PATHS} SELECT page_id, path FROM p WHERE NOT (regexp_matches(path, '^(.*/)?[^/]*\\.ts$') OR regexp_matches(path, '^(.*/)?fr/.*$'))")
def exclude_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(Tables(spark, sf_dir)).where(~paths.excluded(F.col("path"), ["*.ts", "**/fr/**"]))


@query(f"""WITH {_PAGE_PATHS}, x AS (SELECT page_id, CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.go' THEN 'go' ELSE 'rust' END AS language, list_filter(string_split(regexp_replace(path, '\\.[^./]*$', ''), '/'), lambda s: s <> '') AS parts FROM p)
 SELECT page_id, language, CASE language WHEN 'go' THEN array_to_string(parts[:-2], '::') WHEN 'rust' THEN array_to_string(list_concat(['crate'], list_filter(parts, lambda s: s NOT IN ('src', 'mod', 'lib', 'main'))), '::') ELSE array_to_string(parts, '::') END AS module,
  parts[-1] AS last_name FROM x""")
def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _page_paths(Tables(spark, sf_dir)).withColumn("language", paths.language(F.col("path")))
    plain = F.array_join(F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "/"), "::")
    return found.select("page_id", "language", paths.module_path(F.col("path"), F.col("language")).alias("module"), paths.last_segment(plain).alias("last_name"))


@query("""SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(p_type || 'Of' || p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda t: t <> ''), ' ') AS tokens FROM part""")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(paths.identifier_tokens(F.concat("p_type", F.lit("Of"), "p_name")), " ").alias("tokens"))


@query("""SELECT page_id, array_to_string(regexp_extract_all('*** Begin' || chr(10) || '*** Update File: ' || url || chr(10) || ' *** Add File:  b/' || page_id || ' ' || chr(10) || '*** Delete File: x', '\\*\\*\\* (?:Update|Add) File: *([^\\n]*[^ \\n])', 1), '|') AS paths FROM pages""")
def patch_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("*** Begin\n*** Update File: "), "url", F.lit("\n *** Add File:  b/"), F.col("page_id").cast("string"), F.lit(" \n*** Delete File: x"))
    return Tables(spark, sf_dir).pages.select("page_id", F.array_join(paths.patch_paths(text), "|").alias("paths"))


@query("""WITH h AS (SELECT page_id, string_split(regexp_extract(url, '^https?://([^/]*)', 1), '.') AS parts FROM pages), k AS (SELECT DISTINCT array_to_string(parts[1:2], '::') AS module FROM h WHERE len(parts) > 2),
 c AS (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM h)
 SELECT page_id, max_by(module, n) AS module, max_by(array_to_string(parts[n + 1:], '::'), n) AS symbol FROM c JOIN k ON module = array_to_string(parts[1:n], '::') GROUP BY 1""")
def import_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.imports import longest_prefix

    parts = F.split(F.regexp_extract("url", "^https?://([^/]*)", 1), r"\.")
    refs = Tables(spark, sf_dir).pages.select("page_id", parts.alias("segments"))
    modules = refs.where(F.size("segments") > 2).select(F.array_join(F.slice("segments", 1, 2), "::").alias("module")).distinct()
    return longest_prefix(refs, modules, "page_id").select("page_id", "module", "symbol")


# similarity

_OPTIONS = similarity.Options(hashes=32, bands=8)
_WORDS = "w AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS labels FROM documents), sh AS (SELECT doc_id, CASE WHEN len(labels) < 3 THEN [array_to_string(labels, chr(31))] ELSE list_distinct(list_transform(range(1, len(labels) - 1), lambda i: array_to_string(labels[i:i + 2], chr(31)))) END AS shingles FROM w)"


def _signatures_sql(n: int) -> str:
    each = ", ".join(f"list_min(list_transform(x, lambda v: (v * {a} + {b}) % {similarity.PRIME}))" for a, b in similarity.coefficients(n))
    return f"hx AS (SELECT doc_id, list_transform(shingles, lambda s: CAST(('0x' || substr(md5(s), 1, 8)) AS BIGINT)) AS x FROM sh), sig AS (SELECT doc_id, [{each}] AS signature FROM hx)"


def _documents_as_trees(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("idx"), F.split("text", r"\s+").alias("labels"))


@query(f"WITH {_WORDS} SELECT doc_id, CAST(len(shingles) AS BIGINT) AS shingles FROM sh")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_as_trees(Tables(spark, sf_dir)).select(F.col("idx").alias("doc_id"), F.size(similarity.shingles(F.col("labels"))).cast("long").alias("shingles"))


def _signed(t: Tables) -> DataFrame:
    return similarity.signed(_documents_as_trees(t), F.col("labels"), _OPTIONS.hashes)


@query(f"WITH {_WORDS}, {_signatures_sql(_OPTIONS.hashes)} SELECT doc_id, array_to_string(signature, ',') AS signature FROM sig")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(Tables(spark, sf_dir)).select(F.col("idx").alias("doc_id"), F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query(f"""WITH {_WORDS}, {_signatures_sql(_OPTIONS.hashes)}, bd AS (SELECT doc_id, unnest(range(0, {_OPTIONS.bands})) AS band, signature FROM sig), bk AS (SELECT doc_id, band, signature[band * 4 + 1:band * 4 + 4] AS part FROM bd)
 SELECT DISTINCT x.doc_id AS i, y.doc_id AS j FROM bk x JOIN bk y ON x.band = y.band AND x.part = y.part AND x.doc_id < y.doc_id""")
def lsh_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.band_pairs(checkpoint(similarity.bands(checkpoint(_signed(Tables(spark, sf_dir))), _OPTIONS.bands, _OPTIONS.hashes // _OPTIONS.bands)))


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_PARTS = """b AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS types, list_sort(list(DISTINCT p_name)) AS names, list_sort(list(DISTINCT p_size)) AS sizes, list_distinct(list_concat(list(p_name), list(CAST(p_size AS VARCHAR)))) AS words FROM part GROUP BY 1)"""


@query(f"""WITH {_PARTS}, j AS (SELECT x.p_brand AS a, y.p_brand AS b, len(list_intersect(x.words, y.words)) AS ni, len(list_distinct(list_concat(x.words, y.words))) AS nu, len(list_intersect(x.types, y.types)) AS ti, len(list_distinct(list_concat(x.types, y.types))) AS tu,
  len(list_intersect(x.sizes, y.sizes)) AS si, len(list_distinct(list_concat(x.sizes, y.sizes))) AS su, len(x.sizes) AS sx, len(y.sizes) AS sy FROM b x JOIN b y ON x.p_brand < y.p_brand)
 SELECT a, b, round(0.25 * ni / nu + 0.10 * (1.0 - abs(sx - sy) / greatest(sx, sy)) + 0.05 * si / su + 0.45 * ti / tu + 0.10 + 0.05, 6) AS score FROM j""")
def signature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = Tables(spark, sf_dir).part.groupBy("p_brand").agg(F.collect_set("p_type").alias("types"), F.collect_set("p_name").alias("names"), F.collect_set(F.col("p_size").cast("string")).alias("sizes"))
    none = F.array().cast("array<string>")
    signature = F.struct(F.col("names").alias("name_tokens"), F.size("sizes").alias("parameter_count"), F.col("sizes").alias("parameter_names"), F.col("types").alias("parameter_type_paths"), none.alias("return_type_paths"), none.alias("generics"), F.lit(None).cast("string").alias("receiver"))
    s = checkpoint(brands.select("p_brand", signature.alias("s")))
    both = s.select(F.col("p_brand").alias("a"), F.col("s").alias("sa")).join(s.select(F.col("p_brand").alias("b"), F.col("s").alias("sb")), F.col("a") < F.col("b"))
    return both.select("a", "b", F.round(similarity.signature_similarity(F.col("sa"), F.col("sb")), 6).alias("score"))


def _part_trees(t: Tables) -> DataFrame:
    """A tree for each type and size: the type, below it brands, below each brand the words of its parts' names."""
    words = t.part.groupBy("p_type", "p_size", "p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("names"))
    node = F.struct("p_brand", F.concat(F.array("p_brand"), "names").alias("labels"), F.concat(F.array(F.size("names") + 1), F.array_repeat(F.lit(1), F.size("names"))).alias("sizes"))
    trees = words.groupBy("p_type", "p_size").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    labels = F.concat(F.array("p_type"), F.flatten(F.col("nodes.labels")))
    sizes = F.concat(F.array(F.aggregate("nodes", F.lit(1), lambda n, x: n + F.size(x["labels"]))), F.flatten(F.col("nodes.sizes")))
    signature = F.lit(None).cast("struct<name_tokens:array<string>,parameter_count:int,parameter_names:array<string>,parameter_type_paths:array<string>,return_type_paths:array<string>,generics:array<string>,receiver:string>")
    name = F.concat_ws("/", "p_type", F.col("p_size").cast("string"))
    return trees.select(F.xxhash64(name).alias("idx"), name.alias("name"), F.struct(labels.alias("labels"), sizes.alias("sizes")).alias("tree"), signature.alias("signature"), F.lit(False).alias("is_test"))


_CLOSE = similarity.Options(threshold=0.5, bands=42)


def _tree_pairs(t: Tables) -> tuple[DataFrame, DataFrame]:
    trees = checkpoint(_part_trees(t))
    return trees, checkpoint(similarity.similar_pairs(trees, _CLOSE))


@query()
def tsed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees, pairs = _tree_pairs(Tables(spark, sf_dir))
    name = lambda c: trees.select(F.col("idx").alias(c), F.col("name").alias(f"{c}_name"))
    return pairs.join(name("i"), "i").join(name("j"), "j").select("i_name", "j_name", "similarity", "body_similarity")


@query()
def complete_link_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs = _tree_pairs(Tables(spark, sf_dir))
    return similarity.ranked(similarity.clusters(pairs, _CLOSE.threshold))
