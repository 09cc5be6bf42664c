"""Cohesion of units: methods (unit_id, method_idx, name, fields, calls) that share fields or call each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import checkpoint, components, task_count

_KEYS = ["unit_id", "method_idx"]


def _node(method: str) -> F.Column:
    return F.struct(F.col("unit_id"), F.col(method).alias("method_idx"))


def shared_fields(methods: DataFrame, tasks: int | None = None) -> DataFrame:
    """unit_id, method_idx, first: the uses of fields but for the first use in each unit, with the method that has the first. Windows stream over sorted uses."""
    uses = methods.select(*_KEYS, F.explode(F.array_distinct("fields")).alias("field")).where("unit_id is not null and field is not null and method_idx is not null")
    uses = uses.repartition(tasks or task_count(methods.sparkSession), "unit_id", "field")
    same = Window.partitionBy("unit_id", "field").orderBy("method_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return checkpoint(uses.select(*_KEYS, F.min("method_idx").over(same).alias("first"), F.row_number().over(same).alias("n")).where("n > 1").drop("n"))


def method_links(methods: DataFrame, shared: DataFrame) -> DataFrame:
    """(src, dst) structs of different methods. Methods with a field in common link to the first one that has it, not to each other; calls link to methods of that name."""
    fields = shared.where("method_idx <> first").select(_node("method_idx").alias("src"), _node("first").alias("dst"))
    calls = methods.where(F.size("calls") > 0).select(*_KEYS, F.explode(F.array_distinct("calls")).alias("callee"))
    named = methods.select("unit_id", F.col("name").alias("callee"), F.col("method_idx").alias("other"))
    called = calls.join(named, ["unit_id", "callee"]).where("method_idx <> other").select(_node("method_idx").alias("src"), _node("other").alias("dst"))
    return fields.unionByName(called).distinct()


def _labelled(rows: DataFrame, methods: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` with the component of their method. Only linked methods take part in the search; the others, most of them where few fields are shared, stand alone."""
    found = components(method_links(methods, shared)).select("node.unit_id", "node.method_idx", F.col("component.method_idx").alias("component"))
    return rows.join(found, _KEYS, "left").withColumn("component", F.coalesce("component", "method_idx"))


def method_components(methods: DataFrame, tasks: int | None = None) -> DataFrame:
    """unit_id, method_idx, component: the smallest method_idx that a method is connected with."""
    return _labelled(methods.select(*_KEYS).distinct(), methods, shared_fields(methods, tasks))


def cohesion(methods: DataFrame, tasks: int | None = None) -> DataFrame:
    """unit_id, method_count, component_count, inert_method_count, lcom4, lcom96.

    lcom4: components without inert methods, which are alone and use nothing. lcom96: (mean methods per field - m) / (1 - m); null for fewer than two
    methods or no field. The fields of a unit are counted as its uses but for repeated ones; a null field counts as one."""
    shared = shared_fields(methods, tasks)
    distinct = lambda c: F.size(F.array_distinct(c))
    idle, uses, named, unnamed = (F.size("fields") == 0) & (F.size("calls") == 0), distinct(F.col("fields")), distinct(F.array_compact("fields")), F.exists("fields", F.isnull)
    rows = methods.where("unit_id is not null and method_idx is not null").select(*_KEYS, idle.alias("idle"), uses.alias("uses"), named.alias("named"), unnamed.cast("int").alias("unnamed"))
    groups = _labelled(rows, methods, shared).groupBy("unit_id", "component").agg(F.count(F.lit(1)).alias("n"), F.bool_and("idle").alias("idle"), F.sum("uses").alias("uses"), F.sum("named").alias("named"), F.max("unnamed").alias("unnamed"))
    inert = F.count_if((F.col("n") == 1) & F.col("idle")).alias("inert_method_count")
    counts = groups.groupBy("unit_id").agg(F.sum("n").cast("long").alias("method_count"), F.count(F.lit(1)).alias("component_count"), inert, F.sum("uses").alias("uses"), F.sum("named").alias("named"), F.max("unnamed").alias("unnamed"))
    again = shared.groupBy("unit_id").agg(F.count(F.lit(1)).alias("again"))
    counts = counts.join(again, "unit_id", "left").withColumn("fields", F.col("named") - F.coalesce("again", F.lit(0)) + F.col("unnamed"))
    m, mean = F.col("method_count"), F.when(F.col("fields") > 0, F.col("uses") / F.col("fields"))
    lcom96 = F.when(m >= 2, (mean - m) / (1.0 - m))
    return counts.select("unit_id", "method_count", "component_count", "inert_method_count", (F.col("component_count") - F.col("inert_method_count")).alias("lcom4"), lcom96.alias("lcom96"))


def ranked(units: DataFrame, top: int | None = None, min_lcom4: int = 2) -> DataFrame:
    """The least cohesive first; an undefined lcom96 counts as 1. Further keys: start_line and file, where the units have them."""
    rest = [c for c in ("start_line", "file", "unit_id") if c in units.columns]
    out = units.where(F.col("lcom4") >= min_lcom4).orderBy(F.coalesce("lcom96", F.lit(1.0)).desc(), F.desc("lcom4"), F.desc("method_count"), *rest)
    return out if top is None else out.limit(top)
