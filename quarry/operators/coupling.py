"""Module coupling: edges (from, to, symbol, kind) between modules (path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.metrics import information_flow, instability
from quarry.operators.graph import closure, strongly_connected

KINDS = ("use", "call", "type", "impl_for")


def normalised(edges: DataFrame) -> DataFrame:
    """Different edges between different modules."""
    return edges.select("from", "to", "symbol", "kind").where("`from` <> `to`").distinct()


def ordered(edges: DataFrame) -> DataFrame:
    """By from, to, symbol and the kinds' own order."""
    return edges.orderBy("from", "to", "symbol", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))


def kept(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges with both ends in ``modules``."""
    paths = modules.select("path").distinct()
    return edges.join(paths, edges["from"] == paths["path"], "left_semi").join(paths.withColumnRenamed("path", "p"), F.col("to") == F.col("p"), "left_semi")


def module_metrics(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """path, fan_in, fan_out (different neighbours), ifc, instability, for every module."""
    near = normalised(edges).select("from", "to").distinct()
    out = near.groupBy(F.col("from").alias("path")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = near.groupBy(F.col("to").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))
    both = modules.select("path").distinct().join(into, "path", "left").join(out, "path", "left").na.fill(0)
    flow, part = information_flow(F.col("fan_in"), F.col("fan_out")), instability(F.col("fan_in"), F.col("fan_out"))
    return both.select("path", "fan_in", "fan_out", flow.alias("ifc"), part.alias("instability"))


def ranked(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("ifc"), F.desc("fan_in"), F.desc("fan_out"), "path")


def pairs(edges: DataFrame) -> DataFrame:
    """a, b (a < b), shared_symbols: different symbols that pass between two modules, either way."""
    return normalised(edges).groupBy(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).agg(F.countDistinct("symbol").alias("shared_symbols"))


def cycles(edges: DataFrame) -> DataFrame:
    """members (sorted) and size of each strongly connected group of two or more modules."""
    found = strongly_connected(normalised(edges).select(F.col("from").alias("src"), F.col("to").alias("dst")))
    return found.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("size")).select("members", "size")


def reachable(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, reached) over edges between known modules, without the module itself."""
    between = kept(normalised(edges), modules).select(F.col("from").alias("src"), F.col("to").alias("dst"))
    return closure(between).where("src <> dst").select(F.col("src").alias("path"), F.col("dst").alias("reached"))


def context_spans(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """path, direct, transitive, files: what has to be read to understand a module. ``modules``: path, file.

    A module that several rows name has its first file by order; its own file is not counted."""
    homes = modules.groupBy("path").agg(F.min("file").alias("file"))
    near = kept(normalised(edges), modules).groupBy(F.col("from").alias("path")).agg(F.countDistinct("to").alias("direct"))
    reached = reachable(edges, modules).join(homes.select(F.col("path").alias("reached"), F.col("file").alias("there")), "reached").join(homes, "path")
    far = reached.groupBy("path").agg(F.count(F.lit(1)).alias("transitive"), F.countDistinct(F.when(F.col("there") != F.col("file"), F.col("there"))).alias("files"))
    return homes.select("path").join(near, "path", "left").join(far, "path", "left").na.fill(0)
