"""Graph recursion on DataFrames: closure, cycles, components. Every round is checkpointed in the shared folder."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that ``spark.checkpoint.dir`` names; a folder of its own only in local mode without that setting."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return df.checkpoint()


def task_count(spark: SparkSession, rows: int | None = None, each: int = 250_000) -> int:
    """Tasks so that none has over ``each`` of so many rows; ``spark.sql.shuffle.partitions`` where the rows are not counted. A shuffle into a number of parts
    stays as it is, where adaptive execution puts parts together until they have 64 MB compressed, which are millions of short rows for one task."""
    if rows is None:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / each))


def closure(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(src, dst) for each target that a source reaches over one edge or more; src = dst on cycles.

    Semi-naive: each round joins the pairs that are new with the edges, and drops those already known."""
    step = checkpoint(edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).where("src is not null and dst is not null").distinct())
    known, new = step, step
    hop = step.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    while True:
        reached = new.join(hop, "dst").select("src", F.col("next").alias("dst")).distinct()
        new = checkpoint(reached.join(known, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return known
        known = checkpoint(known.unionByName(new))


def reachable_from(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The nodes that ``starts`` (node) reach over edges (src, dst), themselves included; a round looks at new nodes only."""
    edges = checkpoint(edges.select("src", "dst").where("src <> dst").distinct())
    known = front = checkpoint(starts.select("node").distinct())
    while not front.isEmpty():
        found = edges.join(front, edges["src"] == front["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        front = checkpoint(found.join(known, "node", "left_anti"))
        known = checkpoint(known.unionByName(front))
    return known


def core(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) that are left when nodes without predecessors or successors are taken away again and again: cycles and ways between them."""
    now = checkpoint(edges.select("src", "dst").where("src <> dst").distinct())
    n = now.count()
    while n:
        now = checkpoint(now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, now.count()
        if n == before:
            break
    return now


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on cycles of two or more nodes, with the smallest node of theirs.

    Closures are taken inside the core only, which holds no tree and no chain."""
    reach = checkpoint(closure(core(edges)))
    back = reach.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = reach.join(back, ["src", "dst"])
    return mutual.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (src, dst), by the smallest reachable node. Loops keep single nodes.

    Labels fall to the neighbours' minimum and then jump to their label's label, so long paths take logarithmically many rounds."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = checkpoint(both)
    labels = checkpoint(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("far"))
        new = checkpoint(low.join(jump, "low", "left").select("node", "component", F.least("low", F.coalesce("far", "low")).alias("new")))
        changed = not new.where("new <> component").isEmpty()
        labels = new.select("node", F.col("new").alias("component"))
        if not changed:
            return labels
