"""What reports add to the rows of analyses: counts, rows grouped by file, clusters with their functions and pairs, labels and group sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_file(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """file, ``{name}_count`` and ``{name}s`` (an array of all other columns, by ``order``) of the files that have rows, by file."""
    others = [c for c in rows.columns if c != "file"]
    # the sorting columns lead, and rows equal in them keep the order of all the others
    leading = F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], F.struct(*others).alias("row"))
    grouped = rows.groupBy("file").agg(F.count(F.lit(1)).alias(f"{name}_count"), F.sort_array(F.collect_list(leading)).alias("__all"))
    return grouped.select("file", f"{name}_count", F.transform("__all", lambda x: x["row"]).alias(f"{name}s")).orderBy("file")


def counts(rows: DataFrame, name: str) -> DataFrame:
    """One row: file_count (files with rows) and ``{name}_count``."""
    return rows.agg(F.countDistinct("file").alias("file_count"), F.count(F.lit(1)).alias(f"{name}_count"))


def language_label(files: DataFrame) -> DataFrame:
    """One row: the files' one language, ``mixed``, or ``unknown`` without files."""
    found = files.agg(F.countDistinct("lang").alias("n"), F.min("lang").alias("one"))
    return found.select(F.when(F.col("n") == 0, "unknown").when(F.col("n") == 1, F.col("one")).otherwise("mixed").alias("language"))


def group_of(file: Column) -> Column:
    """The first folder of a path; below ``crates``, the second."""
    parts = F.split(file, "/")
    return F.when((F.get(parts, F.lit(0)) == "crates") & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))


def group_sizes(nodes: DataFrame) -> DataFrame:
    """group, size: the nodes of each group, the largest first and then by name."""
    return nodes.groupBy(group_of(F.col("file")).alias("group")).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "group")


def cluster_views(functions: DataFrame, pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """``clusters`` (cluster_id, members, min_similarity, max_similarity) as cluster_id, size, min_similarity, max_similarity, functions and pairs.

    Functions come in the members' order; pairs of two members, as far as they were scored, by similarity and then in the members' order.
    Members are joined by number, so no table is sent whole to any task; an array holds one cluster."""
    member = clusters.select("cluster_id", F.posexplode("members").alias("at", "idx"))
    reference = functions.select(F.col("idx").cast("long"), F.struct("file", "name", "start_line", "end_line", "is_test").alias("f"))
    placed = member.join(reference, "idx")
    listed = placed.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("at", "f"))).alias("x")).select("cluster_id", F.size("x").alias("size"), F.transform("x", lambda v: v["f"]).alias("functions"))
    left = placed.select(F.col("idx").alias("i"), F.col("cluster_id"), F.col("at").alias("ati"), F.col("f").alias("a"))
    right = placed.select(F.col("idx").alias("j"), F.col("cluster_id"), F.col("at").alias("atj"), F.col("f").alias("b"))
    scores = [c for c in ("similarity", "body_similarity", "signature_similarity", "type_overlap", "identifier_overlap") if c in pairs.columns]
    inside = pairs.select(F.col("i").cast("long"), F.col("j").cast("long"), *scores).join(left, "i").join(right, ["cluster_id", "j"])
    row = F.struct((-F.col("similarity")).alias("first"), "ati", "atj", F.struct("a", "b", *scores).alias("p"))
    scored = inside.groupBy("cluster_id").agg(F.sort_array(F.collect_list(row)).alias("x")).select("cluster_id", F.transform("x", lambda v: v["p"]).alias("pairs"))
    out = clusters.drop("members").join(listed, "cluster_id").join(scored, "cluster_id", "left")
    return out.select("cluster_id", "size", "min_similarity", "max_similarity", "functions", "pairs").orderBy("cluster_id")
