"""Churn times complexity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.metrics import saturating_product


def churn(touches: DataFrame) -> DataFrame:
    """path, commits: one row of ``touches`` is a file in a commit."""
    return touches.groupBy("path").agg(F.count(F.lit(1)).alias("commits"))


def file_complexity(files: DataFrame, units: DataFrame) -> DataFrame:
    """Per path of ``files``: function_count, loc, cyclomatic_max, cognitive_max. Files without functions have zeros.

    ``units``: path, loc, cyclomatic, cognitive."""
    found = units.groupBy("path").agg(
        F.count(F.lit(1)).alias("function_count"), F.sum("loc").cast("long").alias("loc"), F.max("cyclomatic").cast("long").alias("cyclomatic_max"), F.max("cognitive").cast("long").alias("cognitive_max")
    )
    return files.select("path").distinct().join(found, "path", "left").na.fill(0)


def hotspots(touched: DataFrame, complexity: DataFrame) -> DataFrame:
    """path, commits, function_count, loc, cyclomatic_max, cognitive_max, score: commits times cognitive_max, which is 0 on either side's lack.

    A path in ``complexity`` is a current source and stays with a score of 0; others need a score. Repeated churn rows count by their maximum."""
    once = touched.groupBy("path").agg(F.max("commits").alias("commits"))
    both = once.join(complexity.withColumn("current", F.lit(True)), "path", "full").na.fill(0).withColumn("current", F.coalesce("current", F.lit(False)))
    scored = both.withColumn("score", saturating_product(F.col("commits"), F.col("cognitive_max")))
    return scored.where("score > 0 or current").select("path", "commits", "function_count", "loc", "cyclomatic_max", "cognitive_max", "score")


def ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    out = rows.orderBy(F.desc("score"), F.desc("commits"), "path")
    return out if top is None else out.limit(top)


def summary(rows: DataFrame) -> DataFrame:
    """One row: how many files, and the maxima."""
    return rows.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(f"max_{c}") for c in ("score", "commits", "cognitive_max")])
