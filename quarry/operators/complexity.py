"""Summaries and rankings of complexity units (file, name, start_line, end_line, cyclomatic, cognitive, max_nesting, n1, n2, big_n1, big_n2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.metrics import halstead_volume, loc, maintainability_index


def with_metrics(units: DataFrame) -> DataFrame:
    """Adds loc, halstead_volume and maintainability_index."""
    out = units.withColumn("loc", loc(F.col("start_line"), F.col("end_line"))).withColumn("halstead_volume", halstead_volume(*[F.col(c) for c in ("n1", "n2", "big_n1", "big_n2")]))
    return out.withColumn("maintainability_index", maintainability_index(F.col("halstead_volume"), F.col("cyclomatic"), F.col("loc")))


def _summary_columns() -> list:
    rank = lambda c, p: F.expr(f"percentile_disc({p}) within group (order by {c})").cast("long")
    out = [F.count(F.lit(1)).alias("function_count"), F.sum("loc").cast("long").alias("loc_total"), F.max("max_nesting").cast("long").alias("max_nesting")]
    for c in ("cyclomatic", "cognitive"):
        out += [F.max(c).cast("long").alias(f"{c}_max"), rank(c, 0.95).alias(f"{c}_p95"), rank(c, 0.5).alias(f"{c}_median")]
    return [*out, F.min("maintainability_index").alias("mi_min")]


def summary(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, maxima and nearest-rank percentiles, of all units or by group. ``units`` has metrics."""
    return units.groupBy(*(by or [])).agg(*_summary_columns())


def ranked(units: DataFrame, top: int | None = None, min_score: int = 0) -> DataFrame:
    """The most complex first."""
    out = units.where(F.col("cognitive") >= min_score).orderBy(F.desc("cognitive"), F.desc("cyclomatic"), "start_line", "file")
    return out if top is None else out.limit(top)


def worst_per_file(units: DataFrame, top: int = 5, cognitive: int = 8, cyclomatic: int = 10, nesting: int = 4) -> DataFrame:
    """Up to ``top`` units of each file that reach a floor, with their rank."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("cognitive"), F.desc("cyclomatic"), "start_line"))
    return units.where((F.col("cognitive") >= cognitive) | (F.col("cyclomatic") >= cyclomatic) | (F.col("max_nesting") >= nesting)).withColumn("rank", rank).where(F.col("rank") <= top)
