"""Resolution of import paths to modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_prefix(refs: DataFrame, modules: DataFrame, key: str) -> DataFrame:
    """refs (key, segments) with the longest known module that begins the path, and the rest as symbol; refs without one go.

    Prefixes are exploded and equi-joined, so that no reference is compared with all modules."""
    prefixes = refs.where(F.size("segments") > 0).select("*", F.explode(F.sequence(F.lit(1), F.size("segments"))).alias("__n"))
    prefixes = prefixes.withColumn("module", F.array_join(F.slice("segments", F.lit(1), F.col("__n")), "::"))
    found = prefixes.join(modules.select("module").distinct(), "module")
    best = found.groupBy(key).agg(F.max_by(F.struct("module", "__n", "segments"), "__n").alias("b"))
    rest = F.slice("b.segments", F.col("b.__n") + 1, F.greatest(F.size("b.segments") - F.col("b.__n"), F.lit(0)))
    return best.select(key, "b.module", F.array_join(rest, "::").alias("symbol"))


def first_probe(refs: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """refs (key, candidates: paths in order of preference) with the first that is a file; refs without one go."""
    tried = refs.select(key, F.posexplode("candidates").alias("__rank", "path"))
    return tried.join(files.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "__rank").alias("path"))
