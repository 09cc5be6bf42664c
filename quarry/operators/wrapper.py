"""Reuse of thin wrappers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import last_segment
from quarry.operators.graph import task_count


def reuse(wrappers: DataFrame, calls: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per wrapper (file, name): call_sites, unique_callers, same_file_only.

    ``calls``: file, caller, callee. Calls meet wrappers by the last segment of their names; those from a caller of the wrapper's own full
    name, in any file, do not count. Callers are told apart by file and name; all unknown callers of a file are one. Without calls same_file_only is true.

    Calls are added up per name, file and caller, and wrappers meet sums with one row per key, from which those of their own name are
    taken away: a name that many wrappers and calls share makes no pairs. Only callers with the callee's last segment can be a wrapper's own.

    Calls are dealt out once by name and file, over ``tasks`` tasks, and all sums are taken from there: keys are not null and marks are
    aggregates, so that no sum has a filter of its own below the shuffle."""
    tasks = tasks or task_count(calls.sparkSession)
    placed, known, last = F.col("file").isNotNull().alias("placed"), F.col("caller").isNotNull().alias("known"), last_segment(F.col("callee")).alias("last")
    sites = calls.select(F.coalesce("file", F.lit("")).alias("call_file"), placed, F.coalesce("caller", F.lit("")).alias("caller"), known, last).where("last is not null")
    sites = sites.repartition(tasks, "last", "call_file").groupBy("last", "call_file", "placed", "caller", "known")
    sites = sites.agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("known") & (last_segment(F.col("caller")) == F.col("last"))).alias("named"))
    own = wrappers.select("file", "name", last_segment(F.col("name")).alias("last")).distinct()

    def totals(found: DataFrame, mark: str, *keys: str) -> DataFrame:
        sums = found.groupBy("last", *keys).agg(F.sum("n").alias(f"{mark}_sites"), F.count(F.lit(1)).alias(f"{mark}_callers"), F.sum(F.when(F.col("placed"), F.col("n"))).alias(f"{mark}_placed"))
        return sums.withColumnsRenamed({"call_file": "file", "caller": "name"})

    named = sites.where("named")
    met = own.join(totals(sites, "all"), "last", "left").join(totals(named, "own", "caller"), ["last", "name"], "left")
    met = met.join(totals(sites, "here", "call_file"), ["last", "file"], "left").join(totals(named, "self", "call_file", "caller"), ["last", "file", "name"], "left")
    without = lambda whole, part: F.coalesce(whole, F.lit(0)) - F.coalesce(part, F.lit(0))
    elsewhere = without("all_placed", "own_placed") - without("here_placed", "self_placed")
    return met.select("file", "name", without("all_sites", "own_sites").alias("call_sites"), without("all_callers", "own_callers").alias("unique_callers"), (elsewhere == 0).alias("same_file_only"))
