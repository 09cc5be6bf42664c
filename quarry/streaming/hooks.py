"""Editor events as a stream: events that edit files start analyses of those files.

Events are JSON lines. Each event is handled once and alone; there is no state, window or lateness. Running churn (at the end) is an addition.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.paths import patch_paths
from quarry.operators import cohesion, complexity, hotspot, similarity
from quarry.operators.graph import checkpoint
from quarry.plans import analyses
from quarry.sources import files as sources
from quarry.sources import git

EVENT = "hook_event_name string, session_id string, transcript_path string, cwd string, model string, turn_id string, tool_name string, tool_input string, tool_response string, prompt string, stop_hook_active boolean, source string"
#: Events, those that are handled, and tools that edit files.
EVENTS = ("PreToolUse", "PostToolUse", "SessionStart", "UserPromptSubmit", "Stop", "SubagentStop", "PermissionRequest")
HANDLED = ("PreToolUse", "PostToolUse", "SessionStart")
EDITING_TOOLS = ("Edit", "Write", "MultiEdit")
PATCH_TOOLS = ("apply_patch",)
REQUIRED = ("hook_event_name", "session_id", "cwd")


def parsed(lines: DataFrame) -> DataFrame:
    """Events of text lines (value), with ``valid``: a known event that has the required fields. Unknown fields are ignored."""
    fields = {c.strip().split(" ")[0]: c.strip().split(" ")[1] for c in EVENT.split(",")}
    events = lines.select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    valid = F.coalesce(F.col("hook_event_name").isin(*EVENTS), F.lit(False))
    for name in REQUIRED:
        valid = valid & F.col(name).isNotNull()
    return events.select(*fields, valid.alias("valid"))


def edited_paths(events: DataFrame) -> DataFrame:
    """hook_event_name, session_id, path: files that an event edits; events before an edit name no new files."""
    single = F.get_json_object("tool_input", "$.file_path")
    command = F.coalesce(F.get_json_object("tool_input", "$.command"), F.get_json_object("tool_input", "$.input"))
    before = F.col("hook_event_name") == "PreToolUse"
    patched = F.when(before, patch_paths(command, "Update")).otherwise(patch_paths(command))
    own = F.when(F.col("tool_name").isin(*EDITING_TOOLS), F.array_compact(F.array(single))).when(F.col("tool_name").isin(*PATCH_TOOLS), patched)
    found = events.where(F.col("valid") & F.col("hook_event_name").isin("PreToolUse", "PostToolUse")).select("hook_event_name", "session_id", "cwd", F.explode(own).alias("path"))
    whole = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat_ws("/", "cwd", "path"))
    return found.select("hook_event_name", "session_id", whole.alias("path")).distinct()


def before_edit(files: DataFrame) -> dict[str, DataFrame]:
    """The worst functions and the least cohesive units of the files."""
    return {"complexity": complexity.worst_per_file(analyses.complexity_units(files)), "cohesion": cohesion.ranked(analyses.cohesion_units(files))}


def after_edit(files: DataFrame) -> dict[str, DataFrame]:
    """Near-duplicate functions within each file and thin wrappers in the files."""
    return {"similarity": similar_within(files), "wrappers": analyses.wrappers(files)}


def similar_within(files: DataFrame, opts: similarity.Options = similarity.Options(body_weight=1.0, bands=32)) -> DataFrame:
    """Clusters (members: idx) of near-duplicate functions of one file: whole trees of any length, without signatures."""
    found = analyses.functions(files)
    idx = F.row_number().over(Window.orderBy("file", "start_line", "name")).cast("long") - 1  # the functions of a few edited files
    numbered = checkpoint(found.withColumn("idx", idx))
    home = numbered.select("idx", "file")
    pairs = similarity.similar_pairs(numbered, opts).join(home.select(F.col("idx").alias("i"), F.col("file").alias("fi")), "i").join(home.select(F.col("idx").alias("j"), F.col("file").alias("fj")), "j")
    return similarity.ranked(similarity.clusters(checkpoint(pairs.where("fi = fj").drop("fi", "fj")), opts.threshold))


def session_start(files: DataFrame, churn: DataFrame | None = None, top: int = 5) -> dict[str, DataFrame]:
    """The hottest files and the most coupled modules and pairs of a tree; without a repository there are no hot files."""
    found = analyses.coupled(files)
    hot = {"hotspots": hotspot.ranked(analyses.hotspots(files, churn)).where("score > 0").limit(top)} if churn is not None else {}
    return hot | {"modules": found["modules"].where("ifc > 0").limit(top), "pairs": found["pairs"].limit(top)}


def answer(event: str, message: str, agent: str = "claude_code") -> dict:
    """What an event's process would print; nothing to say is an empty object. ``agent``: claude_code or codex."""
    if not message:
        return {}
    inside = event == "SessionStart" or agent == "codex" and event == "PostToolUse"
    return {"hookSpecificOutput": {"hookEventName": event, "additionalContext": message}} if inside else {"systemMessage": message}


def handle(spark: SparkSession, sink: Callable[[str, str, dict[str, DataFrame]], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: for each event kind, the batch's files are read and analysed together, and the tree of each session that starts.

    ``sink`` gets the event kind, the batch's number and the results. Files and trees that are gone and files of other languages are skipped."""

    def batch(lines: DataFrame, number: int) -> None:
        events = parsed(lines).persist()
        for row in events.where("valid and hook_event_name = 'SessionStart'").select("cwd").distinct().collect():  # sessions that start in a batch
            if os.path.isdir(row["cwd"]):
                tree = sources.read_tree(spark, row["cwd"])
                if not tree.isEmpty():
                    sink("SessionStart", str(number), session_start(tree, git.churn(spark, row["cwd"]) if git.root(row["cwd"]) else None))
        paths = edited_paths(events).persist()
        for event, analysis in (("PreToolUse", before_edit), ("PostToolUse", after_edit)):
            wanted = paths.where(F.col("hook_event_name") == event).select(F.col("path").alias("file"), F.col("path").alias("display_path")).distinct()
            files = sources.described(wanted.mapInPandas(sources._read, sources.SCHEMA + ", source string").drop("display_path")).where("source is not null")
            if not files.isEmpty():
                sink(event, str(number), analysis(files))
        paths.unpersist()
        events.unpersist()

    return batch


def listen(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[str, str, dict[str, DataFrame]], None]):
    """Start a query over a folder of JSON-lines files, which ends when all that is there is handled."""
    lines = spark.readStream.format("text").load(folder)
    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle(spark, sink)).start()


def running_churn(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Edits per path and window of a stream (path, ts), late events allowed for; an addition to the analyses."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "path").agg(F.count(F.lit(1)).alias("edits"))
