"""Version control as DataFrames: one subprocess on the driver, lines into Spark."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import diff, hotspot


def root(path: str) -> str | None:
    """The ancestor that holds ``.git``."""
    start = Path(path).resolve()
    return next((str(p) for p in [start, *start.parents] if (p / ".git").exists()), None)


def _lines(folder: str, *args: str) -> list[str]:
    run = subprocess.run(["git", "-c", "core.quotepath=off", "-C", folder, *args], capture_output=True, text=True, errors="replace")
    if run.returncode:
        raise RuntimeError(run.stderr.strip())
    return run.stdout.splitlines()


def churn(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """path (from the repository's root), commits of the files below a path."""
    top = root(path)
    if top is None:
        raise FileNotFoundError(f"{path} is in no repository")
    scope = os.path.relpath(os.path.realpath(path), os.path.realpath(top))
    found = _lines(top, "log", "--pretty=format:", "--name-only", *([f"--since={since}"] if since else []), "--", scope)
    return hotspot.churn(spark.createDataFrame([(x,) for x in found if x], "path string"))


def changed_ranges(spark: SparkSession, base: str) -> DataFrame:
    """file (from ``base``, or as given if that is a file), start, end: lines changed since the last commit; nothing where there is no repository."""
    folder = base if os.path.isdir(base) else os.path.dirname(base) or "."
    rows, file = [], None
    if root(folder) is not None:
        scope = "." if os.path.isdir(base) else os.path.basename(base)
        for x in _lines(folder, "diff", "--no-ext-diff", "--no-color", "--unified=0", "--relative", "--src-prefix=a/", "--dst-prefix=b/", "--", scope):
            if x.startswith("+++ "):
                file = x[6:].rstrip("\t") if x.startswith("+++ b/") else None  # a deleted file has no lines
            elif x.startswith("@@") and file is not None:
                rows.append((file if os.path.isdir(base) else base, x))
    return diff.hunks(spark.createDataFrame(rows, "file string, line string"))
