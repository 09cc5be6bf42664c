"""Line ranges of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hunks(lines: DataFrame) -> DataFrame:
    """file, start, end from diff lines (file, line): the new side of ``@@`` headers; ranges without lines go."""
    header = r"^@@ .*?\+(\d+)(?:,(\d+))? @@"
    found = lines.where(F.col("line").rlike(header)).select("file", F.regexp_extract("line", header, 1).cast("int").alias("start"), F.regexp_extract("line", header, 2).alias("n"))
    found = found.withColumn("n", F.when(F.col("n") == "", 1).otherwise(F.expr("try_cast(n as int)"))).where("n > 0")
    return found.select("file", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def touched(spans: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of ``spans`` (file, start_line, end_line) that overlap a change (file, start, end) of their file."""
    c = changes.select(F.col("file").alias("changed"), F.col("start").alias("first"), F.col("end").alias("last"))
    return spans.join(c, (F.col("file") == F.col("changed")) & (F.col("first") <= F.col("end_line")) & (F.col("start_line") <= F.col("last")), "left_semi")
