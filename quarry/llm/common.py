"""What several operators share: checkpoints, running sums over salted groups, components, ordered streams of rows."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a missing id where ids are ordered: last of all.
LAST_ID = 9223372036854775807
#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 256
#: Bytes of an Arrow batch that Spark hands to Python; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one in the warehouse in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints")
        gone_at_end(spark, spark.sparkContext.getCheckpointDir())
    return spark.sparkContext.getCheckpointDir()


def gone_at_end(spark: SparkSession, folder: str) -> None:
    """Delete a folder when the driver's process ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def run(df: DataFrame, work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(work, schema)`` with batches bounded by bytes; a task gives its memory back to the system when it ends."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")

    def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Free memory that allocators hold goes back to the system; workers are used again by later tasks."""
    pa.default_memory_pool().release_unused()
    if os.path.exists("/proc/self"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)


def whole_rows(df: DataFrame) -> Column:
    """All columns in one struct: no column of a user's table can clash with a join's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def short_hash(text: Column) -> Column:
    """60 bits of an MD5, from 0 on: any other engine can follow it."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def running_start(df: DataFrame, group: list[str], bucket: str, order: list[Column], weight: str, start: str) -> DataFrame:
    """Add ``start``: the sum of ``weight`` over the rows of the same group that come before, in the order of (bucket, order).

    A group of any size is split by its buckets: a window runs inside each bucket only, and one row per bucket carries the
    offset. Null groups are groups. ``df`` is read twice; hand over a checkpointed frame where its rows are costly to compute.
    """
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col(bucket).alias("__bucket")).agg(F.sum(weight).alias("__total"))
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(Window.partitionBy(*[f"__g{i}" for i in range(len(group))]).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1) if group else before), F.lit(0))).drop("__total")
    same = F.col(bucket) == F.col("__bucket")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    added = df.withColumn("__inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return added.join(offsets, same).withColumn(start, (F.col("__offset") + F.col("__inside")).cast("long")).drop("__inside", "__offset", "__bucket", *[f"__g{i}" for i in range(len(group))])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the smallest node that it reaches.

    Alternating large-star and small-star rounds; every round is checkpointed. A hub costs one row per edge, and its smallest
    neighbour is found with map-side minima. Each component ends as a star around its root, after a logarithmic number of rounds.
    """
    now = checkpoint(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("__a"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("__a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "__a")
        small = large.join(low, F.col("a") == F.col("__a")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = checkpoint(small.select("e.a", "e.b").where("a <> b").distinct())
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    """Count and order-free digests of an edge set."""
    h = F.xxhash64("a", "b")
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["x"] or 0, int(r["s"] or 0)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, one after the other; few at a time are Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


class Out:
    """Gathers rows and gives them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 4096, weight: int = 8_000_000):
        self.schema, self.most, self.heavy = schema, rows, weight
        self.rows: list[tuple] = []
        self.weight = 0

    def add(self, row: tuple, weight: int = 0) -> bool:
        """Take a row; True when a batch should be given out."""
        self.rows.append(row)
        self.weight += weight
        return len(self.rows) >= self.most or self.weight >= self.heavy

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.weight = [], 0
        return out


def grouped(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that are equal in their first columns."""
    at, rows = None, []
    for row in rows_of(batches):
        if row[:n_keys] != at:
            if rows:
                yield at, rows
            at, rows = row[:n_keys], []
        rows.append(row[n_keys:])
    if rows:
        yield at, rows


def blocked(rows: DataFrame, size: str, block: int) -> DataFrame:
    """``rows`` once for each pair of blocks (i, j) of its group that its own block, hashed from the key, takes part in.

    ``size`` is the number of rows in the row's group; groups of up to ``block`` rows have one block."""
    own = rows.withColumn("__n", F.ceil(F.col(size) / block).cast("int")).withColumn("__own", F.pmod(F.xxhash64("key"), F.col("__n")).cast("int"))
    both = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return both.withColumn("i", F.least("__own", "__other")).withColumn("j", F.greatest("__own", "__other")).drop("__n", "__own", "__other", size)


def forest(linked: np.ndarray) -> list[int]:
    """For each row of a symmetric matrix of links, the smallest row that it reaches."""
    root = list(range(len(linked)))
    left = np.ones(len(linked), bool)
    for start in range(len(linked)):
        if not left[start]:
            continue
        front = np.zeros(len(linked), bool)
        front[start] = True
        while front.any():  # all that start reaches, a ring at a time
            left &= ~front
            for x in np.flatnonzero(front):
                root[x] = start
            front = linked[front].any(axis=0) & left
    return root
