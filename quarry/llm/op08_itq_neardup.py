"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact reranking.

Vectors link when their labels are equal and their cosine, in double precision, is ``least`` or more. Null, empty and zero vectors,
vectors with null or non-finite components and vectors without a label link with nothing; nor do vectors of different lengths.

1. On a bounded sample (``FIT_ROWS`` vectors by the hash of their id) a rotation is learned per vector length: principal axes, then turns
   between the nearest binary code and the best rotation (Procrustes), so that codes are balanced and lie near the vectors.
2. Every vector gets its codes, cut into substrings of about log2(number of vectors) bits. Each substring is a table; vectors meet in
   a table when label and substring are equal. Rotations from other starts add tables until there are ``TABLES`` for each length of vectors, more where ``RECALL`` asks for them: vectors that differ in fewer bits
   than a rotation has substrings meet for certain.
3. Buckets of one vector go. In the others all pairs are compared by their original vectors, larger buckets in blocks. A pair counts in
   the first table where it meets. A block gives out counts of links per vector and a forest of its links, not pairs.

Equal vectors with equal labels fall together first and count as linked with each other. Rows with equal vec_id and vector are rows
of their own, with one component. A null vec_id is never the smallest but of a component of nulls. An empty table gives an empty result.
Other columns are not read. No table misses more than the pairs that differ in every substring of every rotation; tests hold recall against brute force.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Out, blocked, checkpoint, components, forest, grouped, rows_of, run, table

LEAST, BITS, TABLES, FIT_ROWS, BLOCK = 0.98, 64, 8, 20_000, 1024
#: Expected recall of pairs at the threshold, taking tables as independent and bits to differ as angles do.
RECALL = 0.95
Models = dict[int, tuple[np.ndarray, list[np.ndarray]]]

_VALID = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("unit", pa.binary())])
VALID = "vec_id long, label long, key binary, n int, unit binary"


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision, or None if it has no direction."""
    if not vector or None in vector:
        return None
    v = np.array(vector, dtype=np.float64)
    most = np.abs(v).max()
    if not np.isfinite(v).all() or most == 0:
        return None
    v = v / most  # no overflow, no underflow to 0
    return v / np.sqrt(v @ v) + 0.0


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Out(_VALID)
    for vec_id, label, vector in rows_of(batches):
        if label is not None and (u := unit(vector)) is not None:
            raw = u.tobytes()
            if out.add((vec_id, label, hashlib.md5(np.array([label]).tobytes() + np.array(vector, np.float64).tobytes()).digest(), len(u), raw), len(raw)):
                yield out.batch()
    if out.rows:
        yield out.batch()


def learn(x: np.ndarray, rotations: int, turns: int = 30) -> tuple[np.ndarray, list[np.ndarray]]:
    """The mean, and for each rotation the matrix that turns centred vectors into values whose signs are the code."""
    mean = x.mean(axis=0)
    centred = x - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, : min(BITS, x.shape[1])]
    v, out = centred @ axes, []
    for seed in range(rotations):
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(turns):
            code = np.where(v @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(v.T @ code)
            r = left @ right
        out.append(axes @ r)
    return mean, out


def substrings(x: np.ndarray, model: tuple[np.ndarray, list[np.ndarray]], width: int) -> np.ndarray:
    """The codes' substrings of all rotations, one column a table."""
    mean, rotations = model
    out = []
    for r in rotations:
        code = ((x - mean) @ r >= 0).astype(np.int64)
        bits = min(width, code.shape[1])
        for i in range(0, code.shape[1] - bits + 1, bits):
            out.append(code[:, i : i + bits] @ (1 << np.arange(bits)))
    return np.stack(out, axis=1)


def rotations_needed(n: int, width: int, least: float) -> int:
    """Rotations for vectors of length ``n``: TABLES tables, or as many as RECALL at the threshold asks for."""
    bits = min(BITS, n)
    one = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** min(width, bits)
    needed = math.ceil(math.log(1 - RECALL) / math.log(1 - one)) if one < 1 else 1
    return math.ceil(max(TABLES, needed) / (bits // min(width, bits)))


def _codes(batches: Iterable[pa.RecordBatch], models: Models, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column(2).to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            part = batch.take(pa.array(at))
            x = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(len(at), n)
            codes = substrings(x, models[int(n)], width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int32()))], names=["key", "label", "n", "codes", "tables"])


_LINKS = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


def _rerank(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links inside buckets (label, n, table, code, i, j; own block, key, copies, codes, unit)."""
    out = Out(_LINKS)
    for (_, _, t, _, i, j), rows in grouped(batches, 6):
        keys, copies = [r[1] for r in rows], np.array([r[2] for r in rows])
        codes = np.frombuffer(b"".join(r[3] for r in rows), np.int32).reshape(len(rows), -1)
        x = np.frombuffer(b"".join(r[4] for r in rows), np.float64).reshape(len(rows), -1)
        linked = x @ x.T >= least
        np.fill_diagonal(linked, False)
        if i != j:
            own = np.array([r[0] for r in rows])
            linked &= own[:, None] != own[None, :]
        for earlier in range(t):
            linked &= codes[:, earlier][:, None] != codes[:, earlier][None, :]
        counts, roots = linked @ copies, forest(linked)
        for k in np.flatnonzero(linked.any(axis=1)):
            if out.add((keys[k], int(counts[k]), keys[roots[k]])):
                yield out.batch()
    if out.rows:
        yield out.batch()


def fit(sets: DataFrame, width: int, least: float) -> Models:
    """A model per vector length. ``sets``: key, n, unit."""
    models: Models = {}
    for row in sets.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect():  # one row per vector length
        some = sets.where(F.col("n") == row["n"]).orderBy(F.xxhash64("key")).limit(FIT_ROWS).select("unit").toArrow().column(0).to_pylist()
        models[row["n"]] = learn(np.frombuffer(b"".join(some), np.float64).reshape(len(some), row["n"]), rotations_needed(row["n"], width, least))
    return models


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    valid = checkpoint(run(rows, _units, VALID))
    sets = checkpoint(valid.groupBy("key").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies")))
    size = max(2, sets.count())
    width = min(24, max(8, math.ceil(math.log2(size))))
    models = fit(sets, width, least)
    coded = checkpoint(run(sets.select("key", "label", "n", "unit"), lambda batches: _codes(batches, models, width), "key binary, label long, n int, codes binary, tables array<int>"))
    bucket = ["label", "n", "table", "code"]
    places = coded.select("key", "label", "n", F.posexplode("tables").alias("table", "code"))
    often = places.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = places.join(often, bucket).join(coded.select("key", "codes"), "key").join(sets.select("key", "unit", "copies"), "key")
    met = met.withColumn("own", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK)).cast("int"))
    met = blocked(met, "size", BLOCK).select(*bucket, "i", "j", "own", "key", "copies", "codes", "unit")
    linked = checkpoint(run(met.repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j", "key"), lambda batches: _rerank(batches, least), "key binary, links long, root binary"))
    joined = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("key").agg(F.sum("links").alias("links"))
    ids = valid.groupBy("key").agg(F.min("vec_id").alias("low"))
    own = sets.select("key", "copies").join(ids, "key").join(counts, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
    own = checkpoint(own.select("key", "low", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root")))
    smallest = own.groupBy("root").agg(F.min("low").alias("component_id"))
    found = valid.select("vec_id", "key").join(own.join(smallest, "root").select("key", "n_links", "component_id"), "key").select("vec_id", "n_links", "component_id")
    lone = run(rows, _without_direction, "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _without_direction(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Out(pa.schema([("vec_id", pa.int64())]))
    for vec_id, label, vector in rows_of(batches):
        if (label is None or unit(vector) is None) and out.add((vec_id,)):
            yield out.batch()
    if out.rows:
        yield out.batch()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Links of all pairs, and what each vector reaches by them.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM fine a JOIN fine b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT r, r AS o FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.o
), low AS (
  SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.o GROUP BY 1
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.r) AS n_links, low.component_id, v.vec_id IS NOT DISTINCT FROM low.component_id AS kept FROM v JOIN low USING (r)
"""
