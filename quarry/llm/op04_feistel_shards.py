"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Rows get the numbers 0 to n - 1; a keyed Feistel network over Z_a x Z_b (a * b >= n) permutes them, and a value of n or more walks
on until it falls below n. Shard and slot are the position modulo and divided by the number of shards, so shard sizes differ by one
row at most, slots have no gaps, and both can be computed from the row number alone. Everything is DataFrame functions.

Row numbers follow the row's key (doc_id, size, text_crc32, 60 bits of the text's MD5), in the order of (bucket, key) for a bucket hashed from
the key, so they do not depend on files, partitions or retries. Rows that are equal in the key are counted map-side first
and numbered as one range; they may change places among themselves, which no column shows. A hot id, a null id or many equal rows
therefore fall into no single task. Null texts have size 1 (no bytes, plus 1) and the checksum of the empty text. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, short_hash, table

ROUNDS = 6


def domain(n: int) -> tuple[int, int]:
    """Factors a, b of the smallest product a * b >= n with a from sqrt(n) to 4 sqrt(n): few values have to walk."""
    low = max(1, math.isqrt(max(0, n - 1)) + 1)
    a = np.arange(low, 4 * low + 1, dtype=np.int64)
    best = int(a[np.argmin(-n % a)])
    return best, max(1, -(-n // best))


def feistel(df: DataFrame, column: str, a: int, b: int, seed: int) -> DataFrame:
    """One pass of the network over ``column``, whose values are below a * b."""
    df = df.withColumn("__l", F.expr(f"`{column}` div {b}")).withColumn("__r", F.pmod(column, F.lit(b)))
    for i in range(ROUNDS):
        side, other, size = ("__l", "__r", a) if i % 2 == 0 else ("__r", "__l", b)
        df = df.withColumn(side, F.pmod(F.col(side) + F.pmod(short_hash(F.concat_ws(":", F.lit(seed * ROUNDS + i), other)), F.lit(size)), F.lit(size)))
    return df.withColumn(column, F.col("__l") * F.lit(b) + F.col("__r")).drop("__l", "__r")


def permute(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Permute the numbers 0 to n - 1 in ``column``. A walk meets each value outside at most once, so a * b - n more passes end it."""
    a, b = domain(n)
    df = feistel(df, column, a, b, seed)
    for _ in range(a * b - n):
        df = feistel(df.withColumn("__was", F.col(column)), column, a, b, seed).withColumn(column, F.when(F.col("__was") < n, F.col("__was")).otherwise(F.col(column))).drop("__was")
    return df


def shards(keys: DataFrame, n_shards: int = 16, seed: int = 1, buckets: int = 1024) -> DataFrame:
    """``keys`` with position, shard and slot, one row per row of keys; all its columns together are the key."""
    names = keys.columns
    counted = checkpoint(keys.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.pmod(short_hash(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])), F.lit(buckets))))
    totals = counted.groupBy("__b").agg(F.sum("__n").alias("__t"))
    n = counted.agg(F.sum("__n")).first()[0] or 0
    # at most as many rows as buckets
    offsets = totals.select("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy("__b").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = counted.withColumn("__i", inside).join(F.broadcast(offsets), "__b").select(*names, F.explode(F.expr("sequence(__o + __i, __o + __i + __n - 1)")).alias("row_number"))
    placed = permute(numbered.withColumn("position", F.col("row_number")), "position", n, seed)
    return placed.withColumn("shard", F.pmod("position", F.lit(n_shards)).cast("int")).withColumn("slot", F.expr(f"position div {n_shards}"))


def key_columns(text: Column) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    return [(F.octet_length(whole).cast("long") + 1).alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), short_hash(whole).alias("__text")]


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, row_number, position, shard, slot."""
    return shards(docs.select(F.col("doc_id").cast("long"), *key_columns(F.col("text"))), n_shards, seed).drop("__text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same permutation by recursion: a step is a round of the network, and a number that lies outside after six rounds walks on. The checksum folds the bytes.
ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM documents, crc
), m AS (
  SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32 || ':' || h), 1, 15) AS BIGINT) % 1024, doc_id NULLS FIRST, size, text_crc32, h) - 1 AS i FROM d
), n AS (
  SELECT count(*) AS n, greatest(1, CAST(floor(sqrt(greatest(0, count(*) - 1))) AS BIGINT) + 1) AS low FROM d
), sides AS (
  SELECT n, arg_min(a, ((a - n % a) % a) * 1000000000 + a) AS a FROM n, LATERAL (SELECT unnest(range(low, 4 * low + 1)) AS a) AS r GROUP BY n
), ab AS (
  SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM sides
), walk AS (
  SELECT i, i // b AS l, i % b AS r, 0 AS k FROM m, ab
  UNION ALL
  SELECT i, CASE WHEN k % 2 = 0 THEN (l + CAST('0x' || substr(md5((6 + k % 6) || ':' || r), 1, 15) AS BIGINT) % a) % a ELSE l END,
    CASE WHEN k % 2 = 1 THEN (r + CAST('0x' || substr(md5((6 + k % 6) || ':' || l), 1, 15) AS BIGINT) % b) % b ELSE r END, k % 6 + 1
  FROM walk, ab WHERE NOT (k = 6 AND l * b + r < n)
), placed AS (
  SELECT i, l * b + r AS position FROM walk, ab WHERE k = 6 AND l * b + r < n
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(position % 16 AS INTEGER) AS shard, CAST(position // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM m JOIN placed USING (i)
"""
