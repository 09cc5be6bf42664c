"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: the sources share ``share`` times all sizes by weight; none gets more than ``most`` times its own size, and what it leaves is
shared among the others by weight (water filling, solved by sorting sources by the level at which they are full).

Schedule: slot k has the golden-ratio point of k; the point's place in the cumulative targets names the slot's source, so every
stretch of slots holds the sources near their weights. A source's slots are ranked. Slots beyond a source's quota are left out, and the
few that a source lacks at the end (the sequence's discrepancy, which grows with the logarithm of the slots) follow after the last point.

Blocks: a source's documents, shuffled by a hash, lie on a line of words that is cut into blocks of ``block`` words (the last may be
shorter). The slot of rank r takes block r modulo the number of blocks, wholly but for the slot in which the target is reached.
So a source's taken words are its target, rounded, and a document is taken at most ``most`` times.

Everything is DataFrame functions. Lines and ranks are running sums over (source, bucket) windows with an offset per bucket; slots
meet documents by (source, block), whose size the block bounds: a hot source is spread over its blocks.

The size of a document is its number of words (runs of characters other than space and the controls 9 to 13); null texts have none,
and documents without words are taken 0 times. A null source is a source, the last one. Rows that are equal in doc_id, size, source and
text are rows of their own. An empty table gives an empty result. Other columns are kept by mixed() and not read by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, running_start, short_hash, table, whole_rows

WEIGHTS = (3, 1, 2)
#: The golden ratio's fraction of 2^31, odd: k * GOLDEN modulo 2^31 visits every point once.
GOLDEN, POINTS = 1327217885, 2147483648


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    """60 bits of an MD5, so that SQL elsewhere can follow; a null text is not an empty one."""
    return short_hash(F.coalesce(F.concat(F.lit("t"), text), F.lit("")))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source of ``sizes`` (source, size): s (its number), source, source_size, target."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = totals.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = numbered.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod("s", F.lit(len(weights))).cast("int") + 1).cast("double"))
    capped = weighted.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    line = Window.orderBy("full_at", "s")
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * share
    spent = F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(line.rowsBetween(0, Window.unboundedFollowing))
    # in the order in which sources fill up, the level is that of the first source which does not
    levels = capped.withColumn("level", (total - spent) / left)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "s", "level"))).over(everything)
    return levels.withColumn("at", level).select("s", "source", "source_size", F.least("cap", F.coalesce(F.col("at.level") * F.col("w"), F.col("cap"))).alias("target"))


def schedule(spark: SparkSession, sources: DataFrame, block: int, chunk: int = 65536) -> DataFrame:
    """Slots in order: k, s, rank, block, first (of the source's line), words. ``sources``: s, source_size, target."""
    # one row per source: what the plan of a mix is made of
    rows = sources.select("s", "source_size", F.round("target").cast("long").alias("words")).orderBy("s").collect()
    quota = {r["s"]: _quota(r["source_size"], r["words"], block) for r in rows}
    n, total, upto, bounds = sum(quota.values()), sum(r["words"] for r in rows), 0, []
    for r in rows:
        upto += r["words"]
        bounds.append(upto / total if total else 1.0)
    point = F.pmod(F.pmod("k", F.lit(POINTS)) * F.lit(GOLDEN) + F.lit(POINTS // 2), F.lit(POINTS)) / F.lit(float(POINTS))
    ends = F.array(*map(F.lit, bounds or [1.0]))
    picked = spark.range(n).withColumnRenamed("id", "k").withColumn("u", point).withColumn("s", F.least(F.size(F.filter(ends, lambda e: e <= F.col("u"))), F.lit(max(0, len(rows) - 1))))
    picked = picked.drop("u").withColumn("one", F.lit(1)).withColumn("chunk", F.expr(f"k div {chunk}"))
    ranked = checkpoint(running_start(picked, ["s"], "chunk", [F.col("k")], "one", "rank").select("k", "s", "rank"))
    had = ranked.groupBy("s").agg(F.count(F.lit(1)).alias("had"))
    plan = sources.select("s", "source_size", F.round("target").cast("long").alias("goal")).withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    plan = plan.withColumn("epochs", F.expr("if(source_size > 0, goal div greatest(source_size, 1), 0)")).withColumn("rest", F.expr("goal - epochs * source_size"))
    plan = plan.withColumn("quota", F.expr(f"epochs * blocks + (rest + {block - 1}) div {block}"))
    lacking = plan.join(had, "s", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < quota").select(F.lit(n).cast("long").alias("k"), "s", F.explode(F.expr("sequence(had, quota - 1)")).alias("rank"))
    slots = ranked.unionByName(lacking).join(plan.where("quota > 0"), "s").where("rank < quota")
    slots = slots.withColumn("block", F.pmod("rank", F.col("blocks"))).withColumn("first", F.col("block") * block)
    done = F.expr("(rank div blocks) * source_size") + F.col("first")
    return slots.select("k", "s", "rank", "block", "first", F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("first"), F.col("goal") - done).alias("words"))


def _quota(size: int, words: int, block: int) -> int:
    if not size:
        return 0
    epochs, rest = divmod(words, size)
    return epochs * -(-size // block) + -(-rest // block)


def mix(docs: DataFrame, block: int = 4096, buckets: int = 512, seed: int = 9) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, text_hash, source_size, target, taken."""
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text")).alias("size"), text_hash(F.col("text")).alias("text_hash"))
    sized = checkpoint(sized.withColumn("shuffled", short_hash(F.concat_ws(":", F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "size", "text_hash"))).withColumn("bucket", F.pmod(F.shiftright("shuffled", 20), F.lit(buckets))))
    goals = checkpoint(targets(sized))
    laid = running_start(sized, ["source"], "bucket", [F.col(c) for c in ("shuffled", "doc_id", "text_hash", "size")], "size", "begin")
    laid = laid.join(goals.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    laid = laid.select("doc_id", "source", "size", "text_hash", "s", "source_size", "target", "begin")
    touched = F.expr(f"if(size > 0, sequence(begin div {block}, (begin + size - 1) div {block}), array(-1L))")
    pieces = laid.withColumn("block", F.explode(touched))
    slots = schedule(docs.sparkSession, goals, block).select("s", "block", "first", "words")
    met = pieces.join(slots, ["s", "block"], "left")
    overlap = F.least(F.col("first") + F.col("words"), F.col("begin") + F.col("size")) - F.greatest("first", "begin")
    # least() and greatest() skip nulls, so pieces that met no slot are set apart
    parts = met.withColumn("part", F.when(F.col("words").isNotNull(), F.greatest(overlap, F.lit(0))).otherwise(0))
    # documents without words may share a place on the line
    counted = parts.where("size > 0").groupBy("doc_id", "source", "size", "text_hash", "source_size", "target", "begin").agg(F.sum("part").alias("taken")).drop("begin")
    return counted.unionByName(laid.where("size = 0").select("doc_id", "source", "size", "text_hash", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as often as the mix takes them: all columns, each row as many times as it is taken, rounded to whole documents.

    Rows that are equal in doc_id, source and text share one decision."""
    taken = mix(docs, **how).where("size > 0").groupBy("doc_id", "source", "text_hash").agg(F.sum("taken").alias("t"), F.sum("size").alias("n"))
    times = taken.withColumn("times", F.floor(F.col("t") / F.col("n") + 0.5).cast("int")).where("times > 0").select("doc_id", "source", "text_hash", "times")
    rows = docs.select(whole_rows(docs), F.col("doc_id").cast("long").alias("own_id"), F.col("source").cast("string").alias("own_source"), text_hash(F.col("text")).alias("own_hash"))
    met = rows.join(times, (F.col("text_hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("source").eqNullSafe(F.col("own_source")))
    return met.select("row", F.explode(F.sequence(F.lit(1), "times"))).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


#: What the mix takes, in one statement. The order of slots shows in no column: every source has the ranks below its quota, whatever their slots.
ORACLE = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce('t' || text, '')), 1, 15) AS BIGINT) AS h FROM documents
), e AS (
  SELECT *, CAST('0x' || substr(md5('9:' || coalesce(doc_id, -1) || ':' || size || ':' || h), 1, 15) AS BIGINT) AS shuffled FROM d
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1
), n AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s, sum(source_size) OVER () * 1.5 AS total FROM t
), w AS (
  SELECT *, CAST([3, 1, 2][s % 3 + 1] AS DOUBLE) AS w, 2.0 * source_size AS cap FROM n
), lv AS (
  SELECT *, cap / w AS full_at, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), lvl AS (
  SELECT arg_min(level, full_at) AS level FROM lv WHERE level <= full_at
), g AS (
  SELECT s, source, source_size, least(cap, coalesce((SELECT level FROM lvl) * w, cap)) AS target FROM lv
), p AS (
  SELECT *, CAST(round(target) AS BIGINT) AS goal, (source_size + 4095) // 4096 AS blocks FROM g
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN ((goal // source_size) * blocks) + ((goal % source_size + 4095) // 4096) ELSE 0 END AS quota FROM p
), slots AS (
  -- slots beyond a quota are left out, and lacking ones follow: every source has the ranks below its quota
  SELECT q.*, r.rank, r.rank % q.blocks AS block FROM q, LATERAL (SELECT unnest(range(CAST(q.quota AS BIGINT))) AS rank) AS r
), took AS (
  SELECT s, block, block * 4096 AS first, least(4096, source_size - block * 4096, goal - (rank // blocks) * source_size - block * 4096) AS words FROM slots
), laid AS (
  SELECT e.*, q.s, q.source_size, q.target, coalesce(sum(size) OVER (PARTITION BY e.source ORDER BY (shuffled >> 20) % 512, shuffled, doc_id, h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin,
    row_number() OVER () AS i FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, any_value(laid.source) AS source,
  CAST(coalesce(sum(greatest(0, least(first + words, begin + size) - greatest(first, begin))) FILTER (size > 0 AND took.block IS NOT NULL), 0) AS BIGINT) AS taken
FROM laid LEFT JOIN took ON took.s = laid.s AND took.block BETWEEN (begin // 4096) AND ((begin + size - 1) // 4096) GROUP BY i, doc_id
"""
