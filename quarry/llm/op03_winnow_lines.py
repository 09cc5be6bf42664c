"""Line dedup by winnowing over line hashes.

A window is the shortest run of lines from a line on (or back from a line) that has ``min_words`` words. Its fingerprint is the smallest
line hash in it, the last one of equals. Windows depend on their own lines alone, so two texts that share a run of lines with ``min_words``
words or more share every window inside it and its fingerprint: none is missed.

Fingerprints are joined on their hash; those that occur once, and their windows, go. The windows of the rest are joined on the hash of
all their lines. The first occurrence of a window, by (doc_id, text hash, line), stays and the lines of all later ones are deleted. Matches
are extended both ways by the forward and backward windows along a run, whose union is the whole run: a line of it with fewer than
``min_words`` words before it in the run has that many after it, or the other way round. No pairs are formed: each occurrence meets
the one row that its window's hash has, however many there are.

Lines are compared without white space at their ends; lines without words are no part of the comparison, and go when they lie inside a
deleted run. In a text that repeats itself the first lines stay. Exact copies are runs too: later copies with ``min_words`` words or
more lose all lines. Rows equal in doc_id and text are one document, and get one result. A null doc_id is the last one. A null text has no
lines and stays null; a text without words stays as it is. Texts of any length are read whole, one at a time. An empty table gives an
empty result. Other columns are kept by dedup().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LAST_ID, Out, checkpoint, rows_of, run, table, whole_rows

MIN_WORDS = 50
_WINDOW = pa.struct([("w", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
_ARROW = pa.schema([("doc", pa.int64()), ("key", pa.binary()), ("h", pa.int64()), ("windows", pa.list_(_WINDOW))])
FINGERPRINTS = "doc long, key binary, h long, windows array<struct<w:long,s:int,e:int>>"


def windows(counts: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs with ``least`` words or more, from each line on and back from each line."""
    found, n, end, total = set(), len(counts), 0, 0
    for start in range(n):  # forward
        while end < n and total < least:
            total += counts[end]
            end += 1
        if total < least:
            break
        found.add((start, end - 1))
        total -= counts[start]
    start, total = 0, 0
    for end in range(n):  # backward
        total += counts[end]
        while total - counts[start] >= least:
            total -= counts[start]
            start += 1
        if total >= least:
            found.add((start, end))
    return sorted(found)


def fingerprints(text: str, least: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(hash of the selected line, its windows as (hash, first line, last line)); line numbers count all lines of the text."""
    numbers, hashes, counts = [], [], []
    for i, line in enumerate(text.split("\n")):
        if n := len(line.split()):
            numbers.append(i)
            counts.append(n)
            hashes.append(xxhash.xxh3_64_intdigest(line.strip()))
    if sum(counts) < least:
        return []
    packed = np.array(hashes, dtype=np.uint64).tobytes()
    selected: dict[int, list[tuple[int, int, int]]] = {}
    for s, e in windows(counts, least):
        low = min(range(s, e + 1), key=lambda i: (hashes[i], -i))
        w = xxhash.xxh3_64_intdigest(packed[8 * s : 8 * e + 8], seed=1)
        selected.setdefault(low, []).append((w - (w >> 63 << 64), numbers[s], numbers[e]))
    return [(hashes[i] - (hashes[i] >> 63 << 64), own) for i, own in selected.items()]


def _find(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    out = Out(_ARROW)
    for doc, key, text in rows_of(batches):
        for h, own in fingerprints(text, least):
            if out.add((doc, key, h, [{"w": w, "s": s, "e": e} for w, s, e in own])):
                yield out.batch()
    if out.rows:
        yield out.batch()


def _identity(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.unhex(F.md5(F.col("text"))).alias("key")]


def repeated(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc, key and the line ranges to delete of each document that has any: ranges array<long>, first * 2^32 + last."""
    found = run(docs.where("text is not null").select(*_identity(docs), "text"), lambda batches: _find(batches, least), FINGERPRINTS)
    found = checkpoint(found)
    # the sides with one row per hash are cut off, so that a join's other side can be split where a hash is frequent
    often = checkpoint(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    # a row for each window whose fingerprint occurs more than once
    places = found.join(often, "h").select("doc", "key", F.explode("windows").alias("x")).select("x.w", "doc", "key", "x.s", "x.e")
    first = checkpoint(places.groupBy("w").agg(F.min(F.struct("doc", "key", "s", "e")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "first"))
    later = places.join(first, "w").where("first.doc <> doc or first.key <> key or first.s < s")
    own = (F.col("first.doc") == F.col("doc")) & (F.col("first.key") == F.col("key"))
    later = later.withColumn("s", F.when(own, F.greatest("s", F.col("first.e") + 1)).otherwise(F.col("s"))).where("s <= e")
    return later.groupBy("doc", "key").agg(F.collect_set(F.shiftleft(F.col("s").cast("long"), 32) + F.col("e")).alias("ranges"))


_DONE = "text string, n_lines long, n_deleted long, n_runs long"


def _without(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    rows = []
    for text, own in zip(texts, ranges, strict=True):
        if text is None or own is None or not len(own):
            rows.append((text, 0 if text is None else text.count("\n") + 1, 0, 0))
            continue
        lines = text.split("\n")
        keep, runs, upto = np.ones(len(lines), bool), 0, -2
        for x in sorted(map(int, own)):
            s, e = x >> 32, x & 0xFFFFFFFF
            keep[s : e + 1] = False
            runs += s > upto + 1
            upto = max(upto, e)
        rows.append(("\n".join(line for line, stays in zip(lines, keep, strict=True) if stays), len(lines), int((~keep).sum()), runs))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_deleted", "n_runs"])


def deduped(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """row (a struct of the columns of ``docs``) and done: a struct of the text without later repeated runs, n_lines, n_deleted and n_runs."""
    rows = docs.select(whole_rows(docs), *_identity(docs)).join(repeated(docs, least), ["doc", "key"], "left")
    text, none = F.col("row.text"), F.lit(0).cast("long")
    lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    as_it_is = F.struct(text.alias("text"), lines.alias("n_lines"), none.alias("n_deleted"), none.alias("n_runs"))
    cut = F.pandas_udf(_without, _DONE)(F.when(F.col("ranges").isNotNull(), text), F.col("ranges"))  # texts that stay need not leave the JVM
    return rows.select("row", F.when(F.col("ranges").isNull(), as_it_is).otherwise(cut).alias("done"))


def dedup(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text that is left; documents of which only white space is left are dropped."""
    done = deduped(docs, least).where("done.n_deleted = 0 or trim(translate(done.text, '\\n\\t\\r', '   ')) <> ''")
    return done.select(*[F.col("done.text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "done.*")


#: The same by all windows: the shortest runs with 50 words from each line on and back from each line; every later one goes.
ORACLE = r"""
WITH d AS (
  SELECT DISTINCT coalesce(CAST(doc_id AS BIGINT), 9223372036854775807) AS doc, md5(text) AS key, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc, key, i - 1 AS pos, regexp_replace(x[i], '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc, key, x, unnest(range(1, len(x) + 1)) AS i FROM d)
), c AS (
  SELECT *, len(regexp_extract_all(line, '\S+')) AS n, row_number() OVER (PARTITION BY doc, key ORDER BY pos) AS p FROM l WHERE line <> ''
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY doc, key ORDER BY p) AS upto FROM c
), agg AS (
  SELECT doc, key, list(line ORDER BY p) AS lines, list(pos ORDER BY p) AS ats, list(upto ORDER BY p) AS uptos, list(n ORDER BY p) AS ns FROM u GROUP BY 1, 2 HAVING max(upto) >= 50
), w AS (
  -- from a line on: the first end that has 50 words; back from a line: the last start that has
  SELECT doc, key, p AS s, list_position(list_transform(uptos, lambda y: y - (uptos[p] - ns[p]) >= 50), true) AS e, lines, ats FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS p FROM agg)
  UNION
  SELECT doc, key, len(list_filter(range(1, p + 1), lambda q: uptos[p] - uptos[q] + ns[q] >= 50)) AS s, p AS e, lines, ats FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS p FROM agg)
), h AS (
  SELECT doc, key, ats[s] AS a, ats[e] AS b, md5(array_to_string(lines[s : e], chr(10))) AS hash FROM w WHERE s > 0 AND e > 0
), f AS (
  SELECT *, first_value({'doc': doc, 'key': key, 'a': a, 'b': b}) OVER (PARTITION BY hash ORDER BY doc, key, a, b) AS fst FROM h
), later AS (
  SELECT DISTINCT doc, key, CASE WHEN fst.doc = doc AND fst.key = key THEN greatest(a, fst.b + 1) ELSE a END AS a, b FROM f WHERE NOT (fst.doc = doc AND fst.key = key AND fst.a = a)
), gone AS (
  SELECT DISTINCT doc, key, unnest(range(CAST(a AS BIGINT), CAST(b AS BIGINT) + 1)) AS pos FROM later WHERE a <= b
), marked AS (
  SELECT gone.*, lag(pos) OVER (PARTITION BY doc, key ORDER BY pos) IS DISTINCT FROM pos - 1 AS begins FROM gone
), per AS (
  SELECT doc, key, list(pos) AS ats, count(*) AS n_deleted, count(*) FILTER (begins) AS n_runs FROM marked GROUP BY 1, 2
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN ats IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda y, i: NOT list_contains(ats, i - 1)), chr(10)) END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs
FROM documents LEFT JOIN per ON per.doc = coalesce(CAST(doc_id AS BIGINT), 9223372036854775807) AND per.key = md5(text)
"""
