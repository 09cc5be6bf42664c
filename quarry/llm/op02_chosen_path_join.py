"""N-gram Jaccard join by chosen paths.

Texts are sets of shingles of ``n`` words; pairs with a Jaccard similarity of ``least`` or more are links.

1. Equal texts fall together. Each set is embedded as ``SIZE`` min-hash tokens.
2. A run begins with all sets in one node. A node samples coordinates (each with probability 1 / (least * SIZE), from a hash of the node's
   path) and sends each set to a child for each sampled coordinate, named by its token there. Nodes with one set end; nodes with up to
   ``LIMIT`` sets are compared; larger ones are split again, up to ``depth`` times, and what is then still large is compared in blocks.
3. Runs are repeated until the chance to miss a pair at the threshold (a branching process with mean 1) is below 1 - ``recall``.
   Nodes that hold the same sets are compared once.
4. In a node, sets are compared by their tokens; those near the threshold or above make up candidate groups. A group is grown from a set:
   each set that joins is compared with those that are left.
5. Inside candidate groups all pairs are compared exactly, on the shingles of the whole texts, in blocks; a block gives out a count of
   links per text and a forest of its links, not pairs. Classes are the connected components of all links.

Words are runs of characters other than space and the controls 9 to 13. A text with 1 to n - 1 words has one shingle, all of its words.
Texts without words, null ones too, link with nothing, not with each other. Equal texts link (similarity 1), and rows equal in doc_id and
text are rows of their own. The class of a row is the smallest doc_id in its class, nulls aside. An empty table gives an empty result. Other columns are not
read by join() and kept by representatives().

Hot groups: equal texts are counted map-side; a frequent shingle's node is split or cut into blocks; no task holds more than two blocks,
which rows and shingles bound (a longer text is a block's only one or nearly so). Texts of any length are read whole.
Members of a dense group of g different texts are compared in (g / block)^2 / 2 block pairs, since exact link counts ask for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Out, blocked, checkpoint, components, forest, grouped, rows_of, run, table, whole_rows

N, LEAST, SIZE, LIMIT, BLOCK, COMPARED = 5, 0.8, 128, 256, 256, 2048
#: Shingles of a block of whole texts.
BLOCK_SHINGLES = 1_000_000
#: Candidate texts are found by a broadcast up to so many, and by a shuffle beyond.
BROADCAST_KEYS = 300_000
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(2)
_FACTORS = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 2**31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, SIZE, dtype=np.uint32)
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base modulo 2^64, and of its inverse."""
    if not _powers:
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            table = np.full(PIECE + 1, np.uint64(base))
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    up, down = _power_tables()
    found, at = [], 0
    while at < len(raw):
        b = raw[at : at + PIECE]
        blank = (b == 32) | ((b >= 9) & (b <= 13))
        if at + PIECE < len(raw):  # end after a blank; a longer word is hashed in parts
            last = np.flatnonzero(blank)
            cut = int(last[-1]) + 1 if len(last) else len(b)
            b, blank = b[:cut], blank[:cut]
        at += len(b)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        found.append((sums[end] - sums[begin]) * down[begin])
    return mix(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def shingles(text: str, n: int = N) -> np.ndarray:
    """The text's set of shingle hashes, sorted."""
    return np.unique(_shingles(text, n))


def _shingles(text: str, n: int) -> np.ndarray:
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, np.uint64(k))
    for j in range(k):
        total = total + words[j : len(words) - k + 1 + j] * _FACTORS[j]
    return mix(total)


def tokens(found: np.ndarray) -> np.ndarray:
    """SIZE min-hashes of a set of shingle hashes."""
    x, low = (found >> np.uint64(32)).astype(np.uint32), np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    return low


_EMBEDDED = pa.schema([("key", pa.binary()), ("doc", pa.int64()), ("tokens", pa.binary()), ("sketch", pa.binary()), ("shingles", pa.int64())])


def _embed(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    out = Out(_EMBEDDED)
    for key, doc, text in rows_of(batches):
        if not len(found := _shingles(text, n)):
            continue
        low = tokens(found)
        if out.add((key, doc, low.tobytes(), low.astype(np.uint8).tobytes(), len(found))):
            yield out.batch()
    if out.rows:
        yield out.batch()


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near(least: float) -> float:
    """Sets are joined as candidates from this estimate by SIZE tokens on: 5 standard deviations below ``least``."""
    return least - 5 * math.sqrt(max(0.0, least * (1 - least)) / SIZE)


def runs_needed(least: float, depth: int, recall: float) -> int:
    """Runs until a pair at the threshold survives one of them with the given chance: it has Poisson(1) common children a level."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _paths(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Children of nodes: (path, key, tokens) to (path, key)."""
    below = np.uint64(int(2**64 / (least * SIZE)))
    coordinates = np.arange(1, SIZE + 1, dtype=np.uint64) * _ODD
    for batch in batches:
        path = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
        sets = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, SIZE)
        nodes, number = np.unique(path, return_inverse=True)
        rows, children = [], []
        chosen = mix(nodes[:, None] ^ coordinates) < below
        for i in range(SIZE):
            at = np.flatnonzero(chosen[number, i])
            rows.append(at)
            children.append(mix(mix(path[at] + coordinates[i]) ^ sets[at, i].astype(np.uint64)))
        rows_, found = np.concatenate(rows), np.concatenate(children)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column(1).take(pa.array(rows_))], names=["path", "key"])


_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _compare(batches: Iterable[pa.RecordBatch], alike_from: float) -> Iterator[pa.RecordBatch]:
    """Candidate groups inside nodes (path, i, j, key, sketch), as edges to a member; i and j are the node's blocks that are compared.

    What is joined is compared with the sets still left only, so a dense group costs little more than its size, and gives an edge per set."""
    out = Out(_EDGES)
    for _, rows in grouped(batches, 3):
        keys = [r[0] for r in rows]
        sets = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), SIZE)
        left = np.arange(len(rows))
        while len(left) > 1:
            seed, left = left[0], left[1:]
            front = [seed]
            while front and len(left):
                alike = (sets[left] == sets[front.pop()]).mean(axis=1) >= alike_from
                found, left = left[alike], left[~alike]
                front.extend(found)
                for k in found:
                    if out.add((keys[seed], keys[k])):
                        yield out.batch()
    if out.rows:
        yield out.batch()


def candidates(sets: DataFrame, least: float, depth: int, recall: float) -> DataFrame:
    """Edges (a, b) of text keys that may be links. ``sets``: key, tokens, sketch (the low byte of each token)."""
    runs, edges = runs_needed(least, depth, recall), None
    seeds = [int(x) for x in mix(np.arange(1, runs + 1, dtype=np.uint64) * _ODD).view(np.int64)]
    level = sets.select(F.explode(F.array(*map(F.lit, seeds))).alias("path"), "key", "tokens")
    sketches = sets.select("key", "sketch")
    for k in range(depth):
        rows = checkpoint(run(level, lambda batches: _paths(batches, least), "path long, key binary"))
        nodes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("same"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("same2")).where("n > 1")
        small = nodes if k == depth - 1 else nodes.where(F.col("n") <= LIMIT)
        once = checkpoint(small.groupBy("n", "same", "same2").agg(F.min("path").alias("path")).select("path", "n"))
        own = rows.join(once, "path").join(sketches, "key").select("path", "key", "sketch", "n")
        own = blocked(own, "n", COMPARED).select("path", "i", "j", "key", "sketch")
        found = run(own.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "key"), lambda batches: _compare(batches, near(least)), "a binary, b binary")
        found = checkpoint(found.distinct())
        edges = found if edges is None else edges.unionByName(found)
        if k < depth - 1:
            large = checkpoint(nodes.where(F.col("n") > LIMIT).select("path"))
            level = rows.join(large, "path").join(sets.select("key", "tokens"), "key").select("path", "key", "tokens")
    return edges.distinct()


_LINKS = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


def overlaps(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    if n <= 6:
        out = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[column] > 1  # a shingle of one text is in no intersection
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.concatenate([[0], np.diff(column) != 0])) if len(column) else column
    out, at = np.zeros((n, n), np.float64), 0
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        end = np.searchsorted(column, low + width)
        part = np.zeros((n, width), np.float32)
        part[owner[at:end], column[at:end] - low] = 1
        out += part @ part.T
        at = end
    return out


def _verify(batches: Iterable[pa.RecordBatch], n: int, least: float) -> Iterator[pa.RecordBatch]:
    """Links inside candidate groups (root, i, j, own block, key, copies, text): counts and a forest."""
    out = Out(_LINKS)
    for (_, i, j), rows in grouped(batches, 3):
        blocks, keys, copies = np.array([r[0] for r in rows]), [r[1] for r in rows], np.array([r[2] for r in rows])
        sets = [shingles(r[3], n) for r in rows]
        sizes = np.array([len(s) for s in sets])
        common = overlaps(sets)
        # similarity >= least, without a division; exact for the decimal threshold
        linked = common * (1 + least) >= least * (sizes[:, None] + sizes[None, :]) - 1e-9
        np.fill_diagonal(linked, False)
        if i != j:  # pairs inside a block belong to that block's own pair
            linked &= blocks[:, None] != blocks[None, :]
        counts, roots = linked @ copies, forest(linked)
        for k in np.flatnonzero(linked.any(axis=1)):
            if out.add((keys[k], int(counts[k]), keys[roots[k]])):
                yield out.batch()
    if out.rows:
        yield out.batch()


def classes(docs: DataFrame, n: int = N, least: float = LEAST, depth: int = 3, recall: float = 0.995) -> DataFrame:
    """One row per different text: key, first (its smallest doc_id), class_id, n_links (of each row with that text), any_words."""
    texts = docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    embedded = run(texts.select("key", "doc", "text"), lambda batches: _embed(batches, n), "key binary, doc long, tokens binary, sketch binary, shingles long")
    sets = checkpoint(embedded.groupBy("key").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("tokens").alias("tokens"), F.min("sketch").alias("sketch"), F.min("shingles").alias("shingles")))
    groups = components(candidates(sets.select("key", "tokens", "sketch"), least, depth, recall))
    # tables with one row per node or root are cut off: the other side of their joins can then be split where one is large
    members = groups.withColumnRenamed("node", "key").join(sets.select("key", "copies", "shingles"), "key")
    sizes = checkpoint(members.groupBy("root").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum("shingles") * BLOCK / BLOCK_SHINGLES)).alias("size")))
    members = checkpoint(members.drop("shingles").join(sizes, "root"))
    few = F.broadcast(members) if members.count() <= BROADCAST_KEYS else members
    # equal texts are the same text: one of them is enough, whichever it is
    whole = texts.select("key", "text").join(few, "key").dropDuplicates(["key"])
    own = blocked(whole.withColumn("own", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK)).cast("int")), "size", BLOCK)
    own = own.select("root", "i", "j", "own", "key", "copies", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "key")
    linked = checkpoint(run(own, lambda batches: _verify(batches, n, least), "key binary, links long, root binary"))
    counts = linked.groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    rows = sets.select("key", "first", "copies").join(counts, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
    rows = checkpoint(rows.select("key", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root")))
    smallest = checkpoint(rows.groupBy("root").agg(F.min_by(F.struct("first", "key"), F.struct(F.col("first").isNull(), "first", "key")).alias("low")))
    return rows.join(smallest, "root").select("key", "first", F.col("low.first").alias("class_id"), "n_links", (F.col("low.key") == F.col("key")).alias("lowest"))


def join(docs: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links."""
    found = classes(docs, **how)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    out = rows.join(found, "key", "left")
    return out.select("doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (of texts with the same id, the smallest hash, and of rows
    that are equal in id and text, the one whose other columns are first as JSON).

    Texts without words are classes of their own and stay."""
    found = classes(docs, **how).select("key", "first", "lowest")
    own = docs.select(whole_rows(docs), text_key(F.col("text")).alias("key"))
    out = own.join(found, "key", "left").where("lowest is null or lowest and cast(row.doc_id as bigint) <=> first")
    lone = out.where("lowest is null").select("row")
    others = [F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    by = F.to_json(F.struct(*others)) if others else F.lit("")
    one = out.where("lowest is not null").groupBy("key").agg(F.min_by("row", F.coalesce(by, F.lit(""))).alias("row")).select("row")
    return one.unionByName(lone).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: The exact join: all pairs that share a shingle, and what each row reaches by its links.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 5 * c >= 4 * (x.n + y.n - c)
), reach AS (
  SELECT r, r AS o FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.o
), low AS (
  SELECT reach.r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.o GROUP BY 1
), often AS (
  SELECT a AS r, count(*) AS n FROM links GROUP BY 1
)
SELECT doc_id, class_id, CAST(coalesce(often.n, 0) AS BIGINT) AS n_links FROM d JOIN low USING (r) LEFT JOIN often USING (r)
"""
