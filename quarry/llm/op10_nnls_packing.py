"""Packing by non-negative least squares over the histogram of lengths.

A document's ids (byte-level BPE, then one separator id) are cut into full windows and one rest. The rests' histogram has ``window`` bins at
most, however many documents there are. On the driver, from the histogram alone: all ways to fill a window with up to three
lengths are enumerated, non-negative least squares gives how often each is repeated, the counts are rounded down and trimmed to what
there is, and the residual lengths are packed greedily, the longest first, each with the longest that still fits.

That plan says which ranks of a length go where. The rests of each length are ranked by running counts over (length, bucket) windows, so
a length that a third of the rows share is spread, and every row looks its place up in the plan, whose size the window bounds.

Texts are encoded once; what is kept of a piece is its start, length and checksum. A null text is an empty one and has the separator id
alone. Rows equal in doc_id and text are documents of their own. An empty table gives an empty result. Other columns are not read.

Texts are encoded by ``tiktoken`` with the vocabulary's own pattern, which gives the ids of ``tokenizers`` several times faster. Long
runs of white space, in which the pattern's engine would recurse, are cut off where the pattern splits too. Texts of any length are
encoded from end to end; a task holds one Arrow batch and one text's ids.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Out, checkpoint, rows_of, run, running_start, table

WINDOW, SEPARATOR = 1024, 0
#: Runs of white space (the pattern's, by Unicode) that are encoded apart.
RUNS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")
END_OF_TEXT = "<|endoftext|>"


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids, as bytes of little-endian 32-bit numbers. The ids are those of ``json_path`` in ``tokenizers``, special tokens included."""

    def __init__(self, ranks_path: str, json_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.piece = own.encode_ordinary, own._encode_single_piece
        self.json_path, self.exact = json_path, None

    def whole(self, text: str) -> bytes:
        out, at = [], 0
        for run_ in RUNS.finditer(text):
            # the pattern leaves a run's last character to what follows, if anything does
            end = run_.end() - (run_.end() < len(text))
            out += [array("I", self.encode(text[at : run_.start()])).tobytes(), array("I", self.piece(text[run_.start() : end])).tobytes()]
            at = end
        out.append(array("I", self.encode(text[at:])).tobytes())
        return b"".join(out)

    def with_special(self, text: str) -> bytes:
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.json_path)
        return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        return self.with_special(text) if END_OF_TEXT in text else self.whole(text)


@lru_cache(maxsize=1)
def encoder(ranks_path: str, json_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, json_path, pattern)


PIECES = "doc_id long, text_crc long, start long, length long, ids_crc32 long, doc_tokens long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text_crc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def _cut(batches: Iterable[pa.RecordBatch], how: tuple[str, str, str], window: int) -> Iterator[pa.RecordBatch]:
    encode, out = encoder(*how), Out(_ARROW)
    end = array("I", [SEPARATOR]).tobytes()
    for doc_id, text in rows_of(batches):
        text = text or ""
        ids = encode(text) + end
        n, crc = len(ids) // 4, zlib.crc32(text.encode())
        for start in range(0, n, window):
            piece = ids[4 * start : 4 * (start + window)]
            if out.add((doc_id, crc, start, len(piece) // 4, zlib.crc32(piece), n)):
                yield out.batch()
    if out.rows:
        yield out.batch()


def pieces(docs: DataFrame, window: int = WINDOW, ranks: str = "byte_bpe_50k.tiktoken", json: str = "byte_bpe_50k.json") -> DataFrame:
    """The pieces of each document: full windows from its start, then the rest."""
    import public_tokenizers

    how = (vocabulary(ranks), vocabulary(json), public_tokenizers.PATTERN)
    return run(docs.select(F.col("doc_id").cast("long"), "text"), lambda batches: _cut(batches, how, window), PIECES)


def fillings(window: int) -> np.ndarray:
    """All ways to fill ``window`` with one to three lengths, each as a sorted row; missing lengths are 0."""
    one = [[window, 0, 0]]
    two = [[a, window - a, 0] for a in range(window - 1, (window - 1) // 2, -1) if a >= window - a]
    a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    c = window - a - b
    keep = (a >= b) & (b >= c) & (c >= 1)
    return np.concatenate([np.array(one + two), np.stack([a[keep], b[keep], c[keep]], axis=1)]) if window > 1 else np.array(one)


def least_squares(ways: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the sum of the ways nearest to the histogram, by accelerated projected gradient.

    Long lengths weigh more: what is left of them is hard to fill up."""
    window = len(histogram) - 1
    weight = 0.2 + np.arange(window + 1) / window
    weight[0] = 0
    goal = histogram * weight

    def total(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(ways[:, j], weights=x, minlength=window + 1) for j in range(3)) * weight

    def back(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return r[ways[:, 0]] + r[ways[:, 1]] + r[ways[:, 2]]

    v = np.random.default_rng(0).random(len(ways))
    for _ in range(12):  # the largest eigenvalue, for the length of steps
        v = back(total(v))
        v /= np.linalg.norm(v) or 1
    bound = 1.05 * float(np.linalg.norm(back(total(v)))) or 1.0
    x = y = np.zeros(len(ways))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(total(y) - goal) / bound)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using up the histogram (index: length)."""
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], most: int | None = None) -> None:
        need: dict[int, int] = {}
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        times = min(int(left[n]) // k for n, k in need.items())
        times = times if most is None else min(times, most)
        if times > 0:
            for n, k in need.items():
                left[n] -= times * k
            chosen.append((lengths, times))

    if left.sum():
        ways = fillings(window)
        ways = ways[((left[ways] > 0) | (ways == 0)).all(axis=1)]
        if len(ways):
            x = np.floor(least_squares(ways, left.astype(float)) + 1e-6).astype(np.int64)
            for i in np.argsort(-x, kind="stable"):
                if x[i] == 0:
                    break
                take(tuple(int(n) for n in ways[i] if n), int(x[i]))
    while left.any():  # greedily: the longest, then the longest that fits; as many times as there are such lengths
        lengths, room = [], window
        some = left.copy()
        while room and (fits := np.flatnonzero(some[: room + 1])).size:
            n = int(fits[-1])
            lengths.append(n)
            some[n] -= 1
            room -= n
        take(tuple(lengths))
    return chosen


def places(chosen: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """The plan by length and rank. Columns: length, first rank, last rank + 1, first sequence, of its pieces in a sequence, offset of the first."""
    rows, used, sequence = [], {}, 0
    for lengths, times in chosen:
        offset, i = 0, 0
        while i < len(lengths):
            j = i
            while j < len(lengths) and lengths[j] == lengths[i]:
                j += 1
            n, k = lengths[i], j - i
            first = used.get(n, 0)
            rows.append((n, first, first + times * k, sequence, k, offset))
            used[n] = first + times * k
            offset += n * k
            i = j
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _place(batches: Iterable[pa.RecordBatch], at: np.ndarray) -> Iterator[pa.RecordBatch]:
    key = at[:, 0] << 44 | at[:, 1]
    for batch in batches:
        n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        row = at[np.searchsorted(key, n << 44 | rank, side="right") - 1]
        inside = rank - row[:, 1]
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        columns += [pa.array(row[:, 3] + inside // row[:, 4]), pa.array(row[:, 5] + inside % row[:, 4] * n)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, window: int = WINDOW, buckets: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = checkpoint(pieces(docs, window).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc", "start"), F.lit(buckets))).withColumn("one", F.lit(1)))
    histogram = np.zeros(window + 1, np.int64)
    for row in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most as many rows as the window has ids
        histogram[row["length"]] = row["n"]
    at = places(plan(histogram))
    ranked = running_start(cut, ["length"], "bucket", [F.col(c) for c in ("doc_id", "text_crc", "start", "ids_crc32")], "one", "rank")
    return run(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"), lambda batches: _place(batches, at), _PLACED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
