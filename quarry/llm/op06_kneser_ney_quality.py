"""Quality classifier: the perplexity of texts under an interpolated modified Kneser-Ney model of character n-grams.

Models are per language, trained on all trusted texts (label quality 1 and not toxic). Each text's log-perplexity per
character and per word must lie in the band of the trusted texts of its language and about its length; junk of rare characters lies
above, and repeated words lie to either side in words. The share of different words among a text's words must not lie below its band.
The band reaches from median - wide * (median - low quantile) to median + wide * (high quantile - median); wide is ``stretch`` * (1 +
``doubt`` / sqrt(n)) for n different trusted texts, as quantiles of few are uncertain. The query and kept() take the quantiles as they
are (``stretch`` 1), as they come from texts that the model has not seen. Neither distance counts as less than ``LEAST_SPREAD``, and a length with
fewer than ``FEW`` texts near it has its language's band.

Scores come from n-grams of ``ORDER`` characters, all characters and all counts (U+0000 and U+FDD1 count as one character, U+FDD0 as the
beginning). Trusted texts are dealt into two halves by a hash of the text; a half's model scores the other half and what is not
trusted, so that no text is scored by its own counts. Counts, continuation counts, discounts and probabilities are sharded DataFrames
that grow with the text; scoring joins them, order by order, with the n-grams of blocks of documents (texts of one model, neighbours in
doc_id), and a block's texts then meet the costs of its n-grams. Only discounts, alphabet sizes, bands and the sizes of blocks pass
through the driver.

A null text is an empty one. Texts without a character have no perplexity and are not kept. A null language is the language "". A
language without any trusted text has no model: its texts have no perplexity and are kept. Rows with the same id are judged each by
its own text; a document counts as trusted if all labels of its id say so. Equal texts in a language get equal results; a text of any length
is scored whole. Empty tables give empty results; without labels nothing is trusted. Other columns are kept by kept() and not read.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Out, checkpoint, give_back, rows_of, run, table

#: Rejected texts and trusted ids are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
SLICE = 1 << 20
#: Different trusted texts from which on a length has its own band, how many buckets of length they may be away, and the least distance
#: from the median to a quantile, in nats a character and in logarithms of nats a word.
FEW, REACH, LEAST_SPREAD = 30, (1, 2, 4), 0.03
#: Length of n-grams; numbers of ORDER symbols below RADIX fit 63 bits, and a part of a text has fewer characters than RADIX.
ORDER, RADIX, PART = 4, 55_000, 32_768
#: Stand for what is before a text, and for the character 0.
PAD, NUL = 0xFDD0, "\ufdd1"
#: n-grams that a task holds, and that it holds as strings.
MOST, MOST_STRINGS = 5_000_000, 1_000_000
#: Characters of a range of ids, of a block of one model's texts within a range, and of a task's texts at least.
RANGE_CHARS, BLOCK_CHARS, TASK_CHARS = 256_000_000, 64_000_000, 16_000_000


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def by_lang(values: dict, kind: str) -> Column:
    """The value of a row's ``lang``, from one value a language."""
    entries = [F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for pair in values.items() for x in pair]
    return F.element_at(F.create_map(*entries), F.col("lang")) if entries else F.lit(None).cast(kind)


def few(df: DataFrame, chars: int) -> DataFrame:
    """``df`` in no more partitions than what comes of ``chars`` characters is worth; small tables do not scatter over many files."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / TASK_CHARS)))


def _discounts(counts: DataFrame) -> Column:
    """The discount of a count ``n``, by language."""
    of = [F.count(F.when(F.col("n") == k, 1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    found = [F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(0.5 * k) for k in (1, 2, 3)]
    rows = counts.groupBy("lang").agg(*of).select("lang", *[F.greatest(F.lit(0.05), F.least(d, F.lit(k - 0.05))).alias(f"d{k}") for k, d in enumerate(found, 1)]).collect()  # a row a language
    return F.element_at(by_lang({r["lang"]: [r["d1"], r["d2"], r["d3"]] for r in rows}, "array<double>"), F.least("n", F.lit(3)).cast("int"))


def length_bucket(n_words: int) -> int:
    return max(1, n_words).bit_length()


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """lang and text of the documents whose labels all say: quality 1, not toxic."""
    ids = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")).where("good").select("doc_id")
    ids = checkpoint(ids)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids  # 16 bytes an id
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''").join(ids, "doc_id", "left_semi").select("lang", "text")


def bands_of(judged: DataFrame, quantile: float = 0.99, stretch: float = 2.0, doubt: float = 5.0) -> dict[tuple[str, int], tuple[float, ...]]:
    """Bands by language and length from different trusted texts (lang, n_words, c, w, r); bucket 0 holds all lengths.

    A bucket's band is that of the texts up to 1, 2 or 4 buckets away, the nearest that are ``FEW`` or more; it has none if they are fewer."""
    bucket = F.length(F.bin(F.greatest(F.col("n_words"), F.lit(1))))
    places = F.array(F.struct(F.lit(0).alias("reach"), F.lit(0).alias("bucket")), *[F.struct(F.lit(reach).alias("reach"), (bucket + k).alias("bucket")) for reach in REACH for k in range(-reach, reach + 1)])
    near = judged.select("lang", "c", "w", "r", F.explode(places).alias("at")).select("lang", "c", "w", "r", "at.*").where("reach = 0 or bucket > 0")
    cuts = [F.percentile_approx(c, [1 - quantile, 0.5, quantile], 100_000).alias(c) for c in ("c", "w", "r")]  # sketches of bounded size
    rows = near.groupBy("lang", "reach", "bucket").agg(*cuts, F.count(F.lit(1)).alias("n")).collect()  # some 100 rows a language
    out: dict[tuple[str, int], tuple[float, ...]] = {}
    for r in sorted(rows, key=lambda r: r["reach"]):
        if r["reach"] == 0 or r["n"] >= FEW:
            wide = stretch * (1 + doubt / r["n"] ** 0.5)
            out.setdefault((r["lang"], r["bucket"]), tuple(m + side * wide * max(LEAST_SPREAD, abs(q - m)) for low, m, high in (r["c"], r["w"], r["r"]) for side, q in ((-1, low), (1, high))))
    return out


class _Cells:
    """Counts of n-grams by (block, lang) as numbers of base ``RADIX``, over symbols that are given to characters as they come."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.lookup, self.characters = np.zeros(0x110000, np.int64), [PAD]
        self.lookup[PAD] = 1  # symbols count from 1 here, from 0 in numbers
        self.cells: dict[tuple[int, str], list] = {}
        self.held = 0

    def add(self, cell: tuple[int, str], part: np.ndarray) -> None:
        fresh = np.unique(part[self.lookup[part] == 0])
        self.lookup[fresh] = np.arange(len(fresh)) + len(self.characters) + 1
        self.characters += fresh.tolist()
        have = self.cells.setdefault(cell, [np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0])
        have[2].append(numbers(self.lookup[part] - 1, RADIX, None))
        have[3] += len(part)
        self.held += len(part)
        if have[3] >= SLICE // 4:
            self.merge(have)

    def merge(self, have: list) -> None:
        found, n = np.unique(np.concatenate(have[2]), return_counts=True)
        both, where = np.unique(np.concatenate([have[0], found]), return_inverse=True)
        self.held += len(both) - len(have[0]) - have[3]
        have[:] = [both, np.bincount(where, np.concatenate([have[1], n])).astype(np.int64), [], 0]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The counts so far, which are then forgotten."""
        characters = np.array(self.characters, np.uint32)
        for (block, lang), have in self.cells.items():
            if have[2]:
                self.merge(have)
            for i in range(0, len(have[0]), 1 << 14):
                rest, n = have[0][i : i + (1 << 14)], have[1][i : i + (1 << 14)]
                digits = np.empty((len(rest), ORDER), np.uint32)
                for k in range(ORDER - 1, -1, -1):
                    rest, digit = np.divmod(rest, RADIX)
                    digits[:, k] = characters[digit]
                grams = digits.view(f"<U{ORDER}").ravel().tolist()
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(n), pa.int32()), pa.array([lang] * len(n), pa.string()), pa.array(grams, pa.string()), pa.array(n)], names=["block", "lang", "gram", "n"])
        self.reset()


def padded(text: str) -> np.ndarray:
    """Code points, with the beginning's sign before them."""
    return np.concatenate([np.full(ORDER - 1, PAD, np.uint32), codes(text.replace("\0", NUL))])


def numbers(x: np.ndarray, radix: int, heads: np.ndarray | None) -> np.ndarray:
    """A number for each n-gram of symbols; ``heads`` (first three symbols, in order) stand in where all symbols are too many for 63 bits."""
    n = len(x) - ORDER + 1
    out = (x[:n] * radix + x[1 : n + 1]) * radix + x[2 : n + 2]
    out = out if heads is None else np.searchsorted(heads, out)
    for k in range(3, ORDER):
        out = out * radix + x[k : n + k]
    return out


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lang, text) to (block, lang, gram, n), each once or a few times a task."""
    cells = _Cells()
    for block, lang, text in rows_of(batches):
        x = padded(text)
        for i in range(0, len(x) - ORDER + 1, PART):
            part = x[i : i + PART + ORDER - 1]
            if len(cells.characters) + len(part) > RADIX and len(cells.characters) + len(np.unique(part)) > RADIX:
                yield from cells.batches()
            cells.add((block, lang), part)
            if cells.held > MOST:
                yield from cells.batches()
    yield from cells.batches()


def grams_of(texts: DataFrame) -> DataFrame:
    """(block, lang, gram, n) of ``texts`` (block, lang, text); a gram may come in several rows."""
    return run(texts.select(F.col("block").cast("int").alias("block"), "lang", "text"), _count_grams, "block int, lang string, gram string, n long")


def _packed(block: int, lang: str, grams: list[str]) -> pa.RecordBatch:
    """Many n-grams of a block in one row, compressed."""
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([lang], pa.string()), pa.array([zlib.compress("".join(grams).encode("utf-8"), 1)], pa.binary())], names=["block", "lang", "packed"])


def _unpacked(packed: bytes) -> list[str]:
    chars = zlib.decompress(packed).decode("utf-8")
    return [chars[i : i + ORDER] for i in range(0, len(chars), ORDER)]


PACKED = "block int, lang string, packed binary"


def _pack_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _count_grams, packed and without counts."""
    for part in _count_grams(batches):
        if part.num_rows:
            yield _packed(part.column(0)[0].as_py(), part.column(1)[0].as_py(), part.column(2).to_pylist())


def _union_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different n-grams of each block (block, lang, packed), packed again; a block with very many may repeat some."""

    def out(at: tuple, held: set[str]) -> Iterator[pa.RecordBatch]:
        grams = sorted(held)
        for i in range(0, len(grams), 1 << 16):
            yield _packed(*at, grams[i : i + (1 << 16)])

    at, held = None, set()
    for block, lang, packed in rows_of(batches):
        if (block, lang) != at or len(held) > MOST_STRINGS:
            if held:
                yield from out(at, held)
            at, held = (block, lang), set()
        held.update(_unpacked(packed))
    if held:
        yield from out(at, held)


def _unpack_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, lang, packed in rows_of(batches):
        grams = _unpacked(packed)
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(grams), pa.int32()), pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string())], names=["block", "lang", "gram"])


def shorter(k: int) -> Column:
    """The context without its first character, for contexts of n-grams of ``k``."""
    return F.substring("context", 2, k - 2) if k > 2 else F.lit("")


def gram_levels(counts: DataFrame, chars: int) -> list[DataFrame]:
    """For each order from 1 on, a row per context that was seen: lang, context, back (its weight of the lower order), known (symbol to probability).

    ``counts``: lang, gram, n. All characters count and all counts stay; the tables grow with the text and stay sharded. A context has at most
    as many symbols as its language has characters."""
    raw = {ORDER: counts.select("lang", F.substring("gram", 1, ORDER - 1).alias("context"), F.substring("gram", ORDER, 1).alias("symbol"), "n")}
    for k in range(ORDER - 1, 0, -1):
        raw[k] = checkpoint(few(raw[k + 1].groupBy("lang", shorter(k + 1).alias("context"), "symbol").agg(F.count(F.lit(1)).alias("n")), chars))
    size = by_lang({r["lang"]: r["n"] + 1 for r in raw[1].groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}, "long")  # and one for all that were never seen
    out: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        taken = raw[k].withColumn("d", _discounts(raw[k]))
        rows = few(taken.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"), F.collect_list(F.struct("symbol", "n", "d")).alias("seen")), chars)
        rows = rows.withColumn("back", F.col("mass") / F.col("total"))
        if k == 1:
            below = lambda symbol: 1 / size
        else:
            rows = rows.withColumn("shorter", shorter(k)).join(out[-1].select("lang", F.col("context").alias("shorter"), F.col("known").alias("lower")), ["lang", "shorter"])
            below = lambda symbol: F.element_at("lower", symbol)
        known = F.map_from_entries(F.transform("seen", lambda x: F.struct(x["symbol"], (x["n"] - x["d"]) / F.col("total") + F.col("back") * below(x["symbol"]))))
        out.append(checkpoint(few(rows.select("lang", "context", "back", known.alias("known")), chars)))
    return out


def costs(grams: DataFrame, levels: list[DataFrame], chars: int) -> DataFrame:
    """(lang, gram, cost): negative logarithms of the probabilities of ``grams`` (lang, gram), by joins with the model order by order.

    Each order has a row per context with the symbols that are wanted after it."""
    size = by_lang({r["lang"]: r["n"] for r in levels[0].select("lang", (F.size("known") + 1).alias("n")).collect()}, "long")
    pairs = grams.select("lang", F.substring("gram", 1, ORDER - 1).alias("context"), F.substring("gram", ORDER, 1).alias("symbol"))
    wanted = {}
    for k in range(ORDER, 0, -1):  # dealt by context once, for both steps
        wanted[k] = checkpoint(few(pairs.distinct().repartition("lang", "context").distinct().groupBy("lang", "context").agg(F.collect_list("symbol").alias("symbols")), chars))
        pairs = wanted[k].select("lang", shorter(k).alias("context"), F.explode("symbols").alias("symbol"))
    found = None
    for k, level in enumerate(levels, 1):
        rows = few(wanted[k].join(level, ["lang", "context"], "left"), chars)
        if found is None:
            below = lambda symbol: 1 / size
        else:
            rows = rows.withColumn("shorter", shorter(k)).join(found.select("lang", F.col("context").alias("shorter"), F.col("p").alias("lower")), ["lang", "shorter"])
            below = lambda symbol: F.element_at("lower", symbol)
        p = F.transform("symbols", lambda x: F.struct(x, F.coalesce(F.element_at("known", x), F.coalesce("back", F.lit(1.0)) * below(x))))
        found = checkpoint(few(rows.select("lang", "context", F.map_from_entries(p).alias("p")), chars))
    return found.select("lang", "context", F.explode("p").alias("symbol", "p")).select("lang", F.concat("context", "symbol").alias("gram"), (-F.log("p")).alias("cost"))


def text_key(lang: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(lang, F.lit("")), F.coalesce(text, F.lit("")))))


_TEXTS = pa.schema([("block", pa.int32()), ("size", pa.int64()), ("packed", pa.binary())])
_CODEC = pa.Codec("zstd", compression_level=6)


def _pack_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a block, about a million characters together compressed; equal ones once a task."""
    out, seen, held, total = Out(_TEXTS), set(), {}, 0

    def pack(block: int) -> bool:
        raw = pickle.dumps(held.pop(block)[0], protocol=5)
        packed = _CODEC.compress(raw, asbytes=True)
        return out.add((block, len(raw), packed), len(packed))

    for block, key, text in rows_of(batches):
        if key in seen:
            continue
        seen.add(key)
        have = held.setdefault(block, [[], 0])
        have[0].append((key, text))
        have[1] += len(text)
        total += len(text)
        full = [block] if have[1] >= SLICE else list(held) if total >= 16 * SLICE else []
        for k in full:
            total -= held[k][1]
            if pack(k):
                yield out.batch()
    for k in list(held):
        if pack(k):
            yield out.batch()
    if out.rows:
        yield out.batch()


def _score_block(texts: pa.Table, priced: pa.Table) -> pa.Table:
    """Scores of a block's texts (block, size, packed) by the costs of its n-grams (block, gram, cost)."""
    out, seen = Out(_SCORES), set()
    if priced.num_rows:
        digits = codes("".join(priced.column("gram").to_pylist())).reshape(-1, ORDER)
        characters = np.unique(np.append(digits, np.uint32(PAD)))
        symbols = np.full(0x110000, -1, np.int64)
        symbols[characters] = np.arange(len(characters))
        radix, x = len(characters), symbols[digits]
        heads = np.unique((x[:, 0] * radix + x[:, 1]) * radix + x[:, 2]) if radix > RADIX else None
        n = numbers(x.ravel(), radix, heads)[::ORDER] if heads is None else np.concatenate([numbers(row, radix, heads) for row in x])
        order = np.argsort(n)
        n, cost = n[order], priced.column("cost").to_numpy()[order]
        for size, packed in zip(texts.column("size"), texts.column("packed"), strict=True):
            for key, text in pickle.loads(_CODEC.decompress(packed.as_py(), size.as_py(), asbytes=True)):
                if key in seen:
                    continue
                seen.add(key)
                y, parts = symbols[padded(text)], []
                for j in range(0, len(y) - ORDER + 1, SLICE):
                    wanted = numbers(y[j : j + SLICE + ORDER - 1], radix, heads)
                    place = np.minimum(np.searchsorted(n, wanted), len(n) - 1)
                    if (n[place] != wanted).any():
                        raise RuntimeError("an n-gram of a text has no cost in its block")
                    parts.append(float(cost[place].sum(dtype=np.float64)))
                words = text.split()
                out.add((key, len(text), len(words), math.fsum(parts), len(set(words))))
    scored = pa.Table.from_batches([out.batch()], _SCORES)
    give_back()
    return scored


_SCORES = pa.schema([("key", pa.binary()), ("n_chars", pa.int64()), ("n_words", pa.int64()), ("total", pa.float64()), ("n_different", pa.int64())])


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (doc_id, lang, text) of ``size`` characters with ``block``: of one model, neighbours in doc_id, about ``BLOCK_CHARS`` characters.

    Ids are cut into ranges of about ``RANGE_CHARS``; many rows with one id are dealt to several ranges by their texts, and what a range has of one
    model to several blocks. Small partitions are read together."""
    place = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    n = math.ceil(size / RANGE_CHARS)
    cuts = rows.agg(F.percentile_approx(place, [i / n for i in range(1, n)], 100 * n).alias("c")).first()["c"] if n > 1 else []  # a number a range
    at = F.lit(0)
    if cuts:
        all_cuts = F.array(*[F.lit(c).cast("long") for c in cuts])
        low, high = F.size(F.filter(all_cuts, lambda c: c < place)), F.size(F.filter(all_cuts, lambda c: c <= place))
        at = F.when(high - low > 1, low + F.pmod(F.xxhash64("text"), high - low).cast("int")).otherwise(high)
    ranged = few(rows, size).withColumn("range", at)
    blocks, first = [], 0
    for r in sorted(ranged.groupBy("range", "lang").agg(F.sum(F.length("text")).alias("n")).collect()):  # a row a range and model
        parts = max(1, math.ceil(r["n"] / BLOCK_CHARS))
        blocks.append((r["range"], r["lang"], first, parts))
        first += parts
    found = rows.sparkSession.createDataFrame(blocks, "range int, lang string, first int, parts int")
    return ranged.join(F.broadcast(found), ["range", "lang"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("text", F.lit(6)), F.col("parts"))).cast("int")).drop("range", "first", "parts")


def scores(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(key, n_chars, n_words, total, n_different words): the negative log-likelihoods of the different texts of ``docs`` whose language has a model.

    Trusted texts (lang, text) of either half, dealt by a hash of the text, make a model; a text is scored by that of the other half, so that
    none is scored by counts of itself. Where the other half is empty, its own half's model serves. Models are joined with the n-grams of each
    block of texts; then texts meet their block's costs."""
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    name = lambda h: F.concat("lang", F.lit("#"), h.cast("string"))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''").withColumn("key", text_key(F.col("lang"), F.col("text")))
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    learned = few(trusted, size).select(name(half).alias("lang"), "text", F.lit(0).alias("block"))
    counts = checkpoint(few(grams_of(learned).groupBy("lang", "gram").agg(F.sum("n").alias("n")), size))
    levels = gram_levels(counts, size)
    models = [r["lang"] for r in levels[0].select("lang").collect()]  # two a language
    other, own = (F.when(name(h).isin(models), name(h)) for h in (1 - half, half))
    rows = in_blocks(rows.select("doc_id", "key", F.coalesce(other, own).alias("lang"), "text").where("lang is not null"), size)
    parts = run(rows.select("block", "lang", "text"), _pack_grams, PACKED)
    packed = checkpoint(few(run(parts.repartition("block").sortWithinPartitions("block"), _union_grams, PACKED), size))
    met = run(packed, _unpack_grams, "block int, lang string, gram string").distinct()
    priced = met.join(costs(met.select("lang", "gram"), levels, size), ["lang", "gram"]).select("block", "gram", F.col("cost").cast("float").alias("cost"))
    texts = run(rows.select("block", "key", "text"), _pack_texts, "block int, size long, packed binary")
    found = texts.groupBy("block").cogroup(few(priced, size).groupBy("block")).applyInArrow(_score_block, "key binary, n_chars long, n_words long, total double, n_different long")
    return checkpoint(few(found.dropDuplicates(["key"]), size))


def verdicts(docs: DataFrame, labels: DataFrame, stretch: float = 1.0, **how) -> DataFrame:
    """(key, n_words, log_ppl_char, log_ppl_word, kept) of the different texts whose language has a model."""
    trusted = trusted_texts(docs, labels)
    found = scores(docs, trusted)
    known = trusted.select("lang", text_key(F.col("lang"), F.col("text")).alias("key"))
    lang = checkpoint(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), text_key(F.col("lang"), F.col("text")).alias("key")).dropDuplicates(["key"]))
    rows = found.join(lang, "key").select("key", "lang", "n_words", (F.col("total") / F.col("n_chars")).alias("c"), (F.col("total") / F.greatest("n_words", F.lit(1))).alias("w"), F.log(F.greatest("n_different", F.lit(1)) / F.greatest("n_words", F.lit(1))).alias("r"))
    judged = rows.join(known.select("key"), "key", "left_semi").select("lang", "n_words", "c", F.log("w").alias("w"), "r")
    bands = bands_of(judged, stretch=stretch, **how)
    limits = docs.sparkSession.createDataFrame([(lang_, bucket, *map(float, b[:5])) for (lang_, bucket), b in bands.items()], "lang string, bucket int, c0 double, c1 double, w0 double, w1 double, r0 double")
    own, whole = F.broadcast(limits), F.broadcast(limits.where("bucket = 0").select("lang", *[F.col(x).alias(f"all_{x}") for x in ("c0", "c1", "w0", "w1", "r0")]))
    limit = lambda x: F.coalesce(x, f"all_{x}")
    inside = F.col("c").between(limit("c0"), limit("c1")) & F.log("w").between(limit("w0"), limit("w1")) & (F.col("r") >= limit("r0"))
    out = rows.withColumn("bucket", F.length(F.bin(F.greatest(F.col("n_words"), F.lit(1))))).join(own, ["lang", "bucket"], "left").join(whole, "lang", "left")
    return checkpoint(out.select("key", "n_words", F.col("c").alias("log_ppl_char"), F.col("w").alias("log_ppl_word"), F.coalesce(inside, F.lit(True)).alias("kept")))


def kept(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    bad = checkpoint(verdicts(docs, labels, **how).where("not kept").select("key"))
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad  # 16 bytes a text
    return docs.where("text <> ''").join(bad, text_key(docs["lang"], docs["text"]) == bad["key"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_chars, n_words, log_ppl_char, log_ppl_word (null without a model or a character), kept."""
    docs = table(spark, sf_dir, "documents")
    found = verdicts(docs, table(spark, sf_dir, "labels")).withColumnRenamed("n_words", "words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), text_key(F.col("lang"), F.col("text")).alias("key"))
    return rows.join(found, "key", "left").select("doc_id", "lang", "n_chars", F.col("words").alias("n_words"), "log_ppl_char", "log_ppl_word", F.coalesce("kept", F.col("n_chars") > 0).alias("kept"))
