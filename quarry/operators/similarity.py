"""Near-duplicate functions: shingles, MinHash bands, bounds, tree distance, blended scores, complete-link clusters.

functions: idx, and tree: struct<labels: array<string>, sizes: array<int>>, a preorder (sizes: of subtrees), and a nullable signature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.metrics import count_similarity, jaccard
from quarry.operators.graph import checkpoint, components


@dataclass(frozen=True)
class Options:
    """Costs of edits and parameters of candidates; the defaults are the similarity analysis's."""

    rename: float = 0.3
    delete: float = 1.0
    insert: float = 1.0
    size_penalty: bool = True
    threshold: float = 0.85
    body_weight: float = 0.8
    hashes: int = 128
    bands: int = 24
    all_pairs_below: int = 200
    max_pairs: int = 13_000_000

    @property
    def body_threshold(self) -> float:
        """A pair whose body scores less cannot reach the threshold, whatever its signatures do."""
        return min(1.0, max(0.0, (self.threshold - (1 - self.body_weight)) / self.body_weight))


# shingles and MinHash

#: A prime; hashes are (a * x + b) modulo it for x below 2^32, so no product leaves 63 bits.
PRIME = 2147483647


def shingles(labels: Column, width: int = 3) -> Column:
    """The different runs of ``width`` labels; of fewer labels, one run of all."""
    joined = lambda a: F.array_join(a, "\x1f")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - (width - 1), F.lit(1))), lambda i: joined(F.slice(labels, i, width)))
    return F.when(F.size(labels) == 0, F.array().cast("array<string>")).when(F.size(labels) < width, F.array(joined(labels))).otherwise(F.array_distinct(many))


def shingle_hash(shingle: Column) -> Column:
    """The first 32 bits of the MD5 digest: the same number in every engine."""
    return F.conv(F.substring(F.md5(shingle), 1, 8), 16, 10).cast("long")


def coefficients(n: int) -> list[tuple[int, int]]:
    """Multipliers and summands below 2^30 from a linear congruence."""
    state, out = 88172645463325252, []
    for _ in range(n):
        pair = []
        for _ in range(2):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            pair.append(state >> 34)
        out.append((pair[0] | 1, pair[1]))
    return out


def minhash(x: Column, n: int) -> Column:
    """n minima of hashes of the numbers in ``x``; of none, the prime. One expression over an array of coefficients, so plans stay small."""
    known = F.expr("array(" + ", ".join(f"named_struct('a', {a}L, 'b', {b}L)" for a, b in coefficients(n)) + ")")
    return F.transform(known, lambda c: F.coalesce(F.array_min(F.transform(x, lambda v: (v * c["a"] + c["b"]) % PRIME)), F.lit(PRIME).cast("long")))


#: With more minima than this, code for an aggregate is not generated whole and takes seconds to compile.
AGGREGATED = 64


def signed(functions: DataFrame, labels: Column, n: int) -> DataFrame:
    """(idx, signature), a row for each function: ``minhash`` of its shingles' hashes.

    Each hash is made once, behind a generator: projections are merged, and inside the minima it would be made once per minimum. Up to
    ``AGGREGATED`` minima are aggregates over a row for each shingle, more are taken from an array."""
    joined = lambda i: F.concat_ws("\x1f", *[F.get("labels", i + k) for k in range(3)])  # noqa: E731; beyond the end there is nothing to join
    starts = F.when(F.size("labels") > 0, F.sequence(F.lit(0), F.greatest(F.size("labels") - 3, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    rows = functions.select("idx", labels.alias("labels"))
    if n > AGGREGATED:
        hashed = rows.select("idx", F.explode(F.array(F.transform(starts, lambda i: shingle_hash(joined(i))))).alias("x"))
        return hashed.select("idx", minhash(F.col("x"), n).alias("signature"))
    rows = rows.select("*", F.monotonically_increasing_id().alias("__row")).select("*", F.explode_outer(starts).alias("at"))
    hashed = rows.select("idx", "__row", F.when(F.col("at").isNotNull(), shingle_hash(joined(F.col("at")))).alias("x"))
    least = hashed.groupBy("idx", "__row").agg(*[F.min((F.col("x") * a + b) % PRIME).alias(f"h{k}") for k, (a, b) in enumerate(coefficients(n))])
    return least.select("idx", F.array(*[F.coalesce(f"h{k}", F.lit(PRIME).cast("long")) for k in range(n)]).alias("signature"))


def bands(signatures: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """(idx, band, part): each signature's bands; a band's own numbers are its key."""
    parts = F.array(*[F.slice("signature", i * rows + 1, rows) for i in range(n_bands)])
    return signatures.select("idx", F.posexplode(parts).alias("band", "part"))


def band_pairs(banded: DataFrame) -> DataFrame:
    """(i, j), i < j: functions that agree in a band. Bands with the same members are expanded once."""
    members = banded.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("idx").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "idx")).alias("x")).where("n > 1")
    once = members.groupBy("n", "s", "x").agg(F.min(F.struct("band", "part")).alias("b")).select("b.band", "b.part")
    rows = banded.join(once, ["band", "part"])
    other = rows.withColumnRenamed("idx", "j")
    return rows.withColumnRenamed("idx", "i").join(other, ["band", "part"]).where("i < j").select("i", "j").distinct()


def candidate_pairs(functions: DataFrame, opts: Options) -> DataFrame:
    """(i, j), i < j: all pairs of few functions, and the pairs of agreeing bands of many. More than ``max_pairs`` is an error.

    Functions with the same labels agree in all bands, so bands are joined for different label sequences only; pairs are counted from the sizes
    of these classes before any is made, and each is made once."""
    n = functions.count()
    if n < opts.all_pairs_below:
        if n * (n - 1) // 2 > opts.max_pairs:
            raise ValueError(f"{n} functions make more than {opts.max_pairs} pairs")
        ids = functions.select(F.col("idx").alias("i"))
        return ids.join(ids.withColumnRenamed("i", "j"), F.col("i") < F.col("j"))
    rows = opts.hashes // opts.bands
    members = functions.select("idx", F.md5(F.array_join("tree.labels", "\x1f")).alias("class"), F.col("tree.labels").alias("labels"))
    classes = members.groupBy("class").agg(F.first("labels").alias("labels"), F.count(F.lit(1)).alias("n"))  # labels are the same in a class
    classes = classes.repartition(int(functions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "class")  # few large trees are little data and much work
    banded = checkpoint(bands(signed(classes.withColumnRenamed("class", "idx"), F.col("labels"), rows * opts.bands), opts.bands, rows))
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    near = band_pairs(banded).unionByName(sizes.where("n > 1").select(F.col("class").alias("i"), F.col("class").alias("j")))
    near = near.join(sizes.select(F.col("class").alias("i"), F.col("n").alias("ni")), "i").join(sizes.select(F.col("class").alias("j"), F.col("n").alias("nj")), "j")
    near = checkpoint(near.select(F.col("i").alias("ci"), F.col("j").alias("cj"), F.when(F.col("i") == F.col("j"), F.expr("ni * (ni - 1) div 2")).otherwise(F.col("ni") * F.col("nj")).alias("pairs")))
    if (count := near.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]) > opts.max_pairs:
        raise ValueError(f"{n} functions make {count} candidate pairs, more than {opts.max_pairs}")
    side = lambda i, c: members.select(F.col("idx").alias(i), F.col("class").alias(c))
    made = near.select("ci", "cj").join(side("a", "ci"), "ci").join(side("b", "cj"), "cj").where("ci <> cj or a < b")
    return made.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))


# bounds that no distance can beat


def _upper(a: Column, b: Column, distance: Column, size_penalty: bool) -> Column:
    most = F.greatest(a, b)
    base = 1.0 - distance / most
    return F.when(most == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * F.sqrt(F.least(a, b) / most) if size_penalty else base)))


def multiset_distance(a: Column, b: Column) -> Column:
    """The L1 distance of two arrays as multisets."""
    both = F.array_distinct(F.concat(a, b))
    times = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    return F.aggregate(both, F.lit(0), lambda total, v: total + F.abs(times(a, v) - times(b, v)))


def child_sizes(sizes: Column) -> Column:
    """Subtree sizes of the root's children."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
    found = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1))), start,
        lambda s, i: F.when((s["at"] == i - 1) & (i <= F.size(sizes)), F.struct((s["at"] + F.get(sizes, i - 1)).alias("at"), F.concat(s["out"], F.array(F.get(sizes, i - 1))).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )
    return found


def bounds(opts: Options, full: bool = True) -> list[tuple[str, Column]]:
    """(name, whether trees a and b may reach the body threshold), in the order of their costs: by size, and if ``full`` by labels, root arity and shingles."""
    size_a, size_b = F.size("a.labels"), F.size("b.labels")
    may = lambda distance: _upper(size_a, size_b, distance, opts.size_penalty) >= opts.body_threshold
    if not full:
        return [("size", may(F.lit(0.0)))]
    label = multiset_distance(F.col("a.labels"), F.col("b.labels")) * min(opts.delete, opts.insert, opts.rename / 2)
    children_a, children_b = F.sort_array(child_sizes(F.col("a.sizes"))), F.sort_array(child_sizes(F.col("b.sizes")))
    extra = F.size(children_a) - F.size(children_b)
    smallest = lambda c, n: F.aggregate(F.slice(c, 1, F.greatest(n, F.lit(0))), F.lit(0), lambda s, v: s + v)
    arity = F.when(extra > 0, smallest(children_a, extra) * opts.delete).otherwise(smallest(children_b, -extra) * opts.insert)
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 2, F.lit(1))), lambda i: F.array_join(F.slice(c, i, 3), "\x1f"))
    shingle = multiset_distance(runs(F.col("a.labels")), runs(F.col("b.labels"))) * min(opts.rename, opts.insert, opts.delete) / 6
    return [("size", may(F.lit(0.0))), ("label", may(label)), ("arity", may(arity)), ("shingle", may(shingle))]


def with_bounds(pairs: DataFrame, opts: Options, full: bool = True) -> DataFrame:
    """``pairs`` (with trees a and b) that no bound rules out."""
    for _, may in bounds(opts, full):
        pairs = pairs.where(may)
    return pairs


# tree distance


def _children(sizes: list) -> list[np.ndarray]:
    out, none = [], np.array([], dtype=np.int64)
    for i, size in enumerate(sizes):
        if size == 1:
            out.append(none)
            continue
        own, at = [], i + 1
        while at < i + size:
            own.append(at)
            at += sizes[at]
        out.append(np.array(own, dtype=np.int64))
    return out


def tree_distance(labels_a: list, sizes_a: list, labels_b: list, sizes_b: list, rename: float = 1.0, delete: float = 1.0, insert: float = 1.0) -> float:
    """Ordered top-down distance: roots are matched, and children aligned by deleting or inserting whole subtrees or by matching them.

    Matches are worked out on demand. In an alignment of many children, sizes and labels give a least cost of each match; the path that is best
    by these gives an upper bound, and only matches that lie on some path below it are worked out. Matches whose children are leaves on both
    sides are worked out together."""
    n, m = len(labels_a), len(labels_b)
    if not n or not m:
        return n * delete + m * insert
    number: dict[object, int] = {}
    la, lb = (np.array([number.setdefault(x, len(number)) for x in labels]) for labels in (labels_a, labels_b))
    sa, sb = np.asarray(sizes_a, dtype=np.int64), np.asarray(sizes_b, dtype=np.int64)
    ca, cb = _children(sa.tolist()), _children(sb.tolist())
    known: dict[tuple[int, int], float] = {}

    def match(pairs: list[tuple[int, int]]) -> list[float]:
        flat = []
        for p in pairs:
            if p in known:
                continue
            i, j = p
            known[p] = 0.0 if la[i] == lb[j] else rename
            if sa[i] == 1 or sb[j] == 1:
                known[p] += (sa[i] - 1) * delete + (sb[j] - 1) * insert
            elif len(ca[i]) == sa[i] - 1 and len(cb[j]) == sb[j] - 1:
                flat.append(p)
            else:
                known[p] += align(ca[i], cb[j])
        for p, cost in zip(flat, _align_leaves([(la[ca[i]], lb[cb[j]]) for i, j in flat], rename, delete, insert), strict=True):
            known[p] += cost
        return [known[p] for p in pairs]

    def align(x: np.ndarray, y: np.ndarray) -> float:
        gone, new = sa[x] * delete, sb[y] * insert
        if len(x) * len(y) <= 64:  # a few cells are quicker one by one
            costs = match([(i, j) for i in x.tolist() for j in y.tolist()])
            return _align([(g, costs[k * len(y) : (k + 1) * len(y)]) for k, g in enumerate(gone.tolist())], list(enumerate(new.tolist())))
        more = sa[x][:, None] - sb[y][None, :]
        least = np.where(la[x][:, None] == lb[y][None, :], 0.0, rename) + np.maximum(more, 0) * delete + np.maximum(-more, 0) * insert
        before, after = _paths(gone, new, least), _paths(gone[::-1], new[::-1], least[::-1, ::-1])[::-1, ::-1]
        k, h, way, upper = len(x), len(y), [], 0.0
        while k and h:
            options = (before[k - 1, h - 1] + least[k - 1, h - 1], before[k - 1, h] + gone[k - 1], before[k, h - 1] + new[h - 1])
            step = options.index(min(options))
            if step == 0:
                way.append((int(x[k - 1]), int(y[h - 1])))
            else:
                upper += float(gone[k - 1] if step == 1 else new[h - 1])
            k, h = k - (step != 2), h - (step != 1)
        upper += float(gone[:k].sum() + new[:h].sum()) + sum(match(way))
        at, to = np.nonzero(before[:-1, :-1] + least + after[1:, 1:] < upper)
        costs = np.full(least.shape, np.inf)
        costs[at, to] = match(list(zip(x[at].tolist(), y[to].tolist(), strict=True)))
        return min(upper, float(_paths(gone, new, costs)[-1, -1]))

    return float(match([(0, 0)])[0])


def _paths(gone: np.ndarray, new: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Least costs of aligning the first k with the first h. A row is one pass: deletions and matches at once, then a running minimum for insertions."""
    below = np.concatenate([[0.0], np.cumsum(new)])
    out = np.empty((len(gone) + 1, len(new) + 1))
    out[0] = below
    for k, g in enumerate(gone):
        best = out[k] + g
        np.minimum(best[1:], out[k, :-1] + costs[k], out=best[1:])
        out[k + 1] = below + np.minimum.accumulate(best - below)
    return out


def _align_leaves(pairs: list[tuple[np.ndarray, np.ndarray]], rename: float, delete: float, insert: float, cells: int = 32768) -> list[float]:
    """Costs of aligning leaves with leaves, by their labels: a row of many alignments at a time."""
    out: list[float] = []
    step = max(1, cells // max((len(b) for _, b in pairs), default=1))
    for begin in range(0, len(pairs), step):
        part = pairs[begin : begin + step]
        p, q = (np.array([len(pair[side]) for pair in part]) for side in (0, 1))
        a, b = np.full((len(part), p.max()), -1), np.full((len(part), q.max()), -2)
        for k, (x, y) in enumerate(part):
            a[k, : len(x)], b[k, : len(y)] = x, y
        below = np.arange(q.max() + 1) * float(insert)
        row, found = np.tile(below, (len(part), 1)), np.zeros(len(part))
        for t in range(p.max()):
            best = row + delete
            np.minimum(best[:, 1:], row[:, :-1] + (a[:, t, None] != b) * rename, out=best[:, 1:])
            row = np.minimum.accumulate(best - below, axis=1) + below
            ends = np.flatnonzero(p == t + 1)
            found[ends] = row[ends, q[ends]]
        out += found.tolist()
    return out


def _align(gone: list[tuple[float, np.ndarray]], new: list[tuple[int, float]]) -> float:
    row = [0.0]
    for _, cost in new:
        row.append(row[-1] + cost)
    for gone_cost, match in gone:
        last, out = row[0], [row[0] + gone_cost]
        for k, (y, cost) in enumerate(new, 1):
            out.append(min(row[k] + gone_cost, out[-1] + cost, last + match[y]))
            last = row[k]
        row = out
    return row[-1]


def tsed(labels_a: list, sizes_a: list, labels_b: list, sizes_b: list, opts: Options) -> float:
    """Tree similarity from 0 to 1."""
    n, m = len(labels_a), len(labels_b)
    if not max(n, m):
        return 1.0
    if n == m and list(labels_a) == list(labels_b) and list(sizes_a) == list(sizes_b):
        return 1.0
    base = 1 - tree_distance(labels_a, sizes_a, labels_b, sizes_b, opts.rename, opts.delete, opts.insert) / max(n, m)
    return min(1.0, max(0.0, base * (min(n, m) / max(n, m)) ** 0.5 if opts.size_penalty else base))


#: Trees come to Python in batches of about so many bytes.
BATCH_BYTES = 8 << 20


def body_similarity(opts: Options) -> F.Column:
    """The tree similarity of columns a and b, as an Arrow-batched UDF."""

    def score(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([tsed(*row, opts) for row in zip(a["labels"], a["sizes"], b["labels"], b["sizes"], strict=True)], dtype="float64")

    score.__annotations__ = {"batches": Iterator[tuple[pd.DataFrame, pd.DataFrame]], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(F.col("a"), F.col("b"))


# signatures and scores


def identifier_overlap(a: Column, b: Column) -> Column:
    """Of the words of the functions' names and their parameters' names; null if a signature is missing."""
    words = lambda s: F.array_union(s["name_tokens"], s["parameter_names"])
    return F.when(a.isNotNull() & b.isNotNull(), jaccard(words(a), words(b)))


def type_overlap(a: Column, b: Column) -> Column:
    """Of the types of parameters and results; null if a signature is missing."""
    types = lambda s: F.array_union(s["parameter_type_paths"], s["return_type_paths"])
    return F.when(a.isNotNull() & b.isNotNull(), jaccard(types(a), types(b)))


def signature_similarity(a: Column, b: Column) -> Column:
    """Of two signatures; null if either is missing."""
    same_receiver = F.when(a["receiver"].eqNullSafe(b["receiver"]), 1.0).otherwise(0.0)
    score = (
        0.25 * identifier_overlap(a, b) + 0.10 * count_similarity(a["parameter_count"], b["parameter_count"]) + 0.05 * jaccard(a["parameter_names"], b["parameter_names"])
        + 0.45 * type_overlap(a, b) + 0.10 * jaccard(a["generics"], b["generics"]) + 0.05 * same_receiver
    )
    return F.when(a.isNotNull() & b.isNotNull(), score)


def blended(body: Column, signature: Column, opts: Options) -> Column:
    return opts.body_weight * body + (1 - opts.body_weight) * F.coalesce(signature, F.lit(1.0))


def compared(functions: DataFrame, opts: Options) -> tuple[DataFrame, DataFrame]:
    """Candidates of one test class (i, j, tree keys a and b, signatures sa and sb), and each pair of different trees among them once (ka, kb, a, b)."""
    keyed = functions.withColumn("__tree", F.md5(F.concat_ws("\x1e", F.array_join("tree.labels", "\x1f"), F.array_join(F.transform("tree.sizes", lambda n: n.cast("string")), ","))))
    side = lambda i, t: keyed.select(F.col("idx").alias(i), F.col("__tree").alias(t), F.col("signature").alias(f"s{t}"), F.col("is_test").alias(f"t{t}"))
    both = checkpoint(candidate_pairs(functions, opts).join(side("i", "a"), "i").join(side("j", "b"), "j").where("ta = tb"))
    # equal trees score 1; of the others each pair of different trees is scored once, however many functions have them
    trees = keyed.select("__tree", "tree").dropDuplicates(["__tree"])
    different = both.where("a <> b").select(F.col("a").alias("ka"), F.col("b").alias("kb")).distinct()
    different = different.join(trees.select(F.col("__tree").alias("ka"), F.col("tree").alias("a")), "ka").join(trees.select(F.col("__tree").alias("kb"), F.col("tree").alias("b")), "kb")
    return both, different


def similar_pairs(functions: DataFrame, opts: Options = Options()) -> DataFrame:
    """i, j, similarity, body_similarity, signature_similarity, type_overlap, identifier_overlap of the pairs that reach the threshold. ``functions``: idx, tree, signature, is_test.

    Tests are compared with tests only."""
    few = functions.count() < opts.all_pairs_below
    both, different = compared(functions, opts)
    spark, limit = functions.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(limit, f"{BATCH_BYTES}b")
    # few pairs of large trees are little data and much work: they are dealt out by number, not by size
    bodies = with_bounds(different, opts, full=few).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ka", "kb")
    bodies = bodies.select("ka", "kb", body_similarity(opts).alias("scored"))
    scored = both.join(bodies, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left").withColumn("body_similarity", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("scored")))
    scored = scored.where(F.col("body_similarity") >= opts.body_threshold)
    scored = scored.withColumn("signature_similarity", signature_similarity(F.col("sa"), F.col("sb")))
    scored = scored.withColumn("similarity", blended(F.col("body_similarity"), F.col("signature_similarity"), opts))
    overlaps = [type_overlap(F.col("sa"), F.col("sb")).alias("type_overlap"), identifier_overlap(F.col("sa"), F.col("sb")).alias("identifier_overlap")]
    return scored.where(F.col("similarity") >= opts.threshold).select("i", "j", "similarity", "body_similarity", "signature_similarity", *overlaps)


def statistics(functions: DataFrame, opts: Options = Options()) -> DataFrame:
    """One row: candidate_pairs, exact_pairs (equal trees), those that each bound rules out first (size_, label_, arity_, shingle_pairs) and scored_pairs.

    Bounds are those that ``similar_pairs`` uses at this number of functions; others are 0. Pairs of trees are judged once and counted by their functions."""
    few = functions.count() < opts.all_pairs_below
    both, different = compared(functions, opts)
    fate = F.lit("scored")
    for name, may in reversed(bounds(opts, few)):
        fate = F.when(~may, name).otherwise(fate)
    known = different.select("ka", "kb", fate.alias("fate"))
    weighted = both.groupBy(F.col("a").alias("ka"), F.col("b").alias("kb")).agg(F.count(F.lit(1)).alias("n")).join(known, ["ka", "kb"], "left")
    of = lambda name: F.coalesce(F.sum(F.when(F.coalesce("fate", F.lit("exact")) == name, F.col("n"))), F.lit(0)).alias(f"{name}_pairs")
    return weighted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidate_pairs"), *map(of, ("exact", "size", "label", "arity", "shingle", "scored")))


# clusters


def complete_link(pairs: list[tuple[int, int, float]], threshold: float) -> list[tuple[list[int], float, float]]:
    """Clusters (members, least and greatest pair similarity): the most similar two clusters merge while all their cross pairs reach the
    threshold; a cluster pair is as similar as its least similar cross pair. Ties go to the lower positions."""
    members = sorted({x for i, j, _ in pairs for x in (i, j)})
    place = {x: k for k, x in enumerate(members)}
    given = {(min(place[i], place[j]), max(place[i], place[j])): s for i, j, s in pairs if s >= threshold}
    now, slots = dict(given), {k: [k] for k in range(len(members))}
    near: dict[int, set[int]] = {k: set() for k in slots}
    for a, b in now:
        near[a].add(b)
        near[b].add(a)
    heap = [(-s, p) for p, s in now.items()]
    heapify(heap)
    while heap:
        s, (a, b) = heappop(heap)
        if now.get((a, b)) != -s:  # merged or lowered since
            continue
        slots[a] = sorted(slots[a] + slots.pop(b))
        for other in near.pop(b):
            near[other].discard(b)
            lost = now.pop((min(b, other), max(b, other)))
            if other != a and other in near[a]:
                x = (min(a, other), max(a, other))
                if lost < now[x]:
                    now[x] = lost
                    heappush(heap, (-lost, x))
                near[other].add(b)  # both had it
        for other in list(near[a]):  # pairs that one side lacks go
            if b in near[other]:
                near[other].discard(b)
            else:
                del now[min(a, other), max(a, other)]
                near[a].discard(other)
                near[other].discard(a)
    out = []
    for slot in slots.values():
        if len(slot) > 1:
            inside = [given[p] for k, x in enumerate(slot) for y in slot[k + 1 :] if (p := (x, y)) in given]
            out.append(([members[k] for k in slot], min(inside), max(inside)))
    return sorted(out, key=lambda c: (-c[2], -len(c[0]), c[0]))


def clusters(pairs: DataFrame, threshold: float) -> DataFrame:
    """members, min_similarity, max_similarity. Merging happens inside connected components of pairs, one task each."""
    found = components(pairs.select(F.col("i").cast("long").alias("src"), F.col("j").cast("long").alias("dst")))
    labelled = pairs.join(found.withColumnRenamed("node", "i"), "i").select("component", F.col("i").cast("long"), F.col("j").cast("long"), "similarity")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(complete_link(list(rows[["i", "j", "similarity"]].itertuples(index=False, name=None)), threshold), columns=["members", "min_similarity", "max_similarity"])

    return labelled.groupBy("component").applyInPandas(merge, "members array<long>, min_similarity double, max_similarity double")


def ranked(found: DataFrame) -> DataFrame:
    """The most similar first, then the larger, then by members; with a number."""
    order = Window.orderBy(F.desc("max_similarity"), F.size("members").desc(), "members")
    return found.withColumn("cluster_id", F.row_number().over(order) - 1)
