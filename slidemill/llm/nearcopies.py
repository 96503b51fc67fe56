"""Near copies: min-hash bands make shards, BK-trees over 256-bit SimHash fingerprints search them, exact sets of shingles verify.

Two texts whose sets of five-word shingles have the Jaccard similarity s share a band of R min-hash values with the chance
s^R. Texts that share one of the BANDS meet in its shard; so do nearly all pairs at 0.8, and next to none that have nothing in
common, however many texts there are: a text has as many keys in a large corpus as in a small one. A shard is a BK-tree of
fingerprints, searched as in slidemill.llm.neardup within the radius that the threshold's pairs are in, and gives a
spanning forest of its links by distance in place of all pairs. Links so close that their texts can't but be alike
stand; of the others each is verified by the texts' shingles before it joins anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemill.llm.common import row_hash, settle, small_enough
from slidemill.llm.components import components
from slidemill.llm.naming import meet
from slidemill.llm.neardup import shingle_hashes, stars

SHINGLE, SIMILARITY, BITS = 5, 0.8, 256
#: Min-hash bands and the values of each: pairs at 0.8 share one with a chance of 0.99, at 0.5 of 0.22, at 0.2 of 0.001.
BANDS, R = 16, 6
#: Standard deviations: of the distance at the threshold that the radius allows, and that a link must be below it to stand unverified.
WIDE, SURE = 2.0, 4.0
#: Fingerprints of one shard's cell; larger shards are dealt into cells of two such parts, every pair of parts once.
CELL = 1024
#: Keys of larger shards up to which they are broadcast (about 40 MB).
HOT = 1_000_000
#: Rows that go, or whose shingles are needed, up to which they are broadcast (about 40 MB) and no text is shuffled.
LOSERS = 1_000_000
#: Pairs that are searched at once.
AT_ONCE = 2_000_000
#: Steps and factors of the splitmix64 generator.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_factors = np.random.default_rng(16).integers(1, 1 << 63, BANDS * R).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def share(similarity: float) -> float:
    """Share of bits in which two sets of the Jaccard similarity differ on average; as vectors of 0 and 1 their cosine is 2s / (1 + s) if of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float = SIMILARITY, deviations: float = WIDE) -> int:
    """Bits in which pairs of the similarity differ on average and so many standard deviations more."""
    p = share(similarity)
    return int(BITS * p + deviations * math.sqrt(BITS * p * (1 - p)))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """(n, 4) hashes made of each of n."""
    z = hashes[:, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    return z ^ (z >> np.uint64(31))


def _voted(hashes: np.ndarray) -> bytes:
    """32 bytes: a bit is set if it is set in over half of the hashes; zero where there are none."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 16384):
        votes += np.unpackbits(mixed(hashes[at : at + 16384]).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def long_simhash(text: str | None, shingle: int = SHINGLE) -> bytes:
    """The fingerprint of the distinct shingles of a text."""
    return _voted(np.unique(shingle_hashes(text, shingle)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set of hashes: its number and R minima under as many permutations, hashed; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * R, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 8192):
        z = hashes[at : at + 8192, None] * _factors
        least = np.minimum(least, (z ^ (z >> np.uint64(32))).min(axis=0))
    keys = np.zeros(BANDS, np.uint64)
    for part in least.reshape(BANDS, R).T:
        keys = (keys ^ part) * np.uint64(FIRST)
        keys ^= keys >> np.uint64(29)
    return (keys * np.uint64(SECOND) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(text: str | None, shingle: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """Fingerprint and band keys of one text."""
    hashes = np.unique(shingle_hashes(text, shingle))
    return _voted(hashes), bands(hashes)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """A struct of fp and keys."""

    @F.pandas_udf("fp binary, keys array<long>")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(t, shingle) for t in texts], columns=["fp", "keys"])

    return hashed(text)


def shingle_sets(text: Column, shingle: int = SHINGLE) -> Column:
    """The distinct shingles' hashes in order, as bytes."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts], dtype=object)

    return packed(text)


class Forest:
    """BK-trees over 256-bit values, one for each root: children are keyed by their Hamming distance to their parent. root: each value's tree by the position of its first value, -1 for a value in none."""

    def __init__(self, values: list[bytes], root: np.ndarray):
        self.values = np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1)
        numbers = [int.from_bytes(v, "little") for v in values]
        kids: dict[int, int] = {}
        for i, (x, at) in enumerate(zip(numbers, root.tolist(), strict=True)):
            if at in (i, -1):
                continue
            while (nxt := kids.get(place := at << 10 | (x ^ numbers[at]).bit_count())) is not None:
                at = nxt
            kids[place] = i
        places, child = np.fromiter(kids.keys(), np.int64, len(kids)), np.fromiter(kids.values(), np.int64, len(kids))
        order = np.argsort(places)
        self.child, self.edge = child[order], places[order] & 1023
        self.first = np.searchsorted(places[order] >> 10, np.arange(len(values) + 1))

    def within(self, queries: np.ndarray, start: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of queries and of values of the trees that they start at which differ in at most so many bits; only edges within the radius are followed."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries), 4096):
            q, node = queries[at : at + 4096], start[at : at + 4096]
            while len(q):
                d = np.bitwise_count(self.values[q] ^ self.values[node]).sum(axis=1, dtype=np.int64)
                near = (d <= most) & (q != node)
                found.append((q[near], node[near]))
                n = self.first[node + 1] - self.first[node]
                edge = np.repeat(self.first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
                q, d = np.repeat(q, n), np.repeat(d, n)
                follow = np.abs(self.edge[edge] - d) <= most
                q, node = q[follow], self.child[edge[follow]]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def spanning(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions of the links (a, b) of n values that make a spanning forest of least distances: no link between two values is shorter than the longest on the forest's way between them."""
    place, label, chosen = np.arange(len(a)), np.arange(n), []
    weight = np.empty(len(a), np.int64)
    weight[np.lexsort((b, a, d))] = np.arange(len(a))  # no two alike
    of = np.argsort(weight)
    while True:
        live = label[a[place]] != label[b[place]]
        place = place[live]
        if not len(place):
            return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        best = np.full(n, len(a), np.int64)
        np.minimum.at(best, label[a[place]], weight[place])
        np.minimum.at(best, label[b[place]], weight[place])
        picked = of[np.unique(best[best < len(a)])]
        chosen.append(picked)
        u, v = stars(np.arange(n), label[a[picked]], label[b[picked]])
        to = np.arange(n)
        to[u] = v
        label = to[label]


def search(tree: pa.ListArray, asked: pa.ListArray, most: int) -> pa.RecordBatch:
    """u, v, d: a spanning forest of the links within each cell, whose tree's values are compared with those asked, or with each other where none are."""
    values = [*tree.flatten().to_pylist(), *asked.flatten().to_pylist()]
    sizes, others = (np.asarray(c.value_lengths(), np.int64) for c in (tree, asked))
    roots = np.cumsum(sizes) - sizes
    own, n = np.repeat(roots, sizes), int(sizes.sum())
    alone = np.flatnonzero(np.repeat(others == 0, sizes))
    queries, start = np.concatenate([alone, np.arange(n, len(values))]), np.concatenate([own[alone], np.repeat(roots, others)])
    a, b = Forest(values, np.concatenate([own, np.full(len(values) - n, -1)])).within(queries, start, most)
    bits = np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1)
    d = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
    keep = spanning(len(values), a, b, d)
    ends = [sorted((values[i], values[j])) for i, j in zip(a[keep].tolist(), b[keep].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in ends], pa.binary()), pa.array([x[1] for x in ends], pa.binary()), pa.array(d[keep], pa.int64())], names=["u", "v", "d"])


def link(keyed: DataFrame, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """u, v, d: links between distinct fingerprints of keyed(fp, key), rows distinct, that differ in d bits, at most the radius: a spanning forest of each cell of a shard in place of all pairs."""
    most = radius(similarity)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    hot = settle(sizes.filter(F.col("n") > cell), "shards")
    hot = F.broadcast(hot) if small_enough(hot, HOT) else hot
    dealt = keyed.join(hot, "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / cell), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp", "key"), "parts").cast("int")).select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = (
        dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).groupBy("key", "i", "j")
        .agg(F.collect_list(F.when(F.col("own") == F.col("i"), F.col("fp"))).alias("tree"), F.collect_list(F.when(F.col("own") > F.col("i"), F.col("fp"))).alias("asked"))
        .filter("size(tree) > 0 and (size(asked) > 0 or i = j and size(tree) > 1)")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, others = (np.asarray(batch.column(c).value_lengths(), np.int64) for c in ("tree", "asked"))
            turn = np.cumsum(sizes * np.where(others > 0, others, sizes)) // AT_ONCE
            ends = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
            for low, high in zip(ends, ends[1:], strict=False):
                part = batch.slice(low, high - low)
                yield search(part.column("tree"), part.column("asked"), most)

    return cells.select("tree", "asked").mapInArrow(run, "u binary, v binary, d long").distinct()


def alike(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs(u, v) whose sets(fp, shingles) have the similarity or more."""

    @F.pandas_udf("boolean")
    def near(us: pd.Series, vs: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(us, vs, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= (similarity - 1e-9) * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    one = lambda c: sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"{c}s"))
    return pairs.join(one("u"), "u").join(one("v"), "v").filter(near("us", "vs")).select("u", "v")


def classes(keyed: DataFrame, sets_of, similarity: float = SIMILARITY) -> DataFrame:
    """fp, root for every fingerprint of keyed(fp, key) that has a verified link; root is the least fingerprint of its component.

    sets_of: a function from fingerprints (fp) to their texts' shingles (fp, shingles). Links of no more bits than a pair below
    the threshold can be expected to have (SURE) stand. Of the others, only those between different components of what
    stands are looked at: first each component's closest ones, then those that are still between two.
    """
    links = settle(link(keyed, similarity), "links")
    sure = radius(similarity, -SURE)
    stands = settle(links.filter(F.col("d") <= sure).select("u", "v"), "stands")
    left = links.filter(F.col("d") > sure)
    if not small_enough(left, 0):
        ends = left.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
        sets = settle(sets_of(ends), "sets")
        for last in (False, True):
            roots = settle(components(stands).select(F.col("node").alias("fp"), "root"), "roots")
            root = lambda c, roots=roots: roots.select(F.col("fp").alias(c), F.col("root").alias(f"{c}r"))
            met = left.join(root("u"), "u", "left").join(root("v"), "v", "left").withColumns({"ur": F.coalesce("ur", "u"), "vr": F.coalesce("vr", "v")}).filter("ur <> vr")
            met = settle(met, "between")
            if small_enough(met, 0):
                break
            tried = met.select("u", "v")
            if not last:
                best = met.select(F.explode(F.array("ur", "vr")).alias("r"), F.struct("d", "u", "v").alias("e")).groupBy("r").agg(F.min("e").alias("e"))
                tried = settle(best.select("e.u", "e.v").distinct(), "tried")
                left = met.join(tried, ["u", "v"], "left_anti").select("u", "v", "d")
            # what stands is as connected by its nodes' roots, and less is left to do from there
            reached = roots.filter("fp <> root").select(F.col("fp").alias("u"), F.col("root").alias("v"))
            stands = settle(reached.unionByName(alike(tried, sets, similarity)), "stands")
    return components(stands).select(F.col("node").alias("fp"), "root")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, less all but one of each component: that with the smallest doc_id, null last; ties by a hash of the row, equal rows leave one.

    Texts of a similarity of 0.8 or more are linked, and what chains of links join is one component; of texts with one
    fingerprint the first stands for all. Texts without words, null ones too, are one component; an empty table gives an
    empty result; extra columns may have any name and type.
    """
    names = docs.columns
    bare = docs.toDF(*[f"c{i}" for i in range(len(names))])
    cols, text = bare.columns, F.col(f"c{names.index('text')}")
    bare = bare.withColumns({"key": F.col(f"c{names.index('doc_id')}").cast("long"), "row": row_hash(bare)})
    hashed = settle(bare.select("key", "row", fingerprint(text, shingle).alias("s")).select("key", "row", "s.fp", "s.keys"), "fingerprints")
    first = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    rows = settle(hashed.groupBy("fp", "key", "row").agg(F.count("*").alias("n")).withColumn("first", first), "distinct-rows")
    n_rows = rows.count()

    def sets_of(fps: DataFrame) -> DataFrame:
        """One text of each fingerprint, by its row's hash, which equal rows share."""
        chosen = settle(hashed.join(fps, "fp").groupBy("fp").agg(F.min("row").alias("row")), "chosen")
        near = F.broadcast if small_enough(chosen, LOSERS) else lambda df: df
        return bare.join(near(chosen), "row").select("fp", shingle_sets(text, shingle).alias("shingles")).dropDuplicates(["fp"])

    keyed = settle(hashed.select("fp", F.explode("keys").alias("key")).distinct(), "keyed")
    roots = settle(classes(keyed, sets_of, similarity), "classes")
    # rows of a fingerprint or group that many rows have stay where they are, in both joins
    sized = settle(rows.groupBy("fp").agg(F.count("*").alias("n")).join(roots, "fp"), "sized")
    rows = settle(meet(rows, sized, ["fp"], "root", n_rows, "left").withColumn("root", F.coalesce("root", "fp")).drop("fp"), "rows")
    best = settle(rows.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("size"), F.count("*").alias("n")).filter("size > 1"), "best")
    # rows that go: all of a group but its first, and of that all but one of its equals
    grouped = meet(rows, best, ["root"], "best", n_rows).withColumn("last", ~F.col("first").eqNullSafe(F.col("best"))).filter("last or n > 1").select("key", "row", "last")
    gone = settle(grouped.select("row", F.coalesce("key", F.lit(0)).alias("key"), F.col("key").isNull().alias("none"), "last").distinct(), "gone")
    bare = bare.withColumns({"none": F.col("key").isNull(), "key": F.coalesce("key", F.lit(0))})
    small = F.broadcast if small_enough(gone, LOSERS) else lambda df: df
    kept = bare.join(small(gone), ["key", "none", "row"], "left")
    once = kept.filter("last is null").select(cols)
    return once.unionByName(kept.filter("not last").dropDuplicates(["key", "none", "row"]).select(cols)).toDF(*names)
