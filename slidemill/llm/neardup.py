"""Near-duplicate documents: SimHash of word shingles, BK-trees over shards of fingerprints, components.

Of b blocks of bits, two fingerprints within radius r agree on at least b - r, so each choice of b - r blocks makes
a shard of the fingerprints that share its bits. The more fingerprints, the more blocks: keys are 21 bits of two of six
blocks, 27 of three of seven, or 32 of four of eight at radius 4, so shards stay small. A shard's fingerprints form a BK-tree whose children are
keyed by their integer Hamming distance to the parent, and a search follows only edges within the radius.
Shards are dealt by shuffle, not broadcast: together they hold every fingerprint of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemill.llm.common import pick, settle, small_enough
from slidemill.llm.components import components, stars

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints up to which the radius and two, three or four blocks more are used, so that a shard has some at most if bits are even.
SIZES = ((20_000_000, 2), (1_000_000_000, 3))
#: Fingerprints of one shard's cell; larger shards are dealt into cells of two such parts, every pair of parts once.
CELL = 1024
#: Keys of larger shards up to which they are broadcast (about 40 MB).
HOT = 1_000_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned XXH64 of every shingle, repeats included; of the whole sequence where words are fewer, none where there are none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the XXH64 of the shingles, repeats included."""
    hashes = shingle_hashes(text, shingle)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return hashed(text)


class BKTree:
    """Distinct 64-bit values; children keyed by Hamming distance to their parent, held as arrays for searches of many values at once."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint64)
        kids: list[dict[int, int]] = [{} for _ in values]
        raw = self.values.tolist()
        for i in range(1, len(raw)):
            at, x = 0, raw[i]
            while (nxt := kids[at].get(d := (x ^ raw[at]).bit_count())) is not None:
                at = nxt
            kids[at][d] = i
        self.first = np.concatenate([[0], np.cumsum([len(k) for k in kids])]).astype(np.int64)
        self.child = np.array([c for k in kids for c in k.values()], np.int64)
        self.edge = np.array([d for k in kids for d in k], np.int64)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of queries and of values that are within the radius of each other."""
        queries = queries.astype(np.uint64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries), 512):
            q = np.arange(at, min(at + 512, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                found.append((q[near], node[near]))
                n = self.first[node + 1] - self.first[node]
                edge = np.repeat(self.first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
                q, d = np.repeat(q, n), np.repeat(d, n)
                follow = np.abs(self.edge[edge] - d) <= radius
                q, node = q[follow], self.child[edge[follow]]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def shard_keys(fp: Column, radius: int, agree: int) -> Column:
    """An array of keys, one for each choice of `agree` of radius + agree blocks."""
    blocks = radius + agree
    ends = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(k).cast("long")
        for i in chosen:
            width = ends[i + 1] - ends[i]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, ends[i]).bitwiseAND((1 << width) - 1))
        keys.append(key)
    return F.array(*keys)


def link(fps: DataFrame, radius: int = RADIUS, sizes: tuple[tuple[int, int], ...] = SIZES) -> DataFrame:
    """u, v: links between distinct fingerprints fps(fp) that join just those that chains of at most `radius` differing bits join.

    Within a cell of a shard, links are given as stars, one for each fingerprint at most, in place of all pairs.
    """
    if not 0 <= radius <= 8:
        raise ValueError("radius must be from 0 to 8")
    n = fps.count()
    keyed = fps.select("fp", F.explode(shard_keys(F.col("fp"), radius, next((k for most, k in sizes if n <= most), 4))).alias("key"))
    # only shards of more than one cell are known by name, and meet their rows where these are: a hot one is never one task's
    large = settle(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CELL), "shards")
    large = F.broadcast(large) if small_enough(large, HOT) else large
    held = keyed.join(large, "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / CELL), F.lit(1)).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp", "key"), "parts").cast("int"))
    dealt = held.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = (
        dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).groupBy("key", "i", "j")
        .agg(F.collect_list(F.when(F.col("own") == F.col("i"), F.col("fp"))).alias("tree"), F.collect_list(F.when(F.col("own") == F.col("j"), F.col("fp"))).alias("asked"))
        .filter("size(tree) > 0 and size(asked) > 0 and (i < j or size(tree) > 1)")
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in batches:
            us, vs = [], []
            for tree, asked in zip(cells["tree"], cells["asked"], strict=True):
                if len(tree) and len(asked):
                    tree, asked = np.sort(np.asarray(tree, np.int64)), np.sort(np.asarray(asked, np.int64))
                    values = np.union1d(tree, asked)
                    a, b = BKTree(tree).within(asked, radius)
                    u, v = stars(values, np.searchsorted(values, asked)[a], np.searchsorted(values, tree)[b])
                    us.append(u)
                    vs.append(v)
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return cells.select("tree", "asked").mapInPandas(search, "u long, v long").distinct()


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root for every distinct fingerprint that has a link; root is the least fingerprint of its component."""
    return components(link(fps, radius)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of those that links reach) of every row of docs(doc_id, text).

    Null, empty and white-space texts have fingerprint zero and are linked like any other. Repeated rows
    give repeated rows. Null ids are kept and count for no minimum; a component with null ids only has a null
    component_id. An empty table gives an empty result; other columns are ignored whatever their names.
    """
    hashed = settle(pick(docs, doc_id="long", text="string").select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "fingerprints")
    fps = settle(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = fps.join(settle(classes(fps.select("fp"), radius), "classes"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(ids, "root").select("fp", "component_id")
    out = hashed.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
