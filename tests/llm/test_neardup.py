import random

import pytest
import xxhash
from pyspark.sql import functions as F

from slidemill.llm import neardup


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids, radius=4):
    at = list(range(len(fps)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                at[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [best.get(find(i)) for i in range(len(fps))]


def texts():
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß"]
    out = []
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.randint(40, 300))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append(" ".join(copy))
    return out + ["", None, " \n ", "a b", "A  b", "one", "x y z w", "word " * 5000]


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, "quite alone here and nowhere else")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("Text"), F.lit(1).alias("fp"))
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str)
    fps = [brute_fp(t) for _, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components(fps, [i for i, _ in rows]), strict=True)), key=str)
    assert got == want


def test_large_shard_in_cells(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 8)
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = {base}
    for _ in range(120):
        x = base
        for _ in range(r.randint(1, 9)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    out = {a: b for a, b in neardup.classes(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    comp = brute_components(fps, signed)
    assert [out.get(s, s) for s in signed] == comp


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(df).count() == 0
    with pytest.raises(ValueError):
        neardup.link(df.select(F.col("doc_id").alias("fp")), 9)


def test_blocks_by_size(spark):
    """More blocks for more fingerprints find the same links."""
    r = random.Random(4)
    fps = {r.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for k in (1, 3, 4, 5):
            x = f
            for b in r.sample(range(64), k):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = brute_components(fps, signed)
    for sizes in (((10**9, 2),), ((1, 2), (10**9, 3)), ((1, 2), (2, 3))):
        out = {a: b for a, b in neardup.components(neardup.link(df, sizes=sizes)).collect()}
        assert [out.get(s, s) for s in signed] == want


def test_hot_nodes(spark, monkeypatch):
    """A node with very many neighbours, joined by broadcast and not."""
    from slidemill.llm import components

    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1040)] + [(299, 5000)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = {**dict.fromkeys([*range(300), 5000], 0), **dict.fromkeys(range(1000, 1041), 1000)}
    for hot in (5, 10_000):
        monkeypatch.setattr(components, "HOT", hot)
        assert dict(map(tuple, components.components(df).collect())) == want
