import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from slidemill.llm import fingerprints as fpr


def h(x, seed=42):
    return xxhash.xxh64_intdigest(x, seed)


def brute(text):
    words = (text or "").lower().split()
    each = [h(w.encode()) for w in words]
    # of several columns, each one's hash is the seed of the next
    terms = each if len(each) < 2 else [h(a.to_bytes(8, "little")) for a in each]
    if len(each) >= 2:
        terms = [h(b.to_bytes(8, "little"), h(a.to_bytes(8, "little"))) for a, b in zip(each, each[1:], strict=False)]
    return f"{sum(1 << b for b in range(64) if 2 * sum(t >> b & 1 for t in terms) > len(terms)):016x}"


def test_edited_documents(spark, monkeypatch):
    r = random.Random(5)
    words = ["alpha", "Beta", "été", "über", "x", "😀", "delta"]
    rows = [(i * 3, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(40)]
    rows += [(9, "same id, other text"), (12, None), (15, " \n"), (None, "no id"), (10_000, "long " * 3000), (21, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("c").alias("TEXT"), F.lit(1).alias("fp"), F.lit(2).alias("range"))
    # the same hash as Spark's, signed
    key = lambda t: h(t.encode()) - (1 << 64) * (h(t.encode()) >> 63)
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, key(x[1])))
    want = expected(order)
    for per_range, ranges, steps in ((7, 2000, 1000), (2000, 2000, 1000), (3, 4, 1000), (1, 3, 4)):
        monkeypatch.setattr(fpr, "RANGES", ranges)
        monkeypatch.setattr(fpr, "STEPS", steps)
        got = fpr.edited_documents(df, per_range=per_range).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def expected(order):
    want = []
    prints = [(i, int(brute(t), 16)) for i, t in order]
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        near = [j for j, f in prints if (f ^ prints[k][1]).bit_count() <= 3] if i is not None and i % 100 == 0 else None
        within = (len(near), min(j for j in near if j is not None)) if near else (None, None)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), brute(t), brute(e), like(brute(t), brute(e)), like(brute(t), brute(nxt)), *within))
    return want


def test_one_id_and_null_fill_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fpr, "RANGES", 5)
    rows = [(100, f"row {i} of one id") for i in range(60)] + [(None, f"none {i}") for i in range(40)] + [(i * 50, f"w {i}") for i in range(20)] + [(10**12, "far")]
    key = lambda t: h(t.encode()) - (1 << 64) * (h(t.encode()) >> 63)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, key(x[1])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, fpr.edited_documents(df, per_range=4).collect()), key=str) == sorted(expected(order), key=str)
    sizes = [r["count"] for r in fpr.ranged(df, 4).groupBy("cut", "step").count().collect()]
    assert max(sizes) <= 20


def test_very_many_terms(spark, monkeypatch):
    monkeypatch.setattr(fpr, "MOST", 50)
    r = random.Random(2)
    rows = [(" ".join(r.choice("abcdefg") for _ in range(n)),) for n in (0, 1, 2, 50, 51, 52, 400)]
    out = fpr.with_fingerprints(spark.createDataFrame(rows, "text string"), f="text").select("text", fpr.hexed(F.col("f"))).collect()
    assert all(brute(t) == f for t, f in out)


def test_one_row_and_none(spark):
    one = fpr.edited_documents(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fpr.edited_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_within_radius(spark):
    r = random.Random(9)
    fps = [r.getrandbits(63) for _ in range(30)]
    for f in list(fps):
        for k in (1, 3, 4):
            x = f
            for b in r.sample(range(63), k):
                x ^= 1 << b
            fps.append(x)
    df = spark.createDataFrame([(f,) for f in fps] + [(None,)], "fp long")
    got = {(a, b): d for a, b, d in fpr.within_radius(df.limit(40), df, radius=3).collect()}
    asked = {f for (f,) in df.limit(40).collect() if f is not None}
    assert got == {(a, b): (a ^ b).bit_count() for a in asked for b in set(fps) if (a ^ b).bit_count() <= 3}


def test_ranges_of_ids_far_apart(spark, monkeypatch):
    monkeypatch.setattr(fpr, "RANGES", 4)
    n = 6000
    for of in ("id", "cast(pow(id, 4) as long)", "cast(pow(2, id / 200.0) * 1000 as long)", "if(id % 3 = 0, 77, id)", "if(id between 1700 and 2100, 5, id)"):
        df = spark.range(n).selectExpr(f"{of} as doc_id", "concat('t', id) as text")
        rows = fpr.ranged(df, 100).select("cut", "step", "doc_id", "hash").collect()
        sizes = {}
        for r in rows:
            sizes[r.cut, r.step] = sizes.get((r.cut, r.step), 0) + 1
        assert len(rows) == n and max(sizes.values()) <= 320, (of, max(sizes.values()))
        ordered = sorted(rows, key=lambda r: (r.doc_id, r.hash))
        assert [(r.cut, r.step) for r in ordered] == sorted((r.cut, r.step) for r in rows), of


def test_blocks_grow_with_the_queries():
    assert [fpr.blocks_for(n, 3) for n in (0, 10**3, 10**7, 10**8, 10**9, 10**10, 10**11)] == [5, 5, 5, 6, 6, 7, 8]


def test_crowded_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(fpr, "QUERIES", 5)
    monkeypatch.setattr(fpr, "CROWD", 3)
    r = random.Random(4)
    fps = [0b1011 << 40 | r.getrandbits(12) for _ in range(200)] + [r.getrandbits(63) for _ in range(50)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    asked = fps[:40] + fps[-5:]
    got = {(a, b): d for a, b, d in fpr.within_radius(spark.createDataFrame([(f,) for f in asked], "fp long"), df).collect()}
    assert got == {(a, b): (a ^ b).bit_count() for a in set(asked) for b in set(fps) if (a ^ b).bit_count() <= 3}
