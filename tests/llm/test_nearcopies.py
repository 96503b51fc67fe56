"""Near copies by long fingerprints, against fingerprints made bit by bit and all pairs compared."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slidemill.llm import naming, nearcopies

MASK = (1 << 64) - 1


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_long(text):
    """The fingerprint as a number, bytes from the lowest."""
    def mix(h, k):
        z = (h + k * nearcopies.STEP) & MASK
        z = ((z ^ z >> 30) * nearcopies.FIRST) & MASK
        z = ((z ^ z >> 27) * nearcopies.SECOND) & MASK
        return z ^ z >> 31

    hs = {xxhash.xxh64_intdigest(s, 42) for s in brute_shingles(text)}
    wide = [b"".join(mix(h, k).to_bytes(8, "little") for k in range(1, 5)) for h in hs]
    out = bytearray(32)
    for i in range(256):
        if 2 * sum(w[i // 8] >> (7 - i % 8) & 1 for w in wide) > len(wide):
            out[i // 8] |= 1 << (7 - i % 8)
    return int.from_bytes(out, "little")


def jaccard(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    return len(a & b) / len(a | b)


def edited(words, n, r):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    r = random.Random(5)
    out = []
    for _ in range(30):
        base = [f"w{r.randrange(400)}" for _ in range(r.randint(60, 400))]
        out.append(" ".join(base))
        out += [edited(base, n, r) for n in r.sample(range(1, 12), 3)]
    return out


def test_fingerprints():
    for text in [*corpus()[:6], "", None, " \n", "one", "A b", "a B c d e f", "word " * 300]:
        assert int.from_bytes(nearcopies.long_simhash(text), "little") == brute_long(text)


def brute_keys(text):
    """Bands by the definition: least products of each factor, mixed."""
    hs = [xxhash.xxh64_intdigest(x, 42) for x in brute_shingles(text)]
    out = []
    for b in range(nearcopies.BANDS if hs else 0):
        key = 0
        for r in range(nearcopies.R):
            z = [h * int(nearcopies._factors[b * nearcopies.R + r]) & MASK for h in hs]
            key = ((key ^ min(x ^ x >> 32 for x in z)) * nearcopies.FIRST) & MASK
            key ^= key >> 29
        key = (key * nearcopies.SECOND + b) & MASK
        out.append(key - (1 << 64) if key >> 63 else key)
    return out


def test_bands():
    for text in [*corpus()[:4], "", None, "one", "a B c d e f g"]:
        fp, keys = nearcopies.sketch(text)
        assert int.from_bytes(fp, "little") == brute_long(text) and keys.tolist() == brute_keys(text)


def test_spanning():
    """Against the plain greedy forest: as many links, of as little distance together, without a circle."""
    r = random.Random(2)
    for n in (1, 2, 30, 200):
        links = sorted({(i, j) for i, j in ((r.randrange(n), r.randrange(n)) for _ in range(3 * n)) if i != j})
        a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
        d = np.array([r.randrange(6) for _ in links], np.int64)
        label, want = list(range(n)), []
        for x, i, j in sorted(zip(d.tolist(), a.tolist(), b.tolist(), strict=True)):
            if label[i] != label[j]:
                want.append(x)
                old, new = label[i], label[j]
                label = [new if y == old else y for y in label]
        got = nearcopies.spanning(n, a, b, d)
        assert sorted(d[got].tolist()) == want


@pytest.mark.parametrize("cell", [1024, 3])
def test_links_are_links(spark, cell):
    """Every link is within the radius, and what shares a band and is within it is joined by links no longer."""
    texts = corpus()
    keyed = sorted({(nearcopies.sketch(t)[0], k) for t in texts for k in brute_keys(t)})
    links = {tuple(r) for r in nearcopies.link(spark.createDataFrame(keyed, "fp binary, key long"), cell=cell).collect()}
    number = lambda f: int.from_bytes(f, "little")
    assert all((number(u) ^ number(v)).bit_count() == d <= nearcopies.radius() and u < v for u, v, d in links)
    fps = sorted({f for f, _ in keyed})
    at = {f: i for i, f in enumerate(fps)}
    shards = {}
    for f, k in keyed:
        shards.setdefault(k, []).append(f)

    def joined(pairs):
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for u, v in pairs:
            root[find(at[u])] = find(at[v])
        groups = {}
        for i in range(len(fps)):
            groups.setdefault(find(i), set()).add(i)
        return sorted(map(sorted, groups.values()))

    for most in (20, nearcopies.radius()):
        want = {(u, v) for own in shards.values() for u in own for v in own if u < v and (number(u) ^ number(v)).bit_count() <= most}
        assert joined((u, v) for u, v, d in links if d <= most) == joined(want)


def test_nothing_goes_that_is_no_near_copy(spark):
    """All pairs by exact similarity: what has no partner of 0.8 stays, of a group one stays, and next to all others go."""
    r = random.Random(21)
    rows = []
    for i in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice((30, 120, 300)))]
        rows.append((10 * i, " ".join(base)))
        rows += [(10 * i + k, edited(base, max(1, round(len(base) * x)), r)) for k, x in enumerate((0.01, 0.02, 0.025, 0.03, 0.035, 0.05), 1)]
    kept = {x.doc_id for x in nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = {(a, b) for i in range(60) for a, x in rows[7 * i : 7 * i + 7] for b, y in rows[7 * i : 7 * i + 7] if a != b and jaccard(x, y) >= 0.8}
    alone = {d for d, _ in rows} - {a for a, _ in near}
    root = {d: d for d, _ in rows}
    for _ in range(8):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    want = {d for d, x in root.items() if d == x}
    assert len(alone) > 40 and alone <= kept and want <= kept
    assert len(kept - want) <= 0.05 * (len(rows) - len(want))


def test_recall_of_near_copies(spark):
    """Single edited copies of a five-word similarity of 0.8 or more go, and what is alike by less than a half stays."""
    r = random.Random(9)
    rows, near, far = [], set(), set()
    for i in range(150):
        base = [f"w{r.randrange(5000)}" for _ in range(300)]
        copy = edited(base, r.choice((1, 2, 4, 6, 60)), r)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, copy)]
        s = jaccard(rows[-1][1], rows[-2][1])
        (near if s >= 0.8 else far if s < 0.5 else set()).add(2 * i + 1)
    kept = {x.doc_id for x in nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 90 and len(near - kept) >= 0.95 * len(near)
    assert far <= kept and set(range(0, 300, 2)) <= kept


def test_empty(spark):
    assert nearcopies.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(spark):
    r = random.Random(1)
    a = " ".join(f"w{r.randrange(200)}" for _ in range(200))
    rows = [(5, a, "x"), (2, a, "y"), (2, a, "y"), (9, "other words entirely in this one", "z"), (None, a, "n"), (None, "lonely text of no id", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, nearcopies.keep_one(df).collect()), key=str)
    assert got == sorted([rows[1], rows[3], rows[5]], key=str)
    assert nearcopies.keep_one(df).columns == ["doc_id", "text", "source"]


def test_keep_one_with_maps_and_large(spark, monkeypatch):
    """A map column; rows that go joined by shuffle; groups joined by broadcast."""
    rows = [(i, "a b c d e f" if i % 2 else f"text number {i} of its own {i * 7} words {i * 3}") for i in range(30)] + [(1, "a b c d e f")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    for most, hot in ((1_000_000, 1000), (1, 1000), (1_000_000, 1), (1, 5)):
        monkeypatch.setattr(nearcopies, "LOSERS", most)
        monkeypatch.setattr(naming, "HOT", hot)
        assert sorted(r.doc_id for r in nearcopies.keep_one(df).collect()) == [0, 1, *range(2, 30, 2)]
