import random

import regex
from pyspark.sql import functions as F

from slidemill.llm import decontaminate as dc


def parts(text):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def contained(text, item, threshold=0.8):
    own = parts(item)
    return bool(own) and len(own & parts(text)) / len(own) >= threshold


def data():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.choice((5, 6, 9, 17, 33, 64, 65, 200)))) for i in range(60)]
    docs = []
    for d in range(120):
        words = say(r.randint(0, 400)).split()
        for _, t in r.sample(items, r.randint(0, 2)):
            own = t.split()
            for _ in range(r.choice((0, 0, 1, 2))):
                own[r.randrange(len(own))] = "new"
            cut = own[: max(1, int(len(own) * r.choice((1, 1, 0.9, 0.82, 0.7))))]
            at = r.randint(0, len(words))
            words[at:at] = " ,; ".join(cut).upper().split() if r.random() < 0.3 else cut
        docs.append((d, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "one two"), (7, docs[7][1]), (None, items[5][1]), (503, "\n--" + items[6][1] + "!"), (504, "w1 " * 60_000 + items[8][1])]
    items += [(900, None), (901, "too short"), (3, items[3][1]), (None, say(12))]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = data()
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("shared"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, k, len(parts(t)), len(parts(t) & parts(x))) for i, x in docs for k, t in set(items) if contained(x, t)), key=str)
    assert len(want) > 40
    for size in (50_000, 40):
        monkeypatch.setattr(dc, "PASS", size)
        got = sorted((tuple(r)[:4] for r in dc.decontaminate(d, b).collect()), key=str)
        assert got == want
    hit = {(i, x) for i, x in docs if any(contained(x, t) for _, t in items)}
    assert sorted((tuple(r)[:2] for r in dc.clean(d, b).collect()), key=str) == sorted((x for x in docs if x not in hit), key=str)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.decontaminate(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert dc.decontaminate(docs, items.limit(0)).count() == 0
    assert dc.clean(docs, items).count() == 0 and dc.clean(docs, items.limit(0)).count() == 1


def test_clean_with_a_map_column(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:12]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing of it here at all")], "doc_id long, text string").withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    assert [r.doc_id for r in dc.clean(docs, items).collect()] == [2]


def test_long_items(spark):
    """What is broadcast grows with the items, not with their squares: thirty of 5,000 words and one of 300,000."""
    long = [" ".join(f"w{k}x{i}" for i in range(5_000)) for k in range(30)]
    huge = " ".join(f"h{i}" for i in range(300_000))
    items = spark.createDataFrame([*enumerate(long), (99, huge)], "item_id long, text string")
    near = " ".join(f"w3x{i}" if i % 40 else "z" for i in range(5_000))
    docs = spark.createDataFrame([(0, "before " + long[7] + " after"), (1, huge + " more"), (2, near), (3, long[5][: len(long[5]) // 2]), (4, "nothing here at all to find"), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in dc.decontaminate(docs, items).collect()}
    shared = sum(all(j % 40 for j in range(i, i + 5)) for i in range(4_996))
    assert got == {(0, 7): (4_996, 4_996), (1, 99): (299_996, 299_996), (2, 3): (4_996, shared)}
