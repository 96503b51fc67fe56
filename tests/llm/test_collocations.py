import random
import re
from collections import Counter

from slidemill.llm import collocations


def brute(rows, least, share=100, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    for lang in n:
        frequent = {g: c for (x, g), c in f.items() if x == lang and c >= least}
        mine = []
        for g, a in frequent.items():
            if len(g) < 2 or any(len(o) > len(g) and 100 * b >= share * a and any(o[i : i + len(g)] == g for i in range(len(o) - len(g) + 1)) for o, b in frequent.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            mine.append((-score, -a, " ".join(g).encode(), a, left, right, score))
        out += [(lang, i, p.decode(), a, le, r, n[lang], s) for i, (_, _, p, a, le, r, s) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(120)):
            words.append(rng.choice(["In the end", "new York city", "the", "a", "çà", "Üb", "x\x1cy", "New York", f"w{rng.randrange(40)}"]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "?!"]))
        rows.append((rng.choice(["en", "de", None]), "".join(words)))
    return rows + [("en", None), ("en", ""), ("fr", "..,"), (None, "aa " * 300), ("und", "aa " * 50), ("en", "copy of this line here now. " * 40)] + [("en", "a b c d e f")] * 30


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "lang string, text string, n long, name string").repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_brute_force_in_small_chunks(spark, monkeypatch):
    rows = made(3, 60)
    want = brute(rows, 20)
    assert len(want) > 12
    monkeypatch.setattr(collocations, "BROADCAST", 0)
    assert run(spark, rows, least=20, chunk=500) == want


def test_first_of_each_language_and_share(spark):
    rows = made(4, 30)
    assert run(spark, rows, least=12, share=80, top=3) == brute(rows, 12, 80, 3)


def test_products_over_64_bits(spark):
    """1000 * a * n of a great many words: decimals, not longs."""
    from pyspark.sql import functions as F

    big = 4_000_000_000_000
    one = spark.range(1).select(((F.lit(1000).cast("decimal(5,0)") * F.lit(big).cast("decimal(20,0)") * F.lit(big + 7).cast("decimal(20,0)")).cast("decimal(38,0)")).alias("t"), (F.lit(big - 1).cast("decimal(20,0)") * F.lit(big - 3).cast("decimal(20,0)")).cast("decimal(38,0)").alias("u"))
    assert one.selectExpr("t div u as s").first()[0] == 1000 * big * (big + 7) // ((big - 1) * (big - 3))


def test_nothing_frequent(spark):
    assert run(spark, [("en", "a b c"), (None, None)]) == []
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_workers_get_few_chunks_at_once(spark, monkeypatch):
    replace, most = collocations._replace, collocations.CHUNKS_AT_ONCE

    def checked(batches):
        for b in batches:
            assert len(b) <= most, f"{len(b)} chunks at once"
            yield from replace(iter([b]))

    monkeypatch.setattr(collocations, "_replace", checked)
    df = spark.createDataFrame(made(5, 40), "lang string, text string").coalesce(1)
    assert collocations.collocations(df, least=3, chunk=200).count() > 0


def test_pairs_are_added_up_in_parts(spark, monkeypatch):
    """Chunks hand on one row for each part of all pairs, not one for each pair, and get one back: no join makes rows of pairs, however many are frequent."""
    monkeypatch.setattr(collocations, "PART", 300)
    made_up, sizes, parts = collocations._add_up, [], []

    def checked(chunks, n_parts, least):
        out = made_up(chunks, n_parts, least)
        sizes.append((chunks.count() + 1) * n_parts - out.count())
        parts.append(n_parts)
        return out

    monkeypatch.setattr(collocations, "_add_up", checked)
    rows = made(6, 50)
    assert run(spark, rows, least=5, chunk=2000) == brute(rows, 5)
    assert min(parts) > 5 and min(sizes) >= 0


def test_a_turn_of_chunks_goes_before_the_next_is_shuffled(spark, monkeypatch):
    """On disk are the chunks of one round, and of another one turn's at most."""
    from slidemill.llm import common

    paired, held = collocations._paired, []

    def checked(chunks, replies, parts):
        held.append(sum("/turn=" in x or "/pairs-" in x for x in common._settled[since:]))
        return paired(chunks, replies, parts)

    since = common.settled_so_far()
    monkeypatch.setattr(collocations, "_paired", checked)
    df = spark.createDataFrame(made(8, 40), "lang string, text string").repartition(8)
    assert collocations.collocations(df, least=3, chunk=2000).count() > 0
    assert len(held) == 4 * collocations.TURNS and max(held) <= collocations.TURNS
