import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from slidemill.llm import language, lm, pitman_yor, spelling, toxicity, words
from slidemill.llm.common import table


def brute_base(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    docs = [(t or "").encode().lower().split() + [None] for _, t in rows]
    c = Counter(w for d, h in zip(docs, held, strict=True) if not h for w in d)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(d), sum(c[w] > 0 for w in d), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in d)) for (i, _), h, d in zip(rows, held, docs, strict=True)]


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def stirling(d, most):
    """S(c, t) by its recursion, a row for each c."""
    rows = [[0.0] * (most + 1) for _ in range(most + 1)]
    rows[1][1] = 1.0
    for c in range(2, most + 1):
        for t in range(1, c + 1):
            rows[c][t] = rows[c - 1][t - 1] + (c - 1 - d * t) * rows[c - 1][t]
    return rows


class Brute:
    """The whole model with dictionaries, one dish after another. spell: probability of a word by its bytes."""

    START, END = b"<", b""

    def __init__(self, texts, spell):
        self.spell = spell
        self.pairs = Counter((u, w) for d in texts for u, w in zip([self.START, *d], [*d, self.END], strict=True))
        self.context = Counter()
        self.seats, self.customers = Counter(), Counter()
        for (u, w), c in self.pairs.items():
            self.context[u] += c
            self.seats[u] += 1
            self.customers[w] += 1
        self.d1, self.d0 = (pitman_yor.discount_of(n.count(1), n.count(2)) for n in (list(self.pairs.values()), list(self.customers.values())))
        self.ways = {d: stirling(d, 60) for d in (self.d1, self.d0)}
        one = {w: 1 for w in self.customers}
        states = [(self.seats, self.customers, one)]
        self.drawn = []
        for sweep in range(lm.SWEEPS):
            before = states[-1]
            x = {u: pitman_yor.gamma(np.array([lm.THETA_PAIRS / self.d1 + n]), self.h(u), 2 * sweep)[0] for u, n in before[0].items()}
            t = {(u, w): self.draw(c, self.d1 * x[u] * self.word(w, before), self.d1, pitman_yor.uniform(lm.pair_hash(self.h(u), self.h(w)), 2 * sweep + 1)[0]) for (u, w), c in self.pairs.items()}
            seats, customers = Counter(), Counter()
            for (u, w), n in t.items():
                seats[u] += n
                customers[w] += n
            y = self.d0 * np.random.default_rng(sweep).gamma(lm.THETA_WORDS / self.d0 + sum(before[2].values()))
            states.append((seats, customers, {w: self.draw(c, y * spell(w), self.d0, pitman_yor.uniform(self.h(w), -2 - sweep)[0]) for w, c in customers.items()}))
            self.drawn.append(t)
        self.states = states

    def h(self, w):
        return np.array([lm.START if w == self.START else lm.END], np.uint64) if w in (self.START, self.END) else words.word_hashes(w)[0]

    def draw(self, c, z, d, u):
        p = [self.ways[d][c][t] * z**t for t in range(1, c + 1)] if c <= 60 else None
        if p is None:  # the recursion overflows
            return int(pitman_yor.draw_tables(np.array([c]), np.array([z]), d, np.array([u]))[0])
        goal, t = u * sum(p), 0
        while goal > 0 and t < c:
            goal -= p[t]
            t += 1
        return max(1, t)

    def word(self, w, state):
        _, customers, tables = state
        n, t = sum(customers.values()), sum(tables.values())
        return (max(0, customers.get(w, 0) - self.d0 * tables.get(w, 0)) + (lm.THETA_WORDS + self.d0 * t) * self.spell(w)) / (lm.THETA_WORDS + n)

    def pair(self, u, w, k):
        state, c = self.states[k + 1], self.pairs.get((u, w), 0)
        own = max(0, c - self.d1 * self.drawn[k].get((u, w), 0))
        return (own + (lm.THETA_PAIRS + self.d1 * state[0].get(u, 0)) * self.word(w, state)) / (lm.THETA_PAIRS + self.context.get(u, 0))

    def score(self, d):
        kept = range(lm.SWEEPS - lm.KEEP, lm.SWEEPS)
        return sum(math.log10(sum(self.pair(u, w, k) for k in kept) / lm.KEEP) for u, w in zip([self.START, *d], [*d, self.END], strict=True))


SMALL = [(i, " ".join(np.random.default_rng(i).choice(["The", "of", "a", "b", "cat", "dog", "née", "x1", f"w{i}", f"w{i // 3}"], 30 + i).tolist())) for i in range(40)]


def test_against_brute_force(spark):
    """Scores against a walk over dictionaries, with the number of hot words on both sides of the vocabulary's size; probabilities sum to one."""
    rows = [*SMALL, (40, None), (40, "zzz cat qq"), (None, "of the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    split = lambda t: (t or "").encode().lower().split()
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    train = [split(t) for (_, t), h in zip(rows, held, strict=True) if not h]
    known = {w for d in train for w in d} | {b""}
    every = known | {w for _, t in rows for w in split(t)}
    fitted = spelling.spelling(spark.createDataFrame([(bytearray(w),) for w in sorted(known)], "word binary"))
    spelled = {bytes(r.word): 10.0**r.base for r in fitted.unmet(spark.createDataFrame([(bytearray(w),) for w in sorted(every)], "word binary")).collect()}
    brute = Brute(train, spelled.__getitem__)
    want = sorted((str(i), round(brute.score(split(t)), 3)) for i, t in rows)
    for hot in (262_144, 4):
        lm_hot, lm.HOT = lm.HOT, hot
        try:
            got = lm.score(df).collect()
        finally:
            lm.HOT = lm_hot
        same([tuple(r)[:6] for r in got], brute_base(rows))
        for a, b in zip(sorted((str(r.doc_id), round(r.score, 3)) for r in got), want, strict=True):
            assert a[0] == b[0] and abs(a[1] - b[1]) < 0.01
    for u in (b"the", b"w1", b"<", b"never met"):
        for k in range(lm.SWEEPS - lm.KEEP, lm.SWEEPS):
            state = brute.states[k + 1]
            unmet = (lm.THETA_WORDS + brute.d0 * sum(state[2].values())) / (lm.THETA_WORDS + sum(state[1].values())) * (1 - sum(spelled[w] for w in known))
            back = (lm.THETA_PAIRS + brute.d1 * state[0].get(u, 0)) / (lm.THETA_PAIRS + brute.context.get(u, 0))
            assert abs(sum(brute.pair(u, w, k) for w in known) + back * unmet - 1) < 1e-9


def test_held_out_beats_plain_bigram(spark):
    """Log10 a token of held-out texts, less their unknown words (which the model must spell), against pairs of full counts over the add-one base, at the best of some weights of it."""
    docs = [(r.doc_id, (r.text or "").encode().lower().split()) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    is_held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, d in docs if not is_held(i) for w in [*d, None])
    docs = [(i, [w for w in d if w in c]) for i, d in docs]
    got = [r for r in lm.score(spark.createDataFrame([(i, b" ".join(d).decode()) for i, d in docs], "doc_id long, text string")).collect() if r.held_out]
    train = [[*d, None] for i, d in docs if not is_held(i)]
    asked = [(u, w) for i, d in docs if is_held(i) for u, w in zip([0, *d], [*d, None], strict=True)]
    pairs = Counter((u, w) for d in train for u, w in zip([0, *d[:-1]], d, strict=True))
    after = Counter(u for d in train for u in [0, *d[:-1]])
    n, v = sum(c.values()), len(c)
    plain = max(sum(math.log10((pairs[u, w] + mix * (c[w] + 1) / (n + v + 1)) / (after[u] + mix)) for u, w in asked) for mix in (1, 5, 20, 50, 200))
    assert sum(r.n_tokens for r in got) == len(asked)
    print("held out, log10 a token:", sum(r.score for r in got) / len(asked), "plain bigram:", plain / len(asked), "base:", sum(r.base_score for r in got) / len(asked))
    assert sum(r.score for r in got) > plain + 0.02 * len(asked)


def test_texts_that_occur_twice_are_told_apart(spark):
    """Of random texts in training, those that are there twice have the higher score a token."""
    r = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(r.choice(vocabulary, 120).tolist()) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:100])]
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    got = {x.doc_id: x.score / x.n_tokens for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = [got[i] for i in range(100) if i in train and 1000 + i in train]
    once = [got[i] for i in range(100, 300) if i in train]
    assert min(twice) > max(once)


def test_edges(spark):
    rows = [(1, "a b c a b"), (1, "a b c a b"), (2, None), (3, ""), (None, "É é \x85 x"), (5, "word " * 30000), (9, "zzz yyy"), (9, "zzz yyy"), (7, "y" * 70000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("word"), F.lit("k").alias("KEY"))
    out = lm.score(df).collect()
    same([tuple(r)[:6] for r in out], brute_base(rows))
    assert lm.score(df.limit(0)).count() == 0


def test_nothing_to_learn_from(spark):
    """Every text held out: the spelling's even share is all there is."""
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm.score(spark.createDataFrame([(i, "ab")], "doc_id long, text string")).collect()
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and abs(r.score + 4 * math.log10(spelling.BYTES)) < 1e-6


def test_words_as_arrays():
    """Hashes and spans of words wherever segments end; packed numbers."""
    text = b"  the of\tthe\x0b\x0cnaiv\xc3\xa9 " * 50 + b"x" * 9000 + b" the"
    whole = words.word_hashes(text)
    old, words.SEGMENT = words.SEGMENT, 37
    try:
        parts = words.word_hashes(text)
    finally:
        words.SEGMENT = old
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    h, a, b = whole
    assert [text[i:j] for i, j in zip(a, b, strict=True)] == text.split() and len(set(h.tolist())) == len(set(text.split()))
    find = words.Lookup(np.unique(h))
    assert (np.unique(h)[find(h)] == h).all() and find(h + np.uint64(1)).max() == -1
    for x in ([], [0], [255, 256, 0], [1 << 40, 3]):
        assert words.unpack(words.pack(np.array(x, np.int64))).tolist() == x


def exact_mean(c, z, d):
    """Mean number of tables in whole numbers and fractions, for a discount of a half."""
    ways = [1]
    for k in range(1, c):  # 2^(c - t) S(c, t)
        stay = [w * (2 * k - t) for t, w in enumerate(ways, 1)] + [0]
        ways = [a + b for a, b in zip(stay, [0, *ways], strict=True)]
    w = [x * (2 * Fraction(z)) ** t for t, x in enumerate(ways, 1)]
    return float(sum(t * x for t, x in enumerate(w, 1)) / sum(w))


def test_tables_follow_their_law():
    """Means of drawn tables against exact ones, below and beyond the size up to which Stirling numbers are tabled; nearly every customer may have a table."""
    n = 20_000
    for c in (2, 3, 8, 9, 40, 200, 256, 257, 400):
        for z in (0.05, 2.0, 40.0, 900.0):
            t = pitman_yor.draw_tables(np.full(n, c), np.full(n, z), 0.5, np.random.default_rng(c).random(n))
            assert t.min() >= 1 and t.max() <= c
            assert abs(t.mean() - exact_mean(c, z, 0.5)) < (0.03 * t.mean() + 0.02 if c <= pitman_yor.FULL else 0.03 * t.mean() + 0.1)
    t = pitman_yor.draw_tables(np.array([100, 1000, 10**9]), np.full(3, 1e12), 0.5, np.full(3, 0.5))
    assert t[0] > 90 and t[1] > 900 and t[2] > 10**8
    assert pitman_yor.draw_tables(np.array([0, 1]), np.ones(2), 0.5, np.full(2, 0.9)).tolist() == [0, 1]


def test_numbers_by_hash():
    h = np.arange(200_000)
    assert abs(pitman_yor.uniform(h).mean() - 0.5) < 0.005 and abs(np.corrcoef(pitman_yor.uniform(h), pitman_yor.uniform(h, 1))[0, 1]) < 0.01
    for shape in (1.0, 2.5, 300.0):
        x = pitman_yor.gamma(np.full(len(h), shape), h, 3)
        assert abs(x.mean() / shape - 1) < 0.01 and abs(x.var() / shape - 1) < 0.02


def test_sizes_are_not_cut():
    assert lm.HOT >= 262_144 and spelling.ORDER == 4
    assert language.SAMPLE >= 4_000 and toxicity.SAMPLE >= 3_000


def test_spelling_keeps_its_order(spark, monkeypatch):
    """Contexts of four bytes however many n-grams there are, dealt over several groups; met and unmet words against a plain walk, with the table broadcast and joined."""
    monkeypatch.setattr(spelling, "SHARD", 50)
    words_ = sorted({bytes(w) for w in np.random.default_rng(5).choice(list(b"abcd"), (300, 6))} | {b""})
    df = spark.createDataFrame([(bytearray(w), 1) for w in words_], "word binary, c long")
    spelled = spelling.spelling(df.select("word"))
    ps = {bytes(g): p for g, p in spelled._grams.select("gram", "ps").collect()}
    bs = {bytes(g): b for g, b in spelled._contexts.select("ctx", "bs").collect()}
    assert max(map(len, ps)) == 5 and max(map(len, bs)) == 4

    def prob(ctx, x, j):
        if (p := ps.get(ctx + x)) is not None:
            return p[j]
        back = bs[ctx][j] if ctx in bs else 1.0
        return back * (prob(ctx[1:], x, j) if ctx else 1 / spelling.BYTES)

    can = [bytes([x]) for x in range(256) if x not in (9, 10, 11, 12, 13)]
    for ctx in list(bs)[::17]:
        assert abs(sum(prob(ctx, x, 0) for x in can) - 1) < 1e-9

    def plain(w):
        s = b" " + w + b" "
        return sum(math.log10(sum(prob(s[max(0, i - 4) : i], s[i : i + 1], j) for j in range(spelling.KEEP)) / spelling.KEEP) for i in range(1, len(s)))

    new = [*words_[:20], b"aaaaaaaaa", b"zzz", b"abzab", "é".encode(), b"d"]
    for small in (True, False):
        spelled._small = small
        met = {bytes(r.word): r.base for r in spelled.met(df).collect()}
        unmet = {bytes(w): b for w, b in spelled.unmet(spark.createDataFrame([(bytearray(w),) for w in new], "word binary")).collect()}
        assert len(met) == len(words_) and len(unmet) == len(new)
        assert all(abs(b - plain(w)) < 1e-9 for w, b in [*met.items(), *unmet.items()])


def test_pairs_are_scored_a_few_at_once(spark, monkeypatch):
    """However many pairs a part has, the same scores."""
    df = spark.createDataFrame([(i, "a b c a b d e f g b a c " * (1 + i % 3)) for i in range(20)], "doc_id long, text string")
    want = sorted(map(tuple, lm.score(df).collect()))
    mean = lm._mean

    def checked(law, c, *rest):
        assert len(c) <= 4, f"{len(c)} pairs at once"
        return mean(law, c, *rest)

    monkeypatch.setattr(lm, "PAIRS_AT_ONCE", 4)
    monkeypatch.setattr(lm, "_mean", checked)
    assert sorted(map(tuple, lm.score(df).collect())) == want


def test_sides_are_packed(spark, monkeypatch):
    """Tokens beside one word that is not hot are no rows; however the sides are dealt, the same scores."""
    texts = ["a b c a b d e f g b a c ", "a x1 b x2 a x1 x2 b a ", "b y a y y b a c x1 "]
    df = spark.createDataFrame([(i, texts[i % 3] * (1 + i % 3) + f"once{i} a") for i in range(24)], "doc_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 8), round(r.score, 8)) for r in rows)
    others, rows = lm._others, []

    def kept(blocks):
        out = others(blocks)
        rows.extend(out.collect())
        return out

    monkeypatch.setattr(lm, "HOT", 3)
    want = key(lm.score(df).collect())
    monkeypatch.setattr(lm, "SIDE", 5)
    monkeypatch.setattr(lm, "_others", kept)
    got = key(lm.score(df).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert max(abs(a - b) for g, w in zip(got, want, strict=True) for a, b in zip(g[4:], w[4:], strict=True)) < 1e-6
    hot = set(words.word_hashes(b"a b")[0].view(np.int64).tolist()) | {lm.START, lm.END}
    assert rows and not any(r.u in hot or r.w in hot for r in rows)
