import math

import numpy as np
from pyspark.sql import functions as F

from slidemill.llm import toxicity as tx
from slidemill.llm.common import table


def test_gradients_by_differences():
    net = tx.Network.fresh(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    r = np.random.default_rng(0)
    x, size = r.standard_normal((6, 3, 6 * tx.H)), np.array([6, 4, 1])
    _, kept = net.run(x, size, back=True)
    g, dx = net.gradients(x, kept, np.ones(3))
    for k in ("u0", "u1", "att", "out", "bias"):
        at = tuple(r.integers(0, s) for s in net.p[k].shape)
        old, ends = net.p[k][at], []
        for e in (1e-3, -1e-3):
            net.p[k][at] = old + e
            ends.append(net.run(x, size).sum())
        net.p[k][at] = old
        assert abs((ends[0] - ends[1]) / 2e-3 - g[k][at]) < 2e-2 * max(1, abs(g[k][at])), k
    for at in ((0, 0, 3), (3, 1, 20), (5, 0, 47)):
        y = x.copy()
        y[at] += 1e-3
        z = x.copy()
        z[at] -= 1e-3
        assert abs((net.run(y, size).sum() - net.run(z, size).sum()) / 2e-3 - dx[at]) < 1e-2


def test_windows_cover_and_overlap():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        s = tx.windows(n)
        covered = {k for a in s for k in range(a, min(a + tx.WINDOW, n))}
        assert covered == set(range(n)) and len(s) >= 1


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    out = tx.toxicity(docs, table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").filter("held_out").toPandas()
    y, p = out.toxic == 1, out.predicted == 1
    assert (p == y).mean() > 0.93 and (p & y).sum() / y.sum() > 0.7 and (p & ~y).sum() / (~y).sum() < 0.05


def test_edges(spark):
    rows = [(i, "you stupid idiot scum " * 3 if i % 2 else "the kind and of that " * 3) for i in range(1, 41)] + [(90, None), (91, ""), (None, "x"), (92, "calm words " * 20_000), (1, "you stupid idiot scum ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("score"), F.lit("q").alias("TEXT"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 41)] + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    out = tx.toxicity(df, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert tx.toxicity(df.limit(0), labels).count() == 0
    assert {r.predicted for r in tx.toxicity(df, labels.limit(0)).collect()} == {0}
    assert tx.keep_clean(df, labels).columns == df.columns


def slow_score(net, text):
    """The forward pass in plain loops over one word, one window and one unit at a time."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    words, best = tx.words_of((text or "").lower()), -math.inf
    sig = lambda v: 1 / (1 + math.exp(-v))
    start = 0
    while True:
        gates = []
        for w in words[start : start + tx.WINDOW]:
            (whole,), parts, _ = tx.word_features([w])
            chars = [sum(p["char"][k][j] for k in parts) / len(parts) for j in range(tx.CHAR_DIM)]
            gates.append([sum(a * b for a, b in zip([*p["word"][whole], *chars], column, strict=True)) for column in p["in"].T] + p["b"])
        states = [[0.0] * (2 * tx.H) for _ in gates]
        for d in (0, 1):
            h, u = [0.0] * tx.H, p[f"u{d}"]
            for t in range(len(gates)) if d == 0 else reversed(range(len(gates))):
                x = gates[t][3 * tx.H * d : 3 * tx.H * (d + 1)]
                rec = [sum(h[i] * u[i][k] for i in range(tx.H)) for k in range(3 * tx.H)]
                z, r = ([sig(x[k] + rec[k]) for k in range(at, at + tx.H)] for at in (0, tx.H))
                c = [math.tanh(x[2 * tx.H + j] + r[j] * rec[2 * tx.H + j]) for j in range(tx.H)]
                h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(tx.H)]
                states[t][tx.H * d : tx.H * (d + 1)] = h
        att = [math.exp(sum(a * b for a, b in zip(s, p["att"], strict=True))) for s in states]
        pooled = [sum(a * s[j] for a, s in zip(att, states, strict=True)) / sum(att) for j in range(2 * tx.H)] if states else [0.0] * (2 * tx.H)
        best = max(best, sum(a * b for a, b in zip(pooled, p["out"], strict=True)) + p["bias"][0])
        start += tx.STRIDE
        if start + tx.WINDOW - tx.STRIDE >= len(words):
            return sig(best)


def test_scores_by_plain_loops(spark):
    rows = table(spark, "/root/testdata/sf0.001", "documents").filter("doc_id % 10 = 0").orderBy("doc_id").limit(12).collect()
    texts = [None, "", "one", " \n", "Élan été 日本 x", "w " * 64, "a b " * 33, *[" ".join(r.text.split()[:220]) for r in rows]]
    net = tx.Network.fresh(4)
    net.p["word"] = np.random.default_rng(5).standard_normal(net.p["word"].shape).astype(np.float32)
    net.p["char"] *= 20
    for got, t in zip(net.score(texts), texts, strict=True):
        assert abs(got - slow_score(net, t)) < 1e-4, t
    assert len({round(v, 3) for v in net.score(texts)}) > 8
