"""The spelling of words: a hierarchical Pitman-Yor model over their bytes, the base of the model over words.

A word is its bytes and a closing space, each given up to ORDER bytes before, the opening space among them. A
context's restaurant shares that of one byte less; below all is an even share for each byte that can occur. The
chances of all words, the empty one (the end of a text) among them, sum to one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.llm.common import arrays, few, settle, small_enough
from slidemill.llm.pitman_yor import discount_of, redraw

#: Bytes of context.
ORDER = 4
THETA, SWEEPS, KEEP = 2.0, 5, 2
#: Bytes that are no ASCII white space, and the closing space.
BYTES = 251
#: Contexts and bytes of the spelling that one group samples, about; and those that are broadcast, at most.
SHARD, BROADCAST = 10_000, 2_000_000
#: Words whose n-grams a task counts at once.
AT_ONCE = 100_000


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word, its closing space last: the byte and up to ORDER before it, and how many, in one number; and the first place of each word."""
    data = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.int64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    start = np.cumsum(size) - size
    place = np.arange(len(data)) - np.repeat(start, size)
    code = data.copy()
    for k in range(1, ORDER + 1):
        deep = np.flatnonzero(place >= k)
        code[deep] += data[deep - k] << 8 * k
    code += np.minimum(place, ORDER) + 1 << 8 * (ORDER + 1)
    return code[place > 0], start - np.arange(len(words))


def _gram(code: int) -> bytes:
    return (code & (1 << 8 * (ORDER + 1)) - 1).to_bytes(8, "big")[8 - (code >> 8 * (ORDER + 1)) :]


def _code(gram: bytes) -> int:
    return int.from_bytes(gram, "big") + (len(gram) << 8 * (ORDER + 1))


def gram_counts(words: DataFrame) -> DataFrame:
    """gram (a context of up to ORDER bytes and the byte after it), n over words(word), each once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.extend(batch["word"])
            if held and (batch is None or len(held) > AT_ONCE):
                code, n = np.unique(_codes(held)[0], return_counts=True)
                held = []
                yield pd.DataFrame({"code": code, "n": n.astype(np.int64)})

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"gram": [_gram(c) for c in batch["code"].tolist()], "n": batch["n"]})

    codes = words.select("word").mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return codes.mapInPandas(named, "gram binary, n long")


class Spelling:
    """grams has gram, ps: probability of the last byte after the others, in each sample. contexts has ctx, bs: share left to the context of one byte less."""

    def __init__(self, grams: DataFrame, contexts: DataFrame):
        self._small = small_enough(grams, BROADCAST)
        self._grams, self._contexts, self._held = grams, contexts, None

    def met(self, words: DataFrame) -> DataFrame:
        """The columns of words and base, log10 of the spelling, of words(word, ...) whose bytes were all fitted."""
        if not self._small:
            mean = self._grams.select("gram", F.log10(F.aggregate("ps", F.lit(0.0), lambda a, p: a + p) / F.size("ps")).alias("p"))
            space = F.lit(bytearray(b" "))
            ends = words.withColumn("s", F.concat(space, "word", space)).withColumn("i", F.explode(F.sequence(F.lit(2), F.length("s"))))
            ends = ends.withColumn("gram", F.expr(f"substring(s, greatest(i - {ORDER}, 1), least(i, {ORDER + 1}))"))
            return ends.join(mean, "gram").groupBy(*words.columns).agg(F.sum("p").alias("base"))
        return self._walked(words)

    def _walked(self, words: DataFrame) -> DataFrame:
        """The same of any words, by a broadcast table: a byte that its context does not have is left to the contexts of less bytes, then to an even share."""
        if self._held is None:
            sides = []
            for table, key, of in ((self._grams, "gram", "ps"), (self._contexts, "ctx", "bs")):
                found = arrays(table.select(key, *[F.col(of)[j].alias(f"v{j}") for j in range(KEEP)]))  # BROADCAST at most
                codes = np.array([_code(g) for g in found[key]], np.int64)
                order = np.argsort(codes)
                sides += [codes[order], np.array([found[f"v{j}"][order] for j in range(KEEP)])]
            self._held = words.sparkSession.sparkContext.broadcast(tuple(sides))
        held = self._held

        def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grams, ps, contexts, bs = held.value
            low = lambda code, k: (code & (1 << 8 * k) - 1) + (k << 8 * (ORDER + 1))
            for batch in batches:
                if not len(batch):
                    continue
                codes, first = _codes(list(batch["word"]))
                p, left, size = np.zeros((KEEP, len(codes))), np.ones((KEEP, len(codes))), codes >> 8 * (ORDER + 1)
                for k in range(ORDER, -1, -1):
                    i = np.flatnonzero((size > k) & (p[0] == 0))
                    gram = low(codes[i], k + 1)
                    at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                    met = grams[at] == gram if len(grams) else np.zeros(len(i), bool)
                    p[:, i[met]] = left[:, i[met]] * ps[:, at[met]]
                    i = i[~met]
                    ctx = low(codes[i] >> 8, k)
                    at = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
                    met = contexts[at] == ctx
                    left[:, i[met]] *= bs[:, at[met]]
                p = np.where(p == 0, left / BYTES, p)
                yield batch.assign(base=np.add.reduceat(np.log10(p.mean(axis=0)), first))

        return words.mapInPandas(spelled, ", ".join(f"{k} {t}" for k, t in [*words.dtypes, ("base", "double")]))

    def unmet(self, words: DataFrame) -> DataFrame:
        """The columns of words and base of any words(word, ...), each once: a byte that its context does not have is left to the contexts of less bytes, then to an even share."""
        if self._small:
            return self._walked(words)
        space = F.lit(bytearray(b" "))
        ends = words.withColumn("s", F.concat(space, "word", space)).withColumn("i", F.explode(F.sequence(F.lit(2), F.length("s"))))
        ends = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.col("i") - 1, F.lit(ORDER)))))
        asked = ends.select(*words.columns, "i", "k", F.expr("substring(s, i - k, k + 1)").alias("gram"), F.expr("substring(s, i - k, k)").alias("ctx"))
        found = asked.join(self._grams, "gram", "left").join(self._contexts, "ctx", "left")
        steps = found.groupBy(*words.columns, "i").agg(F.sort_array(F.collect_list(F.struct("k", "ps", "bs")), asc=False).alias("steps"))
        one = lambda j: (
            "aggregate(steps, named_struct('left', 1D, 'p', CAST(NULL AS DOUBLE)), (a, x) -> named_struct("
            f"'left', a.left * IF(a.p IS NULL AND x.ps IS NULL, coalesce(x.bs[{j}], 1D), 1D), 'p', coalesce(a.p, a.left * x.ps[{j}])), a -> coalesce(a.p, a.left / {BYTES}))"
        )
        p = sum((F.expr(one(j)) for j in range(1, KEEP)), F.expr(one(0))) / KEEP
        return steps.select(*words.columns, F.log10(p).alias("p")).groupBy(*words.columns).agg(F.sum("p").alias("base"))


def spelling(words: DataFrame) -> Spelling:
    """Fit the spelling on words(word), each once.

    Restaurants of one byte of context and of none (65,792 entries at most) are sampled here; all deeper ones stay a
    table, dealt by the last two bytes of the context, below which restaurants do not touch.
    """
    spark = words.sparkSession
    suffixes = gram_counts(words).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("gram"))))
    whole = suffixes.select(F.expr("substring(gram, i)").alias("gram"), F.when(F.col("i") == 1, F.col("n")).otherwise(0).alias("own"))
    counted = settle(whole.groupBy("gram").agg(F.sum("own").alias("own")), "grams")
    sizes = {r[0]: r[1:] for r in counted.groupBy(F.length("gram")).agg(F.count_if(F.col("own") == 1), F.count_if(F.col("own") == 2), F.count("*")).collect()}
    d = [discount_of(*sizes.get(k + 1, (0, 0, 0))[:2]) for k in range(ORDER + 1)]
    shards = 1 + sum(n for *_, n in sizes.values()) // SHARD
    low = sorted((bytes(g), n) for g, n in counted.filter(F.length("gram") <= 2).collect())
    names = [[g for g, _ in low if len(g) == k + 1] for k in range(2)]
    own = [np.array([n for g, n in low if len(g) == k + 1], np.int64) for k in range(2)]
    code = np.array([g[0] * 256 + g[1] for g in names[1]], np.int64)
    dish = np.array([g[0] for g in names[0]], np.int64)
    context, up = code // 256, np.searchsorted(dish, code % 256)
    tables = [np.ones(len(o), np.int64) for o in own]

    shard = F.pmod(F.xxhash64(F.expr("substring(gram, -3, 2)")), F.lit(shards)).cast("int")
    none = F.array().cast("array<double>")
    state = counted.filter(F.length("gram") > 2).select(shard.alias("shard"), "gram", "own", F.lit(1).cast("long").alias("t"), none.alias("ps"), none.alias("bs"))
    kept: list[tuple[list[np.ndarray], list[np.ndarray]]] = []
    for sweep in range(SWEEPS):
        sent = {bytes(g): n for g, n in state.filter(F.length("gram") == 3).groupBy(F.expr("substring(gram, 2)").alias("up")).agg(F.sum("t")).collect()}
        c1 = own[1] + np.array([sent.get(g, 0) for g in names[1]], np.int64)
        tables[1] = np.minimum(tables[1], c1)
        c0 = own[0] + np.bincount(up, tables[1], minlength=len(dish)).astype(np.int64)
        tables[0] = np.minimum(tables[0], c0)
        r = np.random.default_rng(sweep)
        tables[0], back0, prob0 = redraw(np.zeros(len(dish), np.int64), 1, c0, tables[0], np.full(len(dish), 1 / BYTES), d[0], THETA, r)
        tables[1], back1, prob1 = redraw(context, 256, c1, tables[1], prob0[up], d[1], THETA, r)
        if keep := sweep >= SWEEPS - KEEP:
            kept.append(([prob0, prob1], [back0, back1]))
        parent = np.zeros(65_536)
        parent[code] = prob1
        state = settle(_deep_sweep(state, parent, d, sweep, keep), "spelling")

    n = [[float(x) for x in row] for row in zip(*[np.concatenate(p) for p, _ in kept], strict=True)]
    rows = [(bytes(g), p) for g, p in zip(names[0] + names[1], n, strict=True)]
    shares = [(b"", [float(b[0][0]) for _, b in kept])] + [(bytes([x]), [float(b[1][x]) for _, b in kept]) for x in np.unique(context).tolist()]
    grams = state.select("gram", "ps").unionByName(few(spark, rows, gram=pa.binary(), ps=pa.list_(pa.float64())))
    contexts = state.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("ctx")).agg(F.first("bs").alias("bs"))
    contexts = contexts.unionByName(few(spark, shares, ctx=pa.binary(), bs=pa.list_(pa.float64())))
    return Spelling(settle(grams, "spelled"), settle(contexts, "contexts"))


def _deep_sweep(state: DataFrame, parent: np.ndarray, d: list[float], sweep: int, keep: bool) -> DataFrame:
    """state after new tables of all restaurants of two bytes of context or more. parent: probabilities of a byte after one byte."""
    held = state.sparkSession.sparkContext.broadcast(parent)

    def swept(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(gram=rows["gram"].map(bytes)).sort_values("gram", ignore_index=True)
        grams, own, old = rows["gram"].tolist(), rows["own"].to_numpy(np.int64), rows["t"].to_numpy(np.int64)
        size = np.array([len(g) for g in grams])
        places = [np.flatnonzero(size == k + 1) for k in range(ORDER + 1)]
        at = {g: i for i, g in enumerate(grams)}
        up = np.array([at.get(g[1:], -1) for g in grams], np.int64)
        r = np.random.default_rng([sweep, int(rows["shard"].iloc[0])])

        def customers(t: np.ndarray) -> np.ndarray:
            c = own.copy()
            for k in range(ORDER, 1, -1):
                i = places[k]
                t[i] = np.minimum(t[i], c[i])
                if k > 2:
                    np.add.at(c, up[i], t[i])
            return c

        t, prob, share = old.copy(), np.zeros(len(grams)), np.zeros(len(grams))
        c = customers(t)
        for k in range(2, ORDER + 1):
            i = places[k]
            above = prob[up[i]] if k > 2 else held.value[[grams[j][1] * 256 + grams[j][2] for j in i.tolist()]]
            contexts, of = np.unique(np.array([grams[j][:-1] for j in i.tolist()], object), return_inverse=True)
            t[i], back, prob[i] = redraw(of.astype(np.int64), len(contexts), c[i], t[i], above, d[k], THETA, r)
            share[i] = back[of]
        customers(t)
        if keep:
            rows = rows.assign(ps=[[*p, x] for p, x in zip(rows["ps"], prob.tolist(), strict=True)], bs=[[*b, x] for b, x in zip(rows["bs"], share.tolist(), strict=True)])
        return rows.assign(t=t)

    return state.groupBy("shard").applyInPandas(swept, state.schema)
