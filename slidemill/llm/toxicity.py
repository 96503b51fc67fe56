"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, in numpy.

A text is scored in windows of WINDOW words, each overlapping the next by a quarter; its score is the largest of all
its windows. A word's input is the embedding of its hashed whole and the mean of those of its hashed character
n-grams. What the input adds to the gates depends on the word alone, so it is worked out once for each
distinct word a worker meets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.llm.common import crc_mod, pick
from slidemill.llm.hashing import fitted, grams, quota, rank

WINDOW, STRIDE = 64, 48
H, WORD_DIM, CHAR_DIM = 8, 8, 12
WORD_BUCKETS, CHAR_BUCKETS, CHAR_SIZES = 1 << 15, 1 << 15, (3, 4, 5)
#: Labelled rows that the network is trained on, at most (and 60 MB of text).
SAMPLE = 3_000
EPOCHS = 7
#: Words whose gate inputs a worker keeps; it starts afresh beyond that.
KEPT = 100_000
#: Windows scored at once.
CHUNK = 1024

words_of = re.compile(r"\w+").findall


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the bucket of its whole; the buckets of all its character n-grams, and which word each is of, in order."""
    parts = [_features(words[k : k + 10_000], k) for k in range(0, len(words), 10_000)] or [_features([], 0)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _features(words: list[str], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [b"\x01\x01" + w.encode("utf-8", "surrogatepass") + b"\x02\x02" for w in words]
    if not raw:
        return (np.zeros(0, np.int32),) * 3
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw])
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(raw), dtype=np.int32), size)
    buckets, owner = [], []
    for n, g in zip(CHAR_SIZES, grams(data, CHAR_SIZES, CHAR_BUCKETS), strict=True):
        whole = of[: len(g)] == of[n - 1 :]
        buckets.append(g[whole].astype(np.int32))
        owner.append(of[: len(g)][whole])
    b, o = np.concatenate(buckets), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    place = (np.arange(len(data)) - np.repeat(ends - size, size) + 1).astype(np.uint64)
    mixed = data.astype(np.uint64) * place * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    whole = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), ends - size)
    return ((whole >> np.uint64(33)) % np.uint64(WORD_BUCKETS)).astype(np.int32), b[order], o[order] + np.int32(start)


def windows(n: int) -> np.ndarray:
    """First word of each window of a text of n words; at least one."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    kept: dict[str, int] = field(default_factory=dict)
    gates: np.ndarray | None = None

    @staticmethod
    def fresh(seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        p = {"word": np.zeros((WORD_BUCKETS, WORD_DIM), np.float32), "char": (0.05 * r.standard_normal((CHAR_BUCKETS, CHAR_DIM))).astype(np.float32)}
        p |= {"in": f(d, 6 * H), "b": np.zeros(6 * H, np.float32), "u0": f(H, 3 * H), "u1": f(H, 3 * H), "att": 0.5 * f(2 * H), "out": f(2 * H), "bias": np.full(1, -1.0, np.float32)}
        return Network(p)

    def __getstate__(self):
        return {"p": self.p, "kept": {}, "gates": None}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        w, b, o = word_features(words)
        first = np.searchsorted(o, np.arange(len(words)))
        n = np.diff(np.append(first, len(o)))
        chars = np.add.reduceat(self.p["char"][b], first, axis=0) / n[:, None] if len(words) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][w], chars], axis=1).astype(np.float32), (w, b, o, n)

    def run(self, x: np.ndarray, size: np.ndarray, back: bool = False):
        """Logits of windows. x: gate inputs (place, window, 6H); size: words of each. With back also what gradients need."""
        steps, n = x.shape[:2]
        mask = (np.arange(steps)[:, None] < size[None, :]).astype(np.float32)[:, :, None]
        full = int(size.min()) if n else 0  # up to there no window has ended
        hs = np.empty((steps, n, 2 * H), np.float32)
        saved = {}
        for d in (0, 1):
            u, h = self.p[f"u{d}"], np.zeros((n, H), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                pre, rec = x[t, :, 3 * H * d : 3 * H * (d + 1)], h @ u
                zr = _sigmoid(pre[:, : 2 * H] + rec[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(pre[:, 2 * H :] + r * rec[:, 2 * H :])
                new = c + z * (h - c)
                if t >= full:
                    new = h + mask[t] * (new - h)
                if back:
                    saved[d, t] = (h, z, r, c, rec[:, 2 * H :])
                h = new
                hs[t, :, H * d : H * (d + 1)] = h
        att = hs @ self.p["att"]
        att = np.exp(np.minimum(att, 60)) * mask[:, :, 0]
        att /= np.maximum(att.sum(axis=0, keepdims=True), 1e-30)
        pooled = np.einsum("tn,tnh->nh", att, hs)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (mask, hs, saved, att, pooled)) if back else logit

    def gradients(self, x: np.ndarray, kept: tuple, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the recurrent part, and of the gate inputs."""
        mask, hs, saved, att, pooled = kept
        g = {"out": dlogit @ pooled, "bias": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * self.p["out"]
        dhs = att[:, :, None] * dpool[None, :, :]
        datt = np.einsum("tnh,nh->tn", hs, dpool)
        datt = att * (datt - (att * datt).sum(axis=0, keepdims=True))
        g["att"] = np.einsum("tn,tnh->h", datt, hs)
        dhs += datt[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        steps, n = x.shape[:2]
        for d in (0, 1):
            u = self.p[f"u{d}"]
            gu, dh = np.zeros_like(u), np.zeros((n, H), np.float32)
            for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
                h, z, r, c, rec = saved[d, t]
                dh = dh + dhs[t, :, H * d : H * (d + 1)]
                m = mask[t]
                dn = dh * m
                dz, dc = dn * (h - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
                dr = dc * rec * r * (1 - r)
                dx[t, :, 3 * H * d : 3 * H * (d + 1)] = np.concatenate([dz, dr, dc], axis=1)
                drec = np.concatenate([dz, dr, dc * r], axis=1)
                gu += h.T @ drec
                dh = dh * (1 - m) + dn * z + drec @ u.T
            g[f"u{d}"] = gu
        return g, dx

    def score(self, texts: list[str | None]) -> list[float]:
        """The largest window score of each text; an empty text is one window of no words."""
        docs = [words_of((t or "").lower()) for t in texts]
        new = list({w for words in docs for w in words if w not in self.kept})
        if self.gates is None or len(self.kept) + len(new) > len(self.gates):
            if len(self.kept) + len(new) > KEPT:
                self.kept, new = {}, list({w for words in docs for w in words})
            grown = np.zeros((max(4096, 2 * (len(self.kept) + len(new))), 6 * H), np.float32)
            if self.kept:
                grown[: len(self.kept)] = self.gates[: len(self.kept)]
            self.gates = grown
        at = len(self.kept)
        if new:
            self.gates[at : at + len(new)] = self.inputs(new)[0] @ self.p["in"] + self.p["b"]
            self.kept.update(zip(new, range(at, at + len(new)), strict=True))
        kept = self.kept
        return self._highest([np.array([kept[w] for w in words], np.int64) for words in docs])

    def _highest(self, docs: list[np.ndarray]) -> list[float]:
        """The largest window score of each array of word numbers."""
        starts = [windows(len(d)) for d in docs]
        flat = np.concatenate([*docs, np.zeros(1, np.int64)])
        base = np.cumsum([0, *[len(d) for d in docs]])
        of = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        first = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)
        size = np.minimum(WINDOW, base[of + 1] - base[of] - first)
        best = np.full(len(docs), -np.inf)
        order = np.argsort(-size, kind="stable")
        for k in range(0, len(order), CHUNK):
            own = order[k : k + CHUNK]
            steps = max(1, int(size[own].max()))
            place = (base[of[own]] + first[own])[None, :] + np.arange(steps)[:, None]
            x = self.gates[flat[np.where(np.arange(steps)[:, None] < size[own][None, :], place, 0)]]
            np.maximum.at(best, of[own], self.run(x, size[own]))
        return _sigmoid(best).tolist()


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of the rows of values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(values[order], starts, axis=0)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02, seed: int = 0) -> Network:
    """Train on whole texts by their labels: a text's loss is that of its highest window."""
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t.lower())], np.int64) for t in texts]
    if not docs or len(set(labels)) < 2:
        net.p["bias"][:] = 3.0 if labels and min(labels) == 1 else -3.0
        net.p["out"][:] = 0
        return net
    w, b, o = word_features(list(vocab))
    first = np.append(np.searchsorted(o, np.arange(len(vocab))), len(o))
    y = np.array(labels, np.float32)
    dense = [k for k in net.p if k not in ("word", "char")]
    m1, m2 = ({k: np.zeros_like(net.p[k]) for k in dense} for _ in range(2))
    ada = {k: np.full(len(net.p[k]), 1e-8, np.float32) for k in ("word", "char")}
    highest = np.zeros(len(docs), np.int64)
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(docs))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            ids = np.unique(np.concatenate([docs[i] for i in own] or [np.zeros(0, np.int64)]))
            n = first[ids + 1] - first[ids]
            at = np.repeat(first[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())
            own_chars, starts = b[at], np.cumsum(n) - n
            chars = np.add.reduceat(net.p["char"][own_chars], starts, axis=0) / n[:, None] if len(ids) else np.zeros((0, CHAR_DIM), np.float32)
            x_in = np.concatenate([net.p["word"][w[ids]], chars], axis=1).astype(np.float32)
            gates = np.concatenate([x_in @ net.p["in"] + net.p["b"], np.zeros((1, 6 * H), np.float32)])
            tok, size, of = [], [], []
            for j, i in enumerate(own):
                local = np.append(np.searchsorted(ids, docs[i]), np.full(WINDOW, len(ids)))
                for s in windows(len(docs[i])):
                    tok.append(local[s : s + WINDOW])
                    size.append(min(WINDOW, len(docs[i]) - s))
                    of.append(j)
            tok, size, of = np.array(tok), np.array(size), np.array(of)
            from_ = np.searchsorted(of, np.arange(len(own)))
            if epoch % 2 == 0:  # every other time all windows are tried for the highest
                logit = np.concatenate([net.run(gates[tok[q : q + CHUNK].T], size[q : q + CHUNK]) for q in range(0, len(tok), CHUNK)])
                by = np.lexsort((-logit, of))
                highest[own] = by[np.searchsorted(of[by], np.arange(len(own)))] - from_
            top = from_ + highest[own]
            x = gates[tok[top].T]
            logit, kept = net.run(x, size[top], back=True)
            dlogit = ((_sigmoid(logit) - y[own]) / len(own)).astype(np.float32)
            g, dx = net.gradients(x, kept, dlogit)
            hit, dgate = _sums(tok[top].T.ravel(), dx.reshape(-1, 6 * H))
            if hit[-1] == len(ids):  # the padding
                hit, dgate = hit[:-1], dgate[:-1]
            g["in"], g["b"] = x_in[hit].T @ dgate, dgate.sum(axis=0)
            dxin = dgate @ net.p["in"].T
            own_ids, n_hit = ids[hit], n[hit]
            at = np.repeat(first[own_ids] - np.cumsum(n_hit) + n_hit, n_hit) + np.arange(n_hit.sum())
            step += 1
            lr = rate * (1 - 0.9 * (epoch * len(order) + k) / (epochs * len(order)))
            for name in dense:
                m1[name] = 0.9 * m1[name] + 0.1 * g[name]
                m2[name] = 0.99 * m2[name] + 0.01 * g[name] ** 2
                net.p[name] -= lr * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-7)
            for name, rows, grad in (("word", w[own_ids], dxin[:, :WORD_DIM]), ("char", b[at], np.repeat(dxin[:, WORD_DIM:] / n_hit[:, None], n_hit, axis=0))):
                if not len(rows):
                    continue
                u, total = _sums(rows, grad)
                ada[name][u] += (total**2).mean(axis=1)
                net.p[name][u] -= 4 * lr * total / np.sqrt(ada[name][u])[:, None]
    return net


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Network:
    """Fit on at most `most` of docs(doc_id, text) that labels(doc_id, toxic) cover; of ids labelled twice the larger label holds."""
    marks = pick(labels, doc_id="long", toxic="int").filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    sizes = rows.select("doc_id", F.octet_length("text").alias("bytes")).join(marks, "doc_id")
    chosen = sizes.filter(quota(sizes, most, "toxic")).select("doc_id", "toxic").distinct().limit(2 * most)  # texts are read for these ids alone
    sample = rows.join(F.broadcast(chosen), "doc_id").orderBy(rank(), "doc_id", "text").limit(2 * most)
    return fitted(sample, lambda rows: fit([str(t) for t in rows["text"]], [int(v) for v in rows["toxic"]]))


def scorer(docs: DataFrame, net: Network):
    """A function from a text column to its score. The weights, 2.7 MB, are broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = list(texts)
            yield pd.Series([s for k in range(0, len(texts), 200) for s in held.value.score(texts[k : k + 200])], dtype="float64")

    return score


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(crc_mod(F.col("doc_id"), 5) != 0)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text, mod 5, is 0), score, predicted (score >= 0.5) of every row of docs(doc_id, text).

    The network is trained on at most `most` labelled rows that are not held out; every whole text is scored
    from its characters alone. Null and empty texts are scored as one window of no words. Without labels of
    both kinds every score is 0.05, or 0.95 if all labels are 1. Repeated rows and null ids (held out, as the
    empty text's crc32 is 0) are kept; an empty table gives an empty result; other columns are ignored.
    """
    rows = pick(docs, doc_id="long", text="string")
    score = scorer(docs, train(training_rows(rows), labels, most))
    out = rows.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose text scores below 0.5."""
    names = docs.columns
    score = scorer(docs, train(training_rows(pick(docs, doc_id="long", text="string")), labels, most))
    bare = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = bare.withColumn("score", score(F.col(f"c{names.index('text')}").cast("string"))).filter("score < 0.5")
    return kept.drop("score").toDF(*names)
