"""Language-model scores by a hierarchical Pitman-Yor model: previous word, all words, spelling.

Each word that a word follows, and a text's start, is a context with a restaurant of its own; all contexts
share one parent, the restaurant of all words, whose base is the spelling of a word's bytes (llm/spelling.py). The
end of a text is the empty word. Nothing is left out: every pair of words is counted, and every word is a
context. Numbers of tables are drawn by Gibbs sweeps from their exact law (llm/pitman_yor.py), and predictive
probabilities are averaged over the last KEEP sweeps. They sum to one over all words, known or not.

The work is laid out so that no step meets a whole corpus or a hot key:
- Texts are encoded in batches. Pairs of two of the HOT most frequent words are counted within their batch and
  dealt as one packed row for each batch and part; a part adds up its pairs of all batches. However frequent a pair, a
  part has it once a batch. The answer, the log10 of each pair's probability, goes back to the batch.
- Pairs of a hot and another word (the sides) go the same way: dealt in packed rows by the other word's hash to parts, which also get
  that word's state. Only pairs of two words that are not hot are rows of a Spark table and meet the words' state by joins.
- A drawn number depends on the hash of its words and the sweep alone, so it is the same wherever it is drawn,
  and HOT decides which way a pair takes, not what it scores.
Words are told apart by 64-bit hashes (llm/words.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemill.llm.common import arrays, crc_mod, few, forget, give_back, pick, settle
from slidemill.llm.pitman_yor import discount_of, draw_tables, gamma, mixed, uniform
from slidemill.llm.spelling import spelling
from slidemill.llm.words import Lookup, joined, pack, unpack, word_hashes

#: Most frequent words, whose state is broadcast; all others are joined by shuffle.
HOT = 262_144
THETA_WORDS, THETA_PAIRS = 2.0, 1.0
SWEEPS, KEEP = 4, 2
#: Bytes of text and rows of a batch, and pairs that a part counts and that a side's part does, about.
BATCH_BYTES, BATCH_ROWS, PART, SIDE = 4_000_000, 20_000, 1_500_000, 500_000
#: Texts that a Python worker is handed at once.
TEXTS_AT_ONCE = 2500
#: Pairs of a part that are scored at once.
PAIRS_AT_ONCE = 200_000
#: Stand-ins for hashes: the start of a text, and its end.
START, END = 1, 2
ID_BITS = 20


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def word_counts(train: DataFrame) -> DataFrame:
    """word, h, c over all texts of train(text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch, 2 * BATCH_BYTES):
                data, _ = joined(part["text"].tolist())
                h, a, b = word_hashes(data)
                order = np.argsort(h)
                h = h[order]
                new = np.flatnonzero(np.diff(h, prepend=~h[:1]))
                first, n = order[new], np.diff(np.append(new, len(h)))
                found = pd.DataFrame({"word": [data[i:j] for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True)], "h": _signed(h[new]), "c": n.astype(np.int64)})
                del part, data, h, a, b, order, new, first, n
                give_back()
                yield found

    return train.select("text").mapInPandas(count, "word binary, h long, c long").groupBy("word", "h").agg(F.sum("c").alias("c"))


def _slices(batch: pd.DataFrame, most: int = BATCH_BYTES) -> Iterator[pd.DataFrame]:
    """Runs of rows of about so many bytes of text; a longer text is a run of its own."""
    size = batch["text"].map(lambda t: len(t) if t else 0).to_numpy(np.int64)
    at = 0
    while at < len(batch):
        n = max(1, int(np.searchsorted(np.cumsum(size[at : at + BATCH_ROWS]), most, "right")))
        yield batch.iloc[at : at + n]
        at += n


def least_hot(vocabulary: DataFrame, most: int) -> int:
    """The least count c at which no more than `most` words of vocabulary(c) have that count; counts over 4,096 are told apart by 64 steps an octave."""
    step = F.when(F.col("c") <= 4096, F.col("c")).otherwise(4096 + F.ceil(64 * F.log2(F.col("c") / 4096)).cast("long"))
    least, total = None, 0
    for _, n, c in sorted(map(tuple, vocabulary.groupBy(step.alias("step")).agg(F.count("*"), F.min("c")).collect()), reverse=True):
        if (total := total + n) > most:
            break
        least = c
    return least if least is not None else np.iinfo(np.int64).max


@dataclass
class Hot:
    """The hot words in order of hash, the start and the end among them: hashes, counts, spelling; and their customers and tables as words and tables as contexts after each sweep."""

    h: np.ndarray
    c: np.ndarray
    base: np.ndarray
    customers: list[np.ndarray]
    tables: list[np.ndarray]
    seats: list[np.ndarray]


@dataclass
class Law:
    """Discounts; and all words' customers and tables after each sweep."""

    d_words: float
    d_pairs: float
    customers: list[int]
    tables: list[int]

    def word(self, c: np.ndarray, t: np.ndarray, base: np.ndarray, sweep: int) -> np.ndarray:
        """Probability of words by themselves; base: that of their spelling."""
        back = (THETA_WORDS + self.d_words * self.tables[sweep]) / (THETA_WORDS + self.customers[sweep])
        return np.maximum(c - self.d_words * t, 0) / (THETA_WORDS + self.customers[sweep]) + back * base

    def spread(self, seats: np.ndarray, h: np.ndarray, sweep: int) -> np.ndarray:
        """The auxiliary number of contexts with so many tables, in the sweep after."""
        return gamma(THETA_PAIRS / self.d_pairs + seats, h, 2 * sweep)

    def draw(self, c: np.ndarray, spread: np.ndarray, p: np.ndarray, h: np.ndarray, sweep: int) -> np.ndarray:
        return draw_tables(c, self.d_pairs * spread * p, self.d_pairs, uniform(h, 2 * sweep + 1))

    def pair(self, c: np.ndarray, t: np.ndarray, context: np.ndarray, seats: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probability of a word after a context of so many customers and tables; p: that of the word by itself."""
        return (np.maximum(c - self.d_pairs * t, 0) + (THETA_PAIRS + self.d_pairs * seats) * p) / (THETA_PAIRS + context)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64), 7)


def encode(rows: DataFrame, hot_h: np.ndarray, log_base: np.ndarray, known: np.ndarray, parts: int, sides: int) -> DataFrame:
    """batch, part, blobs of rows(doc_id, text, held_out).

    Part -1: the batch itself; a run of each pair of hot words, the rows it occurs in, and the rows' ids, held_out, tokens,
    known tokens and base; the runs and rows of the pairs of either side. Part -2: tokens that are not hot after such. Part -3: words of held-out texts that
    are not hot. From 0: the part's pairs in order, and how often each occurs in training. From `parts`: the sides, first hot contexts of other words, then, `sides`
    parts on, hot words after other contexts: the other words' hashes in order, the hot words' places and how often each pair occurs in training.
    """
    held = rows.sparkSession.sparkContext.broadcast((hot_h, log_base, known))

    def packed(rows: pd.DataFrame, name: int, find: Lookup) -> list[tuple[int, int, list[bytes]]]:
        hot, base, known = held.value
        start_id, end_id = np.searchsorted(hot, np.array([START, END], np.uint64)).tolist()
        n = len(rows)
        data, begin = joined(rows["text"].tolist())
        h, a, b = word_hashes(data)
        own = (np.searchsorted(begin, a, "right") - 1).astype(np.int32)
        count = np.bincount(own, minlength=n)
        ids = find(h).astype(np.int32)
        out = rows["held_out"].to_numpy(bool)
        asked = np.flatnonzero((ids < 0) & out[own])
        asked = asked[np.unique(h[asked], return_index=True)[1]]
        found = [(name, -3, [h[asked].tobytes(), *[data[i:j] for i, j in zip(a[asked].tolist(), b[asked].tolist(), strict=True)]])]
        del data, a, b, asked
        stop = np.cumsum(count) + np.arange(n)
        doc = np.repeat(np.arange(n, dtype=np.int32), count + 1)
        at = np.arange(len(h)) + own
        w, wid = np.full(len(doc), END, np.uint64), np.full(len(doc), end_id, np.int32)
        w[at], wid[at] = h, ids
        u, uid = np.full(len(doc), START, np.uint64), np.full(len(doc), start_id, np.int32)
        rest = np.delete(np.arange(len(doc)), stop - count)
        u[rest], uid[rest] = w[rest - 1], wid[rest - 1]
        del at, rest, h, ids, own
        met = wid >= 0
        sums = np.bincount(doc[met], base[wid[met]], minlength=n)
        n_known = np.bincount(doc[met], known[wid[met]], minlength=n).astype(np.int64)

        other = np.flatnonzero(~met & (uid < 0))
        found.append((name, -2, [u[other].tobytes(), w[other].tobytes(), pack(doc[other]), pack(out[doc[other]].astype(np.int64))]))
        turns = []
        for side, some, x, y in ((0, ~met & (uid >= 0), w, uid), (1, met & (uid < 0), u, wid)):
            some = np.flatnonzero(some)
            some = some[np.lexsort((y[some], x[some]))]
            x, y, docs = x[some], y[some], doc[some]
            new = _first(x, y)
            trained = np.add.reduceat((~out)[docs].astype(np.int64), new) if len(new) else new
            turns += [pack(np.diff(np.append(new, len(x)))), pack(docs)]
            x, y = x[new], y[new]
            part = ((x >> np.uint64(32)) * np.uint64(sides) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1, append=sides))
            found += [(name, parts + side * sides + int(part[i]), [x[i:j].tobytes(), pack(y[i:j]), pack(trained[i:j])]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

        both = np.flatnonzero(met & (uid >= 0))
        key = (uid[both].astype(np.int64) << ID_BITS) + wid[both]
        doc = doc[both]
        del u, uid, w, wid, met, both
        key += (mixed(key) % np.uint64(parts)).astype(np.int64) << 2 * ID_BITS
        order = np.argsort(key)
        key, docs = key[order], doc[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        runs = np.diff(np.append(new, len(key)))
        trained = np.add.reduceat((~out)[docs].astype(np.int64), new) if len(new) else new
        key = key[new]
        part = key >> 2 * ID_BITS
        key &= (1 << 2 * ID_BITS) - 1
        cut = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
        found += [(name, int(part[i]), [pack(np.diff(key[i:j], prepend=0)), pack(trained[i:j])]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        doc_id = rows["doc_id"]
        found.append((name, -1, [pack(runs), pack(docs), doc_id.fillna(0).to_numpy(np.int64).tobytes(), pack(doc_id.isna().to_numpy(np.int64)), pack(out.astype(np.int64)), pack(count + 1), pack(n_known), sums.tobytes(), *turns]))
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, number = Lookup(held.value[0]), 0
        for batch in batches:
            for rows in _slices(batch):
                found = packed(rows, (TaskContext.get().partitionId() << 32) + number, find)
                number += 1
                give_back()
                yield pd.DataFrame(found, columns=["batch", "part", "blobs"])

    return rows.select("doc_id", "text", "held_out").mapInPandas(run, "batch long, part int, blobs array<binary>")


def _first(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the first of each pair of x and y, which are in order."""
    return np.flatnonzero((np.diff(x, prepend=~x[:1]) != 0) | (np.diff(y, prepend=-1) != 0))


def _pairs_of(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unpack(blobs[0])), unpack(blobs[1])


def _added(requests: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """A part's distinct pairs, how often each occurs in training, the place of each asked pair, and how many each row asks."""
    each = [_pairs_of(b) for b in requests["blobs"]]
    keys, n = np.concatenate([k for k, _ in each]), np.concatenate([n for _, n in each])
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, n, minlength=len(keys)).astype(np.int64), place, [len(k) for k, _ in each]


def _tally(kind: int, ids: np.ndarray, n: np.ndarray | None = None) -> tuple[int, list[bytes]]:
    total = np.bincount(ids, n)
    some = np.flatnonzero(total)
    return kind, [pack(some), pack(total[some].astype(np.int64))]


def _side_added(requests: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The same of a side's part, whose pairs are of hashes and places."""
    each = [(np.frombuffer(b[0], np.uint64), unpack(b[1]).astype(np.int32), unpack(b[2])) for b in requests["blobs"]]
    x, y, n = (np.concatenate(k) for k in zip(*each, strict=True))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = _first(x, y)
    place = np.empty(len(x), np.int64)
    place[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(x))))
    return x[new], y[new], np.add.reduceat(n[order], new) if len(new) else n, place, [len(k[0]) for k in each]


def count_pairs(requests: DataFrame) -> DataFrame:
    """kind, blobs for each part: 0, the pairs met twice or more in training and how often; 1 and 2, contexts and words and how many distinct pairs each has; 3, how many pairs are met once and twice."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        keys, c, _, _ = _added(rows)
        keys, c = keys[c > 0], c[c > 0]
        more = c > 1
        out = [(0, [pack(np.diff(keys[more], prepend=0)), pack(c[more])]), _tally(1, keys >> ID_BITS), _tally(2, keys & (1 << ID_BITS) - 1), (3, [pack(np.arange(2)), pack(np.array([(c == 1).sum(), (c == 2).sum()]))])]
        give_back()
        return pd.DataFrame(out, columns=["kind", "blobs"])

    return requests.groupBy("part").applyInPandas(count, "kind int, blobs array<binary>")


def count_sides(requests: DataFrame, second: int) -> DataFrame:
    """The same of the sides' parts, the second side's from `second` on. 0: of pairs met twice or more the side, the other words' hashes, the hot words' places, how often; 4: the side, the other words' hashes, how many distinct pairs each has."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        side = int(rows["part"].iloc[0] >= second)
        x, y, c, _, _ = _side_added(rows)
        x, y, c = x[c > 0], y[c > 0], c[c > 0]
        more = c > 1
        each, n = np.unique(x, return_counts=True)
        out = [(0, [bytes([side]), x[more].tobytes(), pack(y[more]), pack(c[more])]), (4, [bytes([side]), each.tobytes(), pack(n)]), _tally(1 + side, y), (3, [pack(np.arange(2)), pack(np.array([(c == 1).sum(), (c == 2).sum()]))])]
        give_back()
        return pd.DataFrame(out, columns=["kind", "blobs"])

    return requests.groupBy("part").applyInPandas(count, "kind int, blobs array<binary>")


def _side_pairs(counted: DataFrame, hot_h: np.ndarray) -> DataFrame:
    """u, w, uid, wid, c: a row for each pair of a side that is met twice or more in training."""
    held = counted.sparkSession.sparkContext.broadcast(hot_h)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["blobs"]:
                x, y, c = np.frombuffer(b[1], np.int64), unpack(b[2]), unpack(b[3])
                rare, hot = (x, np.full(len(x), -1)), (held.value[y].view(np.int64), y)
                u, w = (rare, hot) if b[0][0] else (hot, rare)
                for at in range(0, len(x), PAIRS_AT_ONCE):
                    some = slice(at, at + PAIRS_AT_ONCE)
                    yield pd.DataFrame({"u": u[0][some], "w": w[0][some], "uid": u[1][some], "wid": w[1][some], "c": c[some]})

    return counted.filter("kind = 0").mapInPandas(spread, "u long, w long, uid int, wid int, c long")


def _side_sizes(counted: DataFrame) -> DataFrame:
    """h, customers, seats: the distinct pairs that a word that is not hot has with hot contexts, and as a context with hot words."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["blobs"]:
                h, n = np.frombuffer(b[1], np.int64), unpack(b[2])
                yield pd.DataFrame({"h": h, "customers": n * (b[0][0] == 0), "seats": n * (b[0][0] == 1)})

    return counted.filter("kind = 4").mapInPandas(spread, "h long, customers long, seats long")


def _summed(tallies: DataFrame, n: int, kinds: tuple[int, ...]) -> list[np.ndarray]:
    """Of each kind of tallies(kind, blobs), an array of n sums."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, blobs in zip(batch["kind"], batch["blobs"], strict=True):
                yield pd.DataFrame({"kind": kind, "id": unpack(blobs[0]), "n": unpack(blobs[1])})

    return _sums(tallies.mapInPandas(spread, "kind int, id long, n long"), n, kinds)


def _sums(rows: DataFrame, n: int, kinds: tuple[int, ...]) -> list[np.ndarray]:
    """The same of rows(kind, id, n)."""
    found = arrays(rows.groupBy("kind", "id").agg(F.sum("n").alias("n")))  # n ids at most of each kind
    return [np.bincount(found["id"][found["kind"] == k], found["n"][found["kind"] == k], minlength=n).astype(np.int64) for k in kinds]


def hot_sweep(pairs: DataFrame, hot: Hot, law: Law, sweep: int) -> list[np.ndarray]:
    """Of each hot word, as context and as word, the tables beyond the first that its pairs have in this sweep."""
    p = law.word(hot.customers[-1], hot.tables[-1], hot.base, sweep)
    held = pairs.sparkSession.sparkContext.broadcast((hot.h, law.spread(hot.seats[-1], hot.h, sweep), p))

    def swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, spread, p = held.value
        total = np.zeros((2, len(h)), np.int64)
        for batch in batches:
            for blobs in batch["blobs"]:
                key, c = _pairs_of(blobs)
                u, w = key >> ID_BITS, key & (1 << ID_BITS) - 1
                more = law.draw(c, spread[u], p[w], pair_hash(h[u], h[w]), sweep) - 1
                some = np.flatnonzero(more)
                np.add.at(total[0], u[some], more[some])
                np.add.at(total[1], w[some], more[some])
        kind, at = np.nonzero(total)
        yield pd.DataFrame({"kind": kind + 1, "id": at, "n": total[kind, at]})

    return _sums(pairs.mapInPandas(swept, "kind int, id long, n long"), len(hot.h), (1, 2))


def _others(blocks: DataFrame) -> DataFrame:
    """batch, doc, held, u, w: a row for each token that is not hot and follows one that is not."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, b in zip(batch["batch"], batch["blobs"], strict=True):
                yield pd.DataFrame({"batch": name, "doc": unpack(b[2]), "held": unpack(b[3]) > 0, "u": np.frombuffer(b[0], np.int64), "w": np.frombuffer(b[1], np.int64)})

    return blocks.filter("part = -2").mapInPandas(spread, "batch long, doc int, held boolean, u long, w long")


def _asked(blocks: DataFrame) -> DataFrame:
    """h, word: the words of held-out texts that are not hot, each once."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["blobs"]:
                yield pd.DataFrame({"h": np.frombuffer(b[0], np.int64), "word": list(b[1:])})

    return blocks.filter("part = -3").mapInPandas(spread, "h long, word binary").groupBy("h").agg(F.min("word").alias("word"))


def sampled(hot: Hot, law: Law, pairs: DataFrame, rare_pairs: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run the sweeps: hot and law take their states; words(h, c, base, customers, tables, seats), those that are not hot, comes back with arrays of the last three after each sweep: what was settled of it, and all.

    Words met once have one customer, table and seat after every sweep and are in no pair met twice, so they are left out of the sweeps' joins.
    pairs: packed, of two hot words; rare_pairs(u, w, uid, wid, c): all others met twice or more.
    """
    still = words.filter("c = 1")
    fixed = still.count()
    words = words.filter("c > 1")
    for sweep in range(SWEEPS):
        one, two = hot_sweep(pairs, hot, law, sweep)
        now = words.select("h", F.element_at("customers", -1).alias("customers"), F.element_at("tables", -1).alias("tables"), F.element_at("seats", -1).alias("seats"), "base")
        asked = rare_pairs.join(now.select(F.col("h").alias("u"), "seats"), "u", "left").join(now.select(F.col("h").alias("w"), "customers", "tables", "base"), "w", "left")
        held = words.sparkSession.sparkContext.broadcast((hot.seats[-1], law.word(hot.customers[-1], hot.tables[-1], hot.base, sweep)))

        def swept(batches: Iterator[pd.DataFrame], held=held, sweep=sweep) -> Iterator[pd.DataFrame]:
            seats, p = held.value
            for b in batches:
                u, w, uid, wid = (b[k].to_numpy(np.int64) for k in ("u", "w", "uid", "wid"))
                own = law.word(b["customers"].to_numpy(float), b["tables"].to_numpy(float), b["base"].to_numpy(float), sweep)
                spread = law.spread(np.where(uid >= 0, seats[uid], b["seats"].to_numpy(float)), u.view(np.uint64), sweep)
                more = law.draw(b["c"].to_numpy(np.int64), spread, np.where(wid >= 0, p[wid], own), pair_hash(u.view(np.uint64), w.view(np.uint64)), sweep) - 1
                some = more > 0
                yield pd.DataFrame({"h": np.concatenate([u[some], w[some]]), "kind": np.repeat([1, 2], some.sum()), "n": np.tile(more[some], 2), "hot": np.concatenate([uid[some] >= 0, wid[some] >= 0])})

        more = settle(asked.mapInPandas(swept, "h long, kind int, n long, hot boolean").groupBy("h", "kind", "hot").agg(F.sum("n").alias("n")), "more")
        found = arrays(more.filter("hot").select("h", "kind", "n"))
        at = np.searchsorted(hot.h, found["h"].view(np.uint64))
        for kind, total in ((1, one), (2, two)):
            np.add.at(total, at[found["kind"] == kind], found["n"][found["kind"] == kind])
        hot.seats.append(hot.seats[0] + one)
        customers = hot.customers[0] + two

        x = law.d_words * np.random.default_rng(sweep).gamma(THETA_WORDS / law.d_words + law.tables[-1])
        hot.customers.append(customers)
        hot.tables.append(draw_tables(customers, x * hot.base, law.d_words, uniform(hot.h, -2 - sweep)))
        mine = more.filter("not hot").groupBy("h").agg(F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("one"), F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("two"))
        grown = words.join(mine, "h", "left").withColumns({"c1": F.col("customers")[0] + F.coalesce("two", F.lit(0)), "s1": F.col("seats")[0] + F.coalesce("one", F.lit(0))}).drop("one", "two")

        def seated(batches: Iterator[pd.DataFrame], x=x, sweep=sweep) -> Iterator[pd.DataFrame]:
            for b in batches:
                h = b["h"].to_numpy(np.int64).view(np.uint64)
                yield b.assign(t1=draw_tables(b["c1"].to_numpy(np.int64), x * b["base"].to_numpy(), law.d_words, uniform(h, -2 - sweep)))

        after = grown.mapInPandas(seated, ", ".join(f"{k} {t}" for k, t in [*grown.dtypes, ("t1", "long")]))
        grow = lambda k, new: F.concat(k, F.array(new)).alias(k)
        before, words = words, settle(after.select("h", "c", "base", grow("customers", "c1"), grow("tables", "t1"), grow("seats", "s1")), "words")
        forget(before, more)
        total = words.agg(F.sum(F.element_at("customers", -1)), F.sum(F.element_at("tables", -1))).first()
        law.customers.append(int(customers.sum() + (total[0] or 0)) + fixed)
        law.tables.append(int(hot.tables[-1].sum() + (total[1] or 0)) + fixed)
    ones = F.array_repeat(F.lit(1).cast("long"), SWEEPS + 1)
    return words, words.unionByName(still.select("h", "c", "base", ones.alias("customers"), ones.alias("tables"), ones.alias("seats")))


def _mean(law: Law, c: np.ndarray, context: np.ndarray, h: np.ndarray, states: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """log10 of the mean probability of pairs. states, for each kept sweep: the context's tables before and after it, the word's probability before and after it."""
    total = np.zeros(len(c))
    for k, (seats_before, seats, p_before, p) in enumerate(states):
        sweep = SWEEPS - KEEP + k
        t = np.minimum(c, 1)
        more = np.flatnonzero(c > 1)
        if len(more):
            t[more] = law.draw(c[more], seats_before[more], p_before[more], h[more], sweep)
        total += law.pair(c, t, context, seats, p)
    return np.log10(np.maximum(total / KEEP, 1e-300))


def _states(hot: Hot, law: Law) -> list[tuple[np.ndarray, ...]]:
    """Of hot words, for each kept sweep: the auxiliary number as context, tables as context, probability before and after it."""
    p = [law.word(c, t, hot.base, k) for k, (c, t) in enumerate(zip(hot.customers, hot.tables, strict=True))]
    return [(law.spread(hot.seats[k], hot.h, k), hot.seats[k + 1].astype(float), p[k], p[k + 1]) for k in range(SWEEPS - KEEP, SWEEPS)]


def answer_pairs(requests: DataFrame, hot: Hot, law: Law) -> DataFrame:
    """batch, part, blobs: log10 of the probability of each asked pair of hot words, in the order asked."""
    held = requests.sparkSession.sparkContext.broadcast((hot.h, hot.c, _states(hot, law)))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        h, context, states = held.value
        keys, c, place, sizes = _added(rows)
        each = np.zeros(len(keys), np.float32)
        for at in range(0, len(keys), PAIRS_AT_ONCE):
            some = slice(at, at + PAIRS_AT_ONCE)
            u, w = keys[some] >> ID_BITS, keys[some] & (1 << ID_BITS) - 1
            each[some] = _mean(law, c[some], context[u], pair_hash(h[u], h[w]), [(a[u], b[u], p[w], q[w]) for a, b, p, q in states])
        score = each[place]
        out = pd.DataFrame({"batch": rows["batch"], "part": rows["part"], "blobs": [[x.tobytes()] for x in np.split(score, np.cumsum(sizes)[:-1])]})
        del keys, c, place, each, score
        give_back()
        return out

    return requests.groupBy("part").applyInPandas(answer, "batch long, part int, blobs array<binary>")


def word_states(words: DataFrame, law: Law) -> DataFrame:
    """h, c of words that are not hot, and p2, s2, ...: probability and tables as context before and after each kept sweep."""
    at = range(SWEEPS - KEEP, SWEEPS + 1)

    def stated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = b["base"].to_numpy()
            for k in at:
                b[f"p{k}"] = law.word(b[f"c{k}"].to_numpy(), b[f"t{k}"].to_numpy(), s, k)
            yield b[["h", "c", *[f"p{k}" for k in at], *[f"s{k}" for k in at]]]

    flat = words.select("h", "c", "base", *[F.col(name)[k].alias(f"{short}{k}") for k in at for name, short in (("customers", "c"), ("tables", "t"), ("seats", "s"))])
    return settle(flat.mapInPandas(stated, "h long, c long, " + ", ".join(f"p{k} double" for k in at) + ", " + ", ".join(f"s{k} long" for k in at)), "word-states")


def answer_sides(requests: DataFrame, states: DataFrame, hot: Hot, law: Law, parts: int, sides: int) -> list[DataFrame]:
    """For each side batch, part, blobs: log10 of the probability of each asked pair, in the order asked; and how often a word that is not hot occurs in training."""
    at = range(SWEEPS - KEEP, SWEEPS + 1)
    held = requests.sparkSession.sparkContext.broadcast((hot.h, hot.c, hot.seats[SWEEPS - KEEP :], [law.word(hot.customers[k], hot.tables[k], hot.base, k) for k in at]))

    def answer(rows: pd.DataFrame, states: pd.DataFrame, side: int) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"batch": [], "part": [], "blobs": pd.Series([], dtype=object)})
        hot_h, hot_c, hot_seats, hot_p = held.value
        x, y, c, place, sizes = _side_added(rows)
        h = states["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        own = order[np.searchsorted(h, x, sorter=order)]  # each is there: words of all texts have a state
        count = states["c"].to_numpy(np.int64)
        mine = [states[f"{'ps'[side]}{k}"].to_numpy(float) for k in at]
        each = np.zeros(len(x))
        for first in range(0, len(x), PAIRS_AT_ONCE):
            some = slice(first, first + PAIRS_AT_ONCE)
            i, j = own[some], y[some]
            u, w = (x[some], hot_h[j]) if side else (hot_h[j], x[some])
            seats, p = ([k[i] for k in mine], [k[j] for k in hot_p]) if side else ([k[j].astype(float) for k in hot_seats], [k[i] for k in mine])
            kept = [(law.spread(seats[k], u, SWEEPS - KEEP + k), seats[k + 1], p[k], p[k + 1]) for k in range(KEEP)]
            each[some] = _mean(law, c[some], (count[i] if side else hot_c[j]).astype(float), pair_hash(u, w), kept)
        cut = np.cumsum(sizes)[:-1]
        blobs = [[k.tobytes()] for k in np.split(each[place], cut)]
        if not side:
            blobs = [[*b, pack(k)] for b, k in zip(blobs, np.split(count[own][place], cut), strict=True)]
        out = pd.DataFrame({"batch": rows["batch"], "part": rows["part"], "blobs": blobs})
        del x, y, c, place, h, order, own, count, mine, each
        give_back()
        return out

    def of_side(side: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        return lambda rows, states: answer(rows, states, side)

    out = []
    for side, name in enumerate("ps"):
        first = parts + side * sides
        mine = requests.filter(F.col("part").between(first, first + sides - 1))
        part = (F.lit(first) + F.shiftright(F.shiftrightunsigned("h", 32) * F.lit(sides).cast("long"), 32)).cast("int")
        dealt = states.select(part.alias("part"), "h", "c", *[f"{name}{k}" for k in at])
        out.append(settle(mine.groupBy("part").cogroup(dealt.groupBy("part")).applyInPandas(of_side(side), "batch long, part int, blobs array<binary>"), "side-answers", large=True))
    return out


def answer_others(others: DataFrame, rare_counts: DataFrame, states: DataFrame, law: Law, base: Column) -> DataFrame:
    """batch, doc, model, base, known: sums over the tokens of others. base: log10 of a word's share from its count wc."""
    at = range(SWEEPS - KEEP, SWEEPS + 1)
    p, seats = [f"p{k}" for k in at], [f"s{k}" for k in at]
    rows = others.join(rare_counts.select("u", "w", F.col("c").alias("n")), ["u", "w"], "left")
    rows = rows.join(states.select(F.col("h").alias("w"), F.col("c").alias("wc"), *p), "w", "left").join(states.select(F.col("h").alias("u"), F.col("c").alias("uc"), *seats), "u", "left")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u, w = (b[k].to_numpy(np.int64).view(np.uint64) for k in ("u", "w"))
            seats_, p_ = ([b[f"{name}{k}"].fillna(0).to_numpy(float) for k in at] for name in "sp")
            kept = [(law.spread(seats_[i], u, k), seats_[i + 1], p_[i], p_[i + 1]) for i, k in enumerate(at[:-1])]
            score = _mean(law, b["n"].fillna(0).to_numpy(np.int64), b["uc"].fillna(0).to_numpy(float), pair_hash(u, w), kept)
            yield pd.DataFrame({"batch": b["batch"], "doc": b["doc"], "score": score, "wc": b["wc"].astype("Int64")})

    each = rows.mapInPandas(scored, "batch long, doc int, score double, wc long")
    return settle(each.groupBy("batch", "doc").agg(F.sum("score").alias("model"), F.sum(base).alias("base"), F.count_if(F.col("wc") > 0).alias("known")), "others")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text, mod 7, is 2), n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    Texts are lower-cased in A to Z; tokens are runs of what is no ASCII white space, then one end. Null and
    empty texts are the end alone. base_score sums log10((c + 1) / (N + V + 1)) over tokens, score is the
    model's log10 probability of the tokens. Learning takes all texts that are not held out; with none, the
    model is the spelling's even share. Repeated rows and null ids (not held out) are kept; an empty table gives an empty
    result; other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id="long", text="string").withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2)
    train = rows.filter("not held_out")
    n_train = train.count()
    vocabulary = settle(word_counts(train), "vocabulary", TEXTS_AT_ONCE)
    n_words, n_types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, types = n_words + n_train, n_types + (n_train > 0)
    share = lambda c: F.log10((c + 1) / F.lit(float(tokens + types + 1)))

    # every word once, the end as the empty one
    ends = few(spark, [(b"", END, n_train)] if n_train else [], word=pa.binary(), h=pa.int64(), c=pa.int64())
    named = vocabulary.unionByName(ends)
    spelled = spelling(named.select("word"))
    cut = least_hot(vocabulary, HOT)
    is_hot = F.col("h").isin(START, END) | (F.col("c") >= cut)
    frequent = arrays(vocabulary.filter(F.col("c") >= cut).select("h", "c"))  # HOT at most
    hot_h = np.append(np.array([START, END], np.uint64), frequent["h"].astype(np.int64).view(np.uint64))
    order = np.argsort(hot_h)
    hot_h, hot_c = hot_h[order], np.append([n_train, n_train], frequent["c"]).astype(np.int64)[order]
    log_base = np.log10((hot_c + 1) / (tokens + types + 1))

    parts = 1 + int(tokens * 7 / 6) // PART
    sides = 1 + int((n_words - int(frequent["c"].sum())) * 7 / 6) // SIDE
    blocks = settle(encode(rows, hot_h, log_base, (hot_c > 0).astype(np.int64), parts, sides), "blocks", TEXTS_AT_ONCE, large=True)
    requests, aside = blocks.filter(F.col("part").between(0, parts - 1)), blocks.filter(F.col("part") >= parts)
    counted = settle(count_pairs(requests), "pairs", large=True)
    counted_aside = settle(count_sides(aside, parts + sides), "side-pairs", large=True)
    others = _others(blocks)
    rare_counts = settle(others.filter("not held").groupBy("u", "w").agg(F.count("*").alias("c")), "rare-pairs")

    # each word's distinct pairs, as word and as context: its first customers and tables
    zero = F.lit(0).cast("long")
    own = spelled.met(named).select("h", "c", F.pow(F.lit(10.0), "base").alias("base"), zero.alias("customers"), zero.alias("seats"))
    one = lambda k, a, b: rare_counts.groupBy(F.col(k).alias("h")).agg(F.count("*").alias(a)).select("h", F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("base"), F.col(a), zero.alias(b))
    aside_too = _side_sizes(counted_aside).select("h", F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("base"), "customers", "seats")
    state = own.unionByName(one("w", "customers", "seats")).unionByName(one("u", "seats", "customers")).unionByName(aside_too)
    state = settle(state.groupBy("h").agg(*[F.max(k).alias(k) for k in ("c", "base")], *[F.sum(k).alias(k) for k in ("customers", "seats")]), "word-counts")
    forget(vocabulary)
    hot_rows = arrays(state.filter(is_hot).select("h", F.coalesce("base", F.lit(0.0)).alias("base"), "customers", "seats"))  # HOT + 2 at most
    at = np.searchsorted(hot_h, hot_rows["h"].astype(np.int64).view(np.uint64))
    tallies = counted.unionByName(counted_aside)
    seats, customers = _summed(tallies.filter("kind in (1, 2)"), len(hot_h), (1, 2))
    base = np.zeros(len(hot_h))
    base[at] = hot_rows["base"]
    if not n_train:
        base[np.searchsorted(hot_h, np.uint64(END))] = 10.0 ** spelled.unmet(few(spark, [(b"",)], word=pa.binary())).first()["base"]
    np.add.at(customers, at, hot_rows["customers"])
    np.add.at(seats, at, hot_rows["seats"])
    hot = Hot(hot_h, hot_c, base, [customers], [np.minimum(customers, 1)], [seats])

    once, twice = _summed(tallies.filter("kind = 3"), 2, (3,))[0].tolist()
    few_rare = rare_counts.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    rare = state.filter(~is_hot)
    size = rare.agg(F.count_if(F.col("customers") == 1), F.count_if(F.col("customers") == 2), F.coalesce(F.sum("customers"), F.lit(0)), F.count("*")).first()
    d_words = discount_of(size[0] + int((customers == 1).sum()), size[1] + int((customers == 2).sum()))
    law = Law(d_words, discount_of(once + few_rare[0], twice + few_rare[1]), [int(size[2] + customers.sum())], [int(size[3] + hot.tables[0].sum())])
    first = lambda k: F.array(k).alias(k)
    rare = rare.select("h", "c", "base", first("customers"), F.array(F.lit(1).cast("long")).alias("tables"), first("seats"))
    both_rare = rare_counts.filter("c > 1").select("u", "w", F.lit(-1).alias("uid"), F.lit(-1).alias("wid"), "c")
    again = settle(_side_pairs(counted_aside, hot_h).unionByName(both_rare), "pairs-again")
    words_sampled, words = sampled(hot, law, counted.filter("kind = 0"), again, rare)

    forget(counted, counted_aside, again)

    # words of held-out texts alone are spelled; they have no customers
    none = F.array(*[zero] * (SWEEPS + 1))
    new = settle(_asked(blocks).join(words, "h", "left_anti"), "unknown")
    unknown = spelled.unmet(new.select("h", "word")).select("h", zero.alias("c"), F.pow(F.lit(10.0), "base").alias("base"), none.alias("customers"), none.alias("tables"), none.alias("seats"))
    states = word_states(words.unionByName(unknown), law)
    forget(words_sampled, state, new)
    extra = answer_others(others, rare_counts, states, law, share(F.col("wc")))
    forget(rare_counts)
    one, two = answer_sides(aside, states, hot, law, parts, sides)
    forget(states)
    replies = answer_pairs(requests, hot, law).unionByName(one).unionByName(two).unionByName(blocks.filter("part = -1"))

    def gathered(own: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("part")
        answered = lambda first, n: [b for p, b in zip(own["part"], own["blobs"], strict=True) if first <= p < first + n]
        batch = next(b for p, b in zip(own["part"], own["blobs"], strict=True) if p == -1)
        answers = [np.frombuffer(b[0], np.float32) for b in answered(0, parts)]
        runs, at = unpack(batch[0]), unpack(batch[1])
        ids, none, out, n, known = np.frombuffer(batch[2], np.int64), unpack(batch[3]), *(unpack(b) for b in batch[4:7])
        model = np.bincount(at, np.repeat(np.concatenate(answers).astype(np.float64), runs), minlength=len(ids)) if answers else np.zeros(len(ids))
        base, known = np.frombuffer(batch[7]).copy(), known.copy()
        for side in range(2):
            if answers := answered(parts + side * sides, sides):
                runs, at = unpack(batch[8 + 2 * side]), unpack(batch[9 + 2 * side])
                model += np.bincount(at, np.repeat(np.concatenate([np.frombuffer(b[0]) for b in answers]), runs), minlength=len(ids))
                if not side:
                    c = np.repeat(np.concatenate([unpack(b[1]) for b in answers]), runs)
                    base += np.bincount(at, np.log10((c + 1) / float(tokens + types + 1)), minlength=len(ids))
                    known += np.bincount(at, c > 0, minlength=len(ids)).astype(np.int64)
        doc = more["doc"].to_numpy(np.int64)
        np.add.at(model, doc, more["model"].to_numpy(float))
        np.add.at(base, doc, more["base"].fillna(0).to_numpy(float))
        np.add.at(known, doc, more["known"].to_numpy(np.int64))
        return pd.DataFrame({"doc_id": pd.Series(ids).astype("Int64").mask(none > 0), "held_out": out > 0, "n_tokens": n, "n_known": known, "train_tokens": int(tokens), "base_score": base, "score": model})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return replies.groupBy("batch").cogroup(extra.groupBy("batch")).applyInPandas(gathered, schema)
