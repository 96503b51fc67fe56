"""Phrases of words that stand together more often than chance gives, by hierarchical pair naming.

Texts are packed into chunks of whole pieces. A word that is frequent gets an id; then each
round replaces two adjacent frequent (k-1)-gram ids by the id of their pair, where that is frequent. A chunk counts
its words or pairs first and deals its distinct ones out by their hash, packed, one row for each part of all; a part adds up
those of all chunks and names the frequent ones. A pair that a third of all rows have is met once a chunk; the new
ids come back to the chunk as its dictionary. What isn't frequent breaks a sequence and is gone for
all longer phrases, so sequences shrink from round to round. A k-gram's pair points to its first and to its last k-1
words: cuts and subsumption follow these pointers and never look into a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from slidemill.llm.common import apart, forget, pick, settle, small_enough
from slidemill.llm.naming import LOW
from slidemill.llm.words import pack, unpack

MOST_WORDS, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Bytes of text of one chunk, over which a single piece may go; and words in whose texts one part's pairs are met, which has no more distinct ones a chunk.
CHUNK, PART = 8_000_000, 6_000_000
#: Chunks' bytes that a task holds, of all languages.
HELD = 4
#: Turns that a round takes its chunks in, by the task that packed them: a turn's old chunks go before the next one's are shuffled.
TURNS = 4
#: Languages up to which their totals are joined by broadcast.
BROADCAST = 200_000
#: Texts, and chunks, that a Python worker is handed at once.
TEXTS_AT_ONCE, CHUNKS_AT_ONCE = 1000, 2
#: Parts that a language's phrases are ranked in before its first ones are.
PARTS = 64
#: ASCII letters in lower case, separators of pieces as full stops (no word has one), tabs as spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)
_PACKED = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("seq", pa.binary())])
_WORDS = "chunk long, part int, lang string, at binary, counts binary, words array<binary>"
_NAMED_WORDS = "chunk long, at binary, names binary, lang string, words array<binary>, f binary"
_PAIRED = "chunk long, seq binary, pairs array<binary>, firsts array<long>"
_NAMED = "chunk long, at binary, names binary, a binary, b binary, f binary"


def _numbers(x: np.ndarray) -> bytes:
    return pack(x + 1)


def _sequence(x: bytes) -> np.ndarray:
    return unpack(x) - 1


def _counted(seq: np.ndarray, n: int) -> list[int]:
    return np.bincount(seq[seq >= 0], minlength=n).tolist()


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Texts to chunks of one language: distinct words, their counts, and positions in them in order, -1 where a piece ends. Only one text's words are held as such."""
    held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
    sizes: dict[str, int] = {}

    def chunk(lang: str) -> pa.RecordBatch:
        known, parts = held.pop(lang)
        sizes.pop(lang)
        seq = np.concatenate(parts)
        row = [lang], [list(known)], [_counted(seq, len(known))], [_numbers(seq)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _PACKED.types, strict=True)], schema=_PACKED)

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(FOLD)
            while raw:
                cut, size = len(raw), sizes.get(lang, 0)
                if cut > most - size:
                    at = raw.rfind(b".", 0, max(1, most - size))
                    at = raw.find(b".", most - size) if at < 0 else at
                    cut = at + 1 if at >= 0 else cut
                known, parts = held.setdefault(lang, ({}, []))
                tokens = (raw[:cut] + b".").replace(b".", b" . ").split()
                parts.append(np.fromiter((-1 if t == b"." else known.setdefault(t, len(known)) for t in tokens), np.int32, len(tokens)))
                sizes[lang] = size + cut
                raw = raw[cut:]
                if sizes[lang] >= most or raw:
                    yield chunk(lang)
                elif sum(sizes.values()) >= HELD * most:
                    yield from [chunk(x) for x in list(held)]
    yield from [chunk(x) for x in list(held)]


def _part_of(a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    z = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(20)).astype(np.int64) % parts


def _pairs(seq: np.ndarray, chunk: int, parts: int) -> dict:
    """Of a sequence of ids (-1: none) the sequence of positions in its distinct adjacent pairs, and these by part: packed with their counts, and the position of each part's first. Runs without a pair are left out."""
    both = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
    ids, local = np.unique(seq, return_inverse=True)
    pair, inverse, counts = np.unique(local[both] * len(ids) + local[both + 1], return_inverse=True, return_counts=True)
    a, b = ids[pair // len(ids)], ids[pair % len(ids)]
    part = _part_of(a, b, parts)
    order = np.argsort(part, kind="stable")  # within a part by a and b
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out = np.full(len(both) + int((np.diff(both) > 1).sum()), -1, np.int64)
    out[np.arange(len(both)) + np.r_[0, np.cumsum(np.diff(both) > 1)][: len(both)]] = place[inverse]
    a, b, counts, cuts = a[order], b[order], counts[order], np.searchsorted(part[order], np.arange(parts + 1))
    pairs = [pack(np.concatenate([np.diff(a[i:j], prepend=0), b[i:j], counts[i:j]])) if i < j else None for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return {"chunk": chunk, "seq": _numbers(out), "pairs": pairs, "firsts": cuts[:-1]}


def _replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks with their dictionaries (at: positions of frequent entries, names: their ids; both packed, by part) to chunks of pairs."""
    for b in batches:
        for chunk, seq, at, names, parts in zip(b["chunk"], b["seq"], b["at"], b["names"], b["parts"], strict=True):
            seq, at = _sequence(seq), np.concatenate([np.cumsum(unpack(x)) for x in at])
            name = np.full(max(int(seq.max(initial=-1)), int(at.max(initial=-1))) + 2, -1, np.int64)  # its last one stays -1, for seq -1
            name[at] = np.concatenate([unpack(x) for x in names])
            yield pd.DataFrame([_pairs(name[seq], int(chunk), int(parts))])


def _paired(chunks: DataFrame, replies: DataFrame, parts: int) -> DataFrame:
    """The next round's chunks. replies(chunk, at, names): what is frequent in them."""
    back = replies.groupBy("chunk").agg(F.collect_list(F.struct("at", "names")).alias("d")).select("chunk", F.col("d.at").alias("at"), F.col("d.names").alias("names"))
    given = chunks.select("chunk", "seq").join(back, "chunk").withColumn("parts", F.lit(parts))
    return settle(given.mapInPandas(_replace, _PAIRED), "pairs", CHUNKS_AT_ONCE, large=True)


def _dealt_words(packed: DataFrame, parts: int) -> DataFrame:
    """The words of packed(chunk, lang, words, counts) by part, with their positions in the chunk and counts."""

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, lang, words, counts in zip(b["chunk"], b["lang"], b["words"], b["counts"], strict=True):
                part = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % parts
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(int(chunk), k, lang, pack(np.diff(at, prepend=0)), pack(counts[at]), words[at]) for k in range(parts) if len(at := order[cuts[k] : cuts[k + 1]])]
                yield pd.DataFrame(rows, columns=["chunk", "part", "lang", "at", "counts", "words"])

    return packed.select("chunk", "lang", "words", "counts").mapInPandas(dealt, _WORDS)


def _add_up_words(dealt: DataFrame, parts: int, least: int) -> DataFrame:
    """For each chunk and part, where in the chunk its frequent words are and their ids; and, for chunk -1, each part's frequent words by language, how often they are met and their ids."""

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        out, total = [], 0
        for lang, own in rows.groupby("lang", sort=True):
            counts = [unpack(x) for x in own["counts"]]
            known = pa.array(np.concatenate(own["words"].tolist()), pa.binary()).dictionary_encode()
            place, words = known.indices.to_numpy(), known.dictionary
            f = np.bincount(place, np.concatenate(counts), minlength=len(words)).astype(np.int64)
            frequent = np.flatnonzero(f >= least)
            name = np.full(len(f), -1, np.int64)
            name[frequent] = (total + np.arange(len(frequent))) * parts + int(rows["part"].iloc[0])
            total += len(frequent)
            names, at = name[place], 0
            for chunk, where, n in zip(own["chunk"], own["at"], map(len, counts), strict=True):
                mine = names[at : at + n]
                at += n
                some = np.flatnonzero(mine >= 0)
                if len(some):
                    out.append((chunk, pack(np.diff(np.cumsum(unpack(where))[some], prepend=0)), pack(mine[some]), None, None, None))
            if len(frequent):
                out.append((-1, None, pack(name[frequent]), lang, words.take(pa.array(frequent)).to_pylist(), pack(f[frequent])))
        return pd.DataFrame(out, columns=["chunk", "at", "names", "lang", "words", "f"])

    return settle(dealt.groupBy("part").applyInPandas(added, _NAMED_WORDS), "replies")


def _counted_words(replies: DataFrame) -> DataFrame:
    """name, lang, word, f of the frequent words."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for names, lang, words, f in zip(b["names"], b["lang"], b["words"], b["f"], strict=True):
                yield pd.DataFrame({"name": unpack(names), "lang": lang, "word": [w.decode("utf-8", "surrogatepass") for w in words], "f": unpack(f)})

    return replies.filter("chunk = -1").mapInPandas(spread, "name long, lang string, word string, f long")


def _add_up(chunks: DataFrame, parts: int, least: int) -> DataFrame:
    """For each chunk and part, where in the chunk its frequent pairs are and their ids; and, for chunk -1, each part's frequent pairs, how often they are met and their ids. All are packed."""

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        each = [unpack(x).reshape(3, -1) for x in rows["pairs"]]
        a, b, n = (np.concatenate([f(x[i]) for x in each]) for i, f in enumerate((np.cumsum, np.asarray, np.asarray)))
        order = np.lexsort((b, a))
        first = np.flatnonzero(np.diff(a[order], prepend=-1) | np.diff(b[order], prepend=-1))
        f = np.add.reduceat(n[order], first)
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        frequent = np.flatnonzero(f >= least)
        name = np.full(len(f), -1, np.int64)
        name[frequent] = np.arange(len(frequent)) * parts + int(rows["part"].iloc[0])
        names, out, at = name[place], [], 0
        for chunk, begin, x in zip(rows["chunk"], rows["first"], each, strict=True):
            own = names[at : at + x.shape[1]]
            at += x.shape[1]
            some = np.flatnonzero(own >= 0)
            if len(some):
                out.append((chunk, pack(np.diff(some + begin, prepend=0)), pack(own[some]), None, None, None))
        if len(frequent):
            out.append((-1, None, pack(name[frequent]), pack(a[order][first[frequent]]), pack(b[order][first[frequent]]), pack(f[frequent])))
        return pd.DataFrame(out, columns=["chunk", "at", "names", "a", "b", "f"])

    dealt = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "firsts")).alias("part", "e")).select("chunk", "part", "e.pairs", F.col("e.firsts").alias("first")).filter("pairs is not null")
    return settle(dealt.groupBy("part").applyInPandas(added, _NAMED), "replies")


def _counted_pairs(replies: DataFrame) -> DataFrame:
    """name, a, b, f of the frequent pairs."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in zip(batch["names"], batch["a"], batch["b"], batch["f"], strict=True):
                yield pd.DataFrame(dict(zip(("name", "a", "b", "f"), map(unpack, row), strict=True)))

    return replies.filter("chunk = -1").mapInPandas(spread, "name long, a long, b long, f long")


def grams(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, chunk: int = CHUNK) -> tuple[DataFrame, list[DataFrame]]:
    """(n: lang, n of all words; for each number of words k a table of the phrases with f >= least).

    Tables have lang, name (the id), f, phrase, last (its last word); those of two words or more also a and b, the ids
    of the first and of the last k-1 words, and `firsts`, `lasts`: f of the first (last) 1, 2, ... k-1 words.
    """
    rows = pick(docs, lang="string", text="string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text is not null")
    turn = F.shiftright("chunk", LOW) % TURNS
    packed = rows.mapInArrow(lambda batches: _pack(batches, chunk), from_arrow_schema(_PACKED)).withColumn("chunk", F.monotonically_increasing_id())
    packed = settle(packed.withColumn("turn", turn), "chunks", TEXTS_AT_ONCE, large=True, by="turn")
    n = settle(packed.select("lang", F.expr("aggregate(counts, 0L, (x, y) -> x + y)").alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    none = F.array().cast("array<long>")
    parts = 1 + (n.agg(F.sum("n")).first()[0] or 0) // PART
    replies = _add_up_words(_dealt_words(packed, parts), parts, least)
    frequent = settle(_counted_words(replies), "frequent").withColumns({"phrase": F.col("word"), "last": F.col("word"), "firsts": none, "lasts": none})
    tables = [frequent]
    none_yet = docs.sparkSession.createDataFrame([], _PAIRED)
    chunks = {k: t for k in range(TURNS) for t in apart(packed, "turn", range(k, k + 1))}
    for _ in range(2, most_words + 1):
        for k, old in chunks.items():
            chunks[k] = _paired(old, replies.filter("chunk >= 0").filter(turn == k), parts)
            forget(old)
        forget(replies)
        replies = _add_up(reduce(DataFrame.unionByName, chunks.values(), none_yet), parts, least)
        known = tables[-1]
        first = known.select(F.col("name").alias("a"), "lang", F.col("phrase").alias("start"), F.concat("firsts", F.array("f")).alias("firsts"))
        rest = known.select(F.col("name").alias("b"), "last", F.concat("lasts", F.array("f")).alias("lasts"))
        found = _counted_pairs(replies).join(first, "a").join(rest, "b").withColumn("phrase", F.concat_ws(" ", "start", "last")).drop("start")
        tables.append(settle(found, "frequent"))
    forget(*chunks.values(), replies)
    return n, tables


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of docs(lang, text), as the contract states.

    share: a phrase goes if a longer candidate around it has so many hundredths of its count. As counts only fall
    with length, a longer one that does so has a part one word longer than the phrase that does, so only these are
    looked up. Null texts have no words, null languages are `und`; repeated rows count each; an empty table has no
    phrases; other columns are ignored whatever their names. Scores are whole decimals of 38 digits: beyond them, at
    some 10^17 words, Spark raises an error.
    """
    n, tables = grams(docs, most_words, least, chunk)
    big = lambda c: c.cast("decimal(20,0)")
    n = F.broadcast(n) if small_enough(n, BROADCAST) else n
    kept = None
    for k, here in enumerate(tables[1:], 2):
        cut = [
            F.struct((F.lit(1000).cast("decimal(5,0)") * big(F.col("f")) * big(F.col("n"))).cast("decimal(38,0)").alias("top"), (big(F.col("firsts")[i - 1]) * big(F.col("lasts")[k - i - 1])).cast("decimal(38,0)").alias("under"), F.lit(i).alias("cut"), F.col("firsts")[i - 1].alias("l"), F.col("lasts")[k - i - 1].alias("r"))
            for i in range(1, k)
        ]
        scored = here.join(n, "lang").select("name", "lang", "phrase", F.col("f").alias("a"), "n", F.array(*cut).alias("cuts"))
        scored = scored.withColumn("best", F.expr("array_min(transform(cuts, c -> struct(c.top div c.under as score, c.cut as cut, c.l as l, c.r as r)))"))
        rows = scored.select("name", "lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
        if k < len(tables):
            longer = tables[k].select(F.explode(F.array("a", "b")).alias("name"), "f").groupBy("name").agg(F.max("f").alias("around"))
            rows = rows.join(longer, "name", "left").filter(f"around is null or 100 * around < {int(share)} * a").drop("around")
        kept = rows.drop("name") if kept is None else kept.unionByName(rows.drop("name"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH p AS (
  SELECT k, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS j FROM (
    SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
total AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang),
place AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
gram AS (SELECT lang, words[i:i + k - 1] AS g, k, count(*)::HUGEINT AS f FROM place, (SELECT unnest(range(1, {MOST_WORDS + 1})) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= {LEAST}),
cut AS (
  SELECT x.lang, x.g, x.k, x.f AS a, c.k AS cut, c.f AS l, r.f AS r, n, (1000 * x.f * n) // (c.f * r.f) AS score
  FROM gram x JOIN total USING (lang) JOIN gram c ON c.lang = x.lang AND c.k < x.k AND c.g = x.g[1:c.k] JOIN gram r ON r.lang = x.lang AND r.k = x.k - c.k AND r.g = x.g[c.k + 1:]
  WHERE x.k > 1),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
around AS (
  SELECT lang, g, max(f) AS f FROM (
    SELECT y.lang, y.f, unnest(list_transform(range(1, y.k - y.m + 2), lambda s: y.g[s:s + y.m - 1])) AS g FROM (SELECT lang, f, g, k, unnest(range(2, k)) AS m FROM gram WHERE k > 2) y)
  GROUP BY lang, g),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.g = b.g WHERE o.f IS NULL OR 100 * o.f < {SHARE} * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {TOP}
"""
