"""Exact BPE token counts at every prefix, by dynamic programming over the vocabulary.

A token sequence is the encoding of its bytes if every neighbouring pair in it is the encoding of its own
bytes. So the encoding of each prefix of a piece is that of a shorter prefix and one more token that may
follow its last one; only that last token and the count are stored at each prefix.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.llm.common import pick

#: Fixed value: how the byte-level vocabulary splits text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose counts a worker keeps; it starts afresh beyond that.
KEPT = 600_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounts:
    """Token counts of whole texts and of all their prefixes under a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PATTERN).findall
        self.spaces = regex.compile(r"\s+")
        self.found = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.found.add_word(b.decode("latin-1"), (len(b), i))
        self.found.make_automaton()
        self.follows: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; only for the few bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def may_follow(self, last: int, token: int) -> bool:
        """If the bytes of the two tokens encode as just these two (last -1: of the one as this one)."""
        if (known := self.follows.get((last, token))) is None:
            want = [token] if last < 0 else [last, token]
            known = self.follows[last, token] = self.merged(b"".join(self.bytes[t] for t in want)) == want
        return known

    def along(self, piece: str) -> list[int]:
        """The count at every byte prefix of one piece, the empty one first."""
        data = piece.encode()
        last, count = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for end, (size, token) in self.found.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0 and (end == size or last[end - size] >= 0) and self.may_follow(last[end - size], token):
                last[end], count[end] = token, count[end - size] + 1
        return count

    def of_piece(self, piece: str) -> int:
        n = self.kept.get(piece)
        if n is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            n = self.kept[piece] = self.along(piece)[-1]
        return n

    def parts(self, text: str) -> tuple[list[str], np.ndarray]:
        """Pieces of the text in order, special tokens among them, and the count of each."""
        if self.split_special is not None and any(s in text for s in self.special):
            pieces, counts, at = [], [], 0
            for m in [*self.split_special.finditer(text), None]:
                own = self.pieces(text[at : m.start() if m else len(text)])
                pieces += own
                counts += map(self.of_piece, own)
                if m:
                    pieces.append(m[0])
                    counts.append(1)
                    at = m.end()
            return pieces, np.array(counts, np.int64)
        pieces = self.pieces(text)
        get = self.kept.get
        counts = [get(p) or self.of_piece(p) for p in pieces]
        return pieces, np.array(counts, np.int64)

    def prefixes(self, text: str) -> list[int]:
        """The count at every code point prefix of the text, the empty one first: element k is that of text[:k] on its own.

        A prefix splits like the text but for its end: cut in white space, the run of it is one piece; cut in a
        contraction or a special token, the beginning is split anew, from the last white space or special token on.
        """
        out, total, at, safe = [0], 0, 0, 0
        pieces, counts = self.parts(text)
        whole = lambda t: int(self.parts(t)[1].sum())
        for p, n in zip(pieces, counts.tolist(), strict=True):
            if p in self.special:
                out += [out[safe] + whole(text[safe : at + j]) for j in range(1, len(p))] + [total + n]
                safe = at + len(p)
            elif p[0] == "'" and len(p) > 1 and p[1].isalpha():
                out += [total + whole(p[:j]) for j in range(1, len(p))] + [total + n]
            else:
                along = self.along(p)
                out += [total + along[e] for e in np.cumsum([len(c.encode()) for c in p])]
                if self.spaces.match(p) and not self.spaces.match(text[at - 1 : at]):
                    safe = at
            total, at = total + n, at + len(p)
        for run in self.spaces.finditer(text):
            along = self.along(run[0])
            for j, end in enumerate(np.cumsum([len(c.encode()) for c in run[0]]), 1):
                out[run.start() + j] = out[run.start()] + along[end]
        return out

    def fit(self, pieces: list[str], counts: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix, of those that end with a piece or within the first piece too many, whose tokens in the text are at most so many."""
        total = np.cumsum(counts)
        k = int(np.searchsorted(total, budget, side="right"))
        chars = sum(map(len, pieces[:k]))
        if k == len(pieces) or pieces[k] in self.special or pieces[k][0] == "'" and pieces[k][1:2].isalpha():
            return chars
        left = budget - (int(total[k - 1]) if k else 0)
        along, ends = self.along(pieces[k]), np.cumsum([len(c.encode()) for c in pieces[k]])
        return chars + max((i for i, e in enumerate(ends, 1) if along[e] <= left), default=0)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def count_tokens(docs: DataFrame, vocabulary: str, budget: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > budget), fit_chars (the longest prefix within the budget, in code points) of every row.

    Null texts count as empty: zero bytes and tokens. Repeated rows and null ids are kept as they are; an
    empty table gives an empty result; other columns are ignored whatever their names. Texts are counted
    whole. A special token's string inside a text is that one token, as the vocabulary's library has it.
    No shuffle: each row is counted where it is read.
    """

    @F.pandas_udf("n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(vocabulary)
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                pieces, n = own.parts(t)
                total = int(n.sum())
                rows.append((len(t.encode()), total, total > budget, own.fit(pieces, n, budget) if total > budget else len(t)))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "over_limit", "fit_chars"])

    rows = pick(docs, doc_id="long", text="string").withColumn("n", counts("text"))
    return rows.select("doc_id", "n.n_bytes", "n.n_tokens", "n.over_limit", "n.fit_chars")


def prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and counts: array whose element k is the library's token count of the text's first k code points (element 0 is 0)."""

    @F.pandas_udf("array<int>")
    def along(texts: pd.Series) -> pd.Series:
        own = counter(vocabulary)
        return texts.map(lambda t: own.prefixes(t or ""))

    return pick(docs, doc_id="long", text="string").select("doc_id", along("text").alias("counts"))
