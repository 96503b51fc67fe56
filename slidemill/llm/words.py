"""Words of whole texts as arrays: 64-bit hashes and spans, and packed arrays of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once, about; a longer word is hashed whole.
SEGMENT = 1 << 19
BASE = 0x2545F4914F6CDD1D
_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_letter = np.random.default_rng(20).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 modulo 2^64, and their inverses."""
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of the lower-cased bytes; words are runs of what is no ASCII white space.

    A hash sums a random odd number for each byte, times a power of its place in the word: two words of a
    corpus with V distinct ones meet in a hash with a chance of about V^2 / 2^65.
    """
    whole = np.frombuffer(data, np.uint8)
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(data):
        stop = min(at + SEGMENT, len(data))
        while stop < len(data) and not _white[whole[stop]]:  # on to the end of a word
            step = np.flatnonzero(_white[whole[stop : stop + 4096]])
            stop = stop + int(step[0]) if len(step) else min(stop + 4096, len(data))
        part = whole[at:stop]
        dark = np.zeros(len(part) + 2, np.int8)
        dark[1:-1] = ~_white[part]
        edge = np.diff(dark)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(a):
            power, inverse = _power(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_letter[part] * power[: len(part)], out=total[1:])
            h = (total[b] - total[a]) * inverse[a]
            h ^= h >> np.uint64(32)
            hashes.append(h * np.uint64(0xD6E8FEB86659FD93) ^ (b - a).astype(np.uint64))
            starts.append(a + at)
            ends.append(b + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The texts' bytes in lower case (A to Z), a space after each, and where each begins."""
    each = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    starts = np.cumsum([0] + [len(x) + 1 for x in each[:-1]]).astype(np.int64)
    return b" ".join([*each, b""]), starts


class Lookup:
    """Places of 64-bit values in a sorted array of distinct ones, -1 where they are not in it."""

    BITS = 20

    def __init__(self, known: np.ndarray):
        self.known = known
        self.first = np.searchsorted(known, np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS))
        self.first = np.append(self.first, len(known)).astype(np.int64)
        self.deep = int(np.diff(self.first).max(initial=0))

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        out = np.full(len(asked), -1, np.int64)
        bucket = (asked >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        for k in range(self.deep):
            i = np.flatnonzero(at + k < stop)
            hit = i[self.known[at[i] + k] == asked[i]]
            out[hit] = at[hit] + k
        return out


def pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0 as few bytes: each in no more than the largest needs, byte by byte of all, compressed."""
    most = int(a.max(initial=0))
    size = next(s for s in (1, 2, 4, 8) if most < 1 << 8 * s)
    raw = np.ascontiguousarray(np.asarray(a).astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()
    return bytes([size]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    raw = np.frombuffer(pa.decompress(data[9:], n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.int64)
