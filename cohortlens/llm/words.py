"""Words, word hashes and byte-bounded chunks of Arrow text columns.

A word is a maximal run of characters other than space and ``\\t``..``\\r``
(``[^\\x20\\x09-\\x0D]+``).  All of these separators are one byte in UTF-8, so
words are found on the bytes, for many texts at once, with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
#: texts of an Arrow batch are handled in chunks of about this many bytes (a longer text is a chunk of its own)
CHUNK_BYTES = 2 << 20
#: the tables of powers grow by this many entries (8 bytes each, two tables)
POWERS_STEP = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as UTF-8 bytes) of a string column, about ``limit`` bytes at a time."""
    raw = col.cast(pa.large_binary())
    at, size, part = 0, 0, []
    for i in range(len(raw)):
        b = raw[i].as_py()
        n = len(b) if b is not None else 0
        if part and size + n > limit:
            yield at, part
            at, size, part = i, 0, []
        part.append(b)
        size += n
    if part:
        yield at, part


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = -(-n // POWERS_STEP) * POWERS_STEP  # no larger than the chunks in use
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        pair = (np.cumprod(up), np.cumprod(down))
        if n > 4 * CHUNK_BYTES:  # one very long text: do not keep its tables
            return pair
        _powers = pair
    return _powers


class Words:
    """The words of a chunk of texts: hashes, byte places and the row each belongs to.

    ``first[i]:first[i + 1]`` are the words of text i; a null text has none.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False, hashes: bool = True):
        self.n = len(texts)
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, self.n)
        #: byte place of each text in ``buf`` (texts are joined by one separator)
        self.at = np.zeros(self.n + 1, np.int64)
        np.cumsum(sizes + 1, out=self.at[1:])
        buf = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        self.buf = _LOWER[buf] if lower else buf
        space = _SPACE[self.buf]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)
        if hashes:
            self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans of ``buf``; they depend on the bytes only."""
        up, down = _powers_to(len(self.buf))
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[:len(self.buf)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)

    def row(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(self.n), self.count)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of each run of k words inside one text."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        acc = self.hash[:m].copy()
        for j in range(1, k):
            acc *= _STEP
            acc += self.hash[j:m + j]
        last = np.repeat(self.first[1:], self.count)[:m]
        where = np.flatnonzero(np.arange(m) + k <= last)
        return where, mix(acc[where] + np.uint64(k))

    def whole(self, i: int) -> int:
        """Hash of the whole word sequence of text i."""
        acc = 0
        for h in self.hash[self.first[i]:self.first[i + 1]].tolist():
            acc = (acc * int(_STEP) + h) & 0xFFFFFFFFFFFFFFFF
        return int(mix(np.array([(acc + int(self.count[i])) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-word array over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]
