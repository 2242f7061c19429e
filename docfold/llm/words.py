"""Words of whole batches of texts as hashes, and what is computed from runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space, by which words are split.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every bit over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Where each word of each text begins and ends, in bytes of the texts joined; where each text's words
    begin (one more at the end); the joined bytes. Null texts have no words."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else memoryview(b"")
    at = offsets - offsets[0]
    b = np.frombuffer(raw, np.uint8)
    blank = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
    edge = np.zeros(len(b) + 1, bool)  # where a text begins
    edge[at[:-1]] = True
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= blank[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at), bytes(raw)


class Hasher:
    """64 bits of each word, from a polynomial over its bytes modulo 2**64, mixed with its length.

    Prefix sums of ``code[byte] * B**position`` give every word's polynomial up to a power of B, which is
    odd and so can be divided out. The powers are kept for the next batch."""

    base = 0x2545F4914F6CDD1D

    def __init__(self) -> None:
        self.codes = mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, starts: np.ndarray, ends: np.ndarray, raw: bytes) -> np.ndarray:
        n = len(raw)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(self.base, n + 1), _powers(pow(self.base, -1, 1 << 64), n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.codes[np.frombuffer(raw, np.uint8)] * self.up[:n], out=sums[1:])
            return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out, dtype=np.uint64)


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place, as far as there are so many."""
    n = max(0, len(words) - length + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * np.uint64(0x9FB21C651E98DF25) + words[k : k + n]
    return mixed(out)
