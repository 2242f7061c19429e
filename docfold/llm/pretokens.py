"""Byte-level pre-tokens of whole batches of texts, without a regular expression per text.

Computes the matches of the usual byte-level pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
from character classes: a match begins where the class changes, a single space before a non-space
belongs to what follows, and an apostrophe begins a contraction only where a match begins with it.
The matches tile the text, so their ends are the offsets of an Arrow array over the text's bytes.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, NUMBER, OTHER = range(4)
#: The characters of white space in Unicode.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


_TABLE: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The class of every code point. Made once, by the driver; tasks get it with what they run."""
    if _TABLE:
        return _TABLE[0]
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE] = SPACE
    _TABLE.append(out)
    return out


def split(texts: list[str], classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All matches of all texts in order, as binary; how many each text has."""
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(cp)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths) - lengths
    if not n:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    kind = classes[cp]
    head = np.zeros(n + 1, bool)  # where a text begins
    head[starts] = True
    head = head[:n]
    change = head.copy()
    change[1:] |= kind[1:] != kind[:-1]
    begin = change.copy()
    space = kind == SPACE
    # The last white space before a non-space of its text is apart from those before it; a plain space joins what follows.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:]
    joins = last & (cp == 0x20)
    begin |= last
    begin[1:] &= ~joins[:-1]
    begin[0] = True
    # Contractions: an apostrophe that begins a match, and the letters after it.
    marks = np.flatnonzero((cp == 0x27) & begin)
    marks = marks[marks + 1 < n]
    if len(marks):
        at = lambda k: np.where((marks + k < n) & ~_crossed(head, marks, k), cp[np.minimum(marks + k, n - 1)], 0)
        a, b = at(1), at(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for which, size in ((one, 1), (two & ~one, 2)):
            m = marks[which]
            begin[m + 1] = False
            after = m + 1 + size
            after = after[after < n]
            begin[after] = True
        # What follows a contraction begins a match, so a lone apostrophe there begins one as well; it did by its class.
    width = (cp >= 0x80).astype(np.uint8)
    width += cp >= 0x800
    width += cp >= 0x10000
    width += 1
    offset = np.cumsum(width, dtype=np.int32)
    offset -= width
    cut = np.flatnonzero(begin)
    data = joined.encode()
    ends = np.append(offset[cut], len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    counts = np.searchsorted(cut, starts + lengths) - np.searchsorted(cut, starts)
    return words, counts


def _crossed(head: np.ndarray, marks: np.ndarray, k: int) -> np.ndarray:
    """Whether another text begins within k characters after the marks."""
    out = np.zeros(len(marks), bool)
    for i in range(1, k + 1):
        out |= head[np.minimum(marks + i, len(head) - 1)] & (marks + i < len(head))
    return out


def coded(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The number of each match's distinct word, the distinct words, how many matches each text has."""
    words, counts = split(texts, classes)
    d = pc.dictionary_encode(words)
    return d.indices.to_numpy(), d.dictionary.to_pylist(), counts
