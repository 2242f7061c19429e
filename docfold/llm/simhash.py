"""Near duplicates by SimHash fingerprints and an inverted index on the positions of their bytes.

Two fingerprints that differ in at most ``BITS`` = 2 bits differ in at most two of their eight bytes, so they share six positional
bytes or more: that is the count filter's guaranteed minimum. Lists of single (position, byte) would each hold a 256th of all
fingerprints, and tallying a pair over them is quadratic work. So the index's lists are of six (position, byte) at once, one list
for each of the 28 ways to choose six positions: how often a pair meets is a function of its tally (once for six shared
bytes, seven times for seven), and a pair meets at all exactly if its tally reaches the minimum. Nothing is lost, and a list is
bounded whatever the data: distinct fingerprints that share six bytes differ in the other two only, so there are at most 65,536 of
them, and a third of all rows being alike makes no list longer. Within a list, a pair is verified by its bits: two at most may differ in
the two free bytes. A task sends on a tree of links for what hangs together in a list, no pairs. Equal fingerprints
are one before they are indexed.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfold.llm.common import arrow_map, free_name, text_of, written
from docfold.llm.minhash import components

WORDS, SEED, BITS, POSITIONS = 3, 42, 2, 8
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: The positions that a pair may differ in: one list for each choice.
FREE = list(itertools.combinations(range(POSITIONS), BITS))
NONE = -(2**63)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # bits of each byte, highest first
_PLACE = np.arange(POSITIONS) * 256


def shingles(data: bytes, length: int = WORDS, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The runs of ``length`` words of a text, piece by piece; all its words where it has fewer; none where it has none."""
    at, words, seen = 0, [], False
    while at < len(data):
        cut = _BLANK.search(data, at + piece)
        end = cut.start() if cut else len(data)
        words += data[at:end].split()
        at = end
        if len(words) >= length:
            seen = True
            yield [b" ".join(words[i : i + length]) for i in range(len(words) - length + 1)]
            words = words[len(words) - length + 1 :]
    if words and not seen:
        yield [b" ".join(words)]


def fingerprint(text: str, length: int = WORDS, piece: int = PIECE) -> int:
    """64 bits: those that are set in over half of the shingles' hashes. A-Z are lower-cased first; 0 without words."""
    counts, n = np.zeros((POSITIONS, 8), np.int64), 0
    # bytes.lower and bytes.split know ASCII only: A-Z, and the blanks 0x20 and 0x09 to 0x0D.
    for part in shingles(text.encode().lower(), length, piece):
        hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in part], ">u8")
        places = hashes.view(np.uint8).reshape(-1, POSITIONS) + _PLACE
        counts += np.bincount(places.ravel(), minlength=256 * POSITIONS).reshape(POSITIONS, 256) @ _SET
        n += len(part)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, fp) of every row: fingerprints as signed longs, a null id as the smallest one."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("id"), text_of().alias("text"))

    def make():
        def each(batch: pa.RecordBatch):
            own = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
            return {"id": batch.column("id"), "fp": own.view(np.int64)}

        return each

    return arrow_map(rows, make, "id long, fp long")


def postings(distinct: DataFrame) -> DataFrame:
    """(choice, shared, free) of each fingerprint and each choice of two free positions: the other six bytes, and the two."""

    def make():
        def each(batch: pa.RecordBatch):
            fp = batch.column("fp").to_numpy().astype(np.int64)
            octets = fp.astype(">i8").view(np.uint8).reshape(-1, POSITIONS)
            shared, free = [], []
            for pair in FREE:
                left = octets.copy()
                left[:, pair] = 0
                shared.append(left.reshape(-1).view(">i8").astype(np.int64))
                free.append(octets[:, pair[0]].astype(np.int32) * 256 + octets[:, pair[1]])
            return {"choice": np.repeat(np.arange(len(FREE), dtype=np.int32), len(fp)), "shared": np.concatenate(shared), "free": np.concatenate(free)}

        return each

    return arrow_map(distinct.select("fp"), make, "choice int, shared long, free int")


#: What two values of the free bytes may differ by: 136 masks of one or two of 16 bits.
MASKS = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in itertools.combinations(range(16), 2)], np.int32)


def tree_of(free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that join exactly what hangs together among a list's distinct values, those of at most two
    differing bits being neighbours. Work and memory are 136 lookups a value at most, not the pairs."""
    n = len(free)
    if n == 2:  # most lists by far
        near = (int(free[0]) ^ int(free[1])).bit_count() <= BITS
        return (free[1:], free[:1]) if near else (free[:0], free[:0])
    if n <= len(MASKS):
        a, b = np.nonzero(np.triu(np.bitwise_count(free[:, None] ^ free) <= BITS, 1))
    else:
        place = np.full(1 << 16, -1, np.int32)
        place[free] = np.arange(n)
        ends = [(own, other[own]) for m in MASKS if len(own := np.flatnonzero((other := place[free ^ m]) > np.arange(n)))]
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (free[:0], free[:0])
    if not len(a):
        return free[:0], free[:0]
    label = np.arange(n)
    while True:  # the least label of both ends goes to both ends' labels, and labels point to the least
        new = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        while not np.array_equal(short := new[new], new):
            new = short
        if np.array_equal(new, label):
            break
        label = new
    on = np.flatnonzero(label != np.arange(n))
    return free[on], free[label[on]]


def links(lists: DataFrame) -> DataFrame:
    """(a, b): fingerprints linked within the lists (choice, shared, free). A task holds one list at a time."""
    left, right = (np.array([8 * (POSITIONS - 1 - pair[k]) for pair in FREE], np.uint64) for k in (0, 1))

    def whole(choice: int, shared: int, free: np.ndarray) -> np.ndarray:
        high, low = (free >> 8).astype(np.uint64), (free & 255).astype(np.uint64)
        return (np.uint64(shared % 2**64) | high << left[choice] | low << right[choice]).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            columns = [] if batch is None else [batch.column(c).to_numpy() for c in ("choice", "shared", "free")]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)] if columns else rest
            if not columns or not len(columns[0]):
                continue
            choice, shared, free = columns
            edge = np.flatnonzero((choice[1:] != choice[:-1]) | (shared[1:] != shared[:-1])) + 1
            starts = np.concatenate([[0], edge])
            ends = np.concatenate([edge, [len(choice)]])
            if batch is not None:  # the last list may go on
                rest = [x[starts[-1] :] for x in columns]
                starts, ends = starts[:-1], ends[:-1]
            a, b = [], []
            for i in np.flatnonzero(ends - starts > 1):
                s, e = starts[i], ends[i]
                one, other = tree_of(free[s:e])
                if len(one):
                    a.append(whole(choice[s], int(shared[s]), one))
                    b.append(whole(choice[s], int(shared[s]), other))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    dealt = lists.repartition("choice", "shared").sortWithinPartitions("choice", "shared", "free")
    return dealt.select("choice", "shared", "free").mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``; component_id is the least doc_id that can be
    reached over links, its own included.

    Null and empty texts, and those of white space, have the fingerprint zero and are linked like any other. A null doc_id counts as
    smaller than any other and stays null. Rows that repeat a doc_id are rows of their own, linked by their fingerprints.
    Texts are read whole, in pieces. Other columns are ignored; no rows in, no rows out."""
    signed = written(fingerprints(docs), "fingerprints")
    distinct = written(signed.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    joined = written(links(postings(distinct)), "links")
    roots = components(joined).withColumnRenamed("v", "fp")
    grouped = written(distinct.join(roots, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "grouped")
    # Written, so that joins can split the rows of a component, or of a fingerprint, that holds a third of all.
    least = written(grouped.groupBy("root").agg(F.min("id").alias("least")), "least")
    of = written(grouped.join(least, "root").select("fp", "least"), "of")
    plain = lambda c: F.when(F.col(c) > NONE, F.col(c))
    return signed.join(of, "fp").select(plain("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), plain("least").alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component holds a smaller doc_id. Rows that repeat a doc_id stay or go together; rows
    without words are one component. All columns are kept as they are; no rows in, no rows out."""
    key = free_name(docs, "_id")
    chosen = near_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NONE)).alias(key))
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))).join(chosen, key, "left_semi").select(*docs.columns)
