"""Ranked lexical search by Fagin's threshold algorithm.

The forward index has a row for each document: how many terms it has, and how often it has each term that any item asks for. What
ranking needs of the whole corpus (documents N, terms L, documents of each term) is counted from it. A task then goes through
its documents in shards: each term's list is sorted by impact, an item's lists are read in rounds, and a document met for the
first time is looked up in the forward index and scored wholly. The threshold, the best score that an unseen document
can have, falls with each round; an item is done with the shard once the threshold is strictly below its kth score, so
that ties are still seen. The kth score is that of all the task's shards so far, so most items end after a glance at a
shard. A task returns k documents an item, and the best of those are the result: nothing but them is shuffled.

Impacts leave out the term's weight, as one factor of a whole list: lists are sorted alike with it and without. All is
computed in 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfold.llm.common import arrow_map, pieces_of, text_of, written

K = 10
BATCH_BYTES = 4 << 20
#: Terms of items that are searched for at once, about: what is broadcast of the items. More are gone through block by block.
BLOCK_TERMS = 200_000
#: Entries of the forward index that a shard has, about, and documents.
SHARD_ENTRIES, SHARD_DOCS = 1 << 20, 1 << 13
#: Places of each list that the first round reads; each round reads twice as many.
FIRST_ROUND = 16
NONE = -(2**63)
_BYTES = np.arange(256, dtype=np.uint8)
#: Letters and digits, and whatever isn't ASCII; A-Z become small letters.
TERM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
SMALL = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, and the row of each."""
    binary = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64, len(binary) + 1, 8 * binary.offset)
    data = binary.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    on = TERM[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = on.copy()
    first[1:] &= ~on[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    # Without what lies between them, the terms' bytes are an array of strings.
    kept = np.cumsum(on)
    begins = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(begins), pa.py_buffer(SMALL[raw[on]])])
    return array, np.searchsorted(at, starts, "right") - 1


def asked(items: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(block, id, term) of the distinct terms of each item; items are dealt to blocks of about ``block_terms`` terms."""

    def make():
        def each(batch: pa.RecordBatch):
            found, row = terms(batch.column("text"))
            return {"id": batch.column("id").take(pa.array(row)), "term": found.cast(pa.binary())}

        return each

    rows = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NONE)).alias("id"), text_of().alias("text"))
    found = written(arrow_map(rows, make, "id long, term binary").distinct(), "asked")
    blocks = max(1, -(-found.count() // block_terms))
    return found.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "term")


def forward_index(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(id, n, terms, tfs) of every row that has terms: their number, and those of ``words`` (by their place) with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("id"), text_of().alias("text"))

    def make():
        known = pa.array(shared.value, pa.large_binary())
        size = max(1, len(known))

        def each(batch: pa.RecordBatch):
            n, ends, which, tfs = [], [np.zeros(1, np.int64)], [], []
            for part in pieces_of(batch, BATCH_BYTES):
                found, row = terms(part.column("text"))
                n.append(np.bincount(row, minlength=part.num_rows))
                place = pc.index_in(found, known)
                on = pc.is_valid(place).to_numpy(zero_copy_only=False)
                keys, counts = np.unique(row[on] * size + pc.fill_null(place, 0).to_numpy(zero_copy_only=False)[on], return_counts=True)
                which.append((keys % size).astype(np.int32))
                tfs.append(counts)
                ends.append(ends[-1][-1] + np.cumsum(np.bincount(keys // size, minlength=part.num_rows)))
            ends = pa.array(np.concatenate(ends), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), t)) for x, t in ((which, pa.int32()), (tfs, pa.int64()))]
            n = np.concatenate(n)
            some = pa.array(n > 0)
            return {"id": batch.column("id").filter(some), "n": pa.array(n, pa.int64()).filter(some), "terms": lists[0].filter(some), "tfs": lists[1].filter(some)}

        return each

    return arrow_map(rows, make, "id long, n long, terms array<int>, tfs array<long>")


class Shard:
    """Some documents: their forward index, and each term's documents by falling impact."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, starts: np.ndarray, which: np.ndarray, tfs: np.ndarray, docs: int, all_terms: int) -> None:
        self.ids, self.starts, self.which = ids, starts, which
        if 90 * int(n.max()) * docs < 2**63:
            share = 90 * n * docs // all_terms
        else:
            share = np.array([90 * int(x) * docs // all_terms for x in n], np.int64)
        row = np.repeat(np.arange(len(n)), np.diff(starts))
        self.impact = 1_000_000_000 * tfs // (1000 * tfs + 8 * (10 + share)[row])
        order = np.lexsort((-self.impact, which))
        self.rows, self.sorted = row[order], self.impact[order]
        present, at = np.unique(which[order], return_index=True)
        ends = np.append(at[1:], len(order))[: len(at)]
        self.lists = {t: (a, b) for t, a, b in zip(present.tolist(), at.tolist(), ends.tolist(), strict=True)}

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of some documents, from their rows of the forward index."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[rows] - ends + sizes, sizes) + np.arange(ends[-1])
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(weight[self.which[at]] * self.impact[at])])
        return sums[ends] - sums[ends - sizes]

    def search(self, best: list[tuple[int, int]], mine: np.ndarray, weight: np.ndarray, k: int) -> int:
        """Puts the shard's documents into ``best``, a heap of the k best (score, minus id), for the terms ``mine``; ``weight`` has
        theirs and is 0 elsewhere. Returns how many documents were looked up."""
        lists = [(*self.lists[t], int(weight[t])) for t in mine.tolist() if t in self.lists]
        seen = np.zeros(len(self.ids), bool)
        depth, step, looked = 0, FIRST_ROUND, 0
        while lists:
            # The best that a document can have which no list has shown yet.
            threshold = sum(w * int(self.sorted[a + depth]) for a, b, w in lists)
            if len(best) == k and threshold < best[0][0]:
                break
            met = np.concatenate([self.rows[a + depth : min(b, a + depth + step)] for a, b, _ in lists])
            new = np.unique(met[~seen[met]])
            if len(new):
                seen[new] = True
                looked += len(new)
                got = self.scores(new, weight)
                on = got >= (best[0][0] if len(best) == k else 1)
                for score, id_ in zip(got[on].tolist(), self.ids[new[on]].tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (score, -id_))
                    elif (score, -id_) > best[0]:
                        heapq.heapreplace(best, (score, -id_))
            depth += step
            step *= 2
            lists = [x for x in lists if x[0] + depth < x[1]]
        return looked


def weight_of(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _shards(batches: Iterator[pa.RecordBatch], docs: int, all_terms: int) -> Iterator[Shard]:
    for batch in batches:
        lists = batch.column("terms"), batch.column("tfs")
        starts = lists[0].offsets.to_numpy().astype(np.int64)
        ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
        which, tfs = lists[0].values.to_numpy(), lists[1].values.to_numpy()
        at = 0
        while at < len(ids):
            end = min(len(ids), at + SHARD_DOCS, max(at + 1, int(np.searchsorted(starts, starts[at] + SHARD_ENTRIES, "right")) - 1))
            a, b = starts[at], starts[end]
            yield Shard(ids[at:end], n[at:end], starts[at : end + 1] - a, which[a:b], tfs[a:b], docs, all_terms)
            at = end


def _searched(index: DataFrame, items: list[tuple[int, list[int]]], weights: list[int], docs: int, all_terms: int, k: int) -> DataFrame:
    """(item, id, score): of each task's documents, the k best of each item."""
    shared = index.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, every = shared.value
        every = np.array(every, np.int64)
        mine = [np.array([t for t in own if every[t] > 0], np.int64) for _, own in wanted]
        best: list[list[tuple[int, int]]] = [[] for _ in wanted]
        weight = np.zeros(len(every), np.int64)
        for shard in _shards(batches, docs, all_terms):
            for own, heap in zip(mine, best, strict=True):
                weight[own] = every[own]
                shard.search(heap, own, weight, k)
                weight[own] = 0
        rows = [(item, -id_, score) for (item, _), heap in zip(wanted, best, strict=True) for score, id_ in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item", "id", "score"])

    return index.select("id", "n", "terms", "tfs").mapInArrow(run, "item long, id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring rows of ``docs`` for each item of ``items`` (item_id, text), those of
    equal scores by ascending doc_id, as far as scores are above 0.

    Null texts have no terms and are neither found nor counted. A null doc_id counts as smaller than any other and stays
    null; rows that repeat a doc_id are rows of their own. Rows that repeat an item_id (null ones too) are one item
    with all their terms; an item without terms, or none of whose terms is in a document, has no rows. Other columns are
    ignored; no documents or no items, no rows.

    Items are dealt to blocks by their number of terms; each block reads ``docs`` once. Broadcast are a block's distinct
    terms and its items' (about ``block_terms``, or those of one larger item)."""
    plain = lambda c: F.when(F.col(c) > NONE, F.col(c))
    own = written(asked(items, block_terms), "items")
    out = docs.sparkSession.createDataFrame([], "item long, id long, score long")
    for (block,) in own.select("block").distinct().sort("block").collect():
        here = own.where(F.col("block") == block)
        words = sorted(bytes(r.term) for r in here.select("term").distinct().collect())
        place = {w: i for i, w in enumerate(words)}
        wanted: dict[int, list[int]] = {}
        for r in here.select("id", "term").collect():
            wanted.setdefault(r.id, []).append(place[bytes(r.term)])
        index = written(forward_index(docs, words), "forward")
        size = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not size.docs:
            continue
        df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect())
        weights = [weight_of(size.docs, df.get(i, 0)) for i in range(len(words))]
        out = out.unionByName(_searched(index, sorted((i, sorted(t)) for i, t in wanted.items()), weights, size.docs, size.terms, k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(plain("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), plain("id").alias("doc_id"), "score")
