"""Substring deduplication by FM-indexes.

A window is a run of words of one text. Each window is dealt by its minimizer (the least hash of the shorter
runs in it), so equal windows meet in one shard however they lie in their texts; consecutive windows of one
minimizer travel as one segment. Minimizers that occur once can't belong to a repeated window, and their
segments stay where they are. A shard makes a compressed index of its distinct segments: a wavelet matrix of the
Burrows-Wheeler transform, and a bit vector that says where windows differ. The texts' segments are streamed through it backwards, one
word at a time; each step is a backward search and gives the length of the match so far, cut to the window's, so that where a match is
as long its interval is that of all occurrences of the window. The first occurrence, by document and place, is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfold.llm.common import arrow_map, pieces_of, text_of, written
from docfold.llm.words import Hasher, runs, spans

WINDOW, SHORT = 20, 6
#: Windows of a segment at most; a minimizer with more occurrences than HOT has its windows dealt one by one.
LONGEST, HOT = 64, 4096
#: Words of an index at most, about; a task with more builds one after another.
SHARD_WORDS = 1 << 20
BATCH_BYTES = 4 << 20
NONE = -(2**63)


def segments(words: np.ndarray, at: np.ndarray, window: int, short: int) -> tuple[np.ndarray, ...]:
    """Of each segment: text's number, first window's place in it, number of windows, minimizer, how often the
    minimizer occurs in it."""
    n = np.diff(at)
    count = np.maximum(0, n - window + 1)
    row = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    if not len(row):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    g = runs(words, short)
    width = window - short + 1
    least, have = g, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    v = least[at[:-1][row] + place]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
    since = np.arange(len(v)) - np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    new |= since % LONGEST == 0
    cut = np.flatnonzero(new)
    size = np.diff(np.append(cut, len(v)))
    first = at[:-1][row[cut]] + place[cut]
    long_ = size + width - 1
    ends = np.cumsum(long_)
    where = np.repeat(first - (ends - long_), long_) + np.arange(ends[-1])
    occurs = np.add.reduceat(g[where] == np.repeat(v[cut], long_), ends - long_)
    return row[cut], place[cut], size, v[cut].view(np.int64), occurs


class Bits:
    """A packed bit vector; every 64 bits have a running count."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        self.words = np.zeros((n >> 6) + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(raw)] = raw
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.n, self.ones = n, int(self.before[-1])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many ones are before ``places``."""
        mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[places >> 6] + np.bitwise_count(self.words[places >> 6] & mask)

    def select(self, numbers: np.ndarray) -> np.ndarray:
        """Where the ones of these numbers (from 0) are; the end for the number of all."""
        out = np.full(len(numbers), self.n, np.int64)
        inside = numbers < self.ones
        k = numbers[inside]
        word = np.searchsorted(self.before, k, "right") - 1
        left = (k - self.before[word]).astype(np.int64)
        bits, at = self.words[word], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the half that has it
            low = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left -= np.where(up, low, 0)
            at += np.where(up, half, 0)
            bits = np.where(up, bits >> np.uint64(half), bits)
        out[inside] = (word << 6) + at
        return out


class Wavelet:
    """A wavelet matrix: ranks of any symbol before any place."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.levels: list[tuple[Bits, int]] = []
        self.depth = max(1, int(kinds - 1).bit_length())
        x = symbols
        for k in range(self.depth - 1, -1, -1):
            b = (x >> k & 1).astype(np.uint8)
            self.levels.append((Bits(b), int(len(x) - b.sum())))
            x = np.concatenate([x[b == 0], x[b == 1]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How many of ``symbols`` are before ``places`` (one row or more of them)."""
        start, end = np.zeros_like(places), places
        for k, (bits, zeros) in enumerate(self.levels):
            one = (symbols >> (self.depth - 1 - k) & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(end)
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + b, end - b)
        return end - start


class Index:
    """Compressed FM-index of segments of words: symbols 1.. with a 0 after each segment.

    What stays is the wavelet matrix of the Burrows-Wheeler transform, the symbols' counts, and one bit for each suffix: whether
    it differs from the one before within ``window`` words. The suffix array is only there while these are made; the order of suffixes counts up
    to ``window`` words and more, which is all that patterns of ``window`` words can tell apart."""

    def __init__(self, symbols: np.ndarray, window: int) -> None:
        n = len(symbols)
        order = rank = symbols
        depth = 1
        have = {}
        while True:
            have[depth] = rank
            if depth >= window:
                break
            key = rank.astype(np.int64) * (int(rank.max()) + 2)
            key[:-depth] += rank[depth:] + 1
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            depth *= 2
        # Ranks at the window's length, from those of two powers of two that overlap.
        half = depth // 2
        a = have[half]
        b = np.full(n, -1, np.int64)
        b[: n - (window - half)] = a[window - half :]
        at_window = a[order] * (int(a.max()) + 2) + b[order] + 1
        kinds = int(symbols.max()) + 1
        self.edges = Bits(np.concatenate([[True], at_window[1:] != at_window[:-1]]))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=kinds))])
        self.wavelet = Wavelet(symbols[order - 1], kinds)
        self.n, self.window = n, window

    def longest(self, symbols: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest matches of at most ``most`` symbols that begin at ``at``: interval and length. Shorter ones are tried
        until one is found."""
        low, high, length = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64), most.copy()
        todo = np.flatnonzero(length > 0)
        while len(todo):
            a, b = np.zeros(len(todo), np.int64), np.full(len(todo), self.n, np.int64)
            for step in range(int(length[todo].max())):
                on = np.flatnonzero((length[todo] > step) & (a < b))
                symbol = symbols[at[todo[on]] + length[todo[on]] - 1 - step]
                a[on], b[on] = self.before[symbol] + self.wavelet.rank(symbol, np.stack([a[on], b[on]]))
            found = a < b
            low[todo[found]], high[todo[found]] = a[found], b[found]
            todo = todo[~found]
            length[todo] -= 1
            todo = todo[length[todo] > 0]
        return low, high, length

    def matches(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Streams texts (``sizes`` symbols of ``symbols`` from ``starts``) backwards through the index: matching statistics
        up to the window's length. Where a match is as long, yields the numbers of these texts,
        its place in them, and the number of its interval, which all occurrences of the window share."""
        who = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[who], sizes[who]
        low, high = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
        length = np.zeros(len(who), np.int64)
        for step in range(int(sizes.max()) if len(sizes) else 0):
            on = int(np.searchsorted(-sizes, -step, "left"))  # those of more than ``step`` words
            place = sizes[:on] - 1 - step
            symbol = symbols[starts[:on] + place]
            both = self.before[symbol] + self.wavelet.rank(symbol, np.stack([low[:on], high[:on]]))
            low[:on], high[:on] = both
            length[:on] += 1
            none = np.flatnonzero(both[0] >= both[1])  # never for a text that the index has
            if len(none):
                low[none], high[none], length[none] = self.longest(symbols, starts[none] + place[none], length[none] - 1)
            full = np.flatnonzero(length[:on] >= self.window)
            if len(full):
                # The match may go on to the right of the window: the interval is that of its first words alone.
                interval = self.edges.rank(low[full] + 1) - 1
                low[full], high[full] = self.edges.select(interval), self.edges.select(interval + 1)
                yield who[full], place[full], interval


def first_windows(segs: pa.Array, ids: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments (words joined by a space) with the place of each: number of the segment and place in it of every
    window that has no earlier occurrence in any of the segments. Of equal segments only the first counts."""
    coded = pc.dictionary_encode(segs)
    code = coded.indices.to_numpy()
    by = np.lexsort((starts, ids, code))
    head = np.ones(len(by), bool)
    head[1:] = code[by][1:] != code[by][:-1]
    head_of = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
    first = by[head]
    tied = by[(ids[by] == ids[by[head_of]]) & (starts[by] == starts[by[head_of]]) & ~head]  # a place that two rows claim
    lists = pc.split_pattern(coded.dictionary, " ")
    words = pc.dictionary_encode(lists.flatten()).indices.to_numpy()
    size = np.diff(lists.offsets.to_numpy())
    begin = np.cumsum(size + 1) - (size + 1)
    symbols = np.zeros(int((size + 1).sum()), np.int64)
    symbols[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = words.astype(np.int64) + 1
    index = Index(symbols, window)
    known, rank = np.unique(ids, return_inverse=True)
    row_of = np.empty(len(size), np.int64)
    row_of[code[first]] = first
    # An occurrence's place in the order of documents and places.
    found = [(who, place, interval, (rank[row_of[who]] << 32) + starts[row_of[who]] + place) for who, place, interval in index.matches(symbols, begin, size)]
    least = np.full(index.edges.ones, np.iinfo(np.int64).max, np.int64)
    for _, _, interval, order in found:
        np.minimum.at(least, interval, order)
    kept, places = [], []
    for who, place, interval, order in found:
        own = order == least[interval]
        kept.append(row_of[who[own]])
        places.append(place[own])
    kept, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kept, places))
    if len(tied):
        twin = {}
        for t in tied.tolist():
            twin.setdefault(int(row_of[code[t]]), []).append(t)
        extra = [(t, p) for k, p in zip(kept.tolist(), places.tolist(), strict=True) for t in twin.get(k, ())]
        if extra:
            more = np.array(extra, np.int64)
            kept, places = np.concatenate([kept, more[:, 0]]), np.concatenate([places, more[:, 1]])
    return kept, places


def shards(batches: Iterator[pa.RecordBatch], most_words: int) -> Iterator[pa.Table]:
    """Rows that are sorted by (key, id, start), in tables of whole keys of about ``most_words`` words. Of windows that are
    dealt one by one (h null), which are equal if their keys are, only the first occurrence stays."""
    held: list[pa.Table] = []
    words, last = 0, None  # the first row of the last key's windows

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if batch.column("h").null_count:
            keep = []
            for key, h, seg, i, start in zip(*(batch.column(c).to_pylist() for c in ("key", "h", "seg", "id", "start")), strict=True):
                if h is not None or last is None or (key, seg) != last[:2]:
                    last = (key, seg, i, start) if h is None else None
                    keep.append(True)
                else:
                    keep.append((i, start) == last[2:])  # rows of one id claim the same place
            table = table.filter(pa.array(keep))
        else:
            last = None
        held.append(table)
        words += (pc.sum(pc.binary_length(table["seg"])).as_py() or 0) // 6
        if words < most_words:
            continue
        whole = pa.concat_tables(held)
        keys = whole["key"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield whole.slice(0, cut)
            whole = whole.slice(cut)
            words = (pc.sum(pc.binary_length(whole["seg"])).as_py() or 0) // 6
        held = [whole]
    if held and (whole := pa.concat_tables(held)).num_rows:
        yield whole


def _indexed(rows: DataFrame, window: int) -> DataFrame:
    """rows (key, h, seg, id, x, start), partitioned by key: the windows that are kept, (id, x, place). A task holds one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shards(batches, SHARD_WORDS):
            part = part.combine_chunks()
            ids, starts = part["id"].to_numpy(), part["start"].to_numpy().astype(np.int64)
            column = lambda c: part[c].chunk(0) if part[c].num_chunks else pa.array([], part[c].type)  # noqa: B023, E731
            row, place = first_windows(column("seg"), ids, starts, window)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([column("id").take(take), column("x").take(take), pa.array(starts[row] + place, pa.int32())], ["id", "x", "place"])

    sorted_ = rows.sortWithinPartitions("key", "id", "start")
    return sorted_.select("key", "h", "seg", "id", "x", "start").mapInArrow(run, "id long, x long, place int")


def deduplicated(docs: DataFrame, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row of ``docs``.

    Words are runs of other characters than ASCII white space, unchanged; a null text has none. A word goes if
    it is in a window of ``window`` words that also begins earlier: in a row of smaller doc_id, or earlier in
    the same document. ``kept`` is the rest, joined by one space. A null doc_id is smaller than any other; rows
    that share a doc_id are one document, so at equal places neither is earlier. Texts of fewer words than a
    window stay whole; longer ones are read whole, of any length. Other columns are ignored; no rows in, no rows out."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("id"), F.xxhash64(text_of()).alias("x"), text_of().alias("text"))

    def cutting():
        hasher = Hasher()

        def each(batch: pa.RecordBatch):
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            base = 0
            for part in pieces_of(batch, BATCH_BYTES):
                starts, ends, at, raw = spans(part.column("text"))
                got = segments(hasher(starts, ends, raw), at, window, short)
                for o, x in zip(out, (got[0] + base, *got[1:]), strict=True):
                    o.append(x)
                base += part.num_rows
            row, place, size, minimizer, occurs = (np.concatenate(o) for o in out)
            take = pa.array(row)
            return {"id": batch.column("id").take(take), "x": batch.column("x").take(take), "start": place, "n": size, "h": minimizer, "occurs": occurs}

        return each

    rows = written(arrow_map(texts, cutting, "id long, x long, start int, n int, h long, occurs int"), "segments")
    often = rows.groupBy("h").agg(F.sum("occurs").alias("times")).where("times > 1").select("h", (F.col("times") > HOT).alias("hot"))
    some = rows.join(often, "h").groupBy("id", "x").agg(F.collect_set(F.struct("start", "n", "h", "hot")).alias("segs"))
    some = written(some, "repeated")

    def shipping():
        def each(batch: pa.RecordBatch):
            best: dict[tuple[int | None, str], tuple[int, int, int]] = {}
            tied: list[tuple[int | None, str, int, int, int]] = []
            for text, i, x, segs in zip(*(batch.column(c).to_pylist() for c in ("text", "id", "x", "segs")), strict=True):
                words = _words(text)
                for s in segs:
                    a, n = s["start"], s["n"]
                    units = [(None, " ".join(words[k : k + window]), k) for k in range(a, a + n)] if s["hot"] else [(s["h"], " ".join(words[a : a + n + window - 1]), a)]
                    for h, seg, at in units:
                        # Of equal segments of a batch only the first is sent.
                        old = best.get((h, seg))
                        if old is None or (i, at) < old[:2]:
                            best[h, seg] = (i, at, x)
                        elif (i, at) == old[:2] and x != old[2]:
                            tied.append((h, seg, i, at, x))
            rows = [(h, seg, i, at, x) for (h, seg), (i, at, x) in best.items()] + tied
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return dict(zip(("h", "seg", "id", "start", "x"), map(list, cols), strict=True))

        return each

    sent = arrow_map(texts.join(some, ["id", "x"]).select("text", "id", "x", "segs"), shipping, "h long, seg string, id long, start int, x long")
    dealt = sent.withColumn("key", F.coalesce("h", F.xxhash64("seg"))).repartition("key")
    firsts = _indexed(dealt, window).groupBy("id", "x").agg(F.collect_set("place").alias("first"))

    def keeping():
        def each(batch: pa.RecordBatch):
            total, gone, sha, kept = [], [], [], []
            base = 0
            for part in pieces_of(batch, BATCH_BYTES):
                starts, ends, at, raw = spans(part.column("text"))
                n = np.diff(at)
                away = np.zeros(len(starts) + 1, np.int64)
                for r, (segs, first) in enumerate(zip(part.column("segs").to_pylist(), part.column("first").to_pylist(), strict=True)):
                    if segs:
                        mark = np.zeros(n[r] + 1, bool)
                        for s in segs:
                            mark[s["start"] : s["start"] + s["n"]] = True
                        if first:
                            mark[first] = False
                        where = at[r] + np.flatnonzero(mark)
                        np.add.at(away, where, 1)
                        np.add.at(away, where + window, -1)
                keep = np.cumsum(away)[:-1] == 0
                b = np.frombuffer(raw, np.uint8).copy()
                step = np.zeros(len(b) + 1, np.int64)
                np.add.at(step, starts[keep], 1)
                np.add.at(step, ends[keep], -1)
                mask = np.cumsum(step)[:-1] > 0
                row = np.repeat(np.arange(len(n)), n)
                edge = np.append(_edges(part), len(b))
                gap = ends[keep]
                gap = gap[gap < edge[row[keep] + 1]]  # a word at its text's end has no space after it
                b[gap] = 0x20
                mask[gap] = True
                out = b[mask].tobytes()
                upto = np.concatenate([[0], np.cumsum(mask)])[edge]
                left = np.bincount(row[keep], minlength=len(n))
                for r in range(part.num_rows):
                    own = out[upto[r] : upto[r + 1]].rstrip(b" ")
                    kept.append(own.decode())
                    sha.append(hashlib.sha256(own).hexdigest())
                total += n.tolist()
                gone += (n - left).tolist()
                base += part.num_rows
            return {"id": batch.column("id"), "n_words": total, "n_removed": gone, "kept_sha256": sha, "kept": kept}

        return each

    all_ = texts.join(some, ["id", "x"], "left").join(firsts, ["id", "x"], "left").select("id", "text", "segs", "first")
    out = arrow_map(all_, keeping, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(F.when(F.col("id") > NONE, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")


def _edges(batch: pa.RecordBatch) -> np.ndarray:
    """Where each text begins in the texts joined."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(size) - size


def _words(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]
