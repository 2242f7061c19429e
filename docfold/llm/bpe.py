"""Byte-level BPE: encoding by ranked merges, decoding by concatenation.

Texts are cut into pre-tokens and every *distinct* pre-token is encoded once. The most frequent ones of
the whole input (``dictionary_words`` at most, so the dictionary has a fixed bound and may be sent to
every task) are folded by Spark's higher-order functions over their bytes, with the ranks as a literal
map; a task folds the pre-tokens that are not among them the same way when it first meets them. Where a
pre-token is folded never changes its ids.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfold.llm import pretokens
from docfold.llm.common import arrow_map, pieces_of, text_of

BATCH_BYTES = 4 << 20
#: Of the literal map: Spark looks a map's key up by going through it, so the map is cut by hash.
BUCKETS = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank is merged, leftmost first, while there is one."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks) + 1
    costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while costs and (best := min(costs)) < none:
        i = costs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


class Encoder:
    """Encodes batches of texts. ``known``: ids of some words; ``one`` gives those of others. A long
    text of one repeated character is one word; only distinct words count, and at most ``most`` are kept."""

    def __init__(self, classes: np.ndarray, one: Callable[[bytes], list[int]], known: dict[bytes, list[int]] | None = None, most: int = 400_000) -> None:
        self.classes, self.one, self.known, self.most = classes, one, known or {}, most
        self.cache: dict[bytes, list[int]] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row; where each text's begin, and the end."""
        codes, words, counts = pretokens.coded(texts, self.classes)
        known, cache, one = self.known, self.cache, self.one
        if len(cache) > self.most:
            cache.clear()
        lists = []
        for w in words:
            ids = known.get(w)
            if ids is None and (ids := cache.get(w)) is None:
                ids = cache[w] = one(w)
            lists.append(ids)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
        first = np.cumsum(size) - size
        n = size[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[codes] - (ends - n), n) + np.arange(ends[-1])] if len(ends) else np.zeros(0, np.uint32)
        matches = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.concatenate([[0], ends])[matches]


def rank_of(piece: Column, buckets: Column) -> Column:
    """Rank of a piece in hexadecimal; null where it has none."""
    return F.try_element_at(F.get(buckets, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int")), piece)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: maps from pieces in hexadecimal, dealt by crc32. Bounded by the vocabulary."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        h = piece.hex().upper()
        maps[crc32(h.encode()) % BUCKETS][h] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def folded(word_hex: Column, buckets: Column) -> Column:
    """Ids of a word given in hexadecimal, by higher-order functions alone."""
    start = F.transform(F.sequence(F.lit(1), F.length(word_hex), F.lit(2)), lambda i: F.substr(word_hex, i, F.lit(2)))
    only = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  names a value inside a lambda

    def merged(parts: Column, ranks: Column) -> Column:
        at = F.array_position(ranks, F.array_min(ranks)).cast("int")
        pair = F.array(F.concat(F.get(parts, at - 1), F.get(parts, at)))
        return F.concat(F.slice(parts, F.lit(1), at - 1), pair, F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0))))

    def step(parts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: rank_of(F.concat(F.get(parts, i - 1), F.get(parts, i)), buckets))
        return only(pairs, lambda ranks: F.when(F.array_min(ranks).isNull(), parts).otherwise(merged(parts, ranks)))

    parts = F.aggregate(F.sequence(F.lit(1), F.length(word_hex)), start, lambda acc, _: F.when(F.size(acc) < 2, acc).otherwise(step(acc)))
    whole = rank_of(word_hex, buckets)
    return F.when(word_hex == "", F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(parts, lambda p: rank_of(p, buckets)))


def frequent_words(docs: DataFrame, most: int, longest: int = 64, buckets: int = 256) -> DataFrame:
    """The most frequent pre-tokens of all texts, of ``longest`` bytes at most: ``most`` at most. Counted within a
    batch first, so what is shuffled is distinct words; ranked within buckets of hashes, so no task ranks all."""
    each_has, classes = max(1, most // buckets), pretokens.class_table()

    def counting():
        def each(batch: pa.RecordBatch):
            words, counts = [], []
            for part in pieces_of(batch, BATCH_BYTES):
                codes, names, _ = pretokens.coded(part.column("text").to_pylist(), classes)
                n = np.bincount(codes, minlength=len(names))
                # A word that occurs once in 4 MB of text is left to the tasks that meet it.
                keep = [i for i in np.flatnonzero(n > 1) if len(names[i]) <= longest]
                words += [names[i] for i in keep]
                counts.append(n[keep])
            return {"word": words, "n": np.concatenate(counts)}

        return each

    rows = arrow_map(docs.select(text_of().alias("text")), counting, "word binary, n long").withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    counts = rows.repartition("bucket").groupBy("bucket", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= each_has).select("word", "n")


def dictionary(docs: DataFrame, ranks: dict[bytes, int], most: int) -> DataFrame:
    """(word, ids) of the frequent words, folded by higher-order functions. The few rows are dealt out
    again, so that all cores fold."""
    words = frequent_words(docs, most).select(F.hex("word").alias("h"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.repartition(n, "h").select(F.unhex("h").alias("word"), folded(F.col("h"), rank_literal(ranks)).alias("ids"))


def encode(docs: DataFrame, ranks_path: str, dictionary_words: int = 200_000) -> DataFrame:
    """(doc_id, ids): the whole texts encoded, without special tokens; one row for each row of docs.

    A null text is the empty one and has no ids. Other columns are ignored; repeated rows are encoded
    each; no rows in, no rows out. For documents whose ids are to be kept; ``digests`` gives only their hashes."""
    return _encoded(docs, ranks_path, dictionary_words, "doc_id long, ids array<int>", lambda part, ids, at, table: {"ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))})


def digests(docs: DataFrame, ranks_path: str, dictionary_words: int = 200_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): of the ids in decimal, joined by a space, and of
    the bytes that the ids decode to, of every row of ``docs``.

    A null text is the empty one, of no ids; repeated rows have a row each; texts of any length are encoded whole; other columns are
    ignored; no rows in, no rows out."""

    def hashes(part, ids, at, table):
        return {"n_tokens": np.diff(at), "ids_sha256": _sha(table["decimal"].take(pa.array(ids)), at, 1), "decoded_sha256": _sha(table["bytes"].take(pa.array(ids)), at, 0)}

    return _encoded(docs, ranks_path, dictionary_words, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", hashes)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, bytes): the pieces of the ids, concatenated, inside the JVM: the vocabulary is a literal array of pieces in
    hexadecimal. Null ids give null; an unknown id is an error; no rows in, no rows out."""
    of = {rank: piece.hex() for piece, rank in load_ranks(ranks_path).items()}
    pieces = F.from_json(F.lit(json.dumps([of.get(i) for i in range(max(of) + 1)])), "array<string>")
    unknown = lambda i: F.raise_error(F.concat(F.lit("no piece has the id "), i.cast("string"))).cast("string")
    return encoded.select("doc_id", F.unhex(F.array_join(F.transform("ids", lambda i: F.coalesce(F.get(pieces, i), unknown(i))), "")).alias("bytes"))


def _pieces(ranks: dict[bytes, int]) -> dict[str, pa.Array]:
    of = dict(map(reversed, ranks.items()))
    top = max(of) + 1
    return {"bytes": pa.array([of.get(i) for i in range(top)], pa.large_binary()), "decimal": pa.array([b"%d " % i for i in range(top)], pa.large_binary())}


def _sha(parts: pa.LargeBinaryArray, at: np.ndarray, less: int) -> list[str]:
    """Of the parts of each text in a row, without the last ``less`` bytes."""
    _, offsets, data = parts.buffers()
    where = np.frombuffer(offsets, np.int64, len(parts) + 1, 8 * parts.offset)[at] if len(parts) else np.zeros(len(at), np.int64)
    view = memoryview(data) if data is not None else memoryview(b"")
    return [hashlib.sha256(view[a : max(a, b - less)]).hexdigest() for a, b in zip(where[:-1], where[1:], strict=True)]


def _encoded(docs: DataFrame, ranks_path: str, dictionary_words: int, schema: str, finish) -> DataFrame:
    spark = docs.sparkSession
    ranks, classes = load_ranks(ranks_path), pretokens.class_table()
    known = dictionary(docs, ranks, dictionary_words).toArrow() if dictionary_words else None
    sent = spark.sparkContext.broadcast((ranks, known.to_batches() if known is not None else []))

    def encoding():
        ranks, batches = sent.value
        known = {w: i for b in batches for w, i in zip(b.column("word").to_pylist(), b.column("ids").to_pylist(), strict=True)}
        encoder, table = Encoder(classes, lambda w: fold(w, ranks), known), _pieces(ranks)

        def each(batch: pa.RecordBatch):
            out: dict[str, list] = {}
            for part in pieces_of(batch, BATCH_BYTES):
                ids, at = encoder(part.column("text").to_pylist())
                for k, v in finish(part, ids, at, table).items():
                    out.setdefault(k, []).append(v if isinstance(v, pa.Array) else pa.array(v))
            return {"doc_id": batch.column("doc_id")} | {k: pa.concat_arrays(v) for k, v in out.items()}

        return each

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), encoding, schema)
