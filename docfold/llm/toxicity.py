"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text is lower-cased and everything but letters and digits becomes space; a feature is the number of
distinct words of the text that hold an n-gram (the word's ends count as characters). The features
that are told apart from chance by the labelled rows are multiplied by their log-count ratio
``log((p + a) / (n1 + 2a)) - log((q + a) / (n0 + 2a))`` and a ridge logistic regression is fitted on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfold.llm.common import arrow_map, give_back, pieces_of, text_of

THRESHOLD = 0.7
BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Model:
    """weights: of each n-gram, its log-count ratio included. Bounded by the n-grams of the labelled sample."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    sizes: tuple[int, ...] = (3, 4, 5)


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, mod 3, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def grams(word: str, sizes: tuple[int, ...]) -> set[str]:
    w = f" {word} "
    return {w[i : i + n] for n in sizes for i in range(len(w) - n + 1)}


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of each (row, distinct word) pair the row and the word's number; the words."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " ")
    lists = pc.split_pattern(clean, " ")
    coded = pc.dictionary_encode(lists.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words, n = coded.dictionary.to_pylist(), max(1, len(coded.dictionary))
    rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    pairs = np.unique(rows * n + coded.indices.to_numpy())
    keep = np.array([bool(w) for w in words] or [False])[pairs % n] if len(pairs) else np.zeros(0, bool)
    return (pairs // n)[keep], (pairs % n)[keep], words


def scores_of(texts: pa.Array, model: Model, cache: dict[str, float]) -> np.ndarray:
    rows, codes, words = distinct_words(texts)
    if len(cache) > 10 * HELD:
        cache.clear()
    value = np.zeros(max(1, len(words)))
    weights, sizes = model.weights, model.sizes
    for i, w in enumerate(words):
        s = cache.get(w)
        if s is None:
            s = cache[w] = sum(weights[g] for g in grams(w, sizes) if g in weights) if w else 0.0
        value[i] = s
    z = model.bias + np.bincount(rows, value[codes], len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logistic(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, ridge: float, rounds: int) -> tuple[float, np.ndarray]:
    """Accelerated gradient descent; the bias carries no penalty."""
    n = len(y)
    v = np.ones(width) / max(1, width) ** 0.5
    size = 1.0
    for _ in range(20):  # the largest singular value, for the step
        u = np.bincount(cols, x * np.bincount(rows, x * v[cols], n)[rows], width)
        size = float(np.linalg.norm(u)) or 1.0
        v = u / size
    step = 1 / (0.25 * (size / n + 1) * 1.1 + ridge)
    rate = min(max(y.mean() if n else 0.5, 1e-6), 1 - 1e-6)
    w, b = np.zeros(width), float(np.log(rate / (1 - rate)))
    w0, b0 = w, b
    for k in range(rounds):
        m = k / (k + 3)
        a, c = w + m * (w - w0), b + m * (b - b0)
        w0, b0 = w, b
        z = c + np.bincount(rows, x * a[cols], n)
        e = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        w = a - step * (np.bincount(cols, x * e[rows], width) / n + ridge * a)
        b = c - step * float(e.mean())
    return b, w


#: Words whose n-grams a task holds while it counts, about: some kilobytes each.
HELD = 20_000


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_rows: int = 5, least_z: float = 4.0, smooth: float = 0.5, sizes: tuple[int, ...] = (3, 4, 5), ridge: float = 1e-4, rounds: int = 300) -> Model:
    """Learns from at most ``max_rows`` labelled rows that aren't held out: those whose hashed doc_id is
    least. All n-grams get a weight that are in ``min_rows`` of these rows at least and whose rates
    in the two classes differ by ``least_z`` standard errors. With no labelled rows, or
    with one class only, the model is the (smoothed) share of that class."""
    chosen = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = chosen.count()
    if rows > max_rows:  # most rows are passed over where they are; a task ranks few more than it keeps
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * max_rows / rows)))
    chosen = chosen.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(max_rows)  # bounded, so it may be broadcast
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def counting():
        cache: dict[str, frozenset[str]] = {}

        def each(batch: pa.RecordBatch):
            seen: tuple[dict[str, int], dict[str, int]] = ({}, {})
            y = batch.column("toxic").to_numpy()
            for part_no, part in enumerate(pieces_of(batch, BATCH_BYTES)):
                del part_no
                rows, codes, words = distinct_words(part.column("text"))
                kinds = part.column("toxic").to_numpy()
                ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
                for r in range(part.num_rows):
                    got: set[str] = set()
                    for c in codes[ends[r] : ends[r + 1]]:
                        w = words[c]
                        if (g := cache.get(w)) is None:
                            g = cache[w] = frozenset(grams(w, sizes))
                        got |= g
                    count = seen[1 if kinds[r] else 0]
                    for g in got:
                        count[g] = count.get(g, 0) + 1
                if len(cache) > HELD:
                    cache.clear()
            names = ["", *(seen[0].keys() | seen[1].keys())]
            return {"gram": names, "q": [int((y == 0).sum()), *(seen[0].get(g, 0) for g in names[1:])], "p": [int((y != 0).sum()), *(seen[1].get(g, 0) for g in names[1:])]}

        return each

    counts = arrow_map(texts, counting, "gram string, q long, p long").groupBy("gram").agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
    total = counts.where("gram = ''").first()
    n0, n1 = (total.q, total.p) if total else (0, 0)
    if not n0 or not n1:
        return Model(float(np.log((n1 + 0.5) / (n0 + 0.5))), {}, sizes)
    pool = (F.col("p") + F.col("q")) / (n0 + n1)
    z = F.abs(F.col("p") / n1 - F.col("q") / n0) / F.sqrt(pool * (1 - pool) * (1 / n0 + 1 / n1) + 1e-12)
    top = counts.where("gram <> ''").where(F.col("p") + F.col("q") >= min_rows).withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "gram").collect()
    if not top:
        return Model(float(np.log(n1 / n0)), {}, sizes)
    ratio = {x.gram: float(np.log((x.p + smooth) / (n1 + 2 * smooth)) - np.log((x.q + smooth) / (n0 + 2 * smooth))) for x in top}
    number = {g: i for i, g in enumerate(ratio)}

    def rowing():
        cache: dict[str, tuple[int, ...]] = {}

        def each(batch: pa.RecordBatch):
            out: list[dict[int, int]] = []
            for part in pieces_of(batch, BATCH_BYTES):
                rows, codes, words = distinct_words(part.column("text"))
                ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
                for r in range(part.num_rows):
                    count: dict[int, int] = {}
                    for c in codes[ends[r] : ends[r + 1]]:
                        w = words[c]
                        if (got := cache.get(w)) is None:
                            got = cache[w] = tuple(number[g] for g in grams(w, sizes) if g in number)
                        for f in got:
                            count[f] = count.get(f, 0) + 1
                    out.append(count)
                if len(cache) > 300_000:
                    cache.clear()
            return {"toxic": batch.column("toxic"), "cols": [list(c) for c in out], "n": [list(c.values()) for c in out]}

        return each

    sample = arrow_map(texts, rowing, "toxic int, cols array<int>, n array<int>").toArrow()
    lengths = pc.list_value_length(sample["cols"]).to_numpy()
    rows, cols = np.repeat(np.arange(len(lengths)), lengths), pc.list_flatten(sample["cols"]).to_numpy().astype(np.int64)
    r = np.array(list(ratio.values()))
    x = pc.list_flatten(sample["n"]).to_numpy() * r[cols]
    bias, w = _logistic(rows, cols, x, (sample["toxic"].to_numpy() != 0).astype(float), len(r), ridge, rounds)
    return Model(bias, {g: float(a * b) for g, a, b in zip(ratio, w, r, strict=True)}, sizes)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with its own columns, ``toxic_score`` (0 to 1) and ``toxic_predicted``.

    Only the text is looked at: whole, null as the empty one, which gets the bias's score. Equal texts
    get equal scores. No rows in, no rows out. Columns of the same names are replaced."""
    own = [f for f in docs.schema.fields if f.name not in ("toxic_score", "toxic_predicted")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", toxic_score double"

    def scoring():
        cache: dict[str, float] = {}

        def each(batch: pa.RecordBatch):
            parts = [scores_of(part.column("text"), model, cache) for part in pieces_of(batch, BATCH_BYTES)]
            return {f.name: batch.column(f.name) for f in own} | {"toxic_score": np.concatenate(parts)}

        return each

    return arrow_map(docs.select([f.name for f in own]), scoring, schema).withColumn("toxic_predicted", (F.col("toxic_score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns as they are, whatever their names.

    A null text is the empty one, which has the bias's score; repeated rows stay or go together; whole texts are read, of any
    length; no rows in, no rows out."""

    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            for part in pieces_of(batch, BATCH_BYTES):
                yield part.filter(pa.array(scores_of(part.column("text"), model, cache) < threshold))
        cache.clear()
        give_back()

    return docs.mapInArrow(run, docs.schema)
