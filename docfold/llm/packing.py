"""Best-fit packing of documents into sequences, by linear grouping.

Lengths of over an eighth of a sequence are sorted and cut into groups of equal cardinality; each counts
as its group's largest. For these few sizes, fillings are chosen one after another: the largest size
left, with those that fill the rest best (bounded subset sums), as often as the counts allow. Documents
take their groups' places, and the short ones go where they leave least room, by their true lengths.
"""

from __future__ import annotations

import heapq
import json
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfold.llm import bpe, pretokens
from docfold.llm.common import arrow_map, pieces_of, text_of, written

SEQUENCE = 2048


def filling(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """Of each size's number how many, so that their sum is the largest up to ``room``."""
    reached = np.full(room + 1, -1, np.int32)  # the size that was added last; -2 for none
    reached[0] = -2
    for i, (s, m) in enumerate(zip(sizes, counts, strict=True)):
        if not m or s > room:
            continue
        new = reached >= 0
        new[0] = True
        for _ in range(min(m, room // s)):
            step = np.zeros(room + 1, bool)
            step[s:] = new[: room + 1 - s]
            step &= reached == -1
            if not step.any():
                break
            reached[step] = i
            new = step
        if reached[room] != -1:
            break
    at = int(np.flatnonzero(reached != -1)[-1])
    out: dict[int, int] = {}
    while at:
        i = int(reached[at])
        out[i] = out.get(i, 0) + 1
        at -= sizes[i]
    return out


def pack(lengths: np.ndarray, room: int = SEQUENCE, groups: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length (0 < length <= room). Deterministic in the given order."""
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] > room // 8]
    small = order[lengths[order] <= room // 8]
    bins: list[list[int]] = []
    parts = [p.tolist() for p in np.array_split(large, min(groups, len(large)))] if len(large) else []
    merged: dict[int, list[int]] = {}  # groups whose largest are equal are one size
    for p in parts:
        merged.setdefault(int(lengths[p[0]]), []).extend(p)
    sizes = sorted(merged, reverse=True)
    stacks = [merged[s][::-1] for s in sizes]  # the longest of a group are taken first
    counts = [len(s) for s in stacks]
    for i, s in enumerate(sizes):
        while counts[i]:
            counts[i] -= 1
            use = filling(sizes, counts, room - s)
            counts[i] += 1
            use[i] = use.get(i, 0) + 1
            times = min(counts[k] // m for k, m in use.items())
            for _ in range(times):
                bins.append([stacks[k].pop() for k, m in use.items() for _ in range(m)])
            for k, m in use.items():
                counts[k] -= m * times
    left: dict[int, list[int]] = {}  # sequences by the room that they have left
    free = 0
    for b, items in enumerate(bins):
        r = room - int(lengths[items].sum())
        left.setdefault(r, []).append(b)
        free |= 1 << r
    for i in small.tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = heapq.heappop(left[r]) if len(left[r]) > 1 else left[r].pop()
            if not left[r]:
                free &= ~(1 << r)
        else:
            b, r = len(bins), room
            bins.append([])
        bins[b].append(i)
        heapq.heappush(left.setdefault(r - n, []), b)
        free |= 1 << (r - n)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins):
        own = lengths[items]
        sequence[items] = b
        offset[items] = np.cumsum(own) - own
    return sequence, offset


class Vocabulary:
    """A byte-level tokenizer file: its pieces' ranks and its added tokens. Bounded by the vocabulary.

    Ranks are ids: such a file lists its merges in the order of the pieces that they make (checked)."""

    def __init__(self, file: str) -> None:
        self.file = file
        read = json.loads(file)
        model = read["model"]
        byte_of = _bytes_of_characters()
        self.ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items()}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("the file's merges aren't in the order of their ids")
        self.added = [t["content"] for t in read.get("added_tokens", ())]

    def whole(self):
        """The library's tokenizer, for texts that hold added tokens."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.file)


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level files write printable bytes of Latin-1 as themselves and the others as characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def tokenized(docs: DataFrame, tokenizer_path: str, room: int = SEQUENCE, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the closing one, cut if they
    are more than ``room``: whole pieces but for the first. Ids are those that the tokenizer file gives without a
    template's special tokens: distinct pre-tokens are encoded once in a task, and a text that holds the string of
    an added token goes through the library's tokenizer as a whole. The file is read by the driver."""
    with open(tokenizer_path, encoding="utf-8") as f:
        file = f.read()
    sent, classes = docs.sparkSession.sparkContext.broadcast(file), pretokens.class_table()

    def encoding():
        import tiktoken

        vocabulary = Vocabulary(sent.value)
        ranks, added = vocabulary.ranks, vocabulary.added
        # Pre-tokens are single matches, so the pattern takes all of what it gets.
        one = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        library: list = []

        def ids_of(word: bytes) -> list[int]:
            whole = ranks.get(word)
            return one.encode_ordinary(word.decode()) if whole is None else [whole]

        def by_library(text: str) -> np.ndarray:
            if not library:
                library.append(vocabulary.whole())
            return np.array(library[0].encode(text, add_special_tokens=False).ids, "<u4")

        encoder = bpe.Encoder(classes, ids_of)

        def each(batch: pa.RecordBatch):
            rows, piece, start, length, crc = [], [], [], [], []
            base = 0
            for part in pieces_of(batch, bpe.BATCH_BYTES):
                texts = part.column("text").to_pylist()
                special = {r for r, t in enumerate(texts) if any(a in t for a in added)}
                ids, at = encoder(["" if r in special else t for r, t in enumerate(texts)])
                ids = ids.astype("<u4")
                for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own = np.append(by_library(texts[r]) if r in special else ids[a:b], np.uint32(end)).astype("<u4")
                    n = len(own)
                    cuts = [0, *range(n % room or room, n + 1, room)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(base + r)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                        crc.append(crc32(own[x:y].tobytes()))
                base += part.num_rows
            return {"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

        return each

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), encoding, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer_path: str, room: int = SEQUENCE, per_task: int = 50_000) -> DataFrame:
    """The pieces of every row of ``docs`` with ``sequence_id`` and ``offset``.

    A null text is the empty one: its piece is the closing id alone. A text of any length is cut into pieces of
    ``room``. Ties are settled by doc_id and piece. Repeated rows are packed each. Other
    columns are ignored; no rows in, no rows out. Pieces are dealt by hash to tasks of about ``per_task``,
    each of which packs its own: one sequence at most is left partly empty by each task for the dealing."""
    pieces = written(tokenized(docs, tokenizer_path, room), "pieces")
    tasks = -(-pieces.count() // per_task) or 1
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ignore_index=True)
        sequence, offset = pack(pdf["length"].to_numpy(), room)
        return pdf.assign(sequence_id=sequence + pdf["task"] * (1 << 32), offset=offset).drop(columns="task")

    dealt = pieces.withColumn("task", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(each, kind)
