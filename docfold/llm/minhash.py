"""Near duplicates by DartMinHash signatures of weighted word shingles.

A text's elements are its runs of five words, weighted by how often they occur. Darts are thrown by hash at
regions of the plane (weight, rank), with each element having a plane of its own; those that land below the
element's weight count, and each coordinate keeps its dart of least rank. Texts agree in a coordinate with
the probability of their weighted Jaccard similarity. Signatures are cut into bands. Of the texts that share a
band's value, each is compared by signature with its bucket's leaders, in one of a few orders: one like none of
them leads as well. What agrees well enough is compared exactly, and links join to classes by
alternating stars. Members of a bucket that aren't in one class by then are compared with each other, part by part: each
pair once, in the first bucket that it shares, exactly where its signatures agree, unless what the same task has found
has joined them meanwhile. Only links leave the task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfold.llm.common import arrow_map, free_name, pieces_of, text_of, written
from docfold.llm.words import Hasher, mixed, runs, spans

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
BATCH_BYTES = 2 << 20
#: Share of a signature's coordinates that must agree before texts are compared: a pair of similarity 0.8 has less
#: with probability 0.0003.
AGREE = 0.66
#: Members of a bucket that one task goes through, about; the leaders of a larger bucket's parts meet afterwards.
PART = 256
#: Orders in which buckets are gone through. With one, a large class has one leader in all of its buckets, and two like
#: texts that aren't leaders might never meet; with one for each band, each text is compared with twenty leaders.
ORDERS = 3
#: Characters of a part of a bucket, about, where its members are compared exactly.
PART_CHARS = 4 << 20
NONE = -(2**63)


def elements(texts: pa.Array, hasher: Hasher, length: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each (row, distinct shingle): row, shingle's hash, how often it occurs. A text of fewer words than
    ``length`` has one shingle, all of it; a text without words has none. Also the number of words of each
    row, and two hashes of its word sequence."""
    starts, ends, at, raw = spans(texts)
    words = hasher(starts, ends, raw)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), np.maximum(0, n - length + 1))
    first = np.cumsum(np.maximum(0, n - length + 1)) - np.maximum(0, n - length + 1)
    shingle = runs(words, length)[np.arange(len(row)) - first[row] + at[:-1][row]] if len(row) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < length))
    if len(short):
        row = np.concatenate([row, short])
        shingle = np.concatenate([shingle, [runs(words[at[i] : at[i + 1]], int(n[i]))[0] ^ np.uint64(n[i]) for i in short]]).astype(np.uint64)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    cut = np.flatnonzero(new)
    with np.errstate(over="ignore"):
        place = (np.arange(len(words)) - np.repeat(at[:-1], n)).astype(np.uint64)
        keys = []
        for salt in (0x51ED270B27F4A7C1, 0xB492B66FBE98F273):
            mix = mixed(words + (place + np.uint64(1)) * np.uint64(salt))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix, dtype=np.uint64)])
            keys.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return row[cut], shingle[cut], np.diff(np.append(cut, len(row))), n, np.stack(keys)


def _poisson(mean: float) -> np.ndarray:
    """The distribution function, until it is 1."""
    p = term = np.exp(-mean)
    out, k = [p], 0
    while out[-1] < 1 - 1e-15 and k < 20 * mean + 40:
        k += 1
        term *= mean / k
        p += term
        out.append(min(1.0, p))
    return np.array(out)


def _edge(j: int) -> int:
    """Where rank bands end: their areas double up to 256, beyond which a Poisson's tail would vanish."""
    return 2**j - 1 if j <= 8 else 255 + 256 * (j - 8)


def darts(row: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray, size: int) -> np.ndarray:
    """Sorted numbers (row * size + coordinate) << 42 | rank of all darts with a rank below their row's reach.

    The plane of an element is cut into weight bands [2^v - 1, 2^(v+1) - 1) and in each of them into rank bands
    of areas 1, 2, 4 and so on. How many darts a region has, and where, depends on element and region alone, so rows that share
    an element share its darts."""
    out = []
    v = 0
    while (on := np.flatnonzero(weight > 2**v - 1)).size:
        j = 0
        while True:
            low, high = _edge(j) / 2**v, _edge(j + 1) / 2**v
            on = on[reach[row[on]] > low]
            if not on.size:
                break
            with np.errstate(over="ignore"):
                seed = mixed(element[on] ^ np.uint64((v * 65536 + j + 1) * 0x9E3779B97F4A7C15 % 2**64))
                count = np.searchsorted(_poisson(float(_edge(j + 1) - _edge(j))), (seed >> np.uint64(11)) * 2.0**-53, "right")
                who = np.repeat(np.arange(len(on)), count)
                nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                a = mixed(seed[who] + (nth + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                rank = low + (high - low) * ((a >> np.uint64(11)) * 2.0**-53)
                r = row[on][who]
                keep = rank < reach[r]
                a, rank, r, w = a[keep], rank[keep], r[keep], weight[on][who][keep]
                b = mixed(a + np.uint64(0x632BE59BD9B4E019))
                keep = (2**v - 1) + 2**v * ((b >> np.uint64(11)) * 2.0**-53) < w
                coordinate = mixed(b[keep] ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(size)
            # A positive float's bits are ordered as it is; 42 of them tell darts apart.
            out.append(((r[keep].astype(np.uint64) * np.uint64(size) + coordinate) << np.uint64(42)) | (rank[keep].view(np.uint64) >> np.uint64(22)))
            j += 1
        v += 1
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """(n_rows, size): the least rank of each coordinate; rows without elements have zeros. Rows with an empty
    coordinate throw again, twice as far."""
    out = np.zeros(n_rows * size, np.uint64)
    total = np.bincount(row, weight, n_rows)
    far = size * (np.log(size) + 2.5)
    left = total > 0
    while left.any():
        on = left[row]
        number = np.cumsum(left) - 1
        rows = np.flatnonzero(left)
        # Ranks of 42 bits leave 22 for row and coordinate.
        per = max(1, (1 << 22) // size)
        ends = np.searchsorted(number[row[on]], np.arange(0, len(rows) + per, per))
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=False)):
            got = darts(number[row[on][a:b]] - k * per, element[on][a:b], weight[on][a:b], far / total[rows[k * per : (k + 1) * per]], size)
            key = got >> np.uint64(42)
            first = np.ones(len(got), bool)
            first[1:] = key[1:] != key[:-1]
            key = key[first].astype(np.int64)
            out[rows[k * per + key // size] * size + key % size] = got[first] & np.uint64((1 << 42) - 1)
        left &= (out.reshape(n_rows, size) == 0).any(axis=1)
        far *= 2
    return out.reshape(n_rows, size)


def banded(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = signature.reshape(len(signature), bands, rows)
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7), parts.shape[:2]).copy()
        for k in range(rows):
            h = mixed(h * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k])
    return h.view(np.int64)


def similarity(a: pa.Array, b: pa.Array, hasher: Hasher, length: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each pair of texts; 0 where one has no words."""
    n = len(a)
    sides = [elements(x, hasher, length) for x in (a, b)]
    row = np.concatenate([s[0] for s in sides])
    element = np.concatenate([s[1] for s in sides])
    weight = np.concatenate([s[2] for s in sides])
    order = np.lexsort((element, row))
    row, element, weight = row[order], element[order], weight[order]
    same = (row[1:] == row[:-1]) & (element[1:] == element[:-1])
    shared = np.bincount(row[1:][same], np.minimum(weight[1:], weight[:-1])[same], n)
    total = np.bincount(row, weight, n) - shared
    return np.where(total > 0, shared / np.maximum(total, 1), 0.0)


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, h1, h2, chars, bands, sig) of every row: two hashes of its word sequence, its bytes, the bands' values (none for a
    text without words), and 16 bits of each coordinate."""

    def make():
        hasher = Hasher()

        def each(batch: pa.RecordBatch):
            keys, values, sigs = [], [], []
            for part in pieces_of(batch, BATCH_BYTES):
                row, element, weight, n, hashes = elements(part.column("text"), hasher)
                signature = signatures(row, element, weight, part.num_rows, bands * rows)
                value = banded(signature, bands, rows)
                sigs += [x.tobytes() for x in signature.astype(np.uint16)]
                keys.append(hashes)
                values += [v if k else [] for v, k in zip(value.tolist(), n, strict=True)]
            keys = np.concatenate(keys, axis=1)
            return {"id": batch.column("id"), "h1": keys[0], "h2": keys[1], "chars": pc.binary_length(batch.column("text")), "bands": values, "sig": sigs}

        return each

    return arrow_map(docs.select("id", "text"), make, "id long, h1 long, h2 long, chars long, bands array<long>, sig binary")


def _led(rows: DataFrame, agree: float) -> DataFrame:
    """rows (band, part, parts, id, sig): pairs (a, b) of a member and each leader of its bucket's part that it agrees
    with, and the leaders of buckets of several parts (b null, with sig). A task streams over sorted rows and holds
    one part's leaders at a time."""

    def run(batches):
        key, leaders, ids = None, np.zeros((0, 0), np.uint16), []
        for batch in batches:
            sig = np.stack([np.frombuffer(x, np.uint16) for x in batch.column("sig").to_pylist()]) if batch.num_rows else None
            out: list[tuple[int, int, int | None, bytes | None]] = []
            for i, (band, part, parts, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("band", "part", "parts", "id")), strict=True)):
                if (band, part) != key:
                    key, ids, leaders = (band, part), [], np.zeros((4, sig.shape[1]), np.uint16)
                like = np.flatnonzero((leaders[: len(ids)] == sig[i]).mean(axis=1) >= agree) if ids else ()
                out += [(band, own, ids[k], None) for k in like if ids[k] != own]
                if not len(like):
                    if len(ids) == len(leaders):
                        leaders = np.concatenate([leaders, np.zeros_like(leaders)])
                    leaders[len(ids)] = sig[i]
                    ids.append(own)
                    if parts > 1:
                        out.append((band, own, None, sig[i].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["band", "a", "b", "sig"])

    order = F.xxhash64("id", F.pmod("band", F.lit(ORDERS)))
    sorted_ = rows.repartition("band", "part").sortWithinPartitions("band", "part", order)
    return sorted_.select("band", "part", "parts", "id", "sig").mapInArrow(run, "band long, a long, b long, sig binary")


def _bags(texts: DataFrame) -> DataFrame:
    """(id, bag) of (id, text): the shingles of a text, the repetitions of one counting as different ones."""

    def make():
        hasher = Hasher()

        def each(batch: pa.RecordBatch):
            bags, sizes = [], []
            for part in pieces_of(batch, BATCH_BYTES):
                row, shingle, weight, *_ = elements(part.column("text"), hasher)
                times = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                with np.errstate(over="ignore"):
                    every = np.repeat(shingle, weight) + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                bags.append(every.view(np.int64))
                sizes.append(np.bincount(row, weight, part.num_rows).astype(np.int64))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            return {"id": batch.column("id"), "bag": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bags)))}

        return each

    return arrow_map(texts.select("id", "text"), make, "id long, bag array<long>")


def _alike(a: frozenset[int], b: frozenset[int], least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) >= least


def _apart(members: DataFrame, texts: DataFrame, firsts: DataFrame, links: DataFrame, agree: float, least: float) -> DataFrame:
    """members (id, band): links (a, b) between bucket members that ``links`` leave in different classes, enough to join all
    that belong together.

    In each bucket, the members outside of its largest class meet all members, in blocks of a part of the ones and a
    part of the others. A task holds one part."""
    roots = components(links).withColumnRenamed("v", "id")
    placed = members.join(roots, "id", "left").select("id", "band", "chars", F.coalesce("root", "id").alias("class"))
    placed = written(placed, "members")
    sizes = placed.groupBy("band", "class").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    parts = lambda n, chars: F.greatest(F.ceil(n / PART), F.ceil(chars / PART_CHARS), F.lit(1)).cast("int")
    top = sizes.groupBy("band").agg(F.max(F.struct("n", "class", "chars")).alias("top"), F.sum("n").alias("n"), F.sum("chars").alias("chars")).where("n > top.n")
    top = written(top.select("band", F.col("top.class").alias("top"), parts(F.col("n"), F.col("chars")).alias("ins"), parts(F.col("n") - F.col("top.n"), F.col("chars") - F.col("top.chars")).alias("outs")), "mixed")
    placed = placed.join(top, "band").withColumn("minor", F.col("class") != F.col("top"))
    needed = written(placed.select("id").distinct(), "needed")
    details = written(firsts.join(needed, "id", "left_semi").select("id", "sig", "bands").join(_bags(texts.join(needed, "id", "left_semi")), "id"), "details")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    hosts = placed.select("id", "band", "class", "minor", F.lit(False).alias("guest"), own("ins").alias("part"), every("outs").alias("from"))
    guests = placed.where("minor").select("id", "band", "class", "minor", F.lit(True).alias("guest"), own("outs").alias("from"), every("ins").alias("part"))

    def run(batches):
        key, hosts, table, joined = None, [], None, {}
        bags: dict[int, frozenset[int]] = {}

        def find(c: int) -> int:
            while (up := joined.get(c, c)) != c:
                joined[c] = c = joined.get(up, up)
            return c

        for batch in batches:
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("band", "part", "from", "guest", "minor", "class", "id", "sig")]
            rows_ = batch.column("bands"), batch.column("bag")
            for n, (band, part, other, guest, minor, cls, id_, sig) in enumerate(zip(*columns, strict=True)):
                if (band, part, other) != key:
                    key, hosts, table, joined, bags = (band, part, other), [], None, {}, {}
                if not guest:
                    hosts.append((sig, rows_[0][n].values.to_numpy(), minor, cls, id_, rows_[1][n].values))
                    table = None
                    continue
                if not hosts:
                    continue
                if table is None:
                    table = np.stack([np.frombuffer(h[0], np.uint16) for h in hosts]), np.stack([h[1] for h in hosts]), *(np.array([h[k] for h in hosts]) for k in (2, 3, 4))
                sigs, values, minors, classes, ids = table
                share = (sigs == np.frombuffer(sig, np.uint16)).mean(axis=1)
                # Two that are both outside of the largest class meet twice.
                like = np.flatnonzero((share >= agree) & (classes != cls) & (~minors | (ids > id_)))
                if not len(like):
                    continue
                common = (values[like] == rows_[0][n].values.to_numpy()).argmax(axis=1)  # a pair is compared in the first bucket that it shares
                like = like[values[like, common] == band]
                mine = None
                for k in like[np.argsort(-share[like], kind="stable")].tolist():
                    if find(int(classes[k])) == find(cls):
                        continue
                    if mine is None:
                        mine = frozenset(rows_[1][n].values.tolist())
                    if (its := bags.get(k)) is None:
                        its = bags[k] = frozenset(hosts[k][5].tolist())
                    if _alike(mine, its, least):
                        joined[find(int(classes[k]))] = find(cls)
                        a.append(id_)
                        b.append(int(ids[k]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = hosts.unionByName(guests).join(details, "id").repartition("band", "part", "from").sortWithinPartitions("band", "part", "from", "guest", "id")
    return rows.select("band", "part", "from", "guest", "minor", "class", "id", "sig", "bands", "bag").mapInArrow(run, "a long, b long")


def _verified(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) with ``same``: whether their texts are of similarity ``least`` or more."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def make():
        hasher = Hasher()

        def each(batch: pa.RecordBatch):
            same = []
            for part in pieces_of(batch, BATCH_BYTES, "text_a"):
                for piece in pieces_of(part, BATCH_BYTES, "text_b"):
                    same.append(similarity(piece.column("text_a"), piece.column("text_b"), hasher) >= least)
            return {"a": batch.column("a"), "b": batch.column("b"), "same": np.concatenate(same)}

        return each

    return arrow_map(both.select("a", "b", "text_a", "text_b"), make, "a long, b long, same boolean")


def components(links: DataFrame, per_task: int = 50_000) -> DataFrame:
    """(v, root) of every end of ``links`` (a, b): the least vertex that it is joined with.

    Alternating stars: each vertex's larger neighbours, then all smaller ones, are linked to its least one,
    until nothing changes. Neighbours are never listed; only their minimum is taken. Tables get a file for about ``per_task``
    edges, as rounds of few edges would otherwise spend their time on files."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        files = -(-before[0] // per_task) + 3
        some = lambda df, name: written(df.coalesce(files), name)  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = some(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = some(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = some(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = some(small.where("u <> v").distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())


def near_classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, agree: float = AGREE) -> DataFrame:
    """``doc_id, class_id, class_size`` of every row of ``docs``; class_id is the least doc_id of the class.

    Texts of one word sequence are copies and share a class without being compared; texts without words (null,
    empty, white space) are alone, each in a class of its own. Rows that repeat a doc_id are one document:
    what is linked to one of them is linked to all; so are rows with a null doc_id, which counts as smaller
    than any other. A pair of similarity ``least`` shares a band with probability 1 - (1 - least**rows)**bands
    (0.9996 by default), and is looked at if ``agree`` of its
    coordinates agree; no bucket is capped or sampled, and what shares one is compared unless it is in one class anyway. Texts
    of any length are read whole. Other columns are ignored; no rows in, no rows out."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("id"), text_of().alias("text"))
    signs = written(signed(texts, bands, rows), "signatures")
    worded = signs.where(F.size("bands") > 0)
    copies = written(worded.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "copies")
    own = worded.select("id", "h1", "h2").join(copies.where("n > 1"), ["h1", "h2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    firsts = worded.join(copies.select("h1", "h2", F.col("rep").alias("id")), ["h1", "h2", "id"], "left_semi")
    # Two texts of one id are two rows here: both lead and follow under their document's id.
    firsts = written(firsts.select("id", "sig", "bands", "chars"), "firsts")
    buckets = firsts.select("id", F.explode("bands").alias("band"))
    shared = written(buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", "n", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "shared")
    members = buckets.join(shared, "band").select("id", "band", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    asked, waiting = [], members.distinct().join(firsts.select("id", "sig"), "id")
    before = None
    while True:
        led = written(_led(waiting, agree), "led")
        asked.append(led.where("b is not null").select("a", "b"))
        # The leaders of buckets of several parts meet again, dealt anew, as long as that leaves less than half of them.
        alone = led.where("b is null").select("band", F.col("a").alias("id"), "sig")
        count = alone.count()
        if not count or (before is not None and 2 * count > before):
            break
        before = count
        again = written(alone.groupBy("band").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "again")
        waiting = alone.join(again, "band").withColumn("part", F.pmod(F.xxhash64("id", F.lit(len(asked))), F.col("parts")).cast("int"))
    asked = reduce(DataFrame.unionByName, asked)
    pairs = asked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = written(_verified(texts, written(pairs, "pairs"), least).where("same").select("a", "b"), "judged")
    # In a bucket of two in one part, the leader has met the other one.
    crowded = firsts.select("id", "chars", F.explode("bands").alias("band")).join(shared.where("n > 2 OR parts > 1").select("band"), "band").select("id", "band", "chars").distinct()
    links = own.unionByName(links).unionByName(written(_apart(crowded, texts, firsts, links, agree, least), "apart"))
    roots = written(components(links), "roots")
    out = texts.select("id").join(roots.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("class"), F.col("root").isNotNull().alias("linked"))
    return sized(written(out, "classes"))


def sized(out: DataFrame) -> DataFrame:
    """With class sizes. They are written, so that the join can split the rows of a class of a third of all."""
    sizes = written(out.groupBy("class").agg(F.count("*").alias("n")), "sizes")
    plain = lambda c: F.when(F.col(c) > NONE, F.col(c))
    joined = out.join(sizes, "class")
    return joined.select(plain("id").alias("doc_id"), plain("class").alias("class_id"), F.col("n").alias("class_size"))


def without_near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the one of the least doc_id.

    Texts without words (null, empty) are each alone and stay; rows that repeat a doc_id stay or go together; rows with a
    null doc_id are one document. All columns are kept as they are; no rows in, no rows out."""
    key = free_name(docs, "_id")
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias(key)
    chosen = near_classes(docs, least).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(id_of)
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))).join(chosen, key, "left_semi").select(*docs.columns)
