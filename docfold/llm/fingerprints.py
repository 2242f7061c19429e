"""Document fingerprints by invertible Bloom lookup tables. DataFrame operations only.

A text's cells are its paragraphs, long ones cut into runs of 32 words; their digests are put into three
slots each of a small table, which keeps a count, the XOR of digests and the XOR of their checks. Two tables
are subtracted slot by slot: what the versions share vanishes, and peeling slots that hold one digest
recovers those that differ. If peeling gets stuck, a larger table is tried, then a twice as large one, then
the digests themselves are compared. The likeness of two versions is shared / (shared + differing).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfold.llm.common import text_of

#: Slots for each of the three hashes in the fingerprint itself.
BASE_SLOTS = 8
#: Digests that a table of several parts has in each part, about, and the slots for them.
PART, PART_SLOTS = 32, 64
CELL = r"r'(?:\S++[^\S\n]*+){1,32}'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def digests(text: str) -> str:
    """SQL: the distinct digests of the cells of a text."""
    return f"array_distinct(transform(regexp_extract_all({text}, {CELL}, 0), p -> xxhash64(p)))"


def _places(key: str, slots: str) -> str:
    return ", ".join(f"cast({j} * {slots} + pmod(xxhash64({key}, {13 + j}, {slots}), {slots}) AS int) AS p{j}" for j in range(3))


def _table(keys: str, slots: str, parts: str, part: str) -> str:
    """SQL: the cells (c, k, h) of one part of the table of an array of digests."""
    placed = f"transform(filter({keys}, k -> {parts} = 1 OR pmod(xxhash64(k, 11), {parts}) = {part}), k -> struct(k, xxhash64(k, 12) AS h, {_places('k', slots)}))"
    cell = "aggregate(filter(mine, o -> o.p0 = i OR o.p1 = i OR o.p2 = i), struct(0 AS c, 0L AS k, 0L AS h), (u, o) -> struct(u.c + 1 AS c, u.k ^ o.k AS k, u.h ^ o.h AS h))"
    return _let("mine", placed, f"transform(sequence(0, 3 * {slots} - 1), i -> {cell})")


def _peeled(cells: str, slots: str) -> str:
    """SQL: how many digests peeling recovers from subtracted cells; null if some are left."""
    pure = "array_distinct(transform(filter(st.cells, x -> abs(x.c) = 1 AND x.h = xxhash64(x.k, 12)), x -> struct(x.c AS c, x.k AS k)))"
    placed = f"transform(pure, x -> struct(x.c AS c, x.k AS k, xxhash64(x.k, 12) AS h, {_places('x.k', slots)}))"
    less = "transform(st.cells, (x, i) -> aggregate(filter(out, o -> o.p0 = i OR o.p1 = i OR o.p2 = i), x, (u, o) -> struct(u.c - o.c AS c, u.k ^ o.k AS k, u.h ^ o.h AS h)))"
    went = f"CASE WHEN size(pure) = 0 THEN struct(st.cells AS cells, st.n AS n, false AS going) ELSE {_let('out', placed, f'struct({less} AS cells, st.n + size(pure) AS n, true AS going)')} END"
    step = f"CASE WHEN st.going THEN {_let('pure', pure, went)} ELSE st END"
    return f"aggregate(sequence(1, 40), struct({cells} AS cells, 0 AS n, true AS going), (st, r) -> {step}, st -> CASE WHEN forall(st.cells, x -> x.c = 0 AND x.k = 0 AND x.h = 0) THEN st.n END)"


def _differing(a: str, b: str, slots: str, parts: str) -> str:
    """SQL: how many digests are in one array only, by tables of ``parts`` parts; null if peeling fails."""
    cells = f"zip_with({_table(a, slots, parts, 'part')}, {_table(b, slots, parts, 'part')}, (x, y) -> struct(x.c - y.c AS c, x.k ^ y.k AS k, x.h ^ y.h AS h))"
    return f"aggregate(sequence(0, {parts} - 1), 0, (n, part) -> CASE WHEN n IS NULL THEN NULL ELSE n + {_peeled(cells, slots)} END)"


def likeness(a: str, b: str) -> str:
    """SQL: of two arrays of digests (names of columns or variables), 0 to 1; two empty ones are alike."""
    exponent = f"cast(ceil(log2(greatest(size({a}), size({b}), 4))) AS int)"
    slots = f"cast(shiftleft(1, least(ex, {PART_SLOTS.bit_length() - 1})) AS int)"
    parts = f"cast(shiftleft(1, greatest(ex - {PART.bit_length() - 1}, 0)) AS int)"
    larger = _let("ex", exponent, _let("s", slots, _let("t", parts, f"coalesce({_differing(a, b, 's', 't')}, {_differing(a, b, '(2 * s)', 't')})")))
    # A sum of sizes that the first table can't hold is no reason to skip it: close versions differ little.
    n = f"coalesce({_differing(a, b, str(BASE_SLOTS), '1')}, {larger}, size(array_except({a}, {b})) + size(array_except({b}, {a})))"
    return f"CASE WHEN size({a}) + size({b}) = 0 THEN 1D ELSE {_let('d', n, f'(size({a}) + size({b}) - d) / cast(size({a}) + size({b}) + d AS double)')} END"


def sketch(keys: str) -> str:
    """SQL: the fingerprint of an array of digests: their number, then each cell in hexadecimal."""
    cells = _table(keys, str(BASE_SLOTS), "1", "0")
    return f"concat(size({keys}), ':', array_join(transform({cells}, x -> concat(hex(x.c), '.', hex(x.k), '.', lpad(hex(x.h), 4, '0'))), ','))"


def _ranges(ids: DataFrame, per_range: int, most: int) -> Column:
    """The number of the range that ``id`` is in: ranges between quantiles of all ids, so that each has about
    ``per_range`` rows however the ids lie, ``most`` ranges at most. The bounds are a literal of two levels, gone through one
    after another."""
    count = max(1, min(most, -(-ids.count() // per_range)))
    bounds: list[int] = []
    if count > 1:
        shares = "array(" + ",".join(f"{k / count}D" for k in range(1, count)) + ")"
        found = ids.select(F.expr(f"percentile_approx(id, {shares}, {max(10_000, 4 * count)})")).first()[0]
        bounds = sorted(set(found or ()))
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    if not groups:
        return F.lit(0).cast("long")
    literal = F.from_json(F.lit(json.dumps([{"low": g[0], "all": g} for g in groups])), "array<struct<low:bigint,all:array<bigint>>>")
    group = F.size(F.filter(literal, lambda g: g["low"] <= F.col("id"))) - 1
    inside = F.size(F.filter(F.get(literal, group)["all"], lambda x: x <= F.col("id")))
    return F.when(group < 0, 0).otherwise(group * width + inside).cast("long")


def with_next(docs: DataFrame, per_range: int = 256, most_ranges: int = 1 << 16) -> DataFrame:
    """(doc_id, text, next_text): of the next row by doc_id (null first, repeated ids by the text's hash),
    of the first row after the last. Ids are cut into ranges of about equal numbers of rows; rows of one id share a range.
    Each range's first document, found with a broadcast table of ``most_ranges`` rows at most, is a guest at the end of
    the range before it, so rows are shuffled once and no task gets more than one range at a time."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), text_of().alias("text"))
    bucket = _ranges(d.select("id"), per_range, most_ranges)
    heads = d.select("id", bucket.alias("bucket")).groupBy("bucket").agg(F.min("id").alias("id"))
    order = Window.orderBy("bucket")  # of a row for each range
    hosts = heads.select("id", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("host"), F.lag("bucket").over(order).isNull().alias("around"))
    guests = d.join(F.broadcast(hosts), "id").select("id", "text", F.col("host").alias("bucket"), F.when(F.col("around"), 2).otherwise(1).alias("guest"))
    rows = d.select("id", "text", bucket.alias("bucket"), F.lit(0).alias("guest")).unionByName(guests)
    by = Window.partitionBy("bucket").orderBy("guest", "id", F.xxhash64("text"), "text")
    out = rows.withColumn("next_text", F.lead("text").over(by)).where("guest = 0")
    return out.select(F.when(F.col("id") > -(2**63), F.col("id")).alias("doc_id"), "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, digests) of every row of ``docs``. Texts of the same words and line ends have
    equal fingerprints; a null text is the empty one, without cells."""
    d = docs.select("doc_id", text_of().alias("text"))
    return d.selectExpr("doc_id", f"{_let('own', digests('text'), f'struct({sketch('own')} AS fingerprint, own AS digests)')} AS x").select("doc_id", "x.*")


def edited(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how like it is to that and to the next one's.

    The edited text has the last floor(n / 2) code points replaced by the first as many of the next text.
    ``near_*`` are those of the whole sketch that grows until it peels: two of the returned 24-slot fingerprints give the
    same number where they differ in so few cells that they peel, else larger tables are made from the digests.
    Null texts are empty ones; a single row is its own next; repeated rows are neighbours of each other;
    other columns are ignored; no rows in, no rows out."""
    pairs = with_next(docs)
    n = "length(text)"
    rows = pairs.selectExpr("doc_id", f"cast({n} AS long) AS n_chars", "text", "next_text", f"concat(substring(text, 1, {n} - {n} div 2), substring(next_text, 1, {n} div 2)) AS edited")
    both = f"struct({sketch('own')} AS fingerprint, {sketch('edit')} AS edited_fingerprint, {likeness('own', 'edit')} AS near_edited, {likeness('own', 'follow')} AS near_next)"
    all_ = _let("own", digests("text"), _let("edit", digests("edited"), _let("follow", digests("next_text"), both)))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(all_).alias("x")).select("doc_id", "n_chars", "edited_sha256", "x.*")
