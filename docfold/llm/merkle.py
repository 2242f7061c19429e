"""Merkle manifest of a dataset: a digest of every row, a tree for each language, one root, and proofs.

Rows become leaves inside the JVM. They are numbered within their tree by range partitions and those partitions' counts.
Blocks of 512 consecutive nodes (three levels of eight) are reduced by tasks, round after round, until at most
``TOP`` nodes are left. The driver builds the tree above these, and what it broadcasts is each one's path to the root. Tasks
then carry the paths down the same blocks, round by round, and fold every leaf to the root. What the driver holds is bounded by
``TOP``: a number of trees beyond it is reduced by tasks as well, as the nodes of one tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfold.llm.common import written

WIDTH, LEVELS = 8, 3
BLOCK = WIDTH**LEVELS
#: Nodes that the driver takes at most, and whose paths (14 levels of seven digests at the very most) are broadcast.
TOP = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"
Path = list[tuple[str, str]]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(columns: dict[str, Column]) -> Column:
    """The digest of a row's values in order: each ``-`` if null, else its bytes' number, ``:`` and itself."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(value, columns.values())), 256)


def lower_cased(docs: DataFrame) -> DataFrame:
    """What the manifest's query tampers with: A-Z of the texts whose id's crc32 is divisible by three."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return docs.withColumn("text", F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))


def leaves(docs: DataFrame, change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(tree, doc_id, leaf, now): ``leaf`` of each row as it is, ``now`` of the row that ``change`` makes of it, null if
    that is the same. ``tree`` is empty for a null language, else ``=`` and the language, so that bytes order them."""
    of = lambda d: row_digest({c: d[c] for c in LEAF})
    rows = docs.select(*LEAF)
    own = rows.select("*", of(rows).alias("leaf"))
    if change:
        own = change(own)
        now = of(own)
        own = own.select("*", F.when(now != F.col("leaf"), now).alias("now"))
    else:
        own = own.withColumn("now", F.lit(None).cast("string"))
    return own.select(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), "leaf", "now")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``idx`` (from 0, in ``order`` within ``tree``) and ``n``, their tree's number of rows.

    Range partitions are sorted and written; a row's number is its place in its partition and what its tree has in the
    partitions before. Rows alike in ``order`` are told apart by where they were read, so one value's can span partitions."""
    at = rows.withColumn("_at", F.monotonically_increasing_id())
    placed = at.repartitionByRange("tree", *order, "_at").sortWithinPartitions("tree", *order, "_at").drop("_at").withColumn("place", F.monotonically_increasing_id())
    placed = written(placed, "placed").withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(tree).alias("n"))
    joined = placed.join(written(parts, "parts"), ["tree", "part"])
    return joined.select(*rows.columns, (F.col("place") - F.col("first") + F.col("before")).alias("idx"), "n")


def levels(nodes: list[str], n: int) -> list[list[str]]:
    """A block's nodes and the levels above them: three if its tree has further blocks, else as long as several nodes remain."""
    out = [nodes]
    while len(out) <= LEVELS if n > BLOCK else len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + WIDTH])) for i in range(0, len(out[-1]), WIDTH)])
    return out


def path(built: list[list[str]], i: int) -> Path:
    """The siblings left and right of node ``i`` and of what it becomes, level by level."""
    out = []
    for level in built[:-1]:
        run, at = level[i - i % WIDTH : i - i % WIDTH + WIDTH], i % WIDTH
        out.append(("".join(run[:at]), "".join(run[at + 1 :])))
        i //= WIDTH
    return out


def fold(leaf: str, siblings: Path) -> str:
    for left, right in siblings:
        leaf = digest(left + leaf + right)
    return leaf


def _blocks(rows: DataFrame, columns: list[str], each: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``each`` of the rows of every block, in order of ``idx``. A task holds one block at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["tree"], row["idx"] // BLOCK) != key:
                    out += each(held) if held else []
                    key, held = (row["tree"], row["idx"] // BLOCK), []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)
        if held:
            yield pa.RecordBatch.from_pylist(each(held), kind)

    dealt = rows.withColumn("block", F.expr(f"idx div {BLOCK}")).repartition("tree", "block").sortWithinPartitions("tree", "idx")
    return dealt.select(*columns).mapInArrow(run, schema)


def _raised(nodes: DataFrame) -> DataFrame:
    """The nodes (tree, idx, n, digest) three levels above, or their trees' roots."""

    def each(block: list[dict]) -> list[dict]:
        n = block[0]["n"]
        return [{"tree": block[0]["tree"], "idx": block[0]["idx"] // BLOCK, "n": -(-n // BLOCK), "digest": levels([x["digest"] for x in block], n)[-1][0]}]

    return _blocks(nodes, ["tree", "idx", "n", "digest"], each, "tree string, idx long, n long, digest string")


def _with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with their block's path and subroot on its first node."""
    first = F.col("idx") % BLOCK == 0
    up = above.select("tree", F.col("idx").alias("up"), "path", "subroot")
    heads = nodes.where(first).withColumn("up", F.expr(f"idx div {BLOCK}")).join(up, ["tree", "up"]).select(*nodes.columns, "path", "subroot")
    rest = nodes.where(~first).select("*", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    return heads.unionByName(rest)


def _pairs(siblings: list) -> Path:
    return [(x["l"], x["r"]) for x in siblings]


def _lowered(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, idx, path, subroot) of ``nodes`` from those of the blocks above them."""

    def each(block: list[dict]) -> list[dict]:
        built, up = levels([x["digest"] for x in block], block[0]["n"]), block[0]["path"]
        return [{"tree": x["tree"], "idx": x["idx"], "path": [{"l": a, "r": b} for a, b in path(built, i)] + up, "subroot": block[0]["subroot"]} for i, x in enumerate(block)]

    return _blocks(_with_paths(nodes, above), ["tree", "idx", "n", "digest", "path", "subroot"], each, f"tree string, idx long, path {PATH}, subroot string")


def _finished(nodes: DataFrame, above: DataFrame, root: str, keep_paths: bool) -> DataFrame:
    """Leaves (tree, idx, n, doc_id, leaf, now) with their proofs, folded."""

    def each(block: list[dict]) -> list[dict]:
        built, up, out = levels([x["leaf"] for x in block], block[0]["n"]), _pairs(block[0]["path"]), []
        tail = "".join(a + b for a, b in up)
        for i, x in enumerate(block):
            own = path(built, i)
            row = {"doc_id": x["doc_id"], "leaf": x["leaf"], "subroot": block[0]["subroot"], "root": root, "proof_sha256": digest("".join(a + b for a, b in own) + tail)}
            row["folded_root"] = fold(x["now"] or x["leaf"], own + up)
            row["verified"] = row["folded_root"] == root
            if keep_paths:
                row["proof"] = [{"l": a, "r": b} for a, b in own + up]
            out.append(row)
        return out

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", proof {PATH}" if keep_paths else "")
    return _blocks(_with_paths(nodes, above), ["tree", "idx", "n", "doc_id", "leaf", "now", "path", "subroot"], each, schema)


def _whole(nodes: list[str]) -> list[list[str]]:
    """All levels above ``nodes``, to the one that remains."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + WIDTH])) for i in range(0, len(out[-1]), WIDTH)])
    return out


def top(rows: list[tuple[str, int, str]]) -> tuple[str, list[tuple[str, int, Path, str]]]:
    """The root above the nodes (tree, idx, digest), and each one's path to it and subroot. Plain: on the driver."""
    trees: dict[str, list[str]] = {}
    for tree, _, node in sorted(rows, key=lambda r: (r[0].encode(), r[1])):
        trees.setdefault(tree, []).append(node)
    built = {tree: _whole(nodes) for tree, nodes in trees.items()}
    roots = _whole([b[-1][0] for b in built.values()])
    return roots[-1][0], [(tree, i, path(b, i) + path(roots, k), b[-1][0]) for k, (tree, b) in enumerate(built.items()) for i in range(len(b[0]))]


def manifest(rows: DataFrame, most: int = TOP, keep_paths: bool = False) -> DataFrame:
    """Of the leaves (tree, doc_id, leaf, now): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and
    ``proof`` (the siblings left and right of each level) if ``keep_paths``.

    ``folded_root`` is ``now`` (where null: the leaf) folded with the original siblings. Leaves ascend by doc_id within their
    tree, null first; those of one doc_id by their digests; equal ones in any order, which changes nothing but which of them
    has which proof. Null columns have their own digest. No rows in, no rows out."""
    spark = rows.sparkSession
    # Written first, as ranges are told from a sample of all rows: texts are read and hashed once.
    base = written(numbered(written(rows, "hashed"), ["doc_id", "leaf"]), "leaves")
    done = [("blocks", base.select("tree", "idx", "n", F.col("leaf").alias("digest")))]
    nodes = written(_raised(done[0][1]), "nodes")
    while (size := nodes.agg(F.count("*").alias("rows"), F.max("n").alias("n")).first()).rows > most:
        if size.n > 1:
            done.append(("blocks", nodes))
            nodes = written(_raised(nodes), "nodes")
        else:  # as many trees: their roots are the nodes of one tree
            ranked = numbered(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"])
            done.append(("roots", ranked := written(ranked, "roots")))
            nodes = written(_raised(ranked.select("tree", "idx", "n", "digest")), "nodes")
    held = [tuple(r) for r in nodes.select("tree", "idx", "digest").collect()]
    if not held:
        return _finished(base, base.sparkSession.createDataFrame([], f"tree string, idx long, path {PATH}, subroot string"), "", keep_paths)
    root, paths = top(held)
    above = F.broadcast(spark.createDataFrame([(t, i, p, s) for t, i, p, s in paths], f"tree string, idx long, path {PATH}, subroot string"))
    for kind, below in reversed(done[1:]):
        if kind == "blocks":
            above = _lowered(below, above)
        else:
            above = _lowered(below.select("tree", "idx", "n", "digest"), above).drop("subroot").join(below, ["tree", "idx"])
            above = above.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"))
        above = written(above, "paths")
    return _finished(base, above, root, keep_paths)
