"""Exact duplicates by composable polynomial fingerprints.

A text's UTF-8 bytes are the digits of a number in base 256; its fingerprint is that number modulo a
128-bit prime. Chunks are hashed apart and combined by length-shifted arithmetic,
``H(a + b) = H(a) * 256**len(b) + H(b)``, so that a huge text's chunks can be hashed by many tasks.
Texts of equal fingerprint and length are then compared chunk by chunk with one member of their group;
what differs from it forms the next round's groups, so collisions cost time but never a wrong result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfold.llm.common import free_name, text_of, written

PRIME = 2**128 - 159
CHUNK = 1 << 16


def combine(left: int, right: int, right_length: int) -> int:
    """The fingerprint of two byte strings joined, from theirs and the second's length."""
    return (left * pow(256, right_length, PRIME) + right) % PRIME


def fingerprint(data: bytes, chunk: int = CHUNK) -> int:
    """Of whole bytes, by combining its chunks' fingerprints."""
    value = 0
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk]
        value = combine(value, int.from_bytes(part, "big") % PRIME, len(part))
    return value


def _hashed(texts: pd.Series) -> pd.Series:
    return pd.Series([f"{fingerprint(x.encode()):032x}" for x in texts], dtype=object)


def _combined(parts: pd.Series) -> pd.Series:
    out = []
    for chunks in parts:
        value = 0
        for c in sorted(chunks, key=lambda c: c["no"]):
            value = combine(value, int(c["fp"], 16), c["size"])
        out.append(f"{value:032x}")
    return pd.Series(out, dtype=object)


def fingerprints(docs: DataFrame, huge_chars: int = 8 << 20) -> DataFrame:
    """Adds ``text_sha256``, ``n_bytes`` and ``fp`` to (doc_id, text). Texts of more than
    ``huge_chars`` characters are cut natively and their chunks dealt to other tasks."""
    hashed, combined = F.pandas_udf(_hashed, "string"), F.pandas_udf(_combined, "string")
    d = docs.select("doc_id", text_of().alias("text"))
    key = [F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes")]
    small = d.where(F.length("text") <= huge_chars).select("doc_id", *key, hashed("text").alias("fp"))
    huge = d.where(F.length("text") > huge_chars)
    cut = huge.select(*key, "text").select("text_sha256", "text", F.explode(F.expr(f"sequence(0, (length(text) - 1) div {huge_chars})")).alias("no"))
    cut = cut.select("text_sha256", "no", F.expr(f"substring(text, cast(no as int) * {huge_chars} + 1, {huge_chars})").alias("text")).repartition("text_sha256", "no")
    whole = cut.select("text_sha256", "no", F.octet_length("text").alias("size"), hashed("text").alias("fp")).dropDuplicates(["text_sha256", "no"])
    whole = whole.groupBy("text_sha256").agg(F.collect_list(F.struct("no", "size", "fp")).alias("parts")).select("text_sha256", combined("parts").alias("fp"))
    return small.unionByName(huge.select("doc_id", *key).join(whole, "text_sha256").select("doc_id", "text_sha256", "n_bytes", "fp"))


def _compared(docs: DataFrame, members: DataFrame, per_salt: int) -> DataFrame:
    """members: (id, text_sha256, keep, keep_sha, n). Adds ``same``: whether the texts are equal, chunk by
    chunk. A large group's members are dealt over salts, and its kept text to each of them, so no task
    gets more than about ``per_salt`` members of one group."""
    texts = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), text_of().alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    salts = F.ceil(F.col("n") / per_salt).cast("long")
    own = members.select("id", "text_sha256", "keep", "keep_sha", F.pmod(F.xxhash64("id", "text_sha256"), salts).alias("salt"), F.lit(False).alias("kept"))
    rep = members.select(F.col("keep").alias("id"), F.col("keep_sha").alias("text_sha256"), "keep", "keep_sha", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(True).alias("kept"))
    wanted = own.distinct().unionByName(rep.distinct())
    # The kept text's salts are listed, not repeated, until its text is fetched.
    wanted = wanted.groupBy("id", "text_sha256", "keep", "keep_sha", "kept").agg(F.collect_list("salt").alias("salts"))
    got = texts.join(wanted, ["id", "text_sha256"]).withColumn("salt", F.explode("salts"))
    cut = got.select("id", "text_sha256", "keep", "keep_sha", "salt", "kept", "text", F.explode(F.expr(f"sequence(0, greatest(length(text) - 1, 0) div {CHUNK})")).alias("no"))
    cut = cut.withColumn("text", F.expr(f"substring(text, cast(no as int) * {CHUNK} + 1, {CHUNK})"))
    on = ["keep", "keep_sha", "salt", "no"]
    pairs = cut.where("not kept").drop("kept").join(cut.where("kept").select(*on, F.col("text").alias("kept_text")).dropDuplicates(on), on, "left")
    return pairs.groupBy("id", "text_sha256", "keep").agg(F.every(F.coalesce(F.col("text") == F.col("kept_text"), F.lit(False))).alias("same"))


def exact_groups(docs: DataFrame, huge_chars: int = 8 << 20, per_salt: int = 128) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts, the row with the largest doc_id stays. A null text is the empty one. A null doc_id
    counts as smaller than any other and stays null. Rows repeated with one doc_id and text are all
    reported, counted in ``group_size``, and all marked alike. Other columns are ignored. An empty table
    gives no rows."""
    base = written(fingerprints(docs, huge_chars).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "text_sha256", "n_bytes", "fp"), "fingerprints")
    left, found = base, None
    while True:
        groups = left.groupBy("fp", "n_bytes").agg(F.max(F.struct("id", "text_sha256")).alias("top"), F.count("*").alias("n"))
        groups = written(groups.where("n > 1").select("fp", "n_bytes", "n", F.col("top.id").alias("keep"), F.col("top.text_sha256").alias("keep_sha")), "repeated")
        members = left.join(groups, ["fp", "n_bytes"]).where("id <> keep or text_sha256 <> keep_sha").select("id", "text_sha256", "keep", "keep_sha", "n")
        judged = written(_compared(docs, members, per_salt), "compared")
        same = judged.where("same").select("id", "text_sha256", "keep")
        found = same if found is None else found.unionByName(same)
        differing = judged.where("not same").select("id", "text_sha256")
        if differing.isEmpty():
            break
        left = left.join(differing, ["id", "text_sha256"], "left_semi")
    out = base.join(found, ["id", "text_sha256"], "left").select("id", "text_sha256", F.coalesce("keep", "id").alias("keep"), F.coalesce(F.col("keep") == F.col("id"), F.lit(True)).alias("kept"))
    # Written, so that the join has the plain rows of a hot group on one side and can split them.
    out = written(out, "groups")
    sizes = written(out.groupBy("keep", "text_sha256").agg(F.count("*").alias("group_size")), "sizes")
    plain = lambda c: F.when(F.col(c) > -(2**63), F.col(c))
    return out.join(sizes, ["keep", "text_sha256"]).select(plain("id").alias("doc_id"), plain("keep").alias("keep_id"), "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text: the one of the largest doc_id. Rows that repeat a doc_id and text
    are one row after. A null text is the empty one; a null doc_id counts as smaller than any other; other columns are kept as they are,
    whatever their names; no rows in, no rows out."""
    kept = exact_groups(docs).where("kept")
    key, sha = free_name(docs, "_id"), free_name(docs, "_sha")
    id_of = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    rows = docs.withColumn(key, id_of("doc_id")).withColumn(sha, F.sha2(text_of(), 256))
    chosen = kept.select(id_of("doc_id").alias(key), F.col("text_sha256").alias(sha))
    return rows.join(chosen, [key, sha], "left_semi").dropDuplicates([key, sha]).select(*docs.columns)
