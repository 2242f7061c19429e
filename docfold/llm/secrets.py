"""Secret scans by an incremental ledger of blobs. DataFrame operations only.

A blob is a text under its SHA-256. The ledger has a row for each pair of blob and rule version that was
scanned, with what was found. A scan takes the versions of all paths, scans each pair that the ledger
doesn't have once, however many paths and versions share the blob, and joins findings back to the paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfold.llm.common import free_name, text_of, written

LEDGER = "blob string, kind string, rule_version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group ``group`` has ``least`` characters at least."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: In the order in which spans of one start are listed: the base rules, then those that the ledger adds.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    # Shorter runs never count, and a run of 32 is the start of the same leftmost, longest match.
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
    # To the end line, else as far as the lines look like a key's.
    Rule("pem", 2, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\t\r\n:,.-]*?-----END [A-Z ]{0,30}PRIVATE KEY-----|(?:\r?\n[A-Za-z0-9+/=]{16,})*)"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")


def blob_of(column: str = "text") -> Column:
    return F.sha2(text_of(column), 256)


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows, of every (blob, rule version) of ``versions`` (its column ``text``) that ``ledger``
    lacks; blobs without findings get rows with no spans. Spans are in code points, end exclusive, leftmost
    and non-overlapping within a kind."""
    named = versions.select(blob_of().alias("blob"), text_of().alias("text"))
    nothing = F.array().cast("array<string>")
    if ledger is not None:
        listed_ = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "rule_version")).alias("done"))
        needed = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
        some = listed_.where(~F.forall(needed, lambda k: F.array_contains("done", k)))
        all_ = listed_.where(F.forall(needed, lambda k: F.array_contains("done", k))).select("blob")
        # What has been scanned by all rules goes before texts are grouped.
        named = named.join(all_, "blob", "left_anti")
        blobs = named.groupBy("blob").agg(F.first("text").alias("text")).join(some, "blob", "left").withColumn("done", F.coalesce("done", nothing))
    else:
        blobs = named.groupBy("blob").agg(F.first("text").alias("text")).withColumn("done", nothing)

    def found(r: Rule) -> Column:
        """The lengths of the texts before the matches, of the matches and of their groups."""
        rx = _literal(r.pattern)
        return F.expr(f"""CASE WHEN array_contains(done, '{r.kind}:{r.version}') THEN NULL
            WHEN NOT text RLIKE {rx} THEN struct('{r.kind}' AS kind, {r.version} AS rule_version, cast(array() AS array<struct<gap:int,length:int,value:int>>) AS parts)
            ELSE struct('{r.kind}' AS kind, {r.version} AS rule_version, zip_with(zip_with(
                slice(split(text, {rx}, -1), 1, size(regexp_extract_all(text, {rx}, 0))), regexp_extract_all(text, {rx}, 0), (g, m) -> struct(length(g) AS gap, length(m) AS length)),
                regexp_extract_all(text, {rx}, {r.group}), (x, v) -> struct(x.gap AS gap, x.length AS length, length(v) AS value)) AS parts) END""")

    pairs = blobs.select("blob", F.explode(F.filter(F.array(*[found(r) for r in rules]), lambda x: x.isNotNull())).alias("x")).select("blob", "x.kind", "x.rule_version", "x.parts")
    least = F.element_at(F.create_map(*[c for r in rules for c in (F.lit(r.kind), F.lit(r.least))]), F.col("kind"))
    # Ends of matches are running sums; a text has few, but a long one may have many, so they go by rows.
    parts = pairs.select("blob", "kind", "rule_version", F.posexplode_outer("parts").alias("pos", "part"))
    end = F.sum(F.col("part.gap") + F.col("part.length")).over(_by_blob())
    spans = parts.withColumn("end", end).withColumn("keep", F.col("part.value") >= least)
    span = F.when(F.col("keep"), F.struct((F.col("end") - F.col("part.length")).cast("int").alias("start"), F.col("end").cast("int").alias("end")))
    return spans.groupBy("blob", "kind", "rule_version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _by_blob():
    from pyspark.sql import Window

    return Window.partitionBy("blob", "kind", "rule_version").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Of each blob with a finding: its spans (start, rank of the kind, end, kind), in order."""
    rank = F.element_at(F.create_map(*[c for k, r in enumerate(rules) for c in (F.lit(r.kind), F.lit(k))]), F.col("kind"))
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    rows = ledger.where(F.array_contains(current, F.concat_ws(":", "kind", "rule_version"))).where(F.size("spans") > 0)
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind")))
    return rows.select("blob", each.alias("spans")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def scanned(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> tuple[DataFrame, DataFrame]:
    """``docs`` with a column ``name`` (array of start, rank, end, kind; empty where none), and the whole ledger.

    A null text is the empty one; repeated rows share a blob and are all reported; other columns are kept,
    but one called ``name`` is replaced; an empty table gives an empty ledger."""
    new = written(scan(docs, ledger, rules), "ledger")
    return _joined(docs, new if ledger is None else ledger.select(*new.columns).unionByName(new), rules, name)


def _joined(docs: DataFrame, whole: DataFrame, rules: tuple[Rule, ...], name: str) -> tuple[DataFrame, DataFrame]:
    blob = free_name(docs, "_blob")
    found = written(findings(whole, rules), "findings").select(F.col("blob").alias(blob), F.col("spans").alias(name))
    out = docs.drop(name).withColumn(blob, blob_of()).join(found, blob, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType))).drop(blob), whole


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, rounds: int = 2, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``.

    The documents come in as ``rounds`` versions of a collection, by their ids' hash, each scanned against the ledger of those
    before: what a later version repeats isn't scanned again. Whatever the number, the result is the same. Null texts are empty
    ones; rows with a null id are rows like others; repeated rows are reported each; other columns are ignored; no rows in, no
    rows out."""
    rows = docs.select("doc_id", "text")
    ledger = None
    for n in range(rounds):
        new = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == n)
        found = written(scan(new, ledger, rules), f"ledger{n}")
        ledger = found if ledger is None else ledger.unionByName(found)
    out, _ = _joined(rows, ledger, rules, "secrets")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[n(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret, overlapping ones joined, replaced by ``mark`` in ``text``, and with
    its number of code points in ``n_chars`` if there is such a column. Null texts stay null, and texts without
    findings (empty ones too) as they are. Repeated rows stay, each masked alike; all other columns are kept, whatever their
    names; no rows in, no rows out."""
    name = free_name(docs, "_secrets")
    out, _ = scanned(docs, name=name)
    joined = F.expr(f"""aggregate({name}, cast(array() AS array<struct<start:int,end:int>>), (acc, s) -> CASE
        WHEN size(acc) > 0 AND s.start <= element_at(acc, -1).end THEN concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start AS start, greatest(s.end, element_at(acc, -1).end) AS end)))
        ELSE concat(acc, array(struct(s.start AS start, s.end AS end))) END)""")
    kept = F.expr(f"""transform(array({name}), x -> transform(sequence(0, size(x)), i -> substring(text,
        CASE WHEN i = 0 THEN 1 ELSE x[i - 1].end + 1 END,
        CASE WHEN i = size(x) THEN length(text) ELSE x[i].start - CASE WHEN i = 0 THEN 0 ELSE x[i - 1].end END END)))[0]""")
    out = out.withColumn(name, F.when(F.size(name) > 0, joined).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
    out = out.withColumn("text", F.when(F.size(name) > 0, F.array_join(kept, mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
