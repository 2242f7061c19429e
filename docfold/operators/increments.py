"""Increments: parsing, sanitizing, validating, and folding them into keyed state."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docfold.config import MergeConfig, yaml
from docfold.functions.text import BLANK
from docfold.operators.similarity import merged
from docfold.session import spread

GONE = object()
#: Block mappings of plain scalars: lines of a key and, at most, a value, without any sign that means something.
PLAIN = re.compile(r"(?: *\w[\w ]{0,80}:(?: +\w[\w .+-]*)?(?:\n|$))+")
TEXT, WHOLE, DECIMAL = "tag:yaml.org,2002:str", "tag:yaml.org,2002:int", re.compile("0|[1-9][0-9]{0,17}")
PARSED = StructType([StructField("node", StringType()), StructField("error", StringType())])


def encode(node: Any) -> str:
    """JSON that keeps the order of keys and tells dates from texts and floats from integers."""
    return json.dumps(node, ensure_ascii=False, default=lambda x: {"$date": x.isoformat()} if isinstance(x, (datetime.date, datetime.datetime)) else str(x))


def decode(text: str) -> Any:
    def hook(pairs):
        d = dict(pairs)
        if set(d) == {"$date"}:
            return datetime.datetime.fromisoformat(d["$date"]) if "T" in d["$date"] else datetime.date.fromisoformat(d["$date"])
        return d

    return json.loads(text, object_pairs_hook=hook)


def sanitized(node: Any) -> Any:
    """Without nulls, blank texts and what is empty after that; texts and keys are trimmed, of keys that
    become equal the last counts. 0 and false stay."""
    if node is None:
        return GONE
    if isinstance(node, str):
        return node.strip() or GONE
    if isinstance(node, list):
        return [y for x in node if (y := sanitized(x)) is not GONE] or GONE
    if isinstance(node, dict):
        out = {}
        for k, v in node.items():
            key = k.strip() if isinstance(k, str) else k
            if key != "" and (y := sanitized(v)) is not GONE:
                out[key] = y
        return out or GONE
    return node


def parsed(text: str) -> tuple[dict | None, str]:
    """A YAML mapping, or the reason why there is none."""
    try:
        data = loaded(unfenced(text))
    except yaml.YAMLError as e:
        return None, f"$: invalid yaml: {e}"
    if data is None:
        return None, "$: yaml document is empty"
    return (data, "") if isinstance(data, dict) else (None, "$: yaml root must be mapping")


def loaded(text: str) -> Any:
    """What ``yaml.safe_load`` makes of a text. The loader on libyaml, of a tenth of the time, takes the texts that both read alike; those
    that it refuses go to the other one, for its words. Of its nodes, mappings of texts and decimal numbers need no constructor."""
    if hasattr(yaml, "CSafeLoader") and PLAIN.fullmatch(text):
        try:
            return built(node) if even((node := yaml.compose(text, yaml.CSafeLoader))) else yaml.load(text, yaml.CSafeLoader)
        except yaml.YAMLError:
            pass
    return yaml.safe_load(text)


def even(node: Any) -> bool:
    """Whether a composed node is of mappings, of texts as keys and texts or decimal numbers as values."""
    if type(node) is yaml.MappingNode:
        return all(k.tag == TEXT and even(v) for k, v in node.value)
    return type(node) is yaml.ScalarNode and (node.tag == TEXT or (node.tag == WHOLE and bool(DECIMAL.fullmatch(node.value))))


def built(node: Any) -> Any:
    if type(node) is yaml.MappingNode:
        return {k.value: built(v) for k, v in node.value}
    return node.value if node.tag == TEXT else int(node.value)


def unfenced(text: str) -> str:
    """Of a fenced block, what is inside; see the column function of that name."""
    text = text.strip()
    head, line, body = text.partition("\n")
    if not head.startswith("```") or not line:
        return text
    inside, fence, _ = body.rpartition("```")
    return inside.strip() if fence else body.rstrip()


def issues(node: Any, skeleton: Any, path: str) -> Iterator[tuple[str, str]]:
    """Strict validation against a sample: (path, reason). Scalars aren't looked at."""
    if isinstance(skeleton, dict):
        if not isinstance(node, dict):
            yield path, "expected mapping"
            return
        for k, v in node.items():
            if k in skeleton:
                yield from issues(v, skeleton[k], f"{path}.{k}")
            else:
                yield f"{path}.{k}", "unexpected field"
    elif isinstance(skeleton, list):
        if not isinstance(node, list):
            yield path, "expected list"
        elif skeleton:
            for i, x in enumerate(node):
                yield from issues(x, skeleton[0], f"{path}[{i}]")


def validated(data: dict, root: str, skeleton: Any, mode: str = "permissive") -> list[tuple[str, str]]:
    """No issues when permissive. Strict: only the root at the top, which maps non-blank keys to items."""
    if mode == "permissive":
        return []
    out = [(f"$.{k}", "unexpected field") for k in data if k != root]
    entries = data.get(root, {})
    if not isinstance(entries, dict):
        return [*out, (f"$.{root}", "expected mapping")]
    for k, v in entries.items():
        if k is None or (isinstance(k, str) and not k.strip()):
            out.append((f"$.{root}", "missing entry key"))
        out += issues(v, skeleton, f"$.{root}.{k}")
    return out


def parse_yaml(text: Column) -> Column:
    """(node, error): the mapping as JSON, or the reason why there is none."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [parsed(t or "") for t in texts]
        return pd.DataFrame({"node": [None if d is None else encode(d) for d, _ in rows], "error": [e or None for _, e in rows]}, dtype=object)

    return F.pandas_udf(run, PARSED)(text)


def sanitize_json(node: Column) -> Column:
    """Sanitized JSON; an empty object if nothing is left."""

    def run(nodes: pd.Series) -> pd.Series:
        return pd.Series([None if n is None else encode({} if (s := sanitized(decode(n))) is GONE else s) for n in nodes], dtype=object)

    return F.pandas_udf(run, StringType())(node)


def sanitized_flat(m: Column) -> Column:
    """A flat map of texts without blank keys and values, trimmed, inside the JVM."""
    blank = F.lit(BLANK)
    kept = F.filter(F.map_entries(m), lambda e: (F.btrim(e["key"], blank) != "") & (F.coalesce(F.btrim(e["value"], blank), F.lit("")) != ""))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(F.btrim(e["key"], blank).alias("key"), F.btrim(e["value"], blank).alias("value"))))


def entries(increments: DataFrame, root: str) -> DataFrame:
    """(…, entity, pos, node) of increments (…, node: JSON): only the root's mapping counts. Rows whose root
    or entry isn't a mapping have an ``error`` and no entity."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                data = decode(r.pop("node"))
                inner = data.get(root, {}) if isinstance(data, dict) else None
                if not isinstance(inner, dict) or any(not isinstance(v, dict) for v in inner.values()):
                    rows.append(r | {"entity": None, "pos": None, "node": None, "error": "increment must map entries to mappings"})
                else:
                    rows += [r | {"entity": str(k), "pos": i, "node": encode(v), "error": None} for i, (k, v) in enumerate(inner.items())]
            yield pd.DataFrame(rows, columns=[*[c for c in pdf.columns if c != "node"], "entity", "pos", "node", "error"]).astype({"pos": "Int64"})

    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in increments.schema.fields if f.name != "node")
    return increments.mapInPandas(run, f"{others}, entity string, pos long, node string, error string")


def folded(rows: DataFrame, config: MergeConfig = MergeConfig(), keys: tuple[str, ...] = ("entity",), again: bool = False) -> DataFrame:  # noqa: B008
    """(keys, node, touches) of rows (keys, seq, node: JSON): each key's nodes merged in the order of seq. ``again``: of rows that may be folds
    themselves, with ``first`` (seq, pos) and ``touches``; the result has both, the least and their sum.

    The merge isn't associative, so nothing is combined before the shuffle; a task streams over its sorted
    rows and holds one key's state at a time, however many rows the key has."""
    more = ("touches", "first_seq", "first_pos") if again else ("touches",)

    def run(batches):
        key, state, touches, least = None, None, 0, ()
        for pdf in batches:
            done = []
            firsts = zip(pdf["first_seq"].tolist(), pdf["first_pos"].tolist(), strict=True) if again else [()] * len(pdf)
            counts = pdf["touches"].tolist() if again else [1] * len(pdf)
            for k, node, n, first in zip(zip(*(pdf[c] for c in keys), strict=True), pdf["node"], counts, firsts, strict=True):
                if k != key:
                    if key is not None:
                        done.append((*key, encode(state), touches, *least))
                    key, state, touches, least = k, decode(node), n, first
                else:
                    state, touches, least = merged(state, decode(node), config), touches + n, min(least, first)
            if done:
                yield pd.DataFrame(done, columns=[*keys, "node", *more])
        if key is not None:
            yield pd.DataFrame([(*key, encode(state), touches, *least)], columns=[*keys, "node", *more])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    ordered = spread(rows.select(*keys, "seq", "node", *(("first", "touches") if again else ())), *keys).sortWithinPartitions(*keys, "seq", *(("first",) if again else ()))
    own = [F.col("touches"), F.col("first.seq").alias("first_seq"), F.col("first.pos").alias("first_pos")] if again else []
    out = ordered.select(*keys, "node", *own).mapInPandas(run, f"{kinds}, node string, {', '.join(f'{c} long' for c in more)}")
    return out.select(*keys, "node", "touches", F.struct(F.col("first_seq").alias("seq"), F.col("first_pos").alias("pos")).alias("first")) if again else out


def last_writer(rows: DataFrame, keys: list[str], path: str, value: str, seq: list[str]) -> DataFrame:
    """Scalar state by last writer: (keys, path, value). Exact where a path is a scalar throughout."""
    return rows.groupBy(*keys, path).agg(F.max_by(value, F.struct(*seq)).alias(value))


def upserted(state: DataFrame, increment: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """State with scalar fields overwritten by the increment's non-null ones; (keys, fields, outcome)."""
    s, i = state.select(*keys, *[F.col(f).alias(f"_s_{f}") for f in fields], F.lit(1).alias("_s")), increment.select(*keys, *[F.col(f).alias(f"_i_{f}") for f in fields], F.lit(1).alias("_i"))
    outcome = F.when(F.col("_s").isNull(), "appended").when(F.col("_i").isNull(), "kept").otherwise("merged")
    return s.join(i, keys, "full_outer").select(*keys, *[F.coalesce(f"_i_{f}", f"_s_{f}").alias(f) for f in fields], outcome.alias("outcome"))


def merge_stats(upserts: DataFrame) -> DataFrame:
    return upserts.agg(F.count_if(F.col("outcome") == "merged").alias("replaced_nodes"), F.count_if(F.col("outcome") == "appended").alias("appended_nodes"))
