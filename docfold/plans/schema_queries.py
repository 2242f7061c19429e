"""Queries of schema inference, over sample schemas made of the suppliers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfold.operators import schema as S
from docfold.plans.registry import by_row, query, table

#: The sample's lines: indent, content, key, value, kind, path of its field (if it is one). {k} is the supplier's key, {v} 7 or less.
LINES = (
    (0, "actors{v}:", "actors{v}", "", "list", None),
    (2, "<name>:", "<name>", "", "object", None),
    (4, 'name: "" # shown', "name", '"" # shown', "string", "actors{v}[].name"),
    (4, "age: {v}", "age", "{v}", "integer", "actors{v}[].age"),
    (4, "alive: True # now", "alive", "True # now", "boolean", "actors{v}[].alive"),
    (4, "tags: []", "tags", "[]", "list", "actors{v}[].tags"),
    (4, "words:", "words", "", "list", "actors{v}[].words"),
    (6, "- word", "word", "", "object", None),
    (4, "k{k}:", "k{k}", "", "object", "actors{v}[].k{k}"),
    (6, "height: -1", "height", "-1", "string", "actors{v}[].k{k}.height"),
    (6, "extra: {}", "extra", "{}", "object", "actors{v}[].k{k}.extra"),
    (4, "links:", "links", "", "list", "actors{v}[].links"),
    (6, '- target: ""', "target", '""', "string", "actors{v}[].links[].target"),
    (8, "weight: 1.5", "weight", "1.5", "string", "actors{v}[].links[].weight"),
    (8, "parts:", "parts", "", "list", "actors{v}[].links[].parts"),
    (10, "- id: 3", "id", "3", "integer", "actors{v}[].links[].parts[].id"),
    (4, "name: again", "name", "again", "string", None),
    (0, "other: 1", "other", "1", "integer", None),
    (2, "below: 2", "below", "2", "integer", "other.below"),
)
FILLED = "replace(replace(@, '{k}', CAST(s_suppkey AS VARCHAR)), '{v}', CAST(s_suppkey % 8 AS VARCHAR))"
_quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def filled(column: str) -> str:
    return FILLED.replace("@", column)


#: Every third sample begins with a comment and a blank line.
TY = f"""v(no, indent, content, key, value, kind, path) AS (VALUES {', '.join(f"({i}, {x[0]}, {', '.join(map(_quoted, x[1:]))})" for i, x in enumerate(LINES))}),
ty AS (SELECT 's' || s_suppkey AS schema, CAST(no + CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS line_no, CAST(indent AS BIGINT) AS indent, {filled('content')} AS content, {filled('key')} AS key, {filled('value')} AS value, 'actors' || s_suppkey % 8 AS root_key, kind, {filled('path')} AS path FROM supplier, v)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    text = "\n".join(" " * x[0] + x[1] for x in LINES)
    k, v = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 8).cast("string")
    body = F.replace(F.replace(F.lit(text), F.lit("{k}"), k), F.lit("{v}"), v)
    head = F.when(F.col("s_suppkey") % 3 == 0, "# people\n \t\n").otherwise("")
    return table(spark, sf, "supplier").select(F.concat(F.lit("s"), k).alias("schema"), F.concat(head, body).alias("text"))


@query(f"WITH {TY} SELECT schema, line_no, indent, content FROM ty")
def f27_schema_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return S.lines(samples(spark, sf))


@query(f"WITH {TY} SELECT schema, line_no, indent, content, key, value, root_key, kind FROM ty")
def f28_line_types(spark: SparkSession, sf: str) -> DataFrame:
    return S.typed_lines(samples(spark, sf))


@query(f"WITH {TY}, l AS (SELECT *, lead(indent) OVER (PARTITION BY schema ORDER BY line_no) AS n FROM ty) SELECT schema, line_no, kind FROM l WHERE value = '' AND n > indent")
def w5_look_ahead(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds that the next line decides: of lines without a value that have a block."""
    rows = S.typed_lines(samples(spark, sf))
    after = rows.select("schema", F.col("line_no").alias("_n"), F.col("indent").alias("_i"))
    return rows.where("value = ''").join(after, "schema").where("_n = line_no + 1 AND _i > indent").select("schema", "line_no", "kind")


@query(f"WITH {TY} SELECT DISTINCT schema, root_key FROM ty")
def f34_root_key(spark: SparkSession, sf: str) -> DataFrame:
    return S.typed_lines(samples(spark, sf)).groupBy("schema").agg(F.min_by("root_key", "line_no").alias("root_key"))


FIELDS_SQL = "SELECT schema, row_number() OVER (PARTITION BY schema ORDER BY line_no) - 1 AS pos, path, kind AS type, key = 'name' AS required FROM ty WHERE path IS NOT NULL"


@query(f"WITH {TY} {FIELDS_SQL}")
def f31_text_fields(spark: SparkSession, sf: str) -> DataFrame:
    return S.text_fields(samples(spark, sf))


@query(f"WITH {TY}, f AS ({FIELDS_SQL}) SELECT schema, path, list_filter(['object', 'list', ''], lambda x: x = type OR x = '')[1] AS container FROM f")
def w6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Which fields hold others, as the indents say."""
    f = S.text_fields(samples(spark, sf))
    return f.select("schema", "path", F.when(F.col("type").isin("object", "list"), F.col("type")).otherwise("").alias("container"))


SKELETON = '{"age": 0, "alive": false, "k{k}": {"extra": {}, "height": ""}, "links": [{"parts": [{"id": 0}], "target": "", "weight": ""}], "name": "", "tags": [], "words": []}'


@query(f"SELECT 's' || s_suppkey AS schema, {filled(_quoted(SKELETON))} AS sample FROM supplier")
def f32_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    fields = S.text_fields(samples(spark, sf)).groupBy("schema").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "type", "required"))).alias("f"))

    def each(r):
        own = [(x["path"], x["type"], x["required"]) for x in r["f"]]
        return [(r["schema"], json.dumps(S.skeleton(own[0][0].partition("[")[0], own), sort_keys=True))]

    return by_row(fields, each, "schema string, sample string")


@query("SELECT o_orderkey, trim(split_part(o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' # note' ELSE '' END, ' #', 1)) AS value, trim(split_part(o_orderpriority, '-', 1)) AS key, o_orderkey % 3 = 0 AS placeholder FROM orders")
def f29_line_parts(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderpriority")
    value = F.concat(o, F.when(F.col("o_orderkey") % 2 == 0, " # note").otherwise(""))
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<"), o, F.lit(">"))).otherwise(o)
    return table(spark, sf, "orders").select("o_orderkey", F.trim(S.uncommented(value)).alias("value"), S.key_of(F.replace(o, F.lit("-"), F.lit(":"))).alias("key"), S.is_placeholder(name).alias("placeholder"))


@query("""SELECT event_id, unnest([{'path': 'events.k', 'type': 'integer', 'required': false}, {'path': 'events[].name', 'type': 'string', 'required': true}, {'path': 'events[].more', 'type': 'list', 'required': false}, {'path': 'events[].more[].x', 'type': CASE WHEN event_id % 2 = 0 THEN 'boolean' ELSE 'number' END, 'required': false}], recursive := true) FROM events""")
def f30_field_paths(spark: SparkSession, sf: str) -> DataFrame:
    def each(r):
        data = json.loads(r["props"]) | {"<name>": {"name": r["event_type"], "more": [{"x": True if r["event_id"] % 2 == 0 else 1.5}, {"unseen": 1}]}}
        return [(r["event_id"], *f) for f in S.fields_of("events", data)]

    return by_row(table(spark, sf, "events").select("event_id", "event_type", "props"), each, "event_id long, path string, type string, required boolean")


@query("""WITH p(pos, path, type, required) AS (VALUES (1, 'e.a', 'object', FALSE), (2, 'e.a.b', 'list', FALSE), (3, 'e.a.b[].c', 'object', FALSE), (4, 'e.a.b[].c.d', 'list', FALSE), (5, 'e.a.b[].c.d[][].name', 'string', TRUE), (6, 'e.a.b[].c.d[][].z', '', FALSE), (7, 'e.k', 'integer', FALSE), (8, 'e[].last', 'boolean', FALSE))
SELECT event_id, path, CASE WHEN type <> '' THEN type WHEN event_id % 2 = 0 THEN 'number' ELSE 'integer' END AS type, required FROM events, p""")
def f30_variant_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Field paths of JSON of six levels, inside the JVM."""
    deep = F.concat(F.lit('{"<any>": {"last": true}, "a": {"b": [{"c": {"d": [[{"name": "x", "z": '), F.when(F.col("event_id") % 2 == 0, "1.5").otherwise("7"), F.lit('}]]}}, {"unseen": 1}]}, '), F.substring("props", 2, 1 << 30))
    rows = table(spark, sf, "events").select("event_id", deep.alias("node"))
    return S.variant_fields(rows, ["event_id"], F.lit("e"), "node").select("event_id", "path", "type", "required")


@query(f"WITH {TY} SELECT schema, line_no, (SELECT max(o.line_no) FROM ty o WHERE o.schema = ty.schema AND o.line_no < ty.line_no AND o.indent < ty.indent) AS parent FROM ty")
def w6_ancestry(spark: SparkSession, sf: str) -> DataFrame:
    """The line that each line belongs to."""
    return S.parents(samples(spark, sf))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' WHEN 2 THEN 'list' WHEN 3 THEN 'number' WHEN 4 THEN 'object' ELSE 'string' END AS type, CASE o_orderkey % 6 WHEN 0 THEN 'false' WHEN 1 THEN '0' WHEN 2 THEN '[]' WHEN 3 THEN '0.0' WHEN 4 THEN '{}' ELSE '\"\"' END AS value FROM orders")
def f28_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """The type of a value, and its default."""
    def each(r):
        k = r["o_orderkey"]
        kind = S.value_type((k % 4 == 0, k, [k], k / 2, {"k": k}, str(k))[k % 6])
        return [(k, kind, json.dumps(S.DEFAULTS.get(kind, str)()))]

    return by_row(table(spark, sf, "orders").select("o_orderkey"), each, "o_orderkey long, type string, value string")


@query("SELECT p_brand, '{' || string_agg('\"k' || p_size || '\": 0', ', ' ORDER BY 'k' || p_size) || '}' AS sample FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand")
def o4_field_order(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of a sample are filled in by depth, then path, in whatever order they come."""
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("sizes"))
    each = lambda r: [(r["p_brand"], json.dumps(S.skeleton("r", [(f"r[].k{n}", "integer", False) for n in r["sizes"]])))]
    return by_row(rows, each, "p_brand string, sample string")


@query("SELECT p_brand, 'r[].' || replace(lower(p_type), ' ', '_') AS path, min_by(CASE WHEN p_size % 2 = 0 THEN 'integer' ELSE 'boolean' END, p_partkey) AS kind FROM part GROUP BY ALL")
def a8_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Of fields of one path the first counts."""
    line = F.concat(F.lit("    "), F.regexp_replace(F.lower("p_type"), " ", "_"), F.lit(": "), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("false"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"])
    texts = table(spark, sf, "part").groupBy(F.col("p_brand").alias("schema")).agg(F.concat(F.lit("r:\n  <name>:\n"), F.array_join(lines, "\n")).alias("text"))
    return S.text_fields(texts).select(F.col("schema").alias("p_brand"), "path", F.col("type").alias("kind"))
