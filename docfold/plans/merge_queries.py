"""Queries of increments: parsing, sanitizing, validating, merging, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfold.config import MergeConfig
from docfold.operators import increments as I  # noqa: N812
from docfold.operators import similarity as S
from docfold.plans.registry import by_row, query, table


@query("""WITH inc AS (SELECT user_id AS entity, event_type AS field, max_by(value, event_id) AS v FROM events GROUP BY user_id, event_type)
SELECT entity, field, v AS value FROM inc""")
def m1_last_writer(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("field"), "value", "event_id")
    return I.last_writer(e, ["entity"], "field", "value", ["event_id"])


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    half = lambda odd: e.where(F.col("event_id") % 2 == odd).groupBy(F.col("user_id").alias("entity")).agg(F.max_by("value", F.when(F.col("event_type") == "view", F.col("event_id"))).alias("a"), F.max_by("props", F.when(F.col("event_type") == "click", F.col("event_id"))).alias("b"))
    return I.upserted(half(0).where("entity % 4 <> 0"), half(1).where("entity % 3 <> 0"), ["entity"], ["a", "b"])


UPSERT = """s AS (SELECT user_id AS entity, max_by(value, event_id) FILTER (WHERE event_type = 'view') AS a, max_by(props, event_id) FILTER (WHERE event_type = 'click') AS b FROM events WHERE event_id % 2 = 0 GROUP BY user_id HAVING user_id % 4 <> 0),
i AS (SELECT user_id AS entity, max_by(value, event_id) FILTER (WHERE event_type = 'view') AS a, max_by(props, event_id) FILTER (WHERE event_type = 'click') AS b FROM events WHERE event_id % 2 = 1 GROUP BY user_id HAVING user_id % 3 <> 0),
u AS (SELECT coalesce(s.entity, i.entity) AS entity, coalesce(i.a, s.a) AS a, coalesce(i.b, s.b) AS b, CASE WHEN s.entity IS NULL THEN 'appended' WHEN i.entity IS NULL THEN 'kept' ELSE 'merged' END AS outcome FROM s FULL JOIN i ON s.entity = i.entity)"""


@query(f"WITH {UPSERT} SELECT * FROM u")
def j3_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _sides(spark, sf)


@query(f"WITH {UPSERT} SELECT count(*) FILTER (WHERE outcome = 'merged') AS replaced_nodes, count(*) FILTER (WHERE outcome = 'appended') AS appended_nodes FROM u")
def m7_merge_stats(spark: SparkSession, sf: str) -> DataFrame:
    return I.merge_stats(_sides(spark, sf))


@query("""WITH w AS (SELECT user_id AS entity, list_sort(list_distinct(list(event_id % 7) FILTER (WHERE event_type = 'view'))) AS cur, list_sort(list_distinct(list(event_id % 11) FILTER (WHERE event_type = 'click'))) AS inc FROM events GROUP BY user_id)
SELECT entity, array_to_string(list_concat(coalesce(cur, []), list_filter(coalesce(inc, []), lambda x: NOT list_contains(coalesce(cur, []), x))), ',') AS merged FROM w""")
def m2_primitive_arrays(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda t, k: F.array_sort(F.collect_set(F.when(F.col("event_type") == t, F.col("event_id") % k)))
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity")).agg(pick("view", 7).alias("cur"), pick("click", 11).alias("inc"))
    each = lambda r: [(r["entity"], ",".join(map(str, S.merged_array([int(x) for x in r["cur"]], [int(x) for x in r["inc"]], MergeConfig()))))]
    return by_row(rows, each, "entity long, merged string")


@query("""WITH p AS (SELECT p_partkey, p_brand AS b1, p_type AS t1, p_size % 3 AS s1, lead(p_brand, 1, p_brand) OVER (ORDER BY p_partkey) AS b2, lead(p_type, 1, p_type) OVER (ORDER BY p_partkey) AS t2, lead(p_size % 3, 1, p_size % 3) OVER (ORDER BY p_partkey) AS s2 FROM part)
SELECT p_partkey, (CASE WHEN b1 = b2 THEN 2.0 ELSE 0.0 END + CASE WHEN s1 = s2 THEN 1.0 ELSE 0.0 END + CASE WHEN t1 = t2 THEN 1.0 ELSE 0.0 END) / 4.0 AS sim FROM p""")
def m5_flat_similarity(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), (F.col("p_size") % 3).cast("string")).alias("m"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("m").alias("n"))  # keys are consecutive
    return p.join(nxt, "p_partkey", "left").select("p_partkey", S.flat_similarity(F.col("m"), F.coalesce("n", "m"), {"brand": 2.0}).alias("sim"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's lines' lengths, in order."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(lines, lambda x: x["l_quantity"].cast("int")).alias("q"))


#: The ratio of a run of one character with another.
RUNS = """li AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q FROM lineitem),
inc AS (SELECT l_orderkey, l_linenumber AS n, q FROM li WHERE l_linenumber > 3), cur AS (SELECT l_orderkey, l_linenumber AS n, q FROM li WHERE l_linenumber <= 3),
pr AS (SELECT inc.l_orderkey, inc.n AS incoming, cur.n AS existing, 2.0::DOUBLE * least(inc.q, cur.q) / (inc.q + cur.q) AS ratio, cur.q AS cq, inc.q AS iq FROM inc JOIN cur USING (l_orderkey))"""


@query("""WITH li AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c, CAST(l_quantity AS INT) AS q FROM lineitem),
b AS (SELECT i.l_orderkey, arg_max(o.n, (2.0 * least(i.q, o.q) / (i.q + o.q), -o.n)) AS spot, max(2.0 * least(i.q, o.q) / (i.q + o.q)) AS best, any_value(i.q) AS iq FROM li i LEFT JOIN li o ON o.l_orderkey = i.l_orderkey AND o.n < o.c WHERE i.n = i.c GROUP BY i.l_orderkey)
SELECT b.l_orderkey, string_agg(CASE WHEN li.n = spot AND best >= 0.6 THEN iq ELSE li.q END::VARCHAR, ',' ORDER BY li.n) FILTER (WHERE li.n < li.c OR best < 0.6 OR best IS NULL) AS lengths FROM b JOIN li ON li.l_orderkey = b.l_orderkey GROUP BY b.l_orderkey""")
def a6_arg_max(spark: SparkSession, sf: str) -> DataFrame:
    """An incoming text (the last line) takes the place of the first of the most similar ones before it, or is appended."""
    def each(r):
        *have, new = ["x" * int(q) for q in r["q"]]
        return [(r["l_orderkey"], ",".join(str(len(t)) for t in S.merged_array(have, [new], MergeConfig())))]

    return by_row(_texts(spark, sf), each, "l_orderkey long, lengths string")


@query("SELECT p_partkey, ((CASE WHEN p_size % 3 = p_partkey % 3 THEN 2.5 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) / (2.5 + 1 + 1))::DOUBLE AS mean FROM part")
def a4_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of mappings: fields by their weights, over the keys of both."""
    def each(r):
        a, b = {"person": {"name": int(r["p_size"]) % 3, "even": 0}, "left": 1}, {"person": {"name": int(r["p_partkey"]) % 3, "even": int(r["p_size"]) % 2}}
        inner = S.similarity(a["person"] | {"left": 1}, b["person"], {"name": 2.5})
        return [(r["p_partkey"], inner)]

    return by_row(table(spark, sf, "part").select("p_partkey", "p_size"), each, "p_partkey long, mean double")


@query("WITH n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS odd FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, round(odd / n::DOUBLE, 12) AS same, round((n / (n + 2.0)) * (n / (n + 2.0)), 12)::DOUBLE AS shorter FROM n")
def a5_penalised_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of lists: the mean over the left one's elements, times the ratio of the lengths."""
    def each(r):
        b = sorted(int(x) for x in r["xs"])
        a = [x for x in b if x % 2 == 1]
        return [(r["l_orderkey"], round(S.similarity(a, b, {}), 12), round(S.similarity([*b, "no", None], b, {}), 12))]

    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("xs"))
    return by_row(rows, each, "l_orderkey long, same double, shorter double")


@query("WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, round((n - 1) / (n + 1.0::DOUBLE) * n / (n + 1), 12)::DOUBLE AS score FROM n")
def j5_greedy_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Each left element claims its best unclaimed right one, also one that is unlike: a later equal one may find it taken."""
    def each(r):
        b = list(range(int(r["n"])))
        a = [99, *b[1:], 0]  # 99 is like none and claims 0, which is gone when its equal comes
        return [(r["l_orderkey"], round(S.similarity(a, b, {}), 12))]

    return by_row(table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")), each, "l_orderkey long, score double")


SAMPLE = {"name": "", "tags": [""], "details": {"height": 0}}


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id")


def _entry(k: int) -> dict:
    """By event_id % 4: a field too many, a scalar in place of a mapping, a clean entry, a list's item that is none."""
    return ({"name": "a", "nose": k}, {"details": k}, {"name": "b", "tags": ["x"], "details": {"height": 1}}, {"tags": "x", "name": "c"})[k % 4]


@query("SELECT event_id, TRUE AS ok, CASE WHEN event_id % 4 = 2 THEN 0 ELSE 1 END::BIGINT AS strict_issues FROM events")
def p6_validate_permissive(spark: SparkSession, sf: str) -> DataFrame:
    each = lambda r: [(r["event_id"], I.validated({"actors": {"a": _entry(r["event_id"])}}, "actors", SAMPLE) == [], len(I.validated({"actors": {"a": _entry(r["event_id"])}}, "actors", SAMPLE, "strict")))]
    return by_row(_answers(spark, sf), each, "event_id long, ok boolean, strict_issues long")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '$.actors.a.nose' WHEN 1 THEN '$.actors.a.details' ELSE '$.actors.a.tags' END AS path, CASE event_id % 4 WHEN 0 THEN 'unexpected field' WHEN 1 THEN 'expected mapping' ELSE 'expected list' END AS reason FROM events WHERE event_id % 4 <> 2
UNION ALL SELECT event_id, '$.other', 'unexpected field' FROM events WHERE event_id % 5 = 0""")
def p7_strict_paths(spark: SparkSession, sf: str) -> DataFrame:
    def each(r):
        k = r["event_id"]
        data = ({"other": 1} if k % 5 == 0 else {}) | {"actors": {"a": _entry(k)}}
        return [(k, *x) for x in I.validated(data, "actors", SAMPLE, "strict")]

    return by_row(_answers(spark, sf), each, "event_id long, path string, reason string")


@query("SELECT c_custkey, c_custkey % 3 < 2 AS missing FROM customer")
def p8_missing_key(spark: SparkSession, sf: str) -> DataFrame:
    def each(r):
        key = ("  ", None, r["c_name"])[r["c_custkey"] % 3]
        return [(r["c_custkey"], ("$.actors", "missing entry key") in I.validated({"actors": {key: {}}}, "actors", {}, "strict"))]

    return by_row(table(spark, sf, "customer").select("c_custkey", "c_name"), each, "c_custkey long, missing boolean")


@query("SELECT CASE WHEN event_id % 4 = 2 THEN 'passed' ELSE 'failed' END AS status, count(*) AS n, sum(CASE WHEN event_id % 4 = 2 THEN 0 ELSE 1 END + CASE WHEN event_id % 8 = 1 THEN 1 ELSE 0 END)::BIGINT AS error_count FROM events GROUP BY 1")
def a9_error_counts(spark: SparkSession, sf: str) -> DataFrame:
    def each(r):
        k = r["event_id"]
        found = I.validated({"actors": {"a": _entry(k)}} | ({"x": 0} if k % 8 == 1 else {}), "actors", SAMPLE, "strict")
        return [("failed" if found else "passed", len(found))]

    rows = by_row(_answers(spark, sf), each, "status string, issues long")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("issues").alias("error_count"))


@query("SELECT n_nationkey, round(list_unique(list_intersect(l1, l2)) / list_unique(list_concat(l1, l2))::DOUBLE, 9) AS sim FROM (SELECT *, [n_name[1], n_name[2], n_name[3]] AS l1, [n_name[2], n_name[4]] AS l2 FROM nation)")
def o7_key_union(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity goes over the keys of both sides, in order; a key that one lacks counts as unlike."""
    def each(r):
        n = r["n_name"]
        return [(r["n_nationkey"], round(S.similarity({c: 1 for c in n[:3]}, {c: 1 for c in n[1] + n[3]}, {}), 9))]

    return by_row(table(spark, sf, "nation").select("n_nationkey", "n_name"), each, "n_nationkey long, sim double")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN props END AS node, CASE event_id % 4 WHEN 1 THEN '$: invalid yaml' WHEN 2 THEN '$: yaml document is empty' WHEN 3 THEN '$: yaml root must be mapping' END AS error FROM events""")
def p4_parse_json(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that are JSON, which YAML contains: the same parser, fenced or not."""
    k = F.col("event_id") % 4
    body = F.when(k == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(k == 1, "{broken").when(k == 2, "null").otherwise("[1]")
    return table(spark, sf, "events").select("event_id", I.parse_yaml(body).alias("x")).select("event_id", "x.node", F.substring_index("x.error", ":", 2).alias("error"))


@query("SELECT n_nationkey, 'name=' || trim(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN ',note=x' ELSE '' END AS kept FROM nation")
def p5_sanitize_flat(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit(" name "), F.concat(F.lit(" "), F.col("n_name"), F.lit("\n")), F.lit("  "), F.lit("lost"), F.lit("blank"), F.lit(" \t"), F.lit("gone"), F.lit(None).cast("string"), F.lit("note"), F.when(F.col("n_nationkey") % 2 == 0, "x"))
    kept = F.transform(F.map_entries(I.sanitized_flat(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(kept, ",").alias("kept"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' WHEN 3 THEN 'string' WHEN 4 THEN 'list' ELSE 'object' END AS kind FROM events")
def f35_scalar_type(spark: SparkSession, sf: str) -> DataFrame:
    """The types that scalars of an answer have."""
    from docfold.operators.schema import value_type

    def each(r):
        k = r["event_id"]
        data, _ = I.parsed(f"v: {(k, k + 0.5, 'yes', 'text', '[1]', '{a: 1}')[k % 6]}")
        return [(k, value_type(data["v"]))]

    return by_row(_answers(spark, sf), each, "event_id long, kind string")


@query("""SELECT user_id, '{"z": ' || max(event_id) || ', "a": [' || count(*) || ', "é"], "d": {"$date": "2024-01-02"}}' AS doc FROM events GROUP BY user_id""")
def f33_dump_json(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered JSON of an answer: keys as they come, dates told apart, and the same after reading it again."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("k"), F.count("*").alias("n"))
    each = lambda r: [(r["user_id"], I.encode(I.decode(I.encode(I.parsed(f"z: {r['k']}\na: [{r['n']}, é]\nd: 2024-01-02")[0]))))]
    return by_row(rows, each, "user_id long, doc string")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's text and the next one's: runs of two characters, which the matcher's blocks meet in the middle."""
    text = F.concat(F.repeat(F.lit("x"), F.col("p_size").cast("int")), F.repeat(F.lit("y"), (F.col("p_partkey") % 30).cast("int")))
    p = table(spark, sf, "part").select("p_partkey", text.alias("a"))
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")


@query("""WITH p AS (SELECT p_partkey, p_size AS x, p_partkey % 30 AS y FROM part) SELECT a.p_partkey, 2.0::DOUBLE * (least(a.x, b.x) + least(a.y, b.y)) / (a.x + a.y + b.x + b.y) AS ratio FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1""")
def m4_text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("p_partkey", S.seq_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query(f"WITH {RUNS} SELECT l_orderkey, incoming, arg_max(existing, (ratio, -existing)) AS existing, max(ratio) AS ratio FROM pr WHERE ratio >= 0.6 GROUP BY ALL")
def j4_similarity_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Each incoming text's best match among all existing ones of its entity, at or over the threshold: looked up in an index whose
    bounds leave few pairs to the matcher."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("no"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"))
    found = S.best_matches(li.where("no <= 3").withColumnRenamed("no", "place"), li.where("no > 3"), ["l_orderkey"], MergeConfig().similarity_threshold)
    return found.select("l_orderkey", F.col("no").cast("int").alias("incoming"), F.col("place").cast("int").alias("existing"), "ratio")


def event_increments(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    node = F.to_json(F.struct(F.col("event_type").alias("last"), F.array("event_type").alias("kinds"), F.struct(F.col("event_id").alias("v")).alias("details")))
    return e.select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), node.alias("node"))


FOLD = """'{"last": "' || max_by(event_type, event_id) || '", "kinds": ["' || @ || '"], "details": {"v": ' || max(event_id) || '}}' AS node, count(*) AS touches FROM events"""


@query("SELECT e.user_id AS entity, " + FOLD.replace("@", "any_value(k)").replace("FROM events", "FROM events e") + """ JOIN (SELECT user_id, string_agg(event_type, '", "' ORDER BY first) AS k FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id) f ON f.user_id = e.user_id GROUP BY e.user_id""")
def m3_similarity_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Increments folded in order: of texts that are no more alike than the threshold, the array gets each once, in the order in
    which they first came."""
    return I.folded(event_increments(spark, sf), MergeConfig(similarity_threshold=0.9))


@query("SELECT user_id AS entity, " + FOLD.replace("@", "max_by(event_type, event_id)") + " GROUP BY user_id")
def m6_replace_fold(spark: SparkSession, sf: str) -> DataFrame:
    return I.folded(event_increments(spark, sf), MergeConfig(array_policy="replace"))


@query("""SELECT event_id AS seq, '{"name": "' || event_type || '"' || CASE WHEN event_type <> 'view' THEN ', "deep": {"list": [{"k": "' || event_type || '"}], "zero": 0}' ELSE ', "deep": {"zero": 0}' END || ', "off": false}' AS node FROM events""")
def p5_sanitize_deep(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    k = F.when(t == "view", " \t").otherwise(F.concat(F.lit(" "), t))
    node = F.to_json(F.struct(F.concat(t, F.lit("\n")).alias(" name "), F.struct(F.array(F.struct(k.alias("k"), F.lit("").alias("blank")), F.struct(F.lit(" ").alias("k"), F.lit("").alias("blank"))).alias("list"), F.lit(0).alias("zero"), F.array().cast("array<string>").alias("none")).alias("deep"), F.lit("x").alias("  "), F.lit(False).alias("off")))
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), I.sanitize_json(node).alias("node"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"actors": {"a": {"k": ' || event_id || '}}}' END AS node, CASE event_id % 4 WHEN 1 THEN '$: invalid yaml' WHEN 2 THEN '$: yaml document is empty' WHEN 3 THEN '$: yaml root must be mapping' END AS error FROM events""")
def p4_parse_yaml(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    body = F.when(k == 0, F.concat(F.lit("```yaml\nactors:\n  a:\n    k: "), F.col("event_id").cast("string"), F.lit("\n```"))).when(k == 1, "[1").when(k == 2, "").otherwise("- 1")
    return table(spark, sf, "events").select("event_id", I.parse_yaml(body).alias("x")).select("event_id", "x.node", F.substring_index("x.error", ":", 2).alias("error"))
