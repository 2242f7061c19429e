"""Queries of tasks, templates, attempts, progress, checkpoints and streams of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfold.functions import text as T
from docfold.operators import control as C
from docfold.plans.registry import query, table


@query("SELECT r_name AS book, n_name AS schema, row_number() OVER (ORDER BY r_regionkey, n_nationkey) AS task_no FROM region, nation")
def j1_task_grid(spark: SparkSession, sf: str) -> DataFrame:
    books = table(spark, sf, "region").select(F.col("r_name").alias("book"), F.col("r_regionkey").alias("book_no"))
    schemas = table(spark, sf, "nation").select(F.col("n_name").alias("schema"), F.col("n_nationkey").alias("schema_no"))
    return C.tasks(books, schemas).select("book", "schema", "task_no")


@query("SELECT c.conv_id AS book, c.turn AS pos, p.url AS path FROM conversations c JOIN pages p ON p.page_id = (c.conv_id * 7 + c.turn) % 60 WHERE regexp_matches(p.url, '(?i)\\.(html|xhtml|htm)$')")
def j2_spine_join(spark: SparkSession, sf: str) -> DataFrame:
    spine = table(spark, sf, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), ((F.col("conv_id") * 7 + F.col("turn")) % 60).alias("item_id"))
    items = table(spark, sf, "pages").select(F.col("page_id").alias("item_id"), F.col("url").alias("path"))
    return C.spine(spine, items, items.select("path")).select("book", "pos", "path")


@query("SELECT p_partkey, p_size, CASE WHEN p_size % 5 = 0 THEN 3.0 WHEN p_size % 5 = 1 THEN 2.0 ELSE 1.0 END AS w FROM part")
def j6_field_weight(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("p_size") % 5 == 0, "person.name").when(F.col("p_size") % 5 == 1, "other.name").otherwise("x.y")
    key = F.element_at(F.split(path, r"\."), -1)
    return table(spark, sf, "part").select("p_partkey", "p_size", C.weight(path, key, {"person.name": 3.0, "name": 2.0}).alias("w"))


@query("""WITH snap AS (SELECT user_id AS book, max_by(props, event_id) AS world FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT c_custkey, coalesce(world, '{}') AS world FROM customer LEFT JOIN snap ON book = c_custkey % 200""")
def j7_context_lookup(spark: SparkSession, sf: str) -> DataFrame:
    snap = table(spark, sf, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("book")).agg(F.max_by("props", "event_id").alias("world"))
    tasks = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 200).alias("book"))
    return C.with_context(tasks, snap).select("c_custkey", "world")


def _checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("task"), (F.col("event_id") % 50 + 1).alias("chapter_index"), F.col("event_id").alias("saved_seq")).withColumn("checkpoint_id", T.checkpoint_id(F.col("chapter_index")))


CK = "ck AS (SELECT user_id AS task, event_id % 50 + 1 AS chapter_index, event_id AS saved_seq, printf('ch%04d', event_id % 50 + 1) AS checkpoint_id FROM events WHERE event_type = 'purchase')"


@query(f"WITH {CK} SELECT task, CASE WHEN task % 2 = 0 THEN 'ch0009' ELSE max_by(checkpoint_id, saved_seq) END AS checkpoint_id FROM ck GROUP BY task")
def j8_resolve_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    ck = _checkpoints(spark, sf)
    asked = ck.select("task").distinct().select("task", F.when(F.col("task") % 2 == 0, "ch0009").alias("asked_id"))
    return C.resolve(asked, ck).select("task", "checkpoint_id")


@query(f"WITH {CK}, d AS (SELECT DISTINCT task, chapter_index, checkpoint_id FROM ck) SELECT task, checkpoint_id, chapter_index, row_number() OVER (PARTITION BY task ORDER BY chapter_index, checkpoint_id) AS pos FROM d")
def o2_list_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return C.listed(_checkpoints(spark, sf)).select("task", "checkpoint_id", "chapter_index", "pos")


@query(f"WITH {CK} SELECT task, max_by(checkpoint_id, saved_seq) AS checkpoint_id, max_by(chapter_index, saved_seq) AS chapter_index FROM ck GROUP BY task")
def o3_latest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return C.latest(_checkpoints(spark, sf)).select("task", "checkpoint_id", "chapter_index")


@query("SELECT name, row_number() OVER (ORDER BY CASE name WHEN 'base.md' THEN 0 WHEN 'retry_format.md' THEN 1 WHEN 'retry_schema.md' THEN 2 ELSE 3 END, name) - 1 AS idx FROM (SELECT lower(n_name) || '.md' AS name FROM nation UNION ALL SELECT unnest(['retry_schema.md', 'retry_format.md', 'base.md']))")
def o1_template_order(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "nation").select(F.concat(F.lower("n_name"), F.lit(".md")).alias("name"))
    names = names.unionByName(spark.createDataFrame([("retry_schema.md",), ("retry_format.md",), ("base.md",)], "name string"))
    return C.templates(names).select("name", "idx")



@query("SELECT r_name AS book, n_name AS schema, row_number() OVER (ORDER BY rk, r_regionkey) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS rk FROM region, nation)")
def o5_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    books = table(spark, sf, "region").select(F.col("r_name").alias("book"), F.col("r_regionkey").alias("book_no"))
    schemas = table(spark, sf, "nation").select(F.col("n_name").alias("schema"), F.col("n_nationkey").alias("schema_no"))
    return C.interleaved(C.tasks(books, schemas)).select("book", "schema", "turn")



@query("SELECT c_mktsegment AS entry FROM customer UNION SELECT p_brand FROM part")
def o8_append_absent(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("entry")).distinct()
    return C.append_absent(have, table(spark, sf, "part").select(F.col("p_brand").alias("entry")), ["entry"])




@query("""SELECT doc_id, CASE WHEN contains(text, 'token') THEN 'token' WHEN contains(text, 'idiot') THEN 'idiot' WHEN contains(text, 'the ') THEN 'the ' END AS hit FROM documents""")
def p3_blacklist(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.first_keyword(F.col("text"), ["token", " ", "idiot", "the "]).alias("hit"))


@query("SELECT d.doc_id, min_by(b.text, b.item_id) AS hit FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id")
def p3_blacklist_table(spark: SparkSession, sf: str) -> DataFrame:
    return C.blacklisted(table(spark, sf, "documents"), table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("keyword"))).select("doc_id", F.col("keyword").alias("hit"))


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN turn = 4 THEN 'data: [DONE]' WHEN turn % 3 = 1 THEN '' WHEN turn % 3 = 2 THEN ': ping' ELSE 'data: ' || role END AS line FROM conversations),
s AS (SELECT *, max(CASE WHEN line = 'data: [DONE]' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS done FROM l)
SELECT conv_id, turn, trim(substr(line, 6)) AS data FROM s WHERE done = 0 AND starts_with(line, 'data:')""")
def p12_sse_filter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("turn")
    line = F.when(k == 4, "data: [DONE]").when(k % 3 == 1, "").when(k % 3 == 2, ": ping").otherwise(F.concat(F.lit("data: "), F.col("role")))
    return C.events_of_stream(table(spark, sf, "conversations").select("conv_id", "turn", line.alias("line")), ["conv_id"], "turn")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS body, count(*) AS chunks FROM conversations GROUP BY conv_id")
def a7_chunk_concat(spark: SparkSession, sf: str) -> DataFrame:
    return C.collected(table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("chunk")), ["conv_id"])


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus <> 'F') AS completed, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 2 ELSE 0 END AS exit_code FROM orders")
def a2_run_rollup(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed")
    return C.run_summary(table(spark, sf, "orders").select(status.alias("status")))


ATTEMPTS = """att AS (SELECT o_custkey AS batch, o_orderkey % 3 AS retry, (o_orderkey // 3) % 3 AS template, o_orderkey AS seq,
 CASE WHEN o_orderkey % 7 = 0 THEN 'stream failed: x' END AS stream_error, CASE WHEN o_orderkey % 5 = 0 THEN 'banned' END AS hit, CASE WHEN o_orderkey % 4 = 0 THEN 'yaml root must be mapping' END AS parse_error, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS issues FROM orders)"""


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("batch"), (k % 3).alias("retry"), (F.floor(k / 3) % 3).alias("template"), k.alias("seq"),
        F.when(k % 7 == 0, "stream failed: x").alias("stream_error"), F.when(k % 5 == 0, "banned").alias("hit"), F.when(k % 4 == 0, "yaml root must be mapping").alias("parse_error"), F.when(k % 3 == 0, 2).otherwise(0).alias("issues"),
    )


STATUS = "CASE WHEN stream_error IS NOT NULL THEN 'interrupted' WHEN hit IS NOT NULL THEN 'blacklisted' WHEN parse_error IS NOT NULL THEN 'unparsed' WHEN issues > 0 THEN 'invalid' ELSE 'merged' END"


@query(f"WITH {ATTEMPTS} SELECT seq, {STATUS} AS status, CASE WHEN {STATUS} = 'merged' THEN 0 WHEN {STATUS} = 'invalid' THEN issues ELSE 1 END AS error_count FROM att")
def c2_status_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return C.judged(_attempts(spark, sf)).select("seq", "status", "error_count")


@query(f"WITH {ATTEMPTS} SELECT batch, count(*) AS attempts, min(retry * 10 + template) FILTER (WHERE {STATUS} = 'merged') AS first_success, CASE WHEN count(*) FILTER (WHERE {STATUS} = 'merged') > 0 THEN 'completed' ELSE 'failed' END AS outcome FROM att GROUP BY batch")
def c1_attempt_loop(spark: SparkSession, sf: str) -> DataFrame:
    out = C.first_success(C.judged(_attempts(spark, sf)))
    return out.select("batch", "attempts", (F.col("retry") * 10 + F.col("template")).alias("first_success"), "outcome")



@query("SELECT user_id AS task, max_by(event_type, event_id) AS status, max(event_id) AS seq, coalesce(max_by(value, event_id) FILTER (WHERE event_type = 'purchase'), 0.0) AS last_value FROM events GROUP BY user_id")
def s8_progress_scan(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), "value")
    return C.current(e, ["task"], {"status": None, "value": "status = 'purchase'"}, {"value": 0.0}).withColumnRenamed("value", "last_value")



@query("""SELECT c_custkey, coalesce(p.status, 'pending') AS status, coalesce(p.n, 0) AS completed FROM customer LEFT JOIN (SELECT user_id, 'running' AS status, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) p ON p.user_id = c_custkey""")
def c8_progress_init(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.lit("running").alias("status"), F.count("*").alias("completed"))
    return C.initialised(table(spark, sf, "customer").select("c_custkey"), have, ["c_custkey"], {"status": "pending", "completed": 0})


@query("SELECT o_orderkey, '[' || lower(o_orderstatus) || '] ' || (o_orderkey % 20) || '/20 ch' || printf('%04d', o_orderkey % 20 + 1) || ' retry=' || (o_orderkey % 3) || CASE WHEN o_orderkey % 3 = 2 THEN ' error=late' ELSE '' END AS line FROM orders")
def c13_console_line(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", C.console_line(F.lower("o_orderstatus"), k % 20, F.lit(20), T.checkpoint_id(k % 20 + 1), k % 3, F.when(k % 3 == 2, "late")).alias("line"))



@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'actors: []' ELSE 'root: []' END AS reply FROM nation")
def s11_echo(spark: SparkSession, sf: str) -> DataFrame:
    prompt = F.when(F.col("n_nationkey") % 2 == 0, "root_key: actors").otherwise("nothing")
    return table(spark, sf, "nation").select("n_nationkey", C.echo(prompt, "root").alias("reply"))


@query("SELECT name, idx, length(content) AS n FROM (SELECT split_part(file, '.', 1) AS name, content, row_number() OVER (ORDER BY CASE file WHEN 'base.md' THEN 0 WHEN 'retry_format.md' THEN 1 WHEN 'retry_schema.md' THEN 2 ELSE 3 END, file) - 1 AS idx FROM (SELECT CASE n_nationkey WHEN 3 THEN 'retry_schema' WHEN 9 THEN 'base' WHEN 20 THEN 'retry_format' ELSE lower(replace(n_name, ' ', '_')) END || '.md' AS file, 'read {{source_text}} ' || n_nationkey AS content FROM nation))")
def s6_template_scan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    stem = F.when(k == 3, "retry_schema").when(k == 9, "base").when(k == 20, "retry_format").otherwise(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))))
    files = table(spark, sf, "nation").select(F.concat(stem, F.lit(".md")).alias("name"), F.concat(F.lit("read {{source_text}} "), k.cast("string")).alias("content"))
    return C.templates(files).select(F.regexp_replace("name", r"\.[^.]*$", "").alias("name"), "idx", F.length("content").cast("long").alias("n"))
