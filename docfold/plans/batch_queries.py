"""Queries of the chapter relation, batches, windows, progress and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfold.config import BatchingConfig
from docfold.functions import text as T
from docfold.operators import batching as B
from docfold.operators.chapters import chapters, resumed
from docfold.plans.registry import query, table
from docfold.plans.text_queries import norm


def books(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as books, turns as chapters."""
    c = table(spark, sf, "conversations")
    return chapters(c.select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), F.col("role").alias("title"), "text", F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("source_path")))


def config(budget: int, **more) -> BatchingConfig:
    return BatchingConfig(max_input_tokens=budget, prompt_overhead_tokens=0, reserve_output_tokens=0, **more)


CH = f"""raw AS (SELECT conv_id AS book, turn AS pos, role, {norm('text')} AS text, 'conv/' || conv_id || '/' || turn AS source_path FROM conversations),
ch AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) AS i, role AS title, text, source_path, greatest(1, (length(text) + 3) // 4) AS t FROM raw WHERE text <> '')"""


def packed_sql(budget: int, window: int, key: str = "book") -> str:
    """Batches by a recursive walk over each book's chapters."""
    crosses = f" OR (w.i - 1) // {window} <> (w.first - 1) // {window}" if window else ""
    grow = f"c.t <= {budget} AND w.tokens <= {budget} AND w.tokens + c.t <= {budget}" + (f" AND (c.i - 1) // {window} = (w.i - 1) // {window}" if window else "")
    del crosses
    return f"""walk AS (SELECT {key}, i, t, 1::BIGINT AS no, t AS tokens FROM ch WHERE i = 1
      UNION ALL SELECT c.{key}, c.i, c.t, CASE WHEN {grow} THEN w.no ELSE w.no + 1 END, CASE WHEN {grow} THEN w.tokens + c.t ELSE c.t END FROM walk w JOIN ch c ON c.{key} = w.{key} AND c.i = w.i + 1),
    bat AS (SELECT {key}, no AS batch_no, min(i) AS start_idx, max(i) AS end_idx, count(*) AS chapter_count, CAST(sum(t) AS BIGINT) AS token_estimate FROM walk GROUP BY {key}, no)"""


BATCH = "SELECT book, batch_no, printf('ch%04d-ch%04d-d0', start_idx, end_idx) AS batch_id, start_idx, end_idx, chapter_count, token_estimate FROM bat"


@query(f"WITH {CH} SELECT book, i AS chapter_index, printf('ch%04d', i) || '-' || substr(sha256(source_path || chr(10) || title || chr(10) || text), 1, 12) AS chapter_id, title, text, source_path, t AS token_estimate FROM ch")
def s1_book_scan(spark: SparkSession, sf: str) -> DataFrame:
    return books(spark, sf)


@query(f"WITH RECURSIVE {CH}, {packed_sql(300, 0)} {BATCH}")
def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    return B.batches(books(spark, sf), config(300))


@query(f"WITH RECURSIVE {CH}, {packed_sql(300, 3)} {BATCH}")
def w3_checkpoint_windows(spark: SparkSession, sf: str) -> DataFrame:
    return B.batches(books(spark, sf), config(300, enable_checkpoint=True, checkpoint_every_n_chapters=3))


@query(f"WITH RECURSIVE {CH}, {packed_sql(60, 0)} {BATCH}")
def w2_oversize(spark: SparkSession, sf: str) -> DataFrame:
    return B.batches(books(spark, sf), config(60))


@query(f"WITH {CH} SELECT book, i AS batch_no, printf('ch%04d-ch%04d-d0', i, i) AS batch_id, i AS start_idx, i AS end_idx, 1::BIGINT AS chapter_count, t AS token_estimate FROM ch")
def w2_zero_budget(spark: SparkSession, sf: str) -> DataFrame:
    return B.batches(books(spark, sf), config(0))


@query("""WITH RECURSIVE ch AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, greatest(1, (length(text) + 3) // 4) AS t FROM documents),
""" + packed_sql(7500, 0) + " " + BATCH)
def w2_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("book"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("chapter_index"), T.tokens(F.col("text")).alias("token_estimate"))
    return B.batches_streamed(d)


@query(f"WITH RECURSIVE {CH}, {packed_sql(300, 3)} {BATCH}")
def w3_windows_streamed(spark: SparkSession, sf: str) -> DataFrame:
    return B.batches_streamed(books(spark, sf), config(300, enable_checkpoint=True, checkpoint_every_n_chapters=3))


@query(f"WITH RECURSIVE {CH}, {packed_sql(60, 0)} {BATCH}")
def w2_oversize_streamed(spark: SparkSession, sf: str) -> DataFrame:
    return B.batches_streamed(books(spark, sf), config(60))


HALVES = """SELECT book, batch_id AS parent_batch_id, half, 1::BIGINT AS depth, CASE half WHEN 0 THEN start_idx ELSE start_idx + chapter_count // 2 END AS start_idx, CASE half WHEN 0 THEN start_idx + chapter_count // 2 - 1 ELSE end_idx END AS end_idx FROM b, (VALUES (0::BIGINT), (1::BIGINT)) h(half) WHERE chapter_count > 1"""


@query(f"WITH RECURSIVE {CH}, {packed_sql(300, 0)}, b AS ({BATCH}), h AS ({HALVES}) SELECT *, printf('ch%04d-ch%04d-d1', start_idx, end_idx) AS batch_id FROM h")
def w4_bisect(spark: SparkSession, sf: str) -> DataFrame:
    return B.halves(batch_plan(spark, sf))


@query(f"WITH RECURSIVE {CH}, {packed_sql(300, 0)} SELECT book, count(*) AS batches, CAST(sum(token_estimate) AS BIGINT) AS tokens, min(start_idx) AS first_idx, max(end_idx) AS last_idx FROM bat GROUP BY book")
def a1_batch_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return batch_plan(spark, sf).groupBy("book").agg(F.count("*").alias("batches"), F.sum("token_estimate").alias("tokens"), F.min("start_idx").alias("first_idx"), F.max("end_idx").alias("last_idx"))


@query(f"WITH {CH} SELECT book, i AS chapter_index FROM ch")
def w1_enumerate(spark: SparkSession, sf: str) -> DataFrame:
    return books(spark, sf).select("book", "chapter_index")


@query(f"WITH {CH} SELECT book, i AS chapter_index, title FROM ch WHERE i > book % 3")
def p9_resume_filter(spark: SparkSession, sf: str) -> DataFrame:
    b = books(spark, sf)
    done = table(spark, sf, "conversations").select(F.col("conv_id").alias("book")).distinct().where("book % 3 > 0").select("book", (F.col("book") % 3).alias("last_completed"))
    return resumed(b, done).select("book", "chapter_index", "title")


@query(f"SELECT page_id % 7 AS book, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS chapter_index, page_id AS pos FROM pages WHERE page_id % 5 <> 0 AND {norm("regexp_replace(html, '<[^>]+>', '', 'g')")} <> ''")
def p1_empty_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without text are no chapters, and get no number."""
    body = F.when(F.col("page_id") % 5 == 0, " \n\u3000\t").otherwise(F.regexp_replace("html", "<[^>]+>", ""))
    rows = table(spark, sf, "pages").select((F.col("page_id") % 7).alias("book"), F.col("page_id").alias("pos"), F.lit("t").alias("title"), body.alias("text"), F.col("page_id").cast("string").alias("source_path"))
    return chapters(rows).select("book", "chapter_index", F.col("source_path").cast("long").alias("pos"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)\\.(html|xhtml|htm)$')")
def p2_html_extension(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(T.is_page(F.col("url"))).select("page_id", "url")


@query("SELECT o_orderkey, o_orderkey % 40 > 0 AND o_orderkey % 40 > o_custkey % 20 AND (o_orderkey % 40 >= 35 OR (o_orderkey % 40) % 3 = 0) AS due, FALSE AS never FROM orders")
def p10_should_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    i, s = F.col("o_orderkey") % 40, F.col("o_custkey") % 20
    return table(spark, sf, "orders").select("o_orderkey", B.should_checkpoint(i, s, F.lit(35), 3).alias("due"), B.should_checkpoint(i, s, F.lit(35), 0).alias("never"))


@query(f"WITH RECURSIVE {CH}, {packed_sql(300, 0)} SELECT book, batch_no, chapter_count > 1 AS split, FALSE AS never FROM bat")
def p11_should_split(spark: SparkSession, sf: str) -> DataFrame:
    return batch_plan(spark, sf).select("book", "batch_no", B.should_split(F.col("chapter_count"), BatchingConfig()).alias("split"), B.should_split(F.col("chapter_count"), BatchingConfig(split_on_failure=False)).alias("never"))


@query(f"""WITH RECURSIVE {CH}, {packed_sql(100, 0)}, done AS (SELECT * FROM bat WHERE (book + batch_no) % 4 <> 0)
SELECT book, coalesce(max(end_idx) FILTER (WHERE NOT EXISTS (SELECT 1 FROM bat m WHERE m.book = d.book AND m.start_idx < d.start_idx AND (m.book + m.batch_no) % 4 = 0)), 0) AS last_completed FROM done d GROUP BY book""")
def w7_completed_prefix(spark: SparkSession, sf: str) -> DataFrame:
    done = B.batches(books(spark, sf), config(100)).where("(book + batch_no) % 4 <> 0")
    return B.completed_prefix(done)


@query(f"WITH RECURSIVE {CH}, {packed_sql(100, 0)}, n AS (SELECT book, max(end_idx) AS total FROM bat GROUP BY book) SELECT book, batch_no, round_even(CAST(end_idx AS DOUBLE) / total * 100, 2) AS pct FROM bat JOIN n USING (book)")
def a10_progress(spark: SparkSession, sf: str) -> DataFrame:
    b = B.batches(books(spark, sf), config(100))
    total = F.max("end_idx").over(Window.partitionBy("book"))
    return b.select("book", "batch_no", T.percent(F.col("end_idx"), total).alias("pct"))
