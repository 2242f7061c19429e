"""Queries of whole runs: a deterministic model's answers, the ledger, and what it says."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow.fs import FileSelector, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfold.clients import delta_of
from docfold.config import AppConfig, RuntimeConfig
from docfold.extraction import attempts, with_chapters
from docfold.operators import batching as B
from docfold.operators.control import progress_of
from docfold.pipeline import Pipeline
from docfold.plans.batch_queries import CH, config, packed_sql
from docfold.plans.batch_queries import books as numbered_books
from docfold.plans.registry import by_row, query, table
from docfold.sinks.ledger import Ledger, export, export_texts, unescaped
from docfold.session import Files
from docfold.sources.epub import pages_of

SCHEMAS = [{"schema": "actors", "root_key": "actors", "schema_text": "actors: {}", "sample": {}}]
TEMPLATES = [{"name": "base", "content": "{{batch_id}}"}]


@dataclass(frozen=True)
class Marker:
    """Answers with the batch that it is asked about. Batches of several chapters that begin at the second of three are
    answered by no YAML; ``stops``: those that begin at the third break off."""

    stops: bool = False

    def __call__(self, prompt: str) -> Iterator[str]:
        batch, a, b = re.search(r"(ch(\d+)-ch(\d+)-d\d+)", prompt).groups()
        a, b = int(a), int(b)
        if a % 3 == 2 and b > a:
            yield "[bro"
            yield "ken"
            return
        yield "actors:\n"
        if self.stops and a % 3 == 0:
            raise RuntimeError("closed")
        yield f"  e{a % 4}:\n    last: {batch}\n    n: {b - a + 1}\n"


def books(spark: SparkSession, sf: str) -> DataFrame:
    return numbered_books(spark, sf).withColumn("book", F.col("book").cast("string"))


def settings(**runtime) -> AppConfig:
    return AppConfig(runtime=RuntimeConfig(retry_count=2, retry_backoff_seconds=0, **runtime), batching=config(300, enable_checkpoint=False, checkpoint_every_n_chapters=2))


def shared_root(spark: SparkSession) -> str:
    """A new folder where driver and tasks share one, or on this machine if the session runs here alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="docfold-")
    return f"{base.rstrip('/')}/ledger-{uuid.uuid4().hex}"


def ran(spark: SparkSession, sf: str) -> Ledger:
    ledger = Ledger(spark, shared_root(spark))
    Pipeline(ledger, SCHEMAS, TEMPLATES, Marker(), settings()).run(books(spark, sf))
    return ledger


#: Batches and the halves of those that fail, and what is merged.
RUN = f"""{CH}, {packed_sql(300, 0)}, nodes AS (SELECT book, start_idx AS a, end_idx AS b, 0 AS d, '' AS parent FROM bat
 UNION ALL SELECT book, CASE h WHEN 0 THEN a ELSE a + (b - a + 1) // 2 END, CASE h WHEN 0 THEN a + (b - a + 1) // 2 - 1 ELSE b END, d + 1, printf('ch%04d-ch%04d-d%d', a, b, d) FROM nodes, (VALUES (0), (1)) t(h) WHERE a % 3 = 2 AND b > a),
named AS (SELECT *, printf('ch%04d-ch%04d-d%d', a, b, d) AS batch_id, a % 3 = 2 AND b > a AS broken FROM nodes),
merged AS (SELECT *, 'e' || (a % 4) AS entity, b - a + 1 AS n FROM named WHERE NOT broken),
totals AS (SELECT book, max(b) AS total, count(*) AS merges, count(DISTINCT entity) AS entities, max_by(batch_id, a) AS last_batch, max_by(n, a) AS last_n FROM merged GROUP BY book)"""
STATE = "SELECT book, entity, min(a) AS first, max_by(batch_id, a) AS last, max_by(n, a) AS n, count(*) AS touches FROM merged GROUP BY book, entity"


@query(f"WITH RECURSIVE {RUN} SELECT book::VARCHAR AS book, batch_id, parent AS parent_batch_id, d AS depth, a AS start_idx, b AS end_idx, k.retry, k.status, k.chunks FROM named, (VALUES (0, 'unparsed', 2, TRUE), (1, 'unparsed', 2, TRUE), (0, 'split', 0, TRUE), (0, 'merged', 2, FALSE)) k(retry, status, chunks, broken) WHERE k.broken = named.broken")
def c3_run_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Every attempt of a run: retries, splits, and the halves that they leave."""
    b = books(spark, sf)
    plan = with_chapters(B.batches_streamed(b, settings().batching), b)
    return attempts(plan, SCHEMAS, TEMPLATES, Marker(), settings(), workers=8).select("book", "batch_id", "parent_batch_id", "depth", "start_idx", "end_idx", "retry", "status", "chunks")


@query(f"WITH RECURSIVE {RUN}, q AS (SELECT book, batch_id, a, d, k.o, broken FROM named, (VALUES (0), (1), (2)) k(o) WHERE broken OR k.o = 0) SELECT book::VARCHAR AS book, batch_id, row_number() OVER (PARTITION BY book ORDER BY a, d, o) AS seq FROM q")
def o9_queue_order(spark: SparkSession, sf: str) -> DataFrame:
    """The order of attempts: a batch's halves, left then right, come before all later batches. Fair turns don't change it."""
    b = books(spark, sf)
    plan = with_chapters(B.batches_streamed(b, settings().batching), b)
    return attempts(plan, SCHEMAS, TEMPLATES, Marker(), settings(), workers=4, fair=True).select("book", "batch_id", "seq")


@query(f"WITH RECURSIVE {RUN} SELECT book::VARCHAR AS book, batch_id, CASE WHEN broken THEN '[broken' WHEN a % 3 = 0 THEN 'actors:' || chr(10) ELSE 'actors:' || chr(10) || '  e' || (a % 4) || ':' || chr(10) || '    last: ' || batch_id || chr(10) || '    n: ' || (b - a + 1) || chr(10) END AS response, CASE WHEN broken THEN 2 WHEN a % 3 = 0 THEN 1 ELSE 2 END AS chunks, CASE WHEN broken THEN 'unparsed' WHEN a % 3 = 0 THEN 'interrupted' ELSE 'merged' END AS status FROM named WHERE d = 0 AND NOT EXISTS (SELECT 1 FROM merged o WHERE o.book = named.book AND o.a < named.a AND o.a % 3 = 0)")
def k5_partial_stream(spark: SparkSession, sf: str) -> DataFrame:
    """What has come of an answer that breaks off is kept, with the number of its chunks. That fails a task, so its later batches
    aren't tried."""
    b = books(spark, sf)
    plan = with_chapters(B.batches_streamed(b, settings().batching), b)
    rows = attempts(plan, SCHEMAS, TEMPLATES, Marker(stops=True), settings())
    return rows.where("retry = 0 AND depth = 0 AND template <> ''").select("book", "batch_id", "response", "chunks", "status")


@query(f"WITH RECURSIVE {RUN}, s AS ({STATE}) SELECT book::VARCHAR AS book, entity, row_number() OVER (PARTITION BY book ORDER BY first) - 1 AS ordinal, '{{\"last\": \"' || last || '\", \"n\": ' || n || '}}' AS node, touches FROM s")
def s7_state(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed state from the ledger, folded on from its snapshot."""
    return ran(spark, sf).state(settings().merge).select("book", "entity", "ordinal", "node", "touches")


@query(f"WITH RECURSIVE {RUN}, s AS ({STATE}) SELECT book::VARCHAR AS book, 'actors' AS schema, 'actors:' || chr(10) || string_agg('  ' || entity || ':' || chr(10) || '    last: ' || last || chr(10) || '    n: ' || n, chr(10) ORDER BY first) AS yaml FROM s GROUP BY book")
def k1_yaml_export(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as YAML files, read back."""
    ledger = ran(spark, sf)
    path = f"{ledger.root}/again"
    export(ledger.documents(settings().merge), path)
    return exported(spark, path).select("book", "schema", "yaml")


def exported(spark: SparkSession, path: str) -> DataFrame:
    """(book, schema, yaml) of exported documents. On a local or mounted file system each task takes the folders of a share of the names."""
    files = Files(spark, path)
    if files.local():
        root, tasks = files.plain(), 2 * spark.sparkContext.defaultParallelism

        def run(pdfs):
            fs = LocalFileSystem()
            for no in (int(n) for pdf in pdfs for n in pdf["id"]):
                own = [f for f in fs.get_file_info(FileSelector(root)) if zlib.crc32(f.base_name.encode()) % tasks == no and f.base_name.startswith("book=")]
                for k in range(0, len(own), 256):
                    found = [(book, f) for book in own[k : k + 256] for f in fs.get_file_info(FileSelector(book.path, recursive=True)) if f.base_name.startswith("part-") and f.size]
                    texts = [fs.open_input_file(f.path).read().decode().rstrip("\n") for _, f in found]
                    value = lambda name: unescaped(name.partition("=")[2])
                    yield pd.DataFrame({"book": [value(b.base_name) for b, _ in found], "schema": [value(f.path.split("/")[-2]) for _, f in found], "yaml": texts}, dtype=object)

        return spark.range(0, tasks, 1, tasks).mapInPandas(run, "book string, schema string, yaml string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    part = lambda k: F.regexp_extract("path", f"/{k}=([^/]+)/", 1).alias(k)
    return found.where("length > 0").select(part("book"), part("schema"), F.rtrim(F.col("content").cast("string"), F.lit("\n")).alias("yaml"))


@query(f"WITH RECURSIVE {RUN}, i AS (SELECT DISTINCT book % 2 AS odd, book FROM totals) SELECT book::VARCHAR AS book, CASE WHEN odd = 1 THEN 'actors: {{}}' ELSE 'kept' END AS yaml, (SELECT count(*) FROM i WHERE odd = 1) AS new FROM i")
def k2_initial_documents(spark: SparkSession, sf: str) -> DataFrame:
    """An empty document for each task without one; those that are there stay."""
    ledger = Ledger(spark, shared_root(spark))
    names = books(spark, sf).select("book").distinct()
    path = f"{ledger.root}/output"
    export_texts(names.where("cast(book AS long) % 2 = 0").select(F.lit("kept").alias("value"), "book", F.lit("actors").alias("schema")), path)
    new = ledger.initialise(SCHEMAS, names, path)
    return exported(spark, path).select("book", "yaml", F.lit(new).cast("long").alias("new"))


@query(f"WITH RECURSIVE {RUN}, c AS (SELECT book, count(*) AS attempts FROM named, (VALUES (TRUE), (TRUE), (TRUE), (FALSE)) k(broken) WHERE k.broken = named.broken GROUP BY book) SELECT book::VARCHAR AS book, 'completed' AS status, total AS last_completed, total, 100.0 AS progress_percent, '' AS last_error, last_batch AS batch_id, merges - entities AS replaced_nodes, entities AS appended_nodes, attempts FROM totals JOIN c USING (book)")
def k3_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of each task after a whole run through the pipeline object."""
    return ran(spark, sf).progress().drop("schema")


@query(f"WITH RECURSIVE {RUN} SELECT book::VARCHAR AS book, printf('ch%04d', b) AS checkpoint_id, b AS chapter_index, b >= total AS is_final FROM merged JOIN totals USING (book) WHERE b >= total OR b % 2 = 0")
def k4_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return ran(spark, sf).checkpoints(2).select("book", "checkpoint_id", "chapter_index", "is_final")


@query(f"WITH RECURSIVE {RUN}, ck AS (SELECT book, min(b) AS at FROM merged JOIN totals USING (book) WHERE b >= total OR b % 2 = 0 GROUP BY book) SELECT t.book::VARCHAR AS book, CASE WHEN t.book = (SELECT min(book) FROM totals) THEN ck.at ELSE total END AS last_completed FROM totals t JOIN ck USING (book)")
def c11_restore(spark: SparkSession, sf: str) -> DataFrame:
    """The first book's task goes back to its first checkpoint; the others stay."""
    ledger = ran(spark, sf)
    first = str(books(spark, sf).agg(F.min(F.col("book").cast("long"))).first()[0])
    ledger.restore(first, "actors", 2, ledger.checkpoints(2).where(F.col("book") == first).orderBy("pos").first()["checkpoint_id"])
    return ledger.completed().select("book", "last_completed")


@query(f"WITH RECURSIVE {RUN}, x AS (SELECT book, max_by(b - a + 1, a) AS n, max_by(batch_id, a) FILTER (WHERE broken) AS s FROM named GROUP BY book), r AS (SELECT book, entity, a, lag(a) OVER (PARTITION BY book, entity ORDER BY a) AS before FROM merged), z AS (SELECT book, max_by(CASE WHEN before IS NULL THEN 0 ELSE 1 END, a) AS again FROM r GROUP BY book), ck AS (SELECT book, max_by(printf('ch%04d', b), a) AS saved FROM merged JOIN totals USING (book) WHERE b >= total OR b % 2 = 0 GROUP BY book) SELECT book::VARCHAR AS book, 'completed' AS status, 'base' AS template, 'received' AS receive_status, 2 AS chunk_count, 'passed' AS validation, 0 AS error_count, again AS replaced_nodes, 1 - again AS appended_nodes, total AS last_completed, saved AS last_saved_id, s IS NOT NULL AS was_split FROM totals JOIN x USING (book) JOIN z USING (book) JOIN ck USING (book)")
def c9_progress_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The progress document as the fold of all events of a run."""
    out = progress_of(ran(spark, sf).transitions(2))
    return out.select("book", "status", "template", "receive_status", "chunk_count", "validation", "error_count", "replaced_nodes", "appended_nodes", "last_completed", "last_saved_id", (F.col("last_split_reason") != "").alias("was_split"))


@query(f"WITH RECURSIVE {RUN} SELECT book::VARCHAR AS book, '[' || book || '][actors] batch=' || batch_id || ' template=' || k.t || ' retry=' || k.retry || ' status=' || k.status || k.e AS line FROM named, (VALUES (0, 'unparsed', TRUE, 'base', ' error=$: invalid yaml: while parsing a flow sequence'), (1, 'unparsed', TRUE, 'base', ' error=$: invalid yaml: while parsing a flow sequence'), (0, 'split', TRUE, '', ' error=$: invalid yaml: while parsing a flow sequence'), (0, 'merged', FALSE, 'base', '')) k(retry, status, broken, t, e) WHERE k.broken = named.broken")
def k6_run_log(spark: SparkSession, sf: str) -> DataFrame:
    """The run log, but for the time of each line."""
    return ran(spark, sf).log().select("book", F.regexp_replace("line", r"^\[[^\]]*\] ", "").alias("line"))


@query(f"WITH RECURSIVE {RUN} SELECT book::VARCHAR AS book, merges AS merged FROM totals")
def k10_uncommitted(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of a run that no pointer names aren't seen, and are gone after a clean-up."""
    ledger = ran(spark, sf)
    ledger.attempts().drop("run", "at").write.parquet(f"{ledger.root}/attempts/run=7")
    assert ledger.pointer()["runs"] == [1] and ledger._free() == 8
    ledger.vacuum()
    return ledger.attempts().where("status = 'merged'").groupBy("book").agg(F.count("*").alias("merged"))


@query("""WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id::VARCHAR AS book, CASE WHEN conv_id % 2 = 0 THEN n - 1 - i ELSE i END AS pos, role AS title, CASE WHEN conv_id % 2 = 0 THEN 'OPS/' ELSE '' END || printf('p%04d.xhtml', turn) AS source_path FROM c""")
def s3_archive_order(spark: SparkSession, sf: str) -> DataFrame:
    """Books as archives: those with a package in its reading order (the last turn first), with paths joined as they are, so that
    one that leads out of the folder is no page; those without in the archive's own order."""
    def each(r):
        turns = sorted((int(t["turn"]), t["role"]) for t in r["turns"])
        file = io.BytesIO()
        with zipfile.ZipFile(file, "w") as z:
            packaged = r["conv_id"] % 2 == 0
            if packaged:
                items = "".join(f'<item id="i{t}" href="p{t:04d}.xhtml"/>' for t, _ in turns) + '<item id="up" href="../p0000.xhtml"/>'
                order = "".join(f'<itemref idref="i{t}"/>' for t, _ in reversed(turns)) + '<itemref idref="up"/>'
                z.writestr("META-INF/container.xml", '<c><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></c>')
                z.writestr("OPS/p.opf", f"<package><manifest>{items}</manifest><spine>{order}</spine></package>")
            z.writestr("notes.txt", "no page")
            for t, role in turns:
                z.writestr(f"{'OPS/' if packaged else ''}p{t:04d}.xhtml", f"<h1> {role}</h1><p>text</p>")
        return [(b, pos, title, path) for b, pos, title, _, path in pages_of(str(r["conv_id"]), file.getvalue())]

    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    return by_row(rows, each, "book string, pos long, title string, source_path string")


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN role || text ELSE '' END AS delta FROM conversations")
def s10_stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of a service's chunks: the form that runs beside the model."""
    def each(r):
        content = (r["text"], [{"text": r["role"]}, 7, {"other": 1}, r["text"]], None)[r["turn"] % 3]
        return [(r["conv_id"], r["turn"], delta_of({"choices": [{"delta": {"content": content}}]}))]

    return by_row(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), each, "conv_id long, turn long, delta string")
