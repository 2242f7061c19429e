"""Tasks, templates, attempts, progress and checkpoints, as relations."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfold.functions import text as T

#: Templates that come first, in this order.
TEMPLATE_ORDER = ("base.md", "retry_format.md", "retry_schema.md")


def tasks(books: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every book with every schema, book by book. Schemas are a configured list, which each book's row gets as an
    array; the number of a task follows from its book's and its schema's."""
    listed_ = schemas.agg(F.array_sort(F.collect_list(F.struct("schema_no", *[c for c in schemas.columns if c != "schema_no"]))).alias("s")).first()[0]
    if not listed_:
        return books.crossJoin(schemas).withColumn("task_no", F.lit(1).cast("long"))  # none
    kind = f"array<struct<{','.join(f'{f}:{schemas.schema[f].dataType.simpleString()}' for f in ['schema_no', *[c for c in schemas.columns if c != 'schema_no']])}>>"
    literal = F.from_json(F.lit(json.dumps([r.asDict() for r in listed_])), kind)
    each = numbered(books, ["book_no"], "_b").select("*", F.posexplode(literal).alias("_s", "_x")).select(*books.columns, "_b", "_s", "_x.*")
    return each.withColumn("task_no", ((F.col("_b") - 1) * len(listed_) + F.col("_s") + 1).cast("long")).drop("_b", "_s")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in an order. For configured lists (books, tasks, templates) only: one task ranks them all."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def interleaved(rows: DataFrame) -> DataFrame:
    """The order in which tasks get their turns: each book's first, then each one's second, and so on."""
    rank = F.row_number().over(Window.partitionBy("book_no").orderBy("schema_no"))
    ranked = rows.withColumn("_rank", rank)
    return numbered(ranked, ["_rank", "book_no"], "turn").drop("_rank")


def spine(items: DataFrame, manifest: DataFrame, members: DataFrame) -> DataFrame:
    """Reading order (book, pos, path): items in the manifest whose path is a page and in the archive."""
    pages = manifest.where(T.is_page(F.col("path")))
    return items.join(pages, "item_id").join(members.select("path").distinct(), "path", "left_semi")


def weight(path: Column, key: Column, weights: dict[str, float]) -> Column:
    """By full path, else by key, else 1."""
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
    return F.coalesce(F.try_element_at(known, path), F.try_element_at(known, key), F.lit(1.0))


def with_context(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Each task's book's snapshot of one version; an empty mapping without one."""
    return rows.join(snapshot, "book", "left").withColumn("world", F.coalesce("world", F.lit("{}")))


def latest(checkpoints: DataFrame) -> DataFrame:
    """The last saved checkpoint of each task, whatever its chapter."""
    return checkpoints.groupBy("task").agg(F.max_by("checkpoint_id", "saved_seq").alias("checkpoint_id"), F.max_by("chapter_index", "saved_seq").alias("chapter_index"))


def listed(checkpoints: DataFrame) -> DataFrame:
    rows = checkpoints.select("task", "checkpoint_id", "chapter_index").distinct()
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("task").orderBy("chapter_index", "checkpoint_id")).cast("long"))


def resolve(asked: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The id asked for, else that of the latest checkpoint."""
    return asked.join(latest(checkpoints), "task", "left").select("task", F.coalesce("asked_id", "checkpoint_id").alias("checkpoint_id"))


def templates(files: DataFrame) -> DataFrame:
    order = F.create_map(*[F.lit(x) for i, n in enumerate(TEMPLATE_ORDER) for x in (n, i)])
    rank = F.coalesce(F.try_element_at(order, F.col("name")), F.lit(len(TEMPLATE_ORDER)))
    return numbered(files.withColumn("_rank", rank), ["_rank", "name"], "idx").withColumn("idx", F.col("idx") - 1).drop("_rank")


def append_absent(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return have.unionByName(new.dropDuplicates(keys).join(have, keys, "left_anti"))


def _finder(words: list[tuple[int, str]]):
    """A function from a text to the least (pos, keyword) that it has, or none: one pass over the text."""
    best: dict[str, int] = {}
    if not words:
        return lambda text: None
    for pos, word in words:
        best[word] = min(pos, best.get(word, pos))
    try:
        import ahocorasick
    except ImportError:
        ordered = sorted((pos, word) for word, pos in best.items())
        return lambda text: next(((p, w) for p, w in ordered if w in text), None)
    automaton = ahocorasick.Automaton()
    for word, pos in best.items():
        automaton.add_word(word, (pos, word))
    automaton.make_automaton()
    return lambda text: min((found for _, found in automaton.iter(text)), default=None)


def blacklisted(docs: DataFrame, keywords: DataFrame, block_chars: int = 1 << 24) -> DataFrame:
    """(doc_id, keyword): the first keyword (by pos) that a text has; texts without any have no row.

    Each text is gone through once for all keywords. Keywords travel to tasks in blocks of ``block_chars`` characters, one
    after another, so any number of them is looked for; a configured list is one block."""
    words = keywords.where(F.trim("keyword") != "").select(F.col("pos").cast("long").alias("pos"), "keyword").orderBy("pos")
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in words.toLocalIterator():
        if size > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((r.pos, r.keyword))
        size += len(r.keyword)

    def looked(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches):
            find = _finder(block)
            for pdf in batches:
                hits = [find(t) if isinstance(t, str) else None for t in pdf["text"]]
                has = [h is not None for h in hits]
                yield pd.DataFrame({"doc_id": pdf["doc_id"][has].to_numpy(), "pos": pd.Series([h[0] for h in hits if h], dtype="int64"), "keyword": pd.Series([h[1] for h in hits if h], dtype=object)})

        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, pos long, keyword string")

    hits = reduce(DataFrame.unionByName, [looked(b) for b in blocks])
    return hits.groupBy("doc_id").agg(F.min_by("keyword", "pos").alias("keyword"))


def events_of_stream(lines: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Payloads of the data lines before the end mark, in a stream's order."""
    by = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    done = F.max((F.btrim(F.substr("line", F.lit(6)), F.lit(" ")) == "[DONE]").cast("int")).over(by)
    rows = lines.withColumn("_done", done).where((F.coalesce("_done", F.lit(0)) == 0) & F.col("line").startswith("data:"))
    return rows.select(*keys, seq, F.trim(F.substr("line", F.lit(6))).alias("data"))


def collected(chunks: DataFrame, keys: list[str]) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    return chunks.groupBy(*keys).agg(parts.alias("p"), F.count("*").alias("chunks")).select(*keys, F.array_join(F.transform("p", lambda x: x["chunk"]), "").alias("body"), "chunks")


def judged(attempts: DataFrame) -> DataFrame:
    """Adds ``status`` (the first check that fails, or merged) and ``error_count``."""
    status = F.when(F.col("stream_error").isNotNull(), "interrupted").when(F.col("hit").isNotNull(), "blacklisted").when(F.col("parse_error").isNotNull(), "unparsed").when(F.col("issues") > 0, "invalid").otherwise("merged")
    count = F.when(F.col("status") == "merged", 0).when(F.col("status") == "invalid", F.col("issues")).otherwise(1)
    return attempts.withColumn("status", status).withColumn("error_count", count)


def first_success(rows: DataFrame) -> DataFrame:
    """(batch, attempts, retry, template, outcome): the success of the least retry, then template."""
    best = F.min(F.when(F.col("status") == "merged", F.struct("retry", "template")))
    out = rows.groupBy("batch").agg(F.count("*").alias("attempts"), best.alias("best"))
    return out.select("batch", "attempts", "best.retry", "best.template", F.when(F.col("best").isNotNull(), "completed").otherwise("failed").alias("outcome"))


def run_summary(rows: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    return rows.agg(failed.alias("failed"), F.count_if(F.col("status") != "failed").alias("completed"), F.when(failed > 0, 2).otherwise(0).alias("exit_code"))


def transitions(attempts: DataFrame) -> DataFrame:
    """(book, schema, at, step, event, batch_id, status, detail, n, m, chapter, total): the events that attempts (with ``total``
    chapters, and ``errors``, how many issues an answer had) stand for, in order of (at, step).

    running: detail is the template, n the retry. stream: detail says received or interrupted, n counts chunks. validation: detail says
    passed or failed, n counts errors. merge: n replaced, m appended. batch_completed: chapter is the batch's last. split and failed:
    detail is the reason. ``status`` is what the event makes the task's."""
    none, no = F.lit(None).cast("string"), F.lit(0).cast("long")

    def event(step, name, when, status=none, detail=none, n=no, m=no, chapter=no):
        fields = {"step": F.lit(step), "event": F.lit(name), "status": status, "detail": detail, "n": n.cast("long"), "m": m.cast("long"), "chapter": chapter.cast("long")}
        return F.when(when, F.struct(*[v.alias(k) for k, v in fields.items()]))

    s = F.col("status")
    tried, merged_ = ~s.isin("split", "failed"), s == "merged"
    after = F.when(F.col("end_idx") >= F.col("total"), "completed").otherwise("running")
    all_ = F.array(
        event(1, "running", tried, F.lit("running"), F.col("template"), F.col("retry")),
        event(2, "stream", tried, detail=F.when(s == "interrupted", "interrupted").otherwise("received"), n=F.col("chunks")),
        event(3, "validation", tried & (s != "interrupted"), detail=F.when(merged_, "passed").otherwise("failed"), n=F.col("errors")),
        event(4, "merge", merged_, n=F.col("replaced"), m=F.col("appended")),
        event(5, "batch_completed", merged_, after, chapter=F.col("end_idx")),
        event(6, "split", s == "split", F.lit("splitting"), F.col("error")),
        event(7, "failed", s == "failed", F.lit("failed"), F.col("error")),
    )
    rows = attempts.select("book", "schema", "at", "batch_id", F.col("total").cast("long").alias("total"), F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("x"))
    return rows.select("book", "schema", "at", "x.step", "x.event", "batch_id", "x.status", "x.detail", "x.n", "x.m", "x.chapter", "total")


def progress_of(events: DataFrame) -> DataFrame:
    """The progress document of each task: what the last event of each kind says."""
    place = F.struct("at", "step")
    last = lambda value, *kinds: F.max_by(value, F.when(F.col("event").isin(*kinds), place))
    done = F.coalesce(last("chapter", "batch_completed", "checkpoint_restored"), F.lit(0))
    return events.groupBy("book", "schema").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), place)).alias("status"),
        F.coalesce(last("detail", "running"), F.lit("")).alias("template"), F.coalesce(last("n", "running"), F.lit(0)).alias("retry"),
        F.coalesce(last("detail", "stream"), F.lit("")).alias("receive_status"), F.coalesce(last("n", "stream"), F.lit(0)).alias("chunk_count"),
        F.coalesce(last("detail", "validation"), F.lit("")).alias("validation"), F.coalesce(last("n", "validation"), F.lit(0)).alias("error_count"),
        F.coalesce(last("n", "merge"), F.lit(0)).alias("replaced_nodes"), F.coalesce(last("m", "merge"), F.lit(0)).alias("appended_nodes"),
        done.alias("last_completed"), F.coalesce(last("detail", "split"), F.lit("")).alias("last_split_reason"),
        F.coalesce(last("detail", "checkpoint_saved"), F.lit("")).alias("last_saved_id"), F.coalesce(last("detail", "checkpoint_restored"), F.lit("")).alias("last_restored_id"),
    )


def log_line(stamp: Column, book: Column, schema: Column, message: Column, error: Column) -> Column:
    """``[stamp] [book][schema] message``, with the error's first line if there is one."""
    tail = F.when(T.last_error(error) != "", F.concat(F.lit(" error="), F.substring_index(T.last_error(error), "\n", 1))).otherwise("")
    return F.concat(F.lit("["), stamp, F.lit("] ["), book, F.lit("]["), schema, F.lit("] "), message, tail)


def current(events: DataFrame, keys: list[str], columns: dict[str, str | None], defaults: dict[str, Any]) -> DataFrame:
    """The last value of each column by seq, among the events of a condition if it has one; then the default."""
    pick = []
    for name, condition in columns.items():
        value = F.max_by(name, F.when(F.expr(condition), F.col("seq")) if condition else F.col("seq"))
        pick.append((F.coalesce(value, F.lit(defaults[name])) if name in defaults else value).alias(name))
    return events.groupBy(*keys).agg(*pick, F.max("seq").alias("seq"))


def initialised(rows: DataFrame, have: DataFrame, keys: list[str], defaults: dict[str, Any]) -> DataFrame:
    out = rows.join(have, keys, "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def console_line(status: Column, done: Column, total: Column, where: Column, retries: Column, error: Column) -> Column:
    tail = F.coalesce(F.concat(F.lit(" error="), error), F.lit(""))
    return F.concat(F.format_string("[%s] %d/%d %s retry=%d", status, done, total, where, retries), tail)


def echo(prompt: Column, fallback: str) -> Column:
    """What the deterministic model says to a prompt."""
    return F.concat(F.coalesce(T.root_of_prompt(prompt), F.lit(fallback)), F.lit(": []"))
