"""Extraction: batches go to a text model, and what it answers becomes increments.

Each (book, schema) is one ordered stream within a task: its batches are tried one after another, with retries
over templates, and split where all fail. Every attempt is a row, so the model's answers are data: they are
written once, and state is folded from those that were merged.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docfold.clients import Client
from docfold.config import AppConfig
from docfold.functions.prompts import PLACEHOLDERS, RULES
from docfold.operators.increments import GONE, decode, encode, parsed, sanitized, validated
from docfold.operators.schema import MATCH_KEY
from docfold.operators.similarity import merged

ATTEMPTS = "book string, schema string, batch_id string, parent_batch_id string, depth int, start_idx long, end_idx long, retry int, template string, prompt string, response string, chunks int, status string, error string, increment string, replaced int, appended int, seq long, stamp string, errors int"

#: Of a stream: tasks of a round at most, rows made into Python's at a time, and characters of prompts and answers held, about.
TASKS, ROWS, CHARACTERS = 1024, 32, 4 << 20

#: Gets (book, schema, batch_id, chunk).
Sink = Callable[[str, str, str, str], None]


def render(template: str, values: dict[str, Callable[[], Any]]) -> str:
    """Values are made for the placeholders that the template has, or that a value has brought in."""
    for name in PLACEHOLDERS:
        if (mark := "{{" + name + "}}") in template:
            template = template.replace(mark, str(values[name]()))
    return template


def prompt_values(chapters: list[dict], batch_id: str, schema: dict, state: dict, world: str, error: str) -> dict[str, Callable[[], Any]]:
    """What makes each placeholder's value."""
    source = lambda: "\n\n".join(f"### Chapter {c['chapter_index']}\nchapter_id: {c['chapter_id']}\nchapter_title: {c['title']}\n\n{c['text'].strip()}" for c in chapters)
    label = lambda: batch_id.rpartition("-d")[0]
    titles = lambda: chapters[0]["title"] if len(chapters) == 1 else f"{chapters[0]['title']} ~ {chapters[-1]['title']}"
    rules = lambda: "\n".join(RULES).replace("{root}", schema["root_key"]).replace("{match}", MATCH_KEY)
    return dict(zip(PLACEHOLDERS, (source, lambda: schema["schema_text"], lambda: encode(state) if state else "{}", lambda: world.strip() or "{}", lambda: error.strip() or "none", lambda: schema["root_key"], lambda: MATCH_KEY, rules, titles, label, lambda: batch_id, label, lambda: len(chapters)), strict=True))


def upsert(state: dict, increment: dict, root: str, config: AppConfig) -> tuple[dict, int, int]:
    """State with the root's entries merged in; how many were merged and appended. An entry that is no mapping
    is an error, which counts as a failed attempt."""
    entries = increment.get(root, {})
    if not isinstance(entries, dict) or any(not isinstance(v, dict) for v in entries.values()):
        raise ValueError(f"{root} must map entries to mappings")
    now, old = dict(state.get(root, {})), 0
    for k, v in entries.items():
        old += k in now
        now[k] = merged(now[k], v, config.merge) if k in now else v
    return state | {root: now}, old, len(entries) - old


class Task:
    """One (book, schema): its state so far, and the attempts that it makes. ``sink`` gets each chunk when it comes."""

    def __init__(self, book: str, schema: dict, templates: list[dict], client: Client, config: AppConfig, state: dict, world: str, sink: Sink | None = None) -> None:
        self.sink = sink
        self.book, self.schema, self.templates, self.client, self.config, self.state, self.world = book, schema, templates, client, config, state, world
        self.seq, self.failed = 0, False

    def row(self, batch: dict, **more: Any) -> dict:
        self.seq += 1
        return {"book": self.book, "schema": self.schema["schema"], **{k: batch[k] for k in ("batch_id", "parent_batch_id", "depth", "start_idx", "end_idx")}, "retry": 0, "template": "", "prompt": "", "response": "", "chunks": 0, "error": "", "increment": None, "replaced": 0, "appended": 0, "errors": 0, "seq": self.seq, "stamp": time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())} | more

    def attempt(self, batch: dict, retry: int, template: dict, error: str) -> dict:
        prompt = render(template["content"], prompt_values(batch["chapters"], batch["batch_id"], self.schema, self.state, self.world, error))
        base = {"retry": retry, "template": template["name"], "prompt": prompt}
        chunks: list[str] = []
        try:
            for chunk in self.client(prompt):
                chunks.append(chunk)
                if self.sink is not None:
                    self.sink(self.book, self.schema["schema"], batch["batch_id"], chunk)
        except Exception as e:  # noqa: BLE001  whatever the model's client raises is a failed attempt; what has come by then is kept
            return self.row(batch, **base, response="".join(chunks), chunks=len(chunks), status="interrupted", error=f"stream failed: {e}")
        text = "".join(chunks)
        base |= {"response": text, "chunks": len(chunks)}
        if hit := next((k for k in self.config.blacklist_keywords if k.strip() and k in text), None):
            return self.row(batch, **base, status="blacklisted", errors=1, error=f"blacklisted keyword: {hit}")
        data, why = parsed(text)
        if data is None:
            return self.row(batch, **base, status="unparsed", errors=1, error=why)
        clean = sanitized(data)
        clean = {} if clean is GONE else clean
        found = validated(clean, self.schema["root_key"], self.schema["sample"], self.config.runtime.validation)
        if found:
            return self.row(batch, **base, status="invalid", errors=len(found), error="; ".join(f"{p}: {r}" for p, r in found))
        try:
            self.state, old, new = upsert(self.state, clean, self.schema["root_key"], self.config)
        except ValueError as e:
            return self.row(batch, **base, status="invalid", errors=1, error=str(e))
        return self.row(batch, **base, status="merged", increment=encode(clean), replaced=old, appended=new)

    def run(self, first: dict) -> Iterator[dict]:
        """Attempts at a batch and, if it is split, at its parts: left then right, before any later batch."""
        queue = [first]
        while queue and not self.failed:
            batch, error, done = queue.pop(0), "", False
            for retry in range(self.config.runtime.retry_count):
                for template in self.templates:
                    out = self.attempt(batch, retry, template, error)
                    yield out
                    if done := out["status"] == "merged":
                        break
                    error = out["error"]
                if done:
                    break
                if retry + 1 < self.config.runtime.retry_count and self.config.runtime.retry_backoff_seconds > 0:
                    time.sleep(self.config.runtime.retry_backoff_seconds)
            if done:
                continue
            b = self.config.batching
            if len(batch["chapters"]) > 1 and b.enable_multi_chapter and b.split_on_failure and b.split_after_retry_exhausted:
                yield self.row(batch, status="split", error=error or "batch retries exhausted")
                parts = halves(batch)
                queue = [*parts, *queue] if self.config.runtime.split_order == "front" else [*queue, *parts]
            else:
                self.failed = True
                yield self.row(batch, status="failed", error=error or "batch retries exhausted")


def halves(batch: dict) -> list[dict]:
    mid = len(batch["chapters"]) // 2
    out = []
    for part in (batch["chapters"][:mid], batch["chapters"][mid:]):
        a, b, depth = part[0]["chapter_index"], part[-1]["chapter_index"], batch["depth"] + 1
        out.append({"batch_id": f"ch{a:04d}-ch{b:04d}-d{depth}", "parent_batch_id": batch["batch_id"], "depth": depth, "start_idx": a, "end_idx": b, "chapters": part})
    return out


def with_chapters(batches: DataFrame, chapters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Batches with their chapters as an ordered array, and their ``turn`` in their book, which is told before texts are joined: each
    batch's places are listed, and joined by (book, place). ``by``: columns of the batches besides, one value a book, by which the result is
    dealt to tasks; texts are shuffled by them before they are put together, and not again."""
    c = F.struct("chapter_index", "chapter_id", "title", "text")
    turn = F.row_number().over(Window.partitionBy("book").orderBy("start_idx", "batch_id"))
    places = batches.select(*by, "book", "batch_id", "start_idx", "end_idx", turn.alias("turn")).select("*", F.explode(F.sequence("start_idx", "end_idx")).alias("chapter_index"))
    rows = places.join(chapters.select("book", F.col("chapter_index").cast("long").alias("chapter_index"), "chapter_id", "title", "text"), ["book", "chapter_index"])
    rows = rows.repartition(*by) if by else rows
    return rows.groupBy(*by, "book", "batch_id", "start_idx", "end_idx", "turn").agg(F.array_sort(F.collect_list(c)).alias("chapters"))


def attempts(batches: DataFrame, schemas: list[dict], templates: list[dict], client: Client, config: AppConfig, states: DataFrame | None = None, workers: int | None = None, fair: bool = False, sink: Sink | None = None) -> DataFrame:
    """All attempts (see ATTEMPTS) at batches with chapters (see ``with_chapters``), for every schema: (schema, root_key, schema_text,
    sample). Texts are shuffled once, to the streams. ``states`` has (book, schema, state, world, last_completed): where tasks go on from; they reach a task as one row that
    comes before its batches.

    ``workers``: streams at most, and so calls to the model at a time. ``fair``: a stream gives each task of a round one batch in turn,
    book by book, and holds the documents of all of them: a round is at most ``TASKS`` tasks, and the next begins when they are done; else it
    finishes one task after another and holds one's. Answers leave a task in pieces. Write the result before using it: the model is asked
    again whenever it is recomputed."""
    by_name = {s["schema"]: s for s in schemas}
    names = F.array(*[F.lit(s["schema"]) for s in schemas])
    rows = batches.select("book", "batch_id", "start_idx", "end_idx", "turn", "chapters").withColumn("schema", F.explode(names))
    nothing = F.lit(None).cast("string")
    if states is not None:
        done = states.select("book", "schema", "last_completed")
        rows = rows.join(done, ["book", "schema"], "left").where(F.col("start_idx") > F.coalesce("last_completed", F.lit(0))).drop("last_completed")
    rows = rows.withColumn("state", nothing).withColumn("world", nothing)
    if states is not None:
        seeds = states.select("book", "schema", "state", "world").where(F.col("schema").isin(list(by_name))).withColumn("turn", F.lit(0))
        rows = rows.unionByName(seeds, allowMissingColumns=True)

    kinds = to_arrow_schema(StructType.fromDDL(ATTEMPTS))

    def run(parts):
        tasks: dict[tuple, Task] = {}
        group, out, size = None, [], 0
        for r in (r for part in parts for k in range(0, part.num_rows, ROWS) for r in part.slice(k, ROWS).to_pylist()):
            key = (r["book"], r["schema"])
            if r["round"] != group:
                tasks.clear()
                group = r["round"]
            if key not in tasks:
                if not fair:
                    tasks.clear()
                tasks[key] = Task(r["book"], by_name[r["schema"]], templates, client, config, decode(r["state"]) if r["state"] else {}, r["world"] or "", sink)
            if r["turn"] and not tasks[key].failed:
                for row in tasks[key].run({"batch_id": r["batch_id"], "parent_batch_id": "", "depth": 0, "start_idx": r["start_idx"], "end_idx": r["end_idx"], "chapters": r["chapters"]}):
                    out.append(row)
                    size += len(row["prompt"]) + len(row["response"])
                    if size > CHARACTERS:
                        yield pa.RecordBatch.from_pylist(out, schema=kinds)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    # All rows in one stream need no shuffle: a step of a run is a job of one stage.
    dealt = rows.coalesce(1) if workers == 1 else rows.repartition(workers, "book", "schema") if workers else rows.repartition("book", "schema")
    dealt = dealt.sortWithinPartitions("book", "schema", "turn")
    if fair:
        # The number of a task's first row in its stream says its round; ids count rows in their order, and a stream has whole tasks.
        first = F.first("no").over(Window.partitionBy("book", "schema").orderBy("turn"))
        dealt = dealt.withColumn("no", F.monotonically_increasing_id()).withColumn("round", F.floor(first / TASKS).cast("long")).sortWithinPartitions("round", "turn", "book", "schema")
    else:
        dealt = dealt.withColumn("round", F.lit(0).cast("long"))
    return dealt.select("book", "schema", "batch_id", "start_idx", "end_idx", "chapters", "state", "world", "turn", "round").mapInArrow(run, ATTEMPTS)
