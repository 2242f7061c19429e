"""The ledger: attempts as an append-only table; state, progress and checkpoints as what it says.

A run's attempts are visible once the ledger's pointer names the run, so a run counts wholly or not at all, and
once. State is the fold of merged increments in order; a checkpoint is a place in that order; restoring hides
what came after it for one task. Nothing is rewritten.
"""

from __future__ import annotations

import datetime
import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import BinaryIO

import pandas as pd
from pyarrow.fs import LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfold.config import MergeConfig, yaml
from docfold.extraction import ATTEMPTS
from docfold.functions import text as T
from docfold.operators import batching as B
from docfold.operators.control import log_line, transitions
from docfold.operators.increments import decode, encode, entries, folded
from docfold.session import Files, spread, tasks_for_rows

POINTER = "ledger"
ORDER = 1 << 32
EMPTY = {"runs": [], "hidden": [], "schemas": {}, "totals": [], "stamps": {}, "snapshot": None}


def now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass(frozen=True)
class View:
    """The levels of the snapshot that count, runs that they don't have, and tasks restored since: (book, schema, after)."""

    levels: list[dict]
    new_runs: list[int]
    restored: list[dict]


class Ledger:
    """Versions of the pointer are files of their own, the greatest counts. Whatever a writer leaves half done isn't named by
    one and never seen; nothing that a version names is deleted or written again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def pointer(self) -> dict:
        return EMPTY | self.files.latest(POINTER, {})[1]

    def _publish(self, seen: int, pointer: dict) -> None:
        self.files.publish(POINTER, seen + 1, pointer | {"updated_at": now()})

    def _free(self) -> int:
        """A run's number that no folder has, be it visible or not."""
        have = self.files.numbers("attempts", "run") + self.files.numbers("totals", "run") + self.pointer()["runs"]
        return max(have, default=0) + 1

    def commit(self, attempts: DataFrame, schemas: list[dict], totals: DataFrame | None = None, snapshot: MergeConfig | None = None) -> int:
        """Writes a run's attempts, then makes them visible. ``totals``: (book, total) chapters. ``snapshot``: the state as of
        this run is written as well, so that it needn't be folded again from all attempts."""
        run = self._free()
        attempts.write.mode("errorifexists").parquet(f"{self.root}/attempts/run={run}")
        if totals is not None:
            totals.write.mode("errorifexists").parquet(f"{self.root}/totals/run={run}")
        seen, p = self.files.latest(POINTER, {})
        p = EMPTY | p
        p = p | {"runs": [*p["runs"], run], "schemas": p["schemas"] | {s["schema"]: s["root_key"] for s in schemas}, "stamps": p["stamps"] | {str(run): now()}}
        if totals is not None:
            p["totals"] = [*p["totals"], run]
        self._publish(seen, p)
        if snapshot is not None:
            self.snapshot(snapshot)
        return run

    def snapshot(self, config: MergeConfig = MergeConfig()) -> None:  # noqa: B008
        """Writes what entries have become since the last snapshot, as a level over it: later folds go on from the last level that has
        an entry. After a restore, and of a merge by other settings, the state is written whole. Levels are merged as soon as they are
        not half of the one below, so there are few, and a commit writes in proportion to what it touches."""
        seen, p = self.files.latest(POINTER, {})
        p = EMPTY | p
        if not p["runs"]:
            return
        view = self._view(p, config)
        whole = view.restored or not view.levels
        if not whole and not view.new_runs:
            return
        levels = [] if whole else list(view.levels)
        levels.append(self._level(self._refolded(view, config, only_touched=not whole), p["runs"]))
        while len(levels) > 1 and 2 * levels[-1]["rows"] > levels[-2]["rows"]:
            upper = [levels.pop(), levels.pop()]
            levels.append(self._level(self._latest(upper[::-1]), p["runs"]))
        self._publish(seen, p | {"snapshot": {"levels": levels, "hidden": len(p["hidden"]), "config": asdict(config)}})

    def _level(self, rows: DataFrame, runs: list[int]) -> dict:
        name = f"state/{max(runs)}-{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(f"{self.root}/{name}")
        return {"path": name, "runs": runs, "rows": self.spark.read.schema(FOLDED).parquet(f"{self.root}/{name}").count()}

    def _latest(self, levels: list[dict], restored: list[dict] | None = None) -> DataFrame:
        """Each entry as the last of the levels has it; of restored tasks, the last that knows nothing of what is hidden."""
        rows = None
        for i, level in enumerate(levels):
            one = self.spark.read.schema(FOLDED).parquet(f"{self.root}/{level['path']}")
            for h in restored or ():
                if max(level["runs"]) * ORDER > h["after"] - ORDER:
                    one = one.where(~((F.col("book") == h["book"]) & (F.col("schema") == h["schema"])))
            one = one.withColumn("level", F.lit(i))
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            return self.spark.createDataFrame([], FOLDED)
        if len(levels) == 1:
            return rows.drop("level")
        last = F.max_by(F.struct("first", "node", "touches"), "level").alias("x")
        return rows.groupBy(*KEYS).agg(last).select(*KEYS, "x.*")

    def attempts(self) -> DataFrame:
        """Visible attempts with ``run`` and ``at``, their place in the order."""
        p = self.pointer()
        if not p["runs"]:
            return self.spark.createDataFrame([], ATTEMPTS + ", run int, at long")
        rows = self.spark.read.schema(ATTEMPTS + ", run int").option("basePath", f"{self.root}/attempts").parquet(*[f"{self.root}/attempts/run={r}" for r in p["runs"]])
        rows = rows.withColumn("at", F.col("run").cast("long") * ORDER + F.col("seq"))
        for h in p["hidden"]:
            rows = rows.where(~((F.col("book") == h["book"]) & (F.col("schema") == h["schema"]) & (F.col("at") > h["after"]) & (F.col("run") <= h["upto"])))
        return rows

    def totals(self) -> DataFrame:
        p = self.pointer()
        if not p["totals"]:
            return self.spark.createDataFrame([], "book string, total long")
        return self.spark.read.schema("book string, total long").parquet(*[f"{self.root}/totals/run={r}" for r in p["totals"]]).groupBy("book").agg(F.max("total").cast("long").alias("total"))

    def _view(self, p: dict, config: MergeConfig, upto: dict | None = None) -> View:
        """The levels that a fold can go on from, and what they don't have. None, if they are of another merge, or if a run became visible
        that comes before what they have folded."""
        s = p["snapshot"]
        levels = s["levels"] if s and s["config"] == asdict(config) else []
        folded_ = set(levels[-1]["runs"]) if levels else set()
        new = [r for r in p["runs"] if r not in folded_]
        if levels and new and min(new) < max(folded_):
            levels, new = [], p["runs"]
        restored = p["hidden"][s["hidden"] :] if levels else []
        if upto:
            restored = [*restored, {"book": upto["book"], "schema": upto["schema"], "after": upto["at"]}]
        return View(levels, new, restored)

    def _folded(self, config: MergeConfig, upto: dict | None = None) -> DataFrame:
        """(book, schema, entity, first, node, touches) of all entries: those of the snapshot, and the merged increments
        after it."""
        view = self._view(self.pointer(), config, upto)
        if view.levels and not view.new_runs and not view.restored:
            return self._latest(view.levels)
        return self._refolded(view, config, upto)

    def _refolded(self, view: View, config: MergeConfig, upto: dict | None = None, only_touched: bool = False) -> DataFrame:
        """What the levels and the increments after them come to. A restored task goes on from the nearest level before the place that
        it was restored to."""
        rows = self.attempts().where("status = 'merged'")
        if upto:
            rows = rows.where((F.col("book") == upto["book"]) & (F.col("schema") == upto["schema"]) & (F.col("at") <= upto["at"]))
        if view.levels:
            known = F.lit(max(view.levels[-1]["runs"]))
            for h in view.restored:
                before = [max(x["runs"]) for x in view.levels if max(x["runs"]) * ORDER <= h["after"] - ORDER]
                mine = (F.col("book") == h["book"]) & (F.col("schema") == h["schema"])
                known = F.when(mine, F.least(known, F.lit(max(before, default=0)))).otherwise(known)
            rows = rows.where(F.col("run") > known)
        out = None
        for schema, root in self.pointer()["schemas"].items():
            one = entries(rows.where(F.col("schema") == schema).select("book", "schema", F.col("at").alias("seq"), F.col("increment").alias("node")), root).where("entity is not null")
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self.spark.createDataFrame([], FOLDED)
        new = out.select(*KEYS, "seq", "node", F.struct("seq", "pos").alias("first"), F.lit(1).cast("long").alias("touches"))
        if not view.levels:
            return _fold(new, config, KEYS)
        old = self._latest(view.levels, view.restored)
        if upto:
            old = old.where((F.col("book") == upto["book"]) & (F.col("schema") == upto["schema"]))
        touched = new.select(*KEYS).distinct()
        again = old.join(touched, list(KEYS), "left_semi").select(*KEYS, F.lit(0).cast("long").alias("seq"), "node", "first", "touches")
        now_ = _fold(again.unionByName(new), config, KEYS)
        return now_ if only_touched else now_.unionByName(old.join(touched, list(KEYS), "left_anti"))

    def state(self, config: MergeConfig = MergeConfig(), upto: dict | None = None) -> DataFrame:  # noqa: B008
        """(book, schema, entity, ordinal, node, touches): entries in the order in which they first came."""
        no = F.row_number().over(Window.partitionBy("book", "schema").orderBy("first")) - 1
        return self._folded(config, upto).select("book", "schema", "entity", no.cast("long").alias("ordinal"), "node", "touches")

    def documents(self, config: MergeConfig = MergeConfig(), upto: dict | None = None) -> DataFrame:  # noqa: B008
        """(book, schema, state): whole documents as ordered JSON."""
        e = F.struct("first", "entity", "node")
        rows = self._folded(config, upto).repartition(tasks_for_rows(self.spark), "book", "schema").groupBy("book", "schema").agg(F.array_sort(F.collect_list(e)).alias("e"))
        body = F.array_join(F.transform("e", lambda x: F.concat(F.regexp_replace(F.to_json(F.struct(x["entity"].alias("k"))), r'^\{"k":|\}$', ""), F.lit(": "), x["node"])), ", ")
        roots = F.create_map(*[F.lit(x) for kv in self.pointer()["schemas"].items() for x in kv]) if self.pointer()["schemas"] else F.create_map().cast("map<string,string>")
        return rows.select("book", "schema", F.concat(F.lit('{"'), F.try_element_at(roots, F.col("schema")), F.lit('": {'), body, F.lit("}}")).alias("state"))

    def completed(self) -> DataFrame:
        """(book, schema, last_completed): the end of the merged batches that have no gap before them."""
        merged = self.attempts().where("status = 'merged'").select(F.struct("book", "schema").alias("book"), "start_idx", "end_idx").distinct()
        return B.completed_prefix(merged).select("book.book", "book.schema", "last_completed")

    def transitions(self, every: int = 0) -> DataFrame:
        """(book, schema, at, step, event, batch_id, status, detail, n, m, chapter, total): what each attempt, checkpoint and restore
        changed, in order. See ``control.transitions``; the current progress document is ``control.progress_of`` of it."""
        rows = transitions(self.attempts().join(self.totals(), "book", "left").withColumn("total", F.coalesce("total", F.lit(0))))
        marks = self.checkpoints(every) if every > 0 else None
        if marks is not None:
            saved = marks.select("book", "schema", "at", F.lit(9).alias("step"), F.lit("checkpoint_saved").alias("event"), F.lit("").alias("batch_id"), F.lit(None).cast("string").alias("status"), F.col("checkpoint_id").alias("detail"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"), F.col("chapter_index").alias("chapter"), F.lit(0).cast("long").alias("total"))
            rows = rows.unionByName(saved)
        hidden = [(h["book"], h["schema"], (h["upto"] + 1) * ORDER - 1, 10 + i, "checkpoint_restored", "", None, h["checkpoint_id"], 0, 0, h.get("chapter_index", 0), 0) for i, h in enumerate(self.pointer()["hidden"])]
        if hidden:
            rows = rows.unionByName(self.spark.createDataFrame(hidden, "book string, schema string, at long, step int, event string, batch_id string, status string, detail string, n long, m long, chapter long, total long"))
        return rows

    def progress(self) -> DataFrame:
        """The last word on each task, from its attempts."""
        a = self.attempts().groupBy("book", "schema").agg(F.max_by("status", "at").alias("last_status"), F.max_by("error", "at").alias("last_error"), F.max_by("batch_id", "at").alias("batch_id"), F.sum("replaced").alias("replaced_nodes"), F.sum("appended").alias("appended_nodes"), F.count("*").alias("attempts"))
        rows = a.join(self.completed(), ["book", "schema"], "left").join(self.totals(), "book", "left")
        done = F.coalesce("last_completed", F.lit(0))
        status = F.when(F.col("last_status") == "failed", "failed").when(done >= F.coalesce("total", F.lit(0)), "completed").otherwise("running")
        return rows.select("book", "schema", status.alias("status"), done.alias("last_completed"), "total", T.percent(done, F.col("total")).alias("progress_percent"), T.last_error(F.col("last_error")).alias("last_error"), "batch_id", "replaced_nodes", "appended_nodes", "attempts")

    def log(self) -> DataFrame:
        """(book, schema, at, line): the run log, a line for each attempt and restore, ``[stamp] [book][schema] message``."""
        stamps = self.pointer()["stamps"]
        known = F.create_map(*[F.lit(x) for kv in stamps.items() for x in kv]) if stamps else F.create_map().cast("map<string,string>")
        a = self.attempts()
        stamp = F.coalesce(F.col("stamp"), F.try_element_at(known, F.col("run").cast("string")), F.lit(""))
        rows = a.select("book", "schema", "at", log_line(stamp, F.col("book"), F.col("schema"), F.concat_ws(" ", F.concat(F.lit("batch="), "batch_id"), F.concat(F.lit("template="), F.col("template")), F.concat(F.lit("retry="), F.col("retry").cast("string")), F.concat(F.lit("status="), "status")), F.col("error")).alias("line"))
        restores = [(h["book"], h["schema"], (h["upto"] + 1) * ORDER - 1, f"[{h['restored_at']}] [{h['book']}][{h['schema']}] restored checkpoint {h['checkpoint_id']}") for h in self.pointer()["hidden"]]
        return rows.unionByName(self.spark.createDataFrame(restores, "book string, schema string, at long, line string")) if restores else rows

    def export_log(self, path: str) -> None:
        """The run log as text, a folder for each task, lines in order."""
        export_texts(self.log().select("book", "schema", "at", F.col("line").alias("value")), path, order=["at"])

    def resume(self, config: MergeConfig = MergeConfig(), world: str = "world") -> DataFrame:  # noqa: B008
        """(book, schema, state, world, last_completed): what tasks go on from. The context that prompts quote
        is the document of the schema ``world`` as of the last commit, so it depends on no scheduling."""
        docs = self.documents(config)
        context = docs.where(F.col("schema") == world).select("book", F.col("state").alias("world"))
        return self.completed().join(docs, ["book", "schema"], "left").join(context, "book", "left").select("book", "schema", "state", "world", "last_completed")

    def checkpoints(self, every: int) -> DataFrame:
        """(book, schema, checkpoint_id, chapter_index, is_final, at, pos): after merged batches where one is due."""
        rows = self.attempts().where("status = 'merged'").join(self.totals(), "book", "left")
        total = F.coalesce("total", F.lit(2**31))
        due = rows.where(B.should_checkpoint(F.col("end_idx"), F.lit(0), total, every))
        last = due.groupBy("book", "schema", "end_idx").agg(F.max("at").alias("at"), F.first(total).alias("total"))
        by = Window.partitionBy("book", "schema").orderBy("end_idx")
        return last.select("book", "schema", T.checkpoint_id(F.col("end_idx")).alias("checkpoint_id"), F.col("end_idx").alias("chapter_index"), (F.col("end_idx") >= F.col("total")).alias("is_final"), "at", F.row_number().over(by).alias("pos"))

    def verify(self) -> None:
        """An error that lists the folders that the pointer names and that are missing."""
        p = self.pointer()
        names = [*(f"attempts/run={r}" for r in p["runs"]), *(f"totals/run={r}" for r in p["totals"])]
        if missing := [f"{self.root}/{n}" for n in names if not self.files.exists(f"{n}/_SUCCESS")]:
            raise FileNotFoundError(f"checkpoint files missing: {', '.join(missing)}")

    def restore(self, book: str, schema: str, every: int, checkpoint_id: str | None = None, latest: bool = False) -> str:
        """Hides a task's attempts after a checkpoint: the one of that id, or the one saved last. All that it is made of must be
        there."""
        if bool(checkpoint_id) == latest:
            raise ValueError("give a checkpoint's id or ask for the latest, one of both")
        self.verify()
        rows = self.checkpoints(every).where((F.col("book") == book) & (F.col("schema") == schema))
        found = (rows.where(F.col("checkpoint_id") == checkpoint_id) if checkpoint_id else rows).orderBy(F.desc("at")).first()
        if found is None:
            raise ValueError(f"no checkpoint {checkpoint_id or ''} of {book} and {schema}".replace("  ", " "))
        seen, p = self.files.latest(POINTER, {})
        p = EMPTY | p
        hide = {"book": book, "schema": schema, "after": found["at"], "upto": max(p["runs"]), "checkpoint_id": found["checkpoint_id"], "chapter_index": found["chapter_index"], "restored_at": now()}
        self._publish(seen, p | {"hidden": [*p["hidden"], hide]})
        return found["checkpoint_id"]

    def initialise(self, schemas: list[dict], books: list[str] | DataFrame, path: str) -> int:
        """Writes an empty document for each (book, schema) that has none under ``path``; says how many. On a local or mounted file system
        tasks look for what is there, elsewhere it is listed once."""
        if not isinstance(books, DataFrame):
            books = self.spark.createDataFrame([(b,) for b in books], "book string")
        files = Files(self.spark, path)
        if files.local():
            return export(_empty(books, schemas), path, "append", only_new=True)
        have = self.spark.createDataFrame(exported_tasks(files), "book string, schema string")
        new = _empty(books, schemas).join(have, ["book", "schema"], "left_anti").persist()
        try:
            if n := new.count():
                export(new, path, "append")
            return n
        finally:
            new.unpersist()

    def all_documents(self, books: DataFrame, schemas: list[dict], config: MergeConfig = MergeConfig()) -> DataFrame:  # noqa: B008
        """(book, schema, state) of every book with every schema: the empty document where nothing was merged."""
        have = self.documents(config).withColumnRenamed("state", "now")
        return _empty(books, schemas).join(have, ["book", "schema"], "left").select("book", "schema", F.coalesce("now", "state").alias("state"))

    def vacuum(self) -> list[int]:
        """Deletes the folders of runs that no version of the pointer that is kept names; their numbers. Not while another writes."""
        named = {r for v in self.files.versions(POINTER) for r in self.files.read(f"{POINTER}-{v}.json")["runs"]}
        gone = sorted(set(self.files.numbers("attempts", "run") + self.files.numbers("totals", "run")) - named)
        for r in gone:
            self.files.delete(f"attempts/run={r}")
            self.files.delete(f"totals/run={r}")
        return gone

    def yaml_of(self, book: str, schema: str, config: MergeConfig = MergeConfig()) -> str:  # noqa: B008
        """One task's document as YAML: keys in their order, sequences indented."""
        row = self.documents(config).where((F.col("book") == book) & (F.col("schema") == schema)).first()
        root = self.pointer()["schemas"].get(schema, "root")
        return to_yaml(decode(row["state"]) if row else {root: {}})


KEYS = ("book", "schema", "entity")
FOLDED = "book string, schema string, entity string, first struct<seq:bigint,pos:bigint>, node string, touches long"


def _fold(rows: DataFrame, config: MergeConfig, keys: tuple[str, ...]) -> DataFrame:
    """Entries (keys, seq, node, first, touches) folded by key in the order of seq."""
    return folded(rows, config, keys, again=True).select(*keys, "first", "node", "touches")


def _empty(books: DataFrame, schemas: list[dict]) -> DataFrame:
    """(book, schema, state) of every book with every schema: documents without entries."""
    each = F.explode(F.array(*[F.struct(F.lit(s["schema"]).alias("schema"), F.lit(json.dumps({s["root_key"]: {}})).alias("state")) for s in schemas])).alias("x")
    return books.select("book").distinct().select("book", each).select("book", "x.*")


def exported_tasks(files: Files) -> list[tuple[str, str]]:
    """(book, schema) of the documents that were exported to a folder, from one listing."""
    return [(unescaped(x), unescaped(y)) for x, y in files.pairs("book", "schema")]


def unescaped(name: str) -> str:
    """A value from the name of a folder, where Spark writes what a path can't hold as % and two digits."""
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name)


def escaped(name: str | None) -> str:
    """The name of a folder as Spark writes a value's: see ``unescaped``."""
    return re.sub("[\x01-\x1f\x7f\"#%'*/:=?\\\\{[\\]^]", lambda m: f"%{ord(m[0]):02X}", name) if name else "__HIVE_DEFAULT_PARTITION__"


#: Texts that need no look at how they are written: one line, nothing at either end, no sign that means something.
EVEN = re.compile(r"\w(?:[\w .+-]{0,98}\w)?", re.ASCII)


def even(node: object) -> bool:
    """Whether a node is of mappings and scalars that both of the library's writers write alike."""
    if type(node) is dict:
        return all(type(k) is str and EVEN.fullmatch(k) and even(v) for k, v in node.items())
    return type(node) in (int, bool, float) or (type(node) is str and bool(EVEN.fullmatch(node)))


def to_yaml(data: object) -> str:
    """By libyaml, in a fraction of the time, what both writers write alike."""
    if hasattr(yaml, "CSafeDumper") and even(data):
        return yaml.dump(data, Dumper=yaml.CSafeDumper, allow_unicode=True, sort_keys=False, width=4096)

    class Indented(yaml.SafeDumper):
        def increase_indent(self, flow=False, indentless=False):
            return super().increase_indent(flow, False)

    return yaml.dump(data, Dumper=Indented, allow_unicode=True, sort_keys=False, width=4096)


def export(documents: DataFrame, path: str, mode: str = "overwrite", only_new: bool = False) -> int | None:
    """Documents as YAML text, one file a book and schema: ``book=…/schema=…/part-…``. See ``export_texts``."""

    return export_texts(documents.select("book", "schema", F.col("state").alias("value")), path, mode, only_new=only_new, text=lambda s: to_yaml(decode(s)))


def export_texts(rows: DataFrame, path: str, mode: str = "overwrite", order: list[str] | None = None, only_new: bool = False, said: Callable[[Column], Column] = lambda value: value, text: Callable[[str], str] | None = None) -> int | None:
    """(book, schema, value) as text files, one a book and schema, a line for each row in an order: ``said`` of its value, and of that ``text``, which
    the tasks that write files call themselves.

    Hadoop's local file system starts a process for each file and folder that it makes, so on a local or mounted file system tasks write
    by plain calls, and how many files there are is returned; elsewhere Spark's writer does it. There are as many tasks as a shuffle has partitions, since it is the
    number of files that takes time, not their bytes. ``overwrite``: all files are written beside and get their place in one step. ``append``: a
    file has its place once it is whole; ``only_new``: where a book and schema have files, none is added."""
    spark = rows.sparkSession
    files = Files(spark, path)
    dealt = spread(rows, "book", "schema").sortWithinPartitions("book", "schema", *(order or ()))
    dealt = dealt.select("book", "schema", said(F.col("value")).alias("value"))
    if not files.local():
        if text is not None:
            dealt = dealt.withColumn("value", F.pandas_udf(lambda values: values.map(text), "string")("value"))
        dealt.write.mode(mode).partitionBy("book", "schema").text(path)
        return None
    root, run = files.plain(), uuid.uuid4().hex
    at = root if mode == "append" else f"{root.rpartition('/')[0]}/_{root.rpartition('/')[2]}-{run}"
    LocalFileSystem().create_dir(at)
    try:
        n = dealt.mapInPandas(TextFiles(at, f"part-{run}.txt", only_new, mode == "append", text), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if mode != "append":
            files.delete("")
            files.moved(at, root)
    except BaseException:
        if mode != "append":
            Files(spark, f"file://{at}").delete("")
        raise
    return n


@dataclass(frozen=True)
class TextFiles:
    """Writes a task's rows, sorted by book and schema; gives the number of files. A task that runs again writes the same files.

    The folder of many files serves one call that names something in it at a time, whatever the number of tasks, so a file takes as few as it
    can: where nobody reads before all files are whole (``beside``: not so), it is made under its own name. What another try of the task has
    made, and may have left half done, is replaced by a whole file in one step, and so is a file that is read beside."""

    root: str
    name: str
    only_new: bool
    beside: bool = True
    text: Callable[[str], str] | None = None

    def __call__(self, pdfs):
        key, out, n = None, None, 0
        try:
            for pdf in pdfs:
                for book, schema, value in zip(pdf["book"], pdf["schema"], pdf["value"], strict=True):
                    if (book, schema) != key:
                        self._close(out)
                        key, out = (book, schema), None
                        folder = self._folder(key)
                        if not self.only_new or self._absent(folder):
                            out = self._open(folder)
                            n += 1
                    if out is not None:
                        out[1].write(f"{'' if value is None else self.text(value) if self.text else value}\n".encode())
            self._close(out)
        except BaseException:
            # A file under its own name stays: another try may have replaced it meanwhile, and if there is none, the folder goes.
            if out is not None:
                out[1].close()
                if out[0] != out[2] and os.path.exists(out[0]):
                    os.remove(out[0])
            raise
        yield pd.DataFrame({"n": [n]})

    def _folder(self, key: tuple[str, str]) -> str:
        return f"{self.root}/book={escaped(key[0])}/schema={escaped(key[1])}"

    def _open(self, folder: str) -> tuple[str, BinaryIO, str]:
        """The file's path while it is written, the file, and its path when it is whole. Folders are made without a look at what is there."""
        for at in (os.path.dirname(folder), folder):
            try:
                os.mkdir(at)
            except FileExistsError:
                pass
        path = f"{folder}/{self.name}"
        if not self.beside:
            try:
                return path, open(path, "xb"), path  # noqa: SIM115
            except FileExistsError:
                pass
        beside = f"{folder}/_{uuid.uuid4().hex}.tmp"
        return beside, open(beside, "xb"), path  # noqa: SIM115

    def _close(self, out: tuple[str, BinaryIO, str] | None) -> None:
        if out is not None:
            out[1].close()
            if out[0] != out[2]:
                os.replace(out[0], out[2])

    def _absent(self, folder: str) -> bool:
        return not os.path.isdir(folder) or all(f == self.name or f[0] in "._" for f in os.listdir(folder))


__all__ = ["Ledger", "encode", "export", "json", "to_yaml"]
