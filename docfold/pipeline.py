"""The whole of a run behind one object, whose parts can be replaced."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfold.clients import Client
from docfold.config import AppConfig
from docfold.extraction import ATTEMPTS, Sink, attempts, with_chapters
from docfold.operators.batching import batches, batches_streamed
from docfold.operators.control import numbered
from docfold.sinks.ledger import Ledger, export

#: Leases for each worker, about: how finely books are shared out, and the books of one at most. Each is a Spark job, which takes seconds
#: whatever it does, so their number doesn't grow with the books unless there are very many; a stream's rounds bound its memory, not its lease.
LEASES, BOOKS = 8, 1 << 14


@dataclass
class Pipeline:
    """Chapters go in, the ledger and the exported documents come out. ``planner``: chapters and settings to batches."""

    ledger: Ledger
    schemas: list[dict]
    templates: list[dict]
    client: Client
    config: AppConfig
    planner: Callable = batches_streamed
    sink: Sink | None = None

    @property
    def workers(self) -> int:
        """Calls to the model at a time, at most."""
        return max(1, self.config.max_workers) if self.config.enable_parallel_tasks else 1

    def prepare(self, chapters: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Batches, and where tasks go on from."""
        plan = self.planner(chapters, self.config.batching)
        going_on = self.config.runtime.resume and self.ledger.pointer()["runs"]
        return plan, self.ledger.resume(self.config.merge) if going_on else None

    def attempts(self, chapters: DataFrame, root: str | None = None, books: DataFrame | None = None) -> DataFrame:
        """All attempts, by leases; what is written on the way is under ``root``. ``books``: a table of the chapters' books, each once, if there is one.

        The plan is written once, with the books dealt to leases: a book a lease in their order or, if there are more than ``LEASES`` for a
        worker, by hash (``BOOKS`` a lease at most, about). A step of the work is a lease with a schema; steps are taken first schema first, so book after book has its turn, by
        as many threads as there are workers: whichever ends its step first takes the next one, and a slow book holds up nothing but
        itself. A step is a Spark job of one task, within which each (book, schema) keeps its order."""
        spark, root = chapters.sparkSession, root or f"{self.ledger.root}/leases/{uuid.uuid4().hex}"
        plan, states = self.prepare(chapters)
        books = chapters.select("book").distinct() if books is None else books.select("book")
        most = max(LEASES * self.workers, -(-(n := books.count()) // BOOKS))
        if n <= most:
            leased = plan.join(numbered(books, ["book"], "lease").select("book", F.pmod("lease", F.lit(most)).cast("int").alias("lease")), "book")
        else:
            leased = plan.withColumn("lease", F.pmod(F.hash("book"), F.lit(most)))
        dealt = with_chapters(leased, chapters, ("lease",))
        dealt.write.partitionBy("lease").parquet(f"{root}/plan")
        if states is not None:
            states.join(books.select("book"), "book", "left_semi").write.parquet(f"{root}/states")
        plan = spark.read.schema(dealt.schema).parquet(f"{root}/plan")
        leases = sorted((r.lease for r in plan.select("lease").distinct().collect()), key=lambda n: n or most)

        @inheritable_thread_target(spark)
        def step(taken: tuple[int, dict, int]) -> str:
            no, schema, lease = taken
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", "steps")
            own = plan.where(F.col("lease") == lease).drop("lease")
            begin = spark.read.parquet(f"{root}/states").join(own.select("book").distinct(), "book", "left_semi") if states is not None else None
            path = f"{root}/attempts/{no}"
            attempts(own, [schema], self.templates, self.client, self.config, begin, 1, True, self.sink).write.parquet(path)
            return path

        steps = [(schema, lease) for schema in self.schemas for lease in leases]
        if not steps:
            return spark.createDataFrame([], ATTEMPTS)
        with ThreadPoolExecutor(self.workers) as pool:
            paths = list(pool.map(step, [(no, *s) for no, s in enumerate(steps)]))
        return spark.read.schema(ATTEMPTS).parquet(*paths)

    def run(self, chapters: DataFrame) -> DataFrame:
        """Commits a run's attempts and exports documents and log; the tasks' progress. The chapters are written once and read back: columns apart, and
        in as many tasks as their bytes ask for, where a cache keeps the partitions of the shuffle that made it. The log needs no state, so it is
        exported beside that."""
        spark, steps = chapters.sparkSession, f"leases/{uuid.uuid4().hex}"
        try:
            chapters.write.parquet(at := f"{self.ledger.root}/{steps}/chapters")
            chapters = spark.read.schema(chapters.schema).parquet(at)
            chapters.groupBy("book").agg(F.max("chapter_index").cast("long").alias("total")).write.parquet(at := f"{self.ledger.root}/{steps}/totals")
            totals = spark.read.schema(f"book {chapters.schema['book'].dataType.simpleString()}, total long").parquet(at)
            self.ledger.commit(self.attempts(chapters, f"{self.ledger.root}/{steps}", totals), self.schemas, totals)
            with ThreadPoolExecutor(1) as pool:
                log = pool.submit(inheritable_thread_target(spark)(self.ledger.export_log), f"{self.ledger.root}/logs")
                self.ledger.snapshot(self.config.merge)
                export(self.ledger.all_documents(totals, self.schemas, self.config.merge), f"{self.ledger.root}/output")
                log.result()
        finally:
            self.ledger.files.delete(steps)
        return self.ledger.progress()


__all__ = ["Pipeline", "batches", "batches_streamed"]
