"""Batches of consecutive chapters under a token budget, clipped to checkpoint windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfold.config import BatchingConfig
from docfold.functions import text as T
from docfold.session import spread

PENDING = "struct<first:bigint,last:bigint,n:bigint,tokens:bigint>"


def fold(items: Column, budget: int, window: int, oversize: bool = True) -> Column:
    """Batches (first, last, n, tokens) of an ordered array of (i, t). A chapter over the budget is a batch of
    its own and closes the pending one; without ``oversize`` it is an error. Batches stay within windows."""
    none = F.lit(None).cast(PENDING)
    one = lambda c: F.struct(c["i"].alias("first"), c["i"].alias("last"), F.lit(1).cast("long").alias("n"), c["t"].alias("tokens"))
    state = lambda done, pending: F.struct(done.alias("done"), pending.cast(PENDING).alias("pending"))

    def step(acc: Column, c: Column) -> Column:
        p, done = acc["pending"], acc["done"]
        closed = F.when(p.isNull(), done).otherwise(F.concat(done, F.array(p)))
        over = c["t"] > budget
        crosses = T.window_index(p["first"], window) != T.window_index(c["i"], window) if window > 0 else F.lit(False)
        grown = F.struct(p["first"].alias("first"), c["i"].alias("last"), (p["n"] + 1).alias("n"), (p["tokens"] + c["t"]).alias("tokens"))
        alone = one(c) if oversize else F.raise_error(F.concat(F.lit("chapter "), c["i"].cast("string"), F.lit(f" exceeds the budget of {budget} tokens")))
        alone = alone if oversize else alone.cast(PENDING)
        return F.when(over, state(F.concat(closed, F.array(alone)), none)).when(p.isNull(), state(done, one(c))).when(crosses | (p["tokens"] + c["t"] > budget), state(closed, one(c))).otherwise(state(done, grown))

    begin = state(F.array().cast(f"array<{PENDING}>"), none)
    return F.aggregate(items, begin, step, lambda acc: F.when(acc["pending"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["pending"]))))


def batches(chapters: DataFrame, config: BatchingConfig = BatchingConfig()) -> DataFrame:  # noqa: B008
    """(book, batch_no, batch_id, start_idx, end_idx, chapter_count, token_estimate), from one shuffle by book.

    A book is one row while it is folded; windows bound the rows: with them, each window is folded apart."""
    t = F.col("token_estimate").cast("long")
    window = config.window
    single = not config.enable_multi_chapter or config.budget <= 0
    if single:
        rows = chapters.select("book", F.col("chapter_index").alias("first"), F.col("chapter_index").alias("last"), F.lit(1).cast("long").alias("n"), t.alias("tokens"))
    else:
        by = ["book", T.window_index(F.col("chapter_index"), window).alias("window")]
        items = chapters.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("chapter_index").cast("long").alias("i"), t.alias("t")))).alias("items"))
        rows = items.select("book", F.explode(fold(F.col("items"), config.budget, 0, config.allow_oversize_single_chapter)).alias("b")).select("book", "b.*")
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy("book").orderBy("first")).cast("long")
    return rows.select(
        "book", no.alias("batch_no"), T.batch_id(F.col("first"), F.col("last"), F.lit(0)).alias("batch_id"),
        F.col("first").alias("start_idx"), F.col("last").alias("end_idx"), F.col("n").alias("chapter_count"), F.col("tokens").alias("token_estimate"),
    )


def batches_streamed(chapters: DataFrame, config: BatchingConfig = BatchingConfig()) -> DataFrame:  # noqa: B008
    """The same as ``batches`` for books of any length: a task streams over its sorted chapters and holds one
    pending batch, where ``batches`` holds a book's (or a window's) lengths in a row."""
    import pandas as pd

    budget, window, oversize = config.budget, config.window, config.allow_oversize_single_chapter
    single = not config.enable_multi_chapter or budget <= 0
    of = lambda i: (i - 1) // window if window else 0

    def run(pdfs):
        book, no, pending = None, 0, None
        for pdf in pdfs:
            done = []

            def close():
                nonlocal no, pending
                if pending is not None:
                    no += 1
                    done.append((book, no, *pending))  # noqa: B023
                    pending = None

            for b, i, t in zip(pdf["book"], pdf["chapter_index"].tolist(), pdf["token_estimate"].tolist(), strict=True):
                if b != book:
                    close()
                    book, no = b, 0
                if t > budget and not single and not oversize:
                    raise ValueError(f"chapter {i} exceeds the budget of {budget} tokens")
                if pending is not None and (single or t > budget or pending[3] + t > budget or of(i) != of(pending[0])):
                    close()
                pending = (i, i, 1, t) if pending is None else (pending[0], i, pending[2] + 1, pending[3] + t)
            if done:
                yield pd.DataFrame(done, columns=["book", "batch_no", "first", "last", "n", "tokens"])
        if pending is not None:
            yield pd.DataFrame([(book, no + 1, *pending)], columns=["book", "batch_no", "first", "last", "n", "tokens"])

    kind = chapters.schema["book"].dataType.simpleString()
    rows = chapters.select("book", F.col("chapter_index").cast("long").alias("chapter_index"), F.col("token_estimate").cast("long").alias("token_estimate"))
    out = spread(rows, "book").sortWithinPartitions("book", "chapter_index").mapInPandas(run, f"book {kind}, batch_no long, first long, last long, n long, tokens long")
    return out.select("book", "batch_no", T.batch_id(F.col("first"), F.col("last"), F.lit(0)).alias("batch_id"), F.col("first").alias("start_idx"), F.col("last").alias("end_idx"), F.col("n").alias("chapter_count"), F.col("tokens").alias("token_estimate"))


def halves(rows: DataFrame) -> DataFrame:
    """Both halves of batches of several chapters: (…, half, depth, parent_batch_id). The first has n // 2."""
    mid = F.col("start_idx") + F.floor(F.col("chapter_count") / 2).cast("long")
    parts = F.array(F.struct(F.lit(0).alias("half"), F.col("start_idx").alias("a"), (mid - 1).alias("b")), F.struct(F.lit(1).alias("half"), mid.alias("a"), F.col("end_idx").alias("b")))
    out = rows.where("chapter_count > 1").withColumn("part", F.explode(parts)).withColumn("depth", F.coalesce("depth", F.lit(0)) + 1 if "depth" in rows.columns else F.lit(1))
    return out.select("book", F.col("batch_id").alias("parent_batch_id"), F.col("part.half").cast("long").alias("half"), F.col("depth").cast("long").alias("depth"), F.col("part.a").alias("start_idx"), F.col("part.b").alias("end_idx"), T.batch_id(F.col("part.a"), F.col("part.b"), F.col("depth")).alias("batch_id"))


def should_split(count: Column, config: BatchingConfig) -> Column:
    return (count > 1) & F.lit(config.enable_multi_chapter and config.split_on_failure and config.split_after_retry_exhausted)


def should_checkpoint(index: Column, saved: Column, total: Column, every: int) -> Column:
    """Whether a checkpoint is due after a batch that ends at ``index``."""
    if every <= 0:
        return F.lit(False)
    return (index > 0) & (index > saved) & ((index >= total) | (index % every == 0))


def completed_prefix(committed: DataFrame) -> DataFrame:
    """(book, last_completed): the end of the longest run of committed batches (book, start_idx, end_idx)
    from chapter 1, whatever the order in which they were committed."""
    from pyspark.sql import Window

    by = Window.partitionBy("book").orderBy("start_idx", "end_idx")
    upto = F.coalesce(F.max("end_idx").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = F.max((F.col("start_idx") > upto + 1).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return committed.withColumn("_gap", gap).groupBy("book").agg(F.coalesce(F.max(F.when(F.col("_gap") == 0, F.col("end_idx"))), F.lit(0)).cast("long").alias("last_completed"))
