"""The ordered chapter relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfold.functions import text as T


def chapters(rows: DataFrame) -> DataFrame:
    """From (book, pos, title, text, source_path): normalised, without blank ones, numbered from 1 in the
    order of ``pos`` after that; with chapter_id and token_estimate."""
    clean = rows.where(T.has_text(F.coalesce("text", F.lit("")))).withColumn("text", T.normalized(F.coalesce("text", F.lit(""))))
    n = F.row_number().over(Window.partitionBy("book").orderBy("pos"))
    out = clean.withColumn("chapter_index", n).withColumn("title", T.titled(F.coalesce("title", F.lit("")), F.col("chapter_index")))
    return out.select(
        "book", F.col("chapter_index").cast("long").alias("chapter_index"),
        T.chapter_id(F.col("chapter_index"), F.col("source_path"), F.col("title"), F.col("text")).alias("chapter_id"),
        "title", "text", "source_path", T.tokens(F.col("text")).alias("token_estimate"),
    )


def resumed(rows: DataFrame, progress: DataFrame) -> DataFrame:
    """Chapters after each book's last completed one; ``progress`` has (book, last_completed)."""
    done = progress.select("book", "last_completed")
    return rows.join(done, "book", "left").where(F.col("chapter_index") > F.coalesce("last_completed", F.lit(0))).drop("last_completed")
