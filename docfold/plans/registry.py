"""Registered queries, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; ``sql`` is what DuckDB runs on the same tables."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_row(df: DataFrame, each: Callable, schema: str) -> DataFrame:
    """Rows that ``each`` makes of one row (a dictionary): tuples in the order of ``schema``. For operators that are plain
    Python inside tasks."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [out for r in pdf.to_dict("records") for out in each(r)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return df.mapInPandas(run, schema)
