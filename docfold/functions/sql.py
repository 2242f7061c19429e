"""The engine's functions under names that SQL knows, for a session."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docfold.operators.increments import GONE, PARSED, decode, encode, parsed, sanitized
from docfold.operators.matching import Against
from docfold.operators.similarity import similarity
from docfold.sources.epub import page_text

HEADING = re.compile(r"(?i)(?=<h1[\s>])")


class ChaptersOf:
    """A page's sections, each from a first-level heading to the next; what stands before the first one, if it has paragraphs."""

    def eval(self, html: str) -> Iterator[tuple[int, str, str]]:
        pos = 0
        for i, part in enumerate(HEADING.split(html or "")):
            title, text = page_text(part)
            if i or text:
                yield pos, title, text
                pos += 1


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else Against(y).ratio(x) for x, y in zip(a, b, strict=True)], dtype="float64")


def _value_similarity(a: pd.Series, b: pd.Series, weights: pd.Series) -> pd.Series:
    of = lambda x, y, w: None if x is None or y is None else similarity(decode(x), decode(y), json.loads(w) if w else {})
    return pd.Series([of(*r) for r in zip(a, b, weights, strict=True)], dtype="float64")


def _parse_yaml(texts: pd.Series) -> pd.DataFrame:
    rows = [parsed(t or "") for t in texts]
    return pd.DataFrame({"node": [None if d is None else encode(d) for d, _ in rows], "error": [e or None for _, e in rows]}, dtype=object)


def _sanitize_json(nodes: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else encode({} if (s := sanitized(decode(n))) is GONE else s) for n in nodes], dtype=object)


def register(spark: SparkSession) -> None:
    """``seq_ratio(existing, incoming)``, ``value_similarity(json, json, json of weights or null)``, ``parse_yaml(text)`` (node, error),
    ``sanitize_json(json)``, and the table function ``chapters_of(html)`` (pos, title, text)."""
    spark.udf.register("seq_ratio", F.pandas_udf(_ratio, "double"))
    spark.udf.register("value_similarity", F.pandas_udf(_value_similarity, "double"))
    spark.udf.register("parse_yaml", F.pandas_udf(_parse_yaml, PARSED))
    spark.udf.register("sanitize_json", F.pandas_udf(_sanitize_json, StringType()))
    spark.udtf.register("chapters_of", F.udtf(ChaptersOf, returnType="pos int, title string, text string"))
