"""From raw documents to packed token sequences: the stages of a training corpus.

toxicity -> exact duplicates -> near duplicates -> secrets -> packing. Each stage's result is written and read
again as the next one's input, so a lost executor costs one stage's tasks at most.

All stages but the last keep the columns of their input, whatever else it has; an empty table stays one. A null text is the empty
one: it has the classifier's bias as its score, is a copy of other empty texts, is near to none, has no secrets, and is packed as its end
mark. Rows that repeat a doc_id and text are one row after the exact stage; a null doc_id counts as smaller than any other.

``python corpus_pipeline.py TABLES OUT`` runs it and deletes what was written on the way.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from docfold.llm import exact_dedup, minhash, packing, secrets, toxicity
from docfold.llm.common import release, table, written
from docfold.llm.queries import tokenizer_file


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled ones that aren't held out."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def clean_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the largest doc_id stays."""
    return exact_dedup.without_copies(docs)


def clean_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document of the least doc_id stays."""
    return minhash.without_near_copies(docs)


def clean_of_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are masked, and n_chars is that of the masked text."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place there."""
    return packing.packed(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean_of_toxic),
    ("exact_dedup", clean_of_copies),
    ("near_dedup", clean_of_near_copies),
    ("secrets", clean_of_secrets),
    ("packing", pack),
]

#: A trained classifier and hashed signatures have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def main(sf_dir: str, out: str) -> None:
    """Writes the pipeline's rows as a table; then nothing reads the stages any more."""
    spark = SparkSession.builder.appName("corpus_pipeline").getOrCreate()
    try:
        run(spark, sf_dir).write.mode("errorifexists").parquet(out)
    finally:
        release(spark)


if __name__ == "__main__":
    main(*sys.argv[1:])
