"""Keyed state inside the stream's own state store: one value for each (book, schema, entity), folded by arriving increments.

A micro-batch reads and writes the keys that it touches, nothing else; the store keeps versions and commits them with the stream's offsets, so a
batch that is run again finds the state from before it. Each key remembers the place of the last increment that it has
folded: what isn't newer (a replayed source, a late row) changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docfold.config import MergeConfig
from docfold.operators.increments import decode, encode
from docfold.operators.similarity import merged

VALUE = "node string, touches long, seq long"
NAME = "entry"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """Folds a key's increments (seq, node) in the order of seq; gives its new state if there was anything new."""

    def __init__(self, keys: tuple[str, ...], config: MergeConfig) -> None:
        self.keys, self.config = keys, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState(NAME, VALUE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        have = self.value.get() if self.value.exists() else None
        node, touches, last = (decode(have[0]), have[1], have[2]) if have else (None, 0, None)
        # A key's increments of one micro-batch; the source bounds how many these are.
        new = sorted(((int(s), n) for pdf in rows for s, n in zip(pdf["seq"], pdf["node"], strict=True)), key=lambda x: x[0])
        before = touches
        for seq, increment in new:
            if last is not None and seq <= last:
                continue
            node = decode(increment) if touches == 0 else merged(node, decode(increment), self.config)
            touches, last = touches + 1, seq
        if touches > before:
            self.value.update((encode(node), touches, last))
            yield pd.DataFrame([(*key, encode(node), touches, last)], columns=[*self.keys, "node", "touches", "seq"])

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, keys: tuple[str, ...], changes: str, checkpoint: str, config: MergeConfig = MergeConfig(), **trigger) -> StreamingQuery:  # noqa: B008
    """Starts folding a stream of (keys, seq, node). Every micro-batch adds what its keys have become to the table ``changes``, exactly
    once; ``state_of`` reads the state itself from ``checkpoint``. The session's state store must be RocksDB's (``use_rocksdb``)."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    out = rows.select(*keys, "seq", "node").groupBy(*keys).transformWithStateInPandas(Fold(keys, config), f"{kinds}, {VALUE}", "append", "none")
    writer = out.writeStream.format("parquet").outputMode("append").option("path", changes).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def use_rocksdb(spark: SparkSession) -> None:
    """Changes are written as logs between the store's snapshots, so a commit costs what changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(keys, node, touches, seq) of all keys, as of the last committed micro-batch."""
    rows = spark.read.format("statestore").option("stateVarName", NAME).load(checkpoint)
    return rows.select("key.*", "value.*")


def state_at(changes: DataFrame, keys: tuple[str, ...], upto: int | None = None) -> DataFrame:
    """The same from the table of changes, as of a place in the order if one is given: each key's last state not after it."""
    rows = changes if upto is None else changes.where(F.col("seq") <= upto)
    return rows.groupBy(*keys).agg(F.max_by(F.struct("node", "touches", "seq"), "seq").alias("x")).select(*keys, "x.*")
