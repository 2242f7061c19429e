"""Increments as a stream: keyed state that micro-batches are folded into, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docfold.config import MergeConfig
from docfold.operators.increments import folded
from docfold.session import Files

STATE = "node string, touches long, seq long"


class StateTable:
    """A state (keys, node, touches, seq) in buckets by its keys' hash. A micro-batch writes the buckets that it touches anew, and
    a pointer names each bucket's version; what no kept pointer names is deleted. ``buckets`` stays what it was first."""

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...], kinds: str, buckets: int = 64) -> None:
        self.spark, self.root, self.keys, self.schema, self.files, self.buckets = spark, root.rstrip("/"), keys, f"{kinds}, {STATE}", Files(spark, root), buckets

    def _pointer(self) -> tuple[int, dict]:
        return self.files.latest("version", {"epoch": -1, "buckets": {}, "of": self.buckets})

    def version(self) -> int:
        return self._pointer()[1]["epoch"]

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The state; of some buckets if ``only`` says which."""
        paths = [f"{self.root}/v={v}/bucket={b}" for b, v in self._pointer()[1]["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, epoch: int, config: MergeConfig) -> None:
        """Folds (keys, seq, node) into the state. A micro-batch that is run again finds its version and stops;
        a row that isn't newer than its key's state is of such a run, or late, and changes nothing."""
        seen, p = self._pointer()
        if epoch <= p["epoch"]:
            return
        keys = list(self.keys)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(p["of"])).cast("int").alias("bucket")
        rows = rows.select(*keys, "seq", "node").persist()
        try:
            # At most as many as there are buckets.
            touched_ = [r.bucket for r in rows.select(bucket).distinct().collect()]
            old = self.read(touched_)
            new = rows.join(old.select(*keys, F.col("seq").alias("_seen")), keys, "left").where(F.col("_seen").isNull() | (F.col("seq") > F.col("_seen"))).drop("_seen")
            touched = new.groupBy(*keys).agg(F.max("seq").alias("seq"), F.count("*").alias("n"))
            both = old.select(*keys, F.lit(-(2**63)).alias("seq"), "node").join(touched.select(*keys), keys, "left_semi").unionByName(new)
            node = folded(both, config, self.keys).select(*keys, "node")
            counts = old.select(*keys, "touches").join(touched, keys, "right").select(*keys, (F.coalesce("touches", F.lit(0)) + F.col("n")).alias("touches"), "seq")
            out = node.join(counts, keys).unionByName(old.join(touched, keys, "left_anti").select(*keys, "node", "touches", "seq"))
            out = out.select(*keys, "node", "touches", "seq", bucket).repartition("bucket")
            out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v={epoch}")
        finally:
            rows.unpersist()
        now = {b: v for b, v in p["buckets"].items() if int(b) not in touched_} | {str(b): epoch for b in touched_}
        self.files.publish("version", seen + 1, {"epoch": epoch, "buckets": now, "of": p["of"]}, keep=2)
        named = {v for k in self.files.versions("version") for v in self.files.read(f"version-{k}.json")["buckets"].values()}
        for v in self.files.numbers(".", "v"):
            if v not in named and v < epoch:
                self.files.delete(f"v={v}")


def upsert_stream(rows: DataFrame, state: StateTable, checkpoint: str, config: MergeConfig = MergeConfig(), **trigger) -> StreamingQuery:  # noqa: B008
    """Starts folding a stream of (keys, seq, node) into ``state``."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: state.merge(df, epoch, config))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def last_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Scalar state of a stream inside the engine: the last value by seq (update mode)."""
    return rows.groupBy(*keys).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
