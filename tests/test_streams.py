"""The stream's own state: replays, restarts, late rows, cost in proportion to the keys touched."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from docfold.config import MergeConfig
from docfold.operators.chapters import chapters
from docfold.operators.increments import folded
from docfold.sources import datasource
from docfold.sources.epub import read_epubs
from docfold.streaming.stateful import fold_stream, state_at, state_of, use_rocksdb

KIND = "book string, schema string, entity string, seq long, node string"
KEYS = ("book", "schema", "entity")


def increments(n, start=0):
    return [("b", f"s{i % 2}", f"e{i % 5}", i, json.dumps({"n": i, "tags": [f"tag {i % 3}"], "d": {"x": i % 4}})) for i in range(start, start + n)]


@pytest.fixture()
def put(spark, tmp_path):
    use_rocksdb(spark)
    (tmp_path / "in").mkdir()

    def add(rows):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = fold_stream(stream, KEYS, str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
        return q

    yield add, run
    for k in ("providerClass", "rocksdb.changelogCheckpointing.enabled"):
        spark.conf.unset(f"spark.sql.streaming.stateStore.{k}")


def rows_of(df):
    return {(r.book, r.schema, r.entity): (json.loads(r.node), r.touches, r.seq) for r in df.collect()}


def test_streamed_state_is_the_fold(spark, tmp_path, put):
    add, run = put
    rows = increments(30)
    add(rows[:12])
    run()
    add(rows[12:])
    add(rows[5:20])  # a replay: nothing newer than what is folded
    q = run()  # goes on from the checkpoint
    want = folded(spark.createDataFrame(rows, KIND), MergeConfig(), KEYS)
    want = {(r.book, r.schema, r.entity): (json.loads(r.node), r.touches) for r in want.collect()}
    got = rows_of(state_of(spark, str(tmp_path / "ck")))
    assert {k: v[:2] for k, v in got.items()} == want
    assert got == rows_of(state_at(spark.read.parquet(str(tmp_path / "out")), KEYS))
    last = spark.createDataFrame([r for r in rows if r[3] <= 11], KIND)
    first = {(r.book, r.schema, r.entity): json.loads(r.node) for r in folded(last, MergeConfig(), KEYS).collect()}
    assert {k: v[0] for k, v in rows_of(state_at(spark.read.parquet(str(tmp_path / "out")), KEYS, 11)).items()} == first
    # Of two files, the replayed one changed no key.
    assert sorted(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"])[0] == 0


def test_cost_is_that_of_touched_keys(spark, tmp_path, put):
    add, run = put
    add([("b", "s", f"e{i}", i, json.dumps({"n": i})) for i in range(2000)])
    run()
    add([("b", "s", "e7", 5000, json.dumps({"n": 1})), ("b", "s", "e8", 5001, json.dumps({"n": 2}))])
    q = run()
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress) == 2
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2002 and out.where(F.col("seq") >= 5000).count() == 2
    assert state_of(spark, str(tmp_path / "ck")).count() == 2000


def archive(path, pages, at=None):
    with zipfile.ZipFile(path, "w") as z:
        for i, words in enumerate(pages):
            z.writestr(f"p{i:03d}.html", f"<h1>Page {i}</h1>" + "".join(f"<p>{w}</p>" for w in words))
        z.writestr("notes.txt", "no page")
    if at is not None:
        os.utime(path, (at, at))
    return str(path)


def test_books_as_a_source(spark, tmp_path):
    """The same rows as by Spark's own file access, of one file, a pattern and a folder, small archives together and large ones in parts."""
    datasource.register(spark)
    paths = [archive(tmp_path / f"b{k}.epub", [[f"text {k} {i}", "x" * 50 * k] for i in range(3 + 10 * (k == 2))]) for k in range(5)]
    (tmp_path / "other.txt").write_text("no book")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    load = lambda path, **o: spark.read.format("epub").options(**o).load(str(path))
    want = rows(read_epubs(spark, *paths))
    size = os.path.getsize(paths[0])
    for most in (1 << 20, 2 * size, 300):
        assert rows(chapters(load(tmp_path, maxBytes=most))) == want
    assert load(tmp_path, maxBytes=300).rdd.getNumPartitions() > 20 > 5 > load(tmp_path).rdd.getNumPartitions()
    assert rows(chapters(load(tmp_path / "b[12].epub"))) == [r for r in want if r[0][:3] in ("b1-", "b2-")]
    assert rows(chapters(load(f"file://{paths[3]}"))) == rows(read_epubs(spark, paths[3]))
    listed = load(tmp_path, text="false")
    assert listed.where("text IS NULL").count() == 25 and load(tmp_path / "none*.epub").count() == 0


def test_books_as_a_stream(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in").mkdir()
    archive(tmp_path / "in" / "a.epub", [["one"], ["two"]], 1000)

    def run():
        rows = spark.readStream.format("epub").load(str(tmp_path / "in"))
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.book[:1], r.pos, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a", 0, "one"), ("a", 1, "two")]
    archive(tmp_path / "in" / "c.epub", [["three"]], 2000)
    archive(tmp_path / "in" / "b.epub", [["four"]], 2000)
    assert run() == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "four"), ("c", 0, "three")]
    assert len(run()) == 4


def test_documents_as_a_sink(spark, tmp_path):
    """A version is seen wholly or not at all; a task that fails leaves the one before."""
    datasource.register(spark)
    path = str(tmp_path / "docs")
    put = lambda df: df.write.format("yaml_documents").mode("overwrite").save(path)
    docs = spark.range(300).repartition(4).select(F.concat(F.lit("b/"), F.col("id") % 100).alias("book"), F.concat(F.lit("s"), F.floor(F.col("id") / 100)).alias("schema"), F.format_string('{"r": {"k": %d}}', "id").alias("state"))
    put(docs)
    first = datasource.current(path)
    assert first["documents"] == 300
    files = sorted(str(p.relative_to(tmp_path / "docs" / first["version"])) for p in (tmp_path / "docs" / first["version"]).rglob("*.yaml"))
    assert len(files) == 300 and "b%2F7/s1.yaml" in files and (tmp_path / "docs" / first["version"] / "b%2F7" / "s1.yaml").read_text() == "r:\n  k: 107\n"
    with pytest.raises(Exception, match="broken|JSON|Expecting"):
        put(docs.withColumn("state", F.when(F.col("book") == "b/7", "broken").otherwise(F.col("state"))))
    assert datasource.current(path) == first and sorted(p.name for p in (tmp_path / "docs").iterdir()) == sorted([first["version"], "current.json"])
    put(docs.limit(10))
    assert datasource.current(path)["documents"] == 10 and datasource.current(path)["version"] != first["version"]
