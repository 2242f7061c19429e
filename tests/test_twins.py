"""Operators that exist as columns and as Python inside tasks say the same."""

import random

import pytest
from pyspark.sql import functions as F

from docfold import clients, extraction
from docfold.functions import prompts as P
from docfold.functions import text as T
from docfold.operators import batching as B
from docfold.operators import control as C
from docfold.operators import increments as I  # noqa: N812
from docfold.sources.epub import book_id

PIECES = ["```", "```yaml\n", "\n", " ", "\t", "\u00a0", "\u3000", "\x1c", "<title>", "</title>", "<TITLE>", "<p>", "</p>", "<b>", "</b>", "<html", "<!DOCTYPE html>", "Error 522", "error\u00a01020", "Error 5", "a", "B c", "é漢😀", "root_key: actors", "worldinfo:\n", "x" * 130]


def texts(n=300):
    rng = random.Random(11)
    return ["", *("".join(rng.choices(PIECES, k=rng.randint(0, 9))) for _ in range(n))]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts())), "i long, t string")


def got(rows, column):
    return [r.x for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


def test_fences(rows):
    assert got(rows, T.unfenced(F.col("t"))) == [I.unfenced(t) for t in texts()]


def test_error_texts(rows):
    t = F.col("t")
    assert got(rows, T.compact(t)) == [clients.compact(x) for x in texts()]
    assert got(rows, F.when(T.looks_like_html(t), T.html_error(t)).otherwise(T.compact(t))) == [clients.error_text(x) for x in texts()]
    assert clients.error_text("<html>Origin down\nError 522</html>") == "Cloudflare 522"
    assert clients.compact("a\u3000\u00a0b ") == "a b"


def test_echo_and_slugs(rows):
    assert got(rows, C.echo(F.col("t"), "root")) == ["".join(clients.Echo()(t)) for t in texts()]
    names = [t.replace("/", "").replace("\n", "").replace("\x1c", "").replace(".", "") + "z" for t in texts()]
    own = rows.sparkSession.createDataFrame(list(enumerate(names)), "i long, t string")
    assert got(own, T.slug(F.col("t"))) == [book_id(f"/b/{n}.epub")[:-9] for n in names]


def test_prompts(spark):
    rng = random.Random(5)
    books = [(n, [(k + 1, f"c{k}", f"T {rng.choice(PIECES)}", f"text {rng.choice(PIECES)} end") for k in range(rng.randint(1, 4))]) for n in range(40)]
    rows = spark.createDataFrame(books, "i long, chapters array<struct<chapter_index:bigint,chapter_id:string,title:string,text:string>>")
    schema = {"root_key": "actors", "schema_text": "actors: {{match_key}}"}
    template = "{{source_text}}|{{output_rules}}|{{chapter_title}}|{{schema_text}}|{{error_summary}}|{{existing_yaml}}|{{batch_id}}"
    values = {"source_text": P.source_text(F.col("chapters")), "output_rules": P.output_rules(F.lit("actors"), F.lit("name")), "chapter_title": P.titles(F.col("chapters")), "schema_text": F.lit(schema["schema_text"]), "error_summary": P.or_default(F.lit(" "), "none"), "existing_yaml": P.or_default(F.lit(""), "{}"), "batch_id": F.lit("ch0001-ch0002-d0"), "match_key": F.lit("name"), "root_key": F.lit("actors")}
    of = lambda cs: extraction.render(template, extraction.prompt_values([dict(zip(("chapter_index", "chapter_id", "title", "text"), c, strict=True)) for c in cs], "ch0001-ch0002-d0", schema, {}, "", " "))
    assert got(rows, P.rendered(F.lit(template), values)) == [of(cs) for _, cs in books]


def test_halves(spark):
    spans = [(n, a, a + n - 1) for n in range(2, 12) for a in (1, 5)]
    rows = spark.createDataFrame([("b", f"ch{a:04d}-ch{b:04d}-d0", a, b, n) for n, a, b in spans], "book string, batch_id string, start_idx long, end_idx long, chapter_count long")
    want = {(x["parent_batch_id"], x["batch_id"], x["start_idx"], x["end_idx"], x["depth"]) for _, a, b in spans for x in extraction.halves({"batch_id": f"ch{a:04d}-ch{b:04d}-d0", "depth": 0, "chapters": [{"chapter_index": i} for i in range(a, b + 1)]})}
    assert {(r.parent_batch_id, r.batch_id, r.start_idx, r.end_idx, r.depth) for r in B.halves(rows).collect()} == want


def test_stream_deltas(spark):
    import json

    contents = ["a", "", None, 5, ["x", "y"], [{"text": "t"}, "u", 3, {"other": 1}, {"text": 4}], [], {"text": "no"}]
    chunks = [json.dumps({"choices": [{"delta": {"content": c}}]}) for c in contents] + ["{}", '{"choices": []}', '{"choices": [{"delta": {}}]}', "[1]"]
    rows = spark.createDataFrame(list(enumerate(chunks)), "i long, t string")
    assert got(rows, T.delta_text(F.col("t"))) == [clients.delta_of(json.loads(c)) for c in chunks]


def test_blacklists(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    words = ["Error", " ", "é漢", "c", "Error 522", "xxxx"]
    keys = spark.createDataFrame(list(enumerate(words)), "pos long, keyword string")
    want = {i: w for i, t in enumerate(texts()) if (w := next((w for w in words if w.strip() and w in t), None))}
    for size in (1 << 24, 1):  # a block of its own for nearly each word
        assert {r.doc_id: r.keyword for r in C.blacklisted(docs, keys, size).collect()} == want
    assert {r.i: r.x for r in docs.select(F.col("doc_id").alias("i"), T.first_keyword(F.col("text"), words).alias("x")).where("x IS NOT NULL").collect()} == want
    assert C.blacklisted(docs, keys.where("pos < 0")).count() == 0
