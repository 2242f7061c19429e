"""Books, extraction, ledger, streaming."""

import json
import types
import zipfile
from functools import reduce

import pytest
from pyspark.sql import functions as F

from docfold import cli
from docfold import config as C
from docfold.clients import ChatStream, Echo, Scripted, client_of, delta_of, error_text
from docfold.extraction import ATTEMPTS, attempts, with_chapters
from docfold.operators.batching import batches, batches_streamed
from docfold.pipeline import Pipeline
from docfold.sinks.ledger import Ledger, to_yaml
from docfold.sources.epub import book_id, page_text, read_epubs
from docfold.streaming.upsert import StateTable, upsert_stream

SCHEMA = {"schema": "characters", "root_key": "actors", "schema_text": "actors: {}", "sample": {"k": "", "tags": []}}
TEMPLATES = [{"name": "base", "content": "base {{batch_id}} {{existing_yaml}}"}, {"name": "retry", "content": "retry {{batch_id}} {{error_summary}}"}]


def book(path, pages, spine=None, container=True):
    with zipfile.ZipFile(path, "w") as z:
        if container:
            z.writestr("META-INF/container.xml", '<c xmlns="x"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></c>')
            items = "".join(f'<item id="i{i}" href="{n}"/>' for i, n in enumerate(pages))
            order = "".join(f'<itemref idref="i{list(pages).index(n)}"/>' for n in (spine or pages))
            z.writestr("OPS/p.opf", f'<package><manifest>{items}<item id="up" href="../up.html"/></manifest><spine>{order}<itemref idref="up"/></spine></package>')
        for n, html in pages.items():
            z.writestr(f"OPS/{n}" if container else n, html)
    return str(path)


def test_page_text():
    assert page_text("<h1>A &amp; B</h1><p>one<p style='opacity:0.4;'>dim</p><p> two <b>x</b></p><p> </p>") == ("A & B", "one\ntwo x")
    assert page_text("<p>x</p>")[0] == "Unnamed Chapter"


def test_references_end_in_a_semicolon():
    """What has none is text, as for the SQL of s1_chapters_in_sql and for libxml2's parser (names): a title may be cut within one."""
    assert page_text("<h1>a&amp;&amp</h1><p>&lt;b&gt &eacute;&#233;&#xe9; &copy2; &ampx; &amp;lt; x & y &#39</p>") == ("a&&amp", "<b&gt ééé &copy2; &ampx; &lt; x & y &#39")


def test_reading_order(spark, tmp_path):
    pages = {"b.xhtml": "<h1>B</h1><p>bb</p>", "a.html": "<h1>A</h1><p>aa</p>", "empty.html": "<h1>E</h1>", "x.txt": "no"}
    one = book(tmp_path / "one.epub", pages, ["a.html", "empty.html", "b.xhtml", "x.txt"])
    two = book(tmp_path / "two.epub", pages, container=False)
    rows = read_epubs(spark, one, two).orderBy("book", "chapter_index").collect()
    assert [(r.book, r.chapter_index, r.title) for r in rows] == [(book_id(one), 1, "A"), (book_id(one), 2, "B"), (book_id(two), 1, "B"), (book_id(two), 2, "A")]
    assert book_id(one).startswith("one-") and book_id("/x/one.epub") != book_id("/y/one.epub") and book_id("file:/x/A b!.epub")[:4] == "a-b-"
    assert rows[0].chapter_id.startswith("ch0001-") and rows[0].source_path == "OPS/a.html"


def chapters(spark, n=4):
    return spark.createDataFrame([("bk", i, f"c{i}", f"T{i}", f"text {i}", "p", 10) for i in range(1, n + 1)], "book string, chapter_index long, chapter_id string, title string, text string, source_path string, token_estimate long")


def config(**runtime):
    return C.AppConfig(runtime=C.RuntimeConfig(retry_count=2, retry_backoff_seconds=0, **runtime), batching=C.BatchingConfig(max_input_tokens=40, prompt_overhead_tokens=0, reserve_output_tokens=0, enable_checkpoint=True, checkpoint_every_n_chapters=2))


def planned(spark, c, n=4):
    ch = chapters(spark, n)
    return with_chapters(batches(ch, c.batching), ch)


def test_batches_respect_windows_and_budget(spark):
    c = C.BatchingConfig(max_input_tokens=70, prompt_overhead_tokens=0, reserve_output_tokens=0)
    ch = lambda ts: spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(ts)], "book string, chapter_index long, token_estimate long")
    spans = lambda df: [(r.start_idx, r.end_idx) for r in df.orderBy("batch_no").collect()]
    assert spans(batches(ch([30, 35, 20, 50]), c)) == [(1, 2), (3, 4)]
    assert spans(batches(ch([90, 10]), c)) == [(1, 1), (2, 2)]
    windows = C.BatchingConfig(max_input_tokens=970, prompt_overhead_tokens=0, reserve_output_tokens=0, enable_checkpoint=True, checkpoint_every_n_chapters=3)
    assert spans(batches(ch([10] * 7), windows)) == [(1, 3), (4, 6), (7, 7)]


def test_extraction_splits_and_resumes_without_loss(spark, tmp_path):
    c = config()
    answers = {"ch0001-ch0002-d0": "[broken", "ch0001-ch0001": "actors:\n  ann: {k: 1, tags: [x]}", "ch0002-ch0002": "```yaml\nactors:\n  ann: {k: 2}\n  bob: {k: 3}\n```", "ch0003-ch0004-d0": RuntimeError("down"), "ch0003-ch0003": RuntimeError("down")}
    ledger = Ledger(spark, str(tmp_path / "w"))
    totals = chapters(spark).groupBy("book").agg(F.max("chapter_index").alias("total"))
    ledger.commit(attempts(planned(spark, c), [SCHEMA], TEMPLATES, Scripted(answers), c), [SCHEMA], totals)
    got = [(r.batch_id, r.retry, r.template, r.status) for r in ledger.attempts().orderBy("at").collect()]
    assert got[:4] == [("ch0001-ch0002-d0", r, t, "unparsed") for r in (0, 1) for t in ("base", "retry")] and got[4][3] == "split"
    assert [g for g in got if g[3] == "merged"] == [("ch0001-ch0001-d1", 0, "base", "merged"), ("ch0002-ch0002-d1", 0, "base", "merged")]
    assert got[-1][0] == "ch0003-ch0003-d1" and got[-1][3] == "failed"
    p = ledger.progress().first()
    assert (p.status, p.last_completed, p.total, p.progress_percent) == ("failed", 2, 4, 50.0)
    again = attempts(planned(spark, c), [SCHEMA], TEMPLATES, Scripted({}, "actors:\n  cat: {k: 9}"), c, ledger.resume())
    ledger.commit(again, [SCHEMA], totals)
    assert ledger.progress().first().status == "completed"
    state = json.loads(ledger.documents().first().state)
    assert state == {"actors": {"ann": {"k": 2, "tags": ["x"]}, "bob": {"k": 3}, "cat": {"k": 9}}}
    assert list(state["actors"]) == ["ann", "bob", "cat"]
    marks = [(r.checkpoint_id, r.is_final) for r in ledger.checkpoints(2).orderBy("pos").collect()]
    assert marks == [("ch0002", False), ("ch0004", True)]
    assert ledger.restore("bk", "characters", 2, "ch0002") == "ch0002"
    assert "cat" not in ledger.yaml_of("bk", "characters") and ledger.completed().first().last_completed == 2


def test_strict_validation_and_blacklist(spark):
    c = C.AppConfig(**{**config(validation="strict").__dict__, "blacklist_keywords": (" ", "sorry")})
    for answer, status in (("actors:\n  a: {nose: 1}", "invalid"), ("other: {}\nactors:\n  a: {k: 1}", "merged"), ("x: {y: 1}", "invalid"), ("I am sorry", "blacklisted"), ("", "unparsed")):
        row = attempts(planned(spark, c, 1), [SCHEMA], TEMPLATES[:1], Scripted({}, answer), c).orderBy("seq").first()
        assert row.status == status, answer


def test_echo_changes_nothing(spark, tmp_path):
    c = config()
    ledger = Ledger(spark, str(tmp_path / "w"))
    ledger.commit(attempts(planned(spark, c), [SCHEMA], TEMPLATES, Echo(), c), [SCHEMA])
    assert {r.status for r in ledger.attempts().collect()} == {"merged"} and ledger.state().count() == 0
    assert ledger.yaml_of("bk", "characters") == "actors: {}\n"


def test_answers_that_break_off_are_kept(spark, tmp_path):
    """Two chunks of three come, for batches that begin at chapter 1."""

    class Stops:
        def __call__(self, prompt):
            yield "actors:\n"
            yield "  ann: {k: 1}\n"
            if "ch0001" in prompt:
                raise RuntimeError("closed")

    c = config()
    heard = tmp_path / "heard"

    def sink(book, schema, batch, chunk, path=str(heard)):
        with open(path, "a", encoding="utf-8") as f:
            f.write(chunk)

    rows = attempts(planned(spark, c), [SCHEMA], TEMPLATES[:1], Stops(), c, sink=sink).orderBy("seq").collect()
    first = rows[0]
    assert (first.status, first.response, first.chunks) == ("interrupted", "actors:\n  ann: {k: 1}\n", 2) and first.error == "stream failed: closed" and first.stamp
    assert heard.read_text(encoding="utf-8").startswith("actors:\n  ann: {k: 1}\n")


def test_streams_are_bounded_and_fair(spark):
    c = config()
    ch = chapters(spark, 6)
    ch = ch.unionByName(ch.withColumn("book", F.lit("bk2")))
    plan = with_chapters(batches(ch, c.batching), ch)
    schemas = [SCHEMA, SCHEMA | {"schema": "world"}]
    out = attempts(plan, schemas, TEMPLATES, Echo(), c, workers=1, fair=True)
    assert out.rdd.getNumPartitions() == 1
    order = [(r.start_idx, r.book, r.schema) for r in out.collect()]
    assert order == sorted(order) and len(order) == 12  # each task's first batch, then each one's second
    assert attempts(plan, schemas, TEMPLATES, Echo(), c, workers=3).rdd.getNumPartitions() == 3


def answered(spark, c, n=4, answer="actors:\n  cat: {k: 9}"):
    return attempts(planned(spark, c, n), [SCHEMA], TEMPLATES, Scripted({}, answer), c)


@pytest.mark.parametrize("step", ["write", "create", "rename", "prune"])
def test_a_crash_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, step):
    from docfold import session

    c = config()
    ledger = Ledger(spark, str(tmp_path / "w"))
    for _ in range(3):
        ledger.commit(answered(spark, c), [SCHEMA])
    before = ledger.attempts().count()

    class Crash(Exception):
        pass

    def crash(*_, **__):
        raise Crash

    real = session.Files.publish
    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(session.Files, "publish", crash)
        elif step == "create":
            m.setattr(session, "json", types.SimpleNamespace(dumps=crash, loads=json.loads))
        elif step == "rename":
            m.setattr(session.Files, "publish", lambda self, name, version, value, keep=8: (self._at(f"_{name}-{version}-x.tmp")[1].create(self._at(f"_{name}-{version}-x.tmp")[0], True).close(), crash()))
        else:
            m.setattr(session.Files, "publish", lambda self, name, version, value, keep=8: (real(self, name, version, value, keep), crash()))
        with pytest.raises(Crash):
            ledger.commit(answered(spark, c), [SCHEMA])
    again = Ledger(spark, str(tmp_path / "w"))
    seen = again.attempts().count()
    assert seen == before + (before // 3 if step == "prune" else 0)
    again.commit(answered(spark, c), [SCHEMA])
    assert again.attempts().count() == seen + before // 3 and again.pointer()["runs"] == sorted(set(again.pointer()["runs"]))
    again.vacuum()
    assert again.attempts().count() == seen + before // 3


def test_two_writers(spark, tmp_path):
    from docfold.session import ConcurrentWrite

    c = config()
    one, two = Ledger(spark, str(tmp_path / "w")), Ledger(spark, str(tmp_path / "w"))
    one.commit(answered(spark, c), [SCHEMA])
    seen, p = one.files.latest("ledger")
    two.commit(answered(spark, c), [SCHEMA])
    with pytest.raises(ConcurrentWrite):
        one._publish(seen, p)
    assert two.pointer()["runs"] == [1, 2] == one.pointer()["runs"]


def test_snapshots_say_the_same(spark, tmp_path):
    c = config()
    plain, kept = Ledger(spark, str(tmp_path / "a")), Ledger(spark, str(tmp_path / "b"))
    for k in range(3):
        rows = answered(spark, c, answer=f"actors:\n  cat: {{k: {k}, tags: [t{k}]}}\n  dog{k}: {{k: 1}}")
        plain.commit(rows, [SCHEMA])
        kept.commit(rows, [SCHEMA], None, c.merge if k < 2 else None)
    state = lambda x: sorted(tuple(r) for r in x.state(c.merge).collect())
    assert kept.pointer()["snapshot"] and state(plain) == state(kept)
    totals = chapters(spark).groupBy("book").agg(F.max("chapter_index").alias("total"))
    for x in (plain, kept):
        x.commit(answered(spark, c), [SCHEMA], totals, c.merge)
        x.restore("bk", "characters", 2, "ch0002")
    assert state(plain) == state(kept)  # a restore makes the snapshot useless


def test_restoring_needs_all_its_files(spark, tmp_path):
    import shutil

    c = config()
    ledger = Ledger(spark, str(tmp_path / "w"))
    totals = chapters(spark).groupBy("book").agg(F.max("chapter_index").alias("total"))
    ledger.commit(answered(spark, c), [SCHEMA], totals)
    ledger.commit(answered(spark, c), [SCHEMA], totals)
    shutil.rmtree(tmp_path / "w" / "attempts" / "run=1")
    shutil.rmtree(tmp_path / "w" / "totals" / "run=2")
    with pytest.raises(FileNotFoundError, match="attempts/run=1, .*totals/run=2"):
        ledger.restore("bk", "characters", 2, latest=True)


def given(spark, run, rows):
    """Merged attempts: (book, chapter, {entity: mapping})."""
    ddl = ATTEMPTS
    base = {"schema": "characters", "parent_batch_id": "", "depth": 0, "retry": 0, "template": "t", "prompt": "", "response": "", "chunks": 1, "status": "merged", "error": "", "replaced": 0, "appended": 1, "stamp": "", "errors": 0}
    out = [base | {"book": b, "batch_id": f"ch{c:04d}-ch{c:04d}-d0", "start_idx": c, "end_idx": c, "increment": json.dumps({"actors": e}), "seq": i + 1} for i, (b, c, e) in enumerate(rows)]
    return spark.createDataFrame([tuple(r[x.split()[0]] for x in ddl.split(", ")) for r in out], ddl)


def test_snapshots_are_levels(spark, tmp_path):
    """A commit writes what it touches, levels stay few, and a restored task goes on from the nearest level before its place."""
    kept, plain = Ledger(spark, str(tmp_path / "k")), Ledger(spark, str(tmp_path / "p"))
    state = lambda x: sorted((r.book, r.entity, r.ordinal, r.node, r.touches) for r in x.state().collect())
    written = []
    for run in range(1, 8):
        rows = [("a", c, {f"e{c}": {"n": c}}) for c in range(1, 41)] if run == 1 else [("b" if run % 2 else "a", 40 + run, {f"e{run}": {"n": 100 * run}, "new": {"run": run}})]
        for ledger in (kept, plain):
            ledger.commit(given(spark, run, rows), [SCHEMA], spark.createDataFrame([("a", 60), ("b", 60)], "book string, total long"), C.MergeConfig() if ledger is kept else None)
        levels = kept.pointer()["snapshot"]["levels"]
        written.append([x["rows"] for x in levels])
        assert state(kept) == state(plain)
    assert written[0] == [40] and written[1] == [40, 2] and all(len(x) <= 4 for x in written)
    for ledger in (kept, plain):
        ledger.restore("a", "characters", 1, "ch0044")
    view = kept._view(kept.pointer(), C.MergeConfig())
    assert view.restored and state(kept) == state(plain)
    for ledger in (kept, plain):
        ledger.commit(given(spark, 8, [("a", 45, {"e1": {"n": -1}})]), [SCHEMA], snapshot=C.MergeConfig() if ledger is kept else None)
    assert len(kept.pointer()["snapshot"]["levels"]) == 1 and state(kept) == state(plain)
    upto = plain.checkpoints(1).where("checkpoint_id = 'ch0042' AND book = 'a'").first()
    at = lambda x: [r.state for r in x.documents(upto={"book": "a", "schema": "characters", "at": upto["at"]}).collect()]
    assert at(kept) == at(plain) and at(plain)


def test_a_slow_book_holds_up_only_itself(spark, tmp_path):
    """Two workers: while one is busy with the slow book, the other does all the others; the order within a task stays."""
    import time

    class Slow:
        def __call__(self, prompt):
            if "SLOW" in prompt:
                time.sleep(9)
            yield "actors: {}"

    c = C.AppConfig(max_workers=2, runtime=C.RuntimeConfig(retry_count=1, retry_backoff_seconds=0), batching=C.BatchingConfig(enable_multi_chapter=False))
    rows = [(f"b{i}", k, f"i{k}", "t", "SLOW" if i == 0 else "x", 1) for i in range(6) for k in ((1,) if i == 0 else (1, 2))]
    ch = spark.createDataFrame(rows, "book string, chapter_index long, chapter_id string, title string, text string, token_estimate long")
    out = Pipeline(Ledger(spark, str(tmp_path / "w")), [SCHEMA], [{"name": "t", "content": "{{source_text}}"}], Slow(), c).attempts(ch).collect()
    slow = next(r.stamp for r in out if r.book == "b0")
    assert len(out) == 11 and all(r.stamp <= slow for r in out)
    assert all([r.seq for r in sorted(out, key=lambda r: r.start_idx) if r.book == b] == [1, 2] for b in ("b1", "b5"))


def test_log_and_transitions(spark, tmp_path):
    from docfold.operators.control import progress_of

    c = config()
    ledger = Ledger(spark, str(tmp_path / "w"))
    totals = chapters(spark).groupBy("book").agg(F.max("chapter_index").alias("total"))
    ledger.commit(attempts(planned(spark, c), [SCHEMA], TEMPLATES, Scripted({"ch0003-ch0004-d0": "[", "ch0003-ch0003": RuntimeError("down")}, "actors:\n  a: {k: 1}"), c), [SCHEMA], totals)
    p = progress_of(ledger.transitions(2)).first()
    assert (p.status, p.last_completed, p.last_saved_id, p.receive_status, p.last_split_reason[:7]) == ("failed", 2, "ch0002", "interrupted", "$: inva")
    ledger.restore("bk", "characters", 2, latest=True)
    p = progress_of(ledger.transitions(2)).first()
    assert (p.last_restored_id, p.last_completed) == ("ch0002", 2)
    events = [r.event for r in ledger.transitions(2).orderBy("at", "step").collect()]
    assert events == ["running", "stream", "validation", "merge", "batch_completed", "checkpoint_saved", "checkpoint_restored"]
    lines = [r.line for r in ledger.log().orderBy("at").collect()]
    assert "[bk][characters] batch=ch0001-ch0002-d0 template=base retry=0 status=merged" in lines[0] and lines[-1].endswith("restored checkpoint ch0002")
    ledger.export_log(str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == len(lines)


def test_pipeline_object(spark, tmp_path):
    from docfold.pipeline import Pipeline

    c = config()
    run = Pipeline(Ledger(spark, str(tmp_path / "w")), [SCHEMA], TEMPLATES, Scripted({}, "actors:\n  a: {k: 1}"), c)
    assert run.workers == 4 and Pipeline(run.ledger, [], [], Echo(), C.AppConfig(enable_parallel_tasks=False)).workers == 1
    assert [r.status for r in run.run(chapters(spark)).collect()] == ["completed"]
    assert run.attempts(chapters(spark)).count() == 0  # it goes on from the end
    assert (tmp_path / "w" / "output" / "book=bk" / "schema=characters").is_dir()


def test_chat_service(tmp_path):
    """The client against a server that streams."""
    import http.server
    import threading

    from docfold.clients import ChatStream

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = body["messages"][0]["content"]
            self.send_response(200 if "ok" in text else 522)
            self.end_headers()
            if "ok" not in text:
                self.wfile.write(b"<html><title>Down</title>Error 522<p>later</p></html>")
                return
            for part in ("ac", "", "tors: {}"):
                self.wfile.write(b": ping\n\ndata: " + json.dumps({"choices": [{"delta": {"content": part}}]}).encode() + b"\n\n")
            self.wfile.write(b"data: " + (b"{bad" if "bad" in text else b"[DONE]") + b"\n\ndata: {}\n\n")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = ChatStream(f"http://127.0.0.1:{server.server_port}/", "m", "key")
    assert list(client("ok")) == ["ac", "tors: {}"]
    with pytest.raises(RuntimeError, match="HTTP 522: Down . Cloudflare 522 . later"):
        list(client("no"))
    with pytest.raises(RuntimeError, match="no JSON"):
        list(client("ok bad"))
    server.shutdown()


def test_client_helpers():
    assert delta_of({"choices": [{"delta": {"content": [{"text": "a"}, "b", 3]}}]}) == "ab" and delta_of({"choices": []}) == ""
    assert error_text("<html><title>Bad</title>cloudflare error 502<p>no <b>way</b></p>") == "Bad | Cloudflare 502 | no way"
    assert len(error_text("x " * 400)) == 240
    assert to_yaml({"a": {"b": [1, "é"]}}) == "a:\n  b:\n    - 1\n    - é\n"


def test_stream_folds_once(spark, tmp_path):
    kinds = "entity long"
    rows = [(i % 3, i, json.dumps({"n": i, "tags": [f"t{i}"]})) for i in range(12)]
    src = tmp_path / "in"
    spark.createDataFrame(rows[:6], "entity long, seq long, node string").coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema("entity long, seq long, node string").parquet(str(src))
    state = StateTable(spark, str(tmp_path / "state"), ("entity",), kinds)
    upsert_stream(stream(), state, str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame(rows[6:], "entity long, seq long, node string").coalesce(1).write.mode("append").parquet(str(src))
    upsert_stream(stream(), state, str(tmp_path / "ck")).awaitTermination()
    state.merge(spark.createDataFrame(rows, "entity long, seq long, node string"), 99, C.MergeConfig())  # late rows
    got = {r.entity: (json.loads(r.node)["n"], r.touches) for r in state.read().collect()}
    assert got == {0: (9, 4), 1: (10, 4), 2: (11, 4)}


def test_error_counts_are_those_of_the_issues(spark, tmp_path):
    """One issue whose key holds a separator counts once, two count twice."""
    c = C.AppConfig(runtime=C.RuntimeConfig(retry_count=1, retry_backoff_seconds=0, validation="strict"), batching=C.BatchingConfig(max_input_tokens=4510))
    for n, answer in ((1, 'actors:\n  a:\n    "a; b": 1\n'), (2, "actors:\n  a:\n    p: 1\n    q: 2\n")):
        ledger = Ledger(spark, str(tmp_path / str(n)))
        rows = spark.createDataFrame([("b", 1, "i", "t", "x")], "book string, chapter_index long, chapter_id string, title string, text string")
        plan = with_chapters(batches_streamed(rows.withColumn("token_estimate", F.lit(1).cast("long")), c.batching), rows)
        ledger.commit(attempts(plan, [SCHEMA | {"sample": {"name": ""}}], [{"name": "t", "content": "x"}], Scripted(default=answer), c), [SCHEMA])
        assert ledger.transitions().where("event = 'validation'").first().n == n


def test_clients_by_key():
    """The service needs a key; what has none is the echo, and a service without one says so instead of asking."""
    assert isinstance(client_of({"base_url": "http://x/v1", "name": "m"}), Echo) and isinstance(client_of({}), Echo)
    assert client_of({"api_key": "k", "name": "m"}) == ChatStream("https://api.openai.com/v1", "m", "k")
    assert isinstance(client_of({"api_key": "k", "provider": "echo"}), Echo)
    with pytest.raises(RuntimeError, match="key"):
        list(ChatStream("http://127.0.0.1:9", "m")("hello"))


def test_settings_keep_what_is_unknown(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("mine: {a: 1}\nmodel: {name: m, temperature: 0.1}\nbatching: {max_input_tokens: 9000, other: x}\n", encoding="utf-8")
    C.save(C.load(path), path)
    (tmp_path / "b.epub").write_bytes(b"x")
    assert cli.add(path, tmp_path / "b.epub") == 0
    raw = C.yaml.safe_load(path.read_text(encoding="utf-8"))
    assert raw["mine"] == {"a": 1} and raw["model"] == {"name": "m", "temperature": 0.1} and raw["batching"]["other"] == "x" and raw["batching"]["max_input_tokens"] == 9000
    assert raw["input_epubs"] == ["input/b.epub"] and C.load(path).batching.max_input_tokens == 9000


def test_a_taken_name_is_not_replaced(spark, tmp_path):
    """Also where another writer's file appears after the check."""
    from docfold.session import ConcurrentWrite, Files

    files = Files(spark, str(tmp_path))
    files.publish("p", 1, {"by": "one"})
    with pytest.raises(ConcurrentWrite):
        files.publish("p", 1, {"by": "two"})
    assert files.latest("p") == (1, {"by": "one"}) and not [f for f in tmp_path.iterdir() if f.name.endswith(".tmp")]


def test_command_line(spark, tmp_path):
    cfg = tmp_path / "config.yaml"
    assert cli.main(["--config", str(cfg), "init"]) == 0 and cli.main(["--config", str(cfg), "init"]) == 1
    b = book(tmp_path / "tale.epub", {"a.html": "<h1>A</h1><p>aa</p>"})
    from pathlib import Path

    assert cli.add(cfg, Path(b)) == 0 and cli.add(cfg, Path(b)) == 0
    assert C.load(cfg).input_epubs == ("input/tale.epub",)
    assert cli.run(cfg) == 0
    p = Ledger(spark, str(tmp_path / "workspace")).progress().collect()
    with pytest.raises(ValueError, match="no checkpoint"):
        cli.restore(cfg, "input/tale.epub", "schemas/world.yaml", "ch0009", False)
    assert cli.restore(cfg, "input/tale.epub", "schemas/world.yaml", None, True) == 0
    assert {(x.schema, x.status) for x in p} == {("characters", "completed"), ("world", "completed")}


def test_exports_are_files_that_tasks_write(spark, tmp_path, monkeypatch):
    """No Hadoop writer, which starts processes for each local file; names that paths can't hold; as many tasks as a shuffle has partitions; what is
    there stays, and what an export replaces goes as a whole."""
    from pyspark.sql import DataFrameWriter

    from docfold.plans.run_queries import exported
    from docfold.sinks.ledger import export

    def refused(*_, **__):
        raise AssertionError("files written by Hadoop")

    monkeypatch.setattr(DataFrameWriter, "text", refused)
    out, names = str(tmp_path / "deep" / "out"), ["a/b", "c:%d", "é x", *map(str, range(40))]
    docs = spark.createDataFrame([(n, "s", json.dumps({"r": {"k": i}})) for i, n in enumerate(names)], "book string, schema string, state string")
    export(docs, out)
    assert sorted(tuple(r) for r in exported(spark, out).collect()) == sorted((n, "s", f"r:\n  k: {i}") for i, n in enumerate(names))
    assert spark.read.text(out).where("book = 'c:%d'").count() == 3  # the names are Spark's
    new = Ledger(spark, str(tmp_path / "w")).initialise([SCHEMA | {"schema": "s"}], ["a/b", "new"], out)
    assert new == 1 and {r.book: r.yaml for r in exported(spark, out).collect()}["a/b"] == "r:\n  k: 0"
    export(docs.where("book = '7'"), out)
    assert [r.book for r in exported(spark, out).collect()] == ["7"] and [f.name for f in (tmp_path / "deep").iterdir()] == ["out"]


def test_a_fair_stream_holds_a_round(spark, monkeypatch):
    """As many tasks at most, each with the same attempts; and answers leave in pieces, though all rows come at once."""
    from docfold import extraction

    c = config()
    ch = chapters(spark, 6)
    ch = reduce(lambda a, b: a.unionByName(b), [ch.withColumn("book", F.lit(f"b{i}")) for i in range(9)])
    plan = with_chapters(batches(ch, c.batching), ch)
    monkeypatch.setattr(extraction, "TASKS", 6)  # rows of three a task
    monkeypatch.setattr(extraction, "CHARACTERS", 1)
    out = attempts(plan, [SCHEMA], TEMPLATES, Echo(), c, workers=1, fair=True)
    rows = [(r.book, r.start_idx, r.seq) for r in out.collect()]
    rounds = [("b0", "b1"), ("b2", "b3"), ("b4", "b5"), ("b6", "b7"), ("b8",)]
    assert rows == [(b, 2 * k + 1, k + 1) for books in rounds for k in range(3) for b in books]


def test_settings_look_at_defaults_once(monkeypatch):
    made = []
    real = C.BatchingConfig.__init__
    monkeypatch.setattr(C.BatchingConfig, "__init__", lambda self, *a, **k: (made.append(1), real(self, *a, **k))[1])
    C.from_mapping({"batching": {"max_input_tokens": "7"}})
    made.clear()
    c = C.from_mapping({"batching": {"max_input_tokens": "9", "enable_checkpoint": 1, "other": 2}})
    assert made == [1] and (c.batching.max_input_tokens, c.batching.enable_checkpoint) == (9, True)
    again = C.to_mapping(c)
    again["merge"]["field_weights"]["x"] = 1.0
    assert c.merge.field_weights == {} and again["batching"]["other"] == 2


def test_exports_are_spread_over_tasks(spark, tmp_path):
    """Documents that are dealt by book and schema already, and small in bytes, aren't one task's."""
    from docfold.sinks.ledger import export_texts

    rows = spark.range(200).selectExpr("cast(id % 40 AS string) AS book", "concat('s', id % 2) AS schema", "cast(id AS string) AS v").groupBy("book", "schema").agg(F.max("v").alias("value"))
    n = export_texts(rows, str(tmp_path / "out"), said=lambda v: F.spark_partition_id().cast("string"))
    assert n == 40 and spark.read.text(str(tmp_path / "out")).select("value").distinct().count() == 4


def test_leases_do_not_grow_with_books(spark, tmp_path, monkeypatch):
    """A lease is a Spark job: as many as the workers need, each of one stage. Rounds bound what a stream holds."""
    from docfold import pipeline
    from docfold.operators.control import numbered

    monkeypatch.setattr(pipeline, "LEASES", 1)
    c = C.AppConfig(max_workers=2, runtime=C.RuntimeConfig(retry_count=1, retry_backoff_seconds=0))
    ch = spark.range(600).selectExpr("cast(id AS string) AS book", "1L AS chapter_index", "'i' AS chapter_id", "'t' AS title", "'x' AS text", "1L AS token_estimate")
    ranked = []
    monkeypatch.setattr(pipeline, "numbered", lambda *a: (ranked.append(1), numbered(*a))[1])
    out = Pipeline(Ledger(spark, str(tmp_path / "w")), [SCHEMA], TEMPLATES[:1], Echo(), c).attempts(ch, str(tmp_path / "steps"))
    assert not ranked  # by one task: for few books only
    assert out.select("book").distinct().count() == out.count() == 600
    assert len([f for f in (tmp_path / "steps" / "attempts").iterdir() if f.is_dir()]) == 2
    plan = spark.read.parquet(str(tmp_path / "steps" / "plan")).drop("lease")
    one = attempts(plan, [SCHEMA], TEMPLATES[:1], Echo(), c, workers=1, fair=True)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString() and one.count() == 600


def test_plain_mappings_are_parsed_alike(monkeypatch):
    """By libyaml where both loaders read a text alike; all else, and what is refused, as before."""
    from docfold.operators import increments as I

    yaml = I.yaml
    texts = ["actors:\n  e1:\n    last: ch0001-ch0002-d0\n    n: 2", "a: 1_000\nb: 2020-01-01\nc: 1e5\nd: no\ne:\nf: x  y ", "é: 中文\n", "a:\n  b: 1\n c: 2\n", "a: 1\n  b: 2\n", "[bro", "a:\tb", "a: - b", "a: b: c", "- a", "a: 'q'", "a: &x 1\nb: *x", "k: >\n  x\n"]

    def read(f, t):
        try:
            return f(t)
        except yaml.YAMLError as e:
            return str(e)

    assert [read(I.loaded, t) for t in texts] == [read(yaml.safe_load, t) for t in texts]
    monkeypatch.setattr(yaml, "safe_load", lambda t: "slow")
    assert I.parsed(texts[0]) == ({"actors": {"e1": {"last": "ch0001-ch0002-d0", "n": 2}}}, "") and I.loaded("a: 'q'") == "slow"


def test_spread_rows_have_a_few_tasks_a_core(spark, monkeypatch):
    """A shuffle of very many partitions isn't one of very many tasks, each with its start and its files."""
    from docfold.session import spread

    monkeypatch.setattr(spark, "conf", types.SimpleNamespace(get=lambda *_: "200"))
    out = spread(spark.range(2000), "id")
    assert out.rdd.getNumPartitions() == 16 and out.distinct().count() == 2000


def test_a_run_reads_its_chapters_from_a_table(spark, tmp_path):
    """Not from a cache, which keeps the partitions of the shuffle that made it. They are made once and gone after the run."""
    made, plans = spark.sparkContext.accumulator(0), []

    def count(rows):
        for pdf in rows:
            made.add(len(pdf))
            yield pdf

    def planner(ch, config):
        plans.append((ch.rdd.getNumPartitions(), spark.sparkContext._jsc.getPersistentRDDs().size()))
        return batches(ch, config)

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    ch = chapters(spark, 60).repartition(60, "chapter_index").mapInPandas(count, chapters(spark).schema)
    ledger = Ledger(spark, str(tmp_path / "w"))
    done = Pipeline(ledger, [SCHEMA], TEMPLATES[:1], Echo(), C.AppConfig(runtime=C.RuntimeConfig(retry_count=1, retry_backoff_seconds=0)), planner).run(ch)
    assert done.count() == 1 and made.value == 60
    assert plans[0][0] < 60 and plans[0][1] == before and not list((tmp_path / "w" / "leases").iterdir())


def test_texts_of_a_plan_are_dealt_to_leases_once(spark):
    """By lease before they are put together, which needs no shuffle of its own then."""
    ch = chapters(spark, 9).withColumn("book", F.concat("book", F.col("chapter_index") % 2)).withColumn("chapter_index", F.ceil(F.col("chapter_index") / 2).cast("long"))
    b = batches(ch, config().batching)
    out = with_chapters(b.withColumn("lease", F.hash("book")), ch, ("lease",))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [lease") < plan.index("RepartitionByExpression [lease")
    physical = out._jdf.queryExecution().sparkPlan().toString()
    assert physical.index("ObjectHashAggregate") < physical.index("REPARTITION_BY_COL")
    above = out._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_COL")[0].splitlines()
    assert sum("Exchange" in line for line in above) == 1
    key = lambda df: sorted(str(r) for r in df.drop("lease").collect())
    assert key(out) == key(with_chapters(b, ch)) and out.count() > 2


def test_even_documents_are_written_alike(monkeypatch):
    """By libyaml where both writers write a document alike; all else as before."""
    from docfold.sinks import ledger as L

    texts = ["ch0001-ch0002-d0", "x", "no", "y", "null", "1_000", "1e5", "0x1F", "2020-01-01", "12", "1.5", "a b  c", "a.", "+1", "t" * 100, "t" * 101, "é", "a:", "- a", "", " a", "a ", "a\nb", "'", "#"]
    docs = [{}, {"a": {}}, {"a": {"b": [1]}}, {"a": None}, {1: 2}, {"a": {"b": {"c": 1, "d": True, "e": -1.5, "f": 1e300}, "g": "x"}}, {"a" * 200: 1}]
    docs += [{t: {"k": t, "n": 2}} for t in texts] + [{"actors": {t: {"last": t} for t in texts}}]
    fast = [to_yaml(d) for d in docs]
    even = [L.even(d) for d in docs]
    assert sum(even) > 15 and not any(even[k] for k in (2, 3, 4, 6, -1))
    monkeypatch.setattr(L, "even", lambda d: False)
    assert fast == [to_yaml(d) for d in docs]
    monkeypatch.undo()
    monkeypatch.setattr(L.yaml, "SafeDumper", None)
    assert to_yaml({"actors": {"e1": {"last": "ch0001-ch0002-d0", "n": 2}}}) == "actors:\n  e1:\n    last: ch0001-ch0002-d0\n    n: 2\n"


def test_an_exported_file_takes_few_calls(tmp_path, monkeypatch):
    """Where nobody reads before all are whole, a file is made under its own name; what another try has left there is replaced by a whole one."""
    import pandas as pd

    from docfold.sinks import ledger as L

    moves, replace = [], L.os.replace
    monkeypatch.setattr(L.os, "replace", lambda *a: (moves.append(a), replace(*a))[1])
    rows = [pd.DataFrame({"book": ["a", "a", "b/c"], "schema": ["s", "s", "s"], "value": ["1", "2", None]})]
    files = lambda: {str(f.relative_to(tmp_path)): f.read_text() for f in tmp_path.rglob("*") if f.is_file()}
    want = {"book=a/schema=s/part-1.txt": "<1>\n<2>\n", "book=b%2Fc/schema=s/part-1.txt": "\n"}
    run = lambda **more: list(L.TextFiles(str(tmp_path), "part-1.txt", False, text=lambda v: f"<{v}>", **more)(rows))[0]["n"].tolist()
    assert run(beside=False) == [2] and not moves and files() == want
    (tmp_path / "book=a" / "schema=s" / "part-1.txt").write_text("<1>")
    assert run(beside=False) == [2] and len(moves) == 2 and files() == want
    moves.clear()
    assert run() == [2] and len(moves) == 2 and files() == want

    def broken():
        yield rows[0].assign(book="d")
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        list(L.TextFiles(str(tmp_path), "part-1.txt", False)(broken()))
    assert files() == want


def test_a_log_is_exported_beside_the_state(spark, tmp_path, monkeypatch):
    import threading

    begun, real = threading.Event(), Ledger.export_log
    monkeypatch.setattr(Ledger, "export_log", lambda self, path: (begun.set(), real(self, path))[1])
    snapshot, waited = Ledger.snapshot, []
    monkeypatch.setattr(Ledger, "snapshot", lambda self, *a: (waited.append(begun.wait(20)), snapshot(self, *a))[1])
    ledger = Ledger(spark, str(tmp_path / "w"))
    Pipeline(ledger, [SCHEMA], TEMPLATES[:1], Scripted(default="actors:\n  a: {k: 1}"), config()).run(chapters(spark))
    assert waited == [True] and ledger.pointer()["snapshot"]["levels"]
    assert spark.read.text(str(tmp_path / "w" / "logs")).count() == ledger.log().count() > 0
    monkeypatch.setattr(Ledger, "export_log", lambda *_: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        Pipeline(Ledger(spark, str(tmp_path / "v")), [SCHEMA], TEMPLATES[:1], Echo(), config()).run(chapters(spark))


def test_a_fold_reads_its_rows_once(spark):
    """What came first and how often is told by the fold itself, also where rows are folds; of one place, in the order of the entries."""
    from docfold.sinks.ledger import _fold

    kinds = "book string, schema string, entity string, seq long, node string, first struct<seq:long,pos:long>, touches long"
    rows = [("b", "s", "e", 7, '{"n": 2}', (7, 1), 1), ("b", "s", "e", 7, '{"n": 1}', (7, 0), 1), ("b", "s", "e", 0, '{"n": 0, "m": 1}', (3, 2), 4), ("b", "s", "f", 5, '{"k": 1}', (5, 9), 1)]
    out = _fold(spark.createDataFrame(rows, kinds).repartition(3), C.MergeConfig(), ("book", "schema", "entity"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInPandas") == 1
    got = {r.entity: (tuple(r.first), json.loads(r.node), r.touches) for r in out.collect()}
    assert got == {"e": ((3, 2), {"n": 2, "m": 1}, 6), "f": ((5, 9), {"k": 1}, 1)}


def test_texts_are_normalised_once(spark):
    """Whether a text is blank is told before, by what isn't blank."""
    from docfold.functions import text as T
    from docfold.operators.chapters import chapters as chapters_

    odd = ["", " ", "\r\n", "\u3000\t", "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029", "\xa0", "\u2003", "\x1f", "\0", "a\r\n\r\n b\r\rc\n\rd", " \U0001f600\u2028 ", "^", "]"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string").select("text", T.normalized(F.col("text")).alias("n"), T.has_text(F.col("text")).alias("has")).collect()
    assert [r.has for r in rows] == [r.n != "" for r in rows] == [False] * 5 + [True] * 8
    assert rows[9].n == "a\nb\nc\nd" and rows[10].n == "\U0001f600"
    out = chapters_(spark.createDataFrame([("b", i, "t", t, "p") for i, t in enumerate([*odd, None])], "book string, pos long, title string, text string, source_path string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("transform(split(") == 1 and out.count() == 8


def test_prompts_make_what_their_template_asks_for():
    from docfold import extraction as E

    values = E.prompt_values([{"chapter_index": 1, "chapter_id": "c", "title": "{{root_key}}", "text": "x"}], "ch0001-ch0001-d0", SCHEMA, {"actors": {}}, "", "")
    assert E.render("{{chapter_title}} {{batch_id}} {{source_text}}", {k: v if k in ("batch_id", "chapter_title", "source_text", "root_key") else None for k, v in values.items()}) == "{{root_key}} ch0001-ch0001-d0 ### Chapter 1\nchapter_id: c\nchapter_title: actors\n\nx"


def test_plain_mappings_need_no_constructor(monkeypatch):
    from docfold.operators import increments as I

    yaml = I.yaml
    texts = ["a:\n  e1:\n    last: ch0001-ch0002-d0\n    n: 20", "a: 1\na: x\n", "a: 0\nb: 7\n"]
    other = ["a: 010\nb: 0x1F", "1: x\n", "a: yes\n", "no: x\n", "a:\n", "a: 2020-01-01\n", "a: 1_0\n", "a: 1.5\n", "a: 12345678901234567890\n"]
    want = [yaml.safe_load(t) for t in [*texts, *other]]
    assert [I.loaded(t) for t in [*texts, *other]] == want and [type(I.loaded(t)) for t in other] == [dict] * 9
    monkeypatch.setattr(yaml, "load", lambda *_: "constructed")
    assert [I.loaded(t) for t in texts] == want[:3] and {I.loaded(t) for t in other} == {"constructed"}
