"""Similarity and merges: stated behaviours, and the distributed fold against a model."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docfold.config import MergeConfig
from docfold.operators import increments as I  # noqa: N812
from docfold.operators import matching
from docfold.operators import schema as S
from docfold.operators import similarity as M

C6 = MergeConfig()


def test_similarity():
    assert M.similarity("a", "a", {}) == 1.0 and M.similarity("apple", "appl", {}) > 0.6 > M.similarity("apple", "orange", {})
    assert M.similarity(1, 1.0, {}) == 0.0 and M.similarity(True, 1, {}) == 0.0 and M.similarity(None, None, {}) == 1.0
    a, b = {"name": "x", "age": 1}, {"name": "x", "age": 2}
    assert M.similarity(a, b, {}) == 0.5 and M.similarity(a, b, {"name": 2.0}) == pytest.approx(2 / 3)
    assert M.similarity({"p": a}, {"p": b}, {"p.name": 3.0}) == pytest.approx(0.75)
    assert M.similarity([], [], {}) == 1.0 and M.similarity([], ["a"], {}) == 0.0
    assert M.similarity(["a", "b", "c"], ["c", "a", "b"], {}) == 1.0 and M.similarity(["a", "b", "c"], ["a", "b"], {}) == pytest.approx(2 / 3 * 2 / 3)
    assert M.text_ratio("tide", "diet") != M.text_ratio("diet", "tide")


def test_arrays():
    m = lambda a, b, c=C6: M.merged_array(a, b, c)
    assert m([], ["abc", "abcd"]) == ["abcd"] and m(m([], ["abc", "abcd"]), ["abc", "abcd"]) == ["abc", "abcd"]
    assert m([1], [1, 1, 1]) == [1, 1] and m([1, 2, 3], [1, 4]) == [1, 2, 3, 4]
    assert len(m(["apple"], ["appl", "apple"])) == 2
    assert m(m(["abcdef"], ["abcdxy"]), ["abwzxy"]) != m(["abcdef"], m(["abcdxy"], ["abwzxy"]))
    assert m(["x"], ["q"], MergeConfig(similarity_threshold=0.0)) == ["x", "q"]
    assert m(["a", "b"], ["c"], MergeConfig(array_policy="replace")) == ["c"]


def test_deep_merge_keeps_what_is_not_mentioned():
    old = {"k": 1, "d": {"region": "n", "climate": "c"}, "t": "x"}
    assert M.merged(old, {"d": {"region": "s"}, "t": [1]}, C6) == {"k": 1, "d": {"region": "s", "climate": "c"}, "t": [1]}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=4), max_size=4), st.lists(st.text("ab", max_size=4), max_size=4))
def test_bounds_change_nothing(a, b):
    """The pruned merge against one that always runs the matcher."""
    out, taken = list(a), set()
    for x in b:
        scores = [(M.text_ratio(y, x), -i) for i, y in enumerate(out) if i not in taken]
        best = max(scores, default=(0.0, 0))
        if best[0] > 0 and best[0] >= 0.6:
            out[-best[1]] = x
            taken.add(-best[1])
        else:
            out.append(x)
    assert M.merged_array(a, b, C6) == out


def plain_merge(current, incoming, config):
    """Every element that nothing has replaced is compared; the first of the best counts."""
    out, taken = list(current), set()
    for x in incoming:
        best, at = 0.0, None
        for i, y in enumerate(out):
            if i not in taken and (s := M.similarity(y, x, config.field_weights)) > best:
                best, at = s, i
        if at is not None and best >= config.similarity_threshold:
            out[at] = x
            taken.add(at)
        else:
            out.append(x)
    return out


VALUES = st.recursive(st.one_of(st.text("abc", max_size=6), st.integers(0, 3), st.booleans(), st.none(), st.floats(0, 1)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from("pqr"), x, max_size=3)), max_leaves=6)


@settings(max_examples=400, deadline=None)
@given(st.lists(VALUES, max_size=14), st.lists(VALUES, max_size=14), st.sampled_from([0.0, 0.3, 0.6, 0.9, 1.0, 1.5]), st.sampled_from([{}, {"p": 3.0, "q": 0.0}, {"p": -1.0}]))
def test_the_index_changes_nothing(a, b, threshold, weights):
    config = MergeConfig(similarity_threshold=threshold, field_weights=weights)
    assert M.merged_array(a, b, config) == plain_merge(a, b, config)


def sentences(n, rng):
    words = ["".join(rng.choices("etaoinshrdlucmfw", range(16, 0, -1), k=rng.randint(2, 9))) for _ in range(3000)]
    return [" ".join(rng.choices(words, k=rng.randint(3, 9))) for _ in range(n)]


def test_arrays_of_many_texts_meet_few_candidates():
    """Of arrays of a thousand texts the matcher sees under a tenth of all pairs; on a part of them the result is that of all pairs."""
    rng = random.Random(9)
    texts = sentences(1000, rng)
    edited = [t[:-4] + "xyz" if rng.random() < 0.5 else s for t, s in zip(texts, sentences(1000, rng), strict=True)]
    before = matching.Against.runs
    out = M.merged_array(texts, edited, C6)
    assert matching.Against.runs - before < 1000 * 1000 / 10 and 1200 < len(out) < 1800
    assert M.merged_array(texts[:60], edited[:60], C6) == plain_merge(texts[:60], edited[:60], C6)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=300), st.text("abcd", max_size=300))
def test_bounds_hold(a, b):
    against = matching.Against(b)
    assert against.ratio(a) <= against.subsequence_bound(a) <= matching.length_bound(a, b)
    shared = int(matching.np.minimum(matching.class_counts(a), matching.class_counts(b)).sum())
    assert against.subsequence_bound(a) <= matching.ratio_of(shared, len(a), len(b))


@pytest.mark.parametrize("part", [4096, 5])
def test_best_matches_are_those_of_all_pairs(spark, part):
    """Also of a key that has most texts, cut into blocks."""
    rng = random.Random(part)
    texts = sentences(60, rng)
    side = lambda n: [(None if k % 19 == 0 else "hot" if k % 3 else f"k{k % 4}", k, None if k % 11 == 0 else rng.choice(texts)[rng.randint(0, 4) :]) for k in range(n)]
    have, new = side(80), side(60)
    got = M.best_matches(spark.createDataFrame(have, "k string, place int, text string"), spark.createDataFrame(new, "k string, no int, text string"), ["k"], 0.6, part).collect()
    want = {}
    for k, no, t in new:
        found = max(((M.text_ratio(x, t), -place) for key, place, x in have if key == k is not None and x is not None), default=(0.0, 0)) if t is not None else (0.0, 0)
        if found[0] >= 0.6:
            want[k, no] = (-found[1], found[0])
    assert {(r.k, r.no): (r.place, r.ratio) for r in got} == want and len(want) >= 15


def test_column_bounds(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("", ""), ("aa", "a"), ("xyz", "abc")], "a string, b string")
    for r in rows.select("a", "b", M.seq_ratio(F.col("a"), F.col("b")).alias("r"), M.length_bound(F.col("a"), F.col("b")).alias("l"), M.bag_bound(F.col("a"), F.col("b")).alias("g")).collect():
        assert r.r <= r.g + 1e-9 <= r.l + 2e-9


def test_fold_is_the_model(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 5)))
    node = lambda: {rng.choice("pqr"): rng.choice([word(), [word() for _ in range(rng.randint(0, 3))], {"x": word()}, rng.randint(0, 3)]) for _ in range(2)}
    rows = [(f"e{rng.randint(0, 20)}", i, node()) for i in range(1000)]
    want: dict = {}
    for k, _, n in rows:
        want[k] = M.merged(want[k], n, C6) if k in want else n
    mixed = rng.sample(rows, len(rows))
    got = I.folded(spark.createDataFrame([(k, i, json.dumps(n)) for k, i, n in mixed], "entity string, seq long, node string").repartition(7), C6).collect()
    assert {r.entity: json.loads(r.node) for r in got} == want and sum(r.touches for r in got) == 1000


def test_sanitize_and_parse(spark):
    dirty = {" a ": "  x ", "b": None, "c": ["", " ", {"d": []}], "e": 0, "f": False, "g": {"h": " "}, "a": "last"}
    assert I.sanitized(dirty) == {"a": "last", "e": 0, "f": False}
    for text in ("a: 1", "```\na: 1\n```", "```yaml\na: 1\n```", "```YAML\na: 1"):
        assert I.parsed(text) == ({"a": 1}, "")
    assert "invalid yaml" in I.parsed("[1")[1] and "empty" in I.parsed("")[1] and "mapping" in I.parsed("[1]")[1]
    row = spark.createDataFrame([("a: 2020-01-01\nb: yes",), (None,)], "t string").select(I.parse_yaml(F.col("t")).alias("x")).collect()
    assert I.decode(row[0].x.node)["a"].year == 2020 and I.decode(row[0].x.node)["b"] is True and row[1].x.error


def test_strict_validation():
    check = lambda d: I.validated(d, "actors", {"k": "", "tags": [""], "d": {}}, "strict")
    assert check({"actors": {"a": {"k": 1, "tags": ["x"]}}}) == []
    assert check({"actors": {" ": {}}}) == [("$.actors", "missing entry key")]
    assert ("$.other", "unexpected field") in check({"other": 1}) and ("$.actors.a.z", "unexpected field") in check({"actors": {"a": {"z": 1}}})
    assert ("$.actors.a.tags", "expected list") in check({"actors": {"a": {"tags": 1}}}) and ("$.actors.a", "expected mapping") in check({"actors": {"a": 1}})
    assert I.validated({"other": 1}, "actors", {}, "permissive") == []


def test_entries_that_are_no_mappings(spark):
    rows = spark.createDataFrame([(1, '{"r": {"a": {"k": 1}}}'), (2, '{"r": {"a": "text"}}'), (3, '{"r": []}'), (4, "{}")], "seq long, node string")
    got = {r.seq: (r.entity, r.error) for r in I.entries(rows, "r").collect()}
    assert got[1] == ("a", None) and got[2][0] is None and got[3][1] and 4 not in got


TEXT = "actors:\n  <name>:\n    name: \"\"\n    tags: []\n    links:\n      - target: x\n        weight: 1\n    details:\n      alive: true\n"


def test_schema_inference(spark):
    root, fields, sample = S.infer(TEXT)
    assert root == "actors" and ("actors[].name", "string", True) in fields and ("actors[].links[].weight", "integer", False) in fields
    by_text = [(r.path, r.type, r.required) for r in S.text_fields(spark.createDataFrame([("s", TEXT)], "schema string, text string")).orderBy("pos").collect()]
    assert [f[:2] for f in by_text] == [f[:2] for f in fields]
    assert S.skeleton("actors", by_text) == {"name": "", "tags": [], "links": [{"target": "", "weight": 0}], "details": {"alive": False}}
    assert S.struct_of(sample).simpleString().startswith("struct<name:string,tags:array<string>")
    deep = [("r[].a.b[].c", "integer", False), ("r[].a.b[].d", "list", False), ("r[].a.e", "object", False), ("r[].z", "list", False), ("r[].a", "object", False), ("r[].a.b", "list", False), ("other[].x", "string", False)]
    assert S.skeleton("r", deep) == {"a": {"b": [{"c": 0, "d": []}], "e": {}}, "z": []}
    broken = "world:\n  <name>:\n    a: [1\n    b: true # note\n"
    assert S.infer(broken)[1] == [("world[].a", "string", False), ("world[].b", "boolean", False)]


def test_functions_in_sql(spark):
    from docfold.functions.sql import register

    register(spark)
    page = "<p>before</p><h1>One</h1><p>a</p><p>b</p><H1 class=x>Two</H1><p>c</p>"
    spark.createDataFrame([(1, page), (2, "<h1>Only</h1>"), (3, None), (4, "no tags")], "id int, html string").createOrReplaceTempView("pages_of_test")
    rows = spark.sql("SELECT id, c.* FROM pages_of_test, LATERAL chapters_of(html) c ORDER BY id, pos").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "Unnamed Chapter", "before"), (1, 1, "One", "a\nb"), (1, 2, "Two", "c"), (2, 0, "Only", "")]
    one = spark.sql("""SELECT seq_ratio('tide', 'diet') AS r, seq_ratio(null, 'a') AS n, value_similarity('{"a": 1, "b": 2}', '{"a": 1, "b": 3}', '{"a": 3}') AS v,
        parse_yaml('a: [1').error AS e, parse_yaml('a: 1').node AS d, sanitize_json('{" a ": " x ", "b": null}') AS s""").first()
    assert one.r == M.text_ratio("tide", "diet") and one.n is None and one.v == 0.75 and one.e.startswith("$: invalid yaml") and one.d == '{"a": 1}' and one.s == '{"a": "x"}'


def test_variant_fields_are_those_of_the_parsed_document(spark):
    docs = [{"b": {"x": [[{"deep": {"er": {"name": None}}}]], "y": []}, "<k>": {"name": "n", "more": {"z": 1.5}}, "c": True, "d": [1, {"no": 1}], "e": -3}, {}, {"a": [{"<p>": {"q": [[]]}}]}, [1], "text"]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, node string")
    out = S.variant_fields(rows, ["id"], F.lit("r"), "node")
    assert "Python" not in out._jdf.queryExecution().toString()
    got = sorted((r.id, r.path, r.type, r.required) for r in out.collect())
    assert got == sorted((i, *f) for i, d in enumerate(docs) for f in S.fields_of("r", d))


def test_parents_are_the_nearest_lines_indented_less(spark):
    rng = random.Random(2)
    texts = [(f"s{k}", "\n".join(" " * rng.randint(0, 6) + f"k{i}: 1" for i in range(rng.randint(1, 40)))) for k in range(20)]
    got = {(r.schema, r.line_no): r.parent for r in S.parents(spark.createDataFrame(texts, "schema string, text string")).collect()}
    want = {}
    for name, text in texts:
        indents = [len(x) - len(x.lstrip()) for x in text.split("\n")]
        for i, n in enumerate(indents):
            want[name, i] = max((j for j in range(i) if indents[j] < n), default=None)
    assert got == want
