"""The registered queries of this folder's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfold.llm import bpe, exact_dedup, fingerprints, html_extract, lexical, merkle, minhash, packing, secrets, simhash, substring, toxicity, url_filter
from docfold.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(merkle.leaves(table(spark, sf_dir, "documents"), merkle.lower_cased))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d)),
f AS (SELECT doc_id, s, min({'d': doc_id, 's': s}) OVER (PARTITION BY t) AS early FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(f.s, f.s + 20)) AS i FROM f WHERE early.d <> doc_id OR early.s <> f.s),
words AS (SELECT doc_id, i, ws[i] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

#: What the extraction comes to on pages whose article holds headings and paragraphs only.
OP4_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS bs FROM pages),
t AS (SELECT page_id, url, list_filter(list_transform(bs, lambda b: trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(replace(b, '<br>', ' '), '<[^>]+>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> '') AS bs FROM a)
SELECT page_id, url, array_to_string(bs, chr(10) || chr(10)) AS text, length(array_to_string(bs, chr(10) || chr(10))) AS n_chars FROM t
"""


#: What is looked for, written apart from the operator's rules: kind, pattern, group that is measured, its least length.
FOUND = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\t\r\n:,.-]*?-----END [A-Z ]{0,30}PRIVATE KEY-----|(?:\r?\n[A-Za-z0-9+/=]{16,})*)", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
)


def _spans_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """SQL: the spans of one kind, from the texts between its matches and the matches' lengths."""
    p = "'" + pattern.replace("'", "''") + "'"
    upto = lambda xs, n: f"coalesce(list_sum(list_transform({xs}[1:{n}], lambda x: length(x))), 0)"
    # A token's first two parts have eight characters at least, besides the first three of the first.
    long_enough = f"v >= {least}" + (r" AND regexp_matches(m, '^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.')" if kind == "jwt" else "")
    return f"""SELECT doc_id, {rank} AS k, '{kind}' AS kind, a, a + length(m) AS b FROM (
      SELECT doc_id, ms[i] AS m, length(vs[i]) AS v, CAST({upto('gs', 'i')} + {upto('ms', 'i - 1')} AS BIGINT) AS a
      FROM (SELECT doc_id, gs, ms, vs, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, string_split_regex(text, {p}) AS gs, regexp_extract_all(text, {p}) AS ms, regexp_extract_all(text, {p}, {group}) AS vs FROM d))) WHERE {long_enough}"""


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_spans_sql(k, *r) for k, r in enumerate(FOUND))}),
g AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11_SQL = rf"""
WITH t AS (SELECT kind, id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark)),
q AS (SELECT DISTINCT id AS item_id, term FROM t WHERE kind = 'q'),
d AS (SELECT id AS doc_id, count(*) AS n FROM t WHERE kind = 'd' GROUP BY id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM d),
f AS (SELECT id AS doc_id, term, count(*) AS tf FROM t WHERE kind = 'd' AND term IN (SELECT term FROM q) GROUP BY id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // all_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"


def _leaf_sql(text: str) -> str:
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(map(value, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: The levels of all trees (those of the languages first, then the one above them), and each row's way up, level by level.
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC32} % 3 = 0 THEN {_leaf_sql(f"translate(text, {_A_Z})")} END AS now FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS i FROM d),
low AS (SELECT tree, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM r
  UNION ALL SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY tree, level, i // 8, n),
subroot AS (SELECT tree, level, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees FROM low WHERE n = 1),
high AS (SELECT 0 AS level, place AS i, h, trees AS n FROM subroot
  UNION ALL SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY level, i // 8, n),
nodes AS (SELECT low.tree, low.level, i, low.h, n FROM low UNION ALL SELECT subroot.tree, subroot.level + high.level, high.i, high.h, high.n FROM subroot, high WHERE high.n > 1 OR high.level > 0),
runs AS (SELECT tree, level, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT * FROM nodes WHERE n > 1) WINDOW w AS (PARTITION BY tree, level, i // 8 ORDER BY i)),
up AS (SELECT doc_id, r.tree, 0 AS level, i, i AS leaf_place, coalesce(now, leaf) AS h, '' AS proof FROM r
  UNION ALL SELECT doc_id, up.tree, up.level + 1, CASE WHEN up.level + 1 = s.level THEN s.place ELSE up.i // 8 END, leaf_place, sha256(runs.l || up.h || runs.r), proof || runs.l || runs.r
  FROM up JOIN subroot s ON s.tree = up.tree JOIN runs ON runs.tree = up.tree AND runs.level = up.level
    AND runs.i = CASE WHEN up.level = s.level THEN s.place ELSE up.i END),
done AS (SELECT doc_id, arg_max(h, level) AS folded, arg_max(proof, level) AS proof FROM up GROUP BY doc_id),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT r.doc_id, leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM r JOIN done ON done.doc_id = r.doc_id JOIN subroot s ON s.tree = r.tree, root
"""


def queries() -> dict[str, Query]:
    return {"op1_url_filter": op1_url_filter, "op2_minhash": op2_minhash, "op3_substring": op3_substring, "op4_html_extract": op4_html_extract, "op5_packing": op5_packing, "op6_toxicity": op6_toxicity, "op7_fingerprints": op7_fingerprints, "op8_bpe": op8_bpe, "op9_exact_dedup": op9_exact_dedup, "op10_secrets": op10_secrets, "op11_lexical": op11_lexical, "op12_merkle": op12_merkle, "op13_simhash": op13_simhash}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring": OP3_SQL, "op4_html_extract": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op10_secrets": OP10_SQL, "op11_lexical": OP11_SQL, "op12_merkle": OP12_SQL}
