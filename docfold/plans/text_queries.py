"""Queries of text, identifier, page and prompt functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfold.functions import html as H
from docfold.functions import prompts as P
from docfold.functions import text as T
from docfold.plans.registry import by_row, query, table

LINES = "regexp_split_to_array(@, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')"
STRIP = "' ' || chr(13) || chr(10) || chr(9) || chr(12288)"


def norm(x: str) -> str:
    """SQL: normalised text."""
    return f"array_to_string(list_filter(list_transform({LINES.replace('@', x)}, lambda l: trim(l, {STRIP})), lambda l: l <> ''), chr(10))"


def compact_sql(x: str) -> str:
    one = f"trim(regexp_replace({x}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), ' ')"
    return f"CASE WHEN length({one}) > 240 THEN substr({one}, 1, 237) || '...' ELSE {one} END"


@query(f"SELECT doc_id, {norm('text')} AS norm_text FROM documents")
def f2_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalized(F.col("text")).alias("norm_text"))


@query(f"SELECT doc_id, trim(text, {STRIP}) AS stripped, length(trim(chr(12288) || ' ' || chr(9) || text || chr(160) || ' ', {STRIP})) AS kept FROM documents")
def f3_strip(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("\u3000 \t"), F.col("text"), F.lit("\u00a0 "))
    return table(spark, sf, "documents").select("doc_id", T.stripped(F.col("text")).alias("stripped"), F.length(T.stripped(padded)).cast("long").alias("kept"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Chapter ' || (turn + 1) ELSE role END AS title FROM conversations")
def f4_normalize_title(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("turn") % 3 == 0, F.lit(" 　\n")).otherwise(F.concat(F.lit("\t"), F.col("role"), F.lit(" ")))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.titled(given, F.col("turn") + 1).alias("title"))


@query("""SELECT conv_id, turn, printf('ch%04d', turn + 1) || '-' || substr(sha256('conv/' || conv_id || chr(10) || role || chr(10) || text), 1, 12) AS chapter_id FROM conversations""")
def f5_chapter_id(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.chapter_id(F.col("turn") + 1, path, F.col("role"), F.col("text")).alias("chapter_id"))


@query("SELECT doc_id, greatest(1, (length(text) + 3) // 4) AS token_estimate FROM documents")
def f6_estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("token_estimate"))


@query("""SELECT conv_id, printf('ch%04d-ch%04d', min(turn) + 1, max(turn) + 1) AS label, printf('ch%04d-ch%04d-d%d', min(turn) + 1, max(turn) + 1, conv_id % 3) AS batch_id, printf('ch%04d', max(turn) + 1) AS checkpoint_id FROM conversations GROUP BY conv_id""")
def f7_range_ids(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "conversations").groupBy("conv_id").agg((F.min("turn") + 1).alias("a"), (F.max("turn") + 1).alias("b"))
    return g.select("conv_id", T.range_label(F.col("a"), F.col("b")).alias("label"), T.batch_id(F.col("a"), F.col("b"), F.col("conv_id") % 3).alias("batch_id"), T.checkpoint_id(F.col("b")).alias("checkpoint_id"))


TOKEN = "coalesce(nullif(trim(regexp_replace(lower(trim({x})), '[^a-zA-Z0-9._-]+', '-', 'g'), '-._'), ''), 'value')"


@query(f"SELECT page_id, {TOKEN.format(x='url')} AS token, {TOKEN.format(x="' -' || url || '- '")} AS padded_token FROM pages")
def f8_debug_token(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.debug_token(F.col("url")).alias("token"), T.debug_token(F.concat(F.lit(" -"), "url", F.lit("- "))).alias("padded_token"))


@query(f"SELECT o_orderkey, {TOKEN.format(x='o_orderpriority')} || '.' || printf('ch%04d-ch%04d', o_orderkey % 50 + 1, o_orderkey % 50 + 4) || '.d1.' || printf('r%02d', o_orderkey % 3 + 1) || '.base.prompt.txt' AS artifact FROM orders")
def f9_artifact_name(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey") % 50
    return table(spark, sf, "orders").select("o_orderkey", T.artifact_name(F.col("o_orderpriority"), n + 1, n + 4, F.lit(1), F.col("o_orderkey") % 3 + 1, F.lit("Base"), F.lit("prompt.txt")).alias("artifact"))


@query("SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}_.-]+', '-', 'g'), '-._'), ''), 'epub') AS slug FROM documents")
def f10_slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 33 <= 0 THEN 0.0 ELSE round_even(CAST(o_custkey % 33 AS DOUBLE) / (o_orderkey % 33) * 100, 2) END AS pct FROM orders")
def f11_progress_percent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", T.percent(F.col("o_custkey") % 33, F.col("o_orderkey") % 33).alias("pct"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def f12_utc_iso(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.utc_iso(F.col("ts")).alias("stamp"))


@query("SELECT conv_id, turn, greatest((turn + 1 - 1) // 3, 0) AS win, 0::BIGINT AS no_win FROM conversations")
def f13_window_index(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("turn") + 1
    return table(spark, sf, "conversations").select("conv_id", "turn", T.window_index(i, 3).alias("win"), T.window_index(i, 0).alias("no_win"))


def _books(spark: SparkSession, sf: str) -> DataFrame:
    c = F.struct((F.col("turn") + 1).alias("chapter_index"), F.format_string("c%d", "turn").alias("chapter_id"), F.col("role").alias("title"), F.col("text").alias("text"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(c)).alias("chapters"))


SOURCE = "string_agg('### Chapter ' || (turn + 1) || chr(10) || 'chapter_id: c' || turn || chr(10) || 'chapter_title: ' || role || chr(10) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn)"


@query(f"SELECT conv_id, {SOURCE} AS source_text FROM conversations GROUP BY conv_id")
def f14_source_text(spark: SparkSession, sf: str) -> DataFrame:
    return _books(spark, sf).select("conv_id", P.source_text(F.col("chapters")).alias("source_text"))


@query("SELECT conv_id, CASE WHEN count(*) = 1 THEN min_by(role, turn) ELSE min_by(role, turn) || ' ~ ' || max_by(role, turn) END AS titles FROM conversations GROUP BY conv_id")
def f15_batch_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _books(spark, sf).select("conv_id", P.titles(F.col("chapters")).alias("titles"))


def _rules_sql(root: str) -> str:
    return " || chr(10) || ".join("'" + r.replace("{root}", f"' || {root} || '").replace("{match}", "name") + "'" for r in P.RULES)


@query(f"SELECT r_regionkey, {_rules_sql('lower(r_name)')} AS rules FROM region")
def f16_output_rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select("r_regionkey", P.output_rules(F.lower("r_name"), F.lit("name")).alias("rules"))


TEMPLATE = "T {{chapter_title}} [{{batch_id}}] e={{error_summary}} y={{existing_yaml}}\n{{source_text}}"


@query(f"""WITH b AS (SELECT conv_id, {SOURCE} AS s, min_by(role, turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, 'T ' || t || ' [b' || conv_id || '] e=none y={{}}' || chr(10) || replace(replace(s || ' {{{{root_key}}}}', '{{{{root_key}}}}', 'actors'), '{{{{chapter_title}}}}', t) AS prompt FROM b""")
def f17_render_template(spark: SparkSession, sf: str) -> DataFrame:
    b = _books(spark, sf).select("conv_id", F.concat(P.source_text(F.col("chapters")), F.lit(" {{root_key}}")).alias("s"), F.element_at("chapters", 1)["title"].alias("t"))
    values = {"source_text": F.col("s"), "chapter_title": F.col("t"), "batch_id": F.concat(F.lit("b"), F.col("conv_id").cast("string")), "error_summary": P.or_default(F.lit("  "), "none"), "existing_yaml": P.or_default(F.lit(""), "{}"), "root_key": F.lit("actors")}
    return b.select("conv_id", P.rendered(F.lit(TEMPLATE), values).alias("prompt"))


FENCE = "repeat(chr(96), 3)"


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS b FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN trim(b) WHEN 1 THEN trim(b) WHEN 2 THEN trim(b) WHEN 3 THEN {FENCE} || rtrim(b) ELSE {FENCE} || 'x' || chr(10) END AS kind_check,
CASE doc_id % 5 WHEN 0 THEN trim(b) WHEN 1 THEN trim(b) WHEN 2 THEN trim(b) WHEN 3 THEN trim({FENCE} || b) ELSE trim(b || {FENCE} || b) END AS body FROM t""")
def f18_strip_fence(spark: SparkSession, sf: str) -> DataFrame:
    b, f, k = F.regexp_replace("text", r"\s+", " "), F.lit("```"), F.col("doc_id") % 5
    given = F.when(k == 0, F.concat(F.lit(" "), b)).when(k == 1, F.concat(f, F.lit("yaml\n"), b, F.lit("\n"), f)).when(k == 2, F.concat(f, F.lit("\n"), b)).when(k == 3, F.concat(f, b)).otherwise(F.concat(f, F.lit("YAML\n"), b, f, b, F.lit("\n"), f))
    check = F.when(k < 3, F.trim(b)).when(k == 3, F.concat(f, F.rtrim(b))).otherwise(F.concat(f, F.lit("x\n")))
    return table(spark, sf, "documents").select("doc_id", check.alias("kind_check"), T.unfenced(given).alias("body"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN role || text ELSE '' END AS delta FROM conversations""")
def f19_stream_delta(spark: SparkSession, sf: str) -> DataFrame:
    k, text, role = F.col("turn") % 4, F.col("text"), F.col("role")
    choice = lambda c: F.to_json(F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("delta"))).alias("choices")))
    parts = F.to_json(F.struct(role.alias("a"), text.alias("b")))
    listed = F.concat(F.lit('{"choices":[{"delta":{"content":['), F.regexp_replace(F.regexp_extract(parts, r'(?s)^\{"a":(".*?"),"b":', 1), "", ""), F.lit(',7,{"other":1},{"text":'), F.regexp_extract(parts, r'(?s)^\{"a":".*?","b":(.*)\}$', 1), F.lit("}]}}]}"))
    chunk = F.when(k == 0, choice(text)).when(k == 1, listed).when(k == 2, F.lit('{"choices":[]}')).otherwise(F.lit("not json"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.delta_text(chunk).alias("delta"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name[1]) || 'roots' WHEN 1 THEN 'worldinfo' END AS root_key FROM nation")
def f20_detect_root(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    prompt = F.when(k == 0, F.concat(F.lit("use root_key: `"), F.lower(F.substring("n_name", 1, 1)), F.lit("roots` here"))).when(k == 1, F.lit("schema\nworldinfo:\n  x: 1")).otherwise(F.lit("nothing here"))
    return table(spark, sf, "nation").select("n_nationkey", T.root_of_prompt(prompt).alias("root_key"))


@query(f"SELECT doc_id, {compact_sql('text')} AS error_text FROM documents")
def f21_compact_error(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.compact(F.col("text")).alias("error_text"))


def _part(rx: str) -> str:
    return compact_sql(f"regexp_replace(regexp_extract(html, '{rx}', 1), '<[^>]+>', ' ', 'g')")


PAGE_KIND = "CASE page_id % 4 WHEN 0 THEN 'error' || chr(160) || '522 ' WHEN 1 THEN 'Origin down Error 1020 ' WHEN 2 THEN 'cloudflare 502 ' ELSE chr(12288) || ' ' END"


@query(f"""WITH h AS (SELECT page_id, {PAGE_KIND} || html AS html FROM pages), p AS (SELECT page_id, html, nullif({_part('(?is)<title>(.*?)</title>')}, '') AS t, nullif({_part('(?is)<p>(.*?)</p>')}, '') AS f,
CASE page_id % 4 WHEN 0 THEN 'Cloudflare 522' WHEN 1 THEN 'Cloudflare 1020' ELSE 'Cloudflare ' || nullif(regexp_extract(html, '(?i)Error[ \\n\\t]*([0-9]{{3,4}})', 1), '') END AS c FROM h)
SELECT page_id, {compact_sql("coalesce(nullif(concat_ws(' | ', t, c, f), ''), html)")} AS summary FROM p""")
def f22_html_error(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 4
    before = F.when(k == 0, "error\u00a0522 ").when(k == 1, "Origin down Error 1020 ").when(k == 2, "cloudflare 502 ").otherwise("\u3000 ")
    return table(spark, sf, "pages").select("page_id", T.html_error(F.concat(before, "html")).alias("summary"))


@query(f"SELECT page_id, {_part('(?is)<title[^>]*>(.*?)</title>')} AS title, contains(lower(html), '<html') OR contains(lower(html), '<!doctype html') AS is_html FROM pages")
def f23_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.html_part(F.col("html"), "(?is)<title[^>]*>(.*?)</title>").alias("title"), T.looks_like_html(F.col("html")).alias("is_html"))


@query("SELECT page_id, rtrim(url || '//', '/') AS base FROM pages")
def f25_base_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.base_url(F.concat("url", F.lit("//"))).alias("base"))


@query("SELECT user_id, string_agg(event_type || ': k' || event_id, '; ' ORDER BY event_id) AS summary FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id")
def f26_issue_summary(spark: SparkSession, sf: str) -> DataFrame:
    issue = F.struct("event_id", F.col("event_type").alias("path"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("reason"))
    rows = table(spark, sf, "events").where(F.col("event_type").isin("error", "signup")).groupBy("user_id").agg(F.array_sort(F.collect_list(issue)).alias("issues"))
    return rows.select("user_id", T.issue_summary(F.col("issues")).alias("summary"))


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for name, value in H.REFERENCES:
        out = f"replace({out}, '{name}', {'chr(39)' if value == chr(39) else 'chr(160)' if value == chr(160) else repr(value) if value != chr(34) else 'chr(34)'})"
    return out


P_SQL = "(?is)<p(?:[ \\t\\r\\n\\f][^>]*)?>(.*?)</p>"
H_SQL = "(?is)<h1(?:[ \\t\\r\\n\\f][^>]*)?>(.*?)</h1>"


@query(f"""WITH x AS (SELECT page_id, trim({_plain(f"regexp_extract(html, '{H_SQL}', 1)")}, {STRIP}) AS t, list_filter(list_transform(regexp_extract_all(html, '{P_SQL}', 1), lambda p: trim({_plain('p')}, {STRIP})), lambda p: p <> '') AS ps FROM pages)
SELECT page_id, CASE WHEN t = '' THEN 'Unnamed Chapter' ELSE t END AS title, array_to_string(ps, chr(10)) AS body FROM x""")
def f1_extract_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.paragraphs(F.col("html")).alias("body"))


@query("SELECT event_id, coalesce(nullif(trim(CASE WHEN event_type = 'error' THEN '  boom ' || event_id || ' ' WHEN event_type = 'view' THEN '' ELSE NULL END), ''), '') AS last_error FROM events")
def f36_last_error(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("  boom "), F.col("event_id").cast("string"), F.lit(" "))).when(F.col("event_type") == "view", F.lit(""))
    return table(spark, sf, "events").select("event_id", T.last_error(raw).alias("last_error"))


@query(f"SELECT page_id, CASE WHEN t = '' THEN 'Unnamed Chapter' ELSE t END AS first_h1 FROM (SELECT page_id, trim({_plain(f"regexp_extract(replace(html, '</article>', '<h1 id=x>later</h1></article>'), '{H_SQL}', 1)")}, {STRIP}) AS t FROM pages)")
def o6_first_heading(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", H.title(F.replace("html", F.lit("</article>"), F.lit("<h1 id=x>later</h1></article>"))).alias("first_h1"))


@query(f"""WITH h AS (SELECT page_id, {PAGE_KIND} || html AS html FROM pages), p AS (SELECT page_id, html, nullif({_part('(?is)<title>(.*?)</title>')}, '') AS t, nullif({_part('(?is)<p>(.*?)</p>')}, '') AS f,
CASE page_id % 4 WHEN 0 THEN 'Cloudflare 522' WHEN 1 THEN 'Cloudflare 1020' ELSE 'Cloudflare ' || nullif(regexp_extract(html, '(?i)Error[ \\n\\t]*([0-9]{{3,4}})', 1), '') END AS c FROM h)
SELECT page_id, {compact_sql("coalesce(nullif(concat_ws(' | ', t, c, f), ''), html)")} AS summary, {compact_sql("regexp_replace(html, '<', '(', 'g')")} AS plain_summary FROM p""")
def f24_read_error(spark: SparkSession, sf: str) -> DataFrame:
    """What a client says about an error's body: the form that runs beside the model."""
    from docfold.clients import error_text

    k = F.col("page_id") % 4
    before = F.when(k == 0, "error\u00a0522 ").when(k == 1, "Origin down Error 1020 ").when(k == 2, "cloudflare 502 ").otherwise("\u3000 ")
    rows = table(spark, sf, "pages").select("page_id", F.concat(before, "html").alias("body"))
    return by_row(rows, lambda r: [(r["page_id"], error_text(r["body"]), error_text(r["body"].replace("<", "(")))], "page_id long, summary string, plain_summary string")


@query("SELECT o_orderkey, greatest(o_orderkey % 9000 - 4500, 0) AS budget, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 12 ELSE 0 END AS window_size, TRUE AS same FROM orders")
def s9_config(spark: SparkSession, sf: str) -> DataFrame:
    """Settings from a mapping, given as text or number, and written back."""
    from docfold import config

    def each(r):
        k = r["o_orderkey"]
        c = config.from_mapping({"batching": {"max_input_tokens": str(k % 9000), "enable_checkpoint": k % 2 == 0, "checkpoint_every_n_chapters": k % 12}, "unknown": 1, "concurrency": {"max_workers": "3"}})
        return [(k, c.batching.budget, c.batching.window, config.from_mapping(config.to_mapping(c)) == c and c.max_workers == 3 and config.to_mapping(c)["unknown"] == 1)]

    return by_row(table(spark, sf, "orders").select("o_orderkey"), each, "o_orderkey long, budget long, window_size long, same boolean")


@query(f"""WITH x AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS i, parts FROM (SELECT page_id, string_split_regex(html, '(?i)<h1') AS parts FROM pages)),
y AS (SELECT page_id, i, CASE WHEN i = 1 THEN '' ELSE '<h1' END || parts[i] AS part FROM x),
z AS (SELECT page_id, i, trim({_plain(f"regexp_extract(part, '{H_SQL}', 1)")}, {STRIP}) AS t, array_to_string(list_filter(list_transform(regexp_extract_all(part, '{P_SQL}', 1), lambda p: trim({_plain('p')}, {STRIP})), lambda p: p <> ''), chr(10)) AS body FROM y)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, CASE WHEN t = '' THEN 'Unnamed Chapter' ELSE t END AS title, CAST(CASE WHEN t = '' THEN 0.0 ELSE 1.0 END AS DOUBLE) AS same_title FROM z WHERE i > 1 OR body <> ''""")
def s1_chapters_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' sections and the matcher, from SQL."""
    from docfold.functions.sql import register

    register(spark)
    table(spark, sf, "pages").createOrReplaceTempView("docfold_pages")
    same = "seq_ratio(c.title, get_json_object(parse_yaml(to_json(named_struct('t', c.title))).node, '$.t'))"
    return spark.sql(f"SELECT page_id, c.pos, c.title, CASE WHEN c.title = 'Unnamed Chapter' THEN 0.0D ELSE {same} END AS same_title FROM docfold_pages p, LATERAL chapters_of(p.html) c")
