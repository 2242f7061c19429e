"""Text and identifier functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that are stripped, line ends, white space of Unicode, characters for a token.
STRIP = " \r\n\t\u3000"
LINE_END = "[\n\r\x0b\x0c\x1c-\x1e\x85" + chr(0x2028) + chr(0x2029) + "]"
SOLID = "[^" + STRIP + LINE_END[1:]
WHITE = "[\\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CHARS_PER_TOKEN = 4
ERROR_LENGTH = 240
#: What is looked for in error pages.
TITLE = "(?is)<title>(.*?)</title>"
PARAGRAPH = "(?is)<p>(.*?)</p>"
#: What names the root in a prompt, in this order.
ROOT_PATTERNS = (r"root_key\s*[:=]\s*`?([A-Za-z_][A-Za-z0-9_-]*)`?", r"(?m)^([A-Za-z_][A-Za-z0-9_-]*):\s*$")
ERROR_CODE = "(?i)Error[\\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*([0-9]{3,4})"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIP))


def normalized(text: Column) -> Column:
    """Stripped lines that aren't blank, joined by line feeds. What is between the two signs of a line end is a blank line, so each may count as one."""
    lines = F.transform(F.split(text, LINE_END, -1), stripped)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def has_text(text: Column) -> Column:
    """Whether anything is left of a text when it is normalised: a sign that is neither stripped nor a line end. A filter on the normalised text
    would make that a second time."""
    return text.rlike(SOLID)


def titled(title: Column, index: Column) -> Column:
    """The stripped title, or one from the 1-based index."""
    return F.coalesce(F.nullif(stripped(title), F.lit("")), F.concat(F.lit("Chapter "), index.cast("string")))


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + CHARS_PER_TOKEN - 1) / CHARS_PER_TOKEN)).cast("long")


def chapter_id(index: Column, path: Column, title: Column, text: Column) -> Column:
    digest = F.sha2(F.concat_ws("\n", path, title, text), 256)
    return F.concat(F.format_string("ch%04d", index), F.lit("-"), F.substring(digest, 1, 12))


def range_label(first: Column, last: Column) -> Column:
    return F.format_string("ch%04d-ch%04d", first, last)


def batch_id(first: Column, last: Column, depth: Column) -> Column:
    return F.concat(range_label(first, last), F.format_string("-d%d", depth))


def checkpoint_id(index: Column) -> Column:
    return F.format_string("ch%04d", index)


def debug_token(value: Column) -> Column:
    core = F.regexp_replace(F.lower(F.trim(value)), "[^a-zA-Z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.btrim(core, F.lit("-._")), F.lit("")), F.lit("value"))


def artifact_name(schema: Column, first: Column, last: Column, depth: Column, attempt: Column, template: Column, suffix: Column) -> Column:
    return F.format_string("%s.%s.d%d.r%02d.%s.%s", debug_token(schema), range_label(first, last), depth, attempt, debug_token(template), suffix)


def slug(name: Column) -> Column:
    core = F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}_.-]+", "-")
    return F.coalesce(F.nullif(F.btrim(core, F.lit("-._")), F.lit("")), F.lit("epub"))


def percent(done: Column, total: Column) -> Column:
    """Half-even, as of the quotient times 100."""
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.bround(done / total * 100, 2))


def window_index(index: Column, size: int) -> Column:
    return F.lit(0).cast("long") if size <= 0 else F.greatest(F.floor((index - 1) / size), F.lit(0)).cast("long")


def compact(text: Column, most: int = ERROR_LENGTH) -> Column:
    """White space (that of Unicode) collapsed, trimmed, and cut with dots.

    Only as many words are collapsed as reach ``most + 1`` characters, which is as far as the result can depend on the text."""
    inside = WHITE.removesuffix("+")
    told = F.regexp_extract(text, f"^(?:{inside}*+[^{inside[1:-1]}]){{0,{most + 1}}}+", 0)
    one = F.transform(F.array(F.btrim(F.regexp_replace(told, WHITE, " "), F.lit(" "))), lambda x: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x))
    return F.get(one, F.lit(0))


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first of the keywords, in their order, that the text has; null if none. Blank ones are ignored."""
    words = [k for k in keywords if k.strip()]
    if not words:
        return F.lit(None).cast("string")
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(text, k)), F.lit(0))


def unfenced(text: Column) -> Column:
    """The inside of a fenced block: without the opening line, cut at the last fence after it."""
    blank = F.lit(BLANK)
    t = F.btrim(text, blank)
    body = F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*)$", 1)
    closed = body.contains("```")
    inside = F.regexp_extract(body, r"(?s)^(.*)```", 1)
    return F.when(~t.startswith("```") | ~t.contains("\n"), t).when(closed, F.btrim(inside, blank)).otherwise(F.rtrim(body, blank))


def delta_text(chunk: Column) -> Column:
    """Text of one streamed JSON chunk: ``choices[0].delta.content``, a string or a list of strings and
    objects with ``text``; anything else is empty."""
    v = F.try_parse_json(chunk)
    content = F.try_variant_get(v, "$.choices[0].delta.content", "variant")
    kind = F.schema_of_variant(content)
    parts = F.try_variant_get(content, "$", "array<variant>")
    part = lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).when(F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING", F.try_variant_get(p, "$.text", "string")).otherwise("")
    joined = F.array_join(F.transform(parts, part), "")
    return F.coalesce(F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(kind.startswith("ARRAY"), joined), F.lit(""))


def root_of_prompt(prompt: Column, patterns: tuple[str, ...] = ROOT_PATTERNS) -> Column:
    """The first pattern's group that matches the prompt; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(prompt, p, 1), F.lit("")) for p in patterns])


def looks_like_html(body: Column) -> Column:
    low = F.lower(body)
    return low.contains("<html") | low.contains("<!doctype html")


def html_part(body: Column, pattern: str) -> Column:
    return compact(F.regexp_replace(F.regexp_extract(body, pattern, 1), "<[^>]+>", " "))


def html_error(body: Column) -> Column:
    """Title, gateway code and first paragraph of an error page, as far as there are any; the tags have no attributes."""
    title = F.nullif(html_part(body, TITLE), F.lit(""))
    code = F.nullif(F.regexp_extract(body, ERROR_CODE, 1), F.lit(""))
    first = F.nullif(html_part(body, PARAGRAPH), F.lit(""))
    joined = F.concat_ws(" | ", title, F.concat(F.lit("Cloudflare "), code), first)
    return F.when(joined == "", compact(body)).otherwise(compact(joined))


def base_url(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def issue_summary(issues: Column) -> Column:
    return F.array_join(F.transform(issues, lambda x: F.concat(x["path"], F.lit(": "), x["reason"])), "; ")


def last_error(error: Column) -> Column:
    """The trimmed error, empty without one."""
    return F.coalesce(F.btrim(error, F.lit(BLANK)), F.lit(""))


def is_page(path: Column) -> Column:
    """Whether a member of a book is a page, by its extension."""
    return path.rlike(r"(?i)\.(html|xhtml|htm)$")
