"""Prompts: what a batch's chapters look like in one, and placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The placeholders, in the order in which they are replaced.
PLACEHOLDERS = ("source_text", "schema_text", "existing_yaml", "existing_worldinfo", "error_summary", "root_key", "match_key", "output_rules", "chapter_title", "chapter_id", "batch_id", "batch_range", "chapter_count")
RULES = (
    "- Only `{root}` may stand at the top level.",
    "- `{root}` must be a mapping, never a list.",
    "- Each key below `{root}` is a non-empty `{match}`.",
    "- That key identifies the entry; do not repeat it as a field.",
    "- Return only fields that are new or have changed.",
    "- Leave out blank strings, empty lists, empty mappings and nulls.",
    "- Leave out a field whose value is unknown.",
)


def source_text(chapters: Column) -> Column:
    """Of an ordered array of chapters (chapter_index, chapter_id, title, text)."""
    one = lambda c: F.concat(F.lit("### Chapter "), c["chapter_index"].cast("string"), F.lit("\nchapter_id: "), c["chapter_id"], F.lit("\nchapter_title: "), c["title"], F.lit("\n\n"), F.trim(c["text"]))
    return F.array_join(F.transform(chapters, one), "\n\n")


def titles(chapters: Column) -> Column:
    first, last = F.element_at(chapters, 1)["title"], F.element_at(chapters, -1)["title"]
    return F.when(F.size(chapters) == 1, first).otherwise(F.concat(first, F.lit(" ~ "), last))


def output_rules(root: Column, match: Column) -> Column:
    text = "\n".join(RULES)
    return F.replace(F.replace(F.lit(text), F.lit("{root}"), root), F.lit("{match}"), match)


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders are replaced one after another, so what a value brings in is replaced by later ones."""
    out = template
    for name in PLACEHOLDERS:
        if name in values:
            out = F.replace(out, F.lit("{{" + name + "}}"), values[name].cast("string"))
    return out


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))
