"""Title and paragraphs of a page, by regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfold.functions.text import stripped

UNTITLED = "Unnamed Chapter"
H1 = r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1>"
P = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"
DIMMED = r"""(?is)<p\s+style=["']opacity:0\.4;["'][^>]*>.*?</p>"""
#: Decoded in this order; the ampersand's own comes last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def plain(markup: Column) -> Column:
    out = F.regexp_replace(markup, "<[^>]+>", "")
    for name, value in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def title(page: Column) -> Column:
    found = stripped(plain(F.regexp_extract(page, H1, 1)))
    return F.when(found == "", F.lit(UNTITLED)).otherwise(found)


def paragraphs(page: Column) -> Column:
    """Stripped texts of the paragraphs that aren't blank, without dimmed ones, joined by line feeds."""
    clean = F.regexp_replace(page, DIMMED, "")
    texts = F.transform(F.regexp_extract_all(clean, F.lit(P), F.lit(1)), lambda x: stripped(plain(x)))
    return F.array_join(F.filter(texts, lambda x: x != ""), "\n")
