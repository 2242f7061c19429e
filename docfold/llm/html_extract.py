"""Main text of pages by wrappers, union-free regular expressions inferred for each host.

A page becomes a tree of block elements with text slots. The wrapper of a host is a tree as well: what its pages have in
common, aligned one after another. The children of an element are a sequence of groups; a child that only some pages
have is optional, one that follows itself is repeated, and where two pages disagree about the order, what lies between becomes
one repeated group of optional members. So each element has one child of a name, and a wrapper is as large as the
host's layouts are, however many pages it was made of. Slots remember how much of their text is
in links, which blocks all of their pages share, and three of these pages that differ, if there are so many: copies of a
page say nothing about what the host repeats.

The wrapper decides which slots are main text, and pages are read by it: not what is in a menu, footer, form and so on
by its element; not what is named as advert, comment and so on, unless the wrapper shows that the pages' own text is in
it. A name that is only similar takes away a block that is links, and in an article one that is links and the same on all pages. On
pages without an article, blocks of links go, and blocks that all pages share, unless these are nearly all of the page's text.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfold.llm.common import arrow_map, pieces_of, written
from docfold.llm.url_filter import host_and_path

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements, if nothing of another kind is open within them.
IMPLIED = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
DROPPED = frozenset("head nav aside footer form script style noscript template button select option textarea iframe object svg math dialog menu".split())
#: Parts of names of what isn't main text, parts that say nothing beside them, and elements whose names count in full.
DROPPED_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice notices newsletter subscribe subscription share sharing social related recommended comment comments commentlist respond reply replies disqus footer widget popup modal overlay toolbar pagination pager contentinfo complementary search alertdialog header masthead".split())
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus".split())
NEUTRAL = frozenset("0 area bar block body bottom box button buttons container count form global icons inner item items js left link links list main module outer page post posts primary right secondary section site slot text thread title top unit us wrap wrapper".split())
CONTAINERS = frozenset("article center dd details div dl dt figure fieldset header li main ol section table tbody td th tr ul".split())
ROOTS = frozenset(("article", "main"))
BATCH_BYTES = 8 << 20
#: Different pages that must share a block before it counts as the host's.
TOLD = 3


@lru_cache(65536)
def label_of(tag: str, attributes: str) -> str:
    """An element's name in paths: its tag and the words of its class, id and role, digits as 0."""
    if not attributes or tag in ("html", "body"):
        return tag
    names = {re.sub(r"[0-9]+", "0", n) for m in ATTRIBUTE.finditer(attributes) for n in re.split(r"[\s.]+", (m[2] or m[3] or m[4] or "").lower())}
    return ".".join([tag, *sorted(n for n in names if n)])


@lru_cache(65536)
def named(label: str) -> str:
    """What an element's name says: "comment" or "other" for what isn't main text, "like" for a name that only holds such a
    word, else "". A name of several parts says it if no part of it says something else."""
    tag, *names = label.split(".")
    found = ""
    for name in names:
        parts = set(re.split(r"[^a-z0-9]+", name)) - {""}
        if parts & DROPPED_NAMES:
            if tag in CONTAINERS and parts <= DROPPED_NAMES | NEUTRAL:
                return "comment" if parts & COMMENTS else "other"
            found = "like"
    return found


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


@lru_cache(65536)
def path_of(above: int, label: str) -> int:
    return _digest(str(above).encode(), label.encode("utf-8", "surrogatepass"))


def digest(text: str) -> int:
    return _digest(text.encode("utf-8", "surrogatepass"))


def blocks(page: str) -> Iterator[tuple]:
    """The stream of a page: ("+", label, path), ("/",) and ("#", path, text, its characters, those in links, whether in an
    article or main element). A path is the hash of the open block elements' labels."""
    stack: list[tuple[str, int, bool]] = []  # tag, path, in an article
    text: list[str] = []
    linked = depth_a = 0
    at = 0

    def flush():
        nonlocal text, linked
        if text:
            whole = "".join(text)
            out = " ".join(entities.unescape(whole).split())
            n, links = max(1, len(whole)), linked
            text, linked = [], 0
            if out:
                _, path, root = stack[-1] if stack else ("", 0, False)
                return ("#", path, out, n, links, root)
        return None

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text.append(page[at:stop])
            linked += (stop - at) * bool(depth_a)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                depth_a = max(0, depth_a + (-1 if closing else 1))
            continue
        if tag in ("img", "input", "link", "meta", "source", "track", "area", "param", "embed", "col", "base"):
            continue
        if (b := flush()) is not None:
            yield b
        depth_a = 0
        if closing:
            if any(tag == s[0] for s in stack):
                while stack:
                    name = stack.pop()[0]
                    yield ("/",)
                    if name == tag:
                        break
            continue
        ended = IMPLIED.get(tag, ("p",) if tag in ENDS_P else ())
        while stack and stack[-1][0] in ended:
            stack.pop()
            yield ("/",)
        if tag in VOID:
            continue
        _, path, root = stack[-1] if stack else ("", 0, False)
        label = label_of(tag, attributes)
        stack.append((tag, path_of(path, label), root or tag in ROOTS))
        yield ("+", label, stack[-1][1])
        if tag in RAW and not attributes.rstrip().endswith("/"):
            close = RAW[tag].search(page, at)
            at = close.end() if close else end
            stack.pop()
            yield ("/",)
    if (b := flush()) is not None:
        yield b


class Element:
    """An element of a wrapper. ``groups``: its children in order, [repeated, names], "#" for text; a repeated group of
    several names stands for any number of them. ``text``: characters of its slot, those in links, the digests and lengths of the blocks
    that are on all pages that have the slot, and the digests of up to ``TOLD`` pages that differ and have it."""

    __slots__ = ("pages", "groups", "kids", "text")

    def __init__(self, pages: int = 1) -> None:
        self.pages, self.groups, self.kids, self.text = pages, [], {}, None


def folded(names: list[str]) -> list[list]:
    """The groups of a sequence of names: what recurs closes a repeated group over all since it was there first."""
    groups: list[list] = []
    place: dict[str, int] = {}
    for x in names:
        at = place.get(x)
        if at is None:
            place[x] = len(groups)
            groups.append([False, [x]])
        else:
            _join(groups, at, len(groups) - 1, place)
    return groups


def _join(groups: list[list], low: int, high: int, place: dict[str, int]) -> None:
    groups[low : high + 1] = [[True, [x for g in groups[low : high + 1] for x in g[1]]]]
    for k in range(low, len(groups)):
        for x in groups[k][1]:
            place[x] = k


def aligned(a: list[list], b: list[list]) -> list[list]:
    """The groups that stand for both sequences of groups. What only one has is put in its place; where the order of the other
    contradicts, all between becomes one repeated group."""
    if a == b:
        return a
    out = [[again, list(names)] for again, names in a]
    place = {x: k for k, (_, names) in enumerate(out) for x in names}
    at = -1
    for again, names in b:
        met = [place[x] for x in names if x in place]
        new = [x for x in names if x not in place]
        if not met:
            at += 1
            out.insert(at, [again, new])
            for k in range(at, len(out)):
                for x in out[k][1]:
                    place[x] = k
            continue
        low, high = min(met), max(met)
        if low < at or high > low or (new and not again):
            low, high = min(low, at if at >= 0 and low < at else low), max(high, at if low < at else high)
            if high > low or new:
                _join(out, low, high, place)
        out[low][0] |= again or bool(new)
        for x in new:
            out[low][1].append(x)
            place[x] = low
        at = low
    return out


def page_wrapper(page: str) -> Element:
    """The wrapper of one page. Elements of one name within one parent count as one that is repeated."""
    top = Element()
    slots, words = [], hashlib.blake2b(digest_size=8)
    stack: list[tuple[Element, list[str]]] = [(top, [])]

    def close() -> None:
        own, names = stack.pop()
        groups = folded(names)
        own.groups = aligned(own.groups, groups) if own.groups else groups

    for event in blocks(page):
        if event[0] == "+":
            own, names = stack[-1]
            names.append(event[1])
            kid = own.kids.get(event[1])
            if kid is None:
                kid = own.kids[event[1]] = Element()
            stack.append((kid, []))
        elif event[0] == "/":
            close()
        else:
            own, names = stack[-1]
            names.append("#")
            if own.text is None:
                own.text = [0, 0, {}, []]
                slots.append(own)
            block = digest(event[2])
            words.update(block.to_bytes(8, "little", signed=True))
            own.text[0] += event[3]
            own.text[1] += event[4]
            own.text[2][block] = event[3]
    while stack:
        close()
    page_digest = int.from_bytes(words.digest(), "little", signed=True)
    for own in slots:
        own.text[3].append(page_digest)
    return top


def merged(a: Element, b: Element) -> Element:
    """The wrapper of both, made of ``a``."""
    todo = [(a, b)]
    while todo:
        a_, b_ = todo.pop()
        a_.pages += b_.pages
        a_.groups = aligned(a_.groups, b_.groups)
        if b_.text is not None:
            if a_.text is None:
                a_.text = b_.text
            else:
                x, y = a_.text, b_.text
                a_.text = [x[0] + y[0], x[1] + y[1], {k: v for k, v in x[2].items() if k in y[2]}, sorted({*x[3], *y[3]})[:TOLD]]
        for name, kid in b_.kids.items():
            own = a_.kids.get(name)
            if own is None:
                a_.kids[name] = kid
            else:
                todo.append((own, kid))
    return a


def dumped(top: Element) -> str:
    """As JSON: a row for each element, with its parent's number."""
    rows, todo = [], [(top, -1, "")]
    while todo:
        own, above, name = todo.pop()
        todo += [(kid, len(rows), n) for n, kid in own.kids.items()]
        rows.append([above, name, own.pages, own.groups, None if own.text is None else [*own.text[:2], list(own.text[2].items()), own.text[3]]])
    return json.dumps(rows)


def loaded(text: str) -> Element:
    got: list[Element] = []
    for above, name, pages, groups, slot in json.loads(text):
        own = Element(pages)
        own.groups, own.text = groups, None if slot is None else [slot[0], slot[1], {k: v for k, v in slot[2]}, slot[3]]
        got.append(own)
        if above >= 0:
            got[above].kids[name] = own
    return got[0]


def expression(top: Element) -> str:
    """The wrapper as a regular expression over tags and #."""
    todo: list = [top]
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        after: list = []
        for again, names in x.groups:
            wide = len(names) > 1
            after.append("(" * wide)
            for n in names:
                if n == "#":
                    after.append("#" + "?" * wide)
                    continue
                kid = x.kids[n]
                after += [f"<{n}>", kid, f"</{n}>" + "?" * (wide or kid.pages < x.pages)]
            after.append(")" * wide + "+" * again)
        todo += reversed(after)
    return "".join(out)


def _weight(own: Element) -> int:
    """Characters of a slot that are neither in links nor shared by all pages."""
    chars, links, common, told = own.text
    shared = sum(common.values()) * own.pages if len(told) >= TOLD else 0
    return max(0, chars - links - shared)


def decided(top: Element) -> tuple[list[int], list[int], list[int]]:
    """What a wrapper says about its pages: paths of slots that aren't main text; (hashed with their paths) blocks that all of
    several different pages share; paths of slots whose names make links of them."""
    order: list[tuple[Element, int, int, str, str, bool]] = []  # element, parent's place, path, tag, name, in an article
    todo = [(top, -1, 0, "", False)]
    while todo:
        own, above, path, label, root = todo.pop()
        tag = label.partition(".")[0]
        root = root or tag in ROOTS
        order.append((own, above, path, tag, label, root))
        todo += [(kid, len(order) - 1, path_of(path, n), n, root) for n, kid in own.kids.items()]
    weight = [0] * len(order)
    gone = [False] * len(order)  # by the kind of element
    for i, (_, above, _, tag, _, root) in enumerate(order):
        gone[i] = (above >= 0 and gone[above]) or tag in DROPPED or (tag == "header" and not root)
    for i in range(len(order) - 1, -1, -1):
        own, above = order[i][0], order[i][1]
        if not gone[i]:
            weight[i] += _weight(own) if own.text is not None else 0
            if above >= 0:
                weight[above] += weight[i]
    away, shared, linked = [], [], []
    like = [False] * len(order)
    for i, (own, above, path, _, label, root) in enumerate(order):
        if above >= 0:
            like[i] = like[above]
        kind = named(label)
        if kind in ("comment", "other"):
            # The pages' own text can't be most of what isn't main text.
            if kind == "comment" or 2 * weight[i] <= weight[0] or not weight[0]:
                gone[i] = True
            else:
                like[i] = True
        elif kind == "like":
            like[i] = True
        gone[i] = gone[i] or (above >= 0 and gone[above])
        if own.text is None:
            continue
        if gone[i]:
            away.append(path)
            continue
        if like[i]:
            linked.append(path)
        if len(own.text[3]) >= TOLD and (like[i] or not root):
            shared += [k ^ path for k in own.text[2]]
    return sorted(away), sorted(shared), sorted(linked)


def wrappers(pages: DataFrame, per_task: int = 64, held: int = 1000) -> DataFrame:
    """(host, wrapper, away, shared, linked): the wrapper of each host and what it decides, from all ``pages`` (host, html).

    Tasks align the pages of a host that they meet, with ``held`` hosts at a time; what they made is dealt to tasks of
    about ``per_task`` wrappers of one host until there is one."""

    def reading():
        def each(batch: pa.RecordBatch):
            hosts, made = [], []
            held_: dict[str, Element] = {}

            def flush() -> None:
                hosts.extend(held_)
                made.extend(dumped(w) for w in held_.values())
                held_.clear()

            for part in pieces_of(batch, BATCH_BYTES, "html"):
                for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    one = page_wrapper(page)
                    held_[host] = merged(held_[host], one) if host in held_ else one
                    if len(held_) >= held:
                        flush()
            flush()
            return {"host": hosts, "wrapper": made}

        return each

    def whole(g: pd.DataFrame) -> Element:
        out = None
        for w in sorted(g["wrapper"]):
            out = loaded(w) if out is None else merged(out, loaded(w))
        return out

    def some(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [g["host"].iloc[0]], "wrapper": [dumped(whole(g))]})

    def last(g: pd.DataFrame) -> pd.DataFrame:
        top = whole(g)
        away, shared, linked = decided(top)
        return pd.DataFrame({"host": [g["host"].iloc[0]], "wrapper": [expression(top)], "away": [away], "shared": [shared], "linked": [linked]})

    read = written(arrow_map(pages.select("host", "html"), reading, "host string, wrapper string"), "wrappers")
    while True:
        salts = written(read.groupBy("host").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts")), "salts")
        if salts.where("salts > 1").isEmpty():
            return read.groupBy("host").applyInPandas(last, "host string, wrapper string, away array<long>, shared array<long>, linked array<long>")
        dealt = read.join(salts, "host").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.col("salts")))
        read = written(dealt.groupBy("host", "salt").applyInPandas(some, "host string, wrapper string"), "wrappers")


def main_text(page: str, away: set[int], shared: set[int], linked: set[int]) -> str:
    """The blocks that the page's wrapper takes for main text: those in an article, or else all. Each block is judged by its own
    links. Without an article, what all pages share goes unless it is nearly all that the page has (three quarters), as it is of
    a page that was crawled again and again with another date."""
    got = [b for b in blocks(page) if b[0] == "#" and b[1] not in away]
    same = lambda b: bool(shared) and b[1] ^ digest(b[2]) in shared
    inside = [b[2] for b in got if b[5] and not (b[1] in linked and 2 * b[4] >= b[3] and same(b))]
    if inside:
        return "\n\n".join(inside)
    plain = [b for b in got if b[4] < (0.5 if b[1] in linked else 0.8) * b[3]]
    own = [b for b in plain if not same(b)]
    enough = 4 * sum(b[3] for b in own) >= sum(b[3] for b in plain)
    return "\n\n".join(b[2] for b in (own if enough else plain))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    A null html is the empty page, whose text is empty; a null url and one without a host share the empty
    host's wrapper; repeated rows are extracted each, and count as one page where the host's pages are told apart; pages of any
    length are read whole; other columns are ignored; no rows in, no rows out.
    Character references are decoded, white space in a block is one space, blocks are joined by two line
    ends; nothing else is changed or cut."""
    host, _ = host_and_path()
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = written(wrappers(rows), "decided").select("host", "away", "shared", "linked")

    def extracting():
        def each(batch: pa.RecordBatch):
            out = []
            for part in pieces_of(batch, BATCH_BYTES, "html"):
                for page, *decisions in zip(*(part.column(c).to_pylist() for c in ("html", "away", "shared", "linked")), strict=True):
                    out.append(main_text(page, *(frozenset(x or ()) for x in decisions)))
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": out, "n_chars": [len(t) for t in out]}

        return each

    id_type = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(rows.join(found, "host", "left").select("page_id", "url", "html", "away", "shared", "linked"), extracting, f"page_id {id_type}, url string, text string, n_chars long")
