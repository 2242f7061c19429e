"""What runs inside tasks, against plain versions of it."""

import base64
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docfold.llm import bpe, exact_dedup, html_extract, minhash, packing, pretokens, substring, words

public = pytest.importorskip("public_tokenizers")
CLASSES = pretokens.class_table()
CHARS = "aslrevmtdZ' '\n\t\r  .,12½éß_\u00a0\u2028\u3000漢Ⅷ\u0301!😀"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(CHARS, max_size=25), min_size=1, max_size=5))
def test_pretokens_are_the_pattern(texts):
    import regex

    pattern = regex.compile(public.PATTERN)
    got, counts = pretokens.split(texts, CLASSES)
    want = [pattern.findall(t) for t in texts]
    assert [w.decode() for w in got.to_pylist()] == [w for ws in want for w in ws] and counts.tolist() == [len(w) for w in want]


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public.path("byte_bpe_50k.tiktoken"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_encoder_is_both_libraries(texts):
    import tiktoken
    from tokenizers import Tokenizer

    ranks = bpe.load_ranks(public.path("byte_bpe_50k.tiktoken"))
    ids, at = bpe.Encoder(CLASSES, lambda w: bpe.fold(w, ranks))(texts)
    own = [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    one = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert own == [one.encode_ordinary(t) for t in texts]
    two = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert own == [e.ids for e in two.encode_batch(texts, add_special_tokens=False)]
    file = packing.Vocabulary(open(public.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert file.ranks == ranks and file.added == ["<|endoftext|>"]
    assert base64.b64encode(b"".join(bpe._pieces(ranks)["bytes"].take(pa.array(ids)).to_pylist())) == base64.b64encode("".join(texts).encode())


@given(st.binary(max_size=400), st.integers(1, 50), st.integers(0, 400))
def test_fingerprints_compose(data, chunk, cut):
    a, b = data[:cut], data[cut:]
    whole = int.from_bytes(data, "big") % exact_dedup.PRIME
    assert exact_dedup.fingerprint(data, chunk) == whole == exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b))


@settings(deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.sampled_from([1, 5, 20, 200]))
def test_packing_is_valid_and_tight(lengths, groups):
    lengths = np.array(lengths, np.int64)
    sequence, offset = packing.pack(lengths, 64, groups)
    for s in set(sequence.tolist()):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist() and lengths[own].sum() <= 64
    if groups >= len(lengths) > 0:  # with fewer groups, lengths are rounded up
        assert len(set(sequence.tolist())) <= 1.7 * max(1, lengths.sum() / 64) + 1


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6.5, 1.2, 20_000).astype(int), 1, 2048)
    assert packing.pack(lengths)[0].max() + 1 <= 1.003 * lengths.sum() / 2048 + 1


@given(st.lists(st.one_of(st.none(), st.text(" \t\n\x0b\x1cab漢😀", max_size=20)), max_size=8))
def test_words(texts):
    starts, ends, at, raw = words.spans(pa.array(texts, pa.string()))
    want = [WORD.findall(t or "") for t in texts]
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [w for ws in want for w in ws]
    hashes = words.Hasher()(starts, ends, raw)
    assert len(set(hashes.tolist())) == len({w for ws in want for w in ws}) and np.diff(at).tolist() == [len(w) for w in want]


@pytest.mark.parametrize(("wa", "wb", "n"), [(49, 19, 5), (1, 1, 60), (3, 2, 100), (1000, 900, 3)])
def test_darts_estimate_weighted_similarity(wa, wb, n):
    rng = np.random.default_rng(wa)
    got = []
    for _ in range(30):
        e = np.concatenate([np.sort(rng.integers(0, 2**63, n)), np.sort(rng.integers(0, 2**63, 60))]).astype(np.uint64)
        w = np.concatenate([np.full(n, wa), np.ones(60, int), np.full(n, wb), np.ones(60, int)])
        s = minhash.signatures(np.repeat([0, 1], n + 60), np.concatenate([e, e]), w, 2, 400)
        got.append((s[0] == s[1]).mean())
    assert np.mean(got) == pytest.approx((min(wa, wb) * n + 60) / (max(wa, wb) * n + 60), abs=0.02)


def test_signature_depends_on_its_text_alone():
    texts = ["a b c d e f g h", None, "", "x", "one two three four five six seven " * 300]
    hasher = words.Hasher()
    sign = lambda ts: minhash.signatures(*minhash.elements(pa.array(ts, pa.string()), hasher)[:3], len(ts), 100)
    whole = sign(texts)
    assert all((sign([t])[0] == whole[i]).all() for i, t in enumerate(texts)) and not whole[1].any() and not whole[2].any() and whole[3].all()


def test_backward_search_finds_all_occurrences():
    rng = random.Random(1)
    segs = ["".join(rng.choices("abc", k=rng.randint(4, 12))) for _ in range(60)]
    window = 4
    ids, starts = np.array([rng.randint(0, 9) for _ in segs]), np.array([100 * i for i in range(len(segs))])
    row, place = substring.first_windows(pa.array([" ".join(s) for s in segs]), ids, starts, window)
    first: dict = {}
    places = [(i, starts[k] + p, k, p, s[p : p + window]) for k, (s, i) in enumerate(zip(segs, ids, strict=True)) for p in range(len(s) - window + 1)]
    for i, at, k, p, w in sorted(places):
        first.setdefault(w, (k, p))
    assert sorted(zip(row.tolist(), place.tolist(), strict=True)) == sorted(first.values())


def test_ranks_of_the_wavelet_matrix():
    x = np.random.default_rng(2).integers(0, 37, 1000)
    w = substring.Wavelet(x, 37)
    s, p = np.random.default_rng(3).integers(0, 37, 500), np.random.default_rng(4).integers(0, 1001, 500)
    assert w.rank(s, p).tolist() == [int((x[:b] == a).sum()) for a, b in zip(s, p, strict=True)]


@given(st.lists(st.booleans(), max_size=400))
def test_ranks_and_selects_of_bits(bits):
    b = substring.Bits(np.array(bits, bool))
    ones = [i for i, x in enumerate(bits) if x]
    assert b.rank(np.arange(len(bits) + 1)).tolist() == [sum(bits[:i]) for i in range(len(bits) + 1)]
    assert b.select(np.arange(len(ones) + 1)).tolist() == [*ones, len(bits)]


def test_matching_statistics_of_texts_that_the_index_has_not():
    """Streams that aren't part of the index: the intervals of those windows that it has."""
    rng = random.Random(4)
    make = lambda k: "".join(rng.choices("abcd", k=k))
    own, other, window = [make(30) for _ in range(20)], [make(25) for _ in range(30)], 3
    code = {c: i + 1 for i, c in enumerate("abcd")}
    flat = lambda segs: np.array([x for s in segs for x in (*(code[c] for c in s), 0)], np.int64)
    index = substring.Index(flat(own), window)
    begin, size = np.arange(len(other)) * 26, np.full(len(other), 25)
    got: dict = {}
    for who, place, interval in index.matches(flat(other), begin, size):
        for w, p, i in zip(who.tolist(), place.tolist(), interval.tolist(), strict=True):
            got[w, p] = i
    windows = {s[p : p + window] for s in own for p in range(len(s) - window + 1)}
    assert set(got) == {(w, p) for w, s in enumerate(other) for p in range(len(s) - window + 1) if s[p : p + window] in windows}
    by: dict = {}
    for (w, p), i in got.items():
        by.setdefault(i, set()).add(other[w][p : p + window])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({x for v in by.values() for x in v})


def test_shards_hold_whole_keys():
    rows = sorted((k, None if k % 3 == 0 else k, f"seg {k}", i, 5) for k in range(40) for i in range(k % 7 + 1))
    names = ["key", "h", "seg", "id", "start"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[a : a + 9]], pa.schema([("key", pa.int64()), ("h", pa.int64()), ("seg", pa.string()), ("id", pa.int64()), ("start", pa.int32())])) for a in range(0, len(rows), 9)]
    parts = [p.to_pylist() for p in substring.shards(iter(batches), 5)]
    keys = [{r["key"] for r in p} for p in parts]
    assert len(parts) > 3 and all(not a & b for a, b in itertools.combinations(keys, 2))
    left = [tuple(r[n] for n in names) for p in parts for r in p]
    assert left == [r for r in rows if r[1] is not None or r[3] == 0]


PAGE = """<html><head><title>T</title><script>var a="</p><article>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>m</a><li><a>n</a></ul></nav><div class="cookie-notice">We use</div><main><article><h1>Ti&amp;tle</h1>
<p>One <b>bo</b>ld<br>x &nbsp; y<p>Two &lt;3<!-- <p>no</p> --><aside>side</aside><div class="share">s</div><form>f<input></form></article>
<section id="comments"><article><p>c</p></article></section></main><footer>f</footer></body>"""


def wrapper_of(pages):
    out = html_extract.page_wrapper(pages[0])
    for p in pages[1:]:
        out = html_extract.merged(out, html_extract.loaded(html_extract.dumped(html_extract.page_wrapper(p))))
    return out


def texts_of(*pages):
    decisions = [set(x) for x in html_extract.decided(wrapper_of(pages))]
    return [html_extract.main_text(p, *decisions) for p in pages]


def test_main_text_of_a_page():
    assert texts_of(PAGE) == ["Ti&tle\n\nOne bold x y\n\nTwo <3"]
    assert html_extract.expression(wrapper_of(["<ul><li>a<li>b</ul><p>c<p>d"])) == "<ul>(<li>#</li>)+</ul><p>#</p>+".replace("(<li>#</li>)", "<li>#</li>")


def test_alignment_resolves_mismatches():
    f, al = html_extract.folded, html_extract.aligned
    assert f(list("abbc")) == [[False, ["a"]], [True, ["b"]], [False, ["c"]]]
    assert f(list("abcbd")) == [[False, ["a"]], [True, ["b", "c"]], [False, ["d"]]]
    a, b = f(list("ac")), f(list("abc"))
    assert al(a, b) == al(b, a) == f(list("abc"))  # optional: fewer pages have it
    assert al(f(list("abc")), f(list("acb"))) == [[False, ["a"]], [True, ["b", "c"]]]  # contradicting orders: a repeated group
    one = wrapper_of(["<div><h1>a</h1><p>b</p></div>", "<div><p>c</p><p>d</p><h2>e</h2></div>"])
    assert html_extract.expression(one) == "<div><h1>#</h1>?<p>#</p>+<h2>#</h2>?</div>"


@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=8), min_size=1, max_size=6))
def test_wrappers_accept_all_their_sequences(rows):
    """Each sequence goes through the groups in order, members of a repeated group in any."""
    groups = html_extract.folded(rows[0])
    for r in rows[1:]:
        groups = html_extract.aligned(groups, html_extract.folded(r))
    names = [x for _, g in groups for x in g]
    assert len(names) == len(set(names)) and set(names) == {x for r in rows for x in r}
    for r in rows:
        places = [next(k for k, (_, g) in enumerate(groups) if x in g) for x in r]
        assert places == sorted(places)
        assert all(groups[k][0] for k in set(places) if places.count(k) > 1)


def test_wrapper_decides_by_variation_links_and_weight():
    art = lambda i, extra: f"<article><h1>T{i}</h1><p>Body of page {i}.</p>{extra}</article>"
    # A name that only holds a word of the list decides nothing by itself.
    assert texts_of(art(1, '<div class="share-price"><p>The share price fell.</p></div><p class="search">How search works</p>')) == ["T1\n\nBody of page 1.\n\nThe share price fell.\n\nHow search works"]
    # Inside an article neither equal text nor links take such a block away, only both.
    assert texts_of(*(art(i, '<p class="site-notice-de">We moved</p>') for i in range(3))) == [f"T{i}\n\nBody of page {i}.\n\nWe moved" for i in range(3)]
    related = '<p class="related-x"><a href=a>one</a> <a href=b>two</a></p>'
    assert texts_of(art(1, related)) == ["T1\n\nBody of page 1.\n\none two"]
    assert texts_of(*(art(i, related) for i in range(3))) == [f"T{i}\n\nBody of page {i}." for i in range(3)]
    # An article's own repeated paragraph stays, and an odd page takes nothing from the others.
    same = [art(i, "<p>The same</p>") for i in range(4)]
    assert texts_of(*same, "<article><section><p>odd</p></section></article>") == [*(f"T{i}\n\nBody of page {i}.\n\nThe same" for i in range(4)), "odd"]
    # What is named as an advert but holds the pages' own text is it.
    assert texts_of('<body><div class="promo"><h1>A</h1><p>All of the long text is here</p></div><p>x</p>') == ["A\n\nAll of the long text is here\n\nx"]
    assert texts_of('<div class="ad-box">buy</div><article><p>Long enough to be the text</p><div id="comments"><p>first of very many comments, longer than all else</p></div></article>') == ["Long enough to be the text"]


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    long_ = "<article>" + "".join(f"<p>Paragraph {i} of many</p>" for i in range(20_000)) + "</article>"
    assert texts_of(deep, deep, long_) == ["text", "text", "\n\n".join(f"Paragraph {i} of many" for i in range(20_000))]
