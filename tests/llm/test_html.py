"""Wrappers and main text: golden pages, brute force for the alignment, and pages that only the wrapper can tell."""

import random

import pytest

from palimpsest.llm import html
from palimpsest.llm import queries as qs
from palimpsest.llm.common import read

DIR = "/root/testdata/sf0.001"


def page(i, extra=""):
    return f"""<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>
<header>Site</header><div class="ad">Buy</div><article><h1>Title &amp; {i}</h1><p><b>One  two<br>three {i}<p>Four</p>{extra}</article>
<div id="comments"><p>nice</p></div><aside>side</aside><form><p>mail</p></form><footer>&copy; me</footer></body></html>"""


def test_the_article_without_the_rest():
    assert html.main_text(page(1)) == "Title & 1\nOne two three 1\nFour"
    assert html.main_text(page(1, '<div class="cookie-notice">x</div><div class="adverb">kept</div>')).endswith("Four\nkept")


@pytest.mark.parametrize("odd", [None, "", "   ", "<", "a < b", "<p", "<!-- open", '<p title="open>text', "<script>never ends", "</p></p>", "&am", "\x00", "<!-->a", "</article>", "<svg>" * 50])
def test_odd_pages_do_not_break(odd):
    assert isinstance(html.main_text(odd), str)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<article class="post has-comments"><p>a</p></article>', "a"),
        ('<main class="no-sidebar"><p>a</main>', "a"),
        ('<article id="share-2"><p>a', "a"),
        ('<div class="form-factor"><p>a', "a"),
        ('<p title="' + "x" * 4100 + 'LEAK ">t', "t"),
        ("<div>a<noscript>z</div><p>b", "a\nb"),
        ("<svg><svg>a</svg>LEAK</svg>b", "b"),
        ("<p>a<iframe>b<p>c", "a\nc"),
        ("<div>a<template>z</div>b", "a\nb"),
        ('<p>One <span class="ad">x</span> two', "One two"),
        ('<p>One <button>x</button> two <svg><title>y</title></svg>three', "One two three"),
        ("<article><header><h1>T</h1></header><p>x</article><article class=comment><p>no</article>", "T\nx"),
        ('<div class="post-comments"><p>no</div><div class="site-footer">no</div><div class="headerless">yes</div>', "yes"),
        ("<p>&lt;b&gt; &amp;amp; &#65;&nbsp; x</p>", "<b> &amp; A x"),
        ("<div data-class='ad' hidden-x>kept</div><div hidden>no</div><div aria-hidden=true>no</div>", "kept"),
        ("<b><div>a</div>x</b>", "a\nx"),
    ],
)
def test_golden_pages(source, text):
    assert html.main_text(source) == text


def story(i, rng, more=""):
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    own = [words(8) for _ in range(1 + i % 3)]
    links = "".join(f'<li><a href="/{k}">{words(2)}</a></li>' for k in range(3))
    return own, f"<html><body><div class=top>The daily</div><ul class=more>{links}</ul><div class=x>{''.join(f'<p>{w}</p>' for w in own)}{more}</div><div class=z>All rights</div></body></html>"


def test_a_wrapper_has_slots_repeats_and_options():
    rng = random.Random(1)
    pages = [story(i, rng, "<h2>sub</h2>" if i % 2 else "") for i in range(6)]
    w = html.infer([p for _, p in pages])
    assert "(<p>#TEXT</p>)+" in html.expression(w.items) and "?" in html.expression(w.items) and "<div.top>The daily</div.top>" in html.expression(w.items)
    for own, p in pages:
        want = own + (["sub"] if "<h2>" in p else [])
        # what never changes is no content, nor is a list of links; alone the page can't tell
        assert html.main_text(p, html.Wrapper.load(w.dump())).split("\n") == want
        assert html.main_text(p).split("\n") == ["The daily", *want, "All rights"]
    assert not html.infer([pages[0][1]]).constants


def test_copies_of_a_page_make_nothing_constant():
    rng = random.Random(2)
    own, p = story(1, rng)
    w = html.infer([p.replace("All rights", f"All rights {i}") for i in range(6)])
    assert html.main_text(p, w).split("\n") == ["The daily", *own, "All rights"]


def test_a_text_of_its_own_in_a_constant_slot_is_kept():
    rng = random.Random(3)
    w = html.infer([story(i, rng)[1] for i in range(6)])
    own, p = story(2, rng)
    assert html.main_text(p.replace("The daily", "Extra!"), w).split("\n") == ["Extra!", *own]


@pytest.mark.parametrize("bits", [1 << 29, 8])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(html, "ALIGN_BITS", bits)
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html.common(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(i < k and j < l for (i, j), (k, l) in zip(got, got[1:]))


def test_long_pages_fold_and_align():
    p = "<article>" + "<p>a</p><div><h2>b</h2><p>c</p></div>" * 20_000 + "</article>"
    assert html.main_text(p) == "\n".join(["a", "b", "c"] * 20_000)


def table(spark):
    rng, rows, want = random.Random(5), [], {}
    for i in range(40):
        own, p = story(i, rng)
        rows.append((i, f"http://h{i % 2}.net/{i}", p, "clash"))
        want[i] = "\n".join(own)
    rows += [(100, "http://alone.net/", rows[0][2], None), (101, None, "<p>no url</p>", None), (102, "http://h0.net/", None, None), (103, "http://h0.net/", "", None), (104, "http://mute.net/", "<script>x</script>", None), (0, *rows[0][1:])]
    want |= {100: html.main_text(rows[0][2]), 101: "no url", 102: "", 103: "", 104: ""}
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string"), want


def test_unmarked_pages_change_with_the_wrapper(spark):
    """Pages of two hosts without article or main: the rows come out right only through the wrappers, by either way of handing them out."""
    df, want = table(spark)
    wrappers = html.learn(df)
    assert {r.host: r.pages for r in wrappers.collect()} == {"h0.net": 21, "h1.net": 20, "alone.net": 1}
    for options in ({}, {"handed_bytes": 0}, {"handed_bytes": 0, "hot_pages": 3}):
        got = html.extract(df, wrappers, **options).collect()
        assert len(got) == df.count() and {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    none = html.extract(df, wrappers.limit(0)).collect()
    assert {r.page_id: r.text for r in none}[1] == html.main_text(df.where("page_id = 1").first().html) != want[1]


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "http://a/", "<article><p>x</p></article>", 5), (1, "http://a/", "<article><p>x</p></article>", 5), (2, None, None, 5), (3, "", "", None)], "page_id long, url string, html string, text long")
    got = html.extract(df, html.learn(df)).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "x", 1), (1, "x", 1), (2, "", 0), (3, "", 0)]
    assert html.extract(df.limit(0), html.learn(df.limit(0))).count() == 0


def plain_article(source):
    """The article element's blocks by a plain scan, right for well-formed test pages."""
    import html as escapes
    import re

    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inner)))
    return "\n".join(t for t in (" ".join(escapes.unescape(x).split()) for x in parts) if t)


def test_the_query_against_a_plain_scan(spark):
    pages = {r.page_id: r for r in read(spark, DIR, "pages").collect()}
    got = qs.op1_html_extraction(spark, DIR).collect()
    assert {r.page_id: r.text for r in got} == {i: plain_article(r.html) for i, r in pages.items()}
    assert len(got) == len(pages) and all(r.url == pages[r.page_id].url for r in got)
