import itertools
import random
import time

import pytest

from pairlab.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head>
<body class="home"><nav><ul><li><a href=/a>Home</a><li><a href=/b>Other page</a></ul></nav><!-- <p>no</p> -->
<div id="cookie-notice"><p>We use cookies to improve your visit, please accept them all.</p></div>
<article><header><h1>The  title &amp; more</h1></header><p><b>First para<i>graph</i>,
 with an&nbsp;entity &#8212; and <a href="x">a link</a>.<br><p>Ti.</p><ul><li>one item<li>two</ul>
<form><p>Name: <input></p><button>Send</button></form><aside>Related: things</aside>
<blockquote>Quoted 1 < 2 words</blockquote><section class="comments"><p>I liked this long article very much, thanks for it.</p></section></article>
<div class="sidebar"><p>Popular posts of this week that you may like.</p></div><div style="display: none">hidden words</div>
<footer>&copy; site</footer></body></html>"""


def test_a_page():
    assert html_text.main_text(PAGE).split("\n") == [
        "The title & more",
        "First paragraph, with an entity — and a link.",
        "Ti.",
        "one item",
        "two",
        "Quoted 1 < 2 words",
    ]


def test_without_an_article_element():
    page = (
        '<div id="menu"><a>Home</a> <a>About</a></div><div><h1>Title here</h1><p>Some long text that goes on for'
        " quite a while, with commas.</p><p>Short one.</p><p>Another long paragraph that has many words in it.</p>"
        '</div><div class="footer">All rights reserved</div>'
    )
    assert html_text.main_text(page).split("\n")[0::2] == ["Title here", "Short one."]


@pytest.mark.parametrize("head", ["<head>", "<html><head><meta charset=utf-8>", "<head><noscript><link></noscript><script>a<b</script>"])
@pytest.mark.parametrize("body", ["", "<body>", "</head>", "</head><body class=x>"])
def test_omitted_head_and_body_tags(head, body):
    page = f"{head}<title>x</title>{body}<article><p>The text of the page, which is long enough.</p></article>"
    assert html_text.main_text(page) == "The text of the page, which is long enough."
    assert html_text.main_text(f"{head}<title>x</title>{body}Bare text of a page, long enough to stay.").startswith("Bare")


LAYOUT = "<header{}><h1>A title</h1></header><p>The text of the page, which is long enough to be one.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content-sidebar-wrap"><article>{LAYOUT.format("")}</article></div>',
        f'<div id=page class="has-sidebar"><article>{LAYOUT.format("")}</article></div>',
        f'<div class="sidebar right"><main>{LAYOUT.format("")}</main></div>',
        f'<div class="sidebar"><article class="comments">{LAYOUT.format("")}</article></div>',
        f'<article class="post comments-open">{LAYOUT.format(" class=entry-header")}</article>',
        f'<article>{LAYOUT.format(" class=header id=masthead")}</article>',
    ],
)
def test_names_of_layouts_around_an_article(page):
    assert html_text.main_text(page).split("\n") == ["A title", "The text of the page, which is long enough to be one."]


@pytest.mark.parametrize("name", ["cookie-notice", "site-footer", "main_nav", "widget-area", "x sidebar2", "comments"])
def test_names_of_boilerplate(name):
    noise = "Noise that is written out as one long sentence, with a full stop."
    page = f'<article>{LAYOUT.format("")}</article><div class="{name}"><article><p>{noise}</p></article></div>'
    assert noise not in html_text.main_text(page)


def cost(scores, edges, chosen):
    out = sum(s for s, c in zip(scores, chosen) if s > 0 and not c)
    out -= sum(s for s, c in zip(scores, chosen) if s < 0 and c)
    return out + sum(w for a, b, w in edges if chosen[a] != chosen[b])


@pytest.mark.parametrize("seed", range(40))
def test_the_cut_is_minimal(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    scores = [rng.uniform(-4, 4) for _ in range(n)]
    edges = [(a, b, rng.uniform(0, 3)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
    got = cost(scores, edges, html_text.content_side(scores, edges))
    best = min(cost(scores, edges, c) for c in itertools.product((False, True), repeat=n))
    assert got == pytest.approx(best)


@pytest.mark.parametrize("text", [None, "", "   ", "<", "<p", "</", "<!--", "<p>&amp", '<a href="', "<script>x", "a<b>c</i></b>"])
def test_broken_pages(text):
    assert isinstance(html_text.main_text(text), str)


def test_long_pages_take_linear_time():
    for text in ("<p>" * 40000 + "x", "<div>a" * 20000, "<" * 100000, "<!--" * 50000, '<a href="' * 20000, "<p>Word. " * 20000):
        start = time.time()
        html_text.main_text(text)
        assert time.time() - start < 10


def test_rows(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None), (None, "v", "", "t"), (3, "w", "<p>x</p>" * 3, "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {(r.page_id, r.url, r.text) for r in got if r.page_id != 3} == {
        (1, "u", html_text.main_text(PAGE)), (2, None, ""), (None, "v", "")
    }
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["user-comments", "reader-comment", "ad-slot", "post_comments", "google-ad", "ad-container unit"])
def test_a_telling_part_names_the_whole(name):
    page = f"<body><article>{LAYOUT.format('')}</article><div class='{name}'><p>Nobody asked for this sentence, dear reader.</p></div></body>"
    assert "Nobody asked" not in html_text.main_text(page) and html_text.main_text(page)


@pytest.mark.parametrize("name", ["has-comments", "no-ads", "with-sidebar", "comments-open", "post"])
def test_states_are_no_names(name):
    page = f"<body><div class='{name}'><div>{LAYOUT.format('')}</div></div></body>"
    assert html_text.main_text(page) == html_text.main_text(f"<body><div>{LAYOUT.format('')}</div></body>") != ""


def test_short_bare_text_and_legal_sections():
    bare = "A short page text that stands straight in the body alone"
    assert html_text.main_text(f"<html><body>{bare}</body></html>") == bare
    assert html_text.main_text(bare) == bare
    page = f"<article>{LAYOUT.format('')}<section class='legal'><p>The law of the sea has four parts, as told here.</p></section></article>"
    assert "law of the sea" in html_text.main_text(page)
