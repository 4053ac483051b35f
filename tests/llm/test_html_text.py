"""Block extraction against hand-made pages and against the article element of the given pages."""

import html
import re

import pytest

from granary.llm.html_text import LABELLED, blocks, decide, extract, grow_tree, main_text, train

TREE = train()


def text_of(page):
    return main_text(page, TREE)


def test_tree_fits_its_table():
    assert all(decide(TREE, row[:-1]) == row[-1] for row in LABELLED)


def test_tree_of_one_label_or_equal_rows():
    import numpy as np

    assert grow_tree(np.zeros((3, 2)), np.ones(3)) == (1,)
    assert grow_tree(np.zeros((3, 2)), np.array([1.0, 0.0, 0.0])) == (0,)


PROSE = "The harbour was quiet and the long boats lay side by side until the evening tide came in over the sand."


def test_furniture_is_left_out():
    page = f"""<!doctype html><html><head><title>t &amp; u</title><style>p{{}}</style><script>var a="</p><p>x";</script></head>
    <body><header><a href=/>Home</a><h2>Site name</h2></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
    <div class="cookie-notice">We use cookies to make this site better for all of our dear readers today.</div>
    <article><header><h1>Quiet   harbour</h1></header><p>{PROSE}<p>{PROSE.upper()} &eacute;&#233;&lt;b&gt; <a href="x">see</a> more
    <aside>Read also: {PROSE}</aside><p>Short.</p><form><p>{PROSE}</p></form></article>
    <div id="sidebar"><p>{PROSE}</p></div><section class="comments"><p>{PROSE}</p></section>
    <div class="ad">{PROSE}</div><footer>&copy; site</footer></body></html>"""
    assert text_of(page) == "\n".join(["Quiet harbour", PROSE, PROSE.upper() + " éé<b> see more", "Short."])


def test_page_without_article_element():
    page = f"<html><body><div class=menu><a>a</a> <a>b</a></div><div><h2>On boats</h2><p>{PROSE}</p><p>{PROSE}</p><p>Short line.</p><p>{PROSE}</p></div><div class=footer>{PROSE}</div></body></html>"
    assert text_of(page) == "\n".join(["On boats", PROSE, PROSE, "Short line.", PROSE])


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="content-sidebar-wrap"><main>{}</main>{}</div>',
        '<div class="row has-sidebar">{}{}</div>',
        '<div id="page" class="site no-sidebar">{}{}</div>',
        '<form id="aspnetForm">{}{}</form>',
        '<section id="blog-posts-and-comments">{}{}</section>',
    ],
)
def test_wrappers_of_the_article_are_no_furniture(wrapper):
    article = f"<article><h1>On boats</h1><p>{PROSE}</p><p>He said no.</p></article>"
    beside = f'<div class="sidebar"><p>{PROSE}</p></div><section id="comments"><div class="comment"><p>{PROSE * 9}</p></div></section>'
    page = f"<html><body><nav><a href=1>Home</a></nav>{wrapper.format(article, beside)}<footer>Copyright</footer></body></html>"
    assert text_of(page) == "\n".join(["On boats", PROSE, "He said no."])


def test_long_comments_beside_a_short_article():
    page = f'<body><article><p>{PROSE}</p></article><section id="comments"><article><p>{PROSE * 30}</p></article></section></body>'
    assert text_of(page) == PROSE


def test_short_paragraphs_stay():
    assert text_of("<p>He said no.</p><p>She left.</p>") == "He said no.\nShe left."


@pytest.mark.parametrize("page", ["", "<", "<p", "plain", "<p>a<!-- b", "<script>x", "</p></div>", "<a" * 50, "<div>" * 3000 + "x", "&#xZZ; &amp &nosuch;"])
def test_broken_pages_end(page):
    assert isinstance(text_of(page), str)


def test_markup_without_structure():
    assert [b[0] for b in blocks("a<br>b <b>c</b>d<div>e</div>f<td>g")] == ["a b cd", "e", "f", "g"]


def brute(page):
    """The article element by plain expressions; right for the template of the given pages only."""
    article = re.search(r"(?s)<article>(.*?)(</article>|<footer|$)", page)[1]
    parts = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)


def test_query_on_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    got = extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(want)


def test_edge_rows(frame):
    long = "<article><p>" + f"{PROSE} " * 20_000 + "</article>"
    pages = frame([(1, None, None, "x"), (None, "u", "", None), (2, "u", long, "x"), (2, "u", long, "x")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars) for r in extract(pages).collect())
    assert got == [(0, 0), (1, 0), (2, len(PROSE + " ") * 20_000 - 1), (2, len(PROSE + " ") * 20_000 - 1)]
    assert extract(pages.limit(0)).collect() == []
    assert extract(pages).columns == ["page_id", "url", "text", "n_chars"]
