import html
import re
import time

import pytest

from pagelens.llm.html_text import extract_main_text, main_text
from pagelens.llm.queries import LLM_QUERIES

LONG = "Some long sentence of the article that goes on and on, with commas and a few more words."
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{}}</style><script>var a="</p><article>";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a></header><nav><ul><li><a href=/x>Menu</a><li><a>Two</a></ul></nav>
<div class="cookie-notice"><p>{LONG}</p></div><div id='ad-1'>Buy this now, it is cheap and good and has a very long text.</div>
<article><h1>Title&nbsp;of   it</h1><!-- <p>no</p> --><p>{LONG}<p>Short.<p><b>Bold <i>it</b> rest<br>next &lt;tag&gt; &#x41;&copy
<div class="advert">Advert inside</div><ul><li>one<li>two <a href="u">link</a></ul><form>Name <input></form>
<table><tr><td>a<td>b<tr><td>c</table><script>track()</script><section class="comments"><p>{LONG}</p><p>First!</p></section>
<p>a < b & c</article><aside><p>{LONG}</p></aside><footer>&copy; us</footer></body></html>"""


def test_parts_of_a_page():
    assert main_text(PAGE).split("\n\n") == [
        "Title of it", LONG, "Short.", "Bold it rest next <tag> A©", "one", "two link", "a b", "c", "a < b & c",
    ]


@pytest.mark.parametrize(("source", "want"), [
    ("", ""), ("   ", ""), ("plain text", "plain text"), ("<p>", ""), ("<p>one<p>two", "one\n\ntwo"), ("<script>x", ""),
    ("<!-- open", ""), ("a <", "a <"), ("<a href='", "<a href='"), ("<p>x</p", "x</p"), ("&amp;lt;", "&lt;"),
    ("<div><p>one</p></div></div></p><p>two", "one\n\ntwo"), ("<title>only", ""), ("<nav>menu</nav>", ""),
    ("<head><title>t</title><p>body starts", "body starts"), ("<P CLASS=Sidebar>s</P><P>text", "text"),
    ("<main><div><p>" + LONG + "</p></div><div><p>tail</p></div></main><div>" + LONG + "</div>", LONG + "\n\ntail"),
])
def test_small_pages(source, want):
    assert main_text(source) == want


@pytest.mark.parametrize("attributes", [
    'style="overflow:hidden"', "style='visibility: hidden'", 'aria-hidden="false"', 'title="the hidden valley"', "data-hidden=1",
    'data-id="comments"', 'data-x="a" data-role="banner"', "title=\"id='menu'\"", "data-url=/x?id=menu", "title='a' class='page'/",
    'class="page" class="sidebar"', '"hidden"',
])
def test_only_real_attributes_count(attributes):
    for inner in (f"<article><h1>Head</h1><p>{LONG}</p></article>", f"<div><p>{LONG}</p><p>{LONG}</p></div>"):
        want = main_text(f"<body><div>{inner}</div></body>")
        assert LONG in want and main_text(f"<body><div {attributes}>{inner}</div></body>") == want


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "hidden/", "x=1 hidden", "role=banner", "a='1'class=sidebar", "id = 'menu'"])
def test_real_attributes_cut(attributes):
    assert main_text(f"<div><p>{LONG}</p></div><div {attributes}><p>{LONG} two</p></div>") == LONG


def test_forms_and_hinted_elements_that_wrap_the_page():
    bodies = (f"<article><h1>Head</h1><p>{LONG}</p></article>", f"<div><h1>Head</h1><p>{LONG}</p></div>", f"<div><p>{LONG}</p><p>{LONG}</p></div>")
    for inner in bodies:
        page = f"<nav><a href=/>Menu</a></nav>{inner}<form>Name <input></form><footer>us</footer>"
        want = main_text(page)
        assert LONG in want and "Name" not in want
        for wrapper in ("form id=aspnetForm", "div role=form", "div class=has-sidebar"):
            assert main_text(f"<body><{wrapper}>{page.replace('form>', 'fieldset role=form>')}</{wrapper.split()[0]}></body>") == want, wrapper
    assert main_text(f"<div><p>{LONG}</p><form>Name <input></form></div>") == LONG


def test_sections_beside_the_densest_one():
    body = "".join(f"<div><p>{LONG} {i}</p><p>{LONG}</p></div>" for i in range(3))
    links = "<div>" + "".join(f"<a href='{i}'>link {i}</a> " for i in range(40)) + "</div>"
    got = main_text(f"<body><div>{links}<div><h1>Head</h1>{body}</div></div>")
    assert got.startswith("Head") and got.count(LONG) == 6 and "link 3" not in got


def test_long_and_hostile_pages_take_linear_time():
    start = time.time()
    for source in ("<div>" * 50_000 + "deep", "<" * 300_000, '<a b="' * 50_000, "<!--" * 50_000, "<p>word " * 50_000,
                   "<script>" * 30_000, "&" * 300_000, "</p>" * 100_000, "<b>" * 3_000 + "</i>" * 3_000):
        main_text(source)
    assert time.time() - start < 60


@pytest.mark.parametrize("source", [
    "<b>" * 100_000 + "</i>" * 100_000, "<b>" * 100_000 + "<h2>" * 100_000, "<header>" * 100_000, "<li><b>" * 100_000, "<td><i>" * 100_000 + "</a>" * 100_000,
])
def test_ends_of_what_is_not_open_take_linear_time(source):
    start = time.time()
    main_text(source)
    assert time.time() - start < 5


def test_blocks_beside_the_densest_node_stay():
    dense = f"<div><p>{LONG}</p><p>{LONG} two</p><p>{LONG} three</p></div>"
    blocks = ["Title", LONG, f"{LONG} two", f"{LONG} three", "Tail of the article.", "End."]
    page = f"<body><nav><a href=/>Home</a></nav><div><h1>Title</h1></div>{dense}<section>Tail of the article.</section><div><p>End.</p></div><footer>us</footer>"
    assert main_text(page).split("\n\n") == blocks
    assert main_text(page.replace("<body>", "<body><div>").replace("<h1>", "<h3>").replace("</h1>", "</h3>")).split("\n\n") == blocks


@pytest.mark.parametrize(("attributes", "kept"), [
    ("id=related-work", True), ("class=skip-lines", True), ("class='share-price chart'", True), ("class=related", True), ("class=has-sidebar", True),
    ("id=comment-on-method", True), ("class=advert", False), ("class=comments", False), ("id=ad-1", False), ("class=cookie-notice", False),
    ("class='box newsletter-form'", False), ("class=reader-comments", False), ("id=site-footer", False),
])
def test_names_inside_an_article(attributes, kept):
    part = "Part of the text or not, which its name tells."
    for tag in ("section", "div", "p"):
        got = main_text(f"<article><h1>Head</h1><p>{LONG}</p><{tag} {attributes}>{part}</{tag}><p>End.</p></article>")
        assert got.split("\n\n") == ["Head", LONG, *([part] if kept else []), "End."]
    links = "<ul class=related>" + "".join(f"<li><a href={i}>Other article {i}</a>" for i in range(5)) + "</ul>"
    assert "Other" not in main_text(f"<article><p>{LONG}</p>{links}<p>End.</p></article>")


def plain_article(source):
    """The test pages hold one article; their blocks begin with a tag."""
    inner = source.split("<article>")[1].split("</article>")[0]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    return "\n\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"</?b>|<br>", "", b)).split())))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = LLM_QUERIES["op6_html_extraction"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == plain_article(pages[r.page_id].html)


def test_awkward_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", PAGE, "x"), (1, "u", "", "x"), (1, "u", "", "x"), (2, "", "word " * 200_000, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(frame).collect()
    assert sorted(r.n_chars for r in got) == sorted([0, len(main_text(PAGE)), 0, 0, 999_999])
    assert extract_main_text(frame.limit(0)).count() == 0
