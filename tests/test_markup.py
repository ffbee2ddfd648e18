import html
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagelens.functions.markup import source_set
from pagelens.sources.pages import records_from_pages

PAGE = "https://site.test/x/y"


def media_of(spark, source):
    row = records_from_pages(spark.createDataFrame([(1, PAGE, source)], "page_id long, url string, html string")).first()
    return [[(m.src, m.alt, m.width) for m in bucket] for bucket in (row.images, row.videos, row.audios)]


SITE = "https://site.test"


LINKS = [
    ('<a title="a > b" href="/z">z</a>', [(SITE + "/z", "z", "a > b")]),
    ('<a data-x=" href=/bad" href="/good">g</a>', [(SITE + "/good", "g", "")]),
    ('<!-- <a href="/dead">x</a> --><a href=/live>l</a>', [(SITE + "/live", "l", "")]),
    ("<script>var s = '<a href=\"/dead\">x</a>'</script><a href=/live>l</a>", [(SITE + "/live", "l", "")]),
    ("<SCRIPT type='a>b'>'<a href=/dead>'</sCript ><a href=/live>l</a>", [(SITE + "/live", "l", "")]),
    ("<style>a > b{}</style><a href=/live>l</a><script>never closed <a href=/dead>", [(SITE + "/live", "l", "")]),
    ("<base href='/b/'><a href=c>c</a>", [(SITE + "/b/c", "c", "")]),
    ("<base target=x><base href='https://other.test/q/'><base href=/no/><a href=c>c</a>", [("https://other.test/q/c", "c", "")]),
    ("<base href='mailto:x'><a href=c>c</a>", [(SITE + "/x/c", "c", "")]),
    ("<area href=/a alt='An area'><area alt=none>", [(SITE + "/a", "An area", "")]),
    ("<a href=/one>one<a href=/two>two</a><a href=/3>3<area href=/4 alt=4>", [(SITE + "/one", "one", ""), (SITE + "/two", "two", ""), (SITE + "/3", "3", ""), (SITE + "/4", "4", "")]),
    ("<a href=/x href=/y>x</a><A HREF = '/z' >z</A>", [(SITE + "/x", "x", ""), (SITE + "/z", "z", "")]),
    ("<a href=/x>one <!-- </a> --><b title='</a>'>two</b> <script>'</a>'</script>three</a>", [(SITE + "/x", "one   two   three", "")]),
    ("<!--><a href=/x>x</a><!-- --!><a href=/y>y</a>", [(SITE + "/x", "x", ""), (SITE + "/y", "y", "")]),
    ("<a href=/x>1 < 2</a><abbr href=/no>n</abbr><a\nhref=/y>y</a\n>", [(SITE + "/x", "1 < 2", ""), (SITE + "/y", "y", "")]),
    ("<i title='<a href=/dead>'>i</i><![CDATA[<a href=/cdata>]]>", []),
    ("<a title=it's href=/its>its</a>", [(SITE + "/its", "its", "it's")]),
    ("", []),
    (None, []),
]


def test_links(spark):
    rows = [(i, PAGE, source) for i, (source, _) in enumerate(LINKS)]
    found = {r.request_id: r for r in records_from_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (source, want) in enumerate(LINKS):
        row = found[str(i)]
        assert [(x.href, x.text, x.title) for x in row.internal_links + row.external_links] == want, source


def test_media(spark):
    images, videos, audios = media_of(spark, (
        '<img alt="see src=foo" src="/x.jpg"><!-- <img src=/dead> --><img data-src=/lazy.png><img src=/a.png data-src=/b.png width=30px>'
        "<img srcset='/s1.png 480w,/s2.png 2x, /s3,3.png'><video poster=/p.png src=/v.mp4></video><picture><source type=image/webp srcset=/w.webp></picture>"
        "<video><source src=/v2.mp4></video><audio src=/a.mp3></audio><source src=/b.ogg type=AUDIO/ogg>"
    ))
    assert images == [
        ("/x.jpg", "see src=foo", None), ("/lazy.png", None, None), ("/a.png", None, 30.0), ("/s1.png", None, 480.0), ("/s2.png", None, None),
        ("/s3,3.png", None, None), ("/p.png", None, None), ("/w.webp", None, None),
    ]
    assert [v[0] for v in videos] == ["/v.mp4", "/v2.mp4"] and [a[0] for a in audios] == ["/a.mp3", "/b.ogg"]
    assert media_of(spark, "<base href=//cdn.test/i/><img src=x.png>")[0] == [("https://cdn.test/i/x.png", None, None)]


@pytest.mark.parametrize(("value", "want"), [
    ("", []), ("a.png", ["a.png"]), (" a.png 1x , b.png 2x,", ["a.png", "b.png"]), ("a.png,b.png 2x", ["a.png,b.png"]),
    ("a.png, b.png 3w", ["a.png", "b.png"]), ("data:image/png;base64,AA== 1x, c.png", ["data:image/png;base64,AA==", "c.png"]), (" , ", []),
])
def test_source_sets(evaluate, value, want):
    found = evaluate([(value,)], "v string", source_set(F.col("v")))[0]
    assert [c["src"] for c in found] == want


class Plain(HTMLParser):
    """Start tags by the standard library's parser."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.found = []
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(reversed(attrs)).get("href"):
            self.found.append(dict(reversed(attrs))["href"])


def test_links_equal_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", F.lit(PAGE).alias("url"), "html")
    rows = records_from_pages(pages, ("internal_links", "external_links", "html")).collect()
    for row in rows:
        got = sorted(x.href for x in row.internal_links + row.external_links)
        assert len(got) == len(Plain(row.html).found) and all(html.unescape(g).startswith(SITE) for g in got)


HOSTILE = [
    "<a " * 350_000, "<a b='" * 170_000 + ">", "<a b=\"'" * 150_000 + ">", "<!--" * 250_000, "<script>" * 120_000, "<a href=/x>" * 90_000 + "</b>",
    "<" * 1_000_000, "<a x=" + "=" * 1_000_000 + ">", "<a " + "b='c' " * 160_000 + "href=/x>x</a>", "<a href=/x>" + "<b>" * 330_000, "<a href=/x>" + "< " * 500_000 + "</a>",
    "<textarea><a href=/x></textare>" * 30_000, "<a href='" * 50_000 + "\">" * 50_000,
]


def test_a_megabyte_of_hostile_markup_takes_little_time(spark):
    rows = [(i, PAGE, source) for i, source in enumerate(HOSTILE)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    start = time.time()
    counted = records_from_pages(frame, ("images", "internal_links", "external_links")).select(F.size("images"), F.size("internal_links"))
    assert len(counted.collect()) == len(HOSTILE)
    assert time.time() - start < 60
