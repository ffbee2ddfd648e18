import json

import pytest
from pyspark.sql import functions as F

from pagelens.operators import quality, views
from pagelens.sources import payloads as P
from pagelens.sources import records as R
from pagelens.sources.pages import records_from_pages
from pagelens.sources.requests import select_targets
from pagelens.sources.sinks import write_view

SITE = "https://site.test"


@pytest.fixture
def records(spark):
    """Crawl records of payloads given as Python values or raw text."""

    def build(*payloads, view="bulk", targets=(SITE,), **options):
        rows = [
            (str(i), list(targets), p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)
        ]
        frame = spark.createDataFrame(rows, "request_id string, target_urls array<string>, raw string")
        return P.crawl_records(P.read_payloads(frame), view, **options)

    return build


def test_targets_and_rejects(spark):
    rows = [
        ("a", [SITE + "/1", "ftp://x", SITE + "/1", None], SITE + "/2"),
        ("b", None, SITE), ("c", [], "nope"), ("d", None, None), ("e", [SITE], SITE),
    ]
    targets, rejects = select_targets(spark.createDataFrame(rows, "request_id string, urls array<string>, url string"))
    assert sorted((r.request_id, r.position, r.target_url) for r in targets.collect()) == [
        ("a", 0, SITE + "/1"), ("a", 1, SITE + "/2"), ("b", 0, SITE), ("e", 0, SITE)
    ]
    assert sorted((r.request_id, r.status) for r in rejects.collect()) == [("c", 400), ("d", 400)]


def test_envelopes(records):
    one, two = {"url": "u1"}, {"url": "u2"}
    found = records(
        one, [one, two], [[one, two], 5, None, "x", two], {"results": [one]}, {"result": {"results": [[two]]}},
        {"results": None, "result": None, "url": "own"}, {"results": "text"}, {"results": 0, "url": "lost"}, [[[one]]], 7, "", None,
        {"results": {"result": {"results": {"result": {"results": {"result": [one]}}}}}},
    )
    urls = {}
    for r in found.orderBy("request_id", "record_pos").collect():
        urls.setdefault(int(r.request_id), []).append(r.url)
    assert urls == {
        0: ["u1"], 1: ["u1", "u2"], 2: ["u1", "u2", "u2"], 3: ["u1"], 4: ["u2"], 5: ["own"], 10: [None], 11: [None], 12: ["u1"]
    }


def test_unreadable_payload_is_kept_whole(spark, records):
    raw = "{broken" + "x" * 9000
    row = P.read_payloads(
        spark.createDataFrame([("0", [SITE], raw)], "request_id string, target_urls array<string>, raw string")
    ).first()
    assert row.corrupt_text == raw
    only = records(raw).collect()
    assert [(r.url, r.fallback_url, r.success) for r in only] == [(None, SITE, False)]
    assert records(raw, view="html").count() == 0


def test_repeated_key_takes_the_last_value(records):
    assert records('{"url":"a","url":"b"}').first().url == "b"


def test_field_typing(records):
    found = records(
        {"url": 5, "success": "true", "status_code": "404", "html": 7, "markdown": {"raw_markdown": "x"}, "metadata": [1]},
        {"url": "", "redirected_url": "r", "success": True, "status_code": 200, "markdown": "m", "metadata": {"a": {"b": 1}}},
        view="bulk", fields=("html", "markdown_text", "markdown", "metadata", "has_metadata", "status_is_number"),
    ).orderBy("request_id").collect()
    first, second = found
    assert (first.success, first.status_code, first.status_is_number, first.html) == (False, 404, False, None)
    assert (first.markdown_text, first.markdown.raw_markdown, first.metadata, first.has_metadata) == (None, "x", None, True)
    assert (second.url, second.success, second.markdown_text, second.markdown.raw_markdown) == (None, True, "m", None)
    assert second.metadata == {"a": '{"b":1}'}


def test_fallback_url_follows_kept_records_or_payload_order(records):
    payload = [{"note": 1}, {"html": "<p>"}]
    targets = ("t0", "t1")
    assert records(payload, view="html", targets=targets).first().fallback_url == "t0"
    assert records(payload, view="html", targets=targets, fallback="ordinal").first().fallback_url == "t1"


def test_metadata_view(records):
    payload = [
        {"url": SITE, "success": True, "status_code": 200, "metadata": {"title": "T"}}, {"status_code": 500}, {"status_code": "500"},
        {"redirected_url": SITE + "/r", "metadata": "text"}, {"metadata": {}}, {"html": "x"},
    ]
    rows = views.metadata_view(records(payload, view="metadata", targets=())).orderBy("record_pos").collect()
    assert [(r.url, r.redirected_url, r.success, r.status_code, r.metadata) for r in rows] == [
        (SITE, None, True, 200, {"title": "T"}), (None, None, False, 500, {}), (SITE + "/r", SITE + "/r", False, None, {}),
        (None, None, False, None, {}),
    ]


def test_html_view_and_totals(records):
    view = views.html_view(records([{"html": "<b>é</b>"}, {"html": " \n"}, {"html": None}, {}], view="html"))
    assert [r.html for r in view.collect()] == ["<b>é</b>"]
    assert tuple(views.view_totals(view, "html").first()) == (1, 8)
    assert tuple(views.view_totals(view.filter("false"), "html").first()) == (0, 0)


def test_markdown_priority(records):
    payload = [
        {"markdown": {"raw_markdown": " ", "markdown_with_citations": "cited", "references_markdown": "", "fit_markdown": "fit"}},
        {"markdown": {"references_markdown": "refs"}}, {"markdown": "text"}, {"markdown": " "},
        {"markdown": {"raw_markdown": "raw", "fit_markdown": "fit"}},
    ]
    rows = views.markdown_view(records(payload, view="markdown")).orderBy("record_pos").collect()
    assert [(r.markdown, r.markdown_with_citations, r.references_markdown, r.fit_markdown) for r in rows] == [
        ("cited", "cited", None, "fit"), ("", None, "refs", None), ("text", None, None, None), ("raw", None, None, "fit")
    ]


def test_text_prefers_fit_over_citations_and_falls_back_to_html(records):
    payload = [
        {"markdown": {"markdown_with_citations": "cited", "fit_markdown": "# Fit [a](b)"}},
        {"markdown": " ", "html": "<style>x</style><h1>Head</h1> body"}, {"markdown": {"references_markdown": "r"}},
    ]
    rows = views.text_view(records(payload, view="text")).orderBy("record_pos").collect()
    assert [r.text for r in rows] == ["Fit", "Head body"]


def test_seo_merges_metadata_and_tags(records):
    html = (
        "<title> Page </title><META content='d2' name='description'><meta name=\"robots\" content=\"index, follow\">"
        "<meta property='og:title' content='og'><meta name='twitter:card'><link href='/c' rel='canonical'>"
    )
    payload = [
        {"html": html, "metadata": {"title": "", "keywords": "  ", "description": 0, "og": {"title": "m", "url": ""}}},
        {"metadata": [1]}, {"metadata": "x"}, {"html": "<p>"},
    ]
    rows = views.seo_view(records(payload, view="seo")).orderBy("record_pos").collect()
    assert len(rows) == 3
    seo = rows[0].seo
    assert (seo.title, seo.keywords, seo.robots, seo.canonical) == ("Page", "  ", "index, follow", "/c")
    assert (seo.og.title, seo.og.url, seo.twitter.card) == ("m", "", "")
    assert set(rows[1].seo.asDict(recursive=True)["twitter"].values()) == {""}


def test_extract_reads_raw_markdown_then_text_then_html(records):
    payload = [
        {"markdown": {"raw_markdown": "a@x.test", "fit_markdown": "b@x.test"}, "html": "c@x.test"},
        {"markdown": {"fit_markdown": "d@x.test"}, "html": "<p title='t@x.test'>e@x.test</p>"}, {"html": "<br>"},
        {"markdown": "call 030 1234567"}, {"markdown": {"fit_markdown": "f@x.test"}},
    ]
    kept = records(payload, view="extract")
    rows = views.extract_fields(kept).orderBy("record_pos").collect()
    assert [(r.emails, r.phones) for r in rows] == [(["a@x.test"], []), (["e@x.test"], []), ([], []), ([], ["030 1234567"])]
    long = views.extract_fields_long(kept, ["phones", "urls"]).collect()
    assert [(r.field, r.value) for r in long] == [("phones", "030 1234567")]


def test_extract_by_request(spark, records):
    kept = records({"markdown": "a@x.test https://x.test/1"}, {"markdown": "b@x.test https://x.test/2"}, view="extract")
    asked = spark.createDataFrame([("0", ["Urls "]), ("1", None)], "request_id string, fields array<string>")
    rows = views.extract_by_request(kept, asked).collect()
    assert sorted((r.request_id, r.field) for r in rows) == [("0", "urls"), ("1", "emails")]


def test_screenshot_priority(records):
    payload = [
        {"screenshot": " s ", "screenshot_url": "u"}, {"screenshot": {"url": "u", "base64": " "}, "screenshot_base64": "b"},
        {"screenshot": {}, "screenshot_url": " u "}, {"screenshot_base64": " ", "screenshotBase64": "c"}, {"screenshot": [1]},
    ]
    rows = views.screenshot_view(records(payload, view="screenshot")).orderBy("record_pos").collect()
    assert [tuple(r.screenshot) for r in rows] == [
        ("s", None, None), (None, "u", None), (None, " u ", None), (None, None, "c")
    ]


def test_bulk_summary_and_owner(records):
    found = records([{"url": "a", "success": True, "status_code": 200}, {"url": "b", "status_code": 500}, {}])
    row = views.bulk_summary(found).first()
    assert (row["count"], row.succeeded, row.failed, row.error_status) == (3, 1, 2, 1)
    owned = views.bulk_items(found).withColumn("owner", F.when(F.col("success"), "me").otherwise("you"))
    assert views.owned_jobs(owned, "me").count() == 1


def test_request_quality(spark, records):
    targets = spark.createDataFrame([("0", "a"), ("0", "b"), ("1", "c")], "request_id string, target_url string")
    kept = records([{"html": "x"}, {"html": "y"}], {"html": ""}, view="html")
    rows = quality.request_quality(targets, kept).orderBy("request_id").collect()
    assert [tuple(r) for r in rows] == [("0", 2, 2, 200), ("1", 1, 0, 502)]
    assert [r.request_id for r in quality.empty_requests(targets, kept).collect()] == ["1"]


def test_page_adapter(spark):
    html = (
        "<a class=x href='/in'>In <b>side</b></a><a href=\"https://blog.site.test/p\">blog<a href='https://other.test' title='T'>o</a>"
        "<a href='mailto:a@b.test'>m</a><a name='n'>no</a><img src='/i.png' alt='I' width='30px'><img alt='none'>"
        "<video src='v.mp4'></video><source src='a.ogg' type='audio/ogg'><source src='w.webm' type='video/webm'>"
    )
    row = records_from_pages(spark.createDataFrame([(1, SITE + "/x/y", html)], "page_id long, url string, html string")).first()
    assert [tuple(x) for x in row.internal_links] == [
        (SITE + "/in", "In  side", ""), ("https://blog.site.test/p", "blog", "")
    ]
    assert [tuple(x) for x in row.external_links] == [("https://other.test/", "o", "T"), ("mailto:a@b.test", "m", "")]
    assert [(m.src, m.alt, m.width) for m in row.images] == [("/i.png", "I", 30.0)]
    assert [m.src for m in row.videos] == ["v.mp4", "w.webm"] and [m.src for m in row.audios] == ["a.ogg"]
    assert R.usable(records_from_pages(spark.createDataFrame([(1, SITE, " ")], "page_id long, url string, html string")), R.has_html).count() == 0


def test_page_adapter_reads_awkward_tags(spark):
    html = (
        """<a href="/o'brien" title='say "hi"'>ob</a><a href=/plain>plain</a><a href='/a&#38;b&amp;c'>amp</a>"""
        "<a href=\"/open\">open<p>not this</p><a href='/last'>last <b>words</b>" + "<a " * 50_000
    )
    row = records_from_pages(spark.createDataFrame([(1, SITE + "/x", html)], "page_id long, url string, html string")).first()
    assert [(x.href, x.text, x.title) for x in row.internal_links] == [
        (SITE + "/o'brien", "ob", 'say "hi"'), (SITE + "/plain", "plain", ""), (SITE + "/a&b&c", "amp", ""),
        (SITE + "/open", "open", ""), (SITE + "/last", "last  words  a" + "  a" * 49_999, ""),
    ]


def test_seo_values_of_other_kinds(records):
    html = "<title>Page</title><meta name='keywords' content='k'><meta property='og:title' content='og'>"
    payload = [
        {"html": html, "metadata": {"title": 0, "keywords": False, "og": '{"title":"text"}', "robots": 5}},
        {"html": html, "metadata": [{"title": "in a list"}]}, {"html": html, "metadata": {"og": ["x"], "title": None}},
    ]
    rows = [r.seo for r in views.seo_view(records(payload, view="seo")).orderBy("record_pos").collect()]
    assert [(s.title, s.keywords, s.og.title) for s in rows] == [("Page", "k", "og")] * 3
    assert rows[0].robots == "5"


def test_totals_count_utf16_units(spark):
    frame = spark.createDataFrame([("a😀b",), (None,), ("é",)], "t string")
    assert tuple(views.view_totals(frame, "t").first()) == (3, 5)


def test_jobs_without_items_are_counted(spark, records):
    jobs = spark.createDataFrame([("0",), ("none",)], "request_id string")
    rows = {r.job_id: tuple(r)[1:] for r in views.bulk_summary(records([{"success": True, "status_code": 500}]), jobs=jobs).collect()}
    assert rows == {"0": (1, 1, 0, 1), "none": (0, 0, 0, 0)}


def test_write_view(spark, records, tmp_path):
    view = views.html_view(records({"html": "x"}, view="html"))
    write_view(view, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    with pytest.raises(ValueError):
        write_view(view, str(tmp_path / "w"), "csv")
