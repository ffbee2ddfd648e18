import random

from pagelens.operators import emails, links, media
from pagelens.sources import payloads as P
from pagelens.sources import records as R

SITE = "https://site.test"


def build(spark, payloads, view):
    import json

    rows = [(rid, [target], json.dumps(p)) for rid, target, p in payloads]
    frame = spark.createDataFrame(rows, "request_id string, target_urls array<string>, raw string")
    return P.crawl_records(P.read_payloads(frame), view)


def test_link_map_merges_records_and_keeps_internal(spark):
    payload = [
        {"links": {"internal": [SITE + "/docs/", {"href": SITE + "/docs#s"}, {"href": "/rel"}, {"text": "x"}, 5], "external": None}},
        {"links": {"internal": [], "external": [{"href": SITE + "/docs"}, {"href": "https://o.test/x/"}, "https://o.test/x#y"]}},
        {"links": None}, {"links": 0}, {"html": "x"},
    ]
    records = build(spark, [("r", SITE, payload), ("empty", SITE, {"links": {}})], "map")
    assert sorted((r.request_id, r.record_pos) for r in records.select("request_id", "record_pos").collect()) == [
        ("empty", 0), ("r", 0), ("r", 1)
    ]
    mapped = links.link_map(records)
    assert sorted((r.url, r.bucket) for r in mapped.collect()) == [("https://o.test/x", "external"), (SITE + "/docs", "internal")]
    counts = links.link_counts(mapped).first()
    assert (counts.total, counts.internal, counts.external) == (2, 1, 1)
    lists = links.link_lists(mapped).first()
    assert (lists.internal, lists.external) == ([SITE + "/docs"], ["https://o.test/x"])
    assert lists["all"] == ["https://o.test/x", SITE + "/docs"]
    assert [r.url for r in links.overlap_free_external(links.link_rows(records)).collect()] == ["https://o.test/x"]


def test_records_without_entries_count_zero(spark):
    records = build(spark, [("none", SITE, {"links": {"internal": ["mailto:x@y.test"]}}), ("unusable", SITE, {"html": "x"})], "map")
    assert [tuple(r) for r in links.link_counts(links.link_map(records), records).collect()] == [("none", SITE, 0, 0, 0)]
    records = build(spark, [("none", SITE, {"media": {"images": [{"alt": "x"}]}}), ("unusable", SITE, {"media": 1})], "media")
    assert [tuple(r) for r in media.media_counts(media.media_inventory(records), records).collect()] == [("none", SITE, 0, 0, 0, 0)]


def test_media_keeps_the_first_entry(spark):
    payload = [
        {"url": SITE + "/list", "media": {
            "images": [
                {"src": "/i/a.png", "alt": "A", "format": "png", "score": 3},
                {"src": SITE + "/i/a.png#x", "alt": "later"}, "/i/b.png", {"href": "c.png", "type": " "}, {"src": 5, "href": "lost.png"},
                {"src": "", "url": "/i/d.png", "width": "10", "height": 4}, {"type": "video", "src": "/v.mp4", "alt": "in images"}, {"alt": "none"},
            ],
            "videos": [{"src": "/v.mp4", "format": "mp4"}], "audios": "text",
        }},
        {"url": SITE, "media": {"images": ["/i/a.png", "data:x#y"], "audios": [{"src": "//cdn.test/s.mp3"}]}},
        {"media": []}, {"media": None},
    ]
    inventory = media.media_inventory(build(spark, [("r", SITE, payload)], "media")).persist()
    rows = {(r.bucket, r.type, r.src): r for r in inventory.collect()}
    assert sorted(rows) == [
        ("audios", "audio", "https://cdn.test/s.mp3"), ("images", "image", "data:x#y"),
        ("images", "image", SITE + "/c.png"), ("images", "image", SITE + "/i/a.png"), ("images", "image", SITE + "/i/b.png"),
        ("images", "image", SITE + "/i/d.png"), ("images", "video", SITE + "/v.mp4"), ("videos", "video", SITE + "/v.mp4"),
    ]
    first = rows["images", "image", SITE + "/i/a.png"]
    assert (first.alt, first.format, first.score) == ("A", "png", 3.0)
    sized = rows["images", "image", SITE + "/i/d.png"]
    assert (sized.width, sized.height) == (None, 4.0)
    everything = {(r.type, r.src): r for r in media.media_all(inventory).collect()}
    assert len(everything) == 7 and everything["video", SITE + "/v.mp4"].alt == "in images"
    listed = [r.src for r in media.media_listing(media.media_all(inventory)).collect()]
    assert listed == ["data:x#y", "https://cdn.test/s.mp3", *(SITE + p for p in ("/c.png", "/i/a.png", "/i/b.png", "/i/d.png", "/v.mp4"))]
    counts = media.media_counts(inventory).first()
    assert (counts.total, counts.images, counts.videos, counts.audios) == (7, 6, 1, 1)


def test_email_discovery(spark):
    links_rows = [
        (SITE, SITE + "/contact", "Write", None), (SITE, SITE + "/contact#form", "again", None), (SITE, SITE + "/x", "The TEAM", None),
        (SITE, SITE + "/y", None, "Help desk"), (SITE, SITE + "/blog", "Blog", None), (SITE, "mailto:info@site.test", "info", None),
    ]
    found = emails.contact_pages(spark.createDataFrame(links_rows, "target string, href string, text string, title string"))
    assert sorted(r.page_url for r in found.collect()) == [SITE + "/contact", SITE + "/x", SITE + "/y"]
    seeds = spark.createDataFrame([(SITE, "3")], "target string, max_pages string")
    scanned = emails.scanned_pages(seeds, found)
    assert [(r.page_url, r.is_seed) for r in scanned.orderBy("position").collect()] == [
        (SITE + "/", True), (SITE + "/contact", False), (SITE + "/x", False)
    ]
    pages = [
        {"url": SITE + "/contact/", "markdown": {"raw_markdown": "Hi@site.test, desk (at) site (dot) test"}, "html": "no@site.test"},
        {"redirected_url": SITE + "/x", "html": "<a title='tag@site.test'>", "links": {"internal": ["mailto:ops@site.test", None]}},
        {"url": SITE + "/y", "markdown": "late@site.test"}, {"url": SITE, "markdown": "hi@site.test"},
    ]
    records = build(spark, [("r", SITE, pages)], "emails")
    index = emails.email_index(scanned, records)
    sources = {r.email: r.sources for r in emails.email_sources(index).collect()}
    assert sources == {
        "hi@site.test": [SITE, SITE + "/contact/"], "desk@site.test": [SITE + "/contact/"],
        "tag@site.test": [SITE + "/x"], "ops@site.test": [SITE + "/x"],
    }
    counts = emails.email_counts(scanned, found, index).first()
    assert (counts.pages_scanned, counts.candidate_pages, counts.emails_found) == (3, 3, 4)
    covered = emails.scanned_coverage(scanned, records.filter("record_pos <> 1")).collect()
    assert sorted((r.page_url, r.records) for r in covered) == [(SITE + "/", 1), (SITE + "/contact", 1), (SITE + "/x", 0)]


def test_media_of_a_record_without_url_belongs_to_the_first_target(spark):
    rows = [("r", [SITE + "/first/x", SITE + "/second/x"], '[{"note":1},{"media":{"images":["a.png"]}},{"media":{"images":["b.png"]}}]')]
    frame = spark.createDataFrame(rows, "request_id string, target_urls array<string>, raw string")
    found = media.media_inventory(P.crawl_records(P.read_payloads(frame), "media")).collect()
    assert sorted(r.src for r in found) == [SITE + "/first/a.png", SITE + "/first/b.png"]


def test_locale_order(spark):
    frame = spark.createDataFrame([("t", e, []) for e in ("b@x.test", "B@a.test", "a@x.test", "_@x.test")], "target string, email string, sources array<string>")
    assert [r.email for r in emails.email_listing(frame).collect()] == ["_@x.test", "a@x.test", "B@a.test", "b@x.test"]


def test_page_limit(evaluate):
    asked = [("5",), ("7.9",), ("25",), ("400",), ("0",), ("0.5",), ("-3",), ("abc",), (None,), ("",)]
    assert evaluate(asked, "n string", emails.page_limit("n")) == [5, 7, 25, 400, None, None, None, None, None, None]


def test_many_pages_of_one_seed_are_ranked_over_partitions(spark):
    pages = [(SITE, f"{SITE}/{i * 7919 % 4001}/contact") for i in range(4001)] + [("https://b.test", "https://b.test/help")]
    found = spark.createDataFrame(pages, "target string, page_url string").repartition(7)
    seeds = spark.createDataFrame([(SITE, "3000"), ("https://b.test", None)], "target string, max_pages string")
    rows = emails.scanned_pages(seeds, found).collect()
    got = sorted((r.position, r.page_url) for r in rows if r.target == SITE)
    assert got == list(enumerate([SITE + "/", *sorted(u for t, u in pages if t == SITE)], 1))[:3000]
    assert sorted((r.position, r.is_seed) for r in rows if r.target != SITE) == [(1, True), (2, False)]


def test_chunks_of_sources_are_the_list(spark):
    rows = [("t", "a@b.test", f"https://s.test/{i * 7919 % 1009}") for i in range(1009)] + [("t", "c@d.test", "https://s.test/x"), ("u", "a@b.test", "https://s.test/y")]
    index = spark.createDataFrame(rows, "target string, email string, source string").repartition(6)
    chunks = emails.email_source_chunks(index, size=100).orderBy("target", "email", "chunk").collect()
    assert max(len(r.sources) for r in chunks) == 100 and [r.chunk for r in chunks[:11]] == list(range(11))
    joined = {}
    for r in chunks:
        joined[r.target, r.email] = joined.get((r.target, r.email), []) + r.sources
    assert joined == {(r.target, r.email): r.sources for r in emails.email_sources(index).collect()}


def test_pages_nobody_scans_are_left_out_before_the_search(spark):
    scanned = spark.createDataFrame([("t", f"{SITE}/{i}") for i in range(0, 400, 2)], "target string, page_url string")
    records = build(spark, [(str(i), SITE, [{"url": f"{SITE}/{i}", "markdown": f"m{i}@site.test"}]) for i in range(400)], "emails")
    kept = emails._maybe_scanned(records, scanned)
    assert 200 <= kept.count() < 215
    assert {r.email for r in emails.email_index(scanned, records).collect()} == {f"m{i}@site.test" for i in range(0, 400, 2)}


def test_first_records_links_seed_the_search(spark):
    payload = [{"links": {"internal": [{"href": SITE + "/about"}]}}, {"links": {"internal": [{"href": SITE + "/help"}]}}]
    rows = emails.seed_links(build(spark, [("r", SITE, payload)], "emails")).collect()
    assert [(r.target, r.href) for r in rows] == [(SITE, SITE + "/about")]


def test_link_map_against_brute_force(spark):
    random.seed(11)
    hot = SITE + "/hot"
    rows = []
    for i in range(300):
        target = "t0" if i % 3 == 0 else f"t{i % 17}"
        pick = lambda: [(random.choice([hot, f"https://h{random.randint(0, 5)}.test/p"]), None, None) for _ in range(random.randint(0, 6))]
        rows.append((target, target, pick(), pick()))
    schema = f"request_id string, target string, internal_links {R.LINK_TYPE}, external_links {R.LINK_TYPE}"
    expected = {}
    for _, target, inside, outside in rows:
        for bucket, found in (("internal", inside), ("external", outside)):
            for href, *_ in found:
                if expected.get((target, href)) != "internal":
                    expected[target, href] = bucket
    mapped = links.link_map(spark.createDataFrame(rows, schema)).collect()
    assert {(r.target, r.url): r.bucket for r in mapped} == expected
    assert len(mapped) == len(expected)
    external = links.overlap_free_external(links.link_rows(spark.createDataFrame(rows, schema))).collect()
    assert {(r.target, r.url) for r in external} == {k for k, b in expected.items() if b == "external"}


def test_entries_written_alike_collapse_before_they_are_resolved(spark):
    schema = "request_id string, target string, record_pos int, url string, redirected_url string, has_media boolean, " + ", ".join(
        f"{b} {R.MEDIA_TYPE}" for b in ("images", "videos", "audios")
    )

    def shot(src, alt, kind=None):
        return (src, kind, alt, None, None, None, None, None)

    rows = [
        ("r", "t", 2, "https://a.test/x/", None, True, [shot("i.png", "late"), shot(" i.png#f", "later")], None, None),
        ("r", "t", 1, "https://a.test/y/", None, True, [shot("i.png", "other page"), shot("../x/i.png", " ")], [shot("i.png", "film")], None),
        (None, None, 1, "https://a.test/x/", None, True, [shot("i.png", "no keys"), shot("", "none"), shot(None, "none")], None, []),
        ("r", "t", 0, "https://a.test/x/", None, False, [shot("i.png", "not usable")], None, None),
        ("q", "https://b.test/", 0, None, "", True, [shot("i.png", "target", "IMG"), shot("i.png", "again", "IMG"), shot("i.png", "b", " ")], None, None),
    ]
    found = {tuple(r[:6]) + (r.alt,) for r in media.media_inventory(spark.createDataFrame(rows, schema).coalesce(1)).collect()}
    assert found == {
        ("r", "t", "images", "image", "https://a.test/x/i.png", 0, None),
        ("r", "t", "images", "image", "https://a.test/y/i.png", 0, "other page"),
        ("r", "t", "videos", "video", "https://a.test/y/i.png", 1, "film"),
        (None, None, "images", "image", "https://a.test/x/i.png", 0, "no keys"),
        ("q", "https://b.test/", "images", "IMG", "https://b.test/i.png", 0, "target"),
        ("q", "https://b.test/", "images", "image", "https://b.test/i.png", 0, "b"),
    }


def test_overlap_needs_all_keys(spark):
    rows = [(r, t, b, u) for r, t, u in [("r", "t", "u"), (None, "t", "u"), ("r", None, "u"), ("r", "t", None)] for b in ("external", "internal", "external")]
    rows += [("r", "t", "external", "v"), ("r", "t", "internal", "w"), ("q", "t", "external", "w"), ("r", "t", None, "x"), ("r", "t", "other", "y")]
    frame = spark.createDataFrame(rows, "request_id string, target string, bucket string, url string")
    found = links.overlap_free_external(frame).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(None, "t", "u"), ("r", None, "u"), ("r", "t", None), ("r", "t", "v"), ("q", "t", "w")]))
