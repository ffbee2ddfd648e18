import random
import time

import pytest
from pyspark.sql import functions as F

from pagelens.functions import contacts, endpoints, numbers, text, urls


def test_white_space_class_is_exact(spark):
    chars = spark.range(0, 0x10000).filter("id < 55296 OR id > 57343").select(
        "id", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c")
    )
    expected = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
    assert [r.id for r in chars.filter(F.col("c").rlike(rf"^[{text.WS}]\z")).orderBy("id").collect()] == expected
    assert chars.filter(~F.col("c").rlike(rf"^[^{text.WS}]\z")).count() == len(expected)


PRINTED = [
    ("https://site.test/docs/", "https://site.test/docs"),
    ("https://site.test/docs#part", "https://site.test/docs"),
    ("HTTP://Site.TEST:80", "http://site.test/"),
    ("https://site.test:443/a/../b/./c/..", "https://site.test/b"),
    ("https://site.test:0444/", "https://site.test:444/"),
    ("http://me:pw@site.test:8080/a b/ü?q=é'z#f", "http://me:pw@site.test:8080/a%20b/%C3%BC?q=%C3%A9%27z"),
    ("http:site.test/x", "http://site.test/x"),
    ("http:\\\\site.test\\x\\y", "http://site.test/x/y"),
    ("  https://site.test/?  ", "https://site.test/?"),
    ("https://site.test//", "https://site.test/"),
    ("https://site.test/a//", "https://site.test/a/"),
    ("https://site.test/a?b=/", "https://site.test/a?b=/"),
    ("http://[::1]:80/%2e%2E/b", "http://[::1]/b"),
    ("https://site.test/..", "https://site.test/"),
    ("https://site.test/%zz", "https://site.test/%zz"),
    ("ftp://site.test/", None), ("http://", None), ("https://a b.test/", None), ("http://site.test:65536/", None),
    ("word", None), ("", None), (None, None), ("http://a%41.test/", "http://aa.test/"), ("http://a%2Fb.test/", None),
    ("http://1", "http://0.0.0.1/"), ("http://256/x/", "http://0.0.1.0/x"), ("http://0x7f.1/", "http://127.0.0.1/"),
    ("http://010.1.2.3", "http://8.1.2.3/"), ("http://1.2.3.4:80", "http://1.2.3.4/"), ("http://1.2.3.256/", None),
    ("http://1.2.3.4.5/", None), ("http://a.1/", None), ("http://4294967295", "http://255.255.255.255/"), ("http://4294967296", None),
    ("http://a..b/", "http://a..b/"), ("http://ü.test/", "http://xn--tda.test/"), ("http://h.test/.well-known/x", "http://h.test/.well-known/x"),
]


def test_lists_are_sorted_by_code_unit(evaluate):
    lists = [["\uff21", "\U0001f600", "a", "\ue000"], ["b", "a", "é"], [], None, ["\uffee", "\U0001f600a", "\U0001f600"]]
    got = evaluate([(x,) for x in lists], "v array<string>", text.sort_by_code_unit(F.col("v")))
    assert got == [x and sorted(x, key=lambda s: s.encode("utf-16-be")) for x in lists]


def test_normalize_url(spark):
    rows = spark.createDataFrame(PRINTED, "raw string, printed string").select(
        "raw", "printed", urls.normalize_url("raw").alias("got"), urls.is_http_url("raw").alias("valid")
    ).collect()
    assert [(r.raw, r.got) for r in rows] == PRINTED
    assert [r.valid for r in rows] == [printed is not None for _, printed in PRINTED]


def test_plain_urls_take_a_short_way_to_the_same_result(spark):
    random.seed(3)
    pieces = ["/", "a", ".", "..", "%2e", "?", "=", "é", "//", "x.html", "~", "'", ":", "@", "#", "-", "/./", "{"]
    rows = [
        (random.choice(["http://h.test", "https://a-b.c.test", "https://h.test/"]) + "".join(random.choices(pieces, k=random.randint(0, 6))),)
        for _ in range(4000)
    ]
    parsed = urls.let(urls.url_parts(urls.with_plain_host("u")), lambda p: urls._print(p, drop_trailing_slash=True))
    both = spark.createDataFrame(rows, "u string").select("u", urls.normalize_url("u").alias("a"), parsed.alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []
    # One slash is removed each time, so a path that still ends with one is left out.
    twice = both.filter(r"a IS NOT NULL AND NOT a RLIKE '/(\\?.*)?$'").select("a", urls.normalize_url("a").alias("again"))
    assert twice.filter("a <> again").collect() == []


RESOLVED = [
    ("/i/a.png", "https://site.test/list", "https://site.test/i/a.png"),
    ("https://SITE.test/i/a.png#top", "not a url", "https://site.test/i/a.png"),
    ("../b?x#y", "http://site.test/a/b/c?d", "http://site.test/a/b?x"),
    ("?q", "http://site.test/a/b?c", "http://site.test/a/b?q"),
    ("#f", "http://site.test/a?c#z", "http://site.test/a?c"),
    ("//cdn.test/v", "https://site.test/", "https://cdn.test/v"),
    ("//cdn.test/v", None, "//cdn.test/v"),
    ("data:image/gif;base64,A#B", "http://site.test", "data:image/gif;base64,A#B"),
    ("rel", "not a url", "rel"), (" \t", "http://site.test", None), (None, "http://site.test", None),
    ("mailto:A@b#c", "http://site.test", "mailto:A@b"), ("FTP://x/y", "http://site.test", "ftp://x/y"),
    ("http:foo", "http://site.test/d/e", "http://site.test/d/foo"),
    ("https:foo", "http://site.test/d/e", "https://foo/"),
    ("foo/", "http://site.test", "http://site.test/foo/"),
    ("http://bad host/", "http://site.test", "http://bad host/"),
    ("\\a\\b", "http://site.test/c", "http://site.test/a/b"),
]


def test_resolve_url(spark):
    frame = spark.createDataFrame([r[:2] for r in RESOLVED], "s string, b string")
    assert [tuple(r) for r in frame.select("s", "b", urls.resolve_url("s", "b")).collect()] == RESOLVED


SITES = [
    ("site.test", "site.test", True), ("blog.site.test", "site.test", True), ("site.test", "a.b.site.test", True),
    ("bank.co.uk", "shop.co.uk", False), ("a.github.io", "b.github.io", False), ("notsite.test", "site.test", False),
    ("10.0.0.1", "0.0.1", False), ("10.0.0.1", "10.0.0.1", True), ("", "", False), ("[::1]", "[::1]", True),
]


def test_same_site(spark):
    frame = spark.createDataFrame([r[:2] for r in SITES], "a string, b string")
    assert [tuple(r) for r in frame.select("a", "b", urls.same_site(F.col("a"), F.col("b"))).collect()] == SITES


def seconds(work):
    start = time.time()
    work()
    return time.time() - start


def test_very_long_urls(spark):
    """No input is too long, neither for the stack nor in time."""
    n = 100_000
    rows = [
        ("http://a.b/" + "a/" * n, "http://a.b/" + "a/" * (n - 1) + "a"),
        ("http://a.b/" + "a/" * n + "../" * (n - 1), "http://a.b/a"),
        ("http://a.b/" + "a/../" * (n // 2) + "x/.", "http://a.b/x"),
        ("http://" + "a." * 20_000 + "b/", "http://" + "a." * 20_000 + "b/"),
        ("http://a.b/?" + "q" * 1_000_000, "http://a.b/?" + "q" * 1_000_000),
        ("http://a.b/" + "x" * 1_000_000 + "%", "http://a.b/" + "x" * 1_000_000 + "%"),
    ]
    frame = spark.createDataFrame(rows, "u string, want string").cache()
    frame.count()
    wrong = frame.filter(~urls.normalize_url("u").eqNullSafe(F.col("want")) | ~urls.is_http_url("u"))
    assert wrong.count() == 0  # starts the code
    assert seconds(wrong.count) < 6
    relative = frame.select(F.concat(F.lit("x/"), F.substring("u", 12, 10**9)).alias("s"))
    resolved = relative.select(F.length(urls.resolve_url("s", F.lit("http://a.b/c/"))).alias("n"))
    assert resolved.filter("n is null").count() == 0


def test_dot_segments_against_brute_force(spark):
    rng = random.Random(8)

    def plain(path):
        kept = []
        for part in path.split("/")[1:]:
            if part == "..":
                del kept[-1:]
            elif part != ".":
                kept.append(part)
        last = path.rsplit("/", 1)[1]
        return "/" + "/".join([*kept, ""] if last in (".", "..") else kept)

    paths = ["/" + "/".join(rng.choices(["a", "b", "..", ".", "", "c"], weights=[3, 3, w, 1, 1, 1], k=rng.choice((3, 10, 900)))) for w in (1, 3, 9) * 60]
    frame = spark.createDataFrame([(p, plain(p)) for p in paths], "p string, want string")
    assert frame.filter(urls._resolve_dots(F.col("p")) != F.col("want")).count() == 0


def test_trim_and_tags_in_linear_time(spark):
    cases = [
        (text.strip_ws, " a" + " " * 1_000_000 + "b\u3000 ", "a" + " " * 1_000_000 + "b"),
        (text.strip_ws, "\t" * 1_000_000, ""),
        (text.strip_tags, "<script " * 100_000, "<script " * 100_000),
        (text.strip_tags, "x<script>1</SCRIPT>" + "<style " * 100_000, "x " + "<style " * 100_000),
        (text.strip_tags, "<p>a</p>" + "<" * 500_000, " a " + "<" * 500_000),
        (text.strip_tags, "<script>a</script>b<script>c<b>d", " b c d"),
    ]
    for fn, value, want in cases:
        spark.createDataFrame([("x",)], "t string").select(fn("t")).collect()  # starts the code
        frame = spark.createDataFrame([(value,)], "t string")
        start = time.time()
        assert frame.select(fn("t")).first()[0] == want
        assert time.time() - start < 5


def test_character_references(evaluate):
    rows = [("a&amp;b&#38;c&#x26;d&quot;&lt;&nbsp;&unknown;&#0;&#xD800;&#x1F600;& &amp",), ("none",), (None,), ("",)]
    assert evaluate(rows, "t string", text.decode_references(F.col("t"))) == [
        'a&b&c&d"<\u00a0&unknown;&#0;&#xD800;😀& &amp', "none", None, ""
    ]


MIXED = (
    "Write to Info@Site.test. or desk [at] site [dot] test, root(AT)my.host DOT test "
    "mailto:ops%40site.test?subject=1 mailto:a+b@site.test mailto:%zz@site.test "
    "call +49 (30) 1234-567 or 1234567 see https://site.test/a?b), http://x.test."
)


def test_contacts_in_text(evaluate):
    rows = [(MIXED,)]
    assert evaluate(rows, "t string", contacts.emails_in_text("t")) == [
        ["%zz@site.test", "a+b@site.test", "desk@site.test", "info@site.test", "root@my.host.test"]
    ]
    assert evaluate(rows, "t string", contacts.phones_in_text("t")) == [["+49 (30) 1234-567"]]
    assert evaluate(rows, "t string", contacts.urls_in_text("t")) == [["http://x.test", "https://site.test/a?b"]]
    indexed = evaluate(rows, "t string", contacts.emails_for_index("t"))[0]
    assert sorted(indexed) == [
        "%zz@site.test", "a+b@site.test", "desk@site.test", "info@site.test", "ops@site.test", "root@my.host.test"
    ]


def test_phone_catches_long_numbers_and_needs_eight_characters(evaluate):
    rows = [("4111 1111 1111 1111",), ("192.168.100.200",), ("12\n34567\t 8",), ("1234567",), ("12-3",)]
    assert evaluate(rows, "t string", contacts.phones_in_text("t")) == [
        ["4111 1111 1111 1111"], ["192.168.100.200"], ["12 34567 8"], [], []
    ]


def test_undecodable_mailto_is_kept_raw(evaluate):
    rows = [("mailto:%FF@site.test",), ("mailto:x%2Cy@site.test",), ("MAILTO:Q@site.test)",)]
    assert evaluate(rows, "t string", contacts.mailto_emails("t")) == [["%ff@site.test"], [], ["q@site.test"]]


def test_link_targets_give_emails(evaluate):
    hrefs = [(["mailto:Desk@site.test?x", "hello@site.test", "https://site.test/", None, "mailto:a@b"],)]
    found = evaluate(hrefs, "h array<string>", contacts.emails_for_index(F.lit(None).cast("string"), F.col("h")))
    assert sorted(found[0]) == ["desk@site.test", "hello@site.test"]


def test_scan_patterns_find_what_the_plain_patterns_find(spark):
    random.seed(5)
    pieces = ["a", "b.", "_", "@", "x@y.co", "-", " ", "\t", " at ", " dot ", "[at]", "(dot)", "[dot]", "com", "+", "%", "é", "@b.c", "..org"]
    rows = [("".join(random.choices(pieces, k=random.randint(3, 18))),) for _ in range(20000)]
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    hidden = found(contacts.EMAIL_OBFUSCATED)
    texts = spark.createDataFrame(rows, "t string")
    differs = (
        (found(contacts.EMAIL) != found(contacts.EMAIL_SCAN))
        | (hidden != found(contacts.OBFUSCATED_SCAN))
        | ((F.size(hidden) > 0) & ~F.col("t").rlike(contacts.ANY_SPELLED_DOT))
    )
    assert texts.filter(differs).collect() == []
    assert texts.filter(F.size(hidden) > 0).count() > 100


def test_supported_fields():
    assert contacts.supported_fields(None) == ["emails", "phones"]
    assert contacts.supported_fields([" URLS", "emails", "emails", "names", None]) == ["urls", "emails"]
    with pytest.raises(ValueError):
        contacts.supported_fields(["names"])


def test_markdown_and_tags(evaluate):
    markdown = [("# A *b*\n```\ncode\n``` `x` ![i](u) [l](u) _c_-d",)]
    assert evaluate(markdown, "t string", text.markdown_to_text("t")) == ["A b c d"]
    html = [("a<SCRIPT x>1<2</script >b</Script><style>p{}</style><p\nq>c&amp;",)]
    assert evaluate(html, "t string", text.strip_tags("t")) == ["a   c&amp;"]


@pytest.mark.parametrize("raw, number", [
    ("", 0.0), ("  ", 0.0), ("0x10", 16.0), ("0b11", 3.0), ("0o7", 7.0), (" 5 ", 5.0), ("-2.5", -2.5), (".5", 0.5), ("5.", 5.0),
    ("1e2", 100.0), ("1d", None), ("1e999", None), ("NaN", None), ("Infinity", None), ("5 6", None), ("-0x1", None), (None, None),
])
def test_loose_number(evaluate, raw, number):
    rows = [(raw,)]
    assert evaluate(rows, "n string", numbers.loose_number("n")) == [number]
    assert evaluate(rows, "n string", numbers.number_or_zero("n")) == [number or 0.0]
    positive = number if number and number > 0 else None
    assert evaluate(rows, "n string", numbers.positive_or_null("n")) == [positive]


def test_endpoints(evaluate):
    raw = [(" /V2/Map/?a=/b ",), ("v2/map",), ("/",), ("",), (None,), ("//x",)]
    assert evaluate(raw, "e string", endpoints.audit_endpoint("e")) == ["/v2/map", "/v2/map", "/", "/", "/", "//x"]
    logged = [("/v2", "/Map/", "x"), ("", "", "v2/Map/?q"), (None, None, None), ("/v2", "/", "")]
    assert evaluate(logged, "b string, p string, o string", endpoints.logged_endpoint("b", "p", "o")) == [
        "/v2/Map", "/v2/Map/?q", "/", "/v2"
    ]


def test_rules(evaluate):
    cases = [("/v2/map", "*"), ("/v2/map", "/v2/m*"), ("/v2/map", "/v2/map"), ("/v2/map/a", "/v2/map"), ("/v2/maps", "/v2/map"), ("/v2", "/v2/*")]
    matched = evaluate(cases, "e string, r string", endpoints.rule_matches(F.col("e"), F.col("r")))
    assert matched == [True, True, True, True, False, False]
    lists = [('[" /V2/A", "", null, 1]',), (" /v2/a , ,/V2/b",), ("",), (None,), ("[not json",), ('{"a":1}',)]
    assert evaluate(lists, "r string", endpoints.rule_list("r", is_array=False)) == [
        ["/v2/a", "1"], ["/v2/a", "/v2/b"], [], [], ["[not json"], ['{"a":1}']
    ]
    assert evaluate([([" A", None],)], "r array<string>", endpoints.rule_list("r", is_array=True)) == [["a"]]


def test_costs_addresses_and_owners(evaluate):
    costs = [("/v2/map", "options"), ("/v2/health", "GET"), ("/v2/map", None)]
    assert evaluate(costs, "e string, m string", endpoints.audit_cost(F.col("e"), F.col("m"))) == [0, 0, 1]
    logged = [("/v2/usage", 200), ("/v2/health", 200), ("/v2/map", 500), ("/v2/map", 499)]
    assert evaluate(logged, "e string, s int", endpoints.logged_credit(F.col("e"), F.col("s"))) == [0, 1, 0, 1]
    hops = [(" 1.1.1.1 , 2.2.2.2", "9"), ("  ", "9"), (None, None), (",3", "9")]
    assert evaluate(hops, "f string, i string", endpoints.client_ip("f", "i")) == ["1.1.1.1", "9", "", ""]
    owners = [("", "k", "a"), ("id", "k", "a"), (None, "", "a"), (None, None, "")]
    assert evaluate(owners, "i string, k string, a string", endpoints.owner_key("i", "k", "a")) == ["k", "id", "a", "anonymous"]
