"""Inputs derived from the given tables; the rules are listed in ``FIXTURES.md``.

Each table is a row-local projection of one given table (registry tables are
distinct keys of ``events``), so it grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.session import configure
from pagelens.sources import records as R
from pagelens.sources.pages import records_from_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _by(key: Column, cases: dict, default: Column | None = None) -> Column:
    """A value per case of ``key``; values are Columns."""
    out = None
    for k, value in cases.items():
        out = F.when(key == k, value) if out is None else out.when(key == k, value)
    return out if default is None else out.otherwise(default)


def null_text() -> Column:
    return F.lit(None).cast("string")


# Usage tables, from ``events``.


def k_of() -> Column:
    """The number in ``props``, always ``{"k": number}``; read by position, as it is used many times."""
    return F.expr("CAST(substr(props, 7, length(props) - 7) AS INT)")


def usage_columns(events: DataFrame) -> DataFrame:
    """``usage_log``; works on a batch or a streaming ``events``."""
    user = F.col("user_id")
    endpoint = _by(F.col("event_type"), {
        "view": F.lit("/v2/gethtml"), "click": F.lit("/v2/map"), "signup": F.lit("/v2/extract"),
        "purchase": F.lit("/v2/bulk"), "error": F.lit("/v2/crawl"),
    })
    is_error = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("request_id"),
        _text("k", user).alias("api_key"),
        _text("a", user % 10).alias("account_id"),
        endpoint.alias("endpoint"),
        F.when(is_error, "500").when(k_of() < 5, "429").otherwise("200").alias("response_code"),
        F.when(is_error, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("credit_used"),
        F.lit("POST").alias("method"),
        _text("10.0.0.", user % 8).alias("ip_address"),
        F.col("ts").cast("timestamp").alias("created"),
    )


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_columns(table(spark, sf_dir, "events"))


def mixed_credit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with credits as text of many forms, and some endpoints and codes missing."""
    k = k_of()
    text = _by(k % 10, {
        0: F.lit(""), 1: F.lit("0x10"), 2: F.lit("1d"), 3: F.lit("-2"), 4: F.lit(" 3 "),
        5: F.lit("1.5"), 6: F.lit("abc"), 7: F.lit("1e2"), 8: null_text(),
    }, F.lit("1"))
    return table(spark, sf_dir, "events").select(
        _text("a", F.col("user_id") % 10).alias("account_id"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("/v2/"), "event_type")).alias("endpoint"),
        F.when(k % 11 == 0, null_text()).otherwise("200").alias("response_code"),
        text.alias("credit_used"),
        k.alias("credits"),
        F.col("ts").cast("timestamp").alias("created"),
    )


def finished_columns(events: DataFrame) -> DataFrame:
    """Finished requests as the usage logger sees them."""
    k, user = k_of(), F.col("user_id")
    path = _by(F.col("event_type"), {
        "view": F.lit("/gethtml/"), "click": F.lit("/map"), "signup": F.lit("/extract"),
        "purchase": F.lit("/usage"), "error": F.lit(""),
    })
    is_error = F.col("event_type") == "error"
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.when(k == 99, null_text()).otherwise(_text("k", user)).alias("api_key"),
        F.when(k == 98, null_text()).otherwise(_text("a", user % 10)).alias("account_id"),
        F.when(is_error, "").otherwise("/v2").alias("base_url"),
        path.alias("path"),
        F.when(is_error, "v2/Crawl/").otherwise(F.lit("/v2")).alias("original_url"),
        F.lit("POST").alias("method"),
        F.when(is_error, F.lit(502)).when(k < 5, F.lit(429)).otherwise(F.lit(200)).alias("status_code"),
        _text("agent/", k).alias("user_agent"),
        F.when(k % 3 == 0, _text(" 10.1.0.", user % 8, " , 10.9.9.9"))
        .when(k % 3 == 1, F.lit("  ")).alias("forwarded_for"),
        _text("10.0.0.", user % 8).alias("ip"),
        (ts - F.expr("INTERVAL 1 SECOND") * k).alias("started_at"),
        ts.alias("finished_at"),
    )


def finished_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished_columns(table(spark, sf_dir, "events"))


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to audit: some without a key, with an unknown key, or free of charge."""
    k, user = k_of(), F.col("user_id")
    path = _by(F.col("event_type"), {
        "view": F.lit("/v2/GetHtml"), "click": F.lit("/v2/map/site"), "signup": F.lit("v2/extract"),
        "purchase": F.lit("/v2/bulk"), "error": F.lit("/v2/status"),
    })
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(k == 99, "").when(k == 98, _text("zz", user)).otherwise(_text("k", user)).alias("api_key"),
        F.when(k == 97, "OPTIONS").otherwise("POST").alias("method"),
        F.concat(path, F.when(k % 3 == 0, "/").otherwise(""), F.when(k % 5 == 0, "?a=1").otherwise("")).alias("endpoint"),
        _text("a", user % 10).alias("account_id"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def burst_columns(events: DataFrame) -> DataFrame:
    """Requests of a month squeezed into hours; one address sends a third of them."""
    user = F.col("user_id")
    return events.select(
        F.col("event_id").alias("request_id"),
        _text("10.0.0.", F.when(user % 3 == 0, F.lit(0)).otherwise(user % 8)).alias("ip_address"),
        F.expr(
            # 2024-01-01 in microseconds
            "timestamp_micros(1704067200000000 + (unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) DIV 100)"
        ).alias("ts"),
    )


def burst_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_columns(table(spark, sf_dir, "events"))


def registry(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """api_keys, accounts, plans and users of the users seen in ``events``."""
    seen = table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    empty = F.array().cast("array<string>")
    keys = seen.select(
        _text("id", u).alias("id"),
        _text("k", u).alias("key"),
        F.when(u % 7 == 0, "inactive").otherwise("Active").alias("status"),
        F.when(u % 11 == 0, "2024-01-01T00:00:00Z").alias("revoked_at"),
        (u % 13 == 0).alias("expires"),
        F.when(u % 26 == 0, "2024-01-10 00:00:00Z").when(u % 39 == 0, "no date").otherwise("2030-01-01").alias("expiration_date"),
        F.when(u % 19 == 0, "").when(u % 23 == 0, "a99").otherwise(_text("a", u % 10)).alias("account"),
        F.when(u % 6 == 0, F.array(F.lit("/v2/map"), F.lit("/v2/bulk"))).otherwise(empty).alias("allowed_endpoints_override"),
        F.when(u % 4 == 0, F.lit(400)).otherwise(F.lit(0)).alias("monthly_credits_override"),
    )
    n = F.col("n")
    account_numbers = seen.select((u % 10).alias("n")).distinct()
    accounts = account_numbers.select(
        _text("a", n).alias("id"),
        F.when(n == 6, "").when(n == 7, "missing").otherwise(_text("u", n)).alias("user"),
        F.when(n.isin(0, 3), "p0").when(n == 4, "p9").when(n == 5, "").otherwise("p1").alias("plan"),
        F.lit("user").alias("role"),
        F.when(n == 9, "canceled").otherwise("active").alias("stripe_sub_status"),
    )
    plans = account_numbers.select((n % 2).alias("n")).distinct().select(
        _text("p", n).alias("id"),
        F.when(n == 0, "[]").otherwise("/v2/gethtml, /v2/MAP*,/v2/extract").alias("allowed_endpoints"),
        F.when(n == 0, "300").otherwise("100000").alias("monthly_credits"),
    )
    users = account_numbers.select(_text("u", n).alias("id"), (n != 8).alias("verified"))
    return {"keys": keys, "accounts": accounts, "plans": plans, "users": users}


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One webhook registration per event."""
    k, user = k_of(), F.col("user_id")
    events = F.when(k % 4 == 0, F.array(F.lit(" bulk.completed "), F.lit(""))).when(
        k % 4 == 1, F.array().cast("array<string>")
    ).when(k % 4 == 2, F.array(F.lit("bulk.failed")))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(user % 3 == 0, _text("id", user)).otherwise("").alias("api_key_id"),
        F.when(user % 3 == 1, _text("k", user)).alias("api_key"),
        F.when(user % 6 == 2, _text("a", user)).alias("account_id"),
        F.when(F.col("event_type") == "error", "hooks.example.com").otherwise(
            _text(" https://hooks.example.com/", F.col("event_id"), " ")
        ).alias("url"),
        events.alias("events"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("updated_at"),
    )


# Crawl tables, from ``pages``, ``documents`` and ``part``.


def target_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose URL list holds repeats, other schemes, words and nothing at all."""
    p, url = F.col("page_id"), F.col("url")
    urls = _by(p % 4, {
        0: F.array(url, F.concat(url, F.lit("#x")), url),
        2: F.array(F.lit("ftp://x.test/a"), F.lit("not a url"), F.lit(""), url),
        3: F.array(F.lit("HTTP://UPPER.test"), F.lit("http://")),
    }, F.lit(None).cast("array<string>"))
    single = F.when(p % 8 == 1, F.lit("http:// bad host/")).when(p % 8 == 7, null_text()).otherwise(url)
    return table(spark, sf_dir, "pages").select(
        p.cast("string").alias("request_id"), urls.alias("urls"), single.alias("url"),
    )


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with more anchors: to themselves, twice to a partner site, and in awkward markup; every third has a base address."""
    p, url = F.col("page_id"), F.col("url")
    partner = _text("partner", p % 7, ".test")
    extra = F.concat(
        F.lit("<body>"),
        _text("<a href='", F.regexp_replace(url, "#.*$", ""), "#again'>self</a>"),
        _text('<a href="https://', partner, "/p/", p, '/">Über &amp; <b>more</b></a>'),
        _text('<A HREF="HTTPS://', F.upper(partner), ":443/x/../p/", p, '#top" title="Partner">again</A>'),
        # Without quotes, with the other kind of quote inside, with a reference, without an end.
        F.lit("""<a href=/plain>plain</a><a href="/o'brien">ob</a><a href='/a&#38;b'>amp</a>"""),
        # A tag's end inside a value, an attribute inside another one, links that are none, an area.
        F.lit("""<a title="a > b" href="/z">z</a><a data-x=" href=/bad" href="/good">good <!-- </a> -->one</a><!-- <a href="/dead">dead</a> -->"""),
        F.lit("""<script>var s = '<a href="/dead">x</a>';</script><textarea><a href=/dead></textarea><map><AREA alt=Area href=/area></map>"""),
        F.when(p % 3 == 0, F.lit("<base target=top><base href=/deep/er/page><base href=/other/>")).otherwise(""),
        F.lit("""<a href=rel>rel</a><a href="/open">open<p>not this"""),
    )
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace("html", F.lit("<body>"), extra).alias("html"))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with images, videos and an audio source after ``<body>``; every third has a base address."""
    extra = _text(
        "<body><img src=\"/i/", F.col("page_id"), ".png\" alt='A \"q\"' width=30><img src=/i/x.png>",
        "<video src=v.mp4></video><source src='a.ogg' type='audio/ogg'>",
        "<img alt=\"see src=foo\" src=\"/x.jpg\"><!-- <img src=/dead.png> --><script>'<img src=/dead.png>'</script><i title='<img src=/dead.png>'>i</i>",
        "<img data-src=/lazy.png srcset='/s1.png 480w, /s2,2.png 2x'><video poster=/poster.png></video>",
        "<picture><source srcset=/pic.webp type=image/webp></picture>",
        F.when(F.col("page_id") % 3 == 1, F.lit("<base href='/deep/x'>")).otherwise(""),
    )
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace("html", F.lit("<body>"), extra).alias("html"))


def linked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_from_pages(linked_pages(spark, sf_dir), R.FIELDS["map"])


def overlapping_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked records whose external list repeats the internal links."""
    records = linked_records(spark, sf_dir)
    return records.withColumn("external_links", F.concat("external_links", "internal_links"))


def seo_page_html() -> Column:
    p, url = F.col("page_id"), F.col("url")
    tags = F.concat(
        _text('<META name="description" content=" About page ', p, ' ">'),
        F.lit("<meta content='index,follow' name='robots'>"),
        F.lit('<meta name="keywords" content="">'),
        _text('<link rel="canonical" href="', url, '">'),
        _text('<meta property="og:title" content="og ', p, '"><meta property="og:type" content=\'article\'>'),
        _text('<meta name="twitter:card" content = "summary ', p % 5, '">'),
    )
    with_tags = F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), tags))
    return F.when(p % 3 == 0, with_tags).otherwise(F.col("html"))


def payload_records(pages: DataFrame) -> DataFrame:
    """One JSON crawl record per page."""
    p = F.col("page_id")
    md = F.concat(F.lit("# Page "), p.cast("string"), F.lit("\n\n* see [site]("), F.col("url"), F.lit(") or `code`\n\n"), F.col("html"))
    prepared = pages.withColumn("md", md).withColumn("seo_html", seo_page_html())
    title = _by(p % 4, {0: F.lit(""), 1: F.lit("  "), 2: _text("Meta ", p)})
    member = {
        "url": F.when((p % 10).isin(6, 9) | (p % 20 == 18), null_text()).otherwise(F.col("url")),
        "redirected_url": F.when(p % 10 == 8, F.concat("url", F.lit("?r=1"))).when(p % 10 == 7, ""),
        "html": F.when(p % 6 == 5, F.lit("  \n")).otherwise(F.col("seo_html")),
    }
    common = [c.alias(n) for n, c in member.items()]
    metadata = F.struct(
        title.alias("title"),
        F.when(p % 5 == 0, F.lit("from service")).alias("description"),
        F.struct(_text("service og ", p).alias("image"), F.lit(7).alias("width")).alias("og"),
    )
    text_form = F.to_json(F.struct(
        *common, F.lit(True).alias("success"), F.lit(200).alias("status_code"), F.col("md").alias("markdown"),
        metadata.alias("metadata"), F.concat(F.lit("  shot-"), p, F.lit(" ")).alias("screenshot"),
    ))
    object_form = F.to_json(F.struct(
        *common, F.lit(False).alias("success"), F.lit(404).alias("status_code"),
        F.struct(
            F.when(p % 2 == 0, F.col("md")).otherwise(" ").alias("raw_markdown"),
            F.concat(F.lit("cited "), F.col("md")).alias("markdown_with_citations"),
            F.lit("refs").alias("references_markdown"),
        ).alias("markdown"),
        metadata.alias("metadata"),
        F.struct(
            F.when(p % 2 == 0, _text("https://shots.test/", p)).alias("url"),
            F.when(p % 2 == 1, _text("b64-", p)).alias("base64"),
        ).alias("screenshot"),
    ))
    sparse_form = F.to_json(F.struct(
        *common, F.lit("true").alias("success"), F.struct(F.lit("fit only").alias("fit_markdown")).alias("markdown"),
        F.when(p % 2 == 0, _text("https://flat.test/", p)).alias("screenshot_url"),
        F.when(p % 4 == 1, _text("flat-", p)).alias("screenshot_base64"),
        F.when(p % 4 == 3, _text("camel-", p)).alias("screenshotBase64"),
    ))
    record = F.when(p % 3 == 0, text_form).when(p % 3 == 1, object_form).otherwise(sparse_form)
    return prepared.select("page_id", "url", record.alias("record"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payloads: one envelope form per page number; every 50th begins with a stray character."""
    p, r = F.col("page_id"), F.col("record")
    noise = F.lit('{"note":"no content"}')
    raw = _by(p % 5, {
        0: r,
        1: F.concat(F.lit("["), noise, F.lit(","), r, F.lit("]")),
        2: F.concat(F.lit("[["), r, F.lit("],5,null]")),
        3: F.concat(F.lit('{"success":true,"results":['), r, F.lit(","), noise, F.lit("]}")),
    }, F.concat(F.lit('{"result":{"results":null,"result":['), r, F.lit("]}}")))
    written = F.when(p % 50 == 0, F.concat(F.lit("~"), raw)).otherwise(raw)
    rows = payload_records(table(spark, sf_dir, "pages"))
    urls = F.array("url", F.concat(F.col("url"), F.lit("#second")))
    return rows.select(p.cast("string").alias("request_id"), urls.alias("target_urls"), written.alias("raw"))


def empty_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without a single record, for every tenth page."""
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").filter(p % 10 == 0).select(
        _text("e", p).alias("request_id"), F.array("url").alias("target_urls"), F.lit("[5,null]").alias("raw")
    )


def home_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per page number for the home page of a site of its own: links by
    page_id % 4, media by % 3, metadata by % 6, and no URL in the record for % 5 = 4."""
    p = F.col("page_id")
    site, partner = _text("https://s", p, ".test"), _text("partner", p % 7, ".test")
    links = _by(p % 4, {
        0: _text(
            '{"internal":["', site, '/contact/",{"href":"', site, '/contact#form","text":"again"},{"href":"', site,
            '/p/1","text":"The team"},{"href":"', site, '/blog","text":"Blog"},"mailto:x@y.test"],"external":[{"href":"https://', partner,
            '/a/"},"not a url",{"text":"no href"},"HTTPS://', F.upper(partner), ':443/a","', site, '/contact"]}',
        ),
        1: F.lit('{"internal":[],"external":null}'),
        2: F.lit('"yes"'),
    })
    media = _by(p % 3, {
        0: _text(
            '{"images":[{"src":"/img/1.png","alt":"one","score":2},"', site, '/img/1.png#hero",{"href":"b.gif","type":"video"},'
            '{"alt":"none"}],"videos":[{"url":"/v.mp4","format":"mp4"}],"audios":"text"}',
        ),
        1: F.lit("{}"),
    })
    metadata = _by(p % 6, {
        0: F.lit('{"title":0,"keywords":false,"description":null,"og":{"title":"svc"},"twitter":{"card":0}}'),
        1: F.lit("[]"),
        2: F.lit('{"og":"{\\"title\\":\\"x\\"}","title":"Svc"}'),
        3: F.lit('{"title":"Svc","robots":"noindex","canonical":7}'),
        4: F.lit('"text"'),
    })
    html = _text(
        "<title> T", p, " </title><meta name='keywords' content='k", p, "'><meta property='og:title' content='og", p, "'>"
    )
    members = [
        _text('"html":"', html, '"'),
        F.when(p % 5 != 4, _text('"url":"', site, '"')),
        F.concat(F.lit('"links":'), links), F.concat(F.lit('"media":'), media), F.concat(F.lit('"metadata":'), metadata),
    ]
    raw = F.concat(F.lit('{"results":[{'), F.concat_ws(",", *members), F.lit("}]}"))
    return table(spark, sf_dir, "pages").select(p.cast("string").alias("request_id"), F.array(site).alias("target_urls"), raw.alias("raw"))


def contact_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contact page of each such site; every third record has no URL of its own."""
    p = F.col("page_id")
    page = _text("https://s", p, ".test/contact")
    own = F.when(p % 3 != 0, _text('"url":"', page, '/",')).otherwise("")
    raw = F.concat(F.lit("{"), own, _text('"markdown":"mail m', p, '@site.test"}'))
    return table(spark, sf_dir, "pages").select(_text("c", p).alias("request_id"), F.array(page).alias("target_urls"), raw.alias("raw"))


def home_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(_text("https://s", F.col("page_id"), ".test").alias("target"), null_text().alias("max_pages"))


def locale_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per brand whose order depends on the locale."""
    words = F.array(*[F.lit(w) for w in ("zebra", "Äpfel", "apfel", "Apfel", "öl", "Zebra")])
    word = F.get(words, (F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("request_id"), word.alias("src")).distinct()


def _typed(frame: DataFrame, **columns: Column) -> DataFrame:
    """Crawl records with the given columns; the other fields are empty."""
    no_text = null_text()
    base = {
        "record_pos": F.lit(0),
        "fallback_url": no_text,
        "redirected_url": no_text,
        "success": F.lit(True),
        "status_code": F.lit(200),
        "html": no_text,
        "markdown_text": no_text,
        "markdown": F.struct(*[no_text.alias(k) for k in R.MARKDOWN_KEYS]),
        "internal_links": F.lit(None).cast(R.LINK_TYPE),
        "external_links": F.lit(None).cast(R.LINK_TYPE),
        "has_media": F.lit(False),
        "images": F.lit(None).cast(R.MEDIA_TYPE),
        "videos": F.lit(None).cast(R.MEDIA_TYPE),
        "audios": F.lit(None).cast(R.MEDIA_TYPE),
    } | columns
    return frame.select(*[c.alias(n) for n, c in base.items()])


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as crawled pages of a site per source, with some hidden addresses added."""
    d, source = F.col("doc_id"), F.col("source")
    page = _by(d % 4, {0: F.lit("contact"), 1: F.lit("about"), 2: F.lit("blog"), 3: F.lit("news")})
    text = F.concat(
        F.col("text"),
        F.when(d % 5 == 0, _text(" sales [at] ", source, " [dot] com")).otherwise(""),
        F.when(d % 9 == 0, _text(" mailto:ops%40", source, ".com")).otherwise(""),
        F.when(d % 6 == 0, _text(" (see https://", source, ".test/p/", d, ").")).otherwise(""),
    )
    md = F.struct(text.alias("raw_markdown"), *[null_text().alias(k) for k in R.MARKDOWN_KEYS[1:]])
    url = _text("https://", source, ".example.com/", page, "/", d)
    hrefs = F.array(
        _text("mailto:Desk", d % 3, "@", source, ".com?subject=x"), url
    )
    links = F.transform(
        hrefs, lambda h: F.struct(h.alias("href"), null_text().alias("text"), null_text().alias("title"))
    )
    return _typed(
        table(spark, sf_dir, "documents"),
        request_id=d.cast("string"), target=url, url=url, markdown=md, internal_links=links.cast(R.LINK_TYPE),
    )


def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal links of each site's home page: every document of the source."""
    d, source = F.col("doc_id"), F.col("source")
    page = _by(d % 4, {0: F.lit("contact"), 1: F.lit("about"), 2: F.lit("blog"), 3: F.lit("news")})
    text = F.when(d % 8 == 2, "Our TEAM").otherwise("read")
    return table(spark, sf_dir, "documents").select(
        _text("https://", source, ".example.com").alias("target"),
        _text("https://", F.upper(source), ".example.com/", page, "/", d, "#top").alias("href"),
        text.alias("text"),
        null_text().alias("title"),
    )


def site_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seed per source, asking for different numbers of pages."""
    seen = table(spark, sf_dir, "documents").select("source").distinct()
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    wanted = _by(number % 5, {0: F.lit("7.9"), 1: F.lit("100"), 2: F.lit("abc"), 3: F.lit("0.5")})
    return seen.select(_text("https://", F.col("source"), ".example.com").alias("target"), wanted.alias("max_pages"))


def media_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per part; all parts of a brand share the target page."""
    k, size = F.col("p_partkey"), F.col("p_size")
    no_text, no_number = null_text(), F.lit(None).cast("double")

    def entry(src: Column, kind: Column, alt: Column, score: Column) -> Column:
        return F.struct(
            src.alias("src"), kind.alias("type"), alt.alias("alt"), no_text.alias("format"), score.alias("score"),
            no_number.alias("width"), no_number.alias("height"), no_number.alias("group_id"),
        )

    image = k % 40
    images = F.array(
        entry(_text("/img/", image, ".jpg"), no_text, _text("part ", k), F.col("p_size").cast("double")),
        entry(_text("https://shop.test/img/", image, ".jpg#hero"), no_text, F.lit("copy"), no_number),
        entry(_text("../clip/", image, ".mp4"), F.lit("video"), F.lit(" "), no_number),
    )
    none = F.array().cast(R.MEDIA_TYPE)
    videos = F.when(size > 40, F.array(entry(_text("/clip/", image, ".mp4"), no_text, no_text, no_number)).cast(R.MEDIA_TYPE)).otherwise(none)
    audios = F.when(size < 5, F.array(entry(_text("//cdn.test/a/", k % 9, ".mp3"), F.lit(""), no_text, no_number)).cast(R.MEDIA_TYPE)).otherwise(none)
    brand = F.col("p_brand")
    page = _text("https://shop.test/brand/", F.regexp_extract(brand, "([0-9]+)", 1))
    return _typed(
        table(spark, sf_dir, "part"),
        request_id=brand, target=page, record_pos=k, url=page,
        has_media=F.lit(True), images=images.cast(R.MEDIA_TYPE), videos=videos, audios=audios,
    )
