"""Registered queries: each runs one operator over whole tables and returns flat rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.urls import is_http_url, normalize_url, resolve_url
from pagelens.operators import audit, emails, ledger, links, media, quality, registrations, usage, views
from pagelens.plans import derived as D
from pagelens.session import scratch_dir
from pagelens.sources import payloads as P
from pagelens.sources import records as R
from pagelens.sources import requests as Q
from pagelens.sources import usage_log as L
from pagelens.sources.pages import records_from_pages
from pagelens.sources.sinks import write_view
from pagelens.streaming import usage as S

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# The account and the key whose usage the period queries report.
ACCOUNT, KEY, PERIOD = "a3", "k8", "2024-01"


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _micros(name: str, alias: str | None = None) -> Column:
    return F.unix_micros(name).alias(alias or name)


def _joined(name: str) -> Column:
    return F.array_join(name, " ").alias(name)


def _payload_records(spark: SparkSession, sf_dir: str, view: str, fallback: str = "filtered_index") -> DataFrame:
    return P.crawl_records(P.read_payloads(D.payloads(spark, sf_dir)), view, fallback)


def _page_records(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return records_from_pages(D.table(spark, sf_dir, "pages"), R.FIELDS[view])


# Sources and sinks


@query
def target_list(spark, sf_dir):
    return Q.select_targets(D.target_requests(spark, sf_dir))[0]


@query
def target_rejects(spark, sf_dir):
    return Q.select_targets(D.target_requests(spark, sf_dir))[1]


@query
def payload_scan(spark, sf_dir):
    scanned = P.read_payloads(D.payloads(spark, sf_dir))
    return scanned.select(
        "request_id",
        F.col("corrupt_text").isNotNull().alias("corrupt"),
        "corrupt_text",
    )


@query
def record_headers(spark, sf_dir):
    return _payload_records(spark, sf_dir, "bulk").select(*views.header(), "target")


@query
def record_headers_by_ordinal(spark, sf_dir):
    return _payload_records(spark, sf_dir, "html", "ordinal").select(*views.header(), "target")


@query
def page_links(spark, sf_dir):
    records = D.linked_records(spark, sf_dir)

    def tagged_links(bucket: str) -> Column:
        return F.transform(f"{bucket}_links", lambda x: F.struct(F.lit(bucket).alias("bucket"), x.alias("link")))

    tagged = F.concat(tagged_links("internal"), tagged_links("external"))
    return records.select("request_id", F.explode(tagged).alias("l")).select(
        "request_id", "l.bucket", "l.link.href", "l.link.text", "l.link.title"
    )


@query
def usage_period_account(spark, sf_dir):
    rows = L.usage_scan(D.usage_log(spark, sf_dir), PERIOD, "account", ACCOUNT)
    return rows.select("request_id", "endpoint", "response_code", "credit_used", _micros("created"))


@query
def usage_period_key_closed(spark, sf_dir):
    rows = L.usage_scan(D.usage_log(spark, sf_dir), PERIOD, "key", KEY, closed=True)
    return rows.select("request_id", "endpoint", "response_code", "credit_used", _micros("created"))


def _log_columns() -> list[Column]:
    kept = [*L.MINIMAL_COLUMNS, *L.EXTENDED_COLUMNS, "month"]
    return [F.col(c) for c in kept] + [_micros("created")]


@query
def usage_append(spark, sf_dir):
    path = scratch_dir(spark, "usage-log")
    L.append_usage(D.finished_requests(spark, sf_dir), path)
    return spark.read.parquet(path).withColumn("month", F.col("month").cast("string")).select(*_log_columns())


@query
def usage_append_again(spark, sf_dir):
    """Two batches, each of them appended twice."""
    path = scratch_dir(spark, "usage-log")
    requests = D.finished_requests(spark, sf_dir)
    first = F.pmod(F.xxhash64("finished_at"), F.lit(2)) == 0
    for name, rows in (("a", first), ("b", ~first), ("a", first), ("b", ~first)):
        L.append_usage(requests.filter(rows), path, batch=name)
    return spark.read.parquet(path).withColumn("month", F.col("month").cast("string")).select(*_log_columns())


@query
def view_sink(spark, sf_dir):
    path = scratch_dir(spark, "markdown-view")
    write_view(views.markdown_view(_payload_records(spark, sf_dir, "markdown")), path, "json")
    schema = "request_id string, record_pos int, url string, success boolean, status_code int, markdown string"
    return spark.read.schema(schema).json(path)


# Views


@query
def metadata_view(spark, sf_dir):
    view = views.metadata_view(_payload_records(spark, sf_dir, "metadata"))
    return view.select(*[c for c in view.columns if c != "metadata"], F.explode_outer("metadata"))


@query
def html_view(spark, sf_dir):
    return views.html_view(_payload_records(spark, sf_dir, "html"))


@query
def markdown_view(spark, sf_dir):
    return views.markdown_view(_payload_records(spark, sf_dir, "markdown"))


@query
def text_view_payloads(spark, sf_dir):
    return views.text_view(_payload_records(spark, sf_dir, "text"))


@query
def text_view_pages(spark, sf_dir):
    return views.text_view(_page_records(spark, sf_dir, "text"))


@query
def text_view_documents(spark, sf_dir):
    return views.text_view(D.document_records(spark, sf_dir)).select("request_id", "url", "text")


def _flat_seo(view: DataFrame) -> DataFrame:
    plain = [F.col(f"seo.{n}").alias(n) for n in ("title", "description", "keywords", "robots", "canonical")]
    og = [F.col(f"seo.og.{n}").alias(f"og_{n}") for n in ("title", "description", "image", "url", "type")]
    twitter = [F.col(f"seo.twitter.{n}").alias(f"twitter_{n}") for n in ("card", "title", "description", "image")]
    return view.select(*[c for c in view.columns if c != "seo"], *plain, *og, *twitter)


@query
def seo_view(spark, sf_dir):
    return _flat_seo(views.seo_view(_payload_records(spark, sf_dir, "seo")))


@query
def seo_view_values(spark, sf_dir):
    return _flat_seo(views.seo_view(_home_records(spark, sf_dir, "seo")))


@query
def extract_fields_documents(spark, sf_dir):
    return views.extract_fields_long(D.document_records(spark, sf_dir), list(views.contacts.FIELDS))


@query
def extract_fields_default(spark, sf_dir):
    wide = views.extract_fields(_payload_records(spark, sf_dir, "extract"))
    return wide.select("request_id", "url", _joined("emails"), _joined("phones"))


@query
def extract_by_request(spark, sf_dir):
    doc = F.col("doc_id")
    fields = F.when(doc % 4 == 0, F.array(F.lit(" URLS "), F.lit("emails"), F.lit("names"))).when(
        doc % 4 == 1, F.array(F.lit("names"))
    ).when(doc % 4 == 2, F.array().cast("array<string>"))
    requests = D.table(spark, sf_dir, "documents").select(doc.cast("string").alias("request_id"), fields.alias("fields"))
    return views.extract_by_request(D.document_records(spark, sf_dir), requests)


@query
def screenshot_view(spark, sf_dir):
    view = views.screenshot_view(_payload_records(spark, sf_dir, "screenshot"))
    shot = [F.col(f"screenshot.{n}").alias(a) for n, a in (("screenshot", "screenshot"), ("url", "shot_url"), ("base64", "base64"))]
    return view.select(*[c for c in view.columns if c != "screenshot"], *shot)


@query
def bulk_items(spark, sf_dir):
    return views.bulk_items(_payload_records(spark, sf_dir, "bulk"))


@query
def bulk_summary(spark, sf_dir):
    payloads = D.payloads(spark, sf_dir).unionByName(D.empty_payloads(spark, sf_dir))
    return views.bulk_summary(P.crawl_records(P.read_payloads(payloads), "bulk"), jobs=payloads)


@query
def owned_bulk_items(spark, sf_dir):
    items = views.bulk_items(_payload_records(spark, sf_dir, "bulk"))
    owner = F.concat(F.lit("owner"), (F.col("job_id").cast("bigint") % 3).cast("string"))
    return views.owned_jobs(items.withColumn("owner", owner), "owner1")


@query
def view_totals_html(spark, sf_dir):
    return views.view_totals(views.html_view(_payload_records(spark, sf_dir, "html")), "html")


@query
def view_totals_markdown(spark, sf_dir):
    return views.view_totals(views.markdown_view(_payload_records(spark, sf_dir, "markdown")), "markdown")


@query
def view_totals_text(spark, sf_dir):
    return views.view_totals(views.text_view(_page_records(spark, sf_dir, "text")), "text")


# Quality, links, media, emails


def _request_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.payloads(spark, sf_dir).select("request_id", F.explode("target_urls").alias("target_url"))


@query
def request_quality(spark, sf_dir):
    return quality.request_quality(_request_targets(spark, sf_dir), _payload_records(spark, sf_dir, "seo"))


@query
def empty_requests(spark, sf_dir):
    return quality.empty_requests(_request_targets(spark, sf_dir), _payload_records(spark, sf_dir, "screenshot"))


@query
def link_map(spark, sf_dir):
    return links.link_map(D.overlapping_records(spark, sf_dir))


@query
def link_counts(spark, sf_dir):
    return links.link_counts(links.link_map(D.overlapping_records(spark, sf_dir)))


def _home_records(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return P.crawl_records(P.read_payloads(D.home_payloads(spark, sf_dir)), view)


@query
def link_map_payloads(spark, sf_dir):
    return links.link_map(_home_records(spark, sf_dir, "map"))


@query
def link_counts_payloads(spark, sf_dir):
    records = _home_records(spark, sf_dir, "map")
    return links.link_counts(links.link_map(records), records)


@query
def media_inventory_payloads(spark, sf_dir):
    kept = ("request_id", "target", "bucket", "type", "src", "alt", "format", "score")
    return media.media_inventory(_home_records(spark, sf_dir, "media")).select(*kept)


@query
def media_counts_payloads(spark, sf_dir):
    records = _home_records(spark, sf_dir, "media")
    return media.media_counts(media.media_inventory(records), records)


@query
def page_media(spark, sf_dir):
    records = records_from_pages(D.media_pages(spark, sf_dir), R.FIELDS["media"])
    return media.media_inventory(records).select("request_id", "target", "bucket", "type", "src", "alt", "width")


@query
def locale_listing(spark, sf_dir):
    return media.locale_rank(D.locale_items(spark, sf_dir), "src").select("request_id", "src", "place")


@query
def email_source_chunks(spark, sf_dir):
    index = emails.email_index(_scan(spark, sf_dir)[1], D.document_records(spark, sf_dir))
    chunks = emails.email_source_chunks(index, size=3)
    return chunks.select("target", "email", "chunk", _joined("sources"))


@query
def link_lists(spark, sf_dir):
    lists = links.link_lists(links.link_map(D.overlapping_records(spark, sf_dir)))
    return lists.select("request_id", "target", _joined("internal"), _joined("external"), _joined("all"))


@query
def overlap_free_external(spark, sf_dir):
    return links.overlap_free_external(links.link_rows(D.overlapping_records(spark, sf_dir)))


@query
def media_inventory(spark, sf_dir):
    kept = ("request_id", "target", "bucket", "type", "src", "alt", "score")
    return media.media_inventory(D.media_records(spark, sf_dir)).select(*kept)


@query
def media_all(spark, sf_dir):
    kept = ("request_id", "target", "type", "src", "alt", "score")
    return media.media_all(media.media_inventory(D.media_records(spark, sf_dir))).select(*kept)


@query
def media_counts(spark, sf_dir):
    return media.media_counts(media.media_inventory(D.media_records(spark, sf_dir)))


def _scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    candidates = emails.contact_pages(D.site_links(spark, sf_dir))
    return candidates, emails.scanned_pages(D.site_seeds(spark, sf_dir), candidates)


@query
def contact_pages(spark, sf_dir):
    return _scan(spark, sf_dir)[0]


@query
def scanned_pages(spark, sf_dir):
    return _scan(spark, sf_dir)[1]


@query
def scanned_coverage(spark, sf_dir):
    return emails.scanned_coverage(_scan(spark, sf_dir)[1], D.document_records(spark, sf_dir))


@query
def email_index(spark, sf_dir):
    return emails.email_index(_scan(spark, sf_dir)[1], D.document_records(spark, sf_dir))


@query
def email_index_payloads(spark, sf_dir):
    """From the home pages' records to their contact pages and the emails on them."""
    candidates = emails.contact_pages(emails.seed_links(_home_records(spark, sf_dir, "emails")))
    scanned = emails.scanned_pages(D.home_seeds(spark, sf_dir), candidates)
    stored = P.crawl_records(P.read_payloads(D.contact_payloads(spark, sf_dir)), "emails")
    return emails.email_index(scanned, stored)


@query
def email_sources(spark, sf_dir):
    index = emails.email_index(_scan(spark, sf_dir)[1], D.document_records(spark, sf_dir))
    return emails.email_sources(index).select("target", "email", _joined("sources"))


@query
def email_counts(spark, sf_dir):
    candidates, scanned = _scan(spark, sf_dir)
    return emails.email_counts(scanned, candidates, emails.email_index(scanned, D.document_records(spark, sf_dir)))


@query
def url_forms(spark, sf_dir):
    """Each page's URL written in other ways, and sources resolved against it."""
    p, url = F.col("page_id"), F.col("url")
    bare = F.regexp_replace(url, r"[?#].*$", "")
    written = F.array(
        url,
        F.concat(F.upper(F.regexp_extract(bare, "^(https?://[^/]+)", 1)), F.regexp_extract(bare, "^https?://[^/]+(.*)$", 1)),
        F.concat(F.lit("  "), bare, F.lit("/../a/./b/#frag")),
        F.concat(bare, F.lit("/café x?q=ü'&r=%C3")),
        F.concat(F.lit("http://h.test:80/"), p.cast("string"), F.lit("//")),
        F.concat(F.lit("https://h.test:8443?"), p.cast("string")),
        F.concat(F.lit("ftp://h.test/"), p.cast("string")),
        F.concat(F.lit("http://www.B\u00dcCHER\u3002test/"), p.cast("string")),
        F.concat(F.lit("http://[0:0:0:2::FFFF:1.2.3.4]:80/"), p.cast("string"), F.lit("/")),
        F.concat(F.lit("http://[1::2::3]/"), p.cast("string")),
        F.concat(F.lit("http://"), F.repeat(F.lit("\u00e9"), F.lit(64)), F.lit(".test/"), p.cast("string")),
    )
    sources = F.array(
        F.lit("/img/a.jpg#hero"), F.lit("b.png?x=1"), F.lit("../c.gif"), F.lit("//cdn.test/d"), F.lit("?only=query"),
        F.lit("data:image/png;base64,AA#B"), F.lit("mailto:X@y.test"), F.lit("#top"), F.lit("  "),
    )
    pages = D.table(spark, sf_dir, "pages")
    forms = pages.select("page_id", F.lit("normalize").alias("form"), F.lit("").alias("base"), F.explode(written).alias("raw"))
    resolved = pages.select("page_id", F.lit("resolve").alias("form"), url.alias("base"), F.explode(sources).alias("raw"))
    written_forms = forms.unionByName(resolved)
    found = written_forms.withColumn("normal", F.when(F.col("form") == "normalize", normalize_url("raw")))
    result = F.when(F.col("form") == "normalize", F.col("normal")).otherwise(resolve_url("raw", "base"))
    return found.select("page_id", "form", "raw", is_http_url("raw").alias("valid"), result.alias("result"))


# Usage and access


@query
def usage_by_endpoint(spark, sf_dir):
    return usage.usage_by_endpoint(D.usage_log(spark, sf_dir))


@query
def usage_by_status(spark, sf_dir):
    return usage.usage_by_status(D.usage_log(spark, sf_dir))


@query
def usage_totals(spark, sf_dir):
    return usage.usage_totals(D.usage_log(spark, sf_dir))


@query
def usage_rollup(spark, sf_dir):
    return usage.usage_rollup(D.usage_log(spark, sf_dir))


@query
def usage_rollup_mixed(spark, sf_dir):
    return usage.usage_rollup(D.mixed_credit_log(spark, sf_dir))


@query
def usage_summary(spark, sf_dir):
    return usage.usage_summary(D.usage_log(spark, sf_dir), PERIOD, "account", ACCOUNT)


@query
def monthly_credits(spark, sf_dir):
    return usage.monthly_credits(D.usage_log(spark, sf_dir))


@query
def monthly_credits_mixed(spark, sf_dir):
    return usage.monthly_credits(D.mixed_credit_log(spark, sf_dir))


@query
def credits_before(spark, sf_dir):
    requests = D.access_requests(spark, sf_dir)
    before = audit.credits_before(requests, D.usage_log(spark, sf_dir))
    return before.select("request_id", "account_id", _micros("ts"), "used_credits")


@query
def credits_from_ledger(spark, sf_dir):
    """The same from a ledger of the days before the last one, to which the last is added."""
    requests, log = D.access_requests(spark, sf_dir), D.usage_log(spark, sf_dir)
    path = scratch_dir(spark, "ledger")
    ledger.write_ledger(ledger.credit_ledger(log, date(2024, 1, 30)), path)
    ledger.extend_ledger(log, path, date(2024, 1, 31))
    used = ledger.credits_from_ledger(requests, log, ledger.read_ledger(spark, path))
    return used.select("request_id", "account_id", _micros("ts"), "used_credits")


def _access(spark: SparkSession, sf_dir: str, policy: audit.AccessPolicy) -> DataFrame:
    known = D.registry(spark, sf_dir)
    return audit.access_audit(
        D.access_requests(spark, sf_dir), known["keys"], known["accounts"], known["plans"], known["users"],
        D.usage_log(spark, sf_dir), policy,
    )


@query
def access_audit(spark, sf_dir):
    return _access(spark, sf_dir, audit.AccessPolicy())


@query
def access_audit_strict(spark, sf_dir):
    policy = audit.AccessPolicy(allowed_subscriptions=("active", "trialing"), enforce_key_credits=True)
    return _access(spark, sf_dir, policy)


@query
def static_key_check(spark, sf_dir):
    keys = D.registry(spark, sf_dir)["keys"].filter(F.col("status") != "inactive")
    return audit.static_key_check(D.access_requests(spark, sf_dir), keys)


@query
def latest_registrations(spark, sf_dir):
    last = registrations.latest_per_owner(D.registrations(spark, sf_dir))
    return last.select("owner", "url", _joined("events"), _micros("updated_at"))


@query
def rejected_registrations(spark, sf_dir):
    return registrations.rejected_registrations(D.registrations(spark, sf_dir))


@query
def rate_limit_audit(spark, sf_dir):
    over = audit.rate_limit_audit(D.burst_requests(spark, sf_dir))
    return over.select("request_id", "ip_address", _micros("ts"), _micros("window_start"))


@query
def rate_limit_windows(spark, sf_dir):
    windows = audit.rate_limit_windows(D.burst_requests(spark, sf_dir))
    return windows.select("ip_address", _micros("window_start"), "requests")


@query
def rate_limit_client_windows(spark, sf_dir):
    windows = audit.client_windows(D.burst_requests(spark, sf_dir))
    return windows.select("ip_address", _micros("window_start"), "requests", "over")


# Streams: everything available now, read back from the written table


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = D.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _run(start, spark: SparkSession, purpose: str) -> DataFrame:
    path, checkpoint = scratch_dir(spark, purpose), scratch_dir(spark, f"{purpose}-checkpoint")
    start(path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


@query
def rate_limit_stream(spark, sf_dir):
    rows = S.rate_limit_stream(D.burst_columns(_event_stream(spark, sf_dir)))
    out = _run(lambda p, c: S.update_stream(rows, p, c, available_now=True), spark, "rate-limit")
    windows = S.latest_updates(out, ["ip_address", "window_start"], "requests")
    return windows.select("ip_address", _micros("window_start"), "requests")


@query
def usage_rollup_stream(spark, sf_dir):
    rows = S.usage_rollup_stream(D.usage_columns(_event_stream(spark, sf_dir)))
    out = _run(lambda p, c: S.update_stream(rows, p, c, available_now=True), spark, "rollup")
    hours = S.latest_updates(out, ["hour", "endpoint", "status"], "requests", "credits")
    return hours.select(_micros("hour"), "endpoint", "status", "requests", "credits")


@query
def monthly_credits_stream(spark, sf_dir):
    rows = S.monthly_credits_stream(D.usage_columns(_event_stream(spark, sf_dir)))
    out = _run(lambda p, c: S.update_stream(rows, p, c, available_now=True), spark, "credits")
    return S.latest_updates(out, ["account_id", "month"], "credits")


@query
def usage_append_stream(spark, sf_dir):
    requests = D.finished_columns(_event_stream(spark, sf_dir))
    out = _run(lambda p, c: S.stream_usage(requests, p, c, available_now=True), spark, "usage-stream")
    return out.withColumn("month", F.col("month").cast("string")).select(*_log_columns())


def _sums_in_any_order(spark: SparkSession, sf_dir: str, columns, keys: list[str]) -> DataFrame:
    """Sums of the events, which arrive in eight batches mixed by hash and are compacted on the way."""
    events, folder, out = D.table(spark, sf_dir, "events"), scratch_dir(spark, "mixed-events"), scratch_dir(spark, "sums")
    events.repartition(8, F.xxhash64("event_id")).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = columns(stream)
    S.sum_stream(rows, keys, out, scratch_dir(spark, "sums-checkpoint"), compact_every=3, available_now=True).awaitTermination()
    return S.read_sums(spark, out, rows.schema, keys)


@query
def usage_rollup_any_order(spark, sf_dir):
    keys = ["hour", "endpoint", "status"]
    sums = _sums_in_any_order(spark, sf_dir, lambda e: S.hourly_usage(D.usage_columns(e)), keys)
    return sums.select(_micros("hour"), "endpoint", "status", "requests", "credits")


@query
def monthly_credits_any_order(spark, sf_dir):
    return _sums_in_any_order(spark, sf_dir, lambda e: S.monthly_usage(D.usage_columns(e)), ["account_id", "month"])


@query
def rate_limit_any_order(spark, sf_dir):
    sums = _sums_in_any_order(spark, sf_dir, lambda e: S.window_requests(D.burst_columns(e)), ["ip_address", "window_start"])
    return S.over_limit(sums).select("ip_address", _micros("window_start"), "requests")
