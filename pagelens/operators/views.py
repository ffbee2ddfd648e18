"""Typed views over crawl records. Each is one narrow projection without a shuffle.

A view keeps the records it can use. For payload input give ``crawl_records`` the
name of the view, so that the position, and with it the fallback URL, counts the
kept records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import contacts, seo
from pagelens.functions.text import if_non_blank, markdown_to_text, non_blank, non_empty, strip_tags
from pagelens.sources import records as R

HEADER = ("request_id", "record_pos", "url", "redirected_url", "success", "status_code")


def record_url() -> Column:
    return F.coalesce(non_empty("url"), non_empty("redirected_url"), F.col("fallback_url"))


def header() -> list[Column]:
    """The columns every view starts with."""
    return [
        F.col("request_id"),
        F.col("record_pos"),
        record_url().alias("url"),
        non_empty("redirected_url").alias("redirected_url"),
        F.col("success"),
        F.col("status_code"),
    ]


def metadata_view(records: DataFrame) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return R.usable(records, R.is_metadata_record).select(
        *header(), F.coalesce("metadata", empty).alias("metadata")
    )


def html_view(records: DataFrame) -> DataFrame:
    return R.usable(records, R.has_html).select(*header(), "html")


def _first_markdown(*keys: str) -> Column:
    return F.coalesce(*[if_non_blank(F.col("markdown")[k]) for k in keys], F.lit(""))


def markdown_view(records: DataFrame) -> DataFrame:
    """Markdown by priority text, raw, citations, fit; the variants that hold something beside it."""
    picked = F.coalesce(
        F.col("markdown_text"), _first_markdown("raw_markdown", "markdown_with_citations", "fit_markdown")
    )
    extra = [
        if_non_blank(F.col("markdown")[k]).alias(k)
        for k in ("markdown_with_citations", "references_markdown", "fit_markdown")
    ]
    return R.usable(records, R.has_markdown).select(*header(), picked.alias("markdown"), *extra)


def text_view(records: DataFrame) -> DataFrame:
    """Plain text of the markdown (text, raw, fit, citations), else of the html."""
    picked = F.coalesce(
        if_non_blank("markdown_text"), _first_markdown("raw_markdown", "fit_markdown", "markdown_with_citations")
    )
    chosen = R.usable(records, R.has_text).select(
        *header(), F.when(picked != "", picked).otherwise(strip_tags(F.coalesce("html", F.lit("")))).alias("source")
    )
    return chosen.withColumn("text", markdown_to_text("source")).drop("source")


def seo_view(records: DataFrame) -> DataFrame:
    """SEO fields: the service's metadata, else the page's tags, else empty text."""
    html, metadata = F.coalesce("html", F.lit("")), F.col("metadata_value")
    names = {n: R.truthy_text_at(metadata, f"$.{n}") for n in seo.PLAIN_FIELDS}

    def group(name: str, fields: tuple[str, ...]) -> Column:
        """The fields of a nested object; text and other values have none."""
        value = F.try_variant_get(metadata, f"$.{name}", "variant")
        held = F.struct(*[R.truthy_text_at(metadata, f"$.{name}.{n}").alias(n) for n in fields])
        return F.when(R.is_object(value), held).alias(name)

    scanned = R.usable(records, R.has_seo).select(
        *header(),
        F.struct(*[c.alias(n) for n, c in names.items()]).alias("service"),
        group("og", seo.OG_FIELDS),
        group("twitter", seo.TWITTER_FIELDS),
        seo.page_title(html).alias("page_title"),
        seo.head_tags(html).alias("tags"),
    )
    tags = F.col("tags")

    def merged(from_service: Column, from_page: Column) -> Column:
        return F.coalesce(non_empty(from_service), non_empty(from_page), F.lit(""))

    def nested(group: str, names: tuple[str, ...], from_page) -> Column:
        return F.struct(*[
            merged(F.col(group)[n], from_page(tags, f"{group}:{n}")).alias(n) for n in names
        ])

    page = {"title": F.col("page_title"), "canonical": seo.canonical_link(tags)}
    plain = [
        merged(F.col("service")[n], page[n] if n in page else seo.meta_named(tags, n)).alias(n) for n in seo.PLAIN_FIELDS
    ]
    og = nested("og", seo.OG_FIELDS, seo.meta_property)
    twitter = nested("twitter", seo.TWITTER_FIELDS, seo.meta_named)
    return scanned.select(*HEADER, F.struct(*plain, og.alias("og"), twitter.alias("twitter")).alias("seo"))


def extractable_text() -> Column:
    return F.coalesce(
        if_non_blank(F.col("markdown")["raw_markdown"]),
        if_non_blank("markdown_text"),
        F.when(non_blank("html"), strip_tags("html")),
    )


def extract_fields(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Contact fields as sorted arrays, one column per requested field."""
    wanted = contacts.supported_fields(fields)
    sourced = R.usable(records, R.is_extractable).select(*header(), extractable_text().alias("source_text"))
    return sourced.select(
        *[c for c in sourced.columns if c != "source_text"],
        *[contacts.EXTRACTORS[f](F.col("source_text")).alias(f) for f in wanted],
    )


def extract_fields_long(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The same values in long form: one row per (record, field, value)."""
    wide = extract_fields(records, fields)
    wanted = contacts.supported_fields(fields)

    def tagged_values(field: str) -> Column:
        return F.transform(field, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    tagged = F.concat(*[tagged_values(f) for f in wanted])
    return wide.select("request_id", "record_pos", "url", F.explode(tagged).alias("item")).select(
        "request_id", "record_pos", "url", "item.field", "item.value"
    )


def extract_by_request(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Long form with the fields each request asks for (``requests.fields``).

    A missing or empty list means emails and phones; a list without a supported
    name gives no rows.
    """
    asked = F.transform(F.col("fields"), lambda f: F.lower(F.trim(F.coalesce(f, F.lit("")))))
    default = F.array(*[F.lit(f) for f in contacts.DEFAULT_FIELDS])
    chosen = F.when(F.coalesce(F.size("fields"), F.lit(0)) > 0, asked).otherwise(default)
    values = extract_fields_long(records, list(contacts.FIELDS))
    wanted = requests.select("request_id", chosen.alias("wanted"))
    return values.join(wanted, "request_id").filter(F.array_contains("wanted", F.col("field"))).drop("wanted")


def screenshot_view(records: DataFrame) -> DataFrame:
    return R.usable(records, R.has_screenshot).select(*header(), "screenshot")


def bulk_items(records: DataFrame, job_id: str = "request_id") -> DataFrame:
    """Per-URL rows of bulk jobs."""
    return records.select(F.col(job_id).alias("job_id"), *header()[1:])


def owned_jobs(jobs: DataFrame, owner: str) -> DataFrame:
    """Bulk rows that belong to one owner."""
    return jobs.filter(F.col("owner") == owner)


def bulk_summary(records: DataFrame, job_id: str = "request_id", jobs: DataFrame | None = None) -> DataFrame:
    """Per job: number of items, how many succeeded, failed, and answered 4xx or 5xx; with
    ``jobs``, zeros for those without an item."""
    failed_status = F.coalesce(F.col("status_code") >= 400, F.lit(False))
    flags = {"count": F.lit(True), "succeeded": F.col("success"), "failed": ~F.col("success"), "error_status": failed_status}
    rows = bulk_items(records, job_id).select("job_id", *[c.cast("bigint").alias(n) for n, c in flags.items()])
    if jobs is not None:
        zero = F.lit(0).cast("bigint")
        rows = rows.unionByName(jobs.select(F.col(job_id).alias("job_id"), *[zero.alias(n) for n in flags]))
    return rows.groupBy("job_id").agg(*[F.sum(n).alias(n) for n in flags])


def utf16_length(c: str | Column) -> Column:
    """Characters as the service counts them: those beyond the basic plane are two."""
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def view_totals(view: DataFrame, text_column: str) -> DataFrame:
    """Number of rows and total characters (UTF-16 units) of a view's text column."""
    return view.agg(
        F.count("*").alias("count"),
        F.coalesce(F.sum(utf16_length(text_column)), F.lit(0)).cast("bigint").alias("total_characters"),
    )
