"""Link maps: distinct internal and external URLs of each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.text import sort_by_code_unit
from pagelens.functions.urls import normalize_plain, with_plain_host
from pagelens.sources import records as R
from pagelens.sources.records import LINK_TYPE

KEYS = ("request_id", "target")


def _tagged(bucket: str) -> Column:
    return F.transform(
        F.coalesce(F.col(f"{bucket}_links"), F.array().cast(LINK_TYPE)),
        lambda x: F.struct(F.lit(bucket).alias("bucket"), x["href"].alias("href")),
    )


def link_rows(records: DataFrame) -> DataFrame:
    """Every link as a row ``(request_id, target, bucket, url)``, URL normalised.

    Links of a target that are written alike are one row for each bucket: they collapse
    before their URL is normalised, once for both buckets. The page text is dropped before
    the rows fan out. What is no valid http(s) URL is left out while in an array: a filter
    behind the projection would be moved below it and normalise every URL twice.
    """
    tagged = records.select(*KEYS, F.explode(F.concat(_tagged("internal"), _tagged("external"))).alias("x")).select(*KEYS, "x.*")
    held = [F.bool_or(F.col("bucket") == b).alias(b) for b in ("internal", "external")]
    written = tagged.groupBy(*KEYS, "href").agg(*held)
    plain = written.withColumn("href", with_plain_host("href"))
    found = F.filter(F.array(normalize_plain("href")), lambda url: url.isNotNull())
    urls = plain.select(*KEYS, "internal", "external", F.explode(found).alias("url"))
    buckets = F.array_compact(F.array(*[F.when(F.col(b), b) for b in ("internal", "external")]))
    return urls.select(*KEYS, F.explode(buckets).alias("bucket"), "url")


def link_map(records: DataFrame) -> DataFrame:
    """One row per (target, URL) with its bucket; internal wins over external.

    Dedupe and overlap removal are one aggregation on (target, url): copies
    collapse before the shuffle and a busy target spreads over its URLs.
    """
    is_internal = F.col("bucket") == "internal"
    bucket = F.when(F.bool_or(is_internal), "internal").otherwise("external")
    return link_rows(records).groupBy(*KEYS, "url").agg(bucket.alias("bucket"))


def overlap_free_external(links: DataFrame) -> DataFrame:
    """External link rows whose URL is not an internal one of the same target.

    One aggregation, so the links are read once; a row without all of its keys equals no other.
    """
    is_internal = F.col("bucket") == "internal"
    sides = links.filter(F.col("bucket").isin("internal", "external")).groupBy(*KEYS, "url")
    found = sides.agg(F.bool_or(~is_internal).alias("external"), F.bool_or(is_internal).alias("internal"))
    unknown = F.col("request_id").isNull() | F.col("target").isNull() | F.col("url").isNull()
    return found.filter(F.col("external") & (~F.col("internal") | unknown)).select(*KEYS, "url")


def link_counts(mapped: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Totals per target of a ``link_map``; with its records, zeros for usable ones without a valid link."""
    rows = mapped.select(
        *KEYS, *[(F.col("bucket") == b).cast("bigint").alias(b) for b in ("internal", "external")]
    )
    if records is not None:
        zero = F.lit(0).cast("bigint")
        seen = R.usable(records, R.has_links) if "has_links" in records.columns else records
        rows = rows.unionByName(seen.select(*KEYS, zero.alias("internal"), zero.alias("external")))
    return rows.groupBy(*KEYS).agg(
        F.sum(F.col("internal") + F.col("external")).alias("total"),
        F.sum("internal").alias("internal"),
        F.sum("external").alias("external"),
    )


def link_lists(mapped: DataFrame) -> DataFrame:
    """Sorted URL lists per target. A list holds what one payload or page held."""
    def listed(bucket: str) -> Column:
        return F.collect_list(F.when(F.col("bucket") == bucket, F.col("url")))

    lists = mapped.groupBy(*KEYS).agg(listed("internal").alias("internal"), listed("external").alias("external"))
    every = {"internal": F.col("internal"), "external": F.col("external"), "all": F.concat("internal", "external")}
    return lists.select(*KEYS, *[sort_by_code_unit(c).alias(n) for n, c in every.items()])
