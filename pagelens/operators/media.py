"""Media inventories: distinct images, videos and audios of each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.text import if_non_blank, non_empty
from pagelens.functions.urls import resolve_against, url_parts, with_plain_host
from pagelens.operators.ranking import spread_rank
from pagelens.sources import records as R

KEYS = ("request_id", "target")
# Bucket name, default entry type, in the order they are listed.
BUCKETS = (("images", "image"), ("videos", "video"), ("audios", "audio"))
ATTRIBUTES = ("alt", "format", "score", "width", "height", "group_id")


def _tagged(position: int, bucket: str, kind: str) -> Column:
    """The entries of one bucket with their place in it, sources as they were written."""
    return F.transform(
        F.coalesce(F.col(bucket), F.array().cast(R.MEDIA_TYPE)),
        lambda m, i: F.struct(
            F.lit(bucket).alias("bucket"), F.coalesce(if_non_blank(m["type"]), F.lit(kind)).alias("type"), m["src"].alias("src"),
            F.struct(i.alias("pos"), F.lit(position).alias("bucket_pos"), *[m[a].alias(a) for a in ATTRIBUTES]).alias("entry"),
        ),
    )


def _written_rows(records: DataFrame) -> DataFrame:
    """Every media entry as a row with its source as written and the page it is seen from.

    Records are dealt anew before they fan out: however few files or row groups hold them,
    all tasks share the entries.
    """
    page = F.coalesce(non_empty("url"), non_empty("redirected_url"), F.col("target"))
    dealt = R.usable(records, R.has_media).select(*KEYS, "record_pos", page.alias("page"), *[b for b, _ in BUCKETS])
    items = F.concat(*[_tagged(n, b, k) for n, (b, k) in enumerate(BUCKETS)])
    return dealt.repartition(*KEYS, "record_pos").select(*KEYS, "record_pos", "page", F.explode(items).alias("m")).select(
        *KEYS, "page", "m.bucket", "m.type", "m.src", F.struct("record_pos", "m.entry.*").alias("first")
    )


def _located(rows: DataFrame) -> DataFrame:
    """The rows with absolute source URLs instead of those written on ``page``; rows without a source are left out."""
    kept = [c for c in rows.columns if c not in ("page", "src")]
    # Left out while in an array: a filter behind the projection would be moved below it and resolve every source twice.
    found = F.filter(F.array(resolve_against("src", F.col("parts"))), lambda s: s.isNotNull())
    located = rows.withColumn("parts", url_parts(with_plain_host("page")))
    return located.select(*kept, F.explode(F.transform(found, with_plain_host)).alias("src"))


def _first(columns: tuple[str, ...], order: tuple[str, ...]) -> Column:
    """The attributes of the first entry; copies collapse before the shuffle."""
    return F.min_by(F.struct(*columns), F.struct(*order))


def media_inventory(records: DataFrame) -> DataFrame:
    """One row per (target, bucket, type, src) with the first entry's attributes.

    Entries that are written alike on the same page collapse first, so a source is
    resolved once for all of them.
    """
    # The first by place; between entries of one place the rest of them decides.
    first = F.min("first").alias("first")
    written = _written_rows(records).groupBy(*KEYS, "page", "bucket", "type", "src").agg(first)
    found = _located(written).groupBy(*KEYS, "bucket", "type", "src").agg(first)
    attributes = [(if_non_blank(F.col(f"first.{a}")) if a in ("alt", "format") else F.col(f"first.{a}")).alias(a) for a in ATTRIBUTES]
    return found.select(*KEYS, "bucket", "type", "src", "first.bucket_pos", *attributes)


def media_all(inventory: DataFrame) -> DataFrame:
    """The inventory without buckets: an entry of the same type and source counts once,
    with the attributes of its first bucket (images, videos, audios)."""
    return (
        inventory.groupBy(*KEYS, "type", "src")
        .agg(_first(ATTRIBUTES, ("bucket_pos",)).alias("first"))
        .select(*KEYS, "type", "src", "first.*")
    )


def media_counts(inventory: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Counts per target: distinct entries over all buckets, and per bucket; with the
    records, zeros for those that can hold media but have no entry."""
    # An entry listed in several buckets is counted in total by its first bucket.
    per_entry = inventory.groupBy(*KEYS, "type", "src").agg(
        *[F.max((F.col("bucket") == b).cast("bigint")).alias(b) for b, _ in BUCKETS]
    )
    rows = per_entry.select(*KEYS, F.lit(1).cast("bigint").alias("total"), *[b for b, _ in BUCKETS])
    if records is not None:
        zero = F.lit(0).cast("bigint")
        seen = R.usable(records, R.has_media)
        rows = rows.unionByName(seen.select(*KEYS, zero.alias("total"), *[zero.alias(b) for b, _ in BUCKETS]))
    return rows.groupBy(*KEYS).agg(F.sum("total").alias("total"), *[F.sum(b).alias(b) for b, _ in BUCKETS])


def media_listing(items: DataFrame, locale: str = "UNICODE") -> DataFrame:
    """Entries in reading order: by source, then type, in the order of the locale."""
    return items.orderBy(*KEYS, F.collate("src", locale), F.collate("type", locale))


def locale_rank(items: DataFrame, column: str, locale: str = "UNICODE") -> DataFrame:
    """Items with their ``place`` within their request in the order of the locale."""
    return spread_rank(items, "request_id", [F.collate(column, locale)], "place")
