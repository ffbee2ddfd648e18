"""Email discovery: contact pages of each seed, and the emails found on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.contacts import emails_for_index
from pagelens.functions.numbers import loose_number
from pagelens.functions.text import if_non_blank, sort_by_code_unit
from pagelens.functions.urls import normalized
from pagelens.operators.ranking import spread_rank
from pagelens.operators.views import record_url

# Words that mark a contact page.
CONTACT_WORDS = ("contact", "about", "info", "support", "help", "team", "company")
# Bits of the filter that keeps pages nobody scans from being searched.
SLOTS = 1 << 23
# Sources of an address in one list.
CHUNK = 10_000


def is_contact_link(href: Column, text: Column, title: Column) -> Column:
    words = f"(?i){'|'.join(CONTACT_WORDS)}"
    hit = F.lit(False)
    for c in (href, text, title):
        hit = hit | F.coalesce(c.rlike(words), F.lit(False))
    return hit


def page_limit(c: str | Column) -> Column:
    """Scanned pages a request asks for: a whole number from 1 on; NULL, which is no limit, for anything else."""
    n = F.floor(loose_number(c))
    return F.when(n >= 1, n).cast("bigint")


def seed_links(records: DataFrame) -> DataFrame:
    """Internal links of each seed's first record, as rows."""
    return records.filter(F.col("record_pos") == 0).select(
        "target", F.explode("internal_links").alias("link")
    ).select("target", "link.*")


def contact_pages(links: DataFrame) -> DataFrame:
    """Distinct normalised contact pages per seed."""
    is_contact = is_contact_link(F.col("href"), F.col("text"), F.col("title"))
    return (
        normalized(links.filter(is_contact), F.col("href"), "page_url").select("target", "page_url").filter("page_url IS NOT NULL")
        .distinct()
    )


def scanned_pages(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pages to scan per seed: the seed, then its candidates by URL; all of them, or as
    many as the request names.

    ``seeds(target, max_pages)`` has one row per seed. Places are found without
    bringing the pages of a seed together.
    """
    own = normalized(seeds.select("target"), F.col("target"), "page_url").withColumn("is_seed", F.lit(True))
    linked = candidates.select("target", "page_url", F.lit(False).alias("is_seed"))
    pages = own.unionByName(linked).groupBy("target", "page_url").agg(F.max("is_seed").alias("is_seed"))
    ranked = spread_rank(pages, "target", [F.col("is_seed").desc(), F.col("page_url")], "position")
    limits = seeds.select("target", page_limit("max_pages").alias("page_limit"))
    wanted = F.col("page_limit").isNull() | (F.col("position") <= F.col("page_limit"))
    return ranked.join(limits, "target").filter(wanted).select("target", "page_url", "is_seed", "position")


def scanned_coverage(scanned: DataFrame, records: DataFrame) -> DataFrame:
    """The scanned list with the number of stored records per page; a page without one stays."""
    stored = (
        normalized(records, record_url(), "page_url").select("page_url")
        .groupBy("page_url")
        .agg(F.count("*").alias("records"))
    )
    return scanned.join(stored, "page_url", "left").na.fill(0, ["records"])


def _scan_text() -> Column:
    """Raw markdown, text markdown, else the html as it is."""
    return F.coalesce(
        if_non_blank(F.col("markdown")["raw_markdown"]), if_non_blank("markdown_text"), if_non_blank("html")
    )


def _link_targets() -> Column:
    empty = F.array().cast("array<string>")
    return F.concat(*[
        F.coalesce(F.transform(f"{b}_links", lambda x: x["href"]), empty) for b in ("internal", "external")
    ])


def record_emails(records: DataFrame) -> DataFrame:
    """Emails of each record with ``page_url``: ``(page_url, source, email)``, found before any shuffle."""
    scanned = records.select(
        "page_url", record_url().alias("source"), _scan_text().alias("scan_text"), _link_targets().alias("hrefs")
    )
    found = emails_for_index("scan_text", F.col("hrefs"))
    return scanned.select("page_url", "source", F.explode(found).alias("email"))


def _slot(url: str) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(SLOTS)) + 1


def scanned_filter(scanned: DataFrame) -> DataFrame:
    """The scanned URLs as a bitmap of ``SLOTS`` bits: rows (bucket, bits), a megabyte at most."""
    slot = scanned.select(_slot("page_url").alias("slot"))
    return slot.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )


def _maybe_scanned(records: DataFrame, scanned: DataFrame) -> DataFrame:
    """Records whose URL may be a scanned one. They stay where they were read; the bitmap goes to them."""
    located = normalized(records, record_url(), "page_url")
    placed = located.filter("page_url IS NOT NULL").withColumn("bucket", F.bitmap_bucket_number(_slot("page_url")))
    place = F.bitmap_bit_position(_slot("page_url"))
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftleft(1, CAST(bitmap_bit_position(pmod(xxhash64(page_url), %d) + 1) %% 8 AS INT))" % SLOTS)
    return placed.join(F.broadcast(scanned_filter(scanned)), "bucket").filter(byte.bitwiseAND(bit) != 0).drop("bits", "bucket")


def email_index(scanned: DataFrame, records: DataFrame) -> DataFrame:
    """One row per (target, email, source).

    Records that no seed scans are left out before their text is searched, by a bitmap
    of fixed size. Emails are pulled out in the scan stage, so only short rows reach the
    join with the scanned pages; the page text never does.
    """
    return (
        scanned.select("target", "page_url")
        .join(record_emails(_maybe_scanned(records, scanned)), "page_url")
        .select("target", "email", "source")
        .distinct()
    )


def email_sources(index: DataFrame) -> DataFrame:
    """Sorted sources per (target, email). A list holds the pages that show one address;
    ``email_source_chunks`` is for addresses that stand on very many."""
    lists = index.groupBy("target", "email").agg(F.collect_list("source").alias("sources"))
    return lists.withColumn("sources", sort_by_code_unit(F.col("sources")))


def email_source_chunks(index: DataFrame, size: int = CHUNK) -> DataFrame:
    """``email_sources`` in lists of at most ``size`` sources: (target, email, chunk from 0, sources).

    The chunks of an address, one behind the other, are its list. Sources are placed over
    range partitions, so no task holds more of an address than one partition or one chunk.
    """
    keyed = index.select(F.struct("target", "email").alias("address"), "source", F.encode("source", "UTF-16BE").alias("unit"))
    placed = spread_rank(keyed, "address", [F.col("unit")], "place")
    chunk = F.floor((F.col("place") - 1) / size).cast("int").alias("chunk")
    lists = placed.groupBy("address", chunk).agg(F.array_sort(F.collect_list(F.struct("place", "source"))).alias("found"))
    return lists.select("address.target", "address.email", "chunk", F.col("found.source").alias("sources"))


def email_counts(scanned: DataFrame, candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Per seed: pages scanned, candidate pages and emails found."""
    found = index.select("target", "email").distinct()
    parts = [
        df.groupBy("target").agg(F.count("*").alias(name))
        for df, name in ((scanned, "pages_scanned"), (candidates, "candidate_pages"), (found, "emails_found"))
    ]
    counts = parts[0].join(parts[1], "target", "left").join(parts[2], "target", "left")
    return counts.na.fill(0, ["candidate_pages", "emails_found"])


def email_listing(sources: DataFrame, locale: str = "UNICODE") -> DataFrame:
    """Emails of each seed in the order of the locale."""
    return sources.orderBy("target", F.collate("email", locale))
