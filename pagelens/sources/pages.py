"""A crawled page table (page_id, url, html) as crawl records.

Links are read from the page's anchors and areas, media from its image, video, audio and
source tags, seen from the page's base address if it names one. A link is internal when its
host is the page's, a sub-domain of it, or the domain above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.markup import anchors, attribute, source_set, start_tags
from pagelens.functions.text import let, non_empty
from pagelens.functions.urls import base_parts, printed_host, resolve_against, same_site, url_parts, with_plain_host, written_out
from pagelens.sources.records import ALL_FIELDS, HEADER_FIELDS, LINK_TYPE, MARKDOWN_KEYS, MEDIA_TYPE

MEDIA_FIELDS = ("images", "videos", "audios")


def _number(text: Column) -> Column:
    return F.regexp_extract(text, r"^([0-9]+)(?:px)?\z", 1).try_cast("double")


def _base(tags: Column) -> Column:
    """The page's own idea of its address: the first ``base`` tag with one; NULL without."""
    named = F.filter(tags, lambda t: (t["tag"] == "base") & (attribute(t, "href") != ""))
    return let(F.get(named, F.lit(0)), lambda t: F.when(t.isNotNull(), attribute(t, "href")))


def _with_base(source: DataFrame) -> DataFrame:
    """``tags`` seen from ``base``, the parts of the base address or of the page's."""
    # In steps, as the analyzer goes over nested lambdas again for each level.
    located = source.withColumn("plain", with_plain_host("url")).withColumn("own", url_parts("plain")).withColumn("named", _base(F.col("tags")))
    return located.withColumn("base", F.when(F.col("named").isNull(), F.col("own")).otherwise(base_parts(F.col("named"), F.col("own"))))


def _link(tag: Column) -> Column:
    area = tag["tag"] == "area"
    return F.struct(
        resolve_against(attribute(tag, "href"), F.col("base")).alias("href"),
        F.when(area, attribute(tag, "alt")).otherwise(tag["text"]).alias("text"),
        attribute(tag, "title").alias("title"),
    )


def _entry(tag: Column, src: Column, width: Column | None = None, height: Column | None = None) -> Column:
    null, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return F.struct(
        # The inventory resolves addresses against the page; what a base tag says is put in front of them here.
        F.when(F.col("named").isNotNull() & (src != ""), written_out(src, F.col("base"))).otherwise(src).alias("src"),
        null.alias("type"),
        non_empty(attribute(tag, "alt")).alias("alt"),
        null.alias("format"),
        no_number.alias("score"),
        (no_number if width is None else width).alias("width"),
        (no_number if height is None else height).alias("height"),
        no_number.alias("group_id"),
    )


def _own_source(tag: Column) -> Column:
    """``src``, or the address that a script puts there later."""
    return let(attribute(tag, "src"), lambda s: F.when(s != "", s).otherwise(attribute(tag, "data-src")))


def _images(tag: Column) -> Column:
    """Entries of one tag: an image and its variants, a picture's sources, a video's poster."""
    name, sized = tag["tag"], (_number(attribute(tag, "width")), _number(attribute(tag, "height")))
    kind = F.lower(attribute(tag, "type"))
    variants = F.concat(source_set(attribute(tag, "srcset")), source_set(attribute(tag, "data-srcset")))
    own = F.when(name == "img", F.struct(_own_source(tag).alias("src"), sized[0].alias("width"), sized[1].alias("height"))).when(
        name == "video", F.struct(attribute(tag, "poster").alias("src"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"))
    )
    others = F.when((name == "img") | ((name == "source") & ~kind.rlike("^(?:audio|video)")), variants)
    every = F.concat(
        F.array_compact(F.array(own)),
        F.transform(F.coalesce(others, F.array().cast("array<struct<src:string,width:double>>")),
                    lambda v: F.struct(v["src"].alias("src"), v["width"].alias("width"), F.lit(None).cast("double").alias("height"))),
    )
    return F.transform(every, lambda e: _entry(tag, e["src"], e["width"], e["height"]))


def _media(kind: str) -> Column:
    if kind == "image":
        entries = F.flatten(F.transform("tags", _images))
    else:
        # A source tag belongs to the kind its type attribute names; video if it names none.
        def belongs(tag: Column) -> Column:
            is_audio = F.lower(attribute(tag, "type")).startswith("audio")
            return (tag["tag"] == kind) | ((tag["tag"] == "source") & (is_audio if kind == "audio" else ~is_audio))

        entries = F.transform(
            F.filter("tags", belongs), lambda t: _entry(t, _own_source(t), _number(attribute(t, "width")), _number(attribute(t, "height")))
        )
    return F.filter(entries, lambda m: m["src"] != "").cast(MEDIA_TYPE)


def _placed(links: Column, host: Column) -> Column:
    """Each link with the bucket it belongs to; a link that is no web page is external."""

    def place(x: Column) -> Column:
        internal = let(printed_host(x["href"]), lambda own: same_site(own, host))
        return F.struct(x.alias("link"), F.coalesce(internal, F.lit(False)).alias("internal"))

    return F.transform(F.filter(links, lambda x: x["href"].isNotNull()), place)


def _bucket(internal: bool) -> Column:
    kept = F.filter("links", lambda x: x["internal"] if internal else ~x["internal"])
    return F.transform(kept, lambda x: x["link"]).cast(LINK_TYPE)


def _no_text() -> Column:
    return F.lit(None).cast("string")


_READERS = {
    "url": lambda: F.col("url"),
    "redirected_url": _no_text,
    "url_text": lambda: F.col("url"),
    "redirected_url_text": _no_text,
    # A stored page was fetched; its status code is not part of the table.
    "success": lambda: F.lit(True),
    "status_code": lambda: F.lit(None).cast("int"),
    "status_is_number": lambda: F.lit(False),
    "html": lambda: F.col("html"),
    "markdown_text": _no_text,
    "markdown": lambda: F.struct(*[_no_text().alias(k) for k in MARKDOWN_KEYS]),
    "metadata": lambda: F.lit(None).cast("map<string,string>"),
    "metadata_value": lambda: F.lit(None).cast("variant"),
    "has_metadata": lambda: F.lit(False),
    "has_links": lambda: F.lit(True),
    "internal_links": lambda: _bucket(internal=True),
    "external_links": lambda: _bucket(internal=False),
    "has_media": lambda: F.lit(True),
    "images": lambda: F.col("images"),
    "videos": lambda: F.col("videos"),
    "audios": lambda: F.col("audios"),
    "screenshot": lambda: F.lit(None).cast("struct<screenshot:string,url:string,base64:string>"),
}


def records_from_pages(pages: DataFrame, fields: tuple[str, ...] = ALL_FIELDS) -> DataFrame:
    """Typed crawl records of a page table; each page is its own target. Row-local."""
    wanted = dict.fromkeys((*HEADER_FIELDS, *fields))
    source = pages.select(F.col("page_id").cast("string").alias("request_id"), "url", "html")
    kept = ["request_id", "url", "html"]
    if {"internal_links", "external_links"} & set(wanted):
        # The page's own URL is taken apart once for all its links.
        located = _with_base(source.withColumn("tags", anchors(F.col("html"), "area", "base")))
        located = located.withColumn("links", F.transform(F.filter("tags", lambda t: t["tag"] != "base"), _link))
        located = located.withColumn("links", F.transform("links", lambda x: x.withField("href", with_plain_host(x["href"]))))
        source = located.select(*kept, _placed(F.col("links"), F.get("own", F.lit(2))).alias("links"))
        kept.append("links")
    media = [m for m in MEDIA_FIELDS if m in wanted]
    if media:
        located = _with_base(source.withColumn("tags", start_tags(F.col("html"), "img", "video", "audio", "source", "base")))
        source = located.select(*kept, *[_media(m.removesuffix("s")).alias(m) for m in media])
    return source.select(
        "request_id",
        F.col("url").alias("target"),
        F.lit(0).alias("record_pos"),
        F.col("url").alias("fallback_url"),
        *[_READERS[name]().alias(name) for name in wanted],
    )
