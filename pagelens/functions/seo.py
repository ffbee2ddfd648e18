"""Head fields of an html page: title, named meta tags, canonical link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.text import strip_ws

# The fields of an SEO record.
PLAIN_FIELDS = ("title", "description", "keywords", "robots", "canonical")
OG_FIELDS = ("title", "description", "image", "url", "type")
TWITTER_FIELDS = ("card", "title", "description", "image")

_QUOTE = "[\"']"


def _attribute(tag: Column, name: str) -> Column:
    return strip_ws(F.regexp_extract(tag, rf"(?i){name}\s*=\s*[\"']([^\"']+)[\"']", 1))


def _first_tag(tags: Column, tag: str, attribute: str, value: str) -> Column:
    return F.regexp_extract(tags, rf"(?i)<{tag}[^>]+{attribute}={_QUOTE}{value}{_QUOTE}[^>]*>", 0)


def head_tags(html: Column) -> Column:
    """All meta and link tags in one string, found in one pass over the page.

    A meta or link tag never holds ``>``, so looking a field up in this short
    string finds the same first tag as looking through the page.
    """
    return F.array_join(F.regexp_extract_all(html, F.lit(r"(?i)<(?:meta|link)[^>]+>"), F.lit(0)), "")


def page_title(html: Column) -> Column:
    return strip_ws(F.regexp_extract(html, r"(?i)<title[^>]*>([\s\S]*?)</title>", 1))


def meta_named(tags: Column, name: str) -> Column:
    return _attribute(_first_tag(tags, "meta", "name", name), "content")


def meta_property(tags: Column, name: str) -> Column:
    return _attribute(_first_tag(tags, "meta", "property", name), "content")


def canonical_link(tags: Column) -> Column:
    return _attribute(_first_tag(tags, "link", "rel", "canonical"), "href")
