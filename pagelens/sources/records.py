"""Typed crawl records.

A crawl record is a loose JSON object. Each field is typed once here; every view
and predicate works on the typed columns, whichever source they come from.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.text import let, non_blank, non_empty, strip_ws

Fields = Mapping[str, Column]
Predicate = Callable[[Fields], Column]

LINK_TYPE = "array<struct<href:string,text:string,title:string>>"
MEDIA_TYPE = (
    "array<struct<src:string,type:string,alt:string,format:string,"
    "score:double,width:double,height:double,group_id:double>>"
)
MARKDOWN_KEYS = ("raw_markdown", "markdown_with_citations", "references_markdown", "fit_markdown")
KEY_COLUMNS = ("request_id", "target", "record_pos", "fallback_url")


def _get(v: Column, path: str, dtype: str = "variant") -> Column:
    return F.try_variant_get(v, path, dtype)


def _kind(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, ... of a small value; NULL for a missing one."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    """A shallow test: the schema of a whole record would visit every link in it."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def string_at(v: Column, path: str) -> Column:
    """The field if it is a JSON string. A plain cast would print objects as text."""
    return let(_get(v, path), lambda x: F.when(_kind(x) == "STRING", x.cast("string")))


def number_at(v: Column, path: str) -> Column:
    number = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z"
    return let(_get(v, path), lambda x: F.when(_kind(x).rlike(number), x.try_cast("double")))


def truthy_text_at(v: Column, path: str) -> Column:
    """Any value that counts as true, as text; NULL for a missing, empty, zero or false one."""

    def text(x: Column) -> Column:
        empty_scalar = (_kind(x) != "STRING") & x.try_cast("string").rlike(r"^(false|-?0(\.0+)?)\z")
        return F.when(~F.coalesce(empty_scalar, F.lit(False)), non_empty(x.try_cast("string")))

    return let(_get(v, path), text)


def _link_entry(x: Column) -> Column:
    is_text = _kind(x) == "STRING"
    return F.struct(
        F.when(is_text, x.try_cast("string")).otherwise(string_at(x, "$.href")).alias("href"),
        F.when(~is_text, truthy_text_at(x, "$.text")).alias("text"),
        F.when(~is_text, truthy_text_at(x, "$.title")).alias("title"),
    )


def _media_entry(x: Column) -> Column:
    is_text = _kind(x) == "STRING"
    attributes = {name: string_at(x, f"$.{name}") for name in ("type", "alt", "format")}
    sizes = {name: number_at(x, f"$.{name}") for name in ("score", "width", "height", "group_id")}
    # The first of src, href and url that holds something decides, text or not.
    source = F.coalesce(*[
        F.when(truthy_text_at(x, f"$.{name}").isNotNull(), F.coalesce(string_at(x, f"$.{name}"), F.lit("")))
        for name in ("src", "href", "url")
    ])
    return F.struct(
        F.when(is_text, x.try_cast("string")).otherwise(source).alias("src"),
        *[value.alias(name) for name, value in {**attributes, **sizes}.items()],
    )


def _entries(v: Column, path: str, entry: Callable[[Column], Column], dtype: str) -> Column:
    return F.transform(_get(v, path, "array<variant>"), entry).cast(dtype)


def _screenshot(v: Column) -> Column:
    """Text form, then the object form, then the three flat fields."""
    text = string_at(v, "$.screenshot")
    as_text = F.when(non_blank(text), text)

    def held(path: str) -> Column:
        s = string_at(v, path)
        return F.when(non_blank(s), s)

    def shot(screenshot: Column | None = None, url: Column | None = None, base64: Column | None = None) -> Column:
        null = F.lit(None).cast("string")
        parts = {"screenshot": screenshot, "url": url, "base64": base64}
        return F.struct(*[(null if c is None else c).alias(n) for n, c in parts.items()])

    url, base64 = held("$.screenshot.url"), held("$.screenshot.base64")
    flat_url = held("$.screenshot_url")
    flat_base64 = F.coalesce(held("$.screenshot_base64"), held("$.screenshotBase64"))
    return (
        F.when(as_text.isNotNull(), shot(screenshot=strip_ws(as_text)))
        .when(url.isNotNull() | base64.isNotNull(), shot(url=url, base64=base64))
        .when(flat_url.isNotNull(), shot(url=flat_url))
        .when(flat_base64.isNotNull(), shot(base64=flat_base64))
    )


def _success(v: Column) -> Column:
    """True only for the JSON literal true."""
    value = _get(v, "$.success")
    return F.coalesce((_kind(value) == "BOOLEAN") & value.try_cast("boolean"), F.lit(False))


def _has_links(v: Column) -> Column:
    links = _get(v, "$.links")
    return is_object(links) | is_array(links) | truthy_text_at(v, "$.links").isNotNull()


def _metadata(v: Column) -> Column:
    metadata = _get(v, "$.metadata")
    return F.when(is_object(metadata), metadata.try_cast("map<string,string>"))


_READERS: dict[str, Callable[[Column], Column]] = {
    "url": lambda v: truthy_text_at(v, "$.url"),
    "redirected_url": lambda v: truthy_text_at(v, "$.redirected_url"),
    "url_text": lambda v: string_at(v, "$.url"),
    "redirected_url_text": lambda v: string_at(v, "$.redirected_url"),
    "success": _success,
    "status_code": lambda v: _get(v, "$.status_code", "int"),
    "status_is_number": lambda v: number_at(v, "$.status_code").isNotNull(),
    "html": lambda v: string_at(v, "$.html"),
    "markdown_text": lambda v: string_at(v, "$.markdown"),
    "markdown": lambda v: F.struct(*[string_at(v, f"$.markdown.{k}").alias(k) for k in MARKDOWN_KEYS]),
    "metadata": _metadata,
    "metadata_value": lambda v: _get(v, "$.metadata"),
    "has_metadata": lambda v: is_object(_get(v, "$.metadata")) | is_array(_get(v, "$.metadata")),
    "has_links": _has_links,
    "internal_links": lambda v: _entries(v, "$.links.internal", _link_entry, LINK_TYPE),
    "external_links": lambda v: _entries(v, "$.links.external", _link_entry, LINK_TYPE),
    "has_media": lambda v: is_object(_get(v, "$.media")),
    "images": lambda v: _entries(v, "$.media.images", _media_entry, MEDIA_TYPE),
    "videos": lambda v: _entries(v, "$.media.videos", _media_entry, MEDIA_TYPE),
    "audios": lambda v: _entries(v, "$.media.audios", _media_entry, MEDIA_TYPE),
    "screenshot": _screenshot,
}
ALL_FIELDS = tuple(_READERS)
HEADER_FIELDS = ("url", "redirected_url", "success", "status_code")
# What each kind of record filter reads, beside the header.
FIELDS = {
    "metadata": ("url_text", "redirected_url_text", "status_is_number", "metadata"),
    "html": ("html",),
    "markdown": ("markdown_text", "markdown"),
    "text": ("markdown_text", "markdown", "html"),
    "seo": ("has_metadata", "metadata_value", "html"),
    "extract": ("markdown_text", "markdown", "html"),
    "screenshot": ("screenshot",),
    "media": ("has_media", "images", "videos", "audios"),
    "map": ("has_links", "internal_links", "external_links"),
    "bulk": (),
    "emails": ("markdown_text", "markdown", "html", "internal_links", "external_links"),
}


class VariantFields(Mapping):
    """Typed columns of one record held as VARIANT, written down when asked for."""

    def __init__(self, v: Column):
        self._v = v

    def __getitem__(self, name: str) -> Column:
        return _READERS[name](self._v)

    def __iter__(self):
        return iter(_READERS)

    def __len__(self) -> int:
        return len(_READERS)


def frame_fields(records: DataFrame) -> dict[str, Column]:
    """The same mapping for records that are already typed columns."""
    return {name: F.col(name) for name in records.columns}


# Record filters: which records a view can use.


def has_html(r: Fields) -> Column:
    return non_blank(r["html"])


def has_markdown(r: Fields) -> Column:
    keep = non_blank(r["markdown_text"])
    for key in MARKDOWN_KEYS:
        keep = keep | non_blank(r["markdown"][key])
    return keep


def has_text(r: Fields) -> Column:
    keep = non_blank(r["markdown_text"]) | non_blank(r["html"])
    for key in ("raw_markdown", "fit_markdown", "markdown_with_citations"):
        keep = keep | non_blank(r["markdown"][key])
    return keep


def has_seo(r: Fields) -> Column:
    return r["has_metadata"] | non_blank(r["html"])


def has_media(r: Fields) -> Column:
    return r["has_media"]


def has_links(r: Fields) -> Column:
    return r["has_links"]


def is_metadata_record(r: Fields) -> Column:
    return (
        non_blank(r["url_text"])
        | non_blank(r["redirected_url_text"])
        | r["status_is_number"]
        | r["metadata"].isNotNull()
    )


def is_extractable(r: Fields) -> Column:
    """Has markdown or html; html of tags only strips to spaces and still counts."""
    return non_blank(r["markdown"]["raw_markdown"]) | non_blank(r["markdown_text"]) | non_blank(r["html"])


def has_screenshot(r: Fields) -> Column:
    return r["screenshot"].isNotNull()


def any_record(r: Fields) -> Column:
    return F.lit(True)


def usable(records: DataFrame, predicate: Predicate) -> DataFrame:
    return records.filter(predicate(frame_fields(records)))


PREDICATES: dict[str, Predicate] = {
    "metadata": is_metadata_record,
    "html": has_html,
    "markdown": has_markdown,
    "text": has_text,
    "seo": has_seo,
    "extract": is_extractable,
    "screenshot": has_screenshot,
    "media": has_media,
    "map": has_links,
    "bulk": any_record,
    "emails": any_record,
}
