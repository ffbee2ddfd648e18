"""Start tags of a page and their attributes, read the way a browser reads them.

One pattern walks over comments, elements whose content is no markup (scripts, styles, text
fields), end tags and start tags with quoted values, so what stands inside any of them is
never taken for a tag. Every alternative matches wherever it begins and all groups repeat
possessively, so a page of any length takes constant stack and time in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.text import decode_references, let, strip_ws, without_open_tags

# Attributes up to the end of the tag; a quote counts behind an equals sign only.
_REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+(?:>|\z)"""
_START = rf"<[a-zA-Z][^\s/>]*+{_REST}"
_COMMENT = r"<!--(?:-?>|[\s\S]*?(?:--!?>|\z))"
# End tags, declarations, processing instructions.
_OTHER = r"<[!?/][^>]*+(?:>|\z)"
_CLOSED_A = r"</a(?=[\s/>])[^>]*+(?:>|\z)"
# Elements whose content is text to the parser.
_TEXT_ELEMENTS = "script|style|textarea|title|xmp|iframe|noembed|noframes"
# A block tag ends an anchor that has no end tag.
_BLOCK_TAG = (
    r"(?i)</?(?:address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|"
    r"nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)(?=[\s/>])[\s\S]*"
)
_ATTRIBUTE = r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+"""


def _text_element(group: int) -> str:
    """A text element to its end; ``group`` is the number of the pattern's group for its name."""
    return rf"<({_TEXT_ELEMENTS})(?=[\s/>]){_REST}[\s\S]*?(?:</\{group}(?=[\s/>])[^>]*+(?:>|\z)|\z)"


def _tokens(wanted: str) -> str:
    """All markup; the second group holds what matches ``wanted``, which may have a third group."""
    return rf"(?i){_COMMENT}|{_text_element(1)}|({wanted})|{_OTHER}|{_START}"


def _named(names: tuple[str, ...]) -> str:
    return rf"<(?:{'|'.join(names)})(?=[\s/>]){_REST}"


# An anchor runs to its end tag; where that is missing, to the next anchor.
_CONTENT = rf"(?:[^<]++|{_COMMENT}|{_text_element(3)}|(?!</?a(?:rea)?[\s/>])(?:{_OTHER}|{_START})|<(?![a-zA-Z!?/]))*+"
_ANCHOR = rf"<a(?=[\s/>]){_REST}{_CONTENT}(?:{_CLOSED_A})?+"
_MARKUP = rf"(?i){_COMMENT}|{_text_element(1)}|{_OTHER}|{_START}"


def _attributes(start: Column) -> Column:
    """Names in lower case and values of a start tag's attributes, in order."""
    body = F.regexp_replace(start, r"\A<[^\s/>]+", "")

    def value(raw: Column) -> Column:
        quoted = raw.rlike("""^(?:"[\\s\\S]*"|'[\\s\\S]*')\\z""")
        return decode_references(F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))

    return let(body, lambda b: F.struct(
        F.transform(F.regexp_extract_all(b, F.lit(_ATTRIBUTE), F.lit(1)), F.lower).alias("names"),
        F.transform(F.regexp_extract_all(b, F.lit(_ATTRIBUTE), F.lit(2)), value).alias("values"),
    ))


def _anchor_text(token: Column, start: Column) -> Column:
    inner = F.substring(token, F.length(start) + 1, F.length(token))
    closed = token.rlike(rf"(?i){_CLOSED_A}\z")
    return strip_ws(F.regexp_replace(F.when(closed, inner).otherwise(F.regexp_replace(inner, _BLOCK_TAG, "")), _MARKUP, " "))


def _read(token: Column) -> Column:
    def parts(start: Column) -> Column:
        name = F.lower(F.regexp_extract(start, r"\A<([^\s/>]+)", 1))
        return F.struct(
            name.alias("tag"), _attributes(start).alias("attributes"),
            F.when(name == "a", _anchor_text(token, start)).otherwise("").alias("text"),
        )

    return let(F.regexp_extract(token, rf"(?i)\A{_START}", 0), parts)


def _all(html: Column, wanted: str) -> Column:
    found = F.regexp_extract_all(without_open_tags(html), F.lit(_tokens(wanted)), F.lit(2))
    return F.transform(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: t != ""), _read)


def start_tags(html: Column, *names: str) -> Column:
    """The start tags with these names, in page order: structs of tag, attributes and (empty) text."""
    return _all(html, _named(names))


def anchors(html: Column, *names: str) -> Column:
    """Anchors with their text, and the start tags with these names, in page order."""
    return _all(html, f"{_named(names)}|{_ANCHOR}")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, empty if it is missing; of a repeated one the first counts."""
    attributes = tag["attributes"]
    place = F.array_position(attributes["names"], F.lit(name)).cast("int")
    return F.coalesce(F.get(attributes["values"], place - 1), F.lit(""))


# An address without commas at its ends, and its width if it names one.
_CANDIDATE = r"[\s,]*+(\S*[^\s,])(?:,++(?=\s|\z)|\s++(?:([0-9]{1,9})w)?[^,]*+(?:,|\z)|\z)"


def source_set(value: Column) -> Column:
    """Candidates of a ``srcset``: structs of src and width (NULL where it names none)."""
    return F.arrays_zip(
        F.regexp_extract_all(value, F.lit(_CANDIDATE), F.lit(1)).alias("src"),
        F.transform(F.regexp_extract_all(value, F.lit(_CANDIDATE), F.lit(2)), lambda w: w.try_cast("double")).alias("width"),
    )
