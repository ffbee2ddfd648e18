"""Whitespace, tag and markdown handling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the service counts as white space.
WS_ASCII = r"\t\n\x0B\f\r "
WS_OTHER = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# As the inside of a character class. Most characters fail the first two tests,
# so the long list is rarely walked through.
WS = rf"{WS_ASCII}[\u00a0-\ufeff&&[{WS_OTHER}]]"

# Tag and markdown patterns.
SCRIPT = r"(?i)<script[\s\S]*?</script>"
STYLE = r"(?i)<style[\s\S]*?</style>"
TAG = r"<[^>]+>"
CODE_FENCE = r"```[\s\S]*?```"
INLINE_CODE = r"`[^`]*`"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LINK = r"\[[^\]]*\]\([^)]*\)"
MARKS = r"#>*_~\-"


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def strip_ws(c: str | Column) -> Column:
    """Strip white space at both ends (``trim`` only knows the space character).

    The end is looked for only where a run of white space begins, so a long run
    inside the text is walked through once.
    """
    return F.regexp_replace(as_column(c), rf"^[{WS}]+|(?<![{WS}])[{WS}]+\z", "")


def non_blank(c: str | Column) -> Column:
    """True for a string with at least one non-space character, never NULL."""
    return F.coalesce(as_column(c).rlike(f"[^{WS}]"), F.lit(False))


def if_non_blank(c: str | Column) -> Column:
    c = as_column(c)
    return F.when(non_blank(c), c)


def non_empty(c: str | Column) -> Column:
    """NULL for an empty string."""
    return F.nullif(as_column(c), F.lit(""))


def collapse_ws(c: str | Column) -> Column:
    return F.regexp_replace(as_column(c), f"[{WS}]+", " ")


def sort_by_code_unit(values: Column) -> Column:
    """Texts in the order of their UTF-16 units; Spark's own differs where characters beyond U+FFFF meet U+E000 to U+FFFF."""

    def sorted_(v: Column) -> Column:
        keyed = F.array_sort(F.transform(v, lambda x: F.struct(F.encode(x, "UTF-16BE").alias("k"), x.alias("x"))))
        return F.when(F.exists(v, lambda x: x.rlike(r"[\x{10000}-\x{10FFFF}]")), F.transform(keyed, lambda s: s["x"])).otherwise(F.array_sort(v))

    return let(values, sorted_)


def _behind_last_tag(c: Column) -> Column:
    """The text behind the last ``>``; all of it without one."""
    return F.substring_index(c, ">", -1)


def _without_element(text: Column, pattern: str, name: str) -> Column:
    """Replace an element. A start tag behind the last end tag would be searched to the end
    of the text in vain, each one again; so a text that has some is searched up to there only."""
    closed = F.regexp_extract(text, rf"(?i)^([\s\S]*</{name}>)", 1)

    def both(head: Column) -> Column:
        return F.concat(F.regexp_replace(head, pattern, " "), F.substring(text, F.length(head) + 1, F.length(text)))

    hopeless = F.contains(F.substring_index(F.lower(text), f"</{name}>", -1), F.lit(f"<{name}"))
    return F.when(hopeless, let(closed, both)).otherwise(F.regexp_replace(text, pattern, " "))


def _without_tags(text: Column) -> Column:
    """Replace tags; behind the last ``>`` none can be complete, so that part is not searched."""

    def both(tail: Column) -> Column:
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        return F.concat(F.regexp_replace(head, TAG, " "), tail)

    hopeless = let(_behind_last_tag(text), both)
    return F.when(F.contains(_behind_last_tag(text), F.lit("<")), hopeless).otherwise(F.regexp_replace(text, TAG, " "))


def strip_tags(html: str | Column) -> Column:
    """Replace scripts, styles and tags by a space. Entities are kept as they are."""
    html = as_column(html)
    elements = let(
        let(html, lambda t: _without_element(t, SCRIPT, "script")), lambda t: _without_element(t, STYLE, "style")
    )
    shown = F.when(html.rlike("(?i)</(?:script|style)>"), elements).otherwise(html)
    return let(shown, _without_tags)


def without_open_tags(html: Column) -> Column:
    """The text with every ``<`` behind the last ``>`` replaced by a space: no tag can begin there."""

    def both(tail: Column) -> Column:
        head = F.substring(html, F.lit(1), F.length(html) - F.length(tail))
        return F.when(F.contains(tail, F.lit("<")), F.concat(head, F.translate(tail, "<", " "))).otherwise(html)

    return let(_behind_last_tag(html), both)


# Named character references that occur in addresses.
NAMED_REFERENCES = {"&amp;": "&", "&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": "\u00a0"}
_REFERENCE_OR_TEXT = "&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[a-zA-Z]{1,8};|[^&]+|&"


def _character(hex_code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hex_code, 8, "0")), "UTF-32")


def decode_references(c: Column) -> Column:
    """Numeric and the common named character references as characters; others stay as they are."""

    def decoded(piece: Column) -> Column:
        number = F.regexp_extract(piece, "^&#([0-9]+);", 1).try_cast("bigint")
        hexadecimal = F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+);", 1)
        code = F.coalesce(number, F.conv(F.nullif(hexadecimal, F.lit("")), 16, 10).try_cast("bigint"))
        named = F.create_map(*[F.lit(x) for pair in NAMED_REFERENCES.items() for x in pair])
        # Surrogates and numbers beyond the last character name none.
        fits = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        return F.when(fits, _character(F.hex(code))).otherwise(F.coalesce(F.element_at(named, piece), piece))

    pieces = F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE_OR_TEXT), F.lit(0)), decoded)
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def _without(patterns: tuple[str, ...], mark: str) -> Callable[[Column], Column]:
    """Replace the patterns by a space, in turn; text without ``mark`` cannot hold any."""

    def replace(t: Column) -> Column:
        out = t
        for pattern in patterns:
            out = F.regexp_replace(out, pattern, " ")
        return F.when(F.contains(t, F.lit(mark)), out).otherwise(t)

    return replace


def markdown_to_text(markdown: str | Column) -> Column:
    """Plain text of markdown: code, images, links and marks become a space.

    Runs of marks and white space end up as one space either way, so both are
    replaced in one pass.
    """
    out = let(as_column(markdown), _without((CODE_FENCE, INLINE_CODE), "`"))
    out = let(out, _without((IMAGE, LINK), "]("))
    return F.trim(F.regexp_replace(out, f"[{MARKS}{WS}]+", " "))
