"""Emails, phone numbers and URLs found in text. Every result is a per-row array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.text import WS, as_column, collapse_ws, let, sort_by_code_unit, strip_ws

# What counts as an email, phone number and URL in text.
LOCAL = r"[A-Za-z0-9._%+-]+"
DOMAIN = r"[A-Za-z0-9.-]+"
TOP_LEVEL = r"[A-Za-z]{2,}"
SPELLED_AT = rf"[{WS}]*(?:\[[aA][tT]\]|\([aA][tT]\)|[{WS}][aA][tT][{WS}])[{WS}]*"
SPELLED_DOT = rf"[{WS}]*(?:\[[dD][oO][tT]\]|\([dD][oO][tT]\)|[{WS}][dD][oO][tT][{WS}])[{WS}]*"
EMAIL = rf"{LOCAL}@{DOMAIN}\.{TOP_LEVEL}"
EMAIL_OBFUSCATED = rf"({LOCAL}){SPELLED_AT}({DOMAIN}){SPELLED_DOT}({TOP_LEVEL})"
MAILTO = rf"(?i:mailto):([^\"'?{WS}>]+)"
PHONE = rf"\+?[0-9][0-9{WS}\-().]{{7,}}[0-9]"
PHONE_MIN_CHARS = 8
URL = rf"(?i:https?)://[^{WS})>\"']+"
REPLACEMENT = "\ufffd"
TRAILING_PUNCTUATION = r"[),.;:!?]+\z"

# The same patterns for scanning. They are tried only where a run of address
# characters starts (or the last match ended): a run that fails from its start
# fails from every later position too. Runs are never given back (``++``), as no
# character behind them belongs to the run.
_RUN_START = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
EMAIL_SCAN = rf"{_RUN_START}{LOCAL}+@{DOMAIN}\.{TOP_LEVEL}"
OBFUSCATED_SCAN = rf"{_RUN_START}({LOCAL}+){SPELLED_AT}({DOMAIN}+){SPELLED_DOT}({TOP_LEVEL})"
# Where this is missing there is no hidden address.
ANY_SPELLED_DOT = rf"[dD][oO][tT][\]){WS}]"

FIELDS = ("emails", "phones", "urls")
DEFAULT_FIELDS = ("emails", "phones")


def _matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def normalize_email(c: str | Column) -> Column:
    lowered = F.lower(strip_ws(c))
    return F.regexp_replace(F.regexp_replace(lowered, TRAILING_PUNCTUATION, ""), "^mailto:", "")


def is_valid_email(c: str | Column) -> Column:
    return as_column(c).rlike(rf"^{EMAIL}\z")


def _written_emails(text: Column) -> Column:
    """Plain addresses, and those written with ``[at]`` and ``[dot]``."""
    # Both patterns try every word of a text, so a quick look comes first: no @, no
    # address; no spelled-out dot, no hidden one.
    none = F.array().cast("array<string>")
    plain = F.when(F.contains(text, F.lit("@")), _matches(text, EMAIL_SCAN)).otherwise(none)
    spelled = F.when(text.rlike(ANY_SPELLED_DOT), _matches(text, OBFUSCATED_SCAN)).otherwise(none)
    hidden = F.transform(spelled, lambda m: F.regexp_replace(m, f"^{EMAIL_OBFUSCATED}", "$1@$2.$3"))
    return F.transform(F.concat(plain, hidden), normalize_email)


def _percent_decode(c: Column) -> Column:
    """Percent-decoded text, or the text itself where it cannot be decoded."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    bad_bytes = F.contains(decoded, F.lit(REPLACEMENT)) & ~F.contains(c, F.lit(REPLACEMENT))
    return F.coalesce(F.when(~bad_bytes, decoded), c)


def mailto_emails(text: str | Column) -> Column:
    found = F.transform(
        _matches(as_column(text), MAILTO, 1), lambda m: normalize_email(let(m, _percent_decode))
    )
    return F.filter(found, is_valid_email)


def emails_in_text(text: str | Column) -> Column:
    """Sorted distinct emails for the field extraction job."""
    return sort_by_code_unit(F.array_distinct(_written_emails(as_column(text))))


def emails_for_index(text: str | Column, hrefs: Column | None = None) -> Column:
    """Distinct valid emails of a scanned page: its text, ``mailto:`` and link targets."""
    text = as_column(text)
    parts = [F.filter(_written_emails(text), is_valid_email), mailto_emails(text)]
    if hrefs is not None:
        hrefs = F.filter(hrefs, lambda h: h.isNotNull())
        direct = F.filter(F.transform(hrefs, normalize_email), is_valid_email)
        parts += [direct, F.flatten(F.transform(hrefs, mailto_emails))]
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(p, empty) for p in parts]))


def phones_in_text(text: str | Column) -> Column:
    found = F.transform(_matches(as_column(text), PHONE), collapse_ws)
    return F.array_sort(F.array_distinct(F.filter(found, lambda p: F.length(p) >= PHONE_MIN_CHARS)))


def urls_in_text(text: str | Column) -> Column:
    text = as_column(text)
    none = F.array().cast("array<string>")
    written = F.when(F.contains(text, F.lit("://")), _matches(text, URL)).otherwise(none)
    found = F.transform(written, lambda m: F.regexp_replace(m, TRAILING_PUNCTUATION, ""))
    return sort_by_code_unit(F.array_distinct(found))


EXTRACTORS = {"emails": emails_in_text, "phones": phones_in_text, "urls": urls_in_text}


def supported_fields(fields: list[str] | None) -> list[str]:
    """Requested field names, cleaned; unknown names are left out."""
    if not fields:
        return list(DEFAULT_FIELDS)
    wanted = dict.fromkeys(str(f or "").lower().strip() for f in fields)
    kept = [f for f in wanted if f in FIELDS]
    if not kept:
        raise ValueError("Invalid fields. Supported values: " + ", ".join(FIELDS) + ".")
    return kept
