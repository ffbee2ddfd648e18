"""Request endpoints, allow rules, credits and client addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.text import as_column, let, non_empty, strip_ws

# Endpoints that cost nothing, and the one that is never charged in the log.
CREDIT_EXEMPT = ("/v2/health", "/v2/status", "/v2/usage")
LOG_EXEMPT = "/v2/usage"
SERVER_ERROR = 500


def _with_one_slash(path: Column) -> Column:
    """Leading slash added, one trailing slash removed (the root path stays).

    Written with a single mention of ``path``, so a long expression is not repeated.
    """
    rooted = F.regexp_replace(F.concat(F.lit("/"), path), "^//", "/")
    return F.regexp_replace(rooted, r"(?<=.)/\z", "")


def audit_endpoint(c: str | Column) -> Column:
    """Endpoint as the access rules see it: no query, lower case."""
    path = F.regexp_replace(strip_ws(F.coalesce(as_column(c), F.lit(""))), r"(?s)\?.*\z", "")
    return F.lower(_with_one_slash(path))


def logged_endpoint(base: str | Column, path: str | Column, original: str | Column) -> Column:
    """Endpoint as the usage log keeps it: mount point plus path, case kept."""
    empty = F.lit("")
    mounted = F.concat(F.coalesce(as_column(base), empty), F.coalesce(as_column(path), empty))
    return _with_one_slash(F.coalesce(non_empty(mounted), as_column(original), empty))


def rule_matches(endpoint: Column, rule: Column) -> Column:
    """``*``, ``prefix*``, the endpoint itself, or a parent path."""
    prefix = F.substring(rule, F.lit(1), F.length(rule) - 1)
    return (
        F.when(rule.endswith("*"), F.startswith(endpoint, prefix))
        .otherwise((endpoint == rule) | F.startswith(endpoint, F.concat(rule, F.lit("/"))))
    )


def endpoint_allowed(endpoint: Column, rules: Column) -> Column:
    """An empty rule list allows everything."""
    return (F.size(rules) == 0) | F.exists(rules, lambda r: rule_matches(endpoint, r))


def _clean_rules(rules: Column) -> Column:
    cleaned = F.transform(rules, lambda r: F.lower(strip_ws(F.coalesce(r, F.lit("")))))
    return F.filter(cleaned, lambda r: r != "")


def rule_list(c: str | Column, is_array: bool) -> Column:
    """Rules from an array column, or from JSON-array or comma text; never NULL."""
    c = as_column(c)
    if not is_array:
        listed = F.try_variant_get(F.try_parse_json(c), "$", "array<string>")
        c = let(strip_ws(c), lambda s: F.coalesce(listed, F.split(s, ",")))
    return F.coalesce(_clean_rules(c), F.array().cast("array<string>"))


def logged_credit(endpoint: Column, status: Column) -> Column:
    return F.when((endpoint == LOG_EXEMPT) | (status >= SERVER_ERROR), F.lit(0)).otherwise(F.lit(1))


def audit_cost(endpoint: Column, method: Column, exempt: tuple[str, ...] = CREDIT_EXEMPT) -> Column:
    free = (F.upper(F.coalesce(method, F.lit(""))) == "OPTIONS") | endpoint.isin(*exempt)
    return F.when(free, F.lit(0)).otherwise(F.lit(1))


def client_ip(forwarded_for: str | Column, ip: str | Column) -> Column:
    """First hop of the forwarded header, else the socket address."""
    forwarded = as_column(forwarded_for)
    first = strip_ws(F.split_part(forwarded, F.lit(","), F.lit(1)))
    blank = F.coalesce(strip_ws(forwarded) == "", F.lit(True))
    return F.when(~blank, first).otherwise(F.coalesce(as_column(ip), F.lit("")))


def owner_key(key_id: str | Column, key: str | Column, account: str | Column) -> Column:
    parts = [non_empty(as_column(c)) for c in (key_id, key, account)]
    return F.coalesce(*parts, F.lit("anonymous"))


def relation_id(c: str | Column, is_array: bool = False) -> Column:
    """Id of a linked record: text, or the first item of an array; '' becomes NULL."""
    c = as_column(c)
    return non_empty(F.get(c, F.lit(0)) if is_array else c)
