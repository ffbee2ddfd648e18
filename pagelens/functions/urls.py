"""URL checks, printing and resolution with built-in functions.

A URL is taken apart by one regular expression and printed again the way a
browser prints it: lower-case scheme, host as in ``hosts``, no default port,
resolved dot segments, percent-encoded path and query, no fragment. No pattern
repeats a group, so a URL of any length takes constant stack and time in
proportion to its length.

Hosts beyond ASCII, encoded ones and IPv6 addresses are rewritten by
``with_plain_host``, a step of its own: the others take hosts as they are but for
case and numbers. Jobs run it as a column of its own, so its expression is built
and analysed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import hosts
from pagelens.functions.text import as_column, let, strip_ws

_HOST = r"[^\x00-\x20#/:<>?@\[\\\]^|\x7f]+|\[[0-9a-fA-F:.]+\]"
# What a percent-decoded host must not hold.
_HOST_UNSAFE = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]"
_PORT = r"0*(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])|"
# Groups: the s of https, user info, host, port, path, query.
_HTTP_URL = (
    r"^[hH][tT][tT][pP]([sS]?):[/\\]*"
    rf"(?:([^/\\?#]*)@)?({_HOST})(?::({_PORT}))?"
    r"([/\\][^?#]*)?(\?[^#]*)?(?:#.*)?\z"
)
_GROUPS = 6
# URLs and paths that are in printed form already, which most are: no dot after a
# slash, and a host whose last label begins with a letter.
_PLAIN_PATH = r"/[A-Za-z0-9_~!$&()*+,;=:@./-]*"
_PLAIN_QUERY = r"(?:\?[A-Za-z0-9_~!$&()*+,;=:@./?%-]*)?"
_PLAIN_URL = rf"^https?://[a-z0-9][a-z0-9.-]*\.[a-z][a-z0-9-]*{_PLAIN_PATH}{_PLAIN_QUERY}\z"
_PLAIN_REFERENCE = rf"^(?!//){_PLAIN_PATH}{_PLAIN_QUERY}\z"
_DOT_SEGMENT = r"/(?:\.|%2[eE]){1,2}(?:/|\z)"
_PATH_UNSAFE = r"[^\x21-\x7e]|[\"<>`{}]"
_QUERY_UNSAFE = r"[^\x21-\x7e]|[\"<>']"


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]", "")


def _is_plain(url: Column, pattern: str) -> Column:
    return url.rlike(pattern) & ~F.contains(url, F.lit("/."))


def _host(raw: Column) -> Column:
    """The host in printed form, but for what ``with_plain_host`` does; NULL if it isn't a valid one."""

    def printed(host: Column) -> Column:
        numeric = host.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?\z")
        return F.when(host.rlike(_HOST_UNSAFE) & ~host.startswith("["), None).when(numeric, hosts.dotted(host)).otherwise(host)

    decoded = F.when(F.contains(raw, F.lit("%")), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    # Most hosts are names that end with a letter.
    name = raw.rlike(r"^[A-Za-z0-9.-]*\.[A-Za-z][A-Za-z0-9-]*\z")
    return F.when(name, F.lower(raw)).otherwise(let(F.lower(decoded), printed))


# Scheme, slashes and user, in front of a host that has another printed form than its lower case.
_BEFORE_HOST = r"^[\x00-\x20]*[hH][tT][tT][pP][sS]?:[/\\]*(?:[^/\\?#]*@)?"
_SPECIAL_HOST = rf"{_BEFORE_HOST}(?:\[|[^/\\?#:\[]*[^\x00-\x24\x26-\x7f])"


def with_plain_host(c: str | Column) -> Column:
    """The URL with its host in ASCII, or as a compressed IPv6 address; not valid if that can't be."""

    def rewritten(url: Column) -> Column:
        # Line ends and tabs count for nothing anywhere in a URL.
        clean = F.regexp_replace(url, r"[\t\n\r]", "")
        before, host = F.regexp_extract(clean, f"({_BEFORE_HOST})", 1), F.regexp_extract(clean, f"{_BEFORE_HOST}({_HOST})", 1)
        rest = F.substring(clean, F.length(before) + F.length(host) + 1, F.length(clean))
        return F.when(host == "", url).otherwise(F.concat(before, F.coalesce(hosts.printed(host), F.lit(" ")), rest))

    return let(as_column(c), lambda url: F.when(url.rlike(_SPECIAL_HOST), rewritten(url)).otherwise(url))


def is_http_url(c: str | Column) -> Column:
    """True for a valid absolute http(s) URL, never NULL."""

    def valid(url: Column) -> Column:
        host = F.regexp_extract(url, _HTTP_URL, 3)
        special = F.contains(host, F.lit("%")) | host.rlike(r"(?:^|\.)(?:[0-9]+|0[xX][0-9a-fA-F]*)\.?\z")
        fits = F.when(special, _host(host).isNotNull()).otherwise(F.lit(True))
        return _is_plain(url, _PLAIN_URL) | (url.rlike(_HTTP_URL) & fits)

    return F.coalesce(let(_clean(with_plain_host(c)), valid), F.lit(False))


def url_parts(c: str | Column) -> Column:
    """Scheme, user, host, port, path and query of an http(s) URL as an array; an
    array of another size where the URL is missing or not valid.

    Cleaning removes line feeds, so a line feed is a safe separator.
    """
    groups = "\n".join(f"${i}" for i in range(1, _GROUPS + 1))
    parts = F.split(F.regexp_replace(_clean(as_column(c)), _HTTP_URL, groups), "\n", -1)

    def checked(p: Column) -> Column:
        # The third group becomes the printed host; without one the URL isn't valid.
        return let(
            F.when(F.size(p) == _GROUPS, _host(F.get(p, F.lit(2)))),
            lambda h: F.when(h.isNotNull(), F.concat(F.slice(p, 1, 2), F.array(h), F.slice(p, 4, _GROUPS - 3))).otherwise(F.array(F.lit(""))),
        )

    return F.coalesce(let(parts, checked), F.array(F.lit("")))


def _encode(text: Column, unsafe: str) -> Column:
    """Percent-encode the unsafe characters; text without any is passed through."""
    encoded = F.transform(
        F.split(text, ""),
        lambda ch: F.when(ch.rlike(unsafe), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch),
    )
    return F.when(text.rlike(unsafe), F.array_join(encoded, "")).otherwise(text)


# Segments that are resolved together before they meet the others, and such blocks.
_SEGMENT_BLOCK = 64


def _resolve_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a path that starts with a slash.

    Blocks of segments are resolved by themselves to the folders they go up and the
    segments they keep, then joined in two steps, so that no long array is copied often.
    """
    # A closing dot segment names a folder, so its slash is kept.
    closed = F.when(path.rlike(r"/(?:\.|%2[eE]){1,2}\z"), F.concat(path, F.lit("/"))).otherwise(path)
    nothing = F.array().cast("array<string>")

    def state(ups: Column, kept: Column) -> Column:
        return F.struct(ups.alias("ups"), kept.alias("kept"))

    def step(done: Column, seg: Column) -> Column:
        kept = done["kept"]
        up = F.when(F.size(kept) > 0, state(done["ups"], F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))).otherwise(
            state(done["ups"] + 1, kept)
        )
        return (
            F.when(seg.rlike(r"^(?:\.|%2[eE]){2}\z"), up)
            .when(seg.rlike(r"^(?:\.|%2[eE])\z"), done)
            .otherwise(state(done["ups"], F.concat(kept, F.array(seg))))
        )

    def join(done: Column, block: Column) -> Column:
        size = F.size(done["kept"])
        above = F.greatest(block["ups"] - size, F.lit(0))
        left = F.slice(done["kept"], 1, F.greatest(size - block["ups"], F.lit(0)))
        return state(done["ups"] + above, F.concat(left, block["kept"]))

    def in_blocks(items: Column, merge: Callable[[Column, Column], Column]) -> Column:
        starts = F.sequence(F.lit(1), F.size(items), F.lit(_SEGMENT_BLOCK))
        return F.transform(starts, lambda at: F.aggregate(F.slice(items, at, _SEGMENT_BLOCK), state(F.lit(0), nothing), merge))

    def joined(segments: Column) -> Column:
        groups = let(in_blocks(segments, step), lambda blocks: in_blocks(blocks, join))
        return F.aggregate(groups, state(F.lit(0), nothing), join)["kept"]

    kept = let(F.split(F.substring(closed, 2, 2147483647), "/", -1), joined)
    return F.when(path.rlike(_DOT_SEGMENT), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def _scheme(p: Column) -> Column:
    return F.concat(F.lit("http"), F.lower(p[0]))


def _origin(p: Column) -> Column:
    user = F.regexp_replace(p[1], r":\z", "")
    port = F.regexp_replace(p[3], "^0+(?=[0-9])", "")
    default_port = F.when(p[0] == "", F.lit("80")).otherwise(F.lit("443"))
    return F.concat(
        _scheme(p),
        F.lit("://"),
        F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""),
        p[2],
        F.when((port != "") & (port != default_port), F.concat(F.lit(":"), port)).otherwise(""),
    )


def _print(p: Column, drop_trailing_slash: bool) -> Column:
    path = F.replace(p[4], F.lit("\\"), F.lit("/"))
    path = let(F.when(path == "", F.lit("/")).otherwise(path), _resolve_dots)
    if drop_trailing_slash:
        path = F.regexp_replace(path, r"(?<=.)/\z", "")
    path = let(path, lambda c: _encode(c, _PATH_UNSAFE))
    query = let(p[5], lambda c: _encode(c, _QUERY_UNSAFE))
    return F.when(F.size(p) == _GROUPS, F.concat(_origin(p), path, query))


def normalize_url(c: str | Column) -> Column:
    """The form URLs are compared in: printed, without fragment and without one
    trailing slash. NULL where the URL is not a valid http(s) URL."""
    return normalize_plain(with_plain_host(c))


def normalized(df: DataFrame, url: Column, name: str) -> DataFrame:
    """``df`` with ``normalize_url(url)`` as ``name``, in two steps: short expressions are analysed sooner than one long one."""
    return df.withColumn(name, with_plain_host(url)).withColumn(name, normalize_plain(name))


def normalize_plain(c: str | Column) -> Column:
    """``normalize_url`` of what ``with_plain_host`` gave."""

    def normalize(url: Column) -> Column:
        parsed = let(url_parts(url), lambda p: _print(p, drop_trailing_slash=True))
        plain = F.regexp_replace(url, r"^(https?://[^/]+/[^?]*)/(\?.*)?\z", "$1$2")
        return F.when(_is_plain(url, _PLAIN_URL), plain).otherwise(parsed)

    return let(as_column(c), normalize)


def printed_host(c: str | Column) -> Column:
    """Host of a URL in printed form."""
    return F.regexp_extract(as_column(c), r"^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)


def same_site(host: Column, other: Column) -> Column:
    """Whether two printed hosts are one, or one is a sub-domain of the other.

    This needs no list of public suffixes and never joins two customers of one suffix;
    two sub-domains of a site are told apart. An address is only itself.
    """
    address = r"^[0-9.]+\z|^\["
    below = host.endswith(F.concat(F.lit("."), other)) | other.endswith(F.concat(F.lit("."), host))
    return (host != "") & (other != "") & ((host == other) | (below & ~host.rlike(address) & ~other.rlike(address)))


def _absolute(src: Column, base: Column) -> Column:
    """``src`` written out as an absolute URL; NULL if the base is needed but not valid."""
    path = F.when(base[4] == "", F.lit("/")).otherwise(F.replace(base[4], F.lit("\\"), F.lit("/")))
    folder = F.regexp_replace(path, r"[^/]*\z", "")
    # A scheme equal to the base's, without slashes behind it, adds nothing.
    scheme = _scheme(base)
    repeated = F.lower(F.regexp_extract(src, r"^([hH][tT][tT][pP][sS]?):(?![/\\])", 1)) == scheme
    tail = F.regexp_replace(src, r"^[hH][tT][tT][pP][sS]?:(?![/\\])", "")
    from_origin = (
        F.when(tail.rlike(r"^[/\\]"), tail)
        .when(tail.rlike(r"^\?"), F.concat(path, tail))
        .when((tail == "") | tail.startswith("#"), F.concat(path, base[5]))
        .otherwise(F.concat(folder, tail))
    )
    relative = F.when(tail.rlike(r"^[/\\]{2}"), F.concat(scheme, F.lit(":"), tail)).otherwise(
        F.concat(_origin(base), from_origin)
    )
    has_scheme = src.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")
    base_ok = F.size(base) == _GROUPS
    return F.when(has_scheme & ~(base_ok & repeated), src).when(base_ok, relative)


def written_out(src: Column, base_parts: Column) -> Column:
    """``src`` as an absolute URL, not printed; as it is if that can't be."""
    return F.coalesce(_absolute(_clean(strip_ws(src)), base_parts), src)


def base_parts(named: Column, own: Column) -> Column:
    """Parts of the address that a page with the parts ``own`` names as its base; ``own`` if that is none.

    Its dot segments stay, as those of what is resolved against it are resolved anyway.
    """
    parts = url_parts(_absolute(_clean(named), own))
    return let(parts, lambda p: F.when(F.size(p) == _GROUPS, p).otherwise(own))


def _print_other(url: Column) -> Column:
    """A URL of another scheme: scheme in lower case, fragment dropped."""
    scheme = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    rest = F.regexp_replace(F.substring(url, F.length(scheme) + 1, F.length(url)), r"(?s)#.*\z", "")
    return F.when((scheme != "") & ~scheme.rlike(r"^[hH][tT][tT][pP][sS]?\z"), F.concat(F.lower(scheme), rest))


def resolve_against(src: str | Column, base_parts: Column) -> Column:
    """``resolve_url`` for a base taken apart before, once for all its sources, and without ``with_plain_host``."""

    def resolve(raw: Column) -> Column:
        printed = let(
            _absolute(_clean(raw), base_parts),
            lambda a: F.coalesce(let(url_parts(a), lambda p: _print(p, drop_trailing_slash=False)), _print_other(a)),
        )
        base_ok = F.size(base_parts) == _GROUPS
        return (
            F.when(raw == "", None)
            .when(raw.startswith("data:") | _is_plain(raw, _PLAIN_URL), raw)
            .when(base_ok & _is_plain(raw, _PLAIN_REFERENCE), F.concat(_origin(base_parts), raw))
            .otherwise(F.coalesce(printed, raw))
        )

    return let(strip_ws(as_column(src)), resolve)


def resolve_url(src: str | Column, base: str | Column) -> Column:
    """``src`` as an absolute URL without fragment, seen from the page ``base``.

    ``data:`` sources and those that cannot be resolved stay as they are; blank
    ones are NULL. Jobs take ``with_plain_host`` of the base before and of the result behind it,
    as columns of their own: all in one expression would be nested too deeply for the analyzer.
    """
    return let(url_parts(as_column(base)), lambda parts: resolve_against(src, parts))
