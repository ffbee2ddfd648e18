"""Hosts of URLs in the form browsers print: ASCII names, four numbers, or compressed IPv6.

* Names beyond ASCII: labels are split at all four kinds of dots, folded to lower case and
  encoded (RFC 3492). Characters that a name ignores are dropped and full-width ones are made
  narrow; other normal forms are taken as written, as Spark has no function for them.
* Numeric hosts: decimal, octal and hexadecimal numbers, up to four.
* IPv6: eight pieces, the last two also as four decimal numbers, with the longest run of
  zeros left out.

A host that is none of these is not valid. Everything is built-in functions, written as SQL
text: Spark reads it in one go, while the same as column objects takes a thousand calls each time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a printed host must not hold.
_UNSAFE = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]"
_NUMERIC = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?\z"
_BEYOND_ASCII = r"[^\x00-\x7f]"
# Names that are printed but for their case, which most hosts are: they end with a letter.
_NAME = r"^[A-Za-z0-9.-]*\.[A-Za-z][A-Za-z0-9-]*\z"

# Fixed values of RFC 3492, section 5.
_BASE, _T_MIN, _T_MAX, _SKEW, _DAMP, _FIRST_BIAS, _FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# The longest label of a name, dots beside U+002E, and characters that names ignore.
MAX_LABEL = 63
_DOTS = r"[\u3002\uff0e\uff61]"
_IGNORED = r"[\u00ad\u200b\u2060\ufe00-\ufe0f\ufeff]"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(map(chr, range(0x21, 0x7F))).replace("\\", "\\\\").replace('"', '\\"')  # as it stands in SQL text


def _let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(delta: str, bias: str) -> str:
    """A number in the code's digits of falling weight."""
    # Eight digits hold the largest number that a label of 63 characters can give.
    steps = f"sequence({_BASE}, {8 * _BASE}, {_BASE})"
    limit = f"least(greatest(w - s.bias, {_T_MIN}), {_T_MAX})"
    digit = f"CASE WHEN s.left < {limit} THEN s.left ELSE {limit} + (s.left - {limit}) % ({_BASE} - {limit}) END"
    step = f"""named_struct('left', CASE WHEN s.left < {limit} THEN -1L ELSE (s.left - {limit}) DIV ({_BASE} - {limit}) END, 'bias', s.bias,
      'out', concat(s.out, substring('{_DIGITS}', CAST({digit} AS INT) + 1, 1)))"""
    return f"""aggregate({steps}, named_struct('left', CAST({delta} AS BIGINT), 'bias', CAST({bias} AS BIGINT), 'out', ''),
      (s, w) -> CASE WHEN s.left < 0 THEN s ELSE {step} END).out"""


def _adapted(delta: str, inserted: str, first: str) -> str:
    """The bias after a number, where ``inserted`` counts the characters with the one it stands for."""
    limit, shrink = (_BASE - _T_MIN) * _T_MAX // 2, _BASE - _T_MIN
    # How often the number must be divided to come below the limit, and what is left then.
    times = " ".join(f"WHEN b < {(limit + 1) * shrink**k} THEN {k}" for k in range(5))
    times = f"(CASE {times} ELSE 5 END)"
    left = f"(b DIV CAST(pow({shrink}, {times}) AS BIGINT))"
    halved = f"({delta} DIV (CASE WHEN {first} THEN {_DAMP} ELSE 2 END))"
    return _let(f"{halved} + {halved} DIV {inserted}", "b", f"{times} * {_BASE} + ({shrink + 1} * {left}) DIV ({left} + {_SKEW})")


def _encoded(label: str) -> str:
    """A label beyond ASCII in ASCII form.

    Characters beyond ASCII are inserted in order of code and place. What is written for one is
    how many steps it lies behind the one before, a step being a place in the text so far, at
    the next code once all places are passed. The bias of its digits follows from the number
    written before it, so every character is written by itself.
    """
    codes = f"transform(regexp_extract_all({label}, r'(?s).', 0), (ch, i) -> named_struct('code', CAST(ascii(ch) AS BIGINT), 'place', i, 'ch', ch))"
    plain = f"filter(codes, x -> x.code < {_FIRST_CODE})"
    placed = f"""transform(array_sort(filter(codes, x -> x.code >= {_FIRST_CODE})), (x, k) -> named_struct(
      'code', x.code, 'index', CAST(size(filter(codes, y -> y.place < x.place AND y.code <= x.code)) AS BIGINT), 'inserted', size({plain}) + k + 1))"""
    step = f"(x.code - coalesce(get(p, k - 1).code, {_FIRST_CODE})) * x.inserted + x.index - coalesce(get(p, k - 1).index + 1, 0)"
    deltas = _let(placed, "p", f"transform(p, (x, k) -> named_struct('inserted', x.inserted, 'delta', {step}))")
    bias = f"CASE WHEN k = 0 THEN {_FIRST_BIAS} ELSE {_adapted('get(q, k - 1).delta', 'get(q, k - 1).inserted', 'k = 1')} END"
    numbers = _let(deltas, "q", f"array_join(transform(q, (x, k) -> {_digits('x.delta', bias)}), '')")
    return _let(codes, "codes", f"""concat('xn--', array_join(transform({plain}, x -> x.ch), ''),
      CASE WHEN size({plain}) > 0 THEN '-' ELSE '' END, {numbers})""")


def _ascii_name(host: str) -> str:
    """A narrow name in ASCII form; a label that is too long becomes a blank."""
    # The code is longer than the label, so a long label need not be encoded to be refused.
    short = f"regexp_replace({_encoded('label')}, r'^.{{{MAX_LABEL + 1},}}\\z', ' ')"
    printed_label = f"CASE WHEN NOT label RLIKE r'{_BEYOND_ASCII}' THEN label WHEN length(label) > {MAX_LABEL} THEN ' ' ELSE {short} END"
    return f"array_join(transform(split({host}, r'\\.', -1), label -> {printed_label}), '.')"


def _dotted(host: str) -> str:
    """A host whose last label is a number as four numbers; NULL if it isn't an address."""
    # Decimal, octal (0...) or hexadecimal (0x...); NULL if it is none.
    number = r"""CAST(CASE WHEN l RLIKE r'^0[xX][0-9a-fA-F]{0,8}\z' THEN conv(concat('0', substring(l, 3, 8)), 16, 10)
      WHEN l RLIKE r'^0[0-7]{1,14}\z' THEN conv(l, 8, 10) WHEN l RLIKE r'^(?:0|[1-9][0-9]{0,14})\z' THEN l END AS BIGINT)"""
    labels = rf"transform(split(regexp_replace({host}, r'\.\z', ''), r'\.'), l -> {number})"
    # The last of up to four numbers fills the bytes that the others leave. A label that is no number is NULL, and so is every comparison with it.
    first, room = "slice(n, 1, size(n) - 1)", "CAST(pow(256, 5 - size(n)) AS BIGINT)"
    whole = f"aggregate({first}, 0L, (a, x) -> a * 256 + x) * {room} + element_at(n, -1)"
    numbers = "array_join(transform(array(16777216, 65536, 256, 1), s -> CAST((whole DIV s) % 256 AS STRING)), '.')"
    fits = f"size(n) <= 4 AND element_at(n, -1) < {room} AND forall({first}, x -> x < 256)"
    return _let(labels, "n", f"CASE WHEN {fits} THEN {_let(whole, 'whole', numbers)} END")


_BYTE = r"(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_FOUR_BYTES = rf"(?:^|:)({_BYTE}(?:\.{_BYTE}){{3}})\z"
_PIECES = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,7}"
_IPV6_FORM = rf"^(?:{_PIECES})?(?:::(?:{_PIECES})?)?\z"


def _ipv6(host: str) -> str:
    """An address in brackets in printed form; NULL if it isn't one."""

    def piece(at: int) -> str:
        bytes_ = [f"CAST(get(split(regexp_extract(a, r'{_FOUR_BYTES}', 1), r'\\.'), {n}) AS BIGINT)" for n in (at, at + 1)]
        return f"lower(hex({bytes_[0]} * 256 + {bytes_[1]}))"

    # Four decimal numbers at the end are two pieces.
    pieced = f"CASE WHEN a RLIKE r'{_FOUR_BYTES}' THEN concat(regexp_replace(a, r'[0-9.]+\\z', ''), {piece(0)}, ':', {piece(2)}) ELSE a END"
    gap, known = "contains(t, '::')", "regexp_count(t, '[0-9a-f]+')"
    fits = f"t RLIKE r'{_IPV6_FORM}' AND CASE WHEN {gap} THEN {known} <= 7 ELSE {known} = 8 END"
    filled = f"""CASE WHEN {gap} THEN concat_ws(':', nullif(substring_index(t, '::', 1), ''), array_join(array_repeat('0', 8 - {known}), ':'),
      nullif(substring_index(t, '::', -1), '')) ELSE t END"""
    short = f"regexp_replace({filled}, '(?<![0-9a-f])0+(?=[0-9a-f])', '')"
    # Without the first of the longest runs of two or more zeros.
    runs = [":".join("0" * size) for size in range(7, 1, -1)]
    cases = " ".join(rf"WHEN z RLIKE r'(?:^|:){run}(?:\z|:)' THEN regexp_replace(z, r'^(.*?)(?:^|:){run}(?:\z|:)(.*)\z', '$1::$2')" for run in runs)
    compressed = f"CASE WHEN z = '0:0:0:0:0:0:0:0' THEN '::' {cases} ELSE z END"
    address = f"CASE WHEN {fits} THEN concat('[', {_let(short, 'z', compressed)}, ']') END"
    return _let(f"lower(substring({host}, 2, length({host}) - 2))", "a", _let(pieced, "t", address))


def _printed(raw: str) -> str:
    d = f"(CASE WHEN contains({raw}, '%') THEN try_url_decode(replace({raw}, '+', '%2B')) ELSE {raw} END)"
    # In lower case, with other spellings of dots and ASCII characters replaced.
    narrow = f"""CASE WHEN {d} RLIKE r'{_BEYOND_ASCII}'
      THEN lower(translate(regexp_replace(regexp_replace({d}, r'{_DOTS}', '.'), r'{_IGNORED}', ''), '{_WIDE}', "{_ASCII}")) ELSE lower({d}) END"""
    return _let(narrow, "host", f"""CASE WHEN startswith(host, '[') THEN {_ipv6('host')}
      WHEN host = '' OR host RLIKE r'{_UNSAFE}' THEN NULL WHEN host RLIKE r'{_NUMERIC}' THEN {_dotted('host')}
      WHEN host RLIKE r'{_BEYOND_ASCII}' THEN {_ascii_name('host')} ELSE host END""")


_PRINTED, _DOTTED = f"raw -> {_printed('raw')}", f"host -> {_dotted('host')}"


def printed(raw: Column) -> Column:
    """The host in printed form; NULL or, for a label that is too long, with a blank if it isn't valid (``is_valid``)."""
    return F.when(raw.rlike(_NAME), F.lower(raw)).otherwise(F.call_function("transform", F.array(raw), F.expr(_PRINTED))[0])


def dotted(host: Column) -> Column:
    """A host whose last label is a number as four numbers; NULL if it isn't an address."""
    return F.call_function("transform", F.array(host), F.expr(_DOTTED))[0]


def is_valid(host: Column) -> Column:
    """Whether a printed host is one."""
    return host.isNotNull() & ~F.contains(host, F.lit(" "))
