"""DuckDB SQL for every registered query, written by hand over the given tables.

Payload queries do not read JSON back: their expected rows follow directly from
the rules the payloads were built with.
"""

from __future__ import annotations

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

USAGE = f"""
ev AS (SELECT *, {K} AS k, epoch_us(ts) AS us FROM events),
usage_log AS (
  SELECT event_id AS request_id, 'k' || user_id AS api_key, 'a' || (user_id % 10) AS account_id,
    CASE event_type WHEN 'view' THEN '/v2/gethtml' WHEN 'click' THEN '/v2/map' WHEN 'signup' THEN '/v2/extract'
      WHEN 'purchase' THEN '/v2/bulk' ELSE '/v2/crawl' END AS endpoint,
    CASE WHEN event_type = 'error' THEN '500' WHEN k < 5 THEN '429' ELSE '200' END AS response_code,
    CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS credit_used,
    us, strftime(ts, '%Y-%m') AS month
  FROM ev),
mixed AS (
  SELECT 'a' || (user_id % 10) AS account_id, strftime(ts, '%Y-%m') AS month,
    CASE WHEN k % 7 = 0 THEN 'unknown' ELSE '/v2/' || event_type END AS endpoint,
    CASE WHEN k % 11 = 0 THEN 'unknown' ELSE '200' END AS status,
    CAST(CASE k % 10 WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 0 WHEN 3 THEN -2 WHEN 4 THEN 3 WHEN 5 THEN 1.5
      WHEN 6 THEN 0 WHEN 7 THEN 100 WHEN 8 THEN k ELSE 1 END AS DOUBLE) AS credit
  FROM ev),
burst AS (
  SELECT event_id AS request_id,
    '10.0.0.' || (CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 8 END) AS ip_address,
    1704067200000000 + (us - 1704067200000000) // 100 AS ts FROM ev),
burst_windows AS (SELECT *, ts - ts % 900000000 AS window_start FROM burst)
"""

FINISHED = f"""
WITH {USAGE}
SELECT CASE WHEN k = 99 THEN '' ELSE 'k' || user_id END AS api_key,
  CASE WHEN event_type = 'error' THEN '502' WHEN k < 5 THEN '429' ELSE '200' END AS response_code,
  CAST(CASE WHEN event_type IN ('error', 'purchase') THEN 0 ELSE 1 END AS BIGINT) AS credit_used,
  CASE event_type WHEN 'view' THEN '/v2/gethtml' WHEN 'click' THEN '/v2/map' WHEN 'signup' THEN '/v2/extract'
    WHEN 'purchase' THEN '/v2/usage' ELSE '/v2/Crawl' END AS endpoint,
  'POST' AS method,
  CASE WHEN k = 98 THEN '' ELSE 'a' || (user_id % 10) END AS account_id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
  CAST(k AS BIGINT) * 1000 AS latency_ms, 'agent/' || k AS user_agent,
  CASE WHEN k % 3 = 0 THEN '10.1.0.' ELSE '10.0.0.' END || (user_id % 8) AS ip_address,
  strftime(ts, '%Y-%m') AS month, us AS created
FROM ev
"""


def _rollup(source: str, status: str, credit: str, where: str = "") -> str:
    parts = [
        f"SELECT 'endpoint' AS level, endpoint AS name, count(*) AS requests, CAST(sum({credit}) AS DOUBLE) AS credits "
        f"FROM {source} {where} GROUP BY endpoint",
        f"SELECT 'status', {status}, count(*), CAST(sum({credit}) AS DOUBLE) FROM {source} {where} GROUP BY {status}",
        f"SELECT 'total', 'all', count(*), CAST(coalesce(sum({credit}), 0) AS DOUBLE) FROM {source} {where}",
    ]
    return " UNION ALL ".join(parts)


def _audit(strict: bool) -> str:
    key_limit = "CASE WHEN u % 4 = 0 THEN 400 END" if strict else "NULL"
    subscription = "WHEN n = 9 THEN 'subscription_inactive'" if strict else ""
    return f"""
WITH {USAGE},
used AS (
  SELECT request_id, coalesce(sum(credit_used) OVER (PARTITION BY account_id, month ORDER BY us
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM usage_log),
r AS (
  SELECT event_id AS request_id, user_id AS u, user_id % 10 AS n, k, ts, used.used,
    CASE event_type WHEN 'view' THEN '/v2/gethtml' WHEN 'click' THEN '/v2/map/site' WHEN 'signup' THEN '/v2/extract'
      WHEN 'purchase' THEN '/v2/bulk' ELSE '/v2/status' END AS endpoint,
    CASE WHEN user_id % 10 IN (0, 3) THEN 300 WHEN user_id % 10 IN (1, 2, 6, 7, 8, 9) THEN 100000 END AS plan_limit
  FROM ev JOIN used ON used.request_id = event_id),
c AS (
  SELECT *, CASE WHEN k = 97 OR endpoint = '/v2/status' THEN 0 ELSE 1 END AS cost, {key_limit} AS key_limit,
    CASE WHEN u % 6 = 0 THEN endpoint IN ('/v2/map/site', '/v2/bulk')
      WHEN plan_limit = 100000 THEN endpoint IN ('/v2/gethtml', '/v2/map/site', '/v2/extract') ELSE true END AS open
  FROM r),
l AS (
  SELECT *, cost = 1 AND (plan_limit IS NOT NULL OR key_limit IS NOT NULL) AS metered,
    CASE WHEN plan_limit IS NULL THEN key_limit WHEN used + 1 > plan_limit AND used + 1 <= key_limit THEN key_limit
      ELSE plan_limit END AS chosen
  FROM c),
d AS (
  SELECT *, CASE WHEN k = 99 THEN 'missing_key' WHEN k = 98 THEN 'unknown_key' WHEN u % 7 = 0 THEN 'key_inactive'
    WHEN u % 11 = 0 THEN 'key_revoked'
    WHEN u % 13 = 0 AND ((u % 2 = 0 AND ts >= TIMESTAMP '2024-01-10') OR (u % 2 = 1 AND u % 3 = 0)) THEN 'key_expired'
    WHEN u % 19 = 0 THEN 'no_account' WHEN u % 23 = 0 THEN 'account_not_found' {subscription}
    WHEN n = 4 THEN 'plan_not_found' WHEN NOT open THEN 'endpoint_not_allowed'
    WHEN metered AND used + 1 > chosen THEN 'credits_exceeded'
    WHEN n = 6 THEN 'no_user' WHEN n = 7 THEN 'user_not_found' WHEN n = 8 THEN 'user_not_verified'
    ELSE 'allowed' END AS reason
  FROM l)
SELECT request_id, endpoint, reason = 'allowed' AS allowed,
  CAST(CASE WHEN reason = 'allowed' THEN 200 WHEN reason = 'missing_key' THEN 401 WHEN reason = 'credits_exceeded' THEN 429
    WHEN reason LIKE '%not_found' THEN 503 ELSE 403 END AS INTEGER) AS code,
  reason,
  CASE reason WHEN 'missing_key' THEN 'Missing API key. Provide it via the x-api-key header.'
    WHEN 'unknown_key' THEN 'Invalid API key.' WHEN 'key_inactive' THEN 'API key is inactive.'
    WHEN 'key_revoked' THEN 'API key is revoked.' WHEN 'key_expired' THEN 'API key has expired.'
    WHEN 'no_account' THEN 'API key is not linked to an account.'
    WHEN 'account_not_found' THEN 'Authentication service unavailable.'
    WHEN 'subscription_inactive' THEN 'Account subscription is not active.'
    WHEN 'plan_not_found' THEN 'Authentication service unavailable.'
    WHEN 'endpoint_not_allowed' THEN 'Endpoint not allowed for this API key: ' || endpoint
    WHEN 'credits_exceeded' THEN 'Monthly credit limit exceeded.'
    WHEN 'no_user' THEN 'Account has no linked user.' WHEN 'user_not_found' THEN 'Authentication service unavailable.'
    WHEN 'user_not_verified' THEN 'User is not verified.' END AS error,
  CASE WHEN reason = 'allowed' THEN 'id' || u END AS api_key_id,
  CASE WHEN reason = 'allowed' THEN 'a' || n END AS account_id,
  CASE WHEN reason = 'allowed' THEN 'u' || n END AS user_id,
  CASE WHEN reason = 'allowed' AND n IN (0, 3) THEN 'p0' WHEN reason = 'allowed' AND n <> 5 THEN 'p1' END AS plan_id,
  CASE WHEN reason = 'allowed' THEN 'user' END AS role,
  CASE WHEN reason = 'allowed' AND metered THEN CAST(used AS DOUBLE) END AS used_credits,
  CASE WHEN reason = 'allowed' AND metered THEN CAST(chosen AS DOUBLE) END AS monthly_credit_limit
FROM d
"""


# Crawl tables

WS = r"[\t\n\x0b\x0c\r ]"
TAGS = r"""
'<META name="description" content=" About page ' || page_id || ' ">'
|| '<meta content=''index,follow'' name=''robots''><meta name="keywords" content="">'
|| '<link rel="canonical" href="' || url || '">'
|| '<meta property="og:title" content="og ' || page_id || '"><meta property="og:type" content=''article''>'
|| '<meta name="twitter:card" content = "summary ' || (page_id % 5) || '">'
"""

# One row per readable payload: the fields of its crawl record.
RECORDS = f"""
rec AS (
  SELECT page_id AS p, CAST(page_id AS VARCHAR) AS request_id, url AS page_url, html AS page_html,
    CASE WHEN page_id % 10 IN (6, 9) OR page_id % 20 = 18 THEN NULL ELSE url END AS own_url,
    CASE WHEN page_id % 10 = 8 THEN url || '?r=1' END AS redirected_url,
    page_id % 3 = 0 AS success,
    CAST(CASE page_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 END AS INTEGER) AS status_code,
    CASE WHEN page_id % 6 = 5 THEN NULL
      WHEN page_id % 3 = 0 THEN replace(html, '<head>', '<head>' || {TAGS}) ELSE html END AS html,
    '# Page ' || page_id || chr(10) || chr(10) || '* see [site](' || url || ') or `code`' || chr(10) || chr(10) || html AS md,
    page_id % 3 AS form
  FROM pages),
ok AS (
  SELECT *, 0 AS record_pos, coalesce(own_url, redirected_url, page_url) AS url FROM rec WHERE p % 50 <> 0),
every AS (
  SELECT request_id, CASE WHEN p % 5 = 1 THEN 1 ELSE 0 END AS record_pos,
    coalesce(own_url, redirected_url, CASE WHEN p % 5 = 1 THEN page_url || '#second' ELSE page_url END) AS url,
    redirected_url, success, status_code, page_url AS target, p
  FROM rec WHERE p % 50 <> 0
  UNION ALL
  SELECT request_id, CASE WHEN p % 5 = 1 THEN 0 ELSE 1 END,
    CASE WHEN p % 5 = 1 THEN page_url ELSE page_url || '#second' END, NULL, false, NULL, page_url, p
  FROM rec WHERE p % 5 IN (1, 3)
  UNION ALL
  SELECT request_id, 0, page_url, NULL, false, NULL, page_url, p FROM rec WHERE p % 50 = 0)
"""
HEAD = "request_id, CAST(record_pos AS INTEGER) AS record_pos, url, redirected_url, success, status_code"
MARKDOWN = "CASE WHEN form = 0 OR (form = 1 AND p % 2 = 0) THEN md WHEN form = 1 THEN 'cited ' || md ELSE 'fit only' END"


def _strip_tags(c: str) -> str:
    out = c
    for pattern in (r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", r"<[^>]+>"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return out


def _clean(c: str) -> str:
    out = c
    for pattern in (
        r"```[\s\S]*?```", r"`[^`]*`", r"!\[[^\]]*\]\([^)]*\)", r"\[[^\]]*\]\([^)]*\)", r"[#>*_~\-]+", WS + "+",
    ):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"trim({out}, ' ')"


def _units(c: str) -> str:
    """UTF-16 units: characters beyond the basic plane are two."""
    return f"(length({c}) + length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
OBFUSCATED = (
    r"([A-Za-z0-9._%+-]+)W*(?:\[[aA][tT]\]|\([aA][tT]\)|W[aA][tT]W)W*([A-Za-z0-9.-]+)"
    r"W*(?:\[[dD][oO][tT]\]|\([dD][oO][tT]\)|W[dD][oO][tT]W)W*([A-Za-z]{2,})"
).replace("W", WS)


def _tidy(email: str) -> str:
    return f"regexp_replace(regexp_replace(lower({email}), '[),.;:!?]+$', ''), '^mailto:', '')"


def _written(c: str) -> str:
    hidden = f"list_transform(regexp_extract_all({c}, '{OBFUSCATED}'), lambda m: regexp_replace(m, '{OBFUSCATED}', '\\1@\\2.\\3'))"
    return f"list_transform(list_concat(regexp_extract_all({c}, '{EMAIL}'), {hidden}), lambda e: {_tidy('e')})"


def _emails(c: str) -> str:
    return f"list_sort(list_distinct({_written(c)}))"


def _phones(c: str) -> str:
    found = rf"regexp_extract_all({c}, '\+?[0-9][0-9\t\n\x0b\x0c\r \-().]{{7,}}[0-9]')"
    tidy = f"list_transform({found}, lambda m: regexp_replace(m, '{WS}+', ' ', 'g'))"
    return f"list_sort(list_distinct(list_filter({tidy}, lambda m: length(m) >= 8)))"


def _urls(c: str) -> str:
    found = rf"""regexp_extract_all({c}, '[hH][tT][tT][pP][sS]?://[^\t\n\x0b\x0c\r )>"'']+')"""
    return f"list_sort(list_distinct(list_transform({found}, lambda m: regexp_replace(m, '[),.;:!?]+$', ''))))"


DOCS = """
docs AS (
  SELECT doc_id AS d, CAST(doc_id AS VARCHAR) AS request_id, source,
    'https://' || source || '.example.com/' || CASE doc_id % 4 WHEN 0 THEN 'contact' WHEN 1 THEN 'about'
      WHEN 2 THEN 'blog' ELSE 'news' END || '/' || doc_id AS url,
    'https://' || source || '.example.com' AS target,
    text || CASE WHEN doc_id % 5 = 0 THEN ' sales [at] ' || source || ' [dot] com' ELSE '' END
      || CASE WHEN doc_id % 9 = 0 THEN ' mailto:ops%40' || source || '.com' ELSE '' END
      || CASE WHEN doc_id % 6 = 0 THEN ' (see https://' || source || '.test/p/' || doc_id || ').' ELSE '' END AS text
  FROM documents)
"""

FIELDS = f"""
fields AS (
  SELECT request_id, url, 'emails' AS field, unnest({_emails('text')}) AS value FROM docs
  UNION ALL SELECT request_id, url, 'phones', unnest({_phones('text')}) FROM docs
  UNION ALL SELECT request_id, url, 'urls', unnest({_urls('text')}) FROM docs)
"""

SITES = f"""
{DOCS},
candidates AS (SELECT target, url AS page_url FROM docs WHERE d % 4 IN (0, 1) OR d % 8 = 2),
seeds AS (
  SELECT DISTINCT target, CASE CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 5
    WHEN 0 THEN 7 WHEN 1 THEN 100 END AS wanted FROM docs),
pool AS (
  SELECT target, target || '/' AS page_url, true AS is_seed FROM seeds
  UNION ALL SELECT target, page_url, false FROM candidates),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY is_seed DESC, page_url) AS position FROM pool),
scanned AS (
  SELECT target, page_url, is_seed, CAST(position AS INTEGER) AS position FROM ranked JOIN seeds USING (target)
  WHERE wanted IS NULL OR position <= wanted),
page_emails AS (
  SELECT url, unnest(list_distinct(list_concat(list_concat(
      list_filter({_written('text')}, lambda e: regexp_full_match(e, '{EMAIL}')),
      list_filter(list_transform(regexp_extract_all(text, 'mailto:([^"''?\\t\\n\\x0b\\x0c\\r >]+)', 1),
        lambda m: {_tidy('url_decode(m)')}), lambda e: regexp_full_match(e, '{EMAIL}'))),
      ['desk' || (d % 3) || '@' || source || '.com']))) AS email
  FROM docs),
email_rows AS (
  SELECT DISTINCT target, email, url AS source FROM scanned JOIN page_emails ON page_url = url)
"""

LINKS = """
site AS (
  SELECT CAST(page_id AS VARCHAR) AS request_id, page_id AS p, url, html, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin
  FROM pages),
nav AS (
  SELECT request_id, url, origin, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS path,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text FROM site),
nav_links AS (
  SELECT request_id, url, text, origin || array_to_string(list_transform(string_split(path, ''),
    lambda c: CASE WHEN regexp_full_match(c, '[!-~]') AND NOT regexp_full_match(c, '["<>`{}]') THEN c ELSE url_encode(c) END), '') AS href
  FROM nav),
found AS (
  SELECT request_id, url AS target, 'internal' AS bucket, href, text, '' AS title FROM nav_links
  UNION ALL SELECT request_id, url, 'internal', regexp_replace(url, '#.*$', ''), 'self', '' FROM site
  UNION ALL SELECT request_id, url, 'external', 'https://partner' || (p % 7) || '.test/p/' || p || '/', 'Über &amp;  more', '' FROM site
  UNION ALL SELECT request_id, url, 'external', 'https://partner' || (p % 7) || '.test/p/' || p, 'again', 'Partner' FROM site
  UNION ALL SELECT request_id, url, 'internal', origin || '/plain', 'plain', '' FROM site
  UNION ALL SELECT request_id, url, 'internal', origin || '/o''brien', 'ob', '' FROM site
  UNION ALL SELECT request_id, url, 'internal', origin || '/a&b', 'amp', '' FROM site
  UNION ALL SELECT request_id, url, 'internal', origin || '/open', 'open', '' FROM site
  UNION ALL SELECT request_id, url, 'internal', origin || '/z', 'z', 'a > b' FROM site
  UNION ALL SELECT request_id, url, 'internal', origin || '/good', 'good  one', '' FROM site
  UNION ALL SELECT request_id, url, 'internal', origin || '/area', 'Area', '' FROM site
  UNION ALL SELECT request_id, url, 'internal', CASE WHEN p % 3 = 0 THEN origin || '/deep/er/'
    ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') END || 'rel', 'rel', '' FROM site),
mapped AS (SELECT DISTINCT request_id, target, bucket, regexp_replace(href, '([^/])/$', '\\1') AS url FROM found)
"""

HOMES = """
homes AS (SELECT page_id AS p, CAST(page_id AS VARCHAR) AS request_id, 'https://s' || page_id || '.test' AS target FROM pages)
"""

MEDIA = """
m AS (
  SELECT p_brand AS request_id, 'https://shop.test/brand/' || regexp_extract(p_brand, '([0-9]+)', 1) AS target,
    p_partkey AS k, p_partkey % 40 AS i, CAST(p_size AS DOUBLE) AS size FROM part),
entries AS (
  SELECT request_id, target, 0 AS b, 'images' AS bucket, k, 0 AS pos, 'image' AS type,
    'https://shop.test/img/' || i || '.jpg' AS src, 'part ' || k AS alt, size AS score FROM m
  UNION ALL SELECT request_id, target, 0, 'images', k, 1, 'image', 'https://shop.test/img/' || i || '.jpg', 'copy', NULL FROM m
  UNION ALL SELECT request_id, target, 0, 'images', k, 2, 'video', 'https://shop.test/clip/' || i || '.mp4', NULL, NULL FROM m
  UNION ALL SELECT request_id, target, 1, 'videos', k, 0, 'video', 'https://shop.test/clip/' || i || '.mp4', NULL, NULL FROM m WHERE size > 40
  UNION ALL SELECT request_id, target, 2, 'audios', k, 0, 'audio', 'https://cdn.test/a/' || (k % 9) || '.mp3', NULL, NULL FROM m WHERE size < 5),
inventory AS (
  SELECT * FROM entries
  QUALIFY row_number() OVER (PARTITION BY request_id, target, bucket, type, src ORDER BY k, pos) = 1)
"""


def _json_field(name: str, value: str) -> str:
    return f"'\"{name}\":' || to_json({value})"


_COMMON = f"'{{' || {_json_field('url', 'page_url')} || ',' || {_json_field('html', 'html')}"
_METADATA = (
    "',\"metadata\":{' || CASE p % 4 WHEN 0 THEN '\"title\":\"\",' WHEN 2 THEN '\"title\":\"Meta ' || p || '\",' ELSE '' END "
    "|| '\"description\":\"from service\",\"og\":{\"image\":\"service og ' || p || '\",\"width\":7}}'"
)
# Unreadable payloads have an even number divisible by 50, so their own URL is set and they are not redirected.
CUT_JSON = f"""CASE form
  WHEN 0 THEN {_COMMON} || ',"success":true,"status_code":200,' || {_json_field('markdown', 'md')} || {_METADATA}
    || ',"screenshot":"  shot-' || p || ' "}}'
  WHEN 1 THEN {_COMMON} || ',"success":false,"status_code":404,"markdown":{{' || {_json_field('raw_markdown', 'md')} || ','
    || {_json_field('markdown_with_citations', "'cited ' || md")} || ',"references_markdown":"refs"}}' || {_METADATA}
    || ',"screenshot":{{"url":"https://shots.test/' || p || '"}}}}'
  ELSE {_COMMON} || ',"success":"true","markdown":{{"fit_markdown":"fit only"}},"screenshot_url":"https://flat.test/' || p || '"}}'
  END"""

_TITLE = r"trim(coalesce(regexp_extract(html, '(?i)<title[^>]*>([\s\S]*?)</title>', 1), ''))"
_SCREENSHOT = """
  CASE WHEN form = 0 THEN 'shot-' || p END AS screenshot,
  CASE WHEN form = 1 AND p % 2 = 0 THEN 'https://shots.test/' || p WHEN form = 2 AND p % 2 = 0 THEN 'https://flat.test/' || p END AS shot_url,
  CASE WHEN form = 1 AND p % 2 = 1 THEN 'b64-' || p WHEN form = 2 AND p % 4 = 1 THEN 'flat-' || p
    WHEN form = 2 AND p % 4 = 3 THEN 'camel-' || p END AS base64
"""

REFERENCE_SQL: dict[str, str] = {
    "target_list": """
SELECT CAST(page_id AS VARCHAR) AS request_id, CAST(0 AS INTEGER) AS position, url AS target_url FROM pages
  WHERE page_id % 4 IN (0, 2) OR page_id % 8 = 5
UNION ALL SELECT CAST(page_id AS VARCHAR), 1, url || '#x' FROM pages WHERE page_id % 4 = 0
UNION ALL SELECT CAST(page_id AS VARCHAR), 0, 'HTTP://UPPER.test' FROM pages WHERE page_id % 4 = 3
UNION ALL SELECT CAST(page_id AS VARCHAR), 1, url FROM pages WHERE page_id % 8 = 3""",
    "target_rejects": """
SELECT CAST(page_id AS VARCHAR) AS request_id, CAST(400 AS INTEGER) AS status,
  'Invalid or missing target URL. Provide ''url'' or ''urls'' with valid http(s) values.' AS error
FROM pages WHERE page_id % 8 = 1""",
    "payload_scan": f"""
WITH {RECORDS}, cut AS (SELECT *, {CUT_JSON} AS json_text FROM rec)
SELECT request_id, p % 50 = 0 AS corrupt, CASE WHEN p % 50 = 0 THEN '~' || json_text END AS corrupt_text FROM cut""",
    "record_headers": f"WITH {RECORDS} SELECT {HEAD}, target FROM every",
    "record_headers_by_ordinal": f"""
WITH {RECORDS} SELECT request_id, CAST(0 AS INTEGER) AS record_pos,
  coalesce(own_url, redirected_url, CASE WHEN p % 5 = 1 THEN page_url || '#second' ELSE page_url END) AS url,
  redirected_url, success, status_code, page_url AS target FROM ok WHERE html IS NOT NULL""",
    "page_links": f"WITH {LINKS} SELECT request_id, bucket, href, text, title FROM found",
    "usage_period_account": f"""
WITH {USAGE} SELECT request_id, endpoint, response_code, credit_used, us AS created FROM usage_log
WHERE account_id = 'a3' AND us >= epoch_us(TIMESTAMP '2024-01-01')""",
    "usage_period_key_closed": f"""
WITH {USAGE} SELECT request_id, endpoint, response_code, credit_used, us AS created FROM usage_log
WHERE api_key = 'k8' AND month = '2024-01'""",
    "usage_append": FINISHED,
    "usage_append_again": FINISHED,
    "usage_append_stream": FINISHED,
    "view_sink": f"""
WITH {RECORDS} SELECT request_id, CAST(record_pos AS INTEGER) AS record_pos, url, success, status_code, {MARKDOWN} AS markdown FROM ok""",
    "metadata_view": f"""
WITH {RECORDS}, kept AS (SELECT * FROM ok WHERE NOT (form = 2 AND p % 10 IN (6, 9)))
SELECT {HEAD}, 'title' AS key, CASE p % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE 'Meta ' || p END AS value
  FROM kept WHERE form < 2 AND p % 4 <> 3
UNION ALL SELECT {HEAD}, 'description', 'from service' FROM kept WHERE form < 2 AND p % 5 = 0
UNION ALL SELECT {HEAD}, 'og', '{{"image":"service og ' || p || '","width":7}}' FROM kept WHERE form < 2
UNION ALL SELECT {HEAD}, NULL, NULL FROM kept WHERE form = 2""",
    "html_view": f"WITH {RECORDS} SELECT {HEAD}, html FROM ok WHERE html IS NOT NULL",
    "markdown_view": f"""
WITH {RECORDS} SELECT {HEAD}, {MARKDOWN} AS markdown, CASE WHEN form = 1 THEN 'cited ' || md END AS markdown_with_citations,
  CASE WHEN form = 1 THEN 'refs' END AS references_markdown, CASE WHEN form = 2 THEN 'fit only' END AS fit_markdown FROM ok""",
    "text_view_payloads": f"WITH {RECORDS} SELECT {HEAD}, {_clean(MARKDOWN)} AS text FROM ok",
    "text_view_pages": f"""
SELECT CAST(page_id AS VARCHAR) AS request_id, CAST(0 AS INTEGER) AS record_pos, url, CAST(NULL AS VARCHAR) AS redirected_url,
  true AS success, CAST(NULL AS INTEGER) AS status_code, {_clean(_strip_tags('html'))} AS text FROM pages""",
    "text_view_documents": f"WITH {DOCS} SELECT request_id, url, {_clean('text')} AS text FROM docs",
    "seo_view": f"""
WITH {RECORDS} SELECT {HEAD},
  CASE WHEN form < 2 AND p % 4 = 1 THEN '  ' WHEN form < 2 AND p % 4 = 2 THEN 'Meta ' || p ELSE {_TITLE} END AS title,
  CASE WHEN form < 2 AND p % 5 = 0 THEN 'from service' WHEN form = 0 THEN 'About page ' || p ELSE '' END AS description,
  '' AS keywords, CASE WHEN form = 0 THEN 'index,follow' ELSE '' END AS robots,
  CASE WHEN form = 0 THEN page_url ELSE '' END AS canonical,
  CASE WHEN form = 0 THEN 'og ' || p ELSE '' END AS og_title, '' AS og_description,
  CASE WHEN form < 2 THEN 'service og ' || p ELSE '' END AS og_image, '' AS og_url,
  CASE WHEN form = 0 THEN 'article' ELSE '' END AS og_type,
  CASE WHEN form = 0 THEN 'summary ' || (p % 5) ELSE '' END AS twitter_card,
  '' AS twitter_title, '' AS twitter_description, '' AS twitter_image
FROM ok WHERE form < 2 OR html IS NOT NULL""",
    "extract_fields_documents": f"""
WITH {DOCS}, {FIELDS} SELECT request_id, CAST(0 AS INTEGER) AS record_pos, url, field, value FROM fields""",
    "extract_fields_default": f"""
WITH {RECORDS}, t AS (
  SELECT request_id, url, CASE WHEN form = 0 OR (form = 1 AND p % 2 = 0) THEN md ELSE {_strip_tags('html')} END AS text
  FROM ok WHERE form = 0 OR (form = 1 AND p % 2 = 0) OR html IS NOT NULL)
SELECT request_id, url, array_to_string({_emails('text')}, ' ') AS emails, array_to_string({_phones('text')}, ' ') AS phones FROM t""",
    "extract_by_request": f"""
WITH {DOCS}, {FIELDS} SELECT request_id, CAST(0 AS INTEGER) AS record_pos, url, field, value FROM fields
WHERE (CAST(request_id AS BIGINT) % 4 = 0 AND field IN ('urls', 'emails'))
  OR (CAST(request_id AS BIGINT) % 4 IN (2, 3) AND field IN ('emails', 'phones'))""",
    "screenshot_view": f"""
WITH {RECORDS}, shots AS (SELECT *, {_SCREENSHOT} FROM ok)
SELECT {HEAD}, screenshot, shot_url, base64 FROM shots""",
    "bulk_items": f"WITH {RECORDS} SELECT {HEAD.replace('request_id', 'request_id AS job_id', 1)} FROM every",
    "bulk_summary": f"""
WITH {RECORDS} SELECT request_id AS job_id, count(*) AS count, count(*) FILTER (success) AS succeeded,
  count(*) FILTER (NOT success) AS failed, count(*) FILTER (status_code >= 400) AS error_status FROM every GROUP BY request_id
UNION ALL SELECT 'e' || page_id, 0, 0, 0, 0 FROM pages WHERE page_id % 10 = 0""",
    "owned_bulk_items": f"""
WITH {RECORDS} SELECT {HEAD.replace('request_id', 'request_id AS job_id', 1)}, 'owner1' AS owner FROM every WHERE p % 3 = 1""",
    "view_totals_html": f"""
WITH {RECORDS} SELECT count(*) AS count, CAST(coalesce(sum({_units('html')}), 0) AS BIGINT) AS total_characters FROM ok WHERE html IS NOT NULL""",
    "view_totals_markdown": f"""
WITH {RECORDS} SELECT count(*) AS count, CAST(coalesce(sum({_units(MARKDOWN)}), 0) AS BIGINT) AS total_characters FROM ok""",
    "view_totals_text": f"""
SELECT count(*) AS count, CAST(coalesce(sum({_units(_clean(_strip_tags('html')))}), 0) AS BIGINT) AS total_characters FROM pages""",
    "request_quality": f"""
WITH {RECORDS}, good AS (SELECT request_id FROM ok WHERE form < 2 OR html IS NOT NULL)
SELECT request_id, CAST(2 AS BIGINT) AS targets, CASE WHEN request_id IN (SELECT request_id FROM good) THEN CAST(1 AS BIGINT) ELSE 0 END AS records,
  CAST(CASE WHEN request_id IN (SELECT request_id FROM good) THEN 200 ELSE 502 END AS INTEGER) AS status FROM rec""",
    "empty_requests": f"WITH {RECORDS} SELECT request_id, CAST(502 AS INTEGER) AS status FROM rec WHERE p % 50 = 0",
    "link_map": f"WITH {LINKS} SELECT request_id, target, url, bucket FROM mapped",
    "link_counts": f"""
WITH {LINKS} SELECT request_id, target, count(*) AS total, count(*) FILTER (bucket = 'internal') AS internal,
  count(*) FILTER (bucket = 'external') AS external FROM mapped GROUP BY ALL""",
    "link_lists": f"""
WITH {LINKS} SELECT request_id, target, string_agg(url, ' ' ORDER BY url) FILTER (bucket = 'internal') AS internal,
  string_agg(url, ' ' ORDER BY url) FILTER (bucket = 'external') AS external, string_agg(url, ' ' ORDER BY url) AS "all"
FROM mapped GROUP BY request_id, target""",
    "link_map_payloads": f"""
WITH {HOMES} SELECT request_id, target, target || path AS url, 'internal' AS bucket
  FROM homes, (VALUES ('/contact'), ('/p/1'), ('/blog')) t(path) WHERE p % 4 = 0
UNION ALL SELECT request_id, target, 'https://partner' || (p % 7) || '.test/a', 'external' FROM homes WHERE p % 4 = 0""",
    "link_counts_payloads": f"""
WITH {HOMES} SELECT request_id, target, CAST(CASE WHEN p % 4 = 0 THEN 4 ELSE 0 END AS BIGINT) AS total,
  CAST(CASE WHEN p % 4 = 0 THEN 3 ELSE 0 END AS BIGINT) AS internal, CAST(CASE WHEN p % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS external
FROM homes WHERE p % 4 <> 3""",
    "media_inventory_payloads": f"""
WITH {HOMES} SELECT request_id, target, bucket, type, target || path AS src, alt, format, CAST(score AS DOUBLE) AS score
FROM homes, (VALUES ('images', 'image', '/img/1.png', 'one', NULL, 2), ('images', 'video', '/b.gif', NULL, NULL, NULL),
  ('videos', 'video', '/v.mp4', NULL, 'mp4', NULL)) t(bucket, type, path, alt, format, score) WHERE p % 3 = 0""",
    "media_counts_payloads": f"""
WITH {HOMES} SELECT request_id, target, CAST(CASE WHEN p % 3 = 0 THEN 3 ELSE 0 END AS BIGINT) AS total,
  CAST(CASE WHEN p % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS images, CAST(CASE WHEN p % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS videos,
  CAST(0 AS BIGINT) AS audios FROM homes WHERE p % 3 < 2""",
    "page_media": """
WITH s AS (
  SELECT CAST(page_id AS VARCHAR) AS request_id, url AS target, page_id AS p, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin,
    CASE WHEN page_id % 3 = 1 THEN regexp_extract(url, '^(https?://[^/]+)', 1) || '/deep/'
      ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') END AS folder FROM pages),
pictures AS (SELECT unnest([
  {'path': '/x.jpg', 'alt': 'see src=foo', 'width': NULL}, {'path': '/lazy.png', 'alt': NULL, 'width': NULL},
  {'path': '/s1.png', 'alt': NULL, 'width': 480}, {'path': '/s2,2.png', 'alt': NULL, 'width': NULL},
  {'path': '/poster.png', 'alt': NULL, 'width': NULL}, {'path': '/pic.webp', 'alt': NULL, 'width': NULL}]) AS i)
SELECT request_id, target, 'images' AS bucket, 'image' AS type, origin || '/i/' || p || '.png' AS src, 'A "q"' AS alt, CAST(30 AS DOUBLE) AS width FROM s
UNION ALL SELECT request_id, target, 'images', 'image', origin || '/i/x.png', NULL, NULL FROM s
UNION ALL SELECT request_id, target, 'images', 'image', origin || i.path, i.alt, CAST(i.width AS DOUBLE) FROM s, pictures
UNION ALL SELECT request_id, target, 'videos', 'video', folder || 'v.mp4', NULL, NULL FROM s
UNION ALL SELECT request_id, target, 'audios', 'audio', folder || 'a.ogg', NULL, NULL FROM s""",
    "locale_listing": """
WITH w AS (
  SELECT DISTINCT p_brand AS request_id, list_extract(['zebra', 'Äpfel', 'apfel', 'Apfel', 'öl', 'Zebra'], p_partkey % 6 + 1) AS src FROM part)
SELECT request_id, src, CAST(row_number() OVER (PARTITION BY request_id
  ORDER BY list_position(['apfel', 'Apfel', 'Äpfel', 'öl', 'zebra', 'Zebra'], src)) AS INTEGER) AS place FROM w""",
    "email_index_payloads": f"""
WITH {HOMES} SELECT target, 'm' || p || '@site.test' AS email, target || '/contact' || CASE WHEN p % 3 = 0 THEN '' ELSE '/' END AS source
FROM homes WHERE p % 4 = 0""",
    "seo_view_values": f"""
WITH {HOMES} SELECT request_id, CAST(0 AS INTEGER) AS record_pos, target AS url, CAST(NULL AS VARCHAR) AS redirected_url, false AS success,
  CAST(NULL AS INTEGER) AS status_code, CASE WHEN p % 6 IN (2, 3) THEN 'Svc' ELSE 'T' || p END AS title, '' AS description,
  'k' || p AS keywords, CASE WHEN p % 6 = 3 THEN 'noindex' ELSE '' END AS robots, CASE WHEN p % 6 = 3 THEN '7' ELSE '' END AS canonical,
  CASE WHEN p % 6 = 0 THEN 'svc' ELSE 'og' || p END AS og_title, '' AS og_description, '' AS og_image, '' AS og_url, '' AS og_type,
  '' AS twitter_card, '' AS twitter_title, '' AS twitter_description, '' AS twitter_image FROM homes""",
    "overlap_free_external": f"WITH {LINKS} SELECT request_id, target, url FROM mapped WHERE bucket = 'external'",
    "media_inventory": f"WITH {MEDIA} SELECT request_id, target, bucket, type, src, alt, score FROM inventory",
    "media_all": f"""
WITH {MEDIA} SELECT request_id, target, type, src, alt, score FROM inventory
QUALIFY row_number() OVER (PARTITION BY request_id, target, type, src ORDER BY b) = 1""",
    "media_counts": f"""
WITH {MEDIA} SELECT request_id, target, count(DISTINCT type || '|' || src) AS total,
  count(*) FILTER (bucket = 'images') AS images, count(*) FILTER (bucket = 'videos') AS videos,
  count(*) FILTER (bucket = 'audios') AS audios FROM inventory GROUP BY request_id, target""",
    "contact_pages": f"WITH {SITES} SELECT DISTINCT target, page_url FROM candidates",
    "scanned_pages": f"WITH {SITES} SELECT target, page_url, is_seed, position FROM scanned",
    "scanned_coverage": f"""
WITH {SITES} SELECT target, page_url, is_seed, position, CASE WHEN is_seed THEN CAST(0 AS BIGINT) ELSE 1 END AS records FROM scanned""",
    "email_index": f"WITH {SITES} SELECT target, email, source FROM email_rows",
    "email_sources": f"""
WITH {SITES} SELECT target, email, string_agg(source, ' ' ORDER BY source) AS sources FROM email_rows GROUP BY target, email""",
    "email_source_chunks": f"""
WITH {SITES}, placed AS (
  SELECT target, email, source, CAST((row_number() OVER (PARTITION BY target, email ORDER BY source) - 1) // 3 AS INTEGER) AS chunk FROM email_rows)
SELECT target, email, chunk, string_agg(source, ' ' ORDER BY source) AS sources FROM placed GROUP BY target, email, chunk""",
    "email_counts": f"""
WITH {SITES} SELECT target, (SELECT count(*) FROM scanned s WHERE s.target = seeds.target) AS pages_scanned,
  (SELECT count(*) FROM candidates c WHERE c.target = seeds.target) AS candidate_pages,
  (SELECT count(DISTINCT email) FROM email_rows e WHERE e.target = seeds.target) AS emails_found FROM seeds""",
    "url_forms": r"""
WITH b AS (
  SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS bare, regexp_replace(url, '#.*$', '') AS unhashed,
    regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, regexp_extract(url, '^(https?):', 1) AS scheme FROM pages),
x AS (
  SELECT *, substring(bare, length(origin) + 1) AS path, regexp_replace(bare, '[^/]*$', '') AS folder,
    regexp_replace(regexp_replace(bare, '[^/]*$', ''), '[^/]*/$', '') AS parent,
    regexp_replace(bare, '/[^/]*$', '') AS cut FROM b)
SELECT page_id, 'normalize' AS form, url AS raw, true AS valid, regexp_replace(unhashed, '/$', '') AS result FROM x
UNION ALL SELECT page_id, 'normalize', upper(origin) || path, true, regexp_replace(bare, '/$', '') FROM x
UNION ALL SELECT page_id, 'normalize', '  ' || bare || '/../a/./b/#frag', true, cut || '/a/b' FROM x
UNION ALL SELECT page_id, 'normalize', bare || '/café x?q=ü''&r=%C3', true, bare || '/caf%C3%A9%20x?q=%C3%BC%27&r=%C3' FROM x
UNION ALL SELECT page_id, 'normalize', 'http://h.test:80/' || page_id || '//', true, 'http://h.test/' || page_id || '/' FROM x
UNION ALL SELECT page_id, 'normalize', 'https://h.test:8443?' || page_id, true, 'https://h.test:8443/?' || page_id FROM x
UNION ALL SELECT page_id, 'normalize', 'ftp://h.test/' || page_id, false, NULL FROM x
UNION ALL SELECT page_id, 'normalize', 'http://www.BÜCHER。test/' || page_id, true, 'http://www.xn--bcher-kva.test/' || page_id FROM x
UNION ALL SELECT page_id, 'normalize', 'http://[0:0:0:2::FFFF:1.2.3.4]:80/' || page_id || '/', true, 'http://[::2:0:ffff:102:304]/' || page_id FROM x
UNION ALL SELECT page_id, 'normalize', 'http://[1::2::3]/' || page_id, false, NULL FROM x
UNION ALL SELECT page_id, 'normalize', 'http://' || repeat('é', 64) || '.test/' || page_id, false, NULL FROM x
UNION ALL SELECT page_id, 'resolve', '/img/a.jpg#hero', false, origin || '/img/a.jpg' FROM x
UNION ALL SELECT page_id, 'resolve', 'b.png?x=1', false, folder || 'b.png?x=1' FROM x
UNION ALL SELECT page_id, 'resolve', '../c.gif', false, parent || 'c.gif' FROM x
UNION ALL SELECT page_id, 'resolve', '//cdn.test/d', false, scheme || '://cdn.test/d' FROM x
UNION ALL SELECT page_id, 'resolve', '?only=query', false, bare || '?only=query' FROM x
UNION ALL SELECT page_id, 'resolve', 'data:image/png;base64,AA#B', false, 'data:image/png;base64,AA#B' FROM x
UNION ALL SELECT page_id, 'resolve', 'mailto:X@y.test', false, 'mailto:X@y.test' FROM x
UNION ALL SELECT page_id, 'resolve', '#top', false, unhashed FROM x
UNION ALL SELECT page_id, 'resolve', '  ', false, NULL FROM x""",
    "usage_by_endpoint": f"""
WITH {USAGE} SELECT endpoint, count(*) AS requests, CAST(sum(credit_used) AS DOUBLE) AS credits FROM usage_log
GROUP BY endpoint ORDER BY requests DESC, endpoint""",
    "usage_by_status": f"WITH {USAGE} SELECT response_code AS status, count(*) AS requests FROM usage_log GROUP BY response_code",
    "usage_totals": f"""
WITH {USAGE} SELECT count(*) AS total_requests, CAST(sum(credit_used) AS DOUBLE) AS total_credits FROM usage_log""",
    "usage_rollup": f"WITH {USAGE} {_rollup('usage_log', 'response_code', 'credit_used')}",
    "usage_rollup_mixed": f"WITH {USAGE} {_rollup('mixed', 'status', 'credit')}",
    "usage_summary": f"""
WITH {USAGE} SELECT '2024-01' AS period, 'account' AS scope, * FROM (
  {_rollup('usage_log', 'response_code', 'credit_used', "WHERE account_id = 'a3' AND us >= epoch_us(TIMESTAMP '2024-01-01')")})""",
    "monthly_credits": f"""
WITH {USAGE} SELECT account_id, month, CAST(sum(credit_used) AS DOUBLE) AS credits FROM usage_log
WHERE credit_used > 0 GROUP BY account_id, month""",
    "monthly_credits_mixed": f"""
WITH {USAGE} SELECT account_id, month, sum(credit) AS credits FROM mixed WHERE credit > 0 GROUP BY account_id, month""",
    "monthly_credits_stream": f"""
WITH {USAGE} SELECT account_id, month, CAST(sum(credit_used) AS DOUBLE) AS credits FROM usage_log
WHERE credit_used > 0 GROUP BY account_id, month""",
    "credits_before": f"""
WITH {USAGE} SELECT request_id, account_id, us AS ts, CAST(coalesce(sum(credit_used) OVER (
  PARTITION BY account_id, month ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS used_credits
FROM usage_log""",
    "access_audit": _audit(strict=False),
    "access_audit_strict": _audit(strict=True),
    "static_key_check": f"""
WITH {USAGE} SELECT event_id AS request_id, CAST(CASE WHEN k = 99 THEN 401 WHEN k = 98 OR user_id % 7 = 0 THEN 403 ELSE 200 END AS INTEGER) AS code
FROM ev""",
    "latest_registrations": f"""
WITH {USAGE}, reg AS (
  SELECT event_id AS seq, CASE WHEN user_id % 3 = 0 THEN 'id' || user_id WHEN user_id % 3 = 1 THEN 'k' || user_id
      WHEN user_id % 6 = 2 THEN 'a' || user_id ELSE 'anonymous' END AS owner,
    'https://hooks.example.com/' || event_id AS url,
    CASE k % 4 WHEN 0 THEN 'bulk.completed' WHEN 2 THEN 'bulk.failed' ELSE 'bulk.completed bulk.failed' END AS events,
    us - us % 3600000000 AS updated_at
  FROM ev WHERE event_type <> 'error')
SELECT owner, url, events, updated_at FROM reg QUALIFY row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC, seq DESC) = 1""",
    "rejected_registrations": f"""
WITH {USAGE} SELECT event_id AS seq, CASE WHEN user_id % 3 = 0 THEN 'id' || user_id WHEN user_id % 3 = 1 THEN 'k' || user_id
    WHEN user_id % 6 = 2 THEN 'a' || user_id ELSE 'anonymous' END AS owner, CAST(400 AS INTEGER) AS status,
  'Invalid webhook URL. Provide a valid http(s) URL.' AS error FROM ev WHERE event_type = 'error'""",
    "rate_limit_audit": f"""
WITH {USAGE} SELECT request_id, ip_address, ts, window_start FROM burst_windows
QUALIFY row_number() OVER (PARTITION BY ip_address, window_start ORDER BY ts, request_id) > 100""",
    "rate_limit_windows": f"""
WITH {USAGE} SELECT ip_address, window_start, count(*) AS requests FROM burst_windows
GROUP BY ip_address, window_start HAVING count(*) > 100""",
    "rate_limit_client_windows": f"""
WITH RECURSIVE {USAGE}, instants AS MATERIALIZED (SELECT ip_address, ts AS moment, count(*) AS n FROM burst_windows GROUP BY ip_address, ts),
starts AS (
  SELECT ip_address, min(moment) AS moment FROM instants GROUP BY ip_address
  UNION ALL
  SELECT s.ip_address, min(i.moment) FROM starts s JOIN instants i ON i.ip_address = s.ip_address AND i.moment >= s.moment + 900000000
  GROUP BY s.ip_address)
SELECT i.ip_address, s.moment AS window_start, CAST(sum(n) AS BIGINT) AS requests, greatest(CAST(sum(n) AS BIGINT) - 100, 0) AS over
FROM instants i ASOF JOIN starts s ON i.ip_address = s.ip_address AND i.moment >= s.moment GROUP BY i.ip_address, s.moment""",
    "rate_limit_stream": f"""
WITH {USAGE} SELECT ip_address, window_start, count(*) AS requests FROM burst_windows
GROUP BY ip_address, window_start HAVING count(*) > 100""",
    "usage_rollup_stream": f"""
WITH {USAGE}, hours AS (SELECT *, us - us % 3600000000 AS hour FROM usage_log)
SELECT hour, endpoint, response_code AS status, count(*) AS requests, CAST(sum(credit_used) AS DOUBLE) AS credits FROM hours
GROUP BY hour, endpoint, response_code""",
}

# Other ways to the same rows.
REFERENCE_SQL |= {
    "credits_from_ledger": REFERENCE_SQL["credits_before"],
    "usage_rollup_any_order": REFERENCE_SQL["usage_rollup_stream"],
    "monthly_credits_any_order": REFERENCE_SQL["monthly_credits_stream"],
    "rate_limit_any_order": REFERENCE_SQL["rate_limit_stream"],
}
