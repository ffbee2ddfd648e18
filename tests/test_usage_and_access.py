import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pagelens.operators import audit, registrations, usage
from pagelens.sources import usage_log as L

UTC = timezone.utc
START = datetime(2026, 4, 1, tzinfo=UTC)


def log_of(spark, rows):
    schema = "api_key string, account_id string, endpoint string, response_code string, credit_used string, credits string, created timestamp"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def log(spark):
    day = timedelta(days=1)
    return log_of(spark, [
        ("k", "a", "/v2/gethtml", "200", "2", None, START), ("k", "a", "/v2/gethtml", "200", "2", None, START + day),
        ("k", "a", "/v2/getseo", "429", "1", None, START + 40 * day), ("k", "a", "", None, None, "4", START - day),
        ("k", "b", None, "", "-3", "9", START), ("z", "a", "/v2/map", "200", "x", "5", START),
    ])


def test_period_start():
    assert L.period_start("2026-04") == START
    now = datetime(2025, 7, 9, tzinfo=UTC)
    assert L.period_start("2026-4", now) == L.period_start(None, now) == datetime(2025, 7, 1, tzinfo=UTC)
    with pytest.raises(ValueError):
        L.period_start("2026-13")
    assert L.period_label(START) == "2026-04"


def test_scan_has_an_open_end_unless_closed(log):
    assert L.usage_scan(log, "2026-04", "key", "k").count() == 4
    assert L.usage_scan(log, "2026-04", "key", "k", closed=True).count() == 3
    assert L.usage_scan(log, "2026-04", "ACCOUNT", "a").count() == 4
    assert L.usage_scan(log, "2026-04", "anything", "z").count() == 1
    for scope in ("key", "account"):
        with pytest.raises(ValueError):
            L.usage_scan(log, "2026-04", scope, "")


def test_scan_with_own_column_names(log):
    renamed = log.withColumnRenamed("account_id", "acct").withColumnRenamed("created", "at").withColumn("credits_x", F.lit("7"))
    names = {"account_id": "acct", "created": "at", "credit_used": "credits_x"}
    rows = L.usage_scan(renamed, "2026-04", "account", "a", column_map=names)
    assert usage.usage_totals(rows).first().total_credits == 28.0


def test_summary_of_a_key(log):
    rows = {(r.level, r.name): (r.requests, r.credits) for r in usage.usage_summary(log, "2026-04", "key", "k").collect()}
    assert rows["total", "all"] == (4, 2.0)
    assert rows["endpoint", "/v2/gethtml"] == (2, 4.0) and rows["endpoint", "unknown"] == (1, -3.0)
    assert rows["status", "200"] == (2, 4.0) and rows["status", "unknown"][0] == 1
    labels = usage.usage_summary(log, "2026-04", "key", "k").select("period", "scope").distinct().collect()
    assert [tuple(r) for r in labels] == [("2026-04", "key")]


def test_rollup_agrees_with_its_parts(log):
    rolled = {(r.level, r.name): r for r in usage.usage_rollup(log).collect()}
    for r in usage.usage_by_endpoint(log).collect():
        assert (rolled["endpoint", r.endpoint].requests, rolled["endpoint", r.endpoint].credits) == (r.requests, r.credits)
    for r in usage.usage_by_status(log).collect():
        assert rolled["status", r.status].requests == r.requests
    totals = usage.usage_totals(log).first()
    assert (rolled["total", "all"].requests, rolled["total", "all"].credits) == tuple(totals) == (6, 6.0)
    assert sum(r.credits for k, r in rolled.items() if k[0] == "endpoint") == totals.total_credits
    counts = [r.requests for r in usage.usage_by_endpoint(log).collect()]
    assert counts == sorted(counts, reverse=True)


def test_empty_log_has_a_total_of_zero(log):
    assert [tuple(r) for r in usage.usage_rollup(log.filter("false")).collect()] == [("total", "all", 0, 0.0)]
    assert tuple(usage.usage_totals(log.filter("false")).first()) == (0, 0.0)


def test_monthly_credits_ignore_negative_values(log):
    rows = {(r.account_id, r.month): r.credits for r in usage.monthly_credits(log).collect()}
    assert rows == {("a", "2026-04"): 4.0, ("a", "2026-05"): 1.0, ("a", "2026-03"): 4.0}


def test_append_and_short_record(spark, tmp_path):
    schema = (
        "api_key string, account_id string, base_url string, path string, original_url string, method string, status_code int, "
        "user_agent string, forwarded_for string, ip string, started_at timestamp, finished_at timestamp"
    )
    done = START + timedelta(milliseconds=1500)
    rows = [
        ("k", "a", "/v2", "/map/", "/x", "POST", 200, "ua", "1.1.1.1, 2.2.2.2", "9", START, done),
        (None, None, "/v2", "/usage", "", None, None, None, None, None, START, START), ("k", "a", "", "", "/v2/crawl", "GET", 502, "", " ", "9", START, done),
    ]
    requests, path = spark.createDataFrame(rows, schema), str(tmp_path / "log")
    L.append_usage(requests, path)
    L.append_usage(requests, path)
    written = spark.read.parquet(path)
    assert written.count() == 6
    row = written.filter("endpoint = '/v2/map'").first()
    assert (row.credit_used, row.latency_ms, row.ip_address, row.timestamp, str(row.month)) == (1, 1500, "1.1.1.1", "2026-04-01T00:00:01.500Z", "2026-04")
    blank = written.filter("endpoint = '/v2/usage'").first()
    assert (blank.api_key, blank.response_code, blank.credit_used, blank.method, blank.ip_address) == ("", "0", 0, "", "")
    assert written.filter("endpoint = '/v2/crawl'").first().credit_used == 0

    short = str(tmp_path / "short")
    L.with_month(L.usage_records(requests, extended=False)).write.partitionBy("month").parquet(short)
    L.append_usage(requests, short)
    assert set(spark.read.parquet(short).columns) == {*L.MINIMAL_COLUMNS, "created", "month"}
    assert spark.read.parquet(short).count() == 6


def test_append_fails_for_a_log_that_cannot_be_read(spark, tmp_path):
    """Only a missing log counts as new."""
    path = tmp_path / "log" / "month=2024-01"
    path.mkdir(parents=True)
    (path / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        L._accepts_extended(spark, str(tmp_path / "log"))
    assert L._accepts_extended(spark, str(tmp_path / "missing"))


def test_credits_before_against_brute_force(spark):
    random.seed(7)
    rows, asked = [], []
    for i in range(1500):
        account = "hot" if i % 3 == 0 else f"a{i % 7}"
        # Few instants, so that many rows share a microsecond or a second, around a month's end.
        at = datetime(2026, 4, 30, 23, 59, 58, tzinfo=UTC) + timedelta(microseconds=random.randint(0, 30) * 130_000)
        rows.append((None, account, None, None, random.choice(["1", "2", "-1", "x", None]), None, at))
        asked.append((i, random.choice([account, "unseen", None]), at + timedelta(microseconds=random.choice([0, 0, 1]))))
    expected = {}
    for i, account, at in asked:
        used = 0.0
        for _, other, _, _, credit, _, when in rows:
            if other == account and (when.year, when.month) == (at.year, at.month) and when < at and credit in ("1", "2"):
                used += float(credit)
        expected[i] = used
    requests = spark.createDataFrame(asked, "request_id int, account_id string, ts timestamp")
    got = audit.credits_before(requests, log_of(spark, rows)).collect()
    assert {r.request_id: r.used_credits for r in got} == expected and len(got) == len(asked)


def test_rate_limit_against_brute_force(spark):
    random.seed(9)
    rows = []
    for i in range(2000):
        ip = "hot" if i % 3 == 0 else f"10.0.0.{i % 5}"
        rows.append((i, ip, START + timedelta(seconds=random.randint(0, 40) * 60)))
    groups = {}
    for i, ip, at in rows:
        groups.setdefault((ip, int(at.timestamp()) // 900), []).append((at, i))
    expected = {i for g in groups.values() for _, i in sorted(g)[50:]}
    requests = spark.createDataFrame(rows, "request_id int, ip_address string, ts timestamp")
    assert {r.request_id for r in audit.rate_limit_audit(requests, limit=50).collect()} == expected
    windows = audit.rate_limit_windows(requests, limit=50).collect()
    assert sum(r.requests - 50 for r in windows) == len(expected)


def test_rate_limit_of_copies_and_of_a_burst_in_one_second(spark):
    rows = [(i // 3, "a", START + timedelta(microseconds=i // 10)) for i in range(400)] + [(7, "b", START)] * 9 + [(1, None, START)] * 9
    requests = spark.createDataFrame(rows, "request_id int, ip_address string, ts timestamp").repartition(5)
    for limit in (0, 1, 5, 100, 5000):
        over = sorted((r.ip_address, r.ts.replace(tzinfo=None), r.request_id) for r in audit.rate_limit_audit(requests, limit=limit).collect())
        expected = []
        for ip in ("a", "b"):
            expected += sorted((t.replace(tzinfo=None), i) for i, who, t in rows if who == ip)[limit:]
        assert [o[1:] for o in over] == expected


def test_client_windows_equal_a_plain_loop(spark):
    random.seed(12)
    rows = []
    for ip, gap in (("busy", 40), ("calm", 2000), ("odd", 900), ("mixed", 700)):
        at = START
        for _ in range(300):
            at += timedelta(seconds=random.choice([0, 1, gap, gap * 3 if ip == "mixed" else gap]), microseconds=random.choice([0, 0, 1]))
            rows.append((len(rows), ip, at))
    rows += [(9001, "one", START), (9002, None, START), (9003, "one", None)]
    expected, open_ = {}, {}
    for _, ip, at in sorted((r for r in rows if r[1] and r[2]), key=lambda r: r[2]):
        if ip not in open_ or at >= open_[ip] + timedelta(minutes=15):
            open_[ip] = at
        expected[ip, open_[ip].replace(tzinfo=None)] = expected.get((ip, open_[ip].replace(tzinfo=None)), 0) + 1
    requests = spark.createDataFrame(rows, "request_id int, ip_address string, ts timestamp")
    got = audit.client_windows(requests, limit=3).collect()
    assert {(r.ip_address, r.window_start.replace(tzinfo=None)): r.requests for r in got} == expected
    assert all(r.over == max(0, r.requests - 3) for r in got)
    assert audit.client_windows(requests.limit(0)).count() == 0


KEY = {"status": "active", "revoked_at": None, "expires": False, "expiration_date": None, "account": "acc", "rules": [], "own": None}
ACCOUNT = {"user": "usr", "plan": None, "stripe_sub_status": "active"}
PLAN = {"id": "p", "allowed_endpoints": None, "monthly_credits": None}
REQUEST = {"api_key": "key", "method": "POST", "endpoint": "/v2/crawl"}


def decide(spark, policy, cases):
    """Audit one request per case; every case has its own key, account, plan and user."""

    def own(i, value):
        return f"{value}{i}" if value else value

    requests, keys, accounts, plans, users, log = [], [], [], [], [], []
    for i, case in cases.items():
        k, a, r = ({**base, **case.get(n, {})} for n, base in (("key", KEY), ("account", ACCOUNT), ("request", REQUEST)))
        requests.append((i, own(i, r["api_key"]), r["method"], r["endpoint"], START + timedelta(days=5)))
        keys.append((f"id{i}", f"key{i}", k["status"], k["revoked_at"], k["expires"], k["expiration_date"], [own(i, k["account"])], k["rules"], k["own"]))
        accounts.append((f"acc{i}", own(i, a["user"]), own(i, a["plan"]), "user", a["stripe_sub_status"]))
        if "plan" in case:
            p = {**PLAN, **case["plan"]}
            plans.append((own(i, p["id"]), p["allowed_endpoints"], p["monthly_credits"]))
        users.append((f"usr{i}", case.get("verified", True)))
        log += [(f"key{i}", f"acc{i}", None, None, "1", None, START + timedelta(hours=h)) for h in range(case.get("used", 0))]
    frame = spark.createDataFrame
    audited = audit.access_audit(
        frame(requests, "request_id int, api_key string, method string, endpoint string, ts timestamp"),
        frame(keys, "id string, key string, status string, revoked_at string, expires boolean, expiration_date string, "
              "account array<string>, allowed_endpoints_override array<string>, monthly_credits_override double"),
        frame(accounts, "id string, user string, plan string, role string, stripe_sub_status string"),
        frame(plans, "id string, allowed_endpoints string, monthly_credits double"),
        frame(users, "id string, verified boolean"),
        log_of(spark, log),
        policy,
    )
    return {r.request_id: r for r in audited.collect()}


OWN = audit.AccessPolicy(enforce_key_credits=True, enforce_endpoints=False)
CASES = [
    ({}, "allowed", 200),
    ({"request": {"api_key": ""}}, "missing_key", 401),
    ({"request": {"api_key": "other"}}, "unknown_key", 403),
    ({"key": {"status": "inactive"}}, "key_inactive", 403),
    ({"key": {"status": "ACTIVE", "revoked_at": "2026-01-01"}}, "key_revoked", 403),
    ({"key": {"revoked_at": "no date"}}, "allowed", 200),
    ({"key": {"expires": True}}, "key_expired", 403),
    ({"key": {"expires": True, "expiration_date": "2026-04-05T00:00:00Z"}}, "key_expired", 403),
    ({"key": {"expires": True, "expiration_date": "2026-05-01"}}, "allowed", 200),
    ({"key": {"expiration_date": "2020-01-01"}}, "allowed", 200),
    ({"key": {"account": ""}}, "no_account", 403),
    ({"key": {"account": "gone"}}, "account_not_found", 503),
    ({"account": {"stripe_sub_status": "canceled"}}, "allowed", 200),
    ({"account": {"stripe_sub_status": "canceled"}, "policy": audit.AccessPolicy(allowed_subscriptions=("active",))}, "subscription_inactive", 403),
    ({"account": {"plan": "p"}}, "plan_not_found", 503),
    ({"key": {"rules": ["/v2/metadata"]}}, "endpoint_not_allowed", 403),
    ({"key": {"rules": ["/v2/metadata"]}, "policy": audit.AccessPolicy(enforce_endpoints=False)}, "allowed", 200),
    ({"account": {"plan": "p"}, "plan": {"id": "p", "allowed_endpoints": "/v2/map"}}, "endpoint_not_allowed", 403),
    ({"key": {"rules": ["/V2/C*"]}, "account": {"plan": "p"}, "plan": {"id": "p", "allowed_endpoints": "/v2/map"}}, "allowed", 200),
    ({"key": {"own": 2.0}, "used": 2, "policy": OWN}, "credits_exceeded", 429),
    ({"key": {"own": 2.0}, "used": 1, "policy": OWN}, "allowed", 200),
    ({"key": {"own": 2.0}, "used": 2}, "allowed", 200),
    ({"key": {"own": 9.0}, "account": {"plan": "p"}, "plan": {"id": "p", "monthly_credits": 2.0}, "used": 4, "policy": OWN}, "allowed", 200),
    ({"account": {"plan": "p"}, "plan": {"id": "p", "monthly_credits": 2.0}, "used": 2}, "credits_exceeded", 429),
    ({"account": {"plan": "p"}, "plan": {"id": "p", "monthly_credits": 2.0}, "used": 2, "request": {"method": "OPTIONS"}}, "allowed", 200),
    ({"account": {"plan": "p"}, "plan": {"id": "p", "monthly_credits": 2.0}, "used": 2, "request": {"endpoint": "/v2/usage/?x"}}, "allowed", 200),
    ({"account": {"user": ""}}, "no_user", 403),
    ({"account": {"user": "gone"}}, "user_not_found", 503),
    ({"verified": False}, "user_not_verified", 403),
    ({"verified": None, "policy": audit.AccessPolicy(require_verified_user=False)}, "allowed", 200),
]


def test_access_decisions(spark):
    by_policy = {}
    for i, (case, *_) in enumerate(CASES):
        by_policy.setdefault(case.get("policy", audit.AccessPolicy()), {})[i] = case
    rows = {}
    for policy, cases in by_policy.items():
        rows |= decide(spark, policy, cases)
    got = [(rows[i].reason, rows[i].code, rows[i].allowed) for i in range(len(CASES))]
    assert got == [(reason, code, reason == "allowed") for _, reason, code in CASES]


def test_reported_limits_and_messages(spark):
    plan = {"account": {"plan": "p"}, "plan": {"monthly_credits": 5600.0}, "key": {"own": 0.0}, "used": 3}
    key = {"account": {"plan": "p"}, "plan": {"monthly_credits": 2.0}, "key": {"own": 9.0}, "used": 4}
    rows = decide(spark, OWN, {1: plan, 2: key})
    assert (rows[1].monthly_credit_limit, rows[1].used_credits, rows[1].account_id, rows[1].user_id) == (5600.0, 3.0, "acc1", "usr1")
    assert rows[2].monthly_credit_limit == 9.0
    denied = decide(spark, audit.AccessPolicy(), {1: {"key": {"rules": ["/v2/x"]}}})[1]
    assert denied.error == "Endpoint not allowed for this API key: /v2/crawl" and denied.account_id is None


def test_static_keys(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "x"), (3, ""), (4, None)], "request_id int, api_key string")
    keys = spark.createDataFrame([(" a ",), ("a",), ("",)], "key string")
    codes = {r.request_id: r.code for r in audit.static_key_check(requests, keys).collect()}
    assert codes == {1: 200, 2: 403, 3: 401, 4: 401}
    assert {r.code for r in audit.static_key_check(requests, None).collect()} == {503, 401}


def test_registrations(spark):
    rows = [
        (1, "", "k", None, "https://a.test/1", ["x"], START), (2, "", "k", None, " https://a.test/2 ", None, START),
        (3, "", "k", None, "nope", ["x"], START + timedelta(days=1)), (4, None, None, None, "https://a.test/4", [" y ", ""], START),
        (5, "id", "k", None, "https://a.test/5", [], START), (6, None, "z", None, "https://a.test/6", [" "], START),
    ]
    schema = "seq int, api_key_id string, api_key string, account_id string, url string, events array<string>, updated_at timestamp"
    frame = spark.createDataFrame(rows, schema)
    last = {r.owner: (r.url, r.events) for r in registrations.latest_per_owner(frame).collect()}
    default = ["bulk.completed", "bulk.failed"]
    assert last == {
        "k": ("https://a.test/2", default), "anonymous": ("https://a.test/4", ["y"]), "id": ("https://a.test/5", default), "z": ("https://a.test/6", [])
    }
    assert [(r.seq, r.status) for r in registrations.rejected_registrations(frame).collect()] == [(3, 400)]
