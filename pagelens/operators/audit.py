"""Access decisions over a request table, and the credits used before each request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.functions.endpoints import CREDIT_EXEMPT, audit_cost, audit_endpoint, endpoint_allowed, relation_id, rule_list
from pagelens.functions.numbers import positive_or_null
from pagelens.functions.text import non_empty, strip_ws
from pagelens.operators.usage import positive_credit
from pagelens.session import scratch_dir

# Reason, status code and message of each decision, in the order they are checked.
DECISIONS = (
    ("missing_key", 401, "Missing API key. Provide it via the x-api-key header."),
    ("unknown_key", 403, "Invalid API key."),
    ("key_inactive", 403, "API key is inactive."),
    ("key_revoked", 403, "API key is revoked."),
    ("key_expired", 403, "API key has expired."),
    ("no_account", 403, "API key is not linked to an account."),
    ("account_not_found", 503, "Authentication service unavailable."),
    ("subscription_inactive", 403, "Account subscription is not active."),
    ("plan_not_found", 503, "Authentication service unavailable."),
    ("endpoint_not_allowed", 403, "Endpoint not allowed for this API key: "),
    ("credits_exceeded", 429, "Monthly credit limit exceeded."),
    ("no_user", 403, "Account has no linked user."),
    ("user_not_found", 503, "Authentication service unavailable."),
    ("user_not_verified", 403, "User is not verified."),
)


@dataclass(frozen=True)
class AccessPolicy:
    """Which checks apply."""

    allowed_key_status: tuple[str, ...] = ("active",)
    allowed_subscriptions: tuple[str, ...] = ()
    require_verified_user: bool = True
    enforce_endpoints: bool = True
    enforce_monthly_credits: bool = True
    enforce_key_credits: bool = False
    credit_exempt: tuple[str, ...] = CREDIT_EXEMPT


def running_credits(moments: DataFrame, log: DataFrame, credit_column: str | None = None, span: str = "month") -> DataFrame:
    """Credits used in the month (or another ``span``) strictly before each ``(account_id, ts)`` of ``moments``.

    Rows are first summed per account and instant, so a running sum never sees
    two rows of one instant. It is then taken in two steps: over the seconds of
    a month, and over the instants of a second. A window holds at most the
    seconds of one month or the microseconds of one second, however many rows an
    account has.
    """
    asked = moments.select("account_id", "ts", F.lit(0.0).alias("credit"), F.lit(True).alias("asked"))
    used = log.select(
        "account_id",
        F.col("created").alias("ts"),
        F.coalesce(positive_credit(log, credit_column), F.lit(0.0)).alias("credit"),
        F.lit(False).alias("asked"),
    )
    instants = (
        asked.unionByName(used)
        .filter(F.col("account_id").isNotNull() & F.col("ts").isNotNull())
        .groupBy("account_id", "ts")
        .agg(F.sum("credit").alias("credit"), F.max("asked").alias("asked"))
        .withColumn("second", F.date_trunc("second", "ts"))
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    seconds = (
        instants.groupBy("account_id", "second")
        .agg(F.sum("credit").alias("credit"), F.max("asked").alias("asked"))
        .withColumn("span", F.date_trunc(span, "second"))
        .withColumn(
            "before_second",
            F.sum("credit").over(before.partitionBy("account_id", "span").orderBy("second")),
        )
        .filter("asked")
        .select("account_id", "second", "before_second")
    )
    within = (
        instants.withColumn(
            "in_second", F.sum("credit").over(before.partitionBy("account_id", "second").orderBy("ts"))
        )
        .filter("asked")
        .select("account_id", "second", "ts", "in_second")
    )
    zero = F.lit(0.0)
    total = F.coalesce("before_second", zero) + F.coalesce("in_second", zero)
    # Every second of the left side is on the right. As an outer join it adds no
    # filters of its own, so both sides read the same shuffled instants.
    joined = within.join(seconds, ["account_id", "second"], "left")
    return joined.select("account_id", "ts", total.alias("used_credits"))


def credits_before(requests: DataFrame, log: DataFrame, credit_column: str | None = None) -> DataFrame:
    """``requests(request_id, account_id, ts)`` with the credits used before each."""
    running = running_credits(requests, log, credit_column)
    return requests.join(running, ["account_id", "ts"], "left").select(
        "request_id", "account_id", "ts", F.coalesce("used_credits", F.lit(0.0)).alias("used_credits")
    )


def _is_array(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def _column(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _rules(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.array().cast("array<string>")
    return rule_list(name, _is_array(df, name))


def _amount(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    return positive_or_null(name, df.schema[name].dataType)


def _relation(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    return relation_id(name, _is_array(df, name))


def _first_failed(checks: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in checks.items()])


def key_context(
    keys: DataFrame, accounts: DataFrame, plans: DataFrame, users: DataFrame, policy: AccessPolicy = AccessPolicy()
) -> DataFrame:
    """What is known about each key, in one row.

    Checks that do not depend on the request are decided here, over the registry
    tables: ``key_failed``, ``account_failed`` and ``user_failed`` name the first
    failing one of each group. The request table then joins once and carries few
    columns. If a key value occurs twice the one with the lowest id is taken.
    """
    k = keys.select(
        "key",
        F.col("id").alias("api_key_id"),
        F.lower(F.coalesce(_column(keys, "status"), F.lit(""))).alias("key_status"),
        _column(keys, "revoked_at").cast("string").try_cast("timestamp").alias("revoked_at"),
        F.coalesce(_column(keys, "expires", "boolean"), F.lit(False)).alias("expires"),
        _column(keys, "expiration_date").cast("string").try_cast("timestamp").alias("expires_at"),
        _relation(keys, "account").alias("account_id"),
        _rules(keys, "allowed_endpoints_override").alias("key_rules"),
        _amount(keys, "monthly_credits_override").alias("key_limit"),
    )
    first = Window.partitionBy("key").orderBy("api_key_id")
    k = k.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    a = accounts.select(
        F.col("id").alias("account_id"),
        _relation(accounts, "user").alias("user_id"),
        _relation(accounts, "plan").alias("plan_id"),
        _column(accounts, "role").alias("role"),
        F.lower(F.coalesce(_column(accounts, "stripe_sub_status"), F.lit(""))).alias("subscription"),
        F.lit(True).alias("account_found"),
    )
    p = plans.select(
        F.col("id").alias("plan_id"),
        _rules(plans, "allowed_endpoints").alias("plan_rules"),
        _amount(plans, "monthly_credits").alias("plan_limit"),
        F.lit(True).alias("plan_found"),
    )
    u = users.select(F.col("id").alias("user_id"), "verified", F.lit(True).alias("user_found"))
    linked = k.join(a.join(p, "plan_id", "left").join(u, "user_id", "left"), "account_id", "left")

    no, no_rules = F.lit(False), F.array().cast("array<string>")
    own_rules = F.size("key_rules") > 0
    # A plan counts only where its credits or its endpoint rules are asked for.
    needs_plan = F.col("plan_id").isNotNull() & (
        F.lit(policy.enforce_monthly_credits) | (F.lit(policy.enforce_endpoints) & ~own_rules)
    )
    rules = F.when(own_rules, F.col("key_rules")).when(needs_plan, F.col("plan_rules"))
    subscribed = F.col("subscription").isin(*policy.allowed_subscriptions) if policy.allowed_subscriptions else ~no
    active = F.col("key_status").isin(*policy.allowed_key_status) if policy.allowed_key_status else ~no
    return linked.select(
        "key", "api_key_id", "account_id", "user_id", "plan_id", "role",
        F.lit(True).alias("key_found"),
        _first_failed({"key_inactive": ~active, "key_revoked": F.col("revoked_at").isNotNull()}).alias("key_failed"),
        F.when(F.col("expires"), F.coalesce("expires_at", F.lit(0).cast("timestamp"))).alias("expires_at"),
        _first_failed({
            "no_account": F.col("account_id").isNull(),
            "account_not_found": F.col("account_found").isNull(),
            "subscription_inactive": ~subscribed,
            "plan_not_found": needs_plan & F.col("plan_found").isNull(),
        }).alias("account_failed"),
        _first_failed({
            "no_user": F.col("user_id").isNull(),
            "user_not_found": F.col("user_found").isNull(),
            "user_not_verified": F.lit(policy.require_verified_user) & ~F.coalesce("verified", no),
        }).alias("user_failed"),
        (F.coalesce(rules, no_rules) if policy.enforce_endpoints else no_rules).alias("rules"),
        F.when(needs_plan & F.lit(policy.enforce_monthly_credits), F.col("plan_limit")).alias("plan_limit"),
        F.when(F.lit(policy.enforce_monthly_credits and policy.enforce_key_credits), F.col("key_limit")).alias("key_limit"),
    )


def _lookup(field: int, dtype: str) -> Column:
    """A value of ``DECISIONS`` for the row's reason."""
    pairs = [F.lit(v) for name, *rest in DECISIONS for v in (name, rest[field])]
    return F.create_map(*pairs)[F.col("reason")].cast(dtype)


def access_audit(
    requests: DataFrame,
    keys: DataFrame,
    accounts: DataFrame,
    plans: DataFrame,
    users: DataFrame,
    log: DataFrame,
    policy: AccessPolicy = AccessPolicy(),
) -> DataFrame:
    """Decision and first failing reason of each request.

    ``requests(request_id, api_key, method, endpoint, ts)``. Past usage is read
    beside requests that cost something; it counts for those that have passed so far
    and whose account has a limit.
    """
    context = key_context(keys, accounts, plans, users, policy)
    asked = requests.select(
        "request_id", "ts", non_empty("api_key").alias("key"), audit_endpoint("endpoint").alias("endpoint"), "method"
    ).withColumn("cost", audit_cost(F.col("endpoint"), F.col("method"), policy.credit_exempt)).drop("method")
    known = asked.join(context, "key", "left")
    before_credits = F.coalesce(
        F.when(F.col("key").isNull(), "missing_key"),
        F.when(F.col("key_found").isNull(), "unknown_key"),
        F.col("key_failed"),
        F.when(F.col("expires_at") <= F.col("ts"), "key_expired"),
        F.col("account_failed"),
        F.when(~endpoint_allowed(F.col("endpoint"), F.col("rules")), "endpoint_not_allowed"),
    )
    checked = known.select(
        "request_id", "ts", "endpoint", "cost", "api_key_id", "account_id", "user_id", "plan_id", "role",
        "user_failed", "plan_limit", "key_limit", before_credits.alias("failed"),
    )
    has_limit = F.col("plan_limit").isNotNull() | F.col("key_limit").isNotNull()
    metered = F.col("failed").isNull() & (F.col("cost") > 0) & has_limit
    if policy.enforce_monthly_credits:
        # The account of a key is all that past usage needs, so the other tables are joined once.
        own = keys.groupBy("key").agg(F.min_by(F.struct(_relation(keys, "account").alias("account_id")), "id").alias("own"))
        owners = own.select("key", "own.account_id").filter("account_id IS NOT NULL")
        running = running_credits(asked.filter("cost > 0").join(owners, "key"), log)
        checked = checked.join(running, ["account_id", "ts"], "left")
    else:
        checked = checked.withColumn("used_credits", F.lit(None).cast("double"))
    used = F.when(metered, F.coalesce("used_credits", F.lit(0.0)))
    judged = checked.withColumn("used_credits", used).withColumn("projected", F.col("used_credits") + F.col("cost"))
    # The plan's limit comes first; the key's own limit may still allow the request.
    over_plan = F.col("projected") > F.col("plan_limit")
    key_allows = F.coalesce(F.col("projected") <= F.col("key_limit"), F.lit(False))
    limit = F.when(F.col("plan_limit").isNull() | (over_plan & key_allows), F.col("key_limit")).otherwise(F.col("plan_limit"))
    judged = judged.withColumn("monthly_limit", F.when(F.col("used_credits").isNotNull(), limit))
    over = F.when(F.col("projected") > F.col("monthly_limit"), "credits_exceeded")
    decided = judged.withColumn("reason", F.coalesce("failed", over, "user_failed", F.lit("allowed")))

    ok = F.col("reason") == "allowed"
    message = _lookup(1, "string")
    message = F.when(F.col("reason") == "endpoint_not_allowed", F.concat(message, "endpoint")).otherwise(message)
    shown_if_ok = ("api_key_id", "account_id", "user_id", "plan_id", "role", "used_credits")
    return decided.select(
        "request_id", "endpoint", ok.alias("allowed"),
        F.coalesce(_lookup(0, "int"), F.lit(200)).alias("code"),
        "reason", message.alias("error"),
        *[F.when(ok, F.col(c)).alias(c) for c in shown_if_ok],
        F.when(ok, F.col("monthly_limit")).alias("monthly_credit_limit"),
    )


def static_key_check(requests: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Decision by a plain key list: missing 401, unknown 403, listed 200; 503 without a list."""
    asked = requests.select("request_id", non_empty("api_key").alias("key"))
    if keys is None:
        return asked.select("request_id", F.when(F.col("key").isNull(), 401).otherwise(503).alias("code"))
    listed = keys.select(non_empty(strip_ws("key")).alias("key"), F.lit(True).alias("listed"))
    checked = asked.join(listed.filter("key IS NOT NULL").distinct(), "key", "left")
    code = F.when(F.col("key").isNull(), 401).when(F.col("listed").isNull(), 403).otherwise(200)
    return checked.select("request_id", code.alias("code"))


def _cut(counts: DataFrame, group: list[str], unit: str, limit: int, name: str) -> DataFrame:
    """The unit of time in which each group passes the limit, as ``name``, and the requests ``before`` it.

    counts: group, unit, n, and before: the group's requests before all of its units.
    """
    earlier = Window.partitionBy(*group).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    running = counts.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    full = (F.col("before") <= limit) & (F.col("before") + F.col("n") > limit)
    return running.filter(full).select(*group, F.col(unit).alias(name), "before")


def rate_limit_audit(requests: DataFrame, limit: int = 100, window: str = "15 minutes") -> DataFrame:
    """Requests beyond ``limit`` per client address and tumbling window.

    ``requests(request_id, ip_address, ts)``. Requests are counted per instant and per second.
    A running sum over the seconds of a window finds the one in which the limit is passed, a
    running sum over that second's instants the deciding instant; either has a fixed number of
    rows at most. Only the requests of that instant are ranked; every later one is over the
    limit. The plan is the same for every limit, and no task ranks a whole busy address or second.
    """
    group = ["ip_address", "window_start"]
    rows = requests.select("request_id", "ip_address", "ts", F.window("ts", window)["start"].alias("window_start"))
    instants = rows.groupBy(*group, "ts").agg(F.count(F.lit(1)).alias("n")).withColumn("second", F.date_trunc("second", "ts"))
    seconds = instants.groupBy(*group, "second").agg(F.sum("n").alias("n")).withColumn("before", F.lit(0).cast("bigint"))
    within = instants.join(_cut(seconds, group, "second", limit, "full_second"), group).filter(F.col("second") == F.col("full_second"))
    reached = _cut(within, group, "ts", limit, "full_ts")
    beyond = rows.join(reached, group).filter(F.col("ts") >= F.col("full_ts"))
    ranked = beyond.filter(F.col("ts") == F.col("full_ts"))
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("request_id")))
    kept = ["request_id", "ip_address", "ts", "window_start"]
    in_instant = ranked.filter(F.col("before") + F.col("n") > limit).select(*kept)
    return beyond.filter(F.col("ts") > F.col("full_ts")).select(*kept).unionByName(in_instant)


def _next_starts(instants: DataFrame, micros: int) -> DataFrame:
    """instants (ip_address, at) with ``next``: the address's first instant ``micros`` or more later, NULL if there is none.

    Time is cut in spans of that length, so the instant asked for lies in the next span, or
    is the first one of a later span. A task sees one span of an address at a time.
    """
    span = F.floor(F.col("at") / micros)
    points = instants.withColumn("span", span)
    firsts = points.groupBy("ip_address", "span").agg(F.min("at").alias("first"))
    # The first instant of a later span than the next one; one row for each span of an address.
    after = Window.partitionBy("ip_address").orderBy("span").rowsBetween(1, 2)
    spans = firsts.select("ip_address", F.col("span").alias("own"), F.collect_list(F.struct("span", "first")).over(after).alias("ahead"))
    beyond = F.filter("ahead", lambda x: x["span"] > F.col("own") + 1)
    spans = spans.select("ip_address", "own", F.get(beyond, F.lit(0))["first"].alias("beyond"))
    # Points and questions of a span in one order, latest first: a question takes the last point before it there.
    asked = instants.select("ip_address", (F.col("at") + micros).alias("place"), F.col("at").alias("asks"), F.lit(None).cast("bigint").alias("point"))
    given = instants.select("ip_address", F.col("at").alias("place"), F.lit(None).cast("bigint").alias("asks"), F.col("at").alias("point"))
    both = asked.unionByName(given).withColumn("span", F.floor(F.col("place") / micros))
    order = Window.partitionBy("ip_address", "span").orderBy(F.desc("place"), F.col("point").desc_nulls_last())
    found = both.withColumn("near", F.last("point", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    answers = found.filter("asks IS NOT NULL").select("ip_address", F.col("asks").alias("at"), (F.col("span") - 1).alias("own"), "near")
    joined = answers.join(spans, ["ip_address", "own"])
    return joined.select("ip_address", "at", F.coalesce("near", "beyond").alias("next"))


def client_windows(requests: DataFrame, limit: int = 100, minutes: int = 15) -> DataFrame:
    """Windows that begin with an address's first request, and the next ones with its first request after they end.

    (ip_address, window_start, requests, over) for every window; ``over`` counts what is
    beyond the limit. Where the next window would begin is known for every instant; which
    instants begin one is found by pointer jumping: reached instants jump on, and jumps are
    doubled, so a chain of n windows takes log2(n) rounds, whatever an address sends within them.
    Each round's pointers are written once. A window of an address ends at the next one's start.
    """
    micros = minutes * 60_000_000
    counts = requests.filter("ip_address IS NOT NULL AND ts IS NOT NULL").groupBy("ip_address", F.unix_micros("ts").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    instants = _written(counts, "instants")
    jumps = _written(_next_starts(instants.select("ip_address", "at"), micros), "jumps")
    starts = _written(instants.groupBy("ip_address").agg(F.min("at").alias("at")), "starts")
    known, size = starts.count(), 0
    while known > size:
        size = known
        reached = starts.join(jumps, ["ip_address", "at"]).select("ip_address", F.col("next").alias("at")).filter("at IS NOT NULL")
        starts = _written(starts.unionByName(reached).distinct(), "starts")
        known = starts.count()
        second = jumps.select("ip_address", F.col("at").alias("next"), F.col("next").alias("then"))
        jumps = _written(jumps.join(second, ["ip_address", "next"]).select("ip_address", "at", F.col("then").alias("next")).filter("next IS NOT NULL"), "jumps")
    # Every instant belongs to the latest start up to it: in its own span or, at the earliest, the one before.
    span = F.floor(F.col("at") / micros)
    begun = starts.withColumn("span", span).groupBy("ip_address", "span").agg(F.max("at").alias("start"))
    placed = instants.withColumn("span", span)
    own = placed.join(begun, ["ip_address", "span"], "left")
    own = own.withColumn("start", F.when(F.col("start") <= F.col("at"), F.col("start")))
    before = begun.select("ip_address", (F.col("span") + 1).alias("span"), F.col("start").alias("earlier"))
    joined = own.join(before, ["ip_address", "span"], "left").withColumn("start", F.coalesce("start", "earlier"))
    total = joined.groupBy("ip_address", "start").agg(F.sum("n").alias("requests"))
    return total.select(
        "ip_address", F.timestamp_micros("start").alias("window_start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("over")
    )


def _written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared scratch folder."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rate_limit_windows(requests: DataFrame, limit: int = 100, window: str = "15 minutes") -> DataFrame:
    """Addresses and windows with more than ``limit`` requests."""
    return (
        requests.groupBy("ip_address", F.window("ts", window)["start"].alias("window_start"))
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
    )
