"""The usage log: reading a period and scope, building rows, appending them."""

from __future__ import annotations

import re
from collections.abc import Collection
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.endpoints import client_ip, logged_credit, logged_endpoint

# Log columns of the short and of the full record.
MINIMAL_COLUMNS = ("api_key", "response_code", "credit_used", "endpoint", "method", "account_id")
EXTENDED_COLUMNS = ("timestamp", "latency_ms", "user_agent", "ip_address")

USAGE_SCHEMA = (
    "api_key string, response_code string, credit_used bigint, endpoint string, method string, "
    "account_id string, timestamp string, latency_ms bigint, user_agent string, ip_address string, "
    "created timestamp"
)


def period_start(period: str | None, now: datetime | None = None) -> datetime:
    """First instant of a ``YYYY-MM`` period in UTC.

    Text of another shape means the current month; a month that does not exist
    is an error.
    """
    if period is not None and re.fullmatch(r"[0-9]{4}-[0-9]{2}", period):
        try:
            return datetime.strptime(period, "%Y-%m").replace(tzinfo=timezone.utc)
        except ValueError:
            raise ValueError("Invalid period format. Use YYYY-MM.") from None
    now = now or datetime.now(timezone.utc)
    return datetime(now.year, now.month, 1, tzinfo=timezone.utc)


def period_label(start: datetime) -> str:
    return f"{start.year:04d}-{start.month:02d}"


def _next_month(start: datetime) -> datetime:
    return start.replace(year=start.year + start.month // 12, month=start.month % 12 + 1)


def _instant(value: datetime) -> Column:
    return F.timestamp_micros(F.lit(int(value.timestamp()) * 1_000_000))


def rename_columns(log: DataFrame, column_map: dict[str, str] | None) -> DataFrame:
    """Give a log with its own column names (``{ours: theirs}``) the usual names.

    A column that is not mapped keeps its name, so the usual one still serves
    as the second choice where the mapped one is empty.
    """
    for ours, theirs in (column_map or {}).items():
        if ours != theirs and theirs in log.columns:
            second = [F.col(ours)] if ours in log.columns else []
            log = log.withColumn(ours, F.coalesce(F.col(theirs), *second))
    return log


def usage_scan(
    log: DataFrame,
    period: str | None,
    scope: str,
    value: str,
    closed: bool = False,
    column_map: dict[str, str] | None = None,
) -> DataFrame:
    """Log rows of one account or key from the period's start on.

    Only the start bounds the period, so an older period includes all later
    months; ``closed`` adds the end. All conditions are plain comparisons and
    reach the file scan; with a ``month`` partition column whole folders are
    skipped.
    """
    if not value:
        wanted = "account context" if scope == "account" else "an API key"
        raise ValueError(f"scope {scope!r} requires {wanted}")
    start = period_start(period)
    names = {"api_key": "api_key", "account_id": "account_id", "created": "created", **(column_map or {})}
    owner = names["account_id"] if scope.lower() == "account" else names["api_key"]
    rows = log.filter((F.col(owner) == value) & (F.col(names["created"]) >= _instant(start)))
    if "month" in log.columns:
        rows = rows.filter(F.col("month") >= period_label(start))
    if closed:
        rows = rows.filter(F.col(names["created"]) < _instant(_next_month(start)))
        if "month" in log.columns:
            rows = rows.filter(F.col("month") == period_label(start))
    return rename_columns(rows, column_map)


def usage_records(requests: DataFrame, extended: bool = True) -> DataFrame:
    """Log rows of finished requests.

    ``requests``: api_key, account_id, base_url, path, original_url, method,
    status_code, user_agent, forwarded_for, ip, started_at, finished_at.
    """
    endpoint = logged_endpoint("base_url", "path", "original_url")
    status = F.coalesce(F.col("status_code"), F.lit(0))
    empty = F.lit("")
    columns = {
        "api_key": F.coalesce("api_key", empty),
        "response_code": status.cast("string"),
        "credit_used": logged_credit(endpoint, status).cast("bigint"),
        "endpoint": endpoint,
        "method": F.coalesce("method", empty),
        "account_id": F.coalesce("account_id", empty),
    }
    if extended:
        iso = F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        columns |= {
            "timestamp": iso,
            "latency_ms": F.unix_millis("finished_at") - F.unix_millis("started_at"),
            "user_agent": F.coalesce("user_agent", empty),
            "ip_address": client_ip("forwarded_for", "ip"),
        }
    return requests.select(*[c.alias(n) for n, c in columns.items()], F.col("finished_at").alias("created"))


def with_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.date_format("created", "yyyy-MM"))


def _accepts_extended(spark: SparkSession, path: str) -> bool:
    """Whether the log at ``path`` has the extended columns; a log that does not exist yet does."""
    try:
        return set(EXTENDED_COLUMNS) <= set(spark.read.parquet(path).columns)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return True
        raise


def append_usage(
    requests: DataFrame, path: str, columns: Collection[str] | None = None, batch: str | None = None, daily: bool = False
) -> None:
    """Append finished requests to the month-partitioned log.

    A log without the extended columns gets the short record. ``columns`` names the
    log's columns, so that they needn't be looked up in its files. With the name of a
    ``batch`` a batch that is appended again takes its own place: batches are folders
    within a month, and only those of this batch are written over. ``daily`` puts a folder
    per day into the month. A log is kept with batches (or days) from its beginning, or without.
    """
    known = None if columns is None else set(EXTENDED_COLUMNS) <= set(columns)
    extended = _accepts_extended(requests.sparkSession, path) if known is None else known
    rows, folders = with_month(usage_records(requests, extended)), ["month"]
    if daily:
        rows, folders = rows.withColumn("day", F.to_date("created")), [*folders, "day"]
    if batch is None:
        rows.write.mode("append").partitionBy(*folders).parquet(path)
        return
    named = rows.withColumn("batch", F.lit(batch))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders, "batch").parquet(path)
