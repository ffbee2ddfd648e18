"""Usage rollups and monthly credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.numbers import number_or_zero, positive_or_null
from pagelens.functions.text import non_empty
from pagelens.sources.usage_log import period_label, period_start, usage_scan

UNKNOWN = "unknown"
CREDIT_COLUMNS = ("credit_used", "credits")


def _text_or_unknown(log: DataFrame, name: str) -> Column:
    if name not in log.columns:
        return F.lit(UNKNOWN)
    return F.coalesce(non_empty(F.col(name).cast("string")), F.lit(UNKNOWN))


def _credit_source(log: DataFrame, credit_column: str | None) -> tuple[Column, object]:
    """The first credit column that holds a value, and its type."""
    names = [n for n in dict.fromkeys([credit_column, *CREDIT_COLUMNS]) if n in log.columns]
    if not names:
        return F.lit(0), None
    if len(names) == 1:
        return F.col(names[0]), log.schema[names[0]].dataType
    return F.coalesce(*[F.col(n).cast("string") for n in names]), None


def credit(log: DataFrame, credit_column: str | None = None) -> Column:
    return number_or_zero(*_credit_source(log, credit_column))


def positive_credit(log: DataFrame, credit_column: str | None = None) -> Column:
    return positive_or_null(*_credit_source(log, credit_column))


def cleaned(log: DataFrame, credit_column: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Endpoint, status and credit of each log row; nothing else travels further."""
    return log.select(
        *keep,
        _text_or_unknown(log, "endpoint").alias("endpoint"),
        _text_or_unknown(log, "response_code").alias("status"),
        credit(log, credit_column).alias("credit"),
    )


def _sums() -> list[Column]:
    return [F.count("*").alias("requests"), F.sum("credit").alias("credits")]


def usage_by_endpoint(log: DataFrame, credit_column: str | None = None) -> DataFrame:
    """Requests and credits per endpoint, busiest first."""
    per_endpoint = cleaned(log, credit_column).groupBy("endpoint").agg(*_sums())
    return per_endpoint.orderBy(F.col("requests").desc(), "endpoint")


def usage_by_status(log: DataFrame) -> DataFrame:
    return cleaned(log).groupBy("status").agg(F.count("*").alias("requests"))


def usage_totals(log: DataFrame, credit_column: str | None = None) -> DataFrame:
    return cleaned(log, credit_column).agg(
        F.count("*").alias("total_requests"), F.coalesce(F.sum("credit"), F.lit(0.0)).alias("total_credits")
    )


def usage_rollup(log: DataFrame, credit_column: str | None = None) -> DataFrame:
    """Endpoint, status and total rows in one pass over the log.

    ``level`` tells which: endpoint, status or total. An empty log has a total of
    zero, which grouping sets leave out, so a zero row is added to their few rows.
    """
    sets = [[F.col("endpoint")], [F.col("status")], []]
    rolled = cleaned(log, credit_column).groupingSets(sets, "endpoint", "status").agg(
        F.grouping_id().alias("gid"), *_sums()
    )
    level = F.when(F.col("gid") == 1, "endpoint").when(F.col("gid") == 2, "status").otherwise("total")
    name = F.coalesce("endpoint", "status", F.lit("all"))
    rows = rolled.select(level.alias("level"), name.alias("name"), "requests", "credits")
    zero = log.sparkSession.range(1).select(
        F.lit("total").alias("level"), F.lit("all").alias("name"),
        F.lit(0).cast("bigint").alias("requests"), F.lit(0.0).alias("credits"),
    )
    return rows.unionByName(zero).groupBy("level", "name").agg(
        F.sum("requests").alias("requests"), F.sum("credits").alias("credits")
    )


def usage_summary(
    log: DataFrame,
    period: str | None,
    scope: str | None,
    value: str,
    closed: bool = False,
    column_map: dict[str, str] | None = None,
) -> DataFrame:
    """The rollup of one account or key for a period, labelled."""
    scope = (scope or "key").lower()
    rows = usage_scan(log, period, scope, value, closed, column_map)
    label = period_label(period_start(period))
    return usage_rollup(rows).select(F.lit(label).alias("period"), F.lit(scope).alias("scope"), "*")


def monthly_credits(log: DataFrame, credit_column: str | None = None) -> DataFrame:
    """Credits per account and UTC month; only positive values count."""
    return (
        log.groupBy("account_id", F.date_format("created", "yyyy-MM").alias("month"))
        .agg(F.sum(positive_credit(log, credit_column)).alias("credits"))
        .filter(F.col("credits").isNotNull())
    )
