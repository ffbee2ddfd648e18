"""Credits carried from day to day, so that an audit of new days reads those days of the log only.

The ledger has one row per account and day of its month, from the account's first row on:
``carried`` is what it used in the month before that day, ``credits`` what it used on the day.
It is a table of one folder per day.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.operators.audit import running_credits
from pagelens.operators.usage import positive_credit

ROW = "account_id string, carried double, credits double"


def _or_zero(amount: str | Column) -> Column:
    return F.coalesce(amount, F.lit(0.0))


def day_credits(log: DataFrame, credit_column: str | None = None) -> DataFrame:
    """Credits per account and UTC day; days without a positive value are 0, rows without account or time left out."""
    rows = log.filter(F.col("account_id").isNotNull() & F.col("created").isNotNull())
    spent = _or_zero(F.sum(positive_credit(log, credit_column)))
    return rows.groupBy("account_id", F.to_date("created").alias("day")).agg(spent.alias("credits"))


def credit_ledger(log: DataFrame, until: date, credit_column: str | None = None) -> DataFrame:
    """The ledger of a whole log through the day ``until``: (account_id, day, carried, credits).

    A window holds the days of one account's month, 31 rows at most.
    """
    days = day_credits(log, credit_column).filter(F.col("day") <= F.lit(until))
    month = Window.partitionBy("account_id", F.trunc("day", "month")).orderBy("day")
    carried = _or_zero(F.sum("credits").over(month.rowsBetween(Window.unboundedPreceding, -1)))
    end = F.least(F.last_day("day"), F.lit(until))
    last = F.coalesce(F.date_sub(F.lead("day").over(month), 1), end)
    spans = days.withColumns({"carried": carried, "days": F.sequence("day", last)})
    rows = spans.select("account_id", F.col("day").alias("active"), "carried", "credits", F.explode("days").alias("day"))
    own = F.col("day") == F.col("active")
    return rows.select(
        "account_id", "day",
        F.when(own, F.col("carried")).otherwise(F.col("carried") + F.col("credits")).alias("carried"),
        F.when(own, F.col("credits")).otherwise(F.lit(0.0)).alias("credits"),
    )


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Write ledger rows to the table at ``path``; only the days among them are written over."""
    writer = ledger.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(path)


def extend_ledger(day_log: DataFrame, path: str, day: date, credit_column: str | None = None) -> None:
    """Add one day to the ledger at ``path`` from that day's log and the day before in the ledger.

    On the first of a month nothing is carried. Otherwise the day before must be there,
    and a missing one is an error. A day that is added again takes its own place.
    """
    spark = day_log.sparkSession
    new = on_days(day_log, "created", day, day)
    fresh = day_credits(new, credit_column).select("account_id", F.col("credits").alias("spent"))
    if day.day == 1:
        rows = fresh.select("account_id", F.lit(0.0).alias("carried"), F.col("spent").alias("credits"))
    else:
        before = spark.read.schema(ROW).parquet(f"{path}/day={day - timedelta(days=1)}")
        opening = before.select("account_id", (F.col("carried") + F.col("credits")).alias("opening"))
        rows = opening.join(fresh, "account_id", "full").select(
            "account_id", _or_zero("opening").alias("carried"), _or_zero("spent").alias("credits")
        )
    rows.write.mode("overwrite").parquet(f"{path}/day={day}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ROW}, day date").parquet(path)


def on_days(rows: DataFrame, column: str, first: date, last: date) -> DataFrame:
    """Rows of the UTC days ``first`` to ``last``; a table with ``day`` folders is read in those folders only."""
    at = F.col(column)
    found = rows.filter((at >= F.lit(first).cast("timestamp")) & (at < F.lit(last + timedelta(days=1)).cast("timestamp")))
    if "day" not in rows.columns:
        return found
    return found.filter(F.col("day").cast("date").between(F.lit(first), F.lit(last)))


def credits_from_ledger(requests: DataFrame, log: DataFrame, ledger: DataFrame, credit_column: str | None = None) -> DataFrame:
    """``credits_before`` with what earlier days used taken from the ledger.

    ``log`` needs to hold only the days of the requests (``on_days``), ``ledger`` an account's rows
    of those days; an account without one has used nothing before. A request without account
    or time has used nothing.
    """
    running = running_credits(requests, log, credit_column, span="day").withColumn("day", F.to_date("ts"))
    opening = ledger.select("account_id", "day", "carried")
    used = running.join(opening, ["account_id", "day"], "left").select(
        "account_id", "ts", (F.col("used_credits") + _or_zero("carried")).alias("used_credits")
    )
    return requests.join(used, ["account_id", "ts"], "left").select(
        "request_id", "account_id", "ts", _or_zero("used_credits").alias("used_credits")
    )
