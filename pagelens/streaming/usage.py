"""Streaming rate-limit audit, usage rollup, monthly credits and usage append.

Windowed streams keep their sums in state and drop rows later than the watermark.
Sum streams (``sum_stream``) keep each micro-batch's sums as a table instead: they have no
watermark, so rows may arrive in any order and at any time, and a reading adds the batches up.
Aggregations combine on the map side of each micro-batch, so a busy address or account
costs one row per task.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagelens.operators.usage import cleaned, positive_credit
from pagelens.sources.usage_log import usage_records, with_month

LATENESS = "1 hour"
MONTH_LATENESS = "32 days"


def rate_limit_stream(requests: DataFrame, limit: int = 100, window: str = "15 minutes", lateness: str = LATENESS) -> DataFrame:
    """Windows in which an address has sent more than ``limit`` requests.

    In append mode a window comes out once it is closed, in update mode with every batch
    that adds to it, so that the windows still open are delivered too.
    """
    return (
        requests.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("w"), "ip_address")
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
        .select("ip_address", F.col("w.start").alias("window_start"), "requests")
    )


def usage_rollup_stream(log: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Requests and credits per hour, endpoint and status; append or update mode as above."""
    rows = cleaned(log, keep=("created",))
    return (
        rows.withWatermark("created", lateness)
        .groupBy(F.window("created", "1 hour").alias("w"), "endpoint", "status")
        .agg(F.count("*").alias("requests"), F.sum("credit").alias("credits"))
        .select(F.col("w.start").alias("hour"), "endpoint", "status", "requests", "credits")
    )


def monthly_credits_stream(log: DataFrame, lateness: str = MONTH_LATENESS) -> DataFrame:
    """Running credits per account and month (update mode).

    Event time is the end of a row's month. With a lateness of one month a month
    stays open through the following one; its state is dropped after that.
    """
    month = F.trunc(F.col("created").cast("date"), "month")
    return (
        log.select(
            "account_id",
            F.date_format(month, "yyyy-MM").alias("month"),
            F.add_months(month, 1).cast("timestamp").alias("month_end"),
            positive_credit(log).alias("credit"),
        )
        .withWatermark("month_end", lateness)
        .groupBy("account_id", "month", "month_end")
        .agg(F.sum("credit").alias("credits"))
        .filter(F.col("credits").isNotNull())
        .select("account_id", "month", "credits")
    )


def append_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append closed results to a table, each row once."""
    return _trigger(rows.writeStream.outputMode("append").format("parquet"), available_now).start(
        path, checkpointLocation=checkpoint
    )


def stream_usage(requests: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append finished requests to the month-partitioned log, each once."""
    rows = with_month(usage_records(requests))
    writer = rows.writeStream.outputMode("append").format("parquet").partitionBy("month")
    return _trigger(writer, available_now).start(path, checkpointLocation=checkpoint)


def update_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write each batch's changed rows to its own folder.

    A batch that is repeated after a failure overwrites its folder, so nothing
    is counted twice.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = rows.writeStream.outputMode("update").foreachBatch(write_batch)
    return _trigger(writer, available_now).start(checkpointLocation=checkpoint)


def latest_updates(written: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """The newest values of each key of an update table."""
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("newest"))
    return newest.select(*keys, "newest.*")


def compact_updates(written: DataFrame, keys: list[str], values: list[str], base: str) -> None:
    """Write the newest row of each key, with its batch, to a new table ``base``.

    The folders of the batches in it are not read again (``read_updates``), so a table of
    many batches costs as much as its keys and the batches since.
    """
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*values, "batch_id"), "batch_id").alias("newest"))
    newest.select(*keys, "newest.*").write.parquet(base)


def read_updates(spark: SparkSession, path: str, schema: str, base: str | None = None) -> DataFrame:
    """The rows of an update table; with a ``base``, its rows and those of later batches only."""
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
    if base is None:
        return rows
    compacted = spark.read.schema(f"{schema}, batch_id bigint").parquet(base)
    done = compacted.agg(F.max("batch_id")).first()[0]
    return compacted.unionByName(rows.filter(F.col("batch_id") > (-1 if done is None else done)))


def hourly_usage(log: DataFrame) -> DataFrame:
    """Rows to be summed by hour, endpoint and status: requests and credits."""
    rows = cleaned(log, keep=("created",))
    return rows.select(
        F.date_trunc("hour", "created").alias("hour"), "endpoint", "status",
        F.lit(1).cast("bigint").alias("requests"), F.col("credit").alias("credits"),
    )


def monthly_usage(log: DataFrame) -> DataFrame:
    """Rows with positive credits, to be summed by account and month."""
    month = F.date_format("created", "yyyy-MM").alias("month")
    return log.select("account_id", month, positive_credit(log).alias("credits")).filter("credits IS NOT NULL")


def window_requests(requests: DataFrame, window: str = "15 minutes") -> DataFrame:
    """Rows to be summed by address and window; ``over_limit`` keeps the windows that pass a limit."""
    return requests.filter("ts IS NOT NULL").select(
        "ip_address", F.window("ts", window)["start"].alias("window_start"), F.lit(1).cast("bigint").alias("requests")
    )


def over_limit(windows: DataFrame, limit: int = 100) -> DataFrame:
    return windows.filter(F.col("requests") > limit)


def sum_stream(
    rows: DataFrame, keys: list[str], path: str, checkpoint: str, compact_every: int = 0, available_now: bool = False
) -> StreamingQuery:
    """Sums of all columns but ``keys`` of each micro-batch, one folder per batch (read by ``read_sums``).

    A batch that is repeated after a failure overwrites its folder. Every ``compact_every``
    batches those before the present one are added up to a base table beside them; folders
    that an older base holds already are removed, so someone who listed the table before
    still finds what they read.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        added = _added(batch, keys)
        added.write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch_id}")
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact_sums(batch.sparkSession, path, added.schema, keys, batch_id - 1)

    return _trigger(rows.writeStream.outputMode("append").foreachBatch(write_batch), available_now).start(
        checkpointLocation=checkpoint
    )


def read_sums(spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str]) -> DataFrame:
    """What a sum stream has added up so far: the newest base and the batches after it."""
    return _added(_open_sums(spark, path, schema, _done(spark, path, "bases")), keys)


def compact_sums(spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], through: int) -> None:
    """Add the newest base and the batches up to ``through`` up to a new base, and remove what the base before held."""
    known = _done(spark, path, "bases")
    if known is not None and known >= through:
        return
    rows = _open_sums(spark, path, schema, known, through)
    _added(rows, keys).write.mode("overwrite").parquet(f"{path}/bases/through={through}")
    if known is not None:
        for kind, last in (("batches", known), ("bases", known - 1)):
            for number, folder in _folders(spark, path, kind):
                if number <= last:
                    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])


def _open_sums(spark: SparkSession, path: str, schema, base: int | None, through: int | None = None) -> DataFrame:
    """Rows of a base and of the batches behind it."""
    read = spark.read.schema(schema)
    batches = [n for n, _ in _folders(spark, path, "batches") if n > (-1 if base is None else base) and (through is None or n <= through)]
    folders = [f"{path}/batches/batch_id={n}" for n in sorted(batches)]
    folders += [] if base is None else [f"{path}/bases/through={base}"]
    return read.parquet(*folders) if folders else spark.createDataFrame([], schema)


def _done(spark: SparkSession, path: str, kind: str) -> int | None:
    return max((n for n, _ in _folders(spark, path, kind)), default=None)


def _folders(spark: SparkSession, path: str, kind: str) -> list[tuple[int, JavaObject]]:
    """Numbers and paths of the completely written batches or bases of a table of sums."""
    files = spark._jvm.org.apache.hadoop.fs
    found = files.Path(f"{path}/{kind}/*=*/_SUCCESS")
    marks = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or []
    folders = [mark.getPath().getParent() for mark in marks]
    return [(int(folder.getName().partition("=")[2]), folder) for folder in folders]


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer
