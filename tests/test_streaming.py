from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pagelens.operators import audit, usage
from pagelens.plans import derived as D
from pagelens.streaming import usage as S

SF = "/root/testdata/sf0.001"
START = datetime(2026, 4, 30, 23, 0, tzinfo=timezone.utc)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def event_files(spark, folder):
    """The events in four files that arrive in time order."""
    events = D.table(spark, SF, "events")
    for part in range(4):
        events.filter(F.floor(F.col("event_id") / 250) == part).coalesce(1).write.mode("append").parquet(folder)
    return events.schema


def hourly(spark, out, base=None):
    schema = "hour timestamp, endpoint string, status string, requests bigint, credits double"
    return S.latest_updates(S.read_updates(spark, out, schema, base), ["hour", "endpoint", "status"], "requests", "credits")


def test_rollup_stream_equals_the_batch_rollup(spark, tmp_path):
    folder, out, base = (str(tmp_path / n) for n in ("in", "out", "base"))
    schema = event_files(spark, folder)
    rows = S.usage_rollup_stream(D.usage_columns(stream_of(spark, folder, schema)))
    S.update_stream(rows, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    hours = usage.cleaned(D.usage_log(spark, SF), keep=("created",)).groupBy(F.date_trunc("hour", "created").alias("hour"), "endpoint", "status").agg(
        F.count("*").alias("requests"), F.sum("credit").alias("credits")
    )
    key = lambda df: sorted(tuple(r) for r in df.select("hour", "endpoint", "status", "requests", "credits").collect())
    assert key(hourly(spark, out)) == key(hours) != []
    # Compaction keeps the result, and only later batches are read beside it.
    written = spark.read.parquet(out)
    S.compact_updates(written.filter("batch_id < 2"), ["hour", "endpoint", "status"], ["requests", "credits"], base)
    assert key(hourly(spark, out, base)) == key(hours)


def test_closed_hours_are_appended_once(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = event_files(spark, folder)
    rows = S.usage_rollup_stream(D.usage_columns(stream_of(spark, folder, schema)))
    S.append_stream(rows, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    log = D.usage_log(spark, SF)
    hours = usage.cleaned(log, keep=("created",)).groupBy(F.date_trunc("hour", "created").alias("hour"), "endpoint", "status").agg(F.count("*").alias("requests"))
    closed = hours.filter(F.col("hour") + F.expr("INTERVAL 2 HOURS") <= F.lit(log.agg(F.max("created")).first()[0]))
    key = lambda df: sorted(tuple(r) for r in df.select("hour", "endpoint", "status", "requests").collect())
    assert key(spark.read.parquet(out)) == key(closed) != []


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = event_files(spark, folder)
    rows = S.rate_limit_stream(D.burst_columns(stream_of(spark, folder, schema)), limit=5)
    S.update_stream(rows, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    batch = audit.rate_limit_windows(D.burst_requests(spark, SF), limit=5)
    key = lambda df: sorted(tuple(r) for r in df.select("ip_address", "window_start", "requests").collect())
    assert key(S.latest_updates(spark.read.parquet(out), ["ip_address", "window_start"], "requests")) == key(batch) != []


def test_monthly_credits_over_a_month_end_and_a_restart(spark, tmp_path):
    schema = "account_id string, credit_used long, created timestamp"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        S.update_stream(S.monthly_credits_stream(stream), out, checkpoint, available_now=True).awaitTermination()

    minute = timedelta(minutes=1)
    arrive(("a", 2, START), ("b", -1, START))
    arrive(("a", 3, START + 90 * minute))
    arrive(("a", 4, START + minute), ("b", 1, START))
    written = spark.read.parquet(out)
    latest = {(r.account_id, r.month): r.credits for r in S.latest_updates(written, ["account_id", "month"], "credits").collect()}
    assert latest == {("a", "2026-04"): 6.0, ("a", "2026-05"): 3.0, ("b", "2026-04"): 1.0}


def test_usage_append_stream_writes_each_request_once(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = event_files(spark, folder)
    for _ in range(2):
        requests = D.finished_columns(stream_of(spark, folder, schema))
        S.stream_usage(requests, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == D.table(spark, SF, "events").count()


def test_sums_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    """Months that arrive mixed and long after each other, with a compaction every second batch."""
    schema = "account_id string, credit_used long, created timestamp"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    day = timedelta(days=1)
    rows = [(f"a{i % 3}", i % 4 - 1, START + (i * 37 % 200) * day) for i in range(70)] + [(None, 2, START), ("a1", 5, None), ("a1", None, START)] * 2
    keys = ["account_id", "month"]

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        sums = S.monthly_usage(stream)
        S.sum_stream(sums, keys, out, checkpoint, compact_every=2, available_now=True).awaitTermination()
        return S.read_sums(spark, out, sums.schema, keys)

    for part in range(6):
        spark.createDataFrame(rows[part::6], schema).coalesce(1).write.mode("append").parquet(folder)
        if part in (2, 4):
            run()
    key = lambda df: sorted((tuple(r) for r in df.select("account_id", "month", "credits").collect()), key=str)
    got = key(run())
    assert got == key(usage.monthly_credits(spark.createDataFrame(rows, schema))) != []
    # Batches 0 and 1 are in a base and gone, the last ones are still there.
    assert [n for n, _ in sorted(S._folders(spark, out, "batches"), key=lambda f: f[0])] == [2, 3, 4, 5]
    assert sorted(n for n, _ in S._folders(spark, out, "bases")) == [1, 3]
    # A compaction that runs again changes nothing.
    sums = S.monthly_usage(spark.createDataFrame(rows, schema)).schema
    S.compact_sums(spark, out, sums, keys, 3)
    assert key(S.read_sums(spark, out, sums, keys)) == got


def test_a_repeated_batch_is_counted_once(spark, tmp_path, monkeypatch):
    """The job fails after a batch is written and compacted, and runs that batch again."""
    schema = "account_id string, credit_used long, created timestamp"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for n in range(3):
        spark.createDataFrame([("a", n + 1, START)], schema).coalesce(1).write.mode("append").parquet(folder)
    compact = S.compact_sums

    def run():
        sums = S.monthly_usage(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
        S.sum_stream(sums, ["account_id", "month"], out, checkpoint, compact_every=2, available_now=True).awaitTermination()
        return S.read_sums(spark, out, sums.schema, ["account_id", "month"]).collect()

    def failing(*args):
        compact(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(S, "compact_sums", failing)
    with pytest.raises(StreamingQueryException):
        run()
    monkeypatch.setattr(S, "compact_sums", compact)
    assert [tuple(r) for r in run()] == [("a", "2026-04", 6.0)]


def test_sums_of_an_empty_stream(spark, tmp_path):
    schema = "ip_address string, ts timestamp"
    rows = S.window_requests(spark.createDataFrame([], schema))
    assert S.over_limit(S.read_sums(spark, str(tmp_path), rows.schema, ["ip_address", "window_start"])).count() == 0
