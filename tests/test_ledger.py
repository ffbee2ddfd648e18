import random
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import functions as F

from pagelens.operators import audit, ledger
from pagelens.plans import derived as D
from pagelens.sources import usage_log as L

SF = "/root/testdata/sf0.001"
FIRST = datetime(2026, 4, 28, 22, 0, tzinfo=UTC)
LOG = "account_id string, credit_used string, created timestamp"
REQUESTS = "request_id int, account_id string, ts timestamp"


def made():
    """Five days around a month's end; many requests of one account, and instants at midnight."""
    random.seed(3)
    rows, asked = [], []
    for i in range(900):
        account = "hot" if i % 3 == 0 else f"a{i % 5}"
        at = FIRST + timedelta(hours=random.randint(0, 100), microseconds=random.choice([0, 0, 1]))
        rows.append((random.choice([account, None]) if i % 50 == 0 else account, random.choice(["1", "2.5", "-1", "x", None]), None if i % 70 == 0 else at))
        asked.append((i, random.choice([account, account, "unseen", None]), at + timedelta(microseconds=random.choice([0, 1]))))
    # Seen once, on the first day.
    return [*rows, ("early", "4", FIRST)], [*asked, (1000, "early", FIRST + timedelta(days=2)), (1001, "early", FIRST + timedelta(days=4)), (1002, "hot", None)]


def key(df):
    return sorted((tuple(r) for r in df.select("request_id", "account_id", "ts", "used_credits").collect()), key=str)


def test_days_added_one_by_one_equal_the_whole_log(spark, tmp_path):
    rows, asked = made()
    log, requests = spark.createDataFrame(rows, LOG), spark.createDataFrame(asked, REQUESTS)
    path, days = str(tmp_path / "ledger"), [date(2026, 4, 28) + timedelta(days=n) for n in range(6)]
    ledger.write_ledger(ledger.credit_ledger(log, days[1]), path)
    for day in (*days[2:], days[4], days[5]):
        ledger.extend_ledger(log, path, day)
    table = ledger.read_ledger(spark, path)
    whole = ledger.credit_ledger(log, days[-1])
    columns = ["account_id", "day", "carried", "credits"]
    assert sorted(map(tuple, table.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    got = key(ledger.credits_from_ledger(requests, log, table))
    assert got == key(audit.credits_before(requests, log)) and len(got) == len(asked)
    # One day alone.
    for day in days:
        own = ledger.on_days(requests, "ts", day, day)
        alone = ledger.credits_from_ledger(own, ledger.on_days(log, "created", day, day), table)
        assert key(alone) == key(audit.credits_before(own, log))


def folders_read(df):
    """Folders of the table that the scan itself reads, after the filters on folders."""
    done = df.groupBy().count()._jdf.queryExecution()
    done.toRdd().count()
    return partitions_of(done.executedPlan())


def partitions_of(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return partitions_of(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return partitions_of(plan.plan())
    if name == "FileSourceScanExec":
        return plan.metrics().apply("numPartitions").value()
    return sum(partitions_of(plan.children().apply(i)) for i in range(plan.children().size()))


def test_one_day_reads_its_own_files(spark, tmp_path):
    path, day = str(tmp_path / "log"), date(2024, 1, 20)
    L.append_usage(D.finished_requests(spark, SF), path, daily=True)
    log = spark.read.parquet(path)
    assert log.count() == D.finished_requests(spark, SF).count()
    assert folders_read(ledger.on_days(log, "created", day, day)) == 1 < folders_read(log)
    table = str(tmp_path / "ledger")
    ledger.write_ledger(ledger.credit_ledger(log, date(2024, 1, 31)), table)
    opening = ledger.read_ledger(spark, table).filter(F.col("day") == F.lit(day))
    assert folders_read(opening) == 1
    assert opening.count() == opening.select("account_id").distinct().count() > 0


def test_empty_log(spark, tmp_path):
    log, requests = spark.createDataFrame([], LOG), spark.createDataFrame([(1, "a", FIRST), (2, None, None)], REQUESTS)
    path = str(tmp_path / "ledger")
    ledger.extend_ledger(log, path, date(2026, 5, 1))
    ledger.extend_ledger(log, path, date(2026, 5, 2))
    used = ledger.credits_from_ledger(requests, log, ledger.read_ledger(spark, path))
    assert {r.request_id: r.used_credits for r in used.collect()} == {1: 0.0, 2: 0.0}
