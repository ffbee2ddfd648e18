"""The physical plans keep the promises the operators make."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagelens.operators import audit
from pagelens.plans import derived as D
from pagelens.sources import usage_log as L

SF = "/root/testdata/sf0.001"
WRITES = {n for n in entry.queries() if n.endswith(("_stream", "_any_order")) or n in ("usage_append", "view_sink")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - WRITES))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node


@pytest.mark.parametrize("name", ["metadata_view", "html_view", "markdown_view", "text_view_pages", "seo_view", "screenshot_view", "page_links", "target_list", "bulk_items"])
def test_views_do_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["link_map", "email_index", "request_quality", "bulk_summary"])
def test_page_text_stays_in_the_scan_stage(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    for shuffle in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        assert "html" not in shuffle
    below = [line for line in plan.splitlines() if "Exchange" in line or "HashAggregate" in line]
    assert below and not any(re.search(r"\b(html|text|raw|payload)#", line) for line in below)


def test_usage_scan_is_pushed_down_and_prunes_months(spark, tmp_path):
    path = str(tmp_path / "log")
    L.append_usage(D.finished_requests(spark, SF), path)
    plan = plan_of(L.usage_scan(spark.read.parquet(path), "2024-01", "key", "k8").select("endpoint"))
    assert "EqualTo(api_key,k8)" in plan and "GreaterThanOrEqual(created" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*month", plan)
    assert "user_agent" not in plan


def test_views_read_only_their_columns(spark):
    plan = plan_of(entry.queries()["record_headers"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan
    assert "ReadSchema: struct<user_id:bigint" in plan_of(D.registry(spark, SF)["users"])


def test_rate_limit_plan_is_the_same_for_every_limit(spark):
    """Only the requests of a deciding second are ranked, whatever the limit."""
    requests = D.burst_requests(spark, SF)
    shapes = [re.findall(r"\b(\w+Join|Window\w*|Exchange|\w*Aggregate)\b", plan_of(audit.rate_limit_audit(requests, n))) for n in (100, 5000)]
    assert shapes[0] == shapes[1] and "WindowGroupLimit" not in shapes[0]


def test_running_credits_read_the_instants_once(spark):
    df = audit.credits_before(D.access_requests(spark, SF), D.usage_log(spark, SF))
    df.collect()
    assert "ReusedExchange" in plan_of(df)


def test_a_hot_key_is_split_over_tasks(spark):
    """With both join sides too large to broadcast, a key with a third of the requests is split."""
    tight = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "5k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5k",
    }
    for key, value in tight.items():
        spark.conf.set(key, value)
    try:
        folder = "/root/testdata/sf0.01"
        known = D.registry(spark, folder)
        hot = F.when(F.col("request_id") % 3 == 0, "k8").otherwise(F.col("api_key"))
        requests = D.access_requests(spark, folder).repartition(8).withColumn("api_key", hot)
        audited = audit.access_audit(
            requests, known["keys"], known["accounts"], known["plans"], known["users"], D.usage_log(spark, folder)
        )
        rows = audited.collect()
        assert re.search(r"SortMergeJoin\(skew=true\) \[key#", plan_of(audited))
        assert len(rows) == len({r.request_id for r in rows}) == requests.count()
    finally:
        for key in tight:
            spark.conf.unset(key)


@pytest.mark.parametrize("name", ["media_inventory", "media_counts", "media_all", "page_media"])
def test_sources_are_resolved_once_behind_the_deal(spark, name):
    """One file holds all records: its task must not resolve their sources too, and copies must have collapsed before."""
    plan = plan_of(entry.queries()[name](spark, SF))
    *above, scan = plan.split("Exchange ")
    entries = above[-1]
    assert "explode" in entries and "Aggregate" in entries
    address = "[hH][tT][tT][pP]([sS]?):[/\\\\]*"
    assert address not in entries and any(address in part for part in above[:-1])
    assert name == "page_media" or address not in scan


@pytest.mark.parametrize("name", ["link_counts", "overlap_free_external"])
def test_pages_are_read_once_and_links_written_alike_normalised_once(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert plan.count("FileScan") == 1
    assert re.search(r"HashAggregate\(keys=\[request_id#\d+, target#\d+, href#\d+\]", plan)
