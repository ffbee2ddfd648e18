"""Target requests: which URLs a request asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.urls import is_http_url

# Fixed value: the answer to a request without a valid target.
NO_TARGET = "Invalid or missing target URL. Provide 'url' or 'urls' with valid http(s) values."


def valid_targets(urls: Column, url: Column) -> Column:
    """Valid targets of one request: the list first, then the single URL, first one kept."""
    listed = F.coalesce(urls, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(listed, F.array(url)), is_http_url))


def with_targets(requests: DataFrame) -> DataFrame:
    """Add ``target_urls`` and ``target`` (the first of them)."""
    return requests.withColumn("target_urls", valid_targets(F.col("urls"), F.col("url"))).withColumn(
        "target", F.get("target_urls", F.lit(0))
    )


def select_targets(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests into targets, one row per (request, position), and rejects.

    Row-local: neither side shuffles.
    """
    checked = with_targets(requests)
    targets = checked.select("request_id", F.posexplode("target_urls").alias("position", "target_url"))
    rejects = checked.filter(F.size("target_urls") == 0).select(
        "request_id", F.lit(400).alias("status"), F.lit(NO_TARGET).alias("error")
    )
    return targets, rejects
