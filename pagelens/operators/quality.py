"""Which requests gave usable records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def empty_requests(targets: DataFrame, records: DataFrame) -> DataFrame:
    """Requests with valid targets but no usable record (the 502 answer)."""
    asked = targets.select("request_id").distinct()
    return asked.join(records.select("request_id"), "request_id", "left_anti").withColumn("status", F.lit(502))


def request_quality(targets: DataFrame, records: DataFrame) -> DataFrame:
    """Per request: number of targets and of usable records, and the answer's status."""
    asked = targets.groupBy("request_id").agg(F.count("*").alias("targets"))
    usable = records.groupBy("request_id").agg(F.count("*").alias("records"))
    joined = asked.join(usable, "request_id", "left").na.fill(0, ["records"])
    return joined.withColumn("status", F.when(F.col("records") > 0, 200).otherwise(502))
