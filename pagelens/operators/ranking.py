"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.session import scratch_dir


def spread_rank(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with the place of each in its group, from 1.

    Rows are dealt out by range of (group, order), so a large group lies on many
    partitions; a place is the place on the row's partition plus the group's rows on the
    partitions before. No task holds more of a group than one partition, and the second
    step sees one row for each partition of a group. The dealt rows are written once, as
    both steps must see the same partitions.
    """
    spark = rows.sparkSession
    path = scratch_dir(spark, "ranked")
    dealt = rows.repartitionByRange(F.col(group), *order).withColumn("part", F.spark_partition_id())
    dealt.write.parquet(path)
    placed = spark.read.schema(dealt.schema).parquet(path)
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy(group, "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
    )
    own = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))
    ranked = placed.withColumn("own", own).join(before, [group, "part"])
    return ranked.withColumn(name, (F.col("own") + F.col("before")).cast("int")).drop("own", "before", "part")
