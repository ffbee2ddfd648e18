"""Embeddings on an integer grid, and tables that replace one another."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.words import narrow_batches
from pagelens.session import scratch_dir

SCALE = 256


def grid_limit(dims: int) -> int:
    """The largest component whose squared distances over ``dims`` components fit a long."""
    return min(math.isqrt((2**63 - 1) // max(1, dims)) // 2, 2**31 - 1)


def on_grid(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and floor(SCALE * x) of those as rows of int32.

    Kept are vectors of ``dims`` components, none null, not finite or beyond ``grid_limit``.
    """
    kept = np.asarray(vectors.is_valid()) & (np.asarray(vectors.value_lengths().fill_null(-1)) == dims)
    flat = vectors.filter(pa.array(kept)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), dtype=np.float64).reshape(-1, dims)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(x * SCALE)
        fits = (np.abs(x) <= grid_limit(dims)).all(axis=1)
    kept[np.flatnonzero(kept)[~fits]] = False
    return kept, x[fits].astype(np.int32)


def as_lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    n, dims = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dims, dims, dtype=np.int32)), pa.array(rows.reshape(-1)))


def as_matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=np.int64).reshape(-1, dims)


def grid_vectors(rows: DataFrame, dims: int, *extra: str) -> DataFrame:
    """vec_id, the extra columns and v (array<int>) of the kept rows."""
    chosen = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), *(F.col(c).alias(c) for c in extra), F.col("embedding").alias("embedding"))
    fields = ["vec_id bigint", *(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in extra), "v array<int>"]
    names = ["vec_id", *extra]

    def convert(batches):
        for batch in batches:
            kept, v = on_grid(batch.column("embedding"), dims)
            mask = pa.array(kept)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(mask) for c in names), as_lists(v)], names=[*names, "v"])

    return narrow_batches(chosen).mapInArrow(convert, ", ".join(fields))


def totals(rows: DataFrame) -> Iterable[tuple[int, int, int]]:
    """Sums of rows (place, slot, total); callers bound the places and slots."""
    summed = rows.groupBy("place", "slot").agg(F.sum("total").alias("total")).toArrow()
    return zip(*(summed.column(c).to_pylist() for c in ("place", "slot", "total")), strict=True)


def digest(numbers: Iterable[int]) -> str:
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


class Replaced:
    """A table in the shared scratch folder whose next version replaces it.

    The version before is removed once the next one is written whole: nothing reads it again.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.purpose, self.path = spark, purpose, None

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch_dir(self.spark, self.purpose)
        df.write.parquet(path)
        self.remove()
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        if self.path:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
            self.path = None
