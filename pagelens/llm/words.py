"""Words, batches and tables shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.session import scratch_dir

# Rows of an Arrow batch handed to Python: with texts of a megabyte a batch stays under 300 MB.
BATCH_ROWS = 256

_SEPARATORS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A))
_LETTERS = bytes.maketrans(
    bytes(range(0x41, 0x5B)) + _SEPARATORS,
    bytes(range(0x61, 0x7B)) + b" " * len(_SEPARATORS),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows, with batches of at most BATCH_ROWS rows in later Arrow stages of the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def narrow_batches(df: DataFrame) -> DataFrame:
    """The same rows, which hold numbers only, in large batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return df


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared scratch folder: later steps read it and don't go further back."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place_of(df: DataFrame, column: str) -> int:
    """Place of a column, found as Spark finds it: whatever the case of its name, but an equal name first."""
    names = df.columns
    return names.index(column) if column in names else [n.lower() for n in names].index(column.lower())


def as_bytes(column: str, alias: str | None = None):
    """A text column as UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary").alias(alias or column)


def plain_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def blank_words(text: bytes) -> list[bytes]:
    """Runs of anything but the blank and the characters U+0009 to U+000D."""
    return text.split()


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Plain Python rows of the named columns."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)
