"""View output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("parquet", "json", "orc")


def write_view(view: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write one view as one table. Each task writes its own file."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    view.write.mode(mode).format(fmt).save(path)
