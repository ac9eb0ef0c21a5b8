"""Where results go: printed, drained, stored."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame

from lakeloom.sources.text import render_line


def print_rows(df: DataFrame, out: TextIO | None = None) -> int:
    """Print rows as pipe-joined text without a header, a partition at a time; the number of rows."""
    out, n = out or sys.stdout, 0
    for row in df.select(render_line(df).alias("line")).toLocalIterator(prefetchPartitions=True):
        print(row["line"], file=out)
        n += 1
    return n


def drain(df: DataFrame) -> None:
    """Run a plan to its end and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def append_temp(df: DataFrame, path: str) -> None:
    """Add rows to a temporary table in a folder that all executors share."""
    df.write.mode("append").parquet(path)
