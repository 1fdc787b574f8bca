"""Size checks that decide between a broadcast, a plain shuffle and a skew-split plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A build side up to this size is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
# A group up to this many rows is left to one task.
GROUP_ROWS = 1_000_000
# Inputs below this come in few splits; one task per so many bytes is worth its start.
SPREAD_BELOW_BYTES = 64 * 1024 * 1024
SPREAD_TASK_BYTES = 32 * 1024
# Upper bound on the number of hot keys, and so on every table keyed by them.
MAX_HOT_KEYS = 65_536


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: file sizes scaled by the columns read; never shrunk by filters."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def group_limit(df: DataFrame, group_rows: int | None = None) -> int | None:
    """Rows above which a key group must be split, or None when the whole input has no more rows than that.

    Rows decide, as bytes on disk say little about them. The limit grows with the input so that at most MAX_HOT_KEYS groups
    can exceed it.
    """
    if group_rows is not None:
        return group_rows
    rows = df.count()
    return None if rows <= GROUP_ROWS else max(GROUP_ROWS, rows // MAX_HOT_KEYS)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give expensive work per row all cores when the input is so small that it is one split."""
    size = estimated_bytes(df)
    if size > SPREAD_BELOW_BYTES:
        return df
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, 1 + size // SPREAD_TASK_BYTES)
    return df.repartition(tasks, key)


def hot_keys(df: DataFrame, key: list[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows; counted with map-side combine."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
