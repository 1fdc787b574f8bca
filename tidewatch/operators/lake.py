"""Operators over the event lake."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.timestamps import normalize_ts
from tidewatch.operators.ordered import newest_per_key

CONTEXT_ROWS = 5


def latest(df: DataFrame, limit: int = 1000, order: tuple[str, ...] = ("arrival_timestamp", "eventId"),
           since_day: str | None = None) -> DataFrame:
    """The newest records. ``since_day`` bounds the scan to the partitions from that day on, for a
    caller who knows that they hold enough."""
    if since_day is not None:
        df = df.where(F.col("day") >= F.lit(since_day).cast(df.schema["day"].dataType))
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(limit)


def recent_per_device(df: DataFrame, k: int = CONTEXT_ROWS, key: str = "deviceId",
                      order: tuple[str, ...] = ("arrival_timestamp", "eventId")) -> DataFrame:
    """The last ``k`` events of every device; ``position`` 1 is the oldest of them.

    The position is counted within the at most ``k`` rows kept per device, on the same shuffle.
    """
    kept = newest_per_key(df, key, list(order), k, rank="_back")
    return (kept.withColumn("position", F.max("_back").over(W.partitionBy(key)) - F.col("_back") + 1)
            .drop("_back"))


def union_evolving(*frames: DataFrame) -> DataFrame:
    """Rows of frames with different columns; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def lake_stats(df: DataFrame) -> DataFrame:
    """Number of records and of devices, and the latest event time; ``distinct_devices`` lists the devices."""
    per_device = df.groupBy("deviceId").agg(F.count(F.lit(1)).alias("events"),
                                            F.max(normalize_ts(F.col("timestamp"))).alias("latest"))
    return per_device.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
                          F.count("deviceId").alias("devices"), F.max("latest").alias("latest_timestamp"))


def distinct_devices(df: DataFrame) -> DataFrame:
    return df.select("deviceId").where(F.col("deviceId").isNotNull()).distinct()


def day_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
