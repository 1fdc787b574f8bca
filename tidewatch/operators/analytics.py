"""Per-device counters, histories and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import newest_per_key
from tidewatch.schemas import SENSORS

HISTORY_LENGTH = 50
ONLINE_MS = 120_000


def device_stats(events: DataFrame) -> DataFrame:
    """Events and last event time (epoch ms) per device; redelivered events count again."""
    return events.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_seen"))


def stats_for_all(devices: DataFrame, stats: DataFrame) -> DataFrame:
    """Every registered device with its counters, 0 and null if it never reported."""
    return (devices.select("device_id").join(stats, "device_id", "left")
            .select("device_id", F.coalesce("event_count", F.lit(0)).alias("event_count"), "last_seen"))


def device_share(stats: DataFrame) -> DataFrame:
    """Devices by count with their share in percent. The total is a scalar subquery: a window
    without partition would move every device to one task."""
    total = stats.agg(F.sum("event_count").alias("n")).scalar()
    share = F.coalesce(F.try_divide(F.col("event_count") * F.lit(100.0), total), F.lit(0.0))
    return (stats.select("device_id", "event_count", share.alias("share_pct"))
            .orderBy(F.col("event_count").desc(), "device_id"))


def online_devices(devices: DataFrame, stats: DataFrame, now_ms: Column) -> DataFrame:
    """Devices with a flag: seen less than two minutes before ``now_ms``."""
    flagged = stats_for_all(devices, stats)
    online = F.col("last_seen").isNotNull() & ((now_ms - F.col("last_seen")) < ONLINE_MS)
    return flagged.select("device_id", "last_seen", online.alias("is_online"))


def online_count(online: DataFrame) -> DataFrame:
    return online.agg(F.count_if("is_online").alias("online"), F.count(F.lit(1)).alias("devices"))


def device_history(events: DataFrame, n: int = HISTORY_LENGTH) -> DataFrame:
    """The last ``n`` snapshots per device, position 1 newest; a missing reading is 0."""
    snapshots = events.select("device_id", "event_id", "ts",
                              *[F.coalesce(s, F.lit(0.0)).alias(s) for s in SENSORS])
    return newest_per_key(snapshots, "device_id", ["ts", "event_id"], n, rank="position")


def latest_reading(events: DataFrame) -> DataFrame:
    """The newest history entry per device."""
    entry = F.struct("ts", "event_id", *[F.coalesce(s, F.lit(0.0)).alias(s) for s in SENSORS])
    return (events.groupBy("device_id").agg(F.max_by(entry, F.struct("ts", "event_id")).alias("e"))
            .select("device_id", "e.*"))


def history_series(events: DataFrame, sensor: str, n: int = HISTORY_LENGTH) -> DataFrame:
    """One sensor's history in time order with a clock label."""
    return (device_history(events, n)
            .select("device_id", "event_id", "ts", F.date_format("ts", "HH:mm:ss").alias("label"),
                    F.col(sensor).alias("value"))
            .orderBy("device_id", "ts", "event_id"))


def first_devices(devices: DataFrame, n: int = 8) -> DataFrame:
    return devices.select("device_id").orderBy("device_id").limit(n)


def get_device(devices: DataFrame, device_id: str) -> DataFrame:
    return devices.where(F.col("device_id") == device_id)


def search_devices(devices: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring over id, type and status; an empty query keeps all."""
    if not query:
        return devices
    q = query.lower()
    hit = F.lit(False)
    for c in ("device_id", "type", "status"):
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q)), F.lit(False))
    return devices.where(hit)


def simulated(devices: DataFrame) -> DataFrame:
    return devices.where("simulated")
