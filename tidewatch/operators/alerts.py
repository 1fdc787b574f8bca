"""Raising, filtering, acknowledging and summarising alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.readings import SEVERITY_HIGH, alert_message, alert_severity, map_text
from tidewatch.operators.lookup import lookup_join
from tidewatch.operators.processing import derived_id


def raise_alerts(processed: DataFrame, alert_id: Column | None = None) -> DataFrame:
    """One pending alert per CRITICAL or WARNING event; the id follows from the source event."""
    data = processed.schema["enriched_data"].dataType
    text = map_text({f: F.col(f"enriched_data.{f}") for f in data.fieldNames()})
    source = F.col("original_event_id")
    return (processed.withColumn("severity", alert_severity(F.col("status")))
            .where(F.col("severity").isNotNull())
            .select((derived_id(source, "alert") if alert_id is None else alert_id).alias("id"),
                    "device_id", "severity",
                    alert_message(F.col("status"), F.col("device_id"), text).alias("message"),
                    F.col("ts"), F.lit(False).alias("acknowledged")))


def to_alert_events(alerts: DataFrame) -> DataFrame:
    """The event published for each raised alert."""
    return alerts.select(
        derived_id(F.col("id"), "alert-event").alias("event_id"), F.col("id").alias("alert_id"),
        F.lit("AlertCreatedEvent").alias("event_type"), F.lit("alert-service").alias("source_service"),
        "device_id", "severity", "message", "ts")


def filter_alerts(alerts: DataFrame, severity: str | None = None, status: str | None = None) -> DataFrame:
    """``status`` is ``pending`` or ``acknowledged``; an empty filter keeps all."""
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    if status:
        alerts = alerts.where(F.col("acknowledged") == (status == "acknowledged"))
    return alerts


def alerts_sorted(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.col("ts").desc(), F.col("id").desc())


def recent_alerts(alerts: DataFrame, n: int = 8) -> DataFrame:
    return alerts_sorted(alerts).limit(n)


def recent_pending(alerts: DataFrame, n: int = 10) -> DataFrame:
    return recent_alerts(filter_alerts(alerts, status="pending"), n)


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))


def pending_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(~F.col("acknowledged")).alias("pending"))


def dashboard(devices: DataFrame, alerts: DataFrame, events: DataFrame) -> DataFrame:
    """One row of headline numbers; the device and event totals are scalar subqueries."""
    total_devices = devices.agg(F.count(F.lit(1)).alias("n")).scalar()
    total_events = events.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (alerts.agg(F.count(F.lit(1)).alias("total_alerts"),
                       F.count_if(~F.col("acknowledged")).alias("pending_alerts"),
                       F.count_if(F.col("severity") == SEVERITY_HIGH).alias("critical_alerts"))
            .select(total_devices.alias("device_count"), "total_alerts", "pending_alerts",
                    "critical_alerts", total_events.alias("total_events")))


def acknowledge(alerts: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Mark the alerts in ``ids`` acknowledged; without ``ids`` every pending one."""
    if ids is None:
        return alerts.withColumn("acknowledged", F.lit(True))
    named = ids.select("id").distinct().withColumn("_named", F.lit(True))
    return (lookup_join(alerts, named, "id", "left")
            .withColumn("acknowledged", F.col("acknowledged") | F.coalesce("_named", F.lit(False)))
            .select(*alerts.columns))


def unknown_alert_ids(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(alerts.select("id"), "id", "left_anti")


def csv_rows(alerts: DataFrame) -> DataFrame:
    """The export's columns, all text: ISO timestamp in milliseconds, ACK or Pending."""
    return alerts.select(
        F.col("id").cast("string").alias("ID"), F.col("device_id").alias("Device"),
        F.col("severity").alias("Severity"), F.coalesce("message", F.lit("")).alias("Message"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("Timestamp"),
        F.when(F.col("acknowledged"), "ACK").otherwise("Pending").alias("Status"))
