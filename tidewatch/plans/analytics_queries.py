"""Alerts, counters, rankings and dashboard figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import alerts, analytics, lake, scoring
from tidewatch.plans.registry import query, rounded
from tidewatch.plans.views import Domain

_ALERT = ["id", "device_id", "severity", "ts", "acknowledged"]


@query("SELECT device_id, event_count, last_seen FROM (SELECT device_id, count(*) AS event_count, max(epoch_us(ts) // 1000) AS last_seen "
       "FROM redelivered GROUP BY device_id)")
def device_counters(d: Domain) -> DataFrame:
    return analytics.device_stats(d.redelivered)


@query("""SELECT device_id, event_count, round(event_count * 100.0::double / (SELECT sum(event_count) FROM stats), 8) AS share_pct
FROM stats""")
def device_share(d: Domain) -> DataFrame:
    return rounded(analytics.device_share(d.stats))


@query("SELECT severity, count(*) AS alerts FROM alerts GROUP BY severity")
def severity_counts(d: Domain) -> DataFrame:
    return alerts.severity_counts(d.alerts)


@query("""SELECT (SELECT count(*) FROM devices) AS device_count, count(*) AS total_alerts,
  count(CASE WHEN NOT acknowledged THEN 1 END) AS pending_alerts, count(CASE WHEN severity = 'HIGH' THEN 1 END) AS critical_alerts,
  (SELECT count(*) FROM readings) AS total_events FROM alerts""")
def dashboard_kpis(d: Domain) -> DataFrame:
    return alerts.dashboard(d.devices, d.alerts, d.readings)


@query("""SELECT count(*) AS total_events, count(DISTINCT device_id) AS devices, max(epoch_us(ts)) AS latest_micros FROM readings""")
def lake_stats(d: Domain) -> DataFrame:
    return lake.lake_stats(d.lake).select("total_events", "devices",
                        F.unix_micros("latest_timestamp").alias("latest_micros"))


@query("""SELECT count(*) AS total_predictions, count(CASE WHEN is_anomaly THEN 1 END) AS anomaly_count,
  coalesce(round(count(CASE WHEN is_anomaly THEN 1 END) * 100.0::double / count(*), 1), 0.0) AS anomaly_rate FROM predictions""")
def anomaly_stats(d: Domain) -> DataFrame:
    return scoring.anomaly_stats(d.predictions)


@query("""SELECT device_id, count(*) AS anomalies FROM predictions WHERE is_anomaly GROUP BY device_id""")
def anomalies_by_device(d: Domain) -> DataFrame:
    return scoring.anomalies_by_device(d.predictions)


@query("""SELECT count(DISTINCT device_id) AS affected_devices FROM predictions WHERE is_anomaly""")
def affected_devices(d: Domain) -> DataFrame:
    return scoring.affected_devices(d.predictions)


_NOW = "(SELECT max(epoch_us(ts) // 1000) FROM readings)"


@query(f"""SELECT count(CASE WHEN s.last_seen IS NOT NULL AND {_NOW} - s.last_seen < 120000 THEN 1 END) AS online,
  count(*) AS devices FROM devices d LEFT JOIN stats s ON d.device_id = s.device_id""")
def online_count(d: Domain) -> DataFrame:
    now = d.readings.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("now")).scalar()
    return analytics.online_count(analytics.online_devices(d.devices, d.stats, now))


@query("SELECT DISTINCT device_id AS \"deviceId\" FROM readings")
def distinct_devices(d: Domain) -> DataFrame:
    return lake.distinct_devices(d.lake)


@query("SELECT count(*) AS pending FROM alerts WHERE NOT acknowledged")
def pending_badge(d: Domain) -> DataFrame:
    return alerts.pending_count(d.alerts)


@query("""SELECT d.device_id, coalesce(s.event_count, 0) AS event_count, s.last_seen
FROM devices d LEFT JOIN stats s ON d.device_id = s.device_id""")
def device_stats_join(d: Domain) -> DataFrame:
    return analytics.stats_for_all(d.devices, d.stats)


_HISTORY = """SELECT device_id, event_id, ts, coalesce(temperature, 0.0) AS temperature, humidity, vibration,
  CAST(row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, event_id DESC) AS integer) AS position FROM telemetry"""


@query(f"SELECT * FROM ({_HISTORY}) WHERE position <= 50")
def history_ring_50(d: Domain) -> DataFrame:
    return analytics.device_history(d.telemetry)


@query(f"SELECT device_id, event_id, ts, temperature, humidity, vibration FROM ({_HISTORY}) WHERE position = 1")
def latest_snapshot(d: Domain) -> DataFrame:
    return analytics.latest_reading(d.telemetry)


@query(f"""SELECT device_id, event_id, ts, strftime(ts, '%H:%M:%S') AS label, temperature AS value FROM ({_HISTORY})
WHERE position <= 50""")
def history_series(d: Domain) -> DataFrame:
    return analytics.history_series(d.telemetry, "temperature")


@query("SELECT id, device_id, severity, ts, acknowledged FROM alerts ORDER BY ts DESC, id DESC LIMIT 8")
def recent_alerts_8(d: Domain) -> DataFrame:
    return alerts.recent_alerts(d.alerts).select(*_ALERT)


@query("SELECT id, device_id, severity, ts, acknowledged FROM alerts WHERE NOT acknowledged ORDER BY ts DESC, id DESC LIMIT 10")
def recent_pending_10(d: Domain) -> DataFrame:
    return alerts.recent_pending(d.alerts).select(*_ALERT)


@query("SELECT device_id, event_id, anomaly_score, severity FROM recent")
def recent_anomalies_10(d: Domain) -> DataFrame:
    return scoring.recent_anomalies(d.predictions).select("device_id", "event_id", "anomaly_score", "severity")


@query("SELECT id, device_id, severity, ts, acknowledged FROM alerts ORDER BY ts DESC, id DESC")
def alerts_sorted(d: Domain) -> DataFrame:
    return alerts.alerts_sorted(d.alerts).select(*_ALERT)


@query("SELECT event_id, device_id, is_anomaly, anomaly_score, severity, reason FROM predictions ORDER BY seq DESC LIMIT 500")
def prediction_history_500(d: Domain) -> DataFrame:
    return scoring.prediction_history(d.predictions).select(
        "event_id", "device_id", "is_anomaly", "anomaly_score", "severity", "reason")


@query("SELECT device_id FROM devices ORDER BY device_id LIMIT 8")
def first_devices_8(d: Domain) -> DataFrame:
    return analytics.first_devices(d.devices)


@query("""SELECT original_event_id AS event_id, CASE status WHEN 'CRITICAL' THEN 'HIGH' WHEN 'WARNING' THEN 'MEDIUM' END AS severity
FROM processed""")
def alert_severity(d: Domain) -> DataFrame:
    return d.processed.select(F.col("original_event_id").alias("event_id"),
                              alerts.alert_severity(F.col("status")).alias("severity"))


@query("SELECT id, message FROM alerts")
def alert_message(d: Domain) -> DataFrame:
    return d.alerts.select("id", "message")


@query("SELECT id, device_id, severity, message, ts, false AS acknowledged FROM alerts")
def raise_alerts(d: Domain) -> DataFrame:
    return alerts.raise_alerts(d.processed, alert_id=F.col("original_event_id"))


@query("""SELECT id, device_id, acknowledged OR id IN (SELECT event_id FROM readings WHERE event_type = 'view') AS acknowledged
FROM alerts""")
def acknowledge_alerts(d: Domain) -> DataFrame:
    ids = d.readings.where("event_type = 'view'").select(F.col("event_id").alias("id"))
    return alerts.acknowledge(d.alerts, ids).select("id", "device_id", "acknowledged")


@query("SELECT event_id AS id FROM readings WHERE event_type = 'view' AND event_id NOT IN (SELECT id FROM alerts)")
def acknowledge_unknown(d: Domain) -> DataFrame:
    ids = d.readings.where("event_type = 'view'").select(F.col("event_id").alias("id"))
    return alerts.unknown_alert_ids(d.alerts, ids)


@query("SELECT count(*) AS alerts, count(*) AS acknowledged FROM alerts")
def acknowledge_all(d: Domain) -> DataFrame:
    return alerts.acknowledge(d.alerts, None).agg(F.count(F.lit(1)).alias("alerts"),
                                                  F.count_if("acknowledged").alias("acknowledged"))
