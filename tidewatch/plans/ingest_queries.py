"""Parsing, validation, filters and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.geometry import format_polygon
from tidewatch.functions.readings import json_number
from tidewatch.functions.timestamps import normalize_ts
from tidewatch.operators import features, ingest, lake, processing
from tidewatch.operators.alerts import csv_rows, filter_alerts, to_alert_events
from tidewatch.operators.analytics import get_device, search_devices, simulated
from tidewatch.operators.geo import filter_map, with_polygon
from tidewatch.plans.registry import plain_names, query, rounded
from tidewatch.plans.views import Domain
from tidewatch.schemas import SENSORS, TOPIC_RECEIVED
from tidewatch.session import scratch_dir
from tidewatch.sources import lake as lake_store
from tidewatch.sources.records import enriched_records, export_csv, read_csv, to_anomalies, to_notifications, to_predictions
from tidewatch.sources.tables import TableConfig, read_table


@query("""SELECT value->>'$.deviceId' AS device_id, value->>'$.eventId' AS event_id, value->>'$.status' AS status,
  CAST(value->>'$.enrichedData.temperature' AS double) AS temperature, value->>'$.enrichedData.deviceType' AS device_type
FROM (SELECT CAST(value AS JSON) AS value FROM raw_records WHERE value <> 'NOT_JSON') WHERE value->>'$.deviceId' IS NOT NULL""")
def parse_events(d: Domain) -> DataFrame:
    parsed = ingest.parse_events(d.raw_records)
    return parsed.select(F.col("deviceId").alias("device_id"), F.col("eventId").alias("event_id"), "status",
                         "enrichedData.temperature", F.col("enrichedData.deviceType").alias("device_type"))


@query("""SELECT event_id, device_id, payload, length(trim(device_id)) > 0 AND payload <> '{}' AS accepted FROM requests""")
def ingest_validate(d: Domain) -> DataFrame:
    return ingest.with_accepted(d.requests).select("event_id", "device_id", "payload", "accepted")


@query("""SELECT device_id, payload, coalesce(event_type, 'DeviceTelemetryEvent') AS event_type, '1.0' AS version,
  coalesce(ts, (SELECT max(ts) FROM readings)) AS ts, 'ingestion-service' AS source_service FROM requests""")
def ingest_envelope(d: Domain) -> DataFrame:
    now = d.readings.agg(F.max("ts").alias("now")).scalar()
    stamped = ingest.to_envelope(d.requests, now, event_id=F.sha2(F.col("event_id").cast("string"), 256))
    return stamped.select("device_id", "payload", "event_type", "version", "ts", "source_service")


def _with_millis(df: DataFrame) -> DataFrame:
    """JSON carries milliseconds."""
    return df.withColumn("millis", F.unix_millis(F.col("timestamp").cast("timestamp"))).drop("timestamp")


_ENRICHED_SQL = """SELECT device_id AS "deviceId", CAST(event_id AS varchar) AS "eventId",
  temperature AS "enrichedData_temperature", humidity AS "enrichedData_humidity",
  round(temp_mean, 8) AS "sparkFeatures_temp_mean", round(vib_std, 8) AS "sparkFeatures_vib_std",
  event_count AS "sparkFeatures_event_count", trend AS "sparkFeatures_trend" FROM featured"""


@query(_ENRICHED_SQL)
def flatten_event(d: Domain) -> DataFrame:
    flat = ingest.flatten(enriched_records(d.featured), sep="_")
    return rounded(flat.select("deviceId", "eventId", "enrichedData_temperature", "enrichedData_humidity",
                               "sparkFeatures_temp_mean", "sparkFeatures_vib_std",
                               "sparkFeatures_event_count", "sparkFeatures_trend"),
                   "sparkFeatures_temp_mean", "sparkFeatures_vib_std")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT device_id) AS devices,
  round(sum(temperature), 3) AS temperature FROM readings GROUP BY 1""")
def lake_append(d: Domain) -> DataFrame:
    path = scratch_dir(d.spark, "lake")
    lake_store.append_lake(d.lake, path)
    return (d.spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"))
            .agg(F.count(F.lit(1)).alias("events"), F.countDistinct("deviceId").alias("devices"),
                 F.round(F.sum("`enrichedData.temperature`"), 3).alias("temperature")))


@query("""SELECT event_id, CAST(round(CASE WHEN try_cast(raw AS double) > 100000000000 THEN try_cast(raw AS double) * 1000
    WHEN try_cast(raw AS double) IS NOT NULL THEN try_cast(raw AS double) * 1000000
    ELSE epoch_us(try_cast(replace(raw, 'Z', '') AS timestamp)) END) AS bigint) AS micros FROM timestamps""")
def normalize_timestamps(d: Domain) -> DataFrame:
    return d.timestamps.select("event_id", F.unix_micros(normalize_ts(F.col("raw"))).alias("micros"))


@query("SELECT event_id, device_id, temperature FROM readings ORDER BY ts DESC, event_id DESC LIMIT 1000")
def lake_latest(d: Domain) -> DataFrame:
    """From a lake by days, of which only the last ones are read."""
    path = scratch_dir(d.spark, "newest-lake")
    lake_store.append_lake(d.lake, path)
    newest = lake_store.read_newest(d.spark, path, 1000)
    return newest.select(F.col("eventId").alias("event_id"), F.col("deviceId").alias("device_id"),
                         F.col("`enrichedData.temperature`").alias("temperature"))


@query("""SELECT device_id, event_id, temperature, CAST(row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS integer)
  AS position FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, event_id DESC) AS back FROM readings)
WHERE back <= 5""")
def lake_recent_per_device(d: Domain) -> DataFrame:
    recent = lake.recent_per_device(d.lake, 5)
    return recent.select(F.col("deviceId").alias("device_id"), F.col("eventId").alias("event_id"),
                         F.col("`enrichedData.temperature`").alias("temperature"), "position")


@query("""SELECT event_id, device_id, temperature, humidity, CAST(NULL AS double) AS vibration FROM readings WHERE event_type = 'click'
UNION ALL SELECT event_id, device_id, temperature, NULL, vibration FROM readings WHERE event_type <> 'click'""")
def lake_union_evolving(d: Domain) -> DataFrame:
    old = d.readings.where("event_type = 'click'").select("event_id", "device_id", "temperature", "humidity")
    new = d.readings.where("event_type <> 'click'").select("event_id", "device_id", "temperature", "vibration")
    return lake.union_evolving(old, new)


@query("""SELECT device_id AS "deviceId", epoch_us(ts) AS micros, temperature AS "enrichedData_temperature",
  humidity AS "enrichedData_humidity", vibration AS "enrichedData_vibration" FROM readings""")
def project_ml_cols(d: Domain) -> DataFrame:
    kept = features.keep_ml_cols(d.lake).withColumn("micros", F.unix_micros(normalize_ts(F.col("timestamp"))))
    return plain_names(kept.drop("timestamp"))


@query("""SELECT device_id AS key, device_id AS "deviceId", event_id AS "originalEventId", is_anomaly AS "isAnomaly",
  anomaly_score AS "anomalyScore", epoch_us(ts) // 1000 AS millis FROM predictions""")
def predictions_out(d: Domain) -> DataFrame:
    schema = "deviceId string, originalEventId bigint, isAnomaly boolean, anomalyScore double, timestamp timestamp_ntz"
    return _with_millis(to_predictions(d.predictions).select("key", F.from_json("value", schema).alias("v")).select("key", "v.*"))


@query("""SELECT device_id AS key, device_id AS "deviceId", event_id AS "originalEventId", anomaly_score AS "anomalyScore",
  'ML_ANOMALY_DETECTED' AS type, 'ml-scoring' AS source, epoch_us(ts) // 1000 AS millis FROM predictions WHERE is_anomaly""")
def anomalies_out(d: Domain) -> DataFrame:
    schema = "deviceId string, originalEventId bigint, anomalyScore double, type string, source string, timestamp timestamp_ntz"
    return _with_millis(to_anomalies(d.predictions).select("key", F.from_json("value", schema).alias("v")).select("key", "v.*"))


@query("""SELECT CAST(id AS varchar) AS "ID", device_id AS "Device", severity AS "Severity", message AS "Message",
  strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS varchar), 3, '0') || 'Z' AS "Timestamp",
  CASE WHEN acknowledged THEN 'ACK' ELSE 'Pending' END AS "Status" FROM alerts WHERE severity = 'HIGH'""")
def alerts_csv(d: Domain) -> DataFrame:
    rows = csv_rows(filter_alerts(d.alerts, severity="HIGH"))
    path = scratch_dir(d.spark, "alerts-csv")
    export_csv(rows, path)
    return read_csv(d.spark, path, rows.columns)


@query("""SELECT id, CAST(len(polygon) AS integer) AS points, CASE WHEN len(polygon) > 0 THEN polygon[1][1] END AS first_lat,
  CASE WHEN len(polygon) > 0 THEN polygon[len(polygon)][2] END AS last_lng FROM shapes""")
def polygon_json(d: Domain) -> DataFrame:
    again = d.shapes.withColumn("polygon", format_polygon(F.col("polygon")))

    p = F.col("polygon")
    return with_polygon(again).select("id", F.size(p).alias("points"), F.get(F.get(p, F.lit(0)), F.lit(0)).alias("first_lat"),
                                      F.get(F.get(p, F.size(p) - 1), F.lit(1)).alias("last_lng"))


@query("SELECT 'system-admin' AS recipient, severity, device_id, message, ts AS notified_ts FROM alerts")
def notify_out(d: Domain) -> DataFrame:
    return to_notifications(to_alert_events(d.alerts))


@query("""SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier
UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders""")
def table_source(d: Domain) -> DataFrame:
    cfg = TableConfig(location=d.folder)
    counts = [read_table(d.spark, t, cfg).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
              for t in ("customer", "supplier", "part", "orders")]
    return lake.union_evolving(*counts)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events,
  count(CASE WHEN event_type <> 'click' THEN vibration END) AS with_vibration FROM readings GROUP BY 1""")
def lake_scan(d: Domain) -> DataFrame:
    """A lake whose files differ: older ones lack a sensor, some have no device."""
    path = scratch_dir(d.spark, "mixed-lake")
    typed = d.lake_with("event_type")
    lake_store.append_lake(typed.where("event_type = 'click'").drop("enrichedData.vibration"), path)
    lake_store.append_lake(typed.where("event_type <> 'click'"), path)
    lake_store.append_lake(d.lake.drop("deviceId"), path)
    return (lake_store.read_lake(d.spark, path).groupBy("day")
            .agg(F.count(F.lit(1)).alias("events"), F.count("`enrichedData.vibration`").alias("with_vibration")))


@query("""SELECT event_id, device_id, temperature, arrival FROM
  (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS n FROM redelivered) WHERE n = 1""")
def dedup_events(d: Domain) -> DataFrame:
    return processing.dedup(d.redelivered).select("event_id", "device_id", "temperature", "arrival")


@query("""SELECT event_id, arrival FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS n FROM redelivered)
WHERE n = 1 AND event_id NOT IN (SELECT event_id FROM readings WHERE event_type = 'view')""")
def dedup_against_processed(d: Domain) -> DataFrame:
    done = d.readings.where("event_type = 'view'").select("event_id")
    return processing.dedup(d.redelivered, processed=done).select("event_id", "arrival")


@query("""SELECT t.event_id, t.device_id, t.temperature, d.type AS device_type FROM telemetry t JOIN devices d ON t.device_id = d.device_id""")
def registry_enrich(d: Domain) -> DataFrame:
    return processing.enrich(d.telemetry, d.devices).select("event_id", "device_id", "temperature", "device_type")


@query("SELECT event_id, device_id, temperature FROM telemetry WHERE device_id NOT IN (SELECT device_id FROM devices)")
def unknown_devices(d: Domain) -> DataFrame:
    return processing.unknown_devices(d.telemetry, d.devices).select("event_id", "device_id", "temperature")


@query("SELECT threshold FROM limits")
def rule_threshold(d: Domain) -> DataFrame:
    return processing.threshold(d.rules)


@query("""SELECT metric, coalesce(o.rule_name, 'Default ' || upper(metric[1]) || metric[2:] || ' Check') AS rule_name,
  coalesce(c.threshold, o.threshold) AS threshold
FROM (SELECT metric, arg_max(threshold, id) AS threshold, arg_max(rule_name, id) AS rule_name FROM rules GROUP BY metric) o
FULL JOIN (SELECT metric, arg_max(threshold, seq) AS threshold FROM rule_changes GROUP BY metric) c USING (metric)""")
def rule_upsert(d: Domain) -> DataFrame:
    out = processing.upsert_rules(d.rules, d.rule_changes)
    # SQL's capitals differ inside a name, so the check capitalises the first letter only
    plain = F.concat(F.lit("Default "), F.upper(F.substring("metric", 1, 1)), F.expr("substring(metric, 2)"), F.lit(" Check"))
    return out.withColumn("rule_name", F.when(F.col("rule_name").startswith("Default "), plain).otherwise(F.col("rule_name")))


@query("""SELECT event_id, CASE WHEN t > threshold THEN 'CRITICAL' WHEN t > threshold * 0.8 THEN 'WARNING' ELSE 'NORMAL' END AS status
FROM (SELECT event_id, CASE WHEN json_type(CAST(payload AS JSON), '$.temperature') IN ('DOUBLE', 'BIGINT', 'UBIGINT')
  THEN CAST(CAST(payload AS JSON)->>'$.temperature' AS double) END AS t FROM requests) CROSS JOIN limits""")
def status_classify(d: Domain) -> DataFrame:
    number = json_number(F.col("payload"), "temperature")
    return processing.with_status(d.requests, d.rules, number).select("event_id", "status")


@query("""SELECT original_event_id, correlation_id, reading_type, 1 AS payload_keys, 'ProcessedTelemetryEvent' AS event_type, '1.0' AS version, 'processing-service' AS source_service,
  ts, device_id, status, temperature, humidity, vibration, device_type FROM processed""")
def processed_projection(d: Domain) -> DataFrame:
    return d.processed.select("original_event_id", "correlation_id", F.col("payload")["event_type"].alias("reading_type"),
                              F.size("payload").alias("payload_keys"), "event_type", "version", "source_service", "ts", "device_id", "status",
                              *[f"enriched_data.{s}" for s in SENSORS], F.col("enriched_data.deviceType").alias("device_type"))


@query("""SELECT event_id, device_id, coalesce(reason, 'ok') AS reason,
  CASE WHEN reason IS NULL THEN NULL ELSE 'device-data-received' END AS topic
FROM (SELECT event_id, device_id, CASE WHEN device_id IS NULL THEN 'malformed' WHEN payload IS NULL THEN 'null_payload'
  WHEN device_id NOT IN (SELECT device_id FROM devices) THEN 'unknown_device' END AS reason
  FROM (SELECT event_id, CASE WHEN value <> 'NOT_JSON' THEN value->>'$.deviceId' END AS device_id,
               CASE WHEN value <> 'NOT_JSON' THEN value->>'$.payload' END AS payload FROM received))""")
def dead_letter_split(d: Domain) -> DataFrame:
    schema = "deviceId string, payload map<string, double>"
    rows = processing.reasoned(d.received, d.devices, schema)
    return rows.select("event_id", F.col("d.deviceId").alias("device_id"), F.coalesce("reason", F.lit("ok")).alias("reason"),
                       F.when(F.col("reason").isNotNull(), TOPIC_RECEIVED).alias("topic"))


@query("""SELECT value->>'$.eventId' AS event_id, coalesce(CAST(value->>'$.enrichedData.temperature' AS double), 0.0) AS temperature,
  0.0::double AS humidity, 0.0::double AS vibration, value->>'$.enrichedData.deviceType' AS device_type
FROM (SELECT CAST(value AS JSON) AS value FROM raw_records WHERE value <> 'NOT_JSON') WHERE value->>'$.deviceId' IS NOT NULL""")
def null_to_zero(d: Domain) -> DataFrame:
    filled = ingest.fill_readings(ingest.parse_events(d.raw_records))
    return filled.select(F.col("eventId").alias("event_id"), *[f"enrichedData.{s}" for s in SENSORS],
                         F.col("enrichedData.deviceType").alias("device_type"))


@query("""SELECT device_id AS "deviceId", event_id AS "eventId", least(greatest(coalesce(temperature * 2 - 100, 0.0), -50.0), 150.0) AS "enrichedData_temperature",
  CASE WHEN event_type = 'click' THEN 0.0 ELSE humidity END AS "enrichedData_humidity",
  CASE WHEN event_type = 'error' THEN '0' ELSE event_type END AS kind FROM telemetry WHERE event_type <> 'view'""")
def validate_features(d: Domain) -> DataFrame:
    frame = d.telemetry.select(
        F.when(F.col("event_type") != "view", F.col("device_id")).alias("deviceId"), F.col("event_id").alias("eventId"),
        F.col("ts").alias("timestamp"), (F.col("temperature") * 2 - 100).alias("enrichedData.temperature"),
        F.when(F.col("event_type") == "click", "bad").otherwise(F.col("humidity").cast("string")).alias("enrichedData.humidity"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return plain_names(features.validate(frame).drop("timestamp"))


@query("""SELECT severity, acknowledged, id, device_id, message FROM alerts WHERE severity = 'HIGH' AND NOT acknowledged""")
def alert_filter(d: Domain) -> DataFrame:
    return filter_alerts(d.alerts, "HIGH", "pending").select("severity", "acknowledged", "id", "device_id", "message")


@query("""SELECT device_id, type, status FROM devices WHERE contains(lower(device_id), 'in') OR contains(lower(type), 'in')
  OR contains(lower(status), 'in')""")
def device_search(d: Domain) -> DataFrame:
    return search_devices(d.devices, "In").select("device_id", "type", "status")


@query("""SELECT device_id, latitude, longitude FROM marked WHERE NOT is_anomaly
  AND device_id IN (SELECT device_id FROM located WHERE area_id = 2)""")
def device_map_filter(d: Domain) -> DataFrame:
    return filter_map(d.marked, d.located, 2, "normal").select("device_id", "latitude", "longitude")


@query("SELECT device_id, type FROM devices WHERE simulated")
def simulated_devices(d: Domain) -> DataFrame:
    return simulated(d.devices).select("device_id", "type")


@query("SELECT id, device_id, type, status FROM devices WHERE device_id = 'dev-1'")
def device_lookup(d: Domain) -> DataFrame:
    return get_device(d.devices, "dev-1").select("id", "device_id", "type", "status")
