"""The telemetry domain as views over the given tables.

Base views are one SQL text that both engines read. Derived views are built by the operators on
the Spark side; their SQL counterpart is written out for the check.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.operators import scoring
from tidewatch.operators.alerts import raise_alerts
from tidewatch.operators.analytics import device_stats
from tidewatch.operators.features import rolling_features
from tidewatch.operators.geo import mark_anomalies, members, spatial_join, with_polygon
from tidewatch.operators.iforest import NODES, average_path
from tidewatch.operators.processing import enrich, to_processed, with_status
from tidewatch.schemas import ENRICHED, SENSORS

TEXT = "varchar(40)"
ISOLATION_LIMIT = 200  # temperature above which the stand-in isolation flag is set


def _text(e: str) -> str:
    return f"CAST({e} AS {TEXT})"


def _polygon(*points: tuple[str, str]) -> str:
    parts = ["'['"]
    for i, (lat, lng) in enumerate(points):
        parts += ["',['" if i else "'['", _text(lat), "','", _text(lng), "']'"]
    return f"concat({', '.join(parts)}, ']')"


_SENT = _text("1775562669731 + event_id * 1000")  # time at which a raw record was sent, epoch ms as text
_LAT, _LNG = "(36 + s_suppkey % 8)", "(s_suppkey % 12 - 9)"

# name: (table, columns, condition)
BASE: dict[str, tuple[str, dict[str, str], str | None]] = {
    "telemetry": ("events", {
        "event_id": "event_id",
        "device_id": f"concat('dev-', {_text('user_id')})",
        "ts": "ts",
        "event_type": "event_type",
        "correlation_id": f"concat('request-', {_text('event_id')})",
        "temperature": "CASE WHEN event_type = 'signup' THEN NULL ELSE value END",
        "humidity": "CAST(regexp_extract(props, '([0-9]+)', 1) AS double)",
        "vibration": "CAST(event_id % 97 AS double) / CAST(1000 AS double)",
    }, None),
    "readings": ("events", {
        "event_id": "event_id",
        "device_id": f"concat('dev-', {_text('user_id')})",
        "ts": "ts",
        "event_type": "event_type",
        "temperature": "value",
        "humidity": "CAST(regexp_extract(props, '([0-9]+)', 1) AS double)",
        "vibration": "CAST(event_id % 97 AS double) / CAST(1000 AS double)",
    }, None),
    # what clients post: some device ids blank, some payloads empty or with a temperature as text
    "requests": ("events", {
        "event_id": "event_id",
        "device_id": f"CASE WHEN event_type = 'click' AND value < 20 THEN '  ' ELSE concat('dev-', {_text('user_id')}) END",
        "event_type": "CASE WHEN event_type = 'view' THEN NULL ELSE event_type END",
        "ts": "CASE WHEN event_type = 'purchase' THEN NULL ELSE ts END",
        "payload": "CASE WHEN event_type = 'error' THEN '{}' "
                   f"WHEN event_type = 'signup' THEN concat('{{\"temperature\":\"', {_text('value')}, '\"}}') "
                   f"WHEN event_type = 'view' THEN '{{\"humidity\":1.5}}' "
                   f"ELSE concat('{{\"temperature\":', {_text('value')}, '}}') END",
    }, None),
    # records on the processed topic: some malformed, some without a device, readings or data
    "raw_records": ("events", {
        "event_id": "event_id",
        "value": "CASE WHEN event_type = 'error' THEN 'NOT_JSON' "
                 f"WHEN event_type = 'signup' THEN concat('{{\"eventId\":\"', {_text('event_id')}, '\"}}') "
                 f"WHEN event_type = 'view' THEN concat('{{\"deviceId\":\"dev-', {_text('user_id')}, '\",\"eventId\":\"', "
                 f"{_text('event_id')}, '\",\"timestamp\":\"', {_SENT}, '\",\"status\":\"NORMAL\"}}') "
                 f"ELSE concat('{{\"deviceId\":\"dev-', {_text('user_id')}, '\",\"eventId\":\"', {_text('event_id')}, "
                 f"'\",\"timestamp\":\"', {_SENT}, '\",\"status\":\"WARNING\",\"enrichedData\":{{\"temperature\":', {_text('value')}, "
                 "',\"humidity\":null,\"deviceType\":\"probe\",\"deviceLocation\":\"roof\"}}') END",
    }, None),
    # records on the received topic, for the dead-letter split
    "received": ("events", {
        "event_id": "event_id",
        "value": "CASE WHEN event_type = 'error' THEN 'NOT_JSON' "
                 f"WHEN event_type = 'signup' THEN concat('{{\"deviceId\":\"dev-', {_text('user_id')}, '\",\"payload\":null}}') "
                 f"ELSE concat('{{\"deviceId\":\"dev-', {_text('user_id')}, '\",\"payload\":{{\"temperature\":', "
                 f"{_text('value')}, '}}}}') END",
    }, None),
    "timestamps": ("events", {
        "event_id": "event_id",
        "raw": "CASE event_type "
               f"WHEN 'click' THEN {_text('1775562669731 + event_id * 1000')} "
               f"WHEN 'view' THEN concat('1.77556', {_text('1000 + event_id % 9000')}, 'E9') "
               "WHEN 'error' THEN 'junk' "
               f"WHEN 'signup' THEN concat('2026-04-', {_text('10 + event_id % 20')}, 'T11:44:23Z') "
               f"ELSE {_text('1775562669 + event_id')} END",
    }, None),
    "devices": ("customer", {
        "id": "c_custkey",
        "device_id": f"concat('dev-', {_text('c_custkey')})",
        "type": "c_mktsegment",
        "status": "CASE WHEN c_acctbal < 1500 THEN 'INACTIVE' ELSE 'ACTIVE' END",
        "simulated": "c_nationkey < 8",
        "latitude": "CASE WHEN c_nationkey = 7 THEN NULL ELSE CAST(36 + c_custkey % 8 AS double) "
                    "+ CAST(c_custkey % 10 AS double) / CAST(10 AS double) END",
        "longitude": "CASE WHEN c_nationkey = 9 THEN NULL ELSE CAST(c_custkey % 12 - 9 AS double) "
                     "+ CAST(c_custkey % 9 AS double) / CAST(10 AS double) END",
    }, "c_acctbal >= 0"),  # customers in debt have no registered device
    "rules": ("part", {
        "id": "p_partkey",
        "rule_name": "p_name",
        "metric": "CASE p_type WHEN 'ECONOMY' THEN 'temperature' ELSE lower(p_type) END",
        "threshold": "CAST(60 + p_size AS double)",
    }, None),
    "rule_changes": ("orders", {
        "seq": "o_orderkey",
        "metric": "CASE o_orderpriority WHEN '1-URGENT' THEN 'temperature' ELSE lower(o_orderpriority) END",
        "threshold": "o_totalprice / CAST(5000 AS double)",
    }, None),
    "areas": ("supplier", {
        "id": "s_suppkey",
        "name": "CASE WHEN s_nationkey = 3 THEN ' ' ELSE s_name END",
        "created_at": "CAST(1704067200 + s_nationkey * 3600 AS bigint)",
        "polygon": "CASE s_suppkey % 5 WHEN 0 THEN "
                   + _polygon((_LAT, _LNG), (_LAT, f"({_LNG} + 2)"), (f"({_LAT} + 2)", f"({_LNG} + 2)"), (f"({_LAT} + 2)", _LNG))
                   + " WHEN 1 THEN "
                   + _polygon((_LAT, _LNG), (f"({_LAT} + 3)", _LNG), (f"({_LAT} + 1)", f"({_LNG} + 4)"))
                   + " WHEN 2 THEN "
                   + _polygon((_LAT, _LNG), (f"({_LAT} + 4)", _LNG), (f"({_LAT} + 4)", f"({_LNG} + 3)"),
                              (f"({_LAT} + 2)", f"({_LNG} + 1)"), (_LAT, f"({_LNG} + 3)"))
                   + " WHEN 3 THEN " + _polygon((_LAT, _LNG), (f"({_LAT} + 1)", _LNG))
                   + " ELSE '[]' END",
    }, None),
    "area_devices": ("orders", {
        "area_id": "CAST(floor(o_orderkey / 150) AS bigint)",
        "device_id": "o_custkey",
    }, "o_orderstatus = 'P'"),
    # changes to the registry: customers' orders in order of their key
    "device_log": ("orders", {
        "seq": "o_orderkey",
        "op": "CASE o_orderpriority WHEN '1-URGENT' THEN 'create' WHEN '2-HIGH' THEN 'delete' "
              "WHEN '3-MEDIUM' THEN 'simulate' ELSE 'locate' END",
        "device_id": f"concat('dev-', {_text('o_custkey')})",
        "type": "CASE WHEN o_orderpriority = '1-URGENT' THEN concat('type-', o_orderstatus) END",
        "simulated": "CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_orderstatus = 'F' END",
        "latitude": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice / CAST(7000 AS double) END",
        "longitude": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice / CAST(9000 AS double) END",
    }, None),
    "area_log": ("part", {
        "seq": "p_partkey",
        "op": "CASE WHEN p_type = 'ECONOMY' AND p_size > 40 THEN 'delete' "
              "WHEN p_type = 'ECONOMY' THEN 'create' ELSE 'polygon' END",
        # creates use fresh ids, other changes name an area that may exist
        "area_id": "CASE WHEN p_type = 'ECONOMY' AND p_size <= 40 THEN p_partkey + 1000000000 "
                   "ELSE CAST(floor(p_partkey / 15) AS bigint) END",
        "name": "CASE WHEN p_type = 'ECONOMY' AND p_size <= 40 THEN p_name END",
        "polygon": f"concat('[[', {_text('p_size')}, ',1],[2,3],[4,5]]')",
    }, None),
    "assignments": ("orders", {
        "area_id": "CAST(floor(o_orderkey / 140) AS bigint)",
        "device_id": "o_custkey",
    }, "o_orderstatus = 'F'"),
    "model_runs": ("orders", {
        "seq": "o_orderkey",
        "version": "CASE o_orderpriority WHEN '1-URGENT' THEN concat('../', " + _text("o_orderkey") + ") "
                   "WHEN '2-HIGH' THEN concat('v 1;', " + _text("o_orderkey") + ") "
                   "ELSE concat('20240101_', " + _text("o_orderkey") + ") END",
        "trained_at": "CAST(1704067200 + o_orderkey * 60 AS bigint)",
        "threshold": "o_totalprice / CAST(-10000000 AS double)",
    }, None),
}

_SPREAD = "OVER (PARTITION BY device_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_LAST20 = _SPREAD.format(n=19)


def stream_feature_sql(source: str) -> str:
    """SQL counterpart of ``rolling_features`` over a view with the three readings."""
    return f"""
SELECT *, temp_max - temp_min AS temp_range,
  CASE WHEN temperature > before THEN 'increasing' WHEN temperature < before THEN 'decreasing' ELSE 'stable' END AS trend
FROM (SELECT *,
    lag(temperature) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS before,
    avg(temperature) {_LAST20} AS temp_mean, stddev_pop(temperature) {_LAST20} AS temp_std,
    min(temperature) {_LAST20} AS temp_min, max(temperature) {_LAST20} AS temp_max,
    avg(humidity) {_LAST20} AS hum_mean, stddev_pop(humidity) {_LAST20} AS hum_std,
    avg(vibration) {_LAST20} AS vib_mean, stddev_pop(vibration) {_LAST20} AS vib_std,
    CAST(count(*) {_LAST20} AS integer) AS event_count
  FROM (SELECT * REPLACE (coalesce(temperature, 0.0) AS temperature) FROM {source}))"""


# A small forest that SQL can walk: (tree, node, feature, threshold, rows); features 0 to 2 are the readings.
LITERAL_FOREST = [(0, 1, 0, 120.0, 256), (0, 2, 1, 45.0, 200), (0, 4, -1, 0.0, 150), (0, 5, -1, 0.0, 50), (0, 3, 2, 0.05, 56),
                  (0, 6, -1, 0.0, 50), (0, 7, -1, 0.0, 6), (1, 1, 2, 0.09, 256), (1, 2, 0, 140.0, 240), (1, 4, -1, 0.0, 230),
                  (1, 5, -1, 0.0, 10), (1, 3, -1, 0.0, 16)]
LITERAL_LIMIT = 0.08


def literal_forest_sql() -> str:
    """The decision value of LITERAL_FOREST: path lengths as nested cases."""
    nodes = {(t, n): (f, cut, rows) for t, n, f, cut, rows in LITERAL_FOREST}
    reading = ("least(greatest(temperature, -50.0), 150.0)", "humidity", "vibration")

    def path(tree: int, node: int, depth: int) -> str:
        feature, cut, rows = nodes[tree, node]
        if feature < 0:
            return f"{depth + float(average_path(rows))!r}::double"
        return (f"CASE WHEN {reading[feature]} > {cut} THEN {path(tree, 2 * node + 1, depth + 1)} "
                f"ELSE {path(tree, 2 * node, depth + 1)} END")
    trees = sorted({t for t, _ in nodes})
    total = " + ".join(f"({path(t, 1, 0)})" for t in trees)
    return f"0.5 - pow(2.0::double, -({total}) / {len(trees)} / {float(average_path(256))!r})"


# Counterparts of the derived views.
DERIVED_SQL: dict[str, str] = {
    "redelivered": "SELECT *, event_id * 2 AS arrival FROM telemetry "
                   "UNION ALL SELECT *, event_id * 2 + 1001 AS arrival FROM telemetry WHERE event_type = 'error'",
    "limits": "SELECT coalesce((SELECT threshold FROM rules WHERE metric = 'temperature' ORDER BY id DESC LIMIT 1), "
              "100.0) AS threshold",
    "processed": """
SELECT t.event_id AS original_event_id, t.correlation_id, t.event_type AS reading_type, t.ts, t.device_id, d.type AS device_type, t.temperature, t.humidity, t.vibration,
  CASE WHEN t.temperature > l.threshold THEN 'CRITICAL' WHEN t.temperature > l.threshold * 0.8 THEN 'WARNING'
       ELSE 'NORMAL' END AS status
FROM telemetry t JOIN devices d ON t.device_id = d.device_id CROSS JOIN limits l""",
    "alerts": """
SELECT original_event_id AS id, device_id, CASE status WHEN 'CRITICAL' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  concat(status, ' condition detected for device ', device_id, '. Data: {deviceType=', device_type, ', humidity=',
    CAST(humidity AS varchar), ', temperature=', CAST(temperature AS varchar), ', vibration=', CAST(vibration AS varchar),
    '}') AS message,
  ts, humidity < 30 AS acknowledged
FROM processed WHERE status <> 'NORMAL'""",
    "featured": stream_feature_sql("readings"),
    "topic_readings": """
SELECT device_id, CAST(event_id AS varchar) AS event_id, event_id AS ts, CAST(1775562669731 + event_id * 1000 AS varchar) AS sent,
  CASE WHEN event_type = 'view' THEN 'NORMAL' ELSE 'WARNING' END AS status,
  CASE WHEN event_type = 'view' THEN 0.0 ELSE temperature END AS temperature, 0.0::double AS humidity, 0.0::double AS vibration,
  CASE WHEN event_type <> 'view' THEN 'probe' END AS device_type, CASE WHEN event_type <> 'view' THEN 'roof' END AS device_location
FROM readings WHERE event_type NOT IN ('error', 'signup')""",
    "topic_featured": stream_feature_sql("topic_readings"),
    "forest_flagged": f"""
SELECT * REPLACE (raw_score < {LITERAL_LIMIT} AS if_flag, round(raw_score, 4) AS if_score)
FROM (SELECT *, {literal_forest_sql()} AS raw_score FROM detected)""",
    "forest_predictions": """
SELECT *, 2 * CAST(if_flag AS integer) + CAST(zscore_flag AS integer) + CAST(trend_flag AS integer) >= 2 AS is_anomaly
FROM forest_flagged""",
    "detected": """
SELECT *, greatest(raw_t, raw_h, raw_v) > 3 AS zscore_flag, round(greatest(raw_t, raw_h, raw_v), 3) AS max_zscore,
  round(raw_t, 3) AS z_temperature, round(raw_h, 3) AS z_humidity, round(raw_v, 3) AS z_vibration,
  trend = 'increasing' AND temp_std > 5 AND temp_range > 10 AS trend_flag,
  temperature > 200 AS if_flag, round((200 - temperature) / 997, 6) AS if_score
FROM (SELECT *,
  CASE WHEN temp_std > 0 THEN abs(temperature - temp_mean) / temp_std ELSE 0.0 END AS raw_t,
  CASE WHEN hum_std > 0 THEN abs(humidity - hum_mean) / hum_std ELSE 0.0 END AS raw_h,
  CASE WHEN vib_std > 0 THEN abs(vibration - vib_mean) / vib_std ELSE 0.0 END AS raw_v FROM featured)""",
    "predictions": """
SELECT *, event_id AS seq, votes >= 2 AS is_anomaly, if_score AS anomaly_score, if_score AS score,
  CASE votes WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'LOW' WHEN 4 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
  CASE WHEN votes = 0 THEN 'All models nominal' ELSE concat_ws('; ',
    CASE WHEN if_flag THEN 'Isolation Forest score ' || printf('%.3f', round(if_score, 3)) || ' below threshold' END,
    CASE WHEN zscore_flag THEN 'Z-score ' || printf('%.1f', round(max_zscore, 1)) || 'σ exceeds 3σ threshold' END,
    CASE WHEN trend_flag THEN 'Rapidly ' || trend || ' temperature (range ' || CAST(round(temp_range, 3) AS varchar)
      || '°C, σ=' || CAST(round(temp_std, 3) AS varchar) || '°C)' END) END AS reason
FROM (SELECT *, 2 * CAST(if_flag AS integer) + CAST(zscore_flag AS integer) + CAST(trend_flag AS integer) AS votes
      FROM detected)""",
    "stats": "SELECT device_id, count(*) AS event_count, max(epoch_us(ts) // 1000) AS last_seen FROM readings GROUP BY device_id",
    "members": "SELECT DISTINCT ad.area_id, d.device_id FROM area_devices ad JOIN devices d ON ad.device_id = d.id",
    "shapes": "SELECT id, name, created_at, CAST(CAST(polygon AS JSON) AS DOUBLE[][]) AS polygon FROM areas",
    "edges": """
SELECT id, name, created_at, polygon[i][1] AS lat_i, polygon[i][2] AS lng_i,
  polygon[CASE WHEN i = 1 THEN len(polygon) ELSE i - 1 END][1] AS lat_j,
  polygon[CASE WHEN i = 1 THEN len(polygon) ELSE i - 1 END][2] AS lng_j
FROM (SELECT *, unnest(range(1, len(polygon) + 1)) AS i FROM shapes)""",
    "located": """
SELECT e.id AS area_id, e.name AS area_name, e.created_at, d.device_id
FROM devices d JOIN edges e ON d.latitude IS NOT NULL AND d.longitude IS NOT NULL
  AND (e.lng_i > d.longitude) <> (e.lng_j > d.longitude)
  AND d.latitude < (e.lat_j - e.lat_i) * (d.longitude - e.lng_i) / (e.lng_j - e.lng_i) + e.lat_i
GROUP BY e.id, e.name, e.created_at, d.device_id HAVING count(*) % 2 = 1""",
    "recent": "SELECT * FROM (SELECT * FROM predictions ORDER BY seq DESC LIMIT 500) WHERE is_anomaly "
              "ORDER BY seq DESC LIMIT 10",
    "marked": """
SELECT d.*, r.device_id IS NOT NULL AS is_anomaly, coalesce(r.score, 0.0) AS anomaly_score
FROM devices d LEFT JOIN (SELECT device_id, arg_max(score, seq) AS score FROM predictions WHERE is_anomaly GROUP BY device_id) r
  ON d.device_id = r.device_id""",
    "mapped": """
SELECT d.device_id, d.type, d.status, d.latitude, d.longitude, d.simulated, f.area_name
FROM devices d LEFT JOIN (
  SELECT m.device_id, arg_min(a.name, a.created_at * 1000000 + a.id) AS area_name
  FROM members m JOIN areas a ON m.area_id = a.id GROUP BY m.device_id) f ON d.device_id = f.device_id""",
}


def base_sql(name: str) -> str:
    table, columns, condition = BASE[name]
    items = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    return f"SELECT {items} FROM {table}" + (f" WHERE {condition}" if condition else "")


def sql(query: str) -> str:
    """The query with the views it uses, and those they use, as common table expressions."""
    texts = {**{n: base_sql(n) for n in BASE}, **DERIVED_SQL}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in texts:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(texts[name])
                needed.append(name)
    visit(query)
    ctes = ",\n".join(f"{n} AS ({texts[n].strip()})" for n in needed)
    return f"WITH {ctes}\n{query.strip()}" if ctes else query.strip()


@lru_cache(maxsize=256)
def _schema(spark: SparkSession, application: str, path: str) -> StructType:
    """Schema of a table; reading footers is a job, done once per application and table."""
    return spark.read.parquet(path).schema


@dataclass(frozen=True)
class Domain:
    """The views as DataFrames over the tables of one folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        return self.spark.read.schema(_schema(self.spark, self.spark.sparkContext.applicationId, path)).parquet(path)

    def base(self, name: str) -> DataFrame:
        table, columns, condition = BASE[name]
        df = self.table(table)
        df = df.where(condition) if condition else df
        return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)

    @property
    def redelivered(self) -> DataFrame:
        first = self.telemetry.withColumn("arrival", F.col("event_id") * 2)
        again = (self.telemetry.where("event_type = 'error'")
                 .withColumn("arrival", F.col("event_id") * 2 + 1001))
        return first.unionByName(again)

    @property
    def processed(self) -> DataFrame:
        return to_processed(with_status(enrich(self.telemetry, self.devices), self.rules))

    @property
    def alerts(self) -> DataFrame:
        raised = raise_alerts(self.processed, alert_id=F.col("original_event_id"))
        # the view's acknowledgements: alerts of dry readings have been seen
        dry = F.regexp_extract("message", r"humidity=([0-9.]+)", 1).cast("double") < 30
        return raised.withColumn("acknowledged", dry)

    @property
    def featured(self) -> DataFrame:
        return rolling_features(self.readings)

    @property
    def flagged(self) -> DataFrame:
        """Features with a stand-in for the isolation forest that SQL can express."""
        return self.featured.withColumns({
            "if_flag": F.col("temperature") > ISOLATION_LIMIT,
            "if_score": F.round((ISOLATION_LIMIT - F.col("temperature")) / 997, 6)})

    @property
    def literal_forest(self) -> DataFrame:
        return self.spark.createDataFrame(LITERAL_FOREST, NODES)

    @property
    def predictions(self) -> DataFrame:
        return scoring.ensemble(self.flagged).withColumns({"seq": F.col("event_id"), "score": F.col("if_score")})

    @property
    def marked(self) -> DataFrame:
        return mark_anomalies(self.devices, self.predictions.where("is_anomaly"))

    @property
    def members(self) -> DataFrame:
        return members(self.area_devices, self.devices)

    @property
    def located(self) -> DataFrame:
        return spatial_join(self.devices, self.shapes)

    @property
    def stats(self) -> DataFrame:
        return device_stats(self.readings)

    @property
    def lake(self) -> DataFrame:
        return self.lake_with()

    def lake_with(self, *more: str) -> DataFrame:
        """Readings with the column names of the lake; events arrive when they happen."""
        return self.readings.select(
            *more,
            F.col("device_id").alias("deviceId"), F.col("event_id").alias("eventId"),
            F.col("ts").cast("timestamp").cast("string").alias("timestamp"),
            *[F.col(s).alias(ENRICHED + s) for s in SENSORS],
            F.col("ts").alias("arrival_timestamp"))

    @property
    def shapes(self) -> DataFrame:
        return with_polygon(self.areas)
