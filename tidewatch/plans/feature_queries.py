"""Rolling features, detectors and the ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import features, scoring
from tidewatch.plans.registry import plain_names, query, rounded
from tidewatch.plans.views import Domain
from tidewatch.schemas import SENSORS

_STATS = ["temp_mean", "temp_std", "temp_min", "temp_max", "temp_range", "hum_mean", "hum_std", "vib_mean", "vib_std"]
_ROUNDED_STATS = ", ".join(f"round({c}, 8) AS {c}" for c in _STATS)


@query(f"SELECT device_id, event_id, {_ROUNDED_STATS}, event_count FROM featured")
def rolling_stats_20(d: Domain) -> DataFrame:
    return rounded(d.featured.select("device_id", "event_id", *_STATS, "event_count"))


@query("SELECT device_id, event_id, trend FROM featured")
def trend_p2p(d: Domain) -> DataFrame:
    return d.featured.select("device_id", "event_id", "trend")


_W = "OVER (PARTITION BY device_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_CLIPPED = "(SELECT * REPLACE (least(greatest(temperature, -50.0), 150.0) AS temperature) FROM readings)"


def _ml_sql(*parts: str) -> str:
    """SQL for some of the engineered columns of every sensor."""
    forms = {
        "mean": "round(avg({s}) {w}, 8) AS feat_{s}_rolling_mean_5",
        "std": "round(coalesce(stddev_samp({s}) {w}, 0.0), 8) AS feat_{s}_rolling_std_5",
        "min": "round(min({s}) {w}, 8) AS feat_{s}_rolling_min_5",
        "max": "round(max({s}) {w}, 8) AS feat_{s}_rolling_max_5",
        "delta": "round(coalesce({s} - lag({s}) OVER (PARTITION BY device_id ORDER BY ts, event_id), 0.0), 8) AS feat_{s}_delta",
    }
    items = ", ".join(forms[p].format(s=s, w=_W) for s in SENSORS for p in parts)
    return f'SELECT device_id AS "deviceId", event_id AS "eventId", {items} FROM {_CLIPPED}'


def _engineered(d: Domain, part: str) -> DataFrame:
    prepared = features.prepare_for_ml(d.lake)
    names = [c for c in prepared.columns if c.startswith("feat_") and part in c]
    return rounded(prepared.select("deviceId", "eventId", *names))


@query(_ml_sql("mean"))
def rolling5_mean(d: Domain) -> DataFrame:
    return _engineered(d, "_rolling_mean_")


@query(_ml_sql("std"))
def rolling5_std(d: Domain) -> DataFrame:
    return _engineered(d, "_rolling_std_")


@query(_ml_sql("min"))
def rolling5_min(d: Domain) -> DataFrame:
    return _engineered(d, "_rolling_min_")


@query(_ml_sql("max"))
def rolling5_max(d: Domain) -> DataFrame:
    return _engineered(d, "_rolling_max_")


@query(_ml_sql("delta"))
def delta(d: Domain) -> DataFrame:
    return _engineered(d, "_delta")


_ALL = _ml_sql("mean", "std", "min", "max", "delta")


@query(_ALL)
def prepare_for_ml(d: Domain) -> DataFrame:
    return _engineered(d, "feat_")


@query(_ALL.replace('SELECT device_id AS "deviceId", event_id AS "eventId",',
                    'SELECT temperature AS "enrichedData_temperature", humidity AS "enrichedData_humidity", '
                    'vibration AS "enrichedData_vibration",'))
def select_features(d: Domain) -> DataFrame:
    return rounded(plain_names(features.features_only(features.prepare_for_ml(d.lake))))


@query(_ALL.replace('"deviceId"', "device_id").replace('"eventId"', "event_id"))
def if_inference_window(d: Domain) -> DataFrame:
    """The features a scored event meets: those of training, from the same window."""
    scored_on = scoring.telemetry_features(d.readings)
    names = [c for c in scored_on.columns if c.startswith("feat_")]
    return rounded(scored_on.select("device_id", "event_id", *names))


@query("""SELECT device_id, event_id, z_temperature, z_humidity, z_vibration, max_zscore, zscore_flag FROM detected""")
def zscore(d: Domain) -> DataFrame:
    return scoring.with_zscore(d.featured).select(
        "device_id", "event_id", *[f"z_{s}" for s in SENSORS], "max_zscore", "zscore_flag")


@query("SELECT device_id, event_id, trend_flag FROM detected")
def trend_flag(d: Domain) -> DataFrame:
    return scoring.with_trend_flag(d.featured).select("device_id", "event_id", "trend_flag")


@query("SELECT device_id, event_id, CAST(votes AS integer) AS votes, is_anomaly FROM predictions")
def ensemble_votes(d: Domain) -> DataFrame:
    return d.predictions.select("device_id", "event_id", "votes", "is_anomaly")


@query("SELECT device_id, severity, count(*) AS events FROM predictions GROUP BY device_id, severity")
def severity_map(d: Domain) -> DataFrame:
    return d.predictions.groupBy("device_id", "severity").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT device_id, event_id, reason FROM predictions")
def reason_text(d: Domain) -> DataFrame:
    return d.predictions.select("device_id", "event_id", "reason")


@query("""SELECT device_id, event_id, is_anomaly AS anomaly, severity, if_score AS isolation, max_zscore AS zscore, trend_flag AS trend_vote,
  z_temperature, z_vibration, trend, round(temp_std, 3) AS temp_std, round(temp_range, 3) AS temp_range FROM predictions""")
def explain_struct(d: Domain) -> DataFrame:
    e = scoring.explain(d.predictions)
    return e.select("device_id", "event_id", "anomaly", "severity", "scores.isolation", "scores.zscore",
                    F.col("scores.trend").alias("trend_vote"),
                    F.col("features.zscore_breakdown.temperature").alias("z_temperature"),
                    F.col("features.zscore_breakdown.vibration").alias("z_vibration"),
                    "features.trend_info.trend", "features.trend_info.temp_std", "features.trend_info.temp_range")


@query("""SELECT device_id, event_id, CASE WHEN is_anomaly THEN 'ANOMALY' ELSE 'NORMAL' END AS prediction, anomaly_score,
  CAST(-0.05 AS double) AS threshold, severity FROM predictions""")
def prediction_label(d: Domain) -> DataFrame:
    return scoring.to_response(d.predictions, F.lit(-0.05))
