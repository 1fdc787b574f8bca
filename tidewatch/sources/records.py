"""Records published downstream, as key and JSON value or as plain rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANOMALY_TYPE = "ML_ANOMALY_DETECTED"


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(F.col("deviceId").alias("key"), F.to_json(F.struct("*")).alias("value"))


def prediction_rows(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        F.col("device_id").alias("deviceId"), F.col("event_id").alias("originalEventId"),
        F.col("is_anomaly").alias("isAnomaly"), F.col("anomaly_score").alias("anomalyScore"),
        F.col("ts").alias("timestamp"))


def anomaly_rows(predictions: DataFrame, source: str = "ml-scoring") -> DataFrame:
    """Anomalies only; ``source`` names the publishing service."""
    return predictions.where("is_anomaly").select(
        F.col("device_id").alias("deviceId"), F.col("event_id").alias("originalEventId"),
        F.col("ts").alias("timestamp"), F.col("anomaly_score").alias("anomalyScore"),
        F.lit(ANOMALY_TYPE).alias("type"), F.lit(source).alias("source"))


def to_predictions(predictions: DataFrame) -> DataFrame:
    return _keyed(prediction_rows(predictions))


def to_anomalies(predictions: DataFrame, source: str = "ml-scoring") -> DataFrame:
    return _keyed(anomaly_rows(predictions, source))


def to_notifications(alert_events: DataFrame, recipient: str = "system-admin") -> DataFrame:
    return alert_events.select(F.lit(recipient).alias("recipient"), "severity", "device_id", "message",
                               F.col("ts").alias("notified_ts"))


def enriched_records(featured: DataFrame) -> DataFrame:
    """Telemetry with rolling features in the nested shape of the enriched topic."""
    text = "string"
    return featured.select(
        F.col("device_id").alias("deviceId"), F.col("event_id").cast(text).alias("eventId"),
        F.col("timestamp" if "timestamp" in featured.columns else "ts").cast(text).alias("timestamp"),
        (F.col("status") if "status" in featured.columns else F.lit(None).cast(text)).alias("status"),
        F.struct("temperature", "humidity", "vibration",
                 *[(F.col(c) if c in featured.columns else F.lit(None).cast(text)).alias(out)
                   for c, out in (("device_type", "deviceType"), ("device_location", "deviceLocation"))])
        .alias("enrichedData"),
        F.struct("temp_mean", "temp_std", "temp_min", "temp_max", "temp_range", "hum_mean", "hum_std",
                 "vib_mean", "vib_std", "event_count", "trend").alias("sparkFeatures"))


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV files with headers; a field with a comma, quote or line break is quoted, quotes doubled."""
    rows.write.mode("append").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", True).option("nullValue", "\\N").csv(path))  # a quoted empty text is no null
