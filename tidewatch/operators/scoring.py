"""Detector columns, the ensemble decision and summaries over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import detectors as d
from tidewatch.functions.readings import clip
from tidewatch.operators import iforest
from tidewatch.operators.features import (ML_WINDOW, STREAM_WINDOW, TEMPERATURE_RANGE, engineered_columns,
                                          rolling_columns)
from tidewatch.operators.ordered import ordered_window
from tidewatch.schemas import ENRICHED, SENSORS

HISTORY = 500
RECENT = 10


def with_zscore(df: DataFrame, limit: float = d.ZSCORE_LIMIT) -> DataFrame:
    """z per sensor, their maximum and the flag, which compares the unrounded maximum."""
    have = set(df.columns)

    def feature(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("double")

    raw = {"temperature": d.zscore(F.col("temperature"), feature("temp_mean"), feature("temp_std")),
           "humidity": d.zscore(F.col("humidity"), feature("hum_mean"), feature("hum_std")),
           "vibration": d.zscore(F.col("vibration"), feature("vib_mean"), feature("vib_std"))}
    out = df.withColumns({f"_z_{s}": z for s, z in raw.items()})
    out = out.withColumn("_z", F.greatest(*[f"_z_{s}" for s in raw]))
    return out.withColumns({**{f"z_{s}": F.round(f"_z_{s}", 3) for s in raw},
                            "max_zscore": F.round("_z", 3), "zscore_flag": F.col("_z") > limit}
                           ).drop("_z", *[f"_z_{s}" for s in raw])


def with_trend_flag(df: DataFrame, std_limit: float = d.TREND_STD_LIMIT,
                    range_limit: float = d.TREND_RANGE_LIMIT) -> DataFrame:
    if "trend" not in df.columns:  # scored without stream features
        return df.withColumns({"trend": F.lit("stable"), "temp_std": F.lit(0.0), "temp_range": F.lit(0.0),
                               "trend_flag": F.lit(False)})
    return df.withColumn("trend_flag", d.trend_flag(F.col("trend"), F.col("temp_std"), F.col("temp_range"),
                                                    std_limit, range_limit))


def with_decision(df: DataFrame) -> DataFrame:
    """Votes, anomaly flag, severity and reason from the three models' flags."""
    n = d.votes(F.col("if_flag"), F.col("zscore_flag"), F.col("trend_flag"))
    out = df.withColumn("votes", n)
    return out.withColumns({
        "is_anomaly": F.col("votes") >= d.VOTES_FOR_ANOMALY,
        "anomaly_score": F.col("if_score"),
        "severity": d.severity(F.col("votes")),
        "reason": d.reason(F.col("if_flag"), F.col("if_score"), F.col("zscore_flag"), F.col("max_zscore"),
                           F.col("trend_flag"), F.col("trend"), F.col("temp_std"), F.col("temp_range")),
    })


def ensemble(df: DataFrame) -> DataFrame:
    """All detector columns and the decision; ``if_flag`` and ``if_score`` must be there."""
    return with_decision(with_trend_flag(with_zscore(df)))


def explain(df: DataFrame) -> DataFrame:
    """The decision as one nested record."""
    return df.select(
        "device_id", "event_id", F.col("is_anomaly").alias("anomaly"), "severity", "reason",
        F.struct(F.col("if_score").alias("isolation"), F.col("max_zscore").alias("zscore"),
                 F.col("trend_flag").alias("trend")).alias("scores"),
        F.struct(F.col("if_score").alias("isolation_score"),
                 F.struct(*[F.col(f"z_{s}").alias(s) for s in SENSORS]).alias("zscore_breakdown"),
                 F.struct("trend", F.round("temp_std", 3).alias("temp_std"),
                          F.round("temp_range", 3).alias("temp_range")).alias("trend_info")).alias("features"),
        "is_anomaly", "anomaly_score")


def to_response(df: DataFrame, threshold: Column) -> DataFrame:
    label = F.when(F.col("is_anomaly"), "ANOMALY").otherwise("NORMAL")
    return df.select("device_id", "event_id", label.alias("prediction"), "anomaly_score",
                     threshold.alias("threshold"), "severity")


def telemetry_features(events: DataFrame, group_rows: int | None = None,
                       order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Stream features and model features of telemetry events from one sort per device."""
    ml = {s: F.coalesce(s, F.lit(0.0)) for s in SENSORS}
    filled = events.withColumns({**ml, **{ENRICHED + s: clip(v, *TEMPERATURE_RANGE) if s == "temperature" else v
                                          for s, v in ml.items()}})
    inputs = [ENRICHED + s for s in SENSORS]
    return ordered_window(filled, "device_id", list(order), STREAM_WINDOW - 1,
                          lambda w: {**rolling_columns(w), **engineered_columns(inputs, w)},
                          group_rows=group_rows)


def model_columns() -> list[str]:
    """Features of the default model: the readings and their rolling values."""
    stats = [f"rolling_{s}_{ML_WINDOW}" for s in ("mean", "std", "min", "max")] + ["delta"]
    return [ENRICHED + s for s in SENSORS] + [f"feat_{s}_{x}" for s in SENSORS for x in stats]


def score_events(events: DataFrame, nodes: DataFrame | None,
                 threshold: float = iforest.DEFAULT_MODEL_THRESHOLD,
                 default_device: str | None = None) -> DataFrame:
    """The full ensemble over telemetry events, each on its own window.

    An event without a device takes ``default_device``, the device of the request.
    """
    if default_device is not None:
        events = events.withColumn("device_id", F.coalesce("device_id", F.lit(default_device)))
    scored = iforest.score(telemetry_features(events), nodes, model_columns(), threshold)
    drop = [c for c in scored.columns if c.startswith((ENRICHED, "feat_"))]
    return ensemble(scored.drop(*drop))


def prediction_history(predictions: DataFrame, n: int = HISTORY) -> DataFrame:
    return predictions.orderBy(F.col("seq").desc()).limit(n)


def anomaly_stats(predictions: DataFrame) -> DataFrame:
    """Counts over all the predictions given; filter them by time for the figures of a period."""
    rate = F.try_divide(F.col("anomaly_count") * F.lit(100.0), F.col("total_predictions"))
    return (predictions
            .agg(F.count(F.lit(1)).alias("total_predictions"), F.count_if("is_anomaly").alias("anomaly_count"))
            .withColumn("anomaly_rate", F.coalesce(F.round(rate, 1), F.lit(0.0))))


def anomalies_by_device(predictions: DataFrame) -> DataFrame:
    return predictions.where("is_anomaly").groupBy("device_id").agg(F.count(F.lit(1)).alias("anomalies"))


def affected_devices(predictions: DataFrame) -> DataFrame:
    return anomalies_by_device(predictions).agg(F.count(F.lit(1)).alias("affected_devices"))


def recent_anomalies(predictions: DataFrame, n: int = HISTORY, k: int = RECENT) -> DataFrame:
    """The newest ``k`` anomalies among the last ``n`` predictions."""
    return (prediction_history(predictions, n).where("is_anomaly")
            .orderBy(F.col("seq").desc()).limit(k))


def train_metrics(scored: DataFrame, threshold: float, feature_count: int) -> DataFrame:
    """Row count, mean score and flagged share of the training rows (``score`` unrounded)."""
    return scored.agg(
        F.count(F.lit(1)).alias("samples"), F.lit(feature_count).alias("feature_count"),
        F.avg("score").alias("avg_anomaly_score"),
        (F.count_if(F.col("score") < threshold) * F.lit(100.0) / F.greatest(F.count(F.lit(1)), F.lit(1)))
        .alias("flagged_pct"),
        F.lit(threshold).alias("threshold"))
