"""The model registry: one row per training, the newest being the current model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.iforest import DEFAULT_MODEL_THRESHOLD

# Fixed value: characters a version may have, as it becomes part of a path.
SAFE_VERSION = r"^[A-Za-z0-9_\-]+$"
REGISTRY = ("version string, trained_at timestamp, samples bigint, feature_count int, "
            "features array<string>, avg_anomaly_score double, flagged_pct double, threshold double")


def valid_versions(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("version").rlike(SAFE_VERSION))


def register(spark: SparkSession, path: str, version: str, features: list[str], metrics: DataFrame) -> None:
    """Append one row; ``metrics`` comes from ``train_metrics``."""
    row = metrics.select(F.lit(version).alias("version"), F.current_timestamp().alias("trained_at"),
                         F.col("samples").cast("bigint").alias("samples"),
                         F.col("feature_count").cast("int").alias("feature_count"),
                         F.array(*[F.lit(f) for f in features]).alias("features"),
                         "avg_anomaly_score", "flagged_pct", "threshold")
    row.coalesce(1).write.mode("append").parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(path)


def latest_model(registry: DataFrame, order: str = "trained_at") -> DataFrame:
    """One row: version and threshold of the newest model.

    With an unsafe version, or no model, the version is null and the threshold the default.
    """
    newest = registry.agg(F.max_by(F.struct("version", "threshold"), F.struct(order, "version")).alias("m"))
    safe = F.coalesce(F.col("m.version").rlike(SAFE_VERSION), F.lit(False))
    return newest.select(
        F.when(safe, F.col("m.version")).alias("version"),
        F.coalesce(F.when(safe, F.col("m.threshold")), F.lit(DEFAULT_MODEL_THRESHOLD)).alias("threshold"))


def retrain_due(registry: DataFrame, now: Column, enabled: bool, interval_hours: float,
                trained_at: str = "trained_at") -> DataFrame:
    """One row: due when enabled and never trained or the interval has passed. ``now`` and the
    training time are epoch seconds."""
    passed = (now - F.col("last")) >= interval_hours * 3600
    return (registry.agg(F.max(trained_at).alias("last"))
            .select(F.col("last").alias("last_train"),
                    (F.lit(enabled) & F.coalesce(passed, F.lit(True))).alias("due")))
