"""Training as a batch job: features, forest, threshold, registry row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import iforest
from tidewatch.operators.features import features_only, prepare_for_ml
from tidewatch.operators.percentile import exact_percentile
from tidewatch.operators.registry import register
from tidewatch.operators.scoring import train_metrics


@dataclass(frozen=True)
class Model:
    nodes: DataFrame
    columns: list[str]
    threshold: float
    metrics: DataFrame


def train(spark: SparkSession, prepared: DataFrame, id_col: str, folder: str,
          trees: int = iforest.TREES, seed: int = iforest.SEED) -> Model:
    """Train on prepared features and store the nodes below ``folder``, a shared path.

    The stored table cuts the lineage: scoring reads the trees instead of growing them again.
    The threshold is the exact 5th percentile of the training scores.
    """
    columns = features_only(prepared).columns
    prepared.write.parquet(f"{folder}/prepared")  # read by the sampling and by the scoring of all rows
    prepared = spark.read.schema(prepared.schema).parquet(f"{folder}/prepared")
    iforest.fit(prepared, id_col, columns, trees=trees, seed=seed).write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    scored = (iforest.score(prepared, nodes, columns, 0.0, rounded=False)
              .select(F.col("if_score").alias("score")))
    scored.write.parquet(f"{folder}/training_scores")
    scored = spark.read.parquet(f"{folder}/training_scores")
    threshold = exact_percentile(scored, "score", iforest.THRESHOLD_PERCENTILE)
    return Model(nodes, columns, threshold, train_metrics(scored, threshold, len(columns)))


def train_and_register(spark: SparkSession, prepared: DataFrame, id_col: str, folder: str,
                       registry: str, version: str) -> Model:
    model = train(spark, prepared, id_col, f"{folder}/{version}")
    register(spark, registry, version, model.columns, model.metrics)
    return model


def train_from_lake(spark: SparkSession, lake: DataFrame, folder: str, registry: str, version: str,
                    since_day: str | None = None) -> Model:
    """Train on the lake, or on its days from ``since_day`` on, and register the model as the current one."""
    if since_day is not None:
        lake = lake.where(F.col("day") >= F.lit(since_day).cast(lake.schema["day"].dataType))
    return train_and_register(spark, prepare_for_ml(lake), "eventId", folder, registry, version)
