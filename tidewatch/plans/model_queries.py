"""Training, scoring and the model registry."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import features, iforest, percentile, registry, scoring, training
from tidewatch.plans.registry import query
from tidewatch.plans.views import LITERAL_LIMIT, Domain
from tidewatch.session import scratch_dir


def _train(d: Domain) -> training.Model:
    return training.train(d.spark, features.prepare_for_ml(d.lake), "eventId", scratch_dir(d.spark, "model"))


@lru_cache(maxsize=8)
def _trained(spark: SparkSession, application: str, folder: str) -> training.Model:
    return _train(Domain(spark, folder))


def stored_model(d: Domain) -> training.Model:
    """The model of a folder, trained on first use in an application and then read from its table."""
    return _trained(d.spark, d.spark.sparkContext.applicationId, d.folder)


@query("""SELECT CAST(t AS integer) AS tree, CAST(least(256, (SELECT count(*) FROM readings)) AS integer) AS rows, true AS grown
FROM range(100) AS r(t)""")
def iforest_train(d: Domain) -> DataFrame:
    """Trains anew; per tree the rows at its root, and whether its leaves hold just these and none is too deep."""
    nodes = _train(d).nodes
    leaf, depth = F.col("feature") < 0, F.floor(F.log2("node"))
    per_tree = nodes.groupBy("tree").agg(F.max(F.when(F.col("node") == 1, F.col("rows"))).alias("rows"),
                                         F.sum(F.when(leaf, F.col("rows"))).alias("held"), F.max(depth).alias("deepest"))
    return per_tree.select("tree", "rows", ((F.col("held") == F.col("rows")) & (F.col("deepest") <= 8)).alias("grown"))


@query("SELECT device_id, event_id, if_score, if_flag FROM forest_flagged")
def iforest_score(d: Domain) -> DataFrame:
    """Scores of a small forest that SQL can walk as well."""
    scored = iforest.score(scoring.telemetry_features(d.readings), d.literal_forest, scoring.model_columns()[:3], LITERAL_LIMIT)
    return scored.select("device_id", "event_id", "if_score", "if_flag")


@query("SELECT device_id, event_id, false AS is_anomaly, CAST(0.0 AS double) AS score FROM readings")
def score_default(d: Domain) -> DataFrame:
    scored = iforest.score(d.readings, None, [], iforest.DEFAULT_MODEL_THRESHOLD)
    return scored.select("device_id", "event_id", F.col("if_flag").alias("is_anomaly"), F.col("if_score").alias("score"))


@query("""SELECT version, (SELECT count(*) FROM readings) AS samples, 18 AS feature_count
FROM (VALUES ('20240101_000000'), ('20240102_000000')) AS v(version)""")
def model_registry_append(d: Domain) -> DataFrame:
    model = stored_model(d)
    path = scratch_dir(d.spark, "registry")
    for version in ("20240101_000000", "20240102_000000"):
        registry.register(d.spark, path, version, model.columns, model.metrics)
    return registry.read_registry(d.spark, path).select("version", "samples", "feature_count")


@query("""SELECT CASE WHEN regexp_full_match(version, '[A-Za-z0-9_\\-]+') THEN version END AS version,
  CASE WHEN regexp_full_match(version, '[A-Za-z0-9_\\-]+') THEN threshold ELSE -0.05 END AS threshold
FROM model_runs ORDER BY trained_at DESC LIMIT 1""")
def model_latest(d: Domain) -> DataFrame:
    return registry.latest_model(d.model_runs)


@query("""SELECT device_id, event_id, zscore_flag, trend_flag, max_zscore, true AS consistent FROM detected""")
def score_events(d: Domain) -> DataFrame:
    """The trained ensemble on every event: the votes SQL can give, and whether the decision follows from all three."""
    model = stored_model(d)
    scored = scoring.score_events(d.readings, model.nodes, model.threshold)
    votes = 2 * F.col("if_flag").cast("int") + F.col("zscore_flag").cast("int") + F.col("trend_flag").cast("int")
    follows = ((F.col("votes") == votes) & (F.col("is_anomaly") == (votes >= 2)) & (F.col("anomaly_score") == F.col("if_score"))
               & ((F.col("severity") == "NORMAL") == (votes == 0)))
    return scored.select("device_id", "event_id", "zscore_flag", "trend_flag", "max_zscore", follows.alias("consistent"))


@query("""SELECT max(trained_at) AS last_train, (SELECT max(CAST(epoch(ts) AS bigint)) FROM readings) - max(trained_at) >= 24 * 3600 AS due
FROM model_runs""")
def retrain_due(d: Domain) -> DataFrame:
    now = d.readings.agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("now")).scalar()
    return registry.retrain_due(d.model_runs, now, enabled=True, interval_hours=24)


@query("SELECT seq, version FROM model_runs WHERE regexp_full_match(version, '[A-Za-z0-9_\\-]+')")
def version_guard(d: Domain) -> DataFrame:
    return registry.valid_versions(d.model_runs).select("seq", "version")


@query("SELECT count(*) AS samples, 18 AS feature_count, true AS five_percent FROM readings")
def train_metrics(d: Domain) -> DataFrame:
    """The threshold is the 5th percentile, so that about 5 % of the training rows are below it."""
    near = F.abs(F.col("flagged_pct") - 5) <= 1 + 200 / F.col("samples")
    return stored_model(d).metrics.select("samples", "feature_count", near.alias("five_percent"))


@query("SELECT round(quantile_cont(temperature, 0.05), 8) AS threshold FROM readings")
def percentile_threshold(d: Domain) -> DataFrame:
    return percentile.threshold(d.readings, "temperature").select(F.round("threshold", 8).alias("threshold"))
