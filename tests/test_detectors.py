"""Detectors, votes, reasons, forest, registry."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import iforest, registry, scoring, training
from tidewatch.operators.features import rolling_features
from tidewatch.session import scratch_dir

EVENT = "temperature double, humidity double, vibration double"
STATS = "temp_mean double, temp_std double, hum_mean double, hum_std double, vib_mean double, vib_std double"


def z(spark, reading, stats=None, limit=3.0):
    schema, row = EVENT, tuple(reading)
    if stats is not None:
        schema, row = f"{EVENT}, {STATS}", row + tuple(stats)
    r = scoring.with_zscore(spark.createDataFrame([row], schema), limit).first()
    return r.max_zscore, r.zscore_flag


def test_zscore(spark):
    base = (25.0, 2.0, 50.0, 5.0, 0.01, 0.005)
    assert z(spark, (35.0, 50.0, 0.01), base) == (5.0, True)
    assert z(spark, (25.0, 80.0, 0.01), base) == (6.0, True)
    assert z(spark, (25.0, 50.0, 0.025), base)[0] == 3.0
    assert z(spark, (100.0, 50.0, 0.01), (25.0, 0.0, 50.0, 0.0, 0.01, 0.0)) == (0.0, False)
    assert z(spark, (100.0, 50.0, 0.01)) == (0.0, False)
    assert z(spark, (None, None, None), (None,) * 6) == (0.0, False)
    assert z(spark, (30.0, 50.0, 0.01), base, 2.0) == (2.5, True)
    assert z(spark, (30.0, 50.0, 0.01), base, 5.0) == (2.5, False)


@pytest.mark.parametrize("n,want", [(9, (2.828, False)), (11, (3.162, True))])
def test_spike_needs_a_long_window(spark, n, want):
    rows = [("d", i, i, 100.0 if i == n - 1 else 20.0, 0.0, 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, "device_id string, event_id int, ts int, " + EVENT)
    r = scoring.with_zscore(rolling_features(df)).orderBy(F.col("ts").desc()).first()
    assert (r.max_zscore, r.zscore_flag) == want


@pytest.mark.parametrize("trend,std,value_range,want", [
    ("increasing", 8.0, 15.0, True), ("increasing", 5.0, 15.0, False), ("increasing", 8.0, 10.0, False),
    ("stable", 10.0, 20.0, False), ("decreasing", 10.0, 20.0, False), (None, 10.0, 20.0, False),
    ("increasing", None, None, False)])
def test_trend_flag(spark, trend, std, value_range, want):
    df = spark.createDataFrame([(trend, std, value_range)], "trend string, temp_std double, temp_range double")
    assert scoring.with_trend_flag(df).first().trend_flag is want


def test_trend_without_features(spark):
    assert scoring.with_trend_flag(spark.range(1)).first().trend_flag is False


def decide(spark, isolation, zscore, trend, score=-0.1):
    df = spark.createDataFrame([(isolation, score, zscore, 3.5, trend, "increasing", 8.1234, 15.5)],
                               "if_flag boolean, if_score double, zscore_flag boolean, max_zscore double, "
                               "trend_flag boolean, trend string, temp_std double, temp_range double")
    return scoring.with_decision(df).first()


@pytest.mark.parametrize("votes,want", [
    ((False, False, False), (False, "NORMAL")), ((False, True, False), (False, "LOW")),
    ((False, False, True), (False, "LOW")), ((True, False, False), (True, "HIGH")),
    ((False, True, True), (True, "HIGH")), ((True, True, False), (True, "HIGH")), ((True, True, True), (True, "CRITICAL"))])
def test_votes(spark, votes, want):
    r = decide(spark, *votes)
    assert (r.is_anomaly, r.severity) == want


def test_reasons(spark):
    assert decide(spark, False, False, False).reason == "All models nominal"
    assert decide(spark, True, True, True).reason == (
        "Isolation Forest score -0.100 below threshold; Z-score 3.5σ exceeds 3σ threshold; "
        "Rapidly increasing temperature (range 15.5°C, σ=8.123°C)")
    assert decide(spark, True, False, False, -0.0003).reason == "Isolation Forest score -0.000 below threshold"


def cloud(spark, n=3000):
    """Points around the origin and one far away."""
    df = spark.range(n).select("id", F.randn(1).alias("a"), F.randn(2).alias("b"), F.lit(1.0).alias("same"))
    far = spark.createDataFrame([(n, 40.0, -40.0, 1.0)], "id bigint, a double, b double, same double")
    path = scratch_dir(spark, "cloud")
    df.unionByName(far).write.parquet(path)
    return spark.read.parquet(path)


def test_forest(spark):
    df, columns = cloud(spark), ["a", "b", "same"]
    one = iforest.fit(df.coalesce(1), "id", columns).orderBy("tree", "node").collect()
    many = iforest.fit(df.repartition(8), "id", columns).orderBy("tree", "node").collect()
    assert one == many
    roots = [r for r in one if r.node == 1]
    assert len(roots) == 100 and all(r.rows == 256 for r in roots)
    assert max(r.node for r in one) < 512
    assert all(r.feature != 2 for r in one)  # a constant column is never split
    nodes = spark.createDataFrame(one, iforest.NODES)
    scored = iforest.score(df, nodes, columns, 0.0, rounded=False)
    scores = {r.id: r.if_score for r in scored.collect()}
    assert all(-0.5 <= s < 0.5 for s in scores.values())
    assert min(scores, key=scores.get) == 3000


def test_forest_on_few_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id bigint, a double")
    nodes = iforest.fit(df, "id", ["a"], trees=5)
    assert {r.rows for r in nodes.where("node = 1").collect()} == {10}
    assert iforest.score(df, nodes, ["a", "absent"], 0.0).count() == 10
    with pytest.raises(ValueError):
        iforest.fit(df.where("false"), "id", ["a"])


def test_narrow_range_still_splits():
    import numpy as np
    x = np.array([[1.0], [np.nextafter(1.0, 2.0)]])
    for seed in range(20):
        nodes = iforest._grow(x, np.random.default_rng(seed), 8)
        assert sorted(n[3] for n in nodes) == [1, 1, 2]


def test_sampling_large_tables_uses_few_tickets(spark):
    df = spark.range(300_000).withColumn("a", F.rand(3))
    sample = iforest.tree_samples(df, "id", 300_000, trees=20, tree_rows=64)
    counts = [r["count"] for r in sample.groupBy("tree").count().collect()]
    assert counts == [64] * 20


def test_training_and_registry(spark):
    df = cloud(spark).select("id", F.col("a").alias("feat_a"), F.col("b").alias("feat_b"))
    folder, path = scratch_dir(spark, "model"), scratch_dir(spark, "registry")
    model = training.train_and_register(spark, df, "id", folder, path, "20240101_000000")
    training.train_and_register(spark, df, "id", folder, path, "20240102_000000")
    m = model.metrics.first()
    assert (m.samples, m.feature_count) == (3001, 2)
    assert m.flagged_pct == pytest.approx(5.0, abs=0.2)
    row = registry.latest_model(registry.read_registry(spark, path)).first()
    assert (row.version, row.threshold) == ("20240102_000000", model.threshold)


@pytest.mark.parametrize("version,safe", [("20240101_1", True), ("v-1_B", True), ("../up", False), ("a b", False),
                                          ("a;b", False), ("", False)])
def test_version_guard(spark, version, safe):
    reg = spark.createDataFrame([(version, 1, -0.2)], "version string, trained_at bigint, threshold double")
    assert registry.valid_versions(reg).count() == int(safe)
    row = registry.latest_model(reg).first()
    assert (row.version, row.threshold) == ((version, -0.2) if safe else (None, -0.05))


def test_no_model(spark):
    empty = spark.createDataFrame([], "version string, trained_at bigint, threshold double")
    assert tuple(registry.latest_model(empty).first()) == (None, -0.05)
    r = iforest.score(spark.range(1), None, [], -0.05).first()
    assert (r.if_flag, r.if_score) == (False, 0.0)


def test_retrain_due(spark):
    reg = spark.createDataFrame([("v", 1000, 0.0)], "version string, trained_at bigint, threshold double")

    def due(table, now, enabled=True):
        return registry.retrain_due(table, F.lit(now), enabled, 1.0).first().due
    assert due(reg, 1000 + 3600) and not due(reg, 1000 + 3599)
    assert not due(reg, 10 ** 6, enabled=False)
    assert due(reg.where("false"), 0)


def test_anomaly_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "seq bigint, is_anomaly boolean")
    assert tuple(scoring.anomaly_stats(empty).first()) == (0, 0, 0.0)


def test_default_device(spark):
    df = spark.createDataFrame([(None, 1, 1, 20.0, 1.0, 1.0)], "device_id string, event_id int, ts int, " + EVENT)
    assert scoring.score_events(df, None, default_device="req-1").first().device_id == "req-1"


def test_training_from_the_lake_takes_the_newest(spark, domain):
    folder, path = scratch_dir(spark, "model"), scratch_dir(spark, "registry")
    model = training.train_from_lake(spark, domain.lake, folder, path, "20240101_000000")
    assert model.columns == scoring.model_columns()[:3] + [c for c in model.columns if c.startswith("feat_")]
    row = registry.read_registry(spark, path).first()
    assert (row.samples, row.feature_count, row.threshold) == (domain.lake.count(), 18, model.threshold)
