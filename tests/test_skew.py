"""Splitting of hot keys must not change results."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.devices import apply_device_changes, judge_changes
from tidewatch.operators.features import prepare_for_ml, rolling_features
from tidewatch.operators.lookup import lookup_join
from tidewatch.operators.ordered import newest_per_key, ordered_window
from tidewatch.operators.percentile import exact_percentile


def skewed(spark, rows=3000, hot_share=0.4, seed=1):
    """A third of the rows and more on one device; many equal times, some null."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        device = "hot" if rng.random() < hot_share else f"d{rng.randrange(40)}"
        t = None if rng.random() < 0.02 else rng.randrange(300)
        data.append((device, i, t, rng.uniform(0, 100), rng.uniform(0, 100), rng.random()))
    return spark.createDataFrame(data, "device_id string, event_id bigint, ts bigint, temperature double, "
                                       "humidity double, vibration double").repartition(6)


def same(a, b):
    cols = [f"`{c}`" for c in sorted(a.columns)]
    left = sorted(map(repr, a.select(*cols).collect()))
    right = sorted(map(repr, b.select(*cols).collect()))
    assert left == right


def rounded(df):
    return df.withColumns({c: F.round(f"`{c}`", 8) for c, t in df.dtypes if t == "double"})


@pytest.mark.parametrize("limit", [1, 50])
def test_rolling_features_on_a_split_key(spark, limit):
    df = skewed(spark)
    same(rounded(rolling_features(df, group_rows=limit)), rounded(rolling_features(df, group_rows=10 ** 9)))


def test_split_groups_stay_small(spark):
    df = skewed(spark)
    sizes = []

    def columns(w):
        sizes.append(w)
        return {"group": F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))}
    out = ordered_window(df, "device_id", ["ts", "event_id"], 19, columns, group_rows=100)
    assert out.count() == 3000
    assert out.agg(F.max("group")).first()[0] < 500  # against 1200 rows of the hot device


def test_prepare_for_ml_on_a_split_key(spark):
    df = skewed(spark).select(F.col("device_id").alias("deviceId"), F.col("event_id").alias("eventId"),
                              F.col("ts").alias("timestamp"), F.col("temperature").alias("enrichedData.temperature"),
                              F.col("vibration").alias("enrichedData.vibration"))
    same(rounded(prepare_for_ml(df, group_rows=60)), rounded(prepare_for_ml(df, group_rows=10 ** 9)))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(limit=st.integers(1, 30), seed=st.integers(0, 10 ** 6), lookback=st.integers(1, 25))
def test_any_lookback_on_a_split_key(spark, limit, seed, lookback):
    df = skewed(spark, rows=200, seed=seed)

    def columns(w):
        return {"s": F.sum("event_id").over(w.rowsBetween(-lookback, 0)), "p": F.lag("event_id", lookback).over(w)}
    order = ["ts", "event_id"]
    same(ordered_window(df, "device_id", order, lookback, columns, group_rows=limit),
         ordered_window(df, "device_id", order, lookback, columns, group_rows=10 ** 9))


def change_log(spark, seed=3, rows=600):
    rng = random.Random(seed)
    ops = ["create", "delete", "simulate", "locate", "locate", "simulate"]
    data = []
    for i in range(rows):
        op = rng.choice(ops)
        device = "hot" if rng.random() < 0.5 else f"d{rng.randrange(20)}"
        lat = rng.uniform(0, 9) if op in ("create", "locate") and rng.random() < 0.7 else None
        data.append((i, op, device, "t%d" % rng.randrange(9) if op == "create" else None,
                     rng.random() < 0.5 if op == "simulate" else None, lat, lat))
    log = spark.createDataFrame(data, "seq bigint, op string, device_id string, type string, simulated boolean, "
                                      "latitude double, longitude double")
    devices = spark.createDataFrame([(i, f"d{i}", "old", "INACTIVE", False, 1.0, 2.0) for i in range(0, 30, 2)],
                                    "id bigint, device_id string, type string, status string, simulated boolean, "
                                    "latitude double, longitude double")
    return data, log, devices


def replay(data, devices):
    """The change log applied one by one."""
    table = {r.device_id: [r.type, r.status, r.simulated, r.latitude, r.longitude] for r in devices.collect()}
    rejected = []
    for seq, op, dev, type_, sim, lat, lng in data:
        if (op == "create") == (dev in table):
            rejected.append(seq)
        elif op == "create":
            table[dev] = [type_, "ACTIVE", bool(sim), lat, lng]
        elif op == "delete":
            del table[dev]
        elif op == "simulate":
            table[dev][2] = sim
        else:
            table[dev][3:] = [lat, lng]
    return table, rejected


@pytest.mark.parametrize("limit", [1, 20, 10 ** 9])
def test_change_log_equals_its_replay(spark, limit):
    data, log, devices = change_log(spark)
    table, rejected = replay(data, devices)
    judged = judge_changes(devices, log, group_rows=limit)
    assert sorted(r.seq for r in judged.where(~F.col("accepted")).collect()) == rejected
    after = {r.device_id: [r.type, r.status, r.simulated, r.latitude, r.longitude]
             for r in apply_device_changes(devices, log, group_rows=limit).collect()}
    assert after == table


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("copies", [1, 3])
def test_lookup_join_on_hot_keys(spark, how, copies):
    df = skewed(spark).withColumn("device_id", F.when(F.col("event_id") % 50 != 0, F.col("device_id")))
    table = spark.createDataFrame([(d, f"{d}-{c}") for d in ["hot"] + [f"d{i}" for i in range(0, 40, 3)]
                                   for c in range(copies)], "device_id string, info string")
    plain = df.join(table, "device_id", how)
    same(lookup_join(df, table, "device_id", how, group_rows=100, broadcast_bytes=-1), plain)
    same(lookup_join(df, table, "device_id", how, group_rows=10 ** 9, broadcast_bytes=-1), plain)
    same(lookup_join(df, table, "device_id", how, broadcast_bytes=1 << 62), plain)


def test_newest_per_key(spark):
    df = skewed(spark).where("ts is not null")
    got = {(r.device_id, r["rank"]): r.event_id for r in newest_per_key(df, "device_id", ["ts", "event_id"], 5).collect()}
    rows = sorted(((r.device_id, r.ts, r.event_id) for r in df.collect()), reverse=True)
    want, seen = {}, {}
    for device, _, event in rows:
        seen[device] = seen.get(device, 0) + 1
        if seen[device] <= 5:
            want[device, seen[device]] = event
    assert got == want


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.999, 1.0])
@pytest.mark.parametrize("limit", [1, 40, 10 ** 6])
def test_exact_percentile(spark, p, limit):
    import numpy as np
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(500)] + [0.25] * 300 + [1e9, -1e9, 5e-324]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert exact_percentile(df, "x", p, limit) == pytest.approx(float(np.percentile(values, p * 100)), rel=1e-9)


def test_percentile_of_nothing(spark):
    assert exact_percentile(spark.createDataFrame([], "x double"), "x", 0.05) is None
