"""Rolling features, feature preparation, timestamps."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.timestamps import display_ts, normalize_ts
from tidewatch.operators import features, ingest

READING = "device_id string, event_id int, ts int, temperature double, humidity double, vibration double"


def readings(spark, temps, device="d1", hum=None, vib=None):
    return spark.createDataFrame(
        [(device, i, i, t, hum[i] if hum else 50.0, vib[i] if vib else 0.01) for i, t in enumerate(temps)], READING)


def last(df):
    return df.orderBy(F.col("ts").desc()).first()


def roll(spark, temps, **kw):
    return last(features.rolling_features(readings(spark, temps, **kw), 5))


def test_single_reading(spark):
    r = roll(spark, [17.5])
    assert (r.temp_mean, r.temp_std, r.trend, r.event_count) == (17.5, 0.0, "stable", 1)


def test_no_readings(spark):
    assert features.rolling_features(readings(spark, [1.0]).where("false"), 5).count() == 0


def test_statistics(spark):
    r = roll(spark, [-4.0, 7.0, 31.5, 2.5])
    assert r.temp_mean == 9.25 and r.temp_std == pytest.approx(math.sqrt(sum((x - 9.25) ** 2 for x in (-4.0, 7.0, 31.5, 2.5)) / 4))
    assert (r.temp_min, r.temp_max, r.temp_range) == (-4.0, 31.5, 35.5)
    assert roll(spark, [3.0] * 3, hum=[41.0, 44.0, 53.0]).hum_mean == 46.0
    assert roll(spark, [3.0] * 3, vib=[0.11, 0.25, 0.12]).vib_mean == pytest.approx(0.16)


@pytest.mark.parametrize("temps,trend", [([-3, -1], "increasing"), ([9, 2], "decreasing"), ([6, 6], "stable"),
                                         ([1, 8, 64, 63], "decreasing"), ([40, 3, 3.5], "increasing")])
def test_trend(spark, temps, trend):
    assert roll(spark, [float(t) for t in temps]).trend == trend


def test_oldest_reading_is_evicted(spark):
    r = roll(spark, [-9.0, 12.0, 4.0, 8.0, 33.0, 5.0, 6.0])
    assert (r.event_count, r.temp_min, r.temp_max) == (5, 4.0, 33.0)


def test_devices_are_isolated(spark):
    both = readings(spark, [71.0, 73.0]).unionByName(readings(spark, [14.0], device="d2"))
    got = {r.device_id: r.temp_mean for r in features.rolling_features(both, 5).orderBy("ts").collect()}
    assert got == {"d1": 72.0, "d2": 14.0}


def test_null_reading_counts_as_zero(spark):
    r = roll(spark, [None])
    assert (r.temperature, r.temp_mean) == (0.0, 0.0)


def test_null_struct_is_filled(spark):
    schema = "deviceId string, enrichedData struct<temperature: double, humidity: double, vibration: double, " \
             "deviceType: string, deviceLocation: string>"
    df = spark.createDataFrame([("a", None), ("b", (1.0, None, None, "probe", None))], schema)
    got = {r.deviceId: tuple(r.enrichedData) for r in ingest.fill_readings(df).collect()}
    assert got == {"a": (0.0, 0.0, 0.0, None, None), "b": (1.0, 0.0, 0.0, "probe", None)}


def lake(spark, temps, stamps=None):
    rows = [("d1", stamps[i] if stamps else f"2026-01-01T00:0{i}:00Z", t) for i, t in enumerate(temps)]
    return spark.createDataFrame(rows, "deviceId string, timestamp string, `enrichedData.temperature` double")


def test_temperature_is_clipped(spark):
    assert features.validate(lake(spark, [200.0])).first()["enrichedData.temperature"] == 150.0
    assert features.validate(lake(spark, [-200.0])).first()["enrichedData.temperature"] == -50.0
    assert features.validate(lake(spark, [None])).first()["enrichedData.temperature"] == 0.0


def test_rows_without_device_or_time_are_dropped(spark):
    df = spark.createDataFrame([("a", None, 1.0), (None, "2026-01-01", 1.0), ("b", "2026-01-01", 1.0)],
                               "deviceId string, timestamp string, `enrichedData.temperature` double")
    assert [r.deviceId for r in features.validate(df).collect()] == ["b"]


def test_rolling_std_of_the_sample(spark):
    one = features.prepare_for_ml(lake(spark, [25.0])).first()
    assert one["feat_temperature_rolling_std_5"] == 0.0
    three = features.prepare_for_ml(lake(spark, [24.0, 25.0, 26.0])).orderBy(F.col("timestamp").desc()).first()
    assert three["feat_temperature_rolling_std_5"] == pytest.approx(1.0)
    assert three["feat_temperature_delta"] == 1.0


def test_no_feature_columns_give_nothing(spark):
    assert features.prepare_for_ml(lake(spark, [1.0]).drop("enrichedData.temperature")).count() == 0


def test_all_columns_become_features_on_request(spark):
    df = lake(spark, [1.0]).withColumn("enrichedData.deviceType", F.lit("probe"))
    narrow, wide = features.prepare_for_ml(df), features.prepare_for_ml(df, all_columns=True)
    assert len(features.features_only(narrow).columns) == 6
    assert len(features.features_only(wide).columns) == 12
    assert wide.first()["enrichedData.deviceType"] == 0.0


def test_features_only(spark):
    df = lake(spark, [1.0]).withColumns({"feat_x": F.lit(1), "other": F.lit(2)})
    assert features.features_only(df).columns == ["enrichedData.temperature", "feat_x"]


@pytest.mark.parametrize("raw,want", [
    ("2026-04-07T11:44:23Z", dt.datetime(2026, 4, 7, 11, 44, 23)),
    ("2026-04-07T13:44:23+02:00", dt.datetime(2026, 4, 7, 11, 44, 23)),
    ("2026-04-07T11:44:23", dt.datetime(2026, 4, 7, 11, 44, 23)),
    ("2026-04-07", dt.datetime(2026, 4, 7)),
    ("1775562669731", dt.datetime(2026, 4, 7, 11, 51, 9, 731000)),
    ("1.7755626697E9", dt.datetime(2026, 4, 7, 11, 51, 9, 700000)),
    ("junk", None), ("12:30", None), ("1e300", None), (None, None)])
def test_normalize_ts(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string").select(normalize_ts(F.col("raw")).cast("timestamp_ntz").alias("t"))
    assert df.first().t == want


def test_timestamps_without_zone_are_utc_in_any_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2026-04-07T11:44:23",)], "raw string")
        assert df.select(F.unix_seconds(normalize_ts(F.col("raw"))).alias("s")).first().s == 1775562263
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_display_ts_keeps_other_text(spark):
    df = spark.createDataFrame([("junk",), ("1775562669731",)], "raw string").select(display_ts(F.col("raw")).alias("t"))
    assert [r.t for r in df.collect()] == ["junk", "2026-04-07T11:51:09.731000Z"]


def test_rolling_features_against_plain_python(spark):
    rng = random.Random(9)
    rows = [(f"d{rng.randrange(7)}", i, rng.randrange(100), rng.uniform(0, 99), 1.0, 2.0) for i in range(500)]
    got = {r.event_id: r for r in features.rolling_features(spark.createDataFrame(rows, READING).repartition(5)).collect()}
    by_device = {}
    for device, event, _, temp, _, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        window = by_device.setdefault(device, [])
        window.append(temp)
        recent = window[-20:]
        mean = sum(recent) / len(recent)
        std = math.sqrt(sum((x - mean) ** 2 for x in recent) / len(recent))
        r = got[event]
        assert (r.temp_mean, r.temp_std) == (pytest.approx(mean), pytest.approx(std, abs=1e-9))
        assert (r.temp_min, r.temp_max, r.event_count) == (min(recent), max(recent), len(recent))
