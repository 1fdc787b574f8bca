"""Ingest, rules, alerts, analytics."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.readings import json_number
from tidewatch.operators import alerts, analytics, ingest, processing
from tidewatch.session import scratch_dir
from tidewatch.sources.records import export_csv, read_csv

T0 = dt.datetime(2026, 1, 1, 12, 0, 0, 123456)


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, rule_name string, metric string, threshold double")


@pytest.mark.parametrize("payload,status", [
    ('{"temperature": 115}', "CRITICAL"), ('{"temperature": 115.5}', "CRITICAL"), ('{"temperature": 85}', "WARNING"),
    ('{"temperature": 80}', "NORMAL"), ('{"temperature": 100}', "WARNING"), ('{"temperature": 50}', "NORMAL"),
    ('{"temperature": "not-a-number"}', "NORMAL"), ('{"temperature": "115"}', "NORMAL"), ('{"temperature": "NaN"}', "NORMAL"),
    ('{"temperature": true}', "NORMAL"), ('{"temperature": null}', "NORMAL"), ('{"temperature": [115]}', "NORMAL"),
    ('{"temperature": 1e3}', "CRITICAL"), ("{}", "NORMAL"), ("NOT_JSON", "NORMAL"), (None, "NORMAL")])
def test_status(spark, payload, status):
    df = spark.createDataFrame([(payload,)], "payload string")
    r = rules(spark, (1, "r", "temperature", 100.0))
    assert processing.with_status(df, r, json_number(F.col("payload"), "temperature")).first().status == status


def test_threshold(spark):
    assert processing.threshold(rules(spark)).first().threshold == 100.0
    both = rules(spark, (1, "a", "temperature", 70.0), (2, "b", "temperature", 60.0), (3, "c", "humidity", 1.0))
    assert processing.threshold(both).first().threshold == 60.0


def test_rule_upsert(spark):
    changes = spark.createDataFrame([(1, "temperature", 55.0), (2, "temperature", 45.0), (1, "pressure", 9.0)],
                                    "seq int, metric string, threshold double")
    got = {r.metric: (r.rule_name, r.threshold)
           for r in processing.upsert_rules(rules(spark, (1, "a", "temperature", 70.0)), changes).collect()}
    assert got == {"temperature": ("a", 45.0), "pressure": ("Default Pressure Check", 9.0)}


def test_ingest(spark):
    df = spark.createDataFrame([("d1", '{"a":1}'), ("  ", '{"a":1}'), (None, '{"a":1}'), ("d1", "{}"), ("d1", None),
                                ("d1", "NOT_JSON"), ("d1", "[1]")], "device_id string, payload string")
    ok, rejected = ingest.validate_ingest(df)
    assert (ok.count(), rejected.count()) == (1, 6)


def test_envelope(spark):
    df = spark.createDataFrame([("d", None, None), ("d", "Own", T0)], "device_id string, event_type string, ts timestamp")
    now = F.lit(dt.datetime(2026, 2, 2))
    got = ingest.to_envelope(df, now).orderBy("event_type").collect()
    assert [(r.event_type, r.version, r.source_service) for r in got] == [
        ("DeviceTelemetryEvent", "1.0", "ingestion-service"), ("Own", "1.0", "ingestion-service")]
    assert got[0].ts == dt.datetime(2026, 2, 2) and got[1].ts == T0
    assert len({r.event_id for r in got}) == 2


def test_flatten_any_depth(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('b', 2, 'c', named_struct('d', 3)) AS s")
    assert ingest.flatten(df).columns == ["a", "s.b", "s.c.d"]


def test_duplicates_and_unknown_devices(spark):
    events = spark.createDataFrame([("e1", "d1", 1), ("e1", "d1", 2), ("e2", "ghost", 3)],
                                   "event_id string, device_id string, arrival int")
    devices = spark.createDataFrame([("d1", "probe")], "device_id string, type string")
    once = processing.dedup(events)
    assert sorted((r.event_id, r.arrival) for r in once.collect()) == [("e1", 1), ("e2", 3)]
    assert [r.device_type for r in processing.enrich(once, devices).collect()] == ["probe"]
    assert [r.event_id for r in processing.unknown_devices(once, devices).collect()] == ["e2"]
    own = once.withColumn("device_type", F.lit("claimed"))
    assert processing.enrich(own, devices).first().device_type == "probe"
    done = spark.createDataFrame([("e1",)], "event_id string")
    assert [r.event_id for r in processing.dedup(events, processed=done).collect()] == ["e2"]


def test_dead_letters(spark):
    raw = spark.createDataFrame(
        [('{"deviceId":"d1","payload":{"temperature":1}}', 1), ('{"deviceId":"d1","payload":null}', 2),
         ('{"deviceId":"ghost","payload":{}}', 3), ("NOT_JSON", 4), ('{"payload":{}}', 5), (None, 6)], "value string, offset int")
    devices = spark.createDataFrame([("d1",)], "device_id string")
    ok, dead = processing.split_dead_letters(raw, devices, "deviceId string, payload map<string, double>")
    assert [r.offset for r in ok.collect()] == [1]
    assert {r.offset: r.reason for r in dead.collect()} == {
        2: "null_payload", 3: "unknown_device", 4: "malformed", 5: "malformed", 6: "malformed"}


def processed(spark, *statuses):
    rows = [(f"e{i}", T0, "d1", s, (50.0, 1.0, 0.5, "probe")) for i, s in enumerate(statuses)]
    return spark.createDataFrame(rows, "original_event_id string, ts timestamp, device_id string, status string, enriched_data "
                                       "struct<temperature: double, humidity: double, vibration: double, deviceType: string>")


def test_alerts(spark):
    got = {r.severity: r for r in alerts.raise_alerts(processed(spark, "CRITICAL", "WARNING", "NORMAL", None)).collect()}
    assert set(got) == {"HIGH", "MEDIUM"}
    assert got["HIGH"].message == ("CRITICAL condition detected for device d1. Data: "
                                   "{deviceType=probe, humidity=1.0, temperature=50.0, vibration=0.5}")
    assert not got["HIGH"].acknowledged


def test_alert_ids_repeat_on_replay(spark):
    first, again = (alerts.raise_alerts(processed(spark, "CRITICAL", "WARNING")).select("id").collect() for _ in range(2))
    assert first == again and len(set(first)) == 2


ALERT = "id int, device_id string, severity string, message string, ts timestamp, acknowledged boolean"


def some_alerts(spark):
    return spark.createDataFrame([(1, "d1", "HIGH", 'He said "hi", twice\nover', T0, False), (2, "d2", "MEDIUM", None, T0, True),
                                  (3, "d1", "HIGH", "plain", T0 + dt.timedelta(hours=1), False)], ALERT)


def test_alert_views(spark):
    df = some_alerts(spark)
    assert [r.id for r in alerts.alerts_sorted(df).collect()] == [3, 2, 1]
    assert [r.id for r in alerts.recent_pending(df).collect()] == [3, 1]
    assert [r.id for r in alerts.recent_alerts(df, 1).collect()] == [3]
    assert alerts.filter_alerts(df, "HIGH", "acknowledged").count() == 0
    assert alerts.filter_alerts(df).count() == 3
    assert alerts.pending_count(df).first().pending == 2


def test_acknowledge(spark):
    df = some_alerts(spark)
    ids = spark.createDataFrame([(1,), (1,), (9,)], "id int")
    assert {r.id: r.acknowledged for r in alerts.acknowledge(df, ids).collect()} == {1: True, 2: True, 3: False}
    assert [r.id for r in alerts.unknown_alert_ids(df, ids).collect()] == [9]
    assert alerts.pending_count(alerts.acknowledge(df, None)).first().pending == 0


def test_csv_round_trip(spark):
    rows = alerts.csv_rows(some_alerts(spark))
    path = scratch_dir(spark, "csv")
    export_csv(rows.coalesce(1), path)
    back = read_csv(spark, path, rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert "ID,Device,Severity,Message,Timestamp,Status" in text and '"He said ""hi"", twice' in text
    assert "2026-01-01T12:00:00.123Z,Pending" in text


def test_counters(spark):
    devices = spark.createDataFrame([("d1",), ("idle",)], "device_id string")
    events = spark.createDataFrame([("d1", T0), ("d1", T0)], "device_id string, ts timestamp")
    stats = analytics.device_stats(events)
    got = {r.device_id: (r.event_count, r.last_seen is None) for r in analytics.stats_for_all(devices, stats).collect()}
    assert got == {"d1": (2, False), "idle": (0, True)}
    last = stats.first().last_seen
    for late, online in ((119_999, 1), (120_000, 0)):
        flagged = analytics.online_devices(devices, stats, F.lit(last + late))
        assert analytics.online_count(flagged).first().online == online


def test_share(spark):
    stats = spark.createDataFrame([("a", 75), ("b", 25)], "device_id string, event_count bigint")
    assert [r.share_pct for r in analytics.device_share(stats).collect()] == [75.0, 25.0]
    none = spark.createDataFrame([("a", 0)], "device_id string, event_count bigint")
    assert analytics.device_share(none).first().share_pct == 0.0


def test_history(spark):
    rows = [("d", i, T0 + dt.timedelta(seconds=i), None if i == 59 else float(i), 1.0, None) for i in range(60)]
    df = spark.createDataFrame(rows, "device_id string, event_id int, ts timestamp, temperature double, humidity double, vibration double")
    ring = analytics.device_history(df).orderBy("position").collect()
    assert (len(ring), ring[0].event_id, ring[0].temperature, ring[0].vibration, ring[-1].event_id) == (50, 59, 0.0, 0.0, 10)
    assert analytics.latest_reading(df).first().event_id == 59
    series = analytics.history_series(df, "temperature").collect()
    assert (series[0].label, series[0].value, series[-1].event_id) == ("12:00:10", 10.0, 59)


def test_device_search(spark):
    df = spark.createDataFrame([("dev-1", "Probe", "ACTIVE"), ("dev-2", None, "OFFLINE"), ("x", "a%b", None)],
                               "device_id string, type string, status string")
    def found(q):
        return sorted(r.device_id for r in analytics.search_devices(df, q).collect())
    assert found("") == ["dev-1", "dev-2", "x"]
    assert found("PRO") == ["dev-1"] and found("off") == ["dev-2"] and found("%") == ["x"] and found("dev") == ["dev-1", "dev-2"]
