"""Streams against their batch twins, restarts, replays and failures."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewatch.operators import analytics, iforest, lookup, processing, scoring, training
from tidewatch.operators.features import rolling_features
from tidewatch.session import names_in, scratch_dir
from tidewatch.sources.kafka import SourceConfig, read_stream, to_json_value, write_stream
from tidewatch.sources.lake import read_lake
from tidewatch.streaming import heavy, jobs, tails
from tidewatch.streaming.isolate import TooManyFailures, isolating

EVENT = "device_id string, event_id bigint, ts timestamp, temperature double, humidity double, vibration double"
T0 = dt.datetime(2026, 1, 1)


def events(n, first=0, seed=1):
    rng = random.Random(seed)
    return [(f"d{rng.randrange(4)}" if rng.random() < 0.6 else "hot", i, T0 + dt.timedelta(seconds=i),
             rng.choice([None, rng.uniform(0, 200)]) if i % 9 == 0 else rng.uniform(0, 200), rng.uniform(0, 100), rng.random())
            for i in range(first, first + n)]


class Feed:
    """A folder that grows; rows of one addition are shuffled over several files."""

    def __init__(self, spark):
        self.spark, self.path = spark, scratch_dir(spark, "feed")
        self.add([], 1)

    def add(self, rows, files=5):
        rows = list(rows)
        random.Random(0).shuffle(rows)
        self.spark.createDataFrame(rows, EVENT).repartition(files).write.mode("append").parquet(self.path)

    def stream(self):
        return read_stream(self.spark, SourceConfig(format="parquet", path=self.path, schema=EVENT))

    def all(self):
        return self.spark.read.schema(EVENT).parquet(self.path)


def rows(df, *columns):
    df = df.withColumns({c: F.round(c, 8) for c, t in df.dtypes if t == "double"})
    return sorted(map(repr, df.select(*columns).collect()))


STATS = ["device_id", "event_id", "temp_mean", "temp_std", "temp_min", "temp_max", "temp_range", "hum_mean",
         "hum_std", "vib_mean", "vib_std", "event_count", "trend"]


def writer(path):
    return lambda df, batch_id: tails.append_batch(df, f"{path}/out", batch_id)


@pytest.mark.parametrize("group_rows", [None, 20])
def test_rolling_stats_over_restarts(spark, group_rows):
    """Four micro-batches, a full table of last rows after every second one, and a device with a third of the rows or more."""
    feed, out, checkpoint = Feed(spark), scratch_dir(spark, "out"), scratch_dir(spark, "cp")

    def run():
        sink = tails.rolling_sink(out, writer(out), fold=2, group_rows=group_rows)
        jobs.start(feed.stream(), checkpoint, batch=sink, trigger_seconds=None).awaitTermination()
        return spark.read.parquet(f"{out}/out")
    for first, n in ((0, 60), (60, 5), (65, 40), (105, 30)):
        feed.add(events(n, first=first, seed=first))
        run()
    want = rows(rolling_features(feed.all()), *STATS)
    assert rows(run(), *STATS) == want


def test_text_ids_and_other_columns_are_kept(spark):
    out = scratch_dir(spark, "out")
    sink = tails.rolling_sink(out, writer(out))
    frame = spark.createDataFrame(events(10), EVENT).withColumn("event_id", F.concat(F.lit("id-"), "event_id")).withColumn("status", F.lit("NORMAL"))
    sink(frame, 0)
    sink(frame.withColumn("event_id", F.concat("event_id", F.lit("b"))), 1)
    sink(frame.withColumn("event_id", F.concat("event_id", F.lit("b"))), 1)  # a replay
    got = spark.read.parquet(f"{out}/out")
    assert got.count() == 20 and got.where("status = 'NORMAL' and event_id like 'id-%'").count() == 20


def test_history_over_restarts(spark):
    feed, out, checkpoint = Feed(spark), scratch_dir(spark, "out"), scratch_dir(spark, "cp")
    for first, n in ((0, 60), (60, 15), (75, 3), (78, 9)):
        feed.add(events(n, first=first, seed=first))
        jobs.start(feed.stream(), checkpoint, batch=tails.history_sink(out, 10, fold=2), trigger_seconds=None).awaitTermination()
    columns = ["device_id", "event_id", "temperature", "position"]
    assert rows(tails.read_history(spark, out, n=10), *columns) == rows(analytics.device_history(feed.all(), 10), *columns)


def test_counters_over_restarts(spark):
    feed, out, checkpoint = Feed(spark), scratch_dir(spark, "out"), scratch_dir(spark, "cp")
    for first in (0, 50, 100, 150):
        feed.add(events(50, first=first))
        jobs.start(jobs.counters_stream(feed.stream()), checkpoint, batch=tails.upsert_sink(out, "device_id", fold=2), mode="update",
                   trigger_seconds=None).awaitTermination()
    columns = ["device_id", "event_count", "last_seen"]
    got = tails.read_upserts(spark, out, "device_id", "device_id string, event_count bigint, last_seen bigint")
    assert rows(got, *columns) == rows(analytics.device_stats(feed.all()), *columns)


def test_distinct_devices_over_micro_batches(spark):
    """Sketches per day, merged and replayed; within 3 % of the exact counts, also over several days."""
    path = scratch_dir(spark, "distinct")
    sink = tails.distinct_sink(path, F.col("device_id"), F.date_format("ts", "yyyy-MM-dd"), fold=2)
    rows = spark.range(60_000).select(F.concat(F.lit("d"), F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("device_id"),
                                      F.expr("timestamp'2026-01-01' + make_dt_interval(cast(id % 3 as int))").alias("ts"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, T0, -1), ("d1", None, -2)], rows.schema))
    for batch in range(5):
        for _ in range(2 if batch == 3 else 1):
            sink(rows.where(F.pmod("id", F.lit(5)) == batch), batch)
    exact = {r.day: r.n for r in rows.where("device_id is not null").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count_distinct("device_id").alias("n")).collect() if r.day}
    got = {r.bucket: r.devices for r in tails.read_distinct(spark, path).collect()}
    assert set(got) == {None, *exact} and all(abs(got[day] - n) <= 0.03 * n for day, n in exact.items())
    assert abs(got[None] - rows.where("ts is not null").agg(F.count_distinct("device_id")).first()[0]) <= 0.03 * 20_000
    two = {r.bucket: r.devices for r in tails.read_distinct(spark, path, F.col("bucket") >= "2026-01-02").collect()}
    assert set(two) == {None, "2026-01-02", "2026-01-03"}


def test_versions_are_folded(spark):
    path = scratch_dir(spark, "versions")
    frame = spark.createDataFrame([("a", 1), ("b", 1)], "key string, n int")
    table = tails.Versions(path, "key", frame.schema, fold=3)
    for batch in range(10):
        table.write(frame.where("key = 'a' or %d = 0" % batch).withColumn("n", F.lit(batch)), batch)
        assert {(r.key, r.n) for r in table.now(spark).collect()} == {("a", batch), ("b", 0)}
    assert {(r.key, r.n) for r in table.before(spark, 7).collect()} == {("a", 6), ("b", 0)}
    kept = spark.read.parquet(path).select("batch").distinct().count()
    assert kept <= 5


def test_dedup_across_batches(spark):
    """Copies go, first arrivals stay, also those an hour late."""
    feed, out, checkpoint = Feed(spark), scratch_dir(spark, "out"), scratch_dir(spark, "cp")

    def run():
        jobs.start(jobs.dedup_stream(feed.stream()), checkpoint, path=out, trigger_seconds=None).awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(out).collect())
    every = [(d, i, T0 + dt.timedelta(minutes=5 * i), t, h, v) for d, i, _, t, h, v in events(60)]
    late = random.Random(3).sample(every, len(every))
    for at in range(0, 60, 15):
        feed.add(late[at:at + 15] + late[:at][-5:])
        run()
    assert run() == list(range(60))


def test_dedup_against_the_history(spark):
    out = scratch_dir(spark, "out")
    done = spark.createDataFrame([(3,), (3,), (7,)], "event_id bigint")
    jobs.dedup_sink(lambda: done, out)(spark.createDataFrame(events(10), EVENT), 0)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 4, 5, 6, 8, 9]


def test_bad_rows_do_not_hold_up_others(spark):
    out = scratch_dir(spark, "out")
    raw = spark.createDataFrame([(1, '{"deviceId":"d","payload":{"t":1.0}}'), (2, "NOT_JSON"), (3, None), (4, '{"deviceId":"x","payload":{}}')],
                                "offset int, value string")
    devices = spark.createDataFrame([("d",)], "device_id string")
    jobs.isolating_sink(lambda: devices, "deviceId string, payload map<string, double>", out)(raw, 0)
    got = {r.offset: (str(r.failed), r.reason) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("false", None), 2: ("true", "malformed"), 3: ("true", "malformed"), 4: ("true", "unknown_device")}


def test_failing_rows_stand_alone(spark):
    """Three rows of 10,000, one of them twice, raise in the features; a replay gives the same."""
    out = scratch_dir(spark, "out")
    frame = spark.range(10_000).select("id", F.when(F.col("id").isin(17, 4000, 9999), "x").otherwise(F.col("id").cast("string")).alias("v"))
    frame = frame.unionByName(frame.where("id = 17")).withColumn("place", F.lit("kept")).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    sink = isolating(lambda rows: rows.select("id", "place", F.col("v").cast("double").alias("v")), f"{out}/ok", f"{out}/dead")
    for _ in range(2):
        sink(frame, 0)
    assert spark.read.parquet(f"{out}/ok").agg(F.count("v"), F.count_distinct("id")).first()[:] == (9997, 9997)
    dead = spark.read.parquet(f"{out}/dead").collect()
    assert sorted(r.row.id for r in dead) == [17, 17, 4000, 9999]
    assert all("CAST_INVALID_INPUT" in r.error and r.row.place == "kept" for r in dead)
    sink(frame.where("v <> 'x'"), 0)  # the input was mended
    assert names_in(spark, f"{out}/dead") == [] and spark.read.parquet(f"{out}/ok").count() == 9997


def test_parts_take_their_own_devices(spark, monkeypatch):
    """A part of a micro-batch is joined with no more devices than it has; the outcome is that of all devices."""
    seen, process = [], jobs.process_batch

    def counting(rows, devices, *rest):
        seen.append(devices.count())
        return process(rows, devices, *rest)
    monkeypatch.setattr(jobs, "process_batch", counting)
    out = scratch_dir(spark, "out")
    rows = [(f"d{i}" if i % 50 else None, i, T0, 50.0, 1.0, 0.1) for i in range(400)] + [("unknown", 999, T0, 1.0, 1.0, 0.1)]
    devices = spark.createDataFrame([(f"d{i}", "probe") for i in range(800)], "device_id string, type string")
    rules = spark.createDataFrame([(1, "temperature", 60.0)], "id int, metric string, threshold double")
    broken = F.when(F.col("event_id") == 77, F.raise_error(F.lit("bad reading"))).otherwise(F.lit(True)).cast("boolean")
    frame = spark.createDataFrame(rows, EVENT).withColumns({"correlation_id": F.lit("c"), "event_type": F.lit("t")})
    jobs.tolerant_process_sink(lambda: devices, lambda: rules, out, lambda events: events.where(broken))(frame, 0)
    assert seen[0] == 392 and min(seen) <= 1 and sum(seen) < 5 * 392
    done = sorted(r.original_event_id for r in spark.read.parquet(f"{out}/processed").collect())
    assert done == [i for i in range(400) if i % 50 and i != 77]
    assert [r.row.event_id for r in spark.read.parquet(f"{out}/dead").collect()] == [77]


def test_faults_of_all_rows_are_not_dead_letters(spark):
    out = scratch_dir(spark, "out")
    frame = spark.range(200).select("id")
    broken = isolating(lambda rows: rows.select(F.raise_error(F.lit("store is down")).alias("x")), f"{out}/ok", f"{out}/dead", most=3)
    with pytest.raises(TooManyFailures, match="store is down"):
        broken(frame, 0)
    with pytest.raises(AnalysisException):
        isolating(lambda rows: rows.select("absent"), f"{out}/ok", f"{out}/dead")(frame, 0)
    assert names_in(spark, f"{out}/dead") == []
    only = isolating(lambda rows: rows.select(F.raise_error(F.lit("bad")).alias("x")), f"{out}/ok", f"{out}/dead")
    only(frame.limit(1), 1)
    assert spark.read.parquet(f"{out}/dead").count() == 1 and names_in(spark, f"{out}/ok") == []


def test_heavy_keys_are_carried(spark):
    path, n = scratch_dir(spark, "heavy"), 0
    keys = heavy.HeavyKeys(path, "device_id", counters=20)
    for batch in range(4):
        frame = spark.range(n, n + 3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "warm").otherwise(
            F.concat(F.lit("d"), F.col("id"))).alias("device_id")).unionByName(spark.createDataFrame([(None,)] * 5, "device_id string"))
        for _ in range(2):  # a replay starts from the same note
            assert keys.hot(spark, batch, 0.1) == (["hot"] if batch else [])
            keys.add(frame, batch)
        n += 3000
    found = {r.key: r.n for r in heavy.summary(frame, "device_id", 20).collect()}
    assert 1000 - 3000 // 20 <= found["hot"] <= 1000
    for batch in range(4, 9):  # the hot device falls silent
        keys.add(spark.range(3000).select(F.col("id").cast("string").alias("device_id")), batch)
    assert keys.hot(spark, 9, 0.1) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_stream_lookup_of_a_hot_device(spark, how):
    """A registry beyond the broadcast limit: a third of the events are of one device, and no task gets them all."""
    feed, out = Feed(spark), scratch_dir(spark, "out")
    feed.add([*events(300), *[(None, 1000 + i, T0, 1.0, 1.0, 1.0) for i in range(30)], ("ghost", 2000, T0, 1.0, 1.0, 1.0)])
    table = spark.createDataFrame([(d, f"t{i}") for d in ("hot", "d0", "d1") for i in range(2)] + [("unused", "t")], "device_id string, type string")
    want = rows(feed.all().join(table, "device_id", how), *feed.all().join(table, "device_id", how).columns)
    for hot in (None, ["hot"], []):
        path = scratch_dir(spark, "joined")
        joined = lookup.lookup_join(feed.stream(), table, "device_id", how, broadcast_bytes=-1, hot=hot)
        jobs.start(joined, scratch_dir(spark, "cp"), path=path, trigger_seconds=None).awaitTermination()
        assert rows(spark.read.schema(joined.schema).parquet(path), *joined.columns) == want
    spread = lookup._salted(feed.all(), table, "device_id", "inner", ["hot"], 16).where("device_id = 'hot'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    per_task = [r["count"] for r in spread.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(per_task) >= 4 and max(per_task) < 0.6 * sum(per_task)


def test_rule_change_without_restart(spark):
    feed, out, checkpoint = Feed(spark), scratch_dir(spark, "out"), scratch_dir(spark, "cp")
    devices = spark.createDataFrame([("hot", "probe")], "device_id string, type string")
    limit = {"value": 1000.0}

    def rules():
        return spark.createDataFrame([(1, "temperature", limit["value"])], "id int, metric string, threshold double")

    def run():
        jobs.start(feed.stream(), checkpoint, batch=jobs.process_sink(lambda: devices, rules, out),
                   trigger_seconds=None).awaitTermination()
    hot = [e for e in events(60) if e[0] == "hot" and e[3] is not None]
    feed.add(hot[:5])
    run()
    limit["value"] = 0.0
    feed.add(hot[5:9] + [("ghost", 999, T0, 500.0, 1.0, 1.0)])
    run()
    got = {r.original_event_id: r.status for r in spark.read.parquet(out).collect()}
    assert got == {**{e[1]: "NORMAL" for e in hot[:5]}, **{e[1]: "CRITICAL" for e in hot[5:9]}}


def forest(spark):
    df = spark.createDataFrame(events(200), EVENT).fillna(0.0)
    prepared = scoring.telemetry_features(df)
    return iforest.fit(prepared, "event_id", scoring.model_columns(), trees=10)


def test_score_sink_equals_the_batch_job(spark):
    """Replays replace themselves, windows go on over micro-batches, and the lake can be trained on."""
    nodes, folder = forest(spark), scratch_dir(spark, "scored")
    sink = jobs.score_sink(lambda: (nodes, scoring.model_columns(), 0.0), folder, fold=2)
    parts = [spark.createDataFrame(events(n, first=first, seed=first), EVENT) for first, n in ((0, 40), (40, 5), (45, 30), (75, 12))]
    for batch_id, part in enumerate(parts):
        sink(part, batch_id)
        sink(part, batch_id)
    whole = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    want = scoring.ensemble(iforest.score(scoring.telemetry_features(whole), nodes, scoring.model_columns(), 0.0))
    lake = read_lake(spark, f"{folder}/lake")
    columns = ["event_id", "anomaly_score", "is_anomaly", "severity"]
    assert rows(lake.select(F.col("eventId").alias("event_id"), *columns[1:]), *columns) == rows(want.select(*columns), *columns)
    assert spark.read.parquet(f"{folder}/predictions").count() == 87
    assert spark.read.parquet(f"{folder}/anomalies").count() == want.where("is_anomaly").count()
    model = training.train_from_lake(spark, lake, scratch_dir(spark, "model"), scratch_dir(spark, "registry"), "v1")
    assert model.metrics.first().samples == 87


def test_events_wait_when_scoring_fails(spark, capsys):
    nodes, folder = forest(spark), scratch_dir(spark, "scored")
    good = (nodes, scoring.model_columns(), 0.0)
    calls = []

    def sometimes():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("no model store")
        return good
    sink = jobs.score_sink(sometimes, folder)
    sink(spark.createDataFrame(events(12), EVENT), 0)
    sink(spark.createDataFrame(events(8, first=12), EVENT), 1)
    assert "no model store" in capsys.readouterr().out
    assert read_lake(spark, f"{folder}/lake").count() == 8
    assert jobs.score_pending(spark, sometimes, folder) == 1
    lake = read_lake(spark, f"{folder}/lake")
    assert lake.count() == 20 and lake.where("is_anomaly is null").count() == 0
    assert jobs.score_pending(spark, sometimes, folder) == 0


def test_alert_stream(spark):
    feed, out = Feed(spark), scratch_dir(spark, "out")
    devices = spark.createDataFrame([("hot", "probe")], "device_id string, type string")
    rules = spark.createDataFrame([(1, "temperature", 100.0)], "id int, metric string, threshold double")
    feed.add(events(40))
    processed = jobs.process_batch(feed.stream(), devices, rules)
    jobs.start(jobs.alerts_stream(processed), scratch_dir(spark, "cp"), path=out, trigger_seconds=None).awaitTermination()
    want = processing.with_status(processing.enrich(feed.all(), devices), rules).where("status <> 'NORMAL'").count()
    assert spark.read.parquet(out).count() == want > 0


def test_kafka_options():
    options = SourceConfig(servers="b:9092", topic="t").reader_options()
    assert options["startingOffsets"] == "latest" and options["failOnDataLoss"] == "false"
    assert options["subscribe"] == "t" and int(options["maxOffsetsPerTrigger"]) > 0
    assert SourceConfig(starting_offsets="earliest").reader_options()["startingOffsets"] == "earliest"


def test_json_sink(spark):
    feed, out = Feed(spark), scratch_dir(spark, "out")
    feed.add(events(8))
    df = feed.stream().select("device_id", "event_id")
    assert to_json_value(df, "device_id").columns == ["key", "value"]
    write_stream(to_json_value(df), scratch_dir(spark, "cp"), path=out, trigger_seconds=None).start().awaitTermination()
    assert spark.read.schema("value string").parquet(out).where("value like '{\"device_id\":%'").count() == 8
