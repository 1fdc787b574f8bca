"""The streaming operators, run over the events in several micro-batches, then read back."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import scoring
from tidewatch.plans.analytics_queries import _HISTORY
from tidewatch.plans.feature_queries import _ROUNDED_STATS, _STATS
from tidewatch.plans.registry import query, rounded
from tidewatch.plans.views import BASE, LITERAL_LIMIT, Domain
from tidewatch.session import names_in, scratch_dir
from tidewatch.sources.kafka import SourceConfig, read_stream
from tidewatch.sources.lake import read_lake
from tidewatch.streaming import jobs, tails
from tidewatch.streaming.heavy import HeavyKeys

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
PARTS = 4
_FILES = 4  # of a part; a micro-batch takes as many


@lru_cache(maxsize=64)
def _arrivals(spark: SparkSession, application: str, folder: str, order: str) -> str:
    """The events in PARTS additions to a folder: by time, by id, or mixed, so that many come hours late."""
    events = Domain(spark, folder).table("events").select(*[c.split()[0] for c in _EVENTS.split(", ")])
    by = {"time": F.unix_micros(F.col("ts").cast("timestamp")), "id": F.col("event_id"),
          "mixed": F.pmod(F.xxhash64("event_id"), F.lit(1_000_003))}[order].cast("double").alias("at")
    cuts = events.select(by).approxQuantile("at", [i / PARTS for i in range(1, PARTS)], 0.001)
    path = scratch_dir(spark, f"arrivals-{order}")
    part = reduce(lambda n, cut: n + F.coalesce(F.col("at") > cut, F.lit(False)).cast("int"), cuts, F.lit(0))
    for n in range(len(cuts) + 1):  # one after another, as a file source goes by the time of files
        events.withColumn("at", by).where(part == n).drop("at").repartition(_FILES).write.mode("append").parquet(path)
    return path


def _stream(d: Domain, view: str = "readings", order: str = "time") -> DataFrame:
    """A view of the events as a stream of several micro-batches; event time becomes a zoned timestamp."""
    path = _arrivals(d.spark, d.spark.sparkContext.applicationId, d.folder, order)
    cfg = SourceConfig(format="parquet", path=path, schema=_EVENTS, files_per_trigger=_FILES)
    events = read_stream(d.spark, cfg).selectExpr(*[f"{e} AS {c}" for c, e in BASE[view][1].items()])
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in events.columns else events


def _naive(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _run_to_folder(d: Domain, df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(d.spark, name)
    jobs.start(df, scratch_dir(d.spark, f"{name}-checkpoint"), path=path, trigger_seconds=None).awaitTermination()
    return d.spark.read.schema(df.schema).parquet(path)


def _run_batches(d: Domain, df: DataFrame, name: str, sink, mode: str = "append") -> str:
    path = scratch_dir(d.spark, name)
    jobs.start(df, scratch_dir(d.spark, f"{name}-checkpoint"), batch=sink(path), mode=mode,
               trigger_seconds=None).awaitTermination()
    return path


def _writer(path: str) -> tails.Sink:
    return lambda df, batch_id: tails.append_batch(df, f"{path}/out", batch_id)


@query("SELECT event_id, device_id, temperature, ts FROM readings")
def kafka_source(d: Domain) -> DataFrame:
    out = _run_to_folder(d, _stream(d).select("event_id", "device_id", "temperature", "ts"), "source")
    return _naive(out)


@query("""SELECT device_id AS key, device_id AS "deviceId", event_id AS "eventId", sent AS timestamp, status, temperature, humidity, vibration,
  device_type AS "deviceType", device_location AS "deviceLocation", round(temp_mean, 8) AS temp_mean, round(temp_std, 8) AS temp_std,
  temp_min, temp_max, round(temp_range, 8) AS temp_range, hum_mean, hum_std, vib_mean, vib_std, event_count, trend FROM topic_featured""")
def kafka_sink_enriched(d: Domain) -> DataFrame:
    """From the raw topic to the enriched topic: parse, fill, rolling features, JSON; every field is compared."""
    readings = jobs.topic_readings(_stream(d, "raw_records", "id"))
    path = _run_batches(d, readings, "enriched", lambda p: jobs.enriched_sink(p, _writer(p)))
    schema = ("deviceId string, eventId string, timestamp string, status string, enrichedData struct<temperature: double, "
              "humidity: double, vibration: double, deviceType: string, deviceLocation: string>, sparkFeatures struct<"
              "temp_mean: double, temp_std: double, temp_min: double, temp_max: double, temp_range: double, hum_mean: double, "
              "hum_std: double, vib_mean: double, vib_std: double, event_count: int, trend: string>")
    parsed = d.spark.read.schema("key string, value string").parquet(f"{path}/out").select("key", F.from_json("value", schema).alias("r"))
    flat = parsed.select("key", "r.deviceId", "r.eventId", "r.timestamp", "r.status", "r.enrichedData.*", "r.sparkFeatures.*")
    return rounded(flat, "temp_mean", "temp_std", "temp_range")


@query(f"SELECT device_id, event_id, {_ROUNDED_STATS}, event_count, trend FROM featured")
def stream_rolling_stats(d: Domain) -> DataFrame:
    path = _run_batches(d, _stream(d), "rolling", lambda p: tails.rolling_sink(p, _writer(p)))
    out = d.spark.read.parquet(f"{path}/out")
    return rounded(out.select("device_id", "event_id", *_STATS, "event_count", "trend"))


@query("""SELECT reason IS NOT NULL AS failed, reason, count(*) AS records FROM (
  SELECT CASE WHEN device_id IS NULL THEN 'malformed' WHEN payload IS NULL THEN 'null_payload'
    WHEN device_id NOT IN (SELECT device_id FROM devices) THEN 'unknown_device' END AS reason
  FROM (SELECT CASE WHEN value <> 'NOT_JSON' THEN value->>'$.deviceId' END AS device_id,
               CASE WHEN value <> 'NOT_JSON' THEN value->>'$.payload' END AS payload FROM received)) GROUP BY 1, 2""")
def micro_batch(d: Domain) -> DataFrame:
    """Checkpointed micro-batches; rows that can't be processed go to the dead letters, the others go on."""
    path = _run_batches(d, _stream(d, "received"), "batches",
                        lambda p: jobs.isolating_sink(lambda: d.devices, "deviceId string, payload map<string, double>", p))
    return d.spark.read.parquet(path).groupBy(F.col("failed").cast("boolean").alias("failed"), "reason").agg(F.count(F.lit(1)).alias("records"))


#: An event on which the work raises; the id is arbitrary.
_BROKEN = 777


@query(f"""SELECT CASE WHEN e.event_id = {_BROKEN} THEN 'dead' ELSE 'processed' END AS outcome, e.event_id, p.status
FROM telemetry e LEFT JOIN processed p ON p.original_event_id = e.event_id AND e.event_id <> {_BROKEN}
WHERE e.event_id = {_BROKEN} OR p.status IS NOT NULL""")
def micro_batch_isolation(d: Domain) -> DataFrame:
    """An event breaks the work on its micro-batch; it alone becomes a dead letter."""
    def check(events: DataFrame) -> DataFrame:
        broken = F.col("event_id") == _BROKEN
        return events.where(F.when(broken, F.raise_error(F.lit("a reading that can't be worked on"))).otherwise(F.lit(True)).cast("boolean"))
    path = _run_batches(d, _stream(d, "telemetry"), "isolation",
                        lambda p: jobs.tolerant_process_sink(lambda: d.devices, lambda: d.rules, p, check))
    done = d.spark.read.parquet(f"{path}/processed").select(F.lit("processed").alias("outcome"), F.col("original_event_id").alias("event_id"),
                                                            "status")
    if not names_in(d.spark, f"{path}/dead"):
        return done
    dead = d.spark.read.parquet(f"{path}/dead").where(F.col("error").contains("can't be worked on"))
    return done.unionByName(dead.select(F.lit("dead").alias("outcome"), "row.event_id", F.lit(None).cast("string").alias("status")))


@query("SELECT event_id, device_id FROM readings")
def stream_dedup(d: Domain) -> DataFrame:
    """Every event twice, in micro-batches that mix early and late ones."""
    twice = _stream(d, order="mixed").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run_to_folder(d, jobs.dedup_stream(twice).select("event_id", "device_id"), "dedup")


@query("SELECT event_id, device_id FROM readings")
def stream_dedup_history(d: Domain) -> DataFrame:
    """Every event twice at once, and once more in a later micro-batch, hours or days after the first."""
    events = _stream(d, order="mixed")
    again = F.explode(F.array(F.lit(1), F.lit(2)))
    path = scratch_dir(d.spark, "dedup-history")
    sink, checkpoint = jobs.history_dedup_sink(path, fold=2), scratch_dir(d.spark, "dedup-history-checkpoint")
    jobs.start(events.withColumn("copy", again), checkpoint, batch=sink, trigger_seconds=None).awaitTermination()
    later = _stream(d, order="time").withColumn("copy", F.lit(3))  # the same events once more, in another order
    follow = lambda batch, batch_id: sink(batch, batch_id + PARTS)
    jobs.start(later, scratch_dir(d.spark, "dedup-history-checkpoint"), batch=follow, trigger_seconds=None).awaitTermination()
    return d.spark.read.parquet(f"{path}/events").select("event_id", "device_id")


@query("SELECT original_event_id, device_id, status, device_type FROM processed")
def stream_enrich_classify(d: Domain) -> DataFrame:
    path = _run_batches(d, _stream(d, "telemetry"), "processed",
                        lambda p: jobs.process_sink(lambda: d.devices, lambda: d.rules, f"{p}/out", HeavyKeys(f"{p}/heavy", "device_id")))
    return d.spark.read.parquet(f"{path}/out").select("original_event_id", "device_id", "status",
                                             F.col("enriched_data.deviceType").alias("device_type"))


@query("SELECT device_id, severity, message, ts FROM alerts")
def stream_alerts(d: Domain) -> DataFrame:
    processed = jobs.process_batch(_stream(d, "telemetry"), d.devices, d.rules)
    return _naive(_run_to_folder(d, jobs.alerts_stream(processed), "alerts")).select(
        "device_id", "severity", "message", "ts")


@query("SELECT device_id, event_count, last_seen FROM stats")
def stream_counters(d: Domain) -> DataFrame:
    path = _run_batches(d, jobs.counters_stream(_stream(d)), "counters", lambda p: tails.upsert_sink(p, "device_id", fold=2), mode="update")
    return tails.read_upserts(d.spark, path, "device_id", "device_id string, event_count bigint, last_seen bigint")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT device_id) AS devices, true AS near FROM readings GROUP BY 1
UNION ALL SELECT 'all', count(DISTINCT device_id), true FROM readings""")
def stream_distinct_devices(d: Domain) -> DataFrame:
    """Distinct devices per day by sketches that are merged over micro-batches, beside the exact counts they must come near (3 %)."""
    path = _run_batches(d, _stream(d, order="mixed"), "distinct",
                        lambda p: tails.distinct_sink(p, F.col("device_id"), F.date_format("ts", "yyyy-MM-dd"), fold=2))
    found = tails.read_distinct(d.spark, path).select(F.coalesce("bucket", F.lit("all")).alias("day"), F.col("devices").alias("estimate"))
    days = d.readings.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "device_id")
    exact = days.groupBy("day").agg(F.count_distinct("device_id").alias("devices")).unionByName(
        days.agg(F.lit("all").alias("day"), F.count_distinct("device_id").alias("devices")))
    near = F.abs(F.col("estimate") - F.col("devices")) <= F.greatest(F.lit(1), F.col("devices") * 0.03)
    return exact.join(found, "day", "left").select("day", "devices", F.coalesce(near, F.lit(False)).alias("near"))


@query(f"SELECT * FROM ({_HISTORY}) WHERE position <= 50")
def stream_history(d: Domain) -> DataFrame:
    path = _run_batches(d, _stream(d, "telemetry"), "history", lambda p: tails.history_sink(p, fold=2))
    return _naive(tails.read_history(d.spark, path))


@query("""SELECT 'lake' AS output, count(*) AS records, round(sum(if_score), 3) AS score FROM forest_predictions
UNION ALL SELECT 'predictions', count(*), round(sum(if_score), 3) FROM forest_predictions
UNION ALL SELECT 'anomalies', count(*), round(sum(if_score), 3) FROM forest_predictions WHERE is_anomaly""")
def stream_score_lake(d: Domain) -> DataFrame:
    """The ensemble with a forest that SQL can walk; windows go on across micro-batches."""
    model = (d.literal_forest, scoring.model_columns()[:3], LITERAL_LIMIT)
    folder = _run_batches(d, _stream(d), "scored", lambda p: jobs.score_sink(lambda: model, p, fold=2))
    lake = read_lake(d.spark, f"{folder}/lake").withColumn("anomalyScore", F.col("anomaly_score"))
    parts = {"lake": lake, **{p: d.spark.read.parquet(f"{folder}/{p}") for p in ("predictions", "anomalies")}}
    counts = [df.agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("records"), F.round(F.sum("anomalyScore"), 3).alias("score"))
              for name, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
