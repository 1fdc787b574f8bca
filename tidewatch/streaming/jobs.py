"""Streaming jobs: de-duplication, processing, enriched records, alerts, counters and scoring into the lake."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.timestamps import normalize_ts
from tidewatch.operators import iforest, scoring
from tidewatch.operators.alerts import raise_alerts
from tidewatch.operators.features import STREAM_WINDOW
from tidewatch.operators.ingest import fill_readings, parse_events
from tidewatch.operators.processing import enrich, reasoned, to_processed, with_status
from tidewatch.schemas import ENGINEERED, ENRICHED, SENSORS
from tidewatch.session import names_in, remove, stored_as
from tidewatch.sources.lake import lake_rows, write_lake_batch
from tidewatch.sources.records import anomaly_rows, enriched_records, prediction_rows
from tidewatch.streaming.heavy import HeavyKeys
from tidewatch.streaming.isolate import isolating
from tidewatch.streaming.seen import FOLD as SEEN_FOLD
from tidewatch.streaming.seen import SeenIds
from tidewatch.streaming.tails import FOLD, Sink, append_batch, carrying, rolling_sink

TRIGGER_SECONDS = 5
DEDUP_HORIZON = "1 hour"
Tables = Callable[[], DataFrame]
ModelParts = tuple[DataFrame | None, list[str], float]


def start(df: DataFrame, checkpoint: str, batch: Sink | None = None,
          path: str | None = None, mode: str = "append", trigger_seconds: int | None = TRIGGER_SECONDS) -> StreamingQuery:
    """Run a stream into ``batch`` or a Parquet folder; a trigger of None takes what is there."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = (writer.trigger(availableNow=True) if trigger_seconds is None
              else writer.trigger(processingTime=f"{trigger_seconds} seconds"))
    if batch is not None:
        return writer.foreachBatch(batch).start()
    return writer.format("parquet").start(path)


def dedup_stream(events: DataFrame, key: str = "event_id", horizon: str = DEDUP_HORIZON) -> DataFrame:
    """Drop copies that arrive within the horizon after the first one, whatever their event time.

    The watermark is on the time of arrival, stamped per micro-batch, which never goes back: no first arrival is ever dropped
    as late. The ids seen are forgotten after the horizon; ``history_dedup_sink`` covers the full history.
    """
    return (events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", horizon)
            .dropDuplicatesWithinWatermark([key]).drop("_arrived"))


def dedup_sink(processed: Tables, path: str, key: str = "event_id") -> Sink:
    """Write what is not among the processed ids, for copies that come after the horizon."""
    def run(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch.join(processed().select(key), key, "left_anti"), path, batch_id)
    return run


def history_dedup_sink(path: str, key: str = "event_id", order: tuple[str, ...] = ("ts",), fold: int = SEEN_FOLD) -> Sink:
    """Write the first arrival of every id ever, however far apart its copies come; of copies in one micro-batch the first in ``order``.

    The sink keeps the ids it has let through (``SeenIds``) and opens only those of their buckets that may hold an id of the
    micro-batch. ``path`` gets the rows under ``events`` and the ids under ``seen``.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        SeenIds(f"{path}/seen", key, fold).first_arrivals(batch, batch_id, order, f"{path}/events")
    return run


def process_batch(events: DataFrame, devices: DataFrame, rules: DataFrame, hot: Sequence[str] | None = None) -> DataFrame:
    return to_processed(with_status(enrich(events, devices, hot), rules))


def process_sink(devices: Tables, rules: Tables, path: str, heavy: HeavyKeys | None = None) -> Sink:
    """Enrich and classify; both tables are read anew for each micro-batch, so a changed rule
    holds for later events without a restart. ``heavy`` carries the hot devices, which are then not counted in each micro-batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        hot = None if heavy is None else heavy.hot(batch.sparkSession, batch_id)
        append_batch(process_batch(batch, devices(), rules(), hot), path, batch_id)
        if heavy is not None:
            heavy.add(batch, batch_id)
    return run


def tolerant_process_sink(devices: Tables, rules: Tables, path: str, check: Callable[[DataFrame], DataFrame] | None = None) -> Sink:
    """As ``process_sink``, but an event on which the work raises goes to the dead letters with its error, and the others go on.

    ``path`` gets the processed events under ``processed`` and the others under ``dead``; ``check`` is more work on the events.

    The work is tried on ever smaller parts of a micro-batch. Each takes the devices of its own events only, found by a shuffle, so
    that the registry isn't broadcast again for every part.
    """
    def work(events: DataFrame) -> DataFrame:
        own = events.select("device_id").distinct().hint("shuffle_merge")
        known = devices().join(own, "device_id", "left_semi")
        return process_batch(events if check is None else check(events), known, rules())
    return isolating(work, f"{path}/processed", f"{path}/dead")


def isolating_sink(devices: Tables, schema: str, path: str) -> Sink:
    """Raw records with the reason why they can't be processed, or null, in one pass.

    The folder is partitioned by the outcome: ``failed=true`` holds the dead letters, ``failed=false`` what goes on. A bad
    row does not hold up the others of its micro-batch.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = reasoned(batch, devices(), schema).withColumn("failed", F.col("reason").isNotNull())
        rows.write.mode("overwrite").partitionBy("failed").parquet(f"{path}/batch={batch_id}")
    return run


def topic_readings(records: DataFrame) -> DataFrame:
    """JSON records of the processed topic as flat readings: text ids, zeros for missing readings, status, type and location.

    The columns ``timestamp`` (text, as sent) and ``ts`` stand side by side. Malformed records and those without a device
    fall out.
    """
    filled = fill_readings(parse_events(records))
    return filled.select(
        F.col("deviceId").alias("device_id"), F.col("eventId").alias("event_id"), "timestamp", normalize_ts(F.col("timestamp")).alias("ts"),
        "status", *[F.col(f"enrichedData.{s}").alias(s) for s in SENSORS],
        F.col("enrichedData.deviceType").alias("device_type"), F.col("enrichedData.deviceLocation").alias("device_location"))


def enriched_sink(folder: str, write: Sink, n: int = STREAM_WINDOW, fold: int = FOLD) -> Sink:
    """From readings (``topic_readings``) to the records of the enriched topic, one JSON value per event."""
    def send(featured: DataFrame, batch_id: int) -> None:
        write(enriched_records(featured).select(F.col("deviceId").alias("key"), F.to_json(F.struct("*")).alias("value")), batch_id)
    return rolling_sink(folder, send, n, fold=fold)


def alerts_stream(processed: DataFrame) -> DataFrame:
    """Stateless: the batch projection holds on a stream."""
    return raise_alerts(processed)


def counters_stream(events: DataFrame) -> DataFrame:
    """Running count and last event time (epoch ms) per device, combined before the shuffle."""
    return events.groupBy("device_id").agg(F.count(F.lit(1)).alias("event_count"),
                                           F.max(F.unix_millis("ts")).alias("last_seen"))


def _scored(features: DataFrame, model: ModelParts) -> DataFrame:
    nodes, columns, threshold = model
    return scoring.ensemble(iforest.score(features, nodes, columns, threshold))


def _publish(scored: DataFrame, folder: str, batch_id: int) -> None:
    """The lake first; predictions and anomalies are read from what was written, so a batch is scored once."""
    own = [c for c in scored.columns if not c.startswith((ENRICHED, ENGINEERED, "_"))]
    written = write_lake_batch(lake_rows(scored.select(*own)), f"{folder}/lake", batch_id)
    flat = written.select(F.col("deviceId").alias("device_id"), F.col("eventId").alias("event_id"), "is_anomaly", "anomaly_score",
                          F.col("timestamp").alias("ts"))
    append_batch(prediction_rows(flat), f"{folder}/predictions", batch_id)
    append_batch(anomaly_rows(flat), f"{folder}/anomalies", batch_id)


def score_sink(model: Callable[[], ModelParts], folder: str, fold: int = FOLD) -> Sink:
    """Score each micro-batch on the windows of its devices and write predictions, anomalies and the lake.

    All outputs are addressed by batch, so a replay replaces its own. If scoring fails, the events wait with their features
    under ``unscored`` for ``score_pending``, and the stream goes on.
    """
    def write(features: DataFrame, batch_id: int) -> None:
        scores = f"{folder}/scoring/batch={batch_id}"
        try:
            scored = stored_as(_scored(features, model()), scores)
        except Exception as error:  # the events must not be lost
            print(f"scoring of batch {batch_id} failed, its events wait to be scored: {error}")
            features.write.mode("overwrite").parquet(f"{folder}/unscored/batch={batch_id}")
            return
        _publish(scored, folder, batch_id)  # if an output can't be written, the micro-batch fails and is tried again
        remove(features.sparkSession, scores)

    return carrying(folder, "device_id", ("ts", "event_id"), STREAM_WINDOW - 1, SENSORS,
                    lambda rows, order: scoring.telemetry_features(rows, order=order), write, fold)


def score_pending(spark: SparkSession, model: Callable[[], ModelParts], folder: str) -> int:
    """Score the micro-batches that ``score_sink`` could not; returns how many."""
    ids = [int(name.partition("=")[2]) for name in names_in(spark, f"{folder}/unscored")]
    for batch_id in ids:
        one = f"{folder}/unscored/batch={batch_id}"
        _publish(_scored(spark.read.parquet(one), model()), folder, batch_id)
        remove(spark, one)
    return len(ids)
