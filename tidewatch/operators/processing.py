"""De-duplication, registry enrichment, rules and status of telemetry events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.readings import DEFAULT_THRESHOLD, TEMPERATURE_METRIC, classify
from tidewatch.operators.lookup import lookup_join
from tidewatch.operators.ordered import first_per_key
from tidewatch.schemas import TOPIC_RECEIVED


def dedup(events: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("arrival",),
          processed: DataFrame | None = None) -> DataFrame:
    """Keep the first arrival of each event, without those in the ``processed`` ids table.

    Copies go first: afterwards no event id can be hot in the join.
    """
    once = first_per_key(events, key, list(order))
    return once if processed is None else once.join(processed.select(key).distinct(), key, "left_anti")


def enrich(events: DataFrame, devices: DataFrame, hot: Sequence[str] | None = None) -> DataFrame:
    """Put the registry's type on events of known devices; others are dropped.

    A ``device_type`` the event brought along is overridden. ``hot`` names devices with many events, where they are known.
    """
    registry = devices.select("device_id", F.col("type").alias("device_type"))
    return lookup_join(events.drop("device_type"), registry, "device_id", "inner", hot=hot)


def unknown_devices(events: DataFrame, devices: DataFrame) -> DataFrame:
    return lookup_join(events, devices.select("device_id"), "device_id", "left_anti")


def threshold(rules: DataFrame, metric: str = TEMPERATURE_METRIC, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row: the threshold of the latest rule for ``metric``, or the default."""
    return (rules.where(F.col("metric") == metric)
            .agg(F.coalesce(F.max_by("threshold", "id"), F.lit(default)).alias("threshold")))


def threshold_value(rules: DataFrame, metric: str = TEMPERATURE_METRIC,
                    default: float = DEFAULT_THRESHOLD) -> Column:
    """The same as a scalar subquery, evaluated once per query."""
    return threshold(rules, metric, default).scalar()


def upsert_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Fold threshold changes (``seq``, ``metric``, ``threshold``) into the rules.

    The latest change sets the threshold; a metric without a rule gets a new one. Of several rules
    for one metric the latest stays.
    """
    old = rules.groupBy("metric").agg(F.max_by("threshold", "id").alias("old_threshold"),
                                      F.max_by("rule_name", "id").alias("old_name"))
    new = changes.groupBy("metric").agg(F.max_by("threshold", "seq").alias("new_threshold"))
    name = F.concat(F.lit("Default "), F.initcap("metric"), F.lit(" Check"))
    return (old.join(new, "metric", "full_outer")
            .select("metric", F.coalesce("old_name", name).alias("rule_name"),
                    F.coalesce("new_threshold", "old_threshold").alias("threshold")))


def with_status(events: DataFrame, rules: DataFrame, temperature: Column | None = None) -> DataFrame:
    value = F.col("temperature") if temperature is None else temperature
    return events.withColumn("status", classify(value, threshold_value(rules)))


def derived_id(source_id: Column, kind: str) -> Column:
    """An id that a retried or replayed event gets again, so that sinks can drop the copy."""
    return F.sha2(F.concat(F.lit(f"{kind}:"), source_id.cast("string")), 256)


def to_processed(events: DataFrame, event_id: Column | None = None, now: Column | None = None) -> DataFrame:
    """The processed event: a new id, the original id, correlation id, status, enriched data and whatever else it brought.

    Columns without a place of their own go to ``payload``, a map from name to text without nulls.
    """
    new_id = derived_id(F.col("event_id"), "processed") if event_id is None else event_id
    own = {"event_id", "correlation_id", "ts", "device_id", "status", "temperature", "humidity", "vibration", "device_type"}
    rest = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in events.columns if c not in own]
    payload = (F.map_from_entries(F.filter(F.array(*rest), lambda e: e["value"].isNotNull())) if rest
               else F.lit(None).cast("map<string,string>"))
    correlation = F.col("correlation_id").cast("string") if "correlation_id" in events.columns else F.lit(None).cast("string")
    return events.select(
        correlation.alias("correlation_id"), payload.alias("payload"),
        new_id.alias("event_id"), F.col("event_id").alias("original_event_id"),
        F.lit("ProcessedTelemetryEvent").alias("event_type"), F.lit("1.0").alias("version"),
        F.lit("processing-service").alias("source_service"),
        (F.col("ts") if now is None else now).alias("ts"), "device_id", "status",
        F.struct("temperature", "humidity", "vibration", F.col("device_type").alias("deviceType"))
        .alias("enriched_data"))


def reasoned(events: DataFrame, devices: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Raw records parsed once: the text, the event as struct ``d``, and the reason why it is a dead letter, or null.

    ``schema`` describes the raw event; ``deviceId`` and ``payload`` decide. Extra columns such as topic, partition and offset
    are kept. A sink writes this once and splits by ``reason``.
    """
    extra = [c for c in events.columns if c != value]
    parsed = events.select(*extra, F.col(value).cast("string").alias("raw")).withColumn(
        "d", F.from_json("raw", schema))
    known = devices.select(F.col("device_id").alias("_device")).withColumn("_known", F.lit(True))
    checked = lookup_join(parsed.withColumn("_device", F.col("d.deviceId")), known, "_device", "left")
    reason = (F.when(F.col("d.deviceId").isNull(), "malformed")
              .when(F.col("d.payload").isNull(), "null_payload")
              .when(F.col("_known").isNull(), "unknown_device"))
    return checked.withColumn("reason", reason).select(*extra, "raw", "d", "reason")


def split_dead_letters(events: DataFrame, devices: DataFrame, schema: str,
                       value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Those records that can be processed, and dead letters with a reason; store ``reasoned`` first to parse only once."""
    extra = [c for c in events.columns if c != value]
    checked = reasoned(events, devices, schema, value)
    ok = checked.where(F.col("reason").isNull()).select(*extra, "d.*")
    topic = [] if "topic" in extra else [F.lit(TOPIC_RECEIVED).alias("topic")]
    dead = checked.where(F.col("reason").isNotNull()).select(
        *extra, *topic, "raw", F.col("d.deviceId").alias("device_id"), "reason")
    return ok, dead
