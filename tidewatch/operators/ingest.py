"""Parsing, validation and envelopes for incoming telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schemas import ENVELOPE_DEFAULTS, PROCESSED_EVENT


def parse_events(df: DataFrame, schema: str = PROCESSED_EVENT, value: str = "value") -> DataFrame:
    """JSON records to columns; a record that is malformed or has no device falls out."""
    return (df.select(F.from_json(F.col(value).cast("string"), schema).alias("d"))
            .select("d.*").where(F.col("deviceId").isNotNull()))


def _acceptable() -> Column:
    """A device id that is not blank and a payload object with at least one key."""
    keys = F.size(F.json_object_keys("payload"))
    return F.coalesce((F.length(F.trim("device_id")) > 0) & (keys > 0), F.lit(False))


def with_accepted(df: DataFrame) -> DataFrame:
    """Requests (``device_id``, ``payload`` JSON text) with the verdict in one pass."""
    return df.withColumn("accepted", _acceptable())


def validate_ingest(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests into accepted and rejected."""
    return df.where(_acceptable()), df.where(~_acceptable())


def to_envelope(df: DataFrame, now: Column, source_service: str = "ingestion-service",
                event_id: Column | None = None) -> DataFrame:
    """Stamp the common envelope, filling what the caller left out.

    Without ``event_id`` fresh random ids are drawn; pass a hash of the request where a retry of
    the task must give the same ids.
    """
    present = set(df.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in present else default

    new_id = event_id if event_id is not None else F.uuid()
    return df.withColumns({
        "event_id": new_id,
        "correlation_id": event_id if event_id is not None else F.uuid(),
        "event_type": given("event_type", F.lit(ENVELOPE_DEFAULTS["event_type"])),
        "version": given("version", F.lit(ENVELOPE_DEFAULTS["version"])),
        "ts": given("ts", now),
        "source_service": F.lit(source_service),
    })


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to columns with joined names, at any depth."""
    def leaves(schema: T.StructType, path: list[str]) -> list[Column]:
        out = []
        for field in schema.fields:
            here = [*path, field.name]
            if isinstance(field.dataType, T.StructType):
                out += leaves(field.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here)))
        return out
    return df.select(*leaves(df.schema, []))


def fill_readings(df: DataFrame, data: str = "enrichedData") -> DataFrame:
    """A missing reading becomes 0.0; a missing struct becomes zeros without type and location."""
    def number(name: str) -> Column:
        return F.coalesce(F.col(f"{data}.{name}"), F.lit(0.0)).alias(name)
    return df.withColumn(data, F.struct(
        number("temperature"), number("humidity"), number("vibration"),
        F.col(f"{data}.deviceType").alias("deviceType"),
        F.col(f"{data}.deviceLocation").alias("deviceLocation")))
