"""Expressions over single sensor readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status names, alert severities and rule constants of the telemetry domain.
STATUS_CRITICAL = "CRITICAL"
STATUS_WARNING = "WARNING"
STATUS_NORMAL = "NORMAL"
SEVERITY_HIGH = "HIGH"
SEVERITY_MEDIUM = "MEDIUM"
DEFAULT_THRESHOLD = 100.0
WARNING_SHARE = 0.8
TEMPERATURE_METRIC = "temperature"
# JSON number types as named by schema_of_variant
NUMBER_TYPES = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def classify(temperature: Column, limit: Column) -> Column:
    """Status of one reading; a missing reading is NORMAL."""
    return (F.when(temperature > limit, STATUS_CRITICAL)
            .when(temperature > limit * WARNING_SHARE, STATUS_WARNING)
            .otherwise(STATUS_NORMAL))


def json_number(payload: Column, key: str) -> Column:
    """``payload[key]`` when the JSON value is a number; a numeric text or other type gives null."""
    field = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    is_number = F.schema_of_variant(field).rlike(NUMBER_TYPES)
    return F.when(is_number, F.try_variant_get(field, "$", "double"))


def alert_severity(status: Column) -> Column:
    """Severity of the alert for a status, null when none is raised."""
    return F.when(status == STATUS_CRITICAL, SEVERITY_HIGH).when(status == STATUS_WARNING, SEVERITY_MEDIUM)


def map_text(fields: dict[str, Column]) -> Column:
    """``{a=1.0, b=x}`` with keys in sorted order and ``null`` for missing values."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(fields[k].cast("string"), F.lit("null")))
             for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def alert_message(status: Column, device_id: Column, data: Column) -> Column:
    return F.format_string("%s condition detected for device %s. Data: %s", status, device_id, data)


def clip(x: Column, low: float, high: float) -> Column:
    """Bound ``x``; null stays null."""
    return F.when(x > high, F.lit(high)).when(x < low, F.lit(low)).otherwise(x)


def has_gps(lat: Column, lng: Column) -> Column:
    return lat.isNotNull() & lng.isNotNull()


def heat_intensity(is_anomaly: Column, score: Column) -> Column:
    return F.when(is_anomaly, F.greatest(F.lit(0.6), F.coalesce(score, F.lit(0.6)))).otherwise(F.lit(0.15))


def marker_class(lat: Column, lng: Column, status: Column, is_anomaly: Column, score: Column) -> Column:
    return (F.when(~has_gps(lat, lng), "blue")
            .when(status.isNull() | (status != "ACTIVE"), "gray")
            .when(is_anomaly, "red")
            .when(F.coalesce(score, F.lit(0.0)) > 0.3, "yellow")
            .otherwise("green"))
