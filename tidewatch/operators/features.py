"""Rolling features per device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.readings import clip
from tidewatch.functions.timestamps import normalize_ts
from tidewatch.operators.ordered import ordered_window
from tidewatch.schemas import ENGINEERED, ENRICHED, SENSORS

STREAM_WINDOW = 20
ML_WINDOW = 5
TEMPERATURE_RANGE = (-50.0, 150.0)


def trend(temperature: str, w: WindowSpec) -> Column:
    """Direction of the last step; the first reading of a device is stable."""
    before = F.lag(temperature, 1).over(w)
    return (F.when(F.col(temperature) > before, "increasing")
            .when(F.col(temperature) < before, "decreasing").otherwise("stable"))


def rolling_columns(w: WindowSpec, n: int = STREAM_WINDOW) -> dict[str, Column]:
    """Statistics over the last ``n`` readings; the deviation is that of the population."""
    last = w.rowsBetween(-(n - 1), 0)
    low, high = F.min("temperature").over(last), F.max("temperature").over(last)
    return {
        "temp_mean": F.avg("temperature").over(last), "temp_std": F.stddev_pop("temperature").over(last),
        "temp_min": low, "temp_max": high, "temp_range": high - low,
        "hum_mean": F.avg("humidity").over(last), "hum_std": F.stddev_pop("humidity").over(last),
        "vib_mean": F.avg("vibration").over(last), "vib_std": F.stddev_pop("vibration").over(last),
        "event_count": F.count(F.lit(1)).over(last).cast("int"),
        "trend": trend("temperature", w),
    }


def rolling_features(events: DataFrame, n: int = STREAM_WINDOW, key: str = "device_id",
                     order: tuple[str, ...] = ("ts", "event_id"), group_rows: int | None = None) -> DataFrame:
    """Rolling statistics and trend for every event over its device's last ``n`` readings."""
    filled = events.withColumns({s: F.coalesce(s, F.lit(0.0)) for s in SENSORS})
    return ordered_window(filled, key, list(order), max(n - 1, 1),
                          lambda w: rolling_columns(w, n), group_rows=group_rows)


def ml_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(ENRICHED)]


def keep_ml_cols(df: DataFrame) -> DataFrame:
    """Device, timestamp and the enriched readings; the scan reads nothing else."""
    return df.select("deviceId", "timestamp", *[f"`{c}`" for c in ml_columns(df)])


def features_only(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in df.columns if c.startswith((ENRICHED, ENGINEERED))])


def validate(df: DataFrame) -> DataFrame:
    """Drop rows without device or time, make readings numbers, clip temperatures, fill nulls.

    Nulls of numeric columns become 0, those of text columns ``"0"``.
    """
    df = df.dropna(subset=["deviceId", "timestamp"])
    fixed = {}
    for c in ml_columns(df):
        number = F.col(f"`{c}`").cast("string").try_cast("double")
        if "temperature" in c:
            number = clip(number, *TEMPERATURE_RANGE)
        fixed[c] = F.coalesce(number, F.lit(0.0))
    for name, dtype in df.dtypes:
        if name in fixed:
            continue
        if dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") or dtype.startswith("decimal"):
            fixed[name] = F.coalesce(F.col(f"`{name}`"), F.lit(0).cast(dtype))
        elif dtype == "string":
            fixed[name] = F.coalesce(F.col(f"`{name}`"), F.lit("0"))
    return df.select(*[(fixed[c] if c in fixed else F.col(f"`{c}`")).alias(c) for c in df.columns])


def engineered_columns(columns: list[str], w: WindowSpec) -> dict[str, Column]:
    """Rolling mean, sample deviation, extremes and step of each column, over one shared window."""
    last = w.rowsBetween(-(ML_WINDOW - 1), 0)
    out: dict[str, Column] = {}
    for c in columns:
        x, short = F.col(f"`{c}`"), c.split(".")[-1]
        out[f"{ENGINEERED}{short}_rolling_mean_{ML_WINDOW}"] = F.avg(x).over(last)
        out[f"{ENGINEERED}{short}_rolling_std_{ML_WINDOW}"] = F.coalesce(F.stddev_samp(x).over(last), F.lit(0.0))
        out[f"{ENGINEERED}{short}_rolling_min_{ML_WINDOW}"] = F.min(x).over(last)
        out[f"{ENGINEERED}{short}_rolling_max_{ML_WINDOW}"] = F.max(x).over(last)
        out[f"{ENGINEERED}{short}_delta"] = F.coalesce(x - F.lag(x, 1).over(w), F.lit(0.0))
    return out


def prepare_for_ml(df: DataFrame, all_columns: bool = False, tie: str = "eventId",
                   keep: tuple[str, ...] = (), group_rows: int | None = None) -> DataFrame:
    """Validated readings with rolling features, one code path for training and scoring.

    Only the three sensors become features unless ``all_columns`` is set. ``tie`` orders events of
    one device with equal time. A frame without readings gives an empty result.
    """
    columns = ml_columns(df) if all_columns else [c for c in ml_columns(df) if c[len(ENRICHED):] in SENSORS]
    extra = [c for c in dict.fromkeys([tie, *keep]) if c in df.columns]
    if not columns:
        return df.select("deviceId", "timestamp", *extra).where(F.lit(False))
    base = (validate(df.select("deviceId", "timestamp", *extra, *[f"`{c}`" for c in columns]))
            .withColumn("timestamp", normalize_ts(F.col("timestamp"))))
    order = ["timestamp"] + ([tie] if tie in extra else [])
    return ordered_window(base, "deviceId", order, ML_WINDOW - 1,
                          lambda w: engineered_columns(columns, w), group_rows=group_rows)
