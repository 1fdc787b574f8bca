"""Timestamp normalisation for the encodings found in telemetry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_MS_ABOVE = 1e11  # a number above this is milliseconds, otherwise seconds


def normalize_ts(value: Column) -> Column:
    """Epoch milliseconds, epoch seconds (also in scientific notation) or ISO-8601 to a timestamp.

    A text without a zone is UTC whatever the session zone is. Anything else gives null.
    """
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    scale = F.when(number > EPOCH_MS_ABOVE, F.lit(1e3)).otherwise(F.lit(1e6))
    micros = F.round(number * scale).try_cast("bigint")
    day_only = F.length(text) == 10
    zoned = text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    iso = (F.when(~text.rlike("^[0-9]{4}-[0-9]{2}"), F.lit(None))
           .when(zoned, text)
           .when(day_only, F.concat(text, F.lit("T00:00:00Z")))
           .otherwise(F.concat(text, F.lit("Z"))))
    return F.when(number.isNotNull(), F.timestamp_micros(micros)).otherwise(F.try_to_timestamp(iso))


def display_ts(value: Column) -> Column:
    """The ISO text shown for a prediction; a value that is no number stays as it is."""
    text = value.cast("string")
    iso = F.date_format(normalize_ts(value), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return F.when(text.try_cast("double").isNotNull(), F.coalesce(iso, text)).otherwise(text)
