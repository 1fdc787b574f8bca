"""The z-score and trend detectors and the weighted vote over all three models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detector limits, vote weights and the wording of reasons.
ZSCORE_LIMIT = 3.0
TREND_STD_LIMIT = 5.0
TREND_RANGE_LIMIT = 10.0
WEIGHT_ISOLATION = 2
WEIGHT_ZSCORE = 1
WEIGHT_TREND = 1
VOTES_FOR_ANOMALY = 2
# Fixed value: severity for 0, 1, 2, 3 and 4 votes.
SEVERITY_BY_VOTES = ("NORMAL", "LOW", "HIGH", "HIGH", "CRITICAL")
REASON_NONE = "All models nominal"


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """Distance from the mean in standard deviations; 0 without a spread or without features."""
    x = F.coalesce(x, F.lit(0.0))
    std = F.coalesce(std, F.lit(0.0))
    return F.when(std > 0, F.try_divide(F.abs(x - F.coalesce(mean, x)), std)).otherwise(F.lit(0.0))


def trend_flag(trend: Column, std: Column, value_range: Column,
               std_limit: float = TREND_STD_LIMIT, range_limit: float = TREND_RANGE_LIMIT) -> Column:
    rising = F.coalesce(trend, F.lit("stable")) == "increasing"
    return (rising & (F.coalesce(std, F.lit(0.0)) > std_limit)
            & (F.coalesce(value_range, F.lit(0.0)) > range_limit))


def votes(isolation: Column, zs: Column, trend: Column) -> Column:
    return (isolation.cast("int") * WEIGHT_ISOLATION + zs.cast("int") * WEIGHT_ZSCORE
            + trend.cast("int") * WEIGHT_TREND)


def severity(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in SEVERITY_BY_VOTES]), n + 1)


def reason(if_flag: Column, if_score: Column, zs_flag: Column, max_z: Column,
           tr_flag: Column, trend: Column, temp_std: Column, temp_range: Column) -> Column:
    """A sentence for each model that fired. Numbers are rounded before they are formatted; a
    negative score keeps its sign when it rounds to zero."""
    sign = F.when(if_score < 0, "-").otherwise("")
    isolation = F.format_string("Isolation Forest score %s%.3f below threshold", sign, F.abs(F.round(if_score, 3)))
    spread = F.format_string("Z-score %.1fσ exceeds 3σ threshold", F.round(F.round(max_z, 3), 1))
    rising = F.concat(F.lit("Rapidly "), trend, F.lit(" temperature (range "),
                      F.round(temp_range, 3).cast("string"), F.lit("°C, σ="),
                      F.round(temp_std, 3).cast("string"), F.lit("°C)"))
    joined = F.concat_ws("; ", F.when(if_flag, isolation), F.when(zs_flag, spread), F.when(tr_flag, rising))
    return F.when(joined == "", REASON_NONE).otherwise(joined)
