"""Exact percentile of a column of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import stored

# Values that may be sorted in one task; the formula is the same for any number.
ONE_TASK_ROWS = 1_000_000
BUCKETS = 4096
ACCURACY = 10_000  # of the sketch; its error is 1 / ACCURACY of the ranks


def _value_at(df: DataFrame, col: str, rank: int, one_task_rows: int) -> float:
    """The value with ``rank`` (from 0) in sorted order.

    Each round counts values in equal-width buckets with map-side combine and goes on with the
    bucket that holds the rank, until what is left fits one task or is a single value.
    """
    x = F.col(col)
    rows = df
    n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    while n > one_task_rows and low < high:
        width = (high - low) / BUCKETS
        if width == 0 or math.isinf(width):
            width = high / BUCKETS - low / BUCKETS or math.ulp(low)
        bucket = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(BUCKETS - 1).cast("bigint"))
        parts = (rows.groupBy(bucket.alias("b"))
                 .agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
                 .orderBy("b").collect())  # at most BUCKETS rows
        for part in parts:
            if rank < part["n"]:
                break
            rank -= part["n"]
        if part["n"] == n and (part["low"], part["high"]) == (low, high):
            break  # neighbouring doubles: no finer split exists
        n, low, high = part["n"], part["low"], part["high"]
        rows = df.where(x.between(low, high))
    if low == high:
        return low
    ordered = rows.select(x.alias("v")).orderBy("v")
    return ordered.offset(rank).limit(1).first()["v"]


def exact_percentile(df: DataFrame, col: str, p: float, one_task_rows: int = ONE_TASK_ROWS, accuracy: int = ACCURACY) -> float | None:
    """Percentile with linear interpolation between the two neighbouring ranks; nulls are left out.

    Two passes: a mergeable sketch, whose error in ranks has a bound, gives two values with both ranks between them; then equal
    values between these are counted, with map-side combine, together with all that are less. If more than
    ``one_task_rows`` different values lie there, they are narrowed further by counting.
    """
    v = F.col("v")
    values = df.select(F.col(col).cast("double").alias("v")).where(F.col(col).isNotNull())
    sure = 2.0 / accuracy  # the sketch errs by 1 / accuracy of the ranks
    n, bracket = values.agg(F.count(v), F.percentile_approx(v, [max(0.0, p - sure), min(1.0, p + sure)], accuracy)).first()
    if n == 0:
        return None
    position = p * (n - 1)
    at = math.floor(position)
    low, high = bracket
    inside = stored(values.where(v <= high).groupBy(F.when(v >= low, v).alias("v")).agg(F.count(F.lit(1)).alias("n")), "bracket")
    below = inside.where("v is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranked = inside.where("v is not null")
    there, rows = ranked.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = range(at, at + 1 + (position > at))
    if not below <= at or wanted[-1] >= below + rows or there > one_task_rows:  # few rows, or very many different values
        found = [_value_at(values, "v", rank, one_task_rows) for rank in wanted]
    else:
        until = F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + F.lit(below)
        placed = ranked.select("v", until.alias("until"), (until - F.col("n")).alias("since"))
        found = [r["v"] for rank in wanted for r in placed.where((F.col("since") <= rank) & (F.col("until") > rank)).collect()]
    return found[0] if len(found) == 1 else found[0] + (found[1] - found[0]) * (position - at)


def threshold(scored: DataFrame, col: str = "score", p: float = 0.05,
              one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """One row with the threshold, as a table that other steps can join or store."""
    value = exact_percentile(scored, col, p, one_task_rows)
    return scored.sparkSession.range(1).select(F.lit(value).cast("double").alias("threshold"))
