"""Row-ordered windows per key that survive a key holding a large share of all rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here a hot key is cut
into slices of its order, and every slice receives copies of the rows just before it, so that a
frame that looks back a fixed number of rows gives the same values as on the uncut key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.sizing import group_limit, hot_keys
from tidewatch.session import stored

_POINTS_PER_SLICE = 32  # sampled order values per slice; only balance depends on it

ColumnsOf = Callable[[WindowSpec], dict[str, Column]]


def _position(order: list[str]) -> Column:
    """A comparable struct that sorts like ``order`` with nulls last."""
    parts = []
    for i, name in enumerate(order):
        parts += [F.col(name).isNull().alias(f"n{i}"), F.col(name).alias(f"v{i}")]
    return F.struct(*parts)


def _sorted(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def _cut_points(df: DataFrame, key: str, order: list[str], hot: DataFrame, limit: int) -> DataFrame:
    """Per hot key a sorted array of order positions that cut it into slices of about ``limit`` rows."""
    every = max(1, limit // _POINTS_PER_SLICE)
    stride = min(_POINTS_PER_SLICE, limit)
    picked = F.pmod(F.xxhash64(key, *order), F.lit(every)) == 0
    return (df.join(F.broadcast(hot.select(key)), key, "left_semi").where(picked)
            .groupBy(key).agg(F.array_sort(F.collect_list(_position(order))).alias("_points"))
            .select(key, F.expr(f"filter(_points, (p, i) -> i % {stride} = {stride - 1})").alias("_cuts")))


def _with_slice(df: DataFrame, cuts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Number of cut points at or before each row: a binary search, one halving per projection, all
    in generated code. Rows of other keys have no cut points and stay in slice 0."""
    most = cuts.agg(F.max(F.size("_cuts"))).first()[0] or 0
    out = (df.join(F.broadcast(cuts), key, "left").withColumn("_position", _position(order))
           .withColumn("_slice", F.lit(0)))
    for step in reversed(range(most.bit_length())):
        width = 2 ** step
        passed = F.get("_cuts", F.col("_slice") + (width - 1)) <= F.col("_position")
        out = out.withColumn("_slice", F.when(passed, F.col("_slice") + width).otherwise(F.col("_slice")))
    return out


def _carried_rows(hot_rows: DataFrame, key: str, order: list[str], lookback: int,
                  only: Column | None, columns: list[str]) -> DataFrame:
    """For every slice but the first of a hot key, the last ``lookback`` rows before it."""
    source = hot_rows if only is None else hot_rows.where(only)
    newest = W.partitionBy(key, "_slice").orderBy(*[F.col(c).desc_nulls_first() for c in order])
    tails = (source.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= lookback)
             .groupBy(key, "_slice")
             .agg(F.array_sort(F.collect_list(F.struct(
                 _position(order).alias("at"), F.struct(*columns).alias("row")))).alias("_tail")))
    slices = hot_rows.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    earlier = W.partitionBy(key).orderBy("_slice")
    if only is None:  # every slice has a row, so this many slices hold enough of them
        before = F.flatten(F.collect_list("_tail").over(earlier.rowsBetween(-lookback, -1)))
    elif lookback == 1:
        before = F.last("_tail", ignorenulls=True).over(earlier.rowsBetween(W.unboundedPreceding, -1))
    else:
        raise ValueError("a filtered look-back carries one row")
    return (slices.join(tails, [key, "_slice"], "left")
            .withColumn("_before", before)
            .select("_slice", F.explode(F.expr(f"slice(_before, greatest(1, size(_before) - {lookback - 1}), {lookback})")
                                        ).alias("_r"))
            .select("_r.row.*", "_slice", F.lit(True).alias("_carried")))


def ordered_window(df: DataFrame, key: str, order: list[str], lookback: int, columns: ColumnsOf,
                   only: Column | None = None, group_rows: int | None = None) -> DataFrame:
    """Add ``columns(window)`` computed per ``key`` in ``order``.

    ``columns`` receives the ordered window and may look back at most ``lookback`` rows (of those
    matching ``only``, when given). ``order`` must be a total order inside a key. ``group_rows``
    overrides the size above which a key is split.
    """
    limit = group_limit(df.select(key, *order), group_rows)
    hot = stored(hot_keys(df, [key], limit), "hot-keys") if limit is not None else None
    if hot is None or hot.isEmpty():
        return df.withColumns(columns(W.partitionBy(key).orderBy(*_sorted(order))))
    names = df.columns
    quoted = [f"`{c}`" for c in names]
    cuts = stored(_cut_points(df, key, order, hot, limit), "cuts")
    placed = _with_slice(df, cuts, key, order)
    carried = _carried_rows(placed.where(F.col("_cuts").isNotNull()).select(*quoted, "_slice"),
                            key, order, lookback, only, quoted)
    whole = (placed.select(*quoted, "_slice", F.lit(False).alias("_carried"))
             .unionByName(carried.select(*quoted, "_slice", "_carried")))
    out = whole.withColumns(columns(W.partitionBy(key, "_slice").orderBy(*_sorted(order))))
    return out.where(~F.col("_carried")).drop("_slice", "_carried")


def newest_per_key(df: DataFrame, key: str, order: list[str], k: int, rank: str = "rank") -> DataFrame:
    """The last ``k`` rows of every key, ``rank`` 1 being the newest.

    The rank filter is applied before the shuffle too, so a task sends on at most ``k`` rows per key.
    """
    w = W.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key; copies are dropped before the shuffle too."""
    w = W.partitionBy(key).orderBy(*_sorted(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
