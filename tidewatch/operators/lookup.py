"""Key lookups against a registry table of unknown size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.sizing import BROADCAST_BYTES, estimated_bytes, group_limit, hot_keys
from tidewatch.session import stored


SALTS = 16  # parts of a key's facts where its rows can't be counted first


def _salted(facts: DataFrame, table: DataFrame, on: str, how: str, hot: Sequence[str] | None, salts: int) -> DataFrame:
    """Join with the facts of hot keys, or of all keys, in ``salts`` parts and their table rows copied as often. No pass over the facts
    comes first, so it holds on streams. Facts without a key are spread as well."""
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(salts)).cast("int")
    if hot is not None:
        named = F.col(on).cast("string").isin(list(hot)) if hot else F.lit(False)
        part = F.when(named | F.col(on).isNull(), part).otherwise(F.lit(0))
        every = F.when(named, every).otherwise(F.array(F.lit(0)))
    spread = facts.withColumn("_salt", part)
    copies = table.withColumn("_salt", F.explode(every))
    return spread.join(copies, [on, "_salt"], how).drop("_salt")


def lookup_join(facts: DataFrame, table: DataFrame, on: str, how: str = "inner",
                group_rows: int | None = None, broadcast_bytes: int = BROADCAST_BYTES,
                table_bytes: int | None = None, hot: Sequence[str] | None = None, salts: int = SALTS) -> DataFrame:
    """Join ``facts`` to a ``table`` on one column (inner, left, left_semi or left_anti).

    A table within the broadcast limit is broadcast. Beyond it the join shuffles, and facts of hot
    keys are kept out of the single task their key would hash to: where a hot key has one table
    row, those rows are few enough to broadcast; otherwise facts are salted and the table rows of
    hot keys are copied once per salt.

    A stream can't be counted beforehand: the facts of all its keys are salted, or only of the keys in ``hot`` (as text), where
    the caller knows them (``HeavyKeys``); a micro-batch with ``hot`` is not counted either.

    ``table_bytes`` is the size of ``table`` where the caller knows it better than Catalyst, which
    multiplies the sides of a join and does not see rows added by an explode.
    """
    size = estimated_bytes(table) if table_bytes is None else table_bytes
    if size <= broadcast_bytes:
        return facts.join(F.broadcast(table), on, how)
    if facts.isStreaming or hot is not None:
        return _salted(facts, table, on, how, hot, salts)
    limit = group_limit(facts.select(on), group_rows)
    if limit is None:
        return facts.join(table, on, how)
    # facts without a key match nothing, and would share one task
    keyless = facts.where(F.col(on).isNull()).join(table.where(F.lit(False)), on, how)
    facts = facts.where(F.col(on).isNotNull())
    parts = F.ceil(F.col("_rows") / limit).cast("int").alias("_salts")
    counted = stored(hot_keys(facts, [on], limit).select(on, parts), "hot-keys")
    if counted.isEmpty():
        return facts.join(table, on, how).unionByName(keyless)
    counted = F.broadcast(counted)
    rest = facts.join(counted, on, "left_anti").join(table, on, how)
    hot_table = stored(table.join(counted.select(on), on, "left_semi"), "hot-rows")
    # one row per hot key is few rows, but each may be wide
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in hot_table.columns]))
    weight = hot_table.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    single = hot_table.groupBy(on).count().where("count > 1").isEmpty()
    if single and weight <= max(broadcast_bytes, BROADCAST_BYTES):
        joined = facts.join(counted.select(on), on, "left_semi").join(F.broadcast(hot_table), on, how)
    else:
        salted = (facts.join(counted, on)
                  .withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.col("_salts")).cast("int"))
                  .drop("_salts"))
        copies = (table.join(counted, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
                  .drop("_salts"))
        joined = salted.join(copies, [on, "_salt"], how).drop("_salt")
    return joined.unionByName(rest).unionByName(keyless)
