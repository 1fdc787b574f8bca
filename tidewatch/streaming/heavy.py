"""Which keys of a stream hold many rows, known before a micro-batch is joined.

A summary of at most ``counters`` keys is carried between micro-batches. Every task summarises its rows in bounded memory (counters that
are lowered together when there are too many), and the summaries add up: a key with more than rows / counters rows is always among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import Notes

COUNTERS = 1024
HOT_SHARE = 0.01  # a key with more of the rows than this is hot
KEPT = 0.5  # weight of what was before a micro-batch


def _lowered(counts: dict[str, int], counters: int) -> dict[str, int]:
    """At most ``counters`` keys: all are lowered by the largest count that has to go."""
    if len(counts) <= counters:
        return counts
    floor = sorted(counts.values(), reverse=True)[counters]
    return {k: n - floor for k, n in counts.items() if n > floor}


def summary(df: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """(key, n): keys, as text, and lower bounds of their rows; too low by rows / counters at most. Null keys are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for pair in pc.value_counts(batch.column(0).drop_null()).to_pylist():
                held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
            held = _lowered(held, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["key", "n"])

    return df.select(F.col(key).cast("string").alias("key")).mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


class HeavyKeys:
    """The summary of a stream's keys under ``path``."""

    def __init__(self, path: str, key: str, counters: int = COUNTERS) -> None:
        self.path, self.key, self.counters = path, key, counters

    def hot(self, spark: SparkSession, batch_id: int, share: float = HOT_SHARE) -> list[str]:
        """Keys that held more than ``share`` of the rows lately; at most 1 / share."""
        note = Notes(spark, self.path).before(batch_id)
        return sorted(k for k, n in note["counts"].items() if n > share * note["rows"]) if note else []

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Take a micro-batch in; the driver sees ``counters`` rows. A replay starts from the same note again."""
        notes = Notes(batch.sparkSession, self.path)
        note = notes.before(batch_id) or {"counts": {}, "rows": 0}
        found = summary(batch, self.key, self.counters).orderBy(F.desc("n"), "key").limit(self.counters + 1).collect()
        counts = {k: KEPT * n for k, n in note["counts"].items()}
        for r in found:
            counts[r.key] = counts.get(r.key, 0) + r.n
        rows = KEPT * note["rows"] + batch.where(F.col(self.key).isNotNull()).count()
        notes.write(batch_id, {"counts": {k: n for k, n in _lowered(counts, self.counters).items() if n >= 1}, "rows": rows})
