"""Rows carried from one micro-batch to the next, kept as tables in the shared folder.

A sink keeps the last rows of every key. For a micro-batch it reads those of the keys in it, computes on them and the new rows
together with the operators of the batch jobs, and writes the new last rows under its batch id. So a hot key is split like in a
batch job, nothing is held in Python, and a replayed micro-batch finds the same state and overwrites its own output.

Between micro-batches the order of arrival rules, inside one the given order. Every FOLD micro-batches the newest rows of all
keys are written together; versions from before the last but one such batch are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.analytics import HISTORY_LENGTH
from tidewatch.operators.features import STREAM_WINDOW, rolling_features
from tidewatch.operators.ordered import newest_per_key
from tidewatch.schemas import SENSORS
from tidewatch.session import Notes, remove, stored_as

FOLD = 64
ARRIVAL = "_arrival"  # the micro-batch a row came in
Sink = Callable[[DataFrame, int], None]


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch: a replayed batch overwrites its own output and nothing else."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


class Versions:
    """The newest rows of every key under ``path``: a full table now and then, and what changed since.

    A note beside the table names the folders that count, so that nothing has to be listed or searched for them.
    """

    def __init__(self, path: str, key: str, schema: T.StructType, fold: int = FOLD) -> None:
        self.path, self.key, self.fold = path, key, fold
        self.schema = T.StructType([*schema.fields, T.StructField("full", T.IntegerType()), T.StructField("batch", T.LongType())])

    def _notes(self, spark: SparkSession) -> Notes:
        return Notes(spark, f"{self.path}-notes", keep=4)

    def _note(self, spark: SparkSession, before: int) -> dict:
        """``versions``: (full, batch) of the last full table and all after it, in order; ``old``: those that the full one replaced."""
        return self._notes(spark).before(before) or {"versions": [], "old": []}

    def _folder(self, version: tuple[int, int]) -> str:
        return f"{self.path}/full={version[0]}/batch={version[1]}"

    def _read(self, spark: SparkSession, note: dict, keys: DataFrame | None) -> DataFrame:
        if not note["versions"]:
            return spark.createDataFrame([], T.StructType(self.schema.fields[:-2]))
        rows = spark.read.schema(self.schema).option("basePath", self.path).parquet(*map(self._folder, note["versions"]))
        rows = rows if keys is None else rows.join(keys, self.key, "left_semi")
        # at most ``fold`` versions of a key's few rows; the window's shuffle by key serves what follows as well
        newest = F.max("batch").over(W.partitionBy(self.key))
        return rows.withColumn("_newest", newest).where("batch = _newest").drop("_newest", "full", "batch")

    def before(self, spark: SparkSession, batch_id: int, keys: DataFrame | None = None) -> DataFrame:
        """Rows as they were before ``batch_id``; those of ``keys`` only, if given."""
        return self._read(spark, self._note(spark, batch_id), keys)

    def now(self, spark: SparkSession) -> DataFrame:
        return self.before(spark, 1 << 62)

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """The rows of the keys that a micro-batch changed; a full table when one is due. Folders that a full table replaced go when
        the next one is written, as a replay still reads them."""
        spark = changed.sparkSession
        note = self._note(spark, batch_id)
        versions = [tuple(v) for v in note["versions"]]
        full = batch_id - (versions[0][1] if versions and versions[0][0] else 0) >= self.fold
        if full:
            others = self._read(spark, note, None).join(changed.select(self.key).distinct(), self.key, "left_anti")
            changed = others.unionByName(changed)
        own = (int(full), batch_id)
        changed.write.mode("overwrite").parquet(self._folder(own))
        self._notes(spark).write(batch_id, {"versions": [own] if full else [*versions, own], "old": versions if full else note["old"]})
        if full:
            for version in note["old"]:
                remove(spark, self._folder(version))


def carrying(folder: str, key: str, order: tuple[str, ...], n: int, keep: tuple[str, ...],
             compute: Callable[[DataFrame, tuple[str, ...]], DataFrame], write: Sink, fold: int = FOLD) -> Sink:
    """A sink that computes on a micro-batch with the last ``n`` rows of its keys before it.

    ``compute`` gets the rows and their order and must keep the column ARRIVAL; what it returns for the new rows goes to
    ``write``. ``keep`` are the columns that earlier rows need.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = stored_as(batch.withColumn(ARRIVAL, F.lit(batch_id).cast("long")), f"{folder}/incoming/batch={batch_id}")
        carried = fresh.select(*dict.fromkeys([key, *order, *keep, ARRIVAL]))
        tails = Versions(f"{folder}/tails", key, carried.schema, fold)
        held = tails.before(spark, batch_id, fresh.select(key).distinct())
        sequence = (ARRIVAL, *order)
        computed = compute(held.unionByName(fresh, allowMissingColumns=True), sequence)
        write(computed.where(F.col(ARRIVAL) == batch_id).drop(ARRIVAL), batch_id)
        tails.write(newest_per_key(held.unionByName(carried), key, list(sequence), n, rank="_rank").drop("_rank"), batch_id)
        remove(spark, f"{folder}/incoming/batch={batch_id}")
    return run


def rolling_sink(folder: str, write: Sink, n: int = STREAM_WINDOW, key: str = "device_id",
                 order: tuple[str, ...] = ("ts", "event_id"), fold: int = FOLD, group_rows: int | None = None) -> Sink:
    """The rolling features of every event, its other columns kept, windows carried across micro-batches."""
    return carrying(folder, key, order, max(n - 1, 1), SENSORS,
                    lambda rows, sequence: rolling_features(rows, n, key, sequence, group_rows), write, fold)


def history_sink(folder: str, n: int = HISTORY_LENGTH, fold: int = FOLD) -> Sink:
    """Keeps the newest ``n`` snapshots of every device; ``read_history`` reads them."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        filled = batch.select("device_id", "event_id", "ts", *[F.coalesce(s, F.lit(0.0)).alias(s) for s in SENSORS],
                              F.lit(batch_id).cast("long").alias(ARRIVAL))
        fresh = newest_per_key(filled, "device_id", ["ts", "event_id"], n, rank="_rank").drop("_rank")
        fresh = stored_as(fresh, f"{folder}/incoming/batch={batch_id}")
        rings = Versions(f"{folder}/rings", "device_id", fresh.schema, fold)
        held = rings.before(spark, batch_id, fresh.select("device_id").distinct())
        rings.write(newest_per_key(held.unionByName(fresh), "device_id", [ARRIVAL, "ts", "event_id"], n, rank="_rank").drop("_rank"),
                    batch_id)
        remove(spark, f"{folder}/incoming/batch={batch_id}")
    return run


def read_history(spark: SparkSession, folder: str, event_id: str = "bigint", n: int = HISTORY_LENGTH) -> DataFrame:
    """The rings of all devices, position 1 being the newest snapshot."""
    schema = T._parse_datatype_string(f"device_id string, event_id {event_id}, ts timestamp, "
                                      + ", ".join(f"{s} double" for s in SENSORS) + f", {ARRIVAL} bigint")
    rings = Versions(f"{folder}/rings", "device_id", schema).now(spark)
    return newest_per_key(rings, "device_id", [ARRIVAL, "ts", "event_id"], n, rank="position").drop(ARRIVAL)


def upsert_sink(path: str, key: str, fold: int = FOLD) -> Sink:
    """Changed rows of an update-mode aggregate; ``read_upserts`` gives the newest row of every key."""
    def run(batch: DataFrame, batch_id: int) -> None:
        Versions(path, key, batch.schema, fold).write(batch, batch_id)
    return run


def read_upserts(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    return Versions(path, key, T._parse_datatype_string(schema)).now(spark)


SKETCH = "bucket string, sketch binary"
SKETCH_SIZE = 14  # log2 of a sketch's registers: a standard error of 0.8 % beyond a few thousand devices, exact or nearly so below


def distinct_sink(path: str, key: Column, bucket: Column, fold: int = FOLD) -> Sink:
    """Keeps a HyperLogLog sketch of the distinct keys of every bucket (a day, say), merged over micro-batches; ``read_distinct`` reads them.

    A micro-batch sends one sketch per bucket and task; a replay starts from the sketches before it. Rows without key or bucket don't
    count.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        table = Versions(path, "bucket", T._parse_datatype_string(SKETCH), fold)
        own = batch.select(bucket.cast("string").alias("bucket"), key.cast("string").alias("key")).where("bucket is not null and key is not null")
        fresh = own.groupBy("bucket").agg(F.hll_sketch_agg("key", SKETCH_SIZE).alias("sketch"))
        fresh = stored_as(fresh, f"{path}-incoming/batch={batch_id}")
        held = table.before(batch.sparkSession, batch_id, fresh.select("bucket"))
        table.write(held.unionByName(fresh).groupBy("bucket").agg(F.hll_union_agg("sketch").alias("sketch")), batch_id)
        remove(batch.sparkSession, f"{path}-incoming/batch={batch_id}")
    return run


def read_distinct(spark: SparkSession, path: str, buckets: Column | None = None) -> DataFrame:
    """(bucket, devices): estimates per bucket, and under a null bucket that of all chosen buckets together."""
    sketches = Versions(path, "bucket", T._parse_datatype_string(SKETCH)).now(spark)
    sketches = sketches if buckets is None else sketches.where(buckets)
    each = sketches.select("bucket", F.hll_sketch_estimate("sketch").alias("devices"))
    whole = sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("devices")).where("devices is not null")
    return each.unionByName(whole.select(F.lit(None).cast("string").alias("bucket"), "devices"))
