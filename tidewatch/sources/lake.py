"""The event lake: Parquet files under ``day=YYYY-MM-DD``."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidewatch.operators.ingest import flatten
from tidewatch.operators.lake import day_of, latest
from tidewatch.schemas import ENRICHED, SENSORS
from tidewatch.session import names_in


def with_arrival(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Flattened events with the arrival time, unless they carry one, and the day of arrival."""
    flat = flatten(df)
    arrival = F.current_timestamp() if now is None else now
    if "arrival_timestamp" not in flat.columns:
        flat = flat.withColumn("arrival_timestamp", arrival)
    return flat.withColumn("day", day_of(F.col("arrival_timestamp")))


def append_lake(df: DataFrame, path: str, now: Column | None = None) -> None:
    """Append events to the lake.

    Rebalancing by day keeps files large without one task per day: AQE splits a day with many
    rows and merges days with few.
    """
    rows = with_arrival(df, now)
    note_schema(rows, path)
    rows.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def lake_rows(events: DataFrame) -> DataFrame:
    """Flat events (``device_id``, ``event_id``, ``ts``, sensors and more) under the names of the lake.

    The arrival time is the event's own unless it brings one, so a replayed event is stored under the same day.
    """
    renamed = {"device_id": "deviceId", "event_id": "eventId", "ts": "timestamp", **{s: ENRICHED + s for s in SENSORS}}
    arrival = [] if "arrival_timestamp" in events.columns else [F.col("ts").alias("arrival_timestamp")]
    return events.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in events.columns], *arrival)


def write_lake_batch(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Store the rows of a micro-batch under ``day=.../batch=N``; a replay overwrites them. Returns what was written."""
    placed = rows.withColumn("day", day_of(F.col("arrival_timestamp"))).withColumn("batch", F.lit(batch_id).cast("long"))
    note_schema(placed, path)
    (placed.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "batch").parquet(path))
    return placed.sparkSession.read.schema(placed.schema).parquet(path).where(F.col("batch") == batch_id)


def note_schema(rows: DataFrame, path: str) -> None:
    """Remember the columns beside the lake, so that a reader need not open every footer."""
    spark = rows.sparkSession
    text = T.StructType(sorted(rows.schema.fields, key=lambda f: f.name)).json()
    if text not in _noted(spark, path):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(f"{path.rstrip('/')}-schema")


def _noted(spark: SparkSession, path: str) -> list[str]:
    try:
        return [r["value"] for r in spark.read.text(f"{path.rstrip('/')}-schema").distinct().collect()]  # one row per set of columns
    except AnalysisException:
        return []


def lake_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """All columns ever written to the lake; null if none were noted, or one has had several types."""
    fields: dict[str, T.StructField] = {}
    for text in sorted(_noted(spark, path)):
        for field in T.StructType.fromJson(json.loads(text)).fields:
            if fields.setdefault(field.name, field).dataType != field.dataType:
                return None
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()]) if fields else None


def read_lake(spark: SparkSession, path: str, schema: str | T.StructType | None = None, skip_corrupt: bool = False) -> DataFrame:
    """All files, their columns merged; rows of files without ``deviceId`` are left out.

    The columns are those given, else those noted beside the lake, else merged from all footers. ``day`` is a partition column,
    so a filter on it prunes folders. A file that cannot be read is an error, unless ``skip_corrupt`` is set:
    ``skipped_files`` then names what was left out.
    """
    schema = schema or lake_schema(spark, path)
    reader = spark.read.option("ignoreCorruptFiles", skip_corrupt).option("recursiveFileLookup", False)
    reader = reader.schema(schema) if schema else reader.option("mergeSchema", True)
    df = reader.parquet(path)
    return df.where(F.col("deviceId").isNotNull()).withColumn("day", F.col("day").cast("string"))


def read_newest(spark: SparkSession, path: str, n: int = 1000, order: tuple[str, ...] = ("arrival_timestamp", "eventId")) -> DataFrame:
    """The newest ``n`` records of a lake, newest first, reading only the last days that hold them.

    The day folders are walked from the newest, twice as many in each round; a day is counted by its non-null devices, a single
    column, until there are ``n``. ``order`` must begin with the time of arrival, which the days follow; records without
    one come last. Other days are neither listed nor opened.
    """
    nothing = "__HIVE_DEFAULT_PARTITION__"
    days = [name for name in reversed(names_in(spark, path)) if name.startswith("day=") and not name.endswith(nothing)]
    days += [f"day={nothing}"] * (f"day={nothing}" in names_in(spark, path))
    schema = lake_schema(spark, path)

    def rows(some: list[str]) -> DataFrame:
        reader = spark.read.option("basePath", path)
        reader = reader.schema(schema) if schema else reader.option("mergeSchema", True)
        return reader.parquet(*[f"{path}/{day}" for day in some]).where(F.col("deviceId").isNotNull()).withColumn("day", F.col("day").cast("string"))

    if not days:
        return read_lake(spark, path).orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)
    held, taken, step = 0, 0, 1
    while taken < len(days) and held < n:
        held += rows(days[taken : taken + step]).count()
        taken, step = min(len(days), taken + step), 2 * step
    return latest(rows(days[:taken]), n, order)


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """Names of Parquet files below the lake from which ``skip_corrupt`` gets no row."""
    there = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("file")))
    schema = lake_schema(spark, path)
    reader = spark.read.option("ignoreCorruptFiles", True)
    rows = (reader.schema(schema) if schema else reader).parquet(path)
    read = rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).distinct()
    return there.join(read, "file", "left_anti")
