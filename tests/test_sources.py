"""The lake, tables, published records and the scratch folder."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import lake as ops
from tidewatch.session import scratch_dir
from tidewatch.sources import lake
from tidewatch.sources.tables import TableConfig, read_table


def nested(spark, n, day=1):
    return spark.range(n).select(
        F.concat(F.lit("d"), F.col("id") % 3).alias("deviceId"), F.col("id").alias("eventId"),
        F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.struct(F.col("id").cast("double").alias("temperature")).alias("enrichedData"),
        F.lit(dt.datetime(2026, 1, day, 5)).alias("arrival_timestamp"))


def test_lake_round_trip(spark):
    path = scratch_dir(spark, "lake")
    lake.append_lake(nested(spark, 5), path)
    lake.append_lake(nested(spark, 7, day=2).withColumn("extra", F.lit("x")), path)
    lake.append_lake(nested(spark, 2, day=3).drop("deviceId"), path)
    df = lake.read_lake(spark, path)
    assert "enrichedData.temperature" in df.columns
    assert {r.day: r["count"] for r in df.groupBy("day").count().collect()} == {"2026-01-01": 5, "2026-01-02": 7}
    assert df.where("extra is null").count() == 5


def test_unreadable_files_are_skipped(spark):
    path = scratch_dir(spark, "lake")
    lake.append_lake(nested(spark, 5), path)
    with open(os.path.join(path, "day=2026-01-01", "event_broken.parquet"), "wb") as f:
        f.write(b"this is no parquet file")
    assert lake.read_lake(spark, path, skip_corrupt=True).count() == 5
    assert [r.file for r in lake.skipped_files(spark, path).collect()] == ["event_broken.parquet"]
    with pytest.raises(Exception, match="event_broken"):
        lake.read_lake(spark, path).count()
    schema = "deviceId string, `enrichedData.temperature` double, day string"
    assert lake.read_lake(spark, path, schema, skip_corrupt=True).count() == 5


def test_day_filter_prunes_partitions(spark, capsys):
    path = scratch_dir(spark, "lake")
    lake.append_lake(nested(spark, 5), path)
    lake.append_lake(nested(spark, 5, day=2), path)
    newest = ops.latest(lake.read_lake(spark, path), 3, since_day="2026-01-02")
    assert newest.count() == 3
    newest.explain()
    text = capsys.readouterr().out
    assert "PartitionFilters: []" not in text and "TakeOrderedAndProject" in text


def test_newest_reads_the_last_days_only(spark):
    """Thirty days of 40 records, of which the newest 60 lie in two; a day without devices counts for nothing."""
    path = scratch_dir(spark, "lake")
    every = spark.range(1200).select(
        F.concat(F.lit("d"), F.col("id") % 3).alias("deviceId"), F.col("id").alias("eventId"), F.lit("x").alias("timestamp"),
        F.expr("timestamp'2026-01-01' + make_dt_interval(cast(id div 40 as int), 0, cast(id % 40 as int))").alias("arrival_timestamp"))
    lake.append_lake(every, path)
    newest = lake.read_newest(spark, path, 60)
    assert [r.eventId for r in newest.collect()] == list(range(1199, 1139, -1))
    read = {part for f in newest.inputFiles() for part in f.split("/") if part.startswith("day=")}
    assert read == {"day=2026-01-28", "day=2026-01-29", "day=2026-01-30"}  # in rounds of one and two days
    assert lake.read_newest(spark, path, 40).inputFiles()[0].count("day=2026-01-30") == 1
    assert lake.read_newest(spark, path, 5000).count() == 1200
    lake.append_lake(every.limit(50).drop("deviceId").withColumn("arrival_timestamp", F.lit(dt.datetime(2026, 2, 1))), path)
    lake.append_lake(every.limit(3).withColumn("arrival_timestamp", F.lit(None).cast("timestamp")), path)
    assert [r.eventId for r in lake.read_newest(spark, path, 60).collect()] == list(range(1199, 1139, -1))
    assert lake.read_newest(spark, path, 1203).where("arrival_timestamp is null").count() == 3


def test_arrival_is_stamped_when_missing(spark):
    df = lake.with_arrival(nested(spark, 1).drop("arrival_timestamp"), F.lit(dt.datetime(2026, 3, 4)))
    r = df.first()
    assert r.arrival_timestamp == dt.datetime(2026, 3, 4) and r.day == "2026-03-04"


def test_recent_per_device_is_oldest_first(spark):
    rows = [("a", i, i) for i in range(8)] + [("b", 100, 1)]
    df = spark.createDataFrame(rows, "deviceId string, eventId int, arrival_timestamp int")
    got = {(r.deviceId, r.position): r.eventId for r in ops.recent_per_device(df, 3).collect()}
    assert got == {("a", 1): 5, ("a", 2): 6, ("a", 3): 7, ("b", 1): 100}


def test_stats_of_an_empty_lake(spark):
    df = spark.createDataFrame([], "deviceId string, eventId int, timestamp string, arrival_timestamp int")
    assert tuple(ops.lake_stats(df).first()) == (0, 0, None)


def test_tables(spark):
    assert read_table(spark, "region", TableConfig(location="/root/testdata/sf0.001")).count() == 5


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://cluster:7077"
    with pytest.raises(ValueError):
        scratch_dir(Session(), "x")
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
