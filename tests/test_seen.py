"""De-duplication over the full history of a stream."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.session import Notes, names_in, scratch_dir
from tidewatch.streaming import jobs, seen

SCHEMA = "event_id string, ts long"


def frame(spark, ids, ts=0):
    return spark.createDataFrame([(i, ts) for i in ids], SCHEMA)


@pytest.mark.parametrize("per_bucket", [1_000_000, 20])
def test_copies_days_apart(spark, per_bucket, monkeypatch):
    """Ten micro-batches, each replayed, over merges of several levels: every id comes out once, in the micro-batch of its first arrival."""
    monkeypatch.setattr(seen, "IDS_PER_BUCKET", per_bucket)
    out, rng, want = scratch_dir(spark, "dedup"), random.Random(1), {}
    sink = jobs.history_dedup_sink(out, fold=2)
    for batch in range(10):
        ids = [f"e{rng.randrange(400)}" for _ in range(60)] + [None] * 2
        for i in ids:
            want.setdefault(i, batch)
        for _ in range(2 if batch % 3 == 0 else 1):
            sink(frame(spark, ids, batch), batch)
    rows = spark.read.parquet(f"{out}/events").collect()
    assert sum(r.event_id is None for r in rows) == 20  # rows without an id are no copies
    keyed = [r for r in rows if r.event_id is not None]
    assert {r.event_id: r.batch for r in keyed} == {k: v for k, v in want.items() if k is not None} and len(keyed) == len(want) - 1
    assert names_in(spark, f"{out}/seen/incoming") == [] and len(names_in(spark, f"{out}/seen/notes")) <= 3
    there = seen.SeenIds(f"{out}/seen").generations(spark, 10)
    assert sum(g.ids for g in there) == len(keyed) and len(there) <= 6
    kept = {f"{level}/{last}" for level in names_in(spark, f"{out}/seen/ids") for last in names_in(spark, f"{out}/seen/ids/{level}")}
    assert {g.name for g in there} <= kept and len(kept) <= len(there) + 4  # those merged last go with the next micro-batch


def test_only_hit_buckets_are_read(spark, monkeypatch):
    monkeypatch.setattr(seen, "IDS_PER_BUCKET", 100)
    path = scratch_dir(spark, "seen")
    ids = seen.SeenIds(path)
    ids.add(frame(spark, [f"e{i}" for i in range(5000)]), 0)
    assert ids.generations(spark, 1)[0].buckets == 50
    found = ids.seen(frame(spark, ["e17", "e18", *[f"new{i}" for i in range(50)]]), 1)
    files = found.inputFiles()
    buckets = {re.search(r"bucket=(\d+)", f)[1] for f in files if "/ids/" in f}
    assert sorted(r.event_id for r in found.collect()) == ["e17", "e18"] and 1 <= len(buckets) <= 4
    assert ids.seen(frame(spark, ["other"]), 0) is None  # nothing came before


def test_filters_say_no_to_nearly_all_new_ids(spark):
    path = scratch_dir(spark, "seen")
    ids = seen.SeenIds(path)
    ids.add(spark.range(20_000).select(F.col("id").cast("string").alias("event_id")), 0)
    there = ids.generations(spark, 1)
    new = spark.range(100_000, 120_000).select(F.col("id").cast("string").alias("event_id"))
    assert ids._candidates(spark, new, there).count() < 100
    old = spark.range(20_000).select(F.col("id").cast("string").alias("event_id"))
    assert ids._candidates(spark, old, there).count() == 20_000


def test_first_of_copies_in_a_micro_batch(spark):
    out = scratch_dir(spark, "dedup")
    jobs.history_dedup_sink(out)(frame(spark, ["a"], 5).unionByName(frame(spark, ["a"], 3)), 0)
    assert [tuple(r) for r in spark.read.parquet(f"{out}/events").select("event_id", "ts").collect()] == [("a", 3)]
    jobs.history_dedup_sink(out)(frame(spark, []), 1)
    jobs.history_dedup_sink(out)(frame(spark, ["a", "b"]), 2)
    assert spark.read.schema(f"{SCHEMA}, batch int").parquet(f"{out}/events").count() == 2


def test_notes(spark):
    notes = Notes(spark, scratch_dir(spark, "notes"))
    assert notes.before(5) is None
    for i in range(5):
        notes.write(i, {"n": i})
    assert notes.before(5) == {"n": 4} and notes.before(4) == {"n": 3}
    assert names_in(spark, notes.path) == ["2.json", "3.json", "4.json"]
    with open(os.path.join(notes.path, "5.json"), "w") as f:
        f.write('{"half')  # a micro-batch that died
    assert notes.before(5) == {"n": 4}
