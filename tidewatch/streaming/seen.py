"""All ids that a stream has ever let through, kept so that a micro-batch reads only the few places where one of its ids may be.

Ids are kept in generations: every micro-batch adds one, and ``fold`` generations of a level are merged into one of the next level, so
there are about ``fold * log(micro-batches)`` of them and an id is rewritten once per level. A generation is cut into hash buckets of
about IDS_PER_BUCKET ids, each a folder, and has a Bloom filter: rows of four 64-bit words, one row per 256 bits, of which an id sets
eight bits in one row. A micro-batch looks its ids up in the filters and opens only the buckets of which a filter says "maybe".
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.ordered import first_per_key
from tidewatch.session import Notes, remove, stored_as

FOLD = 8
IDS_PER_BUCKET = 1_000_000
BITS_PER_ID = 16  # about one id in a thousand is looked for in vain
_WORDS = 4


@dataclass(frozen=True)
class Generation:
    """``last`` is the newest micro-batch in it; ``blocks`` are the filter's rows per bucket."""

    level: int
    last: int
    ids: int
    buckets: int
    blocks: int

    @property
    def name(self) -> str:
        return f"level={self.level}/last={self.last}"

    @classmethod
    def of(cls, level: int, last: int, ids: int) -> Generation:
        buckets = max(1, -(-ids // IDS_PER_BUCKET))
        return cls(level, last, ids, buckets, max(1, -(-ids * BITS_PER_ID // (64 * _WORDS * buckets))))


def _place(hashed: Column, buckets: Column, blocks: Column) -> tuple[Column, Column]:
    """Bucket and filter row of a hash."""
    bucket = F.pmod(hashed, buckets)
    return bucket.cast("int"), F.pmod(F.shiftright(hashed, 20), blocks)


def _words(bits: Column) -> list[Column]:
    """The two bits that a second hash sets in each of the words."""
    def bit(k: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * k).bitwiseAND(63).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(_WORDS)]


class SeenIds:
    """The ids under ``path``; ``key`` is the id column. Rows without an id are never copies."""

    def __init__(self, path: str, key: str = "event_id", fold: int = FOLD) -> None:
        self.path, self.key, self.fold = path, key, fold

    def _notes(self, spark: SparkSession) -> Notes:
        return Notes(spark, f"{self.path}/notes")

    def generations(self, spark: SparkSession, batch_id: int) -> list[Generation]:
        """Those that hold the ids of all micro-batches before ``batch_id``."""
        note = self._notes(spark).before(batch_id)
        return [Generation(**g) for g in note["generations"]] if note else []

    def _hashed(self, df: DataFrame) -> DataFrame:
        return df.select(self.key, F.xxhash64(self.key).alias("_h"), F.xxhash64(F.lit(1), F.col(self.key)).alias("_bits"))

    def _candidates(self, spark: SparkSession, ids: DataFrame, there: list[Generation]) -> DataFrame:
        """(id, level, last, bucket) wherever a filter says that the id may be in a bucket."""
        places = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in (
            ("level", g.level, "int"), ("last", g.last, "long"), ("buckets", g.buckets, "long"), ("blocks", g.blocks, "long"))])
            for g in there])
        asked = self._hashed(ids).withColumn("g", F.explode(places))
        bucket, block = _place(F.col("_h"), F.col("g.buckets"), F.col("g.blocks"))
        asked = asked.select(self.key, "g.level", "g.last", bucket.alias("bucket"), block.alias("block"),
                             *[w.alias(f"q{i}") for i, w in enumerate(_words(F.col("_bits")))])
        schema = "level int, last long, bucket int, block long, " + ", ".join(f"w{i} long" for i in range(_WORDS))
        filters = spark.read.schema(schema).option("basePath", f"{self.path}/filters").parquet(*[f"{self.path}/filters/{g.name}" for g in there])
        hit = reduce(Column.__and__, [F.col(f"w{i}").bitwiseAND(F.col(f"q{i}")) == F.col(f"q{i}") for i in range(_WORDS)])
        return asked.join(filters, ["level", "last", "bucket", "block"]).where(hit).select(self.key, "level", "last", "bucket")

    def _ids(self, spark: SparkSession, kind: str, folders: list[str]) -> DataFrame:
        reader = spark.read.schema(f"`{self.key}` {kind}, level int, last long, bucket int").option("basePath", f"{self.path}/ids")
        return reader.parquet(*[f"{self.path}/ids/{f}" for f in folders])

    def seen(self, ids: DataFrame, batch_id: int) -> DataFrame | None:
        """Those of ``ids`` that came before ``batch_id``, or None if there are no such ids at all.

        The folders named in the plan are the buckets that a filter points to; the driver sees one row for each of them.
        """
        spark = ids.sparkSession
        there = self.generations(spark, batch_id)
        if not there:
            return None
        maybe = stored_as(self._candidates(spark, ids, there), f"{self.path}/maybe/batch={batch_id}")
        hit = maybe.select("level", "last", "bucket").distinct().collect()
        if not hit:
            return None
        kind = dict(ids.dtypes)[self.key]
        known = self._ids(spark, kind, [f"level={r.level}/last={r.last}/bucket={r.bucket}" for r in hit])
        return maybe.join(known, [self.key, "level", "last", "bucket"], "left_semi").select(self.key).distinct()

    def _write(self, ids: DataFrame, g: Generation) -> None:
        bucket, block = _place(F.col("_h"), F.lit(g.buckets).cast("long"), F.lit(g.blocks).cast("long"))
        hashed = self._hashed(ids).withColumns({"bucket": bucket, "block": block})
        rows = hashed.select(self.key, "bucket")
        rows = rows.coalesce(1) if g.buckets == 1 else rows.repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ids/{g.name}")
        words = hashed.select("bucket", "block", *[w.alias(f"w{i}") for i, w in enumerate(_words(F.col("_bits")))])
        bits = words.groupBy("bucket", "block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])
        bits.write.mode("overwrite").parquet(f"{self.path}/filters/{g.name}")

    def add(self, ids: DataFrame, batch_id: int) -> None:
        """Make ``ids``, which are all new, part of the history, and merge a level that is full.

        What the merged generation replaces goes with the next micro-batch, as a replay of this one still reads it.
        """
        spark = ids.sparkSession
        note = self._notes(spark).before(batch_id) or {"generations": [], "gone": []}
        there = [Generation(**g) for g in note["generations"]]
        kind = dict(ids.dtypes)[self.key]
        own = ids.select(self.key).where(F.col(self.key).isNotNull())
        gone: list[str] = []
        level = 0
        while len(full := [g for g in there if g.level == level]) >= self.fold:
            merged = Generation.of(level + 1, full[-1].last, sum(g.ids for g in full))
            self._write(self._ids(spark, kind, [g.name for g in full]), merged)
            there = [g for g in there if g.level != level] + [merged]
            gone += [g.name for g in full]
            level += 1
        count = own.count()
        if count:
            self._write(own, new := Generation.of(0, batch_id, count))
            there.append(new)
        for name in note["gone"]:
            remove(spark, f"{self.path}/ids/{name}")
            remove(spark, f"{self.path}/filters/{name}")
        self._notes(spark).write(batch_id, {"generations": [asdict(g) for g in there], "gone": gone})

    def first_arrivals(self, batch: DataFrame, batch_id: int, order: tuple[str, ...], path: str) -> DataFrame:
        """The rows of a micro-batch whose id is new, one for each id, written under ``path`` and added to the history.

        A replay finds the history as it was before and writes the same rows again.
        """
        spark = batch.sparkSession
        keyed = first_per_key(batch.where(F.col(self.key).isNotNull()), self.key, list(order))
        once = stored_as(keyed.unionByName(batch.where(F.col(self.key).isNull())), f"{self.path}/incoming/batch={batch_id}")
        known = self.seen(once.select(self.key).where(F.col(self.key).isNotNull()), batch_id)
        fresh = once if known is None else once.join(known, self.key, "left_anti")
        written = stored_as(fresh, f"{path}/batch={batch_id}")
        self.add(written.select(self.key), batch_id)
        for part in ("incoming", "maybe"):
            remove(spark, f"{self.path}/{part}/batch={batch_id}")
        return written
