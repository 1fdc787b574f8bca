"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # windows are bound by CPU: keep small shuffles on several cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


SHUFFLE_BYTES_PER_TASK = 128 * 1024 * 1024


def build_session(app_name: str = "tidewatch", master: str | None = None,
                  input_bytes: int | None = None, **conf: str) -> SparkSession:
    """A session with the defaults; ``input_bytes`` sizes the shuffles for the data to be read,
    as AQE merges shuffle partitions but does not add any."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if input_bytes is not None:
        tasks = max(200, input_bytes // SHUFFLE_BYTES_PER_TASK)
        builder = builder.config("spark.sql.shuffle.partitions", str(tasks))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Runtime settings the plans count on, for a session that somebody else built."""
    for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        spark.conf.set(key, DEFAULTS[key])


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the folder all executors share.

    Only a local session may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored_as(df: DataFrame, path: str) -> DataFrame:
    """Write a table to a path of its own and read it back; a retry overwrites it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Spark's own file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a small intermediate table to the shared folder and read it back, so that it is
    computed once and survives lost executors."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly in a folder of the shared store; none if it does not exist. One listing, no job."""
    store, target = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(target)) if store.exists(target) else []


class Notes:
    """Small facts that a sink hands from one micro-batch to the next, one JSON file per micro-batch.

    A micro-batch reads the note of the one before it and writes its own, so a replay reads the same note again and a file that was
    left half written is never read.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3) -> None:
        self.spark, self.path, self.keep = spark, path, keep

    def _ids(self) -> list[int]:
        return sorted(int(name[:-5]) for name in names_in(self.spark, self.path) if name.endswith(".json") and name[:-5].isdigit())

    def before(self, batch_id: int) -> dict | None:
        """The note of the last micro-batch before ``batch_id``."""
        earlier = [i for i in self._ids() if i < batch_id]
        if not earlier:
            return None
        store, target = _store(self.spark, f"{self.path}/{earlier[-1]}.json")
        stream = store.open(target)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, batch_id: int, note: dict) -> None:
        store, target = _store(self.spark, f"{self.path}/{batch_id}.json")
        stream = store.create(target, True)
        try:
            stream.write(bytearray(json.dumps(note).encode()))
        finally:
            stream.close()
        for i in self._ids()[: -self.keep]:
            remove(self.spark, f"{self.path}/{i}.json")
