"""Streams from and to Kafka, with Parquet folders as drop-in for tests.

The Kafka connector is a package of the cluster (``spark-sql-kafka-0-10``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


@dataclass(frozen=True)
class SourceConfig:
    """``format`` kafka (``servers``, ``topic``) or parquet (``path``, ``schema``)."""

    format: str = "kafka"
    servers: str = ""
    topic: str = ""
    starting_offsets: str = "latest"
    path: str = ""
    schema: str = ""
    # A stateful operator holds one key's share of a micro-batch in a task: these bound it.
    per_trigger: int = 1_000_000  # records of a Kafka trigger
    files_per_trigger: int = 64
    options: dict[str, str] = field(default_factory=dict)

    def reader_options(self) -> dict[str, str]:
        if self.format != "kafka":
            return {"maxFilesPerTrigger": str(self.files_per_trigger), **self.options}
        return {"kafka.bootstrap.servers": self.servers, "subscribe": self.topic,
                "startingOffsets": self.starting_offsets, "failOnDataLoss": "false",
                "maxOffsetsPerTrigger": str(self.per_trigger), **self.options}


def read_stream(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """A streaming frame; the admission limits bound every micro-batch."""
    reader = spark.readStream.format(cfg.format).options(**cfg.reader_options())
    return reader.load() if cfg.format == "kafka" else reader.schema(cfg.schema).load(cfg.path)


def to_json_value(df: DataFrame, key: str | None = None) -> DataFrame:
    """Records for a topic: the row as JSON, with a key if one is named."""
    value = F.to_json(F.struct("*")).alias("value")
    return df.select(value) if key is None else df.select(F.col(key).alias("key"), value)


def write_stream(df: DataFrame, checkpoint: str, servers: str = "", topic: str = "", path: str = "",
                 trigger_seconds: int | None = 5) -> DataStreamWriter:
    """A writer for a topic, or for a Parquet folder when ``path`` is given.

    A trigger of None takes what is there and stops.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint)
    writer = (writer.trigger(availableNow=True) if trigger_seconds is None
              else writer.trigger(processingTime=f"{trigger_seconds} seconds"))
    if path:
        return writer.format("parquet").option("path", path)
    return writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
