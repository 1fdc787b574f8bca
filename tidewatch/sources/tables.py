"""Full reads of the relational tables: devices, areas, area_devices, alerts, rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class TableConfig:
    """``format`` parquet (``location`` is a folder of tables) or jdbc (``location`` is the URL).

    For jdbc, ``partition_column`` with its bounds lets executors read ranges side by side; the
    bounds only set the ranges, rows outside them are read too.
    """

    format: str = "parquet"
    location: str = ""
    partition_column: str | None = None
    lower: int = 0
    upper: int = 1
    partitions: int = 64
    options: dict[str, str] = field(default_factory=dict)


def read_table(spark: SparkSession, name: str, cfg: TableConfig) -> DataFrame:
    if cfg.format == "parquet":
        return spark.read.parquet(f"{cfg.location.rstrip('/')}/{name}.parquet")
    reader = spark.read.format("jdbc").options(url=cfg.location, dbtable=name, fetchsize="10000", **cfg.options)
    if cfg.partition_column:
        reader = reader.options(partitionColumn=cfg.partition_column, lowerBound=str(cfg.lower),
                                upperBound=str(cfg.upper), numPartitions=str(cfg.partitions))
    return reader.load()
