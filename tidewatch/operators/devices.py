"""Folding change logs into the device registry, areas and memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.lookup import lookup_join
from tidewatch.operators.ordered import ordered_window

_STATE_OPS = ("create", "delete")


def judge_changes(devices: DataFrame, log: DataFrame, group_rows: int | None = None) -> DataFrame:
    """The log with ``accepted``: a create needs the device to be absent, anything else present.

    Presence before a change is set by the last create or delete before it, and by the registry
    when there is none. A rejected create or delete leaves presence as it finds it, so the outcome
    of earlier changes is not needed.
    """
    known = devices.select("device_id").withColumn("_registered", F.lit(True))
    is_state = F.col("op").isin(*_STATE_OPS)
    after = F.when(is_state, F.col("op") == "create")
    judged = ordered_window(
        log, "device_id", ["seq"], 1,
        lambda w: {"_present": F.last(after, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))},
        only=is_state, group_rows=group_rows)
    present = F.coalesce("_present", "_registered", F.lit(False))
    return (lookup_join(judged, known, "device_id", "left")
            .withColumn("accepted", F.when(F.col("op") == "create", ~present).otherwise(present))
            .drop("_present", "_registered"))


def device_conflicts(devices: DataFrame, log: DataFrame) -> DataFrame:
    """Rejected changes: 409 for a create of an existing id, 404 for any other of an unknown id."""
    return (judge_changes(devices, log).where(~F.col("accepted"))
            .select("seq", "op", "device_id", F.when(F.col("op") == "create", 409).otherwise(404).alias("code")))


def _latest(ops: tuple[str, ...], *columns: str) -> Column:
    """The columns of the last change among ``ops`` as a struct, so that a null value still counts."""
    return F.max_by(F.struct(*columns), F.when(F.col("op").isin(*ops), F.col("seq")))


def _either(change: str, field: str, old: str) -> Column:
    return F.when(F.col(change).isNotNull(), F.col(f"{change}.{field}")).otherwise(F.col(old))


def apply_device_changes(devices: DataFrame, log: DataFrame, group_rows: int | None = None) -> DataFrame:
    """The registry after the accepted changes.

    ``create`` sets all columns (status ACTIVE, simulated false unless given), ``simulate`` the
    flag, ``locate`` both coordinates, where null clears them.
    """
    changes = (judge_changes(devices, log, group_rows).where("accepted")
               .withColumn("simulated", F.coalesce("simulated", F.lit(False)))
               .groupBy("device_id")
               .agg(_latest(_STATE_OPS, "op").alias("_state"),
                    _latest(("create",), "type").alias("_type"),
                    _latest(("create", "simulate"), "simulated").alias("_sim"),
                    _latest(("create", "locate"), "latitude", "longitude").alias("_loc")))
    return (devices.join(changes, "device_id", "full_outer")
            .where(F.coalesce(F.col("_state.op"), F.lit("")) != "delete")
            .select("device_id", _either("_type", "type", "type").alias("type"),
                    F.when(F.col("_type").isNotNull(), "ACTIVE").otherwise(F.col("status")).alias("status"),
                    _either("_sim", "simulated", "simulated").alias("simulated"),
                    _either("_loc", "latitude", "latitude").alias("latitude"),
                    _either("_loc", "longitude", "longitude").alias("longitude")))


def apply_area_changes(areas: DataFrame, area_devices: DataFrame,
                       log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Areas and memberships after a log of ``create``, ``polygon`` and ``delete``.

    Area ids are never used again. Changes to unknown areas have no effect; a deleted area takes
    its memberships with it.
    """
    folded = log.groupBy("area_id").agg(
        F.count_if(F.col("op") == "delete").alias("_deletes"),
        _latest(("create",), "name").alias("_new"),
        _latest(("create", "polygon"), "polygon").alias("_shape"))
    old = areas.select(F.col("id").alias("area_id"), "name", "polygon").withColumn("_old", F.lit(True))
    after = (old.join(folded, "area_id", "full_outer")
             .where(F.col("_old").isNotNull() | F.col("_new").isNotNull())
             .where(F.coalesce("_deletes", F.lit(0)) == 0)
             .select("area_id", _either("_new", "name", "name").alias("name"),
                     _either("_shape", "polygon", "polygon").alias("polygon")))
    gone = log.where(F.col("op") == "delete").select("area_id").distinct()
    return after, lookup_join(area_devices, gone, "area_id", "left_anti")


def judge_assignments(pairs: DataFrame, areas: DataFrame, devices: DataFrame) -> DataFrame:
    """Requested memberships with ``known``: both the area and the device exist."""
    a = areas.select(F.col("id").alias("area_id")).withColumn("_area", F.lit(True))
    d = devices.select(F.col("id").alias("device_id")).withColumn("_device", F.lit(True))
    checked = lookup_join(lookup_join(pairs, a, "area_id", "left"), d, "device_id", "left")
    return (checked.withColumn("known", F.col("_area").isNotNull() & F.col("_device").isNotNull())
            .drop("_area", "_device"))


def assign_devices(area_devices: DataFrame, pairs: DataFrame, areas: DataFrame, devices: DataFrame) -> DataFrame:
    """Memberships with the known requested pairs added; assigning twice changes nothing."""
    new = judge_assignments(pairs, areas, devices).where("known").select("area_id", "device_id")
    return area_devices.select("area_id", "device_id").unionByName(new).distinct()


def rejected_assignments(pairs: DataFrame, areas: DataFrame, devices: DataFrame) -> DataFrame:
    return (judge_assignments(pairs, areas, devices).where(~F.col("known"))
            .select("area_id", "device_id").distinct())
