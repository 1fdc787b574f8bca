"""Areas, memberships and point-in-polygon analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.geometry import bounds, crosses, edges, inside, parse_polygon, polygon_valid
from tidewatch.functions.readings import has_gps, heat_intensity, marker_class
from tidewatch.operators.lookup import lookup_join
from tidewatch.operators.sizing import estimated_bytes, spread
from tidewatch.session import stored

_SMALLEST_LEVEL = -30  # cells of 2^-30 degrees for areas without extent
_NARROWEST_BAND = 40  # halvings of an area's extent
MANY_EDGES = 256  # an area with more has its edges in rows
FEW_EDGES = 8  # an area with no more has its corners in columns
_CELLS_PER_AREA, _ROW_BYTES, _EDGE_BYTES = 4, 256, 64  # size of the cell table, for the broadcast check
_FINER = 2  # halvings of the fitting cell, so that fewer points outside a box are met; at most 25 cells an area
PAIRS_PER_TASK = 50_000_000  # pairs of points and areas of one cell that a task compares
STEP_ROWS = 256  # areas, or points, in the first step of a search for one match
_STEPS_OF = 1024  # slices that are dealt to the steps, at most


def members(area_devices: DataFrame, devices: DataFrame) -> DataFrame:
    """Memberships (``area_id``, registry id) with the device's business key, without repeats."""
    registry = devices.select(F.col("id").alias("device_pk"), "device_id")
    pairs = area_devices.select("area_id", F.col("device_id").alias("device_pk")).distinct()
    return lookup_join(pairs, registry, "device_pk", "inner").select("area_id", "device_id")


def areas_with_devices(areas: DataFrame, area_devices: DataFrame, devices: DataFrame) -> DataFrame:
    """One row per area and member with the area's member count; one row with a null device for
    an area without members. Members stay rows: a list per area has no bound."""
    pairs = stored(members(area_devices, devices), "members")  # read three times
    counts = pairs.groupBy("area_id").agg(F.count(F.lit(1)).alias("device_count"))
    sized = areas.select(F.col("id").alias("area_id"), "name").join(counts, "area_id", "left")
    named = sized.withColumn("device_count", F.coalesce("device_count", F.lit(0)))
    with_members = lookup_join(pairs, named, "area_id", "inner", table_bytes=estimated_bytes(areas))
    without = named.where(F.col("device_count") == 0).withColumn("device_id", F.lit(None).cast("string"))
    return with_members.unionByName(without)


def _first_area(pairs: DataFrame, areas: DataFrame, out: str) -> DataFrame:
    """Per device the name of its first area in (created_at, id) order."""
    named = areas.select(F.col("id").alias("area_id"), "name", "created_at")
    return (lookup_join(pairs.select("area_id", "device_id"), named, "area_id", "inner")
            .groupBy("device_id")
            .agg(F.min(F.struct("created_at", "area_id", "name")).alias("a"))
            .select("device_id", F.col("a.name").alias(out)))


def devices_for_map(devices: DataFrame, areas: DataFrame, area_devices: DataFrame) -> DataFrame:
    """All devices with the name of their first area, null without one."""
    first = _first_area(members(area_devices, devices), areas, "area_name")
    return (devices.join(first, "device_id", "left")
            .select("device_id", "type", "status", "latitude", "longitude", "simulated", "area_name"))


def device_area_names(areas: DataFrame, area_devices: DataFrame, devices: DataFrame) -> DataFrame:
    """Per device the names of all its areas as one text, in (created_at, id) order.

    A device has at most one entry per area, so the text is bounded by the number of areas.
    """
    named = areas.select(F.col("id").alias("area_id"), "name", "created_at")
    entry = F.struct("created_at", "area_id", "name")
    return (lookup_join(members(area_devices, devices), named, "area_id", "inner")
            .groupBy("device_id").agg(F.array_sort(F.collect_list(entry)).alias("a"))
            .select("device_id", F.array_join(F.col("a.name"), ", ").alias("area_names")))


def mark_anomalies(devices: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Flag devices that have an anomaly; the score is that of the most recent one, else 0."""
    last = anomalies.groupBy("device_id").agg(F.max_by("score", "seq").alias("_score"))
    last = last.withColumn("_hit", F.lit(True))
    return (lookup_join(devices, last, "device_id", "left")
            .withColumn("is_anomaly", F.coalesce("_hit", F.lit(False)))
            .withColumn("anomaly_score", F.coalesce("_score", F.lit(0.0)))
            .drop("_hit", "_score"))


def _cell(level: Column, lat: Column, lng: Column) -> Column:
    size = F.pow(F.lit(2.0), level)
    return F.struct(level.alias("level"), F.floor(lat / size).alias("i"), F.floor(lng / size).alias("j"))


def _covered(shapes: DataFrame, *columns: str, finer: int = 0) -> DataFrame:
    """The cells, at most four, of each area's bounding box ``_b``, in the grid that fits its extent, or one halved ``finer`` times."""
    extent = F.greatest(F.col("_b.lat1") - F.col("_b.lat0"), F.col("_b.lng1") - F.col("_b.lng0"))
    level = F.greatest(F.ceil(F.log2(extent)).cast("int") - finer, F.lit(_SMALLEST_LEVEL))
    shapes = shapes.withColumn("_level", F.coalesce(level, F.lit(_SMALLEST_LEVEL)))
    low = _cell(F.col("_level"), F.col("_b.lat0"), F.col("_b.lng0"))
    high = _cell(F.col("_level"), F.col("_b.lat1"), F.col("_b.lng1"))
    return (shapes.withColumns({"_low": low, "_high": high})
            .withColumn("_i", F.explode(F.sequence("_low.i", "_high.i")))
            .withColumn("_j", F.explode(F.sequence("_low.j", "_high.j")))
            .withColumn("_cell", F.struct(F.col("_level").alias("level"), F.col("_i").alias("i"), F.col("_j").alias("j")))
            .select("_cell", "_level", *columns, "_b"))


def _boxed(points: DataFrame, covered: DataFrame, covered_bytes: int) -> DataFrame:
    """Pairs of points and areas whose bounding box they lie in, by an equi-join on the cells of all grids in use.

    Beyond PAIRS_PER_TASK pairs to compare, these decide about the tasks, as few rows may give many pairs: the points of a cell with
    more are dealt to several tasks, each with a copy of the cell's areas.
    """
    levels = covered.agg(F.collect_set("_level").alias("l")).scalar()
    looking = (points.withColumn("_level", F.explode(levels))
               .withColumn("_cell", _cell(F.col("_level"), F.col("latitude"), F.col("longitude"))).drop("_level"))
    covered = covered.drop("_level")
    in_box = (F.col("latitude").between(F.col("_b.lat0"), F.col("_b.lat1"))
              & F.col("longitude").between(F.col("_b.lng0"), F.col("_b.lng1")))
    there = covered.groupBy("_cell").agg(F.count(F.lit(1)).cast("double").alias("_areas"))
    work = looking.groupBy("_cell").agg(F.count(F.lit(1)).alias("_points")).join(there, "_cell").select(
        "_cell", (F.col("_points") * F.col("_areas")).alias("_pairs"))
    pairs = work.agg(F.sum("_pairs")).first()[0] or 0
    if pairs <= PAIRS_PER_TASK:
        return lookup_join(looking, covered, "_cell", "inner", table_bytes=covered_bytes).where(in_box).drop("_cell")
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, int(2 * pairs // PAIRS_PER_TASK))
    salts = F.ceil(F.col("_pairs") / PAIRS_PER_TASK).cast("int").alias("_salts")
    # a row here stands for PAIRS_PER_TASK pairs at least
    many = F.broadcast(stored(work.where(F.col("_pairs") > PAIRS_PER_TASK).select("_cell", salts), "full-cells"))
    place = F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = looking.join(many, "_cell", "left").withColumn("_salt", place).drop("_salts")
    copies = covered.join(many, "_cell", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    on = ["_cell", "_salt"]
    return (dealt.repartition(tasks, *on).join(copies.drop("_salts").repartition(tasks, *on).hint("merge"), on)
            .where(in_box).drop(*on))


def _inside_detailed(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Points in areas of very many edges, which are rows here and never a list.

    An edge lies in bands of longitude about as wide as itself (level k halves the area's extent k times), two at most. A point
    in the area's box looks into its band of every level that the area has edges in; it is inside if it crosses an odd number
    of the edges it meets. A short edge is met by the few points of its band only.
    """
    shapes = stored(shapes, "outlines").withColumn("_b", bounds(F.col("polygon")))  # else the outline is made for each use
    edge_rows = (shapes.select("area_id", "_b", F.explode(edges(F.col("polygon"))).alias("e"))
                 .where(F.col("e.lng_i") != F.col("e.lng_j")))  # others are never crossed
    low, high = F.least("e.lng_i", "e.lng_j"), F.greatest("e.lng_i", "e.lng_j")
    width = F.col("_b.lng1") - F.col("_b.lng0")
    level = F.least(F.floor(F.log2(F.try_divide(width, high - low))).cast("int"), F.lit(_NARROWEST_BAND))
    edge_rows = edge_rows.withColumn("k", F.greatest(level, F.lit(0)))

    def band(lng: Column) -> Column:
        return F.floor((lng - F.col("_b.lng0")) / (width / F.pow(F.lit(2.0), F.col("k"))))

    def slot(at: Column) -> Column:
        return F.struct("area_id", "k", at.alias("band")).alias("_slot")

    in_bands = stored(edge_rows.withColumn("_band", F.explode(F.sequence(band(low), band(high))))
                      .select(slot(F.col("_band")), "e", "area_id", "k"), "edge-bands")
    used = in_bands.groupBy("area_id").agg(F.collect_set("k").alias("_ks"))
    covered = _covered(shapes.join(used, "area_id"), "area_id", "area_name", "created_at", "_ks")
    # equal rows of the devices count once and come back as often
    key = ["device_id", "latitude", "longitude"]
    counted = points.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    boxed = _boxed(counted, covered, _CELLS_PER_AREA * _ROW_BYTES * shapes.count())
    looking = boxed.withColumn("k", F.explode("_ks")).withColumn("_slot", slot(band(F.col("longitude"))))
    looking = looking.select("_slot", *key, "_copies", F.col("area_id").alias("_area"), "area_name", "created_at")
    met = lookup_join(looking, in_bands.select("_slot", "e"), "_slot", "inner").where(crosses(F.col("latitude"), F.col("longitude"), F.col("e")))
    odd = met.groupBy(F.col("_area").alias("area_id"), "area_name", "created_at", *key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_copies").alias("_copies")).where(F.col("_n") % 2 == 1)
    return odd.select("area_id", "area_name", "created_at", *key, F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("col")


def _inside_few(points: DataFrame, shapes: DataFrame, most: int, covered_bytes: int) -> DataFrame:
    """Points in areas of at most ``most`` edges, whose corners are columns: the test is compiled and no list is walked for a pair."""
    sides = ("lat_i", "lng_i", "lat_j", "lng_j")
    whole = [F.forall(F.array(*[F.col("_edges")[k][s] for s in sides]), lambda v: v.isNotNull()) for k in range(most)]
    # an edge with a null is never crossed, nor is one of a single corner
    corners = {f"_{s}_{k}": F.when((F.size("_edges") > k) & whole[k], F.get("_edges", F.lit(k))[s]).otherwise(0.0) for k in range(most) for s in sides}
    named = ["area_id", "area_name", "created_at"]
    flat = shapes.select(*named, "_edges", "_b").withColumns(corners)
    covered = _covered(flat, *named, *corners, finer=_FINER)
    lat, lng = F.col("latitude"), F.col("longitude")
    crossed = [crosses(lat, lng, {s: F.col(f"_{s}_{k}") for s in sides}) for k in range(most)]
    odd = reduce(lambda a, b: a != b, crossed)
    return _boxed(points, covered, covered_bytes).where(odd).select(*named, "device_id", "latitude", "longitude")


def spatial_join(devices: DataFrame, areas: DataFrame, many_edges: int = MANY_EDGES) -> DataFrame:
    """Pairs of devices with GPS and the areas they lie in.

    An equi-join on grid cells: each area uses a grid chosen by the extent of its bounding box, so it covers a bounded number of
    cells, and each device looks into its cell of every grid in use. Only areas sharing a cell are tested exactly: by columns with
    their corners, against the list of their edges where these are more than FEW_EDGES, or, for areas of more than
    ``many_edges``, against edges spread over bands.
    """
    named = areas.where(F.size("polygon") > 0).select(F.col("id").alias("area_id"), F.col("name").alias("area_name"), "created_at", "polygon")
    points = spread(devices.where(has_gps(F.col("latitude"), F.col("longitude"))), "device_id").select("device_id", "latitude", "longitude")
    n, few = F.col("n"), min(FEW_EDGES, many_edges)
    listed = (n > few) & (n <= many_edges)
    few_count, most, list_count, edge_count, many = named.select(F.size("polygon").alias("n")).agg(
        F.count_if(n <= few), F.max(F.when(n <= few, n)), F.count_if(listed), F.coalesce(F.sum(F.when(listed, n)), F.lit(0)),
        F.count_if(n > many_edges)).first()
    shapes = named.withColumns({"_edges": edges(F.col("polygon")), "_b": bounds(F.col("polygon"))})
    cells = (2**_FINER + 1) ** 2
    found = [_inside_few(points, shapes.where(F.size("polygon") <= few), most or 1, cells * few_count * (_ROW_BYTES + (most or 1) * 32))]
    if list_count:
        covered = _covered(shapes.where(F.size("polygon").between(few + 1, many_edges)), "area_id", "area_name", "created_at", "_edges")
        boxed = _boxed(points, covered, _CELLS_PER_AREA * (list_count * _ROW_BYTES + edge_count * _EDGE_BYTES))
        found.append(boxed.where(inside(F.col("latitude"), F.col("longitude"), F.col("_edges")))
                     .select("area_id", "area_name", "created_at", "device_id", "latitude", "longitude"))
    if many:
        found.append(_inside_detailed(points, named.where(F.size("polygon") > many_edges)))
    return reduce(DataFrame.unionByName, found[1:] if not few_count and found[1:] else found)


def _in_steps(rows: DataFrame, slices: int) -> tuple[DataFrame, list[int]]:
    """Rows with their slice ``_slice`` (from 0) as steps ``_step``, each four times as large as all before it, and the steps in order."""
    rows = stored(rows.withColumn("_step", F.floor(F.log2(F.col("_slice") + 1) / 2).cast("int")).drop("_slice"), "steps")
    return rows, sorted(r[0] for r in rows.select("_step").distinct().collect()) if slices > 1 else [0]


def first_located(devices: DataFrame, areas: DataFrame, step_rows: int = STEP_ROWS) -> DataFrame:
    """Per device the first area, in (created_at, id) order, that it lies in: the pairs of ``spatial_join`` with the least
    (created_at, area_id, area_name).

    Areas come in steps of that order, the first one small. Only devices that are in no area of the steps before look at the next,
    so a device in many areas isn't paired with all of them.
    """
    shapes = areas.where(F.size("polygon") > 0).select("id", "name", "created_at", "polygon")
    slices = max(1, min(_STEPS_OF, shapes.count() // step_rows))
    ordered, steps = _in_steps(shapes.repartitionByRange(slices, "created_at", "id").withColumn("_slice", F.spark_partition_id()), slices)
    waiting = devices.where(F.col("device_id").isNotNull() & has_gps(F.col("latitude"), F.col("longitude"))).select(
        "device_id", "latitude", "longitude")
    found = []
    for step in steps:
        located = spatial_join(waiting, ordered.where(F.col("_step") == step))
        first = located.groupBy("device_id").agg(F.min(F.struct("created_at", "area_id", "area_name")).alias("a"))
        found.append(stored(first.select("device_id", "a.*"), "first-areas"))
        if step != steps[-1]:
            waiting = stored(waiting.join(found[-1].select("device_id"), "device_id", "left_anti"), "waiting")
            if waiting.isEmpty():
                break
    return reduce(DataFrame.unionByName, found)


def some_located(devices: DataFrame, areas: DataFrame, step_rows: int = STEP_ROWS) -> DataFrame:
    """(area_id, device_id): one device of every area that has any in it, of the pairs of ``spatial_join``. Devices without an id
    take no part.

    Devices come in steps by a hash, the first one small. Only areas without a device of the steps before look at the next, so an
    area with many isn't paired with all of them.
    """
    points = devices.where(F.col("device_id").isNotNull() & has_gps(F.col("latitude"), F.col("longitude"))).select(
        "device_id", "latitude", "longitude")
    slices = max(1, min(_STEPS_OF, points.count() // step_rows))
    dealt, steps = _in_steps(points.withColumn("_slice", F.pmod(F.xxhash64(*points.columns), F.lit(slices))), slices)
    waiting = areas.where(F.col("id").isNotNull() & (F.size("polygon") > 0)).select("id", "name", "created_at", "polygon")
    found = []
    for step in steps:
        located = spatial_join(dealt.where(F.col("_step") == step), waiting)
        found.append(stored(located.groupBy("area_id").agg(F.min("device_id").alias("device_id")), "some-devices"))
        if step != steps[-1]:
            waiting = stored(waiting.join(found[-1].select(F.col("area_id").alias("id")), "id", "left_anti"), "waiting")
            if waiting.isEmpty():
                break
    return reduce(DataFrame.unionByName, found)


def with_polygon(areas: DataFrame, strict: bool = True) -> DataFrame:
    return areas.withColumn("polygon", parse_polygon(F.col("polygon"), strict))


def valid_areas(areas: DataFrame) -> DataFrame:
    return areas.where(polygon_valid(F.col("name"), F.col("polygon")))


def geo_area_members(areas: DataFrame, located: DataFrame) -> DataFrame:
    """As ``areas_with_devices``, membership being the polygon (``located`` from ``spatial_join``).

    The pairs are counted and listed by a spatial join each: they may be far more than the rows of both tables, and storing
    them costs more than finding them again.
    """
    located = located.select("area_id", "device_id")
    counts = located.groupBy("area_id").agg(F.count(F.lit(1)).alias("device_count"))
    named = (areas.select(F.col("id").alias("area_id"), "name").join(counts, "area_id", "left")
             .withColumn("device_count", F.coalesce("device_count", F.lit(0))))
    with_members = lookup_join(located, named, "area_id", "inner", table_bytes=estimated_bytes(areas))
    without = named.where(F.col("device_count") == 0).withColumn("device_id", F.lit(None).cast("string"))
    return with_members.unionByName(without)


def areas_at_risk(areas: DataFrame, pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """All areas with a flag: at least one member device (``pairs``) is anomalous."""
    bad = marked.where("is_anomaly").select("device_id").distinct()
    hit = pairs.select("area_id", "device_id").join(bad, "device_id", "left_semi")
    hit = hit.groupBy("area_id").agg(F.lit(True).alias("_hit"))
    return (areas.select(F.col("id").alias("area_id"), "name").join(hit, "area_id", "left")
            .select("area_id", "name", F.coalesce("_hit", F.lit(False)).alias("high_risk")))


def resolve_area(mapped: DataFrame, located: DataFrame) -> DataFrame:
    """First containing area in (created_at, id) order, else the assigned area name."""
    first = located.groupBy("device_id").agg(
        F.min(F.struct("created_at", "area_id", "area_name")).alias("_a"))
    return (mapped.join(first, "device_id", "left")
            .withColumn("area_name", F.coalesce(F.col("_a.area_name"), F.col("area_name"))).drop("_a"))


def filter_map(marked: DataFrame, pairs: DataFrame | None = None, area_id: int | None = None,
               severity: str | None = None) -> DataFrame:
    """Devices in one area and/or only ``anomaly`` or ``normal`` ones."""
    if area_id is not None:
        chosen = pairs.where(F.col("area_id") == area_id).select("device_id").distinct()
        marked = marked.join(chosen, "device_id", "left_semi")
    if severity in ("anomaly", "normal"):
        marked = marked.where(F.col("is_anomaly") == (severity == "anomaly"))
    return marked


def map_kpis(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count(F.lit(1)).alias("total_devices"), F.count_if("is_anomaly").alias("anomalous"),
                      F.count_if(~has_gps(F.col("latitude"), F.col("longitude"))).alias("without_gps"))


def heat_points(marked: DataFrame) -> DataFrame:
    return (marked.where(has_gps(F.col("latitude"), F.col("longitude")))
            .select("device_id", "latitude", "longitude",
                    heat_intensity(F.col("is_anomaly"), F.col("anomaly_score")).alias("intensity")))


def marker_classes(marked: DataFrame) -> DataFrame:
    return marked.select("device_id", marker_class(
        F.col("latitude"), F.col("longitude"), F.col("status"), F.col("is_anomaly"),
        F.col("anomaly_score")).alias("marker"))
