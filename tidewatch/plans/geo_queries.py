"""Areas, memberships, the map and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.readings import has_gps
from tidewatch.operators import devices, geo
from tidewatch.plans.registry import query, rounded
from tidewatch.plans.views import Domain
from tidewatch.session import stored


@query("""SELECT a.id AS area_id, a.name, m.device_id, count(m.device_id) OVER (PARTITION BY a.id) AS device_count
FROM areas a LEFT JOIN members m ON m.area_id = a.id""")
def area_left_join(d: Domain) -> DataFrame:
    return geo.areas_with_devices(d.areas, d.area_devices, d.devices)


@query("SELECT * FROM mapped")
def devices_for_map(d: Domain) -> DataFrame:
    return geo.devices_for_map(d.devices, d.areas, d.area_devices)


@query("""SELECT m.device_id, string_agg(a.name, ', ' ORDER BY a.created_at, a.id) AS area_names
FROM members m JOIN areas a ON m.area_id = a.id GROUP BY m.device_id""")
def device_area_names(d: Domain) -> DataFrame:
    return geo.device_area_names(d.areas, d.area_devices, d.devices)


@query("SELECT device_id, is_anomaly, anomaly_score FROM marked")
def devices_with_anomaly(d: Domain) -> DataFrame:
    return d.marked.select("device_id", "is_anomaly", "anomaly_score")


@query("SELECT area_id, device_id FROM located")
def point_in_polygon_join(d: Domain) -> DataFrame:
    return d.located.select("area_id", "device_id")


#: Corners of the outline around each nation, and the SQL of corner k; // is the division of whole numbers in DuckDB, div in Spark.
_CORNERS = 2000


def _corner(div: str) -> tuple[str, str]:
    side, along = f"(k {div} {_CORNERS // 4})", f"(CAST(k % {_CORNERS // 4} AS double) / CAST({_CORNERS // 4} AS double))"
    radius = "(CAST(1 AS double) + CAST((k * 37) % 101 AS double) / CAST(50 AS double))"
    north = f"(CASE {side} WHEN 0 THEN 1 - {along} WHEN 1 THEN -{along} WHEN 2 THEN {along} - 1 ELSE {along} END)"
    east = f"(CASE {side} WHEN 0 THEN {along} WHEN 1 THEN 1 - {along} WHEN 2 THEN -{along} ELSE {along} - 1 END)"
    return (f"CAST(36 + n_nationkey % 8 AS double) + {radius} * {north}", f"CAST(n_nationkey % 5 - 6 AS double) + {radius} * {east}")


@query(f"""SELECT * FROM (WITH corners AS (SELECT n_nationkey AS area_id, k, {_corner('//')[0]} AS lat, {_corner('//')[1]} AS lng
  FROM nation, range({_CORNERS}) AS t(k)),
sides AS (SELECT i.area_id, i.lat AS lat_i, i.lng AS lng_i, j.lat AS lat_j, j.lng AS lng_j
  FROM corners i JOIN corners j ON i.area_id = j.area_id AND j.k = (i.k + {_CORNERS - 1}) % {_CORNERS})
SELECT e.area_id, d.device_id FROM devices d JOIN sides e ON d.latitude IS NOT NULL AND (e.lng_i > d.longitude) <> (e.lng_j > d.longitude)
  AND d.latitude < (e.lat_j - e.lat_i) * (d.longitude - e.lng_i) / (e.lng_j - e.lng_i) + e.lat_i
GROUP BY 1, 2 HAVING count(*) % 2 = 1)""")
def point_in_detailed_polygon(d: Domain) -> DataFrame:
    """Devices inside outlines of 2,000 corners."""
    lat, lng = (F.expr(f"transform(sequence(0, {_CORNERS - 1}), k -> {c})") for c in _corner("div"))
    corners = F.transform(F.arrays_zip(lat.alias("lat"), lng.alias("lng")), lambda c: F.array(c["lat"], c["lng"]))
    outlines = d.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(0).alias("created_at"),
                                        corners.alias("polygon"))
    return geo.spatial_join(d.devices, outlines).select("area_id", "device_id")


@query("""SELECT a.id AS area_id, a.name, EXISTS (SELECT 1 FROM located l JOIN marked m ON l.device_id = m.device_id
  WHERE l.area_id = a.id AND m.is_anomaly) AS high_risk FROM areas a""")
def area_at_risk(d: Domain) -> DataFrame:
    bad = stored(d.marked.where("is_anomaly"), "anomalous")
    return geo.areas_at_risk(d.areas, geo.some_located(bad, d.shapes), bad)


@query("""SELECT m.* REPLACE (coalesce(f.name, m.area_name) AS area_name) FROM mapped m
LEFT JOIN (SELECT device_id, arg_min(area_name, created_at * 1000000 + area_id) AS name FROM located GROUP BY device_id) f
  ON m.device_id = f.device_id""")
def geo_area_fallback(d: Domain) -> DataFrame:
    return geo.resolve_area(geo.devices_for_map(d.devices, d.areas, d.area_devices), geo.first_located(d.devices, d.shapes))


@query("""SELECT count(*) AS total_devices, count(CASE WHEN is_anomaly THEN 1 END) AS anomalous,
  count(CASE WHEN latitude IS NULL OR longitude IS NULL THEN 1 END) AS without_gps FROM marked""")
def map_kpis(d: Domain) -> DataFrame:
    return geo.map_kpis(d.marked)


@query("""SELECT a.id AS area_id, a.name, l.device_id, count(l.device_id) OVER (PARTITION BY a.id) AS device_count
FROM areas a LEFT JOIN located l ON l.area_id = a.id""")
def geo_area_members(d: Domain) -> DataFrame:
    return geo.geo_area_members(d.areas, d.located)


@query("""SELECT device_id, round(latitude, 8) AS latitude, round(longitude, 8) AS longitude,
  CASE WHEN is_anomaly THEN greatest(0.6, anomaly_score) ELSE 0.15 END AS intensity
FROM marked WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def heat_intensity(d: Domain) -> DataFrame:
    return rounded(geo.heat_points(d.marked), "latitude", "longitude")


@query("""SELECT device_id, CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'blue' WHEN status <> 'ACTIVE' THEN 'gray'
  WHEN is_anomaly THEN 'red' WHEN anomaly_score > 0.3 THEN 'yellow' ELSE 'green' END AS marker FROM marked""")
def marker_class(d: Domain) -> DataFrame:
    return geo.marker_classes(d.marked)


@query("SELECT id, name FROM shapes WHERE length(trim(name)) > 0 AND len(polygon) >= 3")
def polygon_valid(d: Domain) -> DataFrame:
    return geo.valid_areas(d.shapes).select("id", "name")


@query("SELECT device_id FROM devices WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def latlng_clean(d: Domain) -> DataFrame:
    return d.devices.where(has_gps(F.col("latitude"), F.col("longitude"))).select("device_id")


# Whether the device exists before each change: the last create or delete decides, else the registry.
_JUDGED = """(SELECT *, CASE WHEN op = 'create' THEN NOT present ELSE present END AS accepted FROM (
  SELECT l.*, coalesce(last_value(CASE op WHEN 'create' THEN true WHEN 'delete' THEN false END IGNORE NULLS)
    OVER (PARTITION BY l.device_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    v.device_id IS NOT NULL) AS present
  FROM device_log l LEFT JOIN (SELECT device_id FROM devices) v ON l.device_id = v.device_id))"""


@query(f"SELECT seq, op, device_id, CASE op WHEN 'create' THEN 409 ELSE 404 END AS code FROM {_JUDGED} WHERE NOT accepted")
def device_conflicts(d: Domain) -> DataFrame:
    return devices.device_conflicts(d.devices, d.device_log)


@query(f"""SELECT coalesce(b.device_id, c.device_id) AS device_id,
  CASE WHEN c.created THEN c.type ELSE b.type END AS type, CASE WHEN c.created THEN 'ACTIVE' ELSE b.status END AS status,
  CASE WHEN c.flagged THEN c.simulated ELSE b.simulated END AS simulated,
  round(CASE WHEN c.moved THEN c.latitude ELSE b.latitude END, 8) AS latitude,
  round(CASE WHEN c.moved THEN c.longitude ELSE b.longitude END, 8) AS longitude
FROM devices b FULL JOIN (
  SELECT device_id, bool_or(op = 'create') AS created, bool_or(op IN ('create', 'simulate')) AS flagged,
    bool_or(op IN ('create', 'locate')) AS moved,
    arg_max(op, seq) FILTER (op IN ('create', 'delete')) AS state,
    arg_max(type, seq) FILTER (op = 'create') AS type,
    arg_max(coalesce(simulated, false), seq) FILTER (op IN ('create', 'simulate')) AS simulated,
    arg_max_null(latitude, seq) FILTER (op IN ('create', 'locate')) AS latitude,
    arg_max_null(longitude, seq) FILTER (op IN ('create', 'locate')) AS longitude
  FROM {_JUDGED} WHERE accepted GROUP BY device_id) c ON b.device_id = c.device_id
WHERE coalesce(c.state, '') <> 'delete'""")
def apply_device_changes(d: Domain) -> DataFrame:
    return rounded(devices.apply_device_changes(d.devices, d.device_log), "latitude", "longitude")


_AREA_FOLD = """(SELECT area_id, arg_max(name, seq) FILTER (op = 'create') AS name, bool_or(op = 'create') AS created,
  bool_or(op = 'delete') AS deleted, arg_max(polygon, seq) FILTER (op <> 'delete') AS polygon
  FROM area_log GROUP BY area_id)"""


@query(f"""SELECT coalesce(a.id, f.area_id) AS area_id, CASE WHEN f.created THEN f.name ELSE a.name END AS name,
  coalesce(f.polygon, a.polygon) AS polygon FROM areas a FULL JOIN {_AREA_FOLD} f ON a.id = f.area_id
WHERE (a.id IS NOT NULL OR f.created) AND NOT coalesce(f.deleted, false)""")
def apply_area_changes(d: Domain) -> DataFrame:
    return devices.apply_area_changes(d.areas, d.area_devices, d.area_log)[0]


@query("""SELECT area_id, device_id FROM area_devices WHERE area_id NOT IN (SELECT area_id FROM area_log WHERE op = 'delete')""")
def area_delete_cascade(d: Domain) -> DataFrame:
    return devices.apply_area_changes(d.areas, d.area_devices, d.area_log)[1]


_KNOWN = "area_id IN (SELECT id FROM areas) AND device_id IN (SELECT id FROM devices)"


@query(f"SELECT area_id, device_id FROM area_devices UNION SELECT area_id, device_id FROM assignments WHERE {_KNOWN}")
def assign_devices(d: Domain) -> DataFrame:
    return devices.assign_devices(d.area_devices, d.assignments, d.areas, d.devices)


@query(f"SELECT DISTINCT area_id, device_id FROM assignments WHERE NOT ({_KNOWN})")
def assign_rejected(d: Domain) -> DataFrame:
    return devices.rejected_assignments(d.assignments, d.areas, d.devices)
