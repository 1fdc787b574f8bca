"""Polygons, spatial join, memberships and area changes."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.geometry import edges, format_polygon, inside, parse_polygon
from tidewatch.operators import devices as registry
from tidewatch.operators import geo

SQUARE = [[0.0, 0.0], [0.0, 10.0], [10.0, 10.0], [10.0, 0.0]]
AREA = "id int, name string, created_at int, polygon array<array<double>>"
DEVICE = "id int, device_id string, type string, status string, simulated boolean, latitude double, longitude double"


def contains(lat, lng, polygon):
    """Ray casting, point by point."""
    hit = False
    for i, (lat_i, lng_i) in enumerate(polygon):
        lat_j, lng_j = polygon[i - 1]
        if (lng_i > lng) != (lng_j > lng) and lat < (lat_j - lat_i) * (lng - lng_i) / (lng_j - lng_i) + lat_i:
            hit = not hit
    return hit


@pytest.mark.parametrize("lat,lng,want", [(5, 5, True), (20, 20, False), (0, 0, True), (0, 5, True), (5, 0, True),
                                          (10, 10, False), (10, 5, False)])
def test_point_in_polygon(spark, lat, lng, want):
    df = spark.createDataFrame([(float(lat), float(lng), SQUARE)], "lat double, lng double, p array<array<double>>")
    assert df.select(inside(F.col("lat"), F.col("lng"), edges(F.col("p"))).alias("x")).first().x is want
    empty = df.withColumn("p", F.array().cast("array<array<double>>"))
    assert empty.select(inside(F.col("lat"), F.col("lng"), edges(F.col("p"))).alias("x")).first().x is False


def test_polygon_text(spark):
    def parse(text, strict=True):
        return spark.createDataFrame([(text,)], "t string").select(parse_polygon(F.col("t"), strict).alias("p")).first().p
    assert parse(None) == [] and parse("  ") == [] and parse("[]") == []
    assert parse("[[1,2],[3.5,4]]") == [[1.0, 2.0], [3.5, 4.0]]
    assert parse("junk", strict=False) is None
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        parse("junk")
    df = spark.createDataFrame([(None,), ([[1.0, 2.0]],)], "p array<array<double>>")
    assert [r.t for r in df.select(format_polygon(F.col("p")).alias("t")).collect()] == ["[]", "[[1.0,2.0]]"]


def test_valid_areas(spark):
    rows = [(1, "ok", 0, SQUARE), (2, " ", 0, SQUARE), (3, None, 0, SQUARE), (4, "two", 0, SQUARE[:2]),
            (5, "odd", 0, [[1.0], [2.0, 3.0], [4.0, 5.0]]), (6, "none", 0, None)]
    assert [r.id for r in geo.valid_areas(spark.createDataFrame(rows, AREA)).collect()] == [1]


@pytest.mark.parametrize("broadcast", [True, False])
def test_spatial_join_against_all_pairs(spark, broadcast, monkeypatch):
    rng = random.Random(4)
    areas = [(0, "empty", 0, [])]
    for i in range(1, 40):
        size = 10 ** rng.uniform(-2, 1.5)
        lat, lng = rng.uniform(-40, 40), rng.uniform(-40, 40)
        points = [[lat + rng.uniform(-size, size), lng + rng.uniform(-size, size)] for _ in range(rng.randrange(1, 7))]
        areas.append((i, f"a{i}", i % 5, points))
    points = [(i, f"d{i}", "t", "ACTIVE", False, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(300)]
    points += [(300 + i, f"v{i}", "t", "ACTIVE", False, *p) for i, p in enumerate(areas[7][3] + areas[8][3])]
    points.append((999, "no-gps", "t", "ACTIVE", False, None, 1.0))
    if not broadcast:
        join = geo.lookup_join
        monkeypatch.setattr(geo, "lookup_join", lambda f, t, on, how, **kw: join(
            f, t, on, how, group_rows=10, broadcast_bytes=-1, table_bytes=0))
    got = geo.spatial_join(spark.createDataFrame(points, DEVICE), spark.createDataFrame(areas, AREA))
    want = {(a[0], p[1]) for a in areas for p in points if p[5] is not None and contains(p[5], p[6], a[3])}
    assert want
    assert sorted((r.area_id, r.device_id) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("many_edges", [0, 2, 256])
def test_edges_in_rows_or_lists_give_the_same(spark, many_edges):
    """Also flat, slanted and degenerate outlines, null corners, points on corners and repeated devices."""
    rng = random.Random(9)
    areas = [(0, "flat", 0, [[1.0, 5.0], [2.0, 5.0], [3.0, 5.0]]), (1, "hole", 0, [[0.0, 0.0], [None, 4.0], [8.0, 8.0], [8.0, 0.0]]),
             (2, "comb", 1, [[float(10 * (i % 2)), float(i) / 7] for i in range(60)]), (3, "point", 2, [[3.0, 3.0]])]
    for i in range(4, 20):
        lat, lng, size = rng.uniform(-9, 9), rng.uniform(-9, 9), 10 ** rng.uniform(-3, 1)
        areas.append((i, f"a{i}", i % 3, [[lat + rng.uniform(-size, size), lng + rng.uniform(-size, size)] for _ in range(rng.randrange(3, 40))]))
    points = [(i, f"d{i % 180}", "t", "ACTIVE", False, rng.uniform(-10, 10), rng.uniform(-10, 10)) for i in range(200)]
    points += [(500 + i, f"c{i}", "t", "ACTIVE", False, *p) for i, p in enumerate(areas[2][3] + areas[5][3])]
    points += points[:20]

    def has(p, polygon):
        hit, corners = False, [[c for c in axis if c is not None] for axis in zip(*polygon, strict=True)]
        if not all(min(c) <= at <= max(c) for c, at in zip(corners, p[5:7], strict=True)):
            return False  # an outline with a null corner is open
        for i, (lat_i, lng_i) in enumerate(polygon):
            lat_j, lng_j = polygon[i - 1]
            if None in (lat_i, lng_i, lat_j, lng_j):
                continue
            hit ^= (lng_i > p[6]) != (lng_j > p[6]) and p[5] < (lat_j - lat_i) * (p[6] - lng_i) / (lng_j - lng_i) + lat_i
        return hit
    got = geo.spatial_join(spark.createDataFrame(points, DEVICE), spark.createDataFrame(areas, AREA), many_edges)
    want = sorted((a[0], p[1]) for a in areas for p in points if has(p, a[3]))
    assert sorted((r.area_id, r.device_id) for r in got.collect()) == want


def test_an_area_of_100000_edges(spark):
    """Against ray casting with numpy; the plan after the edges' table holds no list of edges."""
    n = 100_000
    angle = np.arange(n) * (2 * np.pi / n)
    radius = 3 + np.random.default_rng(1).uniform(-1, 1, n)
    lat, lng = 40 + radius * np.cos(angle), 10 + radius * np.sin(angle)
    where = np.random.default_rng(2).uniform((36, 6), (44, 14), (1500, 2))
    last_lat, last_lng = np.roll(lat, 1), np.roll(lng, 1)
    want = []
    for i, (y, x) in enumerate(where):
        spans = (lng > x) != (last_lng > x)
        want += [f"d{i}"] * (np.sum(y < (last_lat - lat)[spans] * (x - lng[spans]) / (last_lng - lng)[spans] + lat[spans]) % 2)
    devices = spark.createDataFrame([(i, f"d{i}", "t", "ACTIVE", False, float(y), float(x)) for i, (y, x) in enumerate(where)], DEVICE)
    areas = spark.createDataFrame([(1, "coast", 0, np.stack((lat, lng), 1).tolist()), (2, "square", 0, SQUARE)], AREA)
    got = geo.spatial_join(devices, areas)
    assert sorted(r.device_id for r in got.collect()) == sorted(want) and len(want) > 300
    joined = geo._inside_detailed(devices.select("device_id", "latitude", "longitude"), areas.where("id = 1").withColumnsRenamed(
        {"id": "area_id", "name": "area_name"}))
    assert "array<struct" not in str([t for _, t in joined.dtypes])


def small_map(spark):
    devices = spark.createDataFrame(
        [(1, "d1", "t", "ACTIVE", False, 5.0, 5.0), (2, "d2", "t", "OFFLINE", False, 6.0, 6.0),
         (3, "d3", "t", "ACTIVE", True, None, None), (4, "d4", "t", "ACTIVE", False, 50.0, 50.0)], DEVICE)
    areas = spark.createDataFrame([(1, "Zone B", 20, SQUARE), (2, "Zone A", 10, []), (3, "Lonely", 5, [])], AREA)
    pairs = spark.createDataFrame([(1, 3), (2, 3), (1, 4), (1, 4)], "area_id int, device_id int")
    return devices, areas, pairs


def test_memberships(spark):
    devices, areas, pairs = small_map(spark)
    rows = {(r.name, r.device_id, r.device_count) for r in geo.areas_with_devices(areas, pairs, devices).collect()}
    assert rows == {("Zone B", "d3", 2), ("Zone B", "d4", 2), ("Zone A", "d3", 1), ("Lonely", None, 0)}
    mapped = {r.device_id: r.area_name for r in geo.devices_for_map(devices, areas, pairs).collect()}
    assert mapped == {"d1": None, "d2": None, "d3": "Zone A", "d4": "Zone B"}
    names = {r.device_id: r.area_names for r in geo.device_area_names(areas, pairs, devices).collect()}
    assert names == {"d3": "Zone A, Zone B", "d4": "Zone B"}


def test_map(spark):
    devices, areas, pairs = small_map(spark)
    recent = spark.createDataFrame([("d1", -0.1, 1), ("d1", 0.7, 2), ("ghost", 0.5, 3)], "device_id string, score double, seq int")
    marked = geo.mark_anomalies(devices, recent)
    got = {r.device_id: (r.is_anomaly, r.anomaly_score) for r in marked.collect()}
    assert got == {"d1": (True, 0.7), "d2": (False, 0.0), "d3": (False, 0.0), "d4": (False, 0.0)}
    located = geo.spatial_join(devices, areas)
    assert {(r.area_id, r.device_id) for r in located.collect()} == {(1, "d1"), (1, "d2")}
    risk = {r.name: r.high_risk for r in geo.areas_at_risk(areas, located, marked).collect()}
    assert risk == {"Zone B": True, "Zone A": False, "Lonely": False}
    resolved = geo.resolve_area(geo.devices_for_map(devices, areas, pairs), located)
    assert {r.device_id: r.area_name for r in resolved.collect()} == {
        "d1": "Zone B", "d2": "Zone B", "d3": "Zone A", "d4": "Zone B"}
    assert tuple(geo.map_kpis(marked).first()) == (4, 1, 1)
    assert {r.device_id: r.intensity for r in geo.heat_points(marked).collect()} == {"d1": 0.7, "d2": 0.15, "d4": 0.15}
    inside_zone = geo.filter_map(marked, located, 1, "normal")
    assert [r.device_id for r in inside_zone.collect()] == ["d2"]
    assert {(r.name, r.device_id, r.device_count) for r in geo.geo_area_members(areas, located).collect()} == {
        ("Zone B", "d1", 2), ("Zone B", "d2", 2), ("Zone A", None, 0), ("Lonely", None, 0)}


def test_markers(spark):
    rows = [("active", "ACTIVE", 1.0, 1.0, False, 0.0), ("anomaly", "ACTIVE", 1.0, 1.0, True, 0.9),
            ("score", "ACTIVE", 1.0, 1.0, False, 0.5), ("offline", "OFFLINE", 1.0, 1.0, True, 0.9),
            ("nogps", "OFFLINE", None, 1.0, True, 0.9)]
    df = spark.createDataFrame(rows, "device_id string, status string, latitude double, longitude double, is_anomaly boolean, anomaly_score double")
    assert {r.device_id: r.marker for r in geo.marker_classes(df).collect()} == {
        "active": "green", "anomaly": "red", "score": "yellow", "offline": "gray", "nogps": "blue"}


def test_area_changes(spark):
    areas = spark.createDataFrame([(1, "A", "[[1]]"), (2, "B", "[]")], "id int, name string, polygon string")
    pairs = spark.createDataFrame([(1, 7), (2, 7)], "area_id int, device_id int")
    log = spark.createDataFrame([(1, "create", 3, "C", "[[3]]"), (2, "polygon", 3, None, "[[4]]"), (3, "delete", 1, None, None),
                                 (4, "polygon", 9, None, "[[9]]"), (5, "delete", 8, None, None), (6, "polygon", 2, None, "[[2]]")],
                                "seq int, op string, area_id int, name string, polygon string")
    after, members = registry.apply_area_changes(areas, pairs, log)
    assert {tuple(r) for r in after.collect()} == {(2, "B", "[[2]]"), (3, "C", "[[4]]")}
    assert [tuple(r) for r in members.collect()] == [(2, 7)]


def test_assignments(spark):
    devices, areas, pairs = small_map(spark)
    asked = spark.createDataFrame([(2, 4), (2, 4), (1, 4), (9, 1), (1, 99)], "area_id int, device_id int")
    after = registry.assign_devices(pairs, asked, areas, devices)
    assert {tuple(r) for r in after.collect()} == {(1, 3), (2, 3), (1, 4), (2, 4)} and after.count() == 4
    assert {tuple(r) for r in registry.rejected_assignments(asked, areas, devices).collect()} == {(9, 1), (1, 99)}


def test_device_log(spark):
    devices, _, _ = small_map(spark)
    log = spark.createDataFrame(
        [(1, "locate", "d1", None, None, None, None), (2, "simulate", "d2", None, True, None, None),
         (3, "delete", "d3", None, None, None, None), (4, "create", "d3", "new", None, 1.0, 2.0),
         (5, "create", "d4", "again", None, None, None), (6, "locate", "ghost", None, None, 1.0, 1.0)],
        "seq int, op string, device_id string, type string, simulated boolean, latitude double, longitude double")
    got = {r.device_id: tuple(r)[1:] for r in registry.apply_device_changes(devices, log).collect()}
    assert got == {"d1": ("t", "ACTIVE", False, None, None), "d2": ("t", "OFFLINE", True, 6.0, 6.0),
                   "d3": ("new", "ACTIVE", False, 1.0, 2.0), "d4": ("t", "ACTIVE", False, 50.0, 50.0)}
    assert {(r.seq, r.code) for r in registry.device_conflicts(devices, log).collect()} == {(5, 409), (6, 404)}


def crowded_map(spark, n_areas=400, n_points=300):
    """Areas that nearly all lie over each other, some with null corners, ids twice or null; devices repeat, some without an id."""
    rng = random.Random(21)
    areas = []
    for i in range(n_areas):
        lat, lng = rng.uniform(-1, 1), rng.uniform(-1, 1)
        corners = [[lat + rng.uniform(-4, 4), lng + rng.uniform(-4, 4)] for _ in range(rng.choice([1, 3, 4, 5, 8, 9, 12]))]
        if i % 37 == 5:
            corners[0][i % 2] = None
        areas.append((None if i % 97 == 9 else i - i % 2 if i % 50 == 1 else i, f"a{i}", None if i % 61 == 3 else (i * 7) % 40, corners))
    points = [(i, None if i % 71 == 4 else f"d{i % (n_points - 20)}", "t", "ACTIVE", False, rng.uniform(-4, 4), rng.uniform(-4, 4))
              for i in range(n_points)]
    points += points[:5] + [(900, "far", "t", "ACTIVE", False, 80.0, 80.0), (901, "lost", "t", "ACTIVE", False, None, 0.0)]

    def has(p, polygon):
        corners = [[c for c in axis if c is not None] for axis in zip(*polygon, strict=True)]
        if p[5] is None or not all(c and min(c) <= at <= max(c) for c, at in zip(corners, p[5:7], strict=True)):
            return False
        return sum((lng_i > p[6]) != (lng_j > p[6]) and p[5] < (lat_j - lat_i) * (p[6] - lng_i) / (lng_j - lng_i) + lat_i
                   for (lat_i, lng_i), (lat_j, lng_j) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True)
                   if None not in (lat_i, lng_i, lat_j, lng_j)) % 2 == 1
    pairs = [(a, p) for a in areas for p in points if has(p, a[3])]
    return spark.createDataFrame(points, DEVICE), spark.createDataFrame(areas, AREA), areas, pairs


def counted_joins(monkeypatch):
    """The numbers of pairs that the spatial joins from now on list."""
    listed, join = [], geo.spatial_join

    def counting(devices, areas, *rest):
        pairs = join(devices, areas, *rest)
        listed.append(pairs.count())
        return pairs
    monkeypatch.setattr(geo, "spatial_join", counting)
    return listed


def test_pairs_decide_about_the_tasks(spark, monkeypatch):
    """Few rows that give many pairs are dealt to many tasks; no area of few edges is tested by a list."""
    monkeypatch.setattr(geo, "PAIRS_PER_TASK", 200)
    devices, areas, _, pairs = crowded_map(spark, 150, 200)
    got = geo.spatial_join(devices, areas)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    tasks = [int(n) for n in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", plan)]
    assert min(tasks) >= 8 and max(tasks) > 2 * len(pairs) // 200
    found = sorted((str(r.area_id), str(r.device_id), r.latitude) for r in got.collect())
    assert found == sorted((str(a[0]), str(p[1]), p[5]) for a, p in pairs) and len(found) > 2000


def test_first_area_without_all_pairs(spark, monkeypatch):
    devices, areas, _, pairs = crowded_map(spark)
    listed = counted_joins(monkeypatch)
    got = {r.device_id: (r.created_at, r.area_id, r.area_name) for r in geo.first_located(devices, areas, 10).collect()}
    want = {}
    for a, p in pairs:
        if p[1] is not None:
            want[p[1]] = min(want.get(p[1], ((True, 10**9), (True, 0), "")), ((a[2] is not None, a[2]), (a[0] is not None, a[0]), a[1]),
                             key=lambda k: (k[0][0], k[0][1] or 0, k[1][0], k[1][1] or 0, k[2]))
    assert got == {d: (c[1], i[1], name) for d, (c, i, name) in want.items()}
    assert len(listed) > 1 and sum(listed) < len(pairs) / 3
    assert geo.first_located(devices, areas.where("id < 0")).collect() == []


def test_members_of_areas_are_not_stored(spark, monkeypatch):
    devices, areas, rows, pairs = crowded_map(spark, 80, 100)
    store = geo.stored
    purposes = []
    monkeypatch.setattr(geo, "stored", lambda df, purpose: purposes.append(purpose) or store(df, purpose))
    got = sorted((str(r.area_id), r.name, str(r.device_id), r.device_count) for r in geo.geo_area_members(areas, geo.spatial_join(devices, areas)).collect())
    count = {a[0]: sum(b[0] == a[0] for b, _ in pairs) if a[0] is not None else 0 for a in rows}
    want = [(str(a[0]), a[1], str(p[1]), count[a[0]]) for b, p in pairs for a in rows if a[0] is not None and a[0] == b[0]]
    want += [(str(a[0]), a[1], "None", 0) for a in rows if not count[a[0]]]
    assert got == sorted(want) and "located" not in purposes


def test_areas_at_risk_without_all_pairs(spark, monkeypatch):
    devices, areas, rows, pairs = crowded_map(spark)
    listed = counted_joins(monkeypatch)
    some = geo.some_located(devices, areas, 10)
    found = [(r.area_id, r.device_id) for r in some.collect()]
    assert len(found) == len(set(a for a, _ in found)) and set(found) <= {(a[0], p[1]) for a, p in pairs}
    assert {a for a, _ in found} == {a[0] for a, p in pairs if a[0] is not None and p[1] is not None}
    assert len(listed) > 1 and sum(listed) < len(pairs) / 3
    marked = devices.withColumn("is_anomaly", F.lit(True))
    risk = sorted((str(r.area_id), r.name, r.high_risk) for r in geo.areas_at_risk(areas, some, marked).collect())
    hit = {a[0] for a, p in pairs if p[1] is not None}
    assert risk == sorted((str(a[0]), a[1], a[0] is not None and a[0] in hit) for a in rows)
    assert geo.some_located(devices.where("id < 0"), areas).collect() == []
