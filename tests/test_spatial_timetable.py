"""Spatial joins and timetable search against brute force, scenarios on small timetables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reachgrid.functions import geo
from reachgrid.operators import scenario, spatial, stats, timetable


@pytest.fixture(scope="module")
def towns():
    """Clustered points: a third of them sit in one spot's surroundings, some far away."""
    rng = random.Random(3)
    def spot(i):
        if i % 3 == 0:
            return 5000 + rng.randint(-20, 20), 5000 + rng.randint(-20, 20)
        return rng.randint(-20000, 40000), rng.randint(-20000, 40000)
    left = [(i, *map(float, spot(i + 1))) for i in range(60)]
    right = [(i, "ab"[i % 2], *map(float, spot(i))) for i in range(240)] + [(999, "rare", 100.0, 100.0)]
    return left, right


@pytest.fixture(scope="module")
def frames(spark, towns):
    left, right = towns
    return (spark.createDataFrame(left, "id int, x double, y double"),
            spark.createDataFrame(right, "poi_id int, category string, px double, py double"))


def test_nearest_k(towns, frames):
    left, right = towns
    got = {}
    for r in spatial.nearest_k(*frames, 4, by=["category"]).collect():
        got.setdefault((r.id, r.category), []).append((r["rank"], r.poi_id))
    for i, x, y in left:
        for c in ("a", "b", "rare"):
            want = sorted((math.hypot(x - px, y - py), p) for p, k, px, py in right if k == c)[:4]
            assert sorted(got[i, c]) == [(n, p) for n, (_, p) in enumerate(want, 1)]


def test_nth_distance(towns, frames):
    left, right = towns
    asked = frames[0].select("*", (F.col("id") * 5 % 130).alias("n"), F.lit("a").alias("category"))
    got = {r.id: r.distance for r in spatial.nth_distance(asked, frames[1], by=["category"]).collect()}
    for i, x, y in left:
        d = sorted(math.hypot(x - px, y - py) for _, k, px, py in right if k == "a")
        n = min(i * 5 % 130, len(d))
        assert (i in got) == (n > 0) and (n == 0 or got[i] == pytest.approx(d[n - 1]))


def test_pairs_and_sums_within(towns, frames):
    left, right = towns
    near = {(i, p) for i, x, y in left for p, _, px, py in right if math.hypot(x - px, y - py) <= 3000}
    assert {(r.id, r.poi_id) for r in spatial.pairs_within(*frames, 3000).collect()} == near
    sums = {r.id: r.n for r in spatial.sum_within(*frames, 3000, {"n": F.lit(1)}).collect()}
    assert sums == {i: sum(1 for a, _ in near if a == i) for i, _, _ in left}
    assert {r.id for r in spatial.exists_within(*frames, 3000).collect()} == {i for i, _ in near}


def test_polygons(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0)]
    polys = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "poly int, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 8.0), (3, 1.0, 8.0), (4, 30.0, 1.0)], "id int, x double, y double")
    assert {r.id for r in spatial.points_in_polygons(pts, polys, cell=3).collect()} == {1, 3}
    assert {r.id for r in spatial.points_in_polygons(pts, polys, cell=100, how="left_anti").collect()} == {2, 4}


def test_hexagon_is_the_nearest_centre(spark):
    pts = spark.range(400).select("id", ((F.col("id") * 7919) % 5000).cast("double").alias("x"), ((F.col("id") * 104729) % 5003).cast("double").alias("y"))
    q, r = geo.hex_axial(F.col("x"), F.col("y"), 250.0, (30.0, 70.0))
    binned = {v.id: (v.q, v.r) for v in pts.select("id", q.alias("q"), r.alias("r")).collect()}
    lattice = spatial.hex_lattice(spark, (-500, -500, 5500, 5500), 250.0, (30.0, 70.0)).select(
        F.concat_ws("_", "q", "r").alias("hex_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    for v in spatial.nearest_centre(pts, lattice, 150).collect():
        assert v.hex_id == "%d_%d" % binned[v.id]
    with pytest.raises(ValueError):
        spatial.hex_lattice(spark, (0, 0, 1e6, 1e6), 10.0, max_cells=1000)


def test_grid_projection(spark):
    lon, lat = geo.transverse_mercator_to_lonlat(F.lit(500000.0), F.lit(500000.0))
    row = spark.range(1).select(lon.alias("lon"), lat.alias("lat"), geo.utm_epsg(F.lit(180.0), F.lit(-1.0)).alias("e")).first()
    assert row.lon == pytest.approx(19.0) and 52.0 < row.lat < 52.6 and row.e == 32760


def test_moran_of_a_gradient(spark):
    cells = spark.range(100).select("id", (F.col("id") % 10 * 100).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"))
    cells = cells.withColumn("y", F.col("y") * 100)
    graph = spatial.nearest_k(cells, cells.select(F.col("id").alias("other"), F.col("x").alias("px"), F.col("y").alias("py")), 4,
                              base=50, right_key="other", skip_same=True)
    assert graph.count() == 400 and graph.where("id = other").count() == 0
    values = cells.select("id", F.col("x").alias("v"))
    out = stats.moran_p_value(values, graph, 4, permutations=49).first()
    assert out.i > 0.7 and out.p == pytest.approx(1 / 50)


@pytest.mark.parametrize("n", [2, 3, 7, 100, 1013])
def test_shuffles_are_permutations(spark, n):
    rows = spark.range(n).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("perm"))
    got = stats.shuffle_positions(rows, "id", "perm", n, "to", seed=5).collect()
    for p in (1, 2):
        assert sorted(r.to for r in got if r.perm == p) == list(range(n))
    if n > 100:
        assert sum(r.to == r.id for r in got) < 20


# --- timetable -------------------------------------------------------------------------------

def test_isochrones_follow_the_origins(spark):
    origins = spark.createDataFrame([(1, 0.0, 0.0), (2, 500_000.0, 300_000.0), (3, 500_100.0, 300_000.0)], "id int, x double, y double")
    cells = {(r.x, r.y) for r in timetable.isochrone_cells(origins, 250.0, [1]).collect()}
    want = {(i * 250.0, j * 250.0) for ox, oy in ((0, 0), (500_000, 300_000), (500_100, 300_000)) for i in range(int(ox // 250) - 5, int(ox // 250) + 6)
            for j in range(int(oy // 250) - 5, int(oy // 250) + 6) if (i * 250 - ox) ** 2 + (j * 250 - oy) ** 2 <= 900 ** 2}
    assert cells == want
    times = spark.createDataFrame([(1, 5), (1, 10), (1, 30)], "from_id int, minutes int")
    assert [(r.cutoff, r.cells, r.area) for r in timetable.isochrones(times, [5, 10, 15], 4.0).orderBy("cutoff").collect()] == [(5, 1, 4.0), (10, 2, 8.0), (15, 2, 8.0)]


@pytest.fixture()
def small_line(spark):
    trips = spark.createDataFrame([(1, 5, 0), (2, 5, 0), (3, 5, 0), (4, 6, 0), (5, 5, 1)], "trip_id int, route_id int, direction_id int")
    rows = []
    for t, start, path in ((1, 21600, "ab"), (2, 25200, "abc"), (3, 36000, "abc"), (4, 25200, "xy"), (5, 25500, "cb")):
        rows += [(t, i, s, start + i * 100, start + i * 100 + 20) for i, s in enumerate(path)]
    return trips, spark.createDataFrame(rows, "trip_id int, seq int, stop_id string, arr int, dep int")


def routes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "route_id int")


def test_scale_speed(spark, small_line):
    trips, calls = small_line
    got = {(r.trip_id, r.seq): (r.arr, r.dep) for r in scenario.scale_speed(calls, trips, routes(spark, 5), 0.8).collect()}
    assert got[2, 0] == (25200, 25220) and got[2, 1] == (25320, 25340) and got[2, 2] == (25440, 25460) and got[4, 1] == (25300, 25320)
    with pytest.raises(ValueError):
        scenario.scale_speed(calls, trips, routes(spark, 5), 0)


def test_set_headway_uses_the_busiest_pattern(spark, small_line):
    trips, calls = small_line
    new_trips, new_calls = scenario.set_headway(calls, trips, routes(spark, 5), 1800, "07:00", "08:00")
    ids = sorted(r.trip_id for r in new_trips.collect())
    assert ids == ["1", "2@25200", "2@27000", "3", "4", "5@25200", "5@27000"]
    copy = {r.seq: (r.stop_id, r.arr) for r in new_calls.where("trip_id = '2@27000'").collect()}
    # The pattern's first departure (25220) moves to the start of the run.
    assert copy[0] == ("a", 26980) and copy[2][0] == "c"


def test_remove_and_add(spark, small_line):
    trips, _ = small_line
    assert scenario.remove_routes(trips, routes(spark, 5)).count() == 1
    line = spark.createDataFrame([("L", [{"lon": 19.0, "lat": 51.0}, {"lon": 19.0, "lat": 51.0}, {"lon": 19.0, "lat": 51.01}], 36.0, 30, 600, 21600, 22800)],
                                 "line_id string, vertices array<struct<lon:double,lat:double>>, speed_kmh double, dwell int, headway int, start int, end int")
    stops, calls = scenario.add_lines(line)
    assert stops.count() == 2 and calls.count() == 8
    first = {r.seq: (r.stop_id, r.arr, r.dep) for r in calls.where("direction_id = 0 and trip_id = 'L@0@21600'").collect()}
    assert first[1] == ("L#0", 21600, 21630) and first[2] == ("L#1", 21630 + 111, 21630 + 141)
    back = {r.seq: r.stop_id for r in calls.where("direction_id = 1 and trip_id = 'L@1@21600'").collect()}
    assert back == {1: "L#1", 2: "L#0"}
    assert scenario.line_definition([(19, 51), (19.0000001, 51), (19.1, 51)]) == [(19.0, 51.0), (19.1, 51.0)]
    with pytest.raises(ValueError):
        scenario.line_definition([(19, 51), (19, 51)])


def test_scenario_files(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"id": "s", "modifications": [{"type": "easy-remove-routes", "routes": ["5"]}, {"type": "fly"}]}')
    (tmp_path / "empty.json").write_text("{}")
    rows = scenario.modifications(scenario.read_scenarios(spark, str(tmp_path / "*.json"))).collect()
    assert sorted((r.file, r.type, r.problem) for r in rows if r.type) == [("cut.json", "easy-remove-routes", None), ("cut.json", "fly", "unknown type")]
    assert [r.problem for r in rows if r.file == "empty.json"] == ["no modifications"]
    assert all(len(r.label.split(":")[1]) == 8 for r in rows)
