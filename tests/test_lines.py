"""Frequencies and nearest stops by location, against brute force."""

import random
from statistics import median

import pytest

from reachgrid.operators import lines, spatial
from reachgrid.session import checkpoint


def test_frequency_and_nearest_stop_by_location(spark):
    r = random.Random(5)
    cells = [(i, r.randrange(4) * 300, r.randrange(4) * 300) for i in range(60)]
    stops = [(i, r.choice(["tram", "bus"]), r.randrange(4) * 300 + r.choice([0, 50]), r.randrange(4) * 300) for i in range(40)]
    deps = [(r.randrange(40), r.randrange(5), r.randrange(2), r.randrange(0, 1440, 20)) for _ in range(900)]
    c = spark.createDataFrame(cells, "hex_id long, x long, y long")
    s = spark.createDataFrame(stops, "stop_id long, mode string, px long, py long")
    d = spark.createDataFrame(deps, "stop_id long, route_id long, direction_id long, minute long")
    away = lambda cell, stop: round(((cell[1] - stop[2]) ** 2 + (cell[2] - stop[3]) ** 2) ** 0.5, 3)
    want, nearest = {}, {}
    for cell in cells:
        freq = {"tram": [0, 0], "bus": [0, 0]}
        for line in {(x[1], x[2]) for x in deps}:
            at = [(away(cell, t), t[0], t[1]) for t in stops if away(cell, t) <= 300 and any(x[:3] == (t[0], *line) for x in deps)]
            if at:
                _, stop, mode = min(at)
                minutes = [x[3] for x in deps if x[:3] == (stop, *line)]
                freq[mode][0] += sum(420 <= m < 540 for m in minutes) / 2
                freq[mode][1] += sum(900 <= m < 1080 for m in minutes) / 3
        want |= {(cell[0], m): tuple(round(v, 2) for v in f) for m, f in freq.items()}
        nearest[cell[0]] = tuple(min((away(cell, t) for t in stops if t[1] == m and away(cell, t) <= 320), default=None) for m in ("tram", "bus"))
    got = lines.line_frequency(c, s, d, {"morning": (420, 540), "afternoon": (900, 1080)}, 300).collect()
    assert {(x.hex_id, x.mode): (x.freq_morning, x.freq_afternoon) for x in got} == want and len(got) == len(want)
    assert {x.hex_id: (x.d_tram_m, x.d_bus_m) for x in lines.nearest_per_mode(c, s, ["tram", "bus"], 320).collect()} == nearest


def test_rows_of_one_location_do_not_multiply(spark):
    """5000 cells and 2000 stops with 80 lines each on one spot: 800 million rows if each cell met each stop."""
    cells = spark.range(5000).selectExpr("id as hex_id", "0 as x", "0 as y")
    stops = spark.range(2000).selectExpr("id as stop_id", "'bus' as mode", "30 as px", "40 as py")
    deps = spark.range(160_000).selectExpr("id % 2000 as stop_id", "floor(id / 4000) as route_id", "floor(id / 2000) % 2 as direction_id", "450 as minute")
    got = lines.line_frequency(cells, stops, deps, {"morning": (420, 540)}, 1000).groupBy("mode", "freq_morning").count().collect()
    assert [tuple(x) for x in got] == [("bus", 40.0, 5000)]


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_ways_are_not_broadcast(spark, monkeypatch):
    """As a file the 200,000 ways take less than a table that Spark broadcasts, in memory far more."""
    plans = []
    monkeypatch.setattr(lines, "checkpoint", lambda df: plans.append(df) or checkpoint(df))
    ways = checkpoint(spark.range(200_000).selectExpr("id as way_id", "'major' as grp", "id % 50 * 100 as x", "0 as y"))
    direct = spark.createDataFrame([(i, i % 3 / 2) for i in range(0, 200, 2)], "way_id long, factor double")
    out = lines.fill_ways(ways, direct, 10)
    for node in (n for df in (*plans, out) for n in _nodes(df._jdf.queryExecution().sparkPlan())):
        if node.nodeName() == "BroadcastHashJoin":
            built = node.right() if node.buildSide().toString() == "BuildRight" else node.left()
            assert "way_id" not in built.output().toString()
    assert out.count() == 200_000


def test_way_factors_of_equal_segments_and_edges(spark):
    r = random.Random(7)
    segments = [(r.randrange(3) * 100.0, 0.0, r.randrange(4, 6) * 100.0, r.choice([0.0, 10.0]), r.randrange(9) / 8) for _ in range(60)]
    edges = [(r.randrange(40), x := r.randrange(8) * 80.0, y := r.choice([0.0, 15.0, 90.0]), x + r.choice([30.0, 50.0]), y) for _ in range(90)]
    s = spark.createDataFrame(segments, "x1 double, y1 double, x2 double, y2 double, factor double")
    e = spark.createDataFrame(edges, "way_id long, ex1 double, ey1 double, ex2 double, ey2 double")
    pairs = spatial.match_segments(s, e, corridor=20, max_angle=10).collect()
    want = {}
    for p in pairs:
        want.setdefault(p.way_id, []).append((p.factor * (p.ex2 - p.ex1), p.ex2 - p.ex1))
    got = {x.way_id: x.factor for x in lines.way_factors(s, e, corridor=20, max_angle=10).collect()}
    assert got == {w: pytest.approx(sum(a for a, _ in v) / sum(b for _, b in v)) for w, v in want.items()} and len(got) > 10


def test_fill_ways_by_location(spark):
    r = random.Random(9)
    ways = [(i, r.choice(["major", "minor", "track", "lone", None]), r.randrange(6) * 100, r.randrange(6) * 100) for i in range(300)]
    direct = {i: r.choice([0.25, 0.5, 0.75, 1.0, i / 300, None]) for i, grp, *_ in ways if r.random() < 0.4 and grp != "lone"}
    want = {}
    for i, grp, x, y in ways:
        mates = [(w, direct[w[0]]) for w in ways if w[0] in direct and w[1] == grp and grp and direct[w[0]] is not None]
        near = [f for w, f in mates if (w[2] - x) ** 2 + (w[3] - y) ** 2 <= 150 ** 2] if i not in direct else []
        if direct.get(i) is not None:
            want[i] = (direct[i], "direct")
        else:
            want[i] = (median(near), "radius") if near else (median([f for _, f in mates]) if mates else 1.0, "class")
    got = lines.fill_ways(spark.createDataFrame(ways, "way_id long, grp string, x long, y long"),
                          spark.createDataFrame(list(direct.items()), "way_id long, factor double"), 150).collect()
    assert {x.way_id: (x.factor, x.source) for x in got} == {i: (pytest.approx(f), s) for i, (f, s) in want.items()} and len(got) == 300


def test_ways_of_one_location_do_not_multiply(spark):
    """20,000 ways without a factor and 40,000 with one on one spot: 800 million pairs if each met each."""
    ways = spark.range(60_000).selectExpr("id as way_id", "'major' as grp", "0 as x", "0 as y")
    direct = spark.range(40_000).selectExpr("id as way_id", "id % 5 / 4 as factor")
    got = lines.fill_ways(ways, direct, 100).groupBy("factor", "source").count().where("source = 'radius'").collect()
    assert [tuple(x) for x in got] == [(0.5, "radius", 20_000)]
