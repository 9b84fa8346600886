"""Crowded cells: leaves stay bounded, keys are dealt evenly, joins give the rows of brute force."""

import math
import random
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from reachgrid.operators import quadtree, spatial
from reachgrid.operators.quadtree import KEY, Tree

SMALL = Tree(least=20, share=50, depth=7)


@pytest.fixture(scope="module")
def crowd():
    """A third of the points in one cell of 100 m, some of them on one spot, repeated rows, negative and missing coordinates."""
    r = random.Random(12)
    points = [(i, r.uniform(-2000, 2000), r.uniform(-2000, 2000)) for i in range(1200)]
    points += [(2000 + i, 300 + r.random() ** 3 * 100, -500 + r.random() ** 3 * 100) for i in range(500)]
    points += [(3000 + i, 310.0, -490.0) for i in range(150)] + [(1, 10.0, 10.0)] * 5 + [(9, None, 4.0), (10, None, None), (11, 100.0, -200.0)]
    r.shuffle(points)
    return points


@pytest.fixture(scope="module")
def points(spark, crowd):
    return spark.createDataFrame(crowd, "id long, x double, y double").repartition(4)


def leaf_table(points, tree=SMALL, size=100.0):
    return quadtree.leaves(points, F.col("x"), F.col("y"), size, least=tree.least, share=tree.share, depth=tree.depth)


def test_leaves_are_bounded_and_whole(points, crowd):
    found = leaf_table(points).collect()
    bound = max(20, math.ceil(sum(p[1] is not None and p[2] is not None for p in crowd) / 50))
    assert len(found) < 4 * SMALL.share * SMALL.depth and len(found) > 10
    inside = Counter()
    for _, x, y in crowd:
        if x is not None and y is not None:
            inside[math.floor(x / 100), math.floor(y / 100)] += 1
    crowded = {c for c, n in inside.items() if n > bound}
    assert {(r["_bx"], r["_by"]) for r in found} == crowded
    for cell in crowded:
        assert sum(r.n for r in found if (r["_bx"], r["_by"]) == cell) == inside[cell]
    assert all(r.n <= bound or r["_level"] == SMALL.depth for r in found) and all(r.parts == math.ceil(r.n / bound) for r in found)
    assert any(r.parts > 1 for r in found)  # the one spot cannot be split


def test_each_point_has_one_key_and_keys_are_dealt_evenly(spark, points, crowd):
    keyed = quadtree.point_keys(points, F.col("x"), F.col("y"), 100.0, leaf_table(points), depth=SMALL.depth)
    assert sorted(map(repr, keyed.select("id", "x", "y").collect())) == sorted(map(repr, points.collect()))
    bound = max(20, math.ceil(len(crowd) / 50))
    sizes = [r["count"] for r in keyed.where("x is not null and y is not null").groupBy(*KEY).count().collect()]
    assert max(sizes) <= 2 * bound  # parts are dealt by hash
    plain = points.groupBy(F.floor(F.col("x") / 100), F.floor(F.col("y") / 100)).count().agg(F.max("count")).first()[0]
    assert plain > len(crowd) // 3


def test_largest_task_is_within_three_times_the_median(spark):
    r = random.Random(2)
    rows = [(i, r.uniform(0, 20000), r.uniform(0, 20000)) for i in range(20000)] + [(i, 5000 + r.gauss(50, 10), 5000 + r.gauss(50, 10)) for i in range(10000)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    a, _ = quadtree.dealt(points, F.col("x"), F.col("y"), points.limit(1), spatial._around(F.col("x"), F.col("y"), 100.0), 100.0, Tree(least=50))
    sizes = [x["count"] for x in a.repartition(16, *KEY).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) <= 3 * median(sizes)


@pytest.mark.parametrize("tree", [SMALL, Tree(), None])
def test_joins_by_distance(spark, points, crowd, tree):
    r = random.Random(3)
    spots = [(i, r.uniform(-2100, 2100), r.uniform(-2100, 2100)) for i in range(300)] + [(500 + i, 350 + r.gauss(0, 80), -450 + r.gauss(0, 80)) for i in range(40)]
    spots += [(900, 310.0, -490.0), (901, 310.0, -490.0), (902, None, 0.0), (903, 200.0, -200.0)]
    right = spark.createDataFrame(spots, "k long, px double, py double")
    want = Counter((i, k) for i, x, y in crowd for k, a, b in spots if None not in (x, y, a) and math.hypot(x - a, y - b) <= 100)
    near = spatial.pairs_within(points, right, 100.0, tree=tree)
    assert near.columns == ["id", "x", "y", "k", "px", "py", "distance"]
    assert Counter((x.id, x.k) for x in near.collect()) == want
    some = Counter(i for i, x, y in crowd if any(None not in (x, y, a) and math.hypot(x - a, y - b) <= 100 for _, a, b in spots))
    got = spatial.exists_within(points, right, 100.0, tree=tree)
    assert got.columns == points.columns and Counter(x.id for x in got.collect()) == some


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_points_in_polygons(spark, points, crowd, how):
    rings = [(0, [(-1500.0, -1500.0), (1500.0, -1400.0), (0.0, 300.0), (1300.0, 1500.0), (-1500.0, 1400.0)]), (1, [(305.0, -495.0), (330.0, -495.0), (330.0, -470.0)]),
             (2, [(300.0, -500.0), (400.0, -500.0), (400.0, -400.0), (300.0, -400.0)]), (3, [(5000.0, 5000.0), (5100.0, 5000.0), (5000.0, 5100.0)])]
    polygons = spark.createDataFrame([(i, [{"x": a, "y": b} for a, b in ring]) for i, ring in rings], "poly long, ring array<struct<x: double, y: double>>")

    def inside(x, y, ring):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            hit ^= (by > y) != (ay > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return hit
    pairs = Counter((i, p) for i, x, y in crowd if x is not None and y is not None for p, ring in rings if inside(x, y, ring))
    hits = [sum(inside(x, y, ring) for _, ring in rings) if x is not None and y is not None else 0 for _, x, y in crowd]
    got = spatial.points_in_polygons(points, polygons, cell=100, how=how, tree=SMALL).collect()
    if how == "inner":
        assert Counter((x.id, x.poly) for x in got) == pairs
    else:
        assert Counter(x.id for x in got) == Counter(i for (i, *_), n in zip(crowd, hits, strict=True) if (n > 0) == (how == "left_semi"))


def test_segments(spark):
    r = random.Random(7)
    def line(cx, cy, spread):
        x, y, a = cx + r.gauss(0, spread), cy + r.gauss(0, spread), r.uniform(0, 6)
        return x, y, x + 60 * math.cos(a), y + 60 * math.sin(a)
    segments = spark.createDataFrame([(i, *line(0, 0, 300)) for i in range(60)], "seg long, x1 double, y1 double, x2 double, y2 double")
    edges = spark.createDataFrame([(i, *line(40, 40, 400 if i % 3 else 5)) for i in range(400)], "way long, ex1 double, ey1 double, ex2 double, ey2 double")
    runs = [sorted(map(tuple, spatial.match_segments(segments, edges, corridor=50, max_angle=40, tree=t).select("seg", "way").collect())) for t in (None, SMALL)]
    assert runs[0] == runs[1] and len(runs[0]) > 50


def test_empty_tables(spark, points):
    none = points.limit(0)
    right = points.select(F.col("id").alias("k"), F.col("x").alias("px"), F.col("y").alias("py"))
    assert leaf_table(none).count() == 0
    assert spatial.pairs_within(none, right, 100.0).count() == 0 and spatial.pairs_within(points, right.limit(0), 100.0).count() == 0
    assert spatial.exists_within(none, right, 100.0).count() == 0
    with pytest.raises(ValueError):
        leaf_table(points, Tree(depth=0))


def test_pairs_are_dealt_by_their_number(spark):
    """Few rows, many pairs: tasks follow the pairs, and a key with crowds on both sides is cut into tiles."""
    left = spark.range(900).select("id", F.lit(10.0).alias("x"), (F.col("id") % 3 * 1.0).alias("y"))
    right = spark.range(500).select(F.col("id").alias("k"), F.lit(12.0).alias("px"), F.when(F.col("id") % 50 > 0, 2.0).otherwise(500.0).alias("py"))
    near = spatial.pairs_within(left, right, 100.0, tree=Tree(least=64, share=5, depth=2, task_pairs=20_000))
    sizes = [r["count"] for r in near.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 900 * 490 == near.select("id", "k").distinct().count()
    assert max(sizes) <= 900 * 490 / 4
    a, b = quadtree.dealt(left, F.col("x"), F.col("y"), right, spatial._around(F.col("px"), F.col("py"), 100.0), 100.0, Tree())
    a, b, keys = quadtree.tiled(a, b, quadtree.KEY, task_pairs=1000, tile_rows=100)
    tiles = a.join(b, keys).groupBy(*keys).count().collect()
    assert sum(r["count"] for r in tiles) == 900 * 490 and len(tiles) >= 40 and max(r["count"] for r in tiles) <= 4 * 100 * 100
