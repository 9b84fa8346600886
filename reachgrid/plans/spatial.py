"""Distance, nearest-neighbour, polygon, hexagon and projection queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from reachgrid.functions import geo
from reachgrid.functions.values import numeric_text_key, whole
from reachgrid.operators import quadtree, spatial
from reachgrid.plans.registry import query
from reachgrid.plans.views import SQL_VIEWS

# Rings around nation centres: a concave five-corner shape (offsets in metres).
RING = ((-4000, -3000), (4000, -3500), (1000, 500), (3500, 4000), (-3500, 3700))

SQL_VIEWS["v_polys"] = """SELECT n_nationkey::BIGINT AS poly_id, CASE n_nationkey % 4 WHEN 0 THEN 'school' WHEN 1 THEN 'pharmacy' WHEN 2 THEN 'university' ELSE 'mall' END AS category,
    (n_nationkey::BIGINT * 7919 % 1000) * 30 + 7 AS cx, (n_nationkey::BIGINT * 104729 % 1000) * 30 + 11 AS cy FROM nation"""
SQL_VIEWS["v_edges"] = "SELECT poly_id, category, cx + ax AS x1, cy + ay AS y1, cx + bx AS x2, cy + by_ AS y2 FROM v_polys CROSS JOIN (VALUES " + ", ".join(
    f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(RING, RING[1:] + RING[:1])) + ") e(ax, ay, bx, by_)"
SQL_VIEWS["v_inside"] = """SELECT p.x, p.y, e.poly_id, e.category
    FROM (SELECT DISTINCT x, y FROM v_origins UNION SELECT DISTINCT x, y FROM v_dests) p JOIN v_edges e ON (e.y1 > p.y) <> (e.y2 > p.y)
    GROUP BY ALL HAVING count(*) FILTER (p.x < (e.x2 - e.x1)::DOUBLE * (p.y - e.y1) / (e.y2 - e.y1) + e.x1) % 2 = 1"""


def polygons(d):
    k = F.col("n_nationkey").cast("bigint")
    cx, cy = k * 7919 % 1000 * 30 + 7, k * 104729 % 1000 * 30 + 11
    category = F.get(F.array(*[F.lit(c) for c in ("school", "pharmacy", "university", "mall")]), (k % 4).cast("int"))
    ring = F.array(*[F.struct((cx + a).cast("double").alias("x"), (cy + b).cast("double").alias("y")) for a, b in RING])
    return d.table("nation").select(k.alias("poly_id"), category.alias("category"), ring.alias("ring"))


def pois(d):
    return d.dests.select(F.col("id").alias("poi_id"), "category", "capacity", F.col("x").alias("px"), F.col("y").alias("py"))


_D2 = "((o.x - t.x) * (o.x - t.x) + (o.y - t.y) * (o.y - t.y))"


@query("c11_pairs_within", f"""
SELECT o.id, t.id AS poi_id, round(sqrt({_D2}), 6) AS distance FROM v_origins o JOIN v_dests t ON {_D2} <= 800 * 800""")
def pairs_within(d):
    return spatial.pairs_within(d.origins.select("id", "x", "y"), pois(d), 800).select(
        "id", "poi_id", F.round("distance", 6).alias("distance"))


# A third of the origins stand in one cell of the join.
_MOVED = "(SELECT id, " + ", ".join(f"CASE WHEN id % 3 = 0 THEN 15000 + {c} % 700 ELSE {c} END AS {c}" for c in "xy") + " FROM v_origins)"


@query("c11_crowded_cells", f"""
SELECT t.id AS poi_id, count(*) AS n, sum(round(sqrt({_D2}), 3)) AS apart FROM {_MOVED} o JOIN v_dests t ON {_D2} <= 800 * 800 GROUP BY t.id""")
def crowded_cells(d):
    moved = [F.when(F.col("id") % 3 == 0, 15000 + F.col(c) % 700).otherwise(F.col(c)).alias(c) for c in "xy"]
    near = spatial.pairs_within(d.origins.select("id", *moved), pois(d), 800, tree=quadtree.Tree(least=64))
    return near.groupBy("poi_id").agg(F.count("*").alias("n"), F.sum(F.round("distance", 3)).alias("apart"))


@query("c11_exists_within", f"""
SELECT region, count(*) AS n, sum(pop)::BIGINT AS pop FROM v_people o
WHERE EXISTS (SELECT 1 FROM v_dests t WHERE {_D2} <= 500 * 500) GROUP BY region""")
def exists_within(d):
    near = spatial.exists_within(d.people, pois(d), 500)
    return near.groupBy("region").agg(F.count("*").alias("n"), F.sum("pop").alias("pop"))


@query("c11_count_within", f"""
SELECT o.id, count(t.id) AS n, coalesce(sum(t.capacity), 0)::BIGINT AS capacity
FROM v_origins o LEFT JOIN v_dests t ON {_D2} <= 1500 * 1500 GROUP BY o.id""")
def count_within(d):
    out = spatial.sum_within(d.origins.select("id", "x", "y"), pois(d), 1500, {"n": F.lit(1), "capacity": F.col("capacity")})
    return out.select("id", "n", "capacity")


@query("c12_nearest_k", f"""
SELECT id, category, rank, poi_id, round(sqrt(d2), 6) AS distance FROM (
    SELECT o.id, t.category, t.id AS poi_id, {_D2} AS d2,
           row_number() OVER (PARTITION BY o.id, t.category ORDER BY {_D2}, t.id) AS rank
    FROM v_origins o CROSS JOIN v_dests t) WHERE rank <= 3""")
def nearest_k(d):
    out = spatial.nearest_k(d.origins.select("id", "x", "y"), pois(d), 3, by=["category"])
    return out.select("id", "category", F.col("rank").cast("bigint").alias("rank"), "poi_id", F.round("distance", 6).alias("distance"))


SPACING = 1000.0
_SIZE = f"({SPACING} / sqrt(3))"


def hex_sql(source: str, spacing: float = SPACING, extra: str = "id, pop, x, y") -> str:
    """Axial hexagon coordinates of the rows of ``source``."""
    size = f"({spacing} / sqrt(3))"
    return f"""SELECT {extra}, CASE WHEN dq > dr AND dq > ds THEN -r0 - s0 ELSE q0 END::BIGINT AS q,
       CASE WHEN (dq > dr AND dq > ds) OR dr <= ds THEN r0 ELSE -q0 - s0 END::BIGINT AS r FROM (
  SELECT *, round(qf) AS q0, round(rf) AS r0, round(-qf - rf) AS s0, abs(round(qf) - qf) AS dq, abs(round(rf) - rf) AS dr, abs(round(-qf - rf) + qf + rf) AS ds FROM (
    SELECT *, (x * (sqrt(3) / 3) - y / 3) / {size} AS qf, y * 2 / 3 / {size} AS rf FROM {source}))"""


@query("k04_hex_binning", f"SELECT q, r, count(*) AS n, sum(pop)::BIGINT AS pop FROM ({hex_sql('v_people')}) GROUP BY q, r")
def hex_binning(d):
    q, r = geo.hex_axial(F.col("x"), F.col("y"), SPACING)
    return d.people.groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("n"), F.sum("pop").alias("pop"))


@query("c13_nearest_centre", f"""
WITH b AS ({hex_sql('v_origins', extra='id, x, y')}),
c AS (SELECT b.id, b.q || '_' || b.r AS hex_id, sqrt(pow(b.x - {_SIZE} * sqrt(3) * (b.q + b.r / 2), 2) + pow(b.y - {_SIZE} * 1.5 * b.r, 2)) AS dist FROM b)
SELECT id, CASE WHEN dist <= 400 THEN hex_id END AS hex_id, CASE WHEN dist <= 400 THEN round(dist, 4) END AS distance FROM c""")
def nearest_centre(d):
    """Origins to the hexagon centres next to them, at most 400 m away."""
    out = spatial.nearest_lattice_centre(d.origins.select("id", "x", "y"), SPACING, 400)
    return out.select("id", "hex_id", F.round("distance", 4).alias("distance"))


@query("c14_points_in_polygons", """
SELECT o.id, i.poly_id FROM v_origins o JOIN v_inside i ON o.x = i.x AND o.y = i.y""")
def points_in_polygons(d):
    return spatial.points_in_polygons(d.origins.select("id", "x", "y"), polygons(d).drop("category"), cell=1000).select("id", "poly_id")


@query("c15_nodes_outside_polygons", """
SELECT t.id, t.category FROM v_dests t
WHERE NOT EXISTS (SELECT 1 FROM v_inside i WHERE i.x = t.x AND i.y = t.y AND i.category = t.category)""")
def nodes_outside_polygons(d):
    nodes = d.dests.select("id", "category", "x", "y")
    return spatial.points_in_polygons(nodes, polygons(d), cell=1000, on=["category"], how="left_anti").select("id", "category")


@query("c16_numeric_text_lookup", """
SELECT c_custkey AS id, s_name AS supplier FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 150""")
def numeric_text_lookup(d):
    left = d.table("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 150).cast("double").alias("raw"))
    right = d.table("supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".0")).alias("raw"), F.col("s_name").alias("supplier"))
    a = left.withColumn("key", numeric_text_key(F.col("raw"))).drop("raw")
    return a.join(right.withColumn("key", numeric_text_key(F.col("raw"))).drop("raw"), "key", "left").select("id", "supplier")


# Street edges: around each part, a short piece with a bearing from its key. Segments: supplier to a point 600 m on.
SQL_VIEWS["v_street"] = """SELECT p_partkey AS way_id, (p_partkey * 7919 % 1000) * 30.0 AS ex1, (p_partkey * 104729 % 1000) * 30.0 AS ey1,
    (p_partkey * 7919 % 1000) * 30.0 + 10 + p_partkey % 60 AS ex2, (p_partkey * 104729 % 1000) * 30.0 + p_partkey % 37 AS ey2 FROM part"""
SQL_VIEWS["v_segments"] = """SELECT s_suppkey AS seg_id, (s_suppkey * 7919 % 1000) * 30.0 AS x1, (s_suppkey * 104729 % 1000) * 30.0 AS y1,
    (s_suppkey * 7919 % 1000) * 30.0 + 2500 - s_suppkey % 7 * 600 AS x2, (s_suppkey * 104729 % 1000) * 30.0 + 1300 - s_suppkey % 5 * 500 AS y2, 0.5 + s_suppkey % 50 / 100.0 AS factor FROM supplier"""
SQL_VIEWS["v_matches"] = """
    SELECT seg_id, way_id, factor, sqrt(pow(ex2 - ex1, 2) + pow(ey2 - ey1, 2)) AS len FROM (
      SELECT *, (ex1 + ex2) / 2 AS mx, (ey1 + ey2) / 2 AS my, degrees(atan2(x2 - x1, y2 - y1)) AS sb, degrees(atan2(ex2 - ex1, ey2 - ey1)) AS eb,
             greatest(0.0, least(1.0, (((ex1 + ex2) / 2 - x1) * (x2 - x1) + ((ey1 + ey2) / 2 - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t
      FROM v_segments CROSS JOIN v_street)
    WHERE sqrt(pow(mx - (x1 + t * (x2 - x1)), 2) + pow(my - (y1 + t * (y2 - y1)), 2)) <= 120
      AND least(abs((sb + 360) % 180 - (eb + 360) % 180), 180 - abs((sb + 360) % 180 - (eb + 360) % 180)) <= 25"""


def streets(d):
    k = F.col("p_partkey")
    x, y = (k * 7919 % 1000 * 30).cast("double"), (k * 104729 % 1000 * 30).cast("double")
    return d.table("part").select(k.alias("way_id"), x.alias("ex1"), y.alias("ey1"), (x + 10 + k % 60).alias("ex2"), (y + k % 37).alias("ey2"))


def segments(d):
    k = F.col("s_suppkey")
    x, y = (k * 7919 % 1000 * 30).cast("double"), (k * 104729 % 1000 * 30).cast("double")
    return d.table("supplier").select(k.alias("seg_id"), x.alias("x1"), y.alias("y1"), (x + 2500 - k % 7 * 600).alias("x2"),
                                      (y + 1300 - k % 5 * 500).alias("y2"), (0.5 + k % 50 / 100.0).alias("factor"))


MATCH = {"corridor": 120, "max_angle": 25}


def matches(d):
    return spatial.match_segments(segments(d), streets(d), **MATCH)


@query("c17_match_segments", "SELECT seg_id, way_id FROM v_matches")
def match_segments(d):
    return matches(d).select("seg_id", "way_id")


@query("h08_haversine", """
SELECT id, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(51.7 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(51.7)) * pow(sin(radians(19.4 - lon) / 2), 2))), 3) AS metres FROM v_origins""")
def haversine(d):
    return d.origins.select("id", F.round(geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(19.4), F.lit(51.7)), 3).alias("metres"))


def _tm_sql() -> str:
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    n = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    ep = e2 / (1 - e2)
    mu = f"((500000.0 + y + 5300000.0) / 0.9993 / {a * (1 - e2 / 4 - 3 * e2**2 / 64)!r})"
    return f"""
WITH m AS (SELECT id, 400000.0 + x AS px, {mu} AS mu FROM v_origins),
p AS (SELECT id, px, mu + {3 * n / 2 - 27 * n**3 / 32!r} * sin(2 * mu) + {21 * n**2 / 16!r} * sin(4 * mu) + {151 * n**3 / 96!r} * sin(6 * mu) AS phi FROM m),
q AS (SELECT id, px, phi, {ep!r} * pow(cos(phi), 2) AS c, pow(tan(phi), 2) AS t, {a!r} / sqrt(1 - {e2!r} * pow(sin(phi), 2)) AS nn,
             {a * (1 - e2)!r} / pow(1 - {e2!r} * pow(sin(phi), 2), 1.5) AS rr FROM p),
w AS (SELECT *, (px - 500000.0) / (nn * 0.9993) AS dd FROM q)
SELECT id, round(19.0 + degrees((dd - (1 + 2 * t + c) * pow(dd, 3) / 6) / cos(phi)), 7) AS lon,
       round(degrees(phi - nn * tan(phi) / rr * (dd * dd / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {ep!r}) * pow(dd, 4) / 24)), 7) AS lat FROM w"""


@query("h09_grid_to_lonlat", _tm_sql())
def grid_to_lonlat(d):
    lon, lat = geo.transverse_mercator_to_lonlat(400000.0 + F.col("x"), 500000.0 + F.col("y"))
    return d.origins.select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("h10_utm_zone", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 181 - 90 >= 0 THEN 32600 ELSE 32700 END + least(60, greatest(1, (c_custkey * 7 % 361) // 6 + 1)) AS epsg FROM customer""")
def utm_zone(d):
    k = F.col("c_custkey")
    return d.table("customer").select(k.alias("id"), geo.utm_epsg((k * 7 % 361 - 180).cast("double"), k % 181 - 90).cast("bigint").alias("epsg"))


@query("h14_bearing_midpoint", """
SELECT seg_id, round((degrees(atan2(x2 - x1, y2 - y1)) + 360) % 180, 6) AS bearing, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM v_segments""")
def bearing_midpoint(d):
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return segments(d).select("seg_id", F.round(geo.bearing180(x1, y1, x2, y2), 6).alias("bearing"),
                              ((x1 + x2) / 2).alias("mx"), ((y1 + y2) / 2).alias("my"))
