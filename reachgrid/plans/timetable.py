"""Walking, scenario, isochrone and case sweep queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reachgrid.operators import cases, scenario, timetable
from reachgrid.plans.feeds import line_times, line_trips
from reachgrid.plans.registry import query
from reachgrid.plans.views import CASES, SQL_VIEWS
from reachgrid.session import checkpoint_folder

_DIST = "sqrt(pow({a}.x - {b}.x, 2) + pow({a}.y - {b}.y, 2))"


@query("k02_walk_matrix", f"""
SELECT p.id AS from_id, t.id AS to_id, ceil({_DIST.format(a='p', b='t')} / 1.0 / 60)::BIGINT AS minutes FROM v_origins p JOIN v_dests t ON {_DIST.format(a='p', b='t')} <= 1800""")
def walk_matrix(d):
    out = timetable.walk_matrix(d.origins, d.dests, 1.0, 30)
    return out.withColumn("minutes", F.col("minutes").cast("bigint"))


# --- scenario ----------------------------------------------------------------------------------

SQL_VIEWS["v_hop_times"] = """
    SELECT trip_id, seq, stop_id, sum(hop + 20) OVER (PARTITION BY trip_id ORDER BY seq) - 20 AS arr FROM (
      SELECT trip_id, seq, stop_id, coalesce(round((arr - lag(dep) OVER w) / 0.8)::BIGINT, arr) AS hop FROM v_line_times JOIN v_trips USING (trip_id) WHERE route_id < 10 WINDOW w AS (PARTITION BY trip_id ORDER BY seq))"""


@query("k03_scale_speed", """
SELECT trip_id, seq, stop_id, arr::BIGINT AS arr, (arr + 20)::BIGINT AS dep FROM v_hop_times
UNION ALL SELECT trip_id, seq, stop_id, arr, dep FROM v_line_times JOIN v_trips USING (trip_id) WHERE route_id >= 10""")
def scale_speed(d):
    slow = line_trips(d).where("route_id < 10").select("route_id").distinct()
    return scenario.scale_speed(line_times(d), line_trips(d), slow, 0.8)


@query("k03_remove_routes", "SELECT route_id, count(*) AS trips FROM v_trips WHERE route_id % 3 <> 0 GROUP BY route_id")
def remove_routes(d):
    gone = line_trips(d).where("route_id % 3 = 0").select("route_id").distinct()
    return scenario.remove_routes(line_trips(d), gone).groupBy("route_id").agg(F.count("*").alias("trips"))


# Routes of this query serve stops by position only, so trips with equally many stops share a pattern.
_HEAD = """
st AS (SELECT trip_id, seq, seq AS stop_id, arr, arr + 20 AS dep FROM v_stop_times),
p AS (SELECT trip_id, count(*) AS n, arg_min(dep, seq) AS start FROM st GROUP BY trip_id),
m AS (SELECT t.route_id, t.direction_id, t.trip_id, p.n, p.start FROM v_trips t JOIN p USING (trip_id)),
sz AS (SELECT route_id, direction_id, n, count(*) AS k, min(start * 10000000 + trip_id) AS f FROM m GROUP BY ALL)"""


@query("k03_set_headway", f"""
WITH {_HEAD.strip()},
kept AS (SELECT t.route_id, t.trip_id FROM v_trips t LEFT JOIN m USING (trip_id) WHERE m.trip_id IS NULL OR NOT (m.start >= 25200 AND m.start < 32400)),
lines AS (SELECT route_id, direction_id, max(k) AS top FROM sz GROUP BY ALL)
SELECT route_id, sum(n)::BIGINT AS trips FROM (SELECT route_id, 1 AS n FROM kept UNION ALL SELECT route_id, 12 FROM lines) GROUP BY route_id""")
def set_headway(d):
    """Ten-minute headway from 07:00 to 09:00 on every route: trips per route afterwards."""
    by_position = line_times(d).withColumn("stop_id", F.col("seq"))
    routes = line_trips(d).select("route_id").distinct()
    trips, _ = scenario.set_headway(by_position, line_trips(d), routes, 600, "07:00", "09:00")
    return trips.groupBy("route_id").agg(F.count("*").alias("trips"))


_HAV = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))"


@query("k03_add_lines", f"""
WITH l AS (SELECT s_suppkey AS line_id, s_nationkey, lon AS lon1, lat AS lat1, lon + 0.01 AS lon2, lat + 0.005 AS lat2 FROM supplier JOIN v_dests ON id = s_suppkey),
h AS (SELECT *, greatest(1, round_even({_HAV} / (25.0 / 3.6), 0))::BIGINT AS hop FROM l),
r AS (SELECT h.*, unnest(range(21600, 25200, 900)) AS t FROM h)
SELECT line_id, dir AS direction_id, seq, line_id || '#' || CASE WHEN dir = 0 THEN seq - 1 ELSE 2 - seq END AS stop_id, count(*) AS runs, min(t + (seq - 1) * (hop + 30))::BIGINT AS first_arr, max(t + (seq - 1) * (hop + 30) + 30)::BIGINT AS last_dep
FROM r CROSS JOIN (VALUES (0), (1)) dd(dir) CROSS JOIN (VALUES (1), (2)) ss(seq) GROUP BY ALL""")
def add_lines(d):
    """A two-stop line from every facility, a repeated vertex merged, every 15 minutes for an hour."""
    def at(dx, dy):
        return F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
    lines = d.dests.select(F.col("id").alias("line_id"), F.array(at(0.0, 0.0), at(0.0, 0.0), at(0.01, 0.005)).alias("vertices"),
                           F.lit(25.0).alias("speed_kmh"), F.lit(30).alias("dwell"), F.lit(900).alias("headway"),
                           F.lit(21600).alias("start"), F.lit(25200).alias("end"))
    _, calls = scenario.add_lines(lines)
    return calls.groupBy("line_id", "direction_id", "seq", "stop_id").agg(
        F.count("*").alias("runs"), F.min("arr").cast("bigint").alias("first_arr"), F.max("dep").cast("bigint").alias("last_dep"))


@query("a13_a14_scenario_modifications", """
WITH f AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'easy-remove-routes' WHEN 1 THEN 'easy-adjust-speed' WHEN 2 THEN 'teleport' END AS type,
  '{"id": "' || s_name || '", "modifications": [' || CASE s_suppkey % 4 WHEN 0 THEN '{"type": "easy-remove-routes", "routes": ["' || s_nationkey || '"]}' WHEN 1 THEN '{"type": "easy-adjust-speed", "scale": 0.8}' WHEN 2 THEN '{"type": "teleport"}' ELSE '' END || ']}' AS body FROM supplier)
SELECT s_suppkey || '.json:' || substr(sha256(body), 1, 8) AS label, type, CASE WHEN type IS NULL THEN 'no modifications' WHEN type = 'teleport' THEN 'unknown type' END AS problem FROM f""")
def scenario_modifications(d):
    k = F.col("s_suppkey")
    part = (F.when(k % 4 == 0, F.concat(F.lit('{"type": "easy-remove-routes", "routes": ["'), F.col("s_nationkey").cast("string"), F.lit('"]}')))
            .when(k % 4 == 1, '{"type": "easy-adjust-speed", "scale": 0.8}').when(k % 4 == 2, '{"type": "teleport"}').otherwise(""))
    body = F.concat(F.lit('{"id": "'), "s_name", F.lit('", "modifications": ['), part, F.lit("]}"))
    files = d.table("supplier").select(F.concat(k.cast("string"), F.lit(".json")).alias("file"), body.alias("body"))
    files = files.withColumn("label", scenario.run_label(F.col("file"), F.col("body").cast("binary")))
    return scenario.modifications(files).select("label", "type", "problem")


# --- isochrones, sweeps ---------------------------------------------------------------

@query("k05_isochrones", f"""
WITH b AS (SELECT floor((min(x) - 9000) / 500)::BIGINT AS i0, floor((min(y) - 9000) / 500)::BIGINT AS j0, ceil((max(x) + 9000) / 500)::BIGINT AS i1, ceil((max(y) + 9000) / 500)::BIGINT AS j1 FROM v_origins),
c AS (SELECT i * 500 AS x, j * 500 AS y FROM b, LATERAL (SELECT unnest(range(i0, i1 + 1)) AS i), LATERAL (SELECT unnest(range(j0, j1 + 1)) AS j)),
t AS (SELECT p.id AS from_id, ceil({_DIST.format(a='p', b='c')} / 2.0 / 60) AS minutes FROM v_origins p JOIN c ON abs(p.x - c.x) <= 1200 AND abs(p.y - c.y) <= 1200 AND {_DIST.format(a='p', b='c')} <= 1200)
SELECT from_id, cutoff::BIGINT AS cutoff, count(*) AS cells, count(*) * 250000.0::DOUBLE AS area FROM t JOIN (VALUES (3), (6), (10)) k(cutoff) ON minutes <= cutoff GROUP BY ALL""")
def isochrones(d):
    """Walking isochrones of every origin on a 500 m grid."""
    cells = timetable.isochrone_cells(d.origins, 500.0, [3, 6, 10])
    minutes = timetable.walk_matrix(d.origins, cells.withColumnRenamed("cell", "id"), 2.0, 10)
    out = timetable.isochrones(minutes, [3, 6, 10], 500.0 * 500.0)
    return out.withColumn("cutoff", F.col("cutoff").cast("bigint"))


@query("k07_case_sweep", "SELECT case_id, opportunity, cutoff, sum(acc)::BIGINT AS reached, count(*) AS cells FROM v_acc GROUP BY ALL")
def case_sweep(d):
    """A sweep broken off after two cases and taken up again: the second run computes the missing ones only."""
    folder = f"{checkpoint_folder(d.spark)}/sweep-{uuid.uuid4().hex}"

    def compute(cases):
        return (d.acc.where(F.col("case_id").isin(cases)).groupBy("case_id", "opportunity", "cutoff")
                .agg(F.sum("acc").alias("reached"), F.count("*").alias("cells")))
    timetable.run_cases(d.spark, CASES[:2], compute, folder, "case_id")
    timetable.run_cases(d.spark, CASES, compute, folder, "case_id")
    return d.spark.read.parquet(folder).select(F.col("case_id").cast("string").alias("case_id"), "opportunity", "cutoff", "reached", "cells")


@query("k07_changed_inputs", f"""
SELECT case_id, opportunity, cutoff, sum(acc + CASE WHEN case_id = '{CASES[1]}' THEN 1 ELSE 0 END)::BIGINT AS reached, CASE WHEN case_id = '{CASES[1]}' THEN 2 ELSE 1 END::BIGINT AS run FROM v_acc GROUP BY ALL""")
def changed_inputs(d):
    """A sweep, then the inputs of one case change: the second run computes that case only."""
    store = cases.CaseStore(d.spark, f"{checkpoint_folder(d.spark)}/store-{uuid.uuid4().hex}", "case_id")

    def sweep(inputs, run):
        def compute(names):
            rows = inputs.where(F.col("case_id").isin(names)).groupBy("case_id", "opportunity", "cutoff").agg(F.sum("acc").alias("reached"))
            return rows.withColumn("run", F.lit(run).cast("bigint"))
        return store.update(cases.prints(inputs, "case_id", CASES), compute, {"cutoffs": "all"})
    before = d.acc.select("case_id", "id", "opportunity", "cutoff", "acc")
    sweep(before, 1)
    sweep(before.withColumn("acc", F.col("acc") + F.when(F.col("case_id") == CASES[1], 1).otherwise(0)), 2)
    return store.read().select("case_id", "opportunity", "cutoff", F.col("reached").cast("bigint").alias("reached"), "run")
