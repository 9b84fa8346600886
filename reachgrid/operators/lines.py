"""Line metrics from timetables: length, speed, frequency, people nearby, slowdown of street ways."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachgrid.functions.geo import flat_distance, haversine_m
from reachgrid.functions.scale import group_quantiles, linear, quartile_exclusive
from reachgrid.operators.sets import mostly_contained
from reachgrid.operators.spatial import match_segments, pairs_within
from reachgrid.session import checkpoint

PEAK = (7 * 3600, 9 * 3600)
WALK_M, INNER_M, OUTER_M = 500, 2500, 4000
MIN_SEGMENTS = 20


def weighted_centroid(points: DataFrame, weight: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """One row with the weighted mean of the coordinates."""
    w = F.sum(weight)
    return points.agg((F.sum(F.col(weight) * F.col(x)) / w).alias(x), (F.sum(F.col(weight) * F.col(y)) / w).alias(y))


def speed_profile(segs: DataFrame, trips: DataFrame, centre: tuple[Column, Column]) -> DataFrame:
    """Median segment speed and stop spacing inside and outside the centre, per route.

    Speeds need at least 20 segments on their side; spacing splits at the inner radius.
    """
    away = haversine_m(F.col("mid_lon"), F.col("mid_lat"), *centre)
    s = segs.join(trips.select("trip_id", "route_id"), "trip_id").select(
        "route_id", "metres", (F.col("metres") / F.col("seconds") * 3.6).alias("kmh"), away.alias("away"))
    sides = F.filter(F.array(F.when(F.col("away") <= INNER_M, "inner"), F.when(F.col("away") > OUTER_M, "outer")),
                     lambda v: v.isNotNull())
    speed = group_quantiles(s.select("route_id", "kmh", F.explode(sides).alias("side")), ["route_id", "side"], "kmh",
                            {"kmh": linear(0.5)})
    near = s.withColumn("near", F.when(F.col("away") <= INNER_M, "inner").otherwise("outer"))
    spacing = group_quantiles(near, ["route_id", "near"], "metres", {"metres": linear(0.5)})
    def pick(side: str, column: str, key: str, guard: int = 1) -> Column:
        return F.max(F.when((F.col(key) == side) & (F.col("n") >= guard), F.col(column)))
    a = speed.groupBy("route_id").agg(pick("inner", "kmh", "side", MIN_SEGMENTS).alias("inner_kmh"),
                                      pick("outer", "kmh", "side", MIN_SEGMENTS).alias("outer_kmh"))
    b = spacing.groupBy("route_id").agg(pick("inner", "metres", "near").alias("inner_spacing_m"),
                                        pick("outer", "metres", "near").alias("outer_spacing_m"))
    return trips.select("route_id").distinct().join(a, "route_id", "left").join(b, "route_id", "left")


def route_stops(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    return stop_times.join(trips.select("trip_id", "route_id"), "trip_id").select("route_id", "stop_id").distinct()


def exclusive_stops(served: DataFrame) -> DataFrame:
    """(route_id, stop_id) of stops only one route serves."""
    lone = served.groupBy("stop_id").agg(F.count("*").alias("n")).where("n = 1")
    return served.join(lone, "stop_id", "left_semi")


def population_near(served: DataFrame, stops: DataFrame, people: DataFrame, radius: float = WALK_M) -> DataFrame:
    """(route_id, pop): residents within ``radius`` of any of the route's stops, each counted once."""
    spots = people.groupBy("x", "y").agg(F.sum("pop").alias("pop"))
    places = served.join(stops.select("stop_id", F.col("x").alias("px"), F.col("y").alias("py")), "stop_id")
    places = places.select("route_id", "px", "py").distinct()
    near = pairs_within(spots, places, radius).select("route_id", "x", "y", "pop").distinct()
    return near.groupBy("route_id").agg(F.sum("pop").alias("pop"))


def eligible_lines(trips: DataFrame, routes: DataFrame, stop_times: DataFrame, kinds: Sequence[str], min_trips: int) -> DataFrame:
    """(route_id, trips): lines of the wanted route types with at least ``min_trips`` trips and a trip of more than one stop.

    Only these are ranked; others would shift the length quartile and every rank.
    """
    wanted = trips.join(routes.where(F.col("route_type").cast("string").isin(*kinds)).select("route_id").distinct(), "route_id", "left_semi")
    stops = stop_times.groupBy("trip_id").agg(F.count("*").alias("stops"))
    per = wanted.join(stops, "trip_id", "left").groupBy("route_id").agg(F.count("*").alias("trips"), F.max("stops").alias("stops"))
    return per.where((F.col("trips") >= min_trips) & (F.col("stops") > 1)).select("route_id", "trips")


def rank_lines(lines: DataFrame) -> DataFrame:
    """Length gate at the upper quartile (exclusive method), ranks and the composite score.

    One row per line: a line table is a report of at most some thousands of rows, so the
    rank windows here are over that report, not over timetable rows.
    """
    cut = group_quantiles(lines.withColumn("all", F.lit(0)), ["all"], "length_km", {"p75": quartile_exclusive(3)})
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "route_id"))
    slow = Window.partitionBy(F.col("slowdown").isNull()).orderBy(F.desc("slowdown"), "route_id")
    out = lines.withColumn("p75", cut.select("p75").scalar()).select(
        "*", (F.col("length_km") >= F.col("p75")).cast("int").alias("meets_length"),
        rank("pop").alias("rank_pop"), rank("vehicle_km").alias("rank_vehicle_km"),
        F.when(F.col("slowdown").isNotNull(), F.row_number().over(slow)).alias("rank_slowdown"))
    return out.withColumn("score", F.round((F.col("rank_pop") + F.col("rank_vehicle_km")) / 2, 1))


def corridor(picks: DataFrame, served: DataFrame, share: float = 0.6) -> DataFrame:
    """(pick, route_id, share): other routes serving at least ``share`` of a picked route's stops."""
    return mostly_contained(picks, served, "route_id", "stop_id", share)


def _near_spots(cells: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """(x, y, px, py, distance to three decimals) of distinct locations at most ``radius`` apart, however many rows stand on one."""
    near = pairs_within(cells.select("x", "y").distinct(), places.select("px", "py").distinct(), radius + 0.001)
    return near.withColumn("distance", F.round("distance", 3)).where(F.col("distance") <= radius)


def line_frequency(cells: DataFrame, stops: DataFrame, departures: DataFrame, windows: Mapping[str, tuple[int, int]],
                   radius: float) -> DataFrame:
    """(hex_id, mode, departures per hour in each window): a line and direction counts once, at its nearest stop.

    cells: (hex_id, x, y). stops: (stop_id, mode, px, py). departures: (stop_id, route_id, direction_id, minute).
    A line's nearest stop is the same for all cells of one location, and of its stops at one location only that
    of the smallest id can be it, so locations are paired, not cells and stops.
    """
    line = ["route_id", "direction_id"]
    counts = checkpoint(departures.groupBy("stop_id", *line).agg(*[  # asked for twice
        (F.count_if((F.col("minute") >= a) & (F.col("minute") < b)) / ((b - a) / 60)).alias(f"freq_{w}")
        for w, (a, b) in windows.items()]))
    here = counts.join(stops.select("stop_id", "px", "py"), "stop_id").groupBy("px", "py", *line).agg(F.min("stop_id").alias("stop_id"))
    near = _near_spots(cells, here, radius).join(here, ["px", "py"])
    best = near.groupBy("x", "y", *line).agg(F.min(F.struct("distance", "stop_id")).alias("b"))
    best = best.select("x", "y", *line, F.col("b.stop_id").alias("stop_id"))
    total = best.join(counts, ["stop_id", *line]).join(stops.select("stop_id", "mode"), "stop_id").groupBy("x", "y", "mode").agg(
        *[F.sum(f"freq_{w}").alias(f"freq_{w}") for w in windows])
    modes = stops.select("mode").distinct()
    frame = cells.select("hex_id", "x", "y", F.explode(modes.agg(F.collect_set("mode").alias("m")).scalar()).alias("mode"))
    out = frame.join(total, ["x", "y", "mode"], "left")
    return out.select("hex_id", "mode", *[F.round(F.coalesce(f"freq_{w}", F.lit(0.0)), 2).alias(f"freq_{w}") for w in windows])


def nearest_per_mode(cells: DataFrame, stops: DataFrame, modes: list[str], cap: float,
                     inside: DataFrame | None = None) -> DataFrame:
    """Distance to the nearest stop of each mode, NULL beyond the cap; 0 for cells ``inside`` an area.

    cells: (hex_id, x, y). stops: (mode, px, py). Locations are paired, not cells and stops.
    """
    near = _near_spots(cells, stops, cap).join(stops.select("px", "py", "mode").distinct(), ["px", "py"])
    best = near.groupBy("x", "y").agg(
        *[F.min(F.when(F.col("mode") == m, F.col("distance"))).alias(f"d_{m}_m") for m in modes])
    out = cells.select("hex_id", "x", "y").join(best, ["x", "y"], "left").drop("x", "y")
    if inside is None:
        return out
    out = out.join(inside.select("hex_id").distinct().withColumn("_in", F.lit(True)), "hex_id", "left")
    return out.select("hex_id", *[F.when(F.col("_in"), 0.0).otherwise(F.col(f"d_{m}_m")).alias(f"d_{m}_m") for m in modes])


def coverage_class(near: Column, realtime: Column) -> Column:
    """Realtime coverage of the stops in walking range."""
    return F.when(realtime == 0, "none").when(realtime == near, "full").otherwise("partial")


# --- slowdown of street ways from bus observations -------------------------------

def segment_factors(obs: DataFrame, windows: Mapping[str, tuple[int, int]], *, free_flow: float = 0.15,
                    min_obs: int = 5, low: float = 0.3, high: float = 1.0) -> DataFrame:
    """(seg, window, n, factor): free-flow time over the window's median time, clipped."""
    ref = group_quantiles(obs, ["seg"], "secs", {"ref": linear(free_flow)}, count="all")
    hits = F.filter(F.array(*[F.when((F.col("minute") >= a) & (F.col("minute") < b), w) for w, (a, b) in windows.items()]),
                    lambda w: w.isNotNull())
    timed = obs.select("seg", "secs", F.explode(hits).alias("window"))
    med = group_quantiles(timed, ["seg", "window"], "secs", {"median": linear(0.5)}).where(F.col("n") >= min_obs)
    factor = F.least(F.greatest(F.col("ref") / F.col("median"), F.lit(low)), F.lit(high))
    return med.join(ref.select("seg", "ref"), "seg").select("seg", "window", "n", factor.alias("factor"))


def way_factors(segments: DataFrame, edges: DataFrame, *, corridor: float, max_angle: float) -> DataFrame:
    """Length-weighted mean factor of the matched segments per way.

    segments: (x1, y1, x2, y2, factor). edges: (way_id, ex1, ey1, ex2, ey2). Equal segments are matched to equal edges
    once, however many there are of each; a match is that of :func:`match_segments`.
    """
    ends = ["ex1", "ey1", "ex2", "ey2"]
    drawn = segments.groupBy("x1", "y1", "x2", "y2").agg(F.sum("factor").alias("_f"), F.count("*").alias("_n"))
    found = match_segments(drawn, edges.select(*ends).distinct(), corridor=corridor, max_angle=max_angle)
    sums = found.groupBy(*ends).agg(F.sum("_f").alias("_f"), F.sum("_n").alias("_n"))
    # Ways are far larger in memory than as a file, by which Spark would broadcast them.
    length = flat_distance(F.col("ex1"), F.col("ey1"), F.col("ex2"), F.col("ey2"))
    held = edges.hint("merge").join(sums, ends).withColumn("_length", length)
    return held.groupBy("way_id").agg((F.sum(F.col("_f") * F.col("_length")) / F.sum(F.col("_n") * F.col("_length"))).alias("factor"))


def fill_ways(ways: DataFrame, direct: DataFrame, radius: float) -> DataFrame:
    """(way_id, factor, source) for every way: own factor, else the median of same-group ways
    within ``radius``, else the group's median, else 1.

    ways: way_id, grp, x, y. The median is the same for all ways of a group at one location, so locations are paired,
    not ways, and equal factors at one location are counted first.
    """
    own = ways.hint("merge").join(direct.withColumn("_has", F.lit(True)), "way_id", "left")
    own = checkpoint(own.select("way_id", "grp", "x", "y", "factor", "_has"))  # asked for three times
    have = own.where("_has").groupBy("grp", F.col("x").alias("px"), F.col("y").alias("py"), "factor").agg(F.count("*").alias("k"))
    spots = own.where("_has is null").select("grp", "x", "y").distinct()
    near = pairs_within(spots, have.select("grp", "px", "py").distinct(), radius, on=["grp"]).join(have, ["grp", "px", "py"])
    local = group_quantiles(near, ["grp", "x", "y"], "factor", {"local": linear(0.5)}, weight="k")
    whole = group_quantiles(have, ["grp"], "factor", {"whole": linear(0.5)}, count="m", weight="k")
    local = local.select("grp", "x", "y", F.col("local").alias("_local"))
    out = own.join(local, ["grp", "x", "y"], "left").join(whole, "grp", "left").withColumn("local", F.when(F.col("_has").isNull(), F.col("_local")))
    source = F.when(F.col("factor").isNotNull(), "direct").when(F.col("local").isNotNull(), "radius").otherwise("class")
    return out.select("way_id", F.coalesce("factor", "local", "whole", F.lit(1.0)).alias("factor"), source.alias("source"))
