"""Stop times in trip order: stored once, bucketed and sorted by trip, and read without another shuffle.

Nearly everything about a timetable goes along trips: hops, lengths, first departures, segments, shifts. A table
of calls stored by trip pays for the shuffle once; windows, sums and joins along trips then run inside a bucket.
A trip's calls stay together, which is bounded by what one vehicle can do in a run; feeds of any size only have
more trips.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachgrid.functions.geo import haversine_m
from reachgrid.session import checkpoint_folder


def store(stop_times: DataFrame, keys: Sequence[str] = ("trip_id",), *, stops: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """``stop_times`` written by ``keys`` in ``seq`` order and read back; ``stops`` (stop_id, lon, lat) adds the places.

    Stops that are not in ``stops`` have no place; a stop listed twice is an error of the feed and takes its smallest
    place. Buckets are as many as the session's shuffle partitions unless given. The files lie in the shared
    folder; no name stays behind in the catalog.
    """
    spark, keys = stop_times.sparkSession, list(keys)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if stops is not None:
        places = stops.groupBy("stop_id").agg(F.min(F.struct("lon", "lat")).alias("_p")).select("stop_id", "_p.lon", "_p.lat")
        stop_times = stop_times.drop("lon", "lat").join(places, "stop_id", "left")
    name = f"calls_{uuid.uuid4().hex}"
    # Dealt by the buckets' own hash, so that each task writes the one file of its bucket.
    writer = stop_times.repartition(n, *keys).write.format("parquet").option("path", f"{checkpoint_folder(spark)}/{name}")
    writer.bucketBy(n, *keys).sortBy(*keys, "seq").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the frame has read what it needs of the entry
    return table


def _along(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("seq")


def trip_facts(calls: DataFrame, keys: Sequence[str] = ("trip_id",)) -> DataFrame:
    """One row per trip: calls, metres between known stops in a row (unknown ones bridged, NULL without any) and first departure."""
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    here = F.when(placed, F.struct("lon", "lat"))
    # The last known place before a call; of a call without place nothing is asked.
    before = F.last(here, ignorenulls=True).over(_along(keys).rowsBetween(Window.unboundedPreceding, -1))
    rows = calls.select(*keys, "seq", "arr", "dep", "lon", "lat", before.alias("_b"))
    metres = F.when(placed & F.col("_b").isNotNull(), haversine_m(F.col("_b.lon"), F.col("_b.lat"), F.col("lon"), F.col("lat")))
    return rows.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(metres).alias("metres"),
                                   F.min_by(F.coalesce("dep", "arr"), "seq").alias("first"))


def line_metrics(facts: DataFrame, trips: DataFrame, window: tuple[int, int], keys: Sequence[str] = ("trip_id",)) -> DataFrame:
    """(route_id, length_km, vehicle_km, per_hour) from one pass over trips.

    The length is that of the trip with most calls, the smaller id on ties; departures count where the first
    one is in the half-open window. A route whose trips have no calls has no departures and no length.
    """
    joined = trips.select(*keys, "route_id").join(facts, list(keys), "left")
    longest = F.min(F.when(F.col("calls").isNotNull(), F.struct((-F.col("calls")).alias("k"), *keys, F.coalesce("metres", F.lit(0.0)).alias("m"))))
    inside = (F.col("first") >= window[0]) & (F.col("first") < window[1])
    hours = (window[1] - window[0]) / 3600
    out = joined.groupBy("route_id").agg(longest.alias("b"), F.sum("metres").alias("m"), F.count_if(inside).alias("n"))
    return out.select("route_id", (F.col("b.m") / 1000).alias("length_km"), (F.coalesce("m", F.lit(0.0)) / 1000).alias("vehicle_km"),
                      (F.col("n") / hours).alias("per_hour"))


def segments(calls: DataFrame, keys: Sequence[str] = ("trip_id",), *, peak: tuple[int, int] | None = None, min_metres: float = 50) -> DataFrame:
    """(keys, seq, metres, seconds, mid_lon, mid_lat) of hops from one call to the next, both at known stops.

    Seconds run from departure to arrival; hops without time or below ``min_metres`` are dropped. ``peak`` keeps
    trips whose first departure is inside the half-open window.
    """
    along = _along(keys)
    nxt = F.lead(F.struct("lon", "lat", "arr")).over(along).alias("_n")
    whole = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.struct(F.coalesce("dep", "arr").alias("t"))).over(whole)["t"].alias("_first")
    rows = calls.select(*keys, "seq", "dep", "lon", "lat", nxt, first).where("_n is not null")
    if peak is not None:
        rows = rows.where((F.col("_first") >= peak[0]) & (F.col("_first") < peak[1]))
    lon, lat = F.col("_n.lon"), F.col("_n.lat")
    out = rows.select(*keys, "seq", haversine_m(F.col("lon"), F.col("lat"), lon, lat).alias("metres"), (F.col("_n.arr") - F.col("dep")).alias("seconds"),
                      ((F.col("lon") + lon) / 2).alias("mid_lon"), ((F.col("lat") + lat) / 2).alias("mid_lat"))
    return out.where((F.col("seconds") > 0) & (F.col("metres") >= min_metres))


def decreasing(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bad): trips, and whether an arrival lies before the one before it; calls without arrival are passed over."""
    before = F.last("arr", ignorenulls=True).over(_along(keys).rowsBetween(Window.unboundedPreceding, -1))
    marked = calls.select(*keys, F.coalesce(F.col("arr") < before, F.lit(False)).alias("bad"))
    return marked.groupBy(*keys).agg(F.max("bad").alias("bad"))


def store_pair(static: DataFrame, realized: DataFrame, keys: Sequence[str], *, buckets: int | None = None) -> DataFrame:
    """Calls of both feeds (keys, seq, arr, real: whether from ``realized``) in one stored table, a trip's calls of both side by side."""
    def side(df: DataFrame, real: bool) -> DataFrame:
        return df.select(*keys, "seq", F.col("arr").cast("long").alias("arr"), F.lit(real).alias("real"))
    return store(side(static, False).unionByName(side(realized, True)), keys, buckets=buckets)


def shifts(pair: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seq, arr, shift): realized minus static seconds of common calls; every combination where a call is listed twice."""
    def times(real: bool):
        return F.collect_list(F.when(F.col("real") == real, F.struct(F.col("arr").alias("t"))))
    met = pair.groupBy(*keys, "seq").agg(times(False).alias("s"), times(True).alias("r")).where("size(s) > 0 and size(r) > 0")
    met = met.select(*keys, "seq", F.explode("s").alias("s"), "r").select(*keys, "seq", F.col("s.t").alias("arr"), F.explode("r").alias("r"))
    return met.select(*keys, "seq", "arr", (F.col("r.t") - F.col("arr")).alias("shift"))


def trip_shifts(pairs: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """(keys, stops, mean, first) of trips with ``least`` common calls or more, from :func:`shifts`."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("stops"), F.avg("shift").alias("mean"),
                                    F.min_by("arr", "seq").alias("first")).where(F.col("stops") >= least)

