"""Inputs that earlier versions got wrong or cut off."""

import pytest
from pyspark.sql import functions as F

from reachgrid.functions.values import id_key
from reachgrid.operators import access, census, compare, cubes, feeds, lines, prices, stats

WEEK = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
CALENDAR = "row_no int, feed string, service_id string, " + ", ".join(f"{d} int" for d in WEEK) + ", start_date string, end_date string"
DATES = "row_no int, feed string, service_id string, date string, exception_type int"


def calendar(spark, *rows):
    return spark.createDataFrame([(i, f, s, *[1] * 7, a, b) for i, (f, s, a, b) in enumerate(rows)], CALENDAR)


def test_service_days_beyond_400_days(spark):
    cal, exc = calendar(spark, ("f", "s", "20260101", "20271231")), spark.createDataFrame([], DATES)
    trips = spark.createDataFrame([("f", "s", 1)], "feed string, service_id string, trip_id int")
    days = feeds.service_days(cal, exc, trips)
    assert days.where("trips = 1").count() == 730
    assert feeds.service_days(cal, exc, trips, cap_days=400).count() == 400
    assert [(r.code, r.n) for r in feeds.cut_days(cal, exc, 400).collect()] == [("SPAN_CUT", 330)]


def test_a_repeated_service_counts_once(spark):
    cal = calendar(spark, ("f", "s", "20260101", "20260131"), ("f", "s", "20260105", "20260110"))
    trips = spark.createDataFrame([("f", "s", 1)], "feed string, service_id string, trip_id int")
    days = feeds.service_days(cal, spark.createDataFrame([], DATES), trips)
    assert [r.trips for r in days.collect()] == [1] * 6


def test_large_ids_held_as_double(spark):
    a = spark.createDataFrame([(12345678.0, 1.0), (7.0, 2.0), (0.5, 3.0)], "id double, value double")
    b = spark.createDataFrame([("12345678", 1.0), ("7", 2.5), ("0.5", 3.0), ("1E5", 9.0)], "id string, value double")
    got = {r.id: r.status for r in compare.compare_tables(a, b).collect()}
    assert got == {"12345678": "same", "7": "better", "0.5": "same", "1E5": "only_b"}
    assert spark.range(1).select(id_key(F.lit(3_000_000_000).cast("bigint")).alias("k")).first().k == "3000000000"


def test_equal_trip_ids_in_two_feeds(spark):
    pairs = spark.createDataFrame([(f, 1, s, 30000 + s, shift) for f, shift in (("a", 100), ("b", -100)) for s in range(3)], "feed string, trip_id int, seq int, arr int, shift int")
    trips = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "feed string, trip_id int, route_id int")
    routes = spark.createDataFrame([("a", 5, "0"), ("b", 5, "3")], "feed string, route_id int, route_type string")
    got = {(r.window, r.traction): (r.trips, r.late, r.early) for r in feeds.trip_shifts(pairs, trips, routes).collect()}
    assert got["day", "tram"] == (1, 1, 0) and got["day", "bus"] == (1, 0, 1)


def test_trips_without_arrivals_count(spark):
    calls = spark.createDataFrame([("f", 1, 0, 10), ("f", 1, 1, 5), ("f", 2, 0, None)], "feed string, trip_id int, seq int, arr int")
    assert [(r.bad, r.trips) for r in feeds.decreasing_trips(calls).collect()] == [(1, 2)]


def test_combined_noise_source_starts_at_the_highest_of_the_lowest_levels(spark):
    cells = spark.createDataFrame([(1, 50, 0), (1, 0, 60), (1, 57, 0)], "hex_id int, tram int, rail int")
    out = prices.noise_shares(cells, {"tram": F.col("tram"), "rail": F.col("rail")}, [55, 60], cells.select("hex_id").limit(0),
                              {"tram": 50, "rail": 60}, {"both": ("tram", "rail")})
    got = {(r.source, r.threshold): r.share for r in out.collect()}
    assert got["both", 55] is None and got["both", 60] == pytest.approx(0.3333) and got["tram", 55] == pytest.approx(0.3333)


def test_header_below_row_30(spark):
    rows = [("S", i, ["x"]) for i in range(40)] + [("S", 40, ["Symbol", "Struktura", "ludność"]), ("S", 41, ["1", "obwód spisowy", "5"]), ("T", 0, ["none"])]
    sheet = spark.createDataFrame(rows, "sheet string, row_no int, cells array<string>")
    header = census.find_header(sheet, "ludność")
    assert header.first().header_row == 40 and census.sheet_records(sheet, header).count() == 1
    assert [r.sheet for r in census.sheets_without_header(sheet, header).collect()] == ["T"]


def test_counts_above_255_are_kept(spark):
    matrix = spark.range(400).select(F.lit(1).alias("from_id"), F.col("id").alias("to_id"), F.lit(10).alias("minutes"))
    types = spark.range(400).select(F.col("id").alias("to_id"), F.lit("shop").alias("type"))
    cells = spark.createDataFrame([(1,)], "id int")
    assert cubes.facility_counts(matrix, types, cells, ["shop"], [15]).first().n == 400
    assert cubes.facility_counts(matrix, types, cells, ["shop"], [15], clip=255).first().n == 255


def test_ring_means_that_are_no_number(spark):
    rows = [(float(i), 30, m) for i, m in enumerate((5.0, float("nan"), 1.0, 4.0, 6.0))]
    row = stats.ring_verdict(spark.createDataFrame(rows, "bin_lo double, cells int, mean double")).first()
    assert (row.worst_ring_km, row.worst_mean, row.median_other, row.dip) == (2.0, 1.0, 5.0, True)


def test_small_operators(spark):
    matrix = spark.createDataFrame([(1, 5, 10), (1, 5, 12), (1, 6, None), (2, 6, None)], "from_id int, to_id int, minutes int")
    cells = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert {r.id: r.reachable for r in access.reachable_destinations(matrix, cells).collect()} == {1: 1, 2: 0, 3: 0}
    means = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 0.0), ("b", 2, 1.0)], "city string, decile int, mean double")
    assert sorted((r.city, r.decile, r.relative) for r in stats.relative_to_first(means, ["city"], "decile", "mean").collect()) == [
        ("a", 1, 1.0), ("a", 2, 1.5), ("b", 1, None), ("b", 2, None)]
    trips = spark.createDataFrame([(i, i % 3) for i in range(9)], "trip_id int, route_id int")
    routes = spark.createDataFrame([(0, "0"), (1, "3"), (2, "0")], "route_id int, route_type string")
    calls = spark.createDataFrame([(i, s) for i in range(9) for s in range(1 if i % 3 == 2 else 2)], "trip_id int, seq int")
    assert [(r.route_id, r.trips) for r in lines.eligible_lines(trips, routes, calls, ["0"], 3).collect()] == [(0, 3)]
    assert lines.eligible_lines(trips, routes, calls, ["0"], 4).count() == 0
