"""Feed archives, points, matrices, exports, catalogue, logs: files in and out."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from reachgrid.operators import feeds, timetable
from reachgrid.sources import catalogue, tables
from reachgrid.sources import feeds as source


def write_zip(path, **files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(f"{name}.txt", text)


CALENDAR = "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
TRIPS = "route_id,service_id,trip_id\n"


@pytest.fixture()
def folder(tmp_path):
    write_zip(tmp_path / "one.zip",
              calendar="﻿" + CALENDAR + '"A,1",1,1,1,1,1,0,0,20260105,20260111\n',
              calendar_dates="date,exception_type,service_id\n20260106,2,\"A,1\"\n20260111,1,\"A,1\"\n20260110,3,\"A,1\"\n",
              trips="Trip_ID , service_id,route_id\nt1,\"A,1\",r1\nt2,\"A,1\",r1\n\n , , \n",
              stops="stop_id,stop_lat,stop_lon,location_type\ns1,51.7,19.4,0\ns2,0,0,0\ns3,,,3\ns4,x,19,\n",
              feed_info="feed_id\nmain\n")
    write_zip(tmp_path / "two.zip", calendar_dates="service_id,date,exception_type\nB,20260108,1\nB,bad,1\n", trips=TRIPS + "r9,B,t1\n", stops="")
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    return str(tmp_path)


def test_archives(spark, folder):
    rows = source.read_archives(spark, folder).cache()
    trips = source.feed_table(rows, "trips.txt", ["trip_id", "service_id", "route_id"])
    assert sorted((r.feed, r.trip_id, r.service_id) for r in trips.collect()) == [("one", "t1", "A,1"), ("one", "t2", "A,1"), ("two", "t1", "B")]
    assert source.feed_table(rows, "shapes.txt", ["shape_id"]).count() == 0
    assert [r.feed for r in source.unreadable(rows).collect()] == ["broken"]
    calendar = source.feed_table(rows, "calendar.txt", ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"])
    dates = source.feed_table(rows, "calendar_dates.txt", ["service_id", "date", "exception_type"])
    days = {str(r.date): r.trips for r in feeds.service_days(calendar, dates, trips).collect()}
    assert days == {"2026-01-05": 2, "2026-01-06": 0, "2026-01-07": 2, "2026-01-08": 3, "2026-01-09": 2, "2026-01-10": 0, "2026-01-11": 2}
    near = [str(r.date) for r in feeds.nearest_served_days(feeds.service_days(calendar, dates, trips), "2026-01-06", 3).collect()]
    assert near == ["2026-01-05", "2026-01-07", "2026-01-08"]
    stops = source.feed_table(rows, "stops.txt", ["stop_id", "stop_lat", "stop_lon", "location_type"])
    assert {r.stop_id: r.position for r in feeds.stop_position(stops).collect()} == {"s1": "ok", "s2": "bad", "s3": "exempt", "s4": "bad"}
    names = rows.select("feed").distinct().where("feed <> 'broken'")
    found = {(r.feed, r.code, r.detail) for r in feeds.file_findings(names, source.feed_files(rows)).collect()}
    assert ("one", "MISSING_FILE", "routes.txt") in found and ("two", "NO_CALENDAR", None) not in found
    missing = {r.feed: r.missing for r in catalogue.missing_files(source.feed_files(rows).where("feed <> 'broken'")).collect()}
    assert missing["one"] == ["agency.txt", "routes.txt", "stop_times.txt"]


def test_a_cap_counts_from_each_feeds_own_first_day(spark):
    columns = "row_no int, feed string, service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string"
    calendar = spark.createDataFrame([(0, "old", "A", *[1] * 7, "20200101", "20991231"), (1, "new", "B", *[1] * 7, "20260101", "20260103")], columns)
    none = spark.createDataFrame([], "feed string, service_id string, date string, exception_type string, row_no int")
    trips = spark.createDataFrame([("old", "A", "t"), ("new", "B", "t")], "feed string, service_id string, trip_id string")
    days = {str(r.date): r.trips for r in feeds.service_days(calendar, none, trips, cap_days=400).collect()}
    assert len(days) == 403 and days["2026-01-02"] == 1 and "2021-02-04" not in days


def test_stored_archives_prune_by_file(spark, folder, tmp_path):
    out = str(tmp_path / "rows")
    source.store(source.read_archives(spark, folder), out)
    again = spark.read.parquet(out)
    assert source.feed_table(again, "trips.txt", ["trip_id"]).count() == 3


def test_unpacked_csv(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('﻿Stop_ID, Stop_Name\ns1,"a, b"\n,\ns2,"c ""d"""\n', encoding="utf-8")
    rows = source.read_unpacked(spark, str(tmp_path / "stops.txt")).orderBy("stop_id").collect()
    assert [(r.stop_id, r.stop_name) for r in rows] == [("s1", "a, b"), ("s2", 'c "d"')]


def test_points_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([(3, 19.12345678, 51.0, "7"), (1, 19.0, 51.5, ""), (2, None, 51.5, "4")], "k int, lon double, lat double, jobs string")
    got = tables.points(raw, id_field=None, extras=["jobs"], order=["k"])
    assert [(r.id, r.lon, r.jobs) for r in got.orderBy("id").collect()] == [("0", 19.0, 0.0), ("1", 19.123457, 7.0)]
    assert tables.skipped_points(raw).first().skipped == 1
    with pytest.raises(ValueError):
        tables.points(raw, id_field="k", extras=["beds"])
    got.write.csv(str(tmp_path / "p"), header=True)
    assert tables.read_points(spark, str(tmp_path / "p"), ["jobs"]).agg(F.sum("jobs")).first()[0] == 7.0


def test_batches_merge(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"batch_{i}.csv").write_text(f"from_id,to_id,travel_time_p50\na{i},x,{i}\n")
    (tmp_path / "batch_3.csv").write_text("")
    assert tables.read_batches(spark, str(tmp_path / "batch_*.csv")).count() == 2


def test_accessibility_sink(spark, tmp_path):
    long = spark.createDataFrame([("a", "jobs", 50, 30, 2.0)], "id string, opportunity string, percentile int, cutoff int, accessibility double")
    out = str(tmp_path / "acc")
    tables.write_accessibility(long, out, {"decay": "STEP", "cutoffs": [30]})
    assert spark.read.parquet(out).count() == 1
    assert json.loads(spark.read.text(out + ".meta.json").first().value) == {"cutoffs": [30], "decay": "STEP"}


def test_vote_file(spark, tmp_path):
    (tmp_path / "v.csv").write_text('"nr";"x";"valid";"K1";"K2"\n1;a;10;6;4\n2;b;0;0;0\n3;c;5;;5\n', encoding="utf-8")
    got = tables.read_votes(spark, str(tmp_path / "v.csv"), precinct=0, valid=2, committees={3: "A", 4: "B"})
    assert sorted((r.precinct, r.committee, r.votes) for r in got.collect()) == [("1", "A", 6), ("1", "B", 4), ("3", "A", 0), ("3", "B", 5)]


def test_logs(spark, tmp_path):
    (tmp_path / "run.log").write_text("origins: 100\n[ 1/17] 06:00 -> 90 features in 5.0 s\n[ 2/17] 07:00 -> 91 features in 7.0 s\nnoise\n")
    row = tables.run_costs(tables.read_logs(spark, str(tmp_path / "run.log"))).first()
    assert (row.file, row.origins, row.steps_done, row.elapsed_s, row.complete) == ("run.log", 100, 2, 12.0, False)
    assert row.s_per_origin_hour == pytest.approx(0.06) and row.eta_s == pytest.approx(90.0)


def test_systematic_sample(spark):
    def taken(n, k):
        return sorted(r.idx for r in tables.systematic_sample(spark.range(n), ["id"], k).collect())
    assert taken(0, 4) == [] and taken(3, 5) == [0, 1, 2] and taken(9, 1) == [0] and taken(10, 4) == [0, 3, 6, 9] and taken(6, 3) == [0, 2, 5]
    assert taken(100, 15) == sorted({round(i * 99 / 14) for i in range(15)})


def test_catalogue(spark):
    body = {"cities": {"b": {"days": [{"date": "2026-08-02", "assets": {"p50": "u2"}}, {"date": "2026-07-30", "status": "partial", "assets": {"p50": "u1", "p85": "w"}}]},
                       "a": {"display_name": "Zeta", "days": []}}}
    flat = catalogue.slim(spark.createDataFrame([(json.dumps(body),)], "body string"))
    assert flat.count() == 6
    assert [r.month for r in catalogue.months(flat, "b").collect()] == ["2026-08", "2026-07"]
    assert [(r.date, r.status) for r in catalogue.days(flat, "b", "2026-07").collect()] == [("2026-07-30", "partial")]
    assert [(r.gap, r.url) for r in catalogue.resolve(flat, "b", "2026-08-02", "p50").collect()] == [(0, "u2")]
    assert [r.date for r in catalogue.resolve(flat, "b", "2026-08-04", "p50").collect()] == ["2026-08-02", "2026-07-30"]
    with pytest.raises(ValueError):
        catalogue.resolve(flat, "b", "2026-08-02", "p99")


def test_case_sweep_resumes(spark, tmp_path):
    folder, seen = str(tmp_path / "sweep"), []
    def compute(names):
        seen.append(list(names))
        return spark.createDataFrame([(n, 1) for n in names], "scenario string, v int")
    assert timetable.run_cases(spark, ["a", "b"], compute, folder) == ["a", "b"]
    assert timetable.run_cases(spark, ["a", "b", "c"], compute, folder) == ["c"]
    assert seen == [["a", "b"], ["c"]] and spark.read.parquet(folder).count() == 3
