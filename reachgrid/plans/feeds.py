"""Timetable feed and line queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachgrid.functions import values
from reachgrid.functions.values import whole
from reachgrid.operators import calls, feeds, lines, spatial
from reachgrid.plans import spatial as places
from reachgrid.plans.registry import query
from reachgrid.plans.spatial import polygons
from reachgrid.plans.views import SQL_VIEWS

DATE = "2026-01-25"

# --- derived feed tables ------------------------------------------------------

SQL_VIEWS["v_feed_stops"] = """
SELECT 'f' || f AS feed, s_suppkey AS stop_id, CASE WHEN s_suppkey % 13 = 0 THEN '' WHEN s_suppkey % 17 = 0 THEN '0' ELSE lat::VARCHAR END AS stop_lat,
       CASE WHEN s_suppkey % 17 = 0 THEN '0.0' WHEN s_suppkey % 19 = 0 THEN '190' ELSE lon::VARCHAR END AS stop_lon,
       CASE WHEN s_suppkey % 26 = 0 THEN '3' WHEN s_suppkey % 2 = 0 THEN '0' ELSE '' END AS location_type
FROM supplier JOIN v_dests ON id = s_suppkey CROSS JOIN (VALUES (0), (1), (2)) t(f) WHERE s_suppkey % 10 <> f"""
SQL_VIEWS["v_feed_routes"] = """
SELECT DISTINCT 'f' || f AS feed, c_custkey % 40 AS route_id, CASE c_custkey % 40 % 8 WHEN 0 THEN '0' WHEN 1 THEN '3' WHEN 2 THEN '700' WHEN 3 THEN '13'
       WHEN 4 THEN 'x' WHEN 5 THEN '1500' WHEN 6 THEN '109' ELSE '11' END AS route_type, 'L' || (c_custkey % 40 % 10) AS route_short_name
FROM customer CROSS JOIN (VALUES (0), (1), (2)) t(f) WHERE c_custkey % 40 % 9 <> f"""
SQL_VIEWS["v_feed_trips"] = "SELECT *, trip_id % 1000 AS tid FROM v_trips WHERE trip_id % 97 <> 0"
SQL_VIEWS["v_feed_times"] = "SELECT 'f' || (trip_id % 3) AS feed, trip_id, seq, stop_id, arr FROM v_stop_times"
SQL_VIEWS["v_realized"] = "SELECT 'f' || (trip_id % 3) AS feed, trip_id, seq, stop_id, arr + shift AS arr FROM v_stop_times WHERE (trip_id + seq) % 23 <> 0 AND trip_id % 89 <> 0"
# Calendar in force: exceptions (last row wins) override the weekly calendar.
SQL_VIEWS["v_exc"] = "SELECT feed, service_id, strptime(date, '%Y%m%d')::DATE AS d, arg_max(exception_type, row_no) AS kind FROM v_exceptions GROUP BY ALL"
SQL_VIEWS["v_cal"] = "SELECT * EXCLUDE (k), strptime(start_date, '%Y%m%d')::DATE AS s, strptime(end_date, '%Y%m%d')::DATE AS e, [monday, tuesday, wednesday, thursday, friday, saturday, sunday] AS flags FROM (SELECT *, row_number() OVER (PARTITION BY feed, service_id ORDER BY row_no DESC) AS k FROM v_calendar) WHERE k = 1"
SQL_VIEWS["v_span"] = """SELECT feed, min(d) AS first, max(d) AS last FROM (
    SELECT feed, s AS d FROM v_cal UNION ALL SELECT feed, e FROM v_cal UNION ALL SELECT feed, d FROM v_exc) GROUP BY feed"""
SQL_VIEWS["v_span_days"] = "SELECT feed, unnest(generate_series(first::TIMESTAMP, last::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM v_span"
SQL_VIEWS["v_active"] = """
    SELECT c.feed, c.service_id, p.d FROM v_cal c JOIN v_span_days p ON p.feed = c.feed AND p.d BETWEEN c.s AND c.e
    WHERE c.flags[isodow(p.d)] = 1 AND NOT EXISTS (SELECT 1 FROM v_exc x WHERE x.feed = c.feed AND x.service_id = c.service_id AND x.d = p.d)
    UNION ALL SELECT x.feed, x.service_id, x.d FROM v_exc x JOIN v_span_days p ON p.feed = x.feed AND p.d = x.d WHERE kind = 1"""
SQL_VIEWS["v_days"] = """SELECT d, coalesce(sum(n), 0)::BIGINT AS trips FROM (
    SELECT d, 0 AS n FROM v_span_days UNION ALL
    SELECT a.d, t.n FROM v_active a JOIN (SELECT feed, service_id, count(*) AS n FROM v_trips GROUP BY ALL) t USING (feed, service_id)) GROUP BY d"""
SQL_VIEWS["v_line_stops"] = "SELECT id AS stop_id, lon, lat, x, y, CASE id % 2 WHEN 0 THEN 'tram' ELSE 'bus' END AS mode FROM v_dests"
SQL_VIEWS["v_line_times"] = "SELECT trip_id, seq, stop_id, arr, arr + 20 AS dep FROM v_stop_times"


def _each_feed(df, last=2):
    return df.withColumn("f", F.explode(F.array(*[F.lit(i) for i in range(last + 1)])))


def feed_stops(d):
    k = F.col("id")
    return _each_feed(d.dests).where(k % 10 != F.col("f")).select(
        F.concat(F.lit("f"), F.col("f").cast("string")).alias("feed"), k.alias("stop_id"),
        F.when(k % 13 == 0, "").when(k % 17 == 0, "0").otherwise(F.col("lat").cast("string")).alias("stop_lat"),
        F.when(k % 17 == 0, "0.0").when(k % 19 == 0, "190").otherwise(F.col("lon").cast("string")).alias("stop_lon"),
        F.when(k % 26 == 0, "3").when(k % 2 == 0, "0").otherwise("").alias("location_type"))


def feed_routes(d):
    r = F.col("route_id")
    types = F.array(*[F.lit(t) for t in ("0", "3", "700", "13", "x", "1500", "109", "11")])
    keys = d.table("customer").select((F.col("c_custkey") % 40).alias("route_id")).distinct()
    return _each_feed(keys).where(r % 9 != F.col("f")).select(
        F.concat(F.lit("f"), F.col("f").cast("string")).alias("feed"), "route_id",
        F.get(types, (r % 8).cast("int")).alias("route_type"),
        F.concat(F.lit("L"), (r % 10).cast("string")).alias("route_short_name"))


def feed_trips(d):
    return d.trips.where("trip_id % 97 <> 0")


def _of_feed(df):
    return df.withColumn("feed", F.concat(F.lit("f"), (F.col("trip_id") % 3).cast("string")))


def feed_times(d):
    return _of_feed(d.stop_times).select("feed", "trip_id", "seq", "stop_id", "arr")


def realized(d):
    kept = d.stop_times.where("(trip_id + seq) % 23 <> 0 and trip_id % 89 <> 0")
    return _of_feed(kept).select("feed", "trip_id", "seq", "stop_id", (F.col("arr") + F.col("shift")).alias("arr"))


# --- calendar -------------------------------------------------------------------

@query("e01_service_days", "SELECT strftime(d, '%Y-%m-%d') AS date, trips FROM v_days")
def service_days(d):
    out = feeds.service_days(d.calendar, d.exceptions, d.trips)
    return out.select(F.col("date").cast("string").alias("date"), "trips")


@query("e02_nearest_served_days", """
SELECT strftime(d, '%Y-%m-%d') AS date, trips, abs(d - DATE '2026-01-02')::BIGINT AS gap FROM v_days WHERE trips > 0 ORDER BY gap, d LIMIT 3""")
def nearest_served_days(d):
    out = feeds.nearest_served_days(feeds.service_days(d.calendar, d.exceptions, d.trips), "2026-01-02")
    return out.select(F.col("date").cast("string").alias("date"), "trips", F.col("gap").cast("bigint").alias("gap"))


@query("e03_active_trips", f"""
SELECT t.feed, t.service_id, count(*) AS trips FROM v_trips t JOIN (SELECT DISTINCT feed, service_id FROM v_active WHERE d = DATE '{DATE}') USING (feed, service_id) GROUP BY ALL""")
def active_trips(d):
    return feeds.active_trips(d.trips, d.calendar, d.exceptions, DATE).groupBy("feed", "service_id").agg(F.count("*").alias("trips"))


@query("e09_date_coverage", """
SELECT feed, min(x) AS first, max(x) AS last, CASE WHEN min(x) > '20260103' THEN 'published after' WHEN max(x) < '20260103' THEN 'expired' ELSE 'covers' END AS coverage
FROM (SELECT feed, start_date AS x FROM v_calendar UNION ALL SELECT feed, end_date FROM v_calendar UNION ALL SELECT feed, date FROM v_exceptions
      UNION ALL SELECT 'orders', strftime(max(o_orderdate), '%Y%m%d') FROM orders) GROUP BY feed""")
def date_coverage(d):
    """The three feeds, plus the order dates as a feed that ended long ago."""
    last = d.table("orders").agg(F.date_format(F.max("o_orderdate"), "yyyyMMdd").alias("date"))
    dates = d.exceptions.select("feed", "date").unionByName(last.select(F.lit("orders").alias("feed"), "date"))
    return feeds.date_coverage(d.calendar, dates, "2026-01-03")


# --- checks ---------------------------------------------------------------------

@query("b06_e05_stop_positions", """
WITH p AS (SELECT feed, stop_id, try_cast(stop_lat AS DOUBLE) AS la, try_cast(stop_lon AS DOUBLE) AS lo_, location_type FROM v_feed_stops),
q AS (SELECT *, CASE WHEN la IS NULL OR lo_ IS NULL THEN CASE WHEN location_type IN ('', '0', '1', '2') THEN 'bad' ELSE 'exempt' END
              WHEN la NOT BETWEEN -90 AND 90 OR lo_ NOT BETWEEN -180 AND 180 OR (la = 0 AND lo_ = 0) THEN 'bad' ELSE 'ok' END AS position FROM p)
SELECT feed, count(*) FILTER (position = 'bad') AS bad, count(*) FILTER (position = 'exempt') AS exempt, count(DISTINCT stop_id) AS stops,
       min(lo_) FILTER (position = 'ok') AS xmin, min(la) FILTER (position = 'ok') AS ymin, max(lo_) FILTER (position = 'ok') AS xmax, max(la) FILTER (position = 'ok') AS ymax
FROM q GROUP BY feed""")
def stop_positions(d):
    stops = feed_stops(d)
    state = feeds.stop_position(stops).groupBy("feed").agg(
        F.count_if(F.col("position") == "bad").alias("bad"), F.count_if(F.col("position") == "exempt").alias("exempt"))
    return state.join(feeds.stop_boxes(stops), "feed")


@query("b05_inside_box", """
SELECT region, count(*) FILTER (lon BETWEEN 19.35 AND 19.5 AND lat BETWEEN 51.7 AND 51.8) AS inside,
       count(*) FILTER (NOT (lon BETWEEN 19.35 AND 19.5 AND lat BETWEEN 51.7 AND 51.8)) AS outside FROM v_origins GROUP BY region""")
def inside_box(d):
    return feeds.inside_box(d.origins, (19.35, 51.7, 19.5, 51.8), ["region"])


@query("b07_route_type_findings", """
SELECT feed, 'ERROR' AS level, 'UNSUPPORTED_ROUTE_TYPE' AS code, count(*) AS n, coalesce(try_cast(route_type AS INTEGER)::VARCHAR, 'None') AS detail
FROM v_feed_routes WHERE coalesce(NOT (try_cast(route_type AS INTEGER) IN (0,1,2,3,4,5,6,7,11,12) OR try_cast(route_type AS INTEGER) BETWEEN 100 AND 1499), true) GROUP BY ALL""")
def route_type_findings(d):
    return feeds.route_type_findings(feed_routes(d))


_TRACTION = """CASE WHEN {c} IN ('0', '5') OR {c} LIKE '90%' THEN 'tram' WHEN {c} = '1' OR {c} LIKE '40%' THEN 'metro' WHEN {c} = '2' OR {c} LIKE '1%' THEN 'rail'
    WHEN {c} = '3' OR {c} LIKE '7%' THEN 'bus' WHEN {c} = '11' OR {c} LIKE '80%' THEN 'trolleybus' WHEN {c} = '4' OR {c} LIKE '100%' THEN 'ferry' ELSE 'other' END"""


@query("b08_traction_class", f"""
SELECT {_TRACTION.format(c='t')} AS traction, count(*) AS n FROM (SELECT (p_size * 37 % 1300)::VARCHAR AS t FROM part UNION ALL SELECT (p_partkey % 13)::VARCHAR FROM part) GROUP BY 1""")
def traction_class(d):
    parts = d.table("part")
    codes = parts.select((F.col("p_size") * 37 % 1300).cast("string").alias("t")).unionByName(
        parts.select((F.col("p_partkey") % 13).cast("string").alias("t")))
    return codes.groupBy(values.traction(F.col("t")).alias("traction")).agg(F.count("*").alias("n"))


SQL_VIEWS["v_orphans"] = """
SELECT feed, 'WARN' AS level, 'ORPHAN_TRIP_ROUTE' AS code, count(*) AS n, NULL::VARCHAR AS detail FROM v_feed_trips t WHERE NOT EXISTS (SELECT 1 FROM v_feed_routes r WHERE r.feed = t.feed AND r.route_id = t.route_id) GROUP BY feed
UNION ALL SELECT feed, 'WARN', 'ORPHAN_TRIP_SERVICE', count(*), NULL FROM v_feed_trips t WHERE NOT EXISTS (SELECT 1 FROM v_calendar c WHERE c.feed = t.feed AND c.service_id = t.service_id) AND NOT EXISTS (SELECT 1 FROM v_exc c WHERE c.feed = t.feed AND c.service_id = t.service_id) GROUP BY feed
UNION ALL SELECT feed, 'WARN', 'ORPHAN_STOP_TIME_TRIP', count(*), NULL FROM v_feed_times t WHERE NOT EXISTS (SELECT 1 FROM v_feed_trips c WHERE c.feed = t.feed AND c.trip_id = t.trip_id) GROUP BY feed
UNION ALL SELECT feed, 'WARN', 'ORPHAN_STOP_TIME_STOP', count(*), NULL FROM v_feed_times t WHERE NOT EXISTS (SELECT 1 FROM v_feed_stops c WHERE c.feed = t.feed AND c.stop_id = t.stop_id) GROUP BY feed
UNION ALL SELECT feed, 'WARN', 'TRIPS_WITHOUT_STOP_TIMES', count(*), NULL FROM v_feed_trips t WHERE NOT EXISTS (SELECT 1 FROM v_feed_times c WHERE c.feed = t.feed AND c.trip_id = t.trip_id) GROUP BY feed"""


def _orphans(d):
    return feeds.orphan_findings(feed_routes(d), feed_trips(d), feed_times(d), feed_stops(d),
                                 d.calendar.where("not (feed = 'f0' and service_id = '2-HIGH')"), d.exceptions.where("service_id <> '2-HIGH'"))


_ORPHAN_SQL = "SELECT * FROM v_orphans WHERE code <> 'ORPHAN_TRIP_SERVICE' UNION ALL SELECT 'f0', 'WARN', 'ORPHAN_TRIP_SERVICE', count(*), NULL FROM v_feed_trips WHERE feed = 'f0' AND service_id = '2-HIGH'"


@query("c06_orphan_references", _ORPHAN_SQL)
def orphan_references(d):
    return _orphans(d)


@query("c07_shared_trip_ids", """
WITH i AS (SELECT DISTINCT CASE WHEN trip_id % 10 < 6 THEN feed ELSE feed || 'x' END AS feed, tid AS trip_id FROM v_feed_trips),
s AS (SELECT feed, count(*) AS n FROM i GROUP BY feed)
SELECT a.feed AS feed_a, b.feed AS feed_b, count(*) AS shared, round(count(*) / least(any_value(sa.n), any_value(sb.n)), 6) AS ratio,
       CASE WHEN count(*) / least(any_value(sa.n), any_value(sb.n)) >= 0.5 THEN 'ERROR' ELSE 'WARN' END AS level
FROM i a JOIN i b ON a.trip_id = b.trip_id AND a.feed < b.feed JOIN s sa ON sa.feed = a.feed JOIN s sb ON sb.feed = b.feed GROUP BY a.feed, b.feed""")
def shared_trip_ids(d):
    split = F.when(F.col("trip_id") % 10 < 6, F.col("feed")).otherwise(F.concat("feed", F.lit("x")))
    out = feeds.shared_trip_ids(feed_trips(d).select(split.alias("feed"), (F.col("trip_id") % 1000).alias("trip_id")))
    return out.withColumn("ratio", F.round("ratio", 6))


@query("c07_ids_in_many_feeds", """
WITH i AS (SELECT DISTINCT o_custkey % 97 AS feed, o_orderkey % 1009 AS trip_id FROM orders), s AS (SELECT feed, count(*) AS n FROM i GROUP BY feed)
SELECT a.feed AS feed_a, b.feed AS feed_b, count(*) AS shared, round(count(*) / least(any_value(sa.n), any_value(sb.n)), 6) AS ratio,
       CASE WHEN count(*) / least(any_value(sa.n), any_value(sb.n)) >= 0.5 THEN 'ERROR' ELSE 'WARN' END AS level
FROM i a JOIN i b ON a.trip_id = b.trip_id AND a.feed < b.feed JOIN s sa ON sa.feed = a.feed JOIN s sb ON sb.feed = b.feed GROUP BY a.feed, b.feed""")
def ids_in_many_feeds(d):
    ids = d.table("orders").select((F.col("o_custkey") % 97).alias("feed"), (F.col("o_orderkey") % 1009).alias("trip_id"))
    return feeds.shared_trip_ids(ids).withColumn("ratio", F.round("ratio", 6))


@query("c08_duplicate_feed_ids", """
SELECT coalesce(nullif(fid, ''), s_name) AS id, count(*) AS n, min(s_name) AS first
FROM (SELECT s_name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'id' || (s_suppkey % 20) END AS fid FROM supplier) GROUP BY 1 HAVING count(*) > 1""")
def duplicate_feed_ids(d):
    k = F.col("s_suppkey")
    named = d.table("supplier").select(F.col("s_name").alias("feed"), F.when(k % 3 == 0, "").otherwise(
        F.concat(F.lit("id"), (k % 20).cast("string"))).alias("feed_id"))
    return feeds.duplicate_feed_ids(named)


def _feed_files(d):
    """Which files each of the derived feeds holds: a table with rows is a file."""
    parts = [("stops.txt", feed_stops(d)), ("trips.txt", feed_trips(d)), ("stop_times.txt", feed_times(d)),
             ("routes.txt", feed_routes(d).where("feed <> 'f2'")), ("calendar_dates.txt", d.exceptions)]
    out = None
    for name, df in parts:
        part = df.select("feed").distinct().withColumn("file", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("e04_feed_findings", f"""
SELECT 'f2' AS feed, 'ERROR' AS level, 'MISSING_FILE' AS code, 1::BIGINT AS n, 'routes.txt' AS detail
UNION ALL SELECT feed, 'INFO', 'NO_SHAPES', 1, NULL FROM (SELECT DISTINCT feed FROM v_trips)
UNION ALL SELECT feed, 'ERROR', 'UNSUPPORTED_ROUTE_TYPE', count(*), coalesce(try_cast(route_type AS INTEGER)::VARCHAR, 'None') FROM v_feed_routes WHERE route_type IN ('13', 'x', '1500') GROUP BY ALL
UNION ALL ({_ORPHAN_SQL})
UNION ALL SELECT NULL, 'INFO', 'CALENDAR_SPAN', count(*), strftime(min(d), '%Y-%m-%d') || ' ' || strftime(max(d), '%Y-%m-%d') || ' ' || min(trips) || ' ' || printf('%.1f', median(trips)) || ' ' || max(trips) FROM v_days
UNION ALL SELECT NULL, 'WARN', 'DAYS_WITHOUT_SERVICE', count(*), NULL FROM v_days WHERE trips = 0
UNION ALL SELECT NULL, 'ERROR', 'DATE_NO_SERVICE', 0, string_agg(ds, ', ') FROM (SELECT strftime(d, '%Y-%m-%d') AS ds FROM v_days WHERE trips > 0 ORDER BY abs(d - DATE '2027-06-01'), d LIMIT 3)
UNION ALL SELECT 'C', 'WARN', 'NO_TIMEZONE', 1, NULL
UNION ALL SELECT NULL, 'WARN', 'MIXED_TIMEZONES', count(DISTINCT r_name), string_agg(DISTINCT r_name, ', ' ORDER BY r_name) FROM region""")
def feed_findings(d):
    """Every per-feed and cross-feed check over the derived feeds, as one findings table."""
    agencies = d.table("region").select(F.lit("A").alias("feed"), F.col("r_name").alias("agency_timezone")).unionByName(
        d.table("region").select(F.lit("C").alias("feed"), F.lit(" ").alias("agency_timezone")))
    names = d.trips.select("feed").distinct()
    parts = [feeds.file_findings(names, _feed_files(d)), feeds.route_type_findings(feed_routes(d)), _orphans(d),
             feeds.service_findings(feeds.service_days(d.calendar, d.exceptions, d.trips), "2027-06-01"),
             feeds.timezone_findings(agencies)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("e04_route_trips", """
SELECT r.feed, r.route_id, count(t.trip_id) AS trips FROM v_feed_routes r LEFT JOIN v_feed_trips t ON t.feed = r.feed AND t.route_id = r.route_id GROUP BY ALL""")
def route_trips(d):
    return feeds.route_trips(feed_routes(d), feed_trips(d)).select("feed", "route_id", "trips")


# --- static against realized ------------------------------------------------------

@query("e06_decreasing_trips", """
WITH s AS (SELECT feed, trip_id, arr < lag(arr) OVER (PARTITION BY trip_id ORDER BY seq) AS down FROM v_realized),
t AS (SELECT feed, trip_id, max(CASE WHEN down THEN 1 ELSE 0 END) AS bad FROM s GROUP BY ALL)
SELECT feed, count(*) FILTER (bad = 1) AS bad, count(*) AS trips FROM t GROUP BY feed""")
def decreasing_trips(d):
    return feeds.decreasing_trips(realized(d))


_SHIFTS = "x AS (SELECT s.feed, s.trip_id, s.seq, s.arr, r.arr - s.arr AS shift FROM v_feed_times s JOIN v_realized r ON r.trip_id = s.trip_id AND r.seq = s.seq)"


@query("c09_e07_shift_distribution", f"""
WITH {_SHIFTS}, o AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY shift) - 1 AS i, count(*) OVER (PARTITION BY feed) AS n FROM x)
SELECT feed, count(*) AS n, median(shift)::DOUBLE AS median, max(shift) FILTER (i = n // 20)::DOUBLE AS p05, round(avg(shift), 6) AS mean,
       round(count(*) FILTER (shift < -300) / count(*), 6) AS early_share, 0 AS fails FROM o GROUP BY feed""")
def shift_distribution(d):
    out = feeds.shift_distribution(feeds.shifts(feed_times(d), realized(d)))
    return out.select("feed", "n", "median", "p05", F.round("mean", 6).alias("mean"), F.round("early_share", 6).alias("early_share"),
                      F.col("fails").cast("int").alias("fails"))


@query("c09_e06_e08_stored_calls", f"""
WITH {_SHIFTS}, p AS (SELECT feed, trip_id, count(*) AS k, avg(shift) AS m, arg_min(arr, seq) AS first FROM x GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT feed, trip_id, max(CASE WHEN down THEN 1 ELSE 0 END) AS bad FROM (SELECT feed, trip_id, arr < lag(arr) OVER (PARTITION BY trip_id ORDER BY seq) AS down FROM v_realized) GROUP BY ALL)
SELECT s.feed, sum(s.bad)::BIGINT AS bad, count(*) AS trips, count(p.trip_id) AS common, sum(p.k)::BIGINT AS calls, round(avg(p.m), 6) AS mean, min(p.first)::BIGINT AS first
FROM s LEFT JOIN p USING (feed, trip_id) GROUP BY s.feed""")
def stored_calls(d):
    """Time order and shifts per feed, both read from one stored table of static and realized calls."""
    keys = ["feed", "trip_id"]
    pair = calls.store_pair(feed_times(d), realized(d), keys)
    bad = calls.decreasing(pair.where("real"), keys)
    common = calls.trip_shifts(calls.shifts(pair, keys), keys)
    return bad.join(common, keys, "left").groupBy("feed").agg(
        F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("trips"), F.count("stops").alias("common"), F.sum("stops").alias("calls"),
        F.round(F.avg("mean"), 6).alias("mean"), F.min("first").alias("first"))


@query("e08_trip_shifts", f"""
WITH {_SHIFTS},
p AS (SELECT feed, trip_id, avg(shift) AS m, arg_min(arr, seq) AS first FROM (SELECT feed, trip_id % 500 AS trip_id, seq, avg(shift) AS shift, min(arr) AS arr FROM x GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT m, first, {_TRACTION.format(c="coalesce(route_type, '')")} AS traction FROM p JOIN (SELECT DISTINCT feed, trip_id % 500 AS trip_id, trip_id % 40 AS route_id FROM v_feed_times) t USING (feed, trip_id)
      LEFT JOIN v_feed_routes r USING (feed, route_id)),
w AS (SELECT 'day' AS window_, * FROM k UNION ALL SELECT 'peak', * FROM k WHERE first BETWEEN 25200 AND 32400)
SELECT window_ AS "window", traction, count(*) AS trips, count(*) FILTER (m > 30) AS late, count(*) FILTER (m < -30) AS early, count(*) FILTER (abs(m) <= 30) AS unchanged,
       round(100 * count(*) FILTER (m > 30) / count(*), 1) AS late_pct, round(100 * count(*) FILTER (m < -30) / count(*), 1) AS early_pct,
       round(100 * count(*) FILTER (abs(m) <= 30) / count(*), 1) AS unchanged_pct, round(median(m)) AS median_shift_s, round(avg(m)) AS mean_shift_s
FROM w GROUP BY ALL""")
def trip_shifts(d):
    """Trip ids run from 0 to 499 in every feed, so most of them are in several feeds."""
    short = (F.col("trip_id") % 500).alias("trip_id")
    pairs = feeds.shifts(feed_times(d), realized(d)).groupBy("feed", short, "seq").agg(F.avg("shift").alias("shift"), F.min("arr").alias("arr"))
    trips = feed_times(d).select("feed", short, (F.col("trip_id") % 40).alias("route_id")).distinct()
    return feeds.trip_shifts(pairs, trips, feed_routes(d))


@query("c09_pair_findings", f"""
WITH s AS (SELECT feed, trip_id, seq, stop_id FROM v_feed_times),
r AS (SELECT feed, trip_id, seq, CASE WHEN feed = 'f1' AND seq = 1 THEN stop_id + 1000000 ELSE stop_id END AS stop_id FROM v_realized WHERE feed <> 'f2'),
f AS (SELECT DISTINCT feed FROM s),
n AS (SELECT feed, count(*) AS trips FROM v_trips JOIN (SELECT DISTINCT feed, service_id FROM v_active WHERE d = DATE '{DATE}') USING (feed, service_id) GROUP BY feed)
SELECT feed, 'ERROR' AS level, 'NO_OVERLAP' AS code, 1 AS n, NULL::VARCHAR AS detail FROM f WHERE feed NOT IN (SELECT feed FROM s JOIN r USING (feed, trip_id, seq))
UNION ALL SELECT feed, 'WARN', 'STOPS_DIFFER', count(*), NULL FROM (SELECT DISTINCT feed, stop_id, 1 AS a FROM s) FULL JOIN (SELECT DISTINCT feed, stop_id, 1 AS b FROM r) USING (feed, stop_id) WHERE a IS NULL OR b IS NULL GROUP BY feed
UNION ALL SELECT feed, 'WARN', 'FEW_TRIPS', coalesce(trips, 0), NULL FROM f LEFT JOIN n USING (feed) WHERE coalesce(trips, 0) < 4000""")
def pair_findings(d):
    """The realized side has other stop ids in feed f1 and lacks feed f2."""
    moved = F.when((F.col("feed") == "f1") & (F.col("seq") == 1), F.col("stop_id") + 1000000).otherwise(F.col("stop_id"))
    real = realized(d).where("feed <> 'f2'").withColumn("stop_id", moved)
    on_date = feeds.active_trips(d.trips, d.calendar, d.exceptions, DATE).groupBy("feed").agg(F.count("*").alias("trips"))
    return feeds.pair_findings(feed_times(d), real, on_date, min_trips=4000)


@query("c19_trip_id_differences", """
SELECT feed, count(*) FILTER (r IS NULL) AS only_static, count(*) FILTER (s IS NULL) AS only_realized
FROM (SELECT feed, trip_id, 1 AS s FROM (SELECT DISTINCT feed, trip_id FROM v_feed_times WHERE trip_id % 31 <> 0)) a FULL JOIN (SELECT feed, trip_id, 1 AS r FROM (SELECT DISTINCT feed, trip_id FROM v_realized)) b USING (feed, trip_id) GROUP BY feed""")
def trip_id_differences(d):
    return feeds.trip_id_differences(feed_times(d).where("trip_id % 31 <> 0"), realized(d))


# --- cascades ---------------------------------------------------------------------

@query("b09_keep_trips", """
WITH t AS (SELECT * FROM v_feed_trips WHERE service_id IN ('1-URGENT', '2-HIGH')),
st AS (SELECT * FROM v_feed_times s WHERE EXISTS (SELECT 1 FROM t WHERE t.feed = s.feed AND t.trip_id = s.trip_id))
SELECT 'trips' AS tbl, feed, count(*) AS n FROM t GROUP BY feed UNION ALL SELECT 'stop_times', feed, count(*) FROM st GROUP BY feed
UNION ALL SELECT 'routes', feed, count(*) FROM v_feed_routes r WHERE EXISTS (SELECT 1 FROM t WHERE t.feed = r.feed AND t.route_id = r.route_id) GROUP BY feed
UNION ALL SELECT 'stops', feed, count(*) FROM v_feed_stops s WHERE EXISTS (SELECT 1 FROM st WHERE st.feed = s.feed AND st.stop_id = s.stop_id) GROUP BY feed
UNION ALL SELECT 'calendar', feed, count(*) FROM v_calendar c WHERE EXISTS (SELECT 1 FROM t WHERE t.feed = c.feed AND t.service_id = c.service_id) GROUP BY feed""")
def keep_trips(d):
    wanted = d.trips.where(F.col("service_id").isin("1-URGENT", "2-HIGH"))  # the services that stay
    kept = feeds.keep_trips(wanted, {"trips": feed_trips(d), "stop_times": feed_times(d), "routes": feed_routes(d),
                                     "stops": feed_stops(d), "calendar": d.calendar})
    out = None
    for name, df in kept.items():
        part = df.groupBy("feed").agg(F.count("*").alias("n")).withColumn("tbl", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("c10_resolve_routes", """
WITH refs AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'f1:' || (p_size % 40) WHEN 1 THEN (p_size % 50)::VARCHAR WHEN 2 THEN 'L' || (p_size % 10) ELSE '?' || p_size END AS ref FROM part),
keys AS (SELECT feed || ':' || route_id AS full_id, 0 AS tier, feed || ':' || route_id AS ref FROM v_feed_routes
         UNION ALL SELECT feed || ':' || route_id, 1, route_id::VARCHAR FROM v_feed_routes UNION ALL SELECT feed || ':' || route_id, 2, route_short_name FROM v_feed_routes),
h AS (SELECT r.ref, k.tier, k.full_id, rank() OVER (PARTITION BY r.ref ORDER BY k.tier) AS rk FROM refs r LEFT JOIN keys k USING (ref))
SELECT ref, tier, full_id, count(full_id) OVER (PARTITION BY ref) AS hits FROM h WHERE rk = 1""")
def resolve_routes(d):
    n = F.col("p_size")
    text = lambda c: c.cast("string")
    ref = (F.when(n % 4 == 0, F.concat(F.lit("f1:"), text(n % 40))).when(n % 4 == 1, text(n % 50))
           .when(n % 4 == 2, F.concat(F.lit("L"), text(n % 10))).otherwise(F.concat(F.lit("?"), text(n))))
    return feeds.resolve_routes(d.table("part").select(ref.alias("ref")), feed_routes(d))


@query("e10_municipality_inventory", """
WITH sa AS (SELECT i.poly_id AS area, 'f' || (t.id % 3) AS feed FROM v_dests t JOIN v_inside i ON i.x = t.x AND i.y = t.y),
fd AS (SELECT feed, feed <> 'f2' AS covers, feed = 'f0' AS rt, count(*) AS trips FROM v_trips GROUP BY feed),
a AS (SELECT area, coalesce(string_agg(DISTINCT feed, ',' ORDER BY feed) FILTER (covers), '') AS feeds, coalesce(string_agg(DISTINCT feed, ',' ORDER BY feed) FILTER (NOT covers), '') AS unc,
             count(DISTINCT feed) FILTER (covers) AS nf, count(*) AS ns, coalesce(max(trips) FILTER (covers), 0) AS mt, max(CASE WHEN covers AND rt THEN 1 ELSE 0 END) AS rt FROM sa JOIN fd USING (feed) GROUP BY area)
SELECT n_nationkey::BIGINT AS area, coalesce(feeds, '') AS feeds, coalesce(unc, '') AS feeds_uncovered, coalesce(nf, 0) AS n_feeds, coalesce(ns, 0) AS n_stops, coalesce(mt, 0) AS n_trips_max, coalesce(rt, 0) AS has_rt,
       CASE WHEN nf > 0 AND rt = 1 THEN 'static + realtime' WHEN nf > 0 THEN 'static' WHEN coalesce(unc, '') <> '' THEN 'static, date not covered' WHEN ns > 0 THEN 'served, no feed' ELSE 'no data' END AS class
FROM nation LEFT JOIN a ON area = n_nationkey""")
def municipality_inventory(d):
    areas = polygons(d).drop("category")
    stops = d.dests.select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("feed"), "x", "y")
    placed = spatial.points_in_polygons(stops, areas, cell=1000).select(F.col("poly_id").alias("area"), "feed")
    known = d.trips.groupBy("feed").agg(F.count("*").alias("trips")).select(
        "feed", (F.col("feed") != "f2").alias("covers"), (F.col("feed") == "f0").alias("has_rt"), "trips")
    return feeds.municipality_inventory(areas.select(F.col("poly_id").alias("area")), placed, known)


# --- lines --------------------------------------------------------------------------

def line_stops(d):
    mode = F.when(F.col("id") % 2 == 0, "tram").otherwise("bus")
    return d.dests.select(F.col("id").alias("stop_id"), "lon", "lat", "x", "y", mode.alias("mode"))


def line_times(d):
    return d.stop_times.select("trip_id", "seq", "stop_id", "arr", (F.col("arr") + 20).alias("dep"))


def line_trips(d):
    return d.trips.select("trip_id", "route_id", "direction_id")


_HAV = "2 * 6371008.8 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"
SQL_VIEWS["v_hops"] = f"""SELECT trip_id, seq, {_HAV.format(a='lat', b='lat2', c='lon', d='lon2')} AS metres FROM (
    SELECT trip_id, seq, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM v_line_times JOIN v_line_stops USING (stop_id) WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) WHERE lon2 IS NOT NULL"""
SQL_VIEWS["v_longest"] = """SELECT route_id, arg_min(trip_id, (-n * 1000000000 + trip_id)) AS trip_id FROM v_trips JOIN (SELECT trip_id, count(*) AS n FROM v_line_times GROUP BY trip_id) USING (trip_id) GROUP BY route_id"""
SQL_VIEWS["v_line_metrics"] = """
    SELECT r.route_id, coalesce(l.m, 0) / 1000 AS length_km, coalesce(v.m, 0) / 1000 AS vehicle_km, p.per_hour
    FROM (SELECT DISTINCT route_id FROM v_trips) r
    LEFT JOIN (SELECT route_id, sum(metres) AS m FROM v_longest JOIN v_hops USING (trip_id) GROUP BY route_id) l USING (route_id)
    LEFT JOIN (SELECT route_id, sum(metres) AS m FROM v_trips JOIN v_hops USING (trip_id) GROUP BY route_id) v USING (route_id)
    LEFT JOIN (SELECT route_id, count(*) FILTER (f >= 25200 AND f < 32400) / 2.0 AS per_hour FROM v_trips LEFT JOIN (SELECT trip_id, arg_min(dep, seq) AS f FROM v_line_times GROUP BY trip_id) USING (trip_id) GROUP BY route_id) p USING (route_id)"""


def line_calls(d):
    """Stop times with places, stored by trip: the one shuffle of single calls behind all line metrics."""
    return calls.store(line_times(d), stops=line_stops(d))


def line_metrics(d, stored):
    return calls.line_metrics(calls.trip_facts(stored), line_trips(d), lines.PEAK).fillna(0, subset=["length_km"])


@query("e11_e12_e13_line_metrics", """
SELECT route_id, round(length_km, 4) AS length_km, round(vehicle_km, 3) AS vehicle_km, per_hour::DOUBLE AS per_hour FROM v_line_metrics""")
def line_metrics_query(d):
    return line_metrics(d, line_calls(d)).select("route_id", F.round("length_km", 4).alias("length_km"), F.round("vehicle_km", 3).alias("vehicle_km"), "per_hour")


SQL_VIEWS["v_segs"] = f"""
    SELECT s.trip_id, seq, {_HAV.format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')} AS metres, arr2 - dep AS seconds, (a.lon + b.lon) / 2 AS mid_lon, (a.lat + b.lat) / 2 AS mid_lat
    FROM (SELECT *, lead(stop_id) OVER w AS stop2, lead(arr) OVER w AS arr2, first_value(dep) OVER w AS f FROM v_line_times WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) s
    JOIN v_line_stops a ON a.stop_id = s.stop_id JOIN v_line_stops b ON b.stop_id = s.stop2
    WHERE f >= 25200 AND f < 32400 AND arr2 - dep > 0 AND {_HAV.format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')} >= 50"""
SQL_VIEWS["v_centre"] = "SELECT sum(pop * lon) / sum(pop) AS clon, sum(pop * lat) / sum(pop) AS clat FROM v_people"


@query("e14_h02_segments", "SELECT trip_id, seq::BIGINT AS seq, round(metres, 3) AS metres, seconds::BIGINT AS seconds FROM v_segs")
def segments(d):
    return calls.segments(line_calls(d), peak=lines.PEAK).select("trip_id", "seq", F.round("metres", 3).alias("metres"), "seconds")


@query("g25_weighted_centroid", "SELECT round(clon, 8) AS lon, round(clat, 8) AS lat FROM v_centre")
def weighted_centroid(d):
    out = lines.weighted_centroid(d.people, "pop")
    return out.select(F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


SQL_VIEWS["v_profile"] = f"""
    SELECT r.route_id, CASE WHEN count(kmh) FILTER (away <= 2500) >= 20 THEN median(kmh) FILTER (away <= 2500) END AS inner_kmh,
           CASE WHEN count(kmh) FILTER (away > 4000) >= 20 THEN median(kmh) FILTER (away > 4000) END AS outer_kmh,
           median(metres) FILTER (away <= 2500) AS inner_spacing_m, median(metres) FILTER (away > 2500) AS outer_spacing_m
    FROM (SELECT DISTINCT route_id FROM v_trips) r LEFT JOIN (
      SELECT route_id, metres, metres / seconds * 3.6 AS kmh, {_HAV.format(a='mid_lat', b='clat', c='mid_lon', d='clon')} AS away
      FROM v_segs JOIN v_trips USING (trip_id) CROSS JOIN v_centre) USING (route_id) GROUP BY r.route_id"""


def speed_profile_df(d, stored):
    centre = lines.weighted_centroid(d.people, "pop")
    return lines.speed_profile(calls.segments(stored, peak=lines.PEAK), line_trips(d),
                               (centre.select("lon").scalar(), centre.select("lat").scalar()))


@query("e15_speed_profile", "SELECT route_id, " + ", ".join(
    f"round({c}, 4) AS {c}" for c in ("inner_kmh", "outer_kmh", "inner_spacing_m", "outer_spacing_m")) + " FROM v_profile")
def speed_profile(d):
    out = speed_profile_df(d, line_calls(d))
    return out.select("route_id", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


SQL_VIEWS["v_served"] = "SELECT DISTINCT route_id, stop_id FROM v_line_times JOIN v_trips USING (trip_id)"
_NEAR_POP = """(SELECT route_id, sum(pop) AS pop FROM (SELECT DISTINCT s.route_id, p.id, p.pop FROM {s} s JOIN v_line_stops t USING (stop_id)
    JOIN v_people p ON pow(p.x - t.x, 2) + pow(p.y - t.y, 2) <= 500 * 500) GROUP BY route_id)"""
SQL_VIEWS["v_line_pop"] = f"""
    SELECT r.route_id, coalesce(a.pop, 0)::BIGINT AS pop, coalesce(b.pop, 0)::BIGINT AS pop_exclusive
    FROM (SELECT DISTINCT route_id FROM v_trips) r LEFT JOIN {_NEAR_POP.format(s='v_served')} a USING (route_id)
    LEFT JOIN {_NEAR_POP.format(s='(SELECT * FROM v_served WHERE stop_id IN (SELECT stop_id FROM v_served GROUP BY stop_id HAVING count(*) <= 1))')} b USING (route_id)"""


def served(d, times=None):
    return lines.route_stops(times or line_times(d), line_trips(d))


def line_population(d, times=None):
    stops, near = line_stops(d), served(d, times)
    a = lines.population_near(near, stops, d.people)
    b = lines.population_near(lines.exclusive_stops(near), stops, d.people).withColumnRenamed("pop", "pop_exclusive")
    routes = line_trips(d).select("route_id").distinct()
    return routes.join(a, "route_id", "left").join(b, "route_id", "left").fillna(0)


@query("e16_line_population", "SELECT route_id, pop, pop_exclusive FROM v_line_pop")
def line_population_query(d):
    return line_population(d)


@query("e17_eligible_lines", """
SELECT route_id, count(*) AS trips FROM v_trips JOIN (SELECT DISTINCT route_id FROM v_feed_routes WHERE feed = 'f2' AND route_type IN ('0', '3')) USING (route_id)
LEFT JOIN (SELECT trip_id, count(*) AS stops FROM v_line_times GROUP BY trip_id) USING (trip_id) GROUP BY route_id HAVING count(*) >= 30 AND max(stops) > 1""")
def eligible_lines(d):
    return lines.eligible_lines(line_trips(d), feed_routes(d).where("feed = 'f2'"), line_times(d), ["0", "3"], 30)


SQL_VIEWS["v_ranked"] = """
    SELECT *, round((rank_pop + rank_vehicle_km) / 2.0, 1) AS score FROM (
      SELECT route_id, length_km, vehicle_km, pop, slowdown, (length_km >= p75)::INT AS meets_length, p75, row_number() OVER (ORDER BY pop DESC, route_id) AS rank_pop,
             row_number() OVER (ORDER BY vehicle_km DESC, route_id) AS rank_vehicle_km,
             CASE WHEN slowdown IS NOT NULL THEN row_number() OVER (PARTITION BY slowdown IS NULL ORDER BY slowdown DESC, route_id) END AS rank_slowdown
      FROM (SELECT m.route_id, length_km, vehicle_km, pop, outer_kmh - inner_kmh AS slowdown FROM v_line_metrics m JOIN v_line_pop USING (route_id) JOIN v_profile USING (route_id))
      CROSS JOIN (SELECT max(length_km) FILTER (i = floor(pos)) + (pos - floor(pos)) * (max(length_km) FILTER (i = ceil(pos)) - max(length_km) FILTER (i = floor(pos))) AS p75
                  FROM (SELECT length_km, row_number() OVER (ORDER BY length_km) - 1 AS i, 3 * (count(*) OVER () + 1) / 4.0 - 1 AS pos FROM v_line_metrics) GROUP BY pos))"""


def ranked_lines(d, stored):
    rows = (line_metrics(d, stored).join(line_population(d, stored), "route_id").join(speed_profile_df(d, stored), "route_id")
            .withColumn("slowdown", F.col("outer_kmh") - F.col("inner_kmh")))
    return lines.rank_lines(rows.select("route_id", "length_km", "vehicle_km", "pop", "slowdown"))


@query("e17_rank_lines", """
SELECT route_id, meets_length::BIGINT AS meets_length, round(p75, 4) AS p75, rank_pop, rank_vehicle_km, rank_slowdown, score::DOUBLE AS score FROM v_ranked""")
def rank_lines(d):
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return ranked_lines(d, line_calls(d)).select("route_id", long("meets_length"), F.round("p75", 4).alias("p75"), long("rank_pop"),
                                  long("rank_vehicle_km"), long("rank_slowdown"), "score")


@query("e18_corridor", """
WITH p AS (SELECT route_id AS pick FROM v_ranked WHERE meets_length = 1), m AS (SELECT pick, stop_id, count(*) OVER (PARTITION BY pick) AS k FROM p JOIN v_served ON route_id = pick)
SELECT pick, s.route_id, round(count(*) / any_value(k), 6) AS share FROM m JOIN v_served s ON s.stop_id = m.stop_id AND s.route_id <> pick GROUP BY ALL HAVING count(*) / any_value(k) >= 0.6""")
def corridor(d):
    stored = line_calls(d)
    picks = ranked_lines(d, stored).where("meets_length = 1")
    out = lines.corridor(picks, served(d, stored))
    return out.withColumn("share", F.round("share", 6))


@query("e18_corridor_of_all_lines", """
WITH s AS (SELECT DISTINCT o_custkey AS route_id, l_suppkey AS stop_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
m AS (SELECT route_id AS pick, stop_id, count(*) OVER (PARTITION BY route_id) AS k FROM s)
SELECT pick, s.route_id, round(count(*) / any_value(k), 6) AS share FROM m JOIN s ON s.stop_id = m.stop_id AND s.route_id <> pick GROUP BY ALL HAVING count(*) / any_value(k) >= 0.6""")
def corridor_of_all_lines(d):
    orders, items = d.table("orders"), d.table("lineitem")
    served = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("route_id"), F.col("l_suppkey").alias("stop_id"))
    every = orders.select(F.col("o_custkey").alias("route_id"))  # lines without stops hold nothing
    return lines.corridor(every, served).withColumn("share", F.round("share", 6))


_WALK = """w AS (SELECT o.id AS hex_id, t.stop_id, t.mode, round(sqrt(pow(o.x - t.x, 2) + pow(o.y - t.y, 2)), 3) AS d FROM v_origins o JOIN v_line_stops t ON pow(o.x - t.x, 2) + pow(o.y - t.y, 2) <= 1500 * 1500)"""


def hexes(d):
    return d.origins.select(F.col("id").alias("hex_id"), "x", "y")


def placed_stops(d):
    return line_stops(d).select("stop_id", "mode", F.col("x").alias("px"), F.col("y").alias("py"))


@query("e19_line_frequency", f"""
WITH {_WALK},
dep AS (SELECT stop_id, route_id, direction_id, count(*) FILTER (dep // 60 >= 420 AND dep // 60 < 540) / 2.0 AS morning, count(*) FILTER (dep // 60 >= 900 AND dep // 60 < 1080) / 3.0 AS afternoon
        FROM v_line_times JOIN v_trips USING (trip_id) GROUP BY ALL),
b AS (SELECT hex_id, route_id, direction_id, stop_id, row_number() OVER (PARTITION BY hex_id, route_id, direction_id ORDER BY d, stop_id) AS rn FROM w JOIN dep USING (stop_id) WHERE d <= 1000),
f AS (SELECT hex_id, mode, sum(morning) AS m, sum(afternoon) AS a FROM b JOIN dep USING (stop_id, route_id, direction_id) JOIN v_line_stops USING (stop_id) WHERE rn = 1 GROUP BY ALL)
SELECT o.id AS hex_id, k.mode, round(coalesce(m, 0), 2)::DOUBLE AS freq_morning, round(coalesce(a, 0), 2)::DOUBLE AS freq_afternoon
FROM v_origins o CROSS JOIN (SELECT DISTINCT mode FROM v_line_stops) k LEFT JOIN f ON f.hex_id = o.id AND f.mode = k.mode""")
def line_frequency(d):
    deps = line_times(d).join(line_trips(d), "trip_id").select("stop_id", "route_id", "direction_id", F.floor(F.col("dep") / 60).alias("minute"))
    return lines.line_frequency(hexes(d), placed_stops(d), deps, {"morning": (420, 540), "afternoon": (900, 1080)}, 1000)


@query("e20_nearest_per_mode", f"""
WITH {_WALK}, f AS (SELECT hex_id, min(d) FILTER (mode = 'tram') AS t, min(d) FILTER (mode = 'bus') AS b FROM w WHERE d <= 1200 GROUP BY hex_id),
g AS (SELECT DISTINCT o.id FROM v_origins o JOIN v_inside i ON i.x = o.x AND i.y = o.y AND i.category = 'mall')
SELECT o.id AS hex_id, CASE WHEN g.id IS NOT NULL THEN 0 ELSE t END AS d_tram_m, CASE WHEN g.id IS NOT NULL THEN 0 ELSE b END AS d_bus_m FROM v_origins o LEFT JOIN f ON hex_id = o.id LEFT JOIN g ON g.id = o.id""")
def nearest_per_mode(d):
    areas = polygons(d).where("category = 'mall'").drop("category")
    return lines.nearest_per_mode(hexes(d), placed_stops(d), ["tram", "bus"], 1200, spatial.points_in_polygons(hexes(d), areas, cell=1000))


@query("e21_realtime_coverage", """
WITH c AS (SELECT o.id, count(t.stop_id) AS n, count(*) FILTER (t.stop_id % 3 = 0) AS rt FROM v_origins o LEFT JOIN v_line_stops t ON pow(o.x - t.x, 2) + pow(o.y - t.y, 2) <= 1000 * 1000 GROUP BY o.id)
SELECT id, n, rt, CASE WHEN rt = 0 THEN 'none' WHEN rt = n THEN 'full' ELSE 'partial' END AS class FROM c""")
def realtime_coverage(d):
    stops = line_stops(d).select("stop_id", F.col("x").alias("px"), F.col("y").alias("py"))
    near = spatial.sum_within(d.origins.select("id", "x", "y"), stops, 1000, {
        "n": F.lit(1), "rt": F.when(F.col("stop_id") % 3 == 0, 1).otherwise(0)})
    return near.select("id", "n", "rt", lines.coverage_class(F.col("n"), F.col("rt")).alias("class"))


# --- street ways ----------------------------------------------------------------------

_SEG = """
ref AS (SELECT seg, quantile_cont(secs, 0.15) AS ref FROM v_obs GROUP BY seg),
win AS (SELECT seg, CASE WHEN minute >= 420 AND minute < 540 THEN 'morning' WHEN minute >= 900 AND minute < 1080 THEN 'afternoon' END AS w, secs FROM v_obs),
fac AS (SELECT seg, w, count(*) AS n, least(greatest(any_value(ref) / median(secs), 0.3), 1.0) AS factor FROM win JOIN ref USING (seg) WHERE w IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)"""
_WINDOWS = {"morning": (420, 540), "afternoon": (900, 1080)}


@query("e22_segment_factors", f"""WITH {_SEG.strip()} SELECT seg, w AS "window", n, round(factor, 6) AS factor FROM fac""")
def segment_factors(d):
    return lines.segment_factors(d.obs, _WINDOWS).withColumn("factor", F.round("factor", 6))


@query("e23_way_factors", "SELECT way_id, round(sum(factor * len) / sum(len), 6) AS factor FROM v_matches GROUP BY way_id")
def way_factors(d):
    return lines.way_factors(places.segments(d), places.streets(d), **places.MATCH).withColumn("factor", F.round("factor", 6))


@query("e24_fill_ways", """
WITH dir AS (SELECT way_id, sum(factor * len) / sum(len) AS factor FROM v_matches GROUP BY way_id),
ways AS (SELECT p_partkey AS way_id, CASE p_partkey % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'track' END AS grp, (p_partkey * 7919 % 1000) * 30 AS x, (p_partkey * 104729 % 1000) * 30 AS y FROM part),
have AS (SELECT * FROM ways JOIN dir USING (way_id) WHERE grp <> 'track'), dd AS (SELECT way_id, factor FROM have),
loc AS (SELECT w.way_id, median(h.factor) AS f FROM ways w JOIN have h ON h.grp = w.grp AND pow(h.x - w.x, 2) + pow(h.y - w.y, 2) <= 2000 * 2000 WHERE w.way_id NOT IN (SELECT way_id FROM dd) GROUP BY w.way_id),
cls AS (SELECT grp, median(factor) AS f FROM have GROUP BY grp)
SELECT w.way_id, round(coalesce(dd.factor, loc.f, cls.f, 1.0), 6) AS factor, CASE WHEN dd.factor IS NOT NULL THEN 'direct' WHEN loc.f IS NOT NULL THEN 'radius' ELSE 'class' END AS source
FROM ways w LEFT JOIN dd USING (way_id) LEFT JOIN loc USING (way_id) LEFT JOIN cls USING (grp)""")
def fill_ways(d):
    k = F.col("p_partkey")
    ways = d.table("part").select(k.alias("way_id"), F.when(k % 3 == 0, "major").when(k % 3 == 1, "minor").otherwise("track").alias("grp"),
                                  (k * 7919 % 1000 * 30).alias("x"), (k * 104729 % 1000 * 30).alias("y"))
    direct = lines.way_factors(places.segments(d), places.streets(d).where("way_id % 3 <> 2"), **places.MATCH)
    return lines.fill_ways(ways, direct, 2000).withColumn("factor", F.round("factor", 6))


@query("e25_base_speed", """
SELECT tag, count(*) AS n, round(any_value(CASE WHEN v BETWEEN 5 AND 140 THEN v ELSE 50 END), 3) AS kmh FROM (
  SELECT tag, try_cast(regexp_extract(tag, '^\\s*(\\d+)\\s*(mph)?\\s*$', 1) AS DOUBLE) * CASE WHEN regexp_extract(tag, '^\\s*(\\d+)\\s*(mph)?\\s*$', 2) = 'mph' THEN 1.609 ELSE 1 END AS v
  FROM (SELECT CASE p_size % 4 WHEN 0 THEN (p_size * 3)::VARCHAR WHEN 1 THEN p_size || ' mph' WHEN 2 THEN 'walk' ELSE ' ' || (p_size * 10) || ' ' END AS tag FROM part)) GROUP BY tag""")
def base_speed(d):
    n = F.col("p_size")
    text = lambda c: c.cast("string")
    tag = (F.when(n % 4 == 0, text(n * 3)).when(n % 4 == 1, F.concat(text(n), F.lit(" mph"))).when(n % 4 == 2, "walk")
           .otherwise(F.concat(F.lit(" "), text(n * 10), F.lit(" "))))
    tagged = d.table("part").select(tag.alias("tag"))
    return tagged.groupBy("tag").agg(F.count("*").alias("n")).select(
        "tag", "n", F.round(values.base_speed(F.col("tag"), F.lit(50.0)), 3).alias("kmh"))
