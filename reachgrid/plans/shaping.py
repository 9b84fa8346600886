"""Source, sink and scalar queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reachgrid.functions import values
from reachgrid.functions.scale import running_totals
from reachgrid.operators import access
from reachgrid.plans.registry import query
from reachgrid.plans.views import CATEGORIES, SERVICES, SQL_VIEWS
from reachgrid.session import checkpoint_folder
from reachgrid.sources import archives, catalogue, feeds, tables


def _text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# --- points and matrices ------------------------------------------------------------------------

@query("a02_points_with_extras", """
SELECT lpad((row_number() OVER (ORDER BY c_custkey) - 1)::VARCHAR, length((count(*) OVER () - 1)::VARCHAR)::INTEGER, '0') AS id, lon, lat, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_acctbal END::DOUBLE AS score
FROM customer JOIN v_origins ON id = c_custkey WHERE c_custkey % 9 <> 0""")
def points_with_extras(d):
    k = F.col("id")
    raw = d.origins.join(d.table("customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "id").select(
        "id", F.when(k % 9 != 0, F.col("lon")).alias("lon"), "lat", F.when(k % 4 == 0, "").otherwise(_text("c_acctbal")).alias("score"))
    return tables.points(raw, id_field=None, extras=["score"], order=["id"])


@query("a02_id_problems", """
SELECT id, n, CASE WHEN n > 1 THEN 'duplicate' ELSE 'unsafe character' END AS problem FROM (
  SELECT CASE WHEN p_partkey % 500 = 0 THEN p_name || ',' || p_partkey WHEN p_partkey % 7 = 0 THEN p_name ELSE 'p' || p_partkey END AS id, count(*) AS n FROM part GROUP BY 1) WHERE n > 1 OR contains(id, ',')""")
def id_problems(d):
    k = F.col("p_partkey")
    ids = F.when(k % 500 == 0, F.concat_ws(",", "p_name", _text(k))).when(k % 7 == 0, F.col("p_name")).otherwise(F.concat(F.lit("p"), _text(k)))
    return tables.id_problems(d.table("part").select(ids.alias("id")))


@query("a07_opportunities_long", """
SELECT s_suppkey AS to_id, 'beds' AS opportunity, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_acctbal END::DOUBLE AS value FROM supplier
UNION ALL SELECT s_suppkey, 'desks', s_nationkey FROM supplier""")
def opportunities_long(d):
    """Text columns with blanks; the requested field 'rooms' does not exist and is left out."""
    raw = d.table("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(_text("s_acctbal")).alias("beds"),
                                     _text("s_nationkey").alias("desks"))
    return access.opportunities_long(raw, ["beds", "rooms", "desks"])


_WIDE = ", ".join(f"coalesce(max(acc) FILTER (opportunity = '{s}' AND cutoff = {c}), 0)::BIGINT AS acc_{s}_p50_c{c}" for s in SERVICES for c in (30, 60))


@query("a09_a10_wide_layer", f"SELECT c_custkey AS id, {_WIDE}, 'TRANSIT' AS modes, '2026-01-25' AS run_date FROM customer LEFT JOIN v_static ON id = c_custkey AND id % 10 <> 0 GROUP BY c_custkey")
def wide_layer(d):
    long = d.acc.where("case_id = 'base' and id % 10 <> 0").select("id", "opportunity", F.lit(50).alias("percentile"), "cutoff", F.col("acc").alias("accessibility"))
    out = access.accessibility_wide(long, d.table("customer").select(F.col("c_custkey").alias("id")), SERVICES, [50], [30, 60])
    return tables.with_method(out, {"modes": "TRANSIT", "run_date": "2026-01-25"})


@query("c22_wide_with_attributes", "SELECT id, " + ", ".join(
    f"max(acc) FILTER (opportunity = '{s}' AND cutoff = 30) AS {s}_30min" for s in SERVICES) + """, any_value(c_acctbal) AS income, any_value(c_mktsegment) AS segment
FROM v_static LEFT JOIN customer ON c_custkey = id AND c_custkey % 7 <> 0 GROUP BY id""")
def wide_with_attributes(d):
    wide = d.acc.where("case_id = 'base' and cutoff = 30").groupBy("id").pivot("opportunity", list(SERVICES)).agg(F.first("acc"))
    ses = d.table("customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("income"), F.col("c_mktsegment").alias("segment"))
    return wide.select("id", *[F.col(s).alias(f"{s}_30min") for s in SERVICES]).join(ses, "id", "left")


_LINE = "printf('LINESTRING(%.4f %.4f, %.4f %.4f)', o.lon, o.lat, t.lon, t.lat)"


@query("a03_a11_od_lines", """
SELECT m.from_id, m.to_id, tt::DOUBLE AS travel_time, '50' AS percentile, round(o.lon, 6) AS lon1, round(t.lat, 6) AS lat2
FROM v_matrix m JOIN v_origins o ON o.id = m.from_id JOIN v_dests t ON t.id = m.to_id WHERE m.from_id % 5 <> 0""")
def od_lines(d):
    """The line's text is taken apart again, because the engines print numbers differently."""
    pairs = d.matrix.withColumn("travel_time", F.col("minutes").cast("double"))
    out = tables.od_lines(pairs, d.origins.where("id % 5 <> 0"), d.dests, ["travel_time"], {"percentile": "50"})
    part = lambda i: F.round(F.regexp_extract("wkt", r"LINESTRING\((\S+) (\S+), (\S+) (\S+)\)", i).cast("double"), 6)
    return out.select("from_id", "to_id", "travel_time", "percentile", part(1).alias("lon1"), part(4).alias("lat2"))


@query("a12_service_lines", """
SELECT from_id, to_id, coalesce(svc_min_c15, 0)::BIGINT AS svc_min_c15, svc_min_c45::BIGINT AS svc_min_c45, round(o.lat, 6) AS lat1
FROM (SELECT from_id, to_id, nullif(count(*) FILTER (tt <= 15), 0) AS svc_min_c15, count(*) FILTER (tt <= 45) AS svc_min_c45 FROM v_departures GROUP BY ALL HAVING count(*) FILTER (tt <= 45) > 0) JOIN v_origins o ON o.id = from_id JOIN v_dests t ON t.id = to_id""")
def service_lines(d):
    minutes = access.service_minutes(d.departures, [15, 45])
    gaps = minutes.withColumn("svc_min_c15", F.nullif(F.col("svc_min_c15"), F.lit(0)))
    out = tables.service_lines(gaps, d.origins, d.dests, [15, 45])
    lat = F.round(F.regexp_extract("wkt", r"LINESTRING\((\S+) (\S+), ", 2).cast("double"), 6)
    return out.select("from_id", "to_id", "svc_min_c15", "svc_min_c45", lat.alias("lat1"))


@query("a06_merge_batches", "SELECT from_id, to_id, tt::BIGINT AS minutes FROM v_matrix")
def merge_batches(d):
    """Three batches of origins back into one matrix."""
    batches = [d.matrix.where(F.col("from_id") % 3 == i) for i in range(3)]
    return tables.merge_batches(batches).withColumn("minutes", F.col("minutes").cast("bigint"))


@query("a01_feed_table", """
SELECT 'f' || (o_orderkey % 3) AS feed, o_orderkey::VARCHAR AS trip_id, o_orderpriority AS service_id, CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey % 40)::VARCHAR END AS route_id, NULL::VARCHAR AS shape_id FROM orders WHERE o_orderkey % 3 < 2""")
def feed_table(d):
    """Decoded archive rows: padded cells, a feed without the route column, another file in between."""
    k = F.col("o_orderkey")
    cells = F.create_map(F.lit("service_id"), F.concat(F.lit(" "), "o_orderpriority"), F.lit("trip_id"), F.concat(_text(k), F.lit(" ")))
    route = F.create_map(F.lit("route_id"), _text(F.col("o_custkey") % 40))
    rows = d.table("orders").select(F.concat(F.lit("f"), _text(k % 3)).alias("feed"), F.when(k % 3 < 2, "trips.txt").otherwise("stops.txt").alias("file"),
                                    (k + 1).alias("row_no"), F.when(k % 3 > 0, F.map_concat(cells, route)).otherwise(cells).alias("fields"))
    return feeds.feed_table(rows, "trips.txt", ["trip_id", "service_id", "route_id", "shape_id"]).drop("row_no")


@query("a01_archive_scan", """
SELECT o_orderkey::VARCHAR AS trip_id, 'L ' || o_custkey % 40 || ', "' || o_orderpriority || '"' AS name, CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus ELSE '' END AS service_id,
       NULL::VARCHAR AS shape_id FROM orders""")
def archive_scan(d):
    """Trips written to archives, one for each partition, and read back from them as one table."""
    k = F.col("o_orderkey")
    trips = d.table("orders").select(_text(k).alias(" Trip_ID "), F.concat(F.lit(" L "), _text(F.col("o_custkey") % 40), F.lit(', "'), "o_orderpriority", F.lit('"')).alias("name"),
                                     F.when(k % 7 > 0, F.concat("o_orderstatus", F.lit("  "))).otherwise("").alias("service_id"))
    folder = f"{checkpoint_folder(d.spark)}/feeds-{uuid.uuid4().hex}"
    archives.write_feeds(trips, folder, "trips.txt")
    rows = feeds.read_table(d.spark, folder, "trips.txt", ["trip_id", "name", "service_id", "shape_id"])
    return rows.select("trip_id", "name", "service_id", "shape_id")


@query("b01_b02_b04_checked_access", """
SELECT o.id, p.percentile, c.cutoff, count(m.to_id) AS accessibility FROM v_origins o CROSS JOIN (VALUES (50), (85)) p(percentile) CROSS JOIN (VALUES (30), (60)) c(cutoff)
LEFT JOIN (SELECT from_id, to_id, percentile, tt FROM v_matrix_long JOIN v_dests ON id = to_id WHERE category = 'mall' AND tt <= 60) m ON m.from_id = o.id AND m.percentile = p.percentile AND m.tt < c.cutoff GROUP BY ALL""")
def checked_access(d):
    """Arguments as a user types them: percentiles as text, cutoffs unsorted, the trip cap raised to the largest cutoff."""
    percentiles, cutoffs = values.parse_percentiles("50, 85"), values.check_cutoffs([60, 30, 30])
    cap = values.trip_cap(45, cutoffs)
    values.require_columns(d.matrix_wide, [f"travel_time_p{p}" for p in percentiles], "matrix")
    long = access.matrix_long(d.matrix_wide).where(F.col("minutes") <= cap)
    malls = d.opps.where("opportunity = 'srv_mall'")
    out = access.accessibility(long, malls, d.table("customer").select(F.col("c_custkey").alias("id")), ["srv_mall"], percentiles, cutoffs)
    return out.select("id", "percentile", "cutoff", F.col("accessibility").cast("bigint").alias("accessibility"))


# --- catalogue -----------------------------------------------------------------------------------

SQL_VIEWS["v_catalogue"] = """
    SELECT n_name AS city, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'City ' || n_nationkey END AS display_name, strftime(o_orderdate, '%Y-%m-%d') AS date,
           CASE WHEN o_orderkey % 5 = 0 THEN 'ok' ELSE o_orderstatus END AS status, v.variant, CASE v.variant WHEN 'p50' THEN 'u' || o_orderkey WHEN 'p85' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'v' || o_orderkey END END AS url
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey CROSS JOIN (VALUES ('p50'), ('p85'), ('static_gtfs')) v(variant)"""


def manifests(d):
    """One manifest text per order: its customer's nation is the city, its date the recorded day."""
    k = F.col("o_orderkey")
    nation = d.table("nation").select("n_nationkey", "n_name")
    rows = d.table("orders").join(d.table("customer"), F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit('"display_name": "City '), _text("n_nationkey"), F.lit('", '))).otherwise("")
    status = F.when(k % 5 != 0, F.concat(F.lit('"status": "'), "o_orderstatus", F.lit('", '))).otherwise("")
    second = F.when(k % 2 == 0, F.concat(F.lit(', "p85": "v'), _text(k), F.lit('"'))).otherwise("")
    body = F.concat(F.lit('{"cities": {"'), "n_name", F.lit('": {'), name, F.lit('"days": [{"date": "'), F.date_format("o_orderdate", "yyyy-MM-dd"),
                    F.lit('", '), status, F.lit('"assets": {"p50": "u'), _text(k), F.lit('"'), second, F.lit("}}]}}}"))
    return rows.select(body.alias("body"))


@query("a15_catalogue_slim", "SELECT * FROM v_catalogue")
def catalogue_slim(d):
    return catalogue.slim(manifests(d))


@query("a16_catalogue_lists", """
SELECT 'city' AS kind, city AS a, display_name AS b FROM v_catalogue GROUP BY ALL UNION ALL SELECT 'month', substr(date, 1, 7), NULL FROM v_catalogue WHERE city = 'NATION_7' GROUP BY ALL
UNION ALL SELECT 'day', date, status FROM v_catalogue WHERE city = 'NATION_7' AND date LIKE '1997-03%' GROUP BY ALL""")
def catalogue_lists(d):
    flat = catalogue.slim(manifests(d))
    a = catalogue.cities(flat).select(F.lit("city").alias("kind"), F.col("city").alias("a"), F.col("display_name").alias("b"))
    b = catalogue.months(flat, "NATION_7").select(F.lit("month").alias("kind"), F.col("month").alias("a"), F.lit(None).cast("string").alias("b"))
    c = catalogue.days(flat, "NATION_7", "1997-03").select(F.lit("day").alias("kind"), F.col("date").alias("a"), F.col("status").alias("b"))
    return a.unionByName(b).unionByName(c)


@query("a17_resolve_asset", """
WITH n AS (SELECT date, max(url) AS url, abs(date::DATE - DATE '2004-02-29')::BIGINT AS gap FROM v_catalogue WHERE city = 'NATION_3' AND variant = 'p85' GROUP BY date ORDER BY gap, date LIMIT 3)
SELECT date, gap, url FROM n WHERE gap = 0 OR (SELECT min(gap) FROM n) > 0""")
def resolve_asset(d):
    out = catalogue.resolve(catalogue.slim(manifests(d)), "NATION_3", "2004-02-29", "p85")
    return out.withColumn("gap", F.col("gap").cast("bigint"))


@query("a18_missing_files", """
WITH f AS (SELECT DISTINCT o_custkey AS feed, CASE o_orderkey % 8 WHEN 0 THEN 'agency.txt' WHEN 1 THEN 'stops.txt' WHEN 2 THEN 'routes.txt' WHEN 3 THEN 'trips.txt' WHEN 4 THEN 'stop_times.txt' WHEN 5 THEN 'calendar.txt' WHEN 6 THEN 'calendar_dates.txt' ELSE 'readme.md' END AS file FROM orders)
SELECT feed, concat_ws(',', """ + ", ".join(f"CASE WHEN count(*) FILTER (file = '{f}') = 0 THEN '{f}' END" for f in catalogue.FEED_FILES)
       + ", CASE WHEN count(*) FILTER (file LIKE 'calendar%') = 0 THEN 'calendar.txt or calendar_dates.txt' END) AS missing FROM f GROUP BY feed")
def missing_files(d):
    names = F.array(*[F.lit(f) for f in (*catalogue.FEED_FILES, *catalogue.CALENDAR_FILES, "readme.md")])
    files = d.table("orders").select(F.col("o_custkey").alias("feed"), F.get(names, (F.col("o_orderkey") % 8).cast("int")).alias("file"))
    out = catalogue.missing_files(files)
    return out.select("feed", F.array_join("missing", ",").alias("missing"))


# --- observations, exports, logs, votes ------------------------------------------------------------

@query("a19_usable_observations", """
SELECT user_id % 30 AS a, user_id % 31 AS b, value AS secs, (hour(ts) * 60 + minute(ts))::BIGINT AS minute, strftime(ts, '%Y-%m-%d') AS day
FROM events WHERE event_type <> 'error' AND value > 0 AND 3000 / value <= 90 AND user_id % 12 < 7""")
def usable_observations(d):
    u = F.col("user_id")
    raw = d.table("events").select(
        (u % 30).alias("from_stop_id"), (u % 31).alias("stop_id"), (u % 12).alias("route_id"), F.when(F.col("event_type") == "error", "gap").otherwise("ok").alias("seg_status"),
        F.col("value").alias("seg_time_s"), F.when(F.col("value") > 0, 3000 / F.col("value")).otherwise(0.0).alias("seg_speed_kmh"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("obs_local"))
    buses = d.table("events").select((u % 12).alias("route_id")).where("route_id < 7")
    out = tables.usable_observations(raw, buses)
    return out.withColumn("minute", F.col("minute").cast("bigint"))


@query("a21_ordered_arrays", "SELECT case_id, cutoff, opportunity, id // 500 AS part, '[' || string_agg(acc::VARCHAR, ',' ORDER BY id) || ']' AS values FROM v_acc GROUP BY ALL")
def ordered_arrays(d):
    return tables.ordered_arrays(d.acc, ["case_id", "cutoff", "opportunity"], "id", "acc", chunk=500)


@query("a22_features", """
SELECT '{"type":"Feature","properties":{"id":' || id || ',"district":' || CASE WHEN id % 6 = 0 THEN 'null' ELSE '"' || district || '"' END || ',"pop":' || pop || '},"geometry":{"type":"Point","coordinates":[' || x || ',' || y || ']}}' AS value FROM v_origins""")
def features(d):
    rows = d.origins.withColumn("district", F.when(F.col("id") % 6 != 0, F.col("district")))
    return tables.features(rows, ["id", "district", "pop"], F.array("x", "y"))


@query("a23_web_order", "SELECT case_id AS month, opportunity AS meta, cutoff AS hour, id AS hex_id, acc AS n FROM v_acc")
def web_order(d):
    cube = d.acc.select(F.col("case_id").alias("month"), F.col("opportunity").alias("meta"), F.col("cutoff").alias("hour"), F.col("id").alias("hex_id"), F.col("acc").alias("n"))
    return tables.web_order(cube)


@query("a24_run_costs", """
WITH e AS (SELECT user_id % 40 AS f, event_id, event_type, value FROM events),
s AS (SELECT f, count(*) FILTER (event_type <> 'click') AS done, sum(floor(value)) FILTER (event_type <> 'click') AS secs, max(100 + event_id % 900) FILTER (event_type = 'click') AS origins FROM e GROUP BY f)
SELECT 'run' || f AS file, origins, done AS steps_done, 170::BIGINT AS steps_total, secs::DOUBLE AS elapsed_s, round(secs / (origins * done), 8) AS s_per_origin_hour, round((170 - done) * secs / done, 4) AS eta_s, (170 - done <= 0)::INT::BIGINT AS complete
FROM s WHERE origins IS NOT NULL AND done > 0""")
def run_costs(d):
    k = F.col("event_id")
    step = F.concat(F.lit("["), F.lpad(_text(k % 17), 3, " "), F.lit("/170] 07:00 -> "), _text(k), F.lit(" features in "), _text(F.floor("value")), F.lit(" s"))
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("origins: "), _text(100 + k % 900))).otherwise(step)
    logs = d.table("events").select(F.concat(F.lit("run"), _text(F.col("user_id") % 40)).alias("file"), line.alias("value"))
    out = tables.run_costs(logs)
    return out.select("file", "origins", "steps_done", F.col("steps_total").cast("bigint").alias("steps_total"), "elapsed_s",
                      F.round("s_per_origin_hour", 8).alias("s_per_origin_hour"), F.round("eta_s", 4).alias("eta_s"), F.col("complete").cast("bigint").alias("complete"))


@query("a25_vote_rows", """
SELECT o_orderkey::VARCHAR AS precinct, (o_custkey % 50)::BIGINT AS valid_votes, c.committee, CASE c.committee WHEN 'A' THEN CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey % 20 END ELSE o_orderkey % 30 END::BIGINT AS votes
FROM orders CROSS JOIN (VALUES ('A'), ('B')) c(committee) WHERE o_custkey % 50 > 0""")
def vote_rows(d):
    """Columns are addressed by position: precinct 0, valid votes 2, committees 3 and 4."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = d.table("orders").select(_text(k).alias("nr"), "o_orderstatus", _text(c % 50).alias("v"), F.when(k % 4 == 0, " ").otherwise(_text(c % 20)).alias("k1"), _text(k % 30).alias("k2"))
    out = tables.vote_rows(raw, precinct=0, valid=2, committees={3: "A", 4: "B"})
    return out.select("precinct", F.col("valid_votes").cast("bigint").alias("valid_votes"), "committee", F.col("votes").cast("bigint").alias("votes"))


# --- predicates and columns ---------------------------------------------------------------------------

@query("b03_submode_label", """
SELECT label, count(*) AS n FROM (SELECT CASE WHEN p_size % 5 = 0 THEN 'N/A' WHEN p_size % 5 = 1 THEN 'ALL' WHEN p_size % 5 = 2 THEN 'TRAM,BUS' WHEN p_size % 5 = 3 THEN 'RAIL' ELSE 'SUBWAY,FERRY' END AS label FROM part) GROUP BY label""")
def submode_label(d):
    n = F.col("p_size") % 5
    pick = lambda *m: F.array(*[F.lit(x) for x in m])
    chosen = F.when(n == 1, pick()).when(n == 2, pick("BUS", "TRAM")).when(n == 3, pick("RAIL", "HOVERCRAFT")).otherwise(pick("FERRY", "SUBWAY"))
    return d.table("part").groupBy(values.submodes(chosen, n != 0).alias("label")).agg(F.count("*").alias("n"))


@query("b12_tag_categories", """
SELECT p_partkey AS id, 'shop' AS category FROM part WHERE p_type = 'ECONOMY' OR p_brand IN ('Brand#1', 'Brand#2') UNION ALL SELECT p_partkey, 'office' FROM part WHERE p_type = 'STANDARD' OR p_brand = 'Brand#2'""")
def tag_categories(d):
    items = d.table("part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("kind"), F.col("p_type"), F.lit("brand"), F.col("p_brand")).alias("tags"))
    rules = d.spark.createDataFrame([("shop", "kind", "ECONOMY"), ("shop", "brand", "Brand#1"), ("shop", "brand", "Brand#2"),
                                     ("office", "kind", "STANDARD"), ("office", "brand", "Brand#2")], "category string, key string, value string")
    return tables.tag_categories(items, rules)


@query("b13_b14_one_hot", "SELECT id, lon, lat, " + ", ".join(f"(category = '{c}')::INT::BIGINT AS opp{i}" for i, c in enumerate(CATEGORIES)) + ", 1::BIGINT AS total FROM v_dests")
def one_hot(d):
    """Slug columns per category; the helper columns with the suffix _raw are dropped again."""
    hot = [c.cast("bigint") for c in values.one_hot(F.col("category"), CATEGORIES)]
    names = [f"opp{i}" for i in range(len(CATEGORIES))] + ["total"]
    wide = d.dests.select("id", "lon", "lat", F.col("category").alias("category_raw"), *[c.alias(n) for c, n in zip(hot, names)])
    return tables.drop_suffix(wide, "_raw")


# --- scalars, sorts and sets ---------------------------------------------------------------------------

@query("h01_running_population", """
SELECT opportunity, acc, pop, sum(pop) OVER (PARTITION BY opportunity ORDER BY acc)::BIGINT AS running, sum(pop) OVER (PARTITION BY opportunity)::BIGINT AS total
FROM (SELECT opportunity, acc, sum(pop)::BIGINT AS pop FROM v_static30 JOIN v_people USING (id) GROUP BY ALL)""")
def running_population(d):
    held = (d.acc.where("case_id = 'base' and cutoff = 30").join(d.people.select("id", "pop"), "id")
            .groupBy("opportunity", "acc").agg(F.sum("pop").alias("pop")))
    return running_totals(held, ["opportunity"], "acc", {"running": F.col("pop")}).withColumnRenamed("running_all", "total")


@query("h03_average_ranks", """
SELECT c_mktsegment AS segment, c_custkey AS id, row_number() OVER w1 AS rn, rank() OVER w2 AS rk, rank() OVER w2 + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0::DOUBLE AS avg_rank
FROM customer WINDOW w1 AS (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey), w2 AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)""")
def average_ranks(d):
    """Ranks from counts per value: rows before the value, plus the place among its ties by id."""
    people = d.table("customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("v"))
    ties = running_totals(people.groupBy("segment", "v").agg(F.count("*").alias("k")), ["segment"], "v", {"upto": F.col("k")}, small_domain=True)
    placed = running_totals(people, ["segment", "v"], "id", {"place": F.lit(1)}).drop("place_all")
    out = placed.join(ties, ["segment", "v"])
    before = F.col("upto") - F.col("k")
    return out.select("segment", "id", (before + F.col("place")).alias("rn"), (before + 1).alias("rk"), (before + (F.col("k") + 1) / 2).alias("avg_rank"))


@query("h05_systematic_sample", """
WITH n AS (SELECT count(*) AS n FROM orders), i AS (SELECT DISTINCT round_even(k * (n - 1) / 14.0, 0)::BIGINT AS idx FROM n, (SELECT unnest(range(0, 15)) AS k))
SELECT o.o_orderkey, o.idx FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx FROM orders) o JOIN i USING (idx)""")
def systematic_sample(d):
    return tables.systematic_sample(d.table("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "idx")


@query("h06_top_orders", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(d):
    return d.table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus").orderBy(F.desc("o_orderstatus"), F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("h07_set_operations", """
WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'one', count(*) FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))
UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def set_operations(d):
    """Ids in both sets, in exactly one, in any — from one pass that marks membership."""
    a, b = F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"
    seen = d.table("lineitem").groupBy("l_orderkey").agg(F.max(a.cast("int")).alias("a"), F.max(b.cast("int")).alias("b")).where("a + b > 0")
    kinds = F.filter(F.array(F.lit("any"), F.when((F.col("a") == 1) & (F.col("b") == 1), "both").otherwise("one")), lambda k: k.isNotNull())
    return seen.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("h11_clock_seconds", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + o_custkey % 60 END::BIGINT AS secs, ((o_orderkey % 30) * 60 + o_orderkey % 60)::BIGINT AS minutes FROM orders""")
def clock_seconds(d):
    k = F.col("o_orderkey")
    short = F.concat_ws(":", _text(k % 30), _text(k % 60))
    clock = F.when(k % 11 == 0, short).otherwise(F.concat_ws(":", short, F.lpad(_text(F.col("o_custkey") % 60), 2, "0")))
    return d.table("orders").select(k.alias("id"), values.clock_seconds(clock).cast("bigint").alias("secs"), values.clock_minutes(clock).cast("bigint").alias("minutes"))


@query("h12_feed_dates", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (isodow(o_orderdate) IN (1, 3, 5))::INT END::BIGINT AS runs FROM orders""")
def feed_dates(d):
    text = F.when(F.col("o_orderkey") % 10 == 0, "2026013").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    rows = d.table("orders").select(F.col("o_orderkey").alias("id"), values.feed_date(text).alias("day"))
    flags = F.array(*[F.lit(f) for f in (1, 0, 1, 0, 1, 0, 0)])
    return rows.select("id", F.col("day").cast("string").alias("date"), values.weekday_flag(F.col("day"), flags).cast("bigint").alias("runs"))


@query("h13_route_list", """
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size = p_partkey % 50 THEN p_size::VARCHAR || '|Z' ELSE p_size || '|' || (p_partkey % 50) || '|Z' END AS routes FROM part""")
def route_list(d):
    a, b = _text("p_size"), _text(F.col("p_partkey") % 50)
    text = F.when(F.col("p_size") % 3 == 0, " ;, ").otherwise(F.concat(a, F.lit(", "), b, F.lit(";Z  "), a))
    return d.table("part").select(F.col("p_partkey").alias("id"), F.array_join(values.route_list(text), "|").alias("routes"))


@query("h17_park_points", "SELECT p_partkey AS id, least(12, greatest(4, round_even(sqrt(p_retailprice) / 3, 0)))::BIGINT AS points FROM part")
def park_points(d):
    return d.table("part").select(F.col("p_partkey").alias("id"), values.park_points(F.col("p_retailprice")).cast("bigint").alias("points"))
