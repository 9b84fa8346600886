"""Origin-destination cube queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachgrid.operators import cubes, spatial
from reachgrid.plans.impact import _r
from reachgrid.plans.registry import query
from reachgrid.plans.views import CATEGORIES, DAYS, SQL_VIEWS

LEVELS = (15, 30, 45)
SQL_VIEWS["v_counts"] = """
    SELECT k.day, o.id, t.category AS type, l.level, least(coalesce(a.n, 0), 3)::BIGINT AS n
    FROM v_origins o CROSS JOIN (VALUES (0), (1), (2)) k(day) CROSS JOIN (VALUES ('school'), ('pharmacy'), ('university'), ('mall')) t(category) CROSS JOIN (VALUES (15), (30), (45)) l(level)
    LEFT JOIN (SELECT day, from_id, category, level, count(*) AS n FROM v_day_long JOIN v_dests ON id = to_id CROSS JOIN (VALUES (15), (30), (45)) l(level) WHERE tt <= level GROUP BY ALL) a
      ON a.day = k.day AND a.from_id = o.id AND a.category = t.category AND a.level = l.level"""
SQL_VIEWS["v_meta"] = "SELECT * FROM (VALUES ('school', 'learning'), ('university', 'learning'), ('pharmacy', 'health'), ('mall', 'shops')) t(type, meta)"


def day_long(d):
    times = d.pair_rows.groupBy(F.col("o_custkey").alias("from_id"), F.col("l_suppkey").alias("to_id")).agg(
        *[d._capped(F.col("l_linenumber") % 3 != x).alias(f"d{x}") for x in DAYS])
    rows = F.array(*[F.struct(F.lit(x).alias("day"), F.col(f"d{x}").alias("minutes")) for x in DAYS])
    return times.select("from_id", "to_id", F.inline(rows))


def counts(d):
    types = d.dests.select(F.col("id").alias("to_id"), F.col("category").alias("type"))
    cells = d.table("customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(*[F.lit(x) for x in DAYS])).alias("day"))
    return cubes.facility_counts(day_long(d), types, cells, CATEGORIES, LEVELS, by=["day"], clip=3)


def meta(d):
    return d.spark.createDataFrame([("school", "learning"), ("university", "learning"), ("pharmacy", "health"), ("mall", "shops")], "type string, meta string")


@query("g01_facility_counts", "SELECT day, id, type, level, n FROM v_counts")
def facility_counts(d):
    return counts(d)


@query("g02_meta_counts", "SELECT day, id, level, meta, least(sum(n), 5)::BIGINT AS n FROM v_counts JOIN v_meta USING (type) GROUP BY ALL")
def meta_counts(d):
    return cubes.meta_counts(counts(d), meta(d), ["day", "id", "level"], clip=5)


@query("g03_median_over_days", "SELECT id, type, level, count(*) AS days, median(n)::BIGINT AS n FROM v_counts GROUP BY ALL")
def median_over_days(d):
    return cubes.median_over_days(counts(d), ["id", "type", "level"])


@query("g04_median_time", """
SELECT from_id, to_id, m::BIGINT AS minutes FROM (SELECT from_id, to_id, list_sort([coalesce(d0, 255), coalesce(d1, 255), coalesce(d2, 255)])[2] AS m FROM v_day_times) WHERE m < 255""")
def median_time(d):
    return cubes.median_time(day_long(d), 3).withColumn("minutes", F.col("minutes").cast("bigint"))


@query("g05_day_spread", """
WITH a AS (SELECT d0, d1, d2, list_sort([d0, d1, d2])[2] AS m FROM v_day_times WHERE d0 IS NOT NULL AND d1 IS NOT NULL AND d2 IS NOT NULL),
s AS (SELECT count(*) AS pairs, avg((greatest(d0, d1, d2) - least(d0, d1, d2) > 10)::INT) AS sh, avg(abs(d0 - m)) AS a0, avg(abs(d1 - m)) AS a1, avg(abs(d2 - m)) AS a2 FROM a)
SELECT day, pairs, round(sh, 6) AS share_spread_gt_10, round(v, 6) AS mean_abs_dev, (v = greatest(a0, a1, a2))::INT::BIGINT AS outlier
FROM (SELECT 0 AS day, a0 AS v, * FROM s UNION ALL SELECT 1, a1, * FROM s UNION ALL SELECT 2, a2, * FROM s)""")
def day_spread(d):
    out = cubes.day_spread(day_long(d), list(DAYS))
    return _r(out, "share_spread_gt_10", "mean_abs_dev").withColumn("outlier", F.col("outlier").cast("bigint"))


_FIXED = """f AS (SELECT from_id, to_id, coalesce(loo_R, 255) AS few_off, coalesce(loo_N, 255) AS few_on, coalesce(loo_A, 255) AS any_off, coalesce(base, 255) AS any_on FROM v_case_times),
g AS (SELECT *, few_off AS x0, least(few_on, few_off) AS x1, least(any_off, few_off) AS x2, least(any_on, few_on, any_off, few_off) AS x3 FROM f)"""


def variants(d):
    return d.case_times.select("from_id", "to_id", F.col("loo_R").alias("few_off"), F.col("loo_N").alias("few_on"),
                               F.col("loo_A").alias("any_off"), F.col("base").alias("any_on"))


@query("g06_repair_monotone", f"WITH {_FIXED} SELECT from_id, to_id, x0::BIGINT AS few_off, x1::BIGINT AS few_on, x2::BIGINT AS any_off, x3::BIGINT AS any_on FROM g")
def repair_monotone(d):
    out = cubes.repair_monotone(variants(d))
    return out.select("from_id", "to_id", *[F.col(f"{v}_fixed").cast("bigint").alias(v) for v in cubes.VARIANTS])


@query("g06_repair_report", f"WITH {_FIXED}" + " UNION ALL ".join(
    f" SELECT '{v}' AS variant, count(*) AS pairs, count(*) FILTER ({v} <> x{i}) AS repaired, (count(*) FILTER ({v} <> x{i}) <= 1e-6 * count(*))::INT::BIGINT AS within FROM g"
    for i, v in enumerate(cubes.VARIANTS)))
def repair_report(d):
    out = cubes.repair_report(cubes.repair_monotone(variants(d)))
    return out.withColumn("within", F.col("within").cast("bigint"))


# Cell-to-cell times over 80 cells: origins and destinations folded onto the same keys.
SQL_VIEWS["v_cell_times"] = "SELECT o_custkey % 80 AS from_id, (l_suppkey * 7 + l_partkey) % 80 AS to_id, CASE WHEN min(m) % 7 <> 0 AND (o_custkey % 80) % 13 <> 4 THEN min(m) END AS tt FROM lo GROUP BY o_custkey % 80, (l_suppkey * 7 + l_partkey) % 80"


def cell_times(d):
    keys = (F.col("o_custkey") % 80).alias("from_id"), ((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 80).alias("to_id")
    best = d.lo.groupBy(*keys).agg(F.min("m").alias("m"))
    return best.select("from_id", "to_id", F.when((F.col("m") % 7 != 0) & (F.col("from_id") % 13 != 4), F.col("m")).alias("minutes"))


@query("g07_islands", """
WITH h AS (SELECT * FROM v_cell_times WHERE tt IS NOT NULL AND from_id <> to_id), c AS (SELECT DISTINCT c_custkey % 80 AS id FROM customer),
j AS (SELECT c.id, (SELECT count(*) FROM h WHERE from_id = c.id) AS reaches, (SELECT count(*) FROM h WHERE to_id = c.id) AS reached_by FROM c)
SELECT id, reaches, reached_by FROM j WHERE reaches <= 10 OR reached_by <= 10""")
def islands(d):
    cells = d.table("customer").select((F.col("c_custkey") % 80).alias("id")).distinct()
    return cubes.islands(cell_times(d), cells, max_reached=10)


_RINGS = "(VALUES " + ", ".join(f"({r}, {k})" for r in (150, 400, 900) for k in range(8)) + ") k(radius, bearing)"


@query("g08_relocate_access_points", f"""
WITH c AS (SELECT o.id, radius, bearing, (SELECT count(*) FROM v_dests t WHERE pow(t.x - (o.x + radius * cos(2 * pi() * bearing / 8)), 2) + pow(t.y - (o.y + radius * sin(2 * pi() * bearing / 8)), 2) <= 1500 * 1500) AS reach
           FROM v_origins o CROSS JOIN {_RINGS})
SELECT id, radius::DOUBLE AS radius, bearing::BIGINT AS bearing, reach FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY radius, reach DESC, bearing DESC) AS rn FROM c WHERE reach >= 2) WHERE rn = 1""")
def relocate_access_points(d):
    """Each origin moved to the nearest ring whose best candidate has at least two facilities in walking range."""
    spots = cubes.candidate_points(d.origins.select("id", "x", "y"), [150, 400, 900], 8)
    stops = d.dests.select(F.col("x").alias("px"), F.col("y").alias("py"))
    reach = spatial.sum_within(spots, stops, 1500, {"reach": F.lit(1)})
    out = cubes.relocate(reach, 2)
    return out.select("id", "radius", F.col("bearing").cast("bigint").alias("bearing"), "reach")


@query("g09_cube_invariants", """
WITH s AS (SELECT count(*) FILTER (coalesce(base, 255) > coalesce(loo_A, 255)) AS base_worse_than_a, count(*) FILTER (coalesce(loo_A, 255) > coalesce(loo_N, 255)) AS a_worse_than_n,
  round(count(*) FILTER (loo_N < loo_A) / count(*) FILTER (loo_N IS NOT NULL AND loo_A IS NOT NULL), 6) AS n_faster_share, count(*) FILTER (loo_A IS NULL AND loo_N IS NOT NULL) AS newly_reached,
  count(*) FILTER (base IS NOT NULL AND loo_R IS NOT NULL AND loo_R > base) AS gained, coalesce(max(loo_R - base), 0)::BIGINT AS max_gain FROM v_case_times),
y AS (SELECT count(*) AS pairs, round(avg((abs(a.tt - b.tt) <= 1)::INT), 6) AS within_1, round(avg((abs(a.tt - b.tt) <= 3)::INT), 6) AS within_3 FROM v_cell_times a JOIN v_cell_times b ON a.from_id = b.to_id AND a.to_id = b.from_id WHERE a.tt IS NOT NULL AND b.tt IS NOT NULL)
SELECT * FROM s CROSS JOIN y""")
def cube_invariants(d):
    base, a, n, r = (F.col(c) for c in ("base", "loo_A", "loo_N", "loo_R"))
    share, newly = cubes.speed_comparison(a, n)
    one = d.case_times.agg(
        cubes.worse_pairs(base, a).alias("base_worse_than_a"), cubes.worse_pairs(a, n).alias("a_worse_than_n"),
        F.round(share, 6).alias("n_faster_share"), newly.alias("newly_reached"), F.count_if(r > base).alias("gained"),
        F.coalesce(F.max(r - base), F.lit(0)).cast("bigint").alias("max_gain"))
    sym = cubes.symmetry(cell_times(d))
    return one.select("*", *[(sym.select(c) if c == "pairs" else sym.select(F.round(c, 6))).scalar().alias(c)
                             for c in ("pairs", "within_1", "within_3")])


# --- timetable change --------------------------------------------------------------------------

SQL_VIEWS["v_change"] = """
    SELECT t.from_id, t.to_id, p.category, p.lon AS lon2, p.lat AS lat2, o.lon, o.lat, o.pop::DOUBLE AS w, d0 AS later, d1 AS earlier, CASE WHEN (t.from_id * 37 + t.to_id * 11) % 150 <= 60 THEN (t.from_id * 37 + t.to_id * 11) % 150 END AS walk
    FROM v_day_times t JOIN v_people o ON o.id = t.from_id JOIN v_dests p ON p.id = t.to_id"""
SQL_VIEWS["v_eligible"] = """
    SELECT *, 'transit_only' AS mode, later IS NOT NULL AND (walk IS NULL OR later < walk) AS ok_later, earlier IS NOT NULL AND (walk IS NULL OR earlier < walk) AS ok_earlier FROM v_change
    UNION ALL SELECT *, 'door_to_door', later IS NOT NULL, earlier IS NOT NULL FROM v_change"""


def change_rows(d):
    times = day_long(d).groupBy("from_id", "to_id").agg(F.max(F.when(F.col("day") == 0, F.col("minutes"))).alias("later"),
                                                        F.max(F.when(F.col("day") == 1, F.col("minutes"))).alias("earlier"))
    walk = (F.col("from_id") * 37 + F.col("to_id") * 11) % 150
    people = d.people.select(F.col("id").alias("from_id"), "lon", "lat", F.col("pop").cast("double").alias("w"))
    places = d.dests.select(F.col("id").alias("to_id"), "category", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), "capacity")
    return times.join(people, "from_id").join(places, "to_id").withColumn("walk", F.when(walk <= 60, walk))


def _change_sql(source: str, keys: str, digits: int = 6) -> str:
    """Change statistics with weighted medians: the smallest value whose running weight reaches half."""
    med = ", ".join(f"m_{c}.v AS median_{c}" for c in ("later", "earlier", "delta"))
    joins = " ".join(f"""LEFT JOIN (SELECT {keys}, min(v) AS v FROM (SELECT {keys}, {c} AS v, sum(w) OVER (PARTITION BY {keys} ORDER BY {c}) AS cw, sum(w) OVER (PARTITION BY {keys}) AS tw FROM b) WHERE tw > 0 AND cw >= 0.5 * tw GROUP BY {keys}) m_{c} USING ({keys})"""
                     for c in ("later", "earlier", "delta"))
    return f"""
WITH r AS ({source}), b AS (SELECT *, later - earlier AS delta FROM r WHERE ok_later AND ok_earlier),
t AS (SELECT {keys}, count(*) AS n_total, count(*) FILTER (ok_earlier AND NOT ok_later) AS n_lost, count(*) FILTER (ok_later AND NOT ok_earlier) AS n_gained FROM r GROUP BY {keys}),
s AS (SELECT {keys}, count(*) AS n, round(sum(w), 3) AS weight, round(sum(w) FILTER (delta < 0) / sum(w), {digits}) AS share_shorter, round(sum(w) FILTER (delta > 0) / sum(w), {digits}) AS share_longer,
      round(sum(w) FILTER (delta = 0) / sum(w), {digits}) AS share_same, round(sum(w * later) / sum(w), {digits}) AS mean_later, round(sum(w * earlier) / sum(w), {digits}) AS mean_earlier, round(sum(w * delta) / sum(w), {digits}) AS mean_delta FROM b GROUP BY {keys})
SELECT {keys}, n_total, n_lost, n_gained, n, weight, share_shorter, share_longer, share_same, mean_later, mean_earlier, mean_delta, {med} FROM t LEFT JOIN s USING ({keys}) {joins}"""


def _rounded_change(df, as_double=False):
    out = _r(df, "share_shorter", "share_longer", "share_same", "mean_later", "mean_earlier", "mean_delta")
    kind = "double" if as_double else "bigint"
    return out.withColumn("weight", F.round("weight", 3)).select(
        *[F.col(c).cast(kind).alias(c) if c.startswith("median_") else c for c in out.columns])


@query("g10_timetable_change", _change_sql("SELECT *, 1 AS one FROM (SELECT mode, category, later, earlier, ok_later, ok_earlier, w FROM v_eligible UNION ALL SELECT mode, 'all', later, earlier, ok_later, ok_earlier, w FROM v_eligible)", "mode, category"))
def timetable_change(d):
    rows = cubes.with_all(cubes.eligible(change_rows(d)), "category")
    return _rounded_change(cubes.change_statistics(rows, ["mode", "category"]))


_CELL = """SELECT category, from_id, median(later) AS later, median(earlier) AS earlier, any_value(w) AS w, true AS ok_later, true AS ok_earlier
    FROM v_eligible WHERE mode = 'transit_only' AND ok_later AND ok_earlier GROUP BY ALL"""


@query("g11_cell_median_change", _change_sql(_CELL, "category"))
def cell_median_change(d):
    rows = cubes.eligible(change_rows(d)).where("mode = 'transit_only'")
    medians = cubes.cell_medians(rows, ["category", "from_id"]).join(
        d.people.select(F.col("id").alias("from_id"), F.col("pop").cast("double").alias("w")), "from_id")
    marked = medians.withColumn("ok_later", F.lit(True)).withColumn("ok_earlier", F.lit(True))
    return _rounded_change(cubes.change_statistics(marked, ["category"], whole_minutes=False), as_double=True)


_HAV = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))) / 1000"
EDGES = (0, 3, 8, 15)
_CLASS = f"(1 + ({_HAV} >= 3)::INT + ({_HAV} >= 8)::INT + ({_HAV} >= 15)::INT - 1)"
SQL_VIEWS["v_classed"] = f"SELECT from_id, to_id, mode, {_CLASS} AS class, later, earlier, ok_later, ok_earlier, w * (1 + to_id % 7) AS w, 1.0 + to_id % 7 AS wd FROM v_eligible"


def classed(d):
    rows = cubes.eligible(change_rows(d))
    kind = cubes.distance_class(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"), EDGES)
    return rows.withColumn("class", kind)


@query("g12_change_by_distance", _change_sql("SELECT mode, class::VARCHAR AS class, later, earlier, ok_later, ok_earlier, w FROM v_classed UNION ALL SELECT mode, 'all', later, earlier, ok_later, ok_earlier, w FROM v_classed", "mode, class"))
def change_by_distance(d):
    rows = classed(d).withColumn("w", F.col("w") * F.col("capacity"))
    return _rounded_change(cubes.change_statistics(cubes.with_all(rows, "class"), ["mode", "class"]))


@query("g13_origin_change", """
SELECT from_id, count(*) AS n, round(sum(wd * (later - earlier)) / sum(wd), 6) AS mean_delta, count(*) FILTER (class = 3) AS n_far,
       round(CASE WHEN count(*) FILTER (class = 3) >= 5 THEN sum(wd * (later - earlier)) FILTER (class = 3) / sum(wd) FILTER (class = 3) END, 6) AS mean_delta_far
FROM v_classed WHERE mode = 'transit_only' AND ok_later AND ok_earlier GROUP BY from_id HAVING count(*) >= 5""")
def origin_change(d):
    rows = classed(d).where("mode = 'transit_only'").withColumn("w", F.col("capacity").cast("double"))
    return _r(cubes.origin_change(rows, 3, 5), "mean_delta", "mean_delta_far")


@query("g14_season_means", """
WITH c AS (SELECT day, id, type, n, k.month, k.hour FROM v_counts CROSS JOIN (VALUES ('jan', 15), ('jan', 30), ('jul', 45)) k(month, hour) WHERE level = k.hour),
m AS (SELECT month, hour, type, id, median(n) AS n FROM c GROUP BY ALL), q AS (SELECT month, hour, meta, id, sum(n) AS n FROM m JOIN v_meta USING (type) GROUP BY ALL)
SELECT month, hour, meta, round(sum(n * pop) / sum(pop), 6) AS mean, count(*) AS cells FROM q JOIN v_people USING (id) GROUP BY ALL""")
def season_means(d):
    """Levels stand for hours: 15 and 30 in January, 45 in July."""
    month = F.when(F.col("level") == 45, "jul").otherwise("jan")
    cube = counts(d).select(month.alias("month"), F.col("level").alias("hour"), "day", "type", "id", "n")
    return _r(cubes.season_means(cube, meta(d), d.people), "mean")


@query("a20_pack_minutes", "SELECT from_id, to_id, coalesce(least(greatest(round_even(tt * 3.1, 0), 0), 254), 255)::BIGINT AS minutes FROM v_matrix")
def pack_minutes(d):
    return d.matrix.select("from_id", "to_id", cubes.pack_minutes(F.col("minutes") * 3.1).cast("bigint").alias("minutes"))
