"""Price surface and land-cover queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachgrid.functions import geo
from reachgrid.functions.values import comma_number, price_class
from reachgrid.operators import prices
from reachgrid.plans.impact import _r
from reachgrid.plans.registry import query
from reachgrid.plans.spatial import hex_sql
from reachgrid.plans.views import SQL_VIEWS

RULES_SQL = "WHEN kind = 'R' THEN 'transaction type' WHEN date < '1996-01-01' THEN 'before window' WHEN status <> 'F' AND unit % 7 = 0 THEN 'share'"
SQL_VIEWS["v_judged"] = f"""
    SELECT *, CASE {RULES_SQL} WHEN price IS NULL OR area IS NULL OR area = 0 THEN 'no price/area' WHEN area NOT BETWEEN 10 AND 45 THEN 'area'
              WHEN price / area NOT BETWEEN 1000 AND 3000 THEN 'price per m2' END AS reason, price / area AS price_m2
    FROM (SELECT *, coalesce(unit_price, CASE WHEN count(*) OVER (PARTITION BY deed) = 1 THEN deed_price END) AS price, CASE WHEN unit_price IS NOT NULL THEN 'unit' ELSE 'deed' END AS src FROM v_deeds)"""
SQL_VIEWS["v_kept"] = "SELECT deed, unit, date, price, min(src) AS src, min(price_m2) AS price_m2, min(x) AS x, min(y) AS y FROM v_judged WHERE reason IS NULL GROUP BY deed, unit, date, price"


def judged(d):
    rules = [("transaction type", F.col("kind") == "R"), ("before window", F.col("date") < "1996-01-01"),
             ("share", (F.col("status") != "F") & (F.col("unit") % 7 == 0))]
    return prices.judge_sales(d.deeds, rules, area=(10, 45), price_m2=(1000, 3000))


def kept(d):
    return prices.keep_sales(judged(d).withColumn("line", F.struct("area", "x", "y")), "line")


@query("b10_dropped_sales", """
SELECT reason, count(*) AS n FROM v_judged WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'duplicate', (SELECT count(*) FROM v_judged WHERE reason IS NULL) - (SELECT count(*) FROM v_kept)
WHERE (SELECT count(*) FROM v_judged WHERE reason IS NULL) > (SELECT count(*) FROM v_kept)""")
def dropped_sales(d):
    return prices.dropped_reasons(judged(d))


@query("b10_kept_sales", "SELECT deed, unit, date, price, src AS price_source, round(price_m2, 8) AS price_m2 FROM v_kept")
def kept_sales(d):
    return kept(d).select("deed", "unit", "date", "price", "price_source", F.round("price_m2", 8).alias("price_m2"))


@query("g18_price_quality", """
WITH o AS (SELECT price_m2, src, date, row_number() OVER (ORDER BY price_m2) - 1 AS i, count(*) OVER () AS n FROM v_kept)
SELECT count(*) AS kept, """ + ", ".join(f"round(max(price_m2) FILTER (i = floor({q / 100} * (n - 1))), 4) AS p{q}" for q in (5, 25, 50, 75, 95)) + """,
       count(*) FILTER (src = 'deed') AS price_from_deed, min(date) AS date_min, max(date) AS date_max FROM o""")
def price_quality(d):
    out = prices.price_quality(kept(d))
    return _r(out, "p5", "p25", "p50", "p75", "p95", digits=4)


@query("g18_sales_by_month", "SELECT substr(date, 1, 7) AS month, count(*) AS n FROM v_kept GROUP BY 1")
def sales_by_month(d):
    return prices.sales_by_month(kept(d))


@query("b11_usable_offers", """
SELECT c_custkey AS id, c_acctbal AS price_m2, (c_custkey % 90)::DOUBLE AS area FROM customer
WHERE c_custkey % 11 <> 0 AND c_custkey % 3 > 0 AND c_custkey % 90 BETWEEN 20 AND 80 AND c_acctbal BETWEEN 1000 AND 8000""")
def usable_offers(d):
    k = F.col("c_custkey")
    offers = d.table("customer").select(k.alias("id"), F.col("c_acctbal").alias("price_m2"), (k % 90).cast("double").alias("area"),
                                        (k % 3).alias("active"), F.when(k % 11 != 0, k).alias("x"), k.alias("y"))
    return prices.usable_offers(offers, (20, 80), (1000, 8000)).select("id", "price_m2", "area")


# --- adaptive radius ---------------------------------------------------------------------------

RADII = tuple(range(1000, 4001, 250))
# Residential footprint per origin cell: people times four square metres.
SQL_VIEWS["v_footprint"] = "SELECT id AS hex_id, pop * 4 AS footprint, x, y FROM v_people"


def _adaptive_sql(points: str, extra: str, distinct: str, min_n: int, min_distinct: int) -> str:
    """points: x, y, v, loc and the columns of ``extra``; one row per point."""
    keys = f"hex_id{extra}"
    dist = f"count(DISTINCT {distinct})" if distinct else "count(*)"
    return f"""near AS (SELECT c.hex_id, p.*, sqrt(pow(c.x - p.px, 2) + pow(c.y - p.py, 2)) AS d FROM v_footprint c JOIN ({points}) p ON pow(c.x - p.px, 2) + pow(c.y - p.py, 2) <= 16000000),
hit AS (SELECT {keys}, r.radius, count(*) AS n, {dist} AS nd FROM near JOIN (SELECT unnest(range(1000, 4001, 250)) AS radius) r ON d <= r.radius GROUP BY ALL),
pick AS (SELECT {keys}, min(radius) AS radius FROM hit WHERE n >= {min_n} AND nd >= {min_distinct} GROUP BY ALL),
used AS (SELECT near.*, radius, 1 - 0.75 * d / radius AS w FROM near JOIN pick USING ({keys}) WHERE d <= radius),
med AS (SELECT {keys}, min(v) AS median FROM (SELECT {keys}, v, sum(w) OVER (PARTITION BY {keys} ORDER BY v) AS cw, sum(w) OVER (PARTITION BY {keys}) AS tw FROM used) WHERE cw >= tw / 2 - 1e-9 GROUP BY ALL)"""


_SALES_SQL = _adaptive_sql("SELECT x AS px, y AS py, price_m2 AS v, x || '_' || y AS loc FROM v_kept", "", "loc", 10, 2)


def footprint(d):
    return d.people.select(F.col("id").alias("hex_id"), (F.col("pop") * 4).alias("footprint"), "x", "y")


def price_surface(d):
    points = kept(d).select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("price_m2").alias("v"),
                            F.concat_ws("_", "x", "y").alias("loc"))
    return prices.adaptive_median(footprint(d), points, value="v", distinct="loc", radii=RADII, min_n=10, min_distinct=2)


@query("g15_adaptive_median", f"""
WITH {_SALES_SQL} SELECT hex_id, round(median, 8) AS median, p.radius, n, nd AS n_distinct FROM pick p JOIN hit USING (hex_id, radius) JOIN med USING (hex_id)""")
def adaptive_median(d):
    return _r(price_surface(d), "median", digits=8).withColumn("radius", F.col("radius").cast("bigint"))


@query("g19_inhabited_prices", f"""
WITH {_SALES_SQL} SELECT f.hex_id, footprint, CASE WHEN footprint >= 12000 THEN round(median, 8) END AS price, CASE WHEN footprint >= 12000 THEN radius END AS radius, CASE WHEN footprint < 12000 THEN round(median, 8) END AS price_outside
FROM v_footprint f LEFT JOIN (SELECT * FROM med JOIN pick USING (hex_id)) USING (hex_id)""")
def inhabited_prices(d):
    out = prices.hide_uninhabited(price_surface(d), footprint(d), 12000)
    return _r(out, "price", "price_outside", digits=8).withColumn("radius", F.col("radius").cast("bigint"))


@query("g19_price_coverage", f"""
WITH {_SALES_SQL} SELECT count(*) AS cells, count(*) FILTER (footprint >= 12000) AS inhabited, count(*) FILTER (footprint >= 12000 AND median IS NOT NULL) AS priced,
       round(100 * count(*) FILTER (footprint >= 12000 AND median IS NOT NULL) / count(*) FILTER (footprint >= 12000), 1) AS coverage_pct FROM v_footprint LEFT JOIN med USING (hex_id)""")
def price_coverage(d):
    return prices.footprint_coverage(footprint(d), price_surface(d), 12000)


@query("g19_hex_footprint", f"""
SELECT q, r, sum(pop * 4)::BIGINT AS footprint, (sum(pop * 4) >= 60000)::INT::BIGINT AS inhabited FROM ({hex_sql('v_people')}) GROUP BY q, r""")
def hex_footprint(d):
    q, r = geo.hex_axial(F.col("x"), F.col("y"), 1000.0)
    cells = d.people.groupBy(q.alias("q"), r.alias("r")).agg(F.sum(F.col("pop") * 4).alias("footprint"))
    return cells.withColumn("inhabited", (F.col("footprint") >= 60000).cast("bigint"))


_OFFERS_SQL = _adaptive_sql("SELECT (c_custkey * 7919 % 1000) * 30 AS px, (c_custkey * 104729 % 1000) * 30 AS py, c_acctbal AS v, c_nationkey AS dev FROM customer WHERE c_acctbal > 0", "", "dev", 6, 4)


@query("g16_offer_median", f"""
WITH {_OFFERS_SQL} SELECT hex_id, round(median, 8) AS median, p.radius, n, nd AS n_distinct FROM pick p JOIN hit USING (hex_id, radius) JOIN med USING (hex_id) JOIN v_footprint USING (hex_id) WHERE footprint >= 12000""")
def offer_median(d):
    k = F.col("c_custkey")
    points = d.table("customer").where("c_acctbal > 0").select(
        (k * 7919 % 1000 * 30).alias("px"), (k * 104729 % 1000 * 30).alias("py"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("dev"))
    out = prices.adaptive_median(footprint(d).where("footprint >= 12000"), points, value="v", distinct="dev", radii=RADII, min_n=6, min_distinct=4)
    return out.withColumn("radius", F.col("radius").cast("bigint"))


_CLASS_POINTS = """SELECT px, py, market, CASE WHEN hi IS NOT NULL AND lo_ IS NOT NULL THEN (lo_ + hi) / 2 WHEN lo_ IS NOT NULL THEN lo_ + 500 ELSE hi END::DOUBLE AS v, lo_ IS NOT NULL AND hi IS NULL AS open FROM (
    SELECT (p_partkey * 7919 % 1000) * 30 + p_partkey % 29 AS px, (p_partkey * 104729 % 1000) * 30 AS py, CASE p_partkey % 2 WHEN 0 THEN 'RP' ELSE 'RW' END AS market,
           CASE WHEN p_size < 10 THEN NULL ELSE p_size * 100 END AS lo_, CASE WHEN p_size > 35 THEN NULL ELSE p_size * 100 + 999 END AS hi FROM part)"""
_CLASS_SQL = _adaptive_sql(f"SELECT * FROM ({_CLASS_POINTS}) UNION ALL SELECT px, py, 'ALL', v, open FROM ({_CLASS_POINTS})", ", market", "", 5, 1)


@query("g17_class_prices", f"""
WITH {_CLASS_SQL}, fl AS (SELECT hex_id, market, (sum(w) FILTER (open) > sum(w) / 2) AS c FROM used GROUP BY ALL)
SELECT hex_id, market, median, p.radius, n, coalesce(c, false)::INT::BIGINT AS flagged FROM pick p JOIN hit USING (hex_id, market, radius) JOIN med USING (hex_id, market) JOIN fl USING (hex_id, market)""")
def class_prices(d):
    k, size = F.col("p_partkey"), F.col("p_size")
    low, high = F.when(size >= 10, size * 100), F.when(size <= 35, size * 100 + 999)
    v, is_open = prices.class_value(low, high)
    cells = d.table("part").select((k * 7919 % 1000 * 30 + k % 29).alias("px"), (k * 104729 % 1000 * 30).alias("py"),
                                   F.when(k % 2 == 0, "RP").otherwise("RW").alias("market"), v.cast("double").alias("v"), is_open.alias("open"))
    out = prices.adaptive_median(footprint(d), prices.pool_markets(cells), value="v", distinct=None, radii=RADII, min_n=5, by=["market"], flag="open")
    return out.select("hex_id", "market", "median", F.col("radius").cast("bigint").alias("radius"), "n", F.col("flagged").cast("bigint").alias("flagged"))


@query("h15_h16_price_class", """
SELECT label, count(*) AS n, any_value(lo_)::BIGINT AS lo, any_value(hi)::BIGINT AS hi, any_value(num) AS num FROM (
  SELECT CASE p_size % 4 WHEN 0 THEN p_size || ' 501 - ' || (p_size + 1) || ' 500' WHEN 1 THEN '≥ ' || p_size || ' 001' WHEN 2 THEN 'poniżej ' || p_size || '00' ELSE 'Powyżej ' || p_size || '000' END AS label,
         CASE p_size % 4 WHEN 0 THEN p_size * 1000 + 501 WHEN 1 THEN p_size * 1000 + 1 WHEN 2 THEN NULL ELSE p_size * 1000 END AS lo_,
         CASE p_size % 4 WHEN 0 THEN (p_size + 1) * 1000 + 500 WHEN 2 THEN p_size * 100 END AS hi, (p_size + 0.25)::DOUBLE AS num FROM part) GROUP BY label""")
def price_class_labels(d):
    n, text = F.col("p_size"), F.col("p_size").cast("string")
    more = (n + 1).cast("string")
    label = (F.when(n % 4 == 0, F.concat(text, F.lit(" 501 - "), more, F.lit(" 500"))).when(n % 4 == 1, F.concat(F.lit("≥ "), text, F.lit(" 001")))
             .when(n % 4 == 2, F.concat(F.lit("poniżej "), text, F.lit("00"))).otherwise(F.concat(F.lit("Powyżej "), text, F.lit("000"))))
    low, high = price_class(F.col("label"))
    tagged = d.table("part").select(label.alias("label"), comma_number(F.concat(text, F.lit(",25"))).alias("num"))
    return tagged.groupBy("label").agg(F.count("*").alias("n"), F.max("num").alias("num")).select("label", "n", low.alias("lo"), high.alias("hi"), "num")


# --- land cover ------------------------------------------------------------------------------------

SQL_VIEWS["v_raster"] = "SELECT user_id % 60 AS hex_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 50 + (event_id % 6) * 5 END AS tram, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 55 + (event_id % 5) * 5 END AS rail, CASE WHEN event_id % 9 <> 0 THEN (event_id % 2)::DOUBLE END AS canopy FROM events"


def raster(d):
    k = F.col("event_id")
    return d.table("events").select(
        (F.col("user_id") % 60).alias("hex_id"), F.when(k % 3 == 0, 0).otherwise(50 + k % 6 * 5).alias("tram"),
        F.when(k % 4 == 0, 0).otherwise(55 + k % 5 * 5).alias("rail"), F.when(k % 9 != 0, (k % 2).cast("double")).alias("canopy"))


@query("g20_noise_shares", "SELECT h.hex_id, s.source, t.threshold, CASE WHEN h.hex_id % 17 <> 0 AND t.threshold >= s.low THEN round(CASE s.source "
       + " ".join(f"WHEN '{n}' THEN avg((({e}) >= t.threshold)::INT)" for n, e in (("tram", "tram"), ("rail", "rail"), ("both", "greatest(tram, rail)")))
       + """ END, 4) END AS share FROM v_raster h CROSS JOIN (VALUES ('tram', 50), ('rail', 55), ('both', 55)) s(source, low) CROSS JOIN (VALUES (50), (60), (70)) t(threshold) GROUP BY h.hex_id, s.source, s.low, t.threshold""")
def noise_shares(d):
    cells = raster(d)
    outside = cells.where("hex_id % 17 = 0").select("hex_id").distinct()
    levels = {"tram": F.col("tram"), "rail": F.col("rail")}
    return prices.noise_shares(cells, levels, [50, 60, 70], outside, {"tram": 50, "rail": 55}, {"both": ("tram", "rail")})


@query("g21_canopy_shares", "SELECT hex_id, round(avg(canopy), 4) AS canopy, round(count(canopy) * 0.25 / 54126.0, 4) AS cover FROM v_raster GROUP BY hex_id")
def canopy_shares(d):
    return prices.canopy_shares(raster(d), 0.25, 54126.0)
