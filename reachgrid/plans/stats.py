"""Cell statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from reachgrid.operators import access, impact, spatial, stats
from reachgrid.plans.impact import _r, deltas, net
from reachgrid.plans.registry import query
from reachgrid.plans.spatial import pois
from reachgrid.plans.views import CATEGORIES, SERVICES, SQL_VIEWS

SQL_VIEWS["v_total30"] = "SELECT id, sum(acc)::BIGINT AS acc FROM v_static30 GROUP BY id"
SQL_VIEWS["v_total30_85"] = """SELECT c_custkey AS id, coalesce(n, 0) AS acc FROM customer LEFT JOIN (
    SELECT from_id, count(*) AS n FROM v_matrix_85 JOIN v_opps USING (to_id) WHERE tt < 30 AND opportunity <> 'capacity' GROUP BY from_id) ON from_id = c_custkey"""


def static30(d):
    """Of the base case alone; a filter of ``d.acc`` would make the rows of every case first."""
    origins = d.table("customer").select(F.col("c_custkey").alias("id"))
    out = access.accessibility(d.matrix.withColumn("percentile", F.lit(50)), d.opps, origins, SERVICES, [50], [30])
    return out.select("id", "opportunity", F.col("accessibility").cast("bigint").alias("acc"))


def total30(d):
    return static30(d).groupBy("id").agg(F.sum("acc").alias("acc"))


@query("f21_b15_population_coverage", """
SELECT opportunity, cutoff, coalesce(sum(pop) FILTER (acc >= 1), 0)::BIGINT AS population_covered, sum(pop)::BIGINT AS population_total,
       round(100 * coalesce(sum(pop) FILTER (acc >= 1), 0) / sum(pop), 1) AS pct_covered FROM v_static JOIN v_people USING (id) GROUP BY ALL""")
def population_coverage(d):
    return stats.population_coverage(d.acc.where("case_id = 'base'"), d.people)


def _total_at(d, percentile):
    long = access.matrix_long(d.matrix_wide).where(F.col("percentile") == percentile)
    out = access.accessibility(long, d.opps, d.table("customer").select(F.col("c_custkey").alias("id")), SERVICES, [percentile], [30])
    return out.groupBy("id").agg(F.sum("accessibility").cast("bigint").alias("acc"))


_IMPACT = """i AS (SELECT a.id, a.acc AS p50, b.acc AS p85, CASE WHEN a.acc <> 0 THEN round(100.0 * (b.acc - a.acc) / a.acc, 1) END AS pct_impact FROM v_total30 a JOIN v_total30_85 b USING (id))"""


@query("f22_pessimistic_impact", f"WITH {_IMPACT} SELECT id, p50, p85, pct_impact FROM i")
def pessimistic_impact(d):
    return stats.pessimistic_impact(total30(d), _total_at(d, 85))


@query("f22_impact_statistics", f"""
WITH {_IMPACT} SELECT count(*) AS n, round(median(pct_impact), 6) AS median, round(avg(pct_impact), 6) AS mean, round(corr(sqrt(pow(x - 15000, 2) + pow(y - 15000, 2)), pct_impact), 6) AS r
FROM i JOIN v_origins USING (id) WHERE pct_impact IS NOT NULL""")
def impact_statistics(d):
    dist = F.sqrt(F.pow(F.col("x") - 15000, 2) + F.pow(F.col("y") - 15000, 2))
    rows = stats.pessimistic_impact(total30(d), _total_at(d, 85)).join(d.origins.select("id", dist.alias("dist")), "id")
    return _r(stats.impact_statistics(rows), "median", "mean", "r")


_PCTS = (5, 25, 50, 75, 95)


@query("f23_percentile_spread", """
WITH r AS (SELECT from_id, to_id, coalesce(tt, 999) AS tt, row_number() OVER (PARTITION BY from_id, to_id ORDER BY coalesce(tt, 999)) AS rn, count(*) OVER (PARTITION BY from_id, to_id) AS n FROM v_departures),
m AS (SELECT from_id, to_id, """ + ", ".join(f"min(CASE WHEN rn = ceil(n * {p} / 100.0) THEN tt END) AS p{p}" for p in _PCTS) + """ FROM r GROUP BY ALL),
a AS (SELECT from_id AS id, """ + ", ".join(f"(count(*) FILTER (p{p} < 45))::BIGINT AS p{p}" for p in _PCTS) + """ FROM m GROUP BY from_id)
SELECT id, p5, p25, p50, p75, p95, p5 - p95 AS spread, CASE WHEN p50 <> 0 THEN round((p5 - p95) / p50, 3) END AS rel_spread FROM a""")
def percentile_spread(d):
    wide = access.percentile_matrix(d.departures, list(_PCTS), max_trip=120)
    dests = d.departures.select("to_id").distinct().select("to_id", F.lit("total").alias("opportunity"), F.lit(1.0).alias("value"))
    origins = d.departures.select(F.col("from_id").alias("id")).distinct()
    acc = access.accessibility(access.matrix_long(wide), dests, origins, ["total"], list(_PCTS), [45])
    return stats.percentile_spread(acc.select("id", "percentile", F.col("accessibility").cast("bigint").alias("acc")))


_WIDE = "w AS (SELECT id, " + ", ".join(f"max(acc) FILTER (opportunity = '{s}') AS {s}" for s in SERVICES) + " FROM v_static30 GROUP BY id)"
_DOMINANT = "g AS (SELECT *, greatest(" + ", ".join(SERVICES) + ") AS best FROM w), k AS (SELECT id, CASE WHEN best <= 0 THEN 'none' " + " ".join(
    f"WHEN {s} = best THEN '{s}'" for s in SERVICES) + " END AS dominant FROM g)"


def dominant_rows(d):
    wide = static30(d).groupBy("id").pivot("opportunity", list(SERVICES)).agg(F.first("acc"))
    return stats.dominant(wide, SERVICES).join(d.people.select("id", "pop"), "id")


@query("f24_dominant_summary", f"""
WITH {_WIDE}, {_DOMINANT}, j AS (SELECT * FROM k JOIN v_people USING (id) WHERE pop > 0)
SELECT dominant, count(*) AS cells, sum(pop)::BIGINT AS pop, round(100 * count(*) / (SELECT count(*) FROM j), 1) AS pct_cells, round(100 * sum(pop) / (SELECT sum(pop) FROM j), 1) AS pct_pop FROM j GROUP BY dominant""")
def dominant_summary(d):
    return stats.dominant_summary(dominant_rows(d))


@query("f25_count_terciles", """
WITH s AS (SELECT pop, row_number() OVER (ORDER BY pop) - 1 AS i, count(*) OVER () AS n FROM v_people WHERE pop > 0),
c AS (SELECT max(pop) FILTER (i = n // 3) AS t1, max(pop) FILTER (i = 2 * n // 3) AS t2 FROM s)
SELECT CASE WHEN pop <= 0 THEN 0 WHEN pop <= t1 THEN 0 WHEN pop <= t2 THEN 1 ELSE 2 END::BIGINT AS tier, count(*) AS cells, sum(pop)::BIGINT AS pop FROM v_people CROSS JOIN c GROUP BY 1""")
def count_terciles(d):
    out = stats.count_terciles(d.people, "pop")
    return out.groupBy(F.col("tier").cast("bigint").alias("tier")).agg(F.count("*").alias("cells"), F.sum("pop").alias("pop"))


def _edges_sql(source: str, value: str, bins: int) -> str:
    return (f"ed AS (SELECT list_sort(list_distinct([" + ", ".join(f"quantile_cont({value}::DOUBLE, {i / bins!r})" for i in range(bins + 1))
            + f"])) AS e FROM {source})")


@query("f26_income_deciles", f"""
WITH src AS (SELECT c.id, (c.id * 7919 % 613)::DOUBLE AS income, t.acc FROM v_people c JOIN v_total30 t USING (id)), {_edges_sql('src', 'income', 10)},
b AS (SELECT acc, len(list_filter(e[2:len(e) - 1], lambda v: v < income)) + 1 AS bin FROM src CROSS JOIN ed)
SELECT bin, count(*) AS count, round(median(acc), 6) AS median, round(avg(acc), 6) AS mean FROM b GROUP BY bin""")
def income_deciles(d):
    rows = total30(d).withColumn("income", (F.col("id") * 7919 % 613).cast("double"))
    out = _r(stats.bin_statistics(rows, "income", "acc", 10), "median", "mean")
    return out.withColumn("bin", F.col("bin").cast("bigint"))


@query("f26_relative_means", """
WITH m AS (SELECT region, (id % 10)::BIGINT AS bin, avg(acc) AS mean FROM v_people JOIN v_total30 USING (id) GROUP BY ALL)
SELECT region, bin, round(mean, 6) AS mean, round(mean / nullif(first_value(mean) OVER (PARTITION BY region ORDER BY bin), 0), 6) AS relative FROM m""")
def relative_means(d):
    """Means per city and bin against the city's first bin."""
    rows = total30(d).select("id", "acc").join(d.people.select("id", "region"), "id")
    means = rows.groupBy("region", (F.col("id") % 10).cast("bigint").alias("bin")).agg(F.avg("acc").alias("mean"))
    return _r(stats.relative_to_first(means, ["region"], "bin", "mean"), "mean", "relative")


@query("f27_f28_correlations", """
WITH p AS (SELECT 'pop' AS hypothesis, region AS city, pop::DOUBLE AS x, acc::DOUBLE AS y FROM v_people JOIN v_total30 USING (id) UNION ALL SELECT 'east', region, x::DOUBLE, acc::DOUBLE FROM v_people JOIN v_total30 USING (id)),
q AS (SELECT * FROM p UNION ALL SELECT hypothesis, 'ALL', x, y FROM p)
SELECT hypothesis, city, round(corr(x, y), 3) AS r, count(*) AS n FROM q GROUP BY ALL""")
def correlations(d):
    rows = total30(d).join(d.people, "id")
    cases = F.array(F.struct(F.lit("pop").alias("hypothesis"), F.col("pop").cast("double").alias("x")),
                    F.struct(F.lit("east").alias("hypothesis"), F.col("x").cast("double").alias("x")))
    long = rows.select(F.col("region").alias("city"), F.col("acc").cast("double").alias("y"), cases.alias("c"))
    return stats.correlations(long.select("city", "y", F.inline("c")))


_RANK = "rank() OVER (PARTITION BY {g} ORDER BY {c}) + (count(*) OVER (PARTITION BY {g}, {c}) - 1) / 2.0"


@query("f29_spearman", f"""
WITH j AS (SELECT region, acc, pop FROM v_people JOIN v_total30 USING (id)),
r AS (SELECT region, {_RANK.format(g='region', c='acc')} AS a, {_RANK.format(g='region', c='pop')} AS b FROM j)
SELECT region, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY region""")
def spearman(d):
    return _r(stats.spearman(total30(d).join(d.people, "id"), "acc", "pop", ["region"]), "rho")


# Four grids: the cell's key modulo 4; lines are districts ranked by their mean change.
SQL_VIEWS["v_grid_district"] = """SELECT 'g' || (id % 4) AS grid, district, round(sum(net_delta * pop) / nullif(sum(pop) FILTER (net_delta IS NOT NULL), 0), 6) AS mean_net,
    round(coalesce(sum(pop) FILTER (net_delta < 0), 0) / nullif(sum(pop) FILTER (net_delta IS NOT NULL), 0), 4) AS share_losing
    FROM v_net JOIN v_people USING (id) WHERE case_id = 'loo_A' GROUP BY ALL"""
SQL_VIEWS["v_grid_rank"] = "SELECT grid, district AS line, row_number() OVER (PARTITION BY grid ORDER BY mean_net, district) AS rank FROM v_grid_district"


def grid_district(d):
    p, n = F.col("pop"), F.col("net_delta")
    rows = net(d).where("case_id = 'loo_A'").join(d.people.select("id", "pop", "district"), "id")
    held = F.nullif(F.sum(F.when(n.isNotNull(), p)), F.lit(0))
    return rows.groupBy(F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("grid"), "district").agg(
        F.round(F.sum(n * p) / held, 6).alias("mean_net"), F.round(F.sum(F.when(n < 0, p).otherwise(0)) / held, 4).alias("share_losing"))


def grid_ranks(d):
    order = Window.partitionBy("grid").orderBy("mean_net", "district")
    return grid_district(d).select("grid", F.col("district").alias("line"), F.row_number().over(order).alias("rank"))


@query("f30_ranking_agreement", f"""
WITH j AS (SELECT a.grid AS grid_a, b.grid AS grid_b, a.line, a.rank AS ra, b.rank AS rb FROM v_grid_rank a JOIN v_grid_rank b ON a.line = b.line AND a.grid < b.grid),
r AS (SELECT grid_a, grid_b, ra, rb, {_RANK.format(g='grid_a, grid_b', c='ra')} AS x, {_RANK.format(g='grid_a, grid_b', c='rb')} AS y FROM j)
SELECT grid_a, grid_b, CASE WHEN grid_a = 'g2' AND grid_b = 'g3' THEN 'zoning' ELSE 'scale' END AS kind, count(*) AS lines, round(corr(x, y), 3) AS spearman,
       count(*) FILTER (ra = 1 AND rb = 1) AS same_worst_line, count(*) FILTER (ra <= 5 AND rb <= 5) AS top_shared FROM r GROUP BY ALL""")
def ranking_agreement(d):
    out = stats.ranking_agreement(grid_ranks(d), ("g2", "g3"))
    return out.withColumn("same_worst_line", F.col("same_worst_line").cast("bigint"))


_STABLE = """s AS (SELECT district, round(max(share_losing) FILTER (grid IN ('g0', 'g1', 'g2')) - min(share_losing) FILTER (grid IN ('g0', 'g1', 'g2')), 4) AS spread_scale,
    round(abs(max(share_losing) FILTER (grid = 'g2') - max(share_losing) FILTER (grid = 'g3')), 4) AS spread_zoning, count(*) AS grids FROM v_grid_district WHERE share_losing IS NOT NULL GROUP BY district HAVING count(*) >= 2)"""


def stable(d):
    return stats.district_stability(grid_district(d), "share_losing", ["g0", "g1", "g2"], ("g2", "g3"))


@query("f31_district_stability", f"WITH {_STABLE} SELECT district, grids, spread_scale, spread_zoning FROM s")
def district_stability(d):
    return stable(d)


@query("f31_stability_summary", f"""
WITH {_STABLE}, o AS (SELECT *, row_number() OVER (ORDER BY spread_scale) - 1 AS i, row_number() OVER (ORDER BY spread_zoning) - 1 AS j, count(*) OVER () AS n FROM s)
SELECT count(*) AS districts, count(*) FILTER (coalesce(spread_scale, 0) <= 0.05) AS within_5pp,
       max(spread_scale) FILTER (i = round_even(0.5 * (n - 1), 0)) AS spread_scale_median, max(spread_scale) FILTER (i = round_even(0.9 * (n - 1), 0)) AS spread_scale_p90,
       max(spread_zoning) FILTER (j = round_even(0.5 * (n - 1), 0)) AS spread_zoning_median, max(spread_zoning) FILTER (j = round_even(0.9 * (n - 1), 0)) AS spread_zoning_p90 FROM o""")
def stability_summary(d):
    return stats.stability_summary(stable(d))


_K = 8
SQL_VIEWS["v_knn"] = f"""SELECT id, other FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rn
    FROM v_origins a JOIN v_origins b ON a.id <> b.id) WHERE rn <= {_K}"""


def neighbour_graph(d):
    here = d.origins.select("id", "x", "y")
    there = d.origins.select(F.col("id").alias("other"), F.col("x").alias("px"), F.col("y").alias("py"))
    return spatial.nearest_k(here, there, _K, right_key="other", skip_same=True).select("id", "other")


@query("f32_morans_i", f"""
WITH z AS (SELECT id, acc - avg(acc) OVER () AS z FROM v_total30)
SELECT (SELECT count(*) FROM z) AS n, round(sum(a.z * b.z) / {_K} / (SELECT sum(z * z) FROM z), 6) AS i FROM v_knn JOIN z a USING (id) JOIN z b ON b.id = other""")
def morans_i(d):
    values = total30(d).select("id", F.col("acc").cast("double").alias("v"))
    return _r(stats.morans_i(values, neighbour_graph(d), _K), "i")


def _turns(x: str) -> str:
    """The six turns of a shuffle as columns l6 and r6, from position ``x``; n, a and b are columns too."""
    drawn = "((h{r} % 32768 + 1) * (h{r} // 32768 + 1) % {p} * {spread} % {p})".replace("{p}", str(stats.PRIME)).replace("{spread}", str(stats.SPREAD))
    out = [f"{x} // b AS l0", f"{x} % b AS r0"]
    for r in range(6):
        fixed = f"r{r}" if r % 2 == 0 else f"l{r}"
        out.append(f"({fixed} * {stats.STEP} + perm * {stats.TURN} + {(64 * 42 + r) * stats.ROUND}) % {stats.PRIME} AS h{r}")
        out += [f"(l{r} + {drawn.format(r=r)}) % a AS l{r + 1}", f"r{r} AS r{r + 1}"] if r % 2 == 0 else [f"l{r} AS l{r + 1}", f"(r{r} + {drawn.format(r=r)}) % b AS r{r + 1}"]
    return ", ".join(out)


@query("f32_moran_p_value", f"""
WITH RECURSIVE z AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx, acc - avg(acc) OVER () AS z FROM v_total30),
d AS (SELECT n, a, ceil(n / a)::BIGINT AS b FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM z)),
w AS (SELECT id, perm, n, a, b, l6 * b + r6 AS x FROM (SELECT *, {_turns('idx')} FROM z CROSS JOIN d CROSS JOIN (SELECT unnest(range(1, 300)) AS perm))
      UNION ALL SELECT id, perm, n, a, b, l6 * b + r6 FROM (SELECT *, {_turns('x')} FROM w WHERE x >= n)),
p AS (SELECT w.id, perm, z.z FROM w JOIN z ON z.idx = w.x UNION ALL SELECT id, 0, z FROM z),
e AS MATERIALIZED (SELECT g.other, x.perm, x.z FROM v_knn g JOIN p x ON x.id = g.id),
i AS (SELECT e.perm, sum(e.z * y.z) / {_K} / (SELECT sum(z * z) FROM z) AS i FROM e JOIN p y ON y.perm = e.perm AND y.id = e.other GROUP BY e.perm)
SELECT round((SELECT i FROM i WHERE perm = 0), 6) AS i, round((count(*) FILTER (perm > 0 AND abs(i) >= (SELECT abs(i) FROM i WHERE perm = 0)) + 1) / 300.0, 6)::DOUBLE AS p FROM i""")
def moran_p_value(d):
    """Shuffles are whole-number arithmetic, so SQL draws the same ones."""
    values = total30(d).select("id", F.col("acc").cast("double").alias("v"))
    return _r(stats.moran_p_value(values, neighbour_graph(d), _K), "i", "p")


SQL_VIEWS["v_rings"] = """
    SELECT case_id, floor(sqrt(pow(x - cx, 2) + pow(y - cy, 2)) / 1000)::DOUBLE AS bin_lo, count(*) AS cells, sum(pop)::BIGINT AS pop, sum(net_delta * pop) / nullif(sum(pop), 0) AS mean
    FROM v_net JOIN v_people USING (id) CROSS JOIN (SELECT sum(pop * x) / sum(pop) AS cx, sum(pop * y) / sum(pop) AS cy FROM v_people) WHERE net_delta IS NOT NULL AND case_id = 'loo_A' GROUP BY ALL"""


def rings(d):
    cells = net(d).where("case_id = 'loo_A'").join(d.people.select("id", "pop", "x", "y"), "id", "right")
    return stats.ring_profile(cells.select("id", "pop", "x", "y", "net_delta"))


@query("f33_ring_profile", "SELECT bin_lo, cells, pop, round(mean, 6) AS mean FROM v_rings")
def ring_profile(d):
    return _r(rings(d), "mean")


@query("f34_ring_verdict", """
WITH u AS (SELECT *, row_number() OVER (ORDER BY mean, bin_lo) AS rn, count(*) OVER () AS k FROM v_rings WHERE cells >= 20 AND mean IS NOT NULL),
v AS (SELECT max(bin_lo) FILTER (rn = 1) AS worst_ring_km, max(mean) FILTER (rn = 1) AS worst_mean, arg_min(mean, bin_lo) AS inner_mean, max(mean) FILTER (rn = 2 + (k - 1) // 2) AS median_other, any_value(k) AS k FROM u)
SELECT worst_ring_km, round(worst_mean, 6) AS worst_mean, round(inner_mean, 6) AS inner_mean, round(median_other, 6) AS median_other,
       (worst_ring_km BETWEEN 1 AND 4 AND worst_mean < inner_mean AND worst_mean < median_other - 0.3)::INT::BIGINT AS dip FROM v WHERE k >= 3""")
def ring_verdict(d):
    out = stats.ring_verdict(rings(d))
    return _r(out, "worst_mean", "inner_mean", "median_other").withColumn("dip", F.col("dip").cast("bigint"))


SQL_VIEWS["v_reach"] = """
    SELECT id, category, n, distance FROM (
      SELECT o.id, t.category, least(s.acc, count(*) OVER (PARTITION BY o.id, t.category)) AS n, sqrt(pow(o.x - t.x, 2) + pow(o.y - t.y, 2)) AS distance,
             row_number() OVER (PARTITION BY o.id, t.category ORDER BY pow(o.x - t.x, 2) + pow(o.y - t.y, 2), t.id) AS rn
      FROM v_origins o JOIN v_static30 s USING (id) JOIN v_dests t ON 'srv_' || t.category = s.opportunity WHERE s.acc >= 1) WHERE rn = n"""


def reach(d):
    asked = static30(d).select("id", F.expr("substring(opportunity, 5)").alias("category"), F.col("acc").alias("n"))
    left = asked.join(d.origins.select("id", "x", "y"), "id")
    return spatial.nth_distance(left, pois(d).select("category", "px", "py"), by=["category"])


@query("f35_reach_radius", "SELECT id, category, n, round(distance, 6) AS distance FROM v_reach")
def reach_radius(d):
    return _r(reach(d), "distance")


@query("f36_reach_bins", f"""
WITH src AS (SELECT r.distance, d.delta::DOUBLE AS v, p.pop FROM v_reach r JOIN v_deltas d ON d.id = r.id AND d.opportunity = 'srv_mall' AND d.case_id = 'loo_A' JOIN v_people p ON p.id = r.id WHERE r.category = 'mall' AND d.delta IS NOT NULL), {_edges_sql('src', 'distance', 6)},
b AS (SELECT *, len(list_filter(e[2:len(e) - 1], lambda q: q < distance)) + 1 AS bin FROM src CROSS JOIN ed)
SELECT bin, round(any_value(e[bin]), 6) AS lo, round(any_value(e[bin + 1]), 6) AS hi, count(*) AS cells, sum(pop)::BIGINT AS pop, round(sum(v * pop) / nullif(sum(pop), 0), 6) AS mean FROM b GROUP BY bin""")
def reach_bins(d):
    change = deltas(d).where("case_id = 'loo_A' and opportunity = 'srv_mall' and delta is not null").select("id", F.col("delta").alias("v"))
    rows = reach(d).where("category = 'mall'").join(change, "id").join(d.people.select("id", "pop"), "id")
    out = stats.binned_weighted_mean(rows, "distance", "v", "pop", 6)
    return _r(out, "lo", "hi", "mean").withColumn("bin", F.col("bin").cast("bigint"))


@query("f37_city_rollup", """
WITH a AS (SELECT case_id, region AS city, opportunity, avg(delta) AS mean_delta, count(delta) AS comparable, count(*) FILTER (base = 0) AS zero_baseline FROM v_deltas JOIN v_people USING (id) GROUP BY ALL),
b AS (SELECT case_id, region AS city, 'net' AS opportunity, avg(net_delta) AS mean_delta, count(net_delta) AS comparable, count(*) FILTER (net_delta = 0) AS zero_baseline FROM v_net JOIN v_people USING (id) GROUP BY case_id, region),
s AS (SELECT region AS city, count(*) AS origins, sum(pop)::BIGINT AS pop FROM v_people GROUP BY region)
SELECT case_id, city, opportunity, round(mean_delta, 6) AS mean_delta, comparable, zero_baseline, origins, pop FROM (SELECT * FROM a UNION ALL SELECT * FROM b) JOIN s USING (city)""")
def city_rollup(d):
    """Category rows and net rows per case and city in one table, joined with each city's run size."""
    people = d.people.select("id", "pop", F.col("region").alias("city"))
    a = deltas(d).join(people, "id").groupBy("case_id", "city", "opportunity").agg(
        F.avg("delta").alias("mean_delta"), F.count("delta").alias("comparable"), F.count_if(F.col("base") == 0).alias("zero_baseline"))
    b = net(d).join(people, "id").groupBy("case_id", "city").agg(
        F.lit("net").alias("opportunity"), F.avg("net_delta").alias("mean_delta"), F.count("net_delta").alias("comparable"),
        F.count_if(F.col("net_delta") == 0).alias("zero_baseline"))
    size = people.groupBy("city").agg(F.count("*").alias("origins"), F.sum("pop").alias("pop"))
    return _r(a.unionByName(b).join(size, "city"), "mean_delta")


@query("f38_category_survivors", """
WITH c AS (SELECT category, n_regionkey AS district, count(*) AS n FROM v_dests JOIN supplier ON s_suppkey = id JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)
SELECT category, sum(n)::BIGINT AS total, count(*) FILTER (n >= 5) AS districts, CASE WHEN count(*) FILTER (n >= 5) >= 3 THEN 'OK' ELSE 'REJECTED' END AS verdict FROM c GROUP BY category
UNION ALL SELECT 'zoo', 0, 0, 'REJECTED'""")
def category_survivors(d):
    homes = d.table("supplier").join(d.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("district"))
    return stats.survivors(d.dests.join(homes, "id"), [*CATEGORIES, "zoo"], 5, 3)
