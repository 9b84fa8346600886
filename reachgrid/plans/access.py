"""Accessibility, competitive access, departure windows, equity and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachgrid.functions.decay import DECAYS, EXPONENTIAL, LOGISTIC
from reachgrid.functions.values import whole
from reachgrid.operators import access, compare, equity, fca
from reachgrid.plans.registry import query
from reachgrid.plans.views import CASES, SERVICES

NAMES = (*SERVICES, "capacity")
CUTS = (15, 30, 45, 60)
CATCHMENT = 45

_SCAFFOLD = """SELECT o.id, s.opportunity, p.percentile, c.cutoff FROM v_origins o
    CROSS JOIN (SELECT DISTINCT opportunity FROM v_opps) s
    CROSS JOIN (VALUES (50), (85)) p(percentile) CROSS JOIN (VALUES (15), (30), (45), (60)) c(cutoff)"""


@query("d01_c01_c02_cumulative_access", f"""
SELECT f.id, f.opportunity, f.percentile, f.cutoff, coalesce(a.v, 0)::BIGINT AS accessibility
FROM ({_SCAFFOLD}) f LEFT JOIN (
    SELECT from_id AS id, opportunity, percentile, cutoff, sum(value) AS v
    FROM v_matrix_long JOIN v_opps USING (to_id) CROSS JOIN (VALUES (15), (30), (45), (60)) c(cutoff)
    WHERE tt < cutoff GROUP BY ALL) a USING (id, opportunity, percentile, cutoff)""")
def cumulative_access(d):
    out = access.accessibility(access.matrix_long(d.matrix_wide), d.opps, d.table("customer").select(
        F.col("c_custkey").alias("id")), NAMES, [50, 85], CUTS)
    return out.withColumn("accessibility", whole(F.col("accessibility")))


def _decay_sql(weight: str) -> str:
    return f"""
SELECT f.id, f.opportunity, f.cutoff, round(coalesce(a.v, 0), 4) AS accessibility
FROM (SELECT DISTINCT id, opportunity, cutoff FROM ({_SCAFFOLD}) WHERE cutoff IN (30, 60)) f LEFT JOIN (
    SELECT from_id AS id, opportunity, cutoff, sum(value * {weight}) AS v
    FROM v_matrix JOIN v_opps USING (to_id) CROSS JOIN (VALUES (30), (60)) c(cutoff)
    WHERE tt IS NOT NULL GROUP BY ALL) a USING (id, opportunity, cutoff)"""


_EXP = "pow(0.5, tt / cutoff)"
_LOG = "1 / (1 + exp((tt - cutoff) / (10 * sqrt(3) / pi())))"


def _decayed(d, decay):
    out = access.accessibility(d.matrix.withColumn("percentile", F.lit(50)), d.opps, d.table("customer").select(
        F.col("c_custkey").alias("id")), NAMES, [50], [30, 60], decay)
    return out.drop("percentile")


@query("d02_access_exponential", _decay_sql(_EXP))
def access_exponential(d):
    return _decayed(d, EXPONENTIAL)


@query("d02_access_logistic", _decay_sql(_LOG))
def access_logistic(d):
    return _decayed(d, LOGISTIC)


@query("a05_matrix_long", "SELECT from_id, to_id, percentile, tt::BIGINT AS minutes FROM v_matrix_long")
def matrix_long(d):
    return access.matrix_long(d.matrix_wide).withColumn("minutes", F.col("minutes").cast("bigint"))


@query("a04_matrix_pairs", "SELECT from_id, to_id, tt::BIGINT AS minutes FROM v_matrix_85 WHERE tt IS NOT NULL")
def matrix_pairs(d):
    return access.matrix_pairs(d.matrix_wide, 85).withColumn("minutes", F.col("minutes").cast("bigint"))


# --- competitive access ----------------------------------------------------

_FCA = """
pairs AS (SELECT from_id, to_id, {w} AS w FROM v_matrix CROSS JOIN (SELECT 45 AS cutoff) WHERE tt < 45),
ratios AS (
    SELECT d.id AS to_id, d.capacity, coalesce(q.demand, 0) AS demand,
           CASE WHEN coalesce(q.demand, 0) > 0 THEN d.capacity / q.demand ELSE 0 END AS ratio
    FROM v_dests d LEFT JOIN (SELECT to_id, sum(pop * w)::DOUBLE AS demand FROM pairs JOIN v_people ON id = from_id GROUP BY to_id) q
      ON q.to_id = d.id),
access AS (
    SELECT o.id, coalesce(a.v, 0) AS access FROM v_people o LEFT JOIN (
        SELECT from_id, sum(ratio * w) AS v FROM pairs JOIN ratios USING (to_id) GROUP BY from_id) a ON a.from_id = o.id)"""


def _fca_sql(tail: str, weight: str = "1") -> str:
    return f"WITH {_FCA.format(w=weight).strip()} {tail}"


def _ratios(d, decay="STEP"):
    people = d.origins.select("id", F.col("pop").alias("population"))
    return people, fca.supply_ratios(d.matrix, people, d.dests, catchment=CATCHMENT, decay=decay)


@query("d03_d05_supply_ratio", _fca_sql(
    "SELECT to_id, capacity::BIGINT AS capacity, demand::BIGINT AS demand, round(ratio, 9) AS ratio FROM ratios"))
def supply_ratio(d):
    _, ratios = _ratios(d)
    return ratios.select("to_id", whole(F.col("capacity")).alias("capacity"), whole(F.col("demand")).alias("demand"),
                         F.round("ratio", 9).alias("ratio"))


@query("d04_competitive_access", _fca_sql("SELECT id, round(access * 1000, 6) AS access FROM access"))
def competitive_access(d):
    people, ratios = _ratios(d)
    out = fca.competitive_access(d.matrix, ratios, people, catchment=CATCHMENT, per_population=1000)
    return out.withColumn("access", F.round("access", 6))


@query("d04_competitive_access_decay", _fca_sql("SELECT id, round(access * 1000, 6) AS access FROM access", _EXP))
def competitive_access_decay(d):
    people, ratios = _ratios(d, EXPONENTIAL)
    out = fca.competitive_access(d.matrix, ratios, people, catchment=CATCHMENT, decay=EXPONENTIAL, per_population=1000)
    return out.withColumn("access", F.round("access", 6))


@query("d06_thin_supply", _fca_sql("""
SELECT to_id, round(ratio / fair, 6) AS factor
FROM ratios CROSS JOIN (SELECT (SELECT sum(capacity) FROM v_dests) / (SELECT sum(pop) FROM v_people)::DOUBLE AS fair)
WHERE capacity > 0 AND demand > 0 AND ratio > 0.02 * fair"""))
def thin_supply(d):
    people, ratios = _ratios(d)
    return fca.thin_supply(ratios, people, factor=0.02).select("to_id", F.round(F.col("ratio") / F.col("fair"), 6).alias("factor"))


@query("d07_supply_conservation", _fca_sql("""
SELECT (SELECT count(*) FROM ratios WHERE capacity > 0 AND demand = 0) AS unserved_supply,
       (SELECT sum(capacity) FROM ratios WHERE demand > 0)::BIGINT AS distributed_supply,
       (SELECT round(max(ratio), 9) FROM ratios) AS max_ratio,
       (SELECT round(sum(access * pop), 3) FROM access JOIN v_people USING (id)) AS received"""))
def supply_conservation(d):
    people, ratios = _ratios(d)
    reached = fca.competitive_access(d.matrix, ratios, people, catchment=CATCHMENT)
    received = fca.conservation_gap(reached, people, ratios).select("received").scalar()
    return fca.supply_summary(ratios, people).select(
        "unserved_supply", whole(F.col("distributed_supply")).alias("distributed_supply"),
        F.round("max_ratio", 9).alias("max_ratio"), F.round(received, 3).alias("received"))


# --- departure windows -----------------------------------------------------

@query("d01_reachable_destinations", """
SELECT o.id, count(DISTINCT m.to_id) AS reachable FROM v_origins o LEFT JOIN v_matrix m ON m.from_id = o.id AND m.tt IS NOT NULL GROUP BY o.id""")
def reachable_destinations(d):
    return access.reachable_destinations(d.matrix, d.origins)


@query("d08_service_minutes", """
SELECT from_id, to_id, count(CASE WHEN tt <= 15 THEN 1 END) AS svc_min_c15,
       count(CASE WHEN tt <= 45 THEN 1 END) AS svc_min_c45
FROM v_departures GROUP BY ALL HAVING count(CASE WHEN tt <= 45 THEN 1 END) > 0""")
def service_minutes(d):
    return access.service_minutes(d.departures, [15, 45])


@query("d08_service_minutes_histogram", """
SELECT from_id, to_id, floor(count(CASE WHEN tt <= 30 THEN 1 END) / 2 + 0.5)::BIGINT AS svc_min_c30,
       floor(count(CASE WHEN tt <= 119 THEN 1 END) / 2 + 0.5)::BIGINT AS svc_min_c119
FROM v_departures WHERE tt IS NOT NULL GROUP BY ALL HAVING floor(count(CASE WHEN tt <= 119 THEN 1 END) / 2 + 0.5) > 0""")
def service_minutes_histogram(d):
    counts = access.departure_counts(d.departures.where("minutes is not null"))
    at = F.map_from_entries(F.collect_list(F.struct("minutes", "n")))  # at most 120 entries per pair
    histogram = F.transform(F.sequence(F.lit(0), F.lit(119)), lambda m: F.coalesce(F.element_at(F.col("by_minute"), m), F.lit(0)))
    histograms = counts.groupBy("from_id", "to_id").agg(at.alias("by_minute")).select(
        "from_id", "to_id", histogram.alias("histogram"))
    return access.service_minutes_from_histogram(histograms, [30, 119], draws_per_minute=2)


def _departures(d):
    """Departures of which one pair in thirteen never arrives."""
    return d.departures.withColumn("minutes", F.when((F.col("from_id") + F.col("to_id")) % 13 != 0, F.col("minutes")))


@query("d09_departure_percentiles", """
WITH r AS (SELECT from_id, to_id, coalesce(tt, 999) AS tt,
                  row_number() OVER (PARTITION BY from_id, to_id ORDER BY coalesce(tt, 999)) AS rn,
                  count(*) OVER (PARTITION BY from_id, to_id) AS n FROM (SELECT from_id, to_id, CASE WHEN (from_id + to_id) % 13 <> 0 THEN tt END AS tt FROM v_departures))
SELECT from_id, to_id,
""" + ",\n".join(f"CASE WHEN min(CASE WHEN rn = ceil(n * {p} / 100.0) THEN tt END) <= 90 THEN min(CASE WHEN rn = ceil(n * {p} / 100.0) THEN tt END) END::BIGINT AS travel_time_p{p}"
                   for p in (5, 25, 50, 75, 95)) + " FROM r GROUP BY ALL HAVING min(CASE WHEN rn = ceil(n * 5 / 100.0) THEN tt END) <= 90")
def departure_percentiles(d):
    out = access.percentile_matrix(_departures(d), [5, 25, 50, 75, 95], max_trip=90)
    return out.select("from_id", "to_id", *[F.col(c).cast("bigint").alias(c) for c in out.columns[2:]])


_WALK = "SELECT from_id, to_id, tt FROM (SELECT from_id, to_id, (from_id * 37 + to_id * 11) % 150 AS tt FROM v_matrix) WHERE tt <= 60"


def _walk(d):
    walk = (F.col("from_id") * 37 + F.col("to_id") * 11) % 150
    return d.matrix.select("from_id", "to_id", walk.alias("minutes")).where("minutes <= 60")


@query("d10_transit_used_pairs", f"""
SELECT m.from_id, m.to_id, m.tt::BIGINT AS minutes, w.tt::BIGINT AS walk
FROM v_matrix m LEFT JOIN ({_WALK}) w USING (from_id, to_id) WHERE m.tt IS NOT NULL AND (w.tt IS NULL OR m.tt < w.tt)""")
def transit_used_pairs(d):
    out = access.transit_used(d.matrix, _walk(d))
    return out.select("from_id", "to_id", F.col("minutes").cast("bigint").alias("minutes"), F.col("walk").cast("bigint").alias("walk"))


@query("d11_walk_only_guard", f"""
SELECT count(*) AS transit_used_pairs, CASE WHEN count(*) > 0 THEN 'OK' ELSE 'ERROR' END AS level
FROM v_matrix m LEFT JOIN ({_WALK}) w USING (from_id, to_id) WHERE m.tt IS NOT NULL AND (w.tt IS NULL OR m.tt < w.tt)""")
def walk_only_guard(d):
    return access.walk_only_guard(d.matrix, _walk(d))


# --- equity ----------------------------------------------------------------

_EQ = """
rec AS (
    SELECT id, region, CASE WHEN pop % 11 = 0 THEN NULL ELSE pop END AS w, s.opportunity AS field,
           CASE WHEN id % 13 = 0 THEN 0 ELSE acc END::DOUBLE AS x
    FROM v_origins JOIN v_acc s USING (id) WHERE case_id = 'base' AND cutoff = 30),
both_ AS (SELECT 'ALL' AS grp, field, x, w FROM rec UNION ALL SELECT CASE WHEN region = 'ASIA' THEN '(none)' ELSE region END, field, x, w FROM rec),
ok AS (SELECT grp, field, x, w, sum(w) OVER g AS tw, sum(w) OVER (PARTITION BY grp, field ORDER BY x) AS cw FROM both_ WHERE w > 0 WINDOW g AS (PARTITION BY grp, field)),
pairs AS (SELECT a.grp, a.field, sum(a.w * b.w * abs(a.x - b.x)) AS s
          FROM (SELECT grp, field, x, sum(w) AS w FROM ok GROUP BY ALL) a JOIN (SELECT grp, field, x, sum(w) AS w FROM ok GROUP BY ALL) b USING (grp, field) GROUP BY ALL)"""
_EQ_SELECT = f"""
WITH {_EQ.strip()},
skips AS (SELECT grp, field, count(*) AS skipped FROM both_ WHERE w IS NULL OR w < 0 GROUP BY ALL)
SELECT grp, field, sum(w)::BIGINT AS population, coalesce(sum(CASE WHEN x >= 4 THEN w END), 0)::BIGINT AS pop_at_least,
       round(coalesce(sum(CASE WHEN x >= 4 THEN w END), 0) / sum(w), 6) AS share_at_least,
       coalesce(sum(CASE WHEN x <= 0 THEN w END), 0)::BIGINT AS pop_zero,
       round(coalesce(sum(CASE WHEN x <= 0 THEN w END), 0) / sum(w), 6) AS share_zero,
       round(sum(x * w) / sum(w), 6) AS mean, round(any_value(s) / (2 * sum(w) * sum(w) * (sum(x * w) / sum(w))), 6) AS gini,
       any_value(skipped) AS skipped,
""" + ", ".join(f"min(CASE WHEN cw >= {q} * tw - 1e-9 THEN x END) AS p{int(q * 100)}" for q in equity.QUANTILES) + """
FROM ok JOIN pairs USING (grp, field) JOIN skips USING (grp, field) GROUP BY grp, field"""


def _equity_records(d):
    base = d.acc.where("case_id = 'base' and cutoff = 30").groupBy("id").pivot("opportunity", list(SERVICES)).agg(F.first("acc"))
    group = F.when(F.col("region") != "ASIA", F.col("region"))
    return d.origins.join(base, "id").select(
        "id", group.alias("region"), F.when(F.col("pop") % 11 != 0, F.col("pop")).alias("w"),
        *[F.when(F.col("id") % 13 != 0, F.col(s)).alias(s) for s in SERVICES])


def _equity_rows(d):
    return equity.summarize(_equity_records(d), "w", SERVICES, 4, "region")


@query("d13_d14_d15_equity_summary", _EQ_SELECT)
def equity_summary(d):
    out = _equity_rows(d)
    ints = {"population", "pop_at_least", "pop_zero"}
    dec = {"share_at_least", "share_zero", "mean", "gini"}
    return out.select(*[whole(F.col(c)).alias(c) if c in ints else F.round(c, 6).alias(c) if c in dec else c
                        for c in out.columns])


@query("d17_equity_sentence", f"""
SELECT grp, field, grp || ': ' || printf('%.1f', 100 * share_at_least) || '% of residents (' || replace(format('{{:,}}', pop_at_least), ',', ' ')
       || ' of ' || replace(format('{{:,}}', population), ',', ' ') || ') have ' || field || ' ≥ 4; ' || printf('%.1f', 100 * share_zero) || '% have none.' AS sentence
FROM ({_EQ_SELECT})""")
def equity_sentence(d):
    return _equity_rows(d).select("grp", "field", equity.sentence(4).alias("sentence"))


@query("d16_gini_trapezoid", """
WITH h AS (SELECT opportunity, acc::DOUBLE AS x, sum(pop)::DOUBLE AS w FROM v_acc JOIN v_people USING (id)
           WHERE case_id = 'base' AND cutoff = 60 AND pop > 0 GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY opportunity ORDER BY x) AS cw, sum(w * x) OVER (PARTITION BY opportunity ORDER BY x) AS cv,
             sum(w) OVER (PARTITION BY opportunity) AS tw, sum(w * x) OVER (PARTITION BY opportunity) AS tv FROM h)
SELECT opportunity, round(1 - 2 * sum(w / tw * (cv + cv - w * x) / tv / 2), 4) AS gini FROM r GROUP BY opportunity""")
def gini_trapezoid(d):
    joined = d.acc.where("case_id = 'base' and cutoff = 60").join(d.people.select("id", "pop"), "id")
    return equity.gini_trapezoid(joined, ["opportunity"], "acc", "pop")


# --- comparison ------------------------------------------------------------

_CMP_SIDES = """
a AS (SELECT from_id || '.0' AS id, round(avg(tt), 6) AS v FROM v_matrix WHERE from_id % 17 <> 0 GROUP BY from_id),
b AS (SELECT from_id AS id, round(avg(tt), 6) AS v FROM v_matrix_b WHERE from_id % 19 <> 0 GROUP BY from_id)"""


def _sides(d):
    a = d.matrix.where("from_id % 17 <> 0").groupBy("from_id").agg(F.round(F.avg("minutes"), 6).alias("value"))
    b = d.matrix_b.where("from_id % 19 <> 0").groupBy("from_id").agg(F.round(F.avg("minutes"), 6).alias("value"))
    return (a.select(F.concat(F.col("from_id").cast("string"), F.lit(".0")).alias("id"), "value"),
            b.select(F.col("from_id").alias("id"), "value"))


_CMP = f"""WITH {_CMP_SIDES.strip()},
j AS (SELECT coalesce(replace(a.id, '.0', ''), b.id::VARCHAR) AS id, a.v AS va, b.v AS vb, a.id IS NOT NULL AS ina, b.id IS NOT NULL AS inb
      FROM a FULL JOIN b ON replace(a.id, '.0', '') = b.id::VARCHAR),
c AS (SELECT id, va AS value_a, vb AS value_b, CASE WHEN ina AND inb THEN vb - va END AS diff,
             CASE WHEN ina AND inb AND va <> 0 THEN 100 * (vb - va) / va END AS pct_change,
             CASE WHEN NOT inb THEN 'only_a' WHEN NOT ina THEN 'only_b' WHEN va IS NULL AND vb IS NULL THEN 'same' WHEN vb IS NULL THEN 'worse'
                  WHEN va IS NULL THEN 'better' WHEN abs(vb - va) < 1e-9 THEN 'same' WHEN vb < va THEN 'better' ELSE 'worse' END AS status FROM j)"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("value_a", "value_b", "diff", "pct_change", "sum_diff", "mean_diff") else c
                       for c in df.columns])


@query("c03_compare_travel_times", _CMP + """
SELECT id, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, round(diff, 6) AS diff, round(pct_change, 6) AS pct_change, status FROM c""")
def compare_travel_times(d):
    a, b = _sides(d)
    return _rounded(compare.compare_checked(a, b, higher_is_better=False))


@query("d12_compare_summary", _CMP + """
SELECT status, count(*) AS n, round(sum(diff), 6) AS sum_diff, round(avg(diff), 6) AS mean_diff FROM c GROUP BY status""")
def compare_summary(d):
    a, b = _sides(d)
    return _rounded(compare.summarize(compare.compare_tables(a, b, higher_is_better=False)))


@query("c03_compare_accessibility", """
WITH k AS (SELECT case_id, concat_ws(' ', opportunity, cutoff, id) AS id, acc FROM v_acc),
a AS (SELECT id, CASE WHEN acc > 0 THEN acc END AS v FROM k WHERE case_id = 'base'), b AS (SELECT id, acc AS v FROM k WHERE case_id = 'loo_N')
SELECT id, coalesce(a.v, 0)::DOUBLE AS value_a, b.v::DOUBLE AS value_b, (b.v - coalesce(a.v, 0))::DOUBLE AS diff,
       CASE WHEN coalesce(a.v, 0) <> 0 THEN round(100.0 * (b.v - a.v) / a.v, 6) END AS pct_change,
       CASE WHEN b.v = coalesce(a.v, 0) THEN 'same' WHEN b.v > coalesce(a.v, 0) THEN 'better' ELSE 'worse' END AS status
FROM a JOIN b USING (id)""")
def compare_accessibility(d):
    """Two cases side by side, every opportunity, cutoff and origin."""
    rows = d.acc.withColumn("id", F.concat_ws(" ", "opportunity", "cutoff", "id"))
    a = rows.where("case_id = 'base'").select("id", F.when(F.col("acc") > 0, F.col("acc")).alias("value"))
    b = rows.where("case_id = 'loo_N'").select("id", F.col("acc").alias("value"))
    return _rounded(compare.compare_tables(a, b))


@query("c04_method_mismatches", """
WITH a AS (SELECT 'decay' AS field, l_linestatus AS v FROM lineitem UNION SELECT 'modes', l_returnflag FROM lineitem UNION SELECT 'scenario', 'base'),
b AS (SELECT 'decay' AS field, l_linestatus AS v FROM lineitem UNION SELECT 'modes', l_returnflag FROM lineitem WHERE l_returnflag <> 'A' UNION SELECT 'scenario', 'loo')
SELECT field, CASE WHEN field = 'scenario' THEN 0 ELSE 1 END AS blocking, a.s AS values_a, b.s AS values_b
FROM (SELECT field, string_agg(v, ',' ORDER BY v) AS s FROM a GROUP BY field) a JOIN (SELECT field, string_agg(v, ',' ORDER BY v) AS s FROM b GROUP BY field) b USING (field)
WHERE a.s <> b.s""")
def method_mismatches(d):
    items = d.table("lineitem").select(F.col("l_linestatus").alias("decay"), F.col("l_returnflag").alias("modes"))
    a = items.withColumn("scenario", F.lit("base")).withColumn("percentile", F.lit(50))
    b = items.where("modes <> 'A'").withColumn("scenario", F.lit("loo"))
    out = compare.method_mismatches(a, b)
    return out.select("field", F.col("blocking").cast("int").alias("blocking"),
                      F.array_join("values_a", ",").alias("values_a"), F.array_join("values_b", ",").alias("values_b"))


@query("c21_same_row_sets", """
WITH c AS (SELECT from_id, to_id, base IS NOT NULL AS b, loo_A IS NOT NULL AS a, loo_N IS NOT NULL AS n, loo_R IS NOT NULL AS r FROM v_case_times)
SELECT count(*) FILTER (b AND a AND n AND r) AS common, count(*) FILTER (b) AS rows_base, count(*) FILTER (a) AS rows_loo_A,
       count(*) FILTER (n) AS rows_loo_N, count(*) FILTER (r) AS rows_loo_R FROM c""")
def same_row_sets(d):
    reached = {c: d.case_times.where(F.col(c).isNotNull()).select("from_id", "to_id") for c in CASES}
    return compare.same_row_sets(reached, ["from_id", "to_id"])


@query("a26_splice_categories", """
SELECT id, opportunity, acc FROM v_acc WHERE case_id = 'base' AND cutoff = 30 AND opportunity NOT IN ('srv_mall', 'srv_school')
UNION ALL SELECT id, opportunity, acc FROM v_acc WHERE case_id = 'loo_R' AND cutoff = 30 AND opportunity IN ('srv_mall', 'srv_school')""")
def splice_categories(d):
    at30 = d.acc.where("cutoff = 30")
    base = at30.where("case_id = 'base'").select("id", "opportunity", "acc")
    patch = at30.where("case_id = 'loo_R'").select("id", "opportunity", "acc")
    return compare.splice(base, patch, ["srv_mall", "srv_school"])
