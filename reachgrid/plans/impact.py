"""Scenario impact, modal, regional and multi-day queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reachgrid.operators import equity, impact, modal
from reachgrid.plans.registry import query
from reachgrid.plans.views import CASES, SERVICES, SQL_VIEWS

LOO = CASES[1:]

# Scenario results at 30 minutes; every 29th cell is missing from the scenario runs.
SQL_VIEWS["v_deltas"] = """
    SELECT s.case_id, b.id, b.opportunity, b.acc AS base, CASE WHEN b.id % 29 <> 0 THEN s.acc END AS scen,
           CASE WHEN b.acc <> 0 AND b.id % 29 <> 0 THEN s.acc - b.acc END AS delta
    FROM v_acc b JOIN v_acc s USING (id, opportunity, cutoff) WHERE b.case_id = 'base' AND s.case_id <> 'base' AND cutoff = 30"""
SQL_VIEWS["v_net"] = """SELECT case_id, id, sum(delta)::BIGINT AS net_delta, count(delta) AS net_delta_n, sum(base)::BIGINT AS base_total FROM v_deltas GROUP BY ALL"""
_WMEAN = "sum(CASE WHEN {v} IS NOT NULL AND pop > 0 THEN {v} * pop END) / nullif(sum(CASE WHEN {v} IS NOT NULL AND pop > 0 THEN pop END), 0)"


def deltas(d):
    at30 = d.acc.where("cutoff = 30")
    base = at30.where("case_id = 'base'").select("id", "opportunity", "acc")
    return impact.deltas(base, at30.where("case_id <> 'base' and id % 29 <> 0"), LOO)


def net(d):
    return impact.net_deltas(deltas(d))


def _r(df, *columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


@query("f01_cell_deltas", """
SELECT d.case_id, d.id, opportunity, base, scen, delta, net_delta, net_delta_n FROM v_deltas d JOIN v_net USING (case_id, id)""")
def cell_deltas(d):
    return deltas(d).join(net(d).drop("base_total"), ["case_id", "id"])


@query("f02_f04_case_summary", f"""
SELECT case_id, count(*) AS hexagons, sum(pop)::BIGINT AS population, round({_WMEAN.format(v='net_delta')}, 6) AS mean_net,
       coalesce(sum(pop) FILTER (net_delta < 0), 0)::BIGINT AS pop_losing, coalesce(sum(pop) FILTER (net_delta > 0), 0)::BIGINT AS pop_gaining,
       round(coalesce(sum(pop) FILTER (net_delta < 0), 0) / sum(pop), 4) AS share_losing,
       round({_WMEAN.format(v='(CASE WHEN base_total > 0 THEN net_delta / base_total END)')}, 6) AS mean_relative
FROM v_net JOIN v_people USING (id) GROUP BY case_id""")
def case_summary(d):
    return _r(impact.case_summary(net(d), d.people), "mean_net", "mean_relative")


_CATEGORY = """
SELECT {k}, opportunity, round(""" + _WMEAN.format(v="delta") + """, 6) AS mean_delta, count(delta) AS comparable,
       count(*) FILTER (coalesce(base, 0) = 0) AS zero_baseline, coalesce(sum(pop) FILTER (delta IS NOT NULL AND base > 0 AND base + delta = 0), 0)::BIGINT AS pop_cut_off
FROM v_deltas JOIN v_people USING (id) GROUP BY ALL"""


@query("f03_f04_category_summary", _CATEGORY.format(k="case_id"))
def category_summary(d):
    return _r(impact.category_summary(deltas(d), d.people), "mean_delta")


_CENTRE = """c AS (SELECT 'base' AS case_id, from_id AS id, base AS m FROM v_case_times WHERE to_id = 0 UNION ALL SELECT 'loo_A', from_id, loo_A FROM v_case_times WHERE to_id = 0
    UNION ALL SELECT 'loo_N', from_id, loo_N FROM v_case_times WHERE to_id = 0 UNION ALL SELECT 'loo_R', from_id, loo_R FROM v_case_times WHERE to_id = 0)"""


@query("f05_centre_change", f"""
WITH {_CENTRE}, j AS (SELECT s.case_id, b.id, s.m - b.m AS d, pop FROM c b JOIN c s ON s.id = b.id AND s.case_id <> 'base' JOIN v_people p ON p.id = b.id WHERE b.case_id = 'base' AND b.m IS NOT NULL)
SELECT case_id, round({_WMEAN.format(v='d')}, 6) AS minutes_delta, coalesce(sum(pop) FILTER (d IS NULL), 0)::BIGINT AS pop_unreachable FROM j GROUP BY case_id""")
def centre_change(d):
    to_centre = d.case_long.where("to_id = 0").select("case_id", F.col("from_id").alias("id"), "minutes")
    out = impact.centre_change(to_centre.where("case_id = 'base'").drop("case_id"), to_centre.where("case_id <> 'base'"), LOO, d.people)
    return _r(out, "minutes_delta")


_SUMMARY = f"""s AS (SELECT case_id, {_WMEAN.format(v='net_delta')} AS mean_net, coalesce(sum(pop) FILTER (net_delta < 0), 0)::BIGINT AS pop_losing,
    round(coalesce(sum(pop) FILTER (net_delta < 0), 0) / sum(pop), 4) AS share_losing FROM v_net JOIN v_people USING (id) GROUP BY case_id)"""


@query("f06_rank_cases", f"""
WITH {_SUMMARY} SELECT substr(case_id, 5) AS line, round(mean_net, 6) AS mean_net, pop_losing, share_losing,
       row_number() OVER (ORDER BY coalesce(mean_net, 0), pop_losing DESC, case_id) AS measured_rank FROM s""")
def rank_cases(d):
    out = impact.rank_cases(impact.case_summary(net(d), d.people))
    return _r(out, "mean_net").withColumn("measured_rank", F.col("measured_rank").cast("bigint"))


@query("c20_expected_and_measured_rank", f"""
WITH {_SUMMARY}, e AS (SELECT l_returnflag AS line, count(*) AS trips, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS expected_rank FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_returnflag)
SELECT substr(case_id, 5) AS line, row_number() OVER (ORDER BY coalesce(mean_net, 0), pop_losing DESC, case_id) AS measured_rank, trips, expected_rank FROM s LEFT JOIN e ON e.line = substr(case_id, 5)""")
def expected_and_measured_rank(d):
    measured = impact.rank_cases(impact.case_summary(net(d), d.people)).select("line", F.col("measured_rank").cast("bigint").alias("measured_rank"))
    expected = d.table("lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_returnflag").alias("line")).agg(F.count("*").alias("trips"))
    expected = expected.withColumn("expected_rank", F.row_number().over(Window.orderBy(F.desc("trips"), "line")).cast("bigint"))
    return measured.join(expected, "line", "left")


@query("f07_district_table", """
SELECT case_id, district, sum(pop)::BIGINT AS population, coalesce(sum(pop) FILTER (net_delta IS NOT NULL), 0)::BIGINT AS population_comparable,
       coalesce(sum(pop) FILTER (net_delta < 0), 0)::BIGINT AS pop_losing,
       round(coalesce(sum(pop) FILTER (net_delta < 0), 0) / nullif(sum(pop) FILTER (net_delta IS NOT NULL), 0), 4) AS share_losing,
       round(sum(net_delta * pop) / nullif(sum(pop) FILTER (net_delta IS NOT NULL), 0), 3) AS mean_net,
       round(sum(net_delta * pop) / nullif(sum(base_total * pop) FILTER (net_delta IS NOT NULL), 0), 4) AS mean_relative
FROM v_net JOIN v_people USING (id) GROUP BY ALL""")
def district_table(d):
    return impact.district_table(net(d), d.people)


@query("f08_population_terciles", """
WITH v AS (SELECT id, pop, CASE WHEN id % 31 <> 0 THEN (id * 7919 % 977) / 10.0 END AS rate FROM v_people),
r AS (SELECT rate, sum(sum(pop)) OVER (ORDER BY rate) AS cw, sum(sum(pop)) OVER () AS tw FROM v WHERE rate IS NOT NULL AND pop > 0 GROUP BY rate),
c AS (SELECT min(rate) FILTER (cw >= tw / 3) AS lo_, min(rate) FILTER (cw >= 2 * tw / 3) AS hi_ FROM r)
SELECT CASE WHEN rate IS NULL THEN NULL WHEN rate <= lo_ THEN 'low' WHEN rate <= hi_ THEN 'mid' ELSE 'high' END AS tercile, count(*) AS cells, sum(pop)::BIGINT AS pop FROM v CROSS JOIN c GROUP BY 1""")
def population_terciles(d):
    rated = d.people.withColumn("rate", F.when(F.col("id") % 31 != 0, F.col("id") * 7919 % 977 / 10.0))
    out = equity.terciles(rated, "rate", "pop")
    return out.groupBy("tercile").agg(F.count("*").alias("cells"), F.sum("pop").alias("pop"))


_BREAKDOWN = """count(*) AS hex_total, count({v}) AS comparable, count(*) FILTER ({v} IS NULL) AS no_baseline, count(*) FILTER ({v} > 0) AS gain, count(*) FILTER ({v} < 0) AS loss,
       count(*) FILTER ({v} = 0) AS unchanged, round(100 * count(*) FILTER ({v} > 0) / nullif(count({v}), 0), 1) AS gain_pct, round(100 * count(*) FILTER ({v} < 0) / nullif(count({v}), 0), 1) AS loss_pct,
       round(avg({v}), 3) AS mean_unweighted, round(sum({v} * pop) / nullif(sum(pop) FILTER ({v} IS NOT NULL), 0), 3) AS mean_weighted"""


@query("f09_breakdown", f"""
SELECT case_id, opportunity AS metric, {_BREAKDOWN.format(v='delta')} FROM v_deltas JOIN v_people USING (id) GROUP BY ALL
UNION ALL SELECT case_id, 'net', {_BREAKDOWN.format(v='net_delta')} FROM v_net JOIN v_people USING (id) GROUP BY ALL""")
def breakdown(d):
    people = d.people.select("id", "pop")
    per_category = deltas(d).join(people, "id").select("case_id", F.col("opportunity").alias("metric"), "pop", F.col("delta").alias("v"))
    whole = net(d).join(people, "id").select("case_id", F.lit("net").alias("metric"), "pop", F.col("net_delta").alias("v"))
    return impact.breakdown(per_category.unionByName(whole), "v", ["case_id", "metric"])


@query("f10_sign_profile", """
SELECT case_id, opportunity, CASE WHEN delta < 0 THEN 'loss' WHEN delta > 0 THEN 'gain' ELSE 'zero' END AS kind, sum(pop)::BIGINT AS pop, count(*) AS cells
FROM v_deltas JOIN v_people USING (id) WHERE delta IS NOT NULL GROUP BY ALL""")
def sign_profile(d):
    return impact.sign_profile(deltas(d).join(d.people.select("id", "pop"), "id"), "delta", ["case_id", "opportunity"])


# --- modal ----------------------------------------------------------------------------

SQL_VIEWS["v_modal"] = """
    SELECT id, cutoff, sum(acc) FILTER (case_id = 'loo_R')::DOUBLE AS w, sum(acc) FILTER (case_id = 'loo_A')::DOUBLE AS t,
           sum(acc) FILTER (case_id = 'loo_N')::DOUBLE AS b, sum(acc) FILTER (case_id = 'base')::DOUBLE AS tb FROM v_acc GROUP BY ALL"""
K = 12


def modal_table(d):
    names = F.create_map(*[F.lit(v) for pair in (("loo_R", "W"), ("loo_A", "T"), ("loo_N", "B"), ("base", "TB")) for v in pair])
    total = d.acc.groupBy("case_id", "id", "cutoff").agg(F.sum("acc").alias("acc"))
    return modal.modal_wide(total.select(names[F.col("case_id")].alias("mode_case"), "id", "cutoff", "acc"))


_SHARES = ("walk_share", "tram_share", "bus_share", "mode_balance", "transfer_premium_rel", "subadd")
SQL_VIEWS["v_modal_metrics"] = f"""
    SELECT m.*, tb - b AS tram_gain, tb - t AS bus_gain, greatest(t, b) AS no_transfer, tb - greatest(t, b) AS transfer_premium,
           CASE WHEN gate AND tb > 0 THEN w / tb END AS walk_share, CASE WHEN gate AND tb > 0 THEN (tb - b) / tb END AS tram_share,
           CASE WHEN gate AND tb > 0 THEN (tb - t) / tb END AS bus_share, CASE WHEN gate AND tb > 0 THEN (t - b) / tb END AS mode_balance,
           CASE WHEN gate AND tb > 0 THEN (tb - greatest(t, b)) / tb END AS transfer_premium_rel,
           CASE WHEN gate AND tb > 0 AND greatest(0, t - w) + greatest(0, b - w) > 0 THEN greatest(0, tb - w) / (greatest(0, t - w) + greatest(0, b - w)) END AS subadd
    FROM v_modal m JOIN (SELECT id, tb >= {K} AS gate FROM v_modal WHERE cutoff = 30) USING (id)"""


@query("f11_b16_modal_metrics", "SELECT id, cutoff, w, t, b, tb, tram_gain, bus_gain, no_transfer, transfer_premium, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _SHARES) + " FROM v_modal_metrics")
def modal_metrics(d):
    wide = modal_table(d)
    return _r(modal.modal_metrics(wide, modal.reliability_gate(wide, K, 30)), *_SHARES)


@query("b16_reliability_gate", f"SELECT count(*) FILTER (tb >= {K}) AS passing, count(*) FILTER (tb < {K}) AS failing FROM v_modal WHERE cutoff = 30")
def reliability_gate(d):
    gate = modal.reliability_gate(modal_table(d), K, 30)
    return gate.agg(F.count_if("gate").alias("passing"), F.count_if(~F.col("gate")).alias("failing"))


@query("f12_city_modal_summary", f"""
WITH j AS (SELECT cutoff, pop, w, t, b, tb, greatest(t, b) AS nt FROM v_modal JOIN v_people USING (id)),
m AS (SELECT cutoff, """ + ", ".join(f"sum(pop * {c}) / sum(pop) AS m_{c}, sum(CASE WHEN {c} >= {K} THEN pop ELSE 0 END) / sum(pop) AS c_{c}" for c in ("w", "t", "b", "tb", "nt")) + """ FROM j GROUP BY cutoff),
s AS (SELECT *, round(CASE WHEN greatest(0, m_t - m_w) + greatest(0, m_b - m_w) > 0 THEN greatest(0, m_tb - m_w) / (greatest(0, m_t - m_w) + greatest(0, m_b - m_w)) END, 4) AS subadd_city FROM m)
""" + " UNION ALL ".join(f"""SELECT cutoff, '{n}' AS "case", round(m_{c}, 2) AS acc_weighted_mean, round(c_{c} * 100, 2) AS coverage_pct, subadd_city FROM s"""
                           for n, c in (("W", "w"), ("T", "t"), ("B", "b"), ("no_transfer", "nt"), ("TB", "tb"))))
def city_modal_summary(d):
    return modal.city_modal_summary(modal_table(d), d.people, K)


@query("f13_two_weight_mean", """
WITH j AS (SELECT tram_share, pop, CASE WHEN id % 7 <> 0 THEN id % 100 END AS young FROM v_modal_metrics JOIN v_people USING (id) WHERE cutoff = 30)
SELECT count(*) AS cells, round(sum(young * tram_share) / sum(young), 6) AS mean_young, round(sum(pop * tram_share) / sum(pop), 6) AS mean_pop
FROM j WHERE tram_share IS NOT NULL AND young IS NOT NULL""")
def two_weight_mean(d):
    wide = modal_table(d)
    rows = modal.modal_metrics(wide, modal.reliability_gate(wide, K, 30)).where("cutoff = 30").join(d.people.select("id", "pop"), "id")
    rows = rows.withColumn("young", F.when(F.col("id") % 7 != 0, F.col("id") % 100))
    return _r(modal.two_weight_mean(rows, "tram_share", ("young", "pop")), "mean_young", "mean_pop")


@query("f14_modal_invariants", """
SELECT count(*) AS rows_checked, count(*) FILTER (w > t + 1e-6 OR w > b + 1e-6 OR w > tb + 1e-6) AS i1_violations,
       count(*) FILTER (tb + 1e-6 < greatest(t, b)) AS i2_violations, round(avg(abs(t - b)) / avg(tb), 6) AS i3_value FROM v_modal""")
def modal_invariants(d):
    return _r(modal.invariants(modal_table(d)), "i3_value")


# --- regional and multi-day --------------------------------------------------------------

SQL_VIEWS["v_static"] = "SELECT id, opportunity, cutoff, acc FROM v_acc WHERE case_id = 'base'"
SQL_VIEWS["v_layer"] = """
    SELECT id, opportunity, cutoff, base, (base = 0)::INT::BIGINT AS base0, CASE WHEN base <> 0 THEN r - base END AS delta FROM (
      SELECT s.id, s.opportunity, s.cutoff, s.acc AS base, CASE WHEN s.id % 29 <> 0 THEN r.acc END AS r FROM v_static s JOIN v_acc r USING (id, opportunity, cutoff) WHERE r.case_id = 'loo_N'
      UNION ALL SELECT s.id, 'total', s.cutoff, sum(s.acc)::BIGINT, sum(CASE WHEN s.id % 29 <> 0 THEN r.acc ELSE 0 END)::BIGINT FROM v_static s JOIN v_acc r USING (id, opportunity, cutoff) WHERE r.case_id = 'loo_N' GROUP BY ALL)"""


def static(d):
    return d.acc.where("case_id = 'base'").drop("case_id")


def layer(d):
    return impact.delta_layer(static(d), d.acc.where("case_id = 'loo_N' and id % 29 <> 0").drop("case_id"))


@query("f15_level_summary", """
SELECT opportunity, cutoff, round(sum(acc * pop) / sum(pop), 6) AS mean, count(*) AS hexagons
FROM (SELECT * FROM v_static UNION ALL SELECT id, 'total', cutoff, sum(acc) FROM v_static GROUP BY id, cutoff) JOIN v_people USING (id) GROUP BY ALL""")
def level_summary(d):
    levels = impact.with_total(static(d), ["id", "cutoff"]).join(d.people.select("id", "pop"), "id")
    out = impact.weighted_summary(levels, "acc", ["opportunity", "cutoff"])
    return _r(out, "mean").withColumnRenamed("comparable", "hexagons")


@query("f16_delta_layer", """
SELECT l.id, opportunity, cutoff, base, base0, delta::BIGINT AS delta, n AS net_delta_n FROM v_layer l JOIN (
    SELECT id, count(delta) FILTER (cutoff = 60 AND opportunity <> 'total') AS n FROM v_layer GROUP BY id) USING (id)""")
def delta_layer(d):
    rows = layer(d)
    return rows.join(impact.comparable_count(rows, 60), "id")


@query("f17_delta_summary", """
SELECT opportunity, cutoff, round(sum(delta * pop) / sum(CASE WHEN delta IS NOT NULL THEN pop END), 6) AS mean, count(delta) AS comparable, sum(base0)::BIGINT AS zero_baseline
FROM v_layer JOIN v_people USING (id) GROUP BY ALL""")
def delta_summary(d):
    return _r(impact.delta_summary(layer(d), d.people), "mean")


SQL_VIEWS["v_threshold"] = """SELECT id, opportunity, sum(acc) FILTER (cutoff = 30)::BIGINT AS lo_, sum(acc) FILTER (cutoff = 60)::BIGINT AS hi_ FROM (
    SELECT * FROM v_static UNION ALL SELECT id, 'total', cutoff, acc FROM v_static) GROUP BY ALL"""


@query("f18_threshold_layer", "SELECT id, opportunity, lo_ AS lo, hi_ AS hi, hi_ - lo_ AS growth, round(CASE WHEN lo_ <> 0 THEN hi_ / lo_ END, 6) AS ratio FROM v_threshold")
def threshold_layer(d):
    return _r(impact.threshold_layer(static(d), 30, 60), "ratio")


@query("f19_threshold_summary", """
SELECT opportunity, round(sum(CASE WHEN lo_ <> 0 THEN hi_ / lo_ * pop END) / sum(CASE WHEN lo_ <> 0 THEN pop END), 6) AS mean_ratio, round(sum(pop * hi_) / sum(pop * lo_), 6) AS ratio_of_sums,
       round(sum(pop * (hi_ - lo_)) / sum(pop), 6) AS mean_growth, count(*) FILTER (lo_ <> 0) AS with_access, count(*) FILTER (lo_ = 0 AND hi_ > 0) AS emerged, count(*) FILTER (lo_ = 0 AND hi_ = 0) AS still_zero
FROM v_threshold JOIN v_people USING (id) GROUP BY opportunity""")
def threshold_summary(d):
    return _r(impact.threshold_summary(impact.threshold_layer(static(d), 30, 60), d.people), "mean_ratio", "ratio_of_sums", "mean_growth")


_WITH_TOTAL = "SELECT {k} id, opportunity, acc FROM {v} UNION ALL SELECT {k} id, 'total', sum(acc)::BIGINT FROM {v} GROUP BY ALL"
SQL_VIEWS["v_static30"] = "SELECT id, opportunity, acc FROM v_static WHERE cutoff = 30"
SQL_VIEWS["v_day_deltas"] = f"""SELECT r.day, r.id, r.opportunity, s.acc AS base, CASE WHEN s.acc <> 0 THEN r.acc - s.acc END AS delta
    FROM ({_WITH_TOTAL.format(k='day,', v='v_day_acc')}) r JOIN ({_WITH_TOTAL.format(k='', v='v_static30')}) s USING (id, opportunity)"""


def day_rows(d):
    shared = static(d).where("cutoff = 30").select("id", "opportunity", "acc")
    return impact.day_deltas(shared, d.day_acc, per_day_static=False)


@query("f20_day_layer", """
SELECT id, opportunity, round(avg(delta), 6) AS avg_delta, max(delta) - min(delta) AS spread, (max(base) = 0)::INT::BIGINT AS base0 FROM v_day_deltas GROUP BY ALL""")
def day_layer(d):
    return _r(impact.day_layer(day_rows(d)), "avg_delta")


_DAY_SUMMARY = """
WITH p AS (SELECT opportunity, day, sum(delta * pop) / nullif(sum(CASE WHEN delta IS NOT NULL THEN pop END), 0) AS m, count(delta) AS comparable, count(*) FILTER (base = 0) AS zero_baseline
           FROM {v} JOIN v_people USING (id) GROUP BY ALL)
SELECT opportunity, day::VARCHAR AS day, round(m, 6) AS mean, comparable, zero_baseline FROM p
UNION ALL SELECT opportunity, 'avg', round(avg(m), 6), NULL, NULL FROM p GROUP BY opportunity"""


@query("f20_day_summary", _DAY_SUMMARY.format(v="v_day_deltas"))
def day_summary(d):
    return _r(impact.day_summary(day_rows(d), d.people), "mean")


SQL_VIEWS["v_day_own"] = """SELECT r.day, r.id, r.opportunity, s.acc AS base, CASE WHEN s.acc <> 0 THEN r.acc - s.acc END AS delta
    FROM (""" + _WITH_TOTAL.format(k="day,", v="v_day_acc") + """) s JOIN (SELECT (day + 1) % 3 AS day, id, opportunity, acc FROM (""" + _WITH_TOTAL.format(k="day,", v="v_day_acc") + """)) r USING (day, id, opportunity)"""


@query("f20_day_summary_own_baseline", _DAY_SUMMARY.format(v="v_day_own"))
def day_summary_own_baseline(d):
    shifted = d.day_acc.withColumn("day", (F.col("day") + 1) % 3)
    rows = impact.day_deltas(d.day_acc, shifted, per_day_static=True)
    return _r(impact.day_summary(rows, d.people), "mean")
