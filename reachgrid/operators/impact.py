"""Change against a baseline: per cell, per case, per district, per day.

Accessibility tables are long: (…, id, opportunity, acc). A delta exists only where the
baseline is above zero; a cell that had nothing is excluded, not counted as no change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachgrid.operators.equity import weighted_mean

TOTAL = "total"


def deltas(base: DataFrame, cases: DataFrame, names: Sequence[str], *, case: str = "case_id",
           keys: Sequence[str] = ("id", "opportunity")) -> DataFrame:
    """(case, keys, base, scen, delta) for every baseline row and case name."""
    frame = base.select(*keys, F.col("acc").alias("base")).withColumn(
        case, F.explode(F.array(*[F.lit(n) for n in names])))
    joined = frame.join(cases.select(case, *keys, F.col("acc").alias("scen")), [case, *keys], "left")
    return joined.select(case, *keys, "base", "scen",
                         F.when(F.col("base") != 0, F.col("scen") - F.col("base")).alias("delta"))


def net_deltas(rows: DataFrame, by: Sequence[str] = ("case_id", "id")) -> DataFrame:
    """Per cell: sum over the comparable categories, how many there were, and the baseline total."""
    return rows.groupBy(*by).agg(F.sum("delta").alias("net_delta"), F.count("delta").alias("net_delta_n"),
                                 F.sum(F.coalesce("base", F.lit(0))).alias("base_total"))


def case_summary(net: DataFrame, population: DataFrame, case: str = "case_id") -> DataFrame:
    """Headline numbers of every case: losing and gaining population, weighted mean and relative change."""
    p = F.col("pop")
    rows = net.join(population.select("id", "pop"), "id", "left").withColumn("pop", F.coalesce(p, F.lit(0)))
    d = F.col("net_delta")
    lose = F.sum(F.when(d < 0, p).otherwise(0))
    relative = F.when(F.col("base_total") > 0, d / F.col("base_total"))
    return rows.groupBy(case).agg(
        F.count("*").alias("hexagons"), F.sum(p).alias("population"), weighted_mean(d, p).alias("mean_net"),
        lose.alias("pop_losing"), F.sum(F.when(d > 0, p).otherwise(0)).alias("pop_gaining"),
        F.round(lose / F.nullif(F.sum(p), F.lit(0)), 4).alias("share_losing"),
        weighted_mean(relative, p).alias("mean_relative"))


def category_summary(rows: DataFrame, population: DataFrame, by: Sequence[str] = ("case_id", "opportunity")) -> DataFrame:
    """Per category: weighted mean delta, comparable and zero-baseline cells, people who lost the last one."""
    p, d, b = F.col("pop"), F.col("delta"), F.col("base")
    joined = rows.join(population.select("id", "pop"), "id", "left").withColumn("pop", F.coalesce(p, F.lit(0)))
    cut_off = d.isNotNull() & (b > 0) & (b + d == 0)
    return joined.groupBy(*by).agg(
        weighted_mean(d, p).alias("mean_delta"), F.count(d).alias("comparable"),
        F.count_if(b.isNull() | (b == 0)).alias("zero_baseline"),
        F.sum(F.when(cut_off, p).otherwise(0)).alias("pop_cut_off"))


def centre_change(base: DataFrame, cases: DataFrame, names: Sequence[str], population: DataFrame,
                  case: str = "case_id") -> DataFrame:
    """Change of the travel time to the centre, and people for whom the centre becomes unreachable.

    base: (id, minutes) and cases: (case, id, minutes); an unreachable origin has no row or NULL minutes.
    """
    known = base.where("minutes is not null").select("id", F.col("minutes").alias("b")).withColumn(
        case, F.explode(F.array(*[F.lit(n) for n in names])))
    rows = known.join(cases.where("minutes is not null").select(case, "id", "minutes"), [case, "id"], "left").join(
        population.select("id", "pop"), "id", "left").withColumn("pop", F.coalesce("pop", F.lit(0)))
    return rows.groupBy(case).agg(
        weighted_mean(F.col("minutes") - F.col("b"), F.col("pop")).alias("minutes_delta"),
        F.sum(F.when(F.col("minutes").isNull(), F.col("pop")).otherwise(0)).alias("pop_unreachable"))


def rank_cases(summary: DataFrame, case: str = "case_id", prefix: str = "loo_") -> DataFrame:
    """Leave-one-out cases worst first; a missing mean counts 0, ties go to more people losing.

    One row per case: the window is over the case report, not over cells.
    """
    order = Window.orderBy(F.coalesce("mean_net", F.lit(0.0)), F.desc("pop_losing"), case)
    return summary.where(F.col(case).startswith(prefix)).select(
        F.expr(f"substring({case}, {len(prefix) + 1})").alias("line"), "mean_net", "pop_losing", "share_losing",
        F.row_number().over(order).alias("measured_rank"))


def district_table(net: DataFrame, people: DataFrame, by: Sequence[str] = ("case_id", "district")) -> DataFrame:
    """Per district: residents, comparable residents, losing share and mean change (of the comparable)."""
    p, d = F.col("pop"), F.col("net_delta")
    rows = net.join(people.select("id", "pop", "district"), "id").where("district is not null and district <> ''")
    some = d.isNotNull()
    comparable = F.sum(F.when(some, p).otherwise(0))
    num, held = F.sum(d * p), F.sum(F.when(some, F.col("base_total") * p))
    lose = F.sum(F.when(d < 0, p).otherwise(0))
    none = F.lit(0)
    return rows.groupBy(*by).agg(
        F.sum(p).alias("population"), comparable.alias("population_comparable"), lose.alias("pop_losing"),
        F.round(lose / F.nullif(comparable, none), 4).alias("share_losing"),
        F.round(num / F.nullif(comparable, none), 3).alias("mean_net"),
        F.round(num / F.nullif(held, none), 4).alias("mean_relative"))


def breakdown(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Cells gaining, losing, unchanged and without baseline; weighted and unweighted means."""
    v, p = F.col(value), F.coalesce("pop", F.lit(0))
    comparable = F.count(v)
    pct = lambda hit: F.round(100 * F.count_if(hit) / F.nullif(comparable, F.lit(0)), 1)
    return rows.groupBy(*by).agg(
        F.count("*").alias("hex_total"), comparable.alias("comparable"), F.count_if(v.isNull()).alias("no_baseline"),
        F.count_if(v > 0).alias("gain"), F.count_if(v < 0).alias("loss"), F.count_if(v == 0).alias("unchanged"),
        pct(v > 0).alias("gain_pct"), pct(v < 0).alias("loss_pct"), F.round(F.avg(v), 3).alias("mean_unweighted"),
        F.round(F.sum(v * p) / F.nullif(F.sum(F.when(v.isNotNull(), p)), F.lit(0)), 3).alias("mean_weighted"))


def sign_profile(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Residents and cells by loss, zero or gain."""
    kind = F.when(F.col(value) < 0, "loss").when(F.col(value) > 0, "gain").otherwise("zero")
    return rows.where(F.col(value).isNotNull()).groupBy(*by, kind.alias("kind")).agg(
        F.sum(F.coalesce("pop", F.lit(0))).alias("pop"), F.count("*").alias("cells"))


# --- levels and deltas with a total over categories ---------------------------------

def with_total(acc: DataFrame, keys: Sequence[str], value: str = "acc") -> DataFrame:
    """Adds a 'total' category summed from the raw values."""
    both = acc.select(*keys, value, F.explode(F.array(F.col("opportunity"), F.lit(TOTAL))).alias("opportunity"))
    return both.groupBy(*keys, "opportunity").agg(F.sum(F.coalesce(value, F.lit(0))).alias(value))


def delta_layer(static: DataFrame, realized: DataFrame, keys: Sequence[str] = ("id", "cutoff")) -> DataFrame:
    """(keys, category incl. total, base, base0, delta): the total's delta comes from raw sums."""
    cats = static.join(realized.select(*keys, "opportunity", F.col("acc").alias("r")), [*keys, "opportunity"], "left")
    cats = cats.select(*keys, "opportunity", F.col("acc").alias("base"), "r")
    sums = cats.groupBy(*keys).agg(F.sum(F.coalesce("base", F.lit(0))).alias("base"), F.sum(F.coalesce("r", F.lit(0))).alias("r"))
    rows = cats.unionByName(sums.withColumn("opportunity", F.lit(TOTAL)))
    zero = F.coalesce(F.col("base") == 0, F.lit(True))
    return rows.select(*keys, "opportunity", "base", zero.cast("int").alias("base0"),
                       F.when(~zero, F.col("r") - F.col("base")).alias("delta"))


def comparable_count(layer: DataFrame, last_cutoff: int) -> DataFrame:
    """(id, net_delta_n): comparable categories at the last cutoff."""
    hit = (F.col("cutoff") == last_cutoff) & (F.col("opportunity") != TOTAL) & F.col("delta").isNotNull()
    return layer.groupBy("id").agg(F.count_if(hit).alias("net_delta_n"))


def weighted_summary(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Σ pop·value / Σ pop over the rows that have a value."""
    v, p = F.col(value), F.coalesce("pop", F.lit(0))
    return rows.groupBy(*by).agg(
        (F.sum(v * p) / F.nullif(F.sum(F.when(v.isNotNull(), p)), F.lit(0))).alias("mean"),
        F.count(v).alias("comparable"))


def delta_summary(layer: DataFrame, population: DataFrame, by: Sequence[str] = ("opportunity", "cutoff")) -> DataFrame:
    rows = layer.join(population.select("id", "pop"), "id")
    zero = rows.groupBy(*by).agg(F.sum("base0").alias("zero_baseline"))
    return weighted_summary(rows, "delta", by).join(zero, list(by))


def threshold_layer(acc: DataFrame, low: int, high: int) -> DataFrame:
    """(id, category incl. total, lo, hi, growth, ratio): what a larger time budget adds."""
    at = lambda c: F.sum(F.when(F.col("cutoff") == c, F.coalesce("acc", F.lit(0))).otherwise(0))
    both = acc.select("id", "cutoff", "acc", F.explode(F.array(F.col("opportunity"), F.lit(TOTAL))).alias("opportunity"))
    wide = both.groupBy("id", "opportunity").agg(at(low).alias("lo"), at(high).alias("hi"))
    return wide.select("*", (F.col("hi") - F.col("lo")).alias("growth"),
                       F.when(F.col("lo") != 0, F.col("hi") / F.col("lo")).alias("ratio"))


def threshold_summary(layer: DataFrame, population: DataFrame) -> DataFrame:
    """Mean of ratios, ratio of weighted sums, mean growth, emerged and still-zero cells per category."""
    rows = layer.join(population.select("id", "pop"), "id")
    p = F.coalesce("pop", F.lit(0))
    def mean(v: Column) -> Column:
        return F.sum(v * p) / F.nullif(F.sum(F.when(v.isNotNull(), p)), F.lit(0))
    return rows.groupBy("opportunity").agg(
        mean(F.col("ratio")).alias("mean_ratio"),
        (F.sum(p * F.col("hi")) / F.nullif(F.sum(p * F.col("lo")), F.lit(0))).alias("ratio_of_sums"),
        mean(F.col("growth")).alias("mean_growth"), F.count("ratio").alias("with_access"),
        F.count_if((F.col("lo") == 0) & (F.col("hi") > 0)).alias("emerged"),
        F.count_if((F.col("lo") == 0) & (F.col("hi") == 0)).alias("still_zero"))


def day_deltas(static: DataFrame, realized: DataFrame, *, per_day_static: bool) -> DataFrame:
    """(day, id, category incl. total, base, delta); the baseline is shared or each day's own."""
    r = with_total(realized, ["day", "id"]).withColumnRenamed("acc", "r")
    if per_day_static:
        s = with_total(static, ["day", "id"])
        rows = s.join(r, ["day", "id", "opportunity"], "left")
    else:
        s = with_total(static, ["id"])
        rows = r.join(s, ["id", "opportunity"])
    return rows.select("day", "id", "opportunity", F.col("acc").alias("base"),
                       F.when(F.col("acc") != 0, F.col("r") - F.col("acc")).alias("delta"))


def day_layer(rows: DataFrame) -> DataFrame:
    """Per cell and category: mean and spread of the day deltas; base0 when no day had a baseline."""
    return rows.groupBy("id", "opportunity").agg(
        F.avg("delta").alias("avg_delta"), (F.max("delta") - F.min("delta")).alias("spread"),
        (F.coalesce(F.max("base"), F.lit(0)) == 0).cast("int").alias("base0"))


def day_summary(rows: DataFrame, population: DataFrame) -> DataFrame:
    """Weighted mean per category and day, plus the 'avg' row: the mean of the day means."""
    joined = rows.join(population.select("id", "pop"), "id")
    per_day = weighted_summary(joined, "delta", ["opportunity", "day"]).join(
        joined.groupBy("opportunity", "day").agg(F.count_if(F.col("base") == 0).alias("zero_baseline")), ["opportunity", "day"])
    per_day = per_day.select("opportunity", F.col("day").cast("string").alias("day"), "mean", "comparable", "zero_baseline")
    average = per_day.groupBy("opportunity").agg(F.avg("mean").alias("mean")).select(
        "opportunity", F.lit("avg").alias("day"), "mean", F.lit(None).cast("bigint").alias("comparable"),
        F.lit(None).cast("bigint").alias("zero_baseline"))
    return per_day.unionByName(average)
