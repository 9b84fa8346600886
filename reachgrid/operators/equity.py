"""Population-weighted distribution statistics: shares, quantiles, Gini, terciles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.scale import running_totals
from reachgrid.functions.values import number

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def _measured(records: DataFrame, fields: Sequence[str], weight: str, group: str | None) -> DataFrame:
    """(grp, field, x, w) per record: NULL access is 0; the weight is kept raw."""
    label = F.lit("(none)") if group is None else F.col(group).cast("string")
    label = F.when(label.isNull() | (label == ""), "(none)").otherwise(label)
    values = F.array(*[F.struct(F.lit(f).alias("field"),
                                F.coalesce(number(F.col(f)), F.lit(0.0)).alias("x")) for f in fields])
    return records.select(label.alias("grp"), number(F.col(weight)).alias("w"), F.inline(values))


def summarize(records: DataFrame, weight: str, fields: Sequence[str], threshold: float,
              group: str | None = None) -> DataFrame:
    """One row per field for 'ALL' and for each group.

    Equal values are collapsed first (partial aggregation), the ALL rows come from the
    collapsed table, and running weights go through range-split prefix sums, so neither
    a hot group nor the ungrouped total is sorted in one task.
    """
    raw = _measured(records, fields, weight, group)
    collapsed = raw.groupBy("grp", "field", "x").agg(
        F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("w"))), F.lit(0.0)).alias("w"),
        F.count_if(F.col("w").isNull() | (F.col("w") < 0)).alias("skipped"))
    if group is None:
        both = collapsed.withColumn("grp", F.lit("ALL"))
    else:
        both = collapsed.select(F.inline(F.array(
            F.struct("grp", "field", "x", "w", "skipped"),
            F.struct(F.lit("ALL").alias("grp"), "field", "x", "w", "skipped"))))
        both = both.groupBy("grp", "field", "x").agg(F.sum("w").alias("w"), F.sum("skipped").alias("skipped"))
    run = running_totals(both, ["grp", "field"], "x",
                         {"cw": F.col("w"), "cwx": F.col("w") * F.col("x")})
    x, w = F.col("x"), F.col("w")
    total = F.max("cw_all")
    gap = F.sum(w * (x * (F.col("cw") - w) - (F.col("cwx") - w * x)))
    mean = F.max("cwx_all") / total
    gini = F.when((total > 0) & (F.min(F.when(w > 0, x)) >= 0) & (mean > 0), gap / (total * total * mean))
    quantiles = [F.min(F.when((F.col("cw_all") > 0) & (w > 0) & (F.col("cw") >= q * F.col("cw_all") - 1e-9), x))
                 .alias(f"p{int(q * 100)}") for q in QUANTILES]
    at_least = F.coalesce(F.sum(F.when(x >= threshold, w)), F.lit(0.0))
    zero = F.coalesce(F.sum(F.when(x <= 0, w)), F.lit(0.0))
    return run.groupBy("grp", "field").agg(
        total.alias("population"), at_least.alias("pop_at_least"),
        F.when(total > 0, at_least / total).alias("share_at_least"),
        zero.alias("pop_zero"), F.when(total > 0, zero / total).alias("share_zero"),
        F.when(total > 0, mean).alias("mean"), gini.alias("gini"),
        F.sum("skipped").alias("skipped"), *quantiles)


def gini_trapezoid(df: DataFrame, groups: Sequence[str], value: str, weight: str) -> DataFrame:
    """Gini by the area under the Lorenz curve: 0 when nothing is held, NULL values dropped, 4 decimals."""
    held = (df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
            .groupBy(*groups, F.col(value).cast("double").alias("x"))
            .agg(F.sum(F.col(weight).cast("double")).alias("w")))
    run = running_totals(held, groups, "x", {"cw": F.col("w"), "cv": F.col("w") * F.col("x")})
    # Within equal values the Lorenz curve is a straight line, so collapsing them keeps the area.
    area = F.sum(F.col("w") * (2 * F.col("cv") - F.col("w") * F.col("x"))) / 2
    area = area / (F.max("cw_all") * F.max("cv_all"))
    return run.groupBy(*groups).agg(
        F.when(F.max("cv_all") <= 0, 0.0).otherwise(F.round(1 - 2 * area, 4)).alias("gini"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean over rows with a value and a positive weight; NULL when there is none."""
    ok = value.isNotNull() & (weight > 0)
    return F.sum(F.when(ok, value * weight)) / F.nullif(F.sum(F.when(ok, weight)), F.lit(0))


def tercile_cuts(df: DataFrame, value: str, weight: str) -> DataFrame:
    """One row (low_cut, high_cut): values that split the people, not the cells, in thirds.

    The second cut is looked for after the row that made the first one, so a single cell
    holding over two thirds of the people moves it to the next cell.
    """
    held = (df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(F.col(value).alias("x"))
            .agg(F.sum(F.col(weight).cast("double")).alias("w"), F.max(F.col(weight).cast("double")).alias("top")))
    run = running_totals(held, [], "x", {"cw": F.col("w")})
    third, both = F.col("cw") >= F.col("cw_all") / 3, F.col("cw") >= 2 * F.col("cw_all") / 3
    cuts = run.agg(F.min(F.when(third, F.col("x"))).alias("low_cut"),
                   F.min(F.when(both, F.col("x"))).alias("high_cut"))
    low = cuts.select("low_cut").scalar()
    single = run.select(
        F.when((F.col("x") == low) & (F.col("cw") - F.col("top") < F.col("cw_all") / 3), 1).otherwise(0).alias("last"),
        F.when(F.col("x") > low, F.col("x")).alias("after")).agg(
        F.max("last").alias("last"), F.min("after").alias("after"))
    return cuts.select("low_cut", F.when(
        (F.col("high_cut") > F.col("low_cut")) | (single.select("last").scalar() == 0), F.col("high_cut"))
        .otherwise(single.select("after").scalar()).alias("high_cut"))


def terciles(df: DataFrame, value: str, weight: str, name: str = "tercile") -> DataFrame:
    """Adds 'low', 'mid' or 'high' by population-weighted terciles of ``value``."""
    cuts = tercile_cuts(df, value, weight)
    low, high = cuts.select("low_cut").scalar(), cuts.select("high_cut").scalar()
    v = F.col(value)
    return df.withColumn(name, F.when(v.isNull(), None).when(v <= low, "low").when(v <= high, "mid").otherwise("high"))


def _pattern(c: Column, pattern: str) -> Column:
    return F.call_function("format_number", c, F.lit(pattern))


def _shown(c: Column, percent: bool = False) -> Column:
    """Number as report text: blank-grouped thousands, 2 decimals unless whole."""
    if percent:
        return F.coalesce(F.concat(_pattern(100 * c, "0.0"), F.lit("%")), F.lit("–"))
    is_whole = (F.abs(c - F.round(c)) < 1e-9) & (F.abs(c) >= 1)
    text = F.when(is_whole, _pattern(c, "#,##0")).otherwise(_pattern(c, "#,##0.00"))
    return F.coalesce(F.replace(text, F.lit(","), F.lit(" ")), F.lit("–"))


def sentence(threshold: float) -> Column:
    """One-sentence reading of a :func:`summarize` row."""
    return F.concat(
        F.col("grp"), F.lit(": "), _shown(F.col("share_at_least"), True), F.lit(" of residents ("),
        _shown(F.col("pop_at_least")), F.lit(" of "), _shown(F.col("population")), F.lit(") have "),
        F.col("field"), F.lit(" ≥ "), _shown(F.lit(float(threshold))), F.lit("; "),
        _shown(F.col("share_zero"), True), F.lit(" have none."))
