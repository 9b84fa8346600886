"""Cell statistics: coverage, correlation, ranks, bins, rings, grid stability, spatial autocorrelation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachgrid.functions.geo import flat_distance
from reachgrid.functions.scale import (
    fraction, group_quantiles, half_even, linear, row_index, running_totals)
from reachgrid.operators.lines import weighted_centroid
from reachgrid.operators.shuffles import PRIME, ROUND, SPREAD, STEP, TURN, edge_sums
from reachgrid.session import checkpoint


def has_access(c: Column) -> Column:
    return F.coalesce((c >= 1).cast("int"), F.lit(0))


def population_coverage(acc: DataFrame, people: DataFrame) -> DataFrame:
    """People with at least one facility in reach, per category and cutoff."""
    rows = acc.join(people.select("id", "pop"), "id").where("pop is not null")
    covered = F.sum(F.col("pop") * has_access(F.col("acc")))
    return rows.groupBy("opportunity", "cutoff").agg(
        covered.alias("population_covered"), F.sum("pop").alias("population_total"),
        F.round(100 * covered / F.sum("pop"), 1).alias("pct_covered"))


def pessimistic_impact(p50: DataFrame, p85: DataFrame) -> DataFrame:
    """(id, p50, p85, pct_impact): change from the median to the pessimistic percentile, NULL from 0."""
    both = p50.select("id", F.col("acc").alias("p50")).join(p85.select("id", F.col("acc").alias("p85")), "id")
    return both.withColumn("pct_impact", F.when(F.col("p50") != 0, F.round(100 * (F.col("p85") - F.col("p50")) / F.col("p50"), 1)))


def impact_statistics(impact: DataFrame) -> DataFrame:
    """One row: cells, mean, median and the correlation with distance (column ``dist``)."""
    some = impact.where("pct_impact is not null").withColumn("all", F.lit(0))
    middle = group_quantiles(some, ["all"], "pct_impact", {"median": linear(0.5)})
    means = some.groupBy("all").agg(F.avg("pct_impact").alias("mean"), F.corr("dist", "pct_impact").alias("r"))
    return middle.join(means, "all").drop("all")


def percentile_spread(acc: DataFrame) -> DataFrame:
    """(id, p5..p95, spread, rel_spread) of cells with all five percentiles.

    Percentiles are of travel time, so p5 is the best case and the spread is p5 - p95.
    """
    marks = (5, 25, 50, 75, 95)
    wide = acc.groupBy("id").pivot("percentile", list(marks)).agg(F.first("acc"))
    wide = wide.select("id", *[F.col(str(m)).alias(f"p{m}") for m in marks]).dropna()
    spread = F.col("p5") - F.col("p95")
    return wide.select("*", spread.alias("spread"), F.when(F.col("p50") != 0, F.round(spread / F.col("p50"), 3)).alias("rel_spread"))


def dominant(wide: DataFrame, columns: Sequence[str], name: str = "dominant") -> DataFrame:
    """Adds the column with the largest value, the first on ties, 'none' when nothing is above 0."""
    best = F.greatest(*[F.coalesce(c, F.lit(0)) for c in columns])
    pick = F.when(best <= 0, "none")
    for c in columns:
        pick = pick.when(F.coalesce(c, F.lit(0)) == best, c)
    return wide.withColumn(name, pick)


def dominant_summary(rows: DataFrame, name: str = "dominant") -> DataFrame:
    """Cells and people per dominant destination, with their share of all, over inhabited cells."""
    held = rows.where("pop > 0")
    total = held.agg(F.count("*").alias("n"), F.sum("pop").alias("pop"))
    per = held.groupBy(name).agg(F.count("*").alias("cells"), F.sum("pop").alias("pop"))
    return per.select(name, "cells", "pop",
                      F.round(100 * F.col("cells") / total.select("n").scalar(), 1).alias("pct_cells"),
                      F.round(100 * F.col("pop") / total.select("pop").scalar(), 1).alias("pct_pop"))


def count_terciles(df: DataFrame, value: str, name: str = "tier") -> DataFrame:
    """0/1/2 by the values at index n//3 and 2n//3 of the positive values; 0 for nothing."""
    cuts = group_quantiles(df.where(F.col(value) > 0).withColumn("all", F.lit(0)), ["all"], value,
                           {"t1": fraction(1, 3), "t2": fraction(2, 3)})
    t1, t2, v = cuts.select("t1").scalar(), cuts.select("t2").scalar(), F.col(value)
    tier = F.when(v.isNull() | (v <= 0), 0).when(v <= t1, 0).when(v <= t2, 1).otherwise(2)
    return df.withColumn(name, tier)


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Adds ``bin`` 1.. by quantile edges (interpolated, repeated edges merged, right-closed) and its borders."""
    picks = {f"e{i}": linear(i / bins) for i in range(bins + 1)}
    edges = group_quantiles(df.withColumn("all", F.lit(0)), ["all"], value, picks)
    table = edges.select(F.array_distinct(F.array(*[F.col(f"e{i}") for i in range(bins + 1)])).alias("e")).scalar()
    placed = df.where(F.col(value).isNotNull()).withColumn("_e", table)
    inner = F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0)))
    placed = placed.withColumn(name, F.size(F.filter(inner, lambda e: e < F.col(value))) + 1)
    return placed.withColumn("lo", F.get("_e", F.col(name) - 1)).withColumn("hi", F.get("_e", F.col(name))).drop("_e")


def bin_statistics(df: DataFrame, by: str, value: str, bins: int) -> DataFrame:
    """Mean, median and count of ``value`` per quantile bin of ``by`` (for example income deciles)."""
    placed = quantile_bins(df, by, bins)
    middle = group_quantiles(placed, ["bin"], value, {"median": linear(0.5)}, count="count")
    return middle.join(placed.groupBy("bin").agg(F.avg(value).alias("mean")), "bin")


def binned_weighted_mean(df: DataFrame, by: str, value: str, weight: str, bins: int) -> DataFrame:
    """(bin, lo, hi, cells, weight, mean) over equal-count quantile bins of ``by``."""
    placed = quantile_bins(df, by, bins)
    return placed.groupBy("bin").agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count("*").alias("cells"), F.sum(weight).alias("pop"),
        (F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias("mean"))


def pearson(x: str, y: str) -> Column:
    """Aggregate: correlation to 3 decimals, NULL below 3 rows or without variation."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x).cast("double")), F.when(ok, F.col(y).cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)) & (F.count(a) >= 3)
    return F.round(F.when(varies, F.corr(a, b)), 3)


def correlations(pairs: DataFrame) -> DataFrame:
    """(hypothesis, city, r, n) per city, and pooled over cities (city 'ALL')."""
    some = pairs.where("x is not null and y is not null").withColumn("city", F.explode(F.array(F.col("city"), F.lit("ALL"))))
    return some.groupBy("hypothesis", "city").agg(pearson("x", "y").alias("r"), F.count("*").alias("n"))


def _average_ranks(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    counts = df.groupBy(*groups, value).agg(F.sum("_k").alias("_m"))
    run = running_totals(counts, groups, value, {"_c": F.col("_m")})
    return run.select(*groups, value, (F.col("_c") - (F.col("_m") - 1) / 2).alias(name))


def spearman(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n, rho): rank correlation with average ranks for ties, 0 without variation.

    Equal pairs are counted once with their multiplicity, so ties never crowd one task.
    """
    groups = list(groups)
    keyed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not groups:
        keyed, groups = keyed.withColumn("_all", F.lit(0)), ["_all"]
    pairs = keyed.groupBy(*groups, x, y).agg(F.count("*").alias("_k"))
    ranked = pairs.join(_average_ranks(pairs, groups, x, "_rx"), [*groups, x]).join(
        _average_ranks(pairs, groups, y, "_ry"), [*groups, y])
    k, rx, ry = F.col("_k"), F.col("_rx"), F.col("_ry")
    n = F.sum(k)
    sx, sy = F.sum(k * rx), F.sum(k * ry)
    cov = F.sum(k * rx * ry) - sx * sy / n
    vx, vy = F.sum(k * rx * rx) - sx * sx / n, F.sum(k * ry * ry) - sy * sy / n
    rho = F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy)).otherwise(0.0)
    return ranked.groupBy(*groups).agg(n.alias("n"), rho.alias("rho")).drop("_all")


# --- stability over grids ------------------------------------------------------------

def ranking_agreement(ranks: DataFrame, zoning: tuple[str, str], top: int = 5) -> DataFrame:
    """Pairs of grids: lines in common, Spearman, same worst line, shared top lines, kind of pair.

    ranks: (grid, line, rank), one row per grid and line.
    """
    a = ranks.select(F.col("grid").alias("grid_a"), "line", F.col("rank").alias("ra"))
    b = ranks.select(F.col("grid").alias("grid_b"), "line", F.col("rank").alias("rb"))
    both = a.join(b, "line").where("grid_a < grid_b")
    pair = ["grid_a", "grid_b"]
    rho = spearman(both, "ra", "rb", pair).where("n >= 3")
    worst = ranks.groupBy("grid").agg(F.min_by("line", "rank").alias("worst"))
    order = Window.partitionBy("grid").orderBy("rank")
    tops = ranks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top)
    shared = tops.select(F.col("grid").alias("grid_a"), "line").join(
        tops.select(F.col("grid").alias("grid_b"), "line"), "line").where("grid_a < grid_b").groupBy(*pair).agg(F.count("*").alias("top_shared"))
    out = (rho.join(shared, pair, "left")
           .join(worst.select(F.col("grid").alias("grid_a"), F.col("worst").alias("wa")), "grid_a")
           .join(worst.select(F.col("grid").alias("grid_b"), F.col("worst").alias("wb")), "grid_b"))
    is_zoning = F.col("grid_a").isin(*zoning) & F.col("grid_b").isin(*zoning)
    return out.select(*pair, F.when(is_zoning, "zoning").otherwise("scale").alias("kind"), F.col("n").alias("lines"),
                      F.round("rho", 3).alias("spearman"), (F.col("wa") == F.col("wb")).alias("same_worst_line"),
                      F.coalesce("top_shared", F.lit(0)).alias("top_shared"))


def district_stability(rows: DataFrame, value: str, scale_grids: Sequence[str], zoning: tuple[str, str]) -> DataFrame:
    """(district, spread_scale, spread_zoning) of districts measured on two or more grids."""
    v, grid = F.col(value), F.col("grid")
    in_scale = F.when(grid.isin(*scale_grids), v)
    at = lambda g: F.max(F.when(grid == g, v))
    out = rows.where(v.isNotNull()).groupBy("district").agg(
        F.count("*").alias("grids"),
        F.when(F.count(in_scale) > 1, F.round(F.max(in_scale) - F.min(in_scale), 4)).alias("spread_scale"),
        F.round(F.abs(at(zoning[0]) - at(zoning[1])), 4).alias("spread_zoning"))
    return out.where("grids >= 2")


def stability_summary(stable: DataFrame) -> DataFrame:
    """One row: median and 90 % spread over districts (rounded-index rule), districts within 5 points."""
    marked = stable.withColumn("all", F.lit(0))
    out = marked.groupBy("all").agg(F.count("*").alias("districts"),
                                    F.count_if(F.coalesce("spread_scale", F.lit(0.0)) <= 0.05).alias("within_5pp"))
    for c in ("spread_scale", "spread_zoning"):
        q = group_quantiles(marked, ["all"], c, {f"{c}_median": half_even(0.5), f"{c}_p90": half_even(0.9)}, count=f"{c}_n")
        out = out.join(q.drop(f"{c}_n"), "all", "left")
    return out.drop("all")


def relative_to_first(means: DataFrame, keys: Sequence[str], bin_column: str, value: str, name: str = "relative") -> DataFrame:
    """Adds ``name``: the value over that of the key's own first bin; NULL where that is missing or 0."""
    keys = list(keys)
    first = means.groupBy(*keys).agg(F.min_by(value, bin_column).alias("_first"))
    return means.join(first, keys).withColumn(name, F.col(value) / F.nullif("_first", F.lit(0.0))).drop("_first")


# --- spatial autocorrelation -------------------------------------------------------------

def morans_i(values: DataFrame, graph: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, i): global Moran's I over a k-nearest-neighbour graph with row-standardised weights.

    values: (by, id, v). graph: (id, other), k rows per id.
    """
    by = list(by)
    if not by:  # one map: totals are scalar subqueries
        z = values.select("id", (F.col("v") - values.agg(F.avg("v")).scalar()).alias("z"))
        near = graph.select("id", "other").join(z, "id").join(z.select(F.col("id").alias("other"), F.col("z").alias("zo")), "other")
        square = z.agg(F.sum(F.col("z") * F.col("z"))).scalar()
        return near.agg(z.agg(F.count("*")).scalar().alias("n"), (F.sum(F.col("z") * F.col("zo")) / k / square).alias("i"))
    keyed, keys = values, by
    means = keyed.groupBy(*keys).agg(F.avg("v").alias("_mean"))
    z = keyed.join(means, keys).select(*keys, "id", (F.col("v") - F.col("_mean")).alias("z"))
    near = graph.select("id", "other").join(z, "id").join(
        z.select(*keys, F.col("id").alias("other"), F.col("z").alias("zo")), [*keys, "other"])
    cross = near.groupBy(*keys).agg(F.sum(F.col("z") * F.col("zo")).alias("_cross"))
    square = z.groupBy(*keys).agg(F.sum(F.col("z") * F.col("z")).alias("_square"), F.count("*").alias("n"))
    return cross.join(square, keys).select(*keys, "n", (F.col("_cross") / k / F.col("_square")).alias("i"))


def _drawn(fixed: Column, perm: Column, salt: int) -> Column:
    """A pseudo-random whole number from whole numbers by sums, products and remainders alone, so that any engine can repeat it."""
    h = (fixed * STEP + perm * TURN + salt * ROUND) % PRIME
    mixed = _let(h, lambda x: (x % 32_768 + 1) * (F.floor(x / 32_768) + 1) % PRIME)
    return mixed * SPREAD % PRIME


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shuffle_positions(df: DataFrame, index: str, perm: str, n: int | Column, name: str, seed: int = 42, rounds: int = 6) -> DataFrame:
    """Adds ``name``: the row's position in shuffle ``perm``, a bijection of 0..n-1 computed from the row alone.

    The index is split into two digits that are shifted in turn by a number drawn from the other one. Digit
    pairs beyond n are shuffled again until they fall inside (rare: fewer than √n of n pairs). ``n`` may be
    a scalar of the same plan.
    """
    sized = df.withColumn("_n", n.cast("bigint") if isinstance(n, Column) else F.lit(n).cast("bigint"))
    sized = sized.withColumn("_a", F.ceil(F.sqrt("_n"))).withColumn("_b", F.ceil(F.col("_n") / F.col("_a")))
    a, b, of = F.col("_a"), F.col("_b"), F.col(perm).cast("bigint")

    def once(x: Column) -> Column:
        def turn(r: int, left: Column, right: Column) -> Column:
            if r == rounds:
                return left * b + right
            if r % 2 == 0:
                return _let((left + _drawn(right, of, 64 * seed + r)) % a, lambda v: turn(r + 1, v, right))
            return _let((right + _drawn(left, of, 64 * seed + r)) % b, lambda v: turn(r + 1, left, v))
        return _let(F.floor(x / b), lambda left: _let(x % b, lambda right: turn(0, left, right)))
    first = sized.withColumn(name, once(F.col(index).cast("bigint")))
    again = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.col(name), lambda v, _: F.when(v < F.col("_n"), v).otherwise(once(v)))
    settled = first.withColumn(name, F.when(F.col(name) < F.col("_n"), F.col(name)).otherwise(again))
    return settled.withColumn(name, F.when(F.col(name) < F.col("_n"), F.col(name)).otherwise(
        F.raise_error(F.lit("shuffle did not settle")).cast("bigint"))).drop("_n", "_a", "_b")


def moran_p_value(values: DataFrame, graph: DataFrame, k: int, permutations: int = 299, seed: int = 42) -> DataFrame:
    """One row (i, p): share of shuffled maps with |I| at least the observed one.

    The shuffles are those of :func:`shuffle_positions`; a cell's shuffled values meet the graph's edges in
    blocks of cells and packs of shuffles.
    """
    mean = values.agg(F.avg("v")).scalar()
    indexed = checkpoint(row_index(values.select("id", (F.col("v") - mean).alias("z")), "id"))
    # A table of numbers is far larger in memory than as a file, by which Spark would broadcast it.
    edges = graph.select("id", "other").join(indexed.select("id", F.col("idx").alias("i")).hint("merge"), "id").join(
        indexed.select(F.col("id").alias("other"), F.col("idx").alias("o")).hint("merge"), "other").select("i", "o")
    square = indexed.agg(F.sum(F.col("z") * F.col("z"))).scalar()
    each = checkpoint(edge_sums(indexed.select("idx", "z"), edges, permutations, seed)).select("perm", (F.col("cross") / k / square).alias("i"))
    seen = each.where("perm = 0").select("i").scalar()
    at_least = F.count_if((F.col("perm") > 0) & (F.abs("i") >= F.abs(seen)))
    return each.agg(F.max(F.when(F.col("perm") == 0, F.col("i"))).alias("i"), ((at_least + 1) / (permutations + 1)).alias("p"))


# --- distance profiles ---------------------------------------------------------------------

def ring_profile(cells: DataFrame, bin_km: float = 1.0) -> DataFrame:
    """(bin_lo, cells, pop, mean): weighted mean net delta by distance from the population centre."""
    centre = weighted_centroid(cells, "pop", "x", "y")
    cx, cy = centre.select("x").scalar(), centre.select("y").scalar()
    km = flat_distance(F.col("x"), F.col("y"), cx, cy) / 1000
    placed = cells.withColumn("bin_lo", F.floor(km / bin_km) * bin_km).where("net_delta is not null")
    return placed.groupBy("bin_lo").agg(
        F.count("*").alias("cells"), F.sum("pop").alias("pop"),
        (F.sum(F.col("net_delta") * F.col("pop")) / F.nullif(F.sum("pop"), F.lit(0))).alias("mean"))


def ring_verdict(bands: DataFrame, by: Sequence[str] = (), min_cells: int = 20) -> DataFrame:
    """Whether the worst ring dips in the middle distance, against the upper-middle of the other rings.

    bands: (by, bin_lo, cells, mean). A profile has few rings, so its list is small.
    """
    by = list(by)
    keyed = bands if by else bands.withColumn("_one", F.lit(0))
    keys = by or ["_one"]
    usable = keyed.where((F.col("cells") >= min_cells) & F.col("mean").isNotNull() & ~F.isnan("mean"))
    ring = F.struct("mean", "bin_lo")
    per = usable.groupBy(*keys).agg(
        F.count("*").alias("rings"), F.min_by("mean", "bin_lo").alias("inner_mean"), F.min(ring).alias("w"),
        F.sort_array(F.collect_list("mean")).alias("means")).where("rings >= 3")
    others = F.slice("means", F.lit(2), F.size("means") - 1)  # the smallest mean is the worst ring
    middle = F.get(others, F.floor(F.size(others) / 2).cast("int"))
    out = per.select(*keys, F.col("w.bin_lo").alias("worst_ring_km"), F.col("w.mean").alias("worst_mean"), "inner_mean",
                     middle.alias("median_other"))
    dip = (F.col("worst_ring_km").between(1, 4) & (F.col("worst_mean") < F.col("inner_mean"))
           & (F.col("worst_mean") < F.col("median_other") - 0.3))
    return out.withColumn("dip", dip).drop("_one")


def survivors(items: DataFrame, categories: Sequence[str], min_items: int, min_districts: int) -> DataFrame:
    """(category, total, districts, verdict): kept when enough districts hold enough items."""
    per = items.groupBy("category", "district").agg(F.count("*").alias("n"))
    found = per.groupBy("category").agg(F.sum("n").alias("total"), F.count_if(F.col("n") >= min_items).alias("districts"))
    names = items.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    out = names.join(found, "category", "left").fillna(0)
    return out.withColumn("verdict", F.when(F.col("districts") >= min_districts, "OK").otherwise("REJECTED"))
