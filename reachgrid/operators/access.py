"""Cumulative accessibility and what a departure window says about an OD pair.

Long matrix: from_id, to_id, percentile, minutes (NULL = unreachable).
Opportunities: to_id, opportunity, value. Accessibility: id, opportunity, percentile,
cutoff, accessibility.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.decay import STEP, decay_weight
from reachgrid.functions.scale import running_totals
from reachgrid.functions.values import check_cutoffs, number, require_columns

TIME_PREFIX = "travel_time_p"


def matrix_long(wide: DataFrame) -> DataFrame:
    """Every ``travel_time_p<n>`` column as rows; unreachable pairs keep a NULL."""
    found = [(c, int(m[1])) for c in wide.columns if (m := re.fullmatch(TIME_PREFIX + r"(\d+)", c))]
    if not found:
        raise ValueError("matrix has no travel-time column")
    rows = F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(c).try_cast("int").alias("minutes"))
                     for c, p in found])
    return wide.select("from_id", "to_id", F.inline(rows))


def matrix_pairs(wide: DataFrame, percentile: int) -> DataFrame:
    """Reached pairs (from_id, to_id, minutes) of one percentile."""
    column = f"{TIME_PREFIX}{percentile}"
    require_columns(wide, [column], "matrix")
    minutes = F.col(column).try_cast("int")
    return wide.where(minutes.isNotNull()).select("from_id", "to_id", minutes.alias("minutes"))


def opportunities_long(destinations: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """(to_id, opportunity, value): blank values count 0, absent fields are left out."""
    present = [f for f in fields if f in destinations.columns]
    rows = F.array(*[F.struct(F.lit(f).alias("opportunity"),
                              F.coalesce(number(F.col(f)), F.lit(0.0)).alias("value")) for f in present])
    return destinations.select(F.col(key).alias("to_id"), F.inline(rows))


def _exact_or_rounded(total: Column, decay: str) -> Column:
    """Whole STEP sums stay whole (tolerance 1e-6); everything else keeps 4 decimals."""
    if decay != STEP:
        return F.round(total, 4)
    near = F.round(total)
    return F.when(F.abs(total - near) < 1e-6, near).otherwise(F.round(total, 4))


def accessibility(matrix: DataFrame, opportunities: DataFrame, origins: DataFrame,
                  names: Sequence[str], percentiles: Sequence[int], cutoffs: Sequence[int],
                  decay: str = STEP, by: Sequence[str] = ()) -> DataFrame:
    """Opportunities within reach; a row for every origin, name, percentile and cutoff (0 if none).

    One pass over the matrix: a row per origin holds its sums for every name, percentile and cutoff side by side, so
    neither the rows nor the groups of the aggregation are multiplied by them. Origins join the sums, and only the
    joined rows are unfolded. ``by`` names further key columns of matrix and origins, such as a scenario, so a sweep of
    cases is one job.
    """
    by = list(by)
    cuts = check_cutoffs(cutoffs)
    reach = matrix.where(F.col("minutes").isNotNull() & F.col("percentile").isin(*percentiles))
    if decay == STEP:
        reach = reach.where(F.col("minutes") < cuts[-1])
    held = opportunities.where((F.col("value") != 0) & F.col("opportunity").isin(*names))
    hits = reach.join(held, "to_id").select(
        *by, F.col("from_id").alias("id"), "opportunity", "percentile",
        *[(F.col("value") * decay_weight(decay, F.col("minutes"), c)).alias(f"c{c}") for c in cuts])
    cells = [(i, n, p) for i, (n, p) in enumerate((n, p) for n in dict.fromkeys(names) for p in dict.fromkeys(percentiles))]
    mine = {i: (F.col("opportunity") == n) & (F.col("percentile") == p) for i, n, p in cells}
    sums = hits.groupBy(*by, "id").agg(*[F.sum(F.when(mine[i], F.col(f"c{c}"))).alias(f"_s{i}_{c}") for i, _, _ in cells for c in cuts])
    full = with_origins(origins, sums, [*by, "id"])
    rows = F.array(*[F.struct(F.lit(n).alias("opportunity"), F.lit(p).alias("percentile"), F.lit(c).alias("cutoff"),
                              _exact_or_rounded(F.coalesce(F.col(f"_s{i}_{c}"), F.lit(0.0)), decay).alias("accessibility"))
                     for i, n, p in cells for c in cuts])
    return full.select(*by, "id", F.inline(rows))


def with_origins(origins: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every origin once, with its sums where there are any."""
    named = sums.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return origins.select(*keys).distinct().join(named, same, "left")


def accessibility_wide(long: DataFrame, origins: DataFrame, names: Sequence[str],
                       percentiles: Sequence[int], cutoffs: Sequence[int]) -> DataFrame:
    """One row per origin with ``acc_<name>_p<pct>_c<cutoff>`` columns, 0 where nothing is known."""
    keys = [f"acc_{n}_p{p}_c{c}" for n in names for p in percentiles for c in cutoffs]
    key = F.concat(F.lit("acc_"), "opportunity", F.lit("_p"), F.col("percentile").cast("string"),
                   F.lit("_c"), F.col("cutoff").cast("string"))
    wide = long.withColumn("_key", key).groupBy("id").pivot("_key", keys).agg(F.first("accessibility"))
    return origins.join(wide, "id", "left").fillna(0, subset=keys)


def reachable_destinations(matrix: DataFrame, origins: DataFrame, max_minutes: int | None = None) -> DataFrame:
    """(id, reachable): destinations that a cell reaches at all (or within ``max_minutes``); 0 where there is none.

    matrix: (from_id, to_id, minutes), NULL minutes for unreached pairs.
    """
    hit = F.col("minutes").isNotNull() if max_minutes is None else F.col("minutes") <= max_minutes
    found = matrix.where(hit).groupBy(F.col("from_id").alias("id"), "to_id").agg(F.lit(1)).groupBy("id").agg(F.count("*").alias("reachable"))
    return origins.select("id").join(found, "id", "left").fillna(0, subset=["reachable"])


def departure_counts(departures: DataFrame, keys: Sequence[str] = ("from_id", "to_id")) -> DataFrame:
    """Departures per pair and travel minute: at most one row per minute, however many draws."""
    return departures.groupBy(*keys, "minutes").agg(F.count("*").alias("n"))


def percentile_matrix(departures: DataFrame, percentiles: Sequence[int], max_trip: int, *, keep_unreached: bool = False) -> DataFrame:
    """Nearest-rank percentiles of travel time over the departure window.

    A departure without a trip (NULL) ranks last; a percentile over the trip budget is NULL. Pairs
    without any percentile inside the budget are left out unless ``keep_unreached``.
    """
    counts = departure_counts(departures).withColumn("minutes", F.coalesce("minutes", F.lit(2**31 - 1)))
    run = running_totals(counts, ["from_id", "to_id"], "minutes", {"cum": F.col("n")}, small_domain=True)
    picks = []
    for p in percentiles:
        rank = F.ceil(F.col("cum_all") * p / 100)
        picks.append(F.min(F.when(F.col("cum") >= rank, F.col("minutes"))).alias(f"p{p}"))
    found = run.groupBy("from_id", "to_id").agg(*picks)
    if not keep_unreached:
        found = found.where(F.col(f"p{min(percentiles)}") <= max_trip)
    return found.select("from_id", "to_id", *[
        F.when(F.col(f"p{p}") <= max_trip, F.col(f"p{p}")).cast("int").alias(f"{TIME_PREFIX}{p}")
        for p in percentiles])


def service_minutes(departures: DataFrame, cutoffs: Sequence[int], draws_per_minute: int = 1,
                    *, keep_unreached: bool = False) -> DataFrame:
    """Departure minutes from which the destination is reached within each cutoff (inclusive)."""
    cuts = check_cutoffs(cutoffs, service_minutes=True)
    cols = [f"svc_min_c{c}" for c in cuts]
    out = departures.groupBy("from_id", "to_id").agg(*[
        F.floor(F.count_if(F.col("minutes") <= c) / draws_per_minute + 0.5).alias(k)
        for c, k in zip(cuts, cols)])
    return out if keep_unreached else out.where(F.greatest(*cols, F.lit(0)) > 0)


def service_minutes_from_histogram(histograms: DataFrame, cutoffs: Sequence[int],
                                   draws_per_minute: int = 1, *, keep_unreached: bool = False) -> DataFrame:
    """Same from an ``array<int>`` of departures per travel minute (0..119)."""
    cuts = check_cutoffs(cutoffs, service_minutes=True)
    def total(c: int) -> Column:
        summed = F.aggregate(F.slice("histogram", 1, c + 1), F.lit(0).cast("bigint"), lambda a, v: a + v)
        return F.floor(summed / draws_per_minute + 0.5)
    cols = [f"svc_min_c{c}" for c in cuts]
    out = histograms.select("from_id", "to_id", *[F.coalesce(total(c), F.lit(0)).alias(k) for c, k in zip(cuts, cols)])
    return out if keep_unreached else out.where(F.greatest(*cols, F.lit(0)) > 0)


def transit_used(transit: DataFrame, walk: DataFrame) -> DataFrame:
    """Pairs whose transit median beats walking, or that walking cannot reach."""
    t = transit.where(F.col("minutes").isNotNull()).select("from_id", "to_id", "minutes")
    w = walk.where(F.col("minutes").isNotNull()).select("from_id", "to_id", F.col("minutes").alias("walk"))
    return t.join(w, ["from_id", "to_id"], "left").where(
        F.col("walk").isNull() | (F.col("minutes") < F.col("walk")))


def walk_only_guard(transit: DataFrame, walk: DataFrame, *, removes_service: bool = False) -> DataFrame:
    """One row: pairs using transit and the finding — no such pair means a walk-only result."""
    used = transit_used(transit, walk).agg(F.count("*").alias("transit_used_pairs"))
    worst = "WARN" if removes_service else "ERROR"
    return used.select("transit_used_pairs",
                       F.when(F.col("transit_used_pairs") > 0, "OK").otherwise(worst).alias("level"))
