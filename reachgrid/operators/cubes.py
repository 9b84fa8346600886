"""Origin-destination cubes: facility counts, medians over days, repairs, checks, change statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.geo import haversine_m
from reachgrid.functions.scale import group_quantiles, linear, weighted_quantiles
from reachgrid.operators.access import with_origins

NOT_REACHED = 255


def pack_minutes(c: Column) -> Column:
    """Whole minutes 0..254 as a small integer; blank means not reached (255)."""
    clipped = F.least(F.greatest(F.bround(c), F.lit(0)), F.lit(254))
    return F.coalesce(clipped, F.lit(NOT_REACHED)).cast("smallint")


def facility_counts(matrix: DataFrame, types: DataFrame, cells: DataFrame, names: Sequence[str],
                    levels: Sequence[int], by: Sequence[str] = (), clip: int | None = None) -> DataFrame:
    """(by, id, type, level, n): facilities within each time level, inclusive, optionally clipped.

    matrix: (by, from_id, to_id, minutes). types: (to_id, type). cells: (by, id).
    """
    by = list(by)
    near = matrix.where(F.col("minutes") <= max(levels)).join(types, "to_id")
    cols = {(n, v): f"_s{i}_{v}" for i, n in enumerate(dict.fromkeys(names)) for v in levels}
    sums = near.where(F.col("type").isin(*names)).groupBy(*by, F.col("from_id").alias("id")).agg(
        *[F.count_if((F.col("type") == n) & (F.col("minutes") <= v)).alias(c) for (n, v), c in cols.items()])
    full = with_origins(cells, sums, [*by, "id"])
    clipped = (lambda c: F.least(c, F.lit(clip))) if clip is not None else (lambda c: c)
    return full.select(*by, "id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("type"), F.lit(v).alias("level"), clipped(F.coalesce(c, F.lit(0).cast("bigint"))).alias("n"))
        for (n, v), c in cols.items()])))


def meta_counts(counts: DataFrame, groups: DataFrame, keys: Sequence[str], clip: int | None = None) -> DataFrame:
    """Fine types summed to the meta-category of ``groups`` (type, meta), then clipped."""
    out = counts.join(groups, "type").groupBy(*keys, "meta").agg(F.sum("n").alias("n"))
    return out if clip is None else out.withColumn("n", F.least("n", F.lit(clip)))


def median_over_days(counts: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    """Median of the days; an even number of days is refused because it has no middle element."""
    out = group_quantiles(counts, keys, value, {"median": linear(0.5)}, count="days", small_domain=True)
    odd = F.when(F.col("days") % 2 == 1, F.col("median")).otherwise(
        F.raise_error(F.lit("median over an even number of days")).cast("double"))
    return out.select(*keys, "days", odd.cast("bigint").alias(value))


def median_time(times: DataFrame, days: int, keys: Sequence[str] = ("from_id", "to_id")) -> DataFrame:
    """Middle of the days' minutes with not-reached last: more than half of the days must reach.

    times: one row per key and day (NULL or no row = not reached); ``days`` is odd.
    """
    if days % 2 == 0:
        raise ValueError("median over an even number of days")
    held = times.where("minutes is not null").groupBy(*keys).agg(F.sort_array(F.collect_list("minutes")).alias("_m"))
    middle = F.get("_m", F.lit(days // 2))
    return held.select(*keys, middle.cast("int").alias("minutes")).where("minutes is not null")


def day_spread(times: DataFrame, days: Sequence) -> DataFrame:
    """(day, pairs, share_spread_gt_10, mean_abs_dev, outlier) over pairs reached on every day."""
    wide = times.groupBy("from_id", "to_id").pivot("day", list(days)).agg(F.first("minutes")).dropna()
    cols = [F.col(str(x)) for x in days]
    middle = F.get(F.sort_array(F.array(*cols)), F.lit(len(days) // 2))
    wide = wide.select(*cols, middle.alias("_m"), (F.greatest(*cols) - F.least(*cols)).alias("_s"))
    one = wide.agg(F.count("*").alias("pairs"), F.avg((F.col("_s") > 10).cast("double")).alias("share_spread_gt_10"),
                   *[F.avg(F.abs(c - F.col("_m"))).alias(f"_d{i}") for i, c in enumerate(cols)])
    worst = F.greatest(*[F.col(f"_d{i}") for i in range(len(days))])
    rows = F.array(*[F.struct(F.lit(x).alias("day"), F.col(f"_d{i}").alias("mean_abs_dev"),
                              (F.col(f"_d{i}") == worst).alias("outlier")) for i, x in enumerate(days)])
    return one.select("pairs", "share_spread_gt_10", F.inline(rows))


VARIANTS = ("few_off", "few_on", "any_off", "any_on")


def repair_monotone(wide: DataFrame) -> DataFrame:
    """Lower envelope along the order few_off ≥ few_on, any_off ≥ any_on (255 = not reached).

    ``few``/``any`` is the transfer limit, ``on``/``off`` an added line: more freedom never takes
    longer. Each variant becomes the best of itself and the variants below it.
    """
    full = wide.select(*[c for c in wide.columns if c not in VARIANTS],
                       *[F.coalesce(c, F.lit(NOT_REACHED)).alias(c) for c in VARIANTS])
    few_off = F.col("few_off")
    few_on = F.least("few_on", few_off)
    any_off = F.least("any_off", few_off)
    any_on = F.least("any_on", few_on, any_off)
    fixed = {"few_off": few_off, "few_on": few_on, "any_off": any_off, "any_on": any_on}
    return full.select("*", *[v.alias(f"{k}_fixed") for k, v in fixed.items()])


def repair_report(fixed: DataFrame, max_share: float = 1e-6) -> DataFrame:
    """(variant, pairs, repaired, within): repaired pairs, and whether they stay below the tolerated share."""
    one = fixed.agg(F.count("*").alias("pairs"), *[F.count_if(F.col(v) != F.col(f"{v}_fixed")).alias(v) for v in VARIANTS])
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("repaired")) for v in VARIANTS])
    return one.select("pairs", F.inline(rows)).withColumn("within", F.col("repaired") <= max_share * F.col("pairs"))


def islands(matrix: DataFrame, cells: DataFrame, max_reached: int = 1) -> DataFrame:
    """Cells that reach, or are reached from, at most ``max_reached`` other cells."""
    hit = matrix.where("minutes is not null and from_id <> to_id")
    out = hit.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("reaches"))
    back = hit.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("reached_by"))
    full = cells.select("id").join(out, "id", "left").join(back, "id", "left").fillna(0)
    return full.where((F.col("reaches") <= max_reached) | (F.col("reached_by") <= max_reached))


def candidate_points(cells: DataFrame, radii: Sequence[float], bearings: int) -> DataFrame:
    """(id, radius, bearing, x, y): access-point candidates on rings around each cell."""
    spots = F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.lit(k).alias("bearing"),
                               F.lit(r * math.cos(2 * math.pi * k / bearings)).alias("dx"),
                               F.lit(r * math.sin(2 * math.pi * k / bearings)).alias("dy"))
                      for r in radii for k in range(bearings)])
    return cells.select("id", "x", "y", F.inline(spots)).select(
        "id", "radius", "bearing", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))


def relocate(candidates: DataFrame, enough: Column | float) -> DataFrame:
    """(id, radius, bearing, reach): the nearest ring with a good candidate, its best one (larger bearing on ties)."""
    good = candidates.where(F.col("reach") >= enough)
    best = good.groupBy("id").agg(F.min(F.struct(
        "radius", (-F.col("reach")).alias("less"), (-F.col("bearing")).alias("turn"))).alias("b"))
    return best.select("id", F.col("b.radius").alias("radius"), (-F.col("b.turn")).alias("bearing"), (-F.col("b.less")).alias("reach"))


def worse_pairs(a: Column, b: Column) -> Column:
    """Aggregate: pairs where ``a`` is strictly slower than ``b``, not reached being slowest."""
    far = F.lit(NOT_REACHED)
    return F.count_if(F.coalesce(a, far) > F.coalesce(b, far))


def speed_comparison(a: Column, b: Column) -> tuple[Column, Column]:
    """Aggregates: share of commonly reached pairs where ``b`` is faster than ``a``, and newly reached pairs."""
    both = a.isNotNull() & b.isNotNull()
    return F.count_if(both & (b < a)) / F.nullif(F.count_if(both), F.lit(0)), F.count_if(a.isNull() & b.isNotNull())


def symmetry(matrix: DataFrame) -> DataFrame:
    """One row: pairs reached both ways, and shares within 1 and 3 minutes of the way back."""
    there = matrix.where("minutes is not null")
    back = there.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.col("minutes").alias("back"))
    gap = F.abs(F.col("minutes") - F.col("back"))
    return there.join(back, ["from_id", "to_id"]).agg(
        F.count("*").alias("pairs"), F.avg((gap <= 1).cast("double")).alias("within_1"), F.avg((gap <= 3).cast("double")).alias("within_3"))


# --- change between two timetables ------------------------------------------------------

MODES = ("transit_only", "door_to_door")


def eligible(rows: DataFrame) -> DataFrame:
    """Adds ``mode``, ok_later and ok_earlier: transit only counts a trip that beats walking.

    rows: later, earlier, walk minutes (NULL = not reached).
    """
    beats = lambda c: F.col(c).isNotNull() & (F.col("walk").isNull() | (F.col(c) < F.col("walk")))
    modes = F.array(
        F.struct(F.lit("transit_only").alias("mode"), beats("later").alias("ok_later"), beats("earlier").alias("ok_earlier")),
        F.struct(F.lit("door_to_door").alias("mode"), F.col("later").isNotNull().alias("ok_later"),
                 F.col("earlier").isNotNull().alias("ok_earlier")))
    return rows.select("*", F.inline(modes))


def change_statistics(rows: DataFrame, keys: Sequence[str], weight: str = "w", *, whole_minutes: bool = True) -> DataFrame:
    """Shares shorter, longer, same, weighted medians and means of comparable pairs, lost and gained pairs.

    rows: keys, later, earlier, ok_later, ok_earlier, weight. Equal minutes are added up first, so
    what follows works on at most one row per key and pair of minutes.
    """
    keys = list(keys)
    rows = rows.groupBy(*keys, "ok_later", "ok_earlier", "later", "earlier").agg(F.count("*").alias("_k"), F.sum(weight).alias(weight))
    times = lambda hit: F.sum(F.when(hit, F.col("_k")).otherwise(0))
    both = rows.where("ok_later and ok_earlier").withColumn("delta", F.col("later") - F.col("earlier"))
    w, d = F.col(weight), F.col("delta")
    share = lambda hit: F.sum(F.when(hit, w).otherwise(0)) / F.sum(w)
    out = rows.groupBy(*keys).agg(F.sum("_k").alias("n_total"), times(F.col("ok_earlier") & ~F.col("ok_later")).alias("n_lost"),
                                  times(F.col("ok_later") & ~F.col("ok_earlier")).alias("n_gained"))
    means = both.groupBy(*keys).agg(
        F.sum("_k").alias("n"), F.sum(w).alias("weight"), share(d < 0).alias("share_shorter"), share(d > 0).alias("share_longer"),
        share(d == 0).alias("share_same"), (F.sum(w * F.col("later")) / F.sum(w)).alias("mean_later"),
        (F.sum(w * F.col("earlier")) / F.sum(w)).alias("mean_earlier"), (F.sum(w * d) / F.sum(w)).alias("mean_delta"))
    out = out.join(means, keys, "left")
    for c in ("later", "earlier", "delta"):
        q = weighted_quantiles(both, keys, c, weight, {f"median_{c}": 0.5}, small_domain=whole_minutes)
        out = out.join(q.drop("weight"), keys, "left")
    return out


def cell_medians(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, later, earlier): median over a cell's comparable destinations."""
    both = rows.where("ok_later and ok_earlier")
    a = group_quantiles(both, keys, "later", {"later": linear(0.5)}, small_domain=True)
    b = group_quantiles(both, keys, "earlier", {"earlier": linear(0.5)}, count="n2", small_domain=True)
    return a.join(b.drop("n2"), list(keys))


def distance_class(lon1: Column, lat1: Column, lon2: Column, lat2: Column, edges_km: Sequence[float]) -> Column:
    """Index of the distance class; class i starts at ``edges_km[i]``."""
    km = haversine_m(lon1, lat1, lon2, lat2) / 1000
    table = F.array(*[F.lit(float(e)) for e in edges_km])
    return F.size(F.filter(table, lambda e: e <= km)) - 1


def with_all(rows: DataFrame, column: str) -> DataFrame:
    """Every row a second time under 'all'."""
    return rows.withColumn(column, F.explode(F.array(F.col(column).cast("string"), F.lit("all"))))


def origin_change(rows: DataFrame, far_class: int, min_destinations: int) -> DataFrame:
    """(from_id, n, mean_delta, n_far, mean_delta_far) for origins with enough comparable destinations.

    rows: from_id, class, later, earlier, ok flags, w (weight of the destination).
    """
    both = rows.where("ok_later and ok_earlier").withColumn("delta", F.col("later") - F.col("earlier"))
    far, w = F.col("class") == far_class, F.col("w")
    n_far = F.count_if(far)
    out = both.groupBy("from_id").agg(
        F.count("*").alias("n"), (F.sum(w * F.col("delta")) / F.nullif(F.sum(w), F.lit(0))).alias("mean_delta"), n_far.alias("n_far"),
        F.when(n_far >= min_destinations, F.sum(F.when(far, w * F.col("delta"))) / F.nullif(F.sum(F.when(far, w)), F.lit(0))).alias("mean_delta_far"))
    return out.where(F.col("n") >= min_destinations)


def season_means(counts: DataFrame, groups: DataFrame, people: DataFrame) -> DataFrame:
    """(month, hour, meta, mean): median over the month's days, meta sum, population-weighted mean.

    counts: (month, hour, day, type, id, n).
    """
    keys = ["month", "hour", "type", "id"]
    cube = meta_counts(median_over_days(counts, keys), groups, ["month", "hour", "id"], clip=None)
    rows = cube.join(people.select("id", "pop"), "id", "left").withColumn("pop", F.coalesce("pop", F.lit(0)))
    return rows.groupBy("month", "hour", "meta").agg(
        (F.sum(F.col("n") * F.col("pop")) / F.nullif(F.sum("pop"), F.lit(0))).alias("mean"), F.count("*").alias("cells"))
