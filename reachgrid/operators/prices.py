"""Price surfaces: cleaning of sales, adaptive-radius medians, class prices, land-cover shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachgrid.functions.scale import group_quantiles, weighted_quantiles, whole_part
from reachgrid.operators.spatial import pairs_within

# Fixed values of the cleaning rules: square metres and price per square metre.
AREA_M2 = (25, 120)
PRICE_M2 = (2500, 25000)


def judge_sales(sales: DataFrame, rules: Sequence[tuple[str, Column]], *, area: tuple[float, float] = AREA_M2,
                price_m2: tuple[float, float] = PRICE_M2) -> DataFrame:
    """Adds price, price_source, price_m2 and ``reason`` (NULL = passes): the first failing rule names it.

    sales: deed, unit, date, unit_price, deed_price, area. The deed's price stands in for a
    missing unit price only when the deed has a single row.
    """
    rows = sales.groupBy("deed").agg(F.count("*").alias("_rows"))
    joined = sales.join(rows, "deed", "left")
    single = F.when(F.col("_rows") == 1, F.col("deed_price"))
    price = F.coalesce("unit_price", single)
    reason = None
    for name, failing in rules:
        reason = F.when(failing, name) if reason is None else reason.when(failing, name)
    start = F if reason is None else reason
    per_m2 = F.col("price") / F.col("area")
    judged = joined.withColumn("price", price).withColumn("price_source", F.when(F.col("unit_price").isNotNull(), "unit").when(single.isNotNull(), "deed"))
    reason = (start.when(F.col("price").isNull() | F.col("area").isNull() | (F.col("area") == 0), "no price/area")
              .when(~F.col("area").between(*area), "area").when(~per_m2.between(*price_m2), "price per m2"))
    return judged.withColumn("price_m2", F.when(F.col("area") != 0, per_m2)).withColumn("reason", reason).drop("_rows")


KEY = ("deed", "unit", "date", "price")


def keep_sales(judged: DataFrame, order: str) -> DataFrame:
    """Passing sales, one per (deed, unit, date, price): the first by ``order``."""
    passing = judged.where("reason is null")
    rest = [c for c in passing.columns if c not in KEY]
    first = passing.groupBy(*KEY).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return first.select(*KEY, "_r.*")


def dropped_reasons(judged: DataFrame) -> DataFrame:
    """(reason, n), with 'duplicate' for repeated passing sales."""
    failed = judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    again = judged.where("reason is null").groupBy(*KEY).agg((F.count("*") - 1).alias("n")).agg(F.sum("n").alias("n"))
    return failed.unionByName(again.where("n > 0").select(F.lit("duplicate").alias("reason"), "n"))


def price_quality(kept: DataFrame) -> DataFrame:
    """One row: kept sales, those priced by the deed, and index-rule percentiles of the price per m²."""
    marks = {f"p{q}": whole_part(q / 100) for q in (5, 25, 50, 75, 95)}
    marked = kept.withColumn("all", F.lit(0))
    q = group_quantiles(marked, ["all"], "price_m2", marks, count="kept")
    src = marked.groupBy("all").agg(F.count_if(F.col("price_source") == "deed").alias("price_from_deed"),
                                    F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    return q.join(src, "all").drop("all")


def sales_by_month(kept: DataFrame) -> DataFrame:
    return kept.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.count("*").alias("n"))


def usable_offers(offers: DataFrame, area: tuple[float, float], price_m2: tuple[float, float]) -> DataFrame:
    """Active offers with a place, and plausible mean area and price."""
    return offers.where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("active") > 0)
                        & F.coalesce("area", F.lit(0.0)).between(*area) & F.col("price_m2").between(*price_m2))


def adaptive_median(cells: DataFrame, points: DataFrame, *, value: str, distinct: str | None, radii: Sequence[int],
                    min_n: int, min_distinct: int = 1, edge_weight: float = 0.25, by: Sequence[str] = (),
                    flag: str | None = None) -> DataFrame:
    """(by, hex_id, median, radius, n, n_distinct[, flagged]): weighted median inside the smallest
    radius holding ``min_n`` points and ``min_distinct`` different ``distinct`` values.

    Weights fall linearly from 1 at the centre to ``edge_weight`` at the radius used; ``flagged``
    tells whether rows with ``flag`` hold over half of the weight. Cells without enough points
    have no row. Points of one place and value are counted once with their multiplicity.
    """
    by = list(by)
    start, step = radii[0], radii[1] - radii[0] if len(radii) > 1 else 1
    place = [*by, "px", "py"]
    spots = cells.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    spot = ["_x", "_y", *by]
    # The radius is settled on places and their counts; values join only inside the radius used.
    places = points.groupBy(*place).agg(F.count("*").alias("_m"))
    near = pairs_within(spots, places, radii[-1], left_xy=("_x", "_y"), tree=None)  # centres of a lattice, few within a radius
    near = near.withColumn("_ring", F.greatest(F.lit(0), F.ceil((F.col("distance") - start) / step)).cast("int"))
    per_ring = near.groupBy(*spot, "_ring").agg(F.sum("_m").alias("_n"))
    if distinct:
        kinds = points.select(*place, distinct).distinct()
        first = near.select(*spot, "px", "py", "_ring").join(kinds, place).groupBy(*spot, distinct).agg(F.min("_ring").alias("_ring"))
        per_ring = per_ring.join(first.groupBy(*spot, "_ring").agg(F.count("*").alias("_d")), [*spot, "_ring"], "left").fillna(0)
    else:
        per_ring = per_ring.withColumn("_d", F.col("_n"))
    run = Window.partitionBy(*spot).orderBy("_ring").rowsBetween(Window.unboundedPreceding, 0)  # one row per radius
    filled = per_ring.select(*spot, "_ring", F.sum("_n").over(run).alias("n"), F.sum("_d").over(run).alias("n_distinct"))
    enough = filled.where((F.col("n") >= min_n) & (F.col("n_distinct") >= min_distinct))
    chosen = enough.groupBy(*spot).agg(F.min(F.struct("_ring", "n", "n_distinct")).alias("c")).select(
        *spot, F.col("c._ring").alias("_used"), F.col("c.n").alias("n"), F.col("c.n_distinct").alias("n_distinct"))
    chosen = chosen.withColumn("radius", F.lit(start) + F.col("_used") * step)
    inside = near.join(chosen.select(*spot, "_used", "radius"), spot).where("_ring <= _used").select(
        *spot, "px", "py", (1 - (1 - edge_weight) * F.col("distance") / F.col("radius")).alias("_share"))
    held = points.groupBy(*place, value, *([flag] if flag else [])).agg(F.count("*").alias("_m"))
    used = inside.join(held, place).withColumn("_w", F.col("_m") * F.col("_share"))
    median = weighted_quantiles(used, spot, value, "_w", {"median": 0.5}, slack=1e-9, total="_weight")
    out = chosen.join(median.select(*spot, "median"), spot)
    columns = ["median", "radius", "n", "n_distinct"]
    if flag:
        marked = used.groupBy(*spot).agg((F.sum(F.when(F.col(flag), F.col("_w")).otherwise(0)) > F.sum("_w") / 2).alias("flagged"))
        out, columns = out.join(marked, spot), [*columns, "flagged"]
    at = cells.select("hex_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    return at.join(out, ["_x", "_y"]).select(*by, "hex_id", *columns)


def hide_uninhabited(prices: DataFrame, footprint: DataFrame, min_footprint: float) -> DataFrame:
    """Every cell: its price where people live, else the value moved to ``price_outside``."""
    out = footprint.select("hex_id", "footprint").join(prices, "hex_id", "left")
    lived = F.col("footprint") >= min_footprint
    return out.select("hex_id", "footprint", F.when(lived, F.col("median")).alias("price"), F.when(lived, F.col("radius")).alias("radius"),
                      F.when(~lived, F.col("median")).alias("price_outside"))


def class_value(low: Column, high: Column, open_add: float = 500.0) -> tuple[Column, Column]:
    """(value, open): class middle, lower bound plus ``open_add`` for an open top class, upper bound for a bottom class."""
    both = low.isNotNull() & high.isNotNull()
    return (F.when(both, (low + high) / 2).when(low.isNotNull(), low + open_add).otherwise(high),
            low.isNotNull() & high.isNull())


def pool_markets(cells: DataFrame, column: str = "market") -> DataFrame:
    """Every cell also under the pooled market 'ALL'."""
    return cells.withColumn(column, F.explode(F.array(F.col(column), F.lit("ALL"))))


def footprint_coverage(footprint: DataFrame, prices: DataFrame, min_footprint: float) -> DataFrame:
    """One row: cells, inhabited cells, priced inhabited cells, coverage in percent."""
    joined = footprint.join(prices.select("hex_id", F.lit(1).alias("_p")), "hex_id", "left")
    lived = F.col("footprint") >= min_footprint
    priced = lived & F.col("_p").isNotNull()
    return joined.agg(F.count("*").alias("cells"), F.count_if(lived).alias("inhabited"), F.count_if(priced).alias("priced"),
                      F.round(100 * F.count_if(priced) / F.nullif(F.count_if(lived), F.lit(0)), 1).alias("coverage_pct"))


def noise_shares(cells: DataFrame, sources: Mapping[str, Column], thresholds: Sequence[int], outside: DataFrame,
                 lowest: Mapping[str, float], combined: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(hex_id, source, threshold, share) of raster cells at or above each noise level.

    ``sources`` maps a name to its level column (0 = below the mapped range), ``lowest`` a name to the
    lowest level of its layer. ``combined`` names the sources of which a further one is the loudest; it is
    mapped from the highest of their lowest levels. A threshold below the lowest mapped level of a source, and
    cells outside the modelled area, have no value.
    """
    lowest = dict(lowest)
    sources = dict(sources)
    for n, parts in (combined or {}).items():
        sources[n] = F.greatest(*[sources[x] for x in parts])
        lowest[n] = max(lowest[x] for x in parts)
    aggs = [F.avg((c >= t).cast("double")).alias(f"{n}_{t}") for n, c in sources.items() for t in thresholds]
    wide = cells.groupBy("hex_id").agg(*aggs).join(outside.select("hex_id", F.lit(True).alias("_out")), "hex_id", "left")
    for n in sources:
        wide = wide.withColumn(f"_low_{n}", F.lit(lowest[n]))
    rows = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(t).alias("threshold"), F.when(
        F.col("_out").isNull() & (F.lit(t) >= F.col(f"_low_{n}")), F.round(f"{n}_{t}", 4)).alias("share"))
        for n in sources for t in thresholds])
    return wide.select("hex_id", F.inline(rows))


def canopy_shares(cells: DataFrame, cell_area: float, hex_area: float) -> DataFrame:
    """(hex_id, canopy, cover): share of valid pixels under trees, and of the hexagon with valid pixels."""
    valid = F.count("canopy")
    return cells.groupBy("hex_id").agg(F.round(F.avg("canopy"), 4).alias("canopy"), F.round(valid * cell_area / hex_area, 4).alias("cover"))
