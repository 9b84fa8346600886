"""Distance, nearest-neighbour and polygon joins as equi-joins on grid cells.

Spark has no spatial index. Each helper turns a distance condition into an equality on
cell keys; crowded cells are cut into quadtree leaves, so that no key holds more than a
bounded share of the points. The exact condition is checked on the candidates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachgrid.functions.geo import angle_gap, bearing180, flat_distance, hex_axial, hex_centre, point_segment_distance
from reachgrid.operators import quadtree


def _cell(x: Column | str, y: Column | str, size: Column | float) -> tuple[Column, Column]:
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.floor(x / size), F.floor(y / size)


def _block(x: Column, y: Column, size: Column | float) -> Column:
    """The 3×3 cells around the point as array<struct<_cx,_cy>>."""
    cx, cy = _cell(x, y, size)
    return F.array(*[F.struct((cx + i).alias("_cx"), (cy + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def _around(x: Column, y: Column, radius: float) -> tuple[Column, Column, Column, Column]:
    """The box around a circle, a little larger, so that rounding leaves out nothing."""
    reach = radius * (1 + 1e-9)
    return x - reach, x + reach, y - reach, y + reach


def pairs_within(left: DataFrame, right: DataFrame, radius: float, *,
                 left_xy: Sequence[str] = ("x", "y"), right_xy: Sequence[str] = ("px", "py"),
                 on: Sequence[str] = (), tree: quadtree.Tree | None = quadtree.Tree()) -> DataFrame:
    """Pairs at most ``radius`` apart with their ``distance``; ``on`` adds plain equality keys.

    ``tree`` bounds the left rows of a cell; None is for left rows known to be spread, such as the centres of a lattice.
    With a tree the work is dealt by the number of pairs, which is counted while the plan is made.
    """
    lx, ly, rx, ry = (F.col(c) for c in (*left_xy, *right_xy))
    a, b = quadtree.dealt(left, lx, ly, right, _around(rx, ry, radius), radius, tree)
    keys = [*on, *quadtree.KEY]
    if tree is not None:
        a, b, keys = quadtree.tiled(a, b, keys, task_pairs=tree.task_pairs)
    near = a.join(b, keys).withColumn("distance", flat_distance(lx, ly, rx, ry))
    return near.where(F.col("distance") <= radius).drop(*keys[len(on):])


def exists_within(left: DataFrame, right: DataFrame, radius: float, *,
                  left_xy: Sequence[str] = ("x", "y"), right_xy: Sequence[str] = ("px", "py"),
                  tree: quadtree.Tree | None = quadtree.Tree()) -> DataFrame:
    """Left rows with any right point within ``radius``; equal right locations count once."""
    lx, ly, rx, ry = (F.col(c) for c in (*left_xy, "_rx", "_ry"))
    spots = right.select(F.col(right_xy[0]).alias("_rx"), F.col(right_xy[1]).alias("_ry")).distinct()
    a, b = quadtree.dealt(left, lx, ly, spots, _around(rx, ry, radius), radius, tree)
    return a.join(quadtree.renamed(b), quadtree.same_key() & (flat_distance(lx, ly, rx, ry) <= radius), "left_semi").drop(*quadtree.KEY)


def sum_within(left: DataFrame, right: DataFrame, radius: float, sums: dict[str, Column], *,
               left_xy: Sequence[str] = ("x", "y"), right_xy: Sequence[str] = ("px", "py")) -> DataFrame:
    """Adds per left row the ``sums`` over right points within ``radius`` (0 when none).

    Both sides collapse to distinct locations first, so crowded locations do not multiply.
    """
    spots = left.select(F.col(left_xy[0]).alias("_x"), F.col(left_xy[1]).alias("_y")).distinct()
    held = right.groupBy(F.col(right_xy[0]).alias("_rx"), F.col(right_xy[1]).alias("_ry")).agg(
        *[F.sum(c).alias(k) for k, c in sums.items()])
    near = pairs_within(spots, held, radius, left_xy=("_x", "_y"), right_xy=("_rx", "_ry"))
    total = near.groupBy("_x", "_y").agg(*[F.sum(k).alias(k) for k in sums])
    joined = left.join(total, (F.col(left_xy[0]) == F.col("_x")) & (F.col(left_xy[1]) == F.col("_y")), "left")
    return joined.select(*left.columns, *[F.coalesce(k, F.lit(0)).alias(k) for k in sums])


def _pyramid_sizes(left: DataFrame, right: DataFrame, base: float, extent: float | None) -> list[float]:
    """Cell sizes doubling from ``base`` until one cell spans everything."""
    if extent is None:
        spans = [df.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()
                 for df, a, b in ((left, "x", "y"), (right, "px", "py"))]
        known = [s for s in spans if s[0] is not None]
        extent = max([base] + [max(s[i + 1] for s in known) - min(s[i] for s in known) for i in (0, 2) if known])
    top = max(0, math.ceil(math.log2(max(extent, base) / base)))
    return [base * 2**j for j in range(top + 1)]


def _candidates(spots: DataFrame, points: DataFrame, by: Sequence[str], sizes: Sequence[float],
                need: Column, weight: Column) -> DataFrame:
    """Per spot (x, y, need columns): every point that can be among its ``need`` nearest.

    Cell counts on a pyramid of cell sizes give, per spot, the finest level whose 3×3 block
    already holds enough points; the farthest needed point is then at most the block's diagonal
    away, which bounds the candidate search two levels up. Exact for any density.
    """
    by, top = list(by), len(sizes) - 1
    table = F.array(*[F.lit(float(s)) for s in sizes])
    size_of = F.get(table, F.col("_level"))
    levels = F.explode(F.array(*[F.lit(j) for j in range(top + 1)])).alias("_level")
    cx, cy = _cell("px", "py", size_of)
    tiled = points.select("*", levels).withColumn("_cx", cx).withColumn("_cy", cy)
    counts = tiled.groupBy(*by, "_level", "_cx", "_cy").agg(F.sum(weight).alias("_n"))
    given = spots.columns
    blocks = spots.select("*", levels).select("*", F.inline(_block(F.col("x"), F.col("y"), size_of)))
    shared = [c for c in by if c in given]
    keys = [*given, *[c for c in by if c not in given]]
    filled = blocks.join(counts, ["_level", "_cx", "_cy", *shared]).groupBy(*keys, "_level").agg(F.sum("_n").alias("_n"))
    level = filled.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_n") >= need, F.col("_level"))), F.lit(top)).alias("_found"))
    reach = F.when(F.col("_found") < top, 2 * math.sqrt(2) * F.get(table, F.col("_found")))
    search = (level.withColumn("_reach", reach).withColumn("_level", F.least(F.col("_found") + 2, F.lit(top)))
              .select(*keys, "_reach", "_level", F.inline(_block(F.col("x"), F.col("y"), size_of))))
    found = search.join(tiled, [*by, "_level", "_cx", "_cy"]).withColumn(
        "distance", flat_distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")))
    return found.where(F.col("_reach").isNull() | (F.col("distance") <= F.col("_reach") + 1e-6)).drop(
        "_reach", "_level", "_cx", "_cy", "_found")


def nearest_k(left: DataFrame, right: DataFrame, k: int, *, by: Sequence[str] = (), base: float = 250.0,
              extent: float | None = None, left_key: str = "id", right_key: str = "poi_id",
              skip_same: bool = False) -> DataFrame:
    """The k nearest right points per left row and category ``by``; ties go to the smaller key.

    left: key, x, y. right: key, px, py and the ``by`` columns. Of points at one location only
    the first k can matter. ``skip_same`` leaves a row's own key out.
    """
    by = list(by)
    need = k + 1 if skip_same else k
    sizes = _pyramid_sizes(left, right, base, extent)
    at_spot = Window.partitionBy(*by, "px", "py").orderBy(right_key)
    kept = right.withColumn("_n", F.row_number().over(at_spot)).where(F.col("_n") <= need).drop("_n")
    found = _candidates(left.select("x", "y").distinct(), kept, by, sizes, F.lit(need), F.lit(1))
    ranked = Window.partitionBy("x", "y", *by).orderBy("distance", right_key)
    best = (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= need)
            .select("x", "y", *by, "rank", right_key, "distance"))
    out = left.select(left_key, "x", "y").join(best, ["x", "y"])
    if skip_same:
        again = Window.partitionBy(left_key, *by).orderBy("distance", right_key)
        out = (out.where(F.col(left_key) != F.col(right_key)).withColumn("rank", F.row_number().over(again))
               .where(F.col("rank") <= k))
    return out.select(left_key, *by, "rank", right_key, "distance")


def nth_distance(left: DataFrame, right: DataFrame, *, by: Sequence[str], base: float = 250.0,
                 extent: float | None = None, left_key: str = "id") -> DataFrame:
    """Distance to the n-th nearest right point, n given per left row and category (column ``n``).

    n is capped at the points there are; rows with n < 1 have no distance and are left out.
    """
    by = list(by)
    sizes = _pyramid_sizes(left, right, base, extent)
    held = right.groupBy(*by, "px", "py").agg(F.count("*").alias("_w"))
    total = held.groupBy(*by).agg(F.sum("_w").alias("_total"))
    asked = left.where("n >= 1").join(total, by).withColumn("n", F.least("n", "_total"))
    spots = asked.select("x", "y", *by, "n").distinct()
    found = _candidates(spots, held, by, sizes, F.col("n"), F.col("_w"))
    run = Window.partitionBy("x", "y", *by, "n").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
    reached = found.withColumn("_cum", F.sum("_w").over(run)).where(F.col("_cum") >= F.col("n"))
    best = reached.groupBy("x", "y", *by, "n").agg(F.min("distance").alias("distance"))
    return asked.join(best, ["x", "y", *by, "n"]).select(left_key, *by, "n", "distance")


def nearest_centre(points: DataFrame, centres: DataFrame, max_distance: float, *,
                   point_key: str = "id", centre_key: str = "hex_id") -> DataFrame:
    """(point, centre, distance) of the nearest centre within ``max_distance``; NULL centre when none.

    For a regular hexagon tiling the nearest centre is the containing cell.
    """
    near = pairs_within(points, centres, max_distance)
    best = near.groupBy(point_key).agg(F.min(F.struct("distance", centre_key)).alias("_b"))
    out = points.select(point_key).join(best, point_key, "left")
    return out.select(point_key, F.col("_b")[centre_key].alias(centre_key), F.col("_b")["distance"].alias("distance"))


def nearest_lattice_centre(points: DataFrame, spacing: float, max_distance: float, *, offset: tuple[float, float] = (0.0, 0.0),
                           point_key: str = "id") -> DataFrame:
    """:func:`nearest_centre` on a hexagon lattice: the cell follows from the coordinates, so nothing is joined and no lattice is built."""
    x, y = F.col("x"), F.col("y")
    q, r = hex_axial(x, y, spacing, offset)
    cx, cy = hex_centre(q, r, spacing, offset)
    found = points.select(point_key, F.concat_ws("_", q, r).alias("hex_id"), flat_distance(x, y, cx, cy).alias("distance"))
    near = F.col("distance") <= max_distance
    return found.select(point_key, *[F.when(near, F.col(c)).alias(c) for c in ("hex_id", "distance")])


def _inside(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule over the ring's edges (array<struct<x,y>>, not closed)."""
    n = F.size(ring)
    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        spans = (a["y"] > py) != (b["y"] > py)
        at = (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return spans & (px < at)
    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))
    return F.size(hits) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, *, cell: float, on: Sequence[str] = (), how: str = "inner",
                       tree: quadtree.Tree | None = quadtree.Tree()) -> DataFrame:
    """Join of points (x, y) to polygons (ring) that contain them.

    A polygon asks the cells of its bounding box, and the leaves of those that are crowded with points.
    ``how`` may be inner, left_semi or left_anti.
    """
    xs, ys = F.transform("ring", lambda v: v["x"]), F.transform("ring", lambda v: v["y"])
    box = (F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys))
    a, b = quadtree.dealt(points, F.col("x"), F.col("y"), polygons, box, cell, tree)
    b = quadtree.renamed(b)
    b = b.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in b.columns])
    condition = quadtree.same_key()
    for c in on:
        condition = condition & (F.col(c) == F.col(f"_on_{c}"))
    out = a.join(b, condition & _inside(F.col("x"), F.col("y"), F.col("ring")), how)
    return out.drop(*quadtree.KEY, *[f"_on{k}" for k in quadtree.KEY], *[f"_on_{c}" for c in on])


def match_segments(segments: DataFrame, edges: DataFrame, *, corridor: float, max_angle: float, min_length: float = 20.0,
                   cell: float | None = None, tree: quadtree.Tree | None = quadtree.Tree()) -> DataFrame:
    """Segments (x1,y1,x2,y2) joined to edges (ex1,ey1,ex2,ey2) whose midpoint lies in the corridor
    and whose undirected bearing differs by at most ``max_angle``."""
    cell = cell or max(4 * corridor, 100.0)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    long = segments.where(flat_distance(x1, y1, x2, y2) >= min_length)
    box = (F.least(x1, x2) - corridor, F.greatest(x1, x2) + corridor, F.least(y1, y2) - corridor, F.greatest(y1, y2) + corridor)
    ex1, ey1, ex2, ey2 = (F.col(c) for c in ("ex1", "ey1", "ex2", "ey2"))
    mid = edges.withColumn("_mx", (ex1 + ex2) / 2).withColumn("_my", (ey1 + ey2) / 2)
    mid, tiled = quadtree.dealt(mid, F.col("_mx"), F.col("_my"), long, box, cell, tree)
    near = point_segment_distance(F.col("_mx"), F.col("_my"), x1, y1, x2, y2) <= corridor
    along = angle_gap(bearing180(x1, y1, x2, y2), bearing180(ex1, ey1, ex2, ey2)) <= max_angle
    # Both sides are far larger in memory than as files, by which Spark would broadcast one.
    return tiled.join(mid.hint("merge"), [*quadtree.KEY]).where(near & along).drop(*quadtree.KEY, "_mx", "_my")


def hex_lattice(spark, extent: tuple[float, float, float, float], spacing: float,
                offset: tuple[float, float] = (0.0, 0.0), max_cells: int | None = None) -> DataFrame:
    """Hexagon centres (q, r, x, y) covering the extent; refuses more than ``max_cells``."""
    xmin, ymin, xmax, ymax = extent
    row = spacing * math.sqrt(3) / 2
    r0, r1 = math.floor((ymin - offset[1]) / row), math.ceil((ymax - offset[1]) / row)
    columns = math.ceil((xmax - xmin) / spacing) + 2
    total = (r1 - r0 + 1) * columns
    if max_cells is not None and total > max_cells:
        raise ValueError(f"about {total} cells: use a larger spacing or a smaller extent")
    grid = spark.range(total)
    r = F.floor(F.col("id") / columns) + r0
    first = F.floor((xmin - offset[0]) / spacing - r / 2)
    q = first + F.col("id") % columns
    x, y = hex_centre(q, r, spacing, offset)
    return grid.select(q.alias("q"), r.alias("r"), x.alias("x"), y.alias("y")).where(
        F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))
