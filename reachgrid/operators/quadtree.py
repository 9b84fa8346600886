"""Crowded grid cells cut into leaves of bounded size, as a table, and joins on leaf keys.

A join on grid cells is as slow as its most crowded cell. Cells that hold more than a bounded share of all
points are split into four, again and again, until each piece is bounded; the pieces are the rows of a small
leaf table. A point then has one key, its leaf (or its cell, where that is not crowded), and a box has the
keys of all leaves and cells it touches, so two tables meet by equality on keys. Points of a leaf that cannot
be split further, because they lie on one spot, are dealt into parts, and boxes ask every part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points that a leaf may hold in any case; beyond that, one in so many of all points.
LEAST, SHARE = 4096, 1000
#: How often a cell may be halved.
DEPTH = 8
KEY = ("_level", "_cx", "_cy", "_part")
#: Candidates (rows of one key, multiplied) that a task of a join of pairs compares.
TASK_PAIRS = 1 << 23
#: Rows of one key and one side that meet in one tile.
TILE_ROWS = 2048
#: Tasks of one join at most; beyond that tasks grow.
MOST_TASKS = 20_000


@dataclass(frozen=True)
class Tree:
    """When a cell is split and how often, see :func:`leaves`, and the pairs of a task, see :func:`tiled`."""

    least: int = LEAST
    share: int = SHARE
    depth: int = DEPTH
    task_pairs: int = TASK_PAIRS


def _index(value: Column, size: float, level: Column | int) -> Column:
    """Index of the cell that holds ``value``, cells being ``size`` / 2^level wide.

    Dividing by a power of two is exact, so the index at a coarser level is the shifted one of a finer level.
    """
    scale = 2.0 ** level if isinstance(level, int) else F.pow(F.lit(2.0), level)
    return F.floor(value / F.lit(float(size)) * scale)


def leaves(points: DataFrame, x: Column, y: Column, size: float, *, least: int = LEAST, share: int = SHARE, depth: int = DEPTH) -> DataFrame:
    """The leaf table: _bx, _by (the crowded cell), _level, _cx, _cy (the leaf), n and parts.

    A cell or piece of one is split while it holds more than ``least`` points and more than one in ``share`` of
    all. Fewer than ``share`` pieces of a level are split, so the table has under 4 * share * depth rows
    whatever the points are, and it is safe to broadcast. Points without coordinates are in no leaf.
    """
    if depth < 1 or least < 1 or share < 1:
        raise ValueError("least, share and depth are at least 1")
    placed = points.select(_index(x, size, depth).alias("_fx"), _index(y, size, depth).alias("_fy")).where("_fx is not null and _fy is not null")
    base = placed.groupBy(F.expr(f"_fx >> {depth}").alias("_bx"), F.expr(f"_fy >> {depth}").alias("_by")).agg(F.count("*").alias("n"))
    bound = F.greatest(F.lit(least), F.ceil(base.agg(F.sum("n")).scalar() / share)).cast("bigint")
    crowded = base.withColumn("bound", bound).where("n > bound").select("_bx", "_by", "bound")
    fine = placed.withColumns({"_bx": F.expr(f"_fx >> {depth}"), "_by": F.expr(f"_fy >> {depth}")})
    fine = fine.join(F.broadcast(crowded), ["_bx", "_by"]).groupBy("_bx", "_by", "_fx", "_fy", "bound").agg(F.count("*").alias("n"))
    # Each piece is counted on every level at once; a piece whose parent is over the bound and itself is not, is a leaf.
    level = F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("_level")
    shift = F.expr(f"cast({depth} - _level as int)")
    nodes = fine.select("*", level).select("_bx", "_by", "bound", "_level", F.call_function("shiftright", "_fx", shift).alias("_cx"),
                                           F.call_function("shiftright", "_fy", shift).alias("_cy"), "n")
    nodes = nodes.groupBy("_bx", "_by", "bound", "_level", "_cx", "_cy").agg(F.sum("n").alias("n"))
    split = nodes.where("n > bound").select((F.col("_level") + 1).alias("_level"), F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
    ends = nodes.where(f"n <= bound or _level = {depth}").withColumns({"_px": F.expr("_cx >> 1"), "_py": F.expr("_cy >> 1")})
    out = ends.where("_level = 1").select(*nodes.columns).unionByName(
        ends.where("_level > 1").join(F.broadcast(split), ["_level", "_px", "_py"], "left_semi").select(*nodes.columns))
    return out.select("_bx", "_by", "_level", "_cx", "_cy", "n", F.ceil(F.col("n") / F.col("bound")).cast("int").alias("parts"))


def point_keys(points: DataFrame, x: Column, y: Column, size: float, leaf_table: DataFrame, *, depth: int = DEPTH) -> DataFrame:
    """``points`` with their key; each row once, also those without coordinates. Rows equal in every column share a part."""
    mark = F.xxhash64(*points.columns)
    crowded = leaf_table.select(F.col("_bx").alias("_kx"), F.col("_by").alias("_ky"), F.lit(True).alias("_crowded")).distinct()
    ends = leaf_table.select(F.col("_level").alias("_el"), F.col("_cx").alias("_ex"), F.col("_cy").alias("_ey"), "parts")
    rows = points.withColumns({"_cx": _index(x, size, 0), "_cy": _index(y, size, 0), "_mark": mark})
    rows = rows.join(F.broadcast(crowded), (F.col("_cx") == F.col("_kx")) & (F.col("_cy") == F.col("_ky")), "left").drop("_kx", "_ky")
    # Of a point's cells on all levels just one is a leaf; points of other cells keep level 0.
    levels = F.when(F.col("_crowded"), F.sequence(F.lit(1), F.lit(depth))).otherwise(F.array(F.lit(0)))
    rows = rows.select("*", F.explode(levels).alias("_level"))
    rows = rows.withColumns({"_cx": _index(x, size, F.col("_level")), "_cy": _index(y, size, F.col("_level"))})
    found = rows.join(F.broadcast(ends), (F.col("_level") == F.col("_el")) & (F.col("_cx") == F.col("_ex")) & (F.col("_cy") == F.col("_ey")), "left")
    found = found.where("_level = 0 or _el is not null")
    part = F.when(F.col("_level") == 0, 0).otherwise(F.pmod(F.col("_mark"), F.col("parts"))).cast("int")
    return found.select(*points.columns, "_level", "_cx", "_cy", part.alias("_part"))


def box_keys(rows: DataFrame, low_x: Column, high_x: Column, low_y: Column, high_y: Column, size: float, leaf_table: DataFrame) -> DataFrame:
    """``rows`` with one row for every key that the box touches, borders included; rows without a box have none."""
    def span(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(_index(low, size, 0), _index(high, size, 0)))
    kept = [F.col(c).alias(f"_leaf_{c}") for c in ("_level", "_cx", "_cy", "parts")]
    ends = leaf_table.select("_bx", "_by", *kept)
    boxed = rows.withColumns({"_lx": low_x, "_hx": high_x, "_ly": low_y, "_hy": high_y}).where("_lx <= _hx and _ly <= _hy")
    boxed = boxed.select("*", span(F.col("_lx"), F.col("_hx")).alias("_cx"))
    boxed = boxed.select("*", span(F.col("_ly"), F.col("_hy")).alias("_cy"))
    level = F.col("_leaf__level")
    touches = (F.col("_leaf__cx").between(_index(F.col("_lx"), size, level), _index(F.col("_hx"), size, level))
               & F.col("_leaf__cy").between(_index(F.col("_ly"), size, level), _index(F.col("_hy"), size, level)))
    # A crowded cell without a touched leaf keeps level 0, a key that no point has.
    found = boxed.join(F.broadcast(ends), (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by")) & touches, "left")
    parts = F.sequence(F.lit(0), F.coalesce("_leaf_parts", F.lit(1)) - 1)
    return found.select(*rows.columns, F.coalesce(level, F.lit(0)).alias("_level"), F.coalesce("_leaf__cx", "_cx").alias("_cx"),
                        F.coalesce("_leaf__cy", "_cy").alias("_cy"), F.explode(parts).alias("_part"))


def dealt(points: DataFrame, x: Column, y: Column, boxes: DataFrame, box: tuple[Column, Column, Column, Column], size: float,
          tree: Tree | None) -> tuple[DataFrame, DataFrame]:
    """Both tables with keys: a point in a box shares exactly one. Without ``tree`` the keys are the cells alone."""
    if tree is None:
        cells = points.withColumns({"_level": F.lit(0), "_cx": _index(x, size, 0), "_cy": _index(y, size, 0), "_part": F.lit(0)})
        span = [F.sequence(_index(a, size, 0), _index(b, size, 0)) for a, b in (box[:2], box[2:])]
        tiled = boxes.where((box[0] <= box[1]) & (box[2] <= box[3])).select("*", F.lit(0).alias("_level"), F.explode(span[0]).alias("_cx"))
        return cells, tiled.select("*", F.explode(span[1]).alias("_cy"), F.lit(0).alias("_part"))
    table = leaves(points, x, y, size, least=tree.least, share=tree.share, depth=tree.depth)
    return point_keys(points, x, y, size, table, depth=tree.depth), box_keys(boxes, *box, size, table)


def tiled(points: DataFrame, boxes: DataFrame, keys: Sequence[str], *, task_pairs: int = TASK_PAIRS, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables and the keys on which they meet, dealt by the pairs they make, not by their rows.

    A join of few rows can give very many pairs, and partitions sized by rows leave them all to a few tasks. Candidates
    are counted per key (a job while the plan is made). If they are more than a task's, the rows of a key are dealt
    into tiles of about ``tile_rows`` by ``tile_rows``, and tiles over one task for each ``task_pairs`` candidates: a pair of rows
    meets in exactly one tile. Rows equal in every column share a tile.
    """
    keys = list(keys)
    left, right = (t.groupBy(*keys).agg(F.count("*").alias(n)) for t, n in ((points, "_ln"), (boxes, "_rn")))
    work = left.join(right, keys)
    total = work.agg(F.sum(F.col("_ln").cast("double") * F.col("_rn"))).first()[0] or 0.0
    if total <= task_pairs:
        return points, boxes, keys
    tasks = min(MOST_TASKS, math.ceil(total / task_pairs))
    sizes = work.select(*keys, F.ceil(F.col("_ln") / tile_rows).alias("_ls"), F.ceil(F.col("_rn") / tile_rows).alias("_rs"))

    def deal(rows: DataFrame, mine: str, other: str, held: str, every: str) -> DataFrame:
        place = F.pmod(F.xxhash64(F.lit(mine), *rows.columns), F.col(held)).alias(mine)
        out = rows.join(sizes, keys).select(*rows.columns, place, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(every) - 1)).alias(other))
        return out.repartition(tasks, *keys, "_li", "_ri")
    return deal(points, "_li", "_ri", "_ls", "_rs"), deal(boxes, "_ri", "_li", "_rs", "_ls"), [*keys, "_li", "_ri"]


def renamed(boxes: DataFrame) -> DataFrame:
    """Keys of boxes under other names, for joins by condition."""
    return boxes.withColumnsRenamed({k: f"_on{k}" for k in KEY})


def same_key() -> Column:
    out = F.lit(True)
    for k in KEY:
        out = out & (F.col(k) == F.col(f"_on{k}"))
    return out
