"""Ordered computations that never put an unbounded group into one task.

A plain ``Window.partitionBy(g).orderBy(x)`` sorts all of ``g`` in one task, so one
hot group stalls the job. The helpers here first collapse equal values with a
partially aggregated ``groupBy``, then cut every group into value ranges and combine
small per-range totals, which gives the same numbers from bounded pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachgrid.session import checkpoint

#: Value stretches per unit of ln(1 + |x|): a stretch holds values within about 0.3 % of each other.
STRETCHES = 370


#: Cuts of a stretch where values may lie closer still; a power of two.
CUTS = 1 << 16


def _bytes(order: Column, first: int, n: int) -> Column:
    """Bytes of a text as a whole number, absent ones as 0."""
    return F.conv(F.rpad(F.hex(F.substring(order.cast("binary"), first, n)), 2 * n, "0"), 16, 10).cast("bigint")


def stretch(order: Column, kind: T.DataType) -> Column:
    """A whole number that never falls along ``order``: rows are cut by it, whatever their number."""
    if isinstance(kind, T.NumericType):
        x = order.cast("double")
        cut = F.signum(x) * F.floor(F.log1p(F.abs(x)) * STRETCHES)
        return F.when(F.isnan(x), F.lit(float(1 << 40))).otherwise(cut).cast("bigint")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_diff(order.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return _bytes(order, 1, 4)
    return F.lit(0).cast("bigint")


def fine_cut(order: Column, kind: T.DataType) -> Column:
    """A whole number within ``CUTS`` of 0 that never falls along ``order`` among the rows of one stretch.

    Numbers are cut evenly between the borders of their stretch, moments by the second (65 536th of a day), texts by
    their fifth and sixth byte; other types have no finer cut.
    """
    if isinstance(kind, T.NumericType):
        x = order.cast("double")
        at = F.log1p(F.abs(x)) * STRETCHES
        share = (at - F.floor(at)) * CUTS
        cut = F.when(x < 0, -F.ceil(share)).otherwise(F.floor(share))
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0)).otherwise(cut).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        second = (F.hour(order) * 3600 + F.minute(order) * 60 + F.second(order)).cast("bigint")
        return F.floor(second * CUTS / 86_400).cast("bigint")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return _bytes(order, 5, 2)
    return F.lit(0).cast("bigint")


def running_totals(df: DataFrame, groups: Sequence[str], order: str,
                   sums: Mapping[str, Column], *, small_domain: bool = False, near: bool | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` along ``order`` within ``groups``.

    Rows must be unique per (groups, order) — aggregate equal values first. Every name
    in ``sums`` becomes a running column, and ``<name>_all`` holds the group's total.
    ``small_domain`` marks an order column with a fixed small set of values (minutes,
    seconds of a day, counts); then a group is already bounded and one window suffices.
    Otherwise groups are cut into stretches of near values: a window inside each stretch,
    and the totals of the group's earlier stretches in front. ``near`` cuts each stretch
    again into up to ``CUTS`` pieces, for values that lie close together: keys, moments,
    amounts, texts. It is the default for every type but floating point, whose values
    differ by more as a rule. Cuts depend on a row's value alone, so tables of every size
    go the same way, give the same sums, and no job runs while the plan is made.
    """
    groups = list(groups)
    df = df.where(F.col(order).isNotNull())
    kind = df.schema[order].dataType
    if small_domain:
        run = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*groups)
        return df.select("*", *[F.sum(c).over(run).alias(k) for k, c in sums.items()],
                         *[F.sum(c).over(whole).alias(f"{k}_all") for k, c in sums.items()])
    near = not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType) if near is None else near
    at = ["_stretch", "_cut"] if near else ["_stretch"]
    cut = df.select("*", stretch(F.col(order), kind).alias("_stretch"), *([fine_cut(F.col(order), kind).alias("_cut")] if near else []),
                    *[c.alias(f"_v_{k}") for k, c in sums.items()])
    totals = cut.groupBy(*groups, *at).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    offsets = _offsets(totals, groups, at, list(sums))
    inside = Window.partitionBy(*groups, *at).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(f"_v_{k}").over(inside).alias(k) for k in sums])
    same = [local[c].eqNullSafe(offsets[c]) for c in groups]
    joined = local.join(offsets, [*[local[c] == offsets[c] for c in at], *same])
    return joined.select(
        *[local[c] for c in df.columns],
        *[(local[k] + offsets[f"_o_{k}"]).alias(k) for k in sums],
        *[offsets[f"{k}_all"] for k in sums])


def _offsets(totals: DataFrame, groups: list[str], at: list[str], names: list[str]) -> DataFrame:
    """Sums in front of each piece (``_o_<name>``) and of the group; windows see the stretches of a group or the cuts of a stretch."""
    outer, last = [*groups, *at[:-1]], at[-1]
    before = Window.partitionBy(*outer).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*outer)
    here = totals.select(*groups, *at, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in names],
                         *[F.sum(f"_t_{k}").over(whole).alias(f"{k}_all") for k in names])
    if len(at) == 1:
        return here
    coarse = _offsets(totals.groupBy(*outer).agg(*[F.sum(f"_t_{k}").alias(f"_t_{k}") for k in names]), groups, at[:-1], names)
    same = [here[c].eqNullSafe(coarse[c]) for c in groups]
    joined = here.join(coarse, [*[here[c] == coarse[c] for c in at[:-1]], *same])
    return joined.select(*[here[c] for c in [*groups, *at]], *[(here[f"_o_{k}"] + coarse[f"_o_{k}"]).alias(f"_o_{k}") for k in names],
                         *[coarse[f"{k}_all"] for k in names])


Position = Callable[[Column], Column]


def linear(q: float) -> Position:
    """Interpolated quantile position ``q * (n - 1)``."""
    return lambda n: F.lit(q) * (n - 1)


def whole_part(q: float) -> Position:
    """Index rule ``int(q * (n - 1))``."""
    return lambda n: F.floor(F.lit(q) * (n - 1))


def half_even(q: float) -> Position:
    """Index rule ``round(q * (n - 1))`` with ties to the even index."""
    return lambda n: F.bround(F.lit(q) * (n - 1))


def fraction(numerator: int, denominator: int) -> Position:
    """Index rule ``numerator * n // denominator``."""
    return lambda n: F.floor(n * numerator / denominator)


def quartile_exclusive(i: int) -> Position:
    """Position of the i-th of four groups by the exclusive method, ``i * (n + 1) / 4 - 1``."""
    return lambda n: F.greatest(F.lit(0.0), F.least(i * (n + 1) / 4 - 1, (n - 1).cast("double")))


def group_quantiles(df: DataFrame, groups: Sequence[str], value: str,
                    picks: Mapping[str, Position], *, count: str = "n",
                    small_domain: bool = False, near: bool | None = None, more: Sequence[Column] = (),
                    weight: str | None = None) -> DataFrame:
    """Exact order statistics per group; a fractional position interpolates linearly.

    ``more`` are further aggregates over the same pass, in terms of the value and of ``_k``, how often it occurs.
    ``weight`` is a column that says how many rows a row stands for.
    """
    groups = list(groups)
    times = F.sum(weight) if weight else F.count("*")
    held = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(times.alias("_k"))
    run = running_totals(held, groups, value, {"_cum": F.col("_k")}, small_domain=small_domain, near=near)
    n = F.col("_cum_all")
    v = F.col(value)
    aggs = [F.max(n).alias(count)]
    for name, pos in picks.items():
        p = pos(n)
        low, high = F.floor(p), F.ceil(p)
        aggs += [F.min(F.when(F.col("_cum") > low, v)).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("_cum") > high, v)).alias(f"_hi_{name}"),
                 F.max(p - low).alias(f"_f_{name}")]
    out = run.groupBy(*groups).agg(*aggs, *more)
    own = [c for c in out.columns if c not in groups and c != count and not c.startswith("_")]
    return out.select(*groups, count, *own, *[
        F.when(F.col(f"_f_{k}") == 0, F.col(f"_lo_{k}"))
        .otherwise(F.col(f"_lo_{k}") + F.col(f"_f_{k}") * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")))
        .cast("double").alias(k) for k in picks])


def weighted_quantiles(df: DataFrame, groups: Sequence[str], value: str, weight: str,
                       picks: Mapping[str, float], *, slack: float = 0.0, total: str = "weight",
                       small_domain: bool = False, near: bool | None = None) -> DataFrame:
    """Smallest value whose running weight reaches ``q * total - slack`` (no interpolation)."""
    groups = list(groups)
    held = (df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
            .groupBy(*groups, value).agg(F.sum(weight).alias("_w")))
    run = running_totals(held, groups, value, {"_cum": F.col("_w")}, small_domain=small_domain, near=near)
    all_w = F.col("_cum_all")
    return run.groupBy(*groups).agg(
        F.max(all_w).alias(total),
        *[F.min(F.when((all_w > 0) & (F.col("_cum") >= q * all_w - slack), F.col(value))).alias(k)
          for k, q in picks.items()])


def neighbour(df: DataFrame, part: Sequence[str], order: str, columns: Mapping[str, str],
              *, step: int = 1, chunk: int = 4096) -> DataFrame:
    """Values of the next (``step=1``) or previous (``step=-1``) row along ``order`` in ``part``.

    Sequences are cut into chunks of ``chunk`` order units, so a sequence of any length is
    spread over tasks; the row next to a chunk border comes from the adjoining chunk's end row.
    """
    part = list(part)
    row = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    cut = df.select("*", F.floor(F.col(order) / chunk).alias("_chunk"), row.alias("_row"))
    ends = cut.groupBy(*part, "_chunk").agg(
        (F.min_by if step > 0 else F.max_by)("_row", order).alias("_end"))
    across = Window.partitionBy(*part).orderBy("_chunk")
    shift = F.lead if step > 0 else F.lag
    # Only chunks that have a neighbouring chunk are kept: for short sequences that is none.
    ends = ends.select(*part, "_chunk", shift("_end").over(across).alias("_end")).where("_end is not null")
    inside = Window.partitionBy(*part, "_chunk").orderBy(order)
    near = cut.select("*", shift("_row").over(inside).alias("_near"))
    out = near.join(ends, [*part, "_chunk"], "left")
    return out.select(*df.columns, *[
        F.coalesce(F.col("_near")[k], F.col("_end")[k]).alias(k) for k in columns])


def row_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """0-based position of every row in the total order ``order``.

    A global sort is range-partitioned, so a row's position is the number of rows in earlier
    partitions plus its offset inside its own; no task sees more than one partition.
    """
    placed = checkpoint(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright("_mid", 33)
    sizes = placed.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # A row for a partition; without the hint Spark may broadcast the rows themselves, whose file is small.
    return (placed.withColumn("_pid", pid).join(F.broadcast(starts), "_pid")
            .select(*df.columns, (F.col("_start") + F.col("_mid").bitwiseAND((1 << 33) - 1)).alias(name)))


def forward_fill(df: DataFrame, part: Sequence[str], order: str, column: str, name: str,
                 *, chunk: int = 65_536) -> DataFrame:
    """Adds ``name``: the last non-NULL ``column`` up to and including each row along ``order``.

    Rows are filled inside chunks of ``chunk`` order units; the value to start a chunk with is
    carried over from the one-row-per-chunk table, so long sequences spread over tasks.
    """
    part = list(part)
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    ends = cut.where(F.col(column).isNotNull()).groupBy(*part, "_chunk").agg(F.max_by(column, order).alias("_last"))
    chunks = cut.select(*part, "_chunk").distinct().join(ends, [*part, "_chunk"], "left")
    earlier = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*part, "_chunk", F.last("_last", ignorenulls=True).over(earlier).alias("_carry")).where("_carry is not null")
    inside = Window.partitionBy(*part, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumn("_here", F.last(column, ignorenulls=True).over(inside))
    out = filled.join(carry, [*part, "_chunk"], "left")
    return out.select(*df.columns, F.coalesce("_here", "_carry").alias(name))
