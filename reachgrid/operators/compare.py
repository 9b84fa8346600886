"""Before/after comparison of two result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.values import id_key, number

# Run settings that must agree, and those expected to differ.
STRICT_FIELDS = ("percentile", "decay", "time_window", "departure_time", "modes", "catchment",
                 "max_trip_duration_minutes", "max_walk_time_minutes", "walk_speed_kmh",
                 "max_rides", "monte_carlo_draws")
INFORMATIVE_FIELDS = ("run_date", "network_hash", "scenario", "transit_submodes", "engine_version")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Normalised ids that occur more than once (an error for a comparison)."""
    return (df.select(id_key(F.col(key)).alias("id")).where("id is not null")
            .groupBy("id").agg(F.count("*").alias("n")).where("n > 1"))


def diff_columns(a: Column, b: Column, in_a: Column, in_b: Column, higher_is_better: bool) -> list[Column]:
    """value_a, value_b, diff, pct_change, status of one joined feature."""
    both = in_a & in_b
    if higher_is_better:
        va, vb = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    else:
        va, vb = a, b
    diff = F.when(both, vb - va)
    gain = diff > 0 if higher_is_better else diff < 0
    status = (F.when(~in_b, "only_a").when(~in_a, "only_b")
              .when(va.isNull() & vb.isNull(), "same")
              .when(vb.isNull(), "worse").when(va.isNull(), "better")
              .when(F.abs(diff) < 1e-9, "same").when(gain, "better").otherwise("worse"))
    pct = F.when(va != 0, 100 * diff / va)
    return [F.when(both, va).when(in_a, a).alias("value_a"), F.when(both, vb).when(in_b, b).alias("value_b"),
            diff.alias("diff"), pct.alias("pct_change"), status.alias("status")]


def compare_tables(a: DataFrame, b: DataFrame, *, key: str = "id", value: str = "value",
                   higher_is_better: bool = True) -> DataFrame:
    """Full join on the normalised id. Ids are expected unique; check with :func:`duplicate_ids`."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(id_key(F.col(key)).alias("id"), number(F.col(value)).alias(f"v_{name}"),
                         F.lit(True).alias(f"in_{name}")).where("id is not null")
    joined = side(a, "a").join(side(b, "b"), "id", "full")
    return joined.select("id", *diff_columns(
        F.col("v_a"), F.col("v_b"), F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False)),
        higher_is_better))


def compare_checked(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """:func:`compare_tables`, refusing tables with repeated ids."""
    key = options.get("key", "id")
    for label, df in (("A", a), ("B", b)):
        bad = duplicate_ids(df, key).take(1)
        if bad:
            raise ValueError(f"table {label}: id {bad[0]['id']!r} appears more than once")
    return compare_tables(a, b, **options)


def summarize(rows: DataFrame) -> DataFrame:
    """Per status: rows, sum and mean of the numeric differences."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("diff").alias("sum_diff"),
                                      F.avg("diff").alias("mean_diff"))


def method_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Run settings whose value sets differ: (field, blocking, values_a, values_b).

    Only fields both tables carry are compared; blanks are ignored.
    """
    fields = [f for f in STRICT_FIELDS + INFORMATIVE_FIELDS if f in a.columns and f in b.columns]
    def sets(df: DataFrame, name: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
        return (df.select(F.inline(rows)).where("v is not null and v <> ''").groupBy("field")
                .agg(F.sort_array(F.collect_set("v")).alias(name)))
    both = sets(a, "values_a").join(sets(b, "values_b"), "field", "full")
    empty = F.array().cast("array<string>")
    both = both.select("field", F.col("field").isin(*STRICT_FIELDS).alias("blocking"),
                       F.coalesce("values_a", empty).alias("values_a"),
                       F.coalesce("values_b", empty).alias("values_b"))
    return both.where(F.col("values_a") != F.col("values_b"))


def same_row_sets(cases: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row: rows in every case, and rows per case; comparable only when all agree."""
    names = list(cases)
    tagged = None
    for name, df in cases.items():
        part = df.select(*keys, F.lit(name).alias("case"))
        tagged = part if tagged is None else tagged.unionByName(part)
    seen = tagged.groupBy(*keys).agg(*[F.bool_or(F.col("case") == n).alias(n) for n in names])
    has = [F.col(n) for n in names]
    every = has[0]
    for h in has[1:]:
        every = every & h
    return seen.agg(F.count_if(every).alias("common"), *[F.count_if(h).alias(f"rows_{n}") for n, h in zip(names, has)])


def splice(base: DataFrame, patch: DataFrame, replaced: list[str], column: str = "opportunity") -> DataFrame:
    """Listed categories from ``patch``, every other one from ``base``."""
    return base.where(~F.col(column).isin(*replaced)).unionByName(patch.where(F.col(column).isin(*replaced)))
