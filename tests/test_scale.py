"""Ordered helpers give the same numbers whether or not they split their input."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reachgrid.functions import scale


@pytest.fixture()
def skewed(spark):
    """One group holds a third of the rows; a third of all values are equal."""
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", 0.0 if rng.random() < 0.33 else round(rng.uniform(-5, 5), 3), rng.randint(0, 9)) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, x double, w int").repartition(5)


def plain_totals(df, groups, order, value):
    run = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", F.sum(value).over(run).alias("c"), F.sum(value).over(Window.partitionBy(*groups)).alias("c_all"))


@pytest.mark.parametrize("groups", [["g"], [], ["g", "w"]])
def test_running_totals(skewed, groups):
    """A hot group, no group at all, and many small groups."""
    held = skewed.groupBy(*groups, "x").agg(F.sum(F.lit(1)).alias("k"))
    got = scale.running_totals(held, groups, "x", {"c": F.col("k")})
    assert got.columns == [*held.columns, "c", "c_all"]
    assert got.count() == held.count() and got.exceptAll(plain_totals(held, groups, "x", "k")).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "decimal(12,3)", "float", "string", "date", "timestamp"])
def test_running_totals_of_any_order(skewed, kind):
    x = F.col("x")
    order = {"date": F.date_add(F.lit("2026-01-01"), F.floor(x * 40).cast("int")), "timestamp": F.timestamp_seconds(x * 100000)}.get(kind, (x * 7).cast(kind))
    held = skewed.select("g", order.alias("o")).groupBy("g", "o").agg(F.count("*").alias("k"))
    got = scale.running_totals(held, ["g"], "o", {"c": F.col("k")})
    assert got.exceptAll(plain_totals(held, ["g"], "o", "k")).count() == 0


def test_running_totals_starts_no_job(skewed):
    held, tracker = skewed.groupBy("g", "x").agg(F.count("*").alias("k")), skewed.sparkSession.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    scale.running_totals(held, ["g"], "x", {"c": F.col("k")})
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_group_quantiles(skewed):
    out = scale.group_quantiles(skewed, ["g"], "x", {"median": scale.linear(0.5), "q": scale.linear(0.15), "i": scale.fraction(1, 3)},
                                more=[F.sum(F.when(F.col("x") > 0, F.col("_k"))).alias("above")])
    for r in out.collect():
        xs = sorted(v.x for v in skewed.where(F.col("g") == r.g).collect())
        n = len(xs)
        def at(p):
            lo = int(p)
            return xs[lo] + (p - lo) * (xs[min(lo + 1, n - 1)] - xs[lo])
        assert r.n == n and r.median == pytest.approx(at(0.5 * (n - 1))) and r.q == pytest.approx(at(0.15 * (n - 1))) and r.i == xs[n // 3]
        assert r.above == sum(x > 0 for x in xs)


def test_position_rules(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "x double").withColumn("g", F.lit(0))
    row = scale.group_quantiles(df, ["g"], "x", {"p75": scale.quartile_exclusive(3), "w": scale.whole_part(0.5), "h": scale.half_even(0.5)}).first()
    assert row.p75 == pytest.approx(8.25) and row.w == 5 and row.h == 5


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(0.0, 50.0), (10.0, 30.0), (20.0, 20.0)], "x double, w double")
    row = scale.weighted_quantiles(df, [], "x", "w", {"a": 0.5, "b": 0.6, "c": 0.9}, slack=1e-9).first()
    assert (row.a, row.b, row.c) == (0, 10, 20)


@pytest.mark.parametrize("step", [1, -1])
def test_neighbour_across_chunks(spark, step):
    rows = [("t" if i % 3 else "u", i * 2 + (i % 5 == 0), i) for i in range(200)]
    df = spark.createDataFrame(rows, "t string, seq int, v int").repartition(4)
    w = Window.partitionBy("t").orderBy("seq")
    want = df.withColumn("n", (F.lead("v") if step > 0 else F.lag("v")).over(w))
    got = scale.neighbour(df, ["t"], "seq", {"n": "v"}, step=step, chunk=16)
    assert got.count() == 200 and got.exceptAll(want).count() == 0


def test_forward_fill_across_chunks(spark):
    rows = [("s", i, f"r{i}" if i % 37 == 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, row_no int, region string").repartition(4)
    w = Window.partitionBy("s").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("f", F.last("region", ignorenulls=True).over(w))
    got = scale.forward_fill(df, ["s"], "row_no", "region", "f", chunk=20)
    assert got.count() == 300 and got.exceptAll(want).count() == 0


def test_row_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(6)
    assert all(r.k == r.idx for r in scale.row_index(df, "k").collect())
