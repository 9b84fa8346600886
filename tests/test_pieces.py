"""Prefix sums over groups whose values lie close together: cut again, same sums."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reachgrid.functions.scale import fine_cut, running_totals, stretch

KINDS = {
    "close": ("long", lambda r: 1_700_000_000 + r.randrange(40_000)),  # seconds of half a day: one stretch
    "ids": ("long", lambda r: 10_000_000_000 + r.randrange(10_000_000)),
    "price": ("double", lambda r: 1000 + r.random()),
    "money": ("decimal(20,2)", lambda r: __import__("decimal").Decimal(r.randrange(10_000_000, 10_000_999)) / 100),
    "text": ("string", lambda r: "same prefix " [:r.choice([4, 4, 12])] + chr(97 + r.randrange(26)) * r.randrange(1, 4) + "é" * r.randrange(2)),
    "moment": ("timestamp", lambda r: __import__("datetime").datetime(2026, 1, 5, 12, 0, r.randrange(60), r.randrange(1_000_000))),
    "local": ("timestamp_ntz", lambda r: __import__("datetime").datetime(2026, 1, 5, 12, r.randrange(60), 0, r.randrange(1_000_000))),
    "day": ("date", lambda r: __import__("datetime").date(2026, 1, 1 + r.randrange(28))),
    "flag": ("boolean", lambda r: r.random() < 0.5),
    "spread": ("double", lambda r: r.choice([-1, 1]) * 10 ** r.uniform(-9, 9)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_sums_are_the_same_wherever_the_cuts_fall(spark, kind):
    r = random.Random(1)
    name, draw = KINDS[kind]
    rows = Counter((r.choice(["a", "a", "a", "b", None]), draw(r)) for _ in range(3000))
    table = [(g, v, n) for (g, v), n in rows.items()] + [("c", None, 1)]
    df = spark.createDataFrame(table, f"g string, v {name}, n long")
    kind = df.schema["v"].dataType
    cut = df.where("v is not null").select("g", "v", stretch(F.col("v"), kind), fine_cut(F.col("v"), kind))
    order = cut.orderBy("g", "v").collect()
    assert all((x[2], x[3]) <= (y[2], y[3]) for x, y in zip(order, order[1:], strict=False) if x[0] == y[0])
    got = {(x.g, x.v): (x.run, x.run_all) for x in running_totals(df, ["g"], "v", {"run": F.col("n")}, near=True).collect()}
    for g in ("a", "b", None):
        run, mine = 0, sorted((v, n) for (h, v), n in rows.items() if h == g)
        for v, n in mine:
            run += n
            assert got.pop((g, v)) == (run, sum(x[1] for x in mine))
    assert not got


def test_a_million_close_values_are_spread_over_tasks(spark):
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.col("id") + 1_000_000_000).alias("v"))  # within 0.1 %
    cuts = df.groupBy(stretch(F.col("v"), df.schema["v"].dataType), fine_cut(F.col("v"), df.schema["v"].dataType)).count()
    sizes = [x["count"] for x in cuts.collect()]
    assert len(sizes) > 200 and max(sizes) < 100
    sc = spark.sparkContext
    sc.setJobGroup("planning", "plan only")
    plan = running_totals(df, ["g"], "v", {"run": F.lit(1)})
    assert list(sc.statusTracker().getJobIdsForGroup("planning")) == []
    sc.setJobGroup("other", "run")
    assert plan.agg(F.count("*"), F.count_if(F.col("run") == F.col("v") - 999_999_999), F.max("run_all")).first()[:] == (1_000_000, 1_000_000, 1_000_000)


def test_without_groups_and_without_rows(spark):
    df = spark.range(2000).select((F.col("id") + 5_000_000).alias("v"))
    assert running_totals(df, [], "v", {"run": F.col("v")}, near=True).agg(F.max("run"), F.min("run_all")).first()[:] == (sum(range(5_000_000, 5_002_000)),) * 2
    assert running_totals(df.limit(0), [], "v", {"run": F.col("v")}, near=True).count() == 0
