"""Sums per origin: zero rows do not pass the aggregation, and groups of pairs are dealt by the number of rows."""

import io
from contextlib import redirect_stdout

from reachgrid.operators import access, cubes
from reachgrid.plans import views


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_origins_join_the_sums(spark):
    matrix = spark.createDataFrame([(1, 7, 50, 10), (1, 8, 50, 40), (2, 8, 85, 5), (None, 7, 50, 1), (9, 7, 50, 1)], "from_id long, to_id long, percentile int, minutes int")
    opps = spark.createDataFrame([(7, "a", 2.0), (8, "a", 1.0), (8, "b", 3.0)], "to_id long, opportunity string, value double")
    origins = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "id long")
    out = access.accessibility(matrix, opps, origins, ["a", "b"], [50, 85], [30, 60])
    got = {(r.id, r.opportunity, r.percentile, r.cutoff): r.accessibility for r in out.collect()}
    held = {(1, "a", 50, 30): 2.0, (1, "a", 50, 60): 3.0, (1, "b", 50, 60): 3.0, (None, "a", 50, 30): 2.0, (None, "a", 50, 60): 2.0}
    held |= {(2, n, 85, c): v for n, v in (("a", 1.0), ("b", 3.0)) for c in (30, 60)}
    assert got == {(i, n, p, c): held.get((i, n, p, c), 0.0) for i in (1, 2, 3, None) for n in "ab" for p in (50, 85) for c in (30, 60)}
    assert out.count() == len(got) and "Union" not in plan_of(out)
    types = spark.createDataFrame([(7, "a"), (8, "b")], "to_id long, type string")
    counts = cubes.facility_counts(matrix.where("percentile = 50"), types, origins, ["a", "b"], [10, 40], clip=1)
    assert "Union" not in plan_of(counts) and counts.where("n > 0 and id = 1").count() == 3 and counts.count() == 16


def test_tasks_follow_the_rows(spark, monkeypatch):
    d = views.Data(spark, "/root/testdata/sf0.001")
    assert d.pair_rows.rdd.getNumPartitions() == 1
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    d = views.Data(spark, "/root/testdata/sf0.001")
    assert d.pair_rows.rdd.getNumPartitions() == -(-d.table("lineitem").count() // 500) > 10
