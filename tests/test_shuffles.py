"""Shuffles backwards, and sums over edges in all of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachgrid.operators import shuffles, stats
from reachgrid.session import checkpoint


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1013])
def test_sources_undo_the_shuffle(spark, n):
    rows = spark.range(n).select("id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(299))).alias("perm"))
    got = stats.shuffle_positions(rows, "id", "perm", n, "to", seed=42).toPandas()
    assert (shuffles.sources(got["to"].to_numpy(), got["perm"].to_numpy(), n) == got["id"].to_numpy()).all()


def test_edge_sums_over_several_blocks(spark):
    n, permutations = 20_000, 80
    z = np.random.default_rng(3).normal(size=n)
    cells = spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "idx long, z double")
    edges = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array((F.col("id") * 7 + 1) % n, F.lit(5))).alias("o"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # blocks stay in tasks of their own
    try:
        got = {r.perm: r.cross for r in shuffles.edge_sums(cells, edges, permutations).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    i = np.arange(n)
    for perm in (0, 1, 74, 75, 80):
        moved = np.empty(n)
        moved[shuffles.sources(i, np.full(n, perm), n) if perm else i] = z
        assert got[perm] == pytest.approx(moved @ moved[(i * 7 + 1) % n] + moved.sum() * moved[5], abs=1e-6)
    assert sorted(got) == list(range(permutations + 1))


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


@pytest.mark.parametrize("block,asked", [(shuffles.BLOCK, shuffles.ASKED), (1000, 500)])
def test_values_are_never_broadcast_and_hot_homes_are_dealt_out(spark, monkeypatch, block, asked):
    """Spark takes what Python returns for as small as its input: some 100 KB here, 48 MB in truth. Every block asks for cells 0 to 99."""
    monkeypatch.setattr(shuffles, "BLOCK", block)
    monkeypatch.setattr(shuffles, "ASKED", asked)
    n, permutations = 20_000, 299
    z = np.random.default_rng(4).integers(0, 9, n).astype(float)
    cells = checkpoint(spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "idx long, z double"))
    at = np.random.default_rng(5).integers(0, n, (2, 200_000))
    at[1, ::2] %= 100
    edges = spark.createDataFrame(list(zip(*at.tolist())), "i long, o long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "500k")
    try:
        sums = shuffles.edge_sums(cells, edges, permutations)
        plan = sums._jdf.queryExecution().sparkPlan()
        got = {r.perm: r.cross for r in sums.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for node in _nodes(plan):
        if node.nodeName() == "BroadcastHashJoin":
            built = node.right() if node.buildSide().toString() == "BuildRight" else node.left()
            assert not [x.nodeName() for x in _nodes(built) if "InArrow" in x.nodeName()]
    i = np.arange(n)
    for perm in (0, 1, 150, 299):
        moved = np.empty(n)
        moved[shuffles.sources(i, np.full(n, perm), n) if perm else i] = z
        assert got[perm] == pytest.approx((moved[at[0]] * moved[at[1]]).sum())
    assert sorted(got) == list(range(permutations + 1))
