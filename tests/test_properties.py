"""Properties that must hold for any data: conservation, monotonicity, mass."""

import random

import pytest
from pyspark.sql import functions as F

from reachgrid.operators import access, census, cubes, fca, impact, prices


@pytest.fixture(params=[1, 2, 3])
def rng(request):
    return random.Random(request.param)


def test_supply_is_handed_out_exactly(spark, rng):
    pairs = spark.createDataFrame([(o, d, rng.randint(0, 60)) for o in range(12) for d in range(9) if rng.random() < 0.6], "from_id int, to_id int, minutes int")
    people = spark.createDataFrame([(o, float(rng.randint(-5, 400))) for o in range(12)], "id int, population double")
    supply = spark.createDataFrame([(d, float(rng.randint(0, 30))) for d in range(9)], "id int, capacity double")
    for decay in ("STEP", "EXPONENTIAL", "LOGISTIC"):
        ratios = fca.supply_ratios(pairs, people, supply, catchment=30, decay=decay)
        reached = fca.competitive_access(pairs, ratios, people, catchment=30, decay=decay)
        assert fca.conservation_gap(reached, people, ratios).first().gap == pytest.approx(0, abs=1e-6)


def test_reach_grows_with_the_cutoff(spark, rng):
    rows = [(o, d, 50, rng.choice([None, *range(90)])) for o in range(8) for d in range(20)]
    matrix = spark.createDataFrame(rows, "from_id int, to_id int, percentile int, minutes int")
    opps = spark.createDataFrame([(d, "jobs", float(rng.randint(0, 5))) for d in range(20)], "to_id int, opportunity string, value double")
    out = access.accessibility(matrix, opps, spark.range(8).withColumnRenamed("id", "id"), ["jobs"], [50], [10, 30, 60, 90])
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r.id, {})[r.cutoff] = r.accessibility
    assert all(v[10] <= v[30] <= v[60] <= v[90] for v in by_id.values()) and len(by_id) == 8


def test_repair_is_monotone_and_never_slower(spark, rng):
    rows = [(i, 0, *[rng.choice([None, rng.randint(1, 80)]) for _ in cubes.VARIANTS]) for i in range(200)]
    fixed = cubes.repair_monotone(spark.createDataFrame(rows, "from_id int, to_id int, few_off int, few_on int, any_off int, any_on int"))
    for r in fixed.collect():
        assert r.any_on_fixed <= min(r.few_on_fixed, r.any_off_fixed) and max(r.few_on_fixed, r.any_off_fixed) <= r.few_off_fixed
        assert all(r[f"{v}_fixed"] <= r[v] for v in cubes.VARIANTS)


def test_dasymetric_keeps_the_people(spark, rng):
    frags = spark.createDataFrame([(rng.randrange(10), t, float(rng.randint(1, 9)), float(rng.choice([0, 0, 3])) if t % 3 else 0.0)
                                   for t in range(15) for _ in range(4)], "hex_id int, tract int, area double, built double")
    tracts = spark.createDataFrame([(t, float(rng.randint(0, 500))) for t in range(15)], "tract int, population double")
    total = tracts.agg(F.sum("population")).first()[0]
    for out in (census.dasymetric(frags, tracts), census.areal_interpolation(frags, tracts)):
        assert out.agg(F.sum("population")).first()[0] == pytest.approx(total)


def test_delta_rules(spark):
    base = spark.createDataFrame([(1, "a", 5), (1, "b", 0), (2, "a", 2), (2, "b", None), (3, "a", 1)], "id int, opportunity string, acc int")
    scen = spark.createDataFrame([("x", 1, "a", 3), ("x", 1, "b", 4), ("x", 2, "a", 2), ("x", 2, "b", 1)], "case_id string, id int, opportunity string, acc int")
    rows = impact.deltas(base, scen, ["x"])
    net = {r.id: (r.net_delta, r.net_delta_n) for r in impact.net_deltas(rows).collect()}
    assert net == {1: (-2, 1), 2: (0, 1), 3: (None, 0)}
    people = spark.createDataFrame([(1, 10.0), (2, 30.0), (3, 5.0)], "id int, pop double")
    row = impact.case_summary(impact.net_deltas(rows), people, "case_id").first()
    assert (row.hexagons, row.pop_losing, row.mean_net) == (3, 10.0, pytest.approx(-0.5))


def test_adaptive_radius(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 10000.0, 0.0)], "hex_id int, x double, y double")
    pts = spark.createDataFrame([(100.0, 0.0, 10.0, "p"), (100.0, 0.0, 20.0, "p"), (400.0, 0.0, 90.0, "q")], "px double, py double, v double, loc string")
    out = prices.adaptive_median(cells, pts, value="v", distinct="loc", radii=range(250, 1001, 50), min_n=3, min_distinct=2).collect()
    assert [(r.hex_id, r.radius, r.n, r.n_distinct, r.median) for r in out] == [(1, 400, 3, 2, 20.0)]


def test_even_days_are_refused(spark):
    days = spark.createDataFrame([(1, 0, 3), (1, 1, 4)], "id int, day int, n int")
    with pytest.raises(Exception, match="even number of days"):
        cubes.median_over_days(days, ["id"]).collect()
    with pytest.raises(ValueError):
        cubes.median_time(days, 4)
