"""Accessibility, competitive access, departure windows, equity, comparison: worked examples."""

import math

import pytest
from pyspark.sql import functions as F

from reachgrid.functions import values
from reachgrid.functions.decay import catchment_weight, decay_weight
from reachgrid.operators import access, compare, equity, fca


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_decay_weights(spark):
    assert one(spark, decay_weight("STEP", F.lit(29), 30)) == 1.0
    assert one(spark, decay_weight("STEP", F.lit(30), 30)) == 0.0
    assert one(spark, decay_weight("STEP", F.lit(None).cast("int"), 30)) == 0.0
    assert one(spark, decay_weight("EXPONENTIAL", F.lit(30), 30)) == pytest.approx(0.5)
    assert one(spark, decay_weight("EXPONENTIAL", F.lit(30), 0)) == 0.0
    assert one(spark, decay_weight("LOGISTIC", F.lit(30), 30)) == pytest.approx(0.5)
    assert one(spark, catchment_weight("EXPONENTIAL", F.lit(30), 30)) == 0.0
    with pytest.raises(ValueError):
        decay_weight("LINEAR", F.lit(1), 30)


def test_accessibility_has_every_row(spark):
    wide = spark.createDataFrame([("a", "x", "10", "20"), ("a", "y", "30", ""), ("b", "x", "", "")],
                                 "from_id string, to_id string, travel_time_p50 string, travel_time_p85 string")
    opps = access.opportunities_long(spark.createDataFrame([("x", "2", ""), ("y", "3", "0.5")], "id string, jobs string, beds string"),
                                     ["jobs", "beds", "absent"])
    origins = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = access.accessibility(access.matrix_long(wide), opps, origins, ["jobs", "beds"], [50, 85], [15, 31]).collect()
    got = {(r.id, r.opportunity, r.percentile, r.cutoff): r.accessibility for r in rows}
    assert len(got) == 16
    assert got["a", "jobs", 50, 15] == 2 and got["a", "jobs", 50, 31] == 5 and got["a", "beds", 50, 31] == 0.5
    assert got["a", "jobs", 85, 15] == 0 and got["a", "jobs", 85, 31] == 2
    assert all(v == 0 for k, v in got.items() if k[0] == "b")


def test_matrix_pairs_needs_the_column(spark):
    wide = spark.createDataFrame([("a", "x", 5)], "from_id string, to_id string, travel_time_p50 int")
    assert access.matrix_pairs(wide, 50).count() == 1
    with pytest.raises(ValueError):
        access.matrix_pairs(wide, 85)


def test_two_step_worked_example(spark):
    pairs = spark.createDataFrame([("A", "X", 10), ("A", "Y", 40), ("B", "X", 20), ("B", "Y", 25), ("A", "Z", 35)],
                                  "from_id string, to_id string, minutes int")
    people = spark.createDataFrame([("A", 100.0), ("B", 300.0)], "id string, population double")
    supply = spark.createDataFrame([("X", 10.0), ("Y", 20.0), ("Z", 5.0)], "id string, capacity double")
    ratios = fca.supply_ratios(pairs, people, supply, catchment=30)
    r = {x.to_id: x.ratio for x in ratios.collect()}
    assert r == {"X": pytest.approx(0.025), "Y": pytest.approx(20 / 300), "Z": 0.0}
    got = {x.id: x.access for x in fca.competitive_access(pairs, ratios, people, catchment=30).collect()}
    assert got == {"A": pytest.approx(0.025), "B": pytest.approx(0.025 + 20 / 300)}
    summary = fca.supply_summary(ratios, people).first()
    assert summary.unserved_supply == 1 and summary.distributed_supply == 30
    reached = fca.competitive_access(pairs, ratios, people, catchment=30)
    assert fca.conservation_gap(reached, people, ratios).first().gap == pytest.approx(0, abs=1e-9)


def test_thin_supply(spark):
    pairs = spark.createDataFrame([("A", "X", 10), ("B", "Y", 10)], "from_id string, to_id string, minutes int")
    people = spark.createDataFrame([("A", 0.2), ("B", 5000.0), ("C", -3.0)], "id string, population double")
    supply = spark.createDataFrame([("X", 1.0), ("Y", 1.0)], "id string, capacity double")
    ratios = fca.supply_ratios(pairs, people, supply, catchment=30)
    assert [r.to_id for r in fca.thin_supply(ratios, people).collect()] == ["X"]
    got = {x.id: x.access for x in fca.competitive_access(pairs, ratios, people, catchment=30).collect()}
    assert got["A"] == pytest.approx(5.0) and got["C"] == 0


def test_percentiles_and_service_minutes(spark):
    rows = [("a", "x", m) for m in (10, 20, 30, 40)] + [("a", "x", None), ("b", "x", None)]
    dep = spark.createDataFrame(rows, "from_id string, to_id string, minutes int")
    got = {r.from_id: r for r in access.percentile_matrix(dep, [20, 60, 95], 35).collect()}
    assert (got["a"].travel_time_p20, got["a"].travel_time_p60, got["a"].travel_time_p95) == (10, 30, None)
    assert "b" not in got
    kept = {r.from_id: r for r in access.percentile_matrix(dep, [20, 60, 95], 35, keep_unreached=True).collect()}
    assert kept["b"].travel_time_p20 is None and kept["a"] == got["a"]
    svc = access.service_minutes(dep, [20, 30]).collect()
    assert [(r.from_id, r.svc_min_c20, r.svc_min_c30) for r in svc] == [("a", 2, 3)]
    hist = spark.createDataFrame([("a", "x", [1, 0, 4] + [0] * 117), ("b", "x", None)], "from_id string, to_id string, histogram array<int>")
    got = {r.from_id: r.svc_min_c2 for r in access.service_minutes_from_histogram(hist, [2], 2).collect()}
    assert got == {"a": 3}
    got = {r.from_id: r.svc_min_c2 for r in access.service_minutes_from_histogram(hist, [2], 2, keep_unreached=True).collect()}
    assert got == {"a": 3, "b": 0}


def test_walk_only_guard(spark):
    walk = spark.createDataFrame([("a", "x", 5)], "from_id string, to_id string, minutes int")
    assert access.walk_only_guard(walk, walk).first().level == "ERROR"
    assert access.walk_only_guard(walk, walk, removes_service=True).first().level == "WARN"


def test_equity_summary(spark):
    rec = spark.createDataFrame([(10.0, 0.0, "N"), (30.0, 2.0, "S"), (60.0, 1.0, "S"), (None, 5.0, "S"), (-1.0, 5.0, ""), (0.0, 9.0, "N")],
                                "pop double, acc double, d string")
    got = {r.grp: r for r in equity.summarize(rec, "pop", ["acc"], 1, "d").collect()}
    assert got["ALL"].share_at_least == pytest.approx(0.9) and got["ALL"].skipped == 2 and got["ALL"].population == 100
    assert got["(none)"].population == 0 and got["(none)"].share_at_least is None and got["(none)"].skipped == 1
    assert got["N"].gini is None and got["N"].p50 == 0


@pytest.mark.parametrize("pairs,expected", [([(5, 1), (5, 3)], 0.0), ([(0, 1), (1, 1)], 0.5), ([(0, 10)], None), ([(-1, 1), (2, 1)], None)])
def test_gini(spark, pairs, expected):
    rec = spark.createDataFrame([(float(w), float(x)) for x, w in pairs], "w double, x double")
    got = equity.summarize(rec, "w", ["x"], 1).first().gini
    assert got == (None if expected is None else pytest.approx(expected))


def test_quantiles(spark):
    rec = spark.createDataFrame([(50.0, 0.0), (30.0, 10.0), (20.0, 20.0)], "w double, x double")
    row = equity.summarize(rec, "w", ["x"], 1).first()
    assert (row.p10, row.p50, row.p75, row.p90) == (0, 0, 10, 20)


def test_gini_trapezoid_is_zero_for_nothing(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 2.0), ("b", 0.0, 1.0), ("b", 1.0, 1.0)], "g string, v double, w double")
    got = {r.g: r.gini for r in equity.gini_trapezoid(df, ["g"], "v", "w").collect()}
    assert got == {"a": 0.0, "b": 0.5}


def test_terciles_split_people(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 10.0), (3.0, 10.0)], "v double, w double")
    assert tuple(equity.tercile_cuts(df, "v", "w").first()) == (1.0, 2.0)
    hot = spark.createDataFrame([(1.0, 90.0), (2.0, 5.0), (3.0, 5.0)], "v double, w double")
    assert tuple(equity.tercile_cuts(hot, "v", "w").first()) == (1.0, 2.0)
    repeated = spark.createDataFrame([(1.0, 40.0), (1.0, 50.0), (2.0, 5.0)], "v double, w double")
    assert tuple(equity.tercile_cuts(repeated, "v", "w").first()) == (1.0, 1.0)


def test_sentence(spark):
    rec = spark.createDataFrame([(1500.0, 2.0), (500.0, 0.0)], "w double, x double")
    text = equity.summarize(rec, "w", ["x"], 1).select(equity.sentence(1).alias("s")).first().s
    assert text == "ALL: 75.0% of residents (1 500 of 2 000) have x ≥ 1; 25.0% have none."


def test_compare_statuses(spark):
    a = spark.createDataFrame([("1.0", "10"), ("2", None), ("3", "5"), ("4", "5"), ("", "9"), ("6", "0")], "id string, value string")
    b = spark.createDataFrame([(1, 12.0), (2, 3.0), (3, None), (5, 1.0), (6, 2.0)], "id int, value double")
    up = {r.id: (r.diff, r.status) for r in compare.compare_tables(a, b).collect()}
    assert up == {"1": (2.0, "better"), "2": (3.0, "better"), "3": (-5.0, "worse"), "4": (None, "only_a"), "5": (None, "only_b"), "6": (2.0, "better")}
    down = {r.id: (r.diff, r.pct_change, r.status) for r in compare.compare_tables(a, b, higher_is_better=False).collect()}
    assert down["1"] == (2.0, 20.0, "worse") and down["2"] == (None, None, "better") and down["3"] == (None, None, "worse")
    assert down["6"] == (2.0, None, "worse")
    with pytest.raises(ValueError):
        compare.compare_checked(a.unionByName(a), b)


def test_argument_rules():
    assert values.parse_percentiles("5, 50 95") == [5, 50, 95]
    for bad in ("", "50 5", "0", "1 2 3 4 5 6", "100"):
        with pytest.raises(ValueError):
            values.parse_percentiles(bad)
    assert values.check_cutoffs([60, 30, 30]) == [30, 60]
    for bad, svc in (([], False), ([0], False), ([120], True)):
        with pytest.raises(ValueError):
            values.check_cutoffs(bad, service_minutes=svc)
    assert values.trip_cap(45, [30, 60]) == 60
    assert values.scenario_clock("06:30") == 23400 and values.scenario_clock("25:00") == 90000
    for bad in ("31:00", "6", "06:60"):
        with pytest.raises(ValueError):
            values.scenario_clock(bad)


def test_column_guards(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        values.require_columns(df, ["b"], "origins")
    with pytest.raises(ValueError):
        values.require_new_columns(df, ["a"], "result")


def test_lenient_numbers(spark):
    assert one(spark, values.number(F.lit("x"))) is None
    assert one(spark, values.number_or_zero(F.lit(""))) == 0
    assert one(spark, values.comma_number(F.lit("12,5"))) == 12.5
    assert [one(spark, values.id_key(F.lit(v))) for v in ("12", "12.0", " 12 ", "", "NULL", "12.5")] == ["12", "12", "12", None, None, "12.5"]
    assert one(spark, values.clock_seconds(F.lit("25:10:05"))) == 90605
    assert one(spark, values.clock_seconds(F.lit("7:10"))) is None
    assert math.isclose(one(spark, values.base_speed(F.lit("30 mph"), F.lit(50.0))), 48.27)
    assert one(spark, values.base_speed(F.lit("500"), F.lit(50.0))) == 50.0
