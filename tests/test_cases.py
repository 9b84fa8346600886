"""Results by case: recomputed when inputs change, whole after a break, rows and settings together."""

import pytest
from pyspark.sql import functions as F

from reachgrid.operators import cases
from reachgrid.operators.cases import CaseStore
from reachgrid.sources import tables


@pytest.fixture()
def inputs(spark):
    rows = [(c, i, v) for c in "abc" for i, v in ((1, 1.5), (2, None), (2, None), (3, -0.5))]
    return spark.createDataFrame(rows, "scenario string, id long, v double")


def run(store, inputs, names="abc", settings=None, calls=None, fail=False):
    def compute(missing):
        (calls if calls is not None else []).append(sorted(missing))
        out = inputs.where(F.col("scenario").isin(missing)).groupBy("scenario").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
        return out.withColumn("total", F.raise_error(F.lit("broken off")).cast("double")) if fail else out
    return store.update(cases.prints(inputs, "scenario", list(names)), compute, settings)


def rows(store):
    return {r.scenario: (r.total, r.n) for r in store.read().collect()}


def test_fingerprints_follow_rows_and_nothing_else(spark, inputs):
    def of(df):
        return {r.case: r.fingerprint for r in cases.fingerprints(df, "scenario").collect()}
    base = of(inputs)
    assert len(set(base.values())) == 1 and of(inputs.repartition(7).orderBy(F.desc("id")).select("v", "scenario", "id")) == base
    changed = [inputs.distinct(), inputs.withColumn("v", F.col("v") + 1e-9), inputs.withColumn("v", F.coalesce("v", F.lit(0.0))), inputs.withColumnRenamed("v", "w"),
               inputs.withColumn("id", F.col("id").cast("int")), inputs.limit(11), inputs.withColumn("x", F.lit(None).cast("int"))]
    assert all(of(x)["c"] != base["c"] or of(x)["a"] != base["a"] for x in changed)
    shifted = spark.createDataFrame([("a", None, "x"), ("b", "x", None)], "scenario string, p string, q string")
    assert len(set(of(shifted).values())) == 2


def test_only_changed_cases_are_computed(spark, inputs, tmp_path):
    store, calls = CaseStore(spark, str(tmp_path)), []
    with pytest.raises(ValueError):
        store.read()
    assert run(store, inputs, "ab", calls=calls) == ["a", "b"] and run(store, inputs, "abc", calls=calls) == ["c"] and run(store, inputs, calls=calls) == []
    new = inputs.withColumn("v", F.when(F.col("scenario") == "b", 10.0).otherwise(F.col("v")))
    assert {(r.case, r.reason) for r in cases.stale(store, new.where("scenario <> 'c'"), "scenario").collect()} == {("b", "changed"), ("c", "gone")}
    assert run(store, new, calls=calls) == ["b"]
    assert calls == [["a", "b"], ["c"], ["b"]] and rows(store) == {"a": (1.0, 4), "b": (40.0, 4), "c": (1.0, 4)}
    assert run(store, inputs, "b") == ["b"] and rows(store)["b"] == (1.0, 4) and len(rows(store)) == 3  # and back again
    assert run(store, inputs, "ac", settings={}) == []


def test_a_break_leaves_the_old_state(spark, inputs, tmp_path, monkeypatch):
    store = CaseStore(spark, str(tmp_path))
    run(store, inputs)
    new = inputs.withColumn("v", F.lit(2.0))
    with pytest.raises(Exception, match="broken off"):
        run(store, new, fail=True)  # in the data
    assert rows(store) == {c: (1.0, 4) for c in "abc"}
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(CaseStore, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("between data and manifest")))
        run(store, new)
    assert rows(store) == {c: (1.0, 4) for c in "abc"} and store.settings() == {}
    assert run(store, new) == ["a", "b", "c"] and rows(store) == {c: (8.0, 4) for c in "abc"}


def test_settings_are_part_of_the_state(spark, inputs, tmp_path):
    store = CaseStore(spark, str(tmp_path))
    assert run(store, inputs, settings={"cutoffs": [30], "decay": "STEP"}) == ["a", "b", "c"]
    assert store.settings() == {"cutoffs": [30], "decay": "STEP"}
    assert run(store, inputs, settings={"decay": "STEP", "cutoffs": [30]}) == [] and run(store, inputs, "a", settings={"cutoffs": [45]}) == ["a"]
    assert store.settings() == {"cutoffs": [45]} and set(rows(store)) == {"a"}  # the others belong to other settings


def test_cases_without_rows_and_two_runs_at_a_time(spark, inputs, tmp_path):
    store = CaseStore(spark, str(tmp_path))
    assert run(store, inputs, "ad") == ["a", "d"] and run(store, inputs, "ad") == [] and set(rows(store)) == {"a"}
    store._commit(2, {"a": ("x", "p")}, "{}")
    store._commit(2, {"b": ("y", "q")}, "{}")
    assert store.manifest().count() == 1


GOOD = ["[ 1/17] 06:00 -> 90 features in 5.0 s", "[17/17] 22:00 -> 0 features in 7 s (cached)", "[2/17]   07:00 -> 3 features in 0.5 s"]
BAD = ["[ 1/17] warning: took longer in 3 s", "[1/17] 06:00 -> 90 features in x s", "[x/17] 06:00 -> 90 features in 5.0 s", " [1/17] 06:00 -> 90 features in 5.0 s",
       "[1/17] 06:30 -> 90 features in 5.0 s", "[1/17] 06:00 -> features in 5.0 s", "[1/17 06:00 -> 90 features in 5.0 s", "[1] 06:00 -> 90 features in 5.0 s", "",
       "[1/17] 06:00 -> 90 features in 5.0", "[1/17] 06:00 => 90 features in 5.0 s", "[1/17] 6:00 -> 90 features in 5.0 s", "origins 5", "[1/99] done in 1 s", None]


def test_lines_of_run_logs(spark):
    logs = spark.createDataFrame([("good", x) for x in ["origins: 10", *GOOD]] + [("bad", x) for x in ["origins: 10", *BAD]] + [("both", x) for x in ["origins: 4", *GOOD, *BAD]], "file string, value string")
    got = {r.file: (r.origins, r.steps_done, r.steps_total, r.elapsed_s) for r in tables.run_costs(logs).collect()}
    assert got == {"good": (10, 3, 17, 12.5), "both": (4, 3, 17, 12.5)}
