"""Registered queries against their SQL. ALL_QUERIES=1 runs every one, otherwise one or two per family."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
PLANS, SQL = entry.queries(), entry.oracle_sql()
SAMPLE = """a02_points_with_extras a15_catalogue_slim a21_ordered_arrays b09_keep_trips b10_dropped_sales c03_compare_travel_times
c06_orphan_references c12_nearest_k c14_points_in_polygons c17_match_segments d01_c01_c02_cumulative_access d04_competitive_access
d09_departure_percentiles d13_d14_d15_equity_summary e01_service_days e08_trip_shifts e14_h02_segments f02_f04_case_summary
f11_b16_modal_metrics f20_day_summary f29_spearman f33_ring_profile g06_repair_monotone g10_timetable_change g17_class_prices
g26_h04_tract_population g23_dasymetric_report h05_systematic_sample k03_scale_speed k05_isochrones k07_case_sweep
a01_archive_scan a08_g26_workbook_tracts c07_ids_in_many_feeds c09_e06_e08_stored_calls c11_crowded_cells k07_changed_inputs""".split()
OWN = {n for n in PLANS if not (n.startswith("op") or n == "pipeline")}  # the training-data queries have tests of their own
if set(SAMPLE) - OWN:
    raise ValueError(f"no such queries: {sorted(set(SAMPLE) - OWN)}")
NAMES = sorted(OWN) if os.environ.get("ALL_QUERIES") else sorted(SAMPLE)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    verdict, _, _ = compare(con, spark, name, PLANS[name], SQL.get(name), SF_DIR)
    assert verdict in ("ok", "rows only"), verdict


def test_every_sql_has_a_plan():
    assert set(SQL) <= set(PLANS)
    assert OWN <= set(SQL)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
