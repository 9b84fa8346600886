"""Calls stored by trip: no shuffle of single calls behind any reader, results of brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reachgrid.operators import calls

PLACES = {i: (19.0 + i * 0.003, 51.7 + (i * 7 % 11) * 0.002) for i in range(30)}


def metres(a, b):
    from math import asin, cos, radians, sin, sqrt
    (x1, y1), (x2, y2) = a, b
    h = sin(radians(y2 - y1) / 2) ** 2 + cos(radians(y1)) * cos(radians(y2)) * sin(radians(x2 - x1) / 2) ** 2
    return 2 * 6371008.8 * asin(sqrt(h))


@pytest.fixture(scope="module")
def rows():
    r, out = random.Random(4), []
    for trip in range(60):
        t = r.randrange(24000, 33000)
        for seq in range(r.randint(1, 9)):
            t += r.choice([-40, 0, 60, 120, 300])
            out.append(("f" + str(trip % 3), trip // 2, seq * 2, r.choice([*PLACES, 77, 78]), None if r.random() < 0.1 else t, None if r.random() < 0.1 else t + 20))
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def stored(spark, rows):
    stops = spark.createDataFrame([(i, *p) for i, p in PLACES.items()] + [(0, 99.0, 99.0)], "stop_id long, lon double, lat double")
    times = spark.createDataFrame(rows, "feed string, trip_id long, seq long, stop_id long, arr long, dep long")
    return calls.store(times, ["feed", "trip_id"], stops=stops, buckets=5)


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|Single)", df._jdf.queryExecution().executedPlan().toString()))


def by_trip(rows):
    trips = {}
    for feed, trip, seq, stop, arr, dep in rows:
        trips.setdefault((feed, trip), []).append((seq, stop, arr, dep))
    return {k: sorted(v) for k, v in trips.items()}


KEYS = ["feed", "trip_id"]


def test_all_readers_share_the_one_shuffle(spark, stored):
    assert [shuffles(x) for x in (calls.trip_facts(stored, KEYS), calls.segments(stored, KEYS, peak=(25200, 32400)), calls.decreasing(stored, KEYS))] == [0, 0, 0]
    pair = calls.store_pair(stored, stored, KEYS, buckets=5)
    assert shuffles(calls.trip_shifts(calls.shifts(pair, KEYS), KEYS)) == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("calls_")]


def test_stored_rows_are_the_given_ones(stored, rows):
    got = sorted(map(repr, (tuple(x) for x in stored.select("feed", "trip_id", "seq", "stop_id", "arr", "dep").collect())))
    assert got == sorted(map(repr, rows))
    assert {x.stop_id: (x.lon, x.lat) for x in stored.collect()} == {s: PLACES.get(s, (None, None)) for s in {r[3] for r in rows}}


def test_trip_facts(stored, rows):
    got = {(x.feed, x.trip_id): x for x in calls.trip_facts(stored, KEYS).collect()}
    want = by_trip(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        known = [PLACES[s] for _, s, _, _ in v if s in PLACES]
        length = sum(map(metres, known, known[1:])) if len(known) > 1 else None
        assert got[k].calls == len(v) and got[k].metres == (pytest.approx(length) if length is not None else None)
        assert got[k].first == (v[0][3] if v[0][3] is not None else v[0][2])


def test_line_metrics(spark, stored, rows):
    trips = spark.createDataFrame([(f"f{i % 3}", i // 2, i % 7) for i in range(62)] + [("f9", 1, 50)], "feed string, trip_id long, route_id long")
    got = {x.route_id: x for x in calls.line_metrics(calls.trip_facts(stored, KEYS), trips, (25200, 32400), KEYS).collect()}
    facts = {(x.feed, x.trip_id): x for x in calls.trip_facts(stored, KEYS).collect()}
    assert set(got) == {*range(7), 50} and got[50].length_km is None and got[50].vehicle_km == 0 and got[50].per_hour == 0
    for route in range(7):
        mine = [facts[k] for i in range(62) if i % 7 == route and (k := (f"f{i % 3}", i // 2)) in facts]
        longest = min(mine, key=lambda x: (-x.calls, x.feed, x.trip_id))
        assert got[route].length_km == pytest.approx((longest.metres or 0) / 1000)
        assert got[route].vehicle_km == pytest.approx(sum(x.metres or 0 for x in mine) / 1000)
        assert got[route].per_hour == sum(x.first is not None and 25200 <= x.first < 32400 for x in mine) / 2


@pytest.mark.parametrize("peak", [None, (25200, 30000)])
def test_segments(stored, rows, peak):
    want = {}
    for k, v in by_trip(rows).items():
        first = v[0][3] if v[0][3] is not None else v[0][2]
        if peak and (first is None or not peak[0] <= first < peak[1]):
            continue
        for (seq, s, _, dep), (_, s2, arr2, _) in zip(v, v[1:], strict=False):
            if s in PLACES and s2 in PLACES and None not in (dep, arr2) and arr2 > dep and (m := metres(PLACES[s], PLACES[s2])) >= 50:
                want[(*k, seq)] = (pytest.approx(m), arr2 - dep)
    got = {(x.feed, x.trip_id, x.seq): (x.metres, x.seconds) for x in calls.segments(stored, KEYS, peak=peak).collect()}
    assert got == want and len(want) > 20


def test_decreasing_and_shifts(spark, stored, rows):
    real = [(f, t, s, None if a is None else a + (t * 7 + s) % 50 - 10) for f, t, s, _, a, _ in rows if (t + s) % 5] + [(rows[0][0], rows[0][1], rows[0][2], 5), ("zz", 1, 0, 3)]
    bad = {(x.feed, x.trip_id): x.bad for x in calls.decreasing(stored, KEYS).collect()}
    for k, v in by_trip(rows).items():
        times = [a for _, _, a, _ in v if a is not None]
        assert bad[k] == any(y < x for x, y in zip(times, times[1:], strict=False))
    realized = spark.createDataFrame(real, "feed string, trip_id long, seq long, arr long")
    pair = calls.store_pair(stored, realized, KEYS, buckets=3)
    got = sorted(map(repr, (tuple(x) for x in calls.shifts(pair, KEYS).collect())))
    want = [(f, t, s, a, None if None in (a, b) else b - a) for f, t, s, _, a, _ in rows for f2, t2, s2, b in real if (f, t, s) == (f2, t2, s2)]
    assert got == sorted(map(repr, want))
    per = calls.trip_shifts(calls.shifts(pair, KEYS), KEYS, least=1).agg(F.sum("stops")).first()[0]
    assert per == len(want)


def test_no_calls(spark, stored):
    none = calls.store(stored.limit(0), KEYS)
    assert calls.trip_facts(none, KEYS).count() == 0 and calls.segments(none, KEYS).count() == 0
