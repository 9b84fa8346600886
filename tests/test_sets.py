"""Overlaps of sets against brute force: sets in many others, hot members, ties, NULLs, repeats."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from reachgrid.operators import feeds, lines, sets


def memberships(seed, n_sets=60, n_items=200):
    r = random.Random(seed)
    out = {f"s{i:03d}": set(r.sample(range(n_items), r.randint(1, 40))) | ({-1} if i % 3 else set()) for i in range(n_sets)}  # -1 is hot
    out["same"] = set(out["s001"])
    out["all"] = set(range(n_items))
    out["half"] = set(list(out["s002"])[::2])
    return out


def table(spark, found, kind="string"):
    rows = [(s, i) for s, items in found.items() for i in items]
    rows += rows[:20] + [(None, 3), ("s001", None), (None, None)]
    return spark.createDataFrame(rows, f"route_id {kind}, stop_id long")


def test_shared_members(spark):
    found = memberships(1)
    got = {(x.a, x.b): x.shared for x in sets.shared_members(table(spark, found).distinct(), "route_id", "stop_id").collect()}
    assert got == {(a, b): n for a, b in combinations(sorted(found), 2) if (n := len(found[a] & found[b]))}


def test_members_of_the_same_sets_are_one_pattern(spark):
    rows = [(f"f{k:04d}", i) for i in range(30) for k in range(1000)]  # 30 ids in each of 1000 feeds
    trips = spark.createDataFrame(rows, "feed string, trip_id long")
    patterns, _ = sets.set_patterns(trips, "feed", "trip_id")
    assert [(len(x.sets), x.n) for x in patterns.collect()] == [(1000, 30)]
    got = feeds.shared_trip_ids(trips).agg(F.count("*"), F.min("shared"), F.max("shared"), F.min("level"), F.count_if(F.col("feed_a") < F.col("feed_b"))).first()
    assert tuple(got) == (499500, 30, 30, "ERROR", 499500)


def test_shared_trip_ids_of_alike_and_empty_feeds(spark):
    trips = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("b", 3), ("c", 4), (None, 1), ("a", None), ("b", None)], "feed string, trip_id long")
    got = [tuple(x) for x in feeds.shared_trip_ids(trips).collect()]
    assert got == [("a", "b", 1, 0.5, "ERROR")]  # a row without id counts in the feed's size, but is shared with nobody
    assert feeds.shared_trip_ids(trips.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.6, 1.0, 0.05, 1 / 3])
@pytest.mark.parametrize("least,heavy", [(10_000, 1000), (3, 20)])
def test_mostly_contained(spark, share, least, heavy):
    found = memberships(2)
    picks = spark.createDataFrame([("s001",), ("s002",), ("half",), ("all",), ("s001",), ("nowhere",), (None,)], "route_id string")
    got = sets.mostly_contained(picks, table(spark, found), "route_id", "stop_id", share, least=least, heavy_share=heavy)
    want = {(p, s): len(found[p] & found[s]) / len(found[p]) for p in ("s001", "s002", "half", "all") for s in found
            if s != p and len(found[p] & found[s]) / len(found[p]) >= share}
    rows = got.collect()
    assert {(x.pick, x.route_id): x.share for x in rows} == want and len(rows) == len(want) and got.columns == ["pick", "route_id", "share"]


def test_corridor_of_every_line(spark):
    found = memberships(3, 40, 60)
    served = table(spark, found)
    got = {(x.pick, x.route_id): x.share for x in lines.corridor(served, served, 0.6).collect()}
    assert got == {(p, s): len(found[p] & found[s]) / len(found[p]) for p in found for s in found if s != p and len(found[p] & found[s]) / len(found[p]) >= 0.6}
    assert lines.corridor(served.limit(0), served).count() == 0 and lines.corridor(served, served.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lines.corridor(served, served, 0.0)


def test_a_heavy_member_is_dealt_out(spark):
    """A stop of every line: no key of the candidate join holds more than its bound."""
    served = spark.createDataFrame([(f"r{i}", 0) for i in range(900)] + [(f"r{i}", 1 + i % 300) for i in range(900)], "route_id string, stop_id long")
    got = sets.mostly_contained(served.select("route_id"), served, "route_id", "stop_id", 1.0, least=50, heavy_share=100)
    assert got.count() == 900 * 2  # lines of one further stop: three each, two others


def test_small_picks_in_blocks_and_large_ones_alone(spark, monkeypatch):
    """Several blocks, several tasks of a block, pairs counted in pieces, sparse and dense, large picks by the other way."""
    found = memberships(4, 80, 120)
    served = table(spark, found)
    want = {(p, s): len(found[p] & found[s]) / len(found[p]) for p in found for s in found if s != p and len(found[p] & found[s]) / len(found[p]) >= 0.4}
    for picks, held, large, counted in ((16, 100, 30, 50), (30, 200, 1000, 5000)):
        for name, value in (("PICKS", picks), ("HELD", held), ("LARGE", large), ("COUNTED", counted)):
            monkeypatch.setattr(sets, name, value)
        got = sets.mostly_contained(served, served, "route_id", "stop_id", 0.4, least=20, heavy_share=20).collect()
        assert {(x.pick, x.route_id): x.share for x in got} == want and len(got) == len(want)


def test_memberships_of_small_picks_are_not_ranked(spark, monkeypatch):
    """Running totals over all memberships were most of what the job wrote; a pick's rarest members are found in its task."""
    found, seen, totals = memberships(5), [], sets.running_totals
    monkeypatch.setattr(sets, "running_totals", lambda df, *a, **k: seen.append(df.count()) or totals(df, *a, **k))
    served = table(spark, found)
    got = {(x.pick, x.route_id): x.share for x in sets.mostly_contained(served, served, "route_id", "stop_id", 0.5, least=5, heavy_share=50).collect()}
    assert got == {(p, s): len(found[p] & found[s]) / len(found[p]) for p in found for s in found if s != p and len(found[p] & found[s]) / len(found[p]) >= 0.5}
    assert max(seen) <= len(found)


@pytest.mark.parametrize("rows,picks,held,counted", [(40, 1, 60, 10), (200, 7, 100, 100), (10_000, 256, 10_000, 10_000)])
def test_blocks_by_their_memberships(spark, monkeypatch, rows, picks, held, counted):
    """Blocks of few and many memberships, dealt over several tasks, with heavy members; integer names."""
    r = random.Random(11)
    found = {i: set(r.sample(range(30), r.randint(1, 12))) | ({99} if i % 4 else set()) | ({98} if i % 3 else set()) for i in range(90)}
    for name, value in (("ROWS", rows), ("PICKS", picks), ("HELD", held), ("COUNTED", counted)):
        monkeypatch.setattr(sets, name, value)
    served = spark.createDataFrame([(p, s) for p, items in found.items() for s in items], "route_id long, stop_id long")
    asked = spark.createDataFrame([(p,) for p in range(0, 120, 2)], "route_id long")
    for share in (0.3, 0.6, 1.0):
        got = sets.mostly_contained(asked, served, "route_id", "stop_id", share, least=15, heavy_share=30).collect()
        want = {(p, s): len(found[p] & found[s]) / len(found[p]) for p in found if p % 2 == 0 for s in found if s != p and len(found[p] & found[s]) / len(found[p]) >= share}
        assert {(x.pick, x.route_id): x.share for x in got} == want and len(got) == len(want)
