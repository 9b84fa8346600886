"""Service days and quality checks of timetable feeds.

Feed tables carry a ``feed`` column, so any number of feeds is checked in one plan.
Clock times are whole seconds and may pass 24 hours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachgrid.functions.scale import fraction, group_quantiles, linear, neighbour
from reachgrid.functions.values import (
    WEEKDAYS, feed_date, number, route_type_supported, traction, weekday_flag)
from reachgrid.operators.sets import shared_members

# Files every feed must hold.
REQUIRED_FILES = ("stops.txt", "routes.txt", "trips.txt", "stop_times.txt")
FINDING = ("feed", "level", "code", "n", "detail")


# --- calendar ---------------------------------------------------------------

def services(calendar: DataFrame) -> DataFrame:
    """(feed, service_id, flags, start, end); rows without usable dates are dropped, of repeated services the last file row wins."""
    flags = F.array(*[F.trim(F.col(d).cast("string")) == "1" for d in WEEKDAYS])
    rows = calendar.select("feed", F.trim("service_id").alias("service_id"), flags.alias("flags"),
                           feed_date(F.col("start_date")).alias("start"), feed_date(F.col("end_date")).alias("end"),
                           "row_no")
    rows = rows.where("service_id <> '' and start is not null and end is not null")
    last = rows.groupBy("feed", "service_id").agg(F.max_by(F.struct("flags", "start", "end"), "row_no").alias("r"))
    return last.select("feed", "service_id", "r.*")


def exceptions(calendar_dates: DataFrame) -> DataFrame:
    """(feed, service_id, date, added): one row per service and date, the last file row wins."""
    rows = calendar_dates.select(
        "feed", F.trim("service_id").alias("service_id"), feed_date(F.col("date")).alias("date"),
        F.trim(F.col("exception_type").cast("string")).try_cast("int").alias("kind"), "row_no")
    rows = rows.where("service_id <> '' and date is not null and kind is not null")
    last = rows.groupBy("feed", "service_id", "date").agg(F.max_by("kind", "row_no").alias("kind"))
    return last.select("feed", "service_id", "date", (F.col("kind") == 1).alias("added"))


def feed_spans(calendar: DataFrame, calendar_dates: DataFrame, cap_days: int | None = None) -> DataFrame:
    """(feed, first, last): each feed's own span; ``cap_days`` cuts it that many days from its own first day."""
    dates = (services(calendar).select("feed", F.explode(F.array("start", "end")).alias("date"))
             .unionByName(exceptions(calendar_dates).select("feed", "date")))
    spans = dates.groupBy("feed").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return spans if cap_days is None else spans.withColumn("last", F.least("last", F.date_add("first", cap_days - 1)))


def cut_days(calendar: DataFrame, calendar_dates: DataFrame, cap_days: int) -> DataFrame:
    """Findings SPAN_CUT: days of a feed's span that a cap of ``cap_days`` leaves out."""
    spans = feed_spans(calendar, calendar_dates).withColumn("n", F.date_diff("last", "first") + 1 - cap_days)
    return findings(spans.where("n > 0"), "WARN", "SPAN_CUT")


def active_service_days(calendar: DataFrame, calendar_dates: DataFrame, cap_days: int | None = None) -> DataFrame:
    """(feed, service_id, date) in service; an exception row overrides the calendar entirely."""
    spans = feed_spans(calendar, calendar_dates, cap_days)
    exc = exceptions(calendar_dates)
    regular = services(calendar).join(spans, "feed")
    low, high = F.greatest("start", "first"), F.least("end", "last")
    regular = (regular.where(low <= high)
               .select("feed", "service_id", "flags", F.explode(F.sequence(low, high)).alias("date"))
               .where(weekday_flag(F.col("date"), F.col("flags"))).drop("flags"))
    kept = regular.join(exc, ["feed", "service_id", "date"], "left_anti")
    added = exc.where("added").drop("added").join(spans, "feed").where(
        F.col("date").between(F.col("first"), F.col("last"))).select("feed", "service_id", "date")
    return kept.unionByName(added)


def service_days(calendar: DataFrame, calendar_dates: DataFrame, trips: DataFrame,
                 cap_days: int | None = None) -> DataFrame:
    """(date, trips): active trips per day summed over feeds; a day in any feed's span is present."""
    runs = (trips.where(F.coalesce(F.trim("service_id"), F.lit("")) != "")
            .groupBy("feed", F.trim("service_id").alias("service_id")).agg(F.count("*").alias("trips")))
    active = active_service_days(calendar, calendar_dates, cap_days).join(runs, ["feed", "service_id"])
    spans = feed_spans(calendar, calendar_dates, cap_days)
    empty = spans.select(F.explode(F.sequence("first", "last")).alias("date"), F.lit(0).cast("bigint").alias("trips"))
    return empty.unionByName(active.select("date", "trips")).groupBy("date").agg(F.sum("trips").alias("trips"))


def nearest_served_days(days: DataFrame, date: str, k: int = 3) -> DataFrame:
    """The k served days closest to ``date``, the earlier first on ties."""
    gap = F.abs(F.date_diff("date", F.lit(date).cast("date")))
    return days.where("trips > 0").withColumn("gap", gap).orderBy("gap", "date").limit(k)


def active_services(calendar: DataFrame, calendar_dates: DataFrame, date: str) -> DataFrame:
    """(feed, service_id) running on one date."""
    day = F.lit(date).cast("date")
    regular = services(calendar).where(day.between(F.col("start"), F.col("end")) & weekday_flag(day, F.col("flags")))
    today = exceptions(calendar_dates).where(F.col("date") == day)
    kept = regular.select("feed", "service_id").join(today, ["feed", "service_id"], "left_anti")
    return kept.unionByName(today.where("added").select("feed", "service_id"))


def active_trips(trips: DataFrame, calendar: DataFrame, calendar_dates: DataFrame, date: str) -> DataFrame:
    return trips.join(active_services(calendar, calendar_dates, date), ["feed", "service_id"], "left_semi")


def date_coverage(calendar: DataFrame, calendar_dates: DataFrame, date: str) -> DataFrame:
    """(feed, first, last, coverage): whether the feed's dates reach ``date`` at all."""
    dates = (calendar.select("feed", F.explode(F.array("start_date", "end_date")).alias("d"))
             .unionByName(calendar_dates.select("feed", F.col("date").alias("d")))
             .where("d is not null and d <> ''"))
    day = date.replace("-", "")
    return dates.groupBy("feed").agg(F.min("d").alias("first"), F.max("d").alias("last")).select(
        "feed", "first", "last",
        F.when(F.col("first") > day, "published after").when(F.col("last") < day, "expired")
        .otherwise("covers").alias("coverage"))


# --- checks -------------------------------------------------------------------

def findings(df: DataFrame, level: str, code: str, detail: Column | None = None) -> DataFrame:
    return df.select(F.col("feed"), F.lit(level).alias("level"), F.lit(code).alias("code"),
                     F.col("n").cast("bigint").alias("n"),
                     (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def _count(df: DataFrame, level: str, code: str) -> DataFrame:
    return findings(df.groupBy("feed").agg(F.count("*").alias("n")), level, code)


def file_findings(feeds: DataFrame, files: DataFrame) -> DataFrame:
    """Missing required files, no calendar at all, no shapes, frequencies present."""
    have = feeds.select("feed").join(files.groupBy("feed").agg(
        *[F.max((F.col("file") == f).cast("int")).alias(f.removesuffix(".txt"))
          for f in (*REQUIRED_FILES, "calendar.txt", "calendar_dates.txt", "shapes.txt", "frequencies.txt")]), "feed", "left")
    have = have.fillna(0)
    checks = [("ERROR", "MISSING_FILE", F.col(f.removesuffix(".txt")) == 0, f) for f in REQUIRED_FILES]
    checks += [("ERROR", "NO_CALENDAR", (F.col("calendar") == 0) & (F.col("calendar_dates") == 0), None),
               ("INFO", "NO_SHAPES", F.col("shapes") == 0, None),
               ("INFO", "FREQUENCIES", F.col("frequencies") == 1, None)]
    rows = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), hit.alias("hit"),
                              F.lit(detail).cast("string").alias("detail")) for level, code, hit, detail in checks])
    return have.select("feed", F.inline(rows)).where("hit").select(
        "feed", "level", "code", F.lit(1).cast("bigint").alias("n"), "detail")


def stop_position(stops: DataFrame) -> DataFrame:
    """Adds lon, lat (numbers) and ``position``: ok, bad, or exempt (nodes and platforms without coordinates)."""
    lat, lon = number(F.col("stop_lat")), number(F.col("stop_lon"))
    needs = F.coalesce(F.trim("location_type"), F.lit("")).isin("", "0", "1", "2")
    state = (F.when(lat.isNull() | lon.isNull(), F.when(needs, "bad").otherwise("exempt"))
             .when(~lat.between(-90, 90) | ~lon.between(-180, 180) | ((lat == 0) & (lon == 0)), "bad")
             .otherwise("ok"))
    return stops.withColumn("lat", lat).withColumn("lon", lon).withColumn("position", state)


def stop_boxes(stops: DataFrame) -> DataFrame:
    """(feed, stops, xmin, ymin, xmax, ymax) over the usable coordinates."""
    ok = stop_position(stops)
    use = lambda c: F.when(F.col("position") == "ok", F.col(c))
    return ok.groupBy("feed").agg(
        F.count_distinct(F.when(F.trim("stop_id") != "", F.trim("stop_id"))).alias("stops"),
        F.min(use("lon")).alias("xmin"), F.min(use("lat")).alias("ymin"),
        F.max(use("lon")).alias("xmax"), F.max(use("lat")).alias("ymax"))


def inside_box(points: DataFrame, box: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Points inside and outside a lon/lat box."""
    xmin, ymin, xmax, ymax = box
    hit = F.col("lon").between(xmin, xmax) & F.col("lat").between(ymin, ymax)
    return points.groupBy(*keys).agg(F.count_if(hit).alias("inside"), F.count_if(~hit).alias("outside"))


def route_type_findings(routes: DataFrame) -> DataFrame:
    """Routes per unsupported or unreadable route type."""
    kind = F.trim("route_type").try_cast("int")
    bad = routes.where(~route_type_supported(kind)).groupBy("feed", kind.alias("kind")).agg(F.count("*").alias("n"))
    return findings(bad, "ERROR", "UNSUPPORTED_ROUTE_TYPE", F.coalesce(F.col("kind").cast("string"), F.lit("None")))


def route_trips(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """Routes with their number of trips."""
    n = trips.groupBy("feed", "route_id").agg(F.count("*").alias("trips"))
    return routes.join(n, ["feed", "route_id"], "left").fillna(0, subset=["trips"])


def orphan_findings(routes: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame,
                    calendar: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """References to rows that do not exist, and trips without stop times."""
    known_services = (services(calendar).select("feed", "service_id")
                      .unionByName(exceptions(calendar_dates).select("feed", "service_id")).distinct())
    # Stop times collapse to distinct references first: the joins then see ids, not every row.
    by_trip = stop_times.groupBy("feed", "trip_id").agg(F.count("*").alias("rows"))
    by_stop = stop_times.groupBy("feed", "stop_id").agg(F.count("*").alias("rows"))

    def total(df: DataFrame) -> DataFrame:
        return df.groupBy("feed").agg(F.sum("rows").alias("n"))
    trip_ids, stop_ids = trips.select("feed", "trip_id"), stops.select("feed", "stop_id")
    parts = [
        _count(trips.join(routes, ["feed", "route_id"], "left_anti"), "WARN", "ORPHAN_TRIP_ROUTE"),
        _count(trips.join(known_services, ["feed", "service_id"], "left_anti"), "WARN", "ORPHAN_TRIP_SERVICE"),
        findings(total(by_trip.join(trip_ids, ["feed", "trip_id"], "left_anti")), "WARN", "ORPHAN_STOP_TIME_TRIP"),
        findings(total(by_stop.join(stop_ids, ["feed", "stop_id"], "left_anti")), "WARN", "ORPHAN_STOP_TIME_STOP"),
        _count(trip_ids.distinct().join(by_trip, ["feed", "trip_id"], "left_anti"), "WARN", "TRIPS_WITHOUT_STOP_TIMES")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shared_trip_ids(trips: DataFrame) -> DataFrame:
    """(feed_a, feed_b, shared, ratio, level): trip ids two feeds have in common, against the smaller one."""
    ids = trips.select("feed", "trip_id").distinct()
    sizes = ids.groupBy("feed").agg(F.count("*").alias("n"))
    shared = shared_members(ids, "feed", "trip_id", first="feed_a", second="feed_b")
    out = (shared.join(sizes.select(F.col("feed").alias("feed_a"), F.col("n").alias("n_a")), "feed_a")
           .join(sizes.select(F.col("feed").alias("feed_b"), F.col("n").alias("n_b")), "feed_b"))
    ratio = F.col("shared") / F.least("n_a", "n_b")
    return out.select("feed_a", "feed_b", "shared", ratio.alias("ratio"),
                      F.when(ratio >= 0.5, "ERROR").otherwise("WARN").alias("level"))


def duplicate_feed_ids(feeds: DataFrame) -> DataFrame:
    """(id, n, first): feed ids (file name when there is none) used more than once."""
    given = F.when(F.trim("feed_id") != "", F.trim("feed_id"))
    return feeds.groupBy(F.coalesce(given, F.col("feed")).alias("id")).agg(
        F.count("*").alias("n"), F.min("feed").alias("first")).where("n > 1")


def timezone_findings(agencies: DataFrame) -> DataFrame:
    """A feed without a timezone, and (feed NULL) feeds that disagree."""
    zone = F.when(F.trim("agency_timezone") != "", F.trim("agency_timezone"))
    missing = agencies.groupBy("feed").agg(F.count(zone).alias("k"), F.lit(1).alias("n")).where("k = 0")
    zones = agencies.select(zone.alias("zone")).where("zone is not null").distinct()
    mixed = zones.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("zone")), ", ").alias("zones"))
    mixed = mixed.where("n > 1").withColumn("feed", F.lit(None).cast("string"))
    return findings(missing, "WARN", "NO_TIMEZONE").unionByName(
        findings(mixed, "WARN", "MIXED_TIMEZONES", F.col("zones")))


def service_findings(days: DataFrame, date: str | None = None) -> DataFrame:
    """Span, trips per day (min, median, max), days without service, and the requested date."""
    middle = group_quantiles(days.withColumn("all", F.lit(0)), ["all"], "trips", {"median": linear(0.5)}, count="days")
    span = days.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.min("trips").alias("low"),
                    F.max("trips").alias("high"), F.count_if(F.col("trips") == 0).alias("dead"), F.count("*").alias("k"))
    one = span.withColumn("median", middle.select("median").scalar()).withColumn("feed", F.lit(None).cast("string"))
    served = F.coalesce(F.col("high"), F.lit(0)) > 0
    text = F.concat_ws(" ", F.col("first").cast("string"), F.col("last").cast("string"), F.col("low").cast("string"),
                       F.round("median", 1).cast("string"), F.col("high").cast("string"))
    def row(level: str, code: str, hit: Column, n: Column, detail: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), hit.alias("hit"),
                        n.cast("bigint").alias("n"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    rows = [row("ERROR", "NO_SERVICE", ~served, F.lit(1), none), row("INFO", "CALENDAR_SPAN", served, F.col("k"), text),
            row("WARN", "DAYS_WITHOUT_SERVICE", served & (F.col("dead") > 0), F.col("dead"), none)]
    if date is not None:
        trips = days.where(F.col("date") == F.lit(date).cast("date")).select("trips").scalar()
        near = nearest_served_days(days, date, 3).agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("gap", "date"))), lambda v: v["date"].cast("string")), ", ").alias("d"))
        one = one.withColumn("on_date", F.coalesce(trips, F.lit(0))).withColumn("near", near.select("d").scalar())
        rows += [row("INFO", "DATE_OK", F.col("on_date") > 0, F.col("on_date"), F.lit(date)),
                 row("ERROR", "DATE_NO_SERVICE", F.col("on_date") == 0, F.col("on_date"), F.col("near"))]
    return one.select("feed", F.inline(F.array(*rows))).where("hit").select("feed", "level", "code", "n", "detail")


# --- static against realized ---------------------------------------------------

def decreasing_trips(stop_times: DataFrame, keys: Sequence[str] = ("feed",)) -> DataFrame:
    """Per feed: trips whose arrivals go back in time, and all trips, with or without arrivals."""
    timed = stop_times.where("arr is not null")
    prev = neighbour(timed, [*keys, "trip_id"], "seq", {"before": "arr"}, step=-1)
    marked = prev.select(*keys, "trip_id", (F.col("arr") < F.col("before")).cast("int").alias("bad")).unionByName(
        stop_times.where("arr is null").select(*keys, "trip_id", F.lit(0).alias("bad")))
    per_trip = marked.groupBy(*keys, "trip_id").agg(F.max("bad").alias("bad"))
    return per_trip.groupBy(*keys).agg(F.count_if(F.col("bad") == 1).alias("bad"), F.count("*").alias("trips"))


def shifts(static: DataFrame, realized: DataFrame, keys: Sequence[str] = ("feed",)) -> DataFrame:
    """Realized minus static seconds per common (trip, sequence)."""
    a = static.select(*keys, "trip_id", "seq", "arr")
    b = realized.select(*keys, "trip_id", "seq", F.col("arr").alias("real"))
    return a.join(b, [*keys, "trip_id", "seq"]).select(*keys, "trip_id", "seq", "arr", (F.col("real") - F.col("arr")).alias("shift"))


def shift_distribution(pairs: DataFrame, keys: Sequence[str] = ("feed",)) -> DataFrame:
    """Median, mean, 5 % quantile, share over 5 minutes early, and whether the feed looks wrong."""
    marks = group_quantiles(pairs, keys, "shift", {"median": linear(0.5), "p05": fraction(1, 20)}, small_domain=True)
    means = pairs.groupBy(*keys).agg(F.avg("shift").alias("mean"),
                                     F.avg((F.col("shift") < -300).cast("double")).alias("early_share"))
    bad = (F.col("median") < -120) | (F.col("early_share") > 0.02) | (F.col("p05") < -300)
    return marks.join(means, list(keys)).withColumn("fails", bad)


def trip_id_differences(static: DataFrame, realized: DataFrame) -> DataFrame:
    """Per feed: trips only in the static and only in the realized feed."""
    a, b = static.select("feed", "trip_id").distinct(), realized.select("feed", "trip_id").distinct()
    both = a.withColumn("s", F.lit(1)).join(b.withColumn("r", F.lit(1)), ["feed", "trip_id"], "full")
    return both.groupBy("feed").agg(F.count_if(F.col("r").isNull()).alias("only_static"),
                                    F.count_if(F.col("s").isNull()).alias("only_realized"))


def pair_findings(static: DataFrame, realized: DataFrame, trips_on_date: DataFrame | None = None, min_trips: int = 1) -> DataFrame:
    """Findings on a static and a realized feed that should belong together.

    NO_OVERLAP: no common (trip, sequence), also where one side lacks the feed. STOPS_DIFFER: stop ids on one
    side only. FEW_TRIPS: fewer than ``min_trips`` trips in ``trips_on_date`` (feed, trips).
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("feed", "trip_id", "seq", "stop_id", F.lit(1).alias("a" if name == "a" else "b"))
    both = side(static, "a").unionByName(side(realized, "b"), allowMissingColumns=True)
    calls = both.groupBy("feed", "trip_id", "seq").agg(F.max("a").alias("a"), F.max("b").alias("b")).groupBy("feed").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))
    stops = both.groupBy("feed", "stop_id").agg(F.max("a").alias("a"), F.max("b").alias("b")).groupBy("feed").agg(
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n"))
    out = findings(calls.where("common = 0").select("feed", F.lit(1).alias("n")), "ERROR", "NO_OVERLAP").unionByName(
        findings(stops.where("n > 0"), "WARN", "STOPS_DIFFER"))
    if trips_on_date is not None:
        feeds = calls.select("feed").join(trips_on_date, "feed", "left").select("feed", F.coalesce("trips", F.lit(0)).alias("n"))
        out = out.unionByName(findings(feeds.where(F.col("n") < min_trips), "WARN", "FEW_TRIPS"))
    return out


def trip_shifts(pairs: DataFrame, trips: DataFrame, routes: DataFrame, *, threshold: int = 30,
                peak: tuple[int, int] = (25200, 32400)) -> DataFrame:
    """Late, early and unchanged trips per window and traction, from trips with two or more common stops.

    Trips and routes belong to a feed; equal ids in two feeds are different trips. The peak window is
    closed on both sides and looks at the first common stop.
    """
    per_trip = pairs.groupBy("feed", "trip_id").agg(
        F.count("*").alias("stops"), F.avg("shift").alias("mean"), F.min_by("arr", "seq").alias("first")).where("stops >= 2")
    kinds = trips.select("feed", "trip_id", "route_id").join(
        routes.select("feed", "route_id", traction(F.col("route_type")).alias("traction")), ["feed", "route_id"], "left")
    placed = per_trip.join(kinds.select("feed", "trip_id", F.coalesce("traction", F.lit("other")).alias("traction")), ["feed", "trip_id"])
    windows = F.filter(F.array(F.lit("day"), F.when(F.col("first").between(*peak), "peak")), lambda w: w.isNotNull())
    placed = placed.select("traction", "mean", F.explode(windows).alias("window"))
    times = lambda hit: F.sum(F.when(hit, F.col("_k")).otherwise(0))
    out = group_quantiles(placed, ["window", "traction"], "mean", {"median_shift": linear(0.5)}, count="trips", more=[
        times(F.col("mean") > threshold).alias("late"), times(F.col("mean") < -threshold).alias("early"),
        times(F.abs("mean") <= threshold).alias("unchanged"), (F.sum(F.col("mean") * F.col("_k")) / F.sum("_k")).alias("mean_shift")])
    return out.select("window", "traction", "trips", "late", "early", "unchanged",
                      *[F.round(100 * F.col(c) / F.col("trips"), 1).alias(f"{c}_pct") for c in ("late", "early", "unchanged")],
                      F.round("median_shift").alias("median_shift_s"), F.round("mean_shift").alias("mean_shift_s"))


# --- cascades -------------------------------------------------------------------

def keep_trips(wanted: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A feed cut down to the wanted trips: stop times, routes, stops, calendar and agencies follow."""
    trips = tables["trips"].join(wanted.select("feed", "trip_id"), ["feed", "trip_id"], "left_semi")
    stop_times = tables["stop_times"].join(trips, ["feed", "trip_id"], "left_semi")
    routes = tables["routes"].join(trips, ["feed", "route_id"], "left_semi")
    out = {"trips": trips, "stop_times": stop_times, "routes": routes,
           "stops": tables["stops"].join(stop_times, ["feed", "stop_id"], "left_semi")}
    for name in ("calendar", "calendar_dates"):
        if name in tables:
            out[name] = tables[name].join(trips, ["feed", "service_id"], "left_semi")
    if "agency" in tables:
        out["agency"] = tables["agency"].join(routes, ["feed", "agency_id"], "left_semi")
    return out


def resolve_routes(references: DataFrame, routes: DataFrame) -> DataFrame:
    """(ref, tier, full_id, hits): full id first, else route id, else short name; NULL when nothing matches."""
    full = F.concat_ws(":", "feed", F.col("route_id").cast("string"))
    names = F.array(*[F.struct(F.lit(t).alias("tier"), k.alias("ref")) for t, k in enumerate(
        (full, F.col("route_id").cast("string"), F.col("route_short_name")))])
    keyed = routes.select(full.alias("full_id"), F.inline(names))
    refs = references.select(F.trim("ref").alias("ref")).distinct()
    hits = refs.join(keyed, "ref", "left")
    best = hits.groupBy("ref").agg(F.min("tier").alias("best"))
    kept = hits.join(best, "ref").where(F.col("tier").isNull() | (F.col("tier") == F.col("best")))
    counts = kept.groupBy("ref").agg(F.count("full_id").alias("hits"))
    return kept.select("ref", "tier", "full_id").distinct().join(counts, "ref")


def municipality_inventory(areas: DataFrame, stop_areas: DataFrame, feeds: DataFrame) -> DataFrame:
    """Feeds, stops and coverage class per municipality.

    stop_areas: (area, feed) per stop. feeds: (feed, covers, has_rt, trips).
    """
    per_feed = stop_areas.groupBy("area", "feed").agg(F.count("*").alias("stops")).join(feeds, "feed", "left")
    ok = F.coalesce("covers", F.lit(False))
    names = lambda hit: F.array_join(F.sort_array(F.collect_set(F.when(hit, F.col("feed")))), ",")
    found = per_feed.groupBy("area").agg(
        names(ok).alias("feeds"), names(~ok).alias("feeds_uncovered"), F.count_if(ok).alias("n_feeds"),
        F.sum("stops").alias("n_stops"), F.max(F.when(ok, F.col("trips"))).alias("n_trips_max"),
        F.max((ok & F.col("has_rt")).cast("int")).alias("has_rt"))
    out = areas.select("area").join(found, "area", "left").fillna(0).fillna("")
    kind = (F.when((F.col("n_feeds") > 0) & (F.col("has_rt") == 1), "static + realtime")
            .when(F.col("n_feeds") > 0, "static").when(F.col("feeds_uncovered") != "", "static, date not covered")
            .when(F.col("n_stops") > 0, "served, no feed").otherwise("no data"))
    return out.withColumn("class", kind)
