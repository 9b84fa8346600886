"""Domain tables derived from the driver tables, once as DataFrames and once as SQL.

All arithmetic is on non-negative integers, so Spark and SQL agree exactly. Customers play
origins (residents), suppliers destinations, orders trips, line items stop times and sales.
"""

from __future__ import annotations

import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachgrid.operators.access import accessibility

CATEGORIES = ("school", "pharmacy", "university", "mall")
SERVICES = tuple(f"srv_{c}" for c in CATEGORIES)
CASES = ("base", "loo_A", "loo_N", "loo_R")
DAYS = (0, 1, 2)
FLAGS = ("A", "N", "R")
CUTOFFS = (30, 60)
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

#: Rows of the large tables whose groups one task holds.
TASK_ROWS = 250_000

MINUTES = "(l_orderkey * 7919 + l_suppkey * 104729 + l_partkey * 31) % 120"


def _calendar_rows() -> list[tuple]:
    """(feed, service, mon..sun, start, end) with different masks, spans and one far-off end date."""
    rows = []
    for f in range(3):
        for i, service in enumerate(PRIORITIES):
            if f == 2 and i == 4:
                continue  # this service exists through exceptions only
            mask = [1 if (d + i + f) % (2 + i) != 0 else 0 for d in range(7)]
            start = datetime.date(2026, 1, 1 + 3 * f + i)
            end = datetime.date(2099, 12, 31) if (f, i) == (1, 2) else start + datetime.timedelta(40 + 20 * f)
            rows.append((len(rows), f"f{f}", service, *mask, start.strftime("%Y%m%d"), end.strftime("%Y%m%d")))
            if (f, i) == (0, 1):  # a repeated service with other days; the later row is the one above in reverse order
                rows.append((-1, f"f{f}", service, *[1 - m for m in mask], "20251201", "20270401"))
    return rows


# (row_no, feed, service, date, exception type); repeated keys: the last row wins.
_EXCEPTIONS = [
    (1, "f0", "1-URGENT", "20260106", 2), (2, "f0", "1-URGENT", "20260106", 1),
    (3, "f0", "2-HIGH", "20260105", 2), (4, "f0", "5-LOW", "20260301", 1),
    (5, "f1", "3-MEDIUM", "20260110", 3), (6, "f1", "1-URGENT", "20260111", 1),
    (7, "f2", "5-LOW", "20260120", 1), (8, "f2", "5-LOW", "20260121", 1),
    (9, "f2", "5-LOW", "20260121", 2), (10, "f2", "2-HIGH", "20260125", 1),
]
CALENDAR_COLUMNS = ("row_no", "feed", "service_id", "monday", "tuesday", "wednesday", "thursday", "friday",
                    "saturday", "sunday", "start_date", "end_date")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


def values_sql(rows: list[tuple], columns: tuple[str, ...]) -> str:
    return f"SELECT * FROM (VALUES {_values(rows)}) AS t({', '.join(columns)})"


_COORDS = """({k} * 7919 % 1000) * 30 AS x, ({k} * 104729 % 1000) * 30 AS y,
       (19320000 + ({k} * 7919 % 1000) * 300) / 1e6 AS lon, (51680000 + ({k} * 104729 % 1000) * 200) / 1e6 AS lat"""


def _case_min(flag: str | None) -> str:
    return f"min(CASE WHEN l_returnflag <> '{flag}' THEN m END)" if flag else "min(m)"


SQL_VIEWS: dict[str, str] = {
    "lo": f"SELECT l.*, o_custkey, o_orderpriority, {MINUTES} AS m FROM lineitem l JOIN orders ON l_orderkey = o_orderkey",
    "v_case_times": "SELECT o_custkey AS from_id, l_suppkey AS to_id, " + ", ".join(
        f"CASE WHEN {_case_min(None if c == 'base' else c[-1])} <= 90 THEN {_case_min(None if c == 'base' else c[-1])} END AS {c}"
        for c in CASES) + " FROM lo GROUP BY ALL",
    "v_matrix": "SELECT from_id, to_id, base AS tt FROM v_case_times",
    "v_matrix_b": "SELECT from_id, to_id, loo_A AS tt FROM v_case_times",
    "v_matrix_85": "SELECT from_id, to_id, least(tt + (from_id * 13 + to_id * 7) % 15, 119) AS tt FROM v_matrix WHERE tt IS NOT NULL UNION ALL SELECT from_id, to_id, NULL FROM v_matrix WHERE tt IS NULL",
    "v_matrix_long": "SELECT from_id, to_id, 50 AS percentile, tt FROM v_matrix UNION ALL SELECT from_id, to_id, 85, tt FROM v_matrix_85",
    "v_departures": "SELECT o_custkey % 50 AS from_id, l_suppkey % 20 AS to_id, CASE WHEN m <= 110 THEN m END AS tt FROM lo",
    "v_origins": "SELECT c_custkey AS id, floor(c_acctbal)::BIGINT AS pop, n_name AS district, r_name AS region, c_mktsegment AS segment, "
                 + _COORDS.format(k="c_custkey")
                 + " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "v_dests": "SELECT s_suppkey AS id, 1 + s_suppkey % 7 AS capacity, CASE s_suppkey % 4 WHEN 0 THEN 'school' WHEN 1 THEN 'pharmacy' WHEN 2 THEN 'university' ELSE 'mall' END AS category, "
               + _COORDS.format(k="(s_suppkey + 17)") + " FROM supplier",
    "v_opps": "SELECT id AS to_id, 'srv_' || category AS opportunity, 1 AS value FROM v_dests UNION ALL SELECT id, 'capacity', capacity FROM v_dests",
    "v_case_long": " UNION ALL ".join(f"SELECT '{c}' AS case_id, from_id, to_id, {c} AS tt FROM v_case_times" for c in CASES),
    "v_acc": """
        SELECT k.case_id, o.id, s.opportunity, c.cutoff, coalesce(a.n, 0)::BIGINT AS acc
        FROM v_origins o CROSS JOIN (VALUES ('base'), ('loo_A'), ('loo_N'), ('loo_R')) k(case_id)
        CROSS JOIN (VALUES ('srv_school'), ('srv_pharmacy'), ('srv_university'), ('srv_mall')) s(opportunity)
        CROSS JOIN (VALUES (30), (60)) c(cutoff)
        LEFT JOIN (SELECT case_id, from_id, opportunity, cutoff, count(*) AS n
                   FROM v_case_long JOIN v_opps USING (to_id) CROSS JOIN (VALUES (30), (60)) c(cutoff)
                   WHERE tt < cutoff AND opportunity <> 'capacity' GROUP BY ALL) a
          ON a.case_id = k.case_id AND a.from_id = o.id AND a.opportunity = s.opportunity AND a.cutoff = c.cutoff""",
    "v_day_times": "SELECT o_custkey AS from_id, l_suppkey AS to_id, " + ", ".join(
        f"CASE WHEN min(CASE WHEN l_linenumber % 3 <> {d} THEN m END) <= 90 THEN min(CASE WHEN l_linenumber % 3 <> {d} THEN m END) END AS d{d}"
        for d in DAYS) + " FROM lo GROUP BY ALL",
    "v_day_long": " UNION ALL ".join(f"SELECT {d} AS day, from_id, to_id, d{d} AS tt FROM v_day_times" for d in DAYS),
    "v_day_acc": """
        SELECT k.day, o.id, s.opportunity, coalesce(a.n, 0)::BIGINT AS acc
        FROM v_origins o CROSS JOIN (VALUES (0), (1), (2)) k(day)
        CROSS JOIN (VALUES ('srv_school'), ('srv_pharmacy'), ('srv_university'), ('srv_mall')) s(opportunity)
        LEFT JOIN (SELECT day, from_id, opportunity, count(*) AS n FROM v_day_long JOIN v_opps USING (to_id)
                   WHERE tt < 30 AND opportunity <> 'capacity' GROUP BY ALL) a
          ON a.day = k.day AND a.from_id = o.id AND a.opportunity = s.opportunity""",
    "v_people": "SELECT id, greatest(pop, 0)::BIGINT AS pop, district, region, segment, x, y, lon, lat FROM v_origins",
    "v_trips": "SELECT 'f' || (o_orderkey % 3) AS feed, o_orderkey AS trip_id, o_custkey % 40 AS route_id, o_orderpriority AS service_id, (o_orderkey // 3) % 2 AS direction_id FROM orders",
    "v_stop_times": """
        SELECT trip_id, seq, stop_id, 18000 + (trip_id % 960) * 60 + seq * 120 + l_partkey % 60 AS arr,
               (l_partkey * 17 + stop_id * 31) % 241 - 60 AS shift
        FROM (SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, l_partkey, row_number() OVER (
                PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq
              FROM lineitem)""",
    "v_calendar": values_sql(_calendar_rows(), CALENDAR_COLUMNS),
    "v_exceptions": values_sql(_EXCEPTIONS, ("row_no", "feed", "service_id", "date", "exception_type")),
    "v_obs": "SELECT user_id % 20 AS seg, (hour(ts) * 60 + minute(ts))::BIGINT AS minute, strftime(ts, '%Y-%m-%d') AS day, value AS secs FROM events",
    "v_deeds": """SELECT l_orderkey AS deed, l_partkey AS unit, strftime(l_shipdate, '%Y-%m-%d') AS date, l_returnflag AS kind,
        CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice END AS unit_price, l_extendedprice + 100 AS deed_price,
        l_quantity AS area, l_linestatus AS status, (l_suppkey * 7919 % 1000) * 30 AS x, (l_suppkey * 104729 % 1000) * 30 AS y FROM lineitem""",
    "v_votes": "SELECT o_custkey % 100 AS precinct, o_orderpriority AS committee, count(*) AS votes FROM orders GROUP BY ALL",
}


class Data:
    """Lazy DataFrames of the derived tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def lo(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        items = self.table("lineitem").withColumn("m", F.expr(MINUTES))
        return items.join(orders, items.l_orderkey == orders.o_orderkey).drop("o_orderkey")

    @cached_property
    def pair_rows(self) -> DataFrame:
        """``lo`` dealt by origin and destination over as many tasks as its rows ask for: a task's groups are bounded."""
        tasks = -(-self.table("lineitem").count() // TASK_ROWS) or 1  # from the file footers
        return self.lo.repartition(tasks, "o_custkey", "l_suppkey")

    def _capped(self, condition) -> "F.Column":
        best = F.min(F.when(condition, F.col("m"))) if condition is not None else F.min("m")
        return F.when(best <= 90, best).cast("int")

    @cached_property
    def case_times(self) -> DataFrame:
        return self.pair_rows.groupBy(F.col("o_custkey").alias("from_id"), F.col("l_suppkey").alias("to_id")).agg(
            *[self._capped(None if c == "base" else F.col("l_returnflag") != c[-1]).alias(c) for c in CASES])

    @cached_property
    def matrix(self) -> DataFrame:
        return self.case_times.select("from_id", "to_id", F.col("base").alias("minutes"))

    @cached_property
    def matrix_b(self) -> DataFrame:
        return self.case_times.select("from_id", "to_id", F.col("loo_A").alias("minutes"))

    @cached_property
    def matrix_wide(self) -> DataFrame:
        slow = F.least(F.col("minutes") + (F.col("from_id") * 13 + F.col("to_id") * 7) % 15, F.lit(119))
        return self.matrix.select("from_id", "to_id", F.col("minutes").alias("travel_time_p50"),
                                  F.when(F.col("minutes").isNotNull(), slow).cast("int").alias("travel_time_p85"))

    @cached_property
    def departures(self) -> DataFrame:
        return self.lo.select((F.col("o_custkey") % 50).alias("from_id"), (F.col("l_suppkey") % 20).alias("to_id"),
                              F.when(F.col("m") <= 110, F.col("m")).cast("int").alias("minutes"))

    @staticmethod
    def _coords(k) -> list:
        a, b = k * 7919 % 1000, k * 104729 % 1000
        return [(a * 30).alias("x"), (b * 30).alias("y"), ((19320000 + a * 300) / 1e6).alias("lon"),
                ((51680000 + b * 200) / 1e6).alias("lat")]

    @cached_property
    def origins(self) -> DataFrame:
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        people = self.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        return people.select(F.col("c_custkey").alias("id"), F.floor("c_acctbal").alias("pop"),
                             F.col("n_name").alias("district"), F.col("r_name").alias("region"),
                             F.col("c_mktsegment").alias("segment"), *self._coords(F.col("c_custkey")))

    @cached_property
    def people(self) -> DataFrame:
        return self.origins.withColumn("pop", F.greatest("pop", F.lit(0)))

    @cached_property
    def dests(self) -> DataFrame:
        k = F.col("s_suppkey")
        category = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), (k % 4).cast("int"))
        return self.table("supplier").select(k.alias("id"), (1 + k % 7).alias("capacity"),
                                             category.alias("category"), *self._coords(k + 17))

    @cached_property
    def opps(self) -> DataFrame:
        rows = F.array(
            F.struct(F.concat(F.lit("srv_"), "category").alias("opportunity"), F.lit(1.0).alias("value")),
            F.struct(F.lit("capacity").alias("opportunity"), F.col("capacity").cast("double").alias("value")))
        return self.dests.select(F.col("id").alias("to_id"), F.inline(rows))

    @cached_property
    def case_long(self) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(c).alias("case_id"), F.col(c).alias("minutes")) for c in CASES])
        return self.case_times.select("from_id", "to_id", F.inline(rows))

    @cached_property
    def acc(self) -> DataFrame:
        """(case_id, id, opportunity, cutoff, acc) of every case."""
        origins = self.table("customer").select(F.col("c_custkey").alias("id"),
                                                F.explode(F.array(*[F.lit(c) for c in CASES])).alias("case_id"))
        out = accessibility(self.case_long.withColumn("percentile", F.lit(50)), self.opps, origins,
                            SERVICES, [50], CUTOFFS, by=["case_id"])
        return out.select("case_id", "id", "opportunity", "cutoff", F.col("accessibility").cast("bigint").alias("acc"))

    @cached_property
    def day_acc(self) -> DataFrame:
        """(day, id, opportunity, acc) of three realized days at 30 minutes."""
        times = self.pair_rows.groupBy(F.col("o_custkey").alias("from_id"), F.col("l_suppkey").alias("to_id")).agg(
            *[self._capped(F.col("l_linenumber") % 3 != d).alias(f"d{d}") for d in DAYS])
        rows = F.array(*[F.struct(F.lit(d).alias("day"), F.col(f"d{d}").alias("minutes")) for d in DAYS])
        origins = self.table("customer").select(F.col("c_custkey").alias("id"),
                                                F.explode(F.array(*[F.lit(d) for d in DAYS])).alias("day"))
        out = accessibility(times.select("from_id", "to_id", F.inline(rows)).withColumn("percentile", F.lit(50)),
                            self.opps, origins, SERVICES, [50], [30], by=["day"])
        return out.select("day", "id", "opportunity", F.col("accessibility").cast("bigint").alias("acc"))

    @cached_property
    def trips(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            F.concat(F.lit("f"), (k % 3).cast("string")).alias("feed"), k.alias("trip_id"),
            (F.col("o_custkey") % 40).alias("route_id"), F.col("o_orderpriority").alias("service_id"),
            (F.floor(k / 3) % 2).alias("direction_id"))

    @cached_property
    def stop_times(self) -> DataFrame:
        """(trip_id, seq, stop_id, arr, shift); the sequence number counts earlier days, then rows of the day."""
        items = self.table("lineitem").select(
            F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"), "l_partkey",
            "l_linenumber", "l_extendedprice", F.unix_date(F.col("l_shipdate").cast("date")).alias("ship_day"))
        per_day = items.groupBy("trip_id", "ship_day").agg(F.count("*").alias("n"))
        before = Window.partitionBy("trip_id").orderBy("ship_day").rowsBetween(Window.unboundedPreceding, -1)
        starts = per_day.select("trip_id", "ship_day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        day = Window.partitionBy("trip_id", "ship_day").orderBy("l_linenumber", "l_partkey", "stop_id", "l_extendedprice")
        placed = items.withColumn("rn", F.row_number().over(day)).join(starts, ["trip_id", "ship_day"])
        seq = F.col("start") + F.col("rn")
        return placed.select(
            "trip_id", seq.alias("seq"), "stop_id",
            (18000 + (F.col("trip_id") % 960) * 60 + seq * 120 + F.col("l_partkey") % 60).alias("arr"),
            ((F.col("l_partkey") * 17 + F.col("stop_id") * 31) % 241 - 60).alias("shift"))

    @cached_property
    def calendar(self) -> DataFrame:
        return self.spark.sql(values_sql(_calendar_rows(), CALENDAR_COLUMNS))

    @cached_property
    def exceptions(self) -> DataFrame:
        return self.spark.sql(SQL_VIEWS["v_exceptions"])

    @cached_property
    def obs(self) -> DataFrame:
        return self.table("events").select(
            (F.col("user_id") % 20).alias("seg"),
            (F.hour("ts") * 60 + F.minute("ts")).cast("bigint").alias("minute"),
            F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").alias("secs"))

    @cached_property
    def deeds(self) -> DataFrame:
        s = F.col("l_suppkey")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("deed"), F.col("l_partkey").alias("unit"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_returnflag").alias("kind"),
            F.when(F.col("l_partkey") % 5 != 0, F.col("l_extendedprice")).alias("unit_price"),
            (F.col("l_extendedprice") + 100).alias("deed_price"), F.col("l_quantity").alias("area"),
            F.col("l_linestatus").alias("status"), (s * 7919 % 1000 * 30).alias("x"), (s * 104729 % 1000 * 30).alias("y"))

    @cached_property
    def votes(self) -> DataFrame:
        return self.table("orders").groupBy(
            (F.col("o_custkey") % 100).alias("precinct"), F.col("o_orderpriority").alias("committee")).agg(
            F.count("*").alias("votes"))
