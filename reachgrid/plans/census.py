"""Census, dasymetric population and vote queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reachgrid.functions import geo
from reachgrid.operators import census
from reachgrid.plans.impact import _r
from reachgrid.plans.registry import query
from reachgrid.plans.spatial import hex_sql
from reachgrid.plans.views import CATEGORIES, PRIORITIES, SQL_VIEWS
from reachgrid.session import checkpoint_folder
from reachgrid.sources import archives

# A census sheet per order status: two header rows, then region and tract rows in key order.
_STATUSES = ("F", "O", "P")


def sheet_rows(d):
    """(sheet, row_no, cells) as a workbook reader would deliver them."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c: c.cast("string")
    head = d.table("orders").select(F.col("o_orderstatus").alias("sheet")).distinct()
    top = head.select("sheet", F.lit(3).cast("bigint").alias("row_no"), F.array(F.lit("Symbol jednostki"), F.lit(" Struktura "), F.lit("x")).alias("cells"))
    second = head.select("sheet", F.lit(5).cast("bigint").alias("row_no"), F.array(F.lit(None).cast("string"), F.lit(None), F.lit("ogółem")).alias("cells"))
    region = k % 50 < 3
    symbol = F.when(region, text(10000 + cust)).when(cust % 3 == 0, text(100000 + cust)).otherwise(text(cust % 10))
    kind = F.when(region, census.REGION_ROW).when(k % 41 == 40, "gmina").otherwise(census.TRACT_ROW)
    people = F.when(k % 13 == 0, "-").when(k % 17 == 0, "").otherwise(text(k % 997))
    body = d.table("orders").select(F.col("o_orderstatus").alias("sheet"), (10 + k).alias("row_no"), F.array(symbol, kind, people).alias("cells"))
    first = head.select("sheet", F.lit(6).cast("bigint").alias("row_no"), F.array(F.lit("999999"), F.lit(census.REGION_ROW), F.lit(None).cast("string")).alias("cells"))
    return top.unionByName(second).unionByName(first).unionByName(body)


SQL_VIEWS["v_sheet"] = """
    SELECT sheet, row_no, kind, CASE WHEN kind = 'r' THEN lpad(symbol, 6, '0') WHEN length(symbol) = 6 THEN '0' || symbol ELSE symbol END AS symbol, people FROM (
      SELECT o_orderstatus AS sheet, 10 + o_orderkey AS row_no, CASE WHEN o_orderkey % 50 < 3 THEN 'r' WHEN o_orderkey % 41 = 40 THEN 'g' ELSE 't' END AS kind,
             CASE WHEN o_orderkey % 50 < 3 THEN (10000 + o_custkey)::VARCHAR WHEN o_custkey % 3 = 0 THEN (100000 + o_custkey)::VARCHAR ELSE (o_custkey % 10)::VARCHAR END AS symbol,
             CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 0 ELSE o_orderkey % 997 END AS people FROM orders
      UNION ALL SELECT DISTINCT o_orderstatus, 6, 'r', '999999', 0 FROM orders)"""
SQL_VIEWS["v_tracts"] = """
    SELECT sheet, CASE WHEN length(symbol) >= 7 THEN symbol ELSE region || symbol END AS key, sum(people)::DOUBLE AS population, count(*) AS rows FROM (
      SELECT *, last_value(CASE WHEN kind = 'r' THEN symbol END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no) AS region FROM v_sheet WHERE kind <> 'g') WHERE kind = 't' GROUP BY 1, 2"""


def tracts(d):
    rows = sheet_rows(d)
    return census.tract_population(census.sheet_records(rows, census.find_header(rows, "ogółem")))


@query("a08_sheet_header", "SELECT DISTINCT o_orderstatus AS sheet, 5::BIGINT AS header_row, 0 AS symbol_col, 1 AS structure_col, 2 AS population_col FROM orders")
def sheet_header(d):
    return census.find_header(sheet_rows(d), "ogółem")


#: Rows of one written workbook; a sheet of more is several workbooks of one sheet name.
BOOK_ROWS = 200_000


@query("a08_g26_workbook_tracts", """SELECT sheet, key, population, rows FROM v_tracts""")
def workbook_tracts(d):
    """The sheets written to workbook files and read back: header and tracts as from ready-made rows."""
    folder = f"{checkpoint_folder(d.spark)}/books-{uuid.uuid4().hex}"
    part = F.floor(F.col("row_no") / BOOK_ROWS)
    archives.write_workbooks(sheet_rows(d).repartition("sheet", part).sortWithinPartitions("sheet", "row_no"), folder)
    rows = archives.read_workbooks(d.spark, folder, "*").drop("workbook")
    return census.tract_population(census.sheet_records(rows, census.find_header(rows, "ogółem")))


@query("g26_h04_tract_population", """SELECT sheet, key, population, rows FROM v_tracts""")
def tract_population(d):
    return tracts(d)


_AREAS_SQL = "SELECT c_custkey AS area, CASE WHEN c_custkey % 5 = 0 THEN c_custkey::VARCHAR ELSE '0' || (100000 + c_custkey) END AS k FROM customer"


def attached(d):
    k = F.col("c_custkey")
    key = F.when(k % 5 == 0, k.cast("string")).otherwise(F.concat(F.lit("0"), (100000 + k).cast("string")))
    every = tracts(d).groupBy("key").agg(F.sum("population").alias("population"))
    return census.attach_population(d.table("customer").select(k.alias("area"), key.alias("k")), every, "k"), every


@query("c05_attach_population", f"""
SELECT area, k, population FROM ({_AREAS_SQL}) LEFT JOIN (SELECT key AS k, sum(population) AS population FROM v_tracts GROUP BY key) USING (k)""")
def attach_population(d):
    return attached(d)[0]


@query("c05_match_report", f"""
WITH j AS (SELECT area, k, population FROM ({_AREAS_SQL}) LEFT JOIN (SELECT key AS k, sum(population) AS population FROM v_tracts GROUP BY key) USING (k))
SELECT count(population) AS matched, count(*) - count(population) AS unmatched, count(*) FILTER (regexp_matches(k, '^[0-9]{{1,6}}$')) AS short_keys, 'OK' AS level,
       (SELECT count(DISTINCT key) FROM v_tracts) - count(population) AS sheet_only FROM j""")
def match_report(d):
    rows, one = attached(d)
    return census.match_report(rows, one, "k")


# --- population on cells: a part is a tract, a line item its overlap with a cell ------------------

SQL_VIEWS["v_fragments"] = "SELECT l_suppkey % 90 AS hex_id, l_partkey AS tract, sum(l_quantity) AS area, sum(CASE WHEN l_partkey % 6 <> 0 THEN l_linenumber % 4 ELSE 0 END)::DOUBLE AS built FROM lineitem GROUP BY ALL"
SQL_VIEWS["v_tract_pop"] = "SELECT p_partkey AS tract, (p_partkey * 7919 % 900)::DOUBLE AS population, CASE WHEN p_partkey % 8 <> 0 THEN p_size / 10.0 END AS rate FROM part"
SQL_VIEWS["v_areal"] = "SELECT hex_id, sum(population * area / t) AS population FROM (SELECT *, sum(area) OVER (PARTITION BY tract) AS t FROM v_fragments) JOIN v_tract_pop USING (tract) GROUP BY hex_id"
SQL_VIEWS["v_dasy"] = """SELECT hex_id, sum(population * CASE WHEN b > 0 THEN built / b WHEN a > 0 THEN area / a ELSE 0 END) AS population
    FROM (SELECT *, sum(built) OVER (PARTITION BY tract) AS b, sum(area) OVER (PARTITION BY tract) AS a FROM v_fragments) JOIN v_tract_pop USING (tract) GROUP BY hex_id"""


def fragments(d):
    built = F.when(F.col("l_partkey") % 6 != 0, F.col("l_linenumber") % 4).otherwise(0)
    return d.table("lineitem").groupBy((F.col("l_suppkey") % 90).alias("hex_id"), F.col("l_partkey").alias("tract")).agg(
        F.sum("l_quantity").alias("area"), F.sum(built).cast("double").alias("built"))


def tract_pop(d):
    k = F.col("p_partkey")
    return d.table("part").select(k.alias("tract"), (k * 7919 % 900).cast("double").alias("population"),
                                  F.when(k % 8 != 0, F.col("p_size") / 10.0).alias("rate"))


@query("g22_areal_interpolation", "SELECT hex_id, round(population, 6) AS population FROM v_areal")
def areal_interpolation(d):
    return _r(census.areal_interpolation(fragments(d), tract_pop(d)), "population")


@query("c18_g23_dasymetric", "SELECT hex_id, round(population, 6) AS population FROM v_dasy")
def dasymetric(d):
    return _r(census.dasymetric(fragments(d), tract_pop(d)), "population")


@query("g23_dasymetric_report", """
WITH j AS (SELECT coalesce(n.population, 0) AS n, coalesce(o.population, 0) AS o FROM v_dasy n FULL JOIN v_areal o USING (hex_id)),
f AS (SELECT tract, sum(built) AS b, sum(area) AS a FROM v_fragments GROUP BY tract HAVING sum(built) <= 0 AND sum(area) > 0)
SELECT round(sum(o), 3) AS old_sum, round(sum(n), 3) AS new_sum, count(*) FILTER (o < 9000) AS thin_old, count(*) FILTER (n < 9000) AS thin_new, round(sum(abs(n - o)), 3) AS moved,
       round(coalesce(sum(o) FILTER (n < 9000), 0), 3) AS moved_from_dropped, (SELECT round(sum(population), 3) FROM v_tract_pop) AS tract_sum,
       round(abs(sum(n) - (SELECT sum(population) FROM v_tract_pop)) / (SELECT sum(population) FROM v_tract_pop), 6) AS mass_diff,
       (SELECT count(*) FROM f) AS fallback_tracts, (SELECT round(sum(population), 3) FROM f JOIN v_tract_pop USING (tract)) AS fallback_pop FROM j""")
def dasymetric_report(d):
    frags, pop = fragments(d), tract_pop(d)
    out = census.dasymetric_report(frags, pop, census.dasymetric(frags, pop), census.areal_interpolation(frags, pop), 9000)
    out = _r(out, "old_sum", "new_sum", "moved", "moved_from_dropped", "tract_sum", "fallback_pop", digits=3)
    return _r(out, "mass_diff")


@query("g24_people_weighted_rate", """
SELECT hex_id, round(sum(CASE WHEN rate IS NOT NULL THEN area * population / a * rate END) / nullif(sum(CASE WHEN rate IS NOT NULL THEN area * population / a END), 0), 6) AS rate
FROM (SELECT *, sum(area) OVER (PARTITION BY tract) AS a FROM v_fragments) JOIN v_tract_pop USING (tract) GROUP BY hex_id""")
def people_weighted_rate(d):
    return _r(census.people_weighted_rate(fragments(d), tract_pop(d), "rate"), "rate")


@query("g31_cell_categories", "SELECT q, r, " + ", ".join(f"count(*) FILTER (category = '{c}') AS srv_{c}" for c in CATEGORIES)
       + f" , count(*) AS srv_total FROM ({hex_sql('v_dests', 2000.0, 'id, category, x, y')}) GROUP BY q, r")
def cell_categories(d):
    q, r = geo.hex_axial(F.col("x"), F.col("y"), 2000.0)
    return census.cell_categories(d.dests.select("category", q.alias("q"), r.alias("r")), CATEGORIES, ["q", "r"])


# --- categories and votes ------------------------------------------------------------------------

_SORTED = sorted(PRIORITIES)
_CODES = {p: p[0] for p in _SORTED}


def precinct_counts(d):
    return d.votes.select("precinct", F.substring("committee", 1, 1).alias("category"), F.when(F.col("precinct") % 9 != 0, F.col("votes")).otherwise(0).alias("n"))


_PIVOT = "w AS (SELECT precinct, " + ", ".join(
    f"coalesce(sum(CASE WHEN precinct % 9 <> 0 THEN votes ELSE 0 END) FILTER (committee = '{p}'), 0)::BIGINT AS \"{c}\"" for p, c in _CODES.items()) + " FROM v_votes GROUP BY precinct)"
_TOTAL = " + ".join(f'"{c}"' for c in _CODES.values())
_BEST = "greatest(" + ", ".join(f'"{c}"' for c in _CODES.values()) + ")"


@query("g27_category_breakdown", f"WITH {_PIVOT} SELECT precinct, " + ", ".join(f'"{c}"' for c in _CODES.values()) + f", {_TOTAL} AS total, " + ", ".join(
    f"CASE WHEN {_TOTAL} > 0 THEN round(100.0 * \"{c}\" / ({_TOTAL}), 1) ELSE 0 END::DOUBLE AS \"pct_{c}\"" for c in _CODES.values())
    + f", CASE WHEN {_TOTAL} = 0 THEN '' " + " ".join(f"WHEN \"{c}\" = {_BEST} THEN '{c}'" for c in _CODES.values()) + " END AS dominant FROM w")
def category_breakdown(d):
    return census.category_breakdown(precinct_counts(d), "precinct", list(_CODES.values()))


@query("g28_composite_shares", """
WITH c AS (SELECT precinct, committee[1:1] AS k, CASE WHEN precinct % 9 <> 0 THEN votes ELSE 0 END AS n FROM v_votes)
SELECT precinct, sum(n)::BIGINT AS total, round(100.0 * sum(CASE WHEN k = '1' THEN n ELSE 0 END) / nullif(sum(n), 0), 1) AS single_pct, round(100.0 * sum(CASE WHEN k IN ('4', '5') THEN n ELSE 0 END) / nullif(sum(n), 0), 1) AS large_pct,
       round(sum(n * CASE k WHEN '1' THEN 1.0::DOUBLE WHEN '2' THEN 2.0 WHEN '3' THEN 3.0 WHEN '4' THEN 4.0 ELSE 5.5 END) / nullif(sum(n), 0), 2) AS average FROM c GROUP BY precinct""")
def composite_shares(d):
    return census.composite_shares(precinct_counts(d), "precinct", groups={"single_pct": ["1"], "large_pct": ["4", "5"]},
                                   midpoints={"1": 1.0, "2": 2.0, "3": 3.0, "4": 4.0, "5": 5.5})


_INCOMES = {PRIORITIES[0]: 2900.5, PRIORITIES[1]: 3120.25, PRIORITIES[3]: 2480.75}


@query("g29_income_index", "SELECT precinct, sum(votes)::BIGINT AS valid_votes, round(sum(votes * CASE committee "
       + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _INCOMES.items()) + " ELSE 2700 END) / sum(votes), 1) AS income_index FROM v_votes GROUP BY precinct")
def income_index(d):
    return census.income_index(d.votes, _INCOMES, 2700.0)


@query("g30_vote_share", "SELECT precinct, round(100.0 * sum(CASE WHEN committee = '5-LOW' THEN votes ELSE 0 END) / sum(votes), 2)::DOUBLE AS share FROM v_votes GROUP BY precinct")
def vote_share(d):
    return census.vote_share(d.votes, "5-LOW")
