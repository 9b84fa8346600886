"""Census sheets, dasymetric population, household and vote statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.scale import forward_fill

# Labels of the census workbook.
SYMBOL, STRUCTURE = "Symbol", "Struktura"
REGION_ROW, TRACT_ROW = "rejon statystyczny", "obwód spisowy"


def _position(cells: str, hit) -> Column:
    """0-based index of the first matching cell, NULL when there is none."""
    found = F.filter(F.transform(cells, lambda c, i: F.when(hit(F.trim(c)), i)), lambda i: i.isNotNull())
    return F.get(found, F.lit(0))


def find_header(rows: DataFrame, population_label: str) -> DataFrame:
    """(sheet, header_row, symbol_col, structure_col, population_col) ; the header may start in any row.

    rows: (sheet, row_no, cells). The structure labels and the population label may sit on
    different rows; the header ends at the later one. A sheet without both has no row:
    :func:`sheets_without_header` names it.
    """
    head = rows.select(
        "sheet", "row_no",
        _position("cells", lambda c: F.coalesce((c == SYMBOL) | c.startswith(SYMBOL + " "), F.lit(False))).alias("sym"),
        _position("cells", lambda c: F.coalesce(c == STRUCTURE, F.lit(False))).alias("str"),
        _position("cells", lambda c: F.coalesce(c == population_label, F.lit(False))).alias("pop"))
    named = F.col("sym").isNotNull() & F.col("str").isNotNull()
    out = head.groupBy("sheet").agg(
        F.min(F.when(named, F.struct("row_no", "sym", "str"))).alias("a"),
        F.min(F.when(F.col("pop").isNotNull(), F.struct("row_no", "pop"))).alias("b"))
    return out.where("a is not null and b is not null").select(
        "sheet", F.greatest("a.row_no", "b.row_no").alias("header_row"), F.col("a.sym").alias("symbol_col"),
        F.col("a.str").alias("structure_col"), F.col("b.pop").alias("population_col"))


def sheets_without_header(rows: DataFrame, header: DataFrame) -> DataFrame:
    """(sheet): sheets whose labels are not found, to be reported rather than left out in silence."""
    return rows.select("sheet").distinct().join(header.select("sheet"), "sheet", "left_anti")


def sheet_records(rows: DataFrame, header: DataFrame) -> DataFrame:
    """(sheet, row_no, symbol, structure, population) of the rows below the header."""
    below = rows.join(header, "sheet").where(F.col("row_no") > F.col("header_row"))
    cell = lambda c: F.get("cells", F.col(c))
    return below.select("sheet", "row_no", cell("symbol_col").alias("symbol"), cell("structure_col").alias("structure"),
                        cell("population_col").alias("population")).where("structure is not null")


def padded(symbol: Column, width: int) -> Column:
    """A whole number one digit short of ``width`` gets its leading zero back; other text is kept."""
    text = F.trim(F.coalesce(symbol, F.lit("")))
    digits = F.regexp_extract(text, r"^(\d+)(\.0+)?$", 1)
    number = F.when(digits != "", digits)
    return F.coalesce(F.when(F.length(number) == width - 1, F.lpad(number, width, "0")).otherwise(number), text)


def population_value(c: Column) -> Column:
    """Blank and '-' count 0; other text that is no number is an error."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(text.isin("", "-"), 0.0).otherwise(text.cast("double"))


def tract_population(records: DataFrame) -> DataFrame:
    """(sheet, key, population, rows): tract keys built from the region above them, repeats summed."""
    kind = F.trim("structure")
    marked = records.where(kind.isin(REGION_ROW, TRACT_ROW)).withColumn(
        "region", F.when(kind == REGION_ROW, padded(F.col("symbol"), 6)))
    filled = forward_fill(marked, ["sheet"], "row_no", "region", "_region")
    symbol = padded(F.col("symbol"), 7)
    key = F.when(F.length(symbol) >= 7, symbol).when(F.col("_region").isNotNull(), F.concat("_region", symbol)).otherwise(
        F.raise_error(F.lit("a census tract comes before any statistical region")).cast("string"))
    tracts = filled.where(kind == TRACT_ROW).select("sheet", key.alias("key"), population_value(F.col("population")).alias("population"))
    return tracts.groupBy("sheet", "key").agg(F.sum("population").alias("population"), F.count("*").alias("rows"))


def attach_population(areas: DataFrame, tracts: DataFrame, key: str) -> DataFrame:
    """Every area with the population of its key, NULL when the sheet has none."""
    wanted = F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return areas.join(tracts.select(F.col("key").alias("_k"), "population"), wanted == F.col("_k"), "left").drop("_k")


def match_report(attached: DataFrame, tracts: DataFrame, key: str) -> DataFrame:
    """One row: matched and unmatched areas, sheet rows without an area, numeric-looking short keys, error flag."""
    hit = F.count("population")
    total = tracts.agg(F.count("*").alias("n")).scalar()
    return attached.agg(
        hit.alias("matched"), (F.count("*") - hit).alias("unmatched"),
        F.count_if(F.col(key).cast("string").rlike(r"^\d{1,6}$")).alias("short_keys"),
        F.when(hit == 0, "ERROR").otherwise("OK").alias("level")).withColumn("sheet_only", total - F.col("matched"))


# --- population on cells -------------------------------------------------------------------

def areal_interpolation(fragments: DataFrame, tracts: DataFrame) -> DataFrame:
    """(hex_id, population): tract population split over its fragments by area."""
    whole = fragments.groupBy("tract").agg(F.sum("area").alias("_all"))
    parts = fragments.join(whole, "tract").join(tracts.select("tract", "population"), "tract")
    return parts.groupBy("hex_id").agg(F.sum(F.col("population") * F.col("area") / F.nullif(F.col("_all"), F.lit(0.0))).alias("population"))


def dasymetric(fragments: DataFrame, tracts: DataFrame) -> DataFrame:
    """(hex_id, population): split by built cells, by area in tracts without any."""
    whole = fragments.groupBy("tract").agg(F.sum(F.coalesce("built", F.lit(0.0))).alias("_built"), F.sum("area").alias("_all"))
    parts = fragments.join(whole, "tract").join(tracts.select("tract", F.coalesce("population", F.lit(0.0)).alias("population")), "tract")
    share = (F.when(F.col("_built") > 0, F.coalesce("built", F.lit(0.0)) / F.col("_built"))
             .when(F.col("_all") > 0, F.col("area") / F.col("_all")).otherwise(0.0))
    return parts.groupBy("hex_id").agg(F.sum(F.col("population") * share).alias("population"))


def dasymetric_report(fragments: DataFrame, tracts: DataFrame, new: DataFrame, old: DataFrame, min_pop: float) -> DataFrame:
    """One row of mass checks: totals, difference, fallback tracts, thin cells and relocated people."""
    whole = fragments.groupBy("tract").agg(F.sum(F.coalesce("built", F.lit(0.0))).alias("b"), F.sum("area").alias("a"))
    fallback = whole.where((F.col("b") <= 0) & (F.col("a") > 0)).join(tracts, "tract").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("population"), F.lit(0.0)).alias("p"))
    total = tracts.agg(F.sum("population").alias("p")).scalar()
    n, o = F.coalesce("new", F.lit(0.0)), F.coalesce("old", F.lit(0.0))
    both = new.select("hex_id", F.col("population").alias("new")).join(old.select("hex_id", F.col("population").alias("old")), "hex_id", "full")
    out = both.agg(F.sum(o).alias("old_sum"), F.sum(n).alias("new_sum"), F.count_if(o < min_pop).alias("thin_old"),
                   F.count_if(n < min_pop).alias("thin_new"), F.sum(F.abs(n - o)).alias("moved"),
                   F.sum(F.when(n < min_pop, o).otherwise(0.0)).alias("moved_from_dropped"))
    out = out.withColumn("tract_sum", total)
    return out.withColumn("mass_diff", F.abs(F.col("new_sum") - F.col("tract_sum")) / F.nullif("tract_sum", F.lit(0.0))).withColumn(
        "fallback_tracts", fallback.select("n").scalar()).withColumn("fallback_pop", fallback.select("p").scalar())


def people_weighted_rate(fragments: DataFrame, tracts: DataFrame, rate: str) -> DataFrame:
    """(hex_id, rate): tract rates averaged over the people of each tract inside the cell."""
    whole = fragments.groupBy("tract").agg(F.sum("area").alias("_all"))
    parts = fragments.join(whole, "tract").join(tracts.select("tract", "population", rate), "tract")
    w = F.when(F.col(rate).isNotNull(), F.col("area") * F.col("population") / F.nullif(F.col("_all"), F.lit(0.0)))
    return parts.groupBy("hex_id").agg((F.sum(w * F.col(rate)) / F.nullif(F.sum(w), F.lit(0.0))).alias(rate))


def cell_categories(points: DataFrame, categories: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """Points per cell and category side by side, with their total."""
    hits = [F.count_if(F.col("category") == c).alias(f"srv_{c}") for c in categories]
    return points.groupBy(*cell).agg(*hits, F.count("*").alias("srv_total"))


# --- categories ---------------------------------------------------------------------------

def category_breakdown(counts: DataFrame, key: str, categories: Sequence[str]) -> DataFrame:
    """Counts, total, percentages and the dominant category (first in sorted order on ties) per key."""
    names = sorted(categories)
    wide = counts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)).alias(c) for c in names])
    total = sum((F.col(f"`{c}`") for c in names[1:]), F.col(f"`{names[0]}`"))
    best = F.greatest(*[F.col(f"`{c}`") for c in names]) if len(names) > 1 else F.col(f"`{names[0]}`")
    pick = F.when(F.col("total") == 0, "")
    for c in names:
        pick = pick.when(F.col(f"`{c}`") == F.col("_best"), c)
    out = wide.withColumn("total", total).withColumn("_best", best)
    pct = [F.when(F.col("total") > 0, F.round(100.0 * F.col(f"`{c}`") / F.col("total"), 1)).otherwise(0.0).alias(f"pct_{c}") for c in names]
    return out.select(key, *[F.col(f"`{c}`") for c in names], "total", *pct, pick.alias("dominant"))


def composite_shares(counts: DataFrame, key: str, *, groups: Mapping[str, Sequence[str]],
                     midpoints: Mapping[str, float] | None = None) -> DataFrame:
    """Percent of each named group of categories, and the average of class midpoints (NULL without counts)."""
    n, total = F.col("n"), F.sum("n")
    shares = [F.round(100.0 * F.sum(F.when(F.col("category").isin(*cats), n).otherwise(0)) / F.nullif(total, F.lit(0)), 1).alias(name)
              for name, cats in groups.items()]
    if midpoints:
        value = F.create_map(*[F.lit(v) for pair in midpoints.items() for v in pair])[F.col("category")]
        shares.append(F.round(F.sum(value * n) / F.nullif(total, F.lit(0)), 2).alias("average"))
    return counts.groupBy(key).agg(total.alias("total"), *shares)


def mean_income(shares: Sequence[float], midpoints: Sequence[float]) -> float:
    """Mean income of one electorate from its shares per income class; undeclared answers are left out."""
    return sum(s * m for s, m in zip(shares, midpoints)) / sum(shares)


def income_index(votes: DataFrame, incomes: Mapping[str, float], fallback: float, valid: DataFrame | None = None) -> DataFrame:
    """(precinct, valid_votes, income_index): votes weighted by the mean income of each list's electorate.

    ``valid`` gives (precinct, valid_votes); without it the listed votes are the valid ones.
    """
    value = F.coalesce(F.create_map(*[F.lit(v) for pair in incomes.items() for v in pair])[F.col("committee")], F.lit(fallback))
    sums = votes.groupBy("precinct").agg(F.sum(F.coalesce("votes", F.lit(0)) * value).alias("_s"), F.sum("votes").alias("valid_votes"))
    if valid is not None:
        sums = sums.drop("valid_votes").join(valid, "precinct")
    return sums.where("valid_votes > 0").select("precinct", "valid_votes", F.round(F.col("_s") / F.col("valid_votes"), 1).alias("income_index"))


def vote_share(votes: DataFrame, committee: str) -> DataFrame:
    """(precinct, share): percent of valid votes for one list."""
    mine = F.sum(F.when(F.col("committee") == committee, F.col("votes")).otherwise(0))
    return votes.groupBy("precinct").agg(F.round(100.0 * mine / F.nullif(F.sum("votes"), F.lit(0)), 2).alias("share")).where("share is not null")
