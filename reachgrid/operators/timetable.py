"""Walking times, stop patterns of trips, isochrones, case sweeps.

Straight-line walking stands in for street routing. Times are whole seconds after midnight.
stop_times: trip_id, seq, stop_id, arr, dep. stops: stop_id, x, y in metres.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.functions.values import check_cutoffs
from reachgrid.operators.spatial import pairs_within

REACH_PER_MINUTE = 900.0


def walk_matrix(origins: DataFrame, destinations: DataFrame, speed: float, max_minutes: int) -> DataFrame:
    """(from_id, to_id, minutes) on foot, whole minutes rounded up, within the walking cap."""
    a = origins.select(F.col("id").alias("from_id"), "x", "y")
    b = destinations.select(F.col("id").alias("to_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = pairs_within(a, b, speed * 60 * max_minutes)
    return near.select("from_id", "to_id", F.ceil(F.col("distance") / speed / 60).cast("int").alias("minutes"))


# --- patterns ------------------------------------------------------------------------------

def trip_patterns(stop_times: DataFrame) -> DataFrame:
    """(trip_id, pattern, start): trips visiting the same stops in the same order share a pattern.

    The key combines hashes of (position, stop), so no stop list is ever collected.
    """
    piece = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "seq", "stop_id"))
    parts = stop_times.groupBy("trip_id").agg(F.count("*").alias("n"), piece(1).alias("a"), piece(2).alias("b"),
                                              F.min_by("dep", "seq").alias("start"))
    return parts.select("trip_id", F.concat_ws("-", "n", "a", "b").alias("pattern"), "start")


# --- isochrones --------------------------------------------------------------------------------

def isochrone_cells(origins: DataFrame, spacing: float, cutoffs: Sequence[int], corner: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(cell, x, y): points of a square grid through ``corner`` that some origin could reach; ``cell`` is their place, "column:row".

    Points are made around each origin, so their number follows the origins and not the box around them.
    """
    pad = max(check_cutoffs(cutoffs)) * REACH_PER_MINUTE
    x0, y0 = corner

    def steps(c: Column, start: float) -> Column:
        return F.sequence(F.ceil((c - pad - start) / spacing).cast("bigint"), F.floor((c + pad - start) / spacing).cast("bigint"))
    near = origins.select("x", "y", F.explode(steps(F.col("x"), x0)).alias("i")).select("x", "y", "i", F.explode(steps(F.col("y"), y0)).alias("j"))
    cx, cy = x0 + F.col("i") * spacing, y0 + F.col("j") * spacing
    near = near.where(F.pow(cx - F.col("x"), 2) + F.pow(cy - F.col("y"), 2) <= pad * pad)
    return near.select("i", "j").distinct().select(F.concat_ws(":", "i", "j").alias("cell"), cx.alias("x"), cy.alias("y"))


def isochrones(times: DataFrame, cutoffs: Sequence[int], cell_area: float) -> DataFrame:
    """(from_id, cutoff, cells, area): cumulative cells reached per cutoff; unreached cells are holes."""
    cuts = check_cutoffs(cutoffs)
    sums = times.where(F.col("minutes") <= cuts[-1]).groupBy("from_id").agg(
        *[F.count_if(F.col("minutes") <= c).alias(f"c{c}") for c in cuts])
    rows = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"c{c}").alias("cells")) for c in cuts])
    return sums.select("from_id", F.inline(rows)).where("cells > 0").withColumn("area", F.col("cells") * cell_area)


# --- case sweeps ---------------------------------------------------------------------------------

def finished_cases(spark: SparkSession, folder: str) -> set[str]:
    """Cases recorded as complete beside ``folder``: one short name per case."""
    try:
        return {r["value"] for r in spark.read.text(folder.rstrip("/") + ".done").collect()}
    except AnalysisException:  # nothing written yet
        return set()


def run_cases(spark: SparkSession, cases: Sequence[str], compute: Callable[[list[str]], DataFrame], folder: str,
              column: str = "scenario") -> list[str]:
    """Compute the missing cases in one job and add them as partitions; returns what was computed.

    ``compute`` gets the missing case names and returns one table with the case as a column. A case
    counts as finished only after its rows are committed; a broken run is replaced, not added to.
    """
    done = finished_cases(spark, folder)
    missing = [c for c in cases if c not in done]
    if missing:
        (compute(missing).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(column).parquet(folder))
        names = spark.createDataFrame([(c,) for c in missing], "value string")
        names.coalesce(1).write.mode("append").text(folder.rstrip("/") + ".done")
    return missing
