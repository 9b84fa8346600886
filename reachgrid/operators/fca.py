"""Two-step floating catchment access: supply shared among everyone who can reach it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.decay import STEP, catchment_weight
from reachgrid.functions.values import number_or_zero


def at_least_zero(c: Column) -> Column:
    """Missing and negative amounts count as 0."""
    return F.greatest(F.lit(0.0), number_or_zero(c))


def _weighted_pairs(pairs: DataFrame, catchment: int, decay: str) -> DataFrame:
    near = pairs.where(F.col("minutes") < catchment)
    return near.select("from_id", "to_id", catchment_weight(decay, F.col("minutes"), catchment).alias("w"))


def supply_ratios(pairs: DataFrame, population: DataFrame, capacity: DataFrame, *,
                  catchment: int, decay: str = STEP) -> DataFrame:
    """(to_id, capacity, demand, ratio): capacity per weighted resident, 0 without demand."""
    people = population.select(F.col("id").alias("from_id"), at_least_zero(F.col("population")).alias("p"))
    demand = (_weighted_pairs(pairs, catchment, decay).join(people.where("p > 0"), "from_id")
              .groupBy("to_id").agg(F.sum(F.col("p") * F.col("w")).alias("demand")))
    supply = capacity.select(F.col("id").alias("to_id"), at_least_zero(F.col("capacity")).alias("capacity"))
    d = F.coalesce(F.col("demand"), F.lit(0.0))
    return supply.join(demand, "to_id", "left").select(
        "to_id", "capacity", d.alias("demand"),
        F.when(d > 0, F.col("capacity") / d).otherwise(0.0).alias("ratio"))


def competitive_access(pairs: DataFrame, ratios: DataFrame, population: DataFrame, *,
                       catchment: int, decay: str = STEP, per_population: float = 1.0) -> DataFrame:
    """(id, access): supply ratios summed over the catchment; every origin is present."""
    reached = (_weighted_pairs(pairs, catchment, decay)
               .join(ratios.where("ratio > 0").select("to_id", "ratio"), "to_id")
               .groupBy(F.col("from_id").alias("id")).agg(F.sum(F.col("ratio") * F.col("w")).alias("access")))
    return population.select("id").join(reached, "id", "left").select(
        "id", (F.coalesce("access", F.lit(0.0)) * per_population).alias("access"))


def _fair_ratio(ratios: DataFrame, population: DataFrame) -> Column:
    """Study-wide capacity per resident, NULL without residents."""
    supply = ratios.agg(F.sum("capacity").alias("s")).scalar()
    people = population.agg(F.sum(at_least_zero(F.col("population"))).alias("p")).scalar()
    return F.when(people > 0, supply / people).otherwise(0.0)


def thin_supply(ratios: DataFrame, population: DataFrame, factor: float = 50.0) -> DataFrame:
    """Served destinations whose ratio exceeds ``factor`` times the study-wide ratio."""
    fair = _fair_ratio(ratios, population)
    served = ratios.where((F.col("capacity") > 0) & (F.col("demand") > 0)).withColumn("fair", fair)
    return served.where((F.col("fair") <= 0) | (F.col("ratio") > factor * F.col("fair")))


def supply_summary(ratios: DataFrame, population: DataFrame, factor: float = 50.0) -> DataFrame:
    """One row of checks: thin and unserved destinations, supply handed out, extremes."""
    tagged = ratios.withColumn("fair", _fair_ratio(ratios, population))
    served = (F.col("capacity") > 0) & (F.col("demand") > 0)
    thin = served & ((F.col("fair") <= 0) | (F.col("ratio") > factor * F.col("fair")))
    return tagged.agg(
        F.count_if(thin).alias("thin_supply"),
        F.when(F.max("fair") > 0, F.coalesce(F.max(F.when(thin, F.col("ratio"))), F.lit(0.0)) / F.max("fair"))
        .otherwise(0.0).alias("worst_thin_factor"),
        F.coalesce(F.max("ratio"), F.lit(0.0)).alias("max_ratio"),
        F.count_if((F.col("capacity") > 0) & (F.col("demand") == 0)).alias("unserved_supply"),
        F.coalesce(F.sum(F.when(F.col("demand") > 0, F.col("capacity"))), F.lit(0.0)).alias("distributed_supply"))


def conservation_gap(access: DataFrame, population: DataFrame, ratios: DataFrame) -> DataFrame:
    """One row: supply received by residents minus supply handed out (0 by construction)."""
    people = population.select("id", at_least_zero(F.col("population")).alias("p"))
    given = ratios.agg(F.sum(F.when(F.col("demand") > 0, F.col("capacity"))).alias("s")).scalar()
    got = access.join(people, "id").agg(F.coalesce(F.sum(F.col("access") * F.col("p")), F.lit(0.0)).alias("received"))
    return got.withColumn("distributed", F.coalesce(given, F.lit(0.0))).withColumn(
        "gap", F.col("received") - F.col("distributed"))
