"""What each mode adds: walk (W), tram (T), bus (B) and both (TB) side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CASES = ("W", "T", "B", "TB")
EPS = 1e-6


def modal_wide(acc: DataFrame) -> DataFrame:
    """(id, cutoff, w, t, b, tb) from (mode_case, id, cutoff, acc); a missing case counts 0."""
    pick = [F.coalesce(F.max(F.when(F.col("mode_case") == c, F.col("acc"))), F.lit(0)).cast("double").alias(c.lower())
            for c in CASES]
    return acc.groupBy("id", "cutoff").agg(*pick)


def reliability_gate(wide: DataFrame, k: float, cutoff: int) -> DataFrame:
    """(id, gate): cells whose combined reach at the headline cutoff is at least ``k``."""
    return wide.where(F.col("cutoff") == cutoff).select("id", (F.col("tb") >= k).alias("gate"))


def modal_metrics(wide: DataFrame, gate: DataFrame) -> DataFrame:
    """Gains, transfer premium, shares and sub-additivity per cell.

    Shares are NULL, never 0, when nothing is reached or the cell fails the reliability gate.
    """
    w, t, b, tb = (F.col(c) for c in ("w", "t", "b", "tb"))
    ok = F.coalesce("gate", F.lit(False)) & (tb > 0)
    over = lambda c: F.greatest(F.lit(0.0), c - w)
    both = over(t) + over(b)
    share = lambda v: F.when(ok, v / tb)
    premium = tb - F.greatest(t, b)
    return wide.join(gate, "id", "left").select(
        "id", "cutoff", "w", "t", "b", "tb", (tb - b).alias("tram_gain"), (tb - t).alias("bus_gain"),
        F.greatest(t, b).alias("no_transfer"), premium.alias("transfer_premium"), share(w).alias("walk_share"),
        share(tb - b).alias("tram_share"), share(tb - t).alias("bus_share"), share(t - b).alias("mode_balance"),
        share(premium).alias("transfer_premium_rel"), F.when(ok & (both > 0), over(tb) / both).alias("subadd"))


def city_modal_summary(wide: DataFrame, population: DataFrame, k: float) -> DataFrame:
    """(cutoff, case, weighted mean, coverage %, city sub-additivity) incl. the no-transfer case."""
    rows = wide.join(population.select("id", "pop"), "id").withColumn("no_transfer", F.greatest("t", "b"))
    cases = {"W": "w", "T": "t", "B": "b", "no_transfer": "no_transfer", "TB": "tb"}
    total = F.sum("pop")
    means = rows.groupBy("cutoff").agg(
        *[(F.sum(F.col("pop") * F.col(c)) / total).alias(f"m_{n}") for n, c in cases.items()],
        *[(F.sum(F.when(F.col(c) >= k, F.col("pop")).otherwise(0)) / total).alias(f"c_{n}") for n, c in cases.items()])
    over = lambda n: F.greatest(F.lit(0.0), F.col(f"m_{n}") - F.col("m_W"))
    both = over("T") + over("B")
    long = F.array(*[F.struct(F.lit(n).alias("case"), F.round(f"m_{n}", 2).alias("acc_weighted_mean"),
                              F.round(F.col(f"c_{n}") * 100, 2).alias("coverage_pct")) for n in cases])
    return means.select("cutoff", F.round(F.when(both > 0, over("TB") / both), 4).alias("subadd_city"), F.inline(long))


def two_weight_mean(values: DataFrame, value: str, weights: tuple[str, str]) -> DataFrame:
    """One row: the same subset averaged with two different weights."""
    a, b = weights
    kept = values.where(F.col(value).isNotNull() & F.col(a).isNotNull())
    mean = lambda w: F.sum(F.col(w) * F.col(value)) / F.nullif(F.sum(w), F.lit(0))
    return kept.agg(F.count("*").alias("cells"), mean(a).alias(f"mean_{a}"), mean(b).alias(f"mean_{b}"))


def invariants(wide: DataFrame) -> DataFrame:
    """One row: rows where walking beats a mode, where both modes lose to one, and the mode difference."""
    w, t, b, tb = (F.col(c) for c in ("w", "t", "b", "tb"))
    i3 = F.avg(F.abs(t - b)) / F.nullif(F.avg(tb), F.lit(0.0))
    return wide.agg(
        F.count("*").alias("rows_checked"),
        F.count_if((w > t + EPS) | (w > b + EPS) | (w > tb + EPS)).alias("i1_violations"),
        F.count_if(tb + EPS < F.greatest(t, b)).alias("i2_violations"),
        F.coalesce(i3, F.lit(0.0)).alias("i3_value"))
