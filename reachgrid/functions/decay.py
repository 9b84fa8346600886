"""Weight of a trip of t minutes against a cutoff."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP, EXPONENTIAL, LOGISTIC = "STEP", "EXPONENTIAL", "LOGISTIC"
DECAYS = (STEP, EXPONENTIAL, LOGISTIC)
# Fixed value: standard deviation of the logistic roll-off in minutes.
LOGISTIC_SD = 10.0


def decay_weight(decay: str, t: Column, cutoff: Column | int) -> Column:
    """Weight in 0..1; an unreachable (NULL) trip weighs 0 and STEP is strictly below the cutoff."""
    c = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    if decay == STEP:
        w = F.when(t < c, 1.0).otherwise(0.0)
    elif decay == EXPONENTIAL:
        w = F.when(c > 0, F.pow(F.lit(0.5), t / c)).otherwise(0.0)
    elif decay == LOGISTIC:
        w = 1 / (1 + F.exp((t - c) / (LOGISTIC_SD * math.sqrt(3) / math.pi)))
    else:
        raise ValueError(f"unknown decay {decay!r}")
    return F.coalesce(w, F.lit(0.0))


def catchment_weight(decay: str, t: Column, catchment: int) -> Column:
    """Decay weight cut to 0 at and beyond the catchment, for every decay."""
    return F.when(t < catchment, decay_weight(decay, t, catchment)).otherwise(0.0)
