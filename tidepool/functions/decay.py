"""Forgetting curves and activation of memories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the dynamics: weights of recency, importance and confidence,
# decay exponent, base stability in hours, gains of stability by use and importance.
ALPHA, BETA, GAMMA, DECAY = 1.0, 0.5, 0.5, 0.5
BASE_HOURS, USE_GAIN, IMPORTANCE_GAIN = 24.0, 0.1, 0.2
PRUNE_BELOW = 0.05


def stability(accesses: Column, importance: Column) -> Column:
    """Hours until a memory has faded to 1/e."""
    return F.lit(BASE_HOURS) * (F.lit(1.0) + F.lit(USE_GAIN) * F.log(accesses + F.lit(1.0)) + F.lit(IMPORTANCE_GAIN) * importance)


def retention(age_hours: Column, stable_hours: Column) -> Column:
    """exp(-age / stability), between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-age_hours / stable_hours)))


def trace(age_hours: Column) -> Column:
    """One access's part in the activation sum."""
    return F.pow(F.greatest(age_hours, F.lit(1e-4)), F.lit(-DECAY))


def activation(traces: Column, importance: Column, confidence: Column) -> Column:
    return F.lit(ALPHA) * F.log(traces) + F.lit(BETA) * importance + F.lit(GAMMA) * confidence


def by_tier(tier: str, value: Column, core: float, working: float) -> Column:
    """Core and working memories are frozen at fixed values."""
    return F.when(F.col(tier) == "Core", F.lit(core)).when(F.col(tier) == "Working", F.lit(working)).otherwise(value)
