"""Confidence, decay, calibration and rank bonuses as Column expressions.

No expression reads the clock: ``now`` is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Half-life in days and floor by source type; all others don't decay.
DECAY = {"REDDIT_POST": (60.0, 0.10), "GITHUB_REPO": (365.0, 0.40), "GITHUB_GIST": (180.0, 0.20), "GITHUB_PAGES": (365.0, 0.25)}
#: Calibration sources that may be capped, and the cap.
UNCALIBRATED, UNCALIBRATED_CAP = ("EXTRACTOR_DIRECT",), 0.7


def clamp01(x: Column) -> Column:
    """x within 0 and 1; null stays null."""
    return F.when(x.isNull(), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def age_days(then: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(86400e6)


def decayed(age: Column, half_life: Column) -> Column:
    return F.pow(F.lit(0.5), age / half_life)


def recency_of_age(age: Column, half_life: Column, floor: Column) -> Column:
    """max(floor, 0.5 ** (age / half_life)); 1 without age or half-life and for ages up to 0."""
    return F.when(age.isNull() | half_life.isNull() | (age <= 0), F.lit(1.0)).otherwise(F.greatest(floor, decayed(age, half_life)))


def recency(published: Column, source_type: Column, now: Column) -> Column:
    """Recency by the decay of the source type."""
    half_life, floor = F.lit(None).cast("double"), F.lit(0.0)
    for name, (days, least) in DECAY.items():
        half_life = F.when(source_type == name, days).otherwise(half_life)
        floor = F.when(source_type == name, least).otherwise(floor)
    return recency_of_age(age_days(published, now), half_life, floor)


def effective_confidence(value: Column, extractor: Column, source: Column, recent: Column, calibration: Column | None = None, cap: float | None = None) -> Column:
    """Product of value and weights within 0 and 1; missing weights are 1.

    With a cap, values whose calibration source is uncalibrated are capped first.
    """
    if cap is not None and calibration is not None:
        value = F.when(calibration.isin(*UNCALIBRATED), F.least(value, F.lit(cap))).otherwise(value)
    one = F.lit(1.0)
    return clamp01(value * F.coalesce(extractor, one) * F.coalesce(source, one) * F.coalesce(recent, one))


def calibrated(raw: Column, temperature: Column) -> Column:
    """sigmoid(logit(raw) / temperature); 0 and 1 stay."""
    return F.when(raw <= 0, F.lit(0.0)).when(raw >= 1, F.lit(1.0)).otherwise(1 / (1 + F.exp(-F.ln(raw / (1 - raw)) / temperature)))


def saturated(raw: Column, epsilon: float = 1e-7) -> Column:
    return (raw <= epsilon) | (raw >= 1 - epsilon)


def utility_bonus(reinforcement: Column, rate: Column) -> Column:
    return F.when((reinforcement > 0) & (rate > 0), rate * F.log1p(reinforcement)).otherwise(F.lit(0.0))


def owner_bonus(relevant: Column, weight: Column) -> Column:
    return F.when(relevant & (weight > 0), weight).otherwise(F.lit(0.0))


def equivalence(link: Column, trust: Column) -> Column:
    """Link confidence, times the observer's trust where there is one."""
    return F.when(trust.isNull(), link).otherwise(link * clamp01(trust))
