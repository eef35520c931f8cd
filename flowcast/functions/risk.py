"""Risk arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowcast import fixed_values as fv


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def ramp(value: Column, start: float, full: float) -> Column:
    """0 below ``start``, 1 from ``full`` on, linear in between."""
    return clamp01((value - F.lit(start)) / F.lit(full - start))


def _band(score: Column, field: int) -> Column:
    bands = fv.RISK_BANDS
    result = F.when(score < bands[1][0], bands[0][field])
    for band, upper in zip(bands[1:], bands[2:]):
        result = result.when(score < upper[0], band[field])
    return result.otherwise(bands[-1][field])


def risk_level(score: Column) -> Column:
    return F.when(score.isNotNull(), _band(score, 1))


def risk_progression(score: Column) -> Column:
    return F.when(score.isNotNull(), _band(score, 2))


def decisiveness(probability: Column) -> Column:
    """0 at an even chance, 1 at certainty."""
    return F.abs(F.lit(2.0) * probability - F.lit(1.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as DOUBLE, 0 when the denominator is 0."""
    return F.when(denominator != 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0))


def f2(precision: Column, recall: Column) -> Column:
    return ratio(F.lit(5.0) * precision * recall, F.lit(4.0) * precision + recall)


def focal_loss(truth: Column, probability: Column, gamma: float = 2.0, alpha: float = 0.75) -> Column:
    """Focal loss of one scored row; the probability is kept inside the open interval (0, 1)."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), probability))
    attack = -F.lit(alpha) * F.pow(F.lit(1.0) - p, F.lit(gamma)) * F.log(p)
    benign = -F.lit(1 - alpha) * F.pow(p, F.lit(gamma)) * F.log(F.lit(1.0) - p)
    return F.when(truth == 1, attack).otherwise(benign)
