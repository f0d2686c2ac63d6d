"""Scalar statistics as column arithmetic; every rate is 0 on an empty denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(count: Column, total: Column, per: float) -> Column:
    return F.when(total > 0, count * per / total).otherwise(0.0)


def wilson(count: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion, within 0 and 1."""
    p, n = count / total, total
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lo, hi = (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)
    return F.when(total > 0, F.greatest(lo, F.lit(0.0))).otherwise(0.0), F.when(total > 0, F.least(hi, F.lit(1.0))).otherwise(0.0)


def exceedance(v: Column, lo: Column, hi: Column) -> Column:
    """Distance beyond the band over its width (1 if it has none), at most 1."""
    width = F.when(hi > lo, hi - lo).otherwise(1.0)
    out = F.when(v < lo, lo - v).when(v > hi, v - hi).otherwise(0.0)
    return F.least(out / width, F.lit(1.0))


def log_odds(a: Column, total_a: Column, b: Column, total_b: Column, prior: Column, total_prior: Column) -> tuple[Column, Column]:
    """Log-odds difference with an informative Dirichlet prior, and its z score."""
    da = F.log((a + prior) / (total_a + total_prior - a - prior))
    db = F.log((b + prior) / (total_b + total_prior - b - prior))
    delta = da - db
    return delta, delta / F.sqrt(1.0 / (a + prior) + 1.0 / (b + prior))


def smoothed_ratio(a: Column, total_a: Column, b: Column, total_b: Column, eps: float = 0.5) -> Column:
    return ((a + eps) / total_a) / ((b + eps) / total_b)


def verdict(ratio: Column, machine: Column) -> Column:
    """confirmed, direction-error, weak or none."""
    return F.when(ratio.isNull(), "none").when((ratio >= 2.0) & (machine >= 2), "confirmed").when(ratio <= 0.67, "direction-error").when(ratio > 1.0, "weak").otherwise("none")
