"""Scoring columns: precision/recall/F1 rules, harmonic mean, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den, empty: float) -> Column:
    """num / den, ``empty`` when den = 0."""
    n, d = _c(num), _c(den)
    return F.when(d > 0, n.cast("double") / d).otherwise(F.lit(float(empty)))


def harmonic(p, r) -> Column:
    """SC-19: 2pr/(p+r), 0 when p + r = 0."""
    p, r = _c(p), _c(r)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def exact_prf(tp, fp, fn) -> tuple[Column, Column, Column]:
    """SC-10: P and R are 1.0 on an empty denominator; F1 follows SC-19."""
    tp, fp, fn = _c(tp), _c(fp), _c(fn)
    p = ratio(tp, tp + fp, 1.0)
    r = ratio(tp, tp + fn, 1.0)
    return p, r, harmonic(p, r)


def plain_prf(tp, fp, fn) -> tuple[Column, Column, Column]:
    """Aggregate P/R/F1: 0 on an empty denominator."""
    tp, fp, fn = _c(tp), _c(fp), _c(fn)
    p = ratio(tp, tp + fp, 0.0)
    r = ratio(tp, tp + fn, 0.0)
    return p, r, harmonic(p, r)


def overlap_prf(n_gt, n_pred, tp, fp, fn) -> tuple[Column, Column, Column]:
    """SC-11 edge cases: both empty 1/1/1; no predictions 0/0/0; no truth 0/1/0."""
    n_gt, n_pred = _c(n_gt), _c(n_pred)
    p0, r0, f0 = plain_prf(tp, fp, fn)
    both = (n_gt == 0) & (n_pred == 0)
    nopred = n_pred == 0
    nogt = n_gt == 0
    p = F.when(both, 1.0).when(nopred, 0.0).when(nogt, 0.0).otherwise(p0)
    r = F.when(both, 1.0).when(nopred, 0.0).when(nogt, 1.0).otherwise(r0)
    f = F.when(both, 1.0).when(nopred, 0.0).when(nogt, 0.0).otherwise(f0)
    return p, r, f


def clamp(x, lo, hi) -> Column:
    """SC-18: least(hi, greatest(lo, x))."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), _c(x)))
