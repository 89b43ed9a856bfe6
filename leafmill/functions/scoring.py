"""Scores, routes and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the evaluation dimensions, and thresholds.
WEIGHTS = {"text_clarity": 0.25, "image_quality": 0.20, "layout_structure": 0.25, "table_regularity": 0.15, "sku_density": 0.15}
THRESHOLD_A = 0.85
THRESHOLD_B = 0.45
VARIANCE_LIMIT = 0.08
ENTROPY_LIMIT = 0.7


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def stable_round(x: Column, digits: int) -> Column:
    """Rounds half up to report sums and means, whose last bits depend on the order of their terms:
    values within a millionth of a unit below the half go up too.  Plain floating point, so every
    engine gives the same."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.500001).cast("double") / scale


def exact_round(x: Column, digits: int) -> Column:
    """Rounds the exact binary value, halves to even.  The product's rounding error is found by
    splitting ``x`` in two halves of its bits, so that ties are told from their neighbours; good for
    scales of up to 26 bits."""
    scale = float(10**digits)
    product = x * scale
    high = 134217729.0 * x - (134217729.0 * x - x)
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product)
    over = (product - below - 0.5) + error
    return (below + F.when((over > 0) | ((over == 0) & (below % 2 != 0)), 1).otherwise(0)).cast("double") / scale


def exact_mean(x: Column, decimals: int, digits: int) -> Column:
    """Mean of a group's values, none below zero and each of ``decimals`` decimals, halves up.  Summed and
    divided in whole units, so a mean that lies on a half does not hang on the order of the rows."""
    total, n = F.sum(F.round(x * 10**decimals).cast("long")), F.nullif(F.count(x), F.lit(0))
    twice, unit = 2 * 10**digits * total + 10**decimals * n, 2 * 10**decimals * n
    return ((twice - twice % unit) / unit).cast("double") / float(10**digits)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(part / F.greatest(F.lit(1), whole), digits)


def weighted_score(dims: dict[str, Column], penalty: Column, weights: dict[str, float] | None = None) -> Column:
    total = F.lit(0.0)
    for name, w in (weights or WEIGHTS).items():
        total = total + dims.get(name, F.lit(0.0)) * w
    return F.round(clamp(total - penalty), 4)


def route(score: Column, forced: Column, a: float = THRESHOLD_A, b: float = THRESHOLD_B) -> Column:
    return F.when(forced & (score >= b), "HYBRID").when(score >= a, "AUTO").when(score >= b, "HYBRID").otherwise("HUMAN_ALL")


def route_reason(score: Column, a: float = THRESHOLD_A, b: float = THRESHOLD_B) -> Column:
    return F.format_string("C_doc=%.3f, A=%.2f, B=%.2f", score, F.lit(a), F.lit(b))


def wald_margin(p: Column, n: Column) -> Column:
    return 1.96 * F.sqrt(p * (1 - p) / F.greatest(F.lit(1), n))


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p = tp / F.greatest(F.lit(1), tp + fp)
    r = tp / F.greatest(F.lit(1), tp + fn)
    return p, r, 2 * p * r / F.greatest(F.lit(0.001), p + r)
