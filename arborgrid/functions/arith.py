"""Pixel-wise and scalar arithmetic on Columns: sums, masks, thresholds, stretches, test functions.

Nulls give null throughout unless a function says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_combination(a: Column, b: Column, alpha: float) -> Column:
    return a * alpha + b * (1 - alpha)


def abs_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def square_diff(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def relu(a: Column) -> Column:
    return F.greatest(a, F.lit(0).cast("double"))


def relu_diff(a: Column, b: Column) -> Column:
    return relu(a - b)


def complement(v: Column, top: Column | int) -> Column:
    return (F.lit(top) if isinstance(top, int) else top) - v


def label_and(a: Column, b: Column) -> Column:
    return F.least(a, b)


def label_or(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def label_xor(a: Column, b: Column) -> Column:
    return F.when(a != b, 1).otherwise(0)


def label_intersection(a: Column, b: Column) -> Column:
    """The label where both agree, else 0."""
    return F.when(a == b, a).otherwise(0)


def mask(v: Column, m: Column, label: int | None = None) -> Column:
    """v where the mask is not 0 (or equals ``label``), else 0."""
    return F.when(m != 0 if label is None else m == label, v).otherwise(0)


def binarize(v: Column) -> Column:
    return F.when(v > 0, 1).otherwise(0)


def threshold(v: Column, low: Column | float, high: Column | float, value: int = 1) -> Column:
    """``value`` where low <= v <= high, else 0."""
    return F.when(v.between(low, high), value).otherwise(0)


def half_away(v: Column) -> Column:
    """Rounding half away from zero."""
    return F.when(v >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5)).cast("long")


def linear_stretch(v: Column, f1: float, f2: float, g1: float, g2: float) -> Column:
    """g1 below f1, g2 above f2, a straight line between."""
    slope = (g2 - g1) / (f2 - f1) if f2 != f1 else 0.0
    return F.when(v < f1, F.lit(float(g1))).when(v > f2, F.lit(float(g2))).otherwise((v - f1) * slope + g1)


def window_level(v: Column, width: float, level: float, top: float) -> Column:
    return linear_stretch(v, level - width / 2, level + width / 2, 0, top)


def gaussian_stretch(v: Column, mean: Column, std: Column, top: float) -> Column:
    return F.lit(float(top)) * F.exp(-((v - mean) ** 2) / (2 * std * std))


def exponential_stretch(v: Column, f1: float, f2: float, g1: float, g2: float) -> Column:
    return F.when(v.between(f1, f2), (g2 - g1) * (F.exp((v - f1) / (f2 - f1)) - 1) / (math.e - 1) + g1).otherwise(v)


def unit_range(v: Column, low: Column, high: Column, top: float = 1.0) -> Column:
    """(v - low) / (high - low) * top; 0 where the range is empty."""
    return F.when(high > low, (v - low) / (high - low) * top).otherwise(0.0)


def zscore(v: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (v - mean) / std).otherwise(0.0)


def sigmoid(v: Column, alpha: float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-v * alpha))


def log_base(v: Column, base: float) -> Column:
    return F.ln(v) / math.log(base)


def positive_mod(a: Column, n: int) -> Column:
    return F.pmod(a, F.lit(n))


def almost_zero(v: Column, eps: float = 1e-8) -> Column:
    return F.abs(v) < eps


def full_range(v: Column) -> Column:
    """The least 2**n - 1 that is at least v (at least 1): how far a value range normalises."""
    return (F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(v + 1)), F.lit(1))) - 1).cast("long")


def is_prime(v: Column) -> Column:
    """Trial division by the odd numbers up to the root; for numbers up to about 10**8."""
    odd = F.sequence(F.lit(3).cast("long"), F.greatest(F.floor(F.sqrt(v)), F.lit(3)).cast("long"), F.lit(2).cast("long"))
    return F.when(v < 2, False).when(v < 4, True).when(v % 2 == 0, False).otherwise(~F.exists(odd, lambda d: (d < v) & (v % d == 0)))


def arange(start: float, end: float, step: float) -> Column:
    """Closed range start, start + step, ... , as doubles."""
    n = int((end - start) / step + 1e-9) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(start) + i * step)


def geometric_range(start: float, end: float, ratio: float) -> Column:
    n = int(math.log(end / start) / math.log(ratio) + 1e-9) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(start) * F.pow(F.lit(ratio), i))


def _total(xs: Sequence[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


def sphere(xs: Sequence[Column]) -> Column:
    return _total([x * x for x in xs])


def rosenbrock(xs: Sequence[Column]) -> Column:
    return _total([(b - a * a) ** 2 * 100 + (1 - a) ** 2 for a, b in zip(xs, xs[1:])])


def rastrigin(xs: Sequence[Column]) -> Column:
    return _total([x * x - F.cos(x * 2 * math.pi) * 10 + 10 for x in xs])


def griewank(xs: Sequence[Column]) -> Column:
    product = F.lit(1.0)
    for i, x in enumerate(xs, 1):
        product = product * F.cos(x / math.sqrt(i))
    return _total([x * x for x in xs]) / 4000 - product + 1


def ackley(xs: Sequence[Column]) -> Column:
    n = len(xs)
    return F.exp(-F.sqrt(_total([x * x for x in xs]) / n) * 0.2) * -20 - F.exp(_total([F.cos(x * 2 * math.pi) for x in xs]) / n) + 20 + math.e
