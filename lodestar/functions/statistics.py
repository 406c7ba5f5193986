"""Intervals and derived figures of evaluation sheets."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many degrees of freedom the t quantile is looked up; beyond, its expansion is exact to nine digits.
LISTED = 200
Z975 = 1.959963984540054


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by the continued fraction (Lentz)."""
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1) / a


@cache
def t_quantile(freedom: int) -> float:
    """The 0.975 quantile of Student's t, by bisection."""
    low, high = 0.0, 13.0
    for _ in range(80):
        t = (low + high) / 2
        above = _incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t)) / 2
        low, high = (t, high) if above > 0.025 else (low, t)
    return (low + high) / 2


def t975(freedom: Column) -> Column:
    """The 0.975 quantile of Student's t; null below one degree of freedom."""
    z, v = Z975, freedom.cast("double")
    expansion = F.lit(z) + (z**3 + z) / 4 / v + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / F.pow(v, F.lit(2.0)) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / F.pow(v, F.lit(3.0))
    listed = F.array(*[F.lit(t_quantile(k)) for k in range(1, LISTED + 1)])
    return F.when(freedom > LISTED, expansion).when(freedom >= 1, F.get(listed, (freedom - 1).cast("int")))


def interval_half(c: str) -> Column:
    """Half the width of the 95 % interval of the mean; null for fewer than two values."""
    n = F.count(c)
    return t975(n - 1) * F.stddev_samp(c) / F.sqrt(n)


def wald_half(share: Column, n: Column) -> Column:
    """Half the width, in percent, of the 95 % interval of a share of n."""
    return 100 * 1.96 * F.sqrt(share * (1 - share) / n)


def scaled_score(percent: Column, items: int) -> Column:
    """Points of a part with so many items, to one decimal."""
    return F.round(percent * items / 100, 1)


def training_plan(n: Column, batch: Column, epochs: Column, save_every: Column, test_every: Column, devices: int = 24) -> dict[str, Column]:
    """Whole numbers of accumulation steps, steps, checkpoints and evaluations."""
    steps = F.floor(n / batch * epochs)
    return {"accumulation": F.floor(batch / devices), "steps": steps, "saves": F.floor(steps / save_every), "evaluations": F.floor(steps / test_every)}


def row_key(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 10))
