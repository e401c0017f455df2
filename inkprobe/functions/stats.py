"""Tails of distributions and the t quantile, without further libraries: continued fractions and series, to about 1e-12."""

from __future__ import annotations

import math
from functools import lru_cache

CRITICAL_CHI2_DF9_05 = 16.918977604620448
CRITICAL_CHI2_DF8_01 = 20.090235029663233


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    # the continued fraction, evaluated forwards with both running quotients kept away from zero
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 2000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            f *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * f


def gammaincc(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - scale * total
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    f = d
    for i in range(1, 2000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b)
        c = b + num / c
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return scale * f


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return betainc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return gammaincc(df / 2.0, x / 2.0)


def z_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@lru_cache(maxsize=4096)
def t_quantile(p_two_sided: float, df: float) -> float:
    """The t whose two-sided tail is ``p_two_sided``, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > p_two_sided:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_two_sided(mid, df) > p_two_sided else (low, mid)
    return (low + high) / 2.0


def critical_d(n: float, alpha: float = 0.05) -> float:
    """The smallest standardised difference that two groups of n can show as significant."""
    df = 2 * n - 2
    return math.inf if df < 1 else t_quantile(alpha, df) * math.sqrt(2.0 / n)


def p_value(kind: str, value: float | None, df1: float | None, df2: float | None) -> float | None:
    """The p-value of a reported statistic; None where it can't be had."""
    try:
        if value is None:
            return None
        if kind == "t" and df1:
            return t_two_sided(abs(value), df1)
        if kind == "F" and df1 and df2:
            return f_upper(value, df1, df2)
        if kind == "chisq" and df1:
            return chi2_upper(value, df1)
        if kind == "r" and df1:
            return None if abs(value) >= 1 else t_two_sided(value * math.sqrt(df1 / (1 - value * value)), df1)
        if kind == "Z":
            return z_two_sided(value)
    except (ValueError, OverflowError, ZeroDivisionError):
        pass
    return None


#: Effect sizes for which a table of p-values is shown. Fixed values.
EFFECT_SIZES = (0.2, 0.5, 0.8, 1.5, 2.0, 3.0)


def p_table(n: int) -> list[tuple[float, float, float]]:
    """(d, t, p) for each reference effect size, two groups of n."""
    out = []
    for d in EFFECT_SIZES:
        t = d * math.sqrt(n / 2.0)
        out.append((d, t, t_two_sided(t, 2 * n - 2) if n > 1 else 1.0))
    return out
