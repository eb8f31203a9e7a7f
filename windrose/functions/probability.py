"""Probability expressions: normal CDF, Gaussian exceedance, mixture distribution of the absolute error.

Neither Spark nor the SQL dialect used for cross-checks has ``erf``.  ``norm_cdf`` is the double-precision
rational approximation of Hart (1968) as arranged by West (2005), absolute error below 1e-14.  It is built as
one SQL expression so the same text can be evaluated by any engine; callers bind the argument to a short
name first (column or lambda variable), which keeps the expression small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.functions.scalar import clip

# Hart's coefficients, highest order first (fixed values)
_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
        221.213596169931, 220.206867912376)
_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
        637.333633378831, 793.826512519948, 440.413735824752)
_SPLIT = 7.07106781186547
_SQRT_2PI = 2.506628274631


def _horner(coeffs, x: Column) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function as a built-in column expression."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    tail = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + F.lit(0.65)))))) / F.lit(_SQRT_2PI)
    upper = (F.when(a > 37, F.lit(0.0))
             .when(a < _SPLIT, e * _horner(_NUM, a) / _horner(_DEN, a))
             .otherwise(tail))
    return F.when(x > 0, 1 - upper).otherwise(upper)


def norm_cdf_sql(x: str) -> str:
    """The same function as portable SQL text."""
    def horner(coeffs):
        s = f"{coeffs[0]!r}"
        for c in coeffs[1:]:
            s = f"({s} * abs({x}) + {c!r})"
        return s
    e = f"exp(-({x}) * ({x}) / 2e0)"
    tail = f"{e} / (abs({x}) + 1e0 / (abs({x}) + 2e0 / (abs({x}) + 3e0 / (abs({x}) + 4e0 / (abs({x}) + 0.65e0))))) / {_SQRT_2PI!r}e0"
    upper = (f"(CASE WHEN abs({x}) > 37 THEN 0e0 WHEN abs({x}) < {_SPLIT!r}e0 THEN {e} * {horner(_NUM)} / {horner(_DEN)} "
             f"ELSE {tail} END)")
    return f"(CASE WHEN {x} > 0 THEN 1e0 - {upper} ELSE {upper} END)"


def reliable_gaussian_exceedance(threshold, spread, n_members: float) -> Column:
    """P(|error| > threshold) for a perfectly reliable Gaussian ensemble of ``n_members``."""
    s = clip(F.col(spread) * F.lit(math.sqrt(1 + 1 / n_members)), 1e-6)
    return 2 * norm_cdf(-(threshold / s))


def _mean(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v) / F.size(arr)


def mixture_exceedance(c, mu, sigma, m, s) -> Column:
    """P(|m - Z| / s > c) for an equally weighted Gaussian mixture with centres ``mu`` (array) and one ``sigma``."""
    c, mu, sigma, m, s = (F.col(x) for x in (c, mu, sigma, m, s))
    reach = clip(c, 0.0) * s
    hi = F.transform(F.transform(mu, lambda k: (m + reach - k) / sigma), norm_cdf)
    lo = F.transform(F.transform(mu, lambda k: (m - reach - k) / sigma), norm_cdf)
    return clip(1 - (_mean(hi) - _mean(lo)), 0.0, 1.0)


def mixture_mean(mu, sigma, m, s) -> Column:
    """Mean of |m - Z| / s: folded-normal means averaged over the mixture components."""
    mu, sigma, m, s = (F.col(x) for x in (mu, sigma, m, s))
    z = F.transform(mu, lambda k: (k - m) / sigma)
    folded = F.transform(z, lambda t: sigma * (F.lit(math.sqrt(2 / math.pi)) * F.exp(-t * t / 2)
                                               + t * (1 - 2 * norm_cdf(-t))))
    return _mean(folded) / s


def mixture_std(mean, mu, sigma, m, s) -> Column:
    mean, mu, sigma, m, s = (F.col(x) for x in (mean, mu, sigma, m, s))
    second = _mean(F.transform(mu, lambda k: (k - m) * (k - m) + sigma * sigma)) / (s * s)
    return F.sqrt(clip(second - mean * mean, 0.0))


def exceedance_from_quantiles(quantiles: Column, threshold: Column,
                              levels: tuple[float, ...] = C.QUANTILE_LEVELS, eps: float = 1e-6) -> Column:
    """P(Y > threshold) from an ordered quantile array: linear CDF inside, exponential tails outside."""
    lv = F.array(*[F.lit(float(x)) for x in levels])
    k = len(levels)
    idx = F.size(F.filter(quantiles, lambda q: q <= threshold))
    at = lambda arr, i: F.element_at(arr, i)                       # noqa: E731  (1-based)
    safe = F.least(F.greatest(idx, F.lit(1)), F.lit(k - 1))
    x0, x1 = at(quantiles, safe), at(quantiles, safe + 1)
    p0, p1 = at(lv, safe), at(lv, safe + 1)
    inner = p0 + (threshold - x0) / F.greatest(x1 - x0, F.lit(eps)) * (p1 - p0)
    top_scale = F.greatest(at(quantiles, F.lit(k)) - at(quantiles, F.lit(k - 1)), F.lit(eps)) / math.log(
        (1 - levels[-2]) / (1 - levels[-1]))
    top = 1 - (1 - levels[-1]) * F.exp(-(threshold - at(quantiles, F.lit(k))) / top_scale)
    low_scale = F.greatest(at(quantiles, F.lit(2)) - at(quantiles, F.lit(1)), F.lit(eps)) / math.log(
        levels[1] / levels[0])
    low = levels[0] * F.exp(-(at(quantiles, F.lit(1)) - threshold) / low_scale)
    cdf = F.when(idx == 0, low).when(idx == k, top).otherwise(inner)
    known = threshold.isNotNull() & ~F.exists(quantiles, lambda q: q.isNull())
    return F.when(known, clip(1 - cdf, 0.0, 1.0))


def crossing_columns(quantiles: Column) -> tuple[Column, Column]:
    """(number of crossing neighbours, largest violation) of an unsorted quantile array."""
    n = F.size(quantiles)
    drops = F.zip_with(F.slice(quantiles, F.lit(1), n - 1), F.slice(quantiles, F.lit(2), n - 1), lambda a, b: a - b)
    return F.size(F.filter(drops, lambda d: d > 0)), F.greatest(F.lit(0.0), F.array_max(drops))
