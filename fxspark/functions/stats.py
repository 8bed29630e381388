"""Moment formulas and the normal distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of a rational approximation of the normal distribution function, highest power first
CDF_TOP = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
CDF_BOTTOM = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
CDF_SPLIT = 7.07106781186547
ROOT_2_PI = 2.5066282746310002

# Coefficients of a rational approximation of the normal quantile, highest power first
PPF_MID_TOP = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
PPF_MID_BOTTOM = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
PPF_TAIL_TOP = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
PPF_TAIL_BOTTOM = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
PPF_SPLIT = 0.02425


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _once(x: Column | str, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.transform(F.array((F.col(x) if isinstance(x, str) else x).cast("double")), fn)[0]


def correlation(a, b) -> Column:
    """Correlation over the rows with both values; NULL where a side never changes, also under ANSI."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def norm_cdf(x: Column | str) -> Column:
    """Standard normal distribution function."""
    return _once(x, _cdf)


def norm_ppf(p: Column | str) -> Column:
    """Standard normal quantile; NaN outside (0, 1). One step by the distribution function makes it exact."""
    return _once(p, _ppf)


def _cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * _polynomial(a, CDF_TOP) / _polynomial(a, CDF_BOTTOM)
    far = e / ROOT_2_PI / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65)))))
    below = F.when(a > 38.4, F.lit(0.0)).when(a < CDF_SPLIT, near).otherwise(far)
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x > 0, 1 - below).otherwise(below))


def _ppf(p: Column) -> Column:
    inside = (p > 0) & (p < 1)
    s = F.when(inside, F.least(p, 1 - p)).otherwise(0.5)  # the lower tail keeps its digits
    half = s - 0.5
    mid = _polynomial(half * half, PPF_MID_TOP) * half / _polynomial(half * half, PPF_MID_BOTTOM)
    q = F.sqrt(-2 * F.ln(s))
    tail = _polynomial(q, PPF_TAIL_TOP) / _polynomial(q, PPF_TAIL_BOTTOM)
    x = F.when(s >= PPF_SPLIT, mid).otherwise(tail)
    exact = _once(x, lambda v: _once((_cdf(v) - s) * ROOT_2_PI * F.exp(v * v / 2), lambda u: v - u / (1 + v * u / 2)))
    return F.when(p.isNotNull(), F.when(inside, F.when(p > 0.5, -exact).otherwise(exact)).otherwise(float("nan")))


STATE_PARTS = ("n", "mean", "m2", "m3", "m4", "min", "max")


def moment_state(x: Column, prefix: str) -> list[Column]:
    """Aggregates of a mergeable state: n, mean, sums of centred powers 2 to 4, min and max."""
    n = F.count(x)
    m2 = F.var_pop(x) * n
    return [
        n.alias(f"{prefix}_n"),
        F.avg(x).alias(f"{prefix}_mean"),
        m2.alias(f"{prefix}_m2"),
        F.coalesce(F.skewness(x) * F.pow(m2, F.lit(1.5)) / F.sqrt(n.cast("double")), F.lit(0.0)).alias(f"{prefix}_m3"),
        F.coalesce((F.kurtosis(x) + 3) * m2 * m2 / n, F.lit(0.0)).alias(f"{prefix}_m4"),
        F.min(x).alias(f"{prefix}_min"),
        F.max(x).alias(f"{prefix}_max"),
    ]


def merged_moments(prefix: str, mean: str) -> list[Column]:
    """Aggregates that merge states around the common mean held in column ``mean`` of every row."""
    n, m2, m3, m4 = (F.col(f"{prefix}_{p}") for p in ("n", "m2", "m3", "m4"))
    d = F.col(f"{prefix}_mean") - F.col(mean)
    return [
        F.sum(n).alias(f"{prefix}_n"),
        F.max(mean).alias(f"{prefix}_mean"),
        F.sum(m2 + n * d * d).alias(f"{prefix}_m2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias(f"{prefix}_m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias(f"{prefix}_m4"),
        F.min(f"{prefix}_min").alias(f"{prefix}_min"),
        F.max(f"{prefix}_max").alias(f"{prefix}_max"),
    ]


def finished(prefix: str) -> dict[str, Column]:
    """Statistics of a state: plain (not excess) kurtosis, NULL where all values are equal."""
    n, m2 = F.col(f"{prefix}_n"), F.col(f"{prefix}_m2")
    spread = F.when(F.col(f"{prefix}_min") != F.col(f"{prefix}_max"), m2)
    return {
        "mean": F.col(f"{prefix}_mean"),
        "stddev": F.sqrt(m2 / n),
        "variance": m2 / n,
        "skewness": F.sqrt(n.cast("double")) * F.col(f"{prefix}_m3") / F.pow(spread, F.lit(1.5)),
        "kurtosis": n * F.col(f"{prefix}_m4") / (spread * spread),
    }
