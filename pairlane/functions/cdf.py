"""Distribution functions as column expressions: Spark SQL has none for t, F, chi-square or the normal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
_TINY = 1e-300


def lgamma(x: Column) -> Column:
    """Log of the gamma function for x > 0."""
    y = x - 1
    s = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        s = s + c / (y + i)
    t = y + 7.5
    return 0.9189385332046727 + (y + 0.5) * F.ln(t) - t + F.ln(s)


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _beta_fraction(x: Column, a: Column, b: Column, steps: int) -> Column:
    one = F.lit(1.0)
    d0 = one / _away(1 - (a + b) * x / (a + 1))
    start = F.struct(one.alias("c"), d0.alias("d"), d0.alias("h"))

    def half(state: Column, w: Column) -> Column:
        d = one / _away(1 + w * state["d"])
        c = _away(1 + w / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    def step(state: Column, i: Column) -> Column:
        m = F.floor((i + 1) / 2).cast("double")
        even = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        odd = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        return half(state, F.when(i % 2 == 1, odd).otherwise(even))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * steps)), start, step, lambda s: s["h"])


def beta_inc(x: Column, a: Column, b: Column, steps: int = 150) -> Column:
    """Regularised incomplete beta function."""
    a, b = a.cast("double"), b.cast("double")
    front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    inside = F.when(x < (a + 1) / (a + b + 2), front * _beta_fraction(x, a, b, steps) / a).otherwise(1 - front * _beta_fraction(1 - x, b, a, steps) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def gamma_q(a: Column, x: Column, steps: int = 300) -> Column:
    """Regularised upper incomplete gamma function."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(-x + a * F.ln(x) - lgamma(a))
    start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, i: F.struct((s["term"] * x / (a + i)).alias("term"), (s["sum"] + s["term"] * x / (a + i)).alias("sum")), lambda s: s["sum"])
    b0 = x + 1 - a
    d0 = 1 / _away(b0)
    begin = F.struct(F.lit(1 / _TINY).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(s: Column, i: Column) -> Column:
        an, b = -i * (i - a), b0 + 2 * i
        d = 1 / _away(an * s["d"] + b)
        c = _away(b + an / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, step, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    return F.when(F.abs(t) == float("inf"), 0.0).otherwise(beta_inc(df / (df + t * t), df / 2.0, F.lit(0.5)))


def chi2_sf(x: Column, df: Column) -> Column:
    return gamma_q(df / 2.0, x / 2.0)


def f_sf(x: Column, df1: Column, df2: Column) -> Column:
    return beta_inc(df2 / (df2 + df1 * x), df2 / 2.0, df1 / 2.0)


def normal_two_sided(z: Column) -> Column:
    return gamma_q(F.lit(0.5), z * z / 2.0)


def _plus(a: Column, b: Column) -> Column:
    """Sum of two arrays, the shorter one filled up with zeros."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def _moved(a: Column, by: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), by), a)


def _share_upto(counts: Column, upto: Column) -> Column:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return total(F.slice(counts, 1, upto.cast("int") + 1)) / total(counts)


def signed_rank_two_sided(statistic: Column, n: Column) -> Column:
    """Exact two-sided p of the smaller rank sum of ``n`` untied differences: subsets of 1..n are counted by their sum."""
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), lambda c, k: _plus(c, _moved(c, k)))
    return F.least(F.lit(1.0), 2 * _share_upto(counts, statistic))


def rank_sum_two_sided(u: Column, n_x: Column, n_y: Column) -> Column:
    """Exact two-sided p of the smaller U of two untied samples.

    Arrangements of j values of the one and i of the other are counted by U: either the largest is
    of the one and adds i, or it is of the other and adds nothing.
    """
    few, many = F.least(n_x, n_y).cast("int"), F.greatest(n_x, n_y).cast("int")
    one = F.array(F.lit(1.0))

    def longer(state: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), few), F.array(one), lambda acc, j: F.concat(acc, F.array(_plus(_moved(F.element_at(acc, -1), i), F.get(state, j)))))

    counts = F.element_at(F.aggregate(F.sequence(F.lit(1), many), F.array_repeat(one, few + 1), longer), -1)
    return F.least(F.lit(1.0), 2 * _share_upto(counts, u))
