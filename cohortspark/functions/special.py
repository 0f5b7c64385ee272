"""Tails of distributions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series, and steps of the continued fraction.
TERMS, STEPS = 40, 300


def _sum(n: int, term) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0.0), lambda s, k: s + term(k.cast("double")))


def array_ranks(values: Column) -> Column:
    """Ranks from 1 of an array's values, ties averaged, in the order of the array."""
    below = lambda x: F.size(F.filter(values, lambda y: y < x))
    return F.transform(values, lambda x: below(x) + (F.size(F.filter(values, lambda y: y == x)) + 1) / 2)


def array_spearman(a: Column, b: Column) -> Column:
    """Rank correlation of two arrays of one row, ties averaged; constant arrays: 1 if both are, else 0; null if lengths differ or are 0."""
    n = F.size(a)
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    middle = (n + 1) / 2
    ra, rb = (F.transform(array_ranks(x), lambda v: v - middle) for x in (a, b))
    spread = lambda x: add(F.transform(x, lambda v: v * v))
    flat_a, flat_b = F.array_min(a) == F.array_max(a), F.array_min(b) == F.array_max(b)
    told = add(F.zip_with(ra, rb, lambda u, v: u * v)) / F.sqrt(spread(ra) * spread(rb))
    return F.when((n != F.size(b)) | (n == 0), None).when(flat_a & flat_b, 1.0).when(flat_a | flat_b, 0.0).otherwise(told)


def kolmogorov_tail(x: Column) -> Column:
    """P(K > x) of Kolmogorov's distribution: the alternating series from 1 on, its theta transform below, both to full precision."""
    safe = F.greatest(x, F.lit(0.04))  # below, the tail is 1 to the last bit
    low = 1 - math.sqrt(2 * math.pi) / safe * _sum(TERMS, lambda k: F.exp(-((2 * k - 1) * (2 * k - 1)) * (math.pi**2 / 8) / (safe * safe)))
    high = 2 * _sum(TERMS, lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * safe * safe))
    return F.when(x.isNull() | F.isnan(x), None).when(x < 1, F.least(F.greatest(low, F.lit(0.0)), F.lit(1.0))).otherwise(F.greatest(high, F.lit(0.0)))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 12, less the logarithms of the factors between."""
    y = x + 12.0
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square * (1 / 1188)))))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(1.0), lambda p, k: p * (x + k)))


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), 0 < x < 1, by its continued fraction on the side where that converges fast."""
    turned = x > (a + 1) / (a + b + 2)
    p, q, z = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b), F.when(turned, 1 - x).otherwise(x)
    tiny = F.lit(1e-300)
    full = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    start = F.struct(p.alias("p"), q.alias("q"), z.alias("z"), F.lit(1.0).alias("c"), (1 / full(1 - (p + q) * z / (p + 1))).alias("d"), (1 / full(1 - (p + q) * z / (p + 1))).alias("h"))

    def half(s: Column, by: Column) -> Column:
        d, c = 1 / full(1 + by * s["d"]), full(1 + by / s["c"])
        return F.struct(s["p"].alias("p"), s["q"].alias("q"), s["z"].alias("z"), c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s: Column, k: Column) -> Column:
        """Even steps and odd ones of Lentz's method take turns."""
        m = F.floor((k + 1) / 2).cast("double")
        even = m * (s["q"] - m) * s["z"] / ((s["p"] + 2 * m - 1) * (s["p"] + 2 * m))
        n = F.floor(k / 2).cast("double")
        odd = -(s["p"] + n) * (s["p"] + s["q"] + n) * s["z"] / ((s["p"] + 2 * n) * (s["p"] + 2 * n + 1))
        return half(s, F.when(k % 2 == 1, even).otherwise(odd))

    h = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])
    front = F.exp(p * F.ln(z) + q * F.ln(1 - z) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / p
    return F.when(turned, 1 - front * h).otherwise(front * h)


def t_two_sided(t: Column, degrees: Column) -> Column:
    """P(|T| > |t|) of Student's distribution; 1 at t = 0, 0 at infinity, null without degrees of freedom."""
    n = degrees.cast("double")
    x = n / (n + t * t)
    tail = incomplete_beta(n / 2, F.lit(0.5), F.when((x > 0) & (x < 1), x).otherwise(0.5))
    return F.when((n <= 0) | t.isNull() | F.isnan(t), None).when(x >= 1, 1.0).when(x <= 0, 0.0).otherwise(tail)
