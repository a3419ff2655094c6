"""Scalar and vector expressions; every one stays inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str, places: int = 6) -> Column:
    """Half-even rounding, as tables are reported."""
    return F.bround(F.col(c) if isinstance(c, str) else c, places)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0 or null (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null if the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def l2_normalise(a: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda v: v.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def ln_factorial(n: Column) -> Column:
    """ln n! in closed form: exact to 1e-12 from Stirling's series, small n by products.

    A table of log-factorials would have to hold as many numbers as the collection has
    rows; the series costs the same for any n.
    """
    x = n.cast("double") + 1
    shift = F.greatest(F.lit(0.0), 10 - x)  # ln Gamma(x) = ln Gamma(x + m) - ln(x (x+1) ... (x+m-1))
    m = F.ceil(shift)
    z = x + m
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * F.pow(z, F.lit(7)))
    product = F.lit(1.0)
    for k in range(10):
        product = product * F.when(F.lit(k) < m, x + k).otherwise(F.lit(1.0))
    return series - F.log(product)


def hypergeom_tail(k: Column, n_total: Column, n_term: Column, n_cluster: Column) -> Column:
    """P(X >= k) for X hypergeometric: ``n_cluster`` drawn from ``n_total`` of which ``n_term`` are marked.

    The tail is summed away from the mode by the ratio of neighbouring terms and stops
    after 14 standard deviations, so its cost grows with the spread, not with the counts.
    """
    big, sub, draw, obs = (c.cast("double") for c in (n_total, n_term, n_cluster, k))
    low, high = F.greatest(F.lit(0.0), sub + draw - big), F.least(sub, draw)
    mean = draw * sub / big
    var = draw * (sub / big) * (1 - sub / big) * F.coalesce(F.try_divide(big - draw, big - 1), F.lit(0.0))
    reach = F.ceil(14 * F.sqrt(F.greatest(var, F.lit(0.0)))) + 60

    def ln_term(i: Column) -> Column:
        return ln_factorial(sub) - ln_factorial(i) - ln_factorial(sub - i) + ln_factorial(big - sub) - ln_factorial(draw - i) - ln_factorial(big - sub - draw + i) - ln_factorial(big) + ln_factorial(draw) + ln_factorial(big - draw)

    def total(start: Column, steps: Column, up: bool) -> Column:
        def step(acc: Column, j: Column) -> Column:
            i = start + j if up else start - j
            term = acc["term"]
            factor = (sub - i) * (draw - i) / ((i + 1) * (big - sub - draw + i + 1)) if up else i * (big - sub - draw + i) / ((sub - i + 1) * (draw - i + 1))
            return F.struct((acc["sum"] + term).alias("sum"), (term * factor).alias("term"))

        first = F.struct(F.lit(0.0).alias("sum"), F.exp(ln_term(start)).alias("term"))
        return F.aggregate(F.sequence(F.lit(0), steps.cast("int")), first, step)["sum"]

    above = total(obs, F.least(high - obs, reach), True)
    below = total(obs - 1, F.least(obs - 1 - low, reach), False)
    p = F.when(obs <= low, 1.0).when(obs > high, 0.0).when(obs > mean, above).otherwise(1 - below)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def binomial_tail_half(k: Column, n: Column) -> Column:
    """P(X >= k) for n fair coins."""
    term = lambda i: F.exp(ln_factorial(n) - ln_factorial(i) - ln_factorial(n - i) - n * math.log(2))
    return F.when(k > n, 0.0).otherwise(F.aggregate(F.sequence(F.least(k, n).cast("int"), n.cast("int")), F.lit(0.0), lambda a, i: a + term(i)))


def sign_test_p(negative: Column, positive: Column, n: Column) -> Column:
    """Two-sided exact sign test; ties count in ``n`` but for neither sign."""
    return F.when(n == 0, F.lit(None)).otherwise(F.least(F.lit(1.0), 2 * binomial_tail_half(F.greatest(F.greatest(negative, positive), n - F.greatest(negative, positive)), n)))
