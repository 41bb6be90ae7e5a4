"""Statistics as column expressions. Undefined values are null, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def rate(part: Column, whole: Column, per: float = 1.0) -> Column:
    return F.try_divide(part * F.lit(float(per)), whole)


def log_likelihood(a: Column, b: Column, n1: Column, n2: Column) -> Column:
    """Signed G2 of counts a of n1 and b of n2: positive if a is the larger share; 0 if a total or both counts are 0."""
    both, total = (a + b).cast("double"), (n1 + n2).cast("double")
    term = lambda x, n: F.when(x > 0, x * F.ln(x * total / (n * both))).otherwise(F.lit(0.0))
    sign = F.when(a * n2 >= b * n1, 1.0).otherwise(-1.0)
    return F.when((n1 > 0) & (n2 > 0) & (a + b > 0), sign * 2.0 * (term(a, n1) + term(b, n2))).otherwise(F.lit(0.0))


def log_ratio(a: Column, b: Column, n1: Column, n2: Column) -> Column:
    """log2 of the ratio of shares, a count of 0 as a half; 0 if a total is 0."""
    half = F.lit(0.5)
    return F.when((n1 > 0) & (n2 > 0), F.log2((F.greatest(a.cast("double"), half) / n1) / (F.greatest(b.cast("double"), half) / n2))).otherwise(F.lit(0.0))


def zero_ceiling(n: Column, alpha: float = 0.05) -> Column:
    """The largest rate that n trials without a hit don't exclude."""
    return F.when(n > 0, 1 - F.pow(F.lit(alpha), 1 / n)).otherwise(F.lit(1.0))


def informative_minimum(p: Column, alpha: float = 0.05) -> Column:
    """Trials from which on zero hits tell something at rate p."""
    return F.greatest(F.lit(1), F.ceil(F.lit(math.log(alpha)) / F.log1p(-p)).cast("int"))


def pmi(joint: Column, a: Column, b: Column, n: Column) -> Column:
    return F.log2((joint / n) / ((a / n) * (b / n)))


def npmi(joint: Column, a: Column, b: Column, n: Column) -> Column:
    """pmi over its largest value; 1 for a pair in every document."""
    return F.when(joint == n, F.lit(1.0)).otherwise(pmi(joint, a, b, n) / -F.log2(joint / n))


def wilson(count: Column, n: Column) -> Column:
    p = count / n
    z2 = Z95**2
    base = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / base
    margin = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / base
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - margin).alias("low"), F.least(F.lit(1.0), centre + margin).alias("high")))


def poisson_interval(count: Column, exposure: Column) -> Column:
    r = count / exposure
    factor = F.exp(Z95 / F.sqrt(F.greatest(count, F.lit(1))))
    low = F.when(count == 0, 0.0).otherwise(r / factor)
    high = F.when(count == 0, -math.log(0.05) / exposure).otherwise(r * factor)
    return F.when(exposure > 0, F.struct(low.alias("low"), high.alias("high")))


def binomial_likelihood(k: Column, n: Column) -> Column:
    """Of k successes in n trials at their own rate."""
    part = lambda x: F.when(x > 0, x * F.ln(x / n)).otherwise(F.lit(0.0))
    return part(k.cast("double")) + part((n - k).cast("double"))


def poisson_likelihood(k: Column, exposure: Column) -> Column:
    return F.when(k > 0, k * F.ln(k / exposure.cast("double")) - k).otherwise(F.lit(0.0))


def hash_order(seed: int | Column, salt: str, key: Column) -> Column:
    """The key that every sample is ordered by: MD5 of seed, salt and id."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(seed.cast("string"), F.lit(f":{salt}:"), key.cast("string")))
