"""Scalar functions: optimal hash counts, scale labels, bit lengths, t critical values, t probabilities."""

from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % critical values of Student's t for 1 to 10 degrees of freedom (fixed values).
T_CRITICAL = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228]


def bloom_k(bits_per_key: Column) -> Column:
    """The best number of hash functions for a budget of bits a key, 1 to 20."""
    return F.least(F.greatest((F.lit(0.693147) * bits_per_key + 0.5).cast("int"), F.lit(1)), F.lit(20))


def scale_label(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("M")))
        .when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def bit_length(n: Column) -> Column:
    """Binary digits of a number, 0 for 0."""
    return F.when(n <= 0, 0).otherwise(F.length(F.bin(n)))


def t_critical(df: Column) -> Column:
    table = F.array(*[F.lit(x) for x in T_CRITICAL])
    return F.when(df <= 0, F.lit(float("inf"))).when(df <= 10, F.get(table, (df - 1).cast("int"))).otherwise(F.lit(1.96))


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def t_two_tailed(t: float, df: float) -> float:
    return _beta(df / (df + t * t), df / 2, 0.5)


def t_probability() -> object:
    """A vectorised UDF (t, degrees of freedom) -> two-tailed probability; use after aggregation."""
    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(n) else t_two_tailed(abs(x), n) for x, n in zip(t, df)])

    return p
