"""Statistics of benchmark results: means, paired differences, rank sums, outliers, confidence intervals."""

from math import erf, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runweave.functions.scalar import t_critical, t_probability


def mean_sd(d: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean and sample sd (0 below two values)."""
    return d.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def pair(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
    """Rows of a and b matched by on, with columns a and b; fails on repeated or unmatched rows."""
    x = a.groupBy(*on).agg(F.first("value").alias("a"), F.count("*").alias("na"))
    y = b.groupBy(*on).agg(F.first("value").alias("b"), F.count("*").alias("nb"))
    both = x.join(y, list(on), "full")
    good = (F.coalesce("na", F.lit(0)) == 1) & (F.coalesce("nb", F.lit(0)) == 1)
    return both.withColumn("a", F.when(good, F.col("a")).otherwise(F.raise_error(F.lit("repeated or incomplete pairing")).cast("double"))).select(*on, "a", "b")


def paired(d: DataFrame, *by: str) -> DataFrame:
    """n, mean and sd of a - b, t and the 95 % interval, for rows with columns a and b."""
    diff = F.col("a") - F.col("b")
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.coalesce(F.stddev_samp(diff), F.lit(0.0)).alias("sd_diff"))
    half = t_critical(F.col("n") - 1) * F.col("sd_diff") / F.sqrt("n")
    t = F.when(F.col("sd_diff") >= 1e-12, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n")))
    return g.withColumn("t", t).withColumn("ci_low", F.col("mean_diff") - half).withColumn("ci_high", F.col("mean_diff") + half)


def paired_p(d: DataFrame, *by: str) -> DataFrame:
    """Adds p: two-tailed, within [0.0001, 1]; without variance 1 for no difference, else 0.0001."""
    p = t_probability()
    g = paired(d, *by)
    clamped = F.greatest(F.lit(0.0001), F.least(F.lit(1.0), p(F.abs("t"), (F.col("n") - 1).cast("double"))))
    flat = F.when(F.abs("mean_diff") < 1e-9, F.lit(1.0)).otherwise(F.lit(0.0001))
    return g.withColumn("p", F.when(F.col("n") < 2, F.lit(1.0)).when(F.col("t").isNull(), flat).otherwise(clamped))


def rank_sums(d: DataFrame, value: str, side: str, *by: str) -> DataFrame:
    """n1, n2, u and z of sides 1 and 2, with average ranks for ties.

    Equal values are counted first, so the ranking runs over distinct values.
    """
    g = d.groupBy(*by, value).agg(F.count_if(F.col(side) == 1).alias("c1"), F.count_if(F.col(side) == 2).alias("c2"))
    w = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    size = F.col("c1") + F.col("c2")
    g = g.withColumn("rank", F.coalesce(F.sum(size).over(w), F.lit(0)) + (size + 1) / 2)
    s = g.groupBy(*by).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.sum(F.col("rank") * F.col("c1")).alias("r1"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")  # their products can leave BIGINT from 3.4 million rows a group on
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = F.least(u1, n1 * n2 - u1)
    sigma = F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    z = F.try_divide(u - n1 * n2 / 2, sigma)
    return s.select(*by, "n1", "n2", u.alias("u"), z.alias("z"))


# Exact two-tailed values for sides of at most three, up to each u (fixed values).
SMALL_SIDES = [(0.01, 0.1), (1.01, 0.2), (2.01, 0.4), (3.01, 0.6), (4.01, 0.8)]


def rank_sum_p(d: DataFrame, value: str, side: str, *by: str) -> DataFrame:
    """Adds p: tabled for sides of at most three, else of the normal approximation, within [0.0001, 1].

    With fewer than two values on a side, or values all alike, p is 1.
    """
    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: 1.0 if pd.isna(x) else 2 * (1 - 0.5 * (1 + erf(abs(x) / sqrt(2)))))

    g = rank_sums(d, value, side, *by)
    normal = F.greatest(F.lit(0.0001), F.least(F.lit(1.0), tail("z")))
    small = F.lit(1.0)
    for u, p in reversed(SMALL_SIDES):
        small = F.when(F.col("u") <= u, p).otherwise(small)
    p = F.when((F.col("n1") < 2) | (F.col("n2") < 2), F.lit(1.0)).when((F.col("n1") <= 3) & (F.col("n2") <= 3), small).otherwise(normal)
    return g.withColumn("p", p)


def outliers(d: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds outlier: beyond two sample sds from the group's mean, with three values or more and an sd of at least 1e-9."""
    groups = d.groupBy(*by).agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd")).alias("g")
    on = [F.col(f"d.{b}").eqNullSafe(F.col(f"g.{b}")) for b in by]
    both = d.alias("d").join(groups, on) if by else d.alias("d").crossJoin(F.broadcast(groups))  # one row
    off = F.abs(F.col(f"d.{value}") - F.col("_mean")) > 2 * F.col("_sd")
    return both.select("d.*", F.when((F.col("_n") >= 3) & (F.col("_sd") >= 1e-9), F.coalesce(off, F.lit(False))).otherwise(F.lit(False)).alias("outlier"))
