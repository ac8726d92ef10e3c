"""Independence tests and moments from contingency aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chi_square(df: DataFrame, x: str, y: str, given: list[str] | None = None) -> DataFrame:
    """statistic, dof: summed over the states of the condition; expected counts from the margins, absent cells included."""
    z = given or []
    n = df.where(" and ".join(f"{c} is not null" for c in (x, y, *z))).groupBy(*z, x, y).agg(F.count("*").alias("n"))
    nx = n.groupBy(*z, x).agg(F.sum("n").alias("nx"))
    ny = n.groupBy(*z, y).agg(F.sum("n").alias("ny"))
    whole = n.groupBy(*z).agg(F.sum("n").alias("total"), F.countDistinct(x).alias("kx"), F.countDistinct(y).alias("ky")) if z else n.agg(F.sum("n").alias("total"), F.countDistinct(x).alias("kx"), F.countDistinct(y).alias("ky"))
    # sum over cells of (n - e)^2 / e  =  total * (sum of n^2 / (nx ny) - 1): the absent cells need no grid
    cells = n.join(nx, [*z, x]).join(ny, [*z, y])
    ratio = F.sum(F.col("n") * F.col("n") / (F.col("nx").cast("double") * F.col("ny"))).alias("r")
    by = cells.groupBy(*z).agg(ratio) if z else cells.agg(ratio)
    both = by.join(whole, z) if z else by.crossJoin(whole)
    return both.agg(F.sum(F.col("total") * (F.col("r") - 1)).alias("statistic"), F.sum((F.col("kx") - 1) * (F.col("ky") - 1)).cast("bigint").alias("dof"))


def chi_square_p(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function by series or continued fraction."""
    if dof <= 0:
        return 1.0
    a, x = dof / 2, statistic / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def partial_correlation(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    """r of x and y, or of their residuals on z."""
    if z is None:
        return df.agg(F.corr(x, y).alias("r"))
    rows = df.where(f"{x} is not null and {y} is not null and {z} is not null")
    c = rows.agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    return c.select(((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("r"))


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, covariance (sample) of all pairs, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("covariance")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """slope, intercept and residual variance (population) of a linear-Gaussian distribution with one parent."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (F.regr_syy(y, x) / F.regr_count(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x) / F.regr_count(y, x)).alias("variance"))
