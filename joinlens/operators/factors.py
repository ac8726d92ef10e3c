"""Discrete factors as long-form DataFrames: a column for each variable, and ``value``.

A cell that is absent has no value: products and divisions keep the cells that both sides have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variables(f: DataFrame) -> list[str]:
    return [c for c in f.columns if c != "value"]


def _joined(a: DataFrame, b: DataFrame, combine: Column) -> DataFrame:
    shared = [v for v in variables(a) if v in variables(b)]
    right = b.withColumnRenamed("value", "__other")
    both = a.join(right, shared) if shared else a.crossJoin(right)  # factors without a common variable: the product is the result
    names = [*variables(a), *(v for v in variables(b) if v not in shared)]
    return both.select(*names, combine.alias("value"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    return _joined(a, b, F.col("value") * F.col("__other"))


def total(a: DataFrame, b: DataFrame) -> DataFrame:
    return _joined(a, b, F.col("value") + F.col("__other"))


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """0/0 is 0; a value over 0 is null."""
    return _joined(a, b, F.when((F.col("__other") == 0) & (F.col("value") == 0), F.lit(0.0)).otherwise(F.try_divide("value", "__other")))


def marginalize(f: DataFrame, out: list[str]) -> DataFrame:
    keep = [v for v in variables(f) if v not in out]
    return f.groupBy(*keep).agg(F.sum("value").alias("value"))


def maximize(f: DataFrame, out: list[str]) -> DataFrame:
    keep = [v for v in variables(f) if v not in out]
    return f.groupBy(*keep).agg(F.max("value").alias("value"))


def reduce(f: DataFrame, evidence: dict[str, object]) -> DataFrame:
    """The slice at the evidence (a value or a list of values); a variable with a single value leaves the factor."""
    for v, x in evidence.items():
        f = f.where(F.col(v).isin(list(x)) if isinstance(x, list | tuple | set) else F.col(v) == x)
        if not isinstance(x, list | tuple | set):
            f = f.drop(v)
    return f


def normalize(f: DataFrame) -> DataFrame:
    whole = f.agg(F.sum("value").alias("__sum"))  # a row
    return f.crossJoin(whole).select(*variables(f), F.try_divide("value", "__sum").alias("value"))


def conditional(f: DataFrame, parents: list[str]) -> DataFrame:
    """Each parent state's values sum to one; the sums are aggregated before they meet the cells again."""
    sums = f.groupBy(*parents).agg(F.sum("value").alias("__sum")) if parents else f.agg(F.sum("value").alias("__sum"))
    both = f.join(sums, parents) if parents else f.crossJoin(sums)
    return both.select(*variables(f), F.try_divide("value", "__sum").alias("value"))


def identity(f: DataFrame) -> DataFrame:
    return f.withColumn("value", F.lit(1.0))


def assignment(f: DataFrame, index: int) -> DataFrame:
    """The cell at a place in the order of the variables' states."""
    order = Window.orderBy(*variables(f))
    return f.withColumn("__i", F.row_number().over(order) - 1).where(F.col("__i") == index).drop("__i")  # a factor is small: it has cells, not rows of a table


def counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(" and ".join(f"{c} is not null" for c in columns)).groupBy(*columns).agg(F.count("*").cast("double").alias("value"))


def product_all(factors: list[DataFrame]) -> DataFrame:
    out = factors[0]
    for f in factors[1:]:
        out = product(out, f)
    return out


def marginalize_set(factors: list[DataFrame], out: list[str]) -> list[DataFrame]:
    """A lazy set: the factors that hold a variable are multiplied before it is summed out."""
    for v in out:
        own = [f for f in factors if v in variables(f)]
        rest = [f for f in factors if v not in variables(f)]
        factors = [*rest, marginalize(product_all(own), [v])] if own else rest
    return factors


def partition_function(factors: list[DataFrame]) -> DataFrame:
    """partition: the sum of the product of all factors, a variable at a time."""
    names = sorted({v for f in factors for v in variables(f)})
    left = marginalize_set(factors, names)
    out = left[0].select("value")
    for f in left[1:]:
        out = out.crossJoin(f.select(F.col("value").alias("__v"))).select((F.col("value") * F.col("__v")).alias("value"))  # a row each
    return out.withColumnRenamed("value", "partition")


def independence_gap(joint: DataFrame, x: str, y: str, given: list[str] | None = None) -> DataFrame:
    """gap: the largest |P(xyz) P(z) - P(xz) P(yz)| over the table's states; 0 if x and y are independent given z."""
    z = given or []
    p = normalize(marginalize(joint, [v for v in variables(joint) if v not in (x, y, *z)]))
    pz = marginalize(p, [x, y]).withColumnRenamed("value", "pz")
    pxz = marginalize(p, [y]).withColumnRenamed("value", "pxz")
    pyz = marginalize(p, [x]).withColumnRenamed("value", "pyz")
    grid = pxz.join(pyz, z) if z else pxz.crossJoin(pyz)  # states of two variables
    grid = grid.join(pz, z) if z else grid.crossJoin(pz)
    both = grid.join(p, [x, y, *z], "left")
    return both.agg(F.max(F.abs(F.coalesce("value", F.lit(0.0)) * F.col("pz") - F.col("pxz") * F.col("pyz"))).alias("gap"))


def minimal_map(joint: DataFrame, order: list[str], tolerance: float = 1e-6) -> list[tuple[str, str]]:
    """Edges of a minimal independence map for an order of the variables: each node's parents are the first smallest set of its predecessors that separates it from the others."""
    from itertools import combinations

    out: list[tuple[str, str]] = []
    for i, x in enumerate(order):
        before = order[:i]
        for size in range(len(before) + 1):
            hit = next((z for z in combinations(before, size) if all(independence_gap(joint, x, y, list(z)).first()[0] <= tolerance for y in before if y not in z)), None)
            if hit is not None:
                out += [(p, x) for p in hit]
                break
    return out
