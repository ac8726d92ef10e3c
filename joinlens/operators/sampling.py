"""Base-table samples and the distributions of key bins that they give."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_TABLE = 1000


@dataclass(frozen=True)
class Sample:
    df: DataFrame
    rate: float  # the real one: 1 for a table that was small enough to keep


def modulo_sample(df: DataFrame, key: str, every: int, rows: int | None = None) -> Sample:
    """Rows whose key is divisible: the same on every engine and partitioning."""
    if rows is not None and rows < SMALL_TABLE:
        return Sample(df, 1.0)
    return Sample(df.where(F.pmod(key, F.lit(every)) == 0), 1.0 / every)


def hash_sample(df: DataFrame, key: str, percent: float, seed: int = 0, rows: int | None = None) -> Sample:
    """Rows by a hash of their key: repeatable, whatever the partitioning."""
    if rows is not None and rows < SMALL_TABLE:
        return Sample(df, 1.0)
    bound = int(percent * 10_000)
    return Sample(df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < bound), bound / 1_000_000)


def bernoulli_sample(df: DataFrame, percent: float, seed: int = 0, rows: int | None = None) -> Sample:
    if rows is not None and rows < SMALL_TABLE:
        return Sample(df, 1.0)
    return Sample(df.sample(False, percent / 100, seed), percent / 100)


def key_sample(df: DataFrame, key: str, limit: int = 1_000_000, seed: int = 0) -> Sample:
    """About ``limit`` rows of a key at most (the operator's own bound), by a hash of key and row content."""
    n = df.where(F.col(key).isNotNull()).count()
    if n <= limit:
        return Sample(df.where(F.col(key).isNotNull()), 1.0)
    rate = limit / n
    return Sample(df.where(F.col(key).isNotNull()).where(F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000)), rate)


def binned_counts(df: DataFrame, predicate: str | None, bins: dict[str, Column]) -> DataFrame:
    """key, bin, n for every key of an alias, from one scan: grouping sets over its bin columns. A null bin stays null."""
    rows = df.where(F.expr(predicate)) if predicate else df
    named = rows.select(*[b.cast("int").alias(k) for k, b in bins.items()])
    names = list(bins)
    if len(names) == 1:
        return named.groupBy(F.col(names[0]).alias("bin")).agg(F.count("*").alias("n")).select(F.lit(names[0]).alias("key"), "bin", "n")
    grouped = named.groupingSets([[F.col(c)] for c in names], *[F.col(c) for c in names]).agg(F.count("*").alias("n"), F.grouping_id().alias("__g"))
    key, value = F.lit(None).cast("string"), F.lit(None).cast("int")
    full = (1 << len(names)) - 1
    for i, c in enumerate(names):
        hit = F.col("__g") == full & ~(1 << (len(names) - 1 - i))
        key, value = F.when(hit, c).otherwise(key), F.when(hit, F.col(c)).otherwise(value)
    return grouped.select(key.alias("key"), value.alias("bin"), "n")


def scaled_factor(counts: DataFrame, rate: float, full_rows: int, unfiltered: DataFrame | None = None) -> DataFrame:
    """bin, mass: a sample's counts as rows of the whole table, at most ``full_rows`` together. An empty sample counts as one row, spread as without a filter."""
    rows = counts.where("bin is not null")
    whole = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    length = F.least(F.lit(float(full_rows)), F.col("total") / rate)
    out = rows.crossJoin(whole).select("bin", (F.col("n") / F.col("total") * length).alias("mass"))
    if unfiltered is None:
        return out
    share = unfiltered.crossJoin(unfiltered.agg(F.sum("n").alias("u"))).crossJoin(whole.where("total = 0")).select("bin", (F.col("n") / F.col("u")).alias("mass"))
    return out.unionByName(share)


def unfiltered_factor(df: DataFrame, key: str, bin_of: Column) -> DataFrame:
    """bin, probability, table_rows, non_null_frac without a filter."""
    counts = df.groupBy(bin_of.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count(key).alias("k"))
    whole = counts.agg(F.sum("n").alias("table_rows"), F.sum("k").alias("keys"))
    return counts.where("bin is not null").crossJoin(whole).select("bin", F.try_divide("n", "keys").alias("probability"), "table_rows", F.try_divide("keys", "table_rows").alias("non_null_frac"))
