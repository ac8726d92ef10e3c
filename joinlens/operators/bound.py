"""Upper bounds of join sizes from per-bin masses and most frequent values.

A relation in play is a sparse factor: a DataFrame with a column bin_<group> for each open key group, the
mass of rows in the cell, and mode_<group>: how often one key value occurs in the cell at most. Cells without
rows aren't stored, so any number of keys works. Eliminating a group joins the factors that hold it on all
bins they share and sums the kernel over the group's bins:

    out = min over i of P_i * product over j != i of V'_j,   V' = min(P, V)

Modes of groups that stay open grow with the fan-out of the join ("scaled"), which keeps the bound valid
over several groups; "unscaled" keeps the base table's modes, which is often closer but no bound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.operators.binning import modulo_bin
from joinlens.plans.parser import Query, parse
from joinlens.schema import SchemaGraph

Binner = Callable[[int, Column], Column]


@dataclass(frozen=True)
class Factor:
    df: DataFrame
    groups: tuple[int, ...]
    members: frozenset[str]


def _product(items: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, items, F.lit(1.0))


def base_factor(df: DataFrame, alias: str, keys: dict[int, list[str]], binner: Binner) -> Factor:
    """A filtered table as a factor. keys: the columns of each group; columns of one group are equal in every joined row."""
    rows = df
    for columns in keys.values():
        for c in columns:
            rows = rows.where(F.col(c).isNotNull())
        for c in columns[1:]:
            rows = rows.where(F.col(c) == F.col(columns[0]))
    groups = tuple(sorted(keys))
    named = rows.select(*[F.col(keys[g][0]).alias(f"key_{g}") for g in groups], *[binner(g, F.col(keys[g][0])).alias(f"bin_{g}") for g in groups])
    bins = [f"bin_{g}" for g in groups]
    if not groups:
        return Factor(named.agg(F.count("*").cast("double").alias("mass")), (), frozenset({alias}))
    # Counts of the keys' distinct combinations: one shuffle of the rows serves mass and modes.
    counts = named.groupBy(*bins, *[f"key_{g}" for g in groups]).agg(F.count("*").alias("n"))
    out = counts.groupBy(*bins).agg(F.sum("n").cast("double").alias("mass"), *([F.max("n").cast("double").alias(f"mode_{groups[0]}")] if len(groups) == 1 else []))
    if len(groups) > 1:
        for g in groups:
            modes = counts.groupBy(*bins, f"key_{g}").agg(F.sum("n").alias("n")).groupBy(*bins).agg(F.max("n").cast("double").alias(f"mode_{g}"))
            out = out.join(modes, bins)
    return Factor(out, groups, frozenset({alias}))


def kernel(masses: list[Column], modes: list[Column]) -> Column:
    """The bound of one bin."""
    capped = [F.least(p, v) for p, v in zip(masses, modes, strict=True)]
    terms = [_product([p, *(v for j, v in enumerate(capped) if j != i)]) for i, p in enumerate(masses)]
    return F.least(*terms) if len(terms) > 1 else terms[0]


def eliminate(factors: list[Factor], group: int, rule: str = "scaled") -> list[Factor]:
    """Join all factors that hold the group into one without it."""
    own = [f for f in factors if group in f.groups]
    rest = [f for f in factors if group not in f.groups]
    joined, seen = None, []
    for i, f in enumerate(own):
        part = f.df.select(*[f"bin_{g}" for g in f.groups], F.col("mass").alias(f"mass_{i}"), *[F.col(f"mode_{g}").alias(f"mode_{g}_{i}") for g in f.groups])
        if joined is None:
            joined, seen = part, list(f.groups)
        else:
            joined = joined.join(part, [f"bin_{g}" for g in f.groups if g in seen])
            seen += [g for g in f.groups if g not in seen]
    masses = [F.col(f"mass_{i}") for i in range(len(own))]
    modes = [F.col(f"mode_{group}_{i}") for i in range(len(own))]
    capped = [F.least(p, v) for p, v in zip(masses, modes, strict=True)]
    open_groups = tuple(sorted(g for g in seen if g != group))
    cells = joined.withColumn("__out", kernel(masses, modes))
    per_mode = []
    for g in open_groups:
        for i, f in enumerate(own):
            if g in f.groups:
                fan = _product([v for j, v in enumerate(capped) if j != i]) if rule == "scaled" else F.lit(1.0)
                name = f"mode_{g}_from_{i}"
                cells = cells.withColumn(f"__{name}", F.col(f"mode_{g}_{i}") * fan)
                # A value can lie in many of the eliminated group's bins: its multiplicities add up.
                per_mode.append((F.sum if rule == "scaled" else F.max)(f"__{name}").alias(name))
    bins = [f"bin_{g}" for g in open_groups]
    total = F.sum("__out").alias("mass")
    out = cells.groupBy(*bins).agg(total, *per_mode) if bins else cells.agg(F.coalesce(F.sum("__out"), F.lit(0.0)).alias("mass"))
    for g in open_groups:
        sources = [F.col(f"mode_{g}_from_{i}") for i, f in enumerate(own) if g in f.groups]
        out = out.withColumn(f"mode_{g}", F.least(F.col("mass"), *sources))
    out = out.select(*bins, "mass", *[f"mode_{g}" for g in open_groups])
    return [*rest, Factor(out, open_groups, frozenset().union(*(f.members for f in own)))]


def order(factors: list[Factor]) -> int:
    """The next group to eliminate: the one whose result has the fewest open groups, then the fewest factors, then the smallest number."""
    groups = sorted({g for f in factors for g in f.groups})

    def cost(g: int) -> tuple:
        own = [f for f in factors if g in f.groups]
        return len({x for f in own for x in f.groups} - {g}), len(own), g

    return min(groups, key=cost)


def combine(factors: list[Factor], rule: str = "scaled") -> DataFrame:
    """One row, bound: all groups eliminated; parts without a common key multiply."""
    while any(f.groups for f in factors):
        factors = eliminate(factors, order(factors), rule)
    out = factors[0].df.select("mass")
    for f in factors[1:]:
        out = out.select(F.col("mass").alias("m")).crossJoin(f.df.select("mass")).select((F.col("m") * F.col("mass")).alias("mass"))  # a row each
    return out.select(F.col("mass").alias("bound"))


def scaled(factor: Factor, rate: float, rows: int | None = None) -> Factor:
    """A sample's factor as one of its whole table: masses grow by the rate, at most to the table's rows. Modes of a sample grow too where a value occurred more than once."""
    if rate >= 1:
        return factor
    grown = factor.df.withColumn("mass", F.col("mass") / rate)
    for g in factor.groups:
        m = F.col(f"mode_{g}")
        grown = grown.withColumn(f"mode_{g}", F.least(F.col("mass"), F.when(m > 1, m / rate).otherwise(m)))
    if rows is not None:
        whole = grown.agg(F.sum("mass").alias("__whole"))
        grown = grown.crossJoin(whole).withColumn("mass", F.col("mass") * F.least(F.lit(1.0), F.lit(float(rows)) / F.col("__whole"))).drop("__whole")  # a row
    return Factor(grown, factor.groups, factor.members)


def estimate_from_samples(query: Query, samples: dict[str, tuple[DataFrame, float]], bins: int = 64, rule: str = "scaled") -> DataFrame:
    """bound: an estimate, no longer an upper bound, from (sample, rate) of each table."""
    out = []
    for f in base_factors(query, lambda name: samples[name][0], bins):
        (alias,) = f.members
        out.append(scaled(f, samples[query.aliases[alias]][1]))
    return combine(out, rule)


def base_factors(query: Query, tables: Callable[[str], DataFrame], bins: int = 64, binner: Binner | None = None, only: set[str] | None = None) -> list[Factor]:
    groups = query.key_groups()
    binner = binner or (lambda g, c: modulo_bin(c, bins))
    out = []
    for alias, name in sorted(query.aliases.items()):
        if only is not None and alias not in only:
            continue
        df = tables(name).alias(alias)
        for p in query.filters(alias):
            df = df.where(F.expr(p))
        keys: dict[int, list[str]] = {}
        for g, members in enumerate(groups):
            own = [c for a, c in members if a == alias]
            others = [a for a, _ in members if a != alias and (only is None or a in only)]
            if own and (others or len(own) > 1):
                keys[g] = own
        columns = sorted({c for k in keys.values() for c in k})
        out.append(base_factor(df.select(*columns), alias, keys, binner))
    return out


def estimate(spark: SparkSession, sql: str, tables: Callable[[str], DataFrame] | None = None, schema: SchemaGraph | None = None, bins: int = 64, rule: str = "scaled", binner: Binner | None = None) -> DataFrame:
    """bound: an upper bound of the query's count. Predicates over several aliases are left out, which keeps it a bound."""
    query = parse(sql, schema)
    return combine(base_factors(query, tables or spark.table, bins, binner), rule)


def true_count(spark: SparkSession, sql: str) -> DataFrame:
    """The count itself, by Spark's own joins."""
    return spark.sql(parse(sql).sql("COUNT(*) AS true_count"))


def subplan_bounds(spark: SparkSession, sql: str, tables: Callable[[str], DataFrame] | None = None, bins: int = 64, rule: str = "scaled") -> DataFrame:
    """aliases, bound for every connected sub-plan of two aliases or more.

    Each table is scanned once for each set of keys it takes part with; plans share exchanges through Spark's reuse.
    """
    from joinlens.plans.planner import connected_subsets

    query = parse(sql)
    out = None
    for subset in connected_subsets(query):
        if len(subset) < 2:
            continue
        row = combine(base_factors(query, tables or spark.table, bins, only=set(subset)), rule).select(F.lit(" ".join(sorted(subset))).alias("aliases"), "bound")
        out = row if out is None else out.unionByName(row)
    return out


def flagship_row(spark: SparkSession, sql: str, bins: int = 64) -> DataFrame:
    """query, estimate, truth, q_error."""
    both = estimate(spark, sql, bins=bins).crossJoin(true_count(spark, sql))  # a row each
    e, t = F.greatest(F.col("bound"), F.lit(1.0)), F.greatest(F.col("true_count").cast("double"), F.lit(1.0))
    return both.select(F.lit(sql).alias("query"), F.col("bound").alias("estimate"), F.col("true_count").alias("truth"), F.greatest(e / t, t / e).alias("q_error"))
