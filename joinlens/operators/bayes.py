"""Tree-shaped Bayesian networks of a table, learned from aggregates.

All pair counts come from one pass with grouping sets; the driver sees mutual informations (a number for
each pair of columns), never rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinlens.operators import factors

CONTINUOUS_ABOVE = 1000


def attribute_types(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """column, n_distinct, kind: categorical, boolean (two values) or continuous (over CONTINUOUS_ABOVE values); keys are categorical."""
    one = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    rows = one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column_name", "n_distinct"))
    n = F.col("n_distinct")
    kind = F.when(F.col("column_name").isin(keys or []), "categorical").when(n == 2, "boolean").when(n > CONTINUOUS_ABOVE, "continuous").otherwise("categorical")
    return rows.withColumn("kind", kind)


def quantile_edges(df: DataFrame, column: str, bins: int, exact: bool = True) -> list[float]:
    """Distinct edges of equal-mass bins; approximate ones don't sort the column."""
    at = [i / bins for i in range(bins + 1)]
    if exact:
        found = df.agg(F.percentile(column, F.array(*map(F.lit, at))).alias("e")).first()["e"]
    else:
        found = df.approxQuantile(column, at, 1 / (4 * bins))
    return sorted(set(found or []))


def interval_bin(c: Column, edges: list[float]) -> Column:
    """Number of the half-open interval (the last is closed); null outside."""
    inside = F.size(F.filter(F.array(*map(F.lit, edges[1:-1])), lambda e: e <= c)) if len(edges) > 2 else F.lit(0)
    return F.when(c.between(edges[0], edges[-1]), inside)


def common_value_codes(df: DataFrame, column: str, common: int = 30, bins: int = 60) -> DataFrame:
    """For categorical columns, which have CONTINUOUS_ABOVE values at most: value, n, code, share. The ``common`` most frequent values have codes of their own; the others, in value order, share up to ``bins`` of about equal mass. share: the value's part of its code's rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    # Ordered by frequency without one task for all values: only the common ones are ranked.
    top = counts.orderBy(F.desc("n"), "value").limit(common)
    ranked = top.select("value", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1).alias("code"))
    rest = counts.join(ranked.select("value"), "value", "left_anti")
    whole = rest.agg(F.sum("n").alias("__all"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    packed = rest.crossJoin(whole).select("value", "n", (F.lit(common) + F.floor(before * bins / F.col("__all"))).cast("int").alias("code"))
    out = ranked.unionByName(packed)
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("code")))


def extend_codes(codes: DataFrame, new: DataFrame, column: str, groups: int = 60) -> DataFrame:
    """value, n, code after new rows: counts of known values add up; new values get codes behind the known ones, spread over up to ``groups`` by their hash."""
    fresh = new.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("m"))
    base = codes.agg((F.coalesce(F.max("code"), F.lit(-1)) + 1).alias("__base"))  # a row
    both = codes.select("value", "n", "code").join(fresh, "value", "full").crossJoin(base)
    behind = F.col("__base") + F.pmod(F.crc32(F.col("value").cast("string")), F.lit(groups))
    return both.select("value", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.coalesce("code", behind).cast("int").alias("code"))


def expectation(df: DataFrame, condition: Column, fanout: Column) -> DataFrame:
    """expectation: the mean over all rows of a fan-out where a condition holds, 0 elsewhere."""
    return df.agg(F.avg(F.when(condition, fanout).otherwise(F.lit(0.0))).alias("expectation"))


def interval_coverage(low: Column, high: Column, bin_low: Column, bin_high: Column) -> Column:
    """The part of a bin's interval that a range covers, values spread evenly; a bin of one point is in or out."""
    overlap = F.greatest(F.lit(0.0), F.least(high, bin_high) - F.greatest(low, bin_low))
    return F.when(bin_high == bin_low, F.when((bin_low >= low) & (bin_low <= high), 1.0).otherwise(0.0)).otherwise(overlap / (bin_high - bin_low))


def pair_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, x, y, n for all pairs of columns, by one pass with grouping sets. States as strings; nulls are states too."""
    null = "∅"
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(null)).alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    grouped = rows.groupingSets([[F.col(a), F.col(b)] for a, b in pairs], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id().alias("__g"))
    full = (1 << len(columns)) - 1
    out = None
    which_a, which_b = F.lit(None).cast("string"), F.lit(None).cast("string")
    x, y = F.lit(None).cast("string"), F.lit(None).cast("string")
    for a, b in pairs:
        gid = full & ~((1 << (len(columns) - 1 - columns.index(a))) | (1 << (len(columns) - 1 - columns.index(b))))
        hit = F.col("__g") == gid
        which_a, which_b = F.when(hit, a).otherwise(which_a), F.when(hit, b).otherwise(which_b)
        x, y = F.when(hit, F.col(a)).otherwise(x), F.when(hit, F.col(b)).otherwise(y)
    out = grouped.select(which_a.alias("a"), which_b.alias("b"), x.alias("x"), y.alias("y"), "n")
    return out


def mutual_information(pairs: DataFrame) -> DataFrame:
    """a, b, mi in nats."""
    over = lambda *by: F.sum("n").over(Window.partitionBy("a", "b", *by))  # noqa: E731  of cells, which are pairs of states: the table is read once
    cells = pairs.select("a", "b", "n", over("x").alias("nx"), over("y").alias("ny"), over().alias("total"))
    term = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nx").cast("double") * F.col("ny")))
    return cells.groupBy("a", "b").agg(F.sum(term).alias("mi"))


def chow_liu(mi: list[tuple[str, str, float]], root: str) -> dict[str, str | None]:
    """child -> parent of the maximum spanning tree (Prim), grown from the root; ties by name."""
    weight = {frozenset((a, b)): w for a, b, w in mi}
    names = sorted({x for a, b, _ in mi for x in (a, b)} | {root})
    tree: dict[str, str | None] = {root: None}
    while len(tree) < len(names):
        _, child, parent = min((-weight.get(frozenset((p, c)), 0.0), c, p) for p in tree for c in names if c not in tree)
        tree[child] = parent
    return tree


def cpd(df: DataFrame, child: str, parent: str | None = None, alpha: float = 0.0) -> DataFrame:
    """parent, child, value: relative counts, with ``alpha`` added to every state of the cross product of seen states (0: maximum likelihood)."""
    names = [c for c in (parent, child) if c]
    n = factors.counts(df, names)
    if alpha:
        states = [n.select(c).distinct() for c in names]
        grid = states[0] if len(states) == 1 else states[0].crossJoin(states[1])  # states, not rows
        n = grid.join(n, names, "left").select(*names, (F.coalesce("value", F.lit(0.0)) + alpha).alias("value"))
    return factors.conditional(n, [parent] if parent else [])


def cpd_bdeu(df: DataFrame, child: str, parent: str | None, sample_size: float = 5.0) -> DataFrame:
    """Equal pseudo-counts that add up to ``sample_size`` over all cells."""
    cells = 1
    for c in (parent, child):
        if c:
            cells *= df.select(F.countDistinct(c)).first()[0] or 1
    return cpd(df, child, parent, sample_size / cells)


def structure(df: DataFrame, columns: list[str], root: str | None = None) -> dict[str, str | None]:
    rows = mutual_information(pair_counts(df, columns)).collect()  # a row for each pair of columns
    return chow_liu([(r["a"], r["b"], r["mi"]) for r in rows], root or columns[0])


def tree_probability(df: DataFrame, tree: dict[str, str | None], weights: dict[str, DataFrame]) -> DataFrame:
    """probability of a conjunction: messages from the leaves to the root. weights: (state, weight) of each filtered column; others are summed out at once."""
    cpds = {c: cpd(df, c, p) for c, p in tree.items()}
    order = []

    def visit(c: str) -> None:
        for child in sorted(k for k, p in tree.items() if p == c):
            visit(child)
        order.append(c)

    visit(next(c for c, p in tree.items() if p is None))
    needed = set(weights)
    for c in order:  # a sub-tree without a filter sums to one
        if c in needed and tree[c]:
            needed.add(tree[c])
    messages: dict[str, list[DataFrame]] = {c: [] for c in tree}
    for c in order:
        if c not in needed:
            continue
        f = cpds[c]
        if c in weights:
            f = factors.product(f, weights[c].select(weights[c].columns[0], F.col("weight").alias("value")).withColumnRenamed(weights[c].columns[0], c))
        for m in messages[c]:
            f = factors.product(f, m)
        f = factors.marginalize(f, [c])
        if tree[c]:
            messages[tree[c]].append(f)
        else:
            return f.select(F.coalesce("value", F.lit(0.0)).alias("probability"))
    return df.sparkSession.range(1).select(F.lit(1.0).alias("probability"))


def key_distribution(df: DataFrame, tree: dict[str, str | None], weights: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The keys' columns and value = P(keys, filter) by the network: the product of the tables that the keys and filters need, all else summed out."""
    needed = {*weights, *keys}
    for c in list(needed):
        while tree[c] is not None:  # up to the root; other branches sum to one
            c = tree[c]
            needed.add(c)
    parts = []
    for c in sorted(needed):
        f = cpd(df, c, tree[c])
        if c in weights:
            f = factors.product(f, weights[c].select(F.col(weights[c].columns[0]).alias(c), F.col("weight").alias("value")))
        parts.append(f)
    rest = [c for c in sorted(needed, key=lambda c: -_depth(tree, c)) if c not in keys]  # leaves first
    return factors.product_all(factors.marginalize_set(parts, rest)).select(*keys, "value")


def _depth(tree: dict[str, str | None], c: str) -> int:
    n = 0
    while tree[c] is not None:
        c, n = tree[c], n + 1
    return n
