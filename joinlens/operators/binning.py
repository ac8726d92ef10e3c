"""Binning of join keys: domains cut into bins, and per-bin frequency statistics.

Bin maps are DataFrames (value, bin). Everything that grows with the data is an aggregate; the driver
only sees histograms of counts (how many values occur c times), which have at most sqrt(2 N) rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """value, n for the non-null values of a key."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))


def frequency_histogram(counts: DataFrame) -> DataFrame:
    """n, values: how many values occur n times."""
    return counts.groupBy("n").agg(F.count("*").alias("values"))


def modulo_bin(key: Column, bins: int) -> Column:
    return F.pmod(key, F.lit(bins)).cast("int")


def equal_width_bin(key: Column, low: float, high: float, bins: int) -> Column:
    """0..bins-1; values outside go to the outermost bins, null stays null."""
    if high <= low:
        return F.when(key.isNotNull(), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.floor((key - low) * bins / (high - low)), F.lit(bins - 1))).cast("int")


def greedy_cuts(histogram: Iterable[tuple[int, int]], bins: int) -> dict[int, int]:
    """count -> bin: values grouped by their count, ascending; a bin closes when its rows exceed an equal share."""
    rows = sorted(histogram)
    total = sum(n * v for n, v in rows)
    share, held, b, out = total / max(1, bins), 0, 0, {}
    for n, v in rows:
        out[n] = b
        held += n * v
        if held > share and b < bins - 1:
            b, held = b + 1, 0
    return out


def equal_frequency_map(counts: DataFrame, bins: int) -> DataFrame:
    """value, bin. With at most ``bins`` values each has its own bin, in value order."""
    distinct = counts.count()
    if distinct <= bins:
        rank = F.row_number().over(Window.orderBy("value")) - 1  # at most ``bins`` rows
        return counts.select("value", rank.cast("int").alias("bin"))
    cuts = greedy_cuts(((r["n"], r["values"]) for r in frequency_histogram(counts).collect()), bins)
    lookup = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    return counts.select("value", F.element_at(lookup, F.col("n").cast("int")).alias("bin"))


def equal_frequency_share(histogram: DataFrame, bins: int) -> DataFrame:
    """n, bin by the running share of rows in ascending order of n: the form that SQL can state. One row for each distinct count."""
    w = Window.orderBy("n")
    rows = F.col("n") * F.col("values")
    total = F.sum(rows).over(Window.partitionBy())
    before = F.coalesce(F.sum(rows).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return histogram.select("n", "values", F.floor(before * bins / total).cast("int").alias("bin"))


def assign(df: DataFrame, key: str, bin_map: DataFrame, bin_column: str, unseen: int | None = None) -> DataFrame:
    """The rows with the bin of their key; a value that the map lacks gets ``unseen`` (null keys stay null).

    Whether the map is broadcast is left to the size that the planner measures.
    """
    m = bin_map.select(F.col("value").alias("__value"), F.col("bin").alias(bin_column))
    out = df.join(m, df[key] == F.col("__value"), "left").drop("__value")
    if unseen is not None:
        out = out.withColumn(bin_column, F.when(F.col(key).isNotNull(), F.coalesce(bin_column, F.lit(unseen))))
    return out


def bin_statistics(counts: DataFrame, bin_of: Column) -> DataFrame:
    """bin, mass, mfv, mean, var (population) and width, from value counts."""
    return counts.groupBy(bin_of.alias("bin")).agg(F.sum("n").alias("mass"), F.max("n").alias("mfv"), F.avg("n").alias("mean"), F.var_pop("n").alias("var"), F.count("*").alias("width"))


def cell_modes(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """For each cell of the keys' bins: mass, and for every key the largest multiplicity of a value of it in the cell (mfv_<key>)."""
    bins = [b.alias(f"bin_{k}") for k, b in keys.items()]
    names = [f"bin_{k}" for k in keys]
    # Counts of the keys' combinations first: one shuffle of the rows serves mass and modes.
    counts = df.select(*keys, *bins).where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*names, *keys).agg(F.count("*").alias("n"))
    out = counts.groupBy(*names).agg(F.sum("n").alias("mass"))
    for k in keys:
        modes = counts.groupBy(*names, k).agg(F.sum("n").alias("n")).groupBy(*names).agg(F.max("n").alias(f"mfv_{k}"))
        out = out.join(modes, names)
    return out


def variance_product(stats: DataFrame, sides: list[str]) -> DataFrame:
    """Sum over bins of the variance of a product of independent counts: product of (var + mean^2) less product of mean^2."""
    both, means = F.lit(1.0), F.lit(1.0)
    for s in sides:
        square = F.col(f"mean_{s}") * F.col(f"mean_{s}")
        both, means = both * (F.col(f"var_{s}") + square), means * square
    return stats.agg(F.sum(both - means).alias("score"))


def budget_by_variance(scores: list[tuple[int, float, float]], bins: int) -> dict[int, int]:
    """bin -> how many bins it may become, from (bin, variance, mean): 3 where var/mean >= 2, 2 above 0.2, in descending variance while the budget lasts, again and again."""
    out = {b: 1 for b, _, _ in scores}
    left = bins
    eligible = [(b, 2 if v / m >= 2 else 1) for b, v, m in sorted(scores, key=lambda x: (-x[1], x[0])) if m and v / m > 0.2]
    while left > 0 and eligible:
        for b, more in eligible:
            take = min(more, left)
            out[b] += take
            left -= take
    return out


def jenks(values: np.ndarray, weights: np.ndarray, classes: int) -> list[int]:
    """First indices of the classes of a sorted histogram with the least weighted squared deviation (dynamic programme)."""
    n, k = len(values), min(classes, len(values))
    w = np.concatenate([[0.0], np.cumsum(weights)])
    s = np.concatenate([[0.0], np.cumsum(weights * values)])
    q = np.concatenate([[0.0], np.cumsum(weights * values * values)])

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        mass = w[j] - w[i]
        return (q[j] - q[i]) - (s[j] - s[i]) ** 2 / np.maximum(mass, 1e-300)

    best = np.array([np.inf if j == 0 else cost(np.array([0]), j)[0] for j in range(n + 1)])
    best[0] = 0
    cut = np.zeros((k + 1, n + 1), int)
    for c in range(2, k + 1):
        new = np.full(n + 1, np.inf)
        for j in range(c, n + 1):
            i = np.arange(c - 1, j)
            total = best[i] + cost(i, j)
            at = int(total.argmin())
            new[j], cut[c, j] = total[at], i[at]
        best = new
    bounds, j = [], n
    for c in range(k, 0, -1):
        j = cut[c, j] if c > 1 else 0
        bounds.append(int(j))
    return bounds[::-1]


def split_by_counts(counts: DataFrame, bin_map: DataFrame, budget: dict[int, int]) -> DataFrame:
    """Refine bins by another key's counts: within a bin, values fall into classes of alike counts; absent values go by their hash over the parts.

    A bin without any value of this key stays whole. The driver sees a histogram of counts for each bin that is split.
    """
    joined = bin_map.join(counts, "value", "left")
    split = [b for b, k in budget.items() if k > 1]
    hist: dict[int, list[tuple[int, int]]] = {}
    for r in joined.where(F.col("bin").isin(split) & F.col("n").isNotNull()).groupBy("bin", "n").count().collect():
        hist.setdefault(r["bin"], []).append((r["n"], r["count"]))
    base = (bin_map.agg(F.max("bin")).first()[0] or 0) + 1
    # A row for each class: bin, the least count in it, its new bin, and the bin's classes for values without a count.
    classes = []
    for b in sorted(hist):
        rows = sorted(hist[b])
        starts = jenks(np.array([n for n, _ in rows], float), np.array([c for _, c in rows], float), budget[b])
        ids = [b, *range(base, base + len(starts) - 1)]
        base += len(starts) - 1
        classes.append((b, [rows[i][0] for i in starts], ids))
    if not classes:
        return bin_map.select("value", "bin")
    lookup = bin_map.sparkSession.createDataFrame(classes, "bin int, least array<long>, ids array<int>")
    both = joined.join(F.broadcast(lookup), "bin", "left")  # as many rows as bins, as many numbers as the budget
    at = F.greatest(F.size(F.filter("least", lambda x: x <= F.col("n"))), F.lit(1))
    absent = F.pmod(F.xxhash64("value"), F.size("ids")) + 1
    new = F.when(F.col("ids").isNull(), F.col("bin")).otherwise(F.element_at("ids", F.when(F.col("n").isNull(), absent).otherwise(at).cast("int")))
    return both.select("value", new.cast("int").alias("bin"))


def add_unseen(bin_map: DataFrame, counts: DataFrame, start_counts: DataFrame) -> DataFrame:
    """Give the values that the map lacks the bin whose mean count (of the start key) is nearest to their own count; ties go to the smaller mean."""
    means = [(r["bin"], float(r["m"])) for r in bin_map.join(start_counts, "value").groupBy("bin").agg(F.avg("n").alias("m")).collect()]
    fresh = counts.join(bin_map, "value", "left_anti")
    if not means:
        return bin_map.unionByName(fresh.select("value", F.lit(0).alias("bin")))
    means.sort(key=lambda x: (x[1], x[0]))
    nearest: Column = F.lit(means[-1][0])
    for (b, m), (_, following) in reversed(list(zip(means, means[1:], strict=False))):
        nearest = F.when(F.col("n") <= (m + following) / 2, F.lit(b)).otherwise(nearest)
    return bin_map.unionByName(fresh.select("value", nearest.cast("int").alias("bin")))


def greedy_bins(keys: list[DataFrame], bins: int) -> DataFrame:
    """One map for a group of keys (value counts each): keys by rows descending, the first with half the budget by equal frequency, each next one refines with half of what is left, the last with all."""
    sized = sorted(((k.agg(F.sum("n")).first()[0] or 0, i, k) for i, k in enumerate(keys)), key=lambda x: (-x[0], x[1]))
    first = sized[0][2]
    used = bins if len(sized) == 1 else max(1, bins // 2)
    bin_map, left = equal_frequency_map(first, used), bins - used
    for at, (_, _, counts) in enumerate(sized[1:]):
        own = left if at == len(sized) - 2 else left // 2
        left -= own
        bin_map = add_unseen(bin_map, counts, first)
        if own:
            stats = counts.join(bin_map, "value").groupBy("bin").agg(F.var_pop("n").alias("v"), F.avg("n").alias("m")).collect()
            bin_map = split_by_counts(counts, bin_map, budget_by_variance([(r["bin"], r["v"], r["m"]) for r in stats], own))
    return bin_map


def best_start_bins(keys: dict[str, DataFrame], bins: int) -> tuple[str, DataFrame]:
    """Try every key as the start, and take the map with the least variance of products."""
    scored = []
    for name in sorted(keys):
        order = [keys[name], *(keys[k] for k in sorted(keys) if k != name)]
        m = equal_frequency_map(order[0], bins)
        for k in order[1:]:
            m = add_unseen(m, k, order[0])
        stats = m.select("bin").distinct()
        for i, k in enumerate(order):
            s = m.join(k, "value").groupBy("bin").agg(F.avg("n").alias(f"mean_{i}"), F.var_pop("n").alias(f"var_{i}"))
            stats = stats.join(s, "bin")
        score = variance_product(stats, [str(i) for i in range(len(order))]).first()[0] or 0.0
        scored.append((score, name, m))
    best = min(scored, key=lambda x: x[:2])
    return best[1], best[2]


def fixed_start_bins(keys: dict[str, DataFrame], bins: int, by: str = "rows") -> tuple[str, DataFrame]:
    """Start from the key that isn't unique and has the most rows, or whose counts vary most; the others' new values go to the nearest bin."""
    scored = []
    for name in sorted(keys):
        r = keys[name].agg(F.sum("n").alias("rows"), F.count("*").alias("values"), F.coalesce(F.var_pop("n"), F.lit(0.0)).alias("variance")).first()
        unique = (r["values"] or 0) >= 0.99 * (r["rows"] or 0)
        scored.append((unique, -(r["rows"] or 0) if by == "rows" else -r["variance"], name))
    start = min(scored)[2]
    m = equal_frequency_map(keys[start], bins)
    for name in sorted(keys):
        if name != start:
            m = add_unseen(m, keys[name], keys[start])
    return start, m


def workload_budget(uses: dict[str, int], bins: int) -> dict[str, int]:
    """A share of ``bins`` for each key group by how often the workload joins on it; at least one."""
    total = sum(uses.values())
    return {g: max(1, round(bins * n / total)) for g, n in sorted(uses.items())} if total else {}


def is_primary_key(df: DataFrame, key: str, share: float = 0.99) -> DataFrame:
    """rows, distinct values, and whether the key is unique but for a hundredth."""
    return df.agg(F.count(key).alias("n_rows"), F.countDistinct(key).alias("n_distinct")).withColumn("is_key", F.col("n_distinct") >= F.lit(share) * F.col("n_rows"))
