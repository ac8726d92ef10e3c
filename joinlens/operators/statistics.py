"""Stored statistics: factors of whole tables, built once, so that tables without a filter aren't scanned again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.operators import bound
from joinlens.operators.binning import modulo_bin
from joinlens.plans.parser import Query, parse
from joinlens.schema import SchemaGraph
from joinlens.sources.tables import load_model, save_model


@dataclass(frozen=True)
class Statistics:
    """For each table and set of its keys a table with bin_<key>, mode_<key> and mass."""

    bins: int
    tables: dict[str, DataFrame]

    @staticmethod
    def _name(table: str, keys: tuple[str, ...]) -> str:
        return "__".join([table, *keys])

    def factor(self, alias: str, table: str, keys: dict[int, list[str]]) -> bound.Factor | None:
        """The factor for one key of each group, from the stored one of exactly these keys; None if there is none.

        A factor of more keys wouldn't do: it leaves out the rows where another key is null.
        """
        if not keys or any(len(c) > 1 for c in keys.values()):
            return None
        found = self.tables.get(self._name(table, tuple(sorted(c[0] for c in keys.values()))))
        if found is None:
            return None
        columns = [F.col(f"{part}_{c[0]}").alias(f"{part}_{g}") for g, c in sorted(keys.items()) for part in ("bin", "mode")]
        return bound.Factor(found.select(*columns, "mass"), tuple(sorted(keys)), frozenset({alias}))

    def save(self, spark: SparkSession, folder: str) -> None:
        save_model(self.tables, {"bins": self.bins}, folder, spark)


def load(spark: SparkSession, folder: str) -> Statistics:
    tables, meta = load_model(spark, folder)
    return Statistics(meta["bins"], tables)


def build(schema: SchemaGraph, tables: Callable[[str], DataFrame], bins: int = 64, names: list[str] | None = None) -> Statistics:
    """Factors of every set of each table's join keys: a row counts where the set's keys aren't null."""
    out = {}
    for t in sorted(names or schema.tables):
        keys = sorted({k for e in schema.edges for n, k in ((e.left, e.left_key), (e.right, e.right_key)) if n == t})
        for own in (s for n in range(1, len(keys) + 1) for s in combinations(keys, n)):
            f = bound.base_factor(tables(t), t, {i: [k] for i, k in enumerate(own)}, lambda g, c: modulo_bin(c, bins))
            out[Statistics._name(t, own)] = f.df.select("mass", *[F.col(f"{part}_{i}").alias(f"{part}_{k}") for i, k in enumerate(own) for part in ("bin", "mode")])
    return Statistics(bins, out)


def estimate(query: Query | str, statistics: Statistics, tables: Callable[[str], DataFrame], rule: str = "scaled") -> DataFrame:
    """bound: from stored factors where a table has no filter, from a scan of the filtered table where it has."""
    query = parse(query) if isinstance(query, str) else query
    groups = query.key_groups()
    out = []
    for alias, name in sorted(query.aliases.items()):
        keys = {g: own for g, members in enumerate(groups) if (own := [c for a, c in members if a == alias])}
        stored = statistics.factor(alias, name, keys) if not query.filters(alias) else None
        out.append(stored or next(f for f in bound.base_factors(query, tables, statistics.bins) if f.members == {alias}))
    return bound.combine(out, rule)
