"""Where a base table's factor comes from: an exact scan (bound.base_factor), a sample (bound.scaled), or a network, here.

A table's network is a tree over its discretised attributes and key bins. A filter becomes weights on the
states of its columns, and the mass of each cell of key bins is its probability times the table's rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlens.operators import bayes, predicates
from joinlens.operators.binning import modulo_bin
from joinlens.operators.bound import Factor, base_factor, combine
from joinlens.plans.parser import Query

INTERVALS = 120


@dataclass(frozen=True)
class TableNetwork:
    rows: int
    bins: int
    coded: DataFrame  # bin_<key> for each key, the attributes' codes or values
    tree: dict[str, str | None]
    edges: dict[str, list[float]]  # of the continuous attributes
    modes: DataFrame  # bin_<i>, mode_<i> of the whole table's keys
    keys: tuple[str, ...]
    states: dict[str, list]  # of each attribute: bayes.CONTINUOUS_ABOVE values or INTERVALS numbers at most


def learn(df: DataFrame, keys: list[str], attributes: list[str], bins: int = 64, intervals: int = INTERVALS) -> TableNetwork:
    """Attributes of over bayes.CONTINUOUS_ABOVE values become intervals of equal mass; the others keep their values."""
    kinds = {r["column_name"]: r["kind"] for r in bayes.attribute_types(df, attributes).collect()}
    many = [a for a in attributes if kinds[a] == "continuous" and df.schema[a].dataType.typeName() in ("string", "boolean")]
    if many:
        raise ValueError(f"{many} have too many values for states: leave them out, or pack them (catalog)")
    edges = {a: bayes.quantile_edges(df.select(F.col(a).cast("double").alias(a)), a, intervals, exact=False) for a in attributes if kinds[a] == "continuous"}
    code = lambda a: bayes.interval_bin(F.col(a).cast("double"), edges[a]) if a in edges else F.col(a)
    coded = df.select(*[modulo_bin(F.col(k), bins).alias(f"bin_{k}") for k in keys], *[code(a).alias(a) for a in attributes])
    tree = bayes.structure(coded, coded.columns)
    modes = base_factor(df, "t", {i: [k] for i, k in enumerate(keys)}, lambda g, c: modulo_bin(c, bins)).df.drop("mass")
    found = coded.agg(*[F.collect_set(a).alias(a) for a in attributes]).first() if attributes else {}
    states = {a: sorted(found[a]) for a in attributes}
    return TableNetwork(df.count(), bins, coded, tree, edges, modes, tuple(keys), states)


def network_factor(net: TableNetwork, alias: str, groups: dict[int, str], filters: list[str]) -> Factor:
    """The factor of the table's keys (all of them, a group each) under a conjunction of mergeable conditions."""
    spark = net.coded.sparkSession
    weights = {}
    for name, condition in predicates.merge(filters).items():
        column = name.split(".")[-1]
        kind = net.coded.schema[column].dataType.simpleString()
        weights[column] = spark.createDataFrame(predicates.weights(condition, net.states[column], net.edges.get(column)), f"state {kind}, weight double")
    names = [f"bin_{k}" for k in net.keys]
    masses = bayes.key_distribution(net.coded, net.tree, weights, names)
    place = {k: i for i, k in enumerate(net.keys)}
    modes = net.modes.withColumnsRenamed({f"bin_{place[k]}": f"bin_{k}" for k in net.keys})
    both = masses.join(modes, names)
    out = both.select(*[F.col(f"bin_{k}").alias(f"__{g}") for g, k in groups.items()], *[F.col(f"mode_{place[k]}").alias(f"mode_{g}") for g, k in groups.items()], (F.col("value") * net.rows).alias("mass"))
    return Factor(out.withColumnsRenamed({f"__{g}": f"bin_{g}" for g in groups}), tuple(sorted(groups)), frozenset({alias}))


def estimate_from_networks(query: Query, networks: dict[str, TableNetwork], rule: str = "scaled") -> DataFrame:
    """bound: an estimate (the masses are modelled). Every key of a table's network must take part in the query."""
    groups = query.key_groups()
    out = []
    for alias, name in sorted(query.aliases.items()):
        own = {g: c for g, members in enumerate(groups) for a, c in members if a == alias}
        out.append(network_factor(networks[name], alias, own, query.filters(alias)))
    return combine(out, rule)
