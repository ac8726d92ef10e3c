"""Discrete Bayesian networks: fitting, inference, prediction and sampling.

A network's tables are small arrays on the driver; rows of data stay in DataFrames, and prediction and
sampling are joins with the tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joinlens.models.dag import Dag, elimination_order


@dataclass(frozen=True)
class Table:
    """P(name | parents): the first axis is the name's states, the others the parents'."""

    name: str
    parents: tuple[str, ...]
    values: np.ndarray


@dataclass
class Network:
    graph: Dag
    states: dict[str, list]
    tables: dict[str, Table] = field(default_factory=dict)

    def check(self) -> None:
        for n in self.graph.nodes:
            t = self.tables.get(n)
            if t is None:
                raise ValueError(f"{n} has no table")
            if sorted(t.parents) != self.graph.parents(n):
                raise ValueError(f"{n}'s table has other parents than the graph")
            shape = tuple(len(self.states[x]) for x in (n, *t.parents))
            if t.values.shape != shape or not np.allclose(t.values.sum(0), 1, atol=0.01):
                raise ValueError(f"{n}'s table is malformed")

    def factor(self, n: str) -> tuple[tuple[str, ...], np.ndarray]:
        t = self.tables[n]
        return (n, *t.parents), t.values

    def query(self, names: list[str], evidence: dict[str, object] | None = None, order: str = "min_fill") -> np.ndarray:
        """The joint distribution of some variables given others, by eliminating the rest. Variables that neither needs are left out at once."""
        evidence = evidence or {}
        needed = self.graph.ancestors([*names, *evidence])
        factors = []
        for n in sorted(needed):
            scope, values = self.factor(n)
            for e, x in evidence.items():
                if e in scope:
                    values = np.take(values, self.states[e].index(x), axis=scope.index(e))
                    scope = tuple(s for s in scope if s != e)
            factors.append((scope, values))
        rest = needed - set(names) - set(evidence)
        sub = Dag(((a, b) for a, b in self.graph.edges if a in needed and b in needed), needed).moral()
        for n in elimination_order(sub, {k: len(v) for k, v in self.states.items()}, order, rest):
            own = [f for f in factors if n in f[0]]
            factors = [f for f in factors if n not in f[0]]
            scope, values = reduce(_multiply, own)
            factors.append((tuple(s for s in scope if s != n), values.sum(scope.index(n))))
        scope, values = reduce(_multiply, factors)
        values = np.transpose(values, [scope.index(n) for n in names])
        total = values.sum()
        return values / total if total else values

    def probability(self, evidence: dict[str, object]) -> float:
        p, known = 1.0, {}
        for n in sorted(evidence):
            p *= float(self.query([n], known)[self.states[n].index(evidence[n])])
            if not p:
                return 0.0
            known[n] = evidence[n]
        return p


def _multiply(a: tuple, b: tuple) -> tuple:
    scope = tuple(dict.fromkeys([*a[0], *b[0]]))

    def wide(f: tuple) -> np.ndarray:
        order = [s for s in scope if s in f[0]]
        values = np.transpose(f[1], [f[0].index(s) for s in order])
        return values.reshape([f[1].shape[f[0].index(s)] if s in f[0] else 1 for s in scope])

    return scope, wide(a) * wide(b)


def fit(df: DataFrame, graph: Dag, alpha: float = 0.0) -> Network:
    """Relative counts of each node with its parents (``alpha`` added to each cell); unseen parent states are uniform. One aggregate for each node."""
    states = {n: [r[0] for r in df.where(F.col(n).isNotNull()).select(n).distinct().orderBy(n).collect()] for n in graph.nodes}
    out = Network(graph, states)
    for n in graph.nodes:
        scope = (n, *graph.parents(n))
        values = np.full([len(states[s]) for s in scope], alpha, float)
        for r in df.where(" and ".join(f"{s} is not null" for s in scope)).groupBy(*scope).count().collect():
            values[tuple(states[s].index(r[s]) for s in scope)] += r["count"]
        total = values.sum(0, keepdims=True)
        out.tables[n] = Table(n, tuple(graph.parents(n)), np.where(total > 0, values / np.where(total > 0, total, 1), 1 / max(1, len(states[n]))))
    return out


def predict(df: DataFrame, network: Network, target: str, observed: list[str]) -> DataFrame:
    """The rows with the target's likeliest state and its probability. One inference for each combination of observed states that occurs, then a join."""
    spark = df.sparkSession
    seen = [tuple(r) for r in df.select(*observed).where(" and ".join(f"{c} is not null" for c in observed)).distinct().collect()]  # states, bounded by the network
    rows = []
    for combo in seen:
        known = {c: v for c, v in zip(observed, combo, strict=True) if v in network.states[c]}
        p = network.query([target], known)
        best = int(p.argmax())
        rows.append((*combo, network.states[target][best], float(p[best])))
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in observed), f"predicted_{target} {df.schema[target].dataType.simpleString() if target in df.columns else 'string'}", "probability double"])
    return df.join(spark.createDataFrame(rows, schema), observed, "left")


def sample(spark: SparkSession, network: Network, n: int, seed: int = 0, evidence: dict[str, object] | None = None, weighted: bool = False) -> DataFrame:
    """Forward samples in topological order: each node's state is drawn from its table by a join on its parents.

    With evidence, either only the samples that agree (rejection), or all with ``weight``, the likelihood of the evidence.
    """
    evidence = evidence or {}
    out = spark.range(n).withColumn("weight", F.lit(1.0))
    for k, name in enumerate(network.graph.order()):
        t = network.tables[name]
        scope = (name, *t.parents)
        cells = [(*(network.states[s][i] for s, i in zip(scope, index, strict=True)), float(v)) for index, v in np.ndenumerate(t.values)]
        kinds = ", ".join(f"`{s}` {_kind(network.states[s])}" for s in scope)
        cpt = spark.createDataFrame(cells, f"{kinds}, p double")
        w = Window.partitionBy(*t.parents).orderBy(name)
        ranges = cpt.withColumn("high", F.sum("p").over(w)).withColumn("low", F.col("high") - F.col("p"))
        if weighted and name in evidence:
            own = ranges.where(F.col(name) == F.lit(evidence[name])).select(*scope, "p")
            out = (out.join(own, list(t.parents)) if t.parents else out.crossJoin(own)).withColumn("weight", F.col("weight") * F.col("p")).drop("p")  # one cell
            continue
        out = out.withColumn("__u", (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 0.5) / float(1 << 30))
        cdf = ranges.groupBy(*t.parents).agg(F.sort_array(F.collect_list(F.struct("high", name))).alias("__cdf"))
        out = out.join(cdf, list(t.parents)) if t.parents else out.crossJoin(cdf)  # one row of a table without parents
        pick = F.coalesce(F.filter("__cdf", lambda c: c["high"] >= F.col("__u"))[0], F.element_at("__cdf", -1))
        out = out.withColumn(name, pick[name]).drop("__cdf", "__u")
    if evidence and not weighted:
        for name, value in evidence.items():
            out = out.where(F.col(name) == F.lit(value))
    return out.select("id", *network.graph.nodes, "weight")


def _kind(states: list) -> str:
    return "boolean" if all(isinstance(s, bool) for s in states) else "bigint" if all(isinstance(s, int) for s in states) else "double" if all(isinstance(s, float | int) for s in states) else "string"
