"""Adjustment sets, independence assertions and effects."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlens.models.dag import Dag


def _subsets(items: Iterable[str]) -> Iterable[frozenset[str]]:
    items = sorted(items)
    for k in range(len(items) + 1):
        yield from map(frozenset, combinations(items, k))


def backdoor_valid(g: Dag, x: str, y: str, z: Iterable[str] = ()) -> bool:
    """No descendant of x is adjusted for, and z closes every path into x."""
    z = set(z)
    if z & g.descendants(x):
        return False
    out = Dag(((a, b) for a, b in g.edges if a != x), g.nodes)  # only paths that enter x are left
    return out.separated(x, y, z)


def backdoor_sets(g: Dag, x: str, y: str) -> list[frozenset[str]]:
    """All minimal ones; an empty set if nothing needs adjusting."""
    out: list[frozenset[str]] = []
    for z in _subsets(set(g.nodes) - {x, y} - g.descendants(x)):
        if not any(o <= z for o in out) and backdoor_valid(g, x, y, z):
            out.append(z)
    return out


def frontdoor_valid(g: Dag, x: str, y: str, z: Iterable[str]) -> bool:
    """z is on every directed path, nothing confounds x and z, and x closes the paths from z to y."""
    z = set(z)
    if not z or any(not z & set(p[1:-1]) for p in g.paths(x, y)):
        return False
    return all(backdoor_valid(g, x, m) for m in z) and all(backdoor_valid(g, m, y, {x} | (z - {m} - g.descendants(m))) for m in z)


def frontdoor_sets(g: Dag, x: str, y: str) -> list[frozenset[str]]:
    between = {n for p in g.paths(x, y) for n in p[1:-1]}
    out: list[frozenset[str]] = []
    for z in _subsets(between):
        if z and not any(o <= z for o in out) and frontdoor_valid(g, x, y, z):
            out.append(z)
    return out


def factorisation(g: Dag) -> str:
    return "".join(f"P({n}|{','.join(g.parents(n))})" if g.parents(n) else f"P({n})" for n in g.order())


def linear_coefficients(df: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Least squares with an intercept from one aggregate of products: the driver solves a matrix of the columns' number."""
    terms = ["1", *xs, y]
    rows = df.where(" and ".join(f"{c} is not null" for c in [*xs, y]))
    column = lambda t: F.lit(1.0) if t == "1" else F.col(t).cast("double")
    one = rows.agg(*[F.sum(column(a) * column(b)).alias(f"s{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]).first()
    k = len(terms) - 1
    m = np.array([[one[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)], float)
    beta = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
    return dict(zip(["intercept", *xs], map(float, beta), strict=True))


def average_effect(df: DataFrame, g: Dag, x: str, y: str, strategy: str = "smallest") -> float:
    """The linear effect of x on y, adjusted for the smallest set or averaged over all minimal ones."""
    sets = backdoor_sets(g, x, y)
    if not sets:
        raise ValueError("no adjustment set")
    chosen = [min(sets, key=lambda s: (len(s), sorted(s)))] if strategy == "smallest" else sets
    return float(np.mean([linear_coefficients(df, y, [x, *sorted(z)])[x] for z in chosen]))


@dataclass(frozen=True)
class Independence:
    """X independent of Y given Z; symmetric in X and Y."""

    x: frozenset[str]
    y: frozenset[str]
    z: frozenset[str] = frozenset()

    @staticmethod
    def of(x: Iterable[str], y: Iterable[str], z: Iterable[str] = ()) -> Independence:
        a, b = sorted((frozenset(x), frozenset(y)), key=sorted)
        return Independence(a, b, frozenset(z))

    def __str__(self) -> str:
        given = f" | {', '.join(sorted(self.z))}" if self.z else ""
        return f"({', '.join(sorted(self.x))} _|_ {', '.join(sorted(self.y))}{given})"


def closure(known: Iterable[Independence]) -> set[Independence]:
    """Semi-graphoid: decomposition, weak union and contraction, to a fixed point."""
    out, todo = set(), [Independence.of(i.x, i.y, i.z) for i in known]
    while todo:
        i = todo.pop()
        if i in out:
            continue
        out.add(i)
        for a, b in ((i.x, i.y), (i.y, i.x)):
            if len(b) > 1:
                for w in b:
                    todo.append(Independence.of(a, b - {w}, i.z))
                    todo.append(Independence.of(a, b - {w}, i.z | {w}))
        for j in list(out):
            for one, two in ((i, j), (j, i)):
                for a, b in ((one.x, one.y), (one.y, one.x)):
                    for c, d in ((two.x, two.y), (two.y, two.x)):
                        # a _|_ b | z, d and a _|_ d | z  give  a _|_ b, d | z
                        if a == c and one.z == two.z | d and not d & two.z:
                            todo.append(Independence.of(a, b | d, two.z))
    return out


def entails(known: Iterable[Independence], claim: Independence) -> bool:
    return Independence.of(claim.x, claim.y, claim.z) in closure(known)


def equivalent(a: Iterable[Independence], b: Iterable[Independence]) -> bool:
    return closure(a) == closure(b)
