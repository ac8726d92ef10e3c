"""Gaussian distributions in moment and canonical form, and linear-Gaussian networks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlens.models.causal import linear_coefficients
from joinlens.models.dag import Dag


@dataclass(frozen=True)
class Gaussian:
    names: tuple[str, ...]
    mean: np.ndarray
    cov: np.ndarray

    def _at(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(n) for n in names]

    def pdf(self, values: Sequence[float]) -> float:
        d = np.asarray(values, float) - self.mean
        return float(math.exp(-0.5 * d @ np.linalg.solve(self.cov, d)) / math.sqrt(np.linalg.det(2 * math.pi * self.cov)))

    def marginal(self, keep: Sequence[str]) -> Gaussian:
        i = self._at(keep)
        return Gaussian(tuple(keep), self.mean[i], self.cov[np.ix_(i, i)])

    def given(self, evidence: dict[str, float]) -> Gaussian:
        keep = [n for n in self.names if n not in evidence]
        i, j = self._at(keep), self._at(list(evidence))
        gain = self.cov[np.ix_(i, j)] @ np.linalg.inv(self.cov[np.ix_(j, j)])
        return Gaussian(tuple(keep), self.mean[i] + gain @ (np.array(list(evidence.values()), float) - self.mean[j]), self.cov[np.ix_(i, i)] - gain @ self.cov[np.ix_(j, i)])

    def canonical(self) -> Canonical:
        k = np.linalg.inv(self.cov)
        h = k @ self.mean
        return Canonical(self.names, k, h, float(-0.5 * self.mean @ h - 0.5 * math.log(np.linalg.det(2 * math.pi * self.cov))))

    def __mul__(self, other: Gaussian) -> Gaussian:
        return (self.canonical() * other.canonical()).moments()

    def __truediv__(self, other: Gaussian) -> Gaussian:
        return (self.canonical() / other.canonical()).moments()


@dataclass(frozen=True)
class Canonical:
    """exp(g + h'x - x'Kx / 2)"""

    names: tuple[str, ...]
    k: np.ndarray
    h: np.ndarray
    g: float

    def pdf(self, values: Sequence[float]) -> float:
        x = np.asarray(values, float)
        return float(math.exp(self.g + self.h @ x - 0.5 * x @ self.k @ x))

    def _over(self, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        i = [names.index(n) for n in self.names]
        k, h = np.zeros((len(names), len(names))), np.zeros(len(names))
        k[np.ix_(i, i)], h[i] = self.k, self.h
        return k, h

    def _with(self, other: Canonical, sign: float) -> Canonical:
        names = tuple(dict.fromkeys([*self.names, *other.names]))
        (k1, h1), (k2, h2) = self._over(names), other._over(names)
        return Canonical(names, k1 + sign * k2, h1 + sign * h2, self.g + sign * other.g)

    def __mul__(self, other: Canonical) -> Canonical:
        return self._with(other, 1.0)

    def __truediv__(self, other: Canonical) -> Canonical:
        return self._with(other, -1.0)

    def marginal(self, keep: Sequence[str]) -> Canonical:
        i, j = [self.names.index(n) for n in keep], [x for x, n in enumerate(self.names) if n not in keep]
        if not j:
            return Canonical(tuple(keep), self.k[np.ix_(i, i)], self.h[i], self.g)
        inner = np.linalg.inv(self.k[np.ix_(j, j)])
        cross = self.k[np.ix_(i, j)] @ inner
        g = self.g + 0.5 * (len(j) * math.log(2 * math.pi) - math.log(np.linalg.det(self.k[np.ix_(j, j)])) + self.h[j] @ inner @ self.h[j])
        return Canonical(tuple(keep), self.k[np.ix_(i, i)] - cross @ self.k[np.ix_(j, i)], self.h[i] - cross @ self.h[j], float(g))

    def given(self, evidence: dict[str, float]) -> Canonical:
        i = [x for x, n in enumerate(self.names) if n not in evidence]
        j = [self.names.index(n) for n in evidence]
        y = np.array(list(evidence.values()), float)
        return Canonical(tuple(self.names[x] for x in i), self.k[np.ix_(i, i)], self.h[i] - self.k[np.ix_(i, j)] @ y, float(self.g + self.h[j] @ y - 0.5 * y @ self.k[np.ix_(j, j)] @ y))

    def moments(self) -> Gaussian:
        cov = np.linalg.inv(self.k)
        return Gaussian(self.names, cov @ self.h, cov)


def from_table(df: DataFrame, names: list[str]) -> Gaussian:
    """Mean and population covariance of columns, from one aggregate."""
    one = df.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    n = len(names)
    return Gaussian(tuple(names), np.array([one[f"m{i}"] for i in range(n)], float), np.array([[one[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float))


@dataclass(frozen=True)
class LinearGaussian:
    """A node whose mean is linear in its parents."""

    name: str
    intercept: float
    weights: dict[str, float]
    variance: float


def fit_network(df: DataFrame, g: Dag) -> list[LinearGaussian]:
    out = []
    for n in g.order():
        beta = linear_coefficients(df, n, g.parents(n))
        expected = F.lit(beta["intercept"])
        for p in g.parents(n):
            expected = expected + beta[p] * F.col(p)
        variance = df.agg(F.avg((F.col(n) - expected) * (F.col(n) - expected))).first()[0] or 0.0
        out.append(LinearGaussian(n, beta["intercept"], {p: beta[p] for p in g.parents(n)}, float(variance)))
    return out


def joint(nodes: list[LinearGaussian]) -> Gaussian:
    """The nodes' joint distribution; they stand in topological order."""
    names = tuple(n.name for n in nodes)
    at = {n: i for i, n in enumerate(names)}
    mean, cov = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for i, n in enumerate(nodes):
        j = [at[p] for p in n.weights]
        w = np.array(list(n.weights.values()))
        mean[i] = n.intercept + (w @ mean[j] if j else 0.0)
        if j:
            cov[i, :i] = w @ cov[np.ix_(j, range(i))]
            cov[:i, i] = cov[i, :i]
        cov[i, i] = n.variance + (w @ cov[np.ix_(j, j)] @ w if j else 0.0)
    return Gaussian(names, mean, cov)


def normal_cdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return 0.5 * (1 + math.erf((x - mean) / (sd * math.sqrt(2))))


def discretised(mean: float, sd: float, low: float, high: float, bins: int) -> list[float]:
    """Rounding: the mass around each of the points low, low + s, ..."""
    step = (high - low) / bins
    return [normal_cdf(low + (i + 0.5) * step, mean, sd) - normal_cdf(low + (i - 0.5) * step if i else low, mean, sd) for i in range(bins)]


def discretised_unbiased(mean: float, sd: float, low: float, high: float, bins: int) -> list[float]:
    """Moment matching: masses at bins + 1 points that keep the mean of every step (by limited expectations)."""
    step = (high - low) / bins

    def limited(u: float) -> float:
        z = (u - mean) / sd
        density = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
        return mean * normal_cdf(z) - sd * density + u * (1 - normal_cdf(z))

    at = [limited(low + i * step) for i in range(bins + 1)]
    first = (at[0] - at[1]) / step + 1 - normal_cdf(low, mean, sd)
    inner = [(2 * at[i] - at[i - 1] - at[i + 1]) / step for i in range(1, bins)]
    last = (at[bins] - at[bins - 1]) / step - 1 + normal_cdf(high, mean, sd)
    return [first, *inner, last]
