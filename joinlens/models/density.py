"""Continuous distributions given by any density function, by quadrature on a grid, and one face for these and Gaussians."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np

from joinlens.models.gaussian import Canonical, Gaussian, discretised, discretised_unbiased

POINTS = 61
#: Grid points that one step may take: the product over all variables of a density.
MAX_POINTS = 20_000_000


@dataclass(frozen=True)
class Density:
    """f(x, y, ...) over a box. Functions take arrays of one shape. Sums and normal constants come from Gauss-Legendre points."""

    names: tuple[str, ...]
    function: Callable[..., np.ndarray]
    low: tuple[float, ...]
    high: tuple[float, ...]

    def pdf(self, values: Sequence[float]) -> float:
        return float(self.function(*(np.asarray(v, float) for v in values)))

    def _points(self, names: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray]:
        if POINTS ** len(names) > MAX_POINTS:
            raise ValueError(f"{len(names)} variables are too many for a grid")
        x, w = np.polynomial.legendre.leggauss(POINTS)
        axes, weights = [], np.ones(())
        for n in names:
            a, b = self.low[self.names.index(n)], self.high[self.names.index(n)]
            axes.append((x + 1) * (b - a) / 2 + a)
            weights = np.multiply.outer(weights, w * (b - a) / 2)
        return list(np.meshgrid(*axes, indexing="ij")), weights

    def total(self) -> float:
        grid, weights = self._points(self.names)
        return float((self.function(*grid) * weights).sum())

    def normalized(self) -> Density:
        whole, f = self.total(), self.function
        return self._with(self.names, lambda *x: f(*x) / whole)

    def _with(self, names: Sequence[str], function: Callable[..., np.ndarray], other: Density | None = None) -> Density:
        box = {n: (a, b) for d in (other, self) if d is not None for n, a, b in zip(d.names, d.low, d.high, strict=True)}
        if other is not None:  # where both are known
            for n in set(self.names) & set(other.names):
                i, j = self.names.index(n), other.names.index(n)
                box[n] = (max(self.low[i], other.low[j]), min(self.high[i], other.high[j]))
        return Density(tuple(names), function, tuple(box[n][0] for n in names), tuple(box[n][1] for n in names))

    def marginal(self, keep: Sequence[str]) -> Density:
        out = [n for n in self.names if n not in keep]
        grid, weights = self._points(out)
        at = [(keep if n in keep else out).index(n) for n in self.names]

        def f(*x: np.ndarray) -> np.ndarray:
            values = np.broadcast_arrays(*x)
            wide = [v[(...,) + (None,) * len(out)] for v in values]
            args = [wide[i] if n in keep else grid[i] for n, i in zip(self.names, at, strict=True)]
            return (self.function(*np.broadcast_arrays(*args)) * weights).sum(tuple(range(-len(out), 0))) if out else self.function(*args)

        return self._with(keep, f)

    def given(self, evidence: dict[str, float]) -> Density:
        keep = [n for n in self.names if n not in evidence]

        def f(*x: np.ndarray) -> np.ndarray:
            known = dict(zip(keep, x, strict=True))
            return self.function(*np.broadcast_arrays(*[known.get(n, evidence.get(n)) for n in self.names]))

        return self._with(keep, f)

    def _combined(self, other: Density, how: Callable) -> Density:
        names = tuple(dict.fromkeys([*self.names, *other.names]))

        def f(*x: np.ndarray) -> np.ndarray:
            at = dict(zip(names, x, strict=True))
            return how(self.function(*(at[n] for n in self.names)), other.function(*(at[n] for n in other.names)))

        return self._with(names, f, other)

    def __mul__(self, other: Density) -> Density:
        return self._combined(other, np.multiply)

    def __truediv__(self, other: Density) -> Density:
        return self._combined(other, lambda a, b: np.divide(a, b, out=np.zeros_like(np.asarray(a, float)), where=np.asarray(b) != 0))


@dataclass(frozen=True)
class Continuous:
    """A factor over continuous variables: a Gaussian in either form, or any density."""

    inner: Gaussian | Canonical | Density

    @property
    def names(self) -> tuple[str, ...]:
        return self.inner.names

    def pdf(self, values: Sequence[float]) -> float:
        return self.inner.pdf(values)

    def marginal(self, keep: Sequence[str]) -> Continuous:
        return Continuous(self.inner.marginal(keep))

    def given(self, evidence: dict[str, float]) -> Continuous:
        return Continuous(self.inner.given(evidence))

    def _other(self, other: Continuous) -> tuple:
        a, b = self.inner, other.inner
        if isinstance(a, Density) != isinstance(b, Density):
            raise TypeError("a Gaussian and a density given by a function: put the Gaussian as a function first (as_density)")
        return (a.canonical() if isinstance(a, Gaussian) else a), (b.canonical() if isinstance(b, Gaussian) else b)

    def __mul__(self, other: Continuous) -> Continuous:
        a, b = self._other(other)
        return Continuous(a * b)

    def __truediv__(self, other: Continuous) -> Continuous:
        a, b = self._other(other)
        return Continuous(a / b)

    def discretised(self, low: float, high: float, bins: int, unbiased: bool = False) -> list[float]:
        """Masses of one variable by bins: by rounding or unbiased for a Gaussian, the density's sums over the bins otherwise."""
        if len(self.names) != 1:
            raise ValueError("only one variable can be cut into bins")
        if isinstance(self.inner, Density):
            edges = np.linspace(low, high, bins + 1)
            part = partial(Density, self.names, self.inner.function)
            return [part((a,), (b,)).total() for a, b in zip(edges, edges[1:], strict=False)]
        g = self.inner.moments() if isinstance(self.inner, Canonical) else self.inner
        return (discretised_unbiased if unbiased else discretised)(float(g.mean[0]), float(g.cov[0, 0]) ** 0.5, low, high, bins)


def as_density(g: Gaussian, width: float = 8.0) -> Density:
    """A Gaussian as a function, over ``width`` standard deviations on each side."""
    inverse, scale = np.linalg.inv(g.cov), 1 / np.sqrt(np.linalg.det(2 * np.pi * g.cov))
    sd = np.sqrt(np.diag(g.cov))

    def f(*x: np.ndarray) -> np.ndarray:
        d = np.stack([np.asarray(v, float) - m for v, m in zip(np.broadcast_arrays(*x), g.mean, strict=True)], -1)
        return scale * np.exp(-0.5 * np.einsum("...i,ij,...j->...", d, inverse, d))

    return Density(g.names, f, tuple(g.mean - width * sd), tuple(g.mean + width * sd))
