"""Hamiltonian Monte Carlo for Gaussians: one chain for each task, plain or with the step size fitted by dual averaging, and without U-turns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from joinlens.models.gaussian import Gaussian


class _Target:
    def __init__(self, g: Gaussian) -> None:
        self.mean, self.precision = g.mean, np.linalg.inv(g.cov)

    def log(self, x: np.ndarray) -> float:
        d = x - self.mean
        return float(-0.5 * d @ self.precision @ d)

    def slope(self, x: np.ndarray) -> np.ndarray:
        return -self.precision @ (x - self.mean)


def leapfrog(t: _Target, x: np.ndarray, p: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    p = p + 0.5 * step * t.slope(x)
    x = x + step * p
    return x, p + 0.5 * step * t.slope(x)


def modified_euler(t: _Target, x: np.ndarray, p: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    p = p + step * t.slope(x)
    return x + step * p, p


def first_step(t: _Target, x: np.ndarray, rng: np.random.Generator) -> float:
    """Doubled or halved until a single step's acceptance crosses one half."""
    step, p = 1.0, rng.standard_normal(len(x))
    gain = lambda s: (lambda a: t.log(a[0]) - 0.5 * a[1] @ a[1])(leapfrog(t, x, p, s)) - (t.log(x) - 0.5 * p @ p)
    up = gain(step) > np.log(0.5)
    for _ in range(60):
        if (gain(step) > np.log(0.5)) != up:
            break
        step *= 2.0 if up else 0.5
    return step


class _Averaging:
    """Dual averaging of the step size towards a rate of acceptance."""

    def __init__(self, step: float, target: float = 0.65) -> None:
        self.mu, self.target, self.h, self.log_mean, self.n = np.log(10 * step), target, 0.0, 0.0, 0

    def next(self, accepted: float) -> float:
        self.n += 1
        w = 1 / (self.n + 10)
        self.h = (1 - w) * self.h + w * (self.target - accepted)
        log_step = self.mu - np.sqrt(self.n) / 0.05 * self.h
        eta = self.n**-0.75
        self.log_mean = eta * log_step + (1 - eta) * self.log_mean
        return float(np.exp(log_step))

    @property
    def final(self) -> float:
        return float(np.exp(self.log_mean))


def _no_u_turn(t: _Target, x: np.ndarray, step: float, rng: np.random.Generator, depth: int = 8) -> tuple[np.ndarray, float]:
    p = rng.standard_normal(len(x))
    start = t.log(x) - 0.5 * p @ p
    limit = start + np.log(rng.random())
    stats = [0.0, 0]

    def build(x: np.ndarray, p: np.ndarray, way: int, j: int) -> tuple:
        if j == 0:
            x, p = leapfrog(t, x, p, way * step)
            energy = t.log(x) - 0.5 * p @ p
            stats[0] += min(1.0, float(np.exp(min(0.0, energy - start))))
            stats[1] += 1
            return x, p, x, p, x, int(limit <= energy), limit < energy + 1000
        xl, pl, xr, pr, pick, n, ok = build(x, p, way, j - 1)
        if ok:
            if way < 0:
                xl, pl, _, _, other, m, ok = build(xl, pl, way, j - 1)
            else:
                _, _, xr, pr, other, m, ok = build(xr, pr, way, j - 1)
            if n + m and rng.random() < m / (n + m):
                pick = other
            n += m
            ok = ok and (xr - xl) @ pl >= 0 and (xr - xl) @ pr >= 0
        return xl, pl, xr, pr, pick, n, ok

    xl = xr = x
    pl = pr = p
    n = 1
    for j in range(depth):
        way = 1 if rng.random() < 0.5 else -1
        if way < 0:
            xl, pl, _, _, pick, m, ok = build(xl, pl, way, j)
        else:
            _, _, xr, pr, pick, m, ok = build(xr, pr, way, j)
        if not ok:
            break
        if rng.random() < m / n:
            x = pick
        n += m
        if (xr - xl) @ pl < 0 or (xr - xl) @ pr < 0:
            break
    return x, stats[0] / max(1, stats[1])


def chain(g: Gaussian, n: int, seed: int, method: str = "nuts", length: float = 2.0, adapt: int = 100) -> Iterator[np.ndarray]:
    """Samples one at a time. method: hmc, hmc_da, nuts or nuts_da (da: the step size is fitted in the first ``adapt`` steps)."""
    rng, t = np.random.default_rng(seed), _Target(g)
    x = g.mean + rng.standard_normal(len(g.mean))
    step = first_step(t, x, rng)
    fit = _Averaging(step) if method.endswith("_da") else None
    for i in range((adapt if fit else 0) + n):
        if method.startswith("nuts"):
            x, accepted = _no_u_turn(t, x, step, rng)
        else:
            p = rng.standard_normal(len(x))
            y, q = x, p
            for _ in range(max(1, round(length / step))):
                y, q = leapfrog(t, y, q, step)
            accepted = float(np.exp(min(0.0, t.log(y) - 0.5 * q @ q - t.log(x) + 0.5 * p @ p)))
            if rng.random() < accepted:
                x = y
        if fit and i < adapt:
            step = fit.next(accepted)
            if i == adapt - 1:
                step = fit.final
        else:
            yield x


def sample(spark: SparkSession, g: Gaussian, n: int, chains: int = 4, seed: int = 0, method: str = "nuts") -> DataFrame:
    """chain, step and a column for each variable."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for c in frame["id"]:
                out = np.array(list(chain(g, n, seed + int(c), method)))
                yield pd.DataFrame({"chain": int(c), "step": np.arange(n), **{name: out[:, i] for i, name in enumerate(g.names)}})

    return spark.range(chains).repartition(chains).mapInPandas(run, "chain long, step long, " + ", ".join(f"`{x}` double" for x in g.names))
