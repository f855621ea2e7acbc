"""Parameter search: a tree-structured Parzen sampler.

After some random trials the best fraction of the scores so far is "good".  Each
parameter has two densities, over the good and the other trials: a mixture of
truncated normals around the tried values and one wide normal.  Of a number of
draws from the good density, the one whose ratio of densities is largest is tried
next.  Several trials are proposed at once, so that they can be fitted together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

# The search space (kind, low, high), by the names of ``boosting.Params``.
SEARCH_SPACE = {
    "rounds": ("int", 100, 1000),
    "rate": ("log", 0.01, 0.3),
    "max_depth": ("int", 3, 12),
    "leaves": ("int", 15, 127),
    "row_share": ("float", 0.5, 1.0),
    "column_share": ("float", 0.5, 1.0),
    "min_rows": ("int", 5, 100),
    "l1": ("log", 1e-8, 10.0),
    "l2": ("log", 1e-8, 10.0),
}


class Parzen:
    """Density over [low, high]: a normal at each point, as wide as the gap to its neighbours, and one over the range."""

    def __init__(self, points: Sequence[float], low: float, high: float):
        self.low, self.high = low, high
        self.mean = np.array([*sorted(points), (low + high) / 2])
        order = np.argsort(self.mean)
        edge = np.concatenate([[low], self.mean[order], [high]])
        gap = np.maximum(np.diff(edge)[:-1], np.diff(edge)[1:])
        self.width = np.empty(len(gap))
        least = (high - low) / min(100, 1 + len(gap))
        self.width[order] = np.clip(gap, least, high - low)
        self.width[-1] = high - low
        self.mass = np.array([_normal((high - m) / s) - _normal((low - m) / s) for m, s in zip(self.mean, self.width)])

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = np.empty(n)
        for k in range(n):
            while True:
                at = rng.integers(len(self.mean))
                out[k] = rng.normal(self.mean[at], self.width[at])
                if self.low <= out[k] <= self.high:
                    break
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.mean) / self.width
        each = np.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * self.width * self.mass)
        return np.log(each.mean(axis=1) + 1e-300)


def _normal(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


class Sampler:
    """Proposes points of a space from the trials told so far (smaller scores are better)."""

    def __init__(self, space: dict[str, tuple], seed: int = 42, startup: int = 10, draws: int = 24):
        self.space, self.startup, self.draws = space, startup, draws
        self.rng = np.random.default_rng(seed)
        self.points: list[dict] = []
        self.scores: list[float] = []

    def tell(self, point: dict, score: float) -> None:
        self.points.append(point)
        self.scores.append(score if math.isfinite(score) else math.inf)

    def propose(self) -> dict:
        n = len(self.scores)
        if n < self.startup:
            return {name: self._out(name, self.rng.uniform(*self._range(name))) for name in self.space}
        good = min(math.ceil(0.1 * n), 25)
        order = np.argsort(self.scores, kind="stable")
        point = {}
        for name in self.space:
            low, high = self._range(name)
            at = [self._in(name, self.points[k][name]) for k in order]
            better, worse = Parzen(at[:good], low, high), Parzen(at[good:], low, high)
            x = better.draw(self.rng, self.draws)
            point[name] = self._out(name, float(x[(better.log_density(x) - worse.log_density(x)).argmax()]))
        return point

    def _range(self, name: str) -> tuple[float, float]:
        kind, low, high = self.space[name]
        return (low - 0.5, high + 0.5) if kind == "int" else (math.log(low), math.log(high)) if kind == "log" else (low, high)

    def _in(self, name: str, value: float) -> float:
        return math.log(value) if self.space[name][0] == "log" else float(value)

    def _out(self, name: str, x: float):
        kind, low, high = self.space[name]
        if kind == "int":
            return int(min(max(round(x), low), high))
        return min(max(math.exp(x) if kind == "log" else x, low), high)
