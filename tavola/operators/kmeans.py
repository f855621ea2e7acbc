"""k-means for several k at once.

Every pass over the rows assigns them to the centres of all k together and sums
counts and components by (k, cluster) in the tasks; Spark adds these few rows up.
One more pass over the final centres gives the moments from which inertia,
Calinski-Harabasz and Davies-Bouldin follow, and one gives the silhouettes,
which need a row and the clusters' moments only.  First centres are drawn by
k-means++ from a bounded sample (``sample_rows``, by a hash of the row).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Z = "_z"  # array<double> of the scaled features


def spread_first(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: the next centre is drawn by squared distance to those there are."""
    rng = np.random.default_rng([seed, k])
    centres = sample[rng.integers(len(sample))][None]
    while len(centres) < k:
        gap = ((sample[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        share = gap / gap.sum() if gap.sum() > 0 else None
        centres = np.vstack([centres, sample[rng.choice(len(sample), p=share)]])
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centres[None]) ** 2).sum(axis=2)


def _summed(rows: DataFrame, width: int, per_batch: Callable[[np.ndarray, int], np.ndarray], centres: dict[int, np.ndarray],
            columns: int) -> dict[int, np.ndarray]:
    """Sum over all rows of ``per_batch(x, k)``, a clusters x columns array for each k."""
    names = [f"c{j}" for j in range(columns)]

    def run(batches):
        total = {k: np.zeros((k, columns)) for k in centres}
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                x = b.column(0).slice(at, 8192).flatten().to_numpy().reshape(-1, width)
                for k in centres:
                    total[k] += per_batch(x, k)
        ks = np.concatenate([np.full(k, k) for k in total]).astype(np.int32)
        clusters = np.concatenate([np.arange(k) for k in total]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(clusters), *(pa.array(c) for c in np.vstack(list(total.values())).T)],
                                         ["k", "cluster", *names])
    parts = rows.select(Z).mapInArrow(run, "k int, cluster int, " + ", ".join(f"{n} double" for n in names))
    out = {k: np.zeros((k, columns)) for k in centres}
    for r in parts.groupBy("k", "cluster").agg(*[F.sum(n).alias(n) for n in names]).collect():  # a row a centre
        out[r["k"]][r["cluster"]] = [r[n] for n in names]
    return out


def _by_cluster(cluster: np.ndarray, k: int, *columns: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(cluster, c, k) for c in columns], axis=1)


def fit_all(rows: DataFrame, ks: Sequence[int], seed: int = 42, rounds: int = 20, tol: float = 1e-4,
            sample_rows: int = 10_000) -> tuple[dict[int, np.ndarray], list[tuple]]:
    """Centres of every k, and (k, silhouette, inertia, calinski_harabasz, davies_bouldin) rows.

    ``rows`` has the scaled features as the array ``_z``, without nulls.  With
    fewer rows than k some centres coincide; without rows there are no centres."""
    rows = rows.select(Z).persist(StorageLevel.MEMORY_AND_DISK)  # read by every pass
    try:
        sample = np.array([r[0] for r in rows.orderBy(F.xxhash64(Z), Z).limit(sample_rows).collect()])
        if not len(sample):
            return {}, []
        width = sample.shape[1]
        centres = {k: spread_first(sample, k, seed) for k in ks}
        moving = set(ks)
        for _ in range(rounds):
            now = {k: centres[k] for k in moving}

            def assigned(x, k):
                return _by_cluster(_distances(x, now[k]).argmin(axis=1), k, np.ones(len(x)), *x.T)
            for k, s in _summed(rows, width, assigned, now, width + 1).items():
                some = s[:, 0] > 0
                new = centres[k].copy()
                new[some] = s[some, 1:] / s[some, :1]
                if ((new - centres[k]) ** 2).sum(axis=1).max() <= tol ** 2:
                    moving.discard(k)
                centres[k] = new
            if not moving:
                break

        def moments(x, k):
            gap = _distances(x, centres[k])
            c = gap.argmin(axis=1)
            near = gap[np.arange(len(x)), c]
            return _by_cluster(c, k, np.ones(len(x)), near, np.sqrt(near), (x * x).sum(axis=1), *x.T)
        found = _summed(rows, width, moments, centres, width + 4)

        def silhouettes(x, k):
            m = found[k]
            n, some = np.maximum(m[:, 0], 1), m[:, 0] > 0
            c = _distances(x, centres[k]).argmin(axis=1)
            apart = (x * x).sum(axis=1)[:, None] + m[:, 3] / n - 2 * x @ (m[:, 4:] / n[:, None]).T  # mean squared distance to each
            every = np.arange(len(x))
            own = apart[every, c] * n[c] / np.maximum(n[c] - 1, 1)
            apart[:, ~some] = np.inf
            apart[every, c] = np.inf
            other = apart.min(axis=1)
            with np.errstate(invalid="ignore"):
                s = np.where((n[c] > 1) & np.isfinite(other), (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
            return _by_cluster(c, k, s)
        means = {k: s.sum() / found[k][:, 0].sum() for k, s in _summed(rows, width, silhouettes, centres, 1).items()}
    finally:
        rows.unpersist()
    return centres, [(k, float(means[k]), *_indices(found[k], centres[k])) for k in ks]


def _indices(m: np.ndarray, centres: np.ndarray) -> tuple[float, float | None, float | None]:
    """Inertia, Calinski-Harabasz and Davies-Bouldin from the clusters' counts, squared and plain distances."""
    some = m[:, 0] > 0
    n, inertia, spread, at = m[some, 0], float(m[:, 1].sum()), m[some, 2] / m[some, 0], centres[some]
    k, total = len(n), n.sum()
    if k < 2 or total <= k or inertia <= 0:
        return inertia, None, None
    mean = (at * n[:, None]).sum(axis=0) / total
    between = (n * ((at - mean) ** 2).sum(axis=1)).sum()
    away = np.sqrt(_distances(at, at))
    with np.errstate(divide="ignore"):
        ratio = np.where(np.eye(k, dtype=bool), -np.inf, (spread[:, None] + spread) / away)
    return inertia, float(between / (k - 1) / (inertia / (total - k))), float(ratio.max(axis=1).mean())


def nearest(centres: Sequence[Sequence[float]]):
    """Column: number of the nearest centre of the row's ``_z`` (the first of equals)."""
    gaps = F.transform(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres]), lambda c: F.aggregate(
        F.zip_with(F.col(Z), c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b))
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")
