"""Nearest neighbours by balanced posting lists (operator 1).

A bounded sample is split again and again into halves of equal size; the means
of the parts are the centroids, so lists come out balanced.  Centroids are
linked in a small graph that every task holds in memory and searches best-first.
Every vector is indexed: it joins the list of its nearest centroid and, near a
boundary, those of further centroids that are almost as near.  A query visits the lists whose centroids lie within a ratio
of its nearest centroid's distance, and at least as many as hold enough vectors.

Neighbouring lists share a shard of about ``shard_bytes``; a larger list has several shards.  Equal vectors are
one entry of the index that keeps its smallest ids, as many as any query can
return, and equal queries are searched once; so a vector that a third of all
rows share costs no more than others, and no result is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written


@dataclass
class CentroidGraph:
    """Centroids with links to near ones; ``search`` is a best-first walk for many vectors at a time."""
    centroids: np.ndarray   # c x d
    links: np.ndarray       # c x degree
    entry: np.ndarray       # where walks begin

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = 24) -> CentroidGraph:
        c = len(centroids)
        degree = min(degree, c - 1)
        near = np.empty((c, degree), np.int64)
        square = (centroids ** 2).sum(axis=1)
        for at in range(0, c, 1024):
            d = square - 2 * centroids[at:at + 1024] @ centroids.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at:at + 1024] = np.argsort(d, axis=1, kind="stable")[:, :degree]
        rng = np.random.default_rng(5)
        far = rng.integers(0, c, (c, min(8, c)))  # a few long links keep far parts in reach
        entry = np.unique(np.linspace(0, c - 1, min(c, 32)).astype(np.int64))
        return cls(centroids, np.concatenate([near, far], axis=1), entry)

    def distances(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.centroids[at] - x[:, None, :]) ** 2).sum(axis=2))

    def all_distances(self, x: np.ndarray) -> np.ndarray:
        """Distances to every centroid, without a walk."""
        square = (x ** 2).sum(axis=1)[:, None] + (self.centroids ** 2).sum(axis=1) - 2 * x @ self.centroids.T
        return np.sqrt(np.maximum(square, 0))

    def search(self, x: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances (rows x centroids, infinite where unseen) found by walking from each row's nearest on.

        A walk opens the nearest centroid not yet opened, sees those linked to
        it, and ends when ``least`` are open and the next lies beyond ``ratio``
        times the nearest one's distance.
        """
        n, c = len(x), len(self.centroids)
        if c <= 64:
            return self.distances(x, np.broadcast_to(np.arange(c), (n, c)))
        rows = np.arange(n)
        seen = np.full((n, c), np.inf)
        seen[:, self.entry] = self.distances(x, np.broadcast_to(self.entry, (n, len(self.entry))))
        waiting = seen.copy()  # as seen, but infinite once opened
        opened = 0
        while len(rows):
            pick = waiting[rows].argmin(axis=1)
            near = waiting[rows, pick]
            go = np.isfinite(near) & ((opened < least) | (near <= ratio * seen[rows].min(axis=1)))
            rows, pick = rows[go], pick[go]
            waiting[rows, pick] = np.inf
            new = self.links[pick]
            away = self.distances(x[rows], new)
            fresh = np.isinf(seen[rows[:, None], new])
            seen[rows[:, None], new] = away
            waiting[rows[:, None], new] = np.where(fresh, away, waiting[rows[:, None], new])
            opened += 1
        return seen


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of parts of equal size: each part is halved where its two centres' bisector balances it."""
    parts = [x]
    rng = np.random.default_rng(11)
    while len(parts) < lists and max(map(len, parts)) > 1:
        halves = []
        for p in parts:
            if len(p) < 2:
                halves.append(p)
                continue
            a, b = p[rng.integers(len(p))], p[rng.integers(len(p))]
            for _ in range(6):
                side = p @ (b - a)
                upper = side > np.median(side)
                if upper.all() or not upper.any():
                    break
                a, b = p[~upper].mean(axis=0), p[upper].mean(axis=0)
            order = np.argsort(p @ (b - a), kind="stable")
            halves += [p[order[:len(p) // 2]], p[order[len(p) // 2:]]]
        parts = halves
    return np.unique(np.stack([p.mean(axis=0) for p in parts if len(p)]), axis=0)


def _matrix(batch: pa.RecordBatch | pa.Table, name: str = "v") -> np.ndarray:
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(batch.num_rows, -1)


def _lists(graph, ratio: float, copies: int):
    """(cluster, vec_id, v) rows: the nearest list, and near a boundary the next ones within ``ratio``."""
    def run(batches):
        g = graph.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                dist = g.search(_matrix(batch), ratio, 2 * copies)
                nearest = np.argsort(dist, axis=1, kind="stable")[:, :copies]
                away = np.take_along_axis(dist, nearest, axis=1)
                rows, place = np.nonzero(away <= ratio * away[:, :1])
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(nearest[rows, place].astype(np.int32)), taken.column("vec_id"),
                                                  taken.column("v")], ["cluster", "vec_id", "v"])
    return run


def _paths(graph: CentroidGraph, sizes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the lists by distance, their distances, and the vectors in the lists before each."""
    dist = graph.all_distances(x)
    path = np.argsort(dist, axis=1, kind="stable")
    return path, np.take_along_axis(dist, path, axis=1), np.cumsum(sizes[path], axis=1) - sizes[path]


def _visits(graph, sizes: np.ndarray, ratio: float, least: int, shards: np.ndarray):
    """(shard, query, v, clusters) rows: lists within the distance ratio, and as many as hold ``least`` vectors."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                path, near, before = _paths(graph.value, sizes, _matrix(batch))
                wide = (near <= ratio * near[:, :1]) | (before < least)
                rows, where, lists = [], [], []
                for r in range(len(path)):
                    visited: dict[int, list[int]] = {}
                    for c in path[r, wide[r]].tolist():
                        for shard in range(shards[c, 0], shards[c, 0] + shards[c, 1]):
                            visited.setdefault(shard, []).append(c)
                    rows += [r] * len(visited)
                    where += visited.keys()
                    lists += visited.values()
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), taken.column("query"), taken.column("v"),
                     pa.array(lists, pa.list_(pa.int32()))], ["shard", "query", "v", "clusters"])
    return run


NEAR = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _first(names: np.ndarray, ids: np.ndarray, d: np.ndarray, found: int) -> list[np.ndarray]:
    """Of each name the ``found`` nearest distinct ids, ties to the smaller id."""
    order = np.lexsort((d, ids, names))
    names, ids, d = names[order], ids[order], d[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (names[1:] != names[:-1])  # a copy in another list
    names, ids, d = names[new], ids[new], d[new]
    order = np.lexsort((ids, d, names))
    names, ids, d = names[order], ids[order], d[order]
    start = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, int)
    rank = np.arange(len(names)) - np.repeat(start, np.diff(np.append(start, len(names))))
    return [names[rank < found], ids[rank < found], d[rank < found]]


def _nearest(found: int):
    """The ``found`` nearest in the visited lists of one shard for each query; exact, in double precision."""
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return NEAR.empty_table()
        cluster, ids = vectors.column("cluster").to_numpy(), vectors.column("vec_id").to_numpy()
        order = np.lexsort((ids, cluster))
        cluster, ids, x = cluster[order], ids[order], _matrix(vectors)[order]
        names, q = queries.column("query").to_numpy(), _matrix(queries)
        visitors: dict[int, list[int]] = {}
        for k, lists in enumerate(queries.column("clusters").to_pylist()):
            for c in lists:
                visitors.setdefault(c, []).append(k)
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        held = [out]
        for c, who in visitors.items():
            low, high = np.searchsorted(cluster, [c, c + 1])
            step = max(1, (1 << 21) // max(1, (high - low) * x.shape[1]))
            for at in range(0, len(who) if high > low else 0, step):
                part = np.array(who[at:at + step])
                d = np.sqrt(((x[None, low:high] - q[part][:, None]) ** 2).sum(axis=2))
                best = np.argsort(d, axis=1, kind="stable")[:, :found]  # ties: smaller id first
                held.append([np.repeat(names[part], best.shape[1]), ids[low:high][best].ravel(),
                             np.take_along_axis(d, best, axis=1).ravel()])
            if sum(len(h[0]) for h in held) > 1 << 20:
                held = [_first(*map(np.concatenate, zip(*held)), found)]
        return pa.table(_first(*map(np.concatenate, zip(*held)), found), schema=NEAR)
    return run


def _true(sample, bound: np.ndarray, found: int):
    """(query, vec_id, score) rows: the ``found`` nearest of each sampled row in one task, none beyond its ``bound``."""
    def run(batches):
        q = sample.value
        held = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x, ids = _matrix(batch), batch.column("vec_id").to_numpy()
                square = (q ** 2).sum(axis=1)[:, None] + (x ** 2).sum(axis=1) - 2 * q @ x.T
                scale = (q ** 2).sum(axis=1)[:, None] + (x ** 2).sum(axis=1)
                rows, near = np.nonzero(square <= bound[:, None] ** 2 + 1e-9 * scale)
                held.append([rows, ids[near], np.sqrt(((x[near] - q[rows]) ** 2).sum(axis=1))])
                if sum(len(h[0]) for h in held) > 1 << 17:
                    held = [_first(*map(np.concatenate, zip(*held)), found)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, _first(*map(np.concatenate, zip(*held)), found))], schema=NEAR)
    return run


def _holders(sample, names: np.ndarray, ids: np.ndarray, scores: np.ndarray):
    """(pair, cluster) rows: the lists that hold the vector of each true (sampled row, neighbour) pair."""
    def run(batches):
        q = sample.value
        order = np.argsort(ids, kind="stable")
        by_id = ids[order]
        for whole in batches:
            own = whole.column("vec_id").to_numpy()
            low, high = np.searchsorted(by_id, own, "left"), np.searchsorted(by_id, own, "right")
            taken = whole.take(pa.array(np.flatnonzero(high > low)))
            times = (high - low)[high > low]
            row = np.repeat(np.arange(len(times)), times)
            pair = order[np.repeat(low[high > low], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)]
            x = _matrix(taken)[row] if len(row) else np.zeros((0, q.shape[1]))
            right = np.sqrt(((x - q[names[pair]]) ** 2).sum(axis=1)) <= scores[pair] * (1 + 1e-12)  # an id may have other vectors
            yield pa.RecordBatch.from_arrays([pa.array(pair[right].astype(np.int32)),
                                              pa.array(taken.column("cluster").to_numpy()[row][right])], ["pair", "cluster"])
    return run


def visit_rule(index: DataFrame, posted: DataFrame, asked: DataFrame, fit: pa.Table, graph, sizes: np.ndarray, k: int,
               recall: float, ratio: float, least: int, measured: int) -> tuple[float, int]:
    """``ratio`` and ``least``, one of them widened where ``measured`` queries find less than ``recall`` with them.

    The sample is held against every vector, so what assignment and list sizes lose on this table is in the figure.
    """
    context = index.sparkSession.sparkContext
    # Another order than the sample's that the lists are fitted on: those vectors lie nearer to their centroids.
    some = asked.orderBy(F.xxhash64(F.lit("measured"), "vec_id"), "vec_id").limit(measured).toArrow()
    if not some.num_rows:
        return ratio, least
    q, own = _matrix(some), some.column("vec_id").to_numpy()
    first = np.unique(fit.column("vec_id").to_numpy(), return_index=True)[1]
    x, bound = _matrix(fit)[first], np.full(len(q), np.inf)
    for at in range(0, len(q) if len(x) > k else 0, 64):  # the k + 1 nearest of some are no nearer than those of all
        square = (q[at:at + 64] ** 2).sum(axis=1)[:, None] + (x ** 2).sum(axis=1) - 2 * q[at:at + 64] @ x.T
        bound[at:at + 64] = np.sqrt(np.maximum(np.partition(square, k, axis=1)[:, k], 0))
    sample = context.broadcast(q)
    ranked = Window.partitionBy("query").orderBy("score", "vec_id")
    true = (index.mapInArrow(_true(sample, bound, k + 1), "query long, vec_id long, score double")
            .groupBy("query", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k + 1).toArrow())
    names, ids, scores = (true.column(c).to_numpy() for c in ("query", "vec_id", "score"))
    other = ids != own[names]
    names, ids, scores = _first(names[other], ids[other], scores[other], k)
    if not len(names):
        return ratio, least
    held = posted.mapInArrow(_holders(sample, names, ids, scores), "pair int, cluster int").toArrow()
    pair, cluster = held.column("pair").to_numpy(), held.column("cluster").to_numpy()

    path, near, before = _paths(graph.value, sizes, q)
    place = np.empty_like(path)
    np.put_along_axis(place, path, np.arange(path.shape[1])[None], axis=1)
    at = np.full(len(names), path.shape[1])  # of each pair, the first list on the query's path that holds it
    np.minimum.at(at, pair, place[names[pair], cluster])
    at = np.minimum(at, path.shape[1] - 1)
    far, rows = near[names, at], before[names, at]
    within = far <= ratio * near[names, 0]
    enough = rows < least
    most = max(0, math.ceil(recall * len(names)) - 1)
    if (within | enough).sum() > most:
        return ratio, least
    with np.errstate(divide="ignore", invalid="ignore"):
        wider = np.sort(np.where(within | enough, 0.0, far / near[names, 0]))[most]
    wider = max(ratio, float(np.nextafter(wider * (1 + 1e-9), np.inf)))
    more = max(least, int(np.sort(np.where(within | enough, 0, rows + 1))[most]))
    visited = [np.where((near <= r * near[:, :1]) | (before < m), sizes[path], 0).sum() for r, m in ((wider, least), (ratio, more))]
    return (wider, least) if np.isfinite(wider) and visited[0] <= visited[1] else (ratio, more)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, list_rows: int = 128,
                       sample_rows: int = 20_000, boundary_ratio: float = 1.03, copies: int = 3,
                       visit_ratio: float = 1.15, visit_rows: int = 64, shard_bytes: int = 8 << 20,
                       recall: float = 0.97, measured: int = 256,
                       id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k nearest found by Euclidean distance.

    Vectors that are null, zero, or hold a null or non-finite component take no
    part, nor do rows without an id or of another dimension than most; a query
    does not find its own id.  Rows of equal id and vector are one; an id with
    several vectors counts by the nearest.  With fewer than k candidates all are
    returned; an empty table gives no rows.  The index is fitted on at most
    ``sample_rows`` vectors, chosen by a hash of their id, and holds all.
    ``visit_ratio`` and ``visit_rows`` are the least that is visited; ``visit_rule``
    widens one of them until ``measured`` queries find ``recall`` of their neighbours.
    """
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col).cast("array<double>"), lambda e: e + F.lit(0.0))  # -0.0 as 0.0
        bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))
        return (df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
                .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
                .where(~F.exists("v", bad) & F.exists("v", lambda e: e != 0)))

    shapes = valid(vectors).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    result = "query_id long, rank int, vec_id long, score double"
    if shapes is None:
        return spark.createDataFrame([], result)
    right = F.size("v") == shapes["d"]
    same = Window.partitionBy("v").orderBy("vec_id")
    index = (valid(vectors).where(right).groupBy("v", "vec_id").agg(F.lit(1).alias("_"))
             .withColumn("_", F.row_number().over(same)).where(F.col("_") <= k + 1).select("vec_id", "v").transform(written))
    asked = valid(queries).where(right).groupBy("v", "vec_id").agg(F.lit(1).alias("_")).drop("_").transform(written)
    distinct = asked.groupBy("v").agg(F.min("vec_id").alias("query")).transform(written)

    n = index.count()
    sample_rows = max(1000, min(sample_rows, (1 << 25) // (8 * shapes["d"])))  # 32 MB at most
    fit = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec_id", "v").toArrow()
    lists = min(max(1, n // list_rows), max(1, sample_rows // 8))
    graph = spark.sparkContext.broadcast(CentroidGraph.build(balanced_centroids(_matrix(fit), lists)))

    posted = index.mapInArrow(_lists(graph, boundary_ratio, copies), "cluster int, vec_id long, v array<double>").transform(written)
    sizes = np.zeros(len(graph.value.centroids), np.int64)
    for row in posted.groupBy("cluster").count().collect():  # a row for each centroid
        sizes[row["cluster"]] = row["count"]
    ratio, least = visit_rule(index, posted, asked, fit, graph, sizes, k, recall, visit_ratio,
                              max(visit_rows, copies * (k + 1)), measured)
    shard_rows = max(1, shard_bytes // (8 * shapes["d"]))
    shards, shard, held = np.zeros((len(sizes), 2), np.int64), 0, 0
    for c, size in enumerate(sizes.tolist()):  # neighbouring lists share a shard; a large list has several
        if held and held + size > shard_rows:
            shard, held = shard + 1, 0
        shards[c] = shard, max(1, -(-size // shard_rows))
        shard, held = (shard + int(shards[c, 1]), 0) if shards[c, 1] > 1 else (shard, held + size)
    placed = spark.createDataFrame([(c, int(a), int(b)) for c, (a, b) in enumerate(shards)],
                                   "cluster int, first int, shards int")
    posted = posted.join(F.broadcast(placed), "cluster").select(
        F.expr("first + int(pmod(xxhash64(vec_id), shards))").alias("shard"), "cluster", "vec_id", "v")
    visits = distinct.mapInArrow(_visits(graph, sizes, ratio, least, shards),
                                 "shard int, query long, v array<double>, clusters array<int>")
    near = (posted.groupBy("shard").cogroup(visits.groupBy("shard"))
            .applyInArrow(_nearest(k + 1), "query long, vec_id long, score double")
            .groupBy("query", "vec_id").agg(F.min("score").alias("score")))
    ranked = Window.partitionBy("query").orderBy("score", "vec_id")
    near = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k + 1).drop("rank").transform(written)
    named = asked.join(distinct, "v").select(F.col("vec_id").alias("query_id"), "query").transform(written)
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (named.join(near, "query").where("query_id <> vec_id")
            .groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
