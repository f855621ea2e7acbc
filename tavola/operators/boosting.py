"""Leaf-wise histogram gradient boosting.

Features are cut once into at most 255 bins by quantiles.  A tree grows best
leaf first: the leaf whose best split gains most is split next, up to a number
of leaves, with L1 / L2 penalties, row and column shares per tree and early
stopping on held-out rows.

The binned table is made once and written to the checkpoint folder.  A table of
at most ``task_rows`` rows is fitted by one task.  A larger one stays spread, a
block of columns a part: for each tree the parts keep the drawn rows' bins and
gradients, for each growth step they sum the histograms of the leaves that may
be split next, and only those sums (leaves x features x bins) reach the driver;
drawn rows, splits and leaf values are chosen by the same code either way.  Many
fits on the same folds (cross validation, search) run as one task each, or
spread where a fold is large; either way on all rows of the fold.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BINS = 255  # of a feature, the one for missing values (0) included
TASK_ROWS = 1 << 20  # a table of at most so many rows is fitted by one task
BLOCK_ROWS = 1 << 20  # rows of a part of a spread fit, about
MERGED_PARTS = 16  # the histograms of more parts are summed before they reach the driver
BINNED = "bins binary, y double, w double, u long, valid boolean"


@dataclass(frozen=True)
class Params:
    """What a fit is told; the defaults are those of the demand model."""

    rounds: int = 500
    rate: float = 0.05
    max_depth: int = 8
    leaves: int = 31
    row_share: float = 0.8
    column_share: float = 0.8
    min_rows: int = 20
    l1: float = 0.1
    l2: float = 0.1
    stop_after: int = 50  # rounds without a better loss on the held-out rows
    seed: int = 42


@dataclass
class Tree:
    """Parallel arrays over nodes; ``feature`` is -1 in a leaf.  Bins up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray
    depth: int

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        every = np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[at]
            goes = np.where(bins[every, f] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(f >= 0, goes, at)
        return at

    def values(self, cols: np.ndarray) -> np.ndarray:
        """The leaf value of every row of features x rows bins.

        Leaves are bits from left to right.  A split that sends a row right rules out the leaves on its left;
        the row's leaf is the first that no split on its features rules out, so each feature is looked up once."""
        if self.depth == 0:
            return np.full(cols.shape[1], self.value[0])
        if (self.feature < 0).sum() > 64:
            return self.value[self.leaf_of(np.ascontiguousarray(cols.T))]
        leaves, lookup = self._lookup()
        out = np.empty(cols.shape[1])
        for at in range(0, cols.shape[1], 1 << 16):
            left = np.uint64(0xFFFFFFFFFFFFFFFF)
            for f, masks in lookup:
                left = left & masks[cols[f, at:at + (1 << 16)]]
            out[at:at + (1 << 16)] = leaves[np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1))]
        return out

    def _lookup(self) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Leaf values from left to right and, for each feature, the leaves that each of its bins leaves."""
        leaves, masks, waiting, first = [], {}, [(0, False)], {}
        while waiting:  # a node's second visit lies between its left and its right part
            k, back = waiting.pop()
            if self.feature[k] < 0:
                leaves.append(self.value[k])
            elif not back:
                first[k] = len(leaves)
                waiting += [(int(self.right[k]), False), (k, True), (int(self.left[k]), False)]
            else:
                out = ((1 << len(leaves)) - (1 << first[k])) ^ 0xFFFFFFFFFFFFFFFF
                masks.setdefault(int(self.feature[k]), np.full(256, 0xFFFFFFFFFFFFFFFF, np.uint64))[self.cut[k] + 1:] &= np.uint64(out)
        return np.array(leaves), list(masks.items())

    def told(self) -> list:
        return [x.tolist() for x in (self.feature, self.cut, self.left, self.right, self.value, self.rows, self.gain)] + [self.depth]

    @classmethod
    def of(cls, told: list) -> Tree:
        ints, floats = (np.array(x, np.int64) for x in told[:4]), (np.array(x, float) for x in told[4:7])
        return cls(*ints, *floats, told[7])


@dataclass
class Booster:
    """A fitted model: bin edges of each feature, the starting value and the trees."""

    features: list[str]
    edges: list[np.ndarray]
    objective: str
    base: float
    trees: list[Tree] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)  # held-out loss after each round that was fitted

    def bins(self, x: np.ndarray) -> np.ndarray:
        return to_bins(x, self.edges)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        cols = np.ascontiguousarray(bins.T)
        for t in self.trees:
            out += t.values(cols)
        return out

    def finish(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-raw)) if self.objective == "logistic" else raw

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Of a rows x features array: the value, or the probability."""
        return self.finish(self.raw(self.bins(x)))

    def column(self) -> Column:
        """The prediction for a row that has the feature columns."""
        handle = SparkSession.active().sparkContext.broadcast(self)  # rounds x leaves nodes

        @F.pandas_udf("double")
        def predicted(batch: pd.Series) -> pd.Series:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, len(handle.value.features)))
            return pd.Series(handle.value.predict(x.astype(float)))
        return predicted(feature_array(self.features))

    def importance(self) -> dict[str, float]:
        """Share of all gain that the splits on each feature have."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return dict(zip(self.features, (total / total.sum() if total.sum() else total).tolist()))

    def text(self) -> str:
        return json.dumps({"features": self.features, "edges": [e.tolist() for e in self.edges], "objective": self.objective,
                           "base": self.base, "trees": [t.told() for t in self.trees], "curve": self.curve})

    @classmethod
    def of(cls, text: str) -> Booster:
        d = json.loads(text)
        return cls(d["features"], [np.array(e, float) for e in d["edges"]], d["objective"], d["base"],
                   [Tree.of(t) for t in d["trees"]], d["curve"])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.text(),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Booster:
        return cls.of(spark.read.parquet(path).first()["model"])


# --------------------------------------------------------------------------- binning
def feature_array(features: Sequence[str]) -> Column:
    """The features as doubles, null as NaN (an array without nulls, so Arrow hands it over whole)."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """0 for missing, else 1 and the number of edges below the value."""
    out = np.zeros(x.shape, np.uint8)
    for f, e in enumerate(edges):
        there = ~np.isnan(x[:, f])
        out[there, f] = 1 + np.searchsorted(e, x[there, f])
    return out


def quantile_edges(data: DataFrame, features: Sequence[str], most: int = BINS) -> list[np.ndarray]:
    """Distinct quantiles of every feature, from one aggregate over all rows."""
    steps = [k / (most - 1) for k in range(1, most - 1)]
    row = data.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), steps, 20_000).alias(f"_{k}")
                     for k, c in enumerate(features)]).first()
    return [np.unique(np.array(q or [], float)) for q in row]


def binned(data: DataFrame, features: Sequence[str], edges: Sequence[np.ndarray], label: str, weight: str | None = None,
           valid: Column | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """``BINNED`` and the ``extra`` (integer) columns of every row with a label."""
    n = len(features)
    schema = BINNED + "".join(f", {c} int" for c in extra)

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
            flat = to_bins(x, edges).tobytes()
            packed = pa.array([flat[k * n:(k + 1) * n] for k in range(b.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *b.columns[1:]], ["bins", "y", "w", "u", "valid", *extra])
    x = feature_array(features)
    return data.where(F.col(label).isNotNull()).select(
        x.alias("x"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        F.xxhash64(x, F.col(label).cast("double")).alias("u"), (valid if valid is not None else F.lit(False)).alias("valid"),
        *[F.col(c).cast("int").alias(c) for c in extra]).mapInArrow(run, schema)


@dataclass
class Rows:
    """Binned rows in memory."""

    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    u: np.ndarray
    valid: np.ndarray

    @classmethod
    def of(cls, batches: Sequence[pa.RecordBatch], n: int, ordered: bool = True) -> Rows:
        t = pa.Table.from_batches(batches)
        bins = np.concatenate([np.zeros(0, np.uint8), *(_data(c) for c in t.column("bins").chunks)]).reshape(-1, n)
        y, w, u = (t.column(c).to_numpy() for c in ("y", "w", "u"))
        valid = t.column("valid").to_numpy().astype(bool)
        if ordered:  # sums in one order, however the rows arrived
            order = np.lexsort((y, u))
            bins, y, w, u, valid = bins[order], y[order], w[order], u[order], valid[order]
        return cls(bins, y, w, u, valid)


def _data(a: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary array, one after the other."""
    if not len(a):
        return np.zeros(0, np.uint8)
    at = np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]


def picked(u: np.ndarray, round_: int, p: Params) -> np.ndarray:
    """Which rows the round's tree is fitted on: a hash of row and round, the same in every task."""
    x = u.view(np.uint64) ^ np.uint64((p.seed * 1_000_003 + round_ * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(11)).astype(float) / (1 << 53) < p.row_share


def round_columns(n: int, round_: int, p: Params) -> np.ndarray:
    rng = np.random.default_rng([p.seed, round_])
    return np.sort(rng.choice(n, max(1, math.ceil(n * p.column_share)), replace=False))


def gradients(raw: np.ndarray, y: np.ndarray, w: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    if objective == "logistic":
        q = 1 / (1 + np.exp(-raw))
        return (q - y) * w, np.maximum(q * (1 - q), 1e-12) * w
    return (raw - y) * w, w


def loss(raw: np.ndarray, y: np.ndarray, objective: str) -> np.ndarray:
    return np.logaddexp(0, raw) - y * raw if objective == "logistic" else (raw - y) ** 2


def histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray, width: int = BINS) -> np.ndarray:
    """Sums of gradient, second derivative and rows for each feature and bin (3 x features x bins)."""
    return column_sums(bins.T, np.arange(bins.shape[1]), None, g, h, width)


def column_sums(cols: np.ndarray, columns: np.ndarray, at: np.ndarray | None, g: np.ndarray, h: np.ndarray | None,
                width: int = BINS) -> np.ndarray:
    """``histogram`` of the rows ``at`` (None: all) of features x rows bins, for some of the features.
    Second derivatives that are all one (None) sum to the rows."""
    if at is not None:
        g, h = g[at], None if h is None else h[at]
    out = np.empty((3, len(columns), width))
    for j, f in enumerate(columns):
        b = (cols[f] if at is None else cols[f][at]).astype(np.intp)
        out[0, j] = np.bincount(b, g, width)
        out[2, j] = np.bincount(b, minlength=width)
        out[1, j] = out[2, j] if h is None else np.bincount(b, h, width)
    return out


# --------------------------------------------------------------------------- growing a tree
def _shrunk(g, l1):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(hist: np.ndarray, p: Params) -> tuple[float, int, int]:
    """(gain, feature, cut) of the best split; gain 0 if none is allowed."""
    low = hist.cumsum(axis=2)
    total = low[:, :1, -1:]
    low = low[:, :, :-1]
    high = total - low
    ok = (low[2] >= p.min_rows) & (high[2] >= p.min_rows) & (low[1] > 1e-9) & (high[1] > 1e-9)
    if not ok.any():
        return 0.0, -1, -1
    with np.errstate(all="ignore"):
        gain = (_shrunk(low[0], p.l1) ** 2 / (low[1] + p.l2) + _shrunk(high[0], p.l1) ** 2 / (high[1] + p.l2)
                - _shrunk(total[0], p.l1) ** 2 / (total[1] + p.l2))
    gain = np.where(ok, gain, 0.0)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


@dataclass
class Node:
    sums: np.ndarray  # gradient, second derivative, rows
    depth: int
    hist: np.ndarray | None = None
    split: tuple[float, int, int] = (0.0, -1, -1)
    children: tuple[int, int] | None = None  # opened: the children are known, perhaps before they are taken
    taken: bool = False


def grow(root: np.ndarray, opened: Callable, columns: np.ndarray, p: Params, ahead: bool) -> Tree:
    """Best leaf first.  ``opened(list of (node, feature, cut, left, right, which))`` gives the histogram of
    child ``which`` (0 left, 1 right) of each; the other child's is the difference.  ``ahead`` asks for the
    children of all leaves that could still be split, so that one pass serves several splits."""
    nodes = [Node(root[:, 0].sum(axis=1), 0, root)]
    nodes[0].split = best_split(root, p)
    front = [(-nodes[0].split[0], 0)] if nodes[0].split[0] > 0 else []
    leaves = 1
    while front and leaves < p.leaves:
        top = front[0][1]
        if nodes[top].children is None:
            closed = [k for _, k in sorted(front) if nodes[k].children is None]
            asked, where = [], []
            for k in closed[:p.leaves - leaves if ahead else 1]:
                node = nodes[k]
                _, f, cut = node.split
                left = node.hist[:, f, :cut + 1].sum(axis=1)
                pair = (Node(left, node.depth + 1), Node(node.sums - left, node.depth + 1))
                node.children = (len(nodes), len(nodes) + 1)
                nodes += pair
                fewer = int(pair[1].sums[2] < pair[0].sums[2])
                if node.depth + 1 < p.max_depth and max(x.sums[2] for x in pair) >= 2 * p.min_rows and leaves + 1 < p.leaves:
                    asked.append((k, int(columns[f]), cut, *node.children, fewer))
                    where.append((k, fewer))
                elif not ahead:
                    asked.append((k, int(columns[f]), cut, *node.children, -1))  # rows only
                    where.append(None)
            if asked:
                for at, hist in zip(where, opened(asked)):
                    if at is not None:
                        k, fewer = at
                        a, b = (nodes[c] for c in nodes[k].children)
                        small, large = (b, a) if fewer else (a, b)
                        small.hist, large.hist = hist, nodes[k].hist - hist
                        for x in (a, b):
                            x.split = best_split(x.hist, p)
        heapq.heappop(front)
        nodes[top].taken = True
        nodes[top].hist = None
        leaves += 1
        for c in nodes[top].children:
            if nodes[c].split[0] > 0:
                heapq.heappush(front, (-nodes[c].split[0], c))
    return _tree(nodes, columns, p)


def _tree(nodes: list[Node], columns: np.ndarray, p: Params) -> Tree:
    """The taken splits, numbered from the root down."""
    order, told = [0], []
    for k in order:
        node = nodes[k]
        if node.taken:
            gain, f, cut = node.split
            told.append((int(columns[f]), cut, len(order), len(order) + 1, 0.0, node.sums[2], gain))
            order += node.children
        else:
            g, h, _ = node.sums
            told.append((-1, -1, -1, -1, float(-_shrunk(g, p.l1) / (h + p.l2) * p.rate), node.sums[2], 0.0))
    columns_ = list(zip(*told))
    return Tree(*(np.array(c, np.int64) for c in columns_[:4]), *(np.array(c, float) for c in columns_[4:]),
                max(nodes[k].depth for k in order))


class Stopping:
    """The best held-out loss so far."""

    def __init__(self, after: int):
        self.after, self.best, self.at, self.curve = after, math.inf, 0, []

    def over(self, value: float) -> bool:
        self.curve.append(value)
        if value < self.best:
            self.best, self.at = value, len(self.curve)
        return self.after > 0 and len(self.curve) - self.at >= self.after


def base_value(y: float, objective: str) -> float:
    if objective != "logistic":
        return y
    q = min(max(y, 1e-6), 1 - 1e-6)
    return math.log(q / (1 - q))


def fit_rows(rows: Rows, features: list[str], edges: list[np.ndarray], objective: str, p: Params) -> Booster:
    """Fit on rows in memory, best prefix of the rounds by the held-out rows if there are any."""
    train = np.flatnonzero(~rows.valid)
    out = Booster(features, edges, objective, 0.0)
    if not len(train) or not rows.w[train].sum():
        return out
    out.base = base_value(float(np.average(rows.y[train], weights=rows.w[train])), objective)
    raw = np.full(len(rows.y), out.base)
    cols = np.ascontiguousarray(rows.bins.T)
    even = objective != "logistic" and bool((rows.w == 1).all())
    stop = Stopping(p.stop_after) if rows.valid.any() else None
    for t in range(p.rounds):
        columns = round_columns(len(features), t, p)
        some = train[picked(rows.u[train], t, p)]
        if not len(some):
            some = train
        g, h = gradients(raw, rows.y, rows.w, objective)
        h = None if even else h
        held = {0: some}

        def opened(asked):
            for k, f, cut, left, right, which in asked:
                at = held.pop(k)
                low = cols[f][at] <= cut
                held[left], held[right] = at[low], at[~low]
                small = held[(left, right)[which]] if which >= 0 else None
                yield None if small is None else column_sums(cols, columns, small, g, h)
        tree = grow(column_sums(cols, columns, some, g, h), opened, columns, p, ahead=False)
        out.trees.append(tree)
        raw += tree.values(cols)
        if stop and stop.over(float(loss(raw[rows.valid], rows.y[rows.valid], objective).mean())):
            break
        if not tree.depth and t > 2 * p.stop_after:
            break  # nothing left to split
    if stop:
        out.trees, out.curve = out.trees[:stop.at], stop.curve
    return out


# --------------------------------------------------------------------------- fitting a table
def fit(data: DataFrame, features: Sequence[str], label: str, p: Params, objective: str = "squared", weight: str | None = None,
        valid: Column | None = None, task_rows: int = TASK_ROWS) -> Booster:
    """A model of all rows with a label; rows where ``valid`` holds only stop it early."""
    spark, features = data.sparkSession, list(features)
    ensure_checkpoint_dir(spark)
    held_out = valid if valid is not None else F.lit(False)
    edges = quantile_edges(data.where(~held_out & F.col(label).isNotNull()), features)
    table = binned(data, features, edges, label, weight, valid).checkpoint()
    return _fit(table, task_rows, features, edges, objective, p)


def _fit(table: DataFrame, task_rows: int, features: list[str], edges: list[np.ndarray], objective: str, p: Params) -> Booster:
    """A model of a ``BINNED`` table."""
    train = F.col("valid") == F.lit(False)
    n, wsum, ysum, n_valid = table.agg(F.count(F.lit(1)), F.sum(F.when(train, F.col("w"))), F.sum(F.when(train, F.col("w") * F.col("y"))),
                                       F.count_if("valid")).first()
    if not wsum:
        return Booster(features, edges, objective, 0.0)
    if n <= task_rows:
        def run(batches):
            rows = Rows.of(list(batches), len(features))
            yield pa.RecordBatch.from_arrays([pa.array([fit_rows(rows, features, edges, objective, p).text()])], ["model"])
        return Booster.of(table.repartition(1).mapInArrow(run, "model string").first()["model"])
    return _fit_spread(table, n, features, edges, objective, p, base_value(ysum / wsum, objective), n_valid)


@dataclass
class Block:
    """The rows of a part: bins by feature, and the value so far."""

    cols: np.ndarray
    y: np.ndarray
    w: np.ndarray
    u: np.ndarray
    valid: np.ndarray
    raw: np.ndarray

    def later(self, trees: Sequence[Tree]) -> Block:
        raw = self.raw.copy()
        for t in trees:
            raw += t.values(self.cols)
        return replace(self, raw=raw)


def _blocks(table: DataFrame, count: int, n: int, base: float) -> RDD:
    """The rows in parts of about ``BLOCK_ROWS``, one block each."""
    def pack(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            rows = Rows.of(held, n, ordered=False)
            told = [np.ascontiguousarray(rows.bins.T), rows.y, rows.w, rows.u, rows.valid]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in told], ["bins", "y", "w", "u", "valid"])

    def unpacked(r):
        y, w, u, valid = (np.frombuffer(x, kind) for x, kind in zip(r[1:], (float, float, np.int64, bool)))
        return Block(np.frombuffer(r[0], np.uint8).reshape(n, -1), y, w, u, valid, np.full(len(y), base))
    cores = max(1, table.sparkSession.sparkContext.defaultParallelism)
    parts = cores * -(-count // (cores * min(BLOCK_ROWS, max(1, (1 << 28) // n))))
    return table.repartition(parts).mapInArrow(pack, "bins binary, y binary, w binary, u binary, valid binary").rdd.map(unpacked)


def _fit_spread(table: DataFrame, count: int, features: list[str], edges: list[np.ndarray], objective: str, p: Params, base: float,
                n_valid: int, renew: int = 4) -> Booster:
    """The same fit with the rows left where they are.  For each tree the parts apply the trees since the last
    renewal, draw the rows and keep their bins and gradients; the passes of its growth read only those.  Every
    ``renew`` rounds the rows are kept with their value so far.  A pass is a job of a few milliseconds' work for
    each block, so the blocks are an RDD, which needs no planning."""
    n = len(features)
    out = Booster(features, edges, objective, base)
    blocks = _blocks(table, count, n, base).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    recent: list[Tree] = []
    stop = Stopping(p.stop_after) if n_valid else None

    def begun(round_: int, columns: np.ndarray, trees: list[Tree]) -> RDD:
        """The drawn rows of each block (bins, gradients), their sums and the held-out loss."""
        def run(block):
            block = block.later(trees)
            lost = float(loss(block.raw[block.valid], block.y[block.valid], objective).sum())
            at = np.flatnonzero(~block.valid & picked(block.u, round_, p))
            g, h = gradients(block.raw[at], block.y[at], block.w[at], objective)
            if objective != "logistic" and (h == 1).all():
                h = None
            sub = np.stack([block.cols[f][at] for f in columns])
            return sub, g, h, column_sums(sub, np.arange(len(columns)), None, g, h), lost
        return blocks.map(run)

    def sums(drawn: RDD, columns: np.ndarray, splits: list, wanted: list[int]) -> list[np.ndarray]:
        """Histograms of the wanted nodes over all blocks."""
        where = {int(f): j for j, f in enumerate(columns)}
        every = np.arange(len(columns))

        def run(block):
            sub, g, h, _, _ = block
            held = {0: np.arange(len(g))}
            for node, f, cut, left, right, _ in splits:
                at = held.pop(node)
                low = sub[where[f]][at] <= cut
                held[left], held[right] = at[low], at[~low]
            for slot, node in enumerate(wanted):
                if len(held[node]):
                    yield slot, column_sums(sub, every, held[node], g, h)
        return _summed(drawn.flatMap(run), len(wanted), len(columns))

    try:
        for t in range(p.rounds + 1):
            columns = round_columns(n, t, p)
            drawn = begun(t, columns, recent).persist(StorageLevel.MEMORY_AND_DISK_DESER)
            try:
                if stop and t and stop.over(drawn.map(lambda block: block[4]).sum() / n_valid) or t == p.rounds:
                    break
                splits: list = []

                def opened(asked):
                    splits.extend(asked)
                    return sums(drawn, columns, splits, [(left, right)[which] for _, _, _, left, right, which in asked])
                root = _summed(drawn.map(lambda block: (0, block[3])), 1, len(columns))
                tree = grow(root[0], opened, columns, p, ahead=True)
            finally:
                drawn.unpersist()
            out.trees.append(tree)
            recent = [*recent, tree]
            if len(recent) >= renew:
                later = blocks.map(lambda block, trees=recent: block.later(trees)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
                later.foreach(lambda block: None)
                blocks.unpersist()
                blocks, recent = later, []
    finally:
        blocks.unpersist()
    if stop:
        out.trees, out.curve = out.trees[:stop.at], stop.curve
    return out


def _summed(each: RDD, slots: int, width: int) -> list[np.ndarray]:
    """Sums of the blocks' histograms, a slot each; those of many blocks are summed by tasks first."""
    parts = each.getNumPartitions()
    if parts > MERGED_PARTS:
        each = each.reduceByKey(lambda a, b: a + b, min(slots, parts))
    total = np.zeros((slots, 3, width, BINS))
    for slot, x in each.collect():  # slots x features x bins, of at most MERGED_PARTS parts
        total[slot] += x
    return list(total)


# --------------------------------------------------------------------------- many fits on the same folds
@dataclass
class Folds:
    """Folds binned once: all rows (``table``), the rows of each fold that one task fits, packed in one row
    (``packed``), and the rows of each larger one (``large``)."""

    table: DataFrame
    packed: DataFrame
    large: list[int]
    features: list[str]
    edges: list[np.ndarray]
    count: int
    objective: str


def binned_folds(folds: DataFrame, features: Sequence[str], label: str, valid: Column, objective: str = "squared",
                 weight: str | None = None, fold: str = "fold", fold_rows: int | None = None, task_rows: int = TASK_ROWS) -> Folds:
    """Bin the rows of all folds once.  A fit takes all rows of its fold, in one task if there are at most ``task_rows``.
    Only who asks for ``fold_rows`` gets fits on about so many rows a fold (by a hash of the row); no query does."""
    features = list(features)
    ensure_checkpoint_dir(folds.sparkSession)
    edges = quantile_edges(folds, features)
    source = folds.withColumns({"_valid": valid, "_fold": F.col(fold)})
    table = binned(source, features, edges, label, weight, F.col("_valid"), ["_fold"]).checkpoint()
    sizes = {r["_fold"]: r["n"] for r in table.groupBy("_fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a fold
    names = ["bins", "y", "w", "u", "valid"]

    def pack(t: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.select(names).schema) as out:
            out.write_table(t.select(names))
        return pa.table({"_fold": pa.array([t.column("_fold")[0].as_py()], pa.int32()),
                         "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    fitted = table
    if fold_rows is not None:
        share = F.lit(None)
        for k, n in sizes.items():
            share = F.when(F.col("_fold") == k, min(1.0, fold_rows / n)).otherwise(share)
        fitted = table.where(F.pmod(F.xxhash64("u", F.lit(77)), F.lit(1_000_003)) / 1_000_003.0 < share)
    large = sorted(k for k, n in sizes.items() if fold_rows is None and n > task_rows)
    packed = fitted.where(~F.col("_fold").isin(large)).groupBy("_fold").applyInArrow(pack, "_fold int, rows binary").checkpoint()
    return Folds(table, packed, large, features, edges, len(sizes), objective)


def fit_folds(folds: Folds, trials: Sequence[tuple[int, Params]]) -> list[tuple[int, int, Booster]]:
    """A model for each trial and fold, one task each (the rows of a large fold spread): (trial, fold, model)."""
    spark = folds.table.sparkSession
    jobs = spark.createDataFrame([(t, json.dumps(asdict(p))) for t, p in trials], "trial int, params string")
    each = jobs.crossJoin(folds.packed)  # trials x folds rows, each a fold of bounded size
    features, edges, objective = folds.features, folds.edges, folds.objective

    def run(batches):
        for b in batches:
            for trial, params, fold, rows in zip(*(b.column(c).to_pylist() for c in ("trial", "params", "_fold", "rows"))):
                t = pa.ipc.open_stream(rows).read_all()
                model = fit_rows(Rows.of(t.to_batches(), len(features)), features, edges, objective, Params(**json.loads(params)))
                yield pa.RecordBatch.from_arrays([pa.array([trial], pa.int32()), pa.array([fold], pa.int32()),
                                                  pa.array([model.text()])], ["trial", "fold", "model"])
    done = each.coalesce(1).repartition(len(trials) * max(1, folds.count)).mapInArrow(run, "trial int, fold int, model string")
    models = [(r.trial, r.fold, Booster.of(r.model)) for r in done.collect()]  # rounds x leaves nodes each

    def spread(job):
        (trial, p), fold = job
        rows = folds.table.where(F.col("_fold") == fold).select("bins", "y", "w", "u", "valid")
        return trial, fold, _fit(rows, 0, features, edges, objective, p)
    with ThreadPoolExecutor(4) as pool:  # the passes of one fit run while the driver grows the tree of another
        models += pool.map(spread, [(t, k) for t in trials for k in folds.large])
    return sorted(models, key=lambda r: r[:2])


def scores(folds: Folds, models: Sequence[tuple[int, int, Booster]]) -> DataFrame:
    """``trial``, ``fold``, ``n``, ``mae``, ``rmse``, ``r2`` over all held-out rows of each model's fold."""
    spark = folds.table.sparkSession
    handle = spark.sparkContext.broadcast(list(models))
    width = len(folds.features)
    names = ["trial", "_fold", "n", "ae", "se", "y", "yy"]

    def run(batches):
        total = {}
        for b in batches:
            if not b.num_rows:
                continue
            rows = Rows.of([b.select(["bins", "y", "w", "u", "valid"])], width, ordered=False)
            fold = b.column("_fold").to_numpy()
            for trial, k, model in handle.value:
                here = fold == k
                if here.any():
                    y = rows.y[here]
                    gap = model.finish(model.raw(rows.bins[here])) - y
                    row = np.array([len(y), np.abs(gap).sum(), (gap ** 2).sum(), y.sum(), (y ** 2).sum()])
                    total[trial, k] = total.get((trial, k), 0) + row
        keys, sums = list(total), list(total.values())
        yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keys], pa.int32()) for j in (0, 1)]
                                         + [pa.array([float(s[j]) for s in sums], pa.float64()) for j in range(5)], names)
    parts = folds.table.where("valid").mapInArrow(run, "trial int, _fold int, n double, ae double, se double, y double, yy double")
    s = parts.groupBy("trial", F.col("_fold").alias("fold")).agg(*[F.sum(c).alias(c) for c in names[2:]])
    spread = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    return s.select("trial", "fold", F.col("n").cast("long").alias("n"), (F.col("ae") / F.col("n")).alias("mae"),
                    F.sqrt(F.col("se") / F.col("n")).alias("rmse"), F.when(spread > 0, 1 - F.col("se") / spread).alias("r2"))
