"""Window and ordered operators.

Keyed windows (per series, per customer, per conversation) partition on the
key, so the work spreads across tasks.  Un-keyed windows are only used on
tables that are small by construction: a daily series (one row per day) or
the k rows left after a top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import global_rank
from ..functions.scalars import scalar_value


def _win(key: str | Sequence[str] | None, order: str | Sequence[str]):
    order = [order] if isinstance(order, str) else list(order)
    w = Window.orderBy(*order)
    if key:
        keys = [key] if isinstance(key, str) else list(key)
        w = Window.partitionBy(*keys).orderBy(*order)
    return w


def lag_features(df: DataFrame, target: str, lags: Sequence[int] = (1, 7, 14, 28),
                 key: str | None = None, order: str = "date") -> DataFrame:
    """``target_lag_k`` = value k rows earlier in the series (row lags, M9)."""
    w = _win(key, order)
    for k in lags:
        df = df.withColumn(f"{target}_lag_{k}", F.lag(target, k).over(w))
    return df


def rolling_features(df: DataFrame, target: str, windows: Sequence[int] = (7, 14, 28),
                     key: str | None = None, order: str = "date", strict: bool = False) -> DataFrame:
    """Mean and sample std of the previous ``w`` rows (today excluded).

    ``strict`` (G6) needs all ``w`` earlier rows, else NULL (pandas
    ``rolling(w)`` then ``shift(1)``); otherwise ``min_periods=1`` (M8).
    """
    base = _win(key, order)
    for w in windows:
        frame = base.rowsBetween(-w, -1)
        mean = F.avg(target).over(frame)
        std = F.stddev_samp(target).over(frame)
        if strict:
            full = F.count(target).over(frame) == w
            mean, std = F.when(full, mean), F.when(full, std)
        df = (df.withColumn(f"{target}_rolling_mean_{w}", mean)
              .withColumn(f"{target}_rolling_std_{w}", std))
    return df


def moving_average(df: DataFrame, col: str, w: int = 7, key: str | None = None,
                   order: str = "date", out: str | None = None) -> DataFrame:
    """Mean of the last ``w`` rows including today; NULL until ``w`` rows exist."""
    frame = _win(key, order).rowsBetween(-(w - 1), 0)
    full = F.count(F.lit(1)).over(frame) == w
    return df.withColumn(out or f"{col}_ma{w}", F.when(full, F.avg(col).over(frame)))


def recent_items(tx: DataFrame, k: int = 10, cust: str = "customer_id", item: str = "item_id",
                 ts: str = "ts") -> DataFrame:
    """Each customer's last ``k`` distinct items by most recent purchase
    (ties on time by item id).  Aggregates to (customer, item) first."""
    last = tx.where(F.col(cust).isNotNull()).groupBy(cust, item).agg(F.max(ts).alias("last_ts"))
    w = Window.partitionBy(cust).orderBy(F.desc("last_ts"), F.asc(item))
    return last.withColumn("recency_rank", F.row_number().over(w)).where(F.col("recency_rank") <= k)


def autocorrelation(daily: DataFrame, col: str, max_lag: int, order: str = "date") -> DataFrame:
    """Pearson correlation of a daily series with itself shifted by 1..max_lag.

    The series has one row per day, so the row index comes from a window
    over a table that is small by construction; the lagged pairs come from
    a self join on index + lag."""
    idx = daily.select(F.row_number().over(Window.orderBy(order)).alias("_i"), F.col(col).cast("double").alias("_v"))
    a = idx.select("_i", "_v", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag")).alias("a")
    b = idx.alias("b")
    pairs = (a.join(b, F.col("b._i") == F.col("a._i") - F.col("lag"))
             .select("lag", F.col("a._v").alias("x"), F.col("b._v").alias("y")))
    return pairs.groupBy("lag").agg(F.corr("x", "y").alias("autocorr"), F.count(F.lit(1)).alias("n_pairs"))


def temporal_split(df: DataFrame, date: str, key: str, test: float = 0.2) -> DataFrame:
    """First ``int(n*(1-test))`` rows by (date, key) are ``train``, the rest
    ``test``.  Exact distributed rank; no single-partition window."""
    ranked = global_rank(df, [date, key], "_r")
    n = scalar_value(df.agg(F.count(F.lit(1)).alias("_n")))
    cut = F.floor(n * F.lit(1 - test))
    return (ranked.withColumn("split", F.when(F.col("_r") <= cut, "train").otherwise("test"))
            .withColumnRenamed("_r", "row_index"))


def time_series_folds(df: DataFrame, date: str, key: str, n_splits: int = 5) -> DataFrame:
    """Expanding-window folds: test size = n // (k+1); fold f trains on
    rows before its test block.  Emits (row, fold, role) for every fold a row
    takes part in (rows join at most k folds; no row is dropped)."""
    ranked = global_rank(df, [date, key], "_r")
    n = scalar_value(df.agg(F.count(F.lit(1)).alias("_n")))
    ts = F.floor(n / (n_splits + 1))
    first_train = n - n_splits * ts
    test_start = first_train + F.col("fold") * ts  # 0-based index of the first test row
    r0 = F.col("_r") - 1
    role = (F.when(r0 < test_start, "train")
            .when(r0 < test_start + ts, "test"))
    return (ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
            .withColumn("role", role).where(F.col("role").isNotNull())
            .withColumnRenamed("_r", "row_index"))


def lag_by_rank(df: DataFrame, key: str, order: Sequence[str], col: str, out: str) -> DataFrame:
    """Previous row's ``col`` within ``key`` (by ``order``), skew-proof.

    A per-key window sorts each key's rows in one task, so a key holding a
    third of the data would be one giant task.  Here every row gets its
    exact global rank by (key, order) from the range-partitioned
    ``global_rank`` (which cuts a hot key across many tasks), and the
    predecessor is the row with rank - 1: an equi join on a unique key."""
    ranked = global_rank(df, [key, *order], "_gr")
    prev = ranked.select((F.col("_gr") + 1).alias("_gr"), F.col(key).alias("_pk"), F.col(col).alias("_pv"))
    j = ranked.join(prev, "_gr", "left")
    return (j.withColumn(out, F.when(F.col("_pk") == F.col(key), F.col("_pv")))
            .drop("_pk", "_pv", "_gr"))


def last_turns(conv: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` turns of each conversation, in turn order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return conv.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
