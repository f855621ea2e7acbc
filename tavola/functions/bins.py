"""Distributed global rank and quantile bins.

``global_rank`` is an exact first-come rank over a whole table without a
single-partition window: range-partition on the sort key (plus a unique key so
that one hot value is still split across tasks), sort inside each partition,
number rows with ``monotonically_increasing_id`` (partition id in the high
bits, position in the low bits), and reliably checkpoint that result so a
retried task sees the same numbering.  Per-partition counts (one row per
partition, a proven size bound) become offsets through a broadcast join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .scalars import scalar_value

_LOW_BITS = (1 << 33) - 1


def _sort_exprs(order: Sequence) -> list[Column]:
    out = []
    for o in order:
        if isinstance(o, tuple):
            name, asc = o
            c = F.col(name)
            out.append(c.asc_nulls_first() if asc else c.desc_nulls_last())
        elif isinstance(o, str):
            out.append(F.col(o).asc_nulls_first())
        else:
            out.append(o)
    return out


def global_rank(df: DataFrame, order: Sequence, rank_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based row rank following ``order`` (ties must be broken by a key).

    ``order`` items are column names (ascending) or ``(name, ascending)`` pairs.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    exprs = _sort_exprs(order)
    nparts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = (df.repartitionByRange(nparts, *exprs)
                .sortWithinPartitions(*exprs)
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    numbered = (numbered
                .withColumn("_pid", F.shiftright("_mid", 33))
                .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))
    # one row per partition: bounded by the partition count, safe to broadcast
    offsets = (numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(
                   Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select("_pid", "_off"))
    return (numbered.join(F.broadcast(offsets), "_pid")
            .withColumn(rank_col, (F.col("_off") + F.col("_idx") + 1).cast("long"))
            .drop("_mid", "_pid", "_idx", "_off"))


def rank_bin_expr(rank_col: str, n_col: str, q: int) -> Column:
    """M4: pandas ``qcut(rank(method='first'), q)`` label 1..q from rank and n."""
    r, n = F.col(rank_col).cast("double"), F.col(n_col).cast("double")
    return (F.when(n <= 1, F.lit(1))
            .otherwise(F.greatest(F.lit(1), F.ceil((r - 1) * q / (n - 1)).cast("int")))).cast("int")


def rank_bins(df: DataFrame, col: str, q: int, key: str, out: str) -> DataFrame:
    """G1: rank-quantile bin of ``col`` (ascending, ties in ``key`` order)."""
    ranked = global_rank(df, [col, key], "_rank")
    n = scalar_value(df.agg(F.count(F.lit(1)).alias("_n")))
    return (ranked.withColumn("_n", n)
            .withColumn(out, rank_bin_expr("_rank", "_n", q))
            .drop("_rank", "_n"))


def quantile_fractions(q: int) -> list[float]:
    """Inner quantile fractions exactly as pandas ``qcut`` builds them."""
    return [float(x) for x in np.linspace(0, 1, q + 1)[1:-1]]


def exact_quantiles(df: DataFrame, col: str, fractions: Sequence[float], key: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (Spark ``percentile``'s rule)
    without gathering the values into one task.

    The non-null values are ranked with ``global_rank`` (range partitioned,
    sorted per partition); only the at most ``2 * len(fractions)`` rows at the
    needed ranks are joined back, and each quantile is
    ``(hi - pos) * x[lo] + (pos - lo) * x[hi]`` with ``pos = (n - 1) * p``.
    Returns one row with ``_edges``: the quantiles in the order given."""
    spark = df.sparkSession
    tie = F.col(key) if key else F.monotonically_increasing_id()
    x = df.select(F.col(col).cast("double").alias("_x"), tie.alias("_k")).where(F.col("_x").isNotNull())
    ranked = global_rank(x, ["_x", "_k"], "_r")
    n = scalar_value(ranked.agg(F.count(F.lit(1)).alias("_n")))
    pts = (spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(fractions)])).alias("s"))
        .select("s.*")
        .withColumn("pos", (n - 1).cast("double") * F.col("p"))
        .withColumn("lo", F.floor("pos").cast("long")).withColumn("hi", F.ceil("pos").cast("long")))
    need = pts.select(F.col("lo").alias("_pos")).union(pts.select(F.col("hi").alias("_pos"))).distinct()
    # 0-based position = rank - 1; ``need`` has at most 2 * len(fractions) rows
    vals = ranked.join(F.broadcast(need), F.col("_r") - 1 == F.col("_pos")).select("_pos", "_x")
    lo = vals.select(F.col("_pos").alias("lo"), F.col("_x").alias("x_lo"))
    hi = vals.select(F.col("_pos").alias("hi"), F.col("_x").alias("x_hi"))
    e = pts.join(lo, "lo").join(hi, "hi")
    edge = F.when(F.col("hi") == F.col("lo"), F.col("x_lo")).otherwise(
        (F.col("hi").cast("double") - F.col("pos")) * F.col("x_lo")
        + (F.col("pos") - F.col("lo").cast("double")) * F.col("x_hi"))
    return (e.agg(F.sort_array(F.collect_list(F.struct("i", edge.alias("v")))).alias("_s"))
            .select(F.transform("_s", lambda s: s["v"]).alias("_edges")))


def quantile_edges(df: DataFrame, col: str, q: int, accuracy: int | None = None,
                   key: str | None = None, method: str = "rank") -> DataFrame:
    """One-row frame with the inner value-quantile edges as ``_edges``.

    ``method='rank'`` (default) is exact and distributed (``exact_quantiles``);
    ``'map'`` is Spark's exact ``percentile`` (one value-count map merged in
    one task: only for columns with few distinct values); ``accuracy`` gives
    ``percentile_approx``."""
    fracs = quantile_fractions(q)
    if accuracy:
        fr = F.array(*[F.lit(f) for f in fracs])
        return df.agg(F.percentile_approx(F.col(col).cast("double"), fr, accuracy).alias("_edges"))
    if method == "map":
        fr = F.array(*[F.lit(f) for f in fracs])
        return df.agg(F.percentile(F.col(col).cast("double"), fr).alias("_edges"))
    return exact_quantiles(df, col, fracs, key)


def quantile_bins(df: DataFrame, col: str, q: int, out: str, reverse: bool = False,
                  labels: Sequence[str] | None = None, accuracy: int | None = None,
                  key: str | None = None, method: str = "rank") -> DataFrame:
    """Right-closed value-quantile bin, 1..q (or ``labels``).

    ``bin = 1 + #{inner edges e : x > e}``; stays defined when edges tie.
    ``accuracy`` switches to ``percentile_approx`` for very large inputs.
    """
    edges = scalar_value(quantile_edges(df, col, q, accuracy, key, method))
    x = F.col(col).cast("double")
    b = F.lit(1)
    for j in range(1, q):
        b = b + F.when(x > F.element_at(edges, j), 1).otherwise(0)
    if reverse:
        b = F.lit(q + 1) - b
    res = df.withColumn(out, b.cast("int"))
    if labels is not None:
        arr = F.array(*[F.lit(s) for s in labels])
        res = res.withColumn(out, F.element_at(arr, F.col(out)))
    return res
