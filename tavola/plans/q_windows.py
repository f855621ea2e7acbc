"""Window and ordered queries (G*) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bins import quantile_bins, rank_bins
from ..functions.rounding import round_even
from ..operators import reports as R
from ..operators import windows as W
from ..sources import driver as D
from .registry import register
from .sqlviews import qfrac, rank_bin, value_bin, with_views

_CAT_DAILY = """SELECT CAST(ts AS DATE) AS date, category, CAST(SUM(quantity) AS BIGINT) AS qty,
  CAST(SUM(CAST(total_price AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM tx GROUP BY 1, 2"""


def _cat_daily(spark, sf):
    tx = D.transactions(spark, sf)
    return (tx.groupBy(F.to_date("ts").alias("date"), "category")
            .agg(F.sum("quantity").cast("long").alias("qty"),
                 F.sum(F.col("total_price").cast("decimal(18,2)")).cast("double").alias("revenue")))


def _round_cols(df, cols, d=6):
    for c in cols:
        df = df.withColumn(c, round_even(c, d))
    return df


@register("g01_rank_bins", with_views(f"""
SELECT customer_id, total_spent, {rank_bin('r', 'n', 4)} AS spend_quartile
FROM (SELECT customer_id, total_spent, row_number() OVER (ORDER BY total_spent, customer_id) AS r,
             COUNT(*) OVER () AS n FROM cs)""", "tx", extra={"cs": """SELECT customer_id,
  CAST(SUM(CAST(total_price AS DECIMAL(18,2))) AS DOUBLE) AS total_spent FROM tx
  WHERE customer_id IS NOT NULL GROUP BY 1"""}))
def g01(spark, sf):
    """G1 first-come rank quartile of customer spend (distributed exact rank)."""
    cs = R.customer_stats(D.transactions(spark, sf)).select("customer_id", "total_spent")
    return rank_bins(cs, "total_spent", 4, "customer_id", "spend_quartile")


@register("g02_quantile_bins", with_views(f"""
SELECT id, price, ['budget', 'standard', 'premium', 'luxury'][{value_bin('price', 'e', 4)}] AS price_band
FROM mi, (SELECT quantile_cont(price, {qfrac(4)}) AS e FROM mi)""", "mi"))
def g02(spark, sf):
    """G2 value-quantile price bands of menu items."""
    mi = D.menu_items(spark, sf).select("id", "price")
    return quantile_bins(mi, "price", 4, "price_band", labels=["budget", "standard", "premium", "luxury"], key="id")


@register("g03_lag_features", with_views("""
SELECT date, category, qty,
  lag(qty, 1) OVER w AS qty_lag_1, lag(qty, 7) OVER w AS qty_lag_7,
  lag(qty, 14) OVER w AS qty_lag_14, lag(qty, 28) OVER w AS qty_lag_28
FROM cd WINDOW w AS (PARTITION BY category ORDER BY date)""", "tx", extra={"cd": _CAT_DAILY}))
def g03(spark, sf):
    """G3 lag features per category series."""
    return W.lag_features(_cat_daily(spark, sf).drop("revenue"), "qty", (1, 7, 14, 28), "category")


def _rolling_sql(strict: bool) -> str:
    cols = []
    for w in (7, 14, 28):
        fr = f"(PARTITION BY category ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        m, s = f"avg(qty) OVER {fr}", f"stddev_samp(qty) OVER {fr}"
        if strict:
            full = f"count(qty) OVER {fr} = {w}"
            m, s = f"CASE WHEN {full} THEN {m} END", f"CASE WHEN {full} THEN {s} END"
        cols.append(f"round_even({m}, 6) AS qty_rolling_mean_{w}, round_even({s}, 6) AS qty_rolling_std_{w}")
    return with_views(f"SELECT date, category, qty, {', '.join(cols)} FROM cd", "tx", extra={"cd": _CAT_DAILY})


_ROLL_COLS = [f"qty_rolling_{k}_{w}" for w in (7, 14, 28) for k in ("mean", "std")]


@register("g04_rolling_features", _rolling_sql(False))
def g04(spark, sf):
    """G4 rolling mean/std of the previous w rows per category (min_periods=1)."""
    df = W.rolling_features(_cat_daily(spark, sf).drop("revenue"), "qty", (7, 14, 28), "category")
    return _round_cols(df, _ROLL_COLS)


@register("g06_rolling_strict", _rolling_sql(True))
def g06(spark, sf):
    """G6 strict rolling features (null until w earlier rows exist)."""
    df = W.rolling_features(_cat_daily(spark, sf).drop("revenue"), "qty", (7, 14, 28), "category", strict=True)
    return _round_cols(df, _ROLL_COLS)


@register("g05_moving_average", with_views("""
SELECT date, category, revenue, round_even(CASE WHEN count(*) OVER w = 7 THEN avg(revenue) OVER w END, 6) AS revenue_ma7
FROM cd WINDOW w AS (PARTITION BY category ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
                                           "tx", extra={"cd": _CAT_DAILY}))
def g05(spark, sf):
    """G5 7-row moving average including today, full windows only."""
    df = W.moving_average(_cat_daily(spark, sf).drop("qty"), "revenue", 7, "category")
    return _round_cols(df, ["revenue_ma7"])


@register("g07_recent_items", with_views("""
SELECT * FROM (SELECT customer_id, item_id, last_ts,
  CAST(row_number() OVER (PARTITION BY customer_id ORDER BY last_ts DESC, item_id) AS INTEGER) AS recency_rank
  FROM (SELECT customer_id, item_id, max(ts) AS last_ts FROM tx WHERE customer_id IS NOT NULL GROUP BY 1, 2))
WHERE recency_rank <= 10""", "tx"))
def g07(spark, sf):
    """G7 last 10 distinct items per customer."""
    return W.recent_items(D.transactions(spark, sf), 10)


@register("g08_autocorrelation", with_views("""
SELECT lag, round_even(corr(x, y), 6) AS autocorr, COUNT(*) AS n_pairs FROM (
  SELECT l.lag, a.v AS x, b.v AS y FROM d a, (SELECT unnest(range(1, 8)) AS lag) l, d b WHERE b.i = a.i - l.lag)
GROUP BY lag""", "tx", extra={"d": """SELECT row_number() OVER (ORDER BY date) AS i, CAST(n AS DOUBLE) AS v FROM (
  SELECT CAST(ts AS DATE) AS date, COUNT(DISTINCT order_id) AS n FROM tx GROUP BY 1)"""}))
def g08(spark, sf):
    """G8 autocorrelation of daily order counts for lags 1..7."""
    daily = R.daily_aggregates(D.transactions(spark, sf))
    return _round_cols(W.autocorrelation(daily, "total_orders", 7), ["autocorr"])


@register("g09_temporal_split", with_views("""
SELECT date, item_id, quantity_sold, r AS row_index, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY date, item_id) AS r, COUNT(*) OVER () AS n FROM ids)""",
                                           "tx", extra={"ids": """SELECT CAST(ts AS DATE) AS date, item_id,
  CAST(SUM(quantity) AS BIGINT) AS quantity_sold FROM tx GROUP BY 1, 2"""}))
def g09(spark, sf):
    """G9 80/20 temporal split of the item x day table (exact distributed rank)."""
    ids = R.item_daily_sales(D.transactions(spark, sf)).select("date", "item_id", "quantity_sold")
    return W.temporal_split(ids, "date", "item_id", 0.2)


@register("g10_time_series_folds", with_views("""
SELECT date, total_orders, r AS row_index, CAST(fold AS INTEGER) AS fold,
  CASE WHEN r - 1 < (n - 5 * (n // 6)) + fold * (n // 6) THEN 'train' ELSE 'test' END AS role
FROM (SELECT *, row_number() OVER (ORDER BY date) AS r, COUNT(*) OVER () AS n FROM d),
     (SELECT unnest(range(0, 5)) AS fold) f
WHERE r - 1 < (n - 5 * (n // 6)) + fold * (n // 6) + (n // 6)""", "tx", extra={"d": """SELECT CAST(ts AS DATE) AS date,
  COUNT(DISTINCT order_id) AS total_orders FROM tx GROUP BY 1"""}))
def g10(spark, sf):
    """G10 five rolling-origin folds over the daily series."""
    daily = R.daily_aggregates(D.transactions(spark, sf)).select("date", "total_orders")
    return W.time_series_folds(daily, "date", "date", 5)


@register("g11_last_turns", """
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k
  FROM conversations) WHERE k <= 4""")
def g11(spark, sf):
    """G11 last four turns of every conversation."""
    return W.last_turns(D.read(spark, sf, "conversations"), 4)
