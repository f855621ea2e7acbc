"""Forecast tables, baselines and evaluation queries (F*, E*, Q12) with SQL oracles.

Series: daily quantity per product type (``category``), densified so that a
row lag is a day lag.  The last 28 days are held out for evaluation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import scalar_value
from ..operators import customers as C
from ..operators import forecast as FC
from ..operators import quality as Q
from ..sources import driver as D
from .registry import AS_OF, register
from .sqlviews import floor_days, with_views

HOLDOUT = 28
T = f"TIMESTAMP '{AS_OF}'"


def cat_daily(spark, sf):
    tx = D.transactions(spark, sf)
    return tx.groupBy("category", F.to_date("ts").alias("date")).agg(F.sum("quantity").cast("long").alias("qty"))


def dense_daily(spark, sf):
    return FC.densify(cat_daily(spark, sf), "category", "date")


_CD = "SELECT category, CAST(ts AS DATE) AS date, CAST(SUM(quantity) AS BIGINT) AS qty FROM tx GROUP BY 1, 2"
_DENSE = """SELECT s.category, s.date, COALESCE(cd.qty, 0) AS qty FROM (
  SELECT category, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (
    SELECT category, min(date) AS lo, max(date) AS hi FROM cd GROUP BY 1)) s
LEFT JOIN cd ON s.category = cd.category AND s.date = cd.date"""
_CAL = """CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
  CAST(week(date) AS INTEGER) AS week_of_year, CAST(month(date) AS INTEGER) AS month,
  CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
  CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend, CAST(day(date) = 1 AS INTEGER) AS is_month_start,
  CAST(date = last_day(date) AS INTEGER) AS is_month_end"""


def _feat_sql_cols() -> str:
    cols = [f"lag(qty, {k}) OVER w AS qty_lag_{k}" for k in (1, 7, 14, 28)]
    for wn in (7, 14, 28):
        fr = f"(PARTITION BY category ORDER BY date ROWS BETWEEN {wn} PRECEDING AND 1 PRECEDING)"
        cols.append(f"round_even(avg(qty) OVER {fr}, 6) AS qty_rolling_mean_{wn}")
        cols.append(f"round_even(stddev_samp(qty) OVER {fr}, 6) AS qty_rolling_std_{wn}")
    return ", ".join(cols)


_FEATS = f"""SELECT category, date, qty, {_CAL}, {_feat_sql_cols()}
FROM dense WINDOW w AS (PARTITION BY category ORDER BY date)"""
_ROLL = [f"qty_rolling_{k}_{w}" for w in (7, 14, 28) for k in ("mean", "std")]
FEATURE_COLS = ["day_of_week", "day_of_month", "week_of_year", "month", "quarter", "is_weekend",
                "is_month_start", "is_month_end"] + [f"qty_lag_{k}" for k in (1, 7, 14, 28)] + _ROLL


def features(spark, sf):
    f = FC.forecast_features(dense_daily(spark, sf), "qty", (1, 7, 14, 28), (7, 14, 28), "category")
    for c in _ROLL:
        f = f.withColumn(c, F.rint(F.col(c) * 1e6) / 1e6)
    return f


@register("f01_forecast_features", with_views(_FEATS, "tx", extra={"cd": _CD, "dense": _DENSE}))
def f01(spark, sf):
    """F1 calendar, lag and rolling features per product-type daily series."""
    return features(spark, sf)


@register("f02_forecast_training", with_views(f"""
SELECT *, r AS row_index, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (ORDER BY date, category) AS r, COUNT(*) OVER () AS n FROM feats
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURE_COLS)})""", "tx",
    extra={"cd": _CD, "dense": _DENSE, "feats": _FEATS}).replace("SELECT *, r AS row_index", "SELECT * EXCLUDE (r, n), r AS row_index", 1))
def f02(spark, sf):
    """F2 training table: complete feature rows, 80/20 temporal split."""
    return FC.forecast_training(features(spark, sf), FEATURE_COLS, "date", "category", 0.2)


@register("f03_densify", with_views("SELECT * FROM dense", "tx", extra={"cd": _CD, "dense": _DENSE}))
def f03(spark, sf):
    """F3 calendar densification: zero rows for days without sales."""
    return dense_daily(spark, sf)


def _split(spark, sf):
    d = dense_daily(spark, sf)
    cut = scalar_value(d.agg(F.date_sub(F.max("date"), HOLDOUT)))
    return d.where(F.col("date") <= cut), d.where(F.col("date") > cut)


_HIST = f"SELECT * FROM dense WHERE date <= (SELECT max(date) - {HOLDOUT} FROM dense)"
_ACT = f"SELECT * FROM dense WHERE date > (SELECT max(date) - {HOLDOUT} FROM dense)"
_SEASONAL = f"""SELECT h.category, h.date, h.horizon, round_even(COALESCE(CAST(hist.qty AS DOUBLE), 0.0), 6) AS prediction
FROM (SELECT category, last, horizon, CAST(last + horizon AS DATE) AS date,
        CAST(last + horizon - 7 * CAST(ceil(horizon / 7.0) AS INTEGER) AS DATE) AS src
      FROM (SELECT category, max(date) AS last FROM hist GROUP BY 1), (SELECT CAST(range AS INTEGER) AS horizon FROM range(1, {HOLDOUT + 1})) t) h
LEFT JOIN hist ON h.category = hist.category AND h.src = hist.date"""
_ROLLMEAN = f"""SELECT l.category, CAST(l.last + t.horizon AS DATE) AS date, t.horizon, round_even(m.p, 6) AS prediction
FROM (SELECT category, max(date) AS last FROM hist GROUP BY 1) l, (SELECT CAST(range AS INTEGER) AS horizon FROM range(1, {HOLDOUT + 1})) t,
     (SELECT category, avg(CAST(qty AS DOUBLE)) AS p FROM (SELECT *, row_number() OVER (PARTITION BY category
        ORDER BY date DESC) AS r FROM hist) WHERE r <= 7 GROUP BY 1) m WHERE l.category = m.category"""
_FC_CTES = {"cd": _CD, "dense": _DENSE, "hist": _HIST, "act": _ACT}


def _forecast(spark, sf, how):
    hist, _ = _split(spark, sf)
    return FC.baseline_forecast(hist, HOLDOUT, "category", "qty", "date", how)


@register("f07_baseline_seasonal_naive", with_views(_SEASONAL, "tx", extra=_FC_CTES))
def f07(spark, sf):
    """F7 seasonal-naive 28-day forecast per series."""
    return _forecast(spark, sf, "seasonal_naive")


@register("f07_baseline_rolling_mean", with_views(_ROLLMEAN, "tx", extra=_FC_CTES))
def f07r(spark, sf):
    """F7 rolling-mean (last 7 days) 28-day forecast per series."""
    return _forecast(spark, sf, "rolling_mean")


def _eval_sql(fc: str, offset: float = 0.0, by: bool = True) -> str:
    den = f"(CAST(act.qty AS DOUBLE) + {offset})"
    key = "fc.category, " if by else ""
    grp = "GROUP BY fc.category" if by else ""
    return f"""SELECT {key}COUNT(*) AS n, round_even(avg(abs(CAST(act.qty AS DOUBLE) - fc.prediction)), 6) AS mae,
  round_even(sqrt(avg((CAST(act.qty AS DOUBLE) - fc.prediction) * (CAST(act.qty AS DOUBLE) - fc.prediction))), 6) AS rmse,
  round_even(CASE WHEN var_pop(CAST(act.qty AS DOUBLE)) > 0 THEN 1 - SUM((CAST(act.qty AS DOUBLE) - fc.prediction)
    * (CAST(act.qty AS DOUBLE) - fc.prediction)) / (var_pop(CAST(act.qty AS DOUBLE)) * COUNT(*)) END, 6) AS r2,
  round_even(avg(CASE WHEN {den} <> 0 THEN abs((CAST(act.qty AS DOUBLE) - fc.prediction) / {den}) END) * 100, 6) AS mape
FROM ({fc}) fc JOIN act ON fc.category = act.category AND fc.date = act.date {grp}"""


def _evaluate(spark, sf, how, offset=0.0, by="category"):
    _, act = _split(spark, sf)
    fc = _forecast(spark, sf, how)
    j = fc.join(act, ["category", "date"])
    return FC.regression_metrics(j, "qty", "prediction", by, offset)


@register("e01_regression_metrics", with_views(_eval_sql(_SEASONAL), "tx", extra=_FC_CTES))
def e01(spark, sf):
    """E1 MAE/RMSE/R2/MAPE of the seasonal-naive forecast per series."""
    return _evaluate(spark, sf, "seasonal_naive")


@register("e01_regression_metrics_overall", with_views(_eval_sql(_ROLLMEAN, by=False), "tx", extra=_FC_CTES))
def e01o(spark, sf):
    """E1 overall metrics of the rolling-mean forecast."""
    return _evaluate(spark, sf, "rolling_mean", by=None)


@register("e02_offset_mape", with_views(_eval_sql(_SEASONAL, offset=1.0), "tx", extra=_FC_CTES))
def e02(spark, sf):
    """E2 metrics with the offset MAPE, |y - yhat| / (y + 1)."""
    return _evaluate(spark, sf, "seasonal_naive", offset=1.0)


_E3 = {
    "lab": f"""SELECT customer_id, CAST({floor_days(T, 'max(ts)')} > 60 AS INTEGER) AS y,
    CASE WHEN {floor_days(T, 'min(ts)')} > 0 THEN CAST({floor_days(T, 'max(ts)')} AS DOUBLE)
         / CAST({floor_days(T, 'min(ts)')} AS DOUBLE) ELSE 1.0 END AS p
  FROM tx WHERE customer_id IS NOT NULL GROUP BY 1""",
    "ranks": "SELECT p, y, rank() OVER (ORDER BY p) AS r0, COUNT(*) OVER (PARTITION BY p) AS c FROM lab",
    "auc": """SELECT (SUM(y * (r0 + (c - 1) / 2.0)) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y) * (COUNT(*) - SUM(y))) AS a
  FROM ranks""",
    "conf": """SELECT COUNT(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, COUNT(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
  COUNT(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, COUNT(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM lab""",
}


@register("e03_classification_metrics", with_views("""
SELECT tp, fp, tn, fn, round_even(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 6) AS accuracy,
  round_even(pr, 6) AS precision, round_even(rc, 6) AS recall,
  round_even(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1,
  round_even((SELECT a FROM auc), 6) AS roc_auc
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS pr,
             CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS rc FROM conf)""",
                                                   "tx", extra=_E3))
def e03(spark, sf):
    """E3 churn label (60 days) scored by the recency ratio: confusion, F1, AUC."""
    tx = D.transactions(spark, sf)
    lab = C.churn_labels(tx, AS_OF, 60).select("customer_id", F.col("is_churned").alias("y"))
    feats = C.churn_features(tx, AS_OF).select("customer_id", F.col("recency_ratio").alias("p"))
    return FC.classification_metrics(lab.join(feats, "customer_id"), "y", "p", 0.5, key="customer_id")


# Alert limits per metric (alert when the value is above).
METRIC_LIMITS = [("mape", 25.0), ("rmse", 60.0), ("mae", 45.0)]


def _metrics_long(spark, sf, how):
    m = _evaluate(spark, sf, how)
    return m.select(F.col("category").alias("key"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in ("mae", "rmse", "mape")])).alias("_m")
    ).select("key", "_m.metric", "_m.value")


def _metrics_long_sql(fc: str) -> str:
    return "\nUNION ALL ".join(f"SELECT category AS key, '{k}' AS metric, {k} AS value FROM ({_eval_sql(fc)})"
                               for k in ("mae", "rmse", "mape"))


@register("q12_metric_alerts", with_views(f"""
SELECT m.metric, m.key, m.value, l.max_value, m.metric || ' above limit' AS alert FROM ({_metrics_long_sql(_SEASONAL)}) m
JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in METRIC_LIMITS)}) AS l(metric, max_value) ON m.metric = l.metric
WHERE m.value > l.max_value""", "tx", extra=_FC_CTES))
def q12(spark, sf):
    """Q12 threshold alerts on per-series forecast metrics."""
    limits = spark.createDataFrame(METRIC_LIMITS, "metric string, max_value double")
    return Q.metric_alerts(_metrics_long(spark, sf, "seasonal_naive"), limits)


@register("q12_degradation_alerts", with_views(f"""
SELECT b.key, b.metric, b.value AS base_value, c.value AS current_value,
  round_even(CASE WHEN b.value <> 0 THEN (c.value - b.value) / abs(b.value) END, 6) AS degradation,
  round_even(CASE WHEN b.value <> 0 THEN (c.value - b.value) / abs(b.value) END, 6) > 0.5 AS degraded
FROM ({_metrics_long_sql(_ROLLMEAN)}) b JOIN ({_metrics_long_sql(_SEASONAL)}) c ON b.key = c.key AND b.metric = c.metric""",
                                               "tx", extra=_FC_CTES))
def q12d(spark, sf):
    """Q12 degradation of seasonal-naive vs rolling-mean metrics (> 50 %)."""
    return Q.degradation_alerts(_metrics_long(spark, sf, "rolling_mean"), _metrics_long(spark, sf, "seasonal_naive"), 0.5)


@register("a30_forecast_total", with_views("""
SELECT category, SUM(prediction) AS forecast_total, COUNT(*) AS horizon_days FROM (""" + _SEASONAL + """)
GROUP BY category""", "tx", extra=_FC_CTES))
def a30(spark, sf):
    """A30 total forecast quantity over the 28-day horizon per series."""
    from ..operators import reports as R
    return R.forecast_total(_forecast(spark, sf, "seasonal_naive"), "prediction", by="category")
