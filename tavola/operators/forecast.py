"""Demand forecasting tables and evaluation.

Feature tables are keyed windows over per-series daily rows (one row per
series and day: always aggregate first).  Model training lives in
``operators/ml.py``; everything here is plain DataFrame work with a SQL
twin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import global_rank
from ..functions.rounding import round_even
from ..functions.timeutil import calendar_columns
from .windows import lag_features, rolling_features, temporal_split


def forecast_features(df: DataFrame, target: str, lags: Sequence[int] = (1, 7, 14, 28),
                      windows: Sequence[int] = (7, 14, 28), key: str | None = None,
                      date: str = "date") -> DataFrame:
    """calendar columns (X1) + lags (G3) + rolling mean/std."""
    out = df
    for name, expr in calendar_columns(date).items():
        out = out.withColumn(name, expr)
    out = lag_features(out, target, lags, key, date)
    return rolling_features(out, target, windows, key, date)


def encode_categories(df: DataFrame, cols: Sequence[str]):
    """F1 encoding: label-encode categorical columns with an 'unknown' bucket
    for values not seen in training (``StringIndexer(handleInvalid='keep')``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType="alphabetAsc")
              for c in cols]
    model = Pipeline(stages=stages).fit(df.fillna("unknown", list(cols)))
    return model, model.transform(df.fillna("unknown", list(cols)))


def forecast_training(features: DataFrame, feature_cols: Sequence[str], date: str, key: str,
                      test: float = 0.2) -> DataFrame:
    """rows with every feature present, split by time (G9).  Same-day
    columns other than the target are not features (fixes D4)."""
    clean = features.na.drop(subset=list(feature_cols))
    return temporal_split(clean, date, key, test)


def densify(df: DataFrame, key: str, date: str = "date", fill: dict | None = None) -> DataFrame:
    """one row per series and calendar day between its first and last day;
    missing days get zeros (so row lags equal day lags)."""
    span = df.groupBy(key).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    days = span.select(key, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(date))
    out = days.join(df, [key, date], "left")
    value_cols = [c for c in df.columns if c not in (key, date)]
    return out.fillna(fill or {c: 0 for c in value_cols})


def baseline_forecast(history: DataFrame, days: int, key: str, value: str, date: str = "date",
                      how: str = "seasonal_naive", season: int = 7) -> DataFrame:
    """deterministic forecast for the next ``days`` days per series.

    ``seasonal_naive``: the value on the same position of the last observed
    season (``last - season*ceil(h/season) + h``); ``rolling_mean``: the mean
    of the last ``season`` observed rows, flat over the horizon.  Rows are
    (key, date, horizon, prediction)."""
    last = history.groupBy(key).agg(F.max(date).alias("_last"))
    horizon = last.select(key, "_last", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("horizon"))
    fut = horizon.withColumn(date, F.date_add("_last", F.col("horizon")))
    if how == "seasonal_naive":
        src = F.date_add("_last", F.col("horizon") - F.lit(season) * F.ceil(F.col("horizon") / season).cast("int"))
        fut = fut.withColumn("_src", src)
        h = history.select(F.col(key), F.col(date).alias("_src"), F.col(value).cast("double").alias("prediction"))
        out = fut.join(h, [key, "_src"], "left").fillna(0.0, ["prediction"])
    elif how == "rolling_mean":
        w = Window.partitionBy(key).orderBy(F.desc(date))
        recent = (history.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= season)
                  .groupBy(key).agg(F.avg(F.col(value).cast("double")).alias("prediction")))
        out = fut.join(recent, key, "left")
    else:
        raise ValueError(how)
    return out.select(key, date, "horizon", round_even("prediction", 6).alias("prediction"))


# --------------------------------------------------------------------------- evaluation
def regression_metrics(df: DataFrame, y: str, yhat: str, by: str | Sequence[str] | None = None,
                       mape_offset: float = 0.0) -> DataFrame:
    """MAE, RMSE, R^2 and MAPE (%) per group (or overall).

    MAPE uses ``|y - yhat| / (y + offset)`` over rows whose denominator is
    non-zero; ``offset=1`` gives the LTV variant (E2)."""
    err = F.col(y).cast("double") - F.col(yhat).cast("double")
    den = F.col(y).cast("double") + F.lit(mape_offset)
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    g = df.groupBy(*keys) if keys else df.groupBy()
    a = g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("_mae"),
              F.avg(err * err).alias("_mse"), F.sum(err * err).alias("_sse"),
              F.var_pop(F.col(y).cast("double")).alias("_vy"),
              F.avg(F.when(den != 0, F.abs(err / den))).alias("_mape"))
    r2 = F.when(F.col("_vy") > 0, 1 - F.col("_sse") / (F.col("_vy") * F.col("n")))
    return a.select(*keys, "n", round_even("_mae", 6).alias("mae"), round_even(F.sqrt("_mse"), 6).alias("rmse"),
                    round_even(r2, 6).alias("r2"), round_even(F.col("_mape") * 100, 6).alias("mape"))


def classification_metrics(df: DataFrame, y: str, p: str, thr: float = 0.5, key: str | None = None) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 at ``thr`` and
    ROC AUC by the rank-sum rule with average ranks for tied scores.

    Ranks come from the distributed global rank (a unique ``key`` breaks
    ties); a tie group's average rank is the mean of its first and last rank."""
    lab = F.col(y).cast("int")
    pred = (F.col(p) >= thr).cast("int")
    c = df.agg(F.count_if((pred == 1) & (lab == 1)).cast("long").alias("tp"),
               F.count_if((pred == 1) & (lab == 0)).cast("long").alias("fp"),
               F.count_if((pred == 0) & (lab == 0)).cast("long").alias("tn"),
               F.count_if((pred == 0) & (lab == 1)).cast("long").alias("fn"))
    base = df.select(F.col(p).cast("double").alias("_p"), lab.alias("_y"),
                     (F.col(key) if key else F.monotonically_increasing_id()).alias("_k"))
    ranked = global_rank(base, ["_p", "_k"], "_r")
    groups = ranked.groupBy("_p").agg(((F.min("_r") + F.max("_r")) / 2.0).alias("_avg"),
                                      F.sum("_y").alias("_pos"), F.count(F.lit(1)).alias("_cnt"))
    auc_parts = groups.agg(F.sum(F.col("_avg") * F.col("_pos")).alias("_rs"), F.sum("_pos").alias("_P"),
                           F.sum("_cnt").alias("_n")).select(
        F.when((F.col("_P") > 0) & (F.col("_n") > F.col("_P")),
               (F.col("_rs") - F.col("_P") * (F.col("_P") + 1) / 2.0) / (F.col("_P") * (F.col("_n") - F.col("_P"))))
        .alias("roc_auc"))
    auc = auc_parts.scalar()
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return c.select("tp", "fp", "tn", "fn",
                    round_even((tp + tn) / (tp + tn + fp + fn), 6).alias("accuracy"),
                    round_even(prec, 6).alias("precision"), round_even(rec, 6).alias("recall"),
                    round_even(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0), 6).alias("f1"),
                    round_even(auc, 6).alias("roc_auc"))
