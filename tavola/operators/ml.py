"""Model training and scoring with Spark ML (SURVEY C3c-e, C4d-e, C5b-f,
F4-F6, F8-F12, B11, X11).

Gradient boosting is ``boosting.py``: leaf-wise trees over binned columns with
the reference's rounds, leaves, penalties and early stopping.  Its random draws
are its own, so scores are compared as metrics, not values.  Metrics are
DataFrame aggregates over all rows (``forecast.py``, ``boosting.scores``).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import quantile_bins
from ..functions.rounding import round_even
from ..functions.scalars import scalar_struct
from ..session import ensure_checkpoint_dir
from . import boosting, kmeans
from .boosting import Booster, Params
from .forecast import classification_metrics, regression_metrics
from .tuning import SEARCH_SPACE, Sampler

# Churn risk bands (probability cut points) and LTV bands.
RISK_BANDS = [(0.25, "Low"), (0.5, "Medium"), (0.75, "High")]
RISK_TOP = "Critical"
LTV_LABELS = ["Low", "Below Average", "Average", "Above Average", "High"]

# Segment name, description and strategy by profile.
SEGMENT_PROFILES = {
    "high_value_frequent": ("VIP Customers", "High spenders who visit frequently",
                            "Priority service, exclusive offers, loyalty rewards"),
    "high_value_infrequent": ("Big Spenders", "High order values but occasional visits",
                              "Re-engagement campaigns, subscription offers"),
    "low_value_frequent": ("Regular Customers", "Frequent visitors with smaller orders",
                           "Upselling, combo deals, volume discounts"),
    "low_value_infrequent": ("Casual Visitors", "Occasional visitors with small orders",
                             "Welcome back offers, trial promotions"),
    "new_customers": ("New Customers", "Recently acquired customers",
                      "Onboarding journey, first purchase incentives"),
    "churning": ("At Risk", "Previously active but declining engagement",
                 "Win-back campaigns, personalized outreach"),
}


def _assembler(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")


# --------------------------------------------------------------------------- churn
def hash_fraction(key: str, seed: int = 42) -> F.Column:
    """A stable pseudo-random number in [0, 1) from a key: the same row lands
    on the same side of a split whatever the partitioning or retries."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def stratified_split(df: DataFrame, label: str, test: float = 0.2, seed: int = 42, key: str = "customer_id"):
    """Seeded split inside each class: the rows whose hashed key lies below the
    class's own ``test`` quantile are held out, so both sides keep the class
    shares; stable per key."""
    u = hash_fraction(key, seed)
    cut = df.groupBy(label).agg(F.percentile_approx(u, F.lit(test), F.lit(100_000)).alias("_cut"))
    marked = df.withColumn("_u", u).join(F.broadcast(cut), label)  # a row a class
    return (marked.where("_u > _cut").drop("_u", "_cut"), marked.where("_u <= _cut").drop("_u", "_cut"))


def stratified_folds(df: DataFrame, label: str, folds: int = 5, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """Adds ``_fold``: equal slices of the hashed keys of each class."""
    u = hash_fraction(key, seed)
    cuts = df.groupBy(label).agg(F.percentile_approx(u, [k / folds for k in range(1, folds)], 100_000).alias("_cuts"))
    marked = df.withColumn("_u", u).join(F.broadcast(cuts), label)  # a row a class
    return marked.withColumn("_fold", F.size(F.filter("_cuts", lambda c: c < F.col("_u")))).drop("_u", "_cuts")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2 * n_class), as a column ``weight``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    tot = scalar_struct(df.agg(F.count(F.lit(1)).alias("n")))
    w = counts.select(label, (tot["n"] / (2.0 * F.col("_c"))).alias("weight"))
    return df.join(F.broadcast(w), label)


# The reference's settings of the three models.
CHURN_PARAMS = Params(rounds=200, rate=0.05, max_depth=31, leaves=31, row_share=0.8, column_share=0.8, l1=0.0, l2=0.0, stop_after=0)
LTV_PARAMS = Params(rounds=200, rate=0.1, max_depth=5, leaves=32, row_share=1.0, column_share=1.0, min_rows=5, l1=0.0, l2=0.0,
                    stop_after=0)
DEMAND_PARAMS = Params()


def train_churn(data: DataFrame, feature_cols: Sequence[str], label: str = "is_churned",
                params: Params = CHURN_PARAMS, seed: int = 42):
    """Boosted trees with balanced class weights; hold-out metrics."""
    train, hold = stratified_split(data.fillna(0, list(feature_cols)), label, 0.2, seed)
    model = boosting.fit(class_weights(train, label).withColumn("_y", F.col(label).cast("double")), feature_cols, "_y",
                         params, "logistic", "weight")
    return model, classification_metrics(hold.withColumn("p", model.column()), label, "p", 0.5, key="customer_id")


def churn_cv(data: DataFrame, feature_cols: Sequence[str], label: str = "is_churned", folds: int = 5,
             params: Params = CHURN_PARAMS, seed: int = 42) -> DataFrame:
    """Mean and population std of the AUC over stratified folds, all of them fitted at once."""
    data = class_weights(stratified_folds(data.fillna(0, list(feature_cols)), label, folds, seed), label)
    data = data.withColumn("_y", F.col(label).cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        each = data.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        cut = boosting.binned_folds(each, feature_cols, "_y", F.col("_fold") == F.col("fold"), "logistic", "weight")
        rows = []
        for _, k, model in boosting.fit_folds(cut, [(0, params)]):
            scored = data.where(F.col("_fold") == k).withColumn("p", model.column())
            auc = classification_metrics(scored, label, "p", 0.5, key="customer_id").select("roc_auc").first()[0]
            rows.append((k, None if auc is None else float(auc)))
    finally:
        data.unpersist()
    per = data.sparkSession.createDataFrame(rows, "fold int, auc double")
    return per.agg(F.count("auc").alias("n_folds"), round_even(F.avg("auc"), 6).alias("auc_mean"),
                   round_even(F.stddev_pop("auc"), 6).alias("auc_std"))


def train_churn_forest(data: DataFrame, feature_cols: Sequence[str], label: str = "is_churned", trees: int = 100, seed: int = 42):
    """C3c, the other form: a random forest; hold-out metrics."""
    train, hold = stratified_split(data.fillna(0, list(feature_cols)), label, 0.2, seed)
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=12, seed=seed)
    model = Pipeline(stages=[_assembler(feature_cols), forest]).fit(train)
    scored = model.transform(hold).withColumn("p", vector_to_array("probability")[1])
    return model, classification_metrics(scored, label, "p", 0.5, key="customer_id")


def risk_band(p) -> F.Column:
    c = F.col(p) if isinstance(p, str) else p
    expr = None
    for cut, name in RISK_BANDS:
        expr = F.when(c <= cut, name) if expr is None else expr.when(c <= cut, name)
    return expr.otherwise(RISK_TOP)


def churn_bands(scored: DataFrame, p: str = "p", thr: float = 0.5) -> DataFrame:
    """C3d: flag at ``thr`` and risk band of a probability (0 is Low, M6)."""
    return scored.select("customer_id", round_even(F.col(p), 6).alias("churn_probability"),
                         (F.col(p) >= thr).alias("will_churn"), risk_band(p).alias("risk_level"))


def score_churn(model: Booster, features: DataFrame, feature_cols: Sequence[str], thr: float = 0.5) -> DataFrame:
    """C3d: churn probability, flag at ``thr`` and risk band."""
    return churn_bands(features.fillna(0, list(feature_cols)).withColumn("p", model.column()), "p", thr)


def at_risk(scores: DataFrame, thr: float = 0.5) -> DataFrame:
    """C3e: customers at or above the threshold, most likely first."""
    return scores.where(F.col("churn_probability") >= thr).orderBy(F.desc("churn_probability"), "customer_id")


# --------------------------------------------------------------------------- LTV
def train_ltv(table: DataFrame, feature_cols: Sequence[str], target: str = "future_value",
              params: Params = LTV_PARAMS, seed: int = 42):
    """C4d: boosted regression on the hold-out target; MAE, RMSE, R2 and the
    offset MAPE (E2) on a seeded 20 % test split."""
    t = table.fillna(0, list(feature_cols)).withColumn("_u", hash_fraction("customer_id", seed))
    train, test = t.where("_u >= 0.2"), t.where("_u < 0.2")
    model = boosting.fit(train, feature_cols, target, params)
    return model, regression_metrics(test.withColumn("prediction", model.column()), target, "prediction", None, mape_offset=1.0)


def ltv_cv(table: DataFrame, feature_cols: Sequence[str], target: str = "future_value", folds: int = 5,
           params: Params = LTV_PARAMS, seed: int = 42) -> DataFrame:
    """C4d: mean and population std of the MAE over seeded folds, all of them fitted at once."""
    t = (table.fillna(0, list(feature_cols))
         .withColumn("_at", F.floor(hash_fraction("customer_id", seed) * folds).cast("int"))
         .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))))
    cut = boosting.binned_folds(t, feature_cols, target, F.col("_at") == F.col("fold"))
    per = boosting.scores(cut, boosting.fit_folds(cut, [(0, params)]))
    return per.agg(F.count("mae").alias("n_folds"), round_even(F.avg("mae"), 6).alias("mae_mean"),
                   round_even(F.stddev_pop("mae"), 6).alias("mae_std"))


def train_ltv_forest(table: DataFrame, feature_cols: Sequence[str], target: str = "future_value", trees: int = 100, seed: int = 42):
    """C4d, the other form: a random forest on the same split; MAE, RMSE, R2 and the offset MAPE."""
    t = table.fillna(0, list(feature_cols)).withColumn("_u", hash_fraction("customer_id", seed))
    forest = RandomForestRegressor(labelCol=target, featuresCol="features", numTrees=trees, maxDepth=12, seed=seed)
    model = Pipeline(stages=[_assembler(feature_cols), forest]).fit(t.where("_u >= 0.2"))
    return model, regression_metrics(model.transform(t.where("_u < 0.2")), target, "prediction", None, mape_offset=1.0)


def ltv_bands(predicted: DataFrame) -> DataFrame:
    """C4e: five value bands of ``predicted_ltv``."""
    return quantile_bins(predicted, "predicted_ltv", 5, "ltv_segment", labels=LTV_LABELS, key="customer_id")


def predict_ltv(model: Booster, features: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """C4e: non-negative prediction and five value bands."""
    p = features.fillna(0, list(feature_cols)).withColumn("prediction", model.column())
    return ltv_bands(p.select("customer_id", F.greatest(F.col("prediction"), F.lit(0.0)).alias("predicted_ltv")))


# --------------------------------------------------------------------------- segmentation
def standardize(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Population-std scaling (scikit-learn's rule, M16) as expressions;
    returns (frame with the scaled values as the array ``_z``, one-row stats frame)."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    s = scalar_struct(stats)
    z = [F.when(s[f"s_{c}"] > 0, (F.col(c) - s[f"m_{c}"]) / s[f"s_{c}"]).otherwise(0.0).cast("double") for c in cols]
    return df.withColumn(kmeans.Z, F.array(*z)), stats


def choose_k(features: DataFrame, cols: Sequence[str], k_min: int = 3, k_max: int = 8, seed: int = 42) -> DataFrame:
    """Silhouette (squared Euclidean), inertia, Calinski-Harabasz and
    Davies-Bouldin for k in range, all fitted together; ``chosen`` marks the
    best silhouette (the smallest such k), ``centres`` are the scaled ones."""
    scaled, _ = standardize(features.fillna(0, list(cols)), cols)
    centres, rows = kmeans.fit_all(scaled, range(k_min, k_max + 1), seed)
    best = max(rows, key=lambda r: (r[1], -r[0]))[0] if rows else None
    return features.sparkSession.createDataFrame(
        [(*r, r[0] == best, centres[r[0]].tolist()) for r in rows],
        "k int, silhouette double, inertia double, calinski_harabasz double, davies_bouldin double, chosen boolean, "
        "centres array<array<double>>")


def best_centres(scores: DataFrame) -> list[list[float]]:
    """The scaled centres of the chosen k."""
    return scores.where("chosen").first()["centres"]


def fit_segments(features: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]] | None = None, k: int = 5,
                 seed: int = 42):
    """(clustered rows, centres in original units), for given scaled centres or fitted ones of ``k`` clusters."""
    scaled, stats = standardize(features.fillna(0, list(cols)), cols)
    if centres is None:
        centres = kmeans.fit_all(scaled, [k], seed)[0][k].tolist()
    clustered = scaled.withColumn("cluster", kmeans.nearest(centres)).drop(kmeans.Z)
    st = stats.collect()[0]  # one row of per-column mean / std
    rows = [(i, *[float(c[j]) * (st[f"s_{col}"] or 0.0) + st[f"m_{col}"] for j, col in enumerate(cols)])
            for i, c in enumerate(centres)]
    return clustered, features.sparkSession.createDataFrame(rows, ["cluster", *cols])


def segment_profiles(clustered: DataFrame) -> DataFrame:
    """C5d: means per cluster, share of customers, and name, description and
    strategy from the cluster means' median / quartiles (one row per cluster)."""
    prof = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customer_count"), F.avg("recency_days").alias("avg_recency"),
        F.avg("total_transactions").alias("avg_transactions"), F.avg("total_spent").alias("avg_total_spent"),
        F.avg("avg_order_value").alias("avg_order_value"), F.avg("tenure_days").alias("avg_tenure"),
        F.avg("orders_per_month").alias("avg_orders_per_month"), F.avg("spend_per_month").alias("avg_spend_per_month"),
        F.avg("item_diversity").alias("avg_item_diversity"))
    q = scalar_struct(prof.agg(F.percentile("avg_total_spent", 0.5).alias("spend_med"),
                               F.percentile("avg_transactions", 0.5).alias("tx_med"),
                               F.percentile("avg_tenure", 0.25).alias("tenure_q1"),
                               F.percentile("avg_recency", 0.75).alias("recency_q3"),
                               F.sum("customer_count").alias("n")))
    hv, hf = F.col("avg_total_spent") > q["spend_med"], F.col("avg_transactions") > q["tx_med"]
    def told(profile: str) -> F.Column:
        name, description, strategy = SEGMENT_PROFILES[profile]
        return F.struct(F.lit(name).alias("segment_name"), F.lit(description).alias("description"),
                        F.lit(strategy).alias("recommended_strategy"))

    profile = (F.when(F.col("avg_tenure") < q["tenure_q1"], told("new_customers"))
               .when(F.col("avg_recency") > q["recency_q3"], told("churning"))
               .when(hv & hf, told("high_value_frequent"))
               .when(hv, told("high_value_infrequent"))
               .when(hf, told("low_value_frequent"))
               .otherwise(told("low_value_infrequent")))
    return (prof.withColumn("pct_of_customers", round_even(F.col("customer_count") * 100.0 / q["n"], 6))
            .withColumn("_p", profile).select("*", "_p.*").drop("_p"))


def assign_segments(clustered: DataFrame, profiles: DataFrame) -> DataFrame:
    """C5e: every customer's cluster and segment name (``Segment_<cluster>``
    for a cluster without a profile)."""
    names = F.broadcast(profiles.select("cluster", "segment_name"))  # a row a cluster
    return clustered.join(names, "cluster", "left").select(
        "customer_id", "cluster",
        F.coalesce("segment_name", F.concat(F.lit("Segment_"), F.col("cluster").cast("string"))).alias("segment_name"))


def segment_summary(profiles: DataFrame) -> DataFrame:
    """C5e: one row per segment with the totals of the summary on each."""
    q = scalar_struct(profiles.agg(F.sum("customer_count").alias("n"), F.count(F.lit(1)).alias("k")))
    return profiles.select(
        q["n"].alias("total_customers"), q["k"].alias("num_segments"), "cluster", F.col("segment_name").alias("name"),
        "customer_count", round_even("pct_of_customers", 1).alias("pct_of_customers"),
        round_even("avg_order_value", 2).alias("avg_order_value"),
        round_even("avg_orders_per_month", 2).alias("avg_orders_per_month"), "description",
        F.col("recommended_strategy").alias("strategy"))


def normalized_centres(centres: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C5f: min-max normalised centres (over the <= k rows)."""
    s = scalar_struct(centres.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]))
    out = centres
    for c in cols:
        lo, hi = s[f"lo_{c}"], s[f"hi_{c}"]
        out = out.withColumn(c, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0))
    return out


# --------------------------------------------------------------------------- forecasting
def train_forecaster(table: DataFrame, feature_cols: Sequence[str], target: str, params: Params = DEMAND_PARAMS,
                     split_col: str = "split"):
    """boosted regressor, stopped when the validation rows have not gained
    for ``params.stop_after`` rounds; train and validation metrics (E1)."""
    model = boosting.fit(table, feature_cols, target, params, valid=F.col(split_col) == "test")
    return model, regression_metrics(table.withColumn("prediction", model.column()), target, "prediction", split_col)


def forecast(model: Booster, df: DataFrame) -> DataFrame:
    """predictions for new rows."""
    return df.withColumn("prediction", model.column())


def rollout(model: Booster, history: DataFrame, days: int, key: str, target: str,
            feature_fn, date: str = "date", keep: int = 28) -> DataFrame:
    """recursive multi-day forecast for all series at once.

    Each step keeps only the last ``keep`` rows per series (enough for the
    longest lag/window), appends the next day with its prediction, and
    cuts lineage with a reliable ``checkpoint()`` into the session's
    checkpoint folder, so plan size stays constant over the horizon."""
    ensure_checkpoint_dir(history.sparkSession)
    w = Window.partitionBy(key).orderBy(F.desc(date))
    state = history.select(key, date, target).withColumn("_r", F.row_number().over(w)) \
        .where(F.col("_r") <= keep).drop("_r").withColumn("is_forecast", F.lit(False)).checkpoint()
    out = []
    for step in range(1, days + 1):
        nxt = state.groupBy(key).agg(F.date_add(F.max(date), 1).alias(date))
        frame = state.unionByName(nxt.withColumn(target, F.lit(None).cast(state.schema[target].dataType))
                                  .withColumn("is_forecast", F.lit(True)))
        feats = feature_fn(frame)
        pred = feats.join(nxt, [key, date], "left_semi").fillna(0).withColumn("prediction", model.column()) \
            .select(key, date, F.greatest(F.col("prediction"), F.lit(0.0)).alias("prediction"))
        out.append(pred.withColumn("horizon", F.lit(step)).checkpoint())
        new_rows = out[-1].select(key, date, F.col("prediction").cast(state.schema[target].dataType).alias(target),
                                  F.lit(True).alias("is_forecast"))
        state = state.unionByName(new_rows).withColumn("_r", F.row_number().over(w)) \
            .where(F.col("_r") <= keep).drop("_r").checkpoint()
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def feature_importance(model: Booster, n: int = 10) -> DataFrame:
    """F8: top-n features by their share of the splits' gain."""
    from pyspark.sql import SparkSession
    rows = sorted(model.importance().items(), key=lambda r: (-r[1], r[0]))[:n]
    return SparkSession.getActiveSession().createDataFrame([(i + 1, c, round(v, 6)) for i, (c, v) in enumerate(rows)],
                                                           "rank int, feature string, importance double")


def permutation_importance(model: Booster, df: DataFrame, cols: Sequence[str], target: str,
                           key: str, seed: int = 42, n: int | None = None) -> DataFrame:
    """increase of MAE when one feature's values are permuted across rows.

    The rows are ranked once in a seeded random order; feature j then takes the
    value of the row a different number of places further on (round the end),
    a permutation that needs one join and no further rank."""
    def mae(frame):
        return regression_metrics(frame.withColumn("prediction", model.column()), target, "prediction").select("mae").collect()[0][0]
    from ..functions.bins import global_rank
    base = mae(df)
    rows = []
    idx = global_rank(df.withColumn("_u", F.xxhash64(F.col(key), F.lit(seed))), ["_u", key], "_i")
    size = idx.count()
    for j, c in enumerate(cols):
        step = 1 + (size * (j + 1)) // (len(cols) + 1)
        donor = idx.select(F.pmod(F.col("_i") + step, F.lit(size)).alias("_at"), F.col(c).alias("_v"))
        shuffled = idx.withColumn("_at", F.pmod("_i", F.lit(size))).join(donor, "_at").withColumn(c, F.col("_v"))
        rows.append((c, float(mae(shuffled.drop("_v", "_i", "_at", "_u")) - base)))
    rows.sort(key=lambda r: (-r[1], r[0]))
    spark = df.sparkSession
    out = spark.createDataFrame([(c, round(v, 6)) for c, v in rows], "feature string, mae_increase double")
    return out.limit(n) if n else out


def cross_validate(feature_cols: Sequence[str], target: str, folds: DataFrame, params: Params = DEMAND_PARAMS) -> DataFrame:
    """rolling-origin CV over ``time_series_folds`` output; mean and
    population std of MAE, RMSE, R2 across folds, all of them fitted at once."""
    cut = boosting.binned_folds(folds, feature_cols, target, F.col("role") == "test")
    per = boosting.scores(cut, boosting.fit_folds(cut, [(0, params)]))
    return per.agg(*[F.avg(c).alias(f"{c}_mean") for c in ("mae", "rmse", "r2")],
                   *[F.stddev_pop(c).alias(f"{c}_std") for c in ("mae", "rmse", "r2")])


def tune(feature_cols: Sequence[str], target: str, folds: DataFrame, space: dict[str, tuple] | None = None,
         n_trials: int = 50, at_once: int = 10, metric: str = "rmse", seed: int = 42) -> DataFrame:
    """Parzen search, each trial scored by rolling-origin CV (time order
    kept, so no shuffled k-fold): the mean of ``metric`` over the folds.

    The folds are binned once.  ``at_once`` trials are proposed together and
    fitted side by side, a task for each trial and fold; a fit stops after 50
    rounds without gain and is scored by its best prefix, so a larger number of
    rounds costs no further fit.  ``n_trials`` is the budget: 50 to 100."""
    sampler = Sampler(space or SEARCH_SPACE, seed, startup=min(10, n_trials))
    cut = boosting.binned_folds(folds, feature_cols, target, F.col("role") == "test")
    rows = []
    while len(rows) < n_trials:
        points = [sampler.propose() for _ in range(min(at_once, n_trials - len(rows)))]
        trials = [(len(rows) + k, replace(DEMAND_PARAMS, seed=seed, **point)) for k, point in enumerate(points)]
        models = boosting.fit_folds(cut, trials)
        used = {t: sum(len(m.trees) for k, _, m in models if k == t) / cut.count for t, _ in trials}
        told = {r.trial: r for r in boosting.scores(cut, models).groupBy("trial").agg(
            F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2")).collect()}  # a row a trial
        for (t, _), point in zip(trials, points):
            score = told[t]
            rows.append((t, json.dumps({k: round(v, 8) for k, v in sorted(point.items())}), used[t], score.mae, score.rmse, score.r2))
            sampler.tell(point, score[metric] if metric != "r2" else -score.r2)
    return folds.sparkSession.createDataFrame(
        rows, "trial int, params string, mean_rounds double, cv_mae double, cv_rmse double, cv_r2 double")


def best_params(trials: DataFrame, metric: str = "cv_rmse") -> Params:
    """the best trial's parameters, for the final fit."""
    best = trials.agg(F.min_by("params", F.struct(metric, "trial")).alias("p")).first()["p"]
    return replace(DEMAND_PARAMS, **json.loads(best))


def search_summary(trials: DataFrame, metric: str = "cv_rmse") -> DataFrame:
    """best, worst, mean, std of the trial metric and % gain of the best
    over the first trial."""
    first = scalar_struct(trials.where(F.col("trial") == 0).select(F.col(metric).alias("v")))
    return trials.agg(F.count(F.lit(1)).alias("n_trials"), F.min(metric).alias("best"), F.max(metric).alias("worst"),
                      F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"),
                      F.min_by("params", F.struct(metric, "trial")).alias("best_params")) \
        .withColumn("improvement_pct", F.when(first["v"] > 0, (first["v"] - F.col("best")) / first["v"] * 100.0))


# --------------------------------------------------------------------------- CF
def factorize(ui: DataFrame, rank: int = 10, n: int = 5, seed: int = 42, implicit: bool = True) -> DataFrame:
    """Implicit-feedback ALS on (user, item, value); top-n items per user.

    ALS wants int ids: keys of any type or size get their distributed rank, so
    nothing is gathered on the driver and up to 2^31 of either can be ranked."""
    from ..functions.bins import global_rank

    def ids(col: str, out: str) -> DataFrame:
        return global_rank(ui.select(col).where(F.col(col).isNotNull()).distinct(), [col], out).withColumn(
            out, F.col(out).cast("int"))
    users, items = ids("user", "uid"), ids("item", "iid")
    data = ui.join(users, "user").join(items, "item")
    als = ALS(rank=rank, userCol="uid", itemCol="iid", ratingCol="value", implicitPrefs=implicit, seed=seed,
              coldStartStrategy="drop", maxIter=10)
    model = als.fit(data.withColumn("value", F.col("value").cast("float")))
    recs = model.recommendForAllUsers(n).select("uid", F.posexplode("recommendations").alias("pos", "r"))
    return (recs.join(users, "uid").join(items, recs.r.iid == items.iid)
            .select("user", "item", (F.col("pos") + 1).alias("rank"), F.col("r.rating").alias("score")))


def encode_features(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """X11: label encoding with an unknown bucket, one-hot, min-max and
    standard scaling, as one Spark ML pipeline."""
    from pyspark.ml.feature import MinMaxScaler, OneHotEncoder, StandardScaler, StringIndexer
    stages = []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep"),
                   OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_ohe")]
    stages += [VectorAssembler(inputCols=list(numeric), outputCol="_num"),
               MinMaxScaler(inputCol="_num", outputCol="num_minmax"),
               StandardScaler(inputCol="_num", outputCol="num_std", withMean=True, withStd=True)]
    return Pipeline(stages=stages).fit(df).transform(df).drop("_num")
