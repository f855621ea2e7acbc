"""Model queries (C3c-e, C4d-e, C5b-f, J7, C6, F4-F12, B11, X11).

Model outputs depend on the learner, so these have no SQL oracle; the
driver checks rows and schema, the tests check invariants and quality
against constant predictors.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_even
from ..operators import basket as B
from ..operators import customers as C
from ..operators import explain as E
from ..operators import forecast as FC
from ..operators import ml as M
from ..operators import svd as SVD
from ..operators import windows as W
from ..operators.boosting import Booster
from ..session import ensure_checkpoint_dir, written
from ..sources import driver as D
from ..sources.io import load_model, save_model
from .q_customers import SEGMENT_SQL, customer_base
from .q_forecast import FEATURE_COLS, features
from .registry import AS_OF, register
from .sqlviews import with_views

CHURN_COLS = ["total_transactions", "total_spent", "avg_order_value", "std_order_value", "total_items",
              "avg_items_per_order", "unique_items_ordered", "tenure_days", "purchase_span_days",
              "orders_per_month", *[f"orders_dow_{i}" for i in range(7)],
              *[f"orders_{p}" for p in ("morning", "lunch", "afternoon", "dinner", "late")], "tier_code"]
TIERS = ("bronze", "silver", "gold", "platinum")
LTV_COLS = ["total_records", "total_transactions", "total_revenue", "avg_order_value", "max_order_value",
            "min_order_value", "total_items", "avg_items_per_order", "unique_items", "tenure_days", "recency_days",
            "purchase_span", "orders_per_month", "avg_days_between_orders", "revenue_per_month",
            "order_value_range", "order_value_cv", "item_diversity_ratio", "recency_ratio"]
SEG_COLS = ["recency_days", "total_transactions", "total_spent", "avg_order_value", "tenure_days",
            "orders_per_month", "spend_per_month", "item_diversity"]


_MEAN_COLS = ["avg_recency", "avg_transactions", "avg_total_spent", "avg_order_value", "avg_tenure",
              "avg_orders_per_month", "avg_spend_per_month", "avg_item_diversity"]
_MEANS = ", ".join(f"round_even({c}, 6) AS {c}" for c in _MEAN_COLS)
_PROFILES = ", ".join("(" + ", ".join(f"'{x}'" for x in (k, *v)) + ")" for k, v in M.SEGMENT_PROFILES.items())


#: (application, name, folder of the tables) -> where the model or table lies, so that it is made once a session
_MADE: dict[tuple[str, str, str], str] = {}
#: the same -> a feature table
_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def _place(spark, name, sf, make) -> str:
    """The folder that ``make(folder)`` fills, on first use in this session."""
    key = (spark.sparkContext.applicationId, name, sf)
    if key not in _MADE:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tavola-models/{name}-{uuid.uuid4().hex}"
        make(folder)
        _MADE[key] = folder
    return _MADE[key]


def _table(spark, name, sf, make, keep=lambda table: table.checkpoint()) -> DataFrame:
    """A feature table, checkpointed once a session: splits, edges, fits and scores read it several times, and each
    reading would join and aggregate the sales again.  A checkpoint keeps the parts and their order."""
    key = (spark.sparkContext.applicationId, name, sf)
    if key not in _KEPT:
        ensure_checkpoint_dir(spark)
        _KEPT[key] = keep(make())
    return _KEPT[key]


def _sales(spark, sf):
    """The sales' columns that customer features read, joined to their orders and written once a session."""
    return _table(spark, "sales", sf, lambda: D.transactions(spark, sf, dims=False).select(
        "customer_id", "order_id", "item_id", "quantity", "total_price", "ts"), written)


def _base(spark, sf):
    """The aggregates of every customer that the churn, value and RFM features of today share."""
    return _table(spark, "customer-base", sf, lambda: C.customer_base(_sales(spark, sf), with_calendar=True))


def _churn_data(spark, sf):
    return _table(spark, "churn-data", sf, lambda: _churn_features(spark, sf))


def _churn_features(spark, sf):
    f = C.churn_features(_sales(spark, sf), AS_OF, D.customers(spark, sf), partial(_base, spark, sf))
    f = f.withColumn("tier_code", F.array_position(F.array(*map(F.lit, TIERS)), F.col("loyalty_tier")).cast("double"))
    last = _base(spark, sf).select("customer_id", F.col("last_ts").alias("ts"))  # a customer's last line stands for all of them
    lab = C.churn_labels(last, AS_OF, 60).select("customer_id", "is_churned")
    return f.join(lab, "customer_id")


def _model(spark, name, sf, train) -> Booster:
    """Fitted and saved once, loaded by every query that scores with it."""
    return load_model(_place(spark, name, sf, lambda folder: save_model(train()[0], folder)))[0]


def _churn_model(spark, sf):
    return _model(spark, "churn", sf, lambda: M.train_churn(_churn_data(spark, sf), CHURN_COLS, "is_churned"))


@register("c03c_train_churn")
def c03c(spark, sf):
    """C3c boosted churn model: hold-out confusion counts, F1, AUC."""
    return M.train_churn(_churn_data(spark, sf), CHURN_COLS, "is_churned")[1]


@register("c03c_churn_forest")
def c03c_forest(spark, sf):
    """C3c random forest of 100 trees: hold-out confusion counts, F1, AUC."""
    return M.train_churn_forest(_churn_data(spark, sf), CHURN_COLS, "is_churned")[1]


@register("c03c_explain_churn")
def c03c_explain(spark, sf):
    """C3c / F9 tree SHAP of the churn model for every customer (log odds)."""
    return E.shap_values(_churn_model(spark, sf), _churn_data(spark, sf).fillna(0, CHURN_COLS), ["customer_id"])


@register("c03c_churn_cv")
def c03c_cv(spark, sf):
    """C3c AUC over five stratified folds."""
    return M.churn_cv(_churn_data(spark, sf), CHURN_COLS, "is_churned")


def _churn_scores(spark, sf):
    return M.score_churn(_churn_model(spark, sf), _churn_data(spark, sf), CHURN_COLS)


@register("c03d_score_churn")
def c03d(spark, sf):
    """C3d churn probability, flag and risk band for every customer."""
    return _churn_scores(spark, sf)


@register("c03e_at_risk")
def c03e(spark, sf):
    """C3e customers at risk, most likely first."""
    return M.at_risk(_churn_scores(spark, sf), 0.5)


@register("c04d_ltv_cv")
def c04d_cv(spark, sf):
    """C4d MAE over five folds."""
    return M.ltv_cv(_ltv_table(spark, sf), LTV_COLS)


def _ltv_table(spark, sf):
    return _table(spark, "ltv-data", sf, lambda: C.ltv_training(_sales(spark, sf), 90, 365))


@register("c04d_train_ltv")
def c04d(spark, sf):
    """C4d LTV model hold-out MAE, RMSE, R2, offset MAPE."""
    return M.train_ltv(_ltv_table(spark, sf), LTV_COLS, "future_value")[1]


@register("c04d_ltv_forest")
def c04d_forest(spark, sf):
    """C4d random forest of 100 trees: hold-out MAE, RMSE, R2, offset MAPE."""
    return M.train_ltv_forest(_ltv_table(spark, sf), LTV_COLS, "future_value")[1]


def _ltv_model(spark, sf):
    return _model(spark, "ltv", sf, lambda: M.train_ltv(_ltv_table(spark, sf), LTV_COLS, "future_value"))


def _ltv_pred(spark, sf):
    model = _ltv_model(spark, sf)
    return M.predict_ltv(model, C.ltv_features(_sales(spark, sf), AS_OF, 365, partial(_base, spark, sf)), LTV_COLS)


@register("c04e_predict_ltv")
def c04e(spark, sf):
    """C4e non-negative LTV predictions with five bands."""
    return _ltv_pred(spark, sf)


def _seg(spark, sf):
    return _table(spark, "segment-data", sf, lambda: C.segment_features(D.transactions(spark, sf, dims=False), AS_OF))


def _scores(spark, sf):
    """C5b scores and centres, fitted once a session."""
    return spark.read.parquet(_place(spark, "segments", sf, lambda folder: M.choose_k(_seg(spark, sf), SEG_COLS).write.parquet(folder)))


def _chosen(spark, sf):
    """Clusters and centres for the k that C5b chooses."""
    return M.fit_segments(_seg(spark, sf), SEG_COLS, M.best_centres(_scores(spark, sf)))


@register("c05b_choose_k")
def c05b(spark, sf):
    """C5b silhouette, inertia, Calinski-Harabasz, Davies-Bouldin for k = 3..8, and the chosen k."""
    return _scores(spark, sf).drop("centres")


@register("c05c_fit_segments")
def c05c(spark, sf):
    """C5c k-means centres in original units, for the chosen k."""
    return _chosen(spark, sf)[1]


@register("c05d_segment_profiles")
def c05d(spark, sf):
    """C5d cluster profiles with rule-based names."""
    return M.segment_profiles(_chosen(spark, sf)[0])


@register("c05d_profiles_of_given_clusters", with_views(f"""
SELECT cluster, customer_count, {_MEANS},
  round_even(customer_count * 100.0 / c, 6) AS pct_of_customers, segment_name, description, recommended_strategy
FROM named JOIN (VALUES {_PROFILES}) v(p, segment_name, description, recommended_strategy) USING (p)""", "tx", extra={
    "base": customer_base(f"TIMESTAMP '{AS_OF}'"), "seg": SEGMENT_SQL,
    "prof": """SELECT cluster, COUNT(*) AS customer_count, avg(recency_days) AS avg_recency,
  avg(total_transactions) AS avg_transactions, avg(total_spent) AS avg_total_spent, avg(avg_order_value) AS avg_order_value,
  avg(tenure_days) AS avg_tenure, avg(orders_per_month) AS avg_orders_per_month, avg(spend_per_month) AS avg_spend_per_month,
  avg(item_diversity) AS avg_item_diversity
FROM (SELECT *, CAST(customer_id % 6 AS INTEGER) AS cluster FROM seg) GROUP BY 1""",
    "q": """SELECT quantile_cont(avg_total_spent, 0.5) AS s, quantile_cont(avg_transactions, 0.5) AS t,
  quantile_cont(avg_tenure, 0.25) AS n, quantile_cont(avg_recency, 0.75) AS r, SUM(customer_count) AS c FROM prof""",
    "named": """SELECT prof.*, c, CASE WHEN avg_tenure < n THEN 'new_customers' WHEN avg_recency > r THEN 'churning'
  WHEN avg_total_spent > s AND avg_transactions > t THEN 'high_value_frequent' WHEN avg_total_spent > s THEN 'high_value_infrequent'
  WHEN avg_transactions > t THEN 'low_value_frequent' ELSE 'low_value_infrequent' END AS p FROM prof, q"""}))
def c05d_given(spark, sf):
    """C5d profiles of clusters that are given (by customer id), so that SQL can tell them too."""
    given = _seg(spark, sf).withColumn("cluster", (F.col("customer_id") % 6).cast("int"))
    p = M.segment_profiles(given)
    return p.select("cluster", "customer_count", *[round_even(c, 6).alias(c) for c in _MEAN_COLS], "pct_of_customers",
                    "segment_name", "description", "recommended_strategy")


@register("c05e_assign_segments")
def c05e(spark, sf):
    """C5e segment of every customer."""
    clustered, _ = _chosen(spark, sf)
    return M.assign_segments(clustered, M.segment_profiles(clustered))


@register("c05e_segment_summary")
def c05e_summary(spark, sf):
    """C5e summary of the segments."""
    return M.segment_summary(M.segment_profiles(_chosen(spark, sf)[0]))


@register("c05f_normalized_centres")
def c05f(spark, sf):
    """C5f min-max normalised cluster centres."""
    return M.normalized_centres(_chosen(spark, sf)[1], SEG_COLS)


def _insights(spark, sf):
    rfm = C.rfm_metrics(_sales(spark, sf), AS_OF, partial(_base, spark, sf))
    rfm = C.rfm_segment(C.rfm_scores(rfm, 5)).select("customer_id", "Segment", "RFM_Score")
    with ThreadPoolExecutor(2) as pool:  # a fit waits for its driver most of the time, so both go on together
        for made in [pool.submit(model, spark, sf) for model in (_churn_model, _ltv_model)]:
            made.result()
    return C.customer_insights(rfm, _churn_scores(spark, sf), _ltv_pred(spark, sf))


@register("j07_customer_insights")
def j07(spark, sf):
    """J7 RFM segment x churn risk x LTV band per customer."""
    return _insights(spark, sf)


@register("c06_priority_customers")
def c06(spark, sf):
    """C6 high-value customers at high churn risk."""
    return C.priority_customers(_insights(spark, sf))


def _features(spark, sf):
    return _table(spark, "demand-features", sf, lambda: features(spark, sf))


def _train_table(spark, sf):
    return _table(spark, "demand-data", sf, lambda: FC.forecast_training(_features(spark, sf), FEATURE_COLS, "date", "category", 0.2))


def _forecaster(spark, sf):
    return _model(spark, "demand", sf, lambda: M.train_forecaster(_train_table(spark, sf), FEATURE_COLS, "qty"))


@register("f04_train_forecaster")
def f04(spark, sf):
    """F4 boosted demand model with early stopping: train / validation metrics."""
    return M.train_forecaster(_train_table(spark, sf), FEATURE_COLS, "qty")[1]


@register("f05_forecast")
def f05(spark, sf):
    """F5 model predictions on the validation rows."""
    return M.forecast(_forecaster(spark, sf), _train_table(spark, sf).where("split = 'test'")).select(
        "category", "date", "qty", "prediction")


@register("f06_rollout")
def f06(spark, sf):
    """F6 recursive 7-day rollout for every series (checkpointed per step)."""
    from .q_forecast import dense_daily
    model = _forecaster(spark, sf)

    def feats(frame):
        return FC.forecast_features(frame, "qty", (1, 7, 14, 28), (7, 14, 28), "category")
    return M.rollout(model, dense_daily(spark, sf), 7, "category", "qty", feats)


@register("f08_feature_importance")
def f08(spark, sf):
    """F8 top-10 features of the demand model."""
    return M.feature_importance(_forecaster(spark, sf), 10)


@register("f09_permutation_importance")
def f09(spark, sf):
    """F9 permutation importance (MAE increase) of every feature."""
    t = _train_table(spark, sf).where("split = 'test'").withColumn("rid", F.col("row_index"))
    return M.permutation_importance(_forecaster(spark, sf), t, FEATURE_COLS, "qty", "rid")


def _explained(spark, sf):
    return E.shap_values(_forecaster(spark, sf), _train_table(spark, sf).where("split = 'test'"), ["category", "date", "qty"])


@register("f09_shap_values")
def f09_values(spark, sf):
    """F9 tree SHAP of every validation row of the demand model."""
    return _explained(spark, sf)


@register("f09_shap_importance")
def f09_shap(spark, sf):
    """F9 mean absolute SHAP value of every feature over the validation rows."""
    return E.shap_importance(_explained(spark, sf), FEATURE_COLS)


def _folds(spark, sf):
    t = _features(spark, sf).na.drop(subset=FEATURE_COLS).withColumn("key", F.concat_ws("|", "category", F.col("date").cast("string")))
    return W.time_series_folds(t, "date", "key", 3)


def _trials(spark, sf):
    def search(folder):
        M.tune(FEATURE_COLS, "qty", _folds(spark, sf)).write.parquet(folder)
    return spark.read.parquet(_place(spark, "search", sf, search))


@register("f10_tune")
def f10(spark, sf):
    """F10 Parzen search of the whole space, 50 trials scored by rolling-origin CV."""
    return _trials(spark, sf)


@register("f10_best_model")
def f10_best(spark, sf):
    """F10 the demand model refitted with the best trial's parameters: train / validation metrics."""
    return M.train_forecaster(_train_table(spark, sf), FEATURE_COLS, "qty", M.best_params(_trials(spark, sf)))[1]


@register("f11_cross_validate")
def f11(spark, sf):
    """F11 rolling-origin CV (3 folds): mean and population std of metrics."""
    return M.cross_validate(FEATURE_COLS, "qty", _folds(spark, sf))


@register("f12_search_summary")
def f12(spark, sf):
    """F12 summary of the parameter search's written trials."""
    return M.search_summary(_trials(spark, sf))


@register("f12_summary_of_given_trials", """
WITH t AS (SELECT CAST(o_custkey % 50 AS INTEGER) AS trial, CAST(floor(SUM(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS s FROM orders GROUP BY 1),
first AS (SELECT s AS v FROM t WHERE trial = 0)
SELECT count(*) AS n_trials, CAST(min(s) AS DOUBLE) AS best, CAST(max(s) AS DOUBLE) AS worst, round(avg(s), 3) AS mean, round(stddev_pop(s), 3) AS std,
  arg_min('p' || trial, {'s': s, 't': trial}) AS best_params,
  round(CASE WHEN max(v) > 0 THEN (max(v) - min(s)) / max(v) * 100.0 END, 6) AS improvement_pct
FROM t, first""")
def f12_given(spark, sf):
    """F12 over a given trial table (order value by customer number modulo 50 as the score)."""
    o = D.read(spark, sf, "orders")
    t = o.groupBy((F.col("o_custkey") % 50).cast("int").alias("trial")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("long").cast("double").alias("cv_rmse"))
    s = M.search_summary(t.withColumn("params", F.concat(F.lit("p"), F.col("trial").cast("string"))))
    return s.select("n_trials", "best", "worst", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), "best_params",
                    F.round("improvement_pct", 6).alias("improvement_pct"))


@register("b11_factorize")
def b11(spark, sf):
    """B11 implicit ALS top-5 dishes per customer."""
    return M.factorize(B.user_item(D.transactions(spark, sf), implicit=True, item="item_name"))


def _matrix(spark, sf):
    return B.user_item(D.transactions(spark, sf), item="item_name")


@register("b11_svd_values")
def b11_svd(spark, sf):
    """B11 truncated SVD of customers x dishes: the five largest singular values."""
    values = SVD.truncated_svd(_matrix(spark, sf)).values
    return spark.createDataFrame([(k + 1, v) for k, v in enumerate(values)], "component int, singular_value double")


@register("b11_svd_reconstruct")
def b11_reconstruct(spark, sf):
    """B11 quantities as five components give them, for every customer and dish bought."""
    ui = _matrix(spark, sf)
    return SVD.reconstruct(ui, SVD.truncated_svd(ui))


@register("x11_encode_features")
def x11(spark, sf):
    """X11 label/one-hot encoding and min-max / standard scaling of menu rows."""
    mi = D.menu_items(spark, sf).select("id", "category", "subcategory", "price", "prep_time_minutes")
    out = M.encode_features(mi, ["category", "subcategory"], ["price", "prep_time_minutes"])
    return out.select("id", "category_idx", "subcategory_idx",
                      F.col("num_minmax").cast("string").alias("num_minmax"),
                      F.col("num_std").cast("string").alias("num_std"))


# --------------------------------------------------------------------------- the steps behind a model, over given scores
_GIVEN = """SELECT c_custkey AS customer_id, CAST((c_custkey * 37) % 101 AS DOUBLE) / 100.0 AS p,
  greatest(CAST(c_acctbal AS DOUBLE), 0.0) AS predicted_ltv, c_mktsegment AS Segment FROM customer"""
_RISK = """CASE WHEN p <= 0.25 THEN 'Low' WHEN p <= 0.5 THEN 'Medium' WHEN p <= 0.75 THEN 'High' ELSE 'Critical' END"""
_BANDED = f"""SELECT customer_id, predicted_ltv, list_value({', '.join(repr(x) for x in M.LTV_LABELS)})
  [1 + CAST(predicted_ltv > e[1] AS INT) + CAST(predicted_ltv > e[2] AS INT) + CAST(predicted_ltv > e[3] AS INT)
   + CAST(predicted_ltv > e[4] AS INT)] AS ltv_segment
FROM given, (SELECT quantile_cont(predicted_ltv, [0.2, 0.4, 0.6, 0.8]) AS e FROM given)"""
_INSIGHTS = f"""SELECT g.customer_id, Segment, round(p, 6) AS churn_probability, p >= 0.5 AS will_churn, {_RISK} AS risk_level,
  b.predicted_ltv, ltv_segment FROM given g JOIN banded b ON b.customer_id = g.customer_id"""
_CTES = f"WITH given AS ({_GIVEN}), banded AS ({_BANDED}) "


def _given(spark, sf):
    return D.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), (((F.col("c_custkey") * 37) % 101).cast("double") / 100.0).alias("p"),
        F.greatest(F.col("c_acctbal").cast("double"), F.lit(0.0)).alias("predicted_ltv"), F.col("c_mktsegment").alias("Segment"))


def _given_insights(spark, sf):
    g = _given(spark, sf)
    return C.customer_insights(g.select("customer_id", "Segment"), M.churn_bands(g), M.ltv_bands(g.select("customer_id", "predicted_ltv")))


@register("c03d_bands_of_given_scores", _CTES + f"""SELECT customer_id, round(p, 6) AS churn_probability, p >= 0.5 AS will_churn,
  {_RISK} AS risk_level FROM given""")
def c03d_given(spark, sf):
    """C3d flag and risk band of given churn scores."""
    return M.churn_bands(_given(spark, sf))


@register("c03e_at_risk_of_given_scores", _CTES + f"""SELECT customer_id, round(p, 6) AS churn_probability, p >= 0.5 AS will_churn,
  {_RISK} AS risk_level FROM given WHERE p >= 0.5""")
def c03e_given(spark, sf):
    """C3e customers at risk by given churn scores."""
    return M.at_risk(M.churn_bands(_given(spark, sf)))


@register("c04e_bands_of_given_values", _CTES + "SELECT * FROM banded")
def c04e_given(spark, sf):
    """C4e five value bands of given lifetime values."""
    return M.ltv_bands(_given(spark, sf).select("customer_id", "predicted_ltv"))


@register("j07_insights_of_given_inputs", _CTES + _INSIGHTS)
def j07_given(spark, sf):
    """J7 segment x churn risk x value band over given inputs."""
    return _given_insights(spark, sf)


@register("c06_priority_of_given_inputs", _CTES + f"""SELECT * FROM ({_INSIGHTS})
WHERE ltv_segment IN ('High', 'Above Average') AND risk_level IN ('High', 'Critical')""")
def c06_given(spark, sf):
    """C6 priority customers over given inputs."""
    return C.priority_customers(_given_insights(spark, sf))


@register("x11_encoded_columns", """
WITH c AS (SELECT p_type, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS DOUBLE) AS i FROM part GROUP BY 1),
b AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS DOUBLE) AS i FROM part GROUP BY 1),
s AS (SELECT min(p_size) AS lo, max(p_size) AS hi, avg(p_size) AS m, stddev_samp(p_size) AS sd FROM part)
SELECT p_partkey AS id, c.i AS type_idx, b.i AS brand_idx, (SELECT count(*) FROM c) AS type_width,
  round((p_size - lo) / CAST(hi - lo AS DOUBLE), 6) AS size_minmax, round((p_size - m) / sd, 6) AS size_std
FROM part JOIN c ON c.p_type = part.p_type JOIN b ON b.p_brand = part.p_brand, s""")
def x11_columns(spark, sf):
    """X11 codes and scaled values of the parts as plain columns."""
    out = M.encode_features(D.read(spark, sf, "part"), ["p_type", "p_brand"], ["p_size"])
    at = lambda c: F.round(vector_to_array(c)[0], 6)
    return out.select(F.col("p_partkey").alias("id"), F.col("p_type_idx").alias("type_idx"), F.col("p_brand_idx").alias("brand_idx"),
                      F.size(vector_to_array("p_type_ohe")).cast("long").alias("type_width"), at("num_minmax").alias("size_minmax"),
                      at("num_std").alias("size_std"))
