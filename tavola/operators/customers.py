"""Customer analytics.

All per-customer features come from one ``groupBy(customer_id)`` over the
line table (``customer_base``): the shuffle is on the customer key, partial
aggregation runs map-side, and the distinct counts are planned by Catalyst
(Expand + two-level aggregation), so a hot customer is pre-aggregated in
every task before the shuffle.  Money moments are exact decimals
(``functions/stats.py``) so results do not depend on row order.

``as_of`` may be a literal (string / datetime) or a Column (for data-derived
cut dates such as the LTV hold-out).  ``base`` gives the table that
``customer_base`` makes of the lines, for callers that have it already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import quantile_bins, rank_bins
from ..functions.rounding import round_even, safe_div
from ..functions.bins import exact_quantiles
from ..functions.scalars import scalar_struct, scalar_value
from ..functions.stats import mean_of, s1, s2, std_of
from ..functions.timeutil import day_of_week, floor_days, part_of_day, ts_lit
from ..session import ensure_checkpoint_dir

# RFM segment names in ladder order (the executed rules).
RFM_SEGMENTS = ["Champions", "Loyal Customers", "Potential Loyalists", "New Customers", "Promising",
                "Need Attention", "About to Sleep", "Can't Lose Them", "At Risk", "Lost", "Hibernating",
                "Other"]

# Marketing playbook per RFM segment (strategy, actions, priority).
PLAYBOOK = [
    ("Champions", "Reward and retain",
     ["Offer exclusive loyalty rewards", "Early access to new menu items", "Personalized VIP experiences",
      "Ask for referrals and reviews"], "High - Maintain relationship"),
    ("Loyal Customers", "Upsell and engage",
     ["Recommend premium items", "Loyalty program upgrades", "Birthday/anniversary specials",
      "Feedback surveys"], "High - Increase share of wallet"),
    ("Potential Loyalists", "Convert to loyal",
     ["Membership offers", "Cross-sell related items", "Personalized recommendations",
      "Engagement campaigns"], "High - Build loyalty"),
    ("New Customers", "Onboard and nurture",
     ["Welcome offers", "Introduction to menu variety", "First-time buyer discounts",
      "Sign up for loyalty program"], "Medium - Establish relationship"),
    ("Promising", "Encourage more visits",
     ["Time-limited promotions", "Bundle deals", "Occasion-based marketing"], "Medium - Increase frequency"),
    ("Need Attention", "Reactivate",
     ["Win-back campaigns", "Special comeback offers", "Ask for feedback"], "Medium - Prevent churn"),
    ("About to Sleep", "Reactivate urgently",
     ["Limited-time offers", "Reminder campaigns", "We miss you messaging"], "High - Immediate action"),
    ("At Risk", "Win back",
     ["Personal outreach", "Significant discounts", "Survey for feedback"], "High - Urgent retention"),
    ("Can't Lose Them", "Win back urgently",
     ["Immediate personal contact", "Special recovery offers", "Understand issues"],
     "Critical - High value at risk"),
    ("Hibernating", "Reawaken",
     ["Reactivation campaign", "New menu highlights", "Special comeback offer"], "Low - Test reactivation"),
    ("Lost", "Attempt win-back",
     ["Last resort offers", "Brand awareness campaigns", "Low-cost reactivation attempts"],
     "Low - Accept potential loss"),
]

# Total-score bands (5-way notebook ladder and 4-way test ladder).
SCORE_BANDS_5 = [(12, "Champions"), (9, "Loyal Customers"), (6, "Potential Loyalists"), (4, "At Risk")]
SCORE_BANDS_5_FLOOR = "Lost"
SCORE_BANDS_4 = [(10, "Champions"), (7, "Loyal Customers"), (4, "Potential Loyalists")]
SCORE_BANDS_4_FLOOR = "At Risk"

# LTV band labels, low to high.
LTV_LABELS = ["Low", "Below Average", "Average", "Above Average", "High"]


def _asof(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else ts_lit(as_of)


# --------------------------------------------------------------------------- base
def customer_base(tx: DataFrame, cid: str = "customer_id", with_calendar: bool = False) -> DataFrame:
    """One aggregate per customer shared by RFM, churn, LTV and segmentation.

    The two distinct counts come from narrow (customer, order) and (customer,
    item) groups; inside one aggregate they would expand every wide row
    threefold.  All three are partitioned by customer and join in place."""
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            s1("total_price").alias("_s1"), s2("total_price").alias("_s2"),
            F.max("total_price").alias("max_price"), F.min("total_price").alias("min_price"),
            F.sum("quantity").cast("long").alias("total_items"),
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    if with_calendar:
        aggs += [F.count_if(day_of_week("ts") == i).cast("long").alias(f"orders_dow_{i}") for i in range(7)]
        pod = part_of_day(F.hour("ts"))
        aggs += [F.count_if(pod == p).cast("long").alias(f"orders_{p}")
                 for p in ("morning", "lunch", "afternoon", "dinner", "late")]
    known = tx.where(F.col(cid).isNotNull())
    out = known.groupBy(cid).agg(*aggs)
    for col, name in (("order_id", "n_orders"), ("item_id", "unique_items")):
        n = known.select(cid, col).distinct().groupBy(cid).agg(F.count(col).alias(name))
        out = out.join(n, cid)
    return out


# --------------------------------------------------------------------------- RFM
def rfm_metrics(tx: DataFrame, as_of, base: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Recency (floored days), frequency (rows), monetary (exact sum)."""
    if base is None:
        b = (tx.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
             .agg(F.max("ts").alias("_last"), F.count(F.lit(1)).alias("frequency"),
                  s1("total_price").alias("_m")))
    else:
        b = base().select("customer_id", F.col("last_ts").alias("_last"), F.col("n_rows").alias("frequency"), F.col("_s1").alias("_m"))
    return b.select("customer_id", floor_days(_asof(as_of), "_last").alias("recency"),
                       "frequency", F.col("_m").cast("double").alias("monetary"))


def rfm_scores(rfm: DataFrame, q: int = 5) -> DataFrame:
    """R by value quantile (reversed), F and M by first-come rank quantile.

    The per-customer table feeds three passes (recency edges, two ranks); it
    is checkpointed once so the line-level aggregation is not recomputed."""
    ensure_checkpoint_dir(rfm.sparkSession)
    rfm = rfm.checkpoint(eager=True)
    # recency is a whole number of days: its distinct values are bounded by the
    # span of the data, not its volume, so Spark's value-count percentile fits
    r = quantile_bins(rfm, "recency", q, "R", reverse=True, key="customer_id", method="map")
    f = rank_bins(r, "frequency", q, "customer_id", "F")
    m = rank_bins(f, "monetary", q, "customer_id", "M")
    return (m.withColumn("RFM_Score", F.concat(F.col("R").cast("string"), F.col("F").cast("string"),
                                               F.col("M").cast("string")))
            .withColumn("RFM_Total", F.col("R") + F.col("F") + F.col("M")))


def rfm_segment_expr(r="R", f="F", m="M") -> Column:
    """The 12-way ladder, evaluated in exactly this order."""
    R, Fq, M = F.col(r), F.col(f), F.col(m)
    return (F.when((R >= 4) & (Fq >= 4) & (M >= 4), "Champions")
            .when((R >= 3) & (Fq >= 3) & (M >= 3), "Loyal Customers")
            .when((R >= 4) & Fq.isin(2, 3) & M.isin(2, 3), "Potential Loyalists")
            .when((R >= 4) & (Fq == 1), "New Customers")
            .when(R.isin(3, 4) & (Fq <= 2) & (M <= 2), "Promising")
            .when(R.isin(2, 3) & Fq.isin(2, 3) & M.isin(2, 3), "Need Attention")
            .when(R.isin(2, 3) & (Fq <= 2), "About to Sleep")
            .when((R <= 2) & (Fq >= 3) & (M >= 4), "Can't Lose Them")
            .when((R <= 2) & (Fq >= 3), "At Risk")
            .when((R == 1) & (Fq == 1), "Lost")
            .when((R <= 2) & (Fq <= 2), "Hibernating")
            .otherwise("Other"))


def rfm_segment(scores: DataFrame) -> DataFrame:
    return scores.withColumn("Segment", rfm_segment_expr())


def rfm_summary(seg: DataFrame) -> DataFrame:
    """C1d: per segment counts, means (2 dp), revenue, % customers and % revenue (1 dp)."""
    g = (seg.groupBy("Segment")
         .agg(F.count(F.lit(1)).alias("customer_count"),
              F.sum("recency").alias("_r"), F.sum("frequency").alias("_f"),
              s1("monetary").alias("_m"), F.sum("RFM_Total").alias("_t")))
    tot = scalar_struct(g.agg(F.sum("customer_count").alias("_nc"), F.sum("_m").alias("_nm")))
    n = F.col("customer_count")
    return (g.select("*", tot["_nc"].alias("_nc"), tot["_nm"].alias("_nm"))
            .select("Segment", "customer_count",
                    round_even(mean_of("_r", n), 2).alias("avg_recency_days"),
                    round_even(mean_of("_f", n), 2).alias("avg_frequency"),
                    round_even(mean_of("_m", n), 2).alias("avg_monetary"),
                    round_even(F.col("_m").cast("double"), 2).alias("total_monetary"),
                    round_even(mean_of("_t", n), 2).alias("avg_rfm_score"),
                    round_even(n.cast("double") / F.col("_nc").cast("double") * 100, 1).alias("customer_pct"),
                    round_even(safe_div(F.col("_m").cast("double"), F.col("_nm").cast("double"), 0.0) * 100, 1)
                    .alias("revenue_pct")))


def playbook_table(spark) -> DataFrame:
    return spark.createDataFrame(PLAYBOOK, "Segment string, strategy string, actions array<string>, priority string")


def with_playbook(seg: DataFrame, playbook: DataFrame | None = None) -> DataFrame:
    """C1e: attach strategy, actions and priority (11-row table, broadcast)."""
    pb = playbook if playbook is not None else playbook_table(seg.sparkSession)
    return seg.join(F.broadcast(pb), "Segment", "left")


def score_bands(scores: DataFrame, col: str = "RFM_Total", four_way: bool = False,
                out: str = "score_band") -> DataFrame:
    """C1f: total-score bands (>=12/9/6/4, or the 4-bin >=10/7/4 variant)."""
    cuts, floor = (SCORE_BANDS_4, SCORE_BANDS_4_FLOOR) if four_way else (SCORE_BANDS_5, SCORE_BANDS_5_FLOOR)
    expr = None
    for cut, name in cuts:
        expr = F.when(F.col(col) >= cut, name) if expr is None else expr.when(F.col(col) >= cut, name)
    return scores.withColumn(out, expr.otherwise(floor))


def rule_segments(stats: DataFrame, as_of, last="last_order", orders="total_orders",
                  spent="total_spent") -> DataFrame:
    """C1g: the UI's 6-way rule segment; a missing last order counts as 999 days."""
    days = F.coalesce(floor_days(_asof(as_of), last), F.lit(999))
    n, s = F.coalesce(F.col(orders), F.lit(0)), F.coalesce(F.col(spent).cast("double"), F.lit(0.0))
    seg = (F.when((days < 30) & (n >= 5) & (s >= 200), "Champion")
           .when((days < 45) & (n >= 3) & (s >= 100), "Loyal")
           .when((days >= 30) & (days < 60) & (s >= 50), "At Risk")
           .when(days >= 60, "Lost")
           .when(n >= 2, "Promising")
           .otherwise("New"))
    return stats.withColumn("days_since_order", days).withColumn("segment", seg)


def segment_counts(segmented: DataFrame, col: str = "segment") -> DataFrame:
    """C1g / C4f: customers in each segment or band."""
    return segmented.groupBy(col).agg(F.count(F.lit(1)).alias("n_customers"))


def rfm_rule_segments(rfm: DataFrame) -> DataFrame:
    """C1g test variant: 4-way by recency and frequency."""
    r, f = F.col("recency"), F.col("frequency")
    return rfm.withColumn("segment", F.when((r <= 30) & (f >= 5), "Champion")
                          .when((r <= 60) & (f >= 3), "Loyal").when(r >= 90, "At Risk").otherwise("Regular"))


def rfm_ratios(rfm: DataFrame) -> DataFrame:
    """C5g: spend per transaction and frequency per (recency + 1)."""
    return (rfm.withColumn("avg_transaction_value", safe_div("monetary", "frequency"))
            .withColumn("purchase_intensity", F.col("frequency").cast("double") / (F.col("recency") + 1)))


# --------------------------------------------------------------------------- C2
def customer_features(tx: DataFrame, customers: DataFrame, as_of) -> DataFrame:
    """Stored customer features, left-joined onto every customer."""
    now = _asof(as_of)
    c = tx.where(F.col("customer_id").isNotNull())
    agg = (c.groupBy("customer_id")
           .agg(F.countDistinct("order_id").alias("num_orders"), s1("total_price").alias("_s"),
                F.sum("quantity").cast("long").alias("total_items"),
                F.min("ts").alias("first_order_date"), F.max("ts").alias("last_order_date"),
                F.mode("category", True).alias("favorite_category")))
    n = F.col("num_orders").cast("double")
    feats = agg.select(
        "customer_id", "num_orders", F.col("_s").cast("double").alias("total_spent"), "total_items",
        "first_order_date", "last_order_date", "favorite_category",
        round_even(F.col("_s").cast("double") / n, 2).alias("avg_order_value"),
        round_even(F.col("total_items").cast("double") / n, 2).alias("avg_items_per_order"),
        floor_days(now, "first_order_date").alias("days_since_first_order"),
        floor_days(now, "last_order_date").alias("days_since_last_order"))
    feats = feats.withColumn("order_frequency", round_even(
        F.col("num_orders").cast("double") / (F.col("days_since_first_order") + 1) * 30, 2))
    return customers.select("customer_id", "loyalty_tier").join(feats, "customer_id", "left")


# --------------------------------------------------------------------------- churn
def churn_labels(tx: DataFrame, as_of, days: int = 60) -> DataFrame:
    """Churned when floored days since the last purchase exceed ``days``."""
    last = tx.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.max("ts").alias("last_purchase_date"))
    d = floor_days(_asof(as_of), "last_purchase_date")
    return (last.withColumn("days_since_last_purchase", d)
            .withColumn("is_churned", (F.col("days_since_last_purchase") > days).cast("int")))


def churn_features(tx: DataFrame, as_of, customers: DataFrame | None = None,
                   base: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Base aggregates, tenure, span, rates, 7 weekday and 5 part-of-day
    counts (conditional counts in the same aggregate: no pivot shuffle)."""
    now = _asof(as_of)
    b = base() if base else customer_base(tx, with_calendar=True)
    n = F.col("n_rows")
    out = b.select(
        "customer_id",
        floor_days(now, "last_ts").alias("recency_days"),
        F.col("n_orders").alias("total_transactions"),
        F.col("_s1").cast("double").alias("total_spent"),
        mean_of("_s1", n).alias("avg_order_value"),
        F.coalesce(std_of("_s1", "_s2", n), F.lit(0.0)).alias("std_order_value"),
        "total_items",
        (F.col("total_items").cast("double") / n.cast("double")).alias("avg_items_per_order"),
        F.col("unique_items").alias("unique_items_ordered"),
        floor_days(now, "first_ts").alias("tenure_days"),
        floor_days("last_ts", "first_ts").alias("purchase_span_days"),
        *[f"orders_dow_{i}" for i in range(7)],
        *[f"orders_{p}" for p in ("morning", "lunch", "afternoon", "dinner", "late")])
    t = F.col("tenure_days")
    out = (out.withColumn("orders_per_month", F.when(t > 0, F.col("total_transactions") / (t / 30.0))
                          .otherwise(F.col("total_transactions").cast("double")))
           .withColumn("recency_ratio", F.when(t > 0, F.col("recency_days") / t.cast("double")).otherwise(1.0)))
    if customers is not None:
        out = out.join(customers.select("customer_id", "loyalty_tier"), "customer_id", "left")
    return out


def churn_by_value_band(rfm: DataFrame, q: int = 3, days: int = 60) -> DataFrame:
    """Churn rate by spend band (value-quantile bins Low/Medium/High)."""
    labels = ["Low", "Medium", "High"] if q == 3 else [str(i) for i in range(1, q + 1)]
    b = quantile_bins(rfm.withColumn("churned", (F.col("recency") > days).cast("int")),
                      "monetary", q, "segment", labels=labels, key="customer_id")
    return b.groupBy("segment").agg(F.count(F.lit(1)).alias("n_customers"),
                                    round_even(F.avg("churned"), 6).alias("churn_rate"))


# --------------------------------------------------------------------------- LTV
def ltv_features(tx: DataFrame, as_of, horizon: int = 365, base: Callable[[], DataFrame] | None = None) -> DataFrame:
    """C4: 12 aggregates and 9 guarded ratios per customer."""
    now = _asof(as_of)
    b = base() if base else customer_base(tx)
    n = F.col("n_rows")
    f = b.select(
        "customer_id",
        F.col("n_rows").alias("total_records"), F.col("n_orders").alias("total_transactions"),
        F.col("_s1").cast("double").alias("total_revenue"),
        mean_of("_s1", n).alias("avg_order_value"),
        std_of("_s1", "_s2", n).alias("std_order_value"),
        F.col("max_price").alias("max_order_value"), F.col("min_price").alias("min_order_value"),
        "total_items", (F.col("total_items").cast("double") / n.cast("double")).alias("avg_items_per_order"),
        "unique_items",
        floor_days(now, "first_ts").alias("tenure_days"), floor_days(now, "last_ts").alias("recency_days"),
        floor_days("last_ts", "first_ts").alias("purchase_span"))
    t, k = F.col("tenure_days"), F.col("total_transactions")
    f = (f.withColumn("orders_per_month", F.when(t > 0, k / (t / 30.0)).otherwise(k.cast("double")))
         .withColumn("avg_days_between_orders", F.when(k > 1, F.col("purchase_span") / (k - 1).cast("double"))
                     .otherwise(0.0))
         .withColumn("revenue_per_month", F.when(t > 0, F.col("total_revenue") / (t / 30.0))
                     .otherwise(F.col("total_revenue")))
         .withColumn("order_value_range", F.col("max_order_value") - F.col("min_order_value"))
         .withColumn("order_value_cv", F.when(F.col("avg_order_value") > 0,
                                              F.coalesce("std_order_value", F.lit(0.0)) / F.col("avg_order_value"))
                     .otherwise(0.0))
         .withColumn("item_diversity_ratio", F.when(F.col("total_items") > 0,
                                                    F.col("unique_items") / F.col("total_items").cast("double"))
                     .otherwise(0.0))
         .withColumn("recency_ratio", F.when(t > 0, F.col("recency_days") / t.cast("double")).otherwise(1.0))
         .withColumn("expected_future_orders", F.when(F.col("avg_days_between_orders") > 0,
                                                      F.lit(float(horizon)) / F.col("avg_days_between_orders"))
                     .otherwise(F.col("orders_per_month") * (horizon / 30.0))))
    return f


def ltv_target(tx: DataFrame, cut, seen: DataFrame | None = None) -> DataFrame:
    """Spend after ``cut`` for every customer seen up to ``cut`` (0 if none);
    ``seen`` are those customers, if they are known."""
    c = _asof(cut)
    hist = (tx.where((F.col("ts") <= c) & F.col("customer_id").isNotNull()).select("customer_id").distinct() if seen is None else
            seen.select("customer_id"))
    fut = (tx.where(F.col("ts") > c).groupBy("customer_id").agg(s1("total_price").alias("_f")))
    return (hist.join(fut, "customer_id", "left")
            .select("customer_id", F.coalesce(F.col("_f").cast("double"), F.lit(0.0)).alias("future_value")))


def ltv_cut(tx: DataFrame, holdout: int = 90) -> DataFrame:
    """One-row frame with the hold-out cut: max(ts) - holdout days."""
    return tx.agg((F.max("ts") - F.expr(f"INTERVAL {int(holdout)} DAYS")).alias("_cut"))


def ltv_training(tx: DataFrame, holdout: int = 90, horizon: int = 365) -> DataFrame:
    """Features on history up to the cut joined to the hold-out target.

    The cut is a data-derived scalar; it is collected once (a single value),
    then used as a literal so the scans below keep their pushed filters.  The
    history's aggregates are kept, since they name the target's customers too."""
    cut = ltv_cut(tx, holdout).collect()[0]["_cut"]
    hist = tx.where(F.col("ts") <= ts_lit(cut))
    ensure_checkpoint_dir(tx.sparkSession)
    base = customer_base(hist).checkpoint()
    feats = ltv_features(hist, cut, horizon, lambda: base)
    return feats.join(ltv_target(tx, cut, base), "customer_id")


def simple_ltv(tx: DataFrame, months: int = 24) -> DataFrame:
    """C4g: mean value x orders per month (tenure >= 1 month) x lifespan, 5 bands."""
    b = (tx.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
         .agg(s1("total_price").alias("_s"), F.count(F.lit(1)).alias("total_orders"),
              F.min("ts").alias("_first"), F.max("ts").alias("_last")))
    tenure = F.greatest(floor_days("_last", "_first") / 30.0, F.lit(1.0))
    out = b.select("customer_id", mean_of("_s", "total_orders").alias("avg_order_value"),
                   tenure.alias("tenure_months"), F.col("_s").cast("double").alias("total_spent"), "total_orders")
    out = (out.withColumn("purchase_frequency", F.col("total_orders") / F.col("tenure_months"))
           .withColumn("simple_ltv", F.col("avg_order_value") * F.col("purchase_frequency") * float(months))
           .withColumn("historical_ltv", F.col("total_spent")))
    return quantile_bins(out, "simple_ltv", 5, "ltv_segment", labels=LTV_LABELS, key="customer_id").drop("total_orders")


def value_rates(tx: DataFrame) -> DataFrame:
    """C4h: historical LTV, AOV per distinct order, purchase rate per active day."""
    b = (tx.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
         .agg(s1("total_price").alias("_s"), F.countDistinct("order_id").alias("frequency"),
              F.min("ts").alias("_first"), F.max("ts").alias("_last")))
    span = floor_days("_last", "_first") + 1
    return b.select("customer_id", F.col("_s").cast("double").alias("historical_ltv"),
                    mean_of("_s", "frequency").alias("aov"), "frequency", span.alias("tenure_days"),
                    (F.col("frequency") / span.cast("double")).alias("frequency_rate"))


def ltv_distribution(pred: DataFrame, col: str = "predicted_ltv") -> DataFrame:
    """C4f: count, mean, median, std, min, max, percentiles and total (one row)."""
    ps = [0.25, 0.5, 0.75, 0.9, 0.95]
    key = "customer_id" if "customer_id" in pred.columns else None
    pc = scalar_value(exact_quantiles(pred, col, ps, key))
    a = pred.agg(F.count(F.lit(1)).alias("count"), s1(col).alias("_s"), s2(col).alias("_q"),
                 F.min(col).alias("min"), F.max(col).alias("max")).withColumn("_p", pc)
    return a.select("count", round_even(mean_of("_s", "count"), 6).alias("mean"),
                    round_even(F.col("_p")[1], 6).alias("median"),
                    round_even(std_of("_s", "_q", "count"), 6).alias("std"), "min", "max",
                    *[round_even(F.col("_p")[i], 6).alias(f"p{int(p * 100)}") for i, p in enumerate(ps)],
                    F.col("_s").cast("double").alias("total"))


# --------------------------------------------------------------------------- segmentation
def segment_features(tx: DataFrame, as_of) -> DataFrame:
    """8 base features plus tenure, orders/month, spend/month, CV, diversity."""
    now = _asof(as_of)
    b = customer_base(tx)
    n = F.col("n_rows")
    f = b.select("customer_id",
                 floor_days(now, "last_ts").alias("recency_days"),
                 F.col("n_orders").alias("total_transactions"),
                 F.col("_s1").cast("double").alias("total_spent"),
                 mean_of("_s1", n).alias("avg_order_value"),
                 F.coalesce(std_of("_s1", "_s2", n), F.lit(0.0)).alias("std_order_value"),
                 "total_items", (F.col("total_items").cast("double") / n.cast("double")).alias("avg_items_per_order"),
                 F.col("unique_items").alias("unique_items_ordered"),
                 floor_days(now, "first_ts").alias("tenure_days"))
    t, k = F.col("tenure_days"), F.col("total_transactions")
    return (f.withColumn("orders_per_month", F.when(t > 0, k / (t / 30.0)).otherwise(k.cast("double")))
            .withColumn("spend_per_month", F.when(t > 0, F.col("total_spent") / (t / 30.0))
                        .otherwise(F.col("total_spent")))
            .withColumn("order_value_cv", F.when(F.col("avg_order_value") > 0,
                                                 F.col("std_order_value") / F.col("avg_order_value")).otherwise(0.0))
            .withColumn("item_diversity", F.when(F.col("total_items") > 0,
                                                 F.col("unique_items_ordered") / F.col("total_items").cast("double"))
                        .otherwise(0.0)))


def customer_insights(rfm_seg: DataFrame, churn: DataFrame, ltv: DataFrame) -> DataFrame:
    """RFM x churn x LTV on the customer key (co-partitioned inner joins)."""
    return rfm_seg.join(churn, "customer_id").join(ltv, "customer_id")


def priority_customers(insights: DataFrame, ltv_col: str = "ltv_segment", risk_col: str = "risk_level") -> DataFrame:
    """High-value customers at high churn risk."""
    return insights.where(F.col(ltv_col).isin("High", "Above Average") & F.col(risk_col).isin("High", "Critical"))
