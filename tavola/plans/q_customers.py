"""Customer analytics queries (C*, A28) with their SQL oracles."""

from __future__ import annotations

from ..operators import customers as C
from ..operators import reports as R
from ..sources import driver as D
from .registry import AS_OF, REGISTRY, register
from .sqlviews import customer_base, floor_days, qfrac, rank_bin, round_even, std_sql, value_bin, with_views

T = f"TIMESTAMP '{AS_OF}'"

_RFM = f"""SELECT customer_id, {floor_days(T, 'max(ts)')} AS recency, COUNT(*) AS frequency,
  CAST(SUM(CAST(total_price AS DECIMAL(18,2))) AS DOUBLE) AS monetary
FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id"""

_SCORES = f"""SELECT customer_id, recency, frequency, monetary,
  {value_bin('recency', 'e', 5, reverse=True)} AS R, {rank_bin('rf', 'n', 5)} AS F, {rank_bin('rm', 'n', 5)} AS M
FROM (SELECT rfm.*, row_number() OVER (ORDER BY frequency, customer_id) AS rf,
             row_number() OVER (ORDER BY monetary, customer_id) AS rm, COUNT(*) OVER () AS n FROM rfm),
     (SELECT quantile_cont(CAST(recency AS DOUBLE), {qfrac(5)}) AS e FROM rfm)"""

_SEGMENT = """CASE WHEN R >= 4 AND F >= 4 AND M >= 4 THEN 'Champions'
  WHEN R >= 3 AND F >= 3 AND M >= 3 THEN 'Loyal Customers'
  WHEN R >= 4 AND F IN (2, 3) AND M IN (2, 3) THEN 'Potential Loyalists'
  WHEN R >= 4 AND F = 1 THEN 'New Customers'
  WHEN R IN (3, 4) AND F <= 2 AND M <= 2 THEN 'Promising'
  WHEN R IN (2, 3) AND F IN (2, 3) AND M IN (2, 3) THEN 'Need Attention'
  WHEN R IN (2, 3) AND F <= 2 THEN 'About to Sleep'
  WHEN R <= 2 AND F >= 3 AND M >= 4 THEN 'Can''t Lose Them'
  WHEN R <= 2 AND F >= 3 THEN 'At Risk'
  WHEN R = 1 AND F = 1 THEN 'Lost'
  WHEN R <= 2 AND F <= 2 THEN 'Hibernating'
  ELSE 'Other' END"""

_SCORED = f"""SELECT *, CAST(R AS VARCHAR) || CAST(F AS VARCHAR) || CAST(M AS VARCHAR) AS RFM_Score,
  R + F + M AS RFM_Total, {_SEGMENT} AS Segment FROM scores"""

_RFM_CTES = {"rfm": _RFM, "scores": _SCORES, "seg": _SCORED}


def _rfm_seg(spark, sf):
    rfm = C.rfm_metrics(D.transactions(spark, sf, dims=False), AS_OF)
    return C.rfm_segment(C.rfm_scores(rfm, 5))


@register("c01_rfm_metrics", with_views("SELECT * FROM rfm", "tx", extra={"rfm": _RFM}))
def c01(spark, sf):
    """C1 RFM metrics (floored recency, row frequency, exact monetary)."""
    return C.rfm_metrics(D.transactions(spark, sf, dims=False), AS_OF)


@register("c01b_rfm_scores", with_views("""
SELECT *, CAST(R AS VARCHAR) || CAST(F AS VARCHAR) || CAST(M AS VARCHAR) AS RFM_Score, R + F + M AS RFM_Total
FROM scores""", "tx", extra={"rfm": _RFM, "scores": _SCORES}))
def c01b(spark, sf):
    """C1b RFM scores: R value-quantile reversed, F/M first-come rank quantiles."""
    return C.rfm_scores(C.rfm_metrics(D.transactions(spark, sf, dims=False), AS_OF), 5)


@register("c01c_rfm_segments", with_views("SELECT * FROM seg", "tx", extra=_RFM_CTES))
def c01c(spark, sf):
    """C1c RFM segment ladder."""
    return _rfm_seg(spark, sf)


@register("c01d_rfm_summary", with_views(f"""
SELECT Segment, customer_count,
  {round_even('CAST(r AS DOUBLE) / CAST(customer_count AS DOUBLE)', 2)} AS avg_recency_days,
  {round_even('CAST(f AS DOUBLE) / CAST(customer_count AS DOUBLE)', 2)} AS avg_frequency,
  {round_even('CAST(m AS DOUBLE) / CAST(customer_count AS DOUBLE)', 2)} AS avg_monetary,
  {round_even('CAST(m AS DOUBLE)', 2)} AS total_monetary,
  {round_even('CAST(t AS DOUBLE) / CAST(customer_count AS DOUBLE)', 2)} AS avg_rfm_score,
  round_even(CAST(customer_count AS DOUBLE) / CAST(SUM(customer_count) OVER () AS DOUBLE) * 100, 1) AS customer_pct,
  round_even(CAST(m AS DOUBLE) / CAST(SUM(m) OVER () AS DOUBLE) * 100, 1) AS revenue_pct
FROM (SELECT Segment, COUNT(*) AS customer_count, SUM(recency) AS r, SUM(frequency) AS f,
             SUM(CAST(monetary AS DECIMAL(18,2))) AS m, SUM(RFM_Total) AS t FROM seg GROUP BY Segment)""",
                                       "tx", extra=_RFM_CTES))
def c01d(spark, sf):
    """C1d RFM segment summary."""
    return C.rfm_summary(_rfm_seg(spark, sf))


def _playbook_values() -> str:
    rows = []
    for seg, strat, actions, prio in C.PLAYBOOK:
        q = lambda s: "'" + s.replace("'", "''") + "'"
        rows.append(f"({q(seg)}, {q(strat)}, [{', '.join(q(a) for a in actions)}], {q(prio)})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS p(Segment, strategy, actions, priority)"


@register("c01e_rfm_playbook", with_views("""
SELECT seg.*, pb.strategy, pb.actions, pb.priority FROM seg LEFT JOIN pb ON seg.Segment = pb.Segment""",
                                          "tx", extra={**_RFM_CTES, "pb": _playbook_values()}))
def c01e(spark, sf):
    """C1e RFM segments with the marketing playbook attached."""
    return C.with_playbook(_rfm_seg(spark, sf))


@register("c01f_score_bands", with_views("""
SELECT seg.*, CASE WHEN RFM_Total >= 12 THEN 'Champions' WHEN RFM_Total >= 9 THEN 'Loyal Customers'
  WHEN RFM_Total >= 6 THEN 'Potential Loyalists' WHEN RFM_Total >= 4 THEN 'At Risk' ELSE 'Lost' END AS score_band,
  CASE WHEN RFM_Total >= 10 THEN 'Champions' WHEN RFM_Total >= 7 THEN 'Loyal Customers'
  WHEN RFM_Total >= 4 THEN 'Potential Loyalists' ELSE 'At Risk' END AS score_band_4
FROM seg""", "tx", extra=_RFM_CTES))
def c01f(spark, sf):
    """C1f total-score bands, 5-way and 4-way."""
    s = C.score_bands(_rfm_seg(spark, sf))
    return C.score_bands(s, four_way=True, out="score_band_4")


_CSTATS = """SELECT customer_id, COUNT(DISTINCT order_id) AS total_orders,
  CAST(COALESCE(SUM(CAST(total_price AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_spent,
  min(ts) AS first_order, max(ts) AS last_order, CAST(SUM(quantity) AS BIGINT) AS total_items
FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id"""


@register("c01g_rule_segments", with_views(f"""
SELECT cs.* EXCLUDE (d), round_even(total_spent / total_orders, 6) AS avg_order_value, d AS days_since_order,
  CASE WHEN d < 30 AND total_orders >= 5 AND total_spent >= 200 THEN 'Champion'
       WHEN d < 45 AND total_orders >= 3 AND total_spent >= 100 THEN 'Loyal'
       WHEN d >= 30 AND d < 60 AND total_spent >= 50 THEN 'At Risk'
       WHEN d >= 60 THEN 'Lost' WHEN total_orders >= 2 THEN 'Promising' ELSE 'New' END AS segment
FROM (SELECT *, COALESCE({floor_days(T, 'last_order')}, 999) AS d FROM cs) cs""", "tx", extra={"cs": _CSTATS}))
def c01g(spark, sf):
    """C1g UI rule segments (days since order, order count, spend)."""
    return C.rule_segments(R.customer_stats(D.transactions(spark, sf, dims=False)), AS_OF)


_COUNTS = "SELECT segment, COUNT(*) AS n_customers FROM ({sql}) GROUP BY segment"


@register("c01g_rule_segment_counts", _COUNTS.format(sql=REGISTRY["c01g_rule_segments"].sql))
def c01g_counts(spark, sf):
    """C1g customers in each UI rule segment."""
    return C.segment_counts(c01g(spark, sf))


@register("c01g_rfm_rule_segments", with_views("""
SELECT *, CASE WHEN recency <= 30 AND frequency >= 5 THEN 'Champion' WHEN recency <= 60 AND frequency >= 3
  THEN 'Loyal' WHEN recency >= 90 THEN 'At Risk' ELSE 'Regular' END AS segment FROM rfm""", "tx", extra={"rfm": _RFM}))
def c01g2(spark, sf):
    """C1g 4-way recency/frequency rule segments."""
    return C.rfm_rule_segments(C.rfm_metrics(D.transactions(spark, sf, dims=False), AS_OF))


@register("c02_customer_features", with_views(f"""
SELECT cu.customer_id, cu.loyalty_tier, f.num_orders, f.total_spent, f.total_items, f.first_order_date,
  f.last_order_date, f.favorite_category, f.avg_order_value, f.avg_items_per_order, f.days_since_first_order,
  f.days_since_last_order,
  round_even(CAST(f.num_orders AS DOUBLE) / (f.days_since_first_order + 1) * 30, 2) AS order_frequency
FROM cu LEFT JOIN (
  SELECT a.customer_id, num_orders, CAST(s AS DOUBLE) AS total_spent, total_items, first_order_date, last_order_date,
    fav.category AS favorite_category,
    round_even(CAST(s AS DOUBLE) / CAST(num_orders AS DOUBLE), 2) AS avg_order_value,
    round_even(CAST(total_items AS DOUBLE) / CAST(num_orders AS DOUBLE), 2) AS avg_items_per_order,
    {floor_days(T, 'first_order_date')} AS days_since_first_order,
    {floor_days(T, 'last_order_date')} AS days_since_last_order
  FROM (SELECT customer_id, COUNT(DISTINCT order_id) AS num_orders, SUM(CAST(total_price AS DECIMAL(18,2))) AS s,
               CAST(SUM(quantity) AS BIGINT) AS total_items, min(ts) AS first_order_date, max(ts) AS last_order_date
        FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id) a
  JOIN (SELECT customer_id, category FROM (SELECT customer_id, category,
          row_number() OVER (PARTITION BY customer_id ORDER BY COUNT(*) DESC, category) AS r
        FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id, category) WHERE r = 1) fav
    ON a.customer_id = fav.customer_id) f ON cu.customer_id = f.customer_id""", "tx", "cu"))
def c02(spark, sf):
    """C2 stored customer features left-joined to all customers."""
    return C.customer_features(D.transactions(spark, sf), D.customers(spark, sf), AS_OF)


@register("c03_churn_labels", with_views(f"""
SELECT customer_id, last_purchase_date, d AS days_since_last_purchase, CAST(d > 60 AS INTEGER) AS is_churned
FROM (SELECT customer_id, max(ts) AS last_purchase_date, {floor_days(T, 'max(ts)')} AS d
      FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id)""", "tx"))
def c03(spark, sf):
    """C3 churn label: more than 60 days since the last purchase."""
    return C.churn_labels(D.transactions(spark, sf, dims=False), AS_OF, 60)


_BASE_FEATS = f"""customer_id,
  {floor_days(T, 'last_ts')} AS recency_days, n_orders AS total_transactions, CAST(s1 AS DOUBLE) AS total_spent,
  CAST(s1 AS DOUBLE) / CAST(n_rows AS DOUBLE) AS avg_order_value,
  COALESCE({std_sql('s1', 's2', 'n_rows')}, 0.0) AS std_order_value, total_items,
  CAST(total_items AS DOUBLE) / CAST(n_rows AS DOUBLE) AS avg_items_per_order,
  unique_items AS unique_items_ordered, {floor_days(T, 'first_ts')} AS tenure_days"""


@register("c03b_churn_features", with_views(f"""
SELECT f.*, CASE WHEN tenure_days > 0 THEN CAST(total_transactions AS DOUBLE) / (tenure_days / 30.0)
                 ELSE CAST(total_transactions AS DOUBLE) END AS orders_per_month,
  CASE WHEN tenure_days > 0 THEN CAST(recency_days AS DOUBLE) / CAST(tenure_days AS DOUBLE) ELSE 1.0 END AS recency_ratio,
  cu.loyalty_tier
FROM (SELECT {_BASE_FEATS}, {floor_days('last_ts', 'first_ts')} AS purchase_span_days,
        {", ".join(f"orders_dow_{i}" for i in range(7))},
        orders_morning, orders_lunch, orders_afternoon, orders_dinner, orders_late FROM base) f
LEFT JOIN cu ON f.customer_id = cu.customer_id""", "tx", "cu", extra={"base": customer_base(T, calendar=True)}))
def c03b(spark, sf):
    """C3b churn features with weekday and part-of-day counts and tier."""
    return C.churn_features(D.transactions(spark, sf, dims=False), AS_OF, D.customers(spark, sf))


def _ltv_feats_sql(asof: str, horizon: int = 365) -> str:
    return f"""SELECT *, max_order_value - min_order_value AS order_value_range,
  CASE WHEN avg_order_value > 0 THEN COALESCE(std_order_value, 0.0) / avg_order_value ELSE 0.0 END AS order_value_cv,
  CASE WHEN total_items > 0 THEN CAST(unique_items AS DOUBLE) / CAST(total_items AS DOUBLE) ELSE 0.0 END AS item_diversity_ratio,
  CASE WHEN tenure_days > 0 THEN CAST(recency_days AS DOUBLE) / CAST(tenure_days AS DOUBLE) ELSE 1.0 END AS recency_ratio,
  CASE WHEN avg_days_between_orders > 0 THEN {float(horizon)} / avg_days_between_orders
       ELSE orders_per_month * ({horizon} / 30.0) END AS expected_future_orders
FROM (SELECT *,
  CASE WHEN tenure_days > 0 THEN CAST(total_transactions AS DOUBLE) / (tenure_days / 30.0)
       ELSE CAST(total_transactions AS DOUBLE) END AS orders_per_month,
  CASE WHEN total_transactions > 1 THEN CAST(purchase_span AS DOUBLE) / CAST(total_transactions - 1 AS DOUBLE)
       ELSE 0.0 END AS avg_days_between_orders,
  CASE WHEN tenure_days > 0 THEN total_revenue / (tenure_days / 30.0) ELSE total_revenue END AS revenue_per_month
FROM (SELECT customer_id, n_rows AS total_records, n_orders AS total_transactions, CAST(s1 AS DOUBLE) AS total_revenue,
  CAST(s1 AS DOUBLE) / CAST(n_rows AS DOUBLE) AS avg_order_value, {std_sql('s1', 's2', 'n_rows')} AS std_order_value,
  max_price AS max_order_value, min_price AS min_order_value, total_items,
  CAST(total_items AS DOUBLE) / CAST(n_rows AS DOUBLE) AS avg_items_per_order, unique_items,
  {floor_days(asof, 'first_ts')} AS tenure_days, {floor_days(asof, 'last_ts')} AS recency_days,
  {floor_days('last_ts', 'first_ts')} AS purchase_span FROM base))"""


@register("c04_ltv_features", with_views(_ltv_feats_sql(T), "tx", extra={"base": customer_base(T)}))
def c04(spark, sf):
    """C4 LTV features (12 aggregates, 9 guarded ratios)."""
    return C.ltv_features(D.transactions(spark, sf, dims=False), AS_OF, 365)


_CUT = "(SELECT max(ts) - INTERVAL 90 DAY FROM tx)"


@register("c04b_ltv_target", with_views(f"""
SELECT h.customer_id, COALESCE(CAST(f.v AS DOUBLE), 0.0) AS future_value
FROM (SELECT DISTINCT customer_id FROM tx WHERE ts <= {_CUT} AND customer_id IS NOT NULL) h
LEFT JOIN (SELECT customer_id, SUM(CAST(total_price AS DECIMAL(18,2))) AS v FROM tx WHERE ts > {_CUT}
           GROUP BY customer_id) f ON h.customer_id = f.customer_id""", "tx"))
def c04b(spark, sf):
    """C4b LTV target: spend after a 90-day hold-out cut."""
    tx = D.transactions(spark, sf, dims=False)
    cut = C.ltv_cut(tx, 90).collect()[0]["_cut"]
    return C.ltv_target(tx, cut)


@register("c04c_ltv_training", with_views(f"""
SELECT f.*, t.future_value FROM ({_ltv_feats_sql('(SELECT c FROM cut)')}) f JOIN (
  SELECT h.customer_id, COALESCE(CAST(f.v AS DOUBLE), 0.0) AS future_value
  FROM (SELECT DISTINCT customer_id FROM tx WHERE ts <= (SELECT c FROM cut) AND customer_id IS NOT NULL) h
  LEFT JOIN (SELECT customer_id, SUM(CAST(total_price AS DECIMAL(18,2))) AS v FROM tx WHERE ts > (SELECT c FROM cut)
             GROUP BY customer_id) f ON h.customer_id = f.customer_id) t ON f.customer_id = t.customer_id""",
                                          "tx", extra={"cut": "SELECT max(ts) - INTERVAL 90 DAY AS c FROM tx",
                                                       "base": customer_base("x").replace(
                                                           "FROM tx WHERE", "FROM tx WHERE ts <= (SELECT c FROM cut) AND")}))
def c04c(spark, sf):
    """C4c LTV training table: history features joined to the hold-out target."""
    return C.ltv_training(D.transactions(spark, sf, dims=False), 90, 365)


_SIMPLE = f"""SELECT customer_id, avg_order_value, tenure_months, total_spent, purchase_frequency,
  avg_order_value * purchase_frequency * 24.0 AS simple_ltv, total_spent AS historical_ltv
FROM (SELECT customer_id, CAST(s AS DOUBLE) / CAST(n AS DOUBLE) AS avg_order_value, tm AS tenure_months,
        CAST(s AS DOUBLE) AS total_spent, n / tm AS purchase_frequency
      FROM (SELECT customer_id, SUM(CAST(total_price AS DECIMAL(18,2))) AS s, COUNT(*) AS n,
              greatest({floor_days('max(ts)', 'min(ts)')} / 30.0, 1.0) AS tm
            FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id))"""


@register("c04g_simple_ltv", with_views(f"""
SELECT s.*, ['Low', 'Below Average', 'Average', 'Above Average', 'High'][{value_bin('simple_ltv', 'e', 5)}] AS ltv_segment
FROM s, (SELECT quantile_cont(simple_ltv, {qfrac(5)}) AS e FROM s)""", "tx", extra={"s": _SIMPLE}))
def c04g(spark, sf):
    """C4g simple LTV (24 months) with five value bands."""
    return C.simple_ltv(D.transactions(spark, sf, dims=False), 24)


@register("c04f_ltv_distribution", with_views(f"""
SELECT COUNT(*) AS count, round_even(CAST(SUM(CAST(simple_ltv AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 6) AS mean,
  round_even(quantile_cont(simple_ltv, 0.5), 6) AS median,
  round_even({std_sql('SUM(CAST(simple_ltv AS DECIMAL(18,2)))',
                      'SUM(CAST(CAST(CAST(simple_ltv AS DECIMAL(18,2)) AS DECIMAL(38,2)) * CAST(CAST(simple_ltv AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS DECIMAL(38,4)))',
                      'COUNT(*)')}, 6) AS std,
  min(simple_ltv) AS min, max(simple_ltv) AS max,
  round_even(quantile_cont(simple_ltv, 0.25), 6) AS p25, round_even(quantile_cont(simple_ltv, 0.5), 6) AS p50,
  round_even(quantile_cont(simple_ltv, 0.75), 6) AS p75, round_even(quantile_cont(simple_ltv, 0.9), 6) AS p90,
  round_even(quantile_cont(simple_ltv, 0.95), 6) AS p95,
  CAST(SUM(CAST(simple_ltv AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM s""", "tx", extra={"s": _SIMPLE}))
def c04f(spark, sf):
    """C4f distribution summary of simple LTV."""
    return C.ltv_distribution(C.simple_ltv(D.transactions(spark, sf, dims=False), 24), "simple_ltv")


@register("c04h_value_rates", with_views(f"""
SELECT customer_id, CAST(s AS DOUBLE) AS historical_ltv, CAST(s AS DOUBLE) / CAST(frequency AS DOUBLE) AS aov,
  frequency, span AS tenure_days, frequency / CAST(span AS DOUBLE) AS frequency_rate
FROM (SELECT customer_id, SUM(CAST(total_price AS DECIMAL(18,2))) AS s, COUNT(DISTINCT order_id) AS frequency,
        {floor_days('max(ts)', 'min(ts)')} + 1 AS span FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id)""",
                                         "tx"))
def c04h(spark, sf):
    """C4h historical LTV, AOV per order and purchase rate."""
    return C.value_rates(D.transactions(spark, sf, dims=False))


SEGMENT_SQL = f"""
SELECT *, CASE WHEN tenure_days > 0 THEN CAST(total_transactions AS DOUBLE) / (tenure_days / 30.0)
                 ELSE CAST(total_transactions AS DOUBLE) END AS orders_per_month,
  CASE WHEN tenure_days > 0 THEN total_spent / (tenure_days / 30.0) ELSE total_spent END AS spend_per_month,
  CASE WHEN avg_order_value > 0 THEN std_order_value / avg_order_value ELSE 0.0 END AS order_value_cv,
  CASE WHEN total_items > 0 THEN CAST(unique_items_ordered AS DOUBLE) / CAST(total_items AS DOUBLE) ELSE 0.0 END
    AS item_diversity
FROM (SELECT {_BASE_FEATS} FROM base)"""


@register("c05_segment_features", with_views(SEGMENT_SQL, "tx", extra={"base": customer_base(T)}))
def c05(spark, sf):
    """C5 segmentation features."""
    return C.segment_features(D.transactions(spark, sf, dims=False), AS_OF)


@register("c05g_rfm_ratios", with_views("""
SELECT *, CASE WHEN frequency > 0 THEN monetary / CAST(frequency AS DOUBLE) END AS avg_transaction_value,
  CAST(frequency AS DOUBLE) / (recency + 1) AS purchase_intensity FROM rfm""", "tx", extra={"rfm": _RFM}))
def c05g(spark, sf):
    """C5g RFM ratio features."""
    return C.rfm_ratios(C.rfm_metrics(D.transactions(spark, sf, dims=False), AS_OF))


@register("a28_churn_by_value_band", with_views(f"""
SELECT ['Low', 'Medium', 'High'][{value_bin('monetary', 'e', 3)}] AS segment, COUNT(*) AS n_customers,
  round_even(avg(CAST(recency > 60 AS INTEGER)), 6) AS churn_rate
FROM rfm, (SELECT quantile_cont(monetary, {qfrac(3)}) AS e FROM rfm) GROUP BY 1""", "tx", extra={"rfm": _RFM}))
def a28(spark, sf):
    """A28 churn rate by spend tercile."""
    return C.churn_by_value_band(C.rfm_metrics(D.transactions(spark, sf, dims=False), AS_OF), 3, 60)
