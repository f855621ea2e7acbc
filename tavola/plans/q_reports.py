"""Report queries (A*) over the driver tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeutil import period_start, ts_lit
from ..operators import reports as R
from ..sources import driver as D
from .registry import AS_OF, register
from .sqlviews import cents_avg, money_sum, round_even, with_views

T = f"TIMESTAMP '{AS_OF}'"


def _days_ago(days):
    return ts_lit(AS_OF) - F.expr(f"INTERVAL {int(days)} DAYS")


def _done(spark, sf, since):
    """Completed orders of the period, filtered on the raw columns."""
    return D.orders(spark, sf, "completed", since)


# Start of each period in SQL.
_START = {"today": f"date_trunc('day', {T})", "week": f"{T} - INTERVAL 7 DAY", "month": f"{T} - INTERVAL 30 DAY",
          "year": f"{T} - INTERVAL 365 DAY"}


def _a1_sql(period: str) -> str:
    since = f"created_at >= {_START[period]}"
    return with_views(f"""
SELECT CAST(SUM(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
       COUNT(*) AS total_orders,
       (SELECT COUNT(*) FROM cu) AS total_customers,
       round_even(CAST(SUM(CAST(total AS DECIMAL(18,2))) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 2) AS avg_order_value,
       CAST(COALESCE(SUM(CAST(total AS DECIMAL(18,2))) FILTER (WHERE {since}), 0) AS DOUBLE) AS period_revenue,
       COUNT(*) FILTER (WHERE {since}) AS period_orders,
       (SELECT COUNT(*) FILTER (WHERE is_active) FROM mi) AS menu_items_count,
       '{period}' AS period
FROM ord""", "ord", "cu", "mi")


def _register_a01(period: str) -> None:
    @register(f"a01_dashboard_{period}", _a1_sql(period))
    def a01(spark, sf):
        """A1 dashboard of a period."""
        return R.dashboard(D.orders(spark, sf), D.customers(spark, sf), D.menu_items(spark, sf), period, AS_OF)


for _period in _START:
    _register_a01(_period)


def _a2_sql(period: str) -> str:
    ctes = {
        "done": f"SELECT id, total FROM ord WHERE status = 'completed' AND completed_at >= {_START[period]}",
        "sold": ("SELECT oi.quantity, oi.menu_item_id, mi.name, mi.subcategory FROM oi "
                 "JOIN mi ON oi.menu_item_id = mi.id WHERE oi.order_id IN (SELECT id FROM done)"),
        "head": "SELECT COALESCE(SUM(CAST(total AS DECIMAL(18,2))), 0) AS rev, COUNT(*) AS n FROM done",
    }
    return with_views(f"""
SELECT '{period}' AS period, CAST(rev AS DOUBLE) AS total_revenue, n AS total_orders,
       (SELECT CAST(COALESCE(SUM(quantity), 0) AS BIGINT) FROM sold) AS total_items_sold,
       {cents_avg("rev", "n")} AS avg_order_value,
       CASE WHEN n > 0 THEN 'Category ' || (SELECT subcategory FROM (SELECT subcategory, SUM(quantity) q FROM sold
            GROUP BY subcategory) ORDER BY q DESC, subcategory LIMIT 1) ELSE 'N/A' END AS top_category,
       CASE WHEN n > 0 THEN (SELECT name FROM (SELECT menu_item_id, name, SUM(quantity) q FROM sold
            GROUP BY menu_item_id, name) ORDER BY q DESC, menu_item_id LIMIT 1) ELSE 'N/A' END AS top_item
FROM head""", "ord", "oi", "mi", extra=ctes)


def _register_a02(period: str) -> None:
    @register(f"a02_sales_summary_{period}", _a2_sql(period))
    def a02(spark, sf):
        """A2 sales summary of a period."""
        return R.sales_summary(_done(spark, sf, period_start(period, AS_OF)), D.order_items(spark, sf),
                               D.menu_items(spark, sf), period, AS_OF)


for _period in _START:
    _register_a02(_period)


@register("a03_dashboard_top_items", with_views("""
SELECT id, name, category_id, order_count, total_revenue FROM (
  SELECT oi.menu_item_id AS id, mi.name, mi.category AS category_id,
         CAST(SUM(oi.quantity) AS BIGINT) AS order_count,
         CAST(SUM(CAST(oi.total_price AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
  FROM oi JOIN mi ON oi.menu_item_id = mi.id GROUP BY oi.menu_item_id, mi.name, mi.category)
ORDER BY order_count DESC, id LIMIT 10""", "oi", "mi"))
def a03(spark, sf):
    """A3/A3b dashboard top-10 items by quantity (fallback to unsold items)."""
    return R.dashboard_top_items(D.menu_items(spark, sf), D.order_items(spark, sf), 10)


@register("a04_daily_sales", with_views(f"""
SELECT date, CAST(rev AS DOUBLE) AS total_revenue, n AS total_orders, items AS total_items_sold,
       {cents_avg('rev', 'n')} AS avg_order_value FROM d""", "ord", "oi", extra={
    "per": "SELECT order_id, SUM(quantity) AS q FROM oi GROUP BY order_id",
    "d": f"""SELECT CAST(completed_at AS DATE) AS date, SUM(CAST(total AS DECIMAL(18,2))) AS rev, COUNT(*) AS n,
             CAST(COALESCE(SUM(per.q), 0) AS BIGINT) AS items
      FROM ord LEFT JOIN per ON ord.id = per.order_id
      WHERE status = 'completed' AND completed_at >= {T} - INTERVAL 365 DAY
      GROUP BY CAST(completed_at AS DATE)"""}))
def a04(spark, sf):
    """A4 daily sales for the last 365 days."""
    return R.daily_sales(_done(spark, sf, _days_ago(365)), D.order_items(spark, sf), 365, AS_OF)


def _period_items_sql(days: int, extra_cols: str = "") -> str:
    return (f"SELECT oi.menu_item_id AS item_id, mi.name AS item_name{extra_cols}, "
            "CAST(SUM(oi.quantity) AS BIGINT) AS quantity_sold, "
            "CAST(SUM(CAST(oi.total_price AS DECIMAL(18,2))) AS DOUBLE) AS revenue "
            "FROM oi JOIN mi ON oi.menu_item_id = mi.id WHERE oi.order_id IN (SELECT id FROM ord "
            f"WHERE status = 'completed' AND completed_at >= {T} - INTERVAL {days} DAY) "
            f"GROUP BY oi.menu_item_id, mi.name{extra_cols.replace(' AS sub', '')}")


@register("a05_public_dashboard", with_views(f"""
SELECT CAST(COALESCE(SUM(CAST(total AS DECIMAL(18,2))) FILTER (WHERE status = 'completed'), 0) AS DOUBLE) AS total_revenue,
       COUNT(*) FILTER (WHERE status = 'completed') AS total_orders,
       COUNT(*) FILTER (WHERE status = 'completed' AND created_at >= date_trunc('day', {T})) AS today_orders,
       CAST(COALESCE(SUM(CAST(total AS DECIMAL(18,2))) FILTER (WHERE status = 'completed'
            AND completed_at >= {T} - INTERVAL 7 DAY), 0) AS DOUBLE) AS week_revenue,
       (SELECT COUNT(*) FILTER (WHERE is_active) FROM mi) AS menu_items_count,
       CASE WHEN COUNT(*) FILTER (WHERE status = 'completed') > 0 THEN
         CAST(COALESCE(SUM(CAST(total AS DECIMAL(18,2))) FILTER (WHERE status = 'completed'), 0) AS DOUBLE)
         / CAST(COUNT(*) FILTER (WHERE status = 'completed') AS DOUBLE) ELSE 0.0 END AS avg_order_value
FROM ord""", "ord", "mi"))
def a05(spark, sf):
    """A5 public dashboard (completed orders only)."""
    return R.public_dashboard(D.orders(spark, sf), D.menu_items(spark, sf), AS_OF)


@register("a05_recent_orders", with_views("""
SELECT id, total, status, created_at FROM ord ORDER BY created_at DESC, id DESC LIMIT 5""", "ord"))
def a05r(spark, sf):
    """A5 five most recent orders."""
    return R.recent_orders(D.orders(spark, sf), 5)


@register("a06_top_selling", with_views(f"""
SELECT CAST(row_number() OVER (ORDER BY quantity_sold DESC, item_id) AS INTEGER) AS rank, * FROM (
{_period_items_sql(90)}) ORDER BY quantity_sold DESC, item_id LIMIT 10""", "ord", "oi", "mi"))
def a06(spark, sf):
    """A6 top-10 selling items of the last 90 days with rank."""
    return R.top_selling(D.menu_items(spark, sf), D.order_items(spark, sf), _done(spark, sf, _days_ago(90)), 90, 10, AS_OF)


@register("a07_sales_by_category", with_views(f"""
SELECT item_id, item_name, 'Subcategory ' || sub AS category, quantity_sold, revenue FROM (
{_period_items_sql(90, ', mi.subcategory AS sub')})""", "ord", "oi", "mi"))
def a07(spark, sf):
    """A7 item sales of the last 90 days within subcategory."""
    return R.sales_by_category(D.menu_items(spark, sf), D.order_items(spark, sf), _done(spark, sf, _days_ago(90)), 90, AS_OF)


@register("a08_daily_aggregates", with_views(f"""
SELECT date, total_revenue, total_orders, total_items_sold, unique_customers,
       round_even(total_revenue / total_orders, 2) AS avg_order_value,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, isodow(date) - 1 >= 5 AS is_weekend,
       CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year
FROM (SELECT CAST(ts AS DATE) AS date, {money_sum('total_price')} AS total_revenue,
             COUNT(DISTINCT order_id) AS total_orders, CAST(SUM(quantity) AS BIGINT) AS total_items_sold,
             COUNT(DISTINCT customer_id) AS unique_customers
      FROM tx GROUP BY CAST(ts AS DATE))""", "tx"))
def a08(spark, sf):
    """A8 daily aggregates with calendar flags."""
    return R.daily_aggregates(D.transactions(spark, sf, dims=False))


@register("a09_item_daily_sales", with_views(f"""
SELECT CAST(ts AS DATE) AS date, item_id, item_name, category, CAST(SUM(quantity) AS BIGINT) AS quantity_sold,
       {money_sum('total_price')} AS revenue, COUNT(DISTINCT order_id) AS num_orders
FROM tx GROUP BY CAST(ts AS DATE), item_id, item_name, category""", "tx"))
def a09(spark, sf):
    """A9 item x day sales."""
    return R.item_daily_sales(D.transactions(spark, sf))


_PER_ORDER = ("SELECT order_id, SUM(CAST(total_price AS DECIMAL(18,2))) AS v, SUM(quantity) AS q "
              "FROM tx GROUP BY order_id")


@register("a10_overall_metrics", with_views("""
SELECT CAST(COALESCE(SUM(v), 0) AS DOUBLE) AS total_revenue, COUNT(*) AS total_orders,
       round_even(CAST(SUM(v) AS DOUBLE) / COUNT(*), 6) AS avg_order_value,
       round_even(CAST(SUM(q) AS DOUBLE) / COUNT(*), 6) AS avg_items_per_order
FROM per""", "tx", extra={"per": _PER_ORDER}))
def a10(spark, sf):
    """A10 overall sales metrics."""
    return R.overall_metrics(D.transactions(spark, sf, dims=False))


@register("a11_order_value_distribution", with_views("""
SELECT CAST(CASE WHEN hi > lo THEN least(floor((CAST(v AS DOUBLE) - lo) / (hi - lo) * 10), 9) ELSE 0 END AS INTEGER) AS bucket,
       COUNT(*) AS n_orders, round_even(any_value(mean), 6) AS mean_value, round_even(any_value(median), 6) AS median_value
FROM per, (SELECT min(CAST(v AS DOUBLE)) lo, max(CAST(v AS DOUBLE)) hi, CAST(SUM(v) AS DOUBLE) / COUNT(*) AS mean,
                  quantile_cont(CAST(v AS DOUBLE), 0.5) AS median FROM per) s
GROUP BY 1""", "tx", extra={"per": _PER_ORDER}))
def a11(spark, sf):
    """A11 order value histogram (10 buckets), mean and median."""
    return R.order_value_distribution(D.transactions(spark, sf, dims=False), 10)


_CSTATS = f"""SELECT customer_id, COUNT(DISTINCT order_id) AS total_orders, {money_sum('total_price')} AS total_spent,
       min(ts) AS first_order, max(ts) AS last_order, CAST(SUM(quantity) AS BIGINT) AS total_items
FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id"""


@register("a12_customer_stats", with_views("""
SELECT *, round_even(total_spent / total_orders, 6) AS avg_order_value FROM cs""", "tx", extra={"cs": _CSTATS}))
def a12(spark, sf):
    """A12 per-customer statistics."""
    return R.customer_stats(D.transactions(spark, sf, dims=False))


@register("a13_top_share", with_views("""
SELECT COUNT(*) AS n_customers, CAST(floor(COUNT(*) * 0.1) AS BIGINT) AS k,
       round_even(CAST(COALESCE(SUM(CAST(total_spent AS DECIMAL(18,2))) FILTER (WHERE r <= floor(n * 0.1)), 0) AS DOUBLE) * 100.0
                  / CAST(SUM(CAST(total_spent AS DECIMAL(18,2))) AS DOUBLE), 6) AS top_share_pct
FROM (SELECT total_spent, row_number() OVER (ORDER BY total_spent DESC, customer_id) AS r, COUNT(*) OVER () AS n FROM cs)""",
                                    "tx", extra={"cs": _CSTATS}))
def a13(spark, sf):
    """A13 revenue share of the top 10 % of customers."""
    return R.top_share(R.customer_stats(D.transactions(spark, sf, dims=False)), 0.1)


@register("a14_frequency_shares", with_views("""
SELECT COUNT(*) AS n_customers,
       round_even(COUNT(*) FILTER (WHERE total_orders = 1) * 100.0 / COUNT(*), 6) AS one_time_pct,
       round_even(COUNT(*) FILTER (WHERE total_orders >= 5) * 100.0 / COUNT(*), 6) AS five_plus_pct
FROM cs""", "tx", extra={"cs": _CSTATS}))
def a14(spark, sf):
    """A14 one-time and 5+ customer shares."""
    return R.frequency_shares(R.customer_stats(D.transactions(spark, sf, dims=False)))


_ISALES = f"""SELECT s.*, mi.name, mi.category, mi.price FROM (
  SELECT item_id, CAST(SUM(quantity) AS BIGINT) AS qty_sold, {money_sum('total_price')} AS revenue,
         COUNT(DISTINCT order_id) AS order_count FROM tx GROUP BY item_id) s JOIN mi ON s.item_id = mi.id"""


@register("a15_top_items_by_revenue", with_views("""
SELECT * FROM isales ORDER BY revenue DESC, item_id LIMIT 10""", "tx", "mi", extra={"isales": _ISALES}))
def a15(spark, sf):
    """A15 item sales joined with the menu, top 10 by revenue."""
    return R.top_items(R.item_sales(D.transactions(spark, sf), D.menu_items(spark, sf)), "revenue", 10)


@register("a15_top_items_by_quantity", with_views("""
SELECT * FROM isales ORDER BY qty_sold DESC, item_id LIMIT 15""", "tx", "mi", extra={"isales": _ISALES}))
def a15q(spark, sf):
    """A15 item sales joined with the menu, top 15 by quantity."""
    return R.top_items(R.item_sales(D.transactions(spark, sf), D.menu_items(spark, sf)), "qty_sold", 15)


@register("a16_category_sales", with_views("""
SELECT category, qty_sold, CAST(rev AS DOUBLE) AS revenue, order_count,
       round_even(CAST(rev AS DOUBLE) * 100.0 / CAST(SUM(rev) OVER () AS DOUBLE), 6) AS revenue_share_pct
FROM (SELECT category, CAST(SUM(qty_sold) AS BIGINT) AS qty_sold, SUM(CAST(revenue AS DECIMAL(18,2))) AS rev,
             CAST(SUM(order_count) AS BIGINT) AS order_count FROM isales GROUP BY category)""",
                                          "tx", "mi", extra={"isales": _ISALES}))
def a16(spark, sf):
    """A16 category roll-up and revenue share."""
    return R.category_sales(R.item_sales(D.transactions(spark, sf), D.menu_items(spark, sf)))


@register("a17_sales_by_hour", with_views(f"""
SELECT CAST(hour(ts) AS INTEGER) AS hour, {money_sum('value')} AS revenue FROM act GROUP BY 1""", "act"))
def a17h(spark, sf):
    """A17 event value by hour of day."""
    return R.sales_by(D.activity(spark, sf), "hour", value="value", order_key=None)


@register("a17_sales_by_weekday", with_views(f"""
SELECT CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, {money_sum('value')} AS revenue FROM act GROUP BY 1""", "act"))
def a17d(spark, sf):
    """A17 event value by weekday (Monday = 0)."""
    return R.sales_by(D.activity(spark, sf), "day_of_week", value="value", order_key=None)


@register("a17_sales_by_month", with_views(f"""
SELECT CAST(month(ts) AS INTEGER) AS month, {money_sum('total_price')} AS revenue,
       COUNT(DISTINCT order_id) AS orders FROM tx GROUP BY 1""", "tx"))
def a17m(spark, sf):
    """A17 revenue and orders by month."""
    return R.sales_by(D.transactions(spark, sf), "month")


@register("a17_sales_by_weekend", with_views(f"""
SELECT isodow(ts) - 1 >= 5 AS is_weekend, {money_sum('total_price')} AS revenue,
       COUNT(DISTINCT order_id) AS orders FROM tx GROUP BY 1""", "tx"))
def a17w(spark, sf):
    """A17 revenue and orders, weekday vs weekend."""
    return R.sales_by(D.transactions(spark, sf), "is_weekend")


_HOURS = ",\n".join(
    f"CAST(SUM(CAST(value AS DECIMAL(18,2))) FILTER (WHERE hour(ts) = {h}) AS DOUBLE) AS \"{h}\"" for h in range(24))


@register("a18_weekday_hour_matrix", with_views(f"""
SELECT dayname(ts) AS day_name,
{_HOURS}
FROM act GROUP BY dayname(ts)""", "act"))
def a18(spark, sf):
    """A18 weekday x hour value matrix (pivot over 24 known hours)."""
    return R.weekday_hour_matrix(D.activity(spark, sf), value="value")


@register("a19_key_insights", with_views("""
SELECT (SELECT CAST(h AS INTEGER) FROM (SELECT hour(ts) h, SUM(CAST(total_price AS DECIMAL(18,2))) r FROM tx GROUP BY 1)
          ORDER BY r DESC, h LIMIT 1) AS peak_hour,
       (SELECT d FROM (SELECT dayname(ts) d, SUM(CAST(total_price AS DECIMAL(18,2))) r FROM tx GROUP BY 1)
          ORDER BY r DESC, d LIMIT 1) AS best_day,
       (SELECT category FROM (SELECT category, SUM(CAST(revenue AS DECIMAL(18,2))) r FROM isales GROUP BY 1)
          ORDER BY r DESC, category LIMIT 1) AS top_category,
       (SELECT name FROM isales ORDER BY CAST(revenue AS DECIMAL(18,2)) DESC, item_id LIMIT 1) AS top_item""",
                                        "tx", "mi", extra={"isales": _ISALES}))
def a19(spark, sf):
    """A19 peak hour, best day, top category, best item."""
    return R.key_insights(D.transactions(spark, sf), D.menu_items(spark, sf))


@register("a20_peak_hours", with_views("""
SELECT COUNT(*) AS n_peak_hours, min(hour) AS band_start, max(hour) AS band_end, list_sort(list(hour)) AS hours
FROM (SELECT CAST(hour(ts) AS INTEGER) AS hour, SUM(CAST(value AS DECIMAL(18,2))) AS r FROM act GROUP BY 1)
WHERE CAST(r AS DOUBLE) / CAST((SELECT SUM(CAST(value AS DECIMAL(18,2))) FROM act) AS DOUBLE) >= 0.0425""", "act"))
def a20(spark, sf):
    """A20 peak-hour band: hours holding at least 4.25 % of event value."""
    return R.peak_hours(D.activity(spark, sf), 0.0425)


@register("a21_weekday_profile", with_views(f"""
SELECT CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, round_even(avg(total_orders), 6) AS mean,
       round_even(stddev_samp(total_orders), 6) AS std, COUNT(*) AS n_days
FROM (SELECT CAST(ts AS DATE) AS date, COUNT(DISTINCT order_id) AS total_orders FROM tx GROUP BY 1) GROUP BY 1""", "tx"))
def a21(spark, sf):
    """A21 weekday mean/std of daily distinct orders."""
    return R.weekday_profile(R.daily_aggregates(D.transactions(spark, sf, dims=False)))


@register("a22_tier_counts", with_views("""
SELECT loyalty_tier, COUNT(*) AS n_customers FROM cu GROUP BY 1""", "cu"))
def a22(spark, sf):
    """A22 loyalty tier counts."""
    return R.tier_counts(D.customers(spark, sf))


@register("a23_menu_summary", with_views("""
SELECT category, COUNT(*) AS n_items, (SELECT COUNT(*) FROM mi) AS total_items,
       (SELECT round_even(avg(price), 6) FROM mi) AS avg_price FROM mi GROUP BY category""", "mi"))
def a23(spark, sf):
    """A23 menu summary per category."""
    return R.menu_summary(D.menu_items(spark, sf))


@register("a24_price_overview", with_views("""
SELECT id AS item_id, name, price, s.* FROM mi,
  (SELECT round_even(avg(price), 6) AS avg_price, min(price) AS min_price, max(price) AS max_price FROM mi) s
ORDER BY price, id LIMIT 3""", "mi"))
def a24(spark, sf):
    """A24 price overview with the three cheapest items."""
    return R.price_overview(D.menu_items(spark, sf), 3)


@register("a25_favourite_items", with_views("""
SELECT * FROM (SELECT customer_id, item_id, quantity,
       CAST(row_number() OVER (PARTITION BY customer_id ORDER BY quantity DESC, item_id) AS INTEGER) AS rank
  FROM (SELECT customer_id, item_id, CAST(SUM(quantity) AS BIGINT) AS quantity FROM tx
        WHERE customer_id IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 3""", "tx"))
def a25(spark, sf):
    """A25 each customer's three favourite items."""
    return R.favourite_items(D.transactions(spark, sf), 3)


@register("a26_one_per_category", with_views("""
SELECT category, arg_min(id, (price, id)) AS item_id FROM mi WHERE is_active GROUP BY category""", "mi"))
def a26(spark, sf):
    """A26 cheapest active item per category (cold-start diversity)."""
    return R.one_per_category(D.menu_items(spark, sf))


@register("a27_cohort_revenue", with_views(f"""
SELECT CAST(f.cohort_month AS DATE) AS cohort_month, COUNT(DISTINCT tx.customer_id) AS n_customers,
       COUNT(DISTINCT order_id) AS n_orders, {money_sum('total_price')} AS revenue
FROM tx JOIN (SELECT customer_id, date_trunc('month', min(ts)) AS cohort_month FROM tx
              WHERE customer_id IS NOT NULL GROUP BY 1) f ON tx.customer_id = f.customer_id
GROUP BY 1""", "tx"))
def a27(spark, sf):
    """A27 revenue by first-purchase month cohort."""
    return R.cohort_revenue(D.transactions(spark, sf))


def _trend_sql(days: int) -> str:
    cur = f"created_at >= {T} - INTERVAL {days} DAY AND created_at < {T}"
    prev = f"created_at >= {T} - INTERVAL {2 * days} DAY AND created_at < {T} - INTERVAL {days} DAY"
    return with_views(f"""
SELECT c AS revenue_current, p AS revenue_previous,
       CASE WHEN p > 0 THEN round_even((c - p) * 100.0 / p, 6) END AS revenue_change_pct,
       oc AS orders_current, op AS orders_previous,
       CASE WHEN op > 0 THEN round_even(CAST(oc - op AS DOUBLE) * 100.0 / CAST(op AS DOUBLE), 6) END AS orders_change_pct
FROM (SELECT CAST(COALESCE(SUM(CAST(total AS DECIMAL(18,2))) FILTER (WHERE {cur}), 0) AS DOUBLE) AS c,
             CAST(COALESCE(SUM(CAST(total AS DECIMAL(18,2))) FILTER (WHERE {prev}), 0) AS DOUBLE) AS p,
             COUNT(*) FILTER (WHERE {cur}) AS oc, COUNT(*) FILTER (WHERE {prev}) AS op FROM ord)""", "ord")


def _register_a29(period: str, days: int) -> None:
    @register(f"a29_period_trend_{period}", _trend_sql(days))
    def a29(spark, sf):
        """A29 a period against the one before."""
        return R.period_trend(D.orders(spark, sf), period, AS_OF)


for _period, _length in (("week", 7), ("month", 30), ("year", 365)):
    _register_a29(_period, _length)
