"""Reporting operators.

Inputs use the application column names of ``sources/driver.py``:

* ``orders``: id, customer_id, status, total, created_at, completed_at
* ``lines`` (order items): order_id, menu_item_id, quantity, total_price
* ``items`` (menu): id, name, category, subcategory, price, is_active
* ``tx`` (line-level sales): order_id, customer_id, item_id, item_name,
  category, quantity, total_price, ts

Each report is one DataFrame plan.  Several reference endpoints issue one
query per metric (or per day); here the metrics are fused into conditional
aggregates over a single scan, and line totals are pre-aggregated per order
before they meet the orders table (one shuffle on the order key).
Small one-row frames (totals, edges) are cross-joined with a broadcast: they
have exactly one row whatever the input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import exact_quantiles
from ..functions.rounding import cents_avg, money, money_sum, round_even, safe_div
from ..functions.scalars import scalar_struct, scalar_value
from ..functions.timeutil import day_name, day_of_week, period_start, ts_lit

# Weekday names in calendar order (pandas day_name()).
DOW_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _dec_sum(col) -> Column:
    return F.coalesce(F.sum(money(col)), F.lit(0).cast("decimal(28,2)"))


def _count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


def _completed_since(orders: DataFrame, start: Column | None) -> DataFrame:
    cond = F.col("status") == "completed"
    if start is not None:
        cond = cond & (F.col("completed_at") >= start)
    return orders.where(cond)


# --------------------------------------------------------------------------- A1
def dashboard(orders: DataFrame, customers: DataFrame, items: DataFrame,
              period: str, as_of) -> DataFrame:
    """A1: all-time and period revenue/orders (all statuses, D10), customers,
    active items and AOV (0 when there are no orders).  One row."""
    start = period_start(period, as_of)
    o = orders.agg(_dec_sum("total").alias("_rev"),
                   F.sum(F.when(F.col("created_at") >= start, money("total"))).alias("_prev"),
                   F.count(F.lit(1)).alias("total_orders"),
                   _count_if(F.col("created_at") >= start).alias("period_orders"))
    c = scalar_value(customers.agg(F.count(F.lit(1)).alias("total_customers")))
    m = scalar_value(items.agg(_count_if(F.col("is_active")).alias("menu_items_count")))
    return (o.select("*", c.alias("total_customers"), m.alias("menu_items_count"))
            .select(F.col("_rev").cast("double").alias("total_revenue"),
                    "total_orders", "total_customers",
                    round_even(safe_div(F.col("_rev").cast("double"), "total_orders", 0.0), 2).alias("avg_order_value"),
                    F.coalesce(F.col("_prev"), F.lit(0)).cast("double").alias("period_revenue"),
                    "period_orders", "menu_items_count",
                    F.lit(period).alias("period")))


# --------------------------------------------------------------------------- A2
def sales_summary(orders: DataFrame, lines: DataFrame, items: DataFrame,
                  period: str, as_of) -> DataFrame:
    """A2: completed orders in the period; items through a semi join; top
    category (subcategory label) and top item by quantity; 'N/A' when empty."""
    done = _completed_since(orders, period_start(period, as_of)).select("id", "total")
    head = done.agg(_dec_sum("total").alias("_rev"), F.count(F.lit(1)).alias("total_orders"))
    sold = (lines.join(done.select(F.col("id").alias("order_id")), "order_id", "left_semi")
            .join(items.select(F.col("id").alias("menu_item_id"), "name", "subcategory"), "menu_item_id"))
    qty = scalar_value(sold.agg(F.coalesce(F.sum("quantity"), F.lit(0)).cast("long")))
    by_sub = sold.groupBy("subcategory").agg(F.sum("quantity").alias("q"))
    # deterministic tie-break: larger quantity, then smaller key
    top_sub = scalar_value(by_sub.agg(F.min_by("subcategory", F.struct(F.negative("q"), "subcategory"))))
    by_item = sold.groupBy("menu_item_id", "name").agg(F.sum("quantity").alias("q"))
    top_item = scalar_value(by_item.agg(F.min_by("name", F.struct(F.negative("q"), "menu_item_id"))))
    return (head.select("*", qty.alias("total_items_sold"), top_sub.alias("_ts"), top_item.alias("_ti"))
            .select(F.lit(period).alias("period"),
                    F.col("_rev").cast("double").alias("total_revenue"),
                    "total_orders", "total_items_sold",
                    cents_avg("_rev", "total_orders").alias("avg_order_value"),
                    F.when(F.col("total_orders") > 0, F.concat(F.lit("Category "), F.col("_ts")))
                    .otherwise("N/A").alias("top_category"),
                    F.when(F.col("total_orders") > 0, F.col("_ti")).otherwise("N/A").alias("top_item")))


# --------------------------------------------------------------------------- A3
def dashboard_top_items(items: DataFrame, lines: DataFrame, k: int = 10,
                        include_unsold: bool = True) -> DataFrame:
    """Top-k items by quantity over all lines; when nothing has been
    sold at all, the first k active items with zero counts."""
    sold = (lines.groupBy("menu_item_id")
            .agg(F.sum("quantity").alias("order_count"), _dec_sum("total_price").alias("_rev"))
            .join(items.select(F.col("id").alias("menu_item_id"), "name", "category"), "menu_item_id")
            .select(F.col("menu_item_id").alias("id"), "name", F.col("category").alias("category_id"),
                    F.col("order_count").cast("long").alias("order_count"),
                    F.col("_rev").cast("double").alias("total_revenue")))
    top = sold.orderBy(F.desc("order_count"), F.asc("id")).limit(k)
    if not include_unsold:
        return top
    # the fallback rows survive only when no line exists at all
    any_line = lines.limit(1).exists()
    fallback = (items.where(F.col("is_active") & ~any_line)
                .select("id", "name", F.col("category").alias("category_id"),
                        F.lit(0).cast("long").alias("order_count"),
                        F.lit(0.0).alias("total_revenue"))
                .orderBy("id").limit(k))
    return top.unionByName(fallback)


# --------------------------------------------------------------------------- A4
def daily_sales(orders: DataFrame, lines: DataFrame, days: int, as_of) -> DataFrame:
    """A4: per completed day: revenue, orders, items, AOV (half-even cents).
    Line quantities are summed per order first, then joined once (fixes D14)."""
    start = ts_lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    done = _completed_since(orders, start).select("id", "total", "completed_at")
    per_order = (lines.join(done.select(F.col("id").alias("order_id")), "order_id", "left_semi")
                 .groupBy("order_id").agg(F.sum("quantity").alias("_q")))
    joined = done.join(per_order, done.id == per_order.order_id, "left")
    return (joined.groupBy(F.to_date("completed_at").alias("date"))
            .agg(_dec_sum("total").alias("_rev"), F.count(F.lit(1)).alias("total_orders"),
                 F.coalesce(F.sum("_q"), F.lit(0)).cast("long").alias("total_items_sold"))
            .select("date", F.col("_rev").cast("double").alias("total_revenue"), "total_orders",
                    "total_items_sold", cents_avg("_rev", "total_orders").alias("avg_order_value")))


# --------------------------------------------------------------------------- A5
def public_dashboard(orders: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """A5: completed-only totals, today's orders, week revenue, AOV (float)."""
    now = ts_lit(as_of)
    today = F.date_trunc("day", now).cast("timestamp_ntz")
    week = now - F.expr("INTERVAL 7 DAYS")
    done = F.col("status") == "completed"
    o = orders.agg(F.sum(F.when(done, money("total"))).alias("_rev"),
                   _count_if(done).alias("total_orders"),
                   _count_if(done & (F.col("created_at") >= today)).alias("today_orders"),
                   F.sum(F.when(done & (F.col("completed_at") >= week), money("total"))).alias("_wk"))
    m = scalar_value(items.agg(_count_if(F.col("is_active")).alias("menu_items_count")))
    rev = F.coalesce(F.col("_rev"), F.lit(0)).cast("double")
    return (o.select("*", m.alias("menu_items_count"))
            .select(rev.alias("total_revenue"), "total_orders", "today_orders",
                    F.coalesce(F.col("_wk"), F.lit(0)).cast("double").alias("week_revenue"),
                    "menu_items_count", safe_div(rev, "total_orders", 0.0).alias("avg_order_value")))


def recent_orders(orders: DataFrame, k: int = 5) -> DataFrame:
    """A5: the k newest orders (ties: larger id first)."""
    return (orders.select("id", "total", "status", "created_at")
            .orderBy(F.desc("created_at"), F.desc("id")).limit(k))


# --------------------------------------------------------------------------- A6/A7
def _period_item_sales(items, lines, orders, days, as_of, extra=()):
    start = ts_lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    done = _completed_since(orders, start).select(F.col("id").alias("order_id"))
    sold = lines.join(done, "order_id", "left_semi")
    return (sold.groupBy("menu_item_id")
            .agg(F.sum("quantity").cast("long").alias("quantity_sold"), _dec_sum("total_price").alias("_rev"))
            .join(items.select(F.col("id").alias("menu_item_id"), "name", *extra), "menu_item_id")
            .withColumn("revenue", F.col("_rev").cast("double")).drop("_rev"))


def top_selling(items: DataFrame, lines: DataFrame, orders: DataFrame,
                days: int = 30, k: int = 10, as_of=None) -> DataFrame:
    """Top-k items by quantity in completed orders of the last ``days``."""
    agg = _period_item_sales(items, lines, orders, days, as_of)
    top = agg.orderBy(F.desc("quantity_sold"), F.asc("menu_item_id")).limit(k)
    # at most k rows: a window without partition is bounded here
    w = Window.orderBy(F.desc("quantity_sold"), F.asc("menu_item_id"))
    return top.select(F.row_number().over(w).alias("rank"), F.col("menu_item_id").alias("item_id"),
                      F.col("name").alias("item_name"), "quantity_sold", "revenue")


def sales_by_category(items: DataFrame, lines: DataFrame, orders: DataFrame,
                      days: int = 30, as_of=None) -> DataFrame:
    """Item sales labelled by subcategory, ordered by subcategory then quantity."""
    agg = _period_item_sales(items, lines, orders, days, as_of, extra=("subcategory",))
    return (agg.select(F.col("menu_item_id").alias("item_id"), F.col("name").alias("item_name"),
                       F.concat(F.lit("Subcategory "), F.col("subcategory")).alias("category"),
                       "quantity_sold", "revenue")
            .orderBy("category", F.desc("quantity_sold"), "item_id"))


# --------------------------------------------------------------------------- A8/A9
def daily_aggregates(tx: DataFrame) -> DataFrame:
    """Revenue, distinct orders, items, distinct customers, AOV, calendar."""
    # per order first, then days and customers apart: two distinct counts in one
    # aggregate would expand every line threefold
    per_order = (tx.groupBy(F.to_date("ts").alias("date"), "customer_id", "order_id")
                 .agg(_dec_sum("total_price").alias("_rev"), F.sum("quantity").alias("_q")))
    orders = per_order.groupBy("date").agg(
        F.sum("_rev").cast("double").alias("total_revenue"), F.countDistinct("order_id").alias("total_orders"),
        F.sum("_q").cast("long").alias("total_items_sold"))
    customers = (per_order.where(F.col("customer_id").isNotNull()).select("date", "customer_id").distinct()
                 .groupBy("date").agg(F.count(F.lit(1)).alias("unique_customers")))
    return (orders.join(customers, "date", "left").fillna(0, ["unique_customers"])
            .withColumn("avg_order_value", round_even(F.col("total_revenue") / F.col("total_orders"), 2))
            .withColumn("day_of_week", day_of_week("date"))
            .withColumn("is_weekend", F.col("day_of_week") >= 5)
            .withColumn("month", F.month("date"))
            .withColumn("year", F.year("date")))


def item_daily_sales(tx: DataFrame, item_cols=("item_id", "item_name", "category")) -> DataFrame:
    """Quantity, revenue and distinct orders per item and day."""
    return (tx.groupBy(F.to_date("ts").alias("date"), *item_cols)
            .agg(F.sum("quantity").cast("long").alias("quantity_sold"),
                 money_sum("total_price").alias("revenue"),
                 F.countDistinct("order_id").alias("num_orders")))


# --------------------------------------------------------------------------- A10-A14
def order_values(tx: DataFrame) -> DataFrame:
    """Per-order value and item count (the shared first level of A10/A11)."""
    return tx.groupBy("order_id").agg(F.sum(money("total_price")).alias("_v"),
                                      F.sum("quantity").alias("_q"))


def overall_metrics(tx: DataFrame) -> DataFrame:
    """A10: revenue, distinct orders, mean order value, mean items per order."""
    per = order_values(tx)
    return per.agg(F.coalesce(F.sum("_v"), F.lit(0)).cast("double").alias("total_revenue"),
                   F.count(F.lit(1)).alias("total_orders"),
                   round_even(F.sum("_v").cast("double") / F.count(F.lit(1)), 6).alias("avg_order_value"),
                   round_even(F.sum("_q").cast("double") / F.count(F.lit(1)), 6).alias("avg_items_per_order"))


def order_value_distribution(tx: DataFrame, bins: int = 10) -> DataFrame:
    """Histogram of order values in ``bins`` equal-width buckets between
    min and max, with overall mean (exact) and median on every row."""
    per = order_values(tx).select("order_id", F.col("_v").alias("_d"), F.col("_v").cast("double").alias("v"))
    med = scalar_value(exact_quantiles(per, "v", [0.5], key="order_id"))[0]
    s = scalar_struct(per.agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                              (F.sum("_d").cast("double") / F.count(F.lit(1))).alias("mean")).withColumn("median", med))
    lo, hi = s["lo"], s["hi"]
    b = (F.when(hi > lo, F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1)))
         .otherwise(0)).cast("int")
    return (per.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n_orders"))
            .select("bucket", "n_orders", round_even(s["mean"], 6).alias("mean_value"),
                    round_even(s["median"], 6).alias("median_value")))


def customer_stats(tx: DataFrame) -> DataFrame:
    """Per-customer distinct orders, spend, first/last, items, AOV."""
    return (tx.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
            .agg(F.countDistinct("order_id").alias("total_orders"),
                 money_sum("total_price").alias("total_spent"),
                 F.min("ts").alias("first_order"), F.max("ts").alias("last_order"),
                 F.sum("quantity").cast("long").alias("total_items"))
            .withColumn("avg_order_value", round_even(F.col("total_spent") / F.col("total_orders"), 6)))


def top_share(stats: DataFrame, pct: float = 0.1, col: str = "total_spent",
              key: str = "customer_id") -> DataFrame:
    """Share of ``col`` held by the top ``int(n*pct)`` rows (ties by key).

    Uses the distributed global rank, so no single-partition window; sums
    are exact decimals."""
    from ..functions.bins import global_rank
    ranked = global_rank(stats.select(key, col), [(col, False), (key, True)], "_r")
    s = scalar_struct(stats.agg(F.count(F.lit(1)).alias("_n"), F.sum(money(col)).alias("_tot")))
    k = F.floor(s["_n"] * F.lit(pct))
    top = F.coalesce(F.sum(F.when(F.col("_r") <= k, money(col))), F.lit(0).cast("decimal(28,2)"))
    return (ranked.agg(top.alias("_top"))
            .select(s["_n"].alias("n_customers"), k.cast("long").alias("k"), "_top", s["_tot"].alias("_tot"))
            .select("n_customers", "k",
                    round_even(safe_div(F.col("_top").cast("double") * 100.0,
                                        F.col("_tot").cast("double"), 0.0), 6).alias("top_share_pct")))


def frequency_shares(stats: DataFrame) -> DataFrame:
    """Percent of one-time customers and of customers with 5+ orders."""
    n = F.count(F.lit(1))
    return stats.agg(n.alias("n_customers"),
                     round_even(_count_if(F.col("total_orders") == 1) * 100.0 / n, 6).alias("one_time_pct"),
                     round_even(_count_if(F.col("total_orders") >= 5) * 100.0 / n, 6).alias("five_plus_pct"))


# --------------------------------------------------------------------------- A15-A20
def item_sales(tx: DataFrame, items: DataFrame) -> DataFrame:
    """Per item quantity, revenue, distinct orders, joined to the menu."""
    agg = (tx.groupBy("item_id")
           .agg(F.sum("quantity").cast("long").alias("qty_sold"), money_sum("total_price").alias("revenue"),
                F.countDistinct("order_id").alias("order_count")))
    return agg.join(items.select(F.col("id").alias("item_id"), "name", "category", "price"), "item_id")


def top_items(df: DataFrame, by: str, k: int, key: str = "item_id") -> DataFrame:
    """Top-k by ``by`` with a unique tie-break."""
    return df.orderBy(F.desc(by), F.asc(key)).limit(k)


def category_sales(item_sales_df: DataFrame) -> DataFrame:
    """Category roll-up and revenue share (percent)."""
    cat = (item_sales_df.groupBy("category")
           .agg(F.sum("qty_sold").cast("long").alias("qty_sold"),
                F.sum(money("revenue")).alias("_rev"),
                F.sum("order_count").cast("long").alias("order_count")))
    tot = scalar_value(cat.agg(F.sum("_rev").alias("_tot")))
    return (cat.withColumn("_tot", tot)
            .select("category", "qty_sold", F.col("_rev").cast("double").alias("revenue"), "order_count",
                    round_even(safe_div(F.col("_rev").cast("double") * 100.0, F.col("_tot").cast("double"), 0.0), 6)
                    .alias("revenue_share_pct")))


def sales_by(tx: DataFrame, unit: str, ts: str = "ts", value: str = "total_price",
             order_key: str | None = "order_id") -> DataFrame:
    """Revenue (and distinct orders) by hour, weekday, day name, month or weekend."""
    exprs = {"hour": F.hour(ts), "day_of_week": day_of_week(ts), "day_name": day_name(ts),
             "month": F.month(ts), "is_weekend": day_of_week(ts) >= 5}
    aggs = [money_sum(value).alias("revenue")]
    if order_key:
        aggs.append(F.countDistinct(order_key).alias("orders"))
    return tx.groupBy(exprs[unit].alias(unit)).agg(*aggs)


def weekday_hour_matrix(tx: DataFrame, ts: str = "ts", value: str = "total_price") -> DataFrame:
    """Weekday x hour revenue matrix; the 24 hour columns are listed up
    front so the pivot needs no extra pass to find them."""
    return (tx.withColumn("h", F.hour(ts)).groupBy(day_name(ts).alias("day_name"))
            .pivot("h", list(range(24))).agg(F.sum(money(value)).cast("double")))


def key_insights(tx: DataFrame, items: DataFrame, ts: str = "ts") -> DataFrame:
    """Peak hour, best weekday, top category, best item (argmax, ties by key)."""
    hourly = sales_by(tx, "hour", ts, order_key=None)
    dow = sales_by(tx, "day_name", ts, order_key=None)
    isales = item_sales(tx, items)
    cat = isales.groupBy("category").agg(F.sum(money("revenue")).alias("r"))
    one = lambda df, val, key: scalar_value(df.agg(F.min_by(val, F.struct(F.negative("r"), key))))
    return (tx.sparkSession.range(1)  # one row, also when nothing was sold
            .select(one(hourly.withColumnRenamed("revenue", "r"), "hour", "hour").alias("peak_hour"),
                    one(dow.withColumnRenamed("revenue", "r"), "day_name", "day_name").alias("best_day"),
                    one(cat, "category", "category").alias("top_category"),
                    one(isales.withColumnRenamed("revenue", "r"), "name", "item_id").alias("top_item")))


def peak_hours(tx: DataFrame, min_share: float = 0.12, ts: str = "ts", value: str = "value") -> DataFrame:
    """Hours whose share of the day's total is >= ``min_share``, and the
    band from the first to the last such hour."""
    h = tx.groupBy(F.hour(ts).alias("hour")).agg(F.sum(money(value)).alias("_r"))
    tot = scalar_value(h.agg(F.sum("_r").alias("_t")))
    share = h.withColumn("_s", F.col("_r").cast("double") / tot.cast("double"))
    peak = share.where(F.col("_s") >= min_share)
    return peak.agg(F.count(F.lit(1)).alias("n_peak_hours"), F.min("hour").alias("band_start"),
                    F.max("hour").alias("band_end"),
                    F.sort_array(F.collect_list("hour")).alias("hours"))


# --------------------------------------------------------------------------- A21-A30
def weekday_profile(daily: DataFrame, value: str = "total_orders", date: str = "date") -> DataFrame:
    """Mean and sample std of a daily series per weekday."""
    return (daily.groupBy(day_of_week(date).alias("day_of_week"))
            .agg(round_even(F.avg(value), 6).alias("mean"),
                 round_even(F.stddev_samp(value), 6).alias("std"),
                 F.count(F.lit(1)).alias("n_days")))


def tier_counts(customers: DataFrame) -> DataFrame:
    """Customers per loyalty tier."""
    return customers.groupBy("loyalty_tier").agg(F.count(F.lit(1)).alias("n_customers"))


def menu_summary(items: DataFrame) -> DataFrame:
    """Per category item count and the sorted item names, plus overall
    item count and mean price on every row."""
    s = scalar_struct(items.agg(F.count(F.lit(1)).alias("total_items"), round_even(F.avg("price"), 6).alias("avg_price")))
    cat = items.groupBy("category").agg(F.count(F.lit(1)).alias("n_items"))
    return cat.select("*", s["total_items"].alias("total_items"), s["avg_price"].alias("avg_price"))


def price_overview(items: DataFrame, k: int = 3) -> DataFrame:
    """mean/min/max price and the k cheapest items (ties by id)."""
    s = scalar_struct(items.agg(round_even(F.avg("price"), 6).alias("avg_price"), F.min("price").alias("min_price"),
                                F.max("price").alias("max_price")))
    cheap = items.orderBy("price", "id").limit(k).select(F.col("id").alias("item_id"), "name", "price")
    return cheap.select("*", *[s[c].alias(c) for c in ("avg_price", "min_price", "max_price")])


def favourite_items(tx: DataFrame, k: int = 5) -> DataFrame:
    """Each customer's k most-bought items (sum of quantity, ties by item)."""
    per = (tx.where(F.col("customer_id").isNotNull())
           .groupBy("customer_id", "item_id").agg(F.sum("quantity").cast("long").alias("quantity")))
    w = Window.partitionBy("customer_id").orderBy(F.desc("quantity"), F.asc("item_id"))
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def one_per_category(items: DataFrame, key: str = "id", by: str = "price") -> DataFrame:
    """One item per category for cold start: the first by (by, id)."""
    return (items.where("is_active").groupBy("category")
            .agg(F.min_by(F.col(key), F.struct(by, key)).alias("item_id")))


def cohort_revenue(tx: DataFrame) -> DataFrame:
    """Revenue, customers and orders by first-purchase month."""
    c = tx.where(F.col("customer_id").isNotNull())
    first = c.groupBy("customer_id").agg(F.date_trunc("month", F.min("ts")).alias("cohort_month"))
    return (c.join(first, "customer_id").groupBy(F.to_date("cohort_month").alias("cohort_month"))
            .agg(F.countDistinct("customer_id").alias("n_customers"),
                 F.countDistinct("order_id").alias("n_orders"),
                 money_sum("total_price").alias("revenue")))


def period_trend(orders: DataFrame, period: str, as_of) -> DataFrame:
    """Revenue and orders in this period vs the one before, % change."""
    days = {"week": 7, "month": 30, "year": 365}[period]
    now = ts_lit(as_of)
    s1 = now - F.expr(f"INTERVAL {days} DAYS")
    s0 = now - F.expr(f"INTERVAL {2 * days} DAYS")
    cur = (F.col("created_at") >= s1) & (F.col("created_at") < now)
    prev = (F.col("created_at") >= s0) & (F.col("created_at") < s1)
    agg = orders.agg(F.sum(F.when(cur, money("total"))).alias("_c"), F.sum(F.when(prev, money("total"))).alias("_p"),
                     _count_if(cur).alias("orders_current"), _count_if(prev).alias("orders_previous"))
    c = F.coalesce(F.col("_c"), F.lit(0)).cast("double")
    p = F.coalesce(F.col("_p"), F.lit(0)).cast("double")
    return agg.select(c.alias("revenue_current"), p.alias("revenue_previous"),
                      round_even(safe_div((c - p) * 100.0, p), 6).alias("revenue_change_pct"),
                      "orders_current", "orders_previous",
                      round_even(safe_div((F.col("orders_current") - F.col("orders_previous")) * 100.0,
                                          F.col("orders_previous")), 6).alias("orders_change_pct"))


def forecast_total(fc: DataFrame, value: str = "prediction", by: str | None = None) -> DataFrame:
    """Total of a forecast over its horizon (per series when keyed)."""
    g = fc.groupBy(by) if by else fc.groupBy()
    return g.agg(F.sum(value).alias("forecast_total"), F.count(F.lit(1)).alias("horizon_days"))
