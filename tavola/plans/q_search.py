"""Search, join and set queries (P*, J*, K*) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import customers as C
from ..operators import search as S
from ..sources import driver as D
from .registry import AS_OF, register
from .sqlviews import VIEWS, with_views

T = f"TIMESTAMP '{AS_OF}'"


@register("p01_search_orders", with_views("""
SELECT id, order_type, status, total, created_at, COALESCE(n, 0) AS items_count, cu.name AS customer_name
FROM ord LEFT JOIN (SELECT order_id, COUNT(*) AS n FROM oi GROUP BY 1) c ON ord.id = c.order_id
LEFT JOIN cu ON ord.customer_id = cu.customer_id
WHERE status = 'completed' AND created_at >= TIMESTAMP '2000-01-01' AND created_at <= TIMESTAMP '2001-08-01'
ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10""", "ord", "oi", "cu"))
def p01(spark, sf):
    """P1 completed orders in a date range, newest first, page 2 (offset 10)."""
    return S.search_orders(D.orders(spark, sf), D.order_items(spark, sf), D.customers(spark, sf),
                           status="completed", date_from="2000-01-01", date_to="2001-08-01", skip=10, limit=50)


@register("p01_search_orders_text", with_views("""
SELECT id, order_type, status, total, created_at, COALESCE(n, 0) AS items_count, cu.name AS customer_name
FROM ord LEFT JOIN (SELECT order_id, COUNT(*) AS n FROM oi GROUP BY 1) c ON ord.id = c.order_id
LEFT JOIN cu ON ord.customer_id = cu.customer_id
WHERE order_type = 'delivery' AND (contains(CAST(id AS VARCHAR), '00000012') OR contains(lower(cu.name), '00000012'))
ORDER BY created_at DESC, id DESC LIMIT 100""", "ord", "oi", "cu"))
def p01t(spark, sf):
    """P1 delivery orders matching an id / customer-name text."""
    return S.search_orders(D.orders(spark, sf), D.order_items(spark, sf), D.customers(spark, sf),
                           order_type="delivery", text="00000012", limit=100)


@register("p02_search_menu", with_views("""
SELECT *, concat_ws(' > ', COALESCE(category, 'Other'), COALESCE(subcategory, 'Other')) AS category_path FROM mi
WHERE is_active AND is_vegetarian AND (name ILIKE '%ring%' OR description ILIKE '%ring%')
ORDER BY name, id LIMIT 100""", "mi"))
def p02(spark, sf):
    """P2 active vegetarian menu items mentioning 'ring'."""
    return S.search_menu(D.menu_items(spark, sf), active=True, vegetarian=True, text="ring")


_CATEGORIES = """SELECT r_regionkey AS id, r_name AS name, 10 - length(r_name) AS display_order,
  r_regionkey < 4 AS is_active FROM region"""
_SUBCATEGORIES = """SELECT CASE WHEN n_nationkey % 10 <> 9 THEN n_regionkey END AS category_id, n_nationkey AS id,
  n_name AS name, n_nationkey % 5 AS display_order, n_nationkey < 20 AS is_active FROM nation"""


@register("p03_list_categories", f"SELECT * FROM ({_CATEGORIES}) WHERE is_active ORDER BY display_order, name")
def p03(spark, sf):
    """P3 active categories in display order."""
    return S.list_categories(D.categories(spark, sf), active=True)


@register("p04_list_subcategories", f"""
SELECT s.*, COALESCE(c.name, 'Other') AS category_name FROM ({_SUBCATEGORIES}) s LEFT JOIN ({_CATEGORIES}) c
  ON s.category_id = c.id ORDER BY display_order, name""")
def p04(spark, sf):
    """P4 (J2) subcategories with category names, Other for unknown ones."""
    return S.list_subcategories(D.subcategories(spark, sf), D.categories(spark, sf))


@register("p04_subcategories_of_category", f"""
SELECT s.*, COALESCE(c.name, 'Other') AS category_name FROM ({_SUBCATEGORIES}) s LEFT JOIN ({_CATEGORIES}) c
  ON s.category_id = c.id WHERE s.category_id = 2 AND s.is_active ORDER BY display_order, name""")
def p04_one(spark, sf):
    """P4 active subcategories of one category."""
    return S.list_subcategories(D.subcategories(spark, sf), D.categories(spark, sf), 2, True)


@register("p05_search_customers", with_views("""
SELECT * FROM cu WHERE (name ILIKE '%machinery%' OR nation ILIKE '%machinery%' OR segment ILIKE '%machinery%'
  OR CAST(customer_id AS VARCHAR) ILIKE '%machinery%') AND loyalty_tier = 'platinum'
ORDER BY name, customer_id LIMIT 100 OFFSET 5""", "cu"))
def p05(spark, sf):
    """P5 platinum customers matching 'machinery', second page."""
    return S.search_customers(D.customers(spark, sf), search="machinery", tier="platinum", skip=5, limit=100)


@register("p06_search_inventory", with_views("""
SELECT *, quantity_on_hand <= reorder_level AS needs_reorder FROM inv
WHERE category = 'ECONOMY' AND quantity_on_hand <= reorder_level""", "inv"))
def p06(spark, sf):
    """P6 low-stock inventory in one category."""
    return S.search_inventory(D.inventory(spark, sf), category="ECONOMY", low_stock=True)


@register("p07_low_stock", with_views("""
SELECT * FROM inv WHERE quantity_on_hand <= reorder_level AND is_active""", "inv"))
def p07(spark, sf):
    """P7 low-stock report."""
    return S.low_stock(D.inventory(spark, sf))


@register("p08_stock_status", with_views("""
SELECT COUNT(*) AS total_items, COUNT(*) FILTER (WHERE quantity_on_hand <= reorder_level AND quantity_on_hand > 0)
  AS low_stock, COUNT(*) FILTER (WHERE quantity_on_hand <= 0) AS out_of_stock FROM inv""", "inv"))
def p08(spark, sf):
    """P8 stock status counts."""
    return S.stock_status(D.inventory(spark, sf))


@register("p09_low_stock_alerts", with_views("""
SELECT inventory_id, ingredient_name, quantity_on_hand, reorder_level FROM inv
WHERE quantity_on_hand < reorder_level ORDER BY inventory_id LIMIT 5""", "inv"))
def p09(spark, sf):
    """P9 first five strict low-stock alerts."""
    return S.low_stock_alerts(D.inventory(spark, sf), 5)


def _picks_sql(words: list[str]) -> str:
    hit = " OR ".join(f"contains(lower(COALESCE(description, '')), '{w}')" for w in words)
    return with_views(f"""
SELECT id AS item_id, name, category, price, description FROM mi
WHERE is_vegetarian AND price <= 1500 AND (({hit}) OR NOT EXISTS (
  SELECT 1 FROM mi WHERE is_vegetarian AND price <= 1500 AND ({hit})))
ORDER BY id LIMIT 5""", "mi")


@register("p10_menu_picks", _picks_sql(["ring", "bolt"]))
def p10(spark, sf):
    """P10 vegetarian picks under 1500 mentioning ring or bolt."""
    return S.menu_picks(D.menu_items(spark, sf), ["ring", "bolt"], ["vegetarian"], 1500, 5)


@register("p10_menu_picks_fallback", _picks_sql(["saffron"]))
def p10f(spark, sf):
    """P10 picks whose preference word matches nothing (filter skipped)."""
    return S.menu_picks(D.menu_items(spark, sf), ["saffron"], ["vegetarian"], 1500, 5)


@register("p11_theme_items", with_views("""
SELECT * FROM mi WHERE regexp_matches(lower(COALESCE(description, '')), 'hot|cold')
  OR regexp_matches(lower(COALESCE(name, '')), 'anvil|gizmo') ORDER BY id LIMIT 5""", "mi"))
def p11(spark, sf):
    """P11 theme items by regex over name and description."""
    return S.theme_items(D.menu_items(spark, sf), "anvil|gizmo", "hot|cold", 5)


@register("p12_customer_history", with_views("""
SELECT * FROM tx WHERE customer_id = 100""", "tx"))
def p12(spark, sf):
    """P12 one customer's purchase history."""
    return S.customer_history(D.transactions(spark, sf), 100)


@register("p13_page_after", with_views("""
SELECT * FROM ord WHERE id > 5000 ORDER BY id LIMIT 20""", "ord"))
def p13(spark, sf):
    """P13 key-set page of orders after id 5000."""
    return S.page_after(D.orders(spark, sf), "id", 5000, 20)


@register("p14_fill_missing", with_views("""
SELECT customer_id, loyalty_tier, COALESCE(total_spent, avg(total_spent) OVER ()) AS total_spent FROM (
  SELECT cu.customer_id, cu.loyalty_tier, f.total_spent FROM cu LEFT JOIN (
    SELECT customer_id, CAST(SUM(CAST(total_price AS DECIMAL(18,2))) AS DOUBLE) AS total_spent FROM tx
    WHERE customer_id IS NOT NULL AND status = 'completed' GROUP BY 1) f ON cu.customer_id = f.customer_id)""",
                                          "tx", "cu"))
def p14(spark, sf):
    """P14 fill missing completed-order spend (customers with none) with the mean."""
    tx = D.transactions(spark, sf)
    spend = (tx.where(F.col("customer_id").isNotNull() & (F.col("status") == "completed"))
             .groupBy("customer_id").agg(F.sum(F.col("total_price").cast("decimal(18,2)")).cast("double")
                                         .alias("total_spent")))
    base = D.customers(spark, sf).select("customer_id", "loyalty_tier").join(spend, "customer_id", "left")
    return S.fill_missing(base, "total_spent", "mean")


@register("j04_unpurchased", with_views("""
SELECT * FROM mi WHERE id NOT IN (SELECT item_id FROM tx)""", "tx", "mi"))
def j04(spark, sf):
    """J4 menu items never bought (anti join)."""
    return S.unpurchased(D.menu_items(spark, sf), D.transactions(spark, sf))


@register("j04_orphans", with_views("""
SELECT oi.* FROM oi WHERE menu_item_id NOT IN (SELECT id FROM mi WHERE is_active)""", "oi", "mi"))
def j04o(spark, sf):
    """J4 order lines whose menu item is not active (orphans of the active menu)."""
    items = D.menu_items(spark, sf).where("is_active")
    return S.orphans(D.order_items(spark, sf), items, "menu_item_id", "id")


_NORM = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_QUERIES = """SELECT DISTINCT p_name AS query FROM part
UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part
UNION SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM part"""


def _match_queries(spark, sf):
    p = D.read(spark, sf, "part")
    w = F.split("p_name", " ")
    q = (p.select(F.col("p_name").alias("query"))
         .union(p.select(w.getItem(1).alias("query")))
         .union(p.select(F.concat_ws(" ", w.getItem(1), w.getItem(0)).alias("query"))).distinct())
    return q.withColumn("query_id", F.col("query"))


@register("j05_match_items", with_views(f"""
SELECT query_id, item_id, item_name, rule FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rule, item_id) AS r FROM (
    SELECT query_id, item_id, item_name, 1 AS rule FROM q JOIN m ON qn = mn
    UNION ALL SELECT query_id, item_id, item_name, 2 FROM q, m WHERE contains(qn, mn) OR contains(mn, qn)
    UNION ALL SELECT query_id, item_id, item_name, 3 FROM q, m
      WHERE len(list_intersect(list_distinct(list_filter(string_split(qn, ' '), lambda x: length(x) > 2)),
                               list_distinct(list_filter(string_split(mn, ' '), lambda x: length(x) > 2)))) >= 2))
WHERE r = 1""", "mi", extra={
    "q": f"SELECT query AS query_id, {_NORM.format(c='query')} AS qn FROM ({_QUERIES}) WHERE length({_NORM.format(c='query')}) > 0",
    "m": f"SELECT id AS item_id, name AS item_name, {_NORM.format(c='name')} AS mn FROM mi"}))
def j05(spark, sf):
    """J5 fuzzy match of free-text item names to menu items (exact, partial, shared words)."""
    return S.match_items(_match_queries(spark, sf), D.menu_items(spark, sf))


@register("k05_duplicate_rows", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def k05(spark, sf):
    """K5 duplicate (order, line number) keys in the line table."""
    return S.duplicate_rows(D.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
