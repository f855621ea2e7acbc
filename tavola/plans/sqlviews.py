"""SQL twins of ``sources/driver.py`` for the DuckDB oracle.

``with_views(sql, *names)`` prefixes a query with the CTEs it needs.
Keep each definition identical in meaning to its DataFrame twin.
"""

from __future__ import annotations

_STATUS = ("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' "
           "WHEN 'P' THEN 'preparing' END")

VIEWS = {
    "tx": f"""
SELECT l.l_orderkey AS order_id, o.o_custkey AS customer_id, l.l_partkey AS item_id,
       p.p_name AS item_name, p.p_type AS category, p.p_brand AS subcategory,
       CAST(l.l_quantity AS BIGINT) AS quantity, l.l_extendedprice AS total_price,
       l.l_extendedprice / l.l_quantity AS unit_price,
       l.l_extendedprice * l.l_discount AS discount_amount,
       o.o_orderdate AS ts, {_STATUS} AS status,
       CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS transaction_id
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey""",
    "ord": f"""
SELECT o_orderkey AS id, o_custkey AS customer_id, {_STATUS} AS status,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'dine_in' WHEN '2' THEN 'takeout'
            WHEN '3' THEN 'delivery' WHEN '4' THEN 'dine_in' WHEN '5' THEN 'takeout'
            ELSE 'dine_in' END AS order_type,
       o_totalprice AS total, o_orderdate AS created_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at
FROM orders""",
    "oi": """
SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS menu_item_id,
       CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice / l_quantity AS unit_price,
       l_extendedprice AS total_price
FROM lineitem""",
    "mi": """
SELECT p_partkey AS id, p_name AS name, concat_ws(' ', p_name, lower(p_type), p_brand) AS description,
       p_type AS category, p_brand AS subcategory, p_retailprice AS price,
       p_retailprice * 0.4 AS cost, p_size AS prep_time_minutes,
       (p_size <= 20) AS is_vegetarian, (p_size <= 8) AS is_vegan,
       (p_type IN ('SMALL', 'ECONOMY')) AS is_gluten_free, (p_size <= 47) AS is_active
FROM part""",
    "cu": """
SELECT c_custkey AS customer_id, c_name AS name, n_name AS nation, c_mktsegment AS segment,
       c_acctbal AS balance, CAST(floor(greatest(c_acctbal, 0.0)) AS BIGINT) AS loyalty_points,
       CASE WHEN floor(greatest(c_acctbal, 0.0)) >= 2000 THEN 'platinum'
            WHEN floor(greatest(c_acctbal, 0.0)) >= 1000 THEN 'gold'
            WHEN floor(greatest(c_acctbal, 0.0)) >= 500 THEN 'silver' ELSE 'bronze' END AS loyalty_tier,
       (c_acctbal >= 0) AS is_active
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "inv": """
SELECT p_partkey AS inventory_id, p_name AS ingredient_name, p_type AS category,
       p_size AS quantity_on_hand, 20 AS reorder_level, p_retailprice AS unit_cost,
       s.supplier_id, (p_size <= 47) AS is_active
FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS supplier_id FROM lineitem GROUP BY l_partkey) s
  ON p_partkey = s.l_partkey""",
    "act": """
SELECT event_id, ts, user_id, event_type, value,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events""",
}


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix ``sql`` with ``WITH`` clauses for the named views (in order)."""
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in names]
    if extra:
        parts += [f"{k} AS ({v}\n)" for k, v in extra.items()]
    if not parts:
        return sql
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + sql


def money_sum(expr: str) -> str:
    """SQL twin of ``rounding.money_sum``."""
    return f"CAST(COALESCE(SUM(CAST({expr} AS DECIMAL(18,2))), 0) AS DOUBLE)"


def cents_avg(sum_dec: str, n: str) -> str:
    """SQL twin of ``rounding.cents_avg`` (arguments are SQL expressions)."""
    c = f"CAST(({sum_dec}) * 100 AS BIGINT)"
    return (f"(CASE WHEN ({n}) > 0 THEN CAST((({c}) - (({c}) % ({n}) + ({n})) % ({n})) // ({n}) "
            f"+ CASE WHEN 2 * ((({c}) % ({n}) + ({n})) % ({n})) > ({n}) OR (2 * ((({c}) % ({n}) + ({n})) % ({n})) = ({n}) "
            f"AND ((({c}) - (({c}) % ({n}) + ({n})) % ({n})) // ({n})) % 2 <> 0) THEN 1 ELSE 0 END AS DOUBLE) / 100.0 "
            f"ELSE 0.0 END)")


def round_even(expr: str, d: int) -> str:
    return f"round_even(CAST({expr} AS DOUBLE), {d})"


def floor_days(later: str, earlier: str) -> str:
    """SQL twin of ``timeutil.floor_days``."""
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000) AS INTEGER)"


def customer_base(asof: str, calendar: bool = False) -> str:
    """SQL twin of ``customers.customer_base`` over the ``tx`` view."""
    extra = ""
    if calendar:
        extra = "".join(f", COUNT(*) FILTER (WHERE isodow(ts) - 1 = {i}) AS orders_dow_{i}" for i in range(7))
        h = "hour(ts)"
        pods = {"morning": f"{h} <= 11", "lunch": f"{h} > 11 AND {h} <= 14", "afternoon": f"{h} > 14 AND {h} <= 17",
                "dinner": f"{h} > 17 AND {h} <= 21", "late": f"{h} > 21"}
        extra += "".join(f", COUNT(*) FILTER (WHERE {c}) AS orders_{p}" for p, c in pods.items())
    return f"""SELECT customer_id, COUNT(*) AS n_rows, COUNT(DISTINCT order_id) AS n_orders,
  SUM(CAST(total_price AS DECIMAL(18,2))) AS s1,
  SUM(CAST(CAST(total_price AS DECIMAL(38,2)) * CAST(total_price AS DECIMAL(38,2)) AS DECIMAL(38,4))) AS s2,
  max(total_price) AS max_price, min(total_price) AS min_price, CAST(SUM(quantity) AS BIGINT) AS total_items,
  COUNT(DISTINCT item_id) AS unique_items, min(ts) AS first_ts, max(ts) AS last_ts{extra}
FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id"""


def std_sql(s: str, q: str, n: str) -> str:
    a, b, nn = f"CAST({s} AS DOUBLE)", f"CAST({q} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    return f"(CASE WHEN {nn} > 1 THEN sqrt(greatest(({b} - {a} * {a} / {nn}) / ({nn} - 1.0), 0.0)) END)"


def qfrac(q: int) -> str:
    """Inner quantile fractions as pandas builds them, as a SQL list literal."""
    import numpy as np
    return "[" + ", ".join(repr(float(x)) for x in np.linspace(0, 1, q + 1)[1:-1]) + "]"


def value_bin(x: str, edges: str, q: int, reverse: bool = False) -> str:
    """SQL twin of ``bins.quantile_bins``: 1 + #{edges below x}."""
    b = "1 + " + " + ".join(f"CAST(CAST({x} AS DOUBLE) > {edges}[{j}] AS INTEGER)" for j in range(1, q))
    return f"CAST({q + 1} - ({b}) AS INTEGER)" if reverse else f"CAST({b} AS INTEGER)"


def rank_bin(r: str, n: str, q: int) -> str:
    """SQL twin of ``bins.rank_bin_expr``."""
    return (f"CAST(CASE WHEN {n} <= 1 THEN 1 ELSE greatest(1, ceil(CAST({r} - 1 AS DOUBLE) * {q} "
            f"/ CAST({n} - 1 AS DOUBLE))) END AS INTEGER)")
