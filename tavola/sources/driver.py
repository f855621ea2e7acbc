"""The driver's parquet tables seen as the application's tables.

Every view here is a lazy DataFrame plan over the parquet files, so column
pruning and filters reach the scan.  ``plans/sqlviews.py`` holds the same
definitions in SQL for the DuckDB oracle; keep the two in step.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import tier

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()

# Order status letter -> application status.
STATUS_MAP = {"F": "completed", "O": "pending", "P": "preparing"}
# Order priority digit -> order type.
ORDER_TYPE_MAP = {"1": "dine_in", "2": "takeout", "3": "delivery", "4": "dine_in", "5": "takeout"}
# Reorder level used for every stock row.
REORDER_LEVEL = 20
# Menu flags derived from part attributes (size and type).
GLUTEN_FREE_TYPES = ("SMALL", "ECONOMY")
ACTIVE_MAX_SIZE = 47
# Sales lines of a task; tables of more than SALES_TASKS such tasks are dealt out by order.
SALES_ROWS = 1 << 18
SALES_TASKS = 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _map(col, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr.otherwise(F.lit(default))


def _dealt(li: DataFrame) -> DataFrame:
    """Large line tables in parts of about ``SALES_ROWS`` lines by order.

    The lines compress to a few bytes in a shuffle, so parts merged by their
    bytes hold millions of them, and a task sorts and aggregates all it has; a
    number of parts that grows with the rows keeps its memory the same."""
    parts = -(-li.count() // SALES_ROWS)  # answered from the file footers
    return li.repartition(parts, "l_orderkey") if parts > SALES_TASKS else li


def transactions(spark: SparkSession, sf_dir: str, dims: bool = True) -> DataFrame:
    """Line-level sales: lineitem joined to orders, and to part for the item's
    name, category and subcategory unless ``dims`` is False (an inner join
    cannot be pruned by the planner, so reports that read no dimension leave
    it out)."""
    li = _dealt(read(spark, sf_dir, "lineitem"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    sales = li.join(o, li.l_orderkey == o.o_orderkey)
    named = []
    if dims:
        p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
        sales = sales.join(p, li.l_partkey == p.p_partkey)
        named = [F.col("p_name").alias("item_name"), F.col("p_type").alias("category"),
                 F.col("p_brand").alias("subcategory")]
    return (sales
            .select(F.col("l_orderkey").alias("order_id"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("l_partkey").alias("item_id"),
                    *named,
                    F.col("l_quantity").cast("long").alias("quantity"),
                    F.col("l_extendedprice").alias("total_price"),
                    (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
                    (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"),
                    F.col("o_orderdate").alias("ts"),
                    _map(F.col("o_orderstatus"), STATUS_MAP).alias("status"),
                    F.concat_ws("-", F.col("l_orderkey").cast("string"),
                                F.col("l_linenumber").cast("string")).alias("transaction_id")))


def orders(spark: SparkSession, sf_dir: str, status: str | None = None, since=None) -> DataFrame:
    """Orders; ``status`` and ``since`` (a timestamp column) filter the raw
    columns, so that they reach the Parquet scan (Catalyst cannot see through
    the derived status)."""
    o = read(spark, sf_dir, "orders")
    if status is not None:
        o = o.where(F.col("o_orderstatus").isin([raw for raw, name in STATUS_MAP.items() if name == status]))
    if since is not None:
        o = o.where(F.col("o_orderdate") >= since)
    status = _map(F.col("o_orderstatus"), STATUS_MAP)
    return o.select(F.col("o_orderkey").alias("id"),
                    F.col("o_custkey").alias("customer_id"),
                    status.alias("status"),
                    _map(F.substring("o_orderpriority", 1, 1), ORDER_TYPE_MAP, "dine_in").alias("order_type"),
                    F.col("o_totalprice").alias("total"),
                    F.col("o_orderdate").alias("created_at"),
                    F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("completed_at"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("order_id"),
                     F.col("l_linenumber").alias("line_number"),
                     F.col("l_partkey").alias("menu_item_id"),
                     F.col("l_quantity").cast("long").alias("quantity"),
                     (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
                     F.col("l_extendedprice").alias("total_price"))


def menu_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    s = F.col("p_size")
    return p.select(F.col("p_partkey").alias("id"),
                    F.col("p_name").alias("name"),
                    F.concat_ws(" ", F.col("p_name"), F.lower("p_type"), F.col("p_brand")).alias("description"),
                    F.col("p_type").alias("category"),
                    F.col("p_brand").alias("subcategory"),
                    F.col("p_retailprice").alias("price"),
                    (F.col("p_retailprice") * 0.4).alias("cost"),
                    s.alias("prep_time_minutes"),
                    (s <= 20).alias("is_vegetarian"),
                    (s <= 8).alias("is_vegan"),
                    F.col("p_type").isin(*GLUTEN_FREE_TYPES).alias("is_gluten_free"),
                    (s <= ACTIVE_MAX_SIZE).alias("is_active"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as categories; the last in order is inactive."""
    r = read(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"),
                    (10 - F.length("r_name")).alias("display_order"), (F.col("r_regionkey") < 4).alias("is_active"))


def subcategories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as subcategories; every tenth key has no known category."""
    n = read(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                    F.when(F.col("n_nationkey") % 10 != 9, F.col("n_regionkey")).alias("category_id"),
                    (F.col("n_nationkey") % 5).alias("display_order"), (F.col("n_nationkey") < 20).alias("is_active"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    points = F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).cast("long")
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
            .select(F.col("c_custkey").alias("customer_id"),
                    F.col("c_name").alias("name"),
                    F.col("n_name").alias("nation"),
                    F.col("c_mktsegment").alias("segment"),
                    F.col("c_acctbal").alias("balance"),
                    points.alias("loyalty_points"),
                    tier(points).alias("loyalty_tier"),
                    (F.col("c_acctbal") >= 0).alias("is_active")))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    sup = (read(spark, sf_dir, "lineitem").groupBy("l_partkey")
           .agg(F.min("l_suppkey").alias("supplier_id")))
    return (p.join(sup, p.p_partkey == sup.l_partkey, "left")
            .select(F.col("p_partkey").alias("inventory_id"),
                    F.col("p_name").alias("ingredient_name"),
                    F.col("p_type").alias("category"),
                    F.col("p_size").alias("quantity_on_hand"),
                    F.lit(REORDER_LEVEL).alias("reorder_level"),
                    F.col("p_retailprice").alias("unit_cost"),
                    F.col("supplier_id"),
                    (F.col("p_size") <= ACTIVE_MAX_SIZE).alias("is_active")))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a real time of day; ``k`` parsed from the JSON props."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value",
                    F.get_json_object("props", "$.k").cast("long").alias("k"))
