"""Search, filter, join and set operators.

Optional filters become ``where`` clauses only when given, so Catalyst
pushes them into the Parquet scan.  Dimension lookups are left joins with a
``coalesce`` default; the planner broadcasts small dimensions by their
measured size (AQE), falling back to a shuffle join when they are not small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import ts_lit


def page(df: DataFrame, order: Sequence[Column | str], skip: int = 0, limit: int = 50) -> DataFrame:
    """K2: ordered offset/limit page (the order must end in a unique key)."""
    return df.orderBy(*order).offset(skip).limit(limit)


def page_after(df: DataFrame, key: str, cursor, n: int) -> DataFrame:
    """Key-set page: rows with ``key > cursor`` in key order, first ``n``."""
    return df.where(F.col(key) > F.lit(cursor)).orderBy(key).limit(n)


def search_orders(orders: DataFrame, lines: DataFrame, customers: DataFrame, status: str | None = None,
                  order_type: str | None = None, customer: int | None = None, date_from=None, date_to=None,
                  text: str | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    """Optional equality filters, inclusive created range, newest first,
    with line count and customer name; optional id / name text search."""
    o = orders
    if status:
        o = o.where(F.col("status") == status)
    if order_type:
        o = o.where(F.col("order_type") == order_type)
    if customer is not None:
        o = o.where(F.col("customer_id") == customer)
    if date_from is not None:
        o = o.where(F.col("created_at") >= ts_lit(date_from))
    if date_to is not None:
        o = o.where(F.col("created_at") <= ts_lit(date_to))
    # the page comes first; names and line counts are looked up for its rows
    # only (at most ``limit``, which bounds the broadcasts), unless the text
    # search needs the names before
    order = [F.desc("created_at"), F.desc("id")]
    cust = customers.select("customer_id", F.col("name").alias("customer_name"))
    if text:
        t = text.lower()
        o = o.join(cust, "customer_id", "left")
        o = o.where(F.col("id").cast("string").contains(t) | F.lower("customer_name").contains(t))
    shown = page(o, order, skip, limit)
    if not text:
        named = cust.join(F.broadcast(shown.select("customer_id").distinct()), "customer_id")
        shown = shown.join(F.broadcast(named), "customer_id", "left")
    mine = lines.join(F.broadcast(shown.select(F.col("id").alias("order_id"))), "order_id", "left_semi")
    counts = mine.groupBy("order_id").agg(F.count(F.lit(1)).alias("items_count"))
    return (shown.join(counts, shown.id == counts.order_id, "left")
            .withColumn("items_count", F.coalesce("items_count", F.lit(0)).cast("long"))
            .select("id", "order_type", "status", "total", "created_at", "items_count", "customer_name").orderBy(*order))


def search_menu(items: DataFrame, subcategory: str | None = None, category: str | None = None,
                active: bool | None = None, vegetarian: bool | None = None, vegan: bool | None = None,
                gluten_free: bool | None = None, text: str | None = None,
                skip: int = 0, limit: int = 100) -> DataFrame:
    """Menu filters and name/description text search; category path with
    'Other' when the category is missing (J2 default lookup)."""
    m = items
    for col, val in (("subcategory", subcategory), ("category", category)):
        if val is not None:
            m = m.where(F.col(col) == val)
    for col, val in (("is_active", active), ("is_vegetarian", vegetarian), ("is_vegan", vegan),
                     ("is_gluten_free", gluten_free)):
        if val is not None:
            m = m.where(F.col(col) == F.lit(val))
    if text:
        pat = f"%{text}%"
        m = m.where(F.col("name").ilike(pat) | F.col("description").ilike(pat))
    path = F.concat_ws(" > ", F.coalesce("category", F.lit("Other")), F.coalesce("subcategory", F.lit("Other")))
    return page(m.withColumn("category_path", path), ["name", "id"], skip, limit)


def list_categories(categories: DataFrame, active: bool | None = None) -> DataFrame:
    """Categories (id, name, display_order, is_active, ...), by display order, then name."""
    c = categories if active is None else categories.where(F.col("is_active") == F.lit(active))
    return c.orderBy("display_order", "name")


def list_subcategories(subcategories: DataFrame, categories: DataFrame, category=None,
                       active: bool | None = None) -> DataFrame:
    """P4 (J2): subcategories with their category's name, ``Other`` where the
    category is unknown; by display order, then name."""
    s = subcategories
    if category is not None:
        s = s.where(F.col("category_id") == F.lit(category))
    if active is not None:
        s = s.where(F.col("is_active") == F.lit(active))
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return (s.join(names, "category_id", "left")
            .withColumn("category_name", F.coalesce("category_name", F.lit("Other")))
            .orderBy("display_order", "name"))


def search_customers(customers: DataFrame, search: str | None = None, tier: str | None = None,
                     active: bool | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """P5: text in any of the descriptive columns, tier, active; by name."""
    c = customers
    if search:
        pat = f"%{search}%"
        c = c.where(F.col("name").ilike(pat) | F.col("nation").ilike(pat) | F.col("segment").ilike(pat)
                    | F.col("customer_id").cast("string").ilike(pat))
    if tier:
        c = c.where(F.col("loyalty_tier") == tier)
    if active is not None:
        c = c.where(F.col("is_active") == F.lit(active))
    return page(c, ["name", "customer_id"], skip, limit)


def needs_reorder(on_hand="quantity_on_hand", level="reorder_level") -> Column:
    return F.col(on_hand) <= F.col(level)


def search_inventory(inv: DataFrame, category: str | None = None, supplier=None, low_stock: bool = False,
                     active: bool | None = None, text: str | None = None) -> DataFrame:
    """Inventory filters with computed ``needs_reorder`` (<=, D7)."""
    i = inv
    if category:
        i = i.where(F.col("category") == category)
    if supplier is not None:
        i = i.where(F.col("supplier_id") == supplier)
    if low_stock:
        i = i.where(needs_reorder())
    if active is not None:
        i = i.where(F.col("is_active") == F.lit(active))
    if text:
        i = i.where(F.col("ingredient_name").ilike(f"%{text}%"))
    return i.withColumn("needs_reorder", needs_reorder())


def low_stock(inv: DataFrame) -> DataFrame:
    """Active rows at or below the reorder level, by category then name."""
    return (inv.where(needs_reorder() & F.col("is_active"))
            .orderBy("category", "ingredient_name", "inventory_id"))


def stock_status(inv: DataFrame) -> DataFrame:
    """Total, low (<= level and > 0) and out-of-stock (<= 0) counts."""
    q = F.col("quantity_on_hand")
    return inv.agg(F.count(F.lit(1)).alias("total_items"),
                   F.count_if(needs_reorder() & (q > 0)).cast("long").alias("low_stock"),
                   F.count_if(q <= 0).cast("long").alias("out_of_stock"))


def low_stock_alerts(inv: DataFrame, k: int = 5) -> DataFrame:
    """First k rows strictly below the reorder level (the assistant's rule)."""
    return (inv.where(F.col("quantity_on_hand") < F.col("reorder_level"))
            .orderBy("inventory_id").limit(k)
            .select("inventory_id", "ingredient_name", "quantity_on_hand", "reorder_level"))


# Dietary words and the flag each one filters on.
DIETARY_FLAGS = {"vegetarian": "is_vegetarian", "vegan": "is_vegan", "gluten-free": "is_gluten_free"}


def menu_picks(items: DataFrame, prefs: Sequence[str] | None = None, dietary: Sequence[str] | None = None,
               max_price: float | None = None, k: int = 5) -> DataFrame:
    """P10: dietary flags (AND), price cap, any preference word in the
    description; the word filter is skipped when no row matches at all."""
    m = items
    for d in dietary or []:
        flag = DIETARY_FLAGS.get(d.lower())
        if flag:
            m = m.where(F.col(flag))
    if max_price:
        m = m.where(F.col("price") <= max_price)
    if prefs:
        desc = F.lower(F.coalesce("description", F.lit("")))
        hit = F.lit(False)
        for p in prefs:
            hit = hit | desc.contains(p.lower())
        any_hit = m.where(hit).limit(1).exists()
        m = m.where(hit | ~any_hit)
    return m.orderBy("id").limit(k).select(F.col("id").alias("item_id"), "name", "category", "price", "description")


def theme_items(items: DataFrame, name_rx: str, desc_rx: str, k: int = 5) -> DataFrame:
    """Regex over lower-cased name and description (spicy, dessert...)."""
    hit = (F.lower(F.coalesce("description", F.lit(""))).rlike(desc_rx)
           | F.lower(F.coalesce("name", F.lit(""))).rlike(name_rx))
    return items.where(hit).orderBy("id").limit(k)


def customer_history(tx: DataFrame, customer) -> DataFrame:
    """One customer's lines, newest first."""
    return tx.where(F.col("customer_id") == F.lit(customer)).orderBy(F.desc("ts"), "order_id", "item_id")


def fill_missing(df: DataFrame, col: str, how: str = "mean", value=None) -> DataFrame:
    """Drop rows with a null, or fill it with the column mean or a constant."""
    if how == "drop":
        return df.na.drop(subset=[col])
    if how == "mean":
        mean = df.select(F.avg(col)).scalar()
        return df.withColumn(col, F.coalesce(F.col(col), mean.cast(df.schema[col].dataType)))
    return df.na.fill({col: value})


# --------------------------------------------------------------------------- joins / sets
def unpurchased(items: DataFrame, tx: DataFrame, item_key: str = "id") -> DataFrame:
    """Items never bought (anti join)."""
    bought = tx.select(F.col("item_id").alias(item_key))
    return items.join(bought, item_key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent row (NULL keys are not orphans)."""
    p = parent.select(F.col(parent_key).alias("_pk"))
    return child.where(F.col(child_key).isNotNull()).join(p, F.col(child_key) == F.col("_pk"), "left_anti")


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K5: key combinations that occur more than once, with their count."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def normalize_name(col) -> Column:
    """Lower-case, letters/digits/spaces only, single spaces, trimmed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), r"\s+", " "))


def _grams(col: str) -> Column:
    """All substrings of length 1..3 of a string (the probe set for containment)."""
    c = F.col(col)

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(c, i, n))

    return F.array_distinct(F.flatten(F.array(*[grams(n) for n in (1, 2, 3)])))


def _contains_pairs(big: DataFrame, big_col: str, small: DataFrame, small_col: str) -> DataFrame:
    """Pairs where ``small_col`` is a substring of ``big_col``.

    Every such pair shares the small string's first (up to) 3 characters, so
    an equi join of that prefix against all short substrings of the big
    string finds all of them exactly; ``contains`` then confirms."""
    probe = big.withColumn("_g", F.explode(_grams(big_col)))
    keyed = small.withColumn("_g", F.substring(F.col(small_col), 1, 3))
    return probe.join(keyed, "_g").where(F.col(big_col).contains(F.col(small_col))).drop("_g")


def match_items(names: DataFrame, items: DataFrame, name_col: str = "query", key: str = "query_id") -> DataFrame:
    """Fuzzy item match, first rule that hits: (1) equal normalized names,
    (2) either contains the other, (3) at least two shared words longer than
    two letters.  Best match per query by (rule, item id).

    Every rule is an equi join (on the name, on a short prefix, on a word),
    so candidates never come from a cross product and none is missed.  Both
    sides are distinct normalized names first: of equal items only the one of
    the least id can be the best match, and equal queries match alike.
    """
    asked = names.select(key, normalize_name(name_col).alias("qn")).where(F.length("qn") > 0)
    q = asked.select("qn").distinct()
    m = (items.select(F.struct(F.col("id").alias("item_id"), F.col("name").alias("item_name")).alias("_i"),
                      normalize_name("name").alias("mn")).where(F.length("mn") > 0)
         .groupBy("mn").agg(F.min("_i").alias("_i")).select("mn", "_i.item_id", "_i.item_name"))
    exact = q.join(m, q.qn == m.mn).select("qn", "item_id", "item_name", F.lit(1).alias("rule"))
    contain = (_contains_pairs(q, "qn", m, "mn").unionByName(_contains_pairs(m, "mn", q, "qn"))
               .select("qn", "item_id", "item_name", F.lit(2).alias("rule")))
    qw = q.select("qn", F.explode(F.array_distinct(F.split("qn", " "))).alias("w")).where(F.length("w") > 2)
    mw = m.select("item_id", "item_name", F.explode(F.array_distinct(F.split("mn", " "))).alias("w")) \
        .where(F.length("w") > 2)
    words = (qw.join(mw, "w").groupBy("qn", "item_id", "item_name").agg(F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") >= 2).select("qn", "item_id", "item_name", F.lit(3).alias("rule")))
    cand = exact.unionByName(contain).unionByName(words)
    best = cand.groupBy("qn").agg(F.min(F.struct("rule", "item_id", "item_name")).alias("_b"))
    return asked.join(best, "qn").select(key, F.col("_b.item_id").alias("item_id"), F.col("_b.item_name").alias("item_name"),
                       F.col("_b.rule").alias("rule"))
