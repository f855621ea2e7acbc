"""Basket analysis and recommenders.

Pair counting is a self join of (basket, item) on the basket key.  Distinct
(basket, item) rows come first, so one basket contributes at most
``k*(k-1)/2`` pairs for ``k`` distinct items.  A basket that is hot (many
distinct items, e.g. one group holding a third of the data) is split over a
``s x s`` grid of cells: each side is replicated ``s`` times and every item
pair meets in exactly one cell, so the work of one basket spreads over
``s*s`` tasks without dropping or duplicating a pair (``hot_items`` says how
large a basket is hot).  Pair counts are partially aggregated before the
shuffle on the pair key.

Recommenders run for every basket / customer at once as joins and
aggregations; top-n per key is ``row_number`` over a keyed window (Spark
plans it as a WindowGroupLimit), never a driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_even
from ..functions.scalars import scalar_struct, scalar_value
from ..session import written

# Hybrid weights (co-occurrence, content) and thresholds.
HYBRID_WEIGHTS = (0.6, 0.4)
# Distinct items of a basket that meet in one place; larger baskets are split.
HOT_ITEMS = 2048
# Basket rows of a task of the hybrid recommender.
DEALT_ROWS = 1 << 18
MIN_PAIR_COUNT = 5
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.1


def basket_items(tx: DataFrame, basket: str = "order_id", item: str = "item_id") -> DataFrame:
    """Distinct (basket, item) rows."""
    return tx.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()


def _grid_side(bi: DataFrame, sizes: DataFrame, left: bool) -> DataFrame:
    """Replicate one side of the self join over the ``s x s`` grid of its basket."""
    s = F.col("_s")
    own = F.pmod(F.xxhash64("item"), s)
    others = F.sequence(F.lit(0).cast("long"), s - 1)
    cell = (F.transform(others, lambda j: own * s + j) if left else
            F.transform(others, lambda i: i * s + own))
    split = bi.join(sizes, "basket", "left").withColumn("_s", F.coalesce("_s", F.lit(1).cast("long")))
    return split.select("basket", "item", F.explode(cell).alias("_cell"))


def item_pairs(bi: DataFrame, hot_items: int | None = HOT_ITEMS) -> DataFrame:
    """Unordered co-occurring pairs ``(item_a < item_b)`` per basket, counted.

    A basket with more than ``hot_items`` distinct items is spread over
    ``ceil(k / hot_items)``^2 cells, so that no task pairs more than
    ``hot_items``^2 items of it; the cells of all others are their basket.
    Only the oversized baskets (few: each takes over ``hot_items`` rows) are
    joined back for it.  None joins on the basket alone."""
    if hot_items is None:
        a, b = bi.alias("a"), bi.alias("b")
        pairs = a.join(b, (F.col("a.basket") == F.col("b.basket")) & (F.col("a.item") < F.col("b.item")))
    else:
        sizes = (bi.groupBy("basket").agg(F.count(F.lit(1)).alias("_k"))
                 .where(F.col("_k") > hot_items)
                 .select("basket", F.ceil(F.col("_k") / F.lit(hot_items)).cast("long").alias("_s")))
        a = _grid_side(bi, sizes, True).alias("a")
        b = _grid_side(bi, sizes, False).alias("b")
        pairs = a.join(b, (F.col("a.basket") == F.col("b.basket")) & (F.col("a._cell") == F.col("b._cell"))
                       & (F.col("a.item") < F.col("b.item")))
    return (pairs.groupBy(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"))
            .agg(F.count(F.lit(1)).alias("n")))


def cooccurrence(tx: DataFrame, min_count: int = MIN_PAIR_COUNT, basket: str = "order_id",
                 item: str = "item_id", name: str | None = "item_name", hot_items: int | None = HOT_ITEMS) -> DataFrame:
    """B1: item pairs with count >= min_count, support (6 dp), both
    confidences (4 dp) and lift (4 dp); names are the first seen per item."""
    bi = basket_items(tx, basket, item)
    n_baskets = scalar_value(bi.select(F.countDistinct("basket")))
    counts = bi.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    pairs = item_pairs(bi, hot_items).where(F.col("n") >= min_count)
    c1 = counts.select(F.col("item").alias("item_a"), F.col("c").alias("c1"))
    c2 = counts.select(F.col("item").alias("item_b"), F.col("c").alias("c2"))
    # per-item tables are bounded by the item universe; AQE broadcasts them when small
    out = pairs.join(c1, "item_a").join(c2, "item_b")
    nb = n_baskets.cast("double")
    support = F.col("n") / nb
    expected = (F.col("c1") / nb) * (F.col("c2") / nb)
    out = out.select(
        F.col("item_a").alias("item_id_1"), F.col("item_b").alias("item_id_2"),
        F.col("n").alias("cooccurrence_count"),
        round_even(support, 6).alias("support"),
        round_even(F.col("n") / F.col("c1").cast("double"), 4).alias("confidence_1_to_2"),
        round_even(F.col("n") / F.col("c2").cast("double"), 4).alias("confidence_2_to_1"),
        round_even(F.when(expected > 0, support / expected).otherwise(0.0), 4).alias("lift"))
    if name:
        names = tx.groupBy(item).agg(F.min(name).alias("_nm"))
        n1 = names.select(F.col(item).alias("item_id_1"), F.col("_nm").alias("item_name_1"))
        n2 = names.select(F.col(item).alias("item_id_2"), F.col("_nm").alias("item_name_2"))
        out = out.join(n1, "item_id_1", "left").join(n2, "item_id_2", "left")
    return out


def frequent_sets(tx: DataFrame, min_count: int = MIN_PAIR_COUNT, most: int = 3, basket: str = "order_id",
                  item: str = "item_id") -> DataFrame:
    """B1 beyond pairs: sets of up to ``most`` items bought together in ``min_count`` baskets or more.

    Parallel FP-growth, no deeper than ``most``: the conditional transactions of a set
    are, in each basket that has it, the items that sort before its first one.  They
    give the sets with one item more; only those of frequent sets are grown, so a set
    is counted only if its last items are frequent.  A pass holds one basket's
    transactions at a time, and counts are partially aggregated before their shuffle.
    ``items`` are sorted; a basket counts once; null baskets and items take no part."""
    baskets = written(tx.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).groupBy(basket)
                      .agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("_before")).select("_before"))
    grown, found, names = baskets, [], []
    for size in range(1, most + 1):
        if names:
            # an array without items has no transactions, so it is left out before the join
            grown = grown.where(F.size("_before") > 0).join(found[-1].select(*names), names, "left_semi")
        new = f"_{size}"
        grown = grown.select(*names, "_before", F.posexplode("_before").alias("_at", new)).select(
            new, *names, F.slice("_before", 1, F.col("_at")).alias("_before"))
        names = [new, *names]
        sets = grown.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
        found.append(written(sets) if size < most else sets)
    return reduce(DataFrame.unionAll, [
        sets.select(F.array(*[f"_{k}" for k in range(size, 0, -1)]).alias("items"), "n") for size, sets in enumerate(found, 1)])


def association_edges(pairs: DataFrame, min_support: float = MIN_SUPPORT,
                      min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """B2: kept pairs as directed edges both ways, weighted by lift."""
    kept = pairs.where((F.col("support") >= min_support) & (F.col("confidence_1_to_2") >= min_confidence))
    fwd = kept.select(F.col("item_id_1").alias("src"), F.col("item_id_2").alias("dst"), "lift",
                      F.col("cooccurrence_count").alias("n"))
    rev = kept.select(F.col("item_id_2").alias("src"), F.col("item_id_1").alias("dst"), "lift",
                      F.col("cooccurrence_count").alias("n"))
    return fwd.unionByName(rev)


def item_popularity(edges: DataFrame, n: int | None = None) -> DataFrame:
    """popularity = sum of kept pair counts per item; optional top-n."""
    pop = edges.groupBy(F.col("src").alias("item_id")).agg(F.sum("n").cast("long").alias("popularity_score"))
    if n:
        pop = pop.orderBy(F.desc("popularity_score"), "item_id").limit(n)
    return pop


def _top_n(df: DataFrame, key: str, score: str, item: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(item))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recommend_cooccurrence(baskets: DataFrame, edges: DataFrame, n: int = 5,
                           exclude: DataFrame | None = None) -> DataFrame:
    """For every basket, sum of lift from its items to each candidate,
    minus basket items (and ``exclude`` rows (basket, item)), top-n (4 dp)."""
    cand = (baskets.join(edges, baskets.item == edges.src)
            .groupBy("basket", F.col("dst").alias("item")).agg(F.sum("lift").alias("_s")))
    cand = cand.join(baskets, ["basket", "item"], "left_anti")
    if exclude is not None:
        cand = cand.join(exclude.select("basket", "item"), ["basket", "item"], "left_anti")
    scored = cand.select("basket", "item", round_even("_s", 4).alias("score"))
    return _top_n(scored, "basket", "score", "item", n)


def recommend_hybrid(baskets: DataFrame, edges: DataFrame, similar: DataFrame, n: int = 5,
                     weights: tuple[float, float] = HYBRID_WEIGHTS, exclude: DataFrame | None = None) -> DataFrame:
    """Top-2n co-occurrence scores plus, per basket item, its top-n content
    neighbours (max over basket items); each divided by its per-basket max;
    ``wc*cooc + wt*content`` (4 dp); top-n.  ``similar`` is (item, other, score)."""
    wc, wt = weights
    # baskets (and excluded rows) are dealt by basket once; what follows keeps each
    # basket's rows where they are: candidates come from one table per item,
    # a marker of every removed item takes its candidates out by a window
    rows = baskets.select("basket", "item", F.lit(True).alias("_in"))
    if exclude is not None:
        rows = rows.unionByName(exclude.select("basket", "item", F.lit(False).alias("_in")))
    parts = max(1, -(-rows.count() // DEALT_ROWS))
    wb = Window.partitionBy("basket")
    rows = rows.repartition(parts, "basket").withColumn("_e", F.count(F.lit(1)).over(wb).cast("int"))
    to = edges.groupBy(F.col("src").alias("item")).agg(F.collect_list(F.struct("dst", "lift")).alias("_to"))
    near = similar.groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct(F.negative("score").alias("low"), "other"))).alias("_near"))
    item_type = baskets.schema["item"].dataType.simpleString()
    cand = f"array<struct<item:{item_type},lift:double,src:{item_type},score:double,own:boolean>>"
    # a content candidate is among an item's first n + e neighbours (e: removed items of the basket)
    found = F.concat(
        F.array(F.struct("item", F.lit(None), F.lit(None), F.lit(None), F.lit(True))).cast(cand),
        F.when(F.col("_in") & F.col("_to").isNotNull(), F.transform("_to", lambda x: F.struct(
            x["dst"], x["lift"], F.lit(None), F.lit(None), F.lit(False))).cast(cand)).otherwise(F.array().cast(cand)),
        F.when(F.col("_in") & F.col("_near").isNotNull() & F.col("basket").isNotNull(),
               F.transform(F.slice("_near", 1, F.col("_e") + n), lambda x: F.struct(
                   x["other"], F.lit(None), F.col("item"), F.negative(x["low"]), F.lit(False))).cast(cand))
        .otherwise(F.array().cast(cand)))
    rows = (rows.join(to, "item", "left").join(near, "item", "left").select("basket", F.explode(found).alias("_c"))
            .select("basket", "_c.*"))
    own = F.max("own").over(Window.partitionBy("basket", "item"))
    rows = rows.withColumn("_own", own).where(~F.col("own") & (~F.col("_own") | F.col("basket").isNull()))
    w = Window.partitionBy("basket", "src").orderBy(F.desc("score"), F.asc("item"))
    rows = (rows.withColumn("_r", F.row_number().over(w)).where(F.col("src").isNull() | (F.col("_r") <= n))
            .groupBy("basket", "item").agg(round_even(F.sum("lift"), 4).alias("cooc"), F.max("score").alias("content")))
    first = F.row_number().over(wb.orderBy(F.col("cooc").desc_nulls_last(), F.asc("item")))
    merged = (rows.withColumn("cooc", F.when(first <= 2 * n, F.col("cooc")))
              .where(F.col("cooc").isNotNull() | F.col("content").isNotNull()).fillna(0.0, ["cooc", "content"]))
    mc, mt = F.max("cooc").over(wb), F.max("content").over(wb)
    score = (F.lit(wc) * F.when(mc > 0, F.col("cooc") / mc).otherwise(0.0)
             + F.lit(wt) * F.when(mt > 0, F.col("content") / mt).otherwise(0.0))
    out = merged.select("basket", "item", round_even(score, 4).alias("score"),
                        round_even("cooc", 4).alias("cooccurrence_score"), round_even("content", 4).alias("content_score"))
    return _top_n(out, "basket", "score", "item", n)


def recommend_for_customers(tx: DataFrame, edges: DataFrame, similar: DataFrame, customers: DataFrame,
                            n: int = 5, k_recent: int = 10, item: str = "item_id") -> DataFrame:
    """basket = each customer's last k distinct items; everything they ever
    bought is excluded; customers without history get the popular items."""
    from .windows import recent_items
    t = tx.select("customer_id", F.col(item).alias("item_id"), "ts")
    recent = recent_items(t, k_recent).select(F.col("customer_id").alias("basket"), F.col("item_id").alias("item"))
    bought = t.where(F.col("customer_id").isNotNull()).select(F.col("customer_id").alias("basket"),
                                                              F.col("item_id").alias("item")).distinct()
    recs = recommend_hybrid(recent, edges, similar, n, exclude=bought).select(
        F.col("basket").alias("customer_id"), "item", "score", "rank", F.lit("hybrid").alias("method"))
    popular = item_popularity(edges, n).select(
        F.col("item_id").alias("item"), F.col("popularity_score").cast("double").alias("score"))
    # at most n rows: a window without partition over a bounded table
    popular = popular.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "item")))
    top = popular.agg(F.collect_list(F.struct("item", "score", "rank")).alias("_p")).scalar()
    cold = customers.select("customer_id").join(bought.select(F.col("basket").alias("customer_id")).distinct(),
                                                "customer_id", "left_anti")
    cold_recs = (cold.select("customer_id", F.explode(top).alias("_r"))
                 .select("customer_id", "_r.item", "_r.score", "_r.rank", F.lit("popular").alias("method")))
    return recs.unionByName(cold_recs)


# --------------------------------------------------------------------------- CF
def user_item(tx: DataFrame, implicit: bool = False, user: str = "customer_id", item: str = "item_id") -> DataFrame:
    """Long-form user x item matrix (sum of quantity, or 1 when bought)."""
    g = tx.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("user"), F.col(item).alias("item"))
    return g.agg((F.lit(1).cast("long") if implicit else F.sum("quantity").cast("long")).alias("value"))


def cosine_pairs(ui: DataFrame, by: str = "item", hot: int = 2000) -> DataFrame:
    """Cosine between rows of the user-item matrix (``by`` = 'item' or
    'user'), over the shared other key; hot keys are grid-split as in B1."""
    other = "user" if by == "item" else "item"
    m = ui.select(F.col(by).alias("x"), F.col(other).alias("basket"), F.col("value").cast("double").alias("v"))
    norms = m.groupBy("x").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    sizes = (m.groupBy("basket").agg(F.count(F.lit(1)).alias("_k"))
             .select("basket", F.greatest(F.lit(1), F.ceil(F.col("_k") / F.lit(hot))).cast("long").alias("_s")))
    side = lambda left: _grid_side(m.withColumnRenamed("x", "item").select("basket", "item"), sizes, left) \
        .join(m.withColumnRenamed("x", "item"), ["basket", "item"])
    a, b = side(True).alias("a"), side(False).alias("b")
    dots = (a.join(b, (F.col("a.basket") == F.col("b.basket")) & (F.col("a._cell") == F.col("b._cell"))
                   & (F.col("a.item") < F.col("b.item")))
            .groupBy(F.col("a.item").alias("x1"), F.col("b.item").alias("x2"))
            .agg(F.sum(F.col("a.v") * F.col("b.v")).alias("dot")))
    n1 = norms.select(F.col("x").alias("x1"), F.col("norm").alias("n1"))
    n2 = norms.select(F.col("x").alias("x2"), F.col("norm").alias("n2"))
    return (dots.join(n1, "x1").join(n2, "x2")
            .select(F.col("x1").alias(f"{by}_1"), F.col("x2").alias(f"{by}_2"),
                    round_even(F.col("dot") / (F.col("n1") * F.col("n2")), 6).alias("cosine")))


def content_scores(candidates: DataFrame, bought: DataFrame, items: DataFrame) -> DataFrame:
    """Score of each (user, candidate) = mean cosine between the candidate
    and the user's bought items, with item features one-hot category plus
    min-max scaled price.  The mean factorises into a per-user category
    profile and a price moment, so scoring is two equi joins:
    ``cos(c,b) = ([cat_c = cat_b] + p_c p_b) / (|c| |b|)`` with
    ``|x| = sqrt(1 + p_x^2)``."""
    s = scalar_struct(items.agg(F.min("price").alias("lo"), F.max("price").alias("hi")))
    p = F.when(s["hi"] > s["lo"], (F.col("price") - s["lo"]) / (s["hi"] - s["lo"])).otherwise(0.0)
    feat = items.select(F.col("id").alias("item"), "category", p.alias("p")).withColumn(
        "norm", F.sqrt(1 + F.col("p") * F.col("p")))
    b = bought.select("user", "item").distinct().join(feat, "item")
    tot = b.groupBy("user").agg(F.count(F.lit(1)).alias("nb"), F.sum(F.col("p") / F.col("norm")).alias("pm"))
    cat = b.groupBy("user", "category").agg(F.sum(1 / F.col("norm")).alias("cm"))
    c = candidates.select("user", "item").join(feat, "item").join(tot, "user")
    c = c.join(cat, ["user", "category"], "left").fillna(0.0, ["cm"])
    score = (F.col("cm") + F.col("p") * F.col("pm")) / (F.col("norm") * F.col("nb"))
    return c.select("user", "item", round_even(score, 6).alias("content_score"))


# --------------------------------------------------------------------------- metrics
def ranking_metrics(recs: DataFrame, relevant: DataFrame, k: int = 5, n_items=None) -> DataFrame:
    """precision@k, recall@k, NDCG@k (linear gain, 1/log2(rank+1)),
    hit rate, MAP@k and catalogue coverage, averaged over users with relevant
    items.  ``recs``: (user, item, rank); ``relevant``: (user, item)."""
    top = recs.where(F.col("rank") <= k).select("user", "item", "rank")
    rel = relevant.select("user", "item").distinct().withColumn("_rel", F.lit(1))
    j = top.join(rel, ["user", "item"], "left").fillna(0, ["_rel"])
    w = Window.partitionBy("user").orderBy("rank")
    j = j.withColumn("_hits_so_far", F.sum("_rel").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = j.groupBy("user").agg(
        F.sum("_rel").alias("hits"),
        F.sum(F.col("_rel") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.when(F.col("_rel") == 1, F.col("_hits_so_far") / F.col("rank"))).alias("ap_sum"))
    nrel = rel.groupBy("user").agg(F.count(F.lit(1)).alias("n_rel"))
    idcg = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k))), F.lit(0.0),
                       lambda acc, i: acc + 1 / F.log2(i + 1))
    u = nrel.join(per, "user", "left").fillna(0, ["hits"]).fillna(0.0, ["dcg", "ap_sum"])
    u = u.select("user", (F.col("hits") / F.lit(float(k))).alias("precision"),
                 (F.col("hits") / F.col("n_rel")).alias("recall"),
                 (F.col("dcg") / idcg).alias("ndcg"), (F.col("hits") > 0).cast("double").alias("hit"),
                 (F.col("ap_sum") / F.least(F.col("n_rel"), F.lit(k))).alias("ap"))
    cov = top.select(F.countDistinct("item")).scalar()
    out = u.agg(F.count(F.lit(1)).alias("n_users"),
                *[round_even(F.avg(c), 6).alias(f"{c}_at_{k}" if c in ("precision", "recall", "ndcg") else
                                                 ("hit_rate" if c == "hit" else "map"))
                  for c in ("precision", "recall", "ndcg", "hit", "ap")])
    if n_items is not None:
        n = n_items if isinstance(n_items, Column) else F.lit(n_items)
        out = out.withColumn("coverage", round_even(cov / n.cast("double"), 6))
    return out
