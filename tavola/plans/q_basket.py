"""Basket, recommender and retrieval queries (B*) with their SQL oracles.

Basket items are dishes: the item name (``p_name``, 64 values), so that
pairs are dense enough to pass the count threshold and dishes have text for
the content recommender.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import round_even
from ..functions.text import sql_filtered_tokens, sql_terms_from
from ..operators import basket as B
from ..operators import text as X
from ..session import ensure_checkpoint_dir, written
from ..sources import driver as D
from .registry import register
from .sqlviews import with_views


def _tx(spark, sf):
    return D.transactions(spark, sf)


def _pairs(spark, sf):
    return B.cooccurrence(_tx(spark, sf), 5, "order_id", "item_name", name=None)


def _edges(spark, sf):
    return B.association_edges(_pairs(spark, sf))


def _order_baskets(spark, sf):
    return B.basket_items(_tx(spark, sf), "order_id", "item_name")


def _kept(df):
    """Written once to the checkpoint folder: the recommenders read baskets and
    edges several times, and each reading would join the sales again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def dishes(spark, sf):
    """One row per dish: its most common type and brand (ties: smallest)."""
    p = D.read(spark, sf, "part")
    mode = lambda c: F.min_by(c, F.struct(F.negative("_n"), c))
    t = p.groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("_n")).groupBy("p_name").agg(
        mode("p_type").alias("category"))
    b = p.groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("_n")).groupBy("p_name").agg(
        mode("p_brand").alias("subcategory"))
    pr = p.groupBy("p_name").agg(F.min("p_retailprice").alias("price"))
    return (t.join(b, "p_name").join(pr, "p_name").withColumnRenamed("p_name", "id")
            .withColumn("text", F.concat_ws(" ", "id", F.lower("category"), "subcategory")))


_BI = "SELECT DISTINCT order_id AS basket, item_name AS item FROM tx"
_PAIRS = """SELECT item_a AS item_id_1, item_b AS item_id_2, n AS cooccurrence_count,
  round_even(n / nb, 6) AS support, round_even(n / CAST(c1 AS DOUBLE), 4) AS confidence_1_to_2,
  round_even(n / CAST(c2 AS DOUBLE), 4) AS confidence_2_to_1,
  round_even(CASE WHEN (c1 / nb) * (c2 / nb) > 0 THEN (n / nb) / ((c1 / nb) * (c2 / nb)) ELSE 0.0 END, 4) AS lift
FROM (SELECT a.item AS item_a, b.item AS item_b, COUNT(*) AS n FROM bi a JOIN bi b
      ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2 HAVING COUNT(*) >= 5) p
JOIN (SELECT item, COUNT(*) AS c1 FROM bi GROUP BY 1) x1 ON p.item_a = x1.item
JOIN (SELECT item, COUNT(*) AS c2 FROM bi GROUP BY 1) x2 ON p.item_b = x2.item,
(SELECT CAST(COUNT(DISTINCT basket) AS DOUBLE) AS nb FROM bi)"""
_EDGES = """SELECT item_id_1 AS src, item_id_2 AS dst, lift, cooccurrence_count AS n FROM pairs
  WHERE support >= 0.001 AND confidence_1_to_2 >= 0.1
UNION ALL SELECT item_id_2, item_id_1, lift, cooccurrence_count FROM pairs
  WHERE support >= 0.001 AND confidence_1_to_2 >= 0.1"""
_BASKET_CTES = {"bi": _BI, "pairs": _PAIRS, "edges": _EDGES}


@register("b01_cooccurrence", with_views("SELECT * FROM pairs", "tx", extra={"bi": _BI, "pairs": _PAIRS}))
def b01(spark, sf):
    """B1 dish pairs in one order: count >= 5, support, confidences, lift."""
    return _pairs(spark, sf)


@register("b01_frequent_triples", with_views("""
SELECT x.item AS item_1, y.item AS item_2, z.item AS item_3, COUNT(*) AS n
FROM bi x JOIN bi y ON x.basket = y.basket AND x.item < y.item JOIN bi z ON y.basket = z.basket AND y.item < z.item
GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3""", "tx", extra={"bi": _BI}))
def b01_triples(spark, sf):
    """B1 beyond pairs: three dishes together in 3 orders or more, by parallel FP-growth three items deep."""
    sets = B.frequent_sets(_tx(spark, sf), 3, 3, "order_id", "item_name").where(F.size("items") == 3)
    return sets.select(*[F.col("items")[k].alias(f"item_{k + 1}") for k in range(3)], "n")


@register("b02_association_edges", with_views("SELECT * FROM edges", "tx", extra=_BASKET_CTES))
def b02(spark, sf):
    """B2 association edges (support >= .001, confidence >= .1), both ways."""
    return _edges(spark, sf)


@register("b03_item_popularity", with_views("""
SELECT src AS item_id, CAST(SUM(n) AS BIGINT) AS popularity_score FROM edges GROUP BY 1
ORDER BY popularity_score DESC, item_id LIMIT 10""", "tx", extra=_BASKET_CTES))
def b03(spark, sf):
    """B3 ten most popular dishes by kept pair counts."""
    return B.item_popularity(_edges(spark, sf), 10)


_REC_COOC = """SELECT basket, item, score, rank FROM (
  SELECT basket, item, score, CAST(row_number() OVER (PARTITION BY basket ORDER BY score DESC, item) AS INTEGER) AS rank
  FROM (SELECT c.basket, c.item, round_even(c.s, 4) AS score FROM (
          SELECT b.basket, e.dst AS item, SUM(e.lift) AS s FROM {baskets} b JOIN edges e ON b.item = e.src GROUP BY 1, 2) c
        WHERE NOT EXISTS (SELECT 1 FROM {baskets} x WHERE x.basket = c.basket AND x.item = c.item){extra}))
WHERE rank <= {n}"""


@register("b04_recommend_cooccurrence", with_views(
    _REC_COOC.format(baskets="bi", extra="", n=5), "tx", extra=_BASKET_CTES))
def b04(spark, sf):
    """B4 co-occurrence recommendations (top 5) for every order basket."""
    return B.recommend_cooccurrence(_order_baskets(spark, sf), _kept(_edges(spark, sf)), 5)


_DISHES = """SELECT t.id, t.category, b.subcategory, pr.price,
  concat_ws(' ', t.id, lower(t.category), b.subcategory) AS text FROM
 (SELECT p_name AS id, p_type AS category FROM (SELECT p_name, p_type, row_number() OVER (PARTITION BY p_name
    ORDER BY COUNT(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) WHERE r = 1) t
 JOIN (SELECT p_name AS id, p_brand AS subcategory FROM (SELECT p_name, p_brand, row_number() OVER (PARTITION BY p_name
    ORDER BY COUNT(*) DESC, p_brand) AS r FROM part GROUP BY 1, 2) WHERE r = 1) b ON t.id = b.id
 JOIN (SELECT p_name AS id, min(p_retailprice) AS price FROM part GROUP BY 1) pr ON t.id = pr.id"""


def _tfidf_sql(docs: str, key: str, text: str, max_terms: int) -> dict[str, str]:
    return {
        "toks": f"SELECT {key} AS doc, {sql_filtered_tokens(text)} AS t FROM {docs}",
        "post": f"SELECT doc, term, COUNT(*) AS tf FROM (SELECT doc, unnest({sql_terms_from('t')}) AS term FROM toks) "
                "GROUP BY 1, 2",
        "vocab": f"""SELECT term, df, ln((1.0 + (SELECT CAST(COUNT(*) AS DOUBLE) FROM {docs})) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT term, COUNT(*) AS df, SUM(tf) AS total FROM post GROUP BY 1) ORDER BY total DESC, term LIMIT {max_terms}""",
        "wts": """SELECT doc, term, w / sqrt(SUM(w * w) OVER (PARTITION BY doc)) AS w FROM (
  SELECT doc, post.term, tf * idf AS w FROM post JOIN vocab ON post.term = vocab.term)""",
    }


_DISH_TFIDF = {"dishes": _DISHES, **_tfidf_sql("dishes", "id", "text", 100)}


def _dish_model(spark, sf):
    return X.tfidf(dishes(spark, sf), "id", "text", 100)


@register("b05_tfidf", with_views("SELECT doc, term, round_even(w, 6) AS w FROM wts", extra=_DISH_TFIDF))
def b05(spark, sf):
    """B5 TF-IDF weights of dish texts (1-2 grams, top 100 terms, smoothed idf)."""
    w = _dish_model(spark, sf).weights
    return w.withColumn("w", round_even("w", 6))


_SIMILAR = """SELECT item, other, score, rank FROM (
  SELECT item, other, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, other) AS INTEGER) AS rank
  FROM (SELECT a.doc AS item, b.doc AS other, round_even(SUM(a.w * b.w), 4) AS score FROM wts a JOIN wts b
        ON a.term = b.term AND a.doc <> b.doc GROUP BY 1, 2)) WHERE rank <= 5"""


@register("b06_similar_items", with_views(_SIMILAR, extra=_DISH_TFIDF))
def b06(spark, sf):
    """B6 five most similar dishes by TF-IDF cosine."""
    return X.similar_items(_dish_model(spark, sf).weights, 5)


def _hybrid_sql(baskets: str, exclude: str | None, n: int = 5) -> str:
    ex_c = (f" AND NOT EXISTS (SELECT 1 FROM {exclude} z WHERE z.basket = c.basket AND z.item = c.item)"
            if exclude else "")
    ex_t = (f" AND NOT EXISTS (SELECT 1 FROM {exclude} z WHERE z.basket = bb.basket AND z.item = s.other)"
            if exclude else "")
    cooc = _REC_COOC.format(baskets=baskets, extra=ex_c, n=2 * n)
    return f"""SELECT basket, item, score, cooccurrence_score, content_score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY basket ORDER BY score DESC, item) AS INTEGER) AS rank FROM (
    SELECT basket, item,
      round_even(0.6 * CASE WHEN mc > 0 THEN cooc / mc ELSE 0.0 END + 0.4 * CASE WHEN mt > 0 THEN content / mt ELSE 0.0 END, 4)
        AS score, round_even(cooc, 4) AS cooccurrence_score, round_even(content, 4) AS content_score
    FROM (SELECT *, max(cooc) OVER (PARTITION BY basket) AS mc, max(content) OVER (PARTITION BY basket) AS mt FROM (
      SELECT COALESCE(c.basket, t.basket) AS basket, COALESCE(c.item, t.item) AS item,
             COALESCE(c.score, 0.0) AS cooc, COALESCE(t.content, 0.0) AS content
      FROM ({cooc}) c FULL OUTER JOIN (
        SELECT basket, item, max(score) AS content FROM (
          SELECT bb.basket, bb.item AS src, s.other AS item, s.score,
                 row_number() OVER (PARTITION BY bb.basket, bb.item ORDER BY s.score DESC, s.other) AS r
          FROM {baskets} bb JOIN sim s ON bb.item = s.item
          WHERE NOT EXISTS (SELECT 1 FROM {baskets} y WHERE y.basket = bb.basket AND y.item = s.other){ex_t})
        WHERE r <= {n} GROUP BY 1, 2) t ON c.basket = t.basket AND c.item = t.item))))
WHERE rank <= {n}"""


_SIM_ALL = """SELECT a.doc AS item, b.doc AS other, round_even(SUM(a.w * b.w), 4) AS score FROM wts a JOIN wts b
  ON a.term = b.term AND a.doc <> b.doc GROUP BY 1, 2"""


def _all_similar(spark, sf):
    """All positive dish similarities (the content side of the hybrid)."""
    return X.cosine_neighbours(_dish_model(spark, sf).weights)


@register("b07_recommend_hybrid", with_views(_hybrid_sql("bi", None), "tx",
                                             extra={**_BASKET_CTES, **_DISH_TFIDF, "sim": _SIM_ALL}))
def b07(spark, sf):
    """B7 hybrid (0.6 co-occurrence + 0.4 content) top 5 for every order basket."""
    baskets = _kept(_order_baskets(spark, sf))
    edges = B.association_edges(B.cooccurrence(baskets, 5, "basket", "item", name=None))
    return B.recommend_hybrid(baskets, written(edges), written(_all_similar(spark, sf)), 5)


_CUST_CTES = {
    "recent": """SELECT customer_id AS basket, item_name AS item FROM (SELECT customer_id, item_name,
  row_number() OVER (PARTITION BY customer_id ORDER BY max(ts) DESC, item_name) AS r FROM tx
  WHERE customer_id IS NOT NULL GROUP BY 1, 2) WHERE r <= 10""",
    "bought": "SELECT DISTINCT customer_id AS basket, item_name AS item FROM tx WHERE customer_id IS NOT NULL",
}


@register("b08_recommend_for_customers", with_views(f"""
SELECT basket AS customer_id, item, score, rank, 'hybrid' AS method FROM ({_hybrid_sql('recent', 'bought')})
UNION ALL
SELECT c.customer_id, p.item, p.score, p.rank, 'popular' FROM cu c
JOIN (SELECT item, score, CAST(row_number() OVER (ORDER BY score DESC, item) AS INTEGER) AS rank FROM (
  SELECT src AS item, CAST(SUM(n) AS DOUBLE) AS score FROM edges GROUP BY 1 ORDER BY score DESC, item LIMIT 5)) p ON TRUE
WHERE c.customer_id NOT IN (SELECT basket FROM bought)""", "tx", "cu",
                                                   extra={**_BASKET_CTES, **_DISH_TFIDF, "sim": _SIM_ALL,
                                                          **_CUST_CTES}))
def b08(spark, sf):
    """B8 per-customer hybrid recommendations (last 10 dishes as basket,
    everything bought excluded), popular dishes for customers without history."""
    tx = _tx(spark, sf)
    tx = _kept(tx.select("customer_id", "item_name", "ts"))
    return B.recommend_for_customers(tx, written(_edges(spark, sf)), written(_all_similar(spark, sf)), D.customers(spark, sf),
                                     5, 10, item="item_name")


@register("b09_user_item", with_views("""
SELECT customer_id AS user, item_name AS item, CAST(SUM(quantity) AS BIGINT) AS value FROM tx
WHERE customer_id IS NOT NULL GROUP BY 1, 2""", "tx"))
def b09(spark, sf):
    """B9 customer x dish quantity matrix (long form)."""
    return B.user_item(_tx(spark, sf), item="item_name")


@register("b09_user_item_implicit", with_views("""
SELECT DISTINCT customer_id AS user, item_name AS item, CAST(1 AS BIGINT) AS value FROM tx
WHERE customer_id IS NOT NULL""", "tx"))
def b09i(spark, sf):
    """B9 implicit (0/1) customer x dish matrix."""
    return B.user_item(_tx(spark, sf), implicit=True, item="item_name")


@register("b10_item_cosine", with_views("""
SELECT d.x1 AS item_1, d.x2 AS item_2, round_even(d.dot / (n1.norm * n2.norm), 6) AS cosine FROM (
  SELECT a.item AS x1, b.item AS x2, SUM(CAST(a.value AS DOUBLE) * CAST(b.value AS DOUBLE)) AS dot
  FROM ui a JOIN ui b ON a.user = b.user AND a.item < b.item GROUP BY 1, 2) d
JOIN (SELECT item, sqrt(SUM(CAST(value AS DOUBLE) * CAST(value AS DOUBLE))) AS norm FROM ui GROUP BY 1) n1 ON d.x1 = n1.item
JOIN (SELECT item, sqrt(SUM(CAST(value AS DOUBLE) * CAST(value AS DOUBLE))) AS norm FROM ui GROUP BY 1) n2 ON d.x2 = n2.item""",
                                        "tx", extra={"ui": """SELECT customer_id AS user, item_name AS item,
  SUM(quantity) AS value FROM tx WHERE customer_id IS NOT NULL GROUP BY 1, 2"""}))
def b10(spark, sf):
    """B10 dish-dish cosine over customer quantity vectors."""
    return B.cosine_pairs(B.user_item(_tx(spark, sf), item="item_name"), "item")


@register("b12_content_scores", with_views("""
SELECT c.basket AS user, c.item, round_even((COALESCE(cm.cm, 0.0) + f.p * t.pm) / (f.norm * t.nb), 6) AS content_score
FROM (SELECT basket, item FROM (""" + _REC_COOC.format(baskets="bought", extra="", n=5) + """)) c
JOIN feat f ON c.item = f.item
JOIN (SELECT b.basket, COUNT(*) AS nb, SUM(f.p / f.norm) AS pm FROM bought b JOIN feat f ON b.item = f.item
      GROUP BY 1) t ON c.basket = t.basket
LEFT JOIN (SELECT b.basket, f.category, SUM(1 / f.norm) AS cm FROM bought b JOIN feat f ON b.item = f.item
      GROUP BY 1, 2) cm ON c.basket = cm.basket AND f.category = cm.category""", "tx",
                                            extra={**_BASKET_CTES, **_CUST_CTES, "dishes": _DISHES,
                                                   "feat": """SELECT id AS item, category, p, sqrt(1 + p * p) AS norm FROM (
  SELECT id, category, CASE WHEN hi > lo THEN (price - lo) / (hi - lo) ELSE 0.0 END AS p FROM dishes,
  (SELECT min(price) AS lo, max(price) AS hi FROM dishes))"""}))
def b12(spark, sf):
    """B12 content score (category one-hot + scaled price) of each customer's
    co-occurrence candidates against the dishes they bought."""
    tx = _tx(spark, sf)
    bought = (tx.where(F.col("customer_id").isNotNull())
              .select(F.col("customer_id").alias("basket"), F.col("item_name").alias("item")).distinct())
    cand = B.recommend_cooccurrence(bought, _edges(spark, sf), 5).select(F.col("basket").alias("user"), "item")
    return B.content_scores(cand, bought.withColumnRenamed("basket", "user"), dishes(spark, sf))


@register("b13_ranking_metrics", with_views("""
SELECT COUNT(*) AS n_users, round_even(avg(hits / 5.0), 6) AS precision_at_5, round_even(avg(hits / n_rel), 6) AS recall_at_5,
  round_even(avg(dcg / idcg), 6) AS ndcg_at_5, round_even(avg(CAST(hits > 0 AS DOUBLE)), 6) AS hit_rate,
  round_even(avg(ap_sum / least(n_rel, 5)), 6) AS map, round_even((SELECT COUNT(DISTINCT item) FROM recs) / (SELECT CAST(COUNT(DISTINCT p_name) AS DOUBLE) FROM part), 6) AS coverage
FROM (SELECT r.user, r.n_rel, COALESCE(h.hits, 0) AS hits, COALESCE(h.dcg, 0.0) AS dcg, COALESCE(h.ap_sum, 0.0) AS ap_sum,
        (SELECT SUM(1 / log2(i + 1)) FROM range(1, least(r.n_rel, 5) + 1) t(i)) AS idcg
      FROM (SELECT user, COUNT(*) AS n_rel FROM rel GROUP BY 1) r LEFT JOIN (
        SELECT user, SUM(relv) AS hits, SUM(relv / log2(rank + 1)) AS dcg,
               SUM(CASE WHEN relv = 1 THEN so_far / rank END) AS ap_sum FROM (
          SELECT recs.user, recs.rank, CASE WHEN rel.item IS NULL THEN 0 ELSE 1 END AS relv,
                 SUM(CASE WHEN rel.item IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY recs.user ORDER BY recs.rank
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
          FROM recs LEFT JOIN rel ON recs.user = rel.user AND recs.item = rel.item) GROUP BY 1) h ON r.user = h.user)""",
                                             "tx", extra={
    "cut": "SELECT quantile_disc(CAST(ts AS DATE), 0.8) AS d FROM tx WHERE customer_id IS NOT NULL",
    "bi": _BI + " WHERE customer_id IS NOT NULL AND CAST(ts AS DATE) < (SELECT d FROM cut)",
    "pairs": _PAIRS, "edges": _EDGES,
    "hist": "SELECT DISTINCT customer_id AS basket, item_name AS item FROM tx WHERE customer_id IS NOT NULL "
            "AND CAST(ts AS DATE) < (SELECT d FROM cut)",
    "recs": "SELECT basket AS user, item, rank FROM (" + _REC_COOC.format(baskets="hist", extra="", n=5) + ")",
    "rel": "SELECT DISTINCT customer_id AS user, item_name AS item FROM tx WHERE customer_id IS NOT NULL "
           "AND CAST(ts AS DATE) >= (SELECT d FROM cut)"}))
def b13(spark, sf):
    """B13 precision/recall/NDCG/hit-rate/MAP@5 and coverage of co-occurrence
    recommendations: edges and baskets from the history alone, dishes bought
    in the last fifth of the sales (from the day that holds the 80 % point)."""
    tx = _tx(spark, sf).where(F.col("customer_id").isNotNull())
    # distinct days only: a bounded value map
    day = F.unix_date(F.to_date("ts"))
    cut = tx.agg(F.expr("percentile_disc(0.8) WITHIN GROUP (ORDER BY unix_date(to_date(ts)))").alias("d")).scalar()
    old = tx.where(day < cut)
    hist = old.select(F.col("customer_id").alias("basket"), F.col("item_name").alias("item")).distinct()
    edges = B.association_edges(B.cooccurrence(old, 5, "order_id", "item_name", name=None))
    recs = B.recommend_cooccurrence(hist, edges, 5).select(F.col("basket").alias("user"), "item", "rank")
    rel = (tx.where(day >= cut)
           .select(F.col("customer_id").alias("user"), F.col("item_name").alias("item")))
    n_items = D.read(spark, sf, "part").select(F.countDistinct("p_name")).scalar()
    return B.ranking_metrics(recs, rel, 5, n_items=n_items)
