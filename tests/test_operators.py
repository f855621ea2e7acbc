"""Operator invariants and skew paths."""

from pyspark.sql import functions as F

from tavola.operators import basket as B
from tavola.operators import search as S
from tavola.operators import text as X
from tavola.sources import driver as D

from .conftest import SF_SMALL


def test_cooccurrence_grid_split_is_exact(spark):
    tx = D.transactions(spark, SF_SMALL)
    plain = B.cooccurrence(tx, 1, "order_id", "item_name", name=None)
    salted = B.cooccurrence(tx, 1, "order_id", "item_name", name=None, hot_items=2)
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


def test_hot_basket_is_split(spark):
    rows = [(1, f"i{j}") for j in range(40)] + [(2, "i1"), (2, "i2")]
    tx = spark.createDataFrame(rows, "order_id int, item_id string")
    pairs = B.item_pairs(B.basket_items(tx), hot_items=8)
    assert pairs.count() == 40 * 39 // 2
    assert pairs.where("item_a = 'i1' AND item_b = 'i2'").collect()[0].n == 2


def test_edges_symmetric_and_no_basket_items_recommended(spark):
    tx = D.transactions(spark, SF_SMALL)
    pairs = B.cooccurrence(tx, 2, "order_id", "item_name", name=None)
    e = B.association_edges(pairs)
    assert e.select("src", "dst").exceptAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).count() == 0
    bk = B.basket_items(tx, "order_id", "item_name")
    recs = B.recommend_cooccurrence(bk, e, 5)
    assert recs.join(bk, ["basket", "item"]).count() == 0


def test_match_items_rules(spark):
    items = spark.createDataFrame([(1, "Red Widget"), (2, "Blue Bolt"), (3, "Small Red Ring")], "id long, name string")
    q = spark.createDataFrame([("a", "red widget!"), ("b", "bolt"), ("c", "ring small"), ("d", "zzz")],
                              "query_id string, query string")
    got = {r.query_id: (r.item_id, r.rule) for r in S.match_items(q, items).collect()}
    assert got == {"a": (1, 1), "b": (2, 2), "c": (3, 3)}


def test_tfidf_weights_are_unit_norm(spark):
    docs = spark.createDataFrame([(1, "spicy chicken wings with hot sauce"), (2, "chocolate cake dessert"),
                                  (3, "spicy vegan curry")], "id long, text string")
    m = X.tfidf(docs, "id", "text", 100)
    norms = m.weights.groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert all(abs(r.n - 1.0) < 1e-9 for r in norms)
    sim = X.similar_items(m.weights, 2).where("item = 1").collect()
    assert sim[0].other == 3


def test_search_vectors_blocks_agree(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    vecs = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(60)]
    v = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    q = v.where("vec_id < 10").withColumnRenamed("vec_id", "query")
    one = X.search_vectors(q, v, 3, max_block=1024)
    many = X.search_vectors(q, v, 3, max_block=3)
    assert one.exceptAll(many).count() == 0
    top = one.where("rank = 1").collect()
    assert all(r.query == r.vec_id for r in top)
