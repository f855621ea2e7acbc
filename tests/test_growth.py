"""What a task holds and how often the sales are read does not grow with the tables."""

import datetime

from pyspark.sql import functions as F

from tavola.operators import customers as C
from tavola.plans import q_ml
from tavola.sources import driver as D


def _tables(spark, folder, orders=300, lines=4):
    day = datetime.datetime(2001, 1, 1)
    o = [(k, k % 20, day + datetime.timedelta(days=k % 200), "F", 10.0, "1-URGENT") for k in range(orders)]
    spark.createDataFrame(o, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderstatus string, "
                             "o_totalprice double, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    li = [(k, n, (k + n) % 7, 0, 1.0 + n, 5.0, 0.0) for k in range(orders) for n in range(lines)]
    spark.createDataFrame(li, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                              "l_extendedprice double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, f"dish {k}", "A", "B") for k in range(7)],
                          "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(k, f"c{k}", 0, "S", 100.0) for k in range(20)],
                          "c_custkey long, c_name string, c_nationkey long, c_mktsegment string, c_acctbal double"
                          ).write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "N", 0)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{folder}/nation.parquet")
    return str(folder)


def test_sales_of_large_tables_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    sf = _tables(spark, tmp_path / "t")
    whole = sorted(map(repr, D.transactions(spark, sf).collect()))
    monkeypatch.setattr(D, "SALES_ROWS", 20, raising=False)
    monkeypatch.setattr(D, "SALES_TASKS", 4, raising=False)
    tx = D.transactions(spark, sf)
    assert tx.select(F.spark_partition_id().alias("p")).distinct().count() > 30  # of 60, some may hold no order
    assert sorted(map(repr, tx.collect())) == whole


def test_feature_tables_are_made_once_a_session(spark, tmp_path):
    sf = _tables(spark, tmp_path / "t")
    for made in (q_ml._churn_data, q_ml._seg, q_ml._features, q_ml._ltv_table):
        first, again = made(spark, sf), made(spark, sf)
        assert "lineitem" not in str(first.inputFiles()) and sorted(first.inputFiles()) == sorted(again.inputFiles())
        assert first.count() > 0


def test_sales_are_joined_once_for_all_customer_models(spark, tmp_path, monkeypatch):
    sf = _tables(spark, tmp_path / "t")
    read, whole = [], D.transactions
    monkeypatch.setattr(q_ml.D, "transactions", lambda *a, **k: read.append(a) or whole(*a, **k))
    for made in (q_ml.c03c, q_ml.c03d, q_ml.c04d, q_ml.c04e, q_ml.j07, q_ml.c06):
        made(spark, sf).collect()
    assert len(read) == 1


def test_customer_features_of_a_given_base(spark, tmp_path):
    sf = _tables(spark, tmp_path / "t")
    tx = D.transactions(spark, sf, dims=False)
    tx = tx.unionByName(tx.limit(5).withColumn("customer_id", F.lit(None).cast("long")))
    as_of, base = "2001-08-02", C.customer_base(tx, with_calendar=True)
    for f in (C.rfm_metrics, C.ltv_features):
        assert sorted(map(repr, f(tx, as_of).collect())) == sorted(map(repr, f(tx, as_of, base=lambda: base).collect()))
    assert C.churn_features(tx, as_of).exceptAll(C.churn_features(tx, as_of, base=lambda: base)).count() == 0
    last = base.select("customer_id", F.col("last_ts").alias("ts"))
    assert sorted(map(repr, C.churn_labels(tx, as_of).collect())) == sorted(map(repr, C.churn_labels(last, as_of).collect()))
