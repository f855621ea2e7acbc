"""Sources, sinks and the streaming ledgers."""

import os
import tempfile

from pyspark.sql import functions as F

from tavola.operators import ledger as L
from tavola.plans import q_ledger
from tavola.sources import driver as D
from tavola.sources import io
from tavola.streaming import ledgers as SL

from .conftest import SF_SMALL


def _scratch(spark):
    from tavola.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return tempfile.mkdtemp(prefix="tavola-test-", dir=base if base.startswith("/") else None)


def test_import_menu_splits_valid_and_rejected(spark):
    d = _scratch(spark)
    path = os.path.join(d, "menu.csv")
    with open(path, "w") as f:
        f.write('name,description,price,cost,category,is_active\n'
                '"Soup, hot",tomato,5.5,2,Starters,true\n'
                ',no name,4,,Mains,true\n'
                'Cake,,abc,1,Desserts,false\n'
                'Tea,,3,oops,Drinks,FALSE\n')
    valid, bad = io.import_menu(spark, path)
    v = {r.name: r for r in valid.collect()}
    assert set(v) == {"Soup, hot", "Tea"}
    assert v["Tea"].cost == 3 * 0.4 and v["Tea"].is_active is False
    errs = {r.description: r.errors for r in bad.collect()}
    assert errs["no name"] == ["Name is required"] and errs[""] == ["Invalid price"]


def test_menu_loader_parses_json_lists(spark):
    d = _scratch(spark)
    path = os.path.join(d, "menu_items.csv")
    with open(path, "w") as f:
        f.write("item_id,name,allergens\nI1,Soup,\"[\"\"gluten\"\"]\"\nI2,Tea,\n")
    df = io.load_menu_items(spark, path)
    got = {r.item_id: r.allergens for r in df.collect()}
    assert got == {"I1": ["gluten"], "I2": []} and "item_name" in df.columns


def test_write_and_model_roundtrip(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    d = _scratch(spark)
    df = D.menu_items(spark, SF_SMALL).select("id", "price", "prep_time_minutes")
    io.write_table(df.withColumn("bucket", F.col("prep_time_minutes") % 5), os.path.join(d, "t"), ["bucket"])
    assert spark.read.parquet(os.path.join(d, "t")).count() == df.count()
    model = Pipeline(stages=[VectorAssembler(inputCols=["price"], outputCol="v")]).fit(df)
    io.save_model(model, os.path.join(d, "m"), {"kind": "test"})
    m2, meta = io.load_model(os.path.join(d, "m"))
    assert meta == {"kind": "test"} and m2.transform(df).count() == df.count()
    emb = D.read(spark, SF_SMALL, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    io.save_embeddings(emb, os.path.join(d, "e"))
    assert io.load_embeddings(spark, os.path.join(d, "e")).count() == emb.count()


def test_loyalty_stream_matches_batch(spark):
    d = _scratch(spark)
    q = SL.start_loyalty_stream(spark, os.path.join(SF_SMALL, "events.parquet"), os.path.join(d, "state"),
                                os.path.join(d, "ckpt"))
    q.awaitTermination(300)
    streamed = SL.loyalty_from_deltas(spark, D.customers(spark, SF_SMALL), os.path.join(d, "state"))
    batch = q_ledger.l02(spark, SF_SMALL)
    cols = sorted(batch.columns)
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0


def test_stock_stream_matches_batch(spark):
    d = _scratch(spark)
    q = SL.start_stock_stream(spark, os.path.join(SF_SMALL, "events.parquet"), os.path.join(d, "state"),
                              os.path.join(d, "ckpt"), q_ledger.EVENT_STOCK_DELTA)
    q.awaitTermination(300)
    streamed = SL.stock_from_deltas(spark, D.inventory(spark, SF_SMALL), os.path.join(d, "state"))
    batch = q_ledger.l03(spark, SF_SMALL)
    cols = sorted(batch.columns)
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
