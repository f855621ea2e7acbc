"""Hand-sized exact cases taken from the reference's own tests (FIXTURES.md §2)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tavola.functions.money import tax
from tavola.functions.timeutil import is_weekend
from tavola.operators import basket as B
from tavola.operators import forecast as FC
from tavola.operators import ledger as L
from tavola.operators import quality as Q
from tavola.operators import text as X
from tavola.operators import windows as W


def test_weekend_flags(spark):
    days = [(dt.date(2024, 1, d),) for d in range(1, 8)]
    df = spark.createDataFrame(days, "date date")
    got = [r[0] for r in df.orderBy("date").select(is_weekend("date")).collect()]
    assert got == [False] * 5 + [True, True]


def test_lag_values(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([10, 20, 30, 40, 50])], "date int, value double")
    out = W.lag_features(df, "value", [1, 2]).orderBy("date").collect()
    assert [r.value_lag_1 for r in out] == [None, 10, 20, 30, 40]
    assert [r.value_lag_2 for r in out] == [None, None, 10, 20, 30]


def test_grouped_lag(spark):
    rows = [("A", i, float(i + 1)) for i in range(4)] + [("B", i, float(10 * (i + 1))) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, date int, v double")
    out = W.lag_features(df, "v", [1], key="k").where("k = 'A'").orderBy("date").collect()
    assert [r.v_lag_1 for r in out] == [None, 1, 2, 3]


def test_mae_is_14(spark):
    df = spark.createDataFrame(list(zip([100, 200, 300, 400, 500], [110, 190, 310, 380, 520])), "y int, p int")
    m = FC.regression_metrics(df, "y", "p").collect()[0]
    assert m.mae == 14.0
    assert m.r2 > 0.9 and m.mape < 10


def test_precision_recall_hit_rate(spark):
    recs = spark.createDataFrame([("u1", f"I00{i}", i) for i in range(1, 6)], "user string, item string, rank int")
    rel = spark.createDataFrame([("u1", x) for x in ["I001", "I003", "I005", "I007"]], "user string, item string")
    m = B.ranking_metrics(recs, rel, 5).collect()[0]
    assert m.precision_at_5 == 0.6
    assert m.recall_at_5 == 0.75
    assert 0 <= m.ndcg_at_5 <= 1
    recs3 = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("c", "z", 1)], "user string, item string, rank int")
    rel3 = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "q")], "user string, item string")
    assert abs(B.ranking_metrics(recs3, rel3, 1).collect()[0].hit_rate - round(2 / 3, 6)) < 1e-9


def test_order_total_49(spark):
    lines = spark.createDataFrame([(1, 2 * 15.0), (1, 1 * 20.0)], "order_id int, total_price double")
    t = L.order_totals(lines).withColumn("tax8", tax("subtotal", __import__("decimal").Decimal("0.08")))
    r = t.collect()[0]
    assert float(r.subtotal) == 50.0 and float(r.tax8) == 4.0
    assert float(r.subtotal) + float(r.tax8) - 5.0 == 49.0
    assert float(r.tax_amount) == 4.25  # 8.5 % server rate, half-even to cents


def test_status_transitions(spark):
    ev = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1, 10), "confirmed"),
                                (1, 2, dt.datetime(2024, 1, 1, 11), "preparing"),
                                (2, 3, dt.datetime(2024, 1, 1, 10), "confirmed"),
                                (2, 4, dt.datetime(2024, 1, 1, 11), "completed")],
                               "order_id int, event_id int, ts timestamp, status string")
    bad = L.illegal_transitions(ev).collect()
    assert [(r.order_id, r.from_status, r.to_status) for r in bad] == [(2, "confirmed", "completed")]
    st = {r.order_id: (r.status, r.completed_at) for r in L.order_state(ev).collect()}
    assert st[1][0] == "preparing" and st[2][0] == "completed" and st[2][1] is not None


def test_alerts_and_degradation(spark):
    m = spark.createDataFrame([("m", "mape", 12.5), ("m", "rmse", 3.0)], "key string, metric string, value double")
    lim = spark.createDataFrame([("mape", 10.0), ("rmse", 5.0)], "metric string, max_value double")
    assert Q.metric_alerts(m, lim).count() == 1
    base = spark.createDataFrame([("m", "mae", 5.0)], "key string, metric string, value double")
    cur = spark.createDataFrame([("m", "mae", 8.5)], "key string, metric string, value double")
    r = Q.degradation_alerts(base, cur, 0.5).collect()[0]
    assert r.degradation == 0.7 and r.degraded


def test_chunks(spark):
    text = """
        Our restaurant offers a wide variety of dishes.
        We specialize in Italian and Mediterranean cuisine.
        Our chef has 20 years of experience.
        We use only fresh, locally sourced ingredients.
        Our signature dish is the truffle risotto.
        We offer both dine-in and takeaway options.
        """
    df = spark.createDataFrame([(1, text)], "id int, text string")
    chunks = [r.chunk for r in X.chunk_sentences(df, "id", "text").orderBy("pos").collect()]
    assert len(chunks) == 6 and all(chunks)
    assert chunks[0] == "Our restaurant offers a wide variety of dishes"


def test_pack_context_skips_and_keeps_later(spark):
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "query string, rank int, doc bigint")
    texts = spark.createDataFrame([(1, "w " * 2000), (2, "w " * 2000), (3, "w " * 500)], "doc bigint, text string")
    got = [(r.doc, r.tokens) for r in X.pack_context(ranked, texts, budget=4000).orderBy("rank").collect()]
    assert got == [(1, 2600), (3, 650)]


def test_intents_multi(spark):
    df = spark.createDataFrame([("I'd like to order a pizza and make a reservation for tomorrow",)], "text string")
    tags = X.tag_intents(df, "text").collect()[0].intents
    assert "order" in tags and "reservation" in tags
    topic = X.route_topic(spark.createDataFrame([("Do you have anything spicy?",)], "text string"), "text")
    assert topic.collect()[0].topic == "spicy"


def test_rolling_strict_nulls_until_full(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "date int, v double")
    out = W.rolling_features(df, "v", [7], strict=True).orderBy("date").collect()
    assert all(r.v_rolling_mean_7 is None for r in out[:7])
    assert math.isclose(out[7].v_rolling_mean_7, 3.0)
