"""Streamed order status and payments: several batches, late and repeated rows, restarts, compaction."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tavola.operators import ledger as L
from tavola.streaming import deltas
from tavola.streaming import order_status as OS
from tavola.streaming import payments as P

EVENT = "order_id long, event_id long, ts timestamp_ntz, status string"
DAY0 = dt.datetime(2024, 1, 1)
STATUSES = ["pending", "confirmed", "preparing", "ready", "delivered", "completed", "cancelled"]


def land(spark, folder, name, rows, schema):
    """One more file of the stream, in place at once."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}-{name}")
    part = next(f for f in os.listdir(f"{folder}-{name}") if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.link(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def history(seed, n=120):
    """Events of six orders, one of them with half of all; ids in time order."""
    rng = random.Random(seed)
    return [(1 if rng.random() < 0.5 else rng.randrange(2, 7), k, DAY0 + dt.timedelta(hours=k), rng.choice(STATUSES)) for k in range(n)]


def test_fold_checks_every_step():
    state, bad = OS.fold(OS.NOTHING, [(1, 1, "pending"), (2, 2, "confirmed"), (3, 3, "confirmed"), (4, 4, "completed"), (5, 5, "pending"),
                                      (6, 6, "completed")], L.TRANSITIONS)
    assert state == {"status": "completed", "completed_at": 4, "n": 6}
    assert bad == [(4, 4, "confirmed", "completed"), (5, 5, "completed", "pending"), (6, 6, "pending", "completed")]


def test_order_stream_equals_the_batch(spark, tmp_path):
    rows = history(1)
    src, state, ckpt = (str(tmp_path / x) for x in ("src", "state", "ckpt"))
    batches = [rows[k:k + 20] for k in range(0, 120, 20)]
    for a, b in ((0, 1), (2, 3)):  # out of order within the delay: the tail of one batch comes with the next
        batches[b] = batches[b] + batches[a][-6:]
        batches[a] = batches[a][:-6]
    batches[3] += batches[3][-3:] + batches[2][-2:]  # repeated rows
    batches[4].append((None, 999, DAY0, "pending"))
    for k, batch in enumerate(batches):
        land(spark, src, f"b{k}", batch, EVENT)
        # a new run from the checkpoint each time: a restart between all batches
        OS.start_order_stream(stream(spark, src, EVENT), state, ckpt, "12 hours").awaitTermination()
        if k == 3:
            OS.compact_orders(spark, state)
            assert len(os.listdir(f"{state}/base")) == 1 and not [f for f in os.listdir(f"{state}/deltas") if f.startswith("epoch")]
    all_events = spark.createDataFrame(rows, EVENT)
    assert as_set(OS.orders_now(spark, state)) == as_set(L.order_state(all_events))
    want = L.illegal_transitions(all_events).select("order_id", "event_id", "ts", "from_status", "to_status")
    assert as_set(OS.illegal_now(spark, state)) == as_set(want)
    settled = deltas.read(spark, state).where(F.size("settled") > 0).count()
    assert settled  # the watermark passed events while the stream ran


def test_events_behind_the_watermark_are_dropped(spark, tmp_path):
    src, state, ckpt = (str(tmp_path / x) for x in ("src", "state", "ckpt"))
    first = [(1, 1, DAY0, "pending"), (1, 2, DAY0 + dt.timedelta(days=10), "confirmed")]
    land(spark, src, "a", first, EVENT)
    OS.start_order_stream(stream(spark, src, EVENT), state, ckpt, "1 day").awaitTermination()
    land(spark, src, "b", [(1, 3, DAY0 + dt.timedelta(days=1), "cancelled"), (1, 1, DAY0, "pending"),
                           (1, 4, DAY0 + dt.timedelta(days=10, hours=1), "preparing")], EVENT)
    OS.start_order_stream(stream(spark, src, EVENT), state, ckpt, "1 day").awaitTermination()
    assert [(r.status, r.n_events) for r in OS.orders_now(spark, state).collect()] == [("preparing", 3)]
    assert OS.illegal_now(spark, state).count() == 0


def test_replayed_epoch_replaces_its_rows(spark, tmp_path):
    write = deltas.writer(str(tmp_path))
    write(spark.range(3).toDF("n"), 0)
    write(spark.range(5).toDF("n"), 1)
    write(spark.range(4).toDF("n"), 1)  # the same epoch again
    assert deltas.read(spark, str(tmp_path)).count() == 7
    fold = lambda rows: rows.groupBy().agg(F.sum("n").alias("n"), F.max("epoch").alias("epoch"))
    deltas.compact(spark, str(tmp_path), fold)
    write(spark.range(2).toDF("n"), 2)
    assert sorted(r.n for r in deltas.read(spark, str(tmp_path)).collect()) == [0, 1, 9]
    deltas.compact(spark, str(tmp_path), fold)
    deltas.compact(spark, str(tmp_path), fold)  # nothing since: no change
    assert [r.n for r in deltas.read(spark, str(tmp_path)).collect()] == [10]
    with pytest.raises(FileNotFoundError):
        deltas.read(spark, str(tmp_path / "none"))


ORDER = "order_id long, ordered_at timestamp_ntz, subtotal decimal(18,2), tax_amount decimal(18,2), discount_amount decimal(18,2), status string"
PAY = "payment_id long, order_id long, paid_at timestamp_ntz, tip_amount decimal(18,2)"


def test_payments_meet_orders(spark, tmp_path):
    from decimal import Decimal as Dec
    h = lambda k: DAY0 + dt.timedelta(hours=k)
    orders = [(k, h(k), Dec(10 * k), Dec(1), Dec(0), "ready") for k in range(1, 9)]
    pays = [(100 + k, k % 6 + 1, h(k + 1), Dec("0.50")) for k in range(12)]
    late_order = [(9, h(2), Dec(90), Dec(1), Dec(0), "ready")]
    osrc, psrc, state, ckpt = (str(tmp_path / x) for x in ("orders", "pays", "state", "ckpt"))
    steps = [(orders[:5], pays[:4]), (orders[5:], pays[3:8]), (late_order, pays[7:] + [(200, 9, h(13), Dec(2)), (201, 77, h(13), Dec(1))])]
    for k, (o, p) in enumerate(steps):  # payments before their orders, and repeated ones
        land(spark, osrc, f"o{k}", o, ORDER)
        land(spark, psrc, f"p{k}", p, PAY)
        P.start_payment_stream(stream(spark, osrc, ORDER), stream(spark, psrc, PAY), state, ckpt, "2 days").awaitTermination()
        if k == 1:
            P.compact_payments(spark, state)
    o = spark.createDataFrame(orders + late_order, ORDER).withColumn("total", F.col("subtotal") + F.col("tax_amount"))
    p = spark.createDataFrame(pays + [(200, 9, h(13), Dec(2))], PAY)
    assert as_set(P.orders_with_payments(spark, o, state)) == as_set(L.apply_payments(o, p))


def test_payment_counts(spark, tmp_path):
    from decimal import Decimal as Dec
    src, state, ckpt = (str(tmp_path / x) for x in ("src", "state", "ckpt"))
    pays = [(k, k % 4, DAY0 + dt.timedelta(hours=k), Dec(1)) for k in range(10)]
    for k, part in enumerate((pays[:6], pays[4:])):
        land(spark, src, f"p{k}", part, PAY)
        P.start_payment_counts(stream(spark, src, PAY), ["order_id"], state, ckpt, "2 days").awaitTermination()
    P.compact_counts(spark, state, ["order_id"])
    want = L.duplicate_payments(spark.createDataFrame(pays, PAY))
    assert as_set(P.duplicates_now(spark, state, ["order_id"])) == as_set(want)
