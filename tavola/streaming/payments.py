"""Payments as Structured Streaming jobs.

Payments arrive late and more than once; ``dropDuplicatesWithinWatermark`` forgets
a payment's id when the watermark has passed it.  L6 joins the stream of orders
with the stream of payments: both sides wait in the state store until the other
comes, and with ``within`` until the watermarks say it cannot come any more.  Each
epoch leaves one row an order (tips and number of payments, ``deltas.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from . import deltas


def once(payments: DataFrame, delay: str = "1 day", key: str = "payment_id", at: str = "paid_at") -> DataFrame:
    """Each payment id once; rows without id or time take no part."""
    known = payments.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    return known.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def paid(orders: DataFrame, payments: DataFrame, delay: str = "1 day", within: str | None = None) -> DataFrame:
    """Payments that meet their order: ``order_id``, ``payment_id``, ``tip_amount``.

    ``orders`` has order_id and ordered_at, ``payments`` order_id, payment_id,
    paid_at and tip_amount.  ``within``: a payment counts only so long after its
    order, which bounds the state; without it orders wait for ever."""
    o = (orders.select(F.col("order_id").alias("_order"), F.col("ordered_at").cast("timestamp").alias("ordered_at"))
         .where("_order IS NOT NULL AND ordered_at IS NOT NULL").withWatermark("ordered_at", delay))
    p = once(payments, delay)
    met = F.col("order_id") == F.col("_order")
    if within:
        met = met & (F.col("paid_at") >= F.col("ordered_at")) & (F.col("paid_at") <= F.col("ordered_at") + F.expr(f"INTERVAL {within}"))
    return p.join(o, met, "inner").select("order_id", "payment_id", "tip_amount")


def _run(rows: DataFrame, prepare, state_path: str, checkpoint: str, available_now: bool):
    w = rows.writeStream.outputMode("append").foreachBatch(deltas.writer(state_path, prepare)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def start_payment_stream(orders: DataFrame, payments: DataFrame, state_path: str, checkpoint: str, delay: str = "1 day",
                         within: str | None = None, available_now: bool = True):
    """Join the two streams into tips and payments an order and epoch."""
    def each(batch: DataFrame) -> DataFrame:
        return batch.groupBy("order_id").agg(F.sum(F.col("tip_amount").cast("decimal(18,2)")).alias("tip_amount"),
                                             F.count(F.lit(1)).alias("n"))
    return _run(paid(orders, payments, delay, within), each, state_path, checkpoint, available_now)


def start_payment_counts(payments: DataFrame, keys: Sequence[str], state_path: str, checkpoint: str, delay: str = "1 day",
                         available_now: bool = True):
    """Payments for each key and epoch."""
    return _run(once(payments, delay), lambda batch: batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")),
                state_path, checkpoint, available_now)


def compact_payments(spark: SparkSession, state_path: str) -> None:
    deltas.compact(spark, state_path, lambda rows: rows.groupBy("order_id").agg(
        F.sum("tip_amount").cast("decimal(28,2)").alias("tip_amount"), F.sum("n").alias("n"), F.max("epoch").alias("epoch")))


def compact_counts(spark: SparkSession, state_path: str, keys: Sequence[str]) -> None:
    deltas.compact(spark, state_path, lambda rows: rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("epoch").alias("epoch")))


def duplicates_now(spark: SparkSession, state_path: str, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one payment so far."""
    return (deltas.read(spark, state_path).groupBy(*keys).agg(F.sum("n").alias("n_payments")).where("n_payments > 1"))


def orders_with_payments(spark: SparkSession, orders: DataFrame, state_path: str) -> DataFrame:
    """Every order with the payments that have met it so far, as ``ledger.apply_payments``."""
    return L.apply_payments(orders, deltas.read(spark, state_path).select("order_id", "tip_amount"))
