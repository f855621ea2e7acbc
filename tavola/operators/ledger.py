"""Ledgers: event logs folded into current state.

The reference changes state one row at a time behind web endpoints.  Here
each rule is a fold of an event table: ``groupBy(key)`` sums and last-value
picks, so the same function serves a batch rebuild and a streaming
micro-batch (``streaming/ledgers.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import TAX_RATE, order_total, tax, tier

# Legal order status transitions (from -> allowed next states).
TRANSITIONS = {
    "pending": ["confirmed", "cancelled"],
    "confirmed": ["preparing", "cancelled"],
    "preparing": ["ready", "cancelled"],
    "ready": ["delivered", "cancelled"],
    "delivered": ["completed"],
    "cancelled": [],
    "completed": [],
}


def transition_table(spark) -> DataFrame:
    rows = [(a, b) for a, nxt in TRANSITIONS.items() for b in nxt]
    return spark.createDataFrame(rows, "from_status string, to_status string")


def order_totals(lines: DataFrame, order: str = "order_id", amount: str = "total_price",
                 discount: str | None = None) -> DataFrame:
    """L1: subtotal = exact sum of line amounts, tax = half-even(subtotal x rate, 2),
    total = subtotal + tax - discount."""
    aggs = [F.sum(F.col(amount).cast("decimal(18,2)")).alias("subtotal")]
    if discount:
        aggs.append(F.sum(F.col(discount).cast("decimal(18,2)")).alias("discount_amount"))
    t = lines.groupBy(order).agg(*aggs)
    t = t.withColumn("tax_amount", tax("subtotal", TAX_RATE))
    disc = F.col("discount_amount") if discount else F.lit(0)
    return t.withColumn("total", order_total("subtotal", "tax_amount", disc, F.lit(0)))


def loyalty_state(customers: DataFrame, point_events: DataFrame, key: str = "customer_id") -> DataFrame:
    """L2: points = opening points + earned points; tier from points."""
    earned = point_events.groupBy(key).agg(F.sum("points").cast("long").alias("earned_points"),
                                           F.count(F.lit(1)).alias("n_events"))
    s = customers.select(key, F.col("loyalty_points").alias("opening_points")).join(earned, key, "left")
    s = s.fillna(0, ["earned_points", "n_events"])
    pts = F.col("opening_points") + F.col("earned_points")
    return s.withColumn("loyalty_points", pts).withColumn("loyalty_tier", tier(pts))


def stock_state(inv: DataFrame, movements: DataFrame, key: str = "inventory_id") -> DataFrame:
    """L3: on hand = opening + sum of movements; last restock = latest positive
    movement; needs_reorder = on hand <= reorder level."""
    mv = movements.groupBy(key).agg(F.sum("delta").cast("long").alias("net_movement"),
                                    F.max(F.when(F.col("delta") > 0, F.col("ts"))).alias("last_restocked"))
    s = inv.select(key, "quantity_on_hand", "reorder_level").join(mv, key, "left").fillna(0, ["net_movement"])
    on_hand = F.col("quantity_on_hand") + F.col("net_movement")
    return (s.withColumn("quantity_on_hand", on_hand)
            .withColumn("needs_reorder", F.col("quantity_on_hand") <= F.col("reorder_level")))


def order_state(status_events: DataFrame, key: str = "order_id") -> DataFrame:
    """L4: last status wins (by time, then event id); completed_at is the
    first completion time; number of status events."""
    return (status_events.groupBy(key)
            .agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"),
                 F.min(F.when(F.col("status") == "completed", F.col("ts"))).alias("completed_at"),
                 F.count(F.lit(1)).alias("n_events")))


def illegal_transitions(status_events: DataFrame, transitions: DataFrame | None = None,
                        key: str = "order_id") -> DataFrame:
    """L4: consecutive status changes per order that the transition table
    does not allow (anti join against a small fixed table).  Event ids must
    be unique (they break ties in time)."""
    from .windows import lag_by_rank
    tt = transitions if transitions is not None else transition_table(status_events.sparkSession)
    # previous status by exact global rank, so one very busy order is not one task
    steps = (lag_by_rank(status_events, key, ["ts", "event_id"], "status", "from_status")
             .where(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("status")))
             .withColumnRenamed("status", "to_status"))
    return steps.join(F.broadcast(tt), ["from_status", "to_status"], "left_anti") \
        .select(key, "event_id", "ts", "from_status", "to_status")


def duplicate_payments(payments: DataFrame, key: str | list[str] = "order_id") -> DataFrame:
    """Orders with more than one payment."""
    keys = [key] if isinstance(key, str) else list(key)
    return payments.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_payments")).where(F.col("n_payments") > 1)


def apply_payments(orders: DataFrame, payments: DataFrame, key: str = "order_id") -> DataFrame:
    """Paid orders get total = subtotal + tax - discount + tip and status
    completed; unpaid orders keep their total and status."""
    pay = payments.groupBy(key).agg(F.sum(F.col("tip_amount").cast("decimal(18,2)")).alias("tip_amount"),
                                    F.count(F.lit(1)).alias("n_payments"))
    j = orders.join(pay, key, "left")
    paid = F.col("n_payments").isNotNull()
    total = order_total("subtotal", "tax_amount", "discount_amount", "tip_amount")
    return j.select(key, "subtotal", "tax_amount", "discount_amount",
                    F.coalesce("tip_amount", F.lit(0).cast("decimal(18,2)")).cast("decimal(20,2)").alias("tip_amount"),
                    F.when(paid, total).otherwise(F.col("total")).alias("total"),
                    F.when(paid, F.lit("completed")).otherwise(F.col("status")).alias("status"))
