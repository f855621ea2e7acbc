"""Order money and loyalty tier rules."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Server-side tax rate and loyalty tier cut-offs (points).
TAX_RATE = Decimal("0.085")
TIER_CUTS = [(2000, "platinum"), (1000, "gold"), (500, "silver")]
TIER_FLOOR = "bronze"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tier(points) -> Column:
    """>=2000 platinum, >=1000 gold, >=500 silver, else bronze."""
    p = _c(points)
    expr = None
    for cut, name in TIER_CUTS:
        expr = F.when(p >= cut, name) if expr is None else expr.when(p >= cut, name)
    return expr.otherwise(TIER_FLOOR)


def tax(subtotal, rate: Decimal = TAX_RATE) -> Column:
    """Half-even tax to cents on an exact decimal subtotal."""
    return F.bround(_c(subtotal).cast("decimal(20,2)") * F.lit(rate).cast("decimal(6,4)"), 2).cast("decimal(20,2)")


def order_total(subtotal, tax_amount, discount, tip) -> Column:
    """total = subtotal + tax - discount + tip (all decimal)."""
    d = lambda c: F.coalesce(_c(c).cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))
    return (d(subtotal) + d(tax_amount) - d(discount) + d(tip)).cast("decimal(20,2)")
