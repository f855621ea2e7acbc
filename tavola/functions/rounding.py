"""Rounding and guarded arithmetic as Column expressions.

``round_even`` follows NumPy/pandas ``round``: scale, round half to even on the
double, scale back.  Spark's ``bround`` on a double goes through the decimal
string of the value and disagrees on about one value in 300 (e.g. 2.675), so
float results use the NumPy form; decimals use ``bround`` (exact).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_even(col, digits: int = 2) -> Column:
    """Half-to-even rounding of a double, identical to ``numpy.round``."""
    scale = float(10 ** digits)
    return F.rint(_c(col).cast("double") * F.lit(scale)) / F.lit(scale)


def money(col) -> Column:
    """Cast a float amount to exact cents so sums do not depend on order."""
    return _c(col).cast("decimal(18,2)")


def money_sum(col) -> Column:
    """Exact sum of a float money column, returned as double (0 when empty)."""
    return F.coalesce(F.sum(money(col)), F.lit(0).cast("decimal(28,2)")).cast("double")


def safe_div(num, den, fallback=None) -> Column:
    """``num / den`` when ``den > 0`` else ``fallback`` (reference np.where guard)."""
    num, den = _c(num), _c(den)
    fb = F.lit(fallback) if not isinstance(fallback, Column) else fallback
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(fb)


def cents_avg(sum_col, n_col) -> Column:
    """Half-even money average to 2 dp from an exact decimal sum and a count.

    Works in integer cents, so the result does not depend on float division.
    Returns 0.0 when the count is 0 (reference ``Decimal('0.00')``).
    """
    cents = (_c(sum_col).cast("decimal(28,2)") * 100).cast("long")
    n = _c(n_col).cast("long")
    r = F.when(n > 0, F.pmod(cents, n))
    q = ((cents - r) / n).cast("long")
    up = (F.lit(2) * r > n) | ((F.lit(2) * r == n) & (F.pmod(q, F.lit(2)) == 1))
    return F.when(n > 0, (q + F.when(up, 1).otherwise(0)).cast("double") / 100.0).otherwise(F.lit(0.0))
