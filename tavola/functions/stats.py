"""Order-independent mean and standard deviation of money columns.

Float sums depend on the order rows arrive in, so two runs (or Spark and the
SQL oracle) can differ in the last bits.  Here the first and second moments
are summed as exact decimals; only the final combination is done in double,
identically on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dec(col, scale: int = 2) -> Column:
    return _c(col).cast(f"decimal(18,{scale})")


def s1(col, scale: int = 2) -> Column:
    """Exact sum (decimal)."""
    return F.sum(dec(col, scale))


def s2(col, scale: int = 2) -> Column:
    """Exact sum of squares (decimal)."""
    d = dec(col, scale)
    return F.sum((d * d).cast(f"decimal(38,{2 * scale})"))


def mean_of(sum_col, n_col) -> Column:
    return _c(sum_col).cast("double") / _c(n_col).cast("double")


def std_of(sum_col, sumsq_col, n_col) -> Column:
    """Sample std (ddof=1) from exact moments; NULL for fewer than 2 rows."""
    n = _c(n_col).cast("double")
    a = _c(sum_col).cast("double")
    b = _c(sumsq_col).cast("double")
    var = (b - a * a / n) / (n - 1.0)
    return F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))))


# SQL twins for the oracle -------------------------------------------------

def sql_s1(expr: str, scale: int = 2) -> str:
    return f"SUM(CAST({expr} AS DECIMAL(18,{scale})))"


def sql_s2(expr: str, scale: int = 2) -> str:
    return (f"SUM(CAST(CAST({expr} AS DECIMAL(38,{scale})) * CAST({expr} AS DECIMAL(38,{scale})) "
            f"AS DECIMAL(38,{2 * scale})))")


def sql_mean(s: str, n: str) -> str:
    return f"(CAST({s} AS DOUBLE) / CAST({n} AS DOUBLE))"


def sql_std(s: str, q: str, n: str) -> str:
    a, b, nn = f"CAST({s} AS DOUBLE)", f"CAST({q} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    return f"(CASE WHEN {nn} > 1 THEN sqrt(greatest(({b} - {a} * {a} / {nn}) / ({nn} - 1.0), 0.0)) END)"
