"""One-row aggregates used as scalar subqueries.

Totals, percentile edges and counts are one-row frames.  Attaching them with
``DataFrame.scalar()`` plans a scalar subquery that runs once and is inlined
as a value: no join, no cross product, no data through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_struct(one_row: DataFrame) -> Column:
    """The single row of ``one_row`` as a struct-valued scalar subquery."""
    return one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()


def scalar_value(one_row: DataFrame, col: str | None = None) -> Column:
    """One column of a one-row frame as a scalar subquery."""
    return one_row.select(col or one_row.columns[0]).scalar()
