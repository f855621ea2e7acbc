"""Registry of named queries over the driver tables.

Each entry pairs a DataFrame plan builder ``fn(spark, sf_dir)`` with the
equivalent DuckDB SQL (``None`` when the operator has no SQL form: ML models,
iterative algorithms, streams).  ``__spark_entry__.py`` exposes the registry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The reporting date used by every period query; one day after
# the last order date in the driver tables.
AS_OF = "2001-08-02 00:00:00"


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco
