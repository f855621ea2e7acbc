"""Named queries over the driver tables (the ``__spark_entry__`` registry)."""

from . import q_basket, q_customers, q_forecast, q_ledger, q_ml, q_quality, q_reports, q_search, q_text, q_windows  # noqa: F401,E501
from .registry import AS_OF, REGISTRY, Query, register

__all__ = ["AS_OF", "REGISTRY", "Query", "register"]
