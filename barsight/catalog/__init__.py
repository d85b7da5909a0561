"""All registered queries."""

from barsight.catalog.base import ORACLE, QUERIES
from barsight.catalog import features, models_q, positions_q, tables_q, texts  # noqa: F401  (importing registers)

__all__ = ["ORACLE", "QUERIES"]
