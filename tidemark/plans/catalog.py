"""All registered queries."""

from . import cleaning_queries, limit_queries, optimality_queries, portfolio_queries, risk_queries, series_queries, source_queries, strategy_queries, validation_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
