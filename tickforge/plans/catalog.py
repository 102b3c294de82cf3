"""All registered queries; importing a query module registers its entries."""

from tickforge.plans import (bar_queries, correlation_queries, fundamental_queries,  # noqa: F401
                             gap_queries, indicator_queries, intraday_queries,
                             portfolio_queries, season_queries, signal_queries,
                             stream_queries, zone_queries)
from tickforge.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
