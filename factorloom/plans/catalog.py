"""All registered queries: importing the catalogue modules fills the registry."""

from factorloom.plans import catalog_backtest, catalog_eval, catalog_feasibility, catalog_features, catalog_ops, catalog_panel, catalog_portfolio, catalog_quality, catalog_retention, catalog_signals, catalog_stream  # noqa: F401
from factorloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
