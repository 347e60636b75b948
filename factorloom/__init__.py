"""Factor research on Spark: bars, panels, formulas, statistics and backtests as DataFrame jobs."""

__version__ = "0.1.0"
