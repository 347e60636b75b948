"""The measured inputs of the retention gate (V17, V18): folds, segments, increments and the portfolio.

``rows`` is one row per (strategy, code, ts) with factor, pos, ret, pnl, turnover, rn and bars; every strategy has the same bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators import evaluate as ev
from factorloom.operators.backtest import sharpe


def with_fold(rows: DataFrame, folds: int = 4) -> DataFrame:
    return rows.withColumn("fold", F.floor((F.col("rn") - 1) * folds / F.col("bars")).cast("int"))


def same_side(parts: DataFrame, overall: DataFrame, name: str) -> DataFrame:
    """(strategy, name): share of the parts (strategy, rank_ic) whose sign is that of the overall RankIC."""
    joined = parts.where("rank_ic IS NOT NULL").join(overall.select("strategy", F.signum("rank_ic").alias("_side")), "strategy")
    return joined.groupBy("strategy").agg(F.avg((F.signum("rank_ic") == F.col("_side")).cast("double")).alias(name))


def fold_direction(rows: DataFrame, overall: DataFrame) -> DataFrame:
    """Share of the folds whose mean RankIC over the codes has the overall sign."""
    ics = ev.series_ic(with_fold(rows), ["strategy", "fold", "code"], "factor", "ret")
    return same_side(ics.groupBy("strategy", "fold").agg(F.avg("rank_ic").alias("rank_ic")), overall, "fold_direction_ratio")


def segment_direction(rows: DataFrame, overall: DataFrame, need: int = 20) -> DataFrame:
    """Share of the segments (codes and weekdays) of ``need`` rows whose RankIC has the overall sign."""
    segment = F.explode(F.array(F.concat(F.lit("code:"), F.col("code")), F.concat(F.lit("day:"), F.dayofweek("ts").cast("string"))))
    ics = ev.series_ic(rows.withColumn("segment", segment), ["strategy", "segment"], "factor", "ret", bounded=False)
    return same_side(ics.where(F.col("n") >= need), overall, "segment_direction_ratio")


def increments(rows: DataFrame, folds: int = 4) -> DataFrame:
    """(strategy, increment, increment_fold_ratio, portfolio_delta): what the equal-weight pool loses without the strategy.

    The pool without a strategy is the pool's total less its own row, so no pool is built again.  Per fold the
    gain is the difference of the mean IC over the codes; the portfolio is compared by its Sharpe ratio over all bars.
    """
    at = Window.partitionBy("code", "ts")  # one row per strategy
    n = F.count(F.lit(1)).over(at)
    pooled = with_fold(rows, folds).withColumns(
        {
            "_all": F.sum("pos").over(at) / n, "_rest": (F.sum("pos").over(at) - F.col("pos")) / (n - 1),
            "_gain": F.sum("pnl").over(at) / n, "_gain_rest": (F.sum("pnl").over(at) - F.col("pnl")) / (n - 1),
        }
    )
    ics = pooled.groupBy("strategy", "fold", "code").agg((ev.guarded_corr("_all", "ret") - ev.guarded_corr("_rest", "ret")).alias("d"))
    per_fold = ics.groupBy("strategy", "fold").agg(F.avg("d").alias("d"))
    gain = per_fold.groupBy("strategy").agg(F.avg("d").alias("increment"), F.avg((F.col("d") > 0).cast("double")).alias("increment_fold_ratio"))
    money = pooled.groupBy("strategy", "ts").agg(F.avg("_gain").alias("_a"), F.avg("_gain_rest").alias("_b"))
    return gain.join(money.groupBy("strategy").agg((sharpe("_a") - sharpe("_b")).alias("portfolio_delta")), "strategy")


def daily_interval(rows: DataFrame, strategies: list[str], block: int, samples: int, seed: int) -> DataFrame:
    """(strategy, ci_low, ci_high): moving-block bootstrap of the daily RankIC, the same blocks for all strategies."""
    daily = ev.series_ic(rows.withColumn("day", F.col("ts").cast("date")), ["strategy", "day"], "factor", "ret").where("n >= 10")
    wide = daily.groupBy("day").agg(*[F.max(F.when(F.col("strategy") == s, F.col("rank_ic"))).alias(s) for s in strategies]).dropna()
    # a series of days, bounded by the calendar
    series = wide.withColumn("position", F.row_number().over(Window.orderBy("day")) - 1)
    draws = ev.moving_block_bootstrap(series, strategies, block, samples, seed).groupBy("draw").agg(*[F.avg(s).alias(s) for s in strategies])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("stat")) for s in strategies]))
    return ev.bootstrap_summary(draws.select(each.alias("s")).select("s.strategy", "s.stat"), ["strategy"]).select("strategy", "ci_low", "ci_high")
