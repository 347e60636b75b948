"""Ranked portfolios, rebalance schedules and performance tables over ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, score: str, n: int, by: Sequence[str] = ("date",), tie: str = "code") -> DataFrame:
    """The ``n`` best rows per date, ties by code (a date holds at most one row per code)."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def rebalance_days(calendar: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(horizon, phase, position, date) of every schedule: position mod horizon = phase."""
    df = calendar.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return df.withColumn("phase", F.col("position") % F.col("horizon"))


def stock_day_ledger(
    scored: DataFrame, calendar: DataFrame, score: str, n: int, horizons: Sequence[int], cost: float, opens: DataFrame
) -> DataFrame:
    """(horizon, phase, position, code, weight, gain_return, fee_return) without an order simulator.

    Each schedule buys the top ``n`` at equal weight at the open after its signal date and holds
    them until its next rebalance.  Fees follow from the change of weights between two
    rebalances.  ``scored`` and ``opens`` are keyed by (date, code).
    """
    days = rebalance_days(calendar, horizons)
    ranked = top_n(scored.where(F.col(score).isNotNull()), score, n).select("date", "code")
    picks = ranked.join(days, "date").withColumn(
        "weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("horizon", "phase", "position"))
    )
    keys = ["horizon", "phase", "position", "code"]
    held = picks.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("horizon"))))
    held = held.select("horizon", "phase", (F.col("position") + F.col("_k")).alias("position"), "code", "weight")
    last = calendar.agg(F.max("position").alias("p")).scalar()
    prices = opens.join(calendar, "date").select("code", "position", "open")
    following = prices.select("code", (F.col("position") - 1).alias("position"), F.col("open").alias("_next"))
    move = prices.join(following, ["code", "position"]).select("code", "position", (F.col("_next") / F.col("open") - 1).alias("_move"))
    held = held.where(F.col("position") < last).join(move, ["code", "position"], "left")
    held = held.select(*keys, "weight", (F.col("weight") * F.coalesce("_move", F.lit(0.0))).alias("gain_return"))
    # weight changes: each pick adds its weight now and takes it away at the next rebalance
    at = picks.select("horizon", "phase", (F.col("position") + 1).alias("position"), "code", F.col("weight").alias("_dw"))
    out = picks.select(
        "horizon", "phase", (F.col("position") + F.col("horizon") + 1).alias("position"), "code", (-F.col("weight")).alias("_dw")
    )
    change = at.unionByName(out).where(F.col("position") < last).groupBy(*keys).agg(F.sum("_dw").alias("_dw"))
    change = change.select(*keys, F.abs("_dw").alias("turnover"))
    both = held.join(change, keys, "full_outer").na.fill(0.0, ["weight", "gain_return", "turnover"])
    return both.withColumn("fee_return", F.col("turnover") * cost)


def daily_book(ledger: DataFrame) -> DataFrame:
    """Daily gross and net return, turnover and exposure of each (horizon, phase)."""
    return ledger.groupBy("horizon", "phase", "position").agg(
        F.sum("gain_return").alias("gross_return"),
        (F.sum("gain_return") - F.sum("fee_return")).alias("net_return"),
        F.sum("turnover").alias("turnover"),
        F.sum("weight").alias("exposure"),
        F.sum("fee_return").alias("cost"),
    )


def replay_performance(daily: DataFrame, by: Sequence[str], annual: int, excess: str = "net_return") -> DataFrame:
    """Sample-deviation Sharpe of the excess return, annual return, exposure and total cost."""
    std = F.stddev_samp(excess)
    days = F.count(F.lit(1))
    return daily.groupBy(*by).agg(
        days.alias("days"),
        F.when(std > 1e-12, F.avg(excess) / std * F.sqrt(F.lit(float(annual)))).alias("sharpe"),
        F.expm1(F.sum(F.log1p("net_return")) * annual / days).alias("annual_return"),
        F.avg("exposure").alias("mean_exposure"),
        F.sum("cost").alias("total_cost"),
        F.sum("net_return").alias("sum_return"),
    )


def phase_medians(metrics: DataFrame) -> DataFrame:
    """Median and worst over the phases of each horizon (a handful of rows)."""
    return metrics.groupBy("horizon").agg(
        F.median("sharpe").alias("median_sharpe"), F.median("annual_return").alias("median_return"),
        F.min("sharpe").alias("worst_sharpe"), F.count(F.lit(1)).alias("phases"),
    )


def linked_attribution(ledger: DataFrame, daily: DataFrame) -> DataFrame:
    """Contribution of every stock-day, linked by the compounded value before the day."""
    w = Window.partitionBy("horizon", "phase").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    nav = F.exp(F.coalesce(F.sum(F.log1p("net_return")).over(w), F.lit(0.0)))
    linked = daily.withColumn("link_nav", nav).select("horizon", "phase", "position", "link_nav")
    joined = ledger.join(linked, ["horizon", "phase", "position"])
    return joined.withColumn("linked", (F.col("gain_return") - F.col("fee_return")) * F.col("link_nav") / F.col("horizon"))


def concentration(contributions: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Positive, negative, top-5 and top-10 contribution over one row per (by, code)."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), "code")
    ranked = contributions.withColumn("_place", F.row_number().over(order))
    x = F.col(value)
    return ranked.groupBy(*by).agg(
        F.sum(x).alias("total"),
        F.sum(F.when(x > 0, x).otherwise(0.0)).alias("positive"),
        F.sum(F.when(x < 0, x).otherwise(0.0)).alias("negative"),
        F.sum(F.when(F.col("_place") <= 5, x).otherwise(0.0)).alias("top5"),
        F.sum(F.when(F.col("_place") <= 10, x).otherwise(0.0)).alias("top10"),
    )


def compare_replays(metrics: DataFrame, method: str, baseline: Column) -> DataFrame:
    """Metric deltas of every method against the baseline method on the same phase."""
    base = metrics.where(baseline).select(
        "phase", F.col("sharpe").alias("_s"), F.col("annual_return").alias("_a")
    )
    joined = metrics.where(~baseline).join(base, "phase")
    return joined.select(
        method, "phase", (F.col("sharpe") - F.col("_s")).alias("sharpe_delta"), (F.col("annual_return") - F.col("_a")).alias("return_delta"),
        (F.col("sharpe") > F.col("_s")).alias("better"),
    )


def lattice_book(
    scored: DataFrame, calendar: DataFrame, scores: Sequence[str], sizes: Sequence[int], horizons: Sequence[int], opens: DataFrame, folds: int
) -> DataFrame:
    """One daily book (score, size, horizon, phase, fold, position, gross_return, turnover, exposure) of every combination.

    Scores are unpivoted and ranked once; every size is a prefix of that ranking, and schedules are arrays of
    parameters exploded over it.  Moves of prices are joined once for all combinations.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("score"), F.col(n).alias("x")) for n in scores]))
    long = scored.select("date", "code", each.alias("s")).select("date", "code", "s.score", "s.x").where("x IS NOT NULL")
    ranked = top_n(long, "x", max(sizes), ("score", "date")).join(calendar, "date").select("score", "place", "position", "code")
    picks = ranked.withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes]))).where("place <= size")
    case = ["score", "size", "horizon", "phase"]
    picks = picks.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("phase", F.col("position") % F.col("horizon"))
    # a date has as many picks as its size, or all its codes: the count is at most the size
    weight = 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*case, "position"))
    picks = picks.select(*case, "position", "code", weight.alias("weight"))
    last = calendar.agg(F.max("position").alias("p")).scalar()
    size = calendar.agg((F.max("position") + 1).alias("n")).scalar()
    prices = opens.join(calendar, "date").select("code", "position", "open")
    following = prices.select("code", (F.col("position") - 1).alias("position"), F.col("open").alias("_next"))
    move = prices.join(following, ["code", "position"]).select("code", "position", (F.col("_next") / F.col("open") - 1).alias("_move"))
    held = picks.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("horizon")))).withColumn("position", F.col("position") + F.col("_k"))
    held = held.where(F.col("position") < last).join(move, ["code", "position"], "left")
    gains = held.select(*case, "position", (F.col("weight") * F.coalesce("_move", F.lit(0.0))).alias("gain"), "weight", F.lit(0.0).alias("turn"))
    # a pick adds its weight at the next session and takes it away at the rebalance after it
    ends = F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("weight").alias("dw")), F.struct((F.col("horizon") + 1).alias("k"), (-F.col("weight")).alias("dw"))))
    change = picks.withColumn("e", ends).withColumn("position", F.col("position") + F.col("e.k")).where(F.col("position") < last)
    change = change.groupBy(*case, "position", "code").agg(F.abs(F.sum("e.dw")).alias("turn"))
    turns = change.select(*case, "position", F.lit(0.0).alias("gain"), F.lit(0.0).alias("weight"), "turn")
    book = gains.unionByName(turns).groupBy(*case, "position").agg(
        F.sum("gain").alias("gross_return"), F.sum("turn").alias("turnover"), F.sum("weight").alias("exposure")
    )
    return book.withColumn("fold", F.floor(F.col("position") * folds / size).cast("int"))


def lattice_performance(book: DataFrame, cost: float, multiples: Sequence[float], annual: int) -> DataFrame:
    """Performance of every combination, fold and cost level over the one stored book."""
    level = book.withColumn("multiple", F.explode(F.array(*[F.lit(float(m)) for m in multiples])))
    level = level.withColumn("cost", F.col("turnover") * cost * F.col("multiple")).withColumn("net_return", F.col("gross_return") - F.col("cost"))
    return replay_performance(level, ["score", "size", "horizon", "phase", "fold", "multiple"], annual)


def compare_levels(performance: DataFrame, baseline: int = 1) -> DataFrame:
    """Per combination and cost level the medians over the folds of the gains against the baseline horizon of the same fold."""
    keys = ["score", "size", "fold", "multiple"]
    base = performance.where(F.col("horizon") == baseline).groupBy(*keys).agg(F.median("sharpe").alias("_s"), F.median("annual_return").alias("_a"))
    joined = performance.where(F.col("horizon") != baseline).join(base, keys)
    gain = F.col("sharpe") - F.col("_s")
    return joined.groupBy("score", "size", "horizon", "phase", "multiple").agg(
        F.median(gain).alias("sharpe_delta"), F.median(F.col("annual_return") - F.col("_a")).alias("return_delta"),
        F.count(F.when(gain > 0, 1)).alias("folds_better"), F.count(F.lit(1)).alias("folds"),
    )
