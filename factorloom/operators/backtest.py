"""Vectorised backtests and performance metrics (B1-B25) over a long (code, ts) table.

The P&L table has one row per bar: ``pos``, ``ret``, ``turnover``, ``pnl``, the direction
``dir`` and the bar number ``rn``.  Everything below is windows over one series spec or
map-side combined aggregations over it; nothing reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.series import Series, clamp
from factorloom.session import checkpointed

# Fixed values of the evaluation.
COST_RATE = 0.0003
PERIODS_PER_YEAR = 6240
DEAD_BAND = 0.05
SORTINO_LIMIT = 20.0


# -- signals ---------------------------------------------------------------------------
def position(factor: Column, dead_band: float = DEAD_BAND) -> Column:
    """Tanh of the factor, 0 inside the dead band."""
    raw = F.tanh(factor)
    return F.when(F.abs(raw) >= dead_band, raw).otherwise(0.0)


def direction(pos: Column, threshold: float = DEAD_BAND) -> Column:
    """C16"""
    return F.when(pos >= threshold, 1).when(pos <= -threshold, -1).otherwise(0)


def action(current: Column, target: Column) -> Column:
    """C17"""
    return (
        F.when(current == target, "HOLD")
        .when((current == 0) & (target == 1), "OPEN_LONG")
        .when(current == 0, "OPEN_SHORT")
        .when(target == 0, "CLOSE")
        .when(target == 1, "REVERSE_TO_LONG")
        .otherwise("REVERSE_TO_SHORT")
    )


def target_return(s: Series, price: str = "open") -> Column:
    """L1: log return from the next open to the one after; the last two rows are 0."""
    first = s.lead(price, 1)
    entry = F.when(first == 0, 1.0).otherwise(first)
    return F.coalesce(F.log(F.try_divide(s.lead(price, 2), entry)), F.lit(0.0))


# -- frozen snapshots ------------------------------------------------------------------
def frozen_snapshot(df: DataFrame, factors: Sequence[str], s: Series = Series(), cost: float = COST_RATE, periods: float = PERIODS_PER_YEAR) -> DataFrame:
    """One row of metrics of the mean of frozen factors on the holdout.

    ``df`` holds every code on one timeline, with rn, bars and split (``labels.split_chronologically``), ``open`` and the
    ``factors``, computed on the whole series.  Rows behind the split but the last two, whose labels are padding, are
    evaluated; every code starts without a position.  Totals, Sharpe and drawdown are those of the mean over the codes at each
    time, Sortino and Calmar those of all codes' rows, code after code.  A factor that is NULL anywhere ends the job.
    """
    mean = sum((F.col(f) for f in factors), F.lit(0.0)) / len(factors)
    checked = F.when(mean.isNotNull(), mean).otherwise(F.raise_error(F.lit("a frozen factor has no value")).cast("double"))
    rows = df.withColumns({"_factor": checked, "_ret": target_return(s)})
    rows = rows.where((F.col("rn") > F.col("split")) & (F.col("rn") <= F.col("bars") - 2)).withColumn("pos", position(F.col("_factor")))
    rows = rows.withColumn("turnover", F.abs(F.col("pos") - s.lag("pos", 1, 0.0)))
    rows = checkpointed(rows.select(*s.keys, "ts", "pos", "turnover", (F.col("pos") * F.col("_ret") - F.col("turnover") * cost).alias("pnl")))
    book = cumulative(portfolio(rows), Series())
    total = book.agg(
        F.count(F.lit(1)).alias("evaluable_bars"), F.sum("pnl").alias("total_log_pnl"), F.expm1(F.sum("pnl")).alias("simple_return_equivalent"),
        (F.avg("pnl") * periods).alias("annualized_log_return"), sharpe("pnl", periods).alias("sharpe"), F.max("drawdown").alias("max_drawdown_log"),
    )
    # running sums of code after code: each code's own, behind the totals and peaks of the codes before
    own = cumulative(rows, s)
    codes = own.groupBy(*s.keys).agg(F.sum("pnl").alias("_sum"), F.max("cum").alias("_top"))
    before = Window.orderBy(*s.keys).rowsBetween(Window.unboundedPreceding, -1)
    codes = codes.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    codes = codes.withColumn("_high", F.max(F.col("_base") + F.col("_top")).over(before)).select(*s.keys, "_base", "_high")
    flat = own.join(codes, list(s.keys)).withColumn("_fall", F.greatest(F.col("_high") - F.col("_base"), F.col("peak")) - F.col("cum"))
    each = flat.agg(
        sortino("pnl", periods=periods).alias("sortino"),
        clamp(F.avg("pnl") * periods / F.greatest(F.max("_fall"), F.lit(1e-8)), -10.0, 10.0).alias("calmar"),
        F.avg(F.abs("pos")).alias("mean_exposure"), F.avg("turnover").alias("mean_turnover"),
    )
    count = F.lit(len(factors))
    return total.withColumn("formula_count", count).join(each.withColumn("formula_count", count), "formula_count")


# -- P&L -------------------------------------------------------------------------------
def pnl_table(df: DataFrame, s: Series = Series(), cost: Column | float = COST_RATE) -> DataFrame:
    """B1: adds rn, bars, pos, prev, ret, turnover, pnl and dir to a table with ``factor`` and ``open``."""
    whole = Window.partitionBy(*s.keys)
    df = df.withColumns(
        {
            "rn": s.position(),
            "bars": F.count(F.lit(1)).over(whole),
            "pos": position(F.col("factor")),
            "ret": target_return(s),
        }
    )
    df = df.withColumns({"prev": s.lag("pos", 1, 0.0), "dir": direction(F.col("pos"))})
    turnover = F.abs(F.col("pos") - F.col("prev"))
    return df.withColumns({"turnover": turnover, "pnl": F.col("pos") * F.col("ret") - turnover * cost})


def portfolio(pnl: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """B2: equal-weight mean over the codes at each time, as a series of its own."""
    out = pnl.groupBy(*by, "ts").agg(F.avg("pnl").alias("pnl"))
    return out.withColumn("code", F.lit("PORTFOLIO"))


def cumulative(pnl: DataFrame, s: Series = Series()) -> DataFrame:
    """Running sum, its running peak and the distance to the peak."""
    df = pnl.withColumn("cum", F.sum("pnl").over(s.so_far()))
    df = df.withColumn("peak", F.max("cum").over(s.so_far()))
    return df.withColumn("drawdown", F.col("peak") - F.col("cum"))


def sharpe(x: str = "pnl", periods: Column | float = PERIODS_PER_YEAR) -> Column:
    """Aggregate: mean over population deviation, annualised."""
    return F.avg(x) / (F.stddev_pop(x) + 1e-8) * F.sqrt(F.lit(periods))


def sortino(x: str | Column = "pnl", floor: str = "spread", periods: Column | float = PERIODS_PER_YEAR) -> Column:
    """B5 as an aggregate.

    ``floor`` bounds the downside deviation from below: ``spread`` by 20% of the full
    deviation, ``mean`` by the absolute mean (no loss at all gives 0), ``tiny`` by the absolute
    mean with 1e-10 standing in when there is no loss.
    """
    x = F.col(x) if isinstance(x, str) else x
    down = F.stddev_pop(F.when(x < 0, x))
    if floor == "spread":
        spread = F.greatest(F.stddev_pop(x), F.lit(1e-8))
        bottom = F.greatest(F.coalesce(down, F.lit(0.0)), spread * 0.2, F.lit(1e-8))
    elif floor == "mean":
        bottom = F.greatest(down, F.abs(F.avg(x)), F.lit(1e-8))
        bottom = F.when(F.count(F.when(x < 0, 1)) > 0, bottom)
    else:
        bottom = F.greatest(F.coalesce(down, F.lit(1e-10)), F.abs(F.avg(x)), F.lit(1e-10))
    value = F.avg(x) / bottom * F.sqrt(F.lit(periods))
    return F.coalesce(clamp(value, -SORTINO_LIMIT, SORTINO_LIMIT), F.lit(0.0))


def sortino_if(condition: Column, x: str = "pnl") -> Column:
    """Sortino of the rows that satisfy ``condition``, inside any grouping."""
    return sortino(F.when(condition, F.col(x)))


def compounded(returns: DataFrame, s: Series, x: str, annual: int) -> DataFrame:
    """Metrics of compounded simple returns per series."""
    df = returns.where(F.col(x).isNotNull() & ~F.isnan(x)).withColumn("_g", F.sum(F.log1p(x)).over(s.so_far()))
    df = df.withColumn("_peak", F.max("_g").over(s.so_far()))
    out = df.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("observations"),
        F.expm1(F.sum(F.log1p(x))).alias("total_return"),
        F.avg(x).alias("_mean"),
        F.stddev_pop(x).alias("_std"),
        F.stddev_pop(F.when(F.col(x) < 0, F.col(x))).alias("_down"),
        F.max(1.0 - F.exp(F.col("_g") - F.col("_peak"))).alias("max_drawdown"),
    )
    year = F.lit(float(annual)) / F.col("observations")
    out = out.withColumn("annualized_return", F.pow(1.0 + F.col("total_return"), year) - 1.0)

    def ratio(spread: str) -> Column:
        return F.when(F.col(spread) > 1e-12, F.col("_mean") / F.col(spread) * math.sqrt(annual)).otherwise(0.0)

    calmar = F.when(F.col("max_drawdown") > 1e-12, F.col("annualized_return") / F.col("max_drawdown")).otherwise(0.0)
    return out.withColumns({"sharpe": ratio("_std"), "sortino": ratio("_down"), "calmar": calmar}).drop(
        "_mean", "_std", "_down"
    )


def rolling_sharpe(pnl: DataFrame, s: Series = Series(), window: int = 500) -> DataFrame:
    """Over the last min(window, length) rows, NULL before, 0 for a flat window."""
    frame = s.last(window)
    full = (F.col("rn") >= window) | ((F.col("bars") < window) & (F.col("rn") == F.col("bars")))
    std = F.stddev_pop("pnl").over(frame)
    value = clamp(F.try_divide(F.avg("pnl").over(frame), std) * math.sqrt(PERIODS_PER_YEAR), -20.0, 20.0)
    return pnl.withColumn("rolling_sharpe", F.when(full, F.when(std < 1e-12, 0.0).otherwise(value)))


def trailing_sharpe(pnl: DataFrame, s: Series = Series(), window: int = 250) -> DataFrame:
    """Over the ``window`` rows before the current one."""
    frame = s.between(-window, -1)
    value = F.avg("pnl").over(frame) / (F.stddev_pop("pnl").over(frame) + 1e-10) * math.sqrt(PERIODS_PER_YEAR)
    return pnl.withColumn("trailing_sharpe", F.when(F.col("rn") > window, value))


# -- runs and trades -------------------------------------------------------------------
def with_run(df: DataFrame, s: Series, changed: Column, name: str = "run") -> DataFrame:
    """Number the runs of a series; ``changed`` marks the first row of a new run."""
    flagged = df.withColumn("_new", F.when(changed, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_new").over(s.so_far())).drop("_new")


def trades(pnl: DataFrame, s: Series = Series()) -> DataFrame:
    """One row per run of a constant non-zero direction, executed at the following open."""
    df = pnl.withColumns(
        {
            "_prev_dir": s.lag("dir", 1, 0),
            "next_open": F.coalesce(s.lead("open", 1), F.col("open")),
            "next_ts": F.coalesce(s.lead(s.order, 1), F.col(s.order)),
            "next2_open": F.coalesce(s.lead("open", 2), s.lead("open", 1), F.col("open")),
            "next2_ts": F.coalesce(s.lead(s.order, 2), s.lead(s.order, 1), F.col(s.order)),
        }
    )
    df = with_run(df, s, F.col("dir") != F.col("_prev_dir"))
    runs = df.where(F.col("dir") != 0).groupBy(*s.keys, "run").agg(
        F.first("dir").alias("direction"),
        F.min("rn").alias("entry_rn"),
        F.max("rn").alias("last_rn"),
        F.max("bars").alias("bars"),
        F.min_by("next_open", "rn").alias("entry_price"),
        F.min_by("next_ts", "rn").alias("entry_time"),
        F.max_by("next2_open", "rn").alias("exit_price"),
        F.max_by("next2_ts", "rn").alias("exit_time"),
        F.sum("pnl").alias("pnl"),
    )
    # a run that reaches the end of the data is closed at the last row
    exit_rn = F.least(F.col("last_rn") + 1, F.col("bars"))
    return runs.withColumn("hold_bars", exit_rn - F.col("entry_rn")).drop("last_rn", "bars")


def trade_summary(trade: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    """B9 and the win statistics of ``trades``."""
    win = F.avg(F.when(F.col("pnl") > 0, F.col("pnl")))
    loss = F.avg(F.when(F.col("pnl") < 0, -F.col("pnl")))
    return trade.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.avg("hold_bars").alias("avg_hold_bars"),
        (win / loss).alias("profit_loss_ratio"),
        F.sum("pnl").alias("total_pnl"),
    )


def segment_trades(pnl: DataFrame, s: Series = Series(), step: float = 0.01) -> DataFrame:
    """Segments between position changes larger than ``step``, summarised per series."""
    df = pnl.withColumn("_was", s.lag("pos", 1))
    df = with_run(df, s, F.abs(F.col("pos") - F.col("_was")) > step)
    segments = df.groupBy(*s.keys, "run").agg(
        F.min_by("pos", "rn").alias("pos"), F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("length")
    )
    pnl_, held = F.col("pnl"), F.abs("pos") >= step
    win, loss = held & (pnl_ > 0), held & (pnl_ <= 0)
    trading = F.sum(held.cast("int"))

    def avg(condition: Column, x: Column = pnl_) -> Column:
        return F.coalesce(F.avg(F.when(condition, x)), F.lit(0.0))

    gross_loss = F.abs(F.coalesce(F.sum(F.when(loss, pnl_)), F.lit(0.0)))
    out = segments.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("segments"),
        trading.alias("n_trades"),
        F.sum((held & (F.col("pos") > 0)).cast("int")).alias("n_long"),
        F.sum((held & (F.col("pos") < 0)).cast("int")).alias("n_short"),
        F.sum((~held).cast("int")).alias("n_flat"),
        (F.sum(win.cast("int")) / F.greatest(trading, F.lit(1))).alias("win_rate"),
        avg(win).alias("avg_win"),
        avg(loss).alias("avg_loss"),
        (F.coalesce(F.sum(F.when(win, pnl_)), F.lit(0.0)) / F.greatest(gross_loss, F.lit(1e-8))).alias("profit_factor"),
        F.coalesce(F.max(F.when(held, pnl_)), F.lit(0.0)).alias("max_win"),
        F.coalesce(F.min(F.when(held, pnl_)), F.lit(0.0)).alias("max_loss"),
        avg(held).alias("avg_trade_pnl"),
        avg(held, F.col("length")).alias("avg_hold_bars"),
    )
    # a position that never changes is not a trade
    changed = F.col("segments") > 1
    fields = [c for c in out.columns if c not in (*s.keys, "segments")]
    return out.select(*s.keys, *[F.when(changed, F.col(c)).otherwise(F.lit(0)).alias(c) for c in fields])


def longest_losing_run(pnl: DataFrame, s: Series = Series()) -> DataFrame:
    """B10"""
    df = with_run(pnl, s, F.col("pnl") >= 0)
    runs = df.groupBy(*s.keys, "run").agg(F.count(F.when(F.col("pnl") < 0, 1)).alias("n"))
    return runs.groupBy(*s.keys).agg(F.max("n").alias("max_consecutive_losses"))


def holding_runs(pnl: DataFrame, s: Series, sign: Column) -> DataFrame:
    """Lengths of the runs of a constant non-zero ``sign``."""
    df = pnl.withColumn("_sign", sign)
    df = df.withColumn("_was", s.lag("_sign", 1))
    df = with_run(df, s, F.col("_was").isNull() | (F.col("_sign") != F.col("_was")))
    return df.where(F.col("_sign") != 0).groupBy(*s.keys, "run").agg(F.count(F.lit(1)).alias("length"))


def average_hold(pnl: DataFrame, s: Series = Series()) -> DataFrame:
    """B11; a series that is never in the market has no row."""
    return holding_runs(pnl, s, F.signum("pos")).groupBy(*s.keys).agg(F.avg("length").alias("avg_hold"))


def turnover_quality(runs: Column, bars: Column, avg_hold: Column) -> Column:
    """How close the number of trades is to one per 12 bars, plus a holding bonus."""
    ratio = runs / F.greatest(bars / 12.0, F.lit(1.0))
    log2 = F.log(F.greatest(ratio, F.lit(1e-12))) / math.log(2.0)
    score = (
        F.when(ratio <= 0, -2.0)
        .when(ratio < 0.05, -2.0 + ratio / 0.05)
        .when(ratio < 0.5, -1.0 + (ratio - 0.05) / 0.45)
        .when(ratio <= 2.0, F.exp(-0.5 * log2 * log2))
        .when(ratio <= 8.0, 0.5 - (ratio - 2.0) / 6.0 * 1.5)
        .otherwise(-2.0)
    )
    hold = F.log(F.greatest(F.coalesce(avg_hold, F.lit(1.0)), F.lit(1.0)))
    return score + F.when(runs > 0, F.least(F.lit(0.3), hold / math.log(30.0) * 0.3)).otherwise(0.0)


# -- penalties and scores --------------------------------------------------------------
def side_penalty(long_share: Column, short_share: Column) -> Column:
    """A factor on one side most of the time is not a factor."""
    top = F.greatest(long_share, short_share)
    return F.when(top > 0.85, -2.0 * (top - 0.85) / 0.15).when(top > 0.70, -0.5 * (top - 0.70) / 0.15).otherwise(0.0)


def exposure_penalty(mean_abs: Column) -> Column:
    return F.when(mean_abs < 0.10, (mean_abs / 0.10 - 1.0) * 2.0).otherwise(0.0)


def turnover_penalty(mean_turnover: Column) -> Column:
    return -clamp((mean_turnover - 0.2) * 3.0, 0.0, 3.0)


def half_bonus(first: Column, second: Column, bars: Column) -> Column:
    """B14"""
    agree = F.when((first > 0) & (second > 0), 0.5).when(first * second < 0, -1.0).otherwise(0.0)
    return F.when(bars < 20, 0.0).otherwise(agree)


def reversal_bonus(ac1: Column) -> Column:
    """B17 per series: low or negative lag-1 autocorrelation of the factor is rewarded."""
    base = 1.0 - F.abs(ac1)
    return clamp(F.when(ac1 < 0, base + 0.5).otherwise(base), -1.0, 2.0)


def symmetry_bonus(long_share: Column, short_share: Column) -> Column:
    return clamp(1.0 - 2.0 * (F.abs(long_share - 0.5) + F.abs(short_share - 0.5)), -1.0, 1.0)


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation; 0 where one side is (nearly) constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sx < 1e-6) | (sy < 1e-6), F.lit(None)).otherwise(F.covar_pop(a, b) / (sx * sy + 1e-8))


def oos_multiplier(oos_sortino: Column) -> Column:
    """A losing out-of-sample part shrinks the score, a winning one lifts it slightly."""
    return F.when(oos_sortino <= 0, F.greatest(F.lit(0.1), 0.5 + oos_sortino * 0.4)).otherwise(
        F.least(F.lit(1.2), 1.0 + oos_sortino * 0.1)
    )


# Fixed weights of the score by (mode, several codes).
SCORE_WEIGHTS = {
    ("default", False): {"ann_ret": 0.60, "sortino": 0.15, "calmar": 0.10, "ts_ic": 0.10, "quality": 0.05},
    ("ftmo", False): {"ann_ret": 0.80, "sortino": 0.05, "calmar": 0.10, "ts_ic": 0.03, "quality": 0.02},
    ("forex", False): {
        "ann_ret": 0.25, "sortino": 0.05, "calmar": 0.05, "ts_ic": 0.25, "reversal": 0.20, "symmetry": 0.15,
        "quality": 0.05,
    },
    ("default", True): {
        "ann_ret": 0.60, "sortino": 0.10, "calmar": 0.05, "ts_ic": 0.10, "consistency": 0.05, "stress": 0.05,
        "quality": 0.05,
    },
    ("ftmo", True): {
        "ann_ret": 0.75, "sortino": 0.05, "calmar": 0.10, "ts_ic": 0.02, "consistency": 0.03, "stress": 0.02,
        "quality": 0.03,
    },
}


def score(mode: str, several: bool) -> Column:
    """B18 over the columns of ``score_inputs``."""
    weights = SCORE_WEIGHTS.get((mode, several), SCORE_WEIGHTS[("default", several)])
    total = F.col("exposure_pen") + F.col("side_pen") + F.col("half")
    for name, weight in weights.items():
        total = total + weight * F.col(name)
    return total


def score_inputs(pnl: DataFrame, s: Series = Series()) -> DataFrame:
    """The components of the single-series score, one row per series.

    ``pnl`` needs rn, bars, pos, ret, turnover, pnl and factor with rn counted from 1 to bars.
    """
    df = cumulative(pnl, s).withColumns({"_fprev": s.lag("factor", 1)})
    df = df.withColumns({"_whole": F.col("pos").cast("int"), "_half": F.floor(F.col("bars") / 2)})
    first, second = F.col("rn") <= F.col("_half"), F.col("rn") > F.col("_half")
    pairs = F.when(F.col("_fprev").isNotNull(), F.col("factor"))
    base = df.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("bars"),
        (F.avg("pnl") * PERIODS_PER_YEAR).alias("ann_ret"),
        sortino().alias("sortino"),
        F.max("drawdown").alias("_dd"),
        safe_corr(F.col("factor"), F.col("ret")).alias("_ic"),
        F.avg((F.col("pos") > 0.05).cast("double")).alias("_long"),
        F.avg((F.col("pos") < -0.05).cast("double")).alias("_short"),
        F.avg((F.col("pos") > 0).cast("double")).alias("_up"),
        F.avg((F.col("pos") < 0).cast("double")).alias("_down"),
        F.avg(F.abs("pos")).alias("_exposure"),
        F.avg("turnover").alias("_turnover"),
        sortino_if(first).alias("_s1"),
        sortino_if(second).alias("_s2"),
        F.coalesce(safe_corr(pairs, F.col("_fprev")), F.lit(0.0)).alias("_ac1"),
        sortino(F.col("pos") * F.col("ret") - F.col("turnover") * (2 * COST_RATE)).alias("_stress"),
    )
    runs = holding_runs(df, s, F.col("_whole")).groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("_runs"), F.avg("length").alias("_hold")
    )
    joined = base.join(runs, list(s.keys), "left")
    runs_n = F.coalesce(F.col("_runs"), F.lit(0))
    ic = F.when(F.col("bars") < 10, 0.0).otherwise(clamp(F.coalesce(F.col("_ic"), F.lit(0.0)) / 1e-6, -3.0, 3.0))
    return joined.withColumns(
        {
            "calmar": clamp(F.col("ann_ret") / F.greatest(F.col("_dd"), F.lit(1e-8)), -10.0, 10.0),
            "ts_ic": ic,
            "quality": turnover_quality(runs_n, F.col("bars"), F.col("_hold")),
            "exposure_pen": exposure_penalty(F.col("_exposure")),
            "side_pen": side_penalty(F.col("_long"), F.col("_short")),
            "half": half_bonus(F.col("_s1"), F.col("_s2"), F.col("bars")),
            "reversal": reversal_bonus(F.col("_ac1")),
            "symmetry": symmetry_bonus(F.col("_up"), F.col("_down")),
            "stress": clamp(F.col("_stress"), -5.0, 5.0),
            "turnover_pen": turnover_penalty(F.col("_turnover")),
        }
    ).select(
        *s.keys, "bars", "ann_ret", "sortino", "calmar", "ts_ic", "quality", "exposure_pen", "side_pen", "half",
        "reversal", "symmetry", "stress", "turnover_pen",
    )


def symbol_consistency(per_code: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rules over per-code ``sortino`` and ``n_trades`` with ``bars`` evaluated bars."""
    enough = F.greatest(F.lit(5), F.floor(F.col("bars") / 100))
    df = per_code.withColumn("_active", F.col("n_trades") >= enough)
    out = df.groupBy(*by).agg(
        F.avg((~F.col("_active")).cast("double")).alias("inactive_share"),
        F.min("sortino").alias("worst"),
        F.avg(F.when(F.col("_active"), (F.col("sortino") > 0).cast("double"))).alias("positive_share"),
    )
    ratio = F.col("positive_share")
    graded = F.when(ratio < 0.6, (ratio - 0.6) / 0.6).otherwise((ratio - 0.6) / 0.4)
    graded = graded + F.when(ratio == 1.0, 0.5).otherwise(0.0)
    rule = (
        F.when(F.col("inactive_share") > 0.4, -3.0)
        .when(F.col("worst") < -2.0, -2.0)
        .when(ratio.isNull(), -3.0)
        .otherwise(graded)
    )
    return out.withColumn("consistency", rule)


def several_score_inputs(pnl: DataFrame, s: Series = Series()) -> DataFrame:
    """The components of the score of one factor over several codes (one row).

    Return, Sortino and Calmar run over all (code, bar) pairs in code order.  The cumulative
    P&L across codes is put together from per-code totals and peaks, so no task sees more than
    one series.
    """
    df = cumulative(pnl, s)
    per_code = df.groupBy("code").agg(F.sum("pnl").alias("total"), F.max("cum").alias("top"))
    in_order = Window.orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_code.withColumn("start", F.coalesce(F.sum("total").over(in_order), F.lit(0.0)))
    offsets = offsets.withColumn("before", F.max(F.col("start") + F.col("top")).over(in_order))
    chained = df.join(offsets.select("code", "start", "before"), "code")
    level = F.col("start") + F.col("cum")
    peak = F.greatest(F.col("start") + F.col("peak"), F.col("before"))  # skips the NULL of the first code
    half = F.floor(F.col("bars") / 2)
    first, second = F.col("rn") <= half, F.col("rn") > half
    pooled = chained.agg(
        F.max("bars").alias("bars"),
        F.count(F.lit(1)).alias("_rows"),
        (F.avg("pnl") * PERIODS_PER_YEAR).alias("ann_ret"),
        sortino().alias("sortino"),
        F.max(peak - level).alias("_dd"),
        F.avg((F.col("pos") > 0.05).cast("double")).alias("_long"),
        F.avg((F.col("pos") < -0.05).cast("double")).alias("_short"),
        F.avg(F.abs("pos")).alias("_exposure"),
        F.avg("turnover").alias("_turnover"),
        sortino_if(first).alias("_s1"),
        sortino_if(second).alias("_s2"),
        sortino(F.col("pos") * F.col("ret") - F.col("turnover") * (2 * COST_RATE)).alias("_stress"),
    )
    moved = df.withColumn("_move", F.abs(F.abs("pos") - F.abs(s.lag("pos", 1))))
    codes = moved.groupBy("code").agg(
        sortino().alias("sortino"),
        F.sum((F.col("_move") > 0.1).cast("int")).alias("n_trades"),
        F.max("bars").alias("bars"),
        safe_corr(F.col("factor"), F.col("ret")).alias("ic"),
    )
    consistency = symbol_consistency(codes).select("consistency")
    ics = codes.agg(F.avg("ic").alias("m"), F.stddev_pop("ic").alias("d"))
    stability = ics.select(F.coalesce(clamp(F.col("m") / (F.col("d") + 1e-6), -3.0, 3.0), F.lit(0.0)))
    runs = holding_runs(df.withColumn("_whole", F.col("pos").cast("int")), s, F.col("_whole")).agg(
        F.count(F.lit(1)).alias("_runs"), F.avg("length").alias("_hold")
    )
    return pooled.select(
        "ann_ret",
        "sortino",
        clamp(F.col("ann_ret") / F.greatest(F.col("_dd"), F.lit(1e-8)), -10.0, 10.0).alias("calmar"),
        stability.scalar().alias("ts_ic"),
        consistency.scalar().alias("consistency"),
        clamp(F.col("_stress"), -5.0, 5.0).alias("stress"),
        turnover_quality(
            runs.select("_runs").scalar(), F.col("_rows").cast("double"), runs.select("_hold").scalar()
        ).alias("quality"),
        exposure_penalty(F.col("_exposure")).alias("exposure_pen"),
        side_penalty(F.col("_long"), F.col("_short")).alias("side_pen"),
        half_bonus(F.col("_s1"), F.col("_s2"), F.col("bars")).alias("half"),
        turnover_penalty(F.col("_turnover")).alias("turnover_pen"),
    )


def restart(pnl: DataFrame, part: Column, keys: Sequence[str] = ("code",), part_name: str = "part") -> DataFrame:
    """Cut each series into labelled parts (folds, train/test) with rn and bars counted per part.

    Positions and P&L keep their values: only the numbering starts again.
    """
    whole = Window.partitionBy(*keys, part_name)
    df = pnl.withColumn(part_name, part).where(F.col(part_name).isNotNull())
    return df.withColumns(
        {"rn": F.row_number().over(whole.orderBy("ts")), "bars": F.count(F.lit(1)).over(whole)}
    )


def blocks_sum(pnl: DataFrame, size: int, keep_tail: bool, keys: Sequence[str] = ("code",)) -> DataFrame:
    """Sums of consecutive blocks of ``size`` bars."""
    block = F.floor((F.col("rn") - 1) / size).alias("block")
    out = pnl.groupBy(*keys, block).agg(
        F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first_ts")
    )
    return out if keep_tail else out.where(F.col("n_bars") == size)


def daily_limits(daily: DataFrame, s: Series, max_overall: float = 0.10, target: float = 0.10) -> DataFrame:
    """B25 over daily P&L fractions ordered by ``block``."""
    so_far = s.so_far()
    df = daily.withColumn("cum", F.sum("pnl").over(so_far))
    # the peak looks at balances before each day, starting from the initial balance
    df = df.withColumn("_before", F.col("cum") - F.col("pnl"))
    df = df.withColumns(
        {
            "peak": F.greatest(F.max("_before").over(so_far), F.lit(0.0)),
            "day": F.sum((F.abs("pnl") > 1e-11).cast("int")).over(so_far),
        }
    )
    loss = F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0)
    return df.groupBy(*s.keys).agg(
        F.max(loss).alias("max_daily_loss"),
        F.sum((F.col("cum") < F.col("peak") - max_overall).cast("int")).alias("violations"),
        F.max("day").alias("trading_days"),
        F.min(F.when(F.col("cum") >= target, F.col("day"))).alias("target_day"),
    )
