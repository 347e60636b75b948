"""Cross-sectional signals and leave-one-out statistics.

Cross-section windows are partitioned by date (and industry): a partition holds at most one row
per code.  Leave-one-out values come from group totals minus the row itself, never from pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.scalar import safe_log_return
from factorloom.functions.series import Series
from factorloom.plans.formula import average_rank

PANEL = Series(keys=("code",), order="date", at=("date",))


# -- ranks -----------------------------------------------------------------------------
def rank_pct(x: Column, window) -> Column:
    """Average-tie rank over the count of non-NULL values."""
    return average_rank(x, window) / F.count(x).over(window)


def clipped(x: str, window, low: float = 0.01, high: float = 0.99) -> Column:
    """x clipped to the linear quantiles of its cross-section."""
    bounds = F.percentile(x, [low, high]).over(window)
    return F.when(F.col(x).isNotNull(), F.greatest(F.least(F.col(x), bounds[1]), bounds[0]))


def winsor_rank(df: DataFrame, names: Sequence[str], by: Sequence[str] = ("date",)) -> DataFrame:
    """Adds ``<name>_rank`` for every name."""
    window = Window.partitionBy(*by)
    df = df.withColumns({f"_c_{n}": clipped(n, window) for n in names})
    df = df.withColumns({f"{n}_rank": rank_pct(F.col(f"_c_{n}"), window) for n in names})
    return df.drop(*[f"_c_{n}" for n in names])


def midrank(x: Column, window) -> Column:
    """Average rank minus a half, over the count, centred at 0."""
    return (average_rank(x, window) - 0.5) / F.count(x).over(window) - 0.5


def ensemble(ranks: Sequence[str]) -> Column:
    """Mean of the ranks, NULL if any is missing."""
    total = F.col(ranks[0])
    for r in ranks[1:]:
        total = total + F.col(r)
    return total / len(ranks)


def member_rank(x: Column, window) -> Column:
    """rank pct where at least two values are valid."""
    return F.when(F.count(x).over(window) >= 2, rank_pct(x, window))


def member_demean(x: Column, window) -> Column:
    """F67"""
    return x - F.avg(x).over(window)


def member_zscore(x: Column, window) -> Column:
    std = F.stddev_pop(x).over(window)
    return F.when((F.count(x).over(window) >= 2) & (std >= 1e-12), (x - F.avg(x).over(window)) / std)


# -- leave-one-out ---------------------------------------------------------------------
def loo(x: Column, window) -> dict[str, Column]:
    """Count, mean and population deviation of the other valid rows of the group."""
    own = F.when(x.isNotNull(), 1).otherwise(0)
    value = F.coalesce(x, F.lit(0.0))
    count = F.count(x).over(window) - own
    some = F.when(count > 0, count)
    mean = (F.coalesce(F.sum(x).over(window), F.lit(0.0)) - value) / some
    square = (F.coalesce(F.sum(x * x).over(window), F.lit(0.0)) - value * value) / some
    std = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    return {"count": count, "mean": mean, "std": F.when(count >= 2, std)}


def loo_fraction(indicator: Column, valid: Column, window) -> Column:
    """Share of the indicator among the other valid rows."""
    hit = F.when(valid & indicator, 1).otherwise(0)
    ok = F.when(valid, 1).otherwise(0)
    others = F.sum(ok).over(window) - ok
    return (F.sum(hit).over(window) - hit) / F.when(others > 0, others)


def grouped(window_keys: Sequence[str]):
    return Window.partitionBy(*window_keys)


# -- stock signals ---------------------------------------------------------------------
def stock_signals(bars: DataFrame, close: str = "close", s: Series = PANEL) -> DataFrame:
    """X2-X4 on quoted rows: r_1d, MOM_20, REV_5, LOW_VOL_20 and median_amount_20."""
    now = F.col(close)
    df = bars.withColumns(
        {
            "r_1d": safe_log_return(now, s.lag(close, 1)),
            "MOM_20": safe_log_return(now, s.lag(close, 20)),
            "REV_5": -safe_log_return(now, s.lag(close, 5)),
        }
    )
    frame = s.last(20)

    def full(x: str, value: Column) -> Column:
        return F.when(F.count(x).over(frame) == 20, value)

    return df.withColumns(
        {
            "LOW_VOL_20": full("r_1d", -F.stddev_pop("r_1d").over(frame)),
            "median_amount_20": full("amount", F.percentile("amount", 0.5).over(frame)),
        }
    )


def market_context(df: DataFrame, ret: str = "r_1d") -> DataFrame:
    """Market mean and breadth of each date and the 20-session volatility of the mean.

    The daily table has one row per session; the row table joins it by date.
    """
    daily = df.groupBy("date").agg(
        F.avg(ret).alias("market_return_1d"), F.avg((F.col(ret) > 0).cast("double")).alias("market_breadth")
    )
    frame = Window.orderBy("date").rowsBetween(-19, 0)
    volatility = F.when(
        F.count("market_return_1d").over(frame) == 20, F.stddev_pop("market_return_1d").over(frame)
    )
    return df.join(daily.withColumn("market_volatility_20", volatility), "date")


def industry_context(df: DataFrame, ret: str = "r_1d", industry: str = "industry") -> DataFrame:
    """Leave-one-out return, count and breadth of the industry, and the residuals."""
    wg = Window.partitionBy("date", industry)
    known = F.col(industry).isNotNull()
    stats = loo(F.col(ret), wg)
    breadth = loo_fraction(F.col(ret) > 0, F.col(ret).isNotNull(), wg)
    df = df.withColumns(
        {
            "industry_member_count_loo": F.when(known, stats["count"]),
            "industry_return_1d_loo": F.when(known, stats["mean"]),
            "_others": F.when(known, stats["count"]),
            "industry_breadth_loo": F.when(known, breadth),
        }
    )
    # a row without its own return still sees the share of its valid peers
    return df.withColumns(
        {
            "industry_relative_market_1d": F.col("industry_return_1d_loo") - F.col("market_return_1d"),
            "stock_residual_1d": F.col(ret) - F.col("industry_return_1d_loo"),
        }
    ).drop("_others")


def candidate_features(df: DataFrame, s: Series = PANEL) -> DataFrame:
    """X11: eight candidate features of a member panel."""
    wd, wg = Window.partitionBy("date"), Window.partitionBy("date", "industry")
    mom, known = F.col("MOM_20"), F.col("industry").isNotNull()
    spell = Series(keys=("code", "entry_effective_date", "industry"), order="date")
    frame = spell.last(20)
    blocked = ~(
        F.coalesce("has_quote", F.lit(False)) & F.coalesce("can_buy_open", F.lit(False))
        & F.coalesce("can_sell_open", F.lit(False))
    )
    status_known = F.col("has_quote").isNotNull() & F.col("can_buy_open").isNotNull() & F.col("can_sell_open").isNotNull()
    entry, previous_entry = F.col("entry_effective_date"), s.lag("entry_effective_date", 1)
    fresh = (F.col("date") == entry) | F.coalesce(previous_entry != entry, F.lit(False))
    before = F.when(F.coalesce(fresh, F.lit(False)), 0.0).otherwise(s.lag("weight_pct", 1))
    age = F.datediff(F.col("date"), entry)
    return df.withColumns(
        {
            "market_residual_momentum_20": mom - loo(mom, wd)["mean"],
            "industry_loo_residual_momentum_20": F.when(known, mom - loo(mom, wg)["mean"]),
            "industry_dispersion_1d_loo": F.when(known, loo(F.col("r_1d"), wg)["std"]),
            "stock_residual_volatility_20": F.when(
                F.count("stock_residual_1d").over(frame) == 20, F.stddev_pop("stock_residual_1d").over(frame)
            ),
            "tradability_crowding_loo": F.when(known, loo_fraction(blocked, status_known, wg)),
            "index_weight_change_pct": F.col("weight_pct") - before,
            "membership_age_days": F.when(age >= 0, age),
        }
    )


# -- residual signals ------------------------------------------------------------------
def industry_residual(df: DataFrame, others: int = 5, ret: str = "r_1d", industry: str = "industry") -> DataFrame:
    """Return minus the mean of at least ``others`` other members of the industry."""
    eligible = F.col("is_member") & F.col(industry).isNotNull() & F.col(ret).isNotNull()
    x = F.when(eligible, F.col(ret))
    stats = loo(x, Window.partitionBy("date", industry))
    return df.withColumn("epsilon", F.when(eligible & (stats["count"] >= others), x - stats["mean"]))


def shrunk_residual(df: DataFrame, ret: str = "r_1d", industry: str = "industry", full: int = 5) -> DataFrame:
    """With fewer than ``full`` peers the reference moves towards the market."""
    r, known = F.col(ret), F.col(industry).isNotNull()
    peers = loo(F.when(known, r), Window.partitionBy("date", industry))
    market = loo(r, Window.partitionBy("date"))
    df = df.withColumns(
        {"peer_count": F.when(known, peers["count"]), "_ind": F.when(known, peers["mean"]), "_mkt": market["mean"]}
    )
    n = F.col("peer_count")
    w = F.least(n / float(full), F.lit(1.0))
    blended = w * F.coalesce("_ind", F.lit(0.0)) + (1 - w) * F.col("_mkt")
    reference = F.when(n >= full, F.col("_ind")).otherwise(blended)
    ok = known & r.isNotNull()
    return df.withColumns(
        {"strict": F.when(ok & (n >= full), r - F.col("_ind")), "shrink": F.when(ok, r - reference)}
    ).drop("_ind", "_mkt")


def slow_signals(grid: DataFrame, eps: str = "epsilon", s: Series = PANEL) -> DataFrame:
    """X14-X16 on the dense (session x code) grid; frames count sessions."""

    def over(frame):
        return F.sum(eps).over(frame), F.count(eps).over(frame)

    vol = s.last(60)
    mom_sum, mom_n = over(s.between(-119, -20))
    trend_frame = s.between(-59, -5)
    trend_sum, trend_n = over(trend_frame)
    moved = F.sum(F.abs(F.col(eps))).over(trend_frame)
    return grid.withColumns(
        {
            "IDIO_LOW_VOL_60": F.when(F.count(eps).over(vol) >= 54, -F.stddev_pop(eps).over(vol)),
            "RES_MOM_120_20": F.when(mom_n >= 90, 100.0 / F.when(mom_n > 0, mom_n) * mom_sum),
            "RES_TREND_EFF_60_5": F.when(trend_n >= 50, trend_sum / (moved + 1e-12)),
        }
    )


# Fixed values of the scenarios: residual, volatility window and minimum, momentum window, skip
# and minimum, trend window, skip and minimum.
SCENARIOS = {
    "baseline": ("strict", 60, 54, 120, 20, 90, 60, 5, 50),
    "shrink_only": ("shrink", 60, 54, 120, 20, 90, 60, 5, 50),
    "short_only": ("strict", 20, 18, 60, 10, 45, 20, 2, 17),
    "shrink_and_short": ("shrink", 20, 18, 60, 10, 45, 20, 2, 17),
}


def scenario_signals(grid: DataFrame, name: str, s: Series = PANEL) -> DataFrame:
    """low_vol, momentum and efficiency of one scenario over the dense grid."""
    x, vol, vol_min, mom, skip, mom_min, trend, trend_skip, trend_min = SCENARIOS[name]
    frame = s.last(vol)
    old = s.between(-(mom - 1), -skip)
    trend_old = s.between(-(trend - 1), -trend_skip)
    n_old, n_trend = F.count(x).over(old), F.count(x).over(trend_old)
    return grid.withColumns(
        {
            "low_vol": F.when(F.count(x).over(frame) >= vol_min, -F.stddev_pop(x).over(frame)),
            "momentum": F.when(n_old >= mom_min, F.sum(x).over(old) * (mom - skip) / F.when(n_old > 0, n_old)),
            "efficiency": F.when(
                n_trend >= trend_min, F.sum(x).over(trend_old) / (F.sum(F.abs(F.col(x))).over(trend_old) + 1e-12)
            ),
        }
    )
