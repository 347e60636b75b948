"""Inputs of a portfolio allocation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.evaluate import moving_block_bootstrap
from factorloom.operators.signals import midrank
from factorloom.session import stored


def calibration_days(df: DataFrame, score: str, y: str, keep: int = 504) -> DataFrame:
    """A1: per date the means of q, y, q*q and q*y (q = midrank of the score); the last ``keep`` dates.

    The rank uses every scored row of a date, the means only rows with a label.
    """
    q = midrank(F.col(score), Window.partitionBy("date"))
    rows = df.withColumn("_q", q).where(F.col("_q").isNotNull() & F.col(y).isNotNull())
    days = rows.groupBy("date").agg(
        F.avg("_q").alias("q"), F.avg(y).alias("y"), F.avg(F.col("_q") * F.col("_q")).alias("qq"), F.avg(F.col("_q") * F.col(y)).alias("qy")
    )
    newest = days.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("date"))))
    return newest.where(F.col("_n") <= keep).drop("_n")


def coefficients(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A1: monotone date-balanced line y = intercept + slope * q with slope >= 0."""
    m = days.groupBy(*by).agg(*[F.avg(c).alias(f"_{c}") for c in ("q", "y", "qq", "qy")])
    slope = (F.col("_qy") - F.col("_q") * F.col("_y")) / F.greatest(F.col("_qq") - F.col("_q") * F.col("_q"), F.lit(1e-12))
    m = m.withColumn("slope", F.greatest(F.lit(0.0), slope))
    return m.select(*by, (F.col("_y") - F.col("slope") * F.col("_q")).alias("intercept"), "slope")


def coefficient_covariance(days: DataFrame, block: int = 20, draws: int = 2000, seed: int = 20260917) -> DataFrame:
    """A2: sample covariance of the coefficients over moving-block resamples of the dates."""
    series = days.withColumn("position", F.row_number().over(Window.orderBy("date")) - 1)
    sampled = moving_block_bootstrap(series, ["q", "y", "qq", "qy"], block, draws, seed)
    boot = coefficients(sampled, ["draw"])
    return boot.agg(
        F.var_samp("intercept").alias("var_intercept"),
        F.covar_samp("intercept", "slope").alias("cov"),
        F.var_samp("slope").alias("var_slope"),
        F.percentile("slope", 0.05).alias("slope_q05"),
    )


def expected_return(q: Column, intercept: Column, slope: Column, cov: tuple[Column, Column, Column]) -> dict[str, Column]:
    """A3: a + b*q and its standard error sqrt(x' C x) with x = (1, q)."""
    variance = cov[0] + 2 * q * cov[1] + q * q * cov[2]
    return {"expected_return": intercept + slope * q, "standard_error": F.sqrt(F.greatest(variance, F.lit(0.0)))}


#: Periods of one slice of the tiled product.
SLICE = 2000


def block_covariance(x: DataFrame, at: str, code: str, value: str, blocks: int = 8, slices: Column | int = 1) -> DataFrame:
    """(a, b, s): sums of products of the centred series of all pairs of codes, over the periods.

    The codes are dealt into ``blocks`` groups and the periods into ``slices``.  Each unordered pair of groups and
    each slice is one NumPy product, whose cells are then added up over the slices: a value travels ``blocks`` times
    instead of once per partner, no pair of rows is ever emitted, and neither many codes nor a long history
    meets one task.  Choose ``blocks`` so that two groups of series of one slice fit one task.  Each code needs a value at
    each period.
    """
    slices = F.lit(slices) if isinstance(slices, int) else slices
    own, other = F.col("_own"), F.col("_other")
    dealt = x.select(
        at, code, value, F.pmod(F.hash(code), F.lit(blocks)).alias("_own"), F.pmod(F.hash(at), slices.cast("int")).alias("_slice"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other"),
    ).select(at, code, value, "_slice", "_own", F.least(own, other).alias("_i"), F.greatest(own, other).alias("_j"))
    kind = dict(x.dtypes)[code]

    def product(tile: pd.DataFrame) -> pd.DataFrame:
        i, j = tile["_i"].iloc[0], tile["_j"].iloc[0]
        wide = [tile[tile["_own"] == g].pivot(index=at, columns=code, values=value) for g in (i, j)]
        if wide[0].empty or wide[1].empty:
            none = tile.iloc[:0]
            return pd.DataFrame({"a": none[code], "b": none[code], "s": none[value]})
        sums = wide[0].to_numpy().T @ wide[1].reindex(wide[0].index).to_numpy()
        rows, columns = np.meshgrid(wide[0].columns.to_numpy(), wide[1].columns.to_numpy(), indexing="ij")
        out = pd.DataFrame({"a": rows.ravel(), "b": columns.ravel(), "s": sums.ravel()})
        return out if i == j else pd.concat([out, out.rename(columns={"a": "b", "b": "a"})[["a", "b", "s"]]])

    tiles = dealt.groupBy("_i", "_j", "_slice").applyInPandas(product, f"a {kind}, b {kind}, s double")
    return tiles.groupBy("a", "b").agg(F.sum("s").alias("s"))


def shrunk_covariance(
    returns: DataFrame, at: str = "period", code: str = "code", value: str = "r", blocks: int = 8, span: int = SLICE
) -> DataFrame:
    """A4: Ledoit-Wolf covariance (scaled identity target) of the codes with a complete history.

    ``returns`` has one row per (period, code) and is read several times, so give a stored table.  The products are
    written once; ``span`` is the number of periods that one task multiplies.
    """
    periods = returns.agg(F.countDistinct(at).alias("n")).scalar()
    complete = returns.groupBy(code).agg(F.count(value).alias("_n"), F.avg(value).alias("_m")).where(F.col("_n") == periods)
    x = returns.join(complete, code).select(at, code, (F.col(value) - F.col("_m")).alias("x"))
    product = block_covariance(x, at, code, "x", blocks, F.ceil(periods / span))
    s = stored(product.withColumn("s", F.col("s") / periods), "products")
    traces = x.groupBy(at).agg(F.sum(F.col("x") * F.col("x")).alias("_q"))
    beta_sum = traces.agg(F.sum(F.col("_q") * F.col("_q")).alias("v")).scalar()
    n = F.col("n")
    stats = s.agg(
        F.sum(F.col("s") * F.col("s")).alias("d"),
        F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))).alias("t"),
        F.count(F.when(F.col("a") == F.col("b"), 1)).cast("double").alias("p"),
    ).withColumns({"n": periods.cast("double"), "_b": beta_sum})
    p, mu = F.col("p"), F.col("t") / F.col("p")
    delta = (F.col("d") - 2 * mu * F.col("t") + p * mu * mu) / p
    beta = (F.col("_b") / n - F.col("d")) / (p * n)
    stats = stats.select(mu.alias("mu"), F.when(delta > 0, F.least(beta, delta) / delta).otherwise(0.0).alias("shrinkage"))
    shrink, level = stats.select("shrinkage").scalar(), stats.select("mu").scalar()
    target = F.when(F.col("a") == F.col("b"), level).otherwise(0.0)
    return s.select("a", "b", ((1 - shrink) * F.col("s") + shrink * target).alias("covariance"), shrink.alias("shrinkage"))


# Component rates of one trade.
COST_MODEL = {
    "commission_rate": 0.00025, "transfer_rate": 0.00001, "buy_tax_rate": 0.0, "sell_tax_rate": 0.0005, "slippage_rate": 0.0005,
    "minimum_commission": 5.0,
}


def trade_cost(delta: Column, account: float, model=COST_MODEL) -> dict[str, Column]:
    """A5: proportional cost of a weight change and the extra of the minimum commission."""
    common = model["commission_rate"] + model["transfer_rate"] + model["slippage_rate"]
    buy, sell = common + model["buy_tax_rate"], common + model["sell_tax_rate"]
    size = F.abs(delta)
    extra = F.greatest(F.lit(0.0), F.lit(model["minimum_commission"] / account) - size * model["commission_rate"])
    return {
        "proportional": F.when(delta > 0, delta * buy).otherwise(-delta * sell),
        "minimum_extra": F.when(size > 1e-10, extra).otherwise(0.0),
    }


def capacity(target: Column, current: Column, median_amount: Column, mean_amount: Column, account: float, floor: float = 20e6) -> dict[str, Column]:
    """Liquidity status of an increase and the weight bounds of 1% of the mean traded amount."""
    more = target > current + 1e-9
    room = 0.01 * mean_amount / account
    status = (
        F.when(more & (median_amount.isNull() | mean_amount.isNull()), "LIQUIDITY_INFORMATION_MISSING")
        .when(more & (median_amount < floor), "BLOCKED_LIQUIDITY")
        .otherwise("OK")
    )
    blocked = median_amount.isNull() | (median_amount < floor) | mean_amount.isNull()
    return {
        "status": status,
        "upper": F.when(blocked, current).otherwise(current + room),
        "lower": F.greatest(F.lit(0.0), F.when(mean_amount.isNull(), 0.0).otherwise(current - room)),
    }


def reference_weights(variance: Column, budget: float, by: Sequence[str]) -> dict[str, Column]:
    """Inverse-volatility and equal weights scaled to the budget."""
    w = Window.partitionBy(*by)
    inverse = F.when(variance > 0, 1.0 / F.sqrt(variance))
    usable = F.when(variance > 0, 1.0)
    return {
        "inverse_volatility": budget * inverse / F.sum(inverse).over(w),
        "equal": budget * usable / F.sum(usable).over(w),
    }


def sharpe_weight(sharpe: Column, reference: float, low: float = 0.5, high: float = 1.5, exponent: float = 0.5) -> Column:
    """Weight of a symbol from its Sharpe ratio; unknown gives 1."""
    clamped = F.greatest(F.lit(low), F.least(F.lit(high), F.pow(sharpe / reference, F.lit(exponent))))
    return F.when(sharpe.isNull(), 1.0).when(sharpe <= 0, low).otherwise(clamped)


def volatility_parity(df: DataFrame, reference: Column, value_per_unit: Column, weight: Column, reference_lot: float = 0.01) -> DataFrame:
    """Expected lot with the same money per ATR as the reference symbol, and the alert on held lots.

    ``df`` has one row per symbol with atr, signal and held.
    """
    target = df.where(reference).agg(F.first(reference_lot * F.col("atr") * value_per_unit).alias("t")).scalar()
    df = df.withColumn("expected", F.when(F.abs("signal") > 0, F.abs("signal") * weight * target / (F.col("atr") * value_per_unit)).otherwise(0.0))
    ratio = F.when(F.col("expected") > 0, F.col("held") / F.col("expected")).otherwise(0.0)
    df = df.withColumn("ratio", ratio)
    alert = F.when((F.col("expected") > 0) & (F.col("ratio") > 1.35), "ABOVE_EXPECTED").when(
        (F.col("expected") == 0) & (F.col("held") > 0), "HELD_WHILE_FLAT"
    )
    return df.withColumn("alert", alert)
