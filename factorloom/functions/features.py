"""The 65 technical features of an OHLCV series.

Features are computed in four steps over *one* window spec per series, so that a wide feature
table costs one shuffle and one sort: (1) values that need the previous rows, (2) padded window
statistics, (3) statistics of statistics, (4) one Arrow pass for the rolling robust norm.
Exponential averages join between (2) and (3).  Cross-section features come last.
Only the columns that the requested features need are computed: Catalyst prunes the rest.

Values that are not finite (a close of 0 has the log return -inf) pass through the windows and become 0 where a feature
leaves: before the norm, or at the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.recursion import with_ema, with_robust_norm
from factorloom.functions.series import Series, clamp, clean

Steps = dict[str, Callable[[], Column]]
EPS = 1e-9
NORM_WIDTH = 200
# Rows before the current one that any bounded feature can see: 50-span averages fade out in
# 1 000 rows, then windows of up to 60 rows and two passes of the 200-row norm.
LOOKBACK = 1000 + 60 + 2 * NORM_WIDTH

# Fixed order of the features: it defines the token ids of integer formulas.
NAMES = (
    "RET RET5 RET20 MA_DIFF SLOPE20 ATR RVOL HL_RANGE VOL_REGIME DEV DEV60 RSI14 PRESSURE AC1 VOL_RATIO VOL_Z "
    "PV_CORR REL_RET5 REL_RET20 REL_VOL VWAP_DEV BOLL_POS BOLL_WIDTH MACD_HIST OBV_SLOPE MFI14 WILLR_14 CCI_14 "
    "ROC_12 TYPICAL_DEV EMA_RATIO_12_26 TREND_STRENGTH_50 PRICE_POS_50 TRIX_15 PPO ULT_OSC RET_ACCEL GK_VOL "
    "PARKINSON_VOL YANG_ZHANG_VOL RS_VOL AMIHUD_ILLIQ KYLE_LAMBDA CMF_20 AD_LINE_SLOPE STOCH_K_14 STOCH_D_3 "
    "AROON_OSC_25 DMI_ADX_14 DMI_DIFF_14 TRIX_SIGNAL DONCHIAN_POS_20 KELTNER_POS_20 ICHIMOKU_KIJUN_DEV "
    "ICHIMOKU_TENKAN_DEV SUPERTREND_DIR SAR_DIST ROLL_SKEW_20 ROLL_KURT_20 HURST_50 FRACTAL_DIM_30 AC2 "
    "RET_ENTROPY_20 CS_RANK_RET5 CS_ZSCORE_RET20"
).split()

# Features that leave through the rolling robust norm; the others are only cleaned.
NORMED = set(
    "RET RET5 RET20 MA_DIFF SLOPE20 ATR RVOL HL_RANGE VOL_REGIME DEV DEV60 VOL_RATIO VWAP_DEV BOLL_WIDTH MACD_HIST "
    "OBV_SLOPE ROC_12 TYPICAL_DEV EMA_RATIO_12_26 TREND_STRENGTH_50 TRIX_15 PPO RET_ACCEL GK_VOL PARKINSON_VOL "
    "YANG_ZHANG_VOL RS_VOL AMIHUD_ILLIQ KYLE_LAMBDA AD_LINE_SLOPE TRIX_SIGNAL ICHIMOKU_KIJUN_DEV ICHIMOKU_TENKAN_DEV "
    "SAR_DIST ROLL_SKEW_20 ROLL_KURT_20".split()
)
CROSS = {"REL_RET5": "RET5", "REL_RET20": "RET20", "REL_VOL": "RVOL", "CS_RANK_RET5": None, "CS_ZSCORE_RET20": None}

# Exponential averages by feature: new column -> (source, spans applied in turn).  The signal
# line needs no extra pass: EMA9(EMA12 - EMA26) = EMA9(EMA12) - EMA9(EMA26).
_EMAS = {
    "e12": ("close", (12,)),
    "e26": ("close", (26,)),
    "e12_9": ("close", (12, 9)),
    "e26_9": ("close", (26, 9)),
    "e20": ("close", (20,)),
    "e50": ("close", (50,)),
    "e15x3": ("close", (15, 15, 15)),
    "atr_e20": ("atr14", (20,)),
}
_EMAS_OF = {
    "MACD_HIST": ("e12", "e26", "e12_9", "e26_9"),
    "EMA_RATIO_12_26": ("e12", "e26"),
    "PPO": ("e12", "e26"),
    "TRIX_15": ("e15x3",),
    "TRIX_SIGNAL": ("e15x3",),
    "KELTNER_POS_20": ("e20", "atr_e20"),
    "SAR_DIST": ("e20", "e50"),
}


OHLCV = ("open", "high", "low", "close", "volume")


def _ohlcv() -> tuple[Column, ...]:
    """open, high, low, close, volume"""
    return tuple(F.col(x) for x in OHLCV)


def _sq(x: Column) -> Column:
    return x * x


def _ln_ratio(a: Column, b: Column) -> Column:
    return F.log((a + EPS) / (b + EPS))


def _lagged(s: Series) -> Steps:
    o, h, l, c, v = _ohlcv()
    def back(k: int) -> Column:
        # Spark's log has no value at or below 0: a close of 0 is -inf, as in IEEE, and spoils the windows that hold it
        ratio = c / (s.lag("close", k) + EPS)
        return F.when(ratio == 0, float("-inf")).when(ratio < 0, float("nan")).otherwise(F.coalesce(F.log(ratio), F.lit(0.0)))

    return {
        "rn": lambda: s.position(),
        "pc": lambda: F.coalesce(s.lag("close", 1), c),
        "ph": lambda: F.coalesce(s.lag("high", 1), h),
        "pl": lambda: F.coalesce(s.lag("low", 1), l),
        "r": lambda: back(1),
        "r5": lambda: back(5),
        "r20": lambda: back(20),
        "roc": lambda: F.coalesce(c / (s.lag("close", 12) + EPS) - 1.0, F.lit(0.0)),
        "tp": lambda: (h + l + c) / 3.0,
        "ptp": lambda: F.coalesce(s.lag((h + l + c) / 3.0, 1), (h + l + c) / 3.0),
    }


def _per_bar() -> Steps:
    o, h, l, c, v = _ohlcv()
    pc, ph, pl, r, tp = (F.col(x) for x in ("pc", "ph", "pl", "r", "tp"))
    ln2 = math.log(2.0)

    def satchell() -> Column:
        return _ln_ratio(h, c) * _ln_ratio(h, o) + _ln_ratio(l, c) * _ln_ratio(l, o)

    def garman() -> Column:
        return 0.5 * _sq(_ln_ratio(h, l)) - (2.0 * ln2 - 1.0) * _sq(_ln_ratio(c, o))

    return {
        "tr": lambda: F.greatest(h - l, F.abs(h - pc), F.abs(l - pc)),
        "gain": lambda: F.greatest(c - pc, F.lit(0.0)),
        "loss": lambda: F.greatest(pc - c, F.lit(0.0)),
        "step": lambda: F.abs(c - pc),
        "obv_step": lambda: F.signum(c - pc) * v,
        "mfv": lambda: ((c - l) - (h - c)) / (h - l + EPS) * v,
        "tpv": lambda: tp * v,
        "mf_up": lambda: F.when(tp > F.col("ptp"), tp * v).otherwise(0.0),
        "mf_down": lambda: F.when(tp < F.col("ptp"), tp * v).otherwise(0.0),
        "bp": lambda: c - F.least(l, pc),
        "tru": lambda: F.greatest(h, pc) - F.least(l, pc),
        "dm_up": lambda: F.greatest(h - ph, F.lit(0.0)),
        "dm_down": lambda: F.greatest(pl - l, F.lit(0.0)),
        "gk": lambda: F.greatest(garman(), F.lit(0.0)),
        "pk": lambda: _sq(_ln_ratio(h, l)) / (4.0 * ln2),
        "rs": lambda: satchell(),
        "yz": lambda: (_sq(_ln_ratio(o, pc)) + _sq(_ln_ratio(o, c)) + F.greatest(satchell(), F.lit(0.0))) / 3.0,
        "illiq": lambda: F.abs(r) / (v + EPS),
        "abs_r": lambda: F.abs(r),
        "signed_v": lambda: F.signum(r) * v,
        "up": lambda: (r > 0).cast("double"),
        "down": lambda: (r < 0).cast("double"),
    }


def _channel(s: Series, d: int) -> Column:
    low, high = s.pmin("low", d), s.pmax("high", d)
    return (F.col("close") - low) / (high - low + EPS)


def _midpoint_dev(s: Series, d: int) -> Column:
    middle = (s.pmax("high", d) + s.pmin("low", d)) / 2.0
    return (F.col("close") - middle) / (middle + EPS)


def _autocorr(s: Series, other: str) -> Column:
    value = s.pcov(other, "r", 20) / (s.pstd(other, 20) * s.pstd("r", 20) + 1e-8)
    # least() and greatest() would turn NaN into a bound
    return F.when(F.isnan(s.pstd(other, 20)) | F.isnan(s.pstd("r", 20)), float("nan")).otherwise(clamp(value, -1.0, 1.0))


def _aroon(s: Series) -> Column:
    highs, lows = s.plist("high", 25), s.plist("low", 25)
    newest_high = F.array_position(highs, F.array_max(highs))
    newest_low = F.array_position(lows, F.array_min(lows))
    return (newest_high - newest_low) / 25.0


def _entropy(s: Series) -> Column:
    up, down = s.psum("up", 20) / 20.0, s.psum("down", 20) / 20.0
    rest = 1.0 - up - down

    def part(p: Column) -> Column:
        return -p * F.log(F.greatest(p, F.lit(0.0)) + EPS)

    return clamp((part(up) + part(down) + part(rest)) / math.log(3.0), 0.0, 1.0)


def _normal_slope(s: Series, x: str, d: int) -> Column:
    return F.coalesce(F.try_divide(s.pslope(x, "rn", d), s.pmean(x, d) + EPS), F.lit(0.0))


def _first_windows(s: Series) -> Steps:
    """Statistics of per-bar columns; names in capitals are final, the rest feed later steps."""
    o, h, l, c, v = _ohlcv()

    def relative(x: Column, level: Column) -> Column:
        return (x - level) / (level + EPS)

    def boll_std() -> Column:
        return s.pstd("close", 20) + EPS

    def di(side: str) -> Column:
        return s.pmean(f"dm_{side}", 14) / (s.pmean("tr", 14) + EPS)

    def ult(d: int) -> Column:
        return s.psum("bp", d) / (s.psum("tru", d) + EPS)

    def pct(ratio: Column) -> Column:
        return (100.0 - 100.0 / (1.0 + ratio) - 50.0) / 50.0

    return {
        "RET": lambda: F.col("r"),
        "RET5": lambda: F.col("r5"),
        "RET20": lambda: F.col("r20"),
        "MA_DIFF": lambda: s.pmean("close", 10) / (s.pmean("close", 30) + EPS) - 1.0,
        "SLOPE20": lambda: _normal_slope(s, "close", 20),
        "RVOL": lambda: F.log1p(s.pstd("r", 20) + EPS),
        "HL_RANGE": lambda: (h - l) / (c + EPS),
        "DEV": lambda: relative(c, s.pmean("close", 20)),
        "DEV60": lambda: relative(c, s.pmean("close", 60)),
        "RSI14": lambda: clamp(pct((s.pmean("gain", 14) + EPS) / (s.pmean("loss", 14) + EPS)), -1.0, 1.0),
        "PRESSURE": lambda: F.when(F.abs(h - l) < EPS, 0.0).otherwise(clamp(F.try_divide(c - o, h - l), -1.0, 1.0)),
        "VOL_RATIO": lambda: v / (s.pmean("volume", 20) + EPS),
        "VOL_Z": lambda: clamp((v - s.pmean("volume", 20)) / (s.pstd("volume", 20) + EPS + EPS), -5.0, 5.0),
        "VWAP_DEV": lambda: relative(c, s.psum("tpv", 20) / (s.psum("volume", 20) + EPS)),
        "BOLL_POS": lambda: clamp(
            (c - s.pmean("close", 20) + 2 * boll_std()) / (4 * boll_std() + EPS), 0.0, 1.0
        ),
        "BOLL_WIDTH": lambda: 4 * boll_std() / (s.pmean("close", 20) + EPS),
        "MFI14": lambda: clamp(pct(s.psum("mf_up", 14) / (s.psum("mf_down", 14) + EPS)), -1.0, 1.0),
        "WILLR_14": lambda: clamp((s.pmax("high", 14) - c) / (s.pmax("high", 14) - s.pmin("low", 14) + EPS), -1.0, 0.0),
        "ROC_12": lambda: F.col("roc"),
        "TYPICAL_DEV": lambda: relative(F.col("tp"), s.pmean("tp", 20)),
        "PRICE_POS_50": lambda: clamp(_channel(s, 50), 0.0, 1.0),
        "ULT_OSC": lambda: clamp((4.0 * ult(7) + 2.0 * ult(14) + ult(28)) / 7.0 * 2.0 - 1.0, -1.0, 1.0),
        "RET_ACCEL": lambda: F.col("r5") - s.lag("r5", 5, 0.0),
        "GK_VOL": lambda: F.log1p(F.sqrt(s.pmean("gk", 20))),
        "PARKINSON_VOL": lambda: F.log1p(F.sqrt(s.pmean("pk", 20))),
        "YANG_ZHANG_VOL": lambda: F.log1p(F.sqrt(F.greatest(s.pmean("yz", 20), F.lit(0.0)))),
        "RS_VOL": lambda: F.log1p(F.sqrt(F.greatest(s.pmean("rs", 20), F.lit(0.0)))),
        "AMIHUD_ILLIQ": lambda: F.log1p(s.pmean("illiq", 20)),
        "KYLE_LAMBDA": lambda: s.pcov("abs_r", "signed_v", 20) / (s.pvar("signed_v", 20) + EPS),
        "CMF_20": lambda: clamp(s.psum("mfv", 20) / (s.psum("volume", 20) + EPS), -1.0, 1.0),
        "STOCH_K_14": lambda: clamp(_channel(s, 14) * 2.0 - 1.0, -1.0, 1.0),
        "AROON_OSC_25": lambda: clamp(_aroon(s), -1.0, 1.0),
        "DMI_DIFF_14": lambda: clamp(di("up") - di("down"), -1.0, 1.0),
        "DONCHIAN_POS_20": lambda: clamp(_channel(s, 20), 0.0, 1.0),
        "ICHIMOKU_KIJUN_DEV": lambda: _midpoint_dev(s, 26),
        "ICHIMOKU_TENKAN_DEV": lambda: _midpoint_dev(s, 9),
        "ROLL_SKEW_20": lambda: s.pm3("r", 20) / (F.pow(s.pstd("r", 20), F.lit(3.0)) + EPS),
        "ROLL_KURT_20": lambda: s.pm4("r", 20) / (F.pow(s.pstd("r", 20), F.lit(4.0)) + EPS) - 3.0,
        "FRACTAL_DIM_30": lambda: clamp(
            (s.pmax("close", 30) - s.pmin("close", 30)) / (s.pmean("step", 30) * math.sqrt(30.0) + EPS), 0.0, 3.0
        )
        / 3.0
        * 2.0
        - 1.0,
        "RET_ENTROPY_20": lambda: _entropy(s),
        # inputs of the second step
        "atr14": lambda: s.pmean("tr", 14),
        "obv": lambda: F.sum("obv_step").over(s.so_far()),
        "ad": lambda: F.sum("mfv").over(s.so_far()),
        "stoch": lambda: _channel(s, 14),
        "dx": lambda: F.abs(di("up") - di("down")) / (di("up") + di("down") + EPS),
        "tp_mean": lambda: s.pmean("tp", 14),
        "tp_list": lambda: s.plist("tp", 14),
        "r_list": lambda: s.plist("r", 50),
        "r_mean": lambda: s.pmean("r", 50),
        "r_std": lambda: s.pstd("r", 50),
        "slope50": lambda: s.pslope("close", "rn", 50),
        "mean50": lambda: s.pmean("close", 50),
        "var50": lambda: s.pvar("close", 50),
        "r_1": lambda: s.lag("r", 1, 0.0),
        "r_2": lambda: s.lag("r", 2, 0.0),
    }


def _hurst() -> Column:
    start = F.struct(F.lit(0.0).alias("at"), F.lit(float("-inf")).alias("top"), F.lit(float("inf")).alias("low"))

    def add(state: Column, x: Column) -> Column:
        at = state["at"] + x - F.col("r_mean")
        return F.struct(
            at.alias("at"), F.greatest(state["top"], at).alias("top"), F.least(state["low"], at).alias("low")
        )

    path = F.aggregate("r_list", start, add)
    reach = path["top"] - path["low"]
    flat = (reach < EPS) | (F.col("r_std") < EPS)
    exponent = clamp(F.log(F.greatest(reach, F.lit(0.0)) / (F.col("r_std") + EPS) + EPS) / math.log(50.0), 0.0, 1.0)
    return F.when(F.isnan("r_std"), float("nan")).when(flat, 0.5).otherwise(exponent) * 2.0 - 1.0


def _trend_strength() -> Column:
    slope, var = F.col("slope50"), F.col("var50")
    tvar = 50 * (50 * 50 - 1) / 12.0
    total = 50 * var
    residual = total - 2 * slope * slope * (tvar + EPS) + slope * slope * tvar
    fit = clamp(1.0 - residual / (total + EPS), 0.0, 1.0)
    return slope / (F.col("mean50") + EPS) * fit


def _cci() -> Column:
    spread = F.aggregate("tp_list", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("tp_mean"))) / 14.0
    return clamp((F.col("tp") - F.col("tp_mean")) / (0.015 * spread + EPS) / 200.0, -1.0, 1.0)


def _second_windows(s: Series) -> Steps:
    _, h, l, c, _ = _ohlcv()
    e12, e26, e3 = F.col("e12"), F.col("e26"), F.col("e15x3")

    def band(side: int) -> Column:
        return s.lag((h + l) / 2.0 + side * 1.5 * F.col("atr14"), 1)

    def keltner() -> Column:
        lower, upper = (F.col("e20") + side * 2.0 * F.col("atr_e20") for side in (-1, 1))
        return clamp((c - lower) / (upper - lower + EPS), 0.0, 1.0)

    def trix() -> Column:
        previous = F.coalesce(s.lag("e15x3", 1), e3)
        return (e3 - previous) / (F.abs(previous) + EPS)

    return {
        "ATR": lambda: F.log1p(F.col("atr14")),
        "VOL_REGIME": lambda: F.col("atr14") / (s.pmean("atr14", 20) + EPS) - 1.0,
        "AC1": lambda: _autocorr(s, "r_1"),
        "AC2": lambda: _autocorr(s, "r_2"),
        "MACD_HIST": lambda: (e12 - e26) - (F.col("e12_9") - F.col("e26_9")),
        "EMA_RATIO_12_26": lambda: e12 / (e26 + EPS) - 1.0,
        "PPO": lambda: (e12 - e26) / (F.abs(e26) + EPS),
        "OBV_SLOPE": lambda: _normal_slope(s, "obv", 20),
        "AD_LINE_SLOPE": lambda: _normal_slope(s, "ad", 20),
        "CCI_14": lambda: _cci(),
        "TREND_STRENGTH_50": lambda: _trend_strength(),
        "STOCH_D_3": lambda: clamp(s.pmean("stoch", 3) * 2.0 - 1.0, -1.0, 1.0),
        "DMI_ADX_14": lambda: clamp(s.pmean("dx", 14), 0.0, 1.0),
        "KELTNER_POS_20": keltner,
        "SAR_DIST": lambda: F.col("e20") - F.col("e50"),
        "HURST_50": lambda: _hurst(),
        "TRIX_15": trix,
        "flip": lambda: F.when(c < band(-1), -1.0).when(c > band(1), 1.0),
    }


def _third_windows(s: Series) -> Steps:
    return {
        "TRIX_SIGNAL": lambda: F.col("TRIX_15") - s.pmean("TRIX_15", 9),
        "SUPERTREND_DIR": lambda: F.coalesce(F.last("flip", ignorenulls=True).over(s.so_far()), F.lit(0.0)),
    }


# Which features read each helper column.
_READ_BY = {
    "rn": "SLOPE20 TREND_STRENGTH_50 OBV_SLOPE AD_LINE_SLOPE",
    "pc": "ATR VOL_REGIME RSI14 OBV_SLOPE ULT_OSC YANG_ZHANG_VOL FRACTAL_DIM_30 DMI_ADX_14 DMI_DIFF_14 "
    "KELTNER_POS_20 SUPERTREND_DIR",
    "ph": "DMI_ADX_14 DMI_DIFF_14",
    "pl": "DMI_ADX_14 DMI_DIFF_14",
    "r": "RET RVOL AC1 AC2 AMIHUD_ILLIQ KYLE_LAMBDA ROLL_SKEW_20 ROLL_KURT_20 HURST_50 RET_ENTROPY_20",
    "r5": "RET5 RET_ACCEL CS_RANK_RET5",
    "r20": "RET20 CS_ZSCORE_RET20",
    "roc": "ROC_12",
    "tp": "VWAP_DEV MFI14 CCI_14 TYPICAL_DEV",
    "ptp": "MFI14",
    "tr": "ATR VOL_REGIME DMI_ADX_14 DMI_DIFF_14 KELTNER_POS_20 SUPERTREND_DIR",
    "gain": "RSI14",
    "loss": "RSI14",
    "step": "FRACTAL_DIM_30",
    "obv_step": "OBV_SLOPE",
    "mfv": "CMF_20 AD_LINE_SLOPE",
    "tpv": "VWAP_DEV",
    "mf_up": "MFI14",
    "mf_down": "MFI14",
    "bp": "ULT_OSC",
    "tru": "ULT_OSC",
    "dm_up": "DMI_ADX_14 DMI_DIFF_14",
    "dm_down": "DMI_ADX_14 DMI_DIFF_14",
    "gk": "GK_VOL",
    "pk": "PARKINSON_VOL",
    "rs": "RS_VOL",
    "yz": "YANG_ZHANG_VOL",
    "illiq": "AMIHUD_ILLIQ",
    "abs_r": "KYLE_LAMBDA",
    "signed_v": "KYLE_LAMBDA",
    "up": "RET_ENTROPY_20",
    "down": "RET_ENTROPY_20",
    "atr14": "ATR VOL_REGIME KELTNER_POS_20 SUPERTREND_DIR",
    "obv": "OBV_SLOPE",
    "ad": "AD_LINE_SLOPE",
    "stoch": "STOCH_D_3",
    "dx": "DMI_ADX_14",
    "tp_mean": "CCI_14",
    "tp_list": "CCI_14",
    "r_list": "HURST_50",
    "r_mean": "HURST_50",
    "r_std": "HURST_50",
    "slope50": "TREND_STRENGTH_50",
    "mean50": "TREND_STRENGTH_50",
    "var50": "TREND_STRENGTH_50",
    "r_1": "AC1",
    "r_2": "AC2",
    "flip": "SUPERTREND_DIR",
}


def _add(df: DataFrame, steps: Steps, wanted: set[str]) -> DataFrame:
    """Add those columns of ``steps`` that are wanted or feed a wanted feature."""
    chosen = {
        n: build() for n, build in steps.items() if n in wanted or wanted.intersection(_READ_BY.get(n, "").split())
    }
    return df.withColumns(chosen) if chosen else df


def features(bars: DataFrame, names: Iterable[str], s: Series = Series(), keep: Iterable[str] = ()) -> DataFrame:
    """The requested features of ``bars`` as DOUBLE columns named by feature.

    Cross-section features compare the codes present at each time, so give bars on a common
    timeline (``operators.joins.common_timeline``) when several codes are involved.
    """
    names = list(names)
    unknown = set(names) - set(NAMES)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    wanted = set(names) | {CROSS[n] for n in names if CROSS.get(n)}
    if "PV_CORR" in wanted:
        wanted |= {"RET", "VOL_RATIO"}
    if "TRIX_SIGNAL" in wanted:
        wanted |= {"TRIX_15"}
    emas = {e for n in wanted for e in _EMAS_OF.get(n, ())}

    df = bars.select(*dict.fromkeys([*s.keys, *s.at, s.order, s.member, *keep, *OHLCV]))
    if emas:
        # First, while the rows are narrow: only the columns of the bars cross into Python.
        if "atr_e20" in emas:
            narrow = [*df.columns, "atr14"]
            of = {"KELTNER_POS_20"}
            df = _add(_add(_add(df, _lagged(s), of), _per_bar(), of), _first_windows(s), of).select(*narrow)
        df = with_ema(df, s, {e: _EMAS[e] for e in sorted(emas)})
    df = _add(_add(_add(df, _lagged(s), wanted), _per_bar(), wanted), _first_windows(s), wanted)
    df = _add(_add(df, _second_windows(s), wanted), _third_windows(s), wanted)

    normed = [n for n in wanted if n in NORMED]
    plain = [n for n in wanted if n in df.columns and n not in NORMED]
    base = list(dict.fromkeys([*s.keys, *s.at, s.order, s.member, *keep]))
    cross_inputs = [x for n, x in (("CS_RANK_RET5", "r5"), ("CS_ZSCORE_RET20", "r20")) if n in wanted]
    df = df.select(*base, *cross_inputs, *[clean(F.col(n)).alias(n) for n in normed + plain])
    if normed:
        df = with_robust_norm(df, s, {f"n_{n}": n for n in normed}, NORM_WIDTH)
        df = df.drop(*normed).withColumnsRenamed({f"n_{n}": n for n in normed})
    if "PV_CORR" in wanted:
        flow = F.log1p(F.greatest(F.col("VOL_RATIO"), F.lit(-0.99)))
        df = df.withColumn("_flow", flow).withColumn("PV_CORR", clamp(s.pcorr("RET", "_flow", 10), -1.0, 1.0))
    cross = [n for n in CROSS if n in wanted]
    if cross:
        df = _cross_features(df, s, cross)
    return df.select(*base, *names)


def _cross_features(df: DataFrame, s: Series, cross: list[str]) -> DataFrame:
    """Comparisons between codes: one shuffle by time, then back to the series for the norm."""
    wx = s.cross()
    alone = F.count(F.lit(1)).over(wx) == 1
    step, again = {}, []
    for name in cross:
        source = CROSS[name]
        if source:
            step[name] = F.when(alone, F.col(source)).otherwise(F.col(source) - F.avg(source).over(wx))
            again.append(name)
        elif name == "CS_RANK_RET5":
            place = F.row_number().over(wx.orderBy("r5", s.member)) - 1
            step[name] = F.coalesce(F.try_divide(place, F.count(F.lit(1)).over(wx) - 1), F.lit(0.0))
        else:
            score = (F.col("r20") - F.avg("r20").over(wx)) / (F.stddev_samp("r20").over(wx) + EPS)
            step[name] = clean(F.coalesce(score, F.lit(0.0)))
            again.append(name)
    df = df.withColumns(step)
    if again:
        df = with_robust_norm(df, s, {f"n_{n}": n for n in again}, NORM_WIDTH)
        df = df.drop(*again).withColumnsRenamed({f"n_{n}": n for n in again})
    return df
