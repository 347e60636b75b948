"""Registered queries of the technical features.

The SQL twins compute every padded window naively as an explicit list with leading zeros.
In the templates ``[x:20]`` stands for that list of column ``x``.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from factorloom.functions.features import CROSS, NAMES, NORMED, features
from factorloom.operators.joins import common_timeline, number_calendar
from factorloom.operators.panel import run_features
from factorloom.plans.registry import BARS_SQL, DESKS_SQL, query
from factorloom.sources.market import bars_hourly, desks, stored


def _mean(x, d):
    return f"(list_sum([{x}:{d}]) / {d})"


def _var(x, d):
    return f"list_aggregate([{x}:{d}], 'var_pop')"


def _std(x, d):
    return f"sqrt({_var(x, d)})"


def _moment(x, d, k):
    return f"(list_sum(list_transform([{x}:{d}], lambda q: pow(q - {_mean(x, d)}, {k}))) / {d})"


def _cov(x, y, d):
    return (
        f"(list_sum(list_transform(list_zip([{x}:{d}], [{y}:{d}]),"
        f" lambda q: (q[1] - {_mean(x, d)}) * (q[2] - {_mean(y, d)}))) / {d})"
    )


def _slope(x, d):
    tc = f"list_transform(range({d}), lambda i: i - {(d - 1) / 2})"
    return (
        f"(list_sum(list_transform(list_zip([{x}:{d}], {tc}), lambda q: (q[1] - {_mean(x, d)}) * q[2]))"
        f" / ({d * (d * d - 1) / 12} + 1e-9))"
    )


def _clamp(x, low, high):
    return f"greatest(least({x}, {high}), {low})"


def _channel(d):
    return f"((close - list_min([low:{d}])) / (list_max([high:{d}]) - list_min([low:{d}]) + 1e-9))"


def _mid(d):
    return f"((list_max([high:{d}]) + list_min([low:{d}])) / 2)"


def _ult(d):
    return f"(list_sum([bp:{d}]) / (list_sum([tru:{d}]) + 1e-9))"


_TR14 = f"({_mean('tr', 14)} + 1e-9)"
_DI = f"({_mean('dm_up', 14)} / {_TR14})", f"({_mean('dm_down', 14)} / {_TR14})"
_VWAP = "(list_sum([tpv:20]) / (list_sum([volume:20]) + 1e-9))"
_BSTD = f"({_std('close', 20)} + 1e-9)"
_RSI = f"(({_mean('gain', 14)} + 1e-9) / ({_mean('loss', 14)} + 1e-9))"
_MFI = "(list_sum([mf_up:14]) / (list_sum([mf_down:14]) + 1e-9))"


def _pct(ratio):
    return f"((100 - 100 / (1 + {ratio}) - 50) / 50)"


def _entropy():
    parts = []
    for test in ("> 0", "< 0", "= 0"):
        p = f"(len(list_filter([r:20], lambda q: q {test})) / 20.0)"
        parts.append(f"(-{p} * ln({p} + 1e-9))")
    return _clamp(f"({' + '.join(parts)}) / ln(3)", "0.0", "1.0")


def _ema(source, span):
    return f"list_reduce({source}, lambda a, b: a * (1 - 2.0::DOUBLE / {span + 1}) + b * (2.0::DOUBLE / {span + 1}))"


def _autocorr(x):
    return _clamp(f"{_cov(x, 'r', 20)} / ({_std(x, 20)} * {_std('r', 20)} + 1e-8)", "-1.0", "1.0")


_PATH = (
    f"list_transform(range(1, 51), lambda i: list_sum(list_slice(list_transform([r:50],"
    f" lambda q: q - {_mean('r', 50)}), 1, i)))"
)
_REACH = f"(list_max({_PATH}) - list_min({_PATH}))"
_TOT = f"(50 * {_var('close', 50)})"
_RES = (
    f"list_sum(list_transform(list_zip([close:50], range(50)), lambda q:"
    f" pow(q[1] - {_mean('close', 50)} - {_slope('close', 50)} * (q[2] - 24.5), 2)))"
)

# First step: expressions over the bars; second and third steps read columns of earlier steps.
FIRST = {
    "RET": "r", "RET5": "r5", "RET20": "r20",
    "MA_DIFF": f"{_mean('close', 10)} / ({_mean('close', 30)} + 1e-9) - 1",
    "SLOPE20": f"{_slope('close', 20)} / ({_mean('close', 20)} + 1e-9)",
    "ATR": f"ln(1 + {_mean('tr', 14)})",
    "RVOL": f"ln(1 + {_std('r', 20)} + 1e-9)",
    "HL_RANGE": "(high - low) / (close + 1e-9)",
    "DEV": f"(close - {_mean('close', 20)}) / ({_mean('close', 20)} + 1e-9)",
    "DEV60": f"(close - {_mean('close', 60)}) / ({_mean('close', 60)} + 1e-9)",
    "RSI14": _clamp(_pct(_RSI), "-1.0", "1.0"),
    "PRESSURE": "CASE WHEN abs(high - low) < 1e-9 THEN 0.0 ELSE "
    + _clamp("(close - open) / (high - low)", "-1.0", "1.0") + " END",
    "AC1": _autocorr("r_1"), "AC2": _autocorr("r_2"),
    "VOL_RATIO": f"volume / ({_mean('volume', 20)} + 1e-9)",
    "VOL_Z": _clamp(f"(volume - {_mean('volume', 20)}) / ({_std('volume', 20)} + 2e-9)", "-5.0", "5.0"),
    "VWAP_DEV": f"(close - {_VWAP}) / ({_VWAP} + 1e-9)",
    "BOLL_POS": _clamp(f"(close - {_mean('close', 20)} + 2 * {_BSTD}) / (4 * {_BSTD} + 1e-9)", "0.0", "1.0"),
    "BOLL_WIDTH": f"4 * {_BSTD} / ({_mean('close', 20)} + 1e-9)",
    "MFI14": _clamp(_pct(_MFI), "-1.0", "1.0"),
    "WILLR_14": _clamp(
        "(list_max([high:14]) - close) / (list_max([high:14]) - list_min([low:14]) + 1e-9)", "-1.0", "0.0"
    ),
    "CCI_14": _clamp(
        f"(tp - {_mean('tp', 14)}) / (0.015 * list_sum(list_transform([tp:14], lambda q: abs(q - {_mean('tp', 14)})))"
        " / 14 + 1e-9) / 200", "-1.0", "1.0"
    ),
    "ROC_12": "coalesce(close / (p12 + 1e-9) - 1, 0.0)",
    "TYPICAL_DEV": f"(tp - {_mean('tp', 20)}) / ({_mean('tp', 20)} + 1e-9)",
    "TREND_STRENGTH_50": f"{_slope('close', 50)} / ({_mean('close', 50)} + 1e-9) * "
    + _clamp(f"1 - {_RES} / ({_TOT} + 1e-9)", "0.0", "1.0"),
    "PRICE_POS_50": _clamp(_channel(50), "0.0", "1.0"),
    "ULT_OSC": _clamp(f"(4 * {_ult(7)} + 2 * {_ult(14)} + {_ult(28)}) / 7 * 2 - 1", "-1.0", "1.0"),
    "RET_ACCEL": "r5 - r5_5",
    "GK_VOL": f"ln(1 + sqrt({_mean('gk', 20)}))", "PARKINSON_VOL": f"ln(1 + sqrt({_mean('pk', 20)}))",
    "YANG_ZHANG_VOL": f"ln(1 + sqrt(greatest({_mean('yz', 20)}, 0)))",
    "RS_VOL": f"ln(1 + sqrt(greatest({_mean('rs', 20)}, 0)))",
    "AMIHUD_ILLIQ": f"ln(1 + {_mean('illiq', 20)})",
    "KYLE_LAMBDA": f"{_cov('abs_r', 'signed_v', 20)} / ({_var('signed_v', 20)} + 1e-9)",
    "CMF_20": _clamp("list_sum([mfv:20]) / (list_sum([volume:20]) + 1e-9)", "-1.0", "1.0"),
    "STOCH_K_14": _clamp(f"{_channel(14)} * 2 - 1", "-1.0", "1.0"),
    "AROON_OSC_25": "(list_position([high:25], list_max([high:25])) - list_position([low:25], list_min([low:25]))) / 25.0",
    "DMI_DIFF_14": _clamp(f"{_DI[0]} - {_DI[1]}", "-1.0", "1.0"),
    "DONCHIAN_POS_20": _clamp(_channel(20), "0.0", "1.0"),
    "ICHIMOKU_KIJUN_DEV": f"(close - {_mid(26)}) / ({_mid(26)} + 1e-9)",
    "ICHIMOKU_TENKAN_DEV": f"(close - {_mid(9)}) / ({_mid(9)} + 1e-9)",
    "ROLL_SKEW_20": f"{_moment('r', 20, 3)} / (pow({_std('r', 20)}, 3) + 1e-9)",
    "ROLL_KURT_20": f"{_moment('r', 20, 4)} / (pow({_std('r', 20)}, 4) + 1e-9) - 3",
    "HURST_50": f"2 * (CASE WHEN {_REACH} < 1e-9 OR {_std('r', 50)} < 1e-9 THEN 0.5 ELSE "
    + _clamp(f"ln({_REACH} / ({_std('r', 50)} + 1e-9) + 1e-9) / ln(50)", "0.0", "1.0") + " END) - 1",
    "FRACTAL_DIM_30": _clamp(
        f"(list_max([close:30]) - list_min([close:30])) / ({_mean('step', 30)} * sqrt(30) + 1e-9)", "0.0", "3.0"
    ) + " / 3 * 2 - 1",
    "RET_ENTROPY_20": _entropy(),
    "atr14": _mean("tr", 14), "stoch": _channel(14),
    "dx": f"abs({_DI[0]} - {_DI[1]}) / ({_DI[0]} + {_DI[1]} + 1e-9)",
    "obv": "sum(obv_step) OVER (PARTITION BY code ORDER BY ts)", "ad": "sum(mfv) OVER (PARTITION BY code ORDER BY ts)",
    "e12": _ema("closes", 12), "e26": _ema("closes", 26), "e20": _ema("closes", 20), "e50": _ema("closes", 50),
    "e15": _ema("closes", 15), "cs_rank": "(row_number() OVER (PARTITION BY ts ORDER BY r5, code) - 1)"
    " / (count(*) OVER (PARTITION BY ts) - 1.0)",
    "cs_score": "(r20 - avg(r20) OVER (PARTITION BY ts)) / (stddev_samp(r20) OVER (PARTITION BY ts) + 1e-9)",
}
SECOND = {
    "VOL_REGIME": f"atr14 / ({_mean('atr14', 20)} + 1e-9) - 1",
    "STOCH_D_3": _clamp(f"{_mean('stoch', 3)} * 2 - 1", "-1.0", "1.0"),
    "DMI_ADX_14": _clamp(_mean("dx", 14), "0.0", "1.0"),
    "OBV_SLOPE": f"{_slope('obv', 20)} / ({_mean('obv', 20)} + 1e-9)",
    "AD_LINE_SLOPE": f"{_slope('ad', 20)} / ({_mean('ad', 20)} + 1e-9)",
    "EMA_RATIO_12_26": "e12 / (e26 + 1e-9) - 1", "PPO": "(e12 - e26) / (abs(e26) + 1e-9)", "SAR_DIST": "e20 - e50",
    "CS_RANK_RET5": "cs_rank", "CS_ZSCORE_RET20": "cs_score",
    "macd": "e12 - e26", "atr_e20": _ema("list(atr14) OVER c", 20), "e15b": _ema("list(e15) OVER c", 15),
    "flip": "CASE WHEN close < lag((high + low) / 2 - 1.5 * atr14) OVER c THEN -1.0"
    " WHEN close > lag((high + low) / 2 + 1.5 * atr14) OVER c THEN 1.0 END",
}
THIRD = {
    "MACD_HIST": "macd - " + _ema("list(macd) OVER c", 9),
    "KELTNER_POS_20": _clamp("(close - (e20 - 2 * atr_e20)) / (4 * atr_e20 + 1e-9)", "0.0", "1.0"),
    "e15c": _ema("list(e15b) OVER c", 15),
    "SUPERTREND_DIR": "coalesce(last_value(flip IGNORE NULLS) OVER c, 0.0)",
}
FOURTH = {"TRIX_15": "coalesce((e15c - lag(e15c) OVER c) / (abs(lag(e15c) OVER c) + 1e-9), 0.0)"}
FIFTH = {"TRIX_SIGNAL": f"TRIX_15 - {_mean('TRIX_15', 9)}"}

_PLACE = re.compile(r"\[(\w+):(\d+)\]")
_C = "WINDOW c AS (PARTITION BY code ORDER BY ts)"
BASE_SQL = f"""b0 AS (
  SELECT *, coalesce(lag(close) OVER c, close) AS pc, coalesce(lag(high) OVER c, high) AS ph,
    coalesce(lag(low) OVER c, low) AS pl, coalesce(ln(close / (lag(close) OVER c + 1e-9)), 0.0) AS r,
    coalesce(ln(close / (lag(close, 5) OVER c + 1e-9)), 0.0) AS r5,
    coalesce(ln(close / (lag(close, 20) OVER c + 1e-9)), 0.0) AS r20, lag(close, 12) OVER c AS p12,
    (high + low + close) / 3 AS tp, list(close) OVER c AS closes FROM src {_C}),
b1 AS (
  SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, greatest(close - pc, 0) AS gain,
    greatest(pc - close, 0) AS loss, abs(close - pc) AS step, sign(close - pc) * volume AS obv_step,
    ((close - low) - (high - close)) / (high - low + 1e-9) * volume AS mfv, tp * volume AS tpv,
    CASE WHEN tp > lag(tp) OVER c THEN tp * volume ELSE 0.0 END AS mf_up,
    CASE WHEN tp < lag(tp) OVER c THEN tp * volume ELSE 0.0 END AS mf_down,
    close - least(low, pc) AS bp, greatest(high, pc) - least(low, pc) AS tru,
    greatest(high - ph, 0) AS dm_up, greatest(pl - low, 0) AS dm_down,
    greatest(0.5 * pow(ln((high + 1e-9) / (low + 1e-9)), 2)
      - (2 * ln(2) - 1) * pow(ln((close + 1e-9) / (open + 1e-9)), 2), 0) AS gk,
    pow(ln((high + 1e-9) / (low + 1e-9)), 2) / (4 * ln(2)) AS pk,
    ln((high + 1e-9) / (close + 1e-9)) * ln((high + 1e-9) / (open + 1e-9))
      + ln((low + 1e-9) / (close + 1e-9)) * ln((low + 1e-9) / (open + 1e-9)) AS rs,
    abs(r) / (volume + 1e-9) AS illiq, abs(r) AS abs_r, sign(r) * volume AS signed_v,
    coalesce(lag(r, 1) OVER c, 0.0) AS r_1, coalesce(lag(r, 2) OVER c, 0.0) AS r_2,
    coalesce(lag(r5, 5) OVER c, 0.0) AS r5_5 FROM b0 {_C}),
b2 AS (
  SELECT *, (pow(ln((open + 1e-9) / (pc + 1e-9)), 2) + pow(ln((open + 1e-9) / (close + 1e-9)), 2)
    + greatest(rs, 0)) / 3 AS yz FROM b1)"""


def _step(name: str, source: str, exprs: dict[str, str]) -> list[str]:
    """A CTE with the needed padded lists, then one with the expressions."""
    lists = sorted({m.groups() for e in exprs.values() for m in _PLACE.finditer(e)})
    cols = "".join(
        f", list_concat(list_resize(CAST([] AS DOUBLE[]), greatest({d} - rn, 0), 0.0), list({x}) OVER"
        f" (PARTITION BY code ORDER BY ts ROWS BETWEEN {int(d) - 1} PRECEDING AND CURRENT ROW)) AS l_{x}_{d}"
        for x, d in lists
    )
    values = "".join(f", {_PLACE.sub(r'l_\1_\2', e)} AS {n}" for n, e in exprs.items())
    return [f"{name}l AS (SELECT *{cols} FROM {source})", f"{name} AS (SELECT *{values} FROM {name}l {_C})"]


def norm_ctes(name: str, source: str, columns: dict[str, str], warm_zero: bool = True) -> list[str]:
    lists = "".join(
        f", list({x}) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS w_{n}"
        for n, x in columns.items()
    )
    medians = "".join(f", list_sort(w_{n})[100] AS m_{n}" for n in columns)
    values = "".join(
        f", CASE WHEN rn < 200 THEN 0.0 ELSE greatest(least(({x} - m_{n}) /"
        f" (list_sort(list_transform(w_{n}, lambda q: abs(q - m_{n})))[100] + 1e-6), 5.0), -5.0) END AS {n}"
        for n, x in columns.items()
    )
    return [
        f"{name}w AS (SELECT *{lists} FROM {source})",
        f"{name}m AS (SELECT *{medians} FROM {name}w)",
        f"{name} AS (SELECT *{values} FROM {name}m)",
    ]


def feature_ctes(names: list[str], cleaned: bool = False) -> tuple[list[str], str]:
    """CTEs that end in a relation with ``code, ts`` and the features ``f_<name>``.

    ``cleaned`` states the rule for closes of 0 too: what is not finite becomes 0 where a feature leaves.
    """
    inputs = dict.fromkeys([*names, *(CROSS[n] for n in names if CROSS.get(n))])
    if "PV_CORR" in inputs:
        inputs.update({"RET": None, "VOL_RATIO": None})
    ctes = [BASE_SQL]
    source = "b2"
    reach = 5 if "TRIX_SIGNAL" in inputs else 4
    for i, exprs in enumerate([FIRST, SECOND, THIRD, FOURTH, FIFTH][:reach], start=1):
        part = {n: e for n, e in exprs.items() if n in inputs or not n.isupper() or n == "TRIX_15"}
        if cleaned and "HURST_50" in part:
            part["HURST_50"] = f"CASE WHEN isfinite(list_sum([r:50])) THEN {part['HURST_50']} ELSE 0.0 END"
        ctes += _step(f"s{i}", source, part)
        source = f"s{i}"
    if cleaned:
        kept = ", ".join(f"CASE WHEN isfinite({n}) THEN {n} ELSE 0.0 END AS {n}" for n in inputs if n in NORMED)
        ctes.append(f"cl AS (SELECT * REPLACE ({kept}) FROM {source})")
        source = "cl"
    normed = {f"f_{n}": n for n in inputs if n in NORMED}
    if "CS_ZSCORE_RET20" in inputs:
        normed["f_CS_ZSCORE_RET20"] = "CS_ZSCORE_RET20"
    if normed:
        ctes += norm_ctes("nn", source, normed)
        source = "nn"
    if "PV_CORR" in inputs:
        ctes.append(f"pv0 AS (SELECT *, ln(1 + greatest(f_VOL_RATIO, -0.99)) AS flow FROM {source})")
        corr = (
            f"CASE WHEN {_std('f_RET', 10)} < 1e-6 OR {_std('flow', 10)} < 1e-6 THEN 0.0 ELSE "
            + _clamp(f"{_cov('f_RET', 'flow', 10)} / ({_std('f_RET', 10)} * {_std('flow', 10)} + 1e-8)", "-1.0", "1.0")
            + " END"
        )
        ctes += _step("pv", "pv0", {"PV_CORR": corr})
        source = "pv"
    relative = {n: x for n, x in CROSS.items() if x and n in inputs}
    if relative:
        cols = "".join(f", f_{x} - avg(f_{x}) OVER (PARTITION BY ts) AS d_{n}" for n, x in relative.items())
        ctes.append(f"rel0 AS (SELECT *{cols} FROM {source})")
        ctes += norm_ctes("rel", "rel0", {f"f_{n}": f"d_{n}" for n in relative})
        source = "rel"
    return ctes, source


def final_name(n: str) -> str:
    return f"f_{n}" if n in NORMED or CROSS.get(n) or n == "CS_ZSCORE_RET20" else n


ALIGNED_SQL = """src AS (
  SELECT code, ts, open, high, low, close, volume, row_number() OVER (PARTITION BY code ORDER BY ts) AS rn
  FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts
                         HAVING count(DISTINCT code) = (SELECT count(DISTINCT code) FROM bars)))"""
PLAIN_SQL = "src AS (SELECT * FROM bars)"


def feature_sql(names: list[str], aligned: bool, cleaned: bool = False) -> str:
    ctes, source = feature_ctes(names, cleaned)
    outputs = ", ".join(f"{final_name(n)} AS {n.lower()}" for n in names)
    body = ",\n".join([BARS_SQL, ALIGNED_SQL if aligned else PLAIN_SQL, *ctes])
    return f"WITH {body}\nSELECT code, ts, {outputs} FROM {source}"


GROUPS = {
    "F0_F10_trend_volatility": NAMES[0:11],
    "F11_F16_oscillators": NAMES[11:17],
    "F17_F19_F63_F64_cross_section": [*NAMES[17:20], *NAMES[63:65]],
    "F20_F22_F24_F29_bands_flow": [*NAMES[20:23], *NAMES[24:30]],
    "F23_F30_F33_F34_F50_F52_F56_ema": [NAMES[i] for i in (23, 30, 33, 34, 50, 52, 56)],
    "F31_F32_F35_F42_trend_liquidity": [NAMES[i] for i in (31, 32, 35, 36, 37, 38, 39, 40, 41, 42)],
    "F43_F49_F51_flow_direction": [*NAMES[43:50], NAMES[51]],
    "F53_F58_channels_moments": [NAMES[i] for i in (53, 54, 55, 57, 58)],
    "F59_F62_complexity": NAMES[59:63],
}


def feature_query(spark, sf_dir, names, aligned=False):
    bars = bars_hourly(spark, sf_dir)
    if aligned:
        bars = common_timeline(bars)
    out = features(bars, names)
    return out.withColumnsRenamed({n: n.lower() for n in names})


def _register(name, names):
    aligned = any(n in CROSS for n in names)
    columns = "code:s ts:t " + " ".join(f"{n.lower()}:d" for n in names)

    @query(name, columns, feature_sql(names, aligned))
    def run(spark, sf_dir):
        return feature_query(spark, sf_dir, names, aligned)


for _name, _names in GROUPS.items():
    _register(_name, _names)


# -- features on unbroken runs ---------------------------------------------------------
RUN_NAMES = [n for n in NAMES if n not in CROSS]
_OPEN = "NOT (month(date) = 2 AND year(date) % 2 = 0) AND volume > 0"


def run_feature_sql(names: list[str]) -> str:
    """The features of the weekly desks with one code per run, joined back to all rows."""
    ctes, source = feature_ctes(names)
    runs = f"""{DESKS_SQL.replace('panel AS (', 'dk AS (', 1)}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM (SELECT DISTINCT date FROM dk)),
    rn AS (SELECT dk.*, p - row_number() OVER (PARTITION BY code ORDER BY date) AS run FROM dk JOIN cal USING (date) WHERE {_OPEN}),
    src AS (SELECT code || '#' || run AS code, date AS ts, open, high, low, close, volume, amount, row_number() OVER (PARTITION BY code, run ORDER BY date) AS rn FROM rn)"""
    values = ", ".join(f"{final_name(n)} AS {n.lower()}" for n in names)
    outputs = ", ".join(f"CASE WHEN place > 60 THEN {n.lower()} END AS {n.lower()}" for n in names)
    return f"""WITH {', '.join([runs, *ctes])}, ft AS (SELECT CAST(split_part(code, '#', 1) AS BIGINT) AS code, ts, row_number() OVER (PARTITION BY code ORDER BY ts) AS place, {values} FROM {source})
    SELECT dk.code, dk.date, place AS run_row, coalesce(place > 60, false) AS ready, {outputs} FROM dk LEFT JOIN ft ON ft.code = dk.code AND ft.ts = dk.date"""


@query("F65_run_features", "code:i date:t run_row:i ready:b " + " ".join(f"{n.lower()}:d" for n in RUN_NAMES), run_feature_sql(RUN_NAMES))
def f65_features(spark, sf_dir):
    """All features but the cross-section ones on the weekly desks, whose market is shut in February of even years."""
    bars = stored(desks(spark, sf_dir))
    usable = F.expr(_OPEN)
    out = run_features(bars, number_calendar(bars), usable, RUN_NAMES)
    return out.withColumnsRenamed({n: n.lower() for n in RUN_NAMES})
