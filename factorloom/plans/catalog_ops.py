"""Registered queries of the formula operators (W1-W64), the formula builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions.ops import OPS
from factorloom.functions.recursion import with_ema
from factorloom.functions.series import Series
from factorloom.plans.registry import BARS_SQL, query
from factorloom.sources.market import bars_hourly

S = Series()


def operands(spark, sf_dir):
    """x = hourly log return, y = log volume, z = body of the bar; one row per (code, hour)."""
    bars = bars_hourly(spark, sf_dir)
    previous = S.lag("close", 1)
    return bars.select(
        "code",
        "ts",
        F.coalesce(F.log(F.col("close") / previous), F.lit(0.0)).alias("x"),
        F.log("volume").alias("y"),
        (F.col("close") - F.col("open")).alias("z"),
    )


OPERANDS_SQL = f"""{BARS_SQL}, operands AS (
  SELECT code, ts, rn, coalesce(ln(close / lag(close) OVER (PARTITION BY code ORDER BY ts)), 0.0) AS x,
         ln(volume) AS y, close - open AS z FROM bars)"""


def padded(x: str, d: int) -> str:
    frame = f"OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"
    return f"list_concat(list_resize(CAST([] AS DOUBLE[]), greatest({d} - rn, 0), 0.0), list({x}) {frame})"


_LISTS = ", ".join(
    f"{padded(x, d)} AS {x}{d}" for x, d in [("x", 5), ("x", 10), ("x", 20), ("y", 10), ("x", 2), ("x", 3)]
)
LISTS_SQL = f"""{OPERANDS_SQL}, lists AS (
  SELECT *, {_LISTS}, list(x) OVER (PARTITION BY code ORDER BY ts) AS xs,
         coalesce(lag(x, 1) OVER c, 0.0) AS x_1, coalesce(lag(x, 4) OVER c, 0.0) AS x_4,
         lag(x, 1) OVER c AS p1, lag(x, 5) OVER c AS p5
  FROM operands WINDOW c AS (PARTITION BY code ORDER BY ts))"""


def _var(a):
    return f"list_aggregate({a}, 'var_pop')"


def _std(a):
    return f"sqrt({_var(a)})"


def _mean(d):
    return f"list_sum(x{d}) / {d}"


def _rank(d):
    return f"CAST(len(list_filter(x{d}, lambda v: v < x)) AS DOUBLE) / {d}"


def _dot(a, weights):
    """Oldest-first weights, normalised."""
    terms = " + ".join(f"{a}[{i + 1}] * {w}" for i, w in enumerate(weights))
    return f"({terms}) / {sum(weights)}"


def _zscore(d):
    s = f"({_std(f'x{d}')} + 1e-9)"
    return f"CASE WHEN {s} < 2e-9 THEN 0.0 ELSE (x - {_mean(d)}) / {s} END"


def _ema(span):
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"list_reduce(xs, lambda a, b: a * (1 - {a}) + b * {a})"


_COV = "list_sum(list_transform(list_zip(x10, y10), lambda p: (p[1] - list_avg(x10)) * (p[2] - list_avg(y10)))) / 10"
_MEMBERS = "count(*) OVER (PARTITION BY ts)"
SQL_OPS = {
    "ADD": "x + y", "SUB": "x - y", "MUL": "x * y", "DIV": "x / (y + 1e-6)", "NEG": "-x", "ABS": "abs(x)",
    "SIGN": "CAST(sign(x) AS DOUBLE)", "GATE": "CASE WHEN x > 0 THEN y ELSE z END",
    "JUMP": "CASE WHEN rn <= 5 THEN 0.0 ELSE tanh((x - list_avg(xs))"
    " / (sqrt(greatest(list_aggregate(xs, 'var_pop'), 1e-12)) + 1e-6) - 1.5) END",
    "DECAY": "(x3[3] + 0.8 * x3[2] + 0.6 * x3[1]) / 2.4", "DELAY1": "x_1", "MAX3": "list_max(x3)",
    "TS_MEAN_5": _mean(5), "TS_MEAN_10": _mean(10), "TS_MEAN_20": _mean(20),
    "TS_STD_5": f"{_std('x5')} + 1e-6", "TS_STD_10": f"{_std('x10')} + 1e-6", "TS_STD_20": f"{_std('x20')} + 1e-6",
    "TS_RANK_5": _rank(5), "TS_RANK_10": _rank(10), "TS_RANK_20": _rank(20),
    "TS_CORR_10": f"CASE WHEN {_std('x10')} < 1e-6 OR {_std('y10')} < 1e-6 THEN 0.0"
    f" ELSE ({_COV}) / ({_std('x10')} * {_std('y10')} + 1e-8) END",
    "MOMENTUM_5": f"{_mean(5)} - {_mean(20)}", "MOMENTUM_10": f"{_mean(10)} - {_mean(20)}",
    "TS_MAX_10": "list_max(x10)", "TS_MIN_10": "list_min(x10)",
    "WMA": "(3 * x3[3] + 2 * x3[2] + x3[1]) / 6", "DELAY4": "x_4",
    "EMA_5": _ema(5), "EMA_20": _ema(20),
    "TS_QUANTILE_10": _rank(10),
    "TS_SKEW_10": f"list_sum(list_transform(x10, lambda v: pow(v - list_avg(x10), 3))) / 10"
    f" / pow({_std('x10')} + 1e-6, 3)",
    "TS_MIN_20": "list_min(x20)", "TS_MAX_20": "list_max(x20)",
    "DELTA": "CASE WHEN rn > 1 THEN x - p1 ELSE 0.0 END", "DELTA_5": "CASE WHEN rn > 5 THEN x - p5 ELSE 0.0 END",
    "TS_ARG_MAX_5": "(list_position(x5, list_max(x5)) - 1) / 4.0",
    "TS_ARG_MIN_5": "(list_position(x5, list_min(x5)) - 1) / 4.0",
    "DECAY_LINEAR_5": _dot("x5", [1, 2, 3, 4, 5]),
    "SCALE": "x / (list_sum(list_transform(xs, lambda v: abs(v))) + 1e-6)",
    "COVARIANCE_10": _COV,
    "PRODUCT_5": "exp(greatest(least(list_sum(list_transform(x5, lambda v: ln(1 + greatest(v, -0.999)))), 10), -10)) - 1",
    "SIGNED_POWER_2": "sign(x) * x * x", "POWER": "sign(x) * least(x * x, 1e9)",
    "TS_DECAY_EXP_5": _dot("x5", [16, 8, 4, 2, 1]),
    "CS_RANK": f"CASE WHEN {_MEMBERS} = 1 THEN x ELSE (row_number() OVER (PARTITION BY ts ORDER BY x, code) - 1)"
    f" / ({_MEMBERS} - 1.0) END",
    "CS_SCALE": f"CASE WHEN {_MEMBERS} = 1 THEN x WHEN max(x) OVER t - min(x) OVER t < 1e-9 THEN 0.5"
    " ELSE (x - min(x) OVER t) / (max(x) OVER t - min(x) OVER t) END",
    "CS_NEUTRALIZE": f"CASE WHEN {_MEMBERS} = 1 THEN x ELSE x - avg(x) OVER t END",
    "TS_SUM_5": "list_sum(x5)", "TS_SUM_10": "list_sum(x10)", "TS_SUM_20": "list_sum(x20)",
    "MIN": "least(x, y)", "MAX": "greatest(x, y)",
    "SIGNED_LOG": "sign(x) * ln(1 + abs(x))", "SQRT": "sign(x) * sqrt(abs(x))",
    "TS_ZSCORE_10": _zscore(10), "TS_ZSCORE_20": _zscore(20),
    "WINSORIZE": "CASE WHEN list_aggregate(x20, 'quantile_cont', 0.95) - list_aggregate(x20, 'quantile_cont', 0.05)"
    " < 1e-9 THEN x ELSE greatest(least(x, list_aggregate(x20, 'quantile_cont', 0.95)),"
    " list_aggregate(x20, 'quantile_cont', 0.05)) END",
    "CLIP": "greatest(least(x, 3.0), -3.0)", "SIGMOID": "2 / (1 + exp(-x)) - 1", "TANH_SQUASH": "tanh(x)",
    "IF_GT": "CASE WHEN x > 0 THEN y ELSE z END",
}

GROUPS = {
    "W1_W8_W51_W52_elementwise": ["ADD", "SUB", "MUL", "DIV", "NEG", "ABS", "SIGN", "GATE", "MIN", "MAX"],
    "W9_jump_W40_scale_expanding": ["JUMP", "SCALE"],
    "W10_W12_W29_W30_weighted_lags": ["DECAY", "DELAY1", "MAX3", "WMA", "DELAY4"],
    "W13_W15_ts_mean": ["TS_MEAN_5", "TS_MEAN_10", "TS_MEAN_20"],
    "W16_W18_ts_std": ["TS_STD_5", "TS_STD_10", "TS_STD_20"],
    "W19_W21_W33_ts_rank": ["TS_RANK_5", "TS_RANK_10", "TS_RANK_20", "TS_QUANTILE_10"],
    "W22_W41_ts_corr_covariance": ["TS_CORR_10", "COVARIANCE_10"],
    "W23_W24_momentum": ["MOMENTUM_5", "MOMENTUM_10"],
    "W25_W28_ts_extrema": ["TS_MAX_10", "TS_MAX_20", "TS_MIN_10", "TS_MIN_20"],
    "W31_W32_U3_ema": ["EMA_5", "EMA_20"],
    "W34_ts_skew": ["TS_SKEW_10"],
    "W35_W36_delta": ["DELTA", "DELTA_5"],
    "W37_W38_ts_arg": ["TS_ARG_MAX_5", "TS_ARG_MIN_5"],
    "W39_W44_decay": ["DECAY_LINEAR_5", "TS_DECAY_EXP_5"],
    "W42_product": ["PRODUCT_5"],
    "W43_W53_W54_W55_power_log_sqrt": ["SIGNED_POWER_2", "POWER", "SIGNED_LOG", "SQRT"],
    "W45_cs_rank": ["CS_RANK"],
    "W46_W47_cs_scale_neutralize": ["CS_SCALE", "CS_NEUTRALIZE"],
    "W48_W50_ts_sum": ["TS_SUM_5", "TS_SUM_10", "TS_SUM_20"],
    "W56_W57_ts_zscore": ["TS_ZSCORE_10", "TS_ZSCORE_20"],
    "W58_winsorize": ["WINSORIZE"],
    "W59_W61_squash": ["CLIP", "SIGMOID", "TANH_SQUASH"],
    "W62_if_gt": ["IF_GT"],
}


def apply_ops(df, names, s=S):
    """Add one lower-case column per operator, over the operands x, y, z."""
    spans = {n.lower(): ("x", (OPS[n].span,)) for n in names if OPS[n].kind == "ema"}
    if spans:
        df = with_ema(df, s, spans)
    args = ("x", "y", "z")
    # windows of one spec share a sort; cross-section operators come in a second step
    for kinds in (("map", "time"), ("cross",)):
        step = {n.lower(): OPS[n].build(s, *args[: OPS[n].arity]) for n in names if OPS[n].kind in kinds}
        if step:
            df = df.withColumns(step)
    return df


def _register(name, names):
    columns = "code:s ts:t " + " ".join(f"{n.lower()}:d" for n in names)
    sql = (
        f"WITH {LISTS_SQL}\nSELECT code, ts, "
        + ", ".join(f"{SQL_OPS[n]} AS {n.lower()}" for n in names)
        + " FROM lists WINDOW t AS (PARTITION BY ts)"
    )

    @query(name, columns, sql)
    def run(spark, sf_dir):
        return apply_ops(operands(spark, sf_dir), names)


for _name, _names in GROUPS.items():
    _register(_name, _names)
