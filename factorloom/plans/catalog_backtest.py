"""Registered queries of formulas (U1, U2, W63, W64) and of the backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import backtest as bt, labels
from factorloom.functions.features import features
from factorloom.functions.series import Series
from factorloom.operators.joins import common_timeline
from factorloom.plans.catalog_features import ALIGNED_SQL, feature_ctes, final_name
from factorloom.plans.formula import evaluate, evaluate_restricted
from factorloom.plans.registry import BARS_SQL, query
from factorloom.plans.research import FACTOR_SQL, PNL_SQL, S, factor_table, pnl
from factorloom.sources.market import bars_hourly

ALL = Series(keys=("code",), order="ts")


# -- flagship --------------------------------------------------------------------------
@query(
    "E1_factor_backtest",
    "code:s bars:i total_pnl:d sharpe:d max_drawdown:d mean_turnover:d",
    f"""WITH {PNL_SQL} SELECT code, count(*) AS bars, sum(pnl) AS total_pnl,
    avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(6240) AS sharpe, max(peak - cum) AS max_drawdown,
    avg(turnover) AS mean_turnover FROM dd GROUP BY code""",
)
def e1(spark, sf_dir):
    return bt.cumulative(pnl(spark, sf_dir)).groupBy("code").agg(
        F.count(F.lit(1)).alias("bars"),
        F.sum("pnl").alias("total_pnl"),
        bt.sharpe().alias("sharpe"),
        F.max("drawdown").alias("max_drawdown"),
        F.avg("turnover").alias("mean_turnover"),
    )


# -- formulas --------------------------------------------------------------------------
@query(
    "U1_W63_W64_formula_factor",
    "code:s ts:t factor:d invalid:b",
    f"""WITH {FACTOR_SQL}, g AS (SELECT *, avg(factor) OVER t AS m, stddev_samp(factor) OVER t AS sd,
      avg(factor) OVER c AS pm, sqrt(greatest(var_pop(factor) OVER c, 1e-8)) AS psd, count(*) OVER t AS n
      FROM (SELECT code, ts, CASE WHEN factor / (volume + 1e-6) > 0 THEN factor ELSE -ln(volume) END AS factor FROM factors)
      WINDOW t AS (PARTITION BY ts), c AS (PARTITION BY code ORDER BY ts))
    SELECT code, ts, greatest(least(CASE WHEN n > 1 THEN (factor - m) / greatest(sd, 1e-8)
      ELSE (factor - pm) / psd END, 3), -3) AS factor, false AS invalid FROM g""",
)
def formula_factor(spark, sf_dir):
    base = factor_table(spark, sf_dir).withColumnRenamed("factor", "f0").drop("invalid")
    base = base.withColumn("lv", F.log("volume"))
    tokens = ["f0", "volume", "DIV", "f0", "lv", "NEG", "GATE"]
    return evaluate(base, tokens, S, leaves=["f0", "volume", "lv"])


@query(
    "U1_malformed_formula_is_null",
    "code:s ts:t factor:d invalid:b",
    f"WITH {BARS_SQL} SELECT code, ts, CAST(NULL AS DOUBLE) AS factor, true AS invalid FROM bars",
)
def malformed(spark, sf_dir):
    return factor_table(spark, sf_dir, tokens=["mom", "ADD"])


@query(
    "U2_X21_restricted_formula",
    "code:s ts:t factor:d available:t",
    f"""WITH {BARS_SQL}, leaf AS (SELECT code, ts, volume >= 2 AS member,
      CASE WHEN volume >= 2 AND volume % 5 <> 0 AND seen <= cutoff THEN close END AS a,
      CASE WHEN volume >= 2 AND seen <= cutoff THEN open - 1 END AS b, seen
      FROM (SELECT *, ts + to_minutes(CAST(volume AS BIGINT)) AS seen, ts + INTERVAL 59 MINUTE AS cutoff FROM bars)),
    div AS (SELECT *, CASE WHEN b <> 0 THEN a / b END AS q FROM leaf),
    ranked AS (SELECT *, CASE WHEN q IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY q NULLS LAST)
      + (count(*) OVER (PARTITION BY ts, q) - 1) / 2.0) / count(q) OVER (PARTITION BY ts) END AS r,
      max(CASE WHEN q IS NOT NULL THEN seen END) OVER (PARTITION BY ts) AS top FROM div)
    SELECT code, ts, r * abs(b) AS factor, CASE WHEN r IS NOT NULL THEN top END AS available FROM ranked""",
)
def restricted(spark, sf_dir):
    """A bar of n ticks is known n minutes after it opens, its close not at all if 5 divides n; what is not known 59 minutes after the open is missing."""
    bars = bars_hourly(spark, sf_dir).select(
        "code", "ts", F.col("close").alias("a"), (F.col("open") - 1).alias("b"), (F.col("volume") >= 2).alias("member"),
        F.expr("ts + make_interval(0, 0, 0, 0, 0, int(volume), 0)").alias("at"),
        F.expr("ts + make_interval(0, 0, 0, 0, 0, if(volume % 5 = 0, 60, int(volume)), 0)").alias("a_at"),
        F.expr("ts + interval 59 minutes").alias("cutoff"),
    )
    tokens = ["a", "b", "DIV", "CS_RANK", "b", "ABS", "MUL"]
    return evaluate_restricted(bars, tokens, {"a": "a_at", "b": "at"}, "member", "cutoff")


@query(
    "U1_formula_over_features",
    "code:s ts:t factor:d invalid:b",
    "WITH " + ",\n".join([BARS_SQL, ALIGNED_SQL, *feature_ctes(["RET5", "RSI14", "VOL_Z"])[0]])
    + f""", v AS (SELECT code, ts, rn, {final_name('RSI14')} AS rsi, {final_name('RET5')} AS r5n,
        {final_name('VOL_Z')} AS vz FROM {feature_ctes(['RET5', 'RSI14', 'VOL_Z'])[1]}),
      w AS (SELECT *, (3 * r5n + 2 * coalesce(lag(r5n, 1) OVER c, 0.0) + coalesce(lag(r5n, 2) OVER c, 0.0)) / 6 AS wma
        FROM v WINDOW c AS (PARTITION BY code ORDER BY ts)),
      u AS (SELECT *, wma * rsi + CASE WHEN count(*) OVER (PARTITION BY ts) = 1 THEN vz
        ELSE vz - avg(vz) OVER (PARTITION BY ts) END AS f FROM w)
      SELECT code, ts, greatest(least((f - avg(f) OVER t) / greatest(stddev_samp(f) OVER t, 1e-8), 3), -3) AS factor,
        false AS invalid FROM u WINDOW t AS (PARTITION BY ts)""",
)
def over_features(spark, sf_dir):
    table = features(common_timeline(bars_hourly(spark, sf_dir)), ["RET5", "RSI14", "VOL_Z"])
    return evaluate(table, ["RET5", "WMA", "RSI14", "MUL", "VOL_Z", "CS_NEUTRALIZE", "ADD"])


# -- signals ---------------------------------------------------------------------------
@query(
    "C15_C17_positions_actions",
    "code:s ts:t pos:d dir:i action:s",
    f"""WITH {PNL_SQL}, d AS (SELECT *, coalesce(lag(dir) OVER (PARTITION BY code ORDER BY ts), 0) AS cur FROM pnl)
    SELECT code, ts, pos, dir, CASE WHEN cur = dir THEN 'HOLD' WHEN cur = 0 AND dir = 1 THEN 'OPEN_LONG'
      WHEN cur = 0 THEN 'OPEN_SHORT' WHEN dir = 0 THEN 'CLOSE' WHEN dir = 1 THEN 'REVERSE_TO_LONG'
      ELSE 'REVERSE_TO_SHORT' END AS action FROM d""",
)
def positions(spark, sf_dir):
    df = pnl(spark, sf_dir)
    return df.withColumn("action", bt.action(S.lag("dir", 1, 0), F.col("dir")))


@query(
    "L1_target_return",
    "code:s ts:t target_ret:d",
    f"""WITH {BARS_SQL} SELECT code, ts, coalesce(ln(lead(open, 2) OVER c / lead(open, 1) OVER c), 0.0) AS target_ret
    FROM bars WINDOW c AS (PARTITION BY code ORDER BY ts)""",
)
def target(spark, sf_dir):
    return bars_hourly(spark, sf_dir).select("code", "ts", bt.target_return(S).alias("target_ret"))


# -- P&L -------------------------------------------------------------------------------
@query(
    "B1_pnl_series",
    "code:s ts:t pos:d ret:d turnover:d pnl:d",
    f"WITH {PNL_SQL} SELECT code, ts, pos, ret, turnover, pnl FROM pnl",
)
def b1(spark, sf_dir):
    return pnl(spark, sf_dir)


@query("B2_portfolio_pnl", "ts:t pnl:d", f"WITH {PNL_SQL} SELECT ts, pnl FROM port")
def b2(spark, sf_dir):
    return bt.portfolio(pnl(spark, sf_dir))


@query(
    "B3_cumulative_drawdown",
    "code:s ts:t cum:d drawdown:d",
    f"WITH {PNL_SQL} SELECT code, ts, cum, peak - cum AS drawdown FROM dd",
)
def b3(spark, sf_dir):
    return bt.cumulative(pnl(spark, sf_dir))


@query(
    "B4_compounded_metrics",
    "code:s observations:i total_return:d annualized_return:d sharpe:d sortino:d max_drawdown:d calmar:d",
    f"""WITH {PNL_SQL}, r AS (SELECT code, ts, greatest(pnl / 20, -0.5) AS r FROM pnl),
    e AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY code ORDER BY ts)) AS eq FROM r),
    p AS (SELECT *, max(eq) OVER (PARTITION BY code ORDER BY ts) AS top FROM e),
    a AS (SELECT code, count(*) AS observations, product(1 + r) - 1 AS total_return, avg(r) AS m, stddev_pop(r) AS sd,
      stddev_pop(r) FILTER (r < 0) AS ds, max(1 - eq / top) AS max_drawdown FROM p GROUP BY code),
    y AS (SELECT *, pow(1 + total_return, 6240.0 / observations) - 1 AS annualized_return FROM a)
    SELECT code, observations, total_return, annualized_return, m / sd * sqrt(6240) AS sharpe,
      m / ds * sqrt(6240) AS sortino, max_drawdown, annualized_return / max_drawdown AS calmar FROM y""",
)
def b4(spark, sf_dir):
    returns = pnl(spark, sf_dir).withColumn("r", F.greatest(F.col("pnl") / 20, F.lit(-0.5)))
    return bt.compounded(returns, S, "r", bt.PERIODS_PER_YEAR)


_DOWN = "stddev_pop(pnl) FILTER (pnl < 0)"
_SPREAD_FLOOR = f"greatest(coalesce({_DOWN}, 0), 0.2 * greatest(stddev_pop(pnl), 1e-8), 1e-8)"


def sortino_sql(x: str = "pnl", where: str = "true") -> str:
    down = f"stddev_pop({x}) FILTER ({x} < 0 AND {where})"
    std = f"stddev_pop({x}) FILTER ({where})"
    floor = f"greatest(coalesce({down}, 0), 0.2 * greatest({std}, 1e-8), 1e-8)"
    return f"greatest(least(avg({x}) FILTER ({where}) / {floor} * sqrt(6240), 20), -20)"


@query(
    "B5_sortino_variants",
    "code:s by_spread:d by_mean:d by_tiny:d",
    f"""WITH {PNL_SQL} SELECT code, {sortino_sql()} AS by_spread,
      CASE WHEN count(*) FILTER (pnl < 0) = 0 THEN 0 ELSE greatest(least(
        avg(pnl) / greatest({_DOWN}, abs(avg(pnl)), 1e-8) * sqrt(6240), 20), -20) END AS by_mean,
      greatest(least(avg(pnl) / greatest(coalesce({_DOWN}, 1e-10), abs(avg(pnl)), 1e-10) * sqrt(6240), 20), -20)
        AS by_tiny FROM pnl GROUP BY code""",
)
def b5(spark, sf_dir):
    return pnl(spark, sf_dir).groupBy("code").agg(
        bt.sortino().alias("by_spread"),
        bt.sortino(floor="mean").alias("by_mean"),
        bt.sortino(floor="tiny").alias("by_tiny"),
    )


@query(
    "B6_rolling_sharpe",
    "code:s ts:t rolling_sharpe:d",
    f"""WITH {PNL_SQL}, f AS (SELECT *, avg(pnl) OVER w AS m, stddev_pop(pnl) OVER w AS sd FROM pnl WINDOW w AS
      (PARTITION BY code ORDER BY ts ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))
    SELECT code, ts, CASE WHEN rn < least(500, bars) THEN NULL WHEN sd < 1e-12 THEN 0
      ELSE greatest(least(m / sd * sqrt(6240), 20), -20) END AS rolling_sharpe FROM f""",
)
def b6(spark, sf_dir):
    return bt.rolling_sharpe(pnl(spark, sf_dir))


@query(
    "B24_trailing_sharpe",
    "code:s ts:t trailing_sharpe:d",
    f"""WITH {PNL_SQL}, f AS (SELECT *, avg(pnl) OVER w AS m, stddev_pop(pnl) OVER w AS sd FROM port WINDOW w AS
      (ORDER BY ts ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING))
    SELECT 'PORTFOLIO' AS code, ts, CASE WHEN rn > 250 THEN m / (sd + 1e-10) * sqrt(6240) END AS trailing_sharpe FROM f""",
)
def b24(spark, sf_dir):
    port = bt.portfolio(pnl(spark, sf_dir)).withColumn("rn", ALL.position())
    return bt.trailing_sharpe(port, ALL)


# -- trades ----------------------------------------------------------------------------
TRADES_SQL = f"""{PNL_SQL},
nx AS (SELECT *, coalesce(lag(dir) OVER c, 0) AS pd, coalesce(lead(open) OVER c, open) AS no,
  coalesce(lead(ts) OVER c, ts) AS nt FROM pnl WINDOW c AS (PARTITION BY code ORDER BY ts)),
rr AS (SELECT *, sum(CASE WHEN dir <> pd THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY ts) AS run FROM nx),
seg AS (SELECT code, run, any_value(dir) AS direction, min(rn) AS entry_rn, max(rn) AS last_rn, max(bars) AS bars,
  sum(pnl) AS pnl FROM rr WHERE dir <> 0 GROUP BY code, run),
trades AS (SELECT s.code, s.run, s.direction, s.entry_rn, least(s.last_rn + 1, s.bars) - s.entry_rn AS hold_bars,
  e.no AS entry_price, e.nt AS entry_time, x.no AS exit_price, x.nt AS exit_time, s.pnl
  FROM seg s JOIN rr e ON e.code = s.code AND e.rn = s.entry_rn
  JOIN rr x ON x.code = s.code AND x.rn = least(s.last_rn + 1, s.bars))"""


@query(
    "B7_trades",
    "code:s direction:i entry_rn:i hold_bars:i entry_price:d entry_time:t exit_price:d exit_time:t pnl:d",
    f"WITH {TRADES_SQL} SELECT * FROM trades",
)
def b7(spark, sf_dir):
    return bt.trades(pnl(spark, sf_dir))


@query(
    "B9_profit_loss_ratio",
    "code:s n_trades:i win_rate:d avg_hold_bars:d profit_loss_ratio:d total_pnl:d",
    f"""WITH {TRADES_SQL} SELECT code, count(*) AS n_trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate,
      avg(hold_bars) AS avg_hold_bars, avg(pnl) FILTER (pnl > 0) / avg(-pnl) FILTER (pnl < 0) AS profit_loss_ratio,
      sum(pnl) AS total_pnl FROM trades GROUP BY code""",
)
def b9(spark, sf_dir):
    return bt.trade_summary(bt.trades(pnl(spark, sf_dir)))


@query(
    "B8_segment_trades",
    "code:s n_trades:i n_long:i n_short:i n_flat:i win_rate:d avg_win:d avg_loss:d profit_factor:d max_win:d "
    "max_loss:d avg_trade_pnl:d avg_hold_bars:d",
    f"""WITH {PNL_SQL}, q AS (SELECT *, sum(CASE WHEN abs(pos - was) > 0.01 THEN 1 ELSE 0 END) OVER
        (PARTITION BY code ORDER BY ts) AS run FROM
        (SELECT *, lag(pos) OVER (PARTITION BY code ORDER BY ts) AS was FROM pnl)),
    g AS (SELECT code, run, arg_min(pos, rn) AS pos, sum(pnl) AS pnl, count(*) AS len FROM q GROUP BY 1, 2),
    h AS (SELECT *, abs(pos) >= 0.01 AS held FROM g)
    SELECT code, count(*) FILTER (held) AS n_trades, count(*) FILTER (held AND pos > 0) AS n_long,
      count(*) FILTER (held AND pos < 0) AS n_short, count(*) FILTER (NOT held) AS n_flat,
      count(*) FILTER (held AND pnl > 0) / greatest(count(*) FILTER (held), 1) AS win_rate,
      coalesce(avg(pnl) FILTER (held AND pnl > 0), 0) AS avg_win,
      coalesce(avg(pnl) FILTER (held AND pnl <= 0), 0) AS avg_loss,
      coalesce(sum(pnl) FILTER (held AND pnl > 0), 0) / greatest(abs(coalesce(sum(pnl) FILTER (held AND pnl <= 0), 0)), 1e-8)
        AS profit_factor, max(pnl) FILTER (held) AS max_win, min(pnl) FILTER (held) AS max_loss,
      avg(pnl) FILTER (held) AS avg_trade_pnl, avg(len) FILTER (held) AS avg_hold_bars FROM h GROUP BY code""",
)
def b8(spark, sf_dir):
    return bt.segment_trades(pnl(spark, sf_dir))


@query(
    "B10_max_consecutive_losses",
    "code:s max_consecutive_losses:i",
    f"""WITH {PNL_SQL}, q AS (SELECT *, sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) OVER
        (PARTITION BY code ORDER BY ts) AS run FROM pnl)
    SELECT code, max(n) AS max_consecutive_losses FROM
      (SELECT code, run, count(*) FILTER (pnl < 0) AS n FROM q GROUP BY 1, 2) GROUP BY code""",
)
def b10(spark, sf_dir):
    return bt.longest_losing_run(pnl(spark, sf_dir))


def runs_sql(sign: str, source: str = "pnl") -> str:
    return f"""rs AS (SELECT *, {sign} AS sg, row_number() OVER (PARTITION BY code ORDER BY ts)
        - row_number() OVER (PARTITION BY code, {sign} ORDER BY ts) AS island FROM {source}),
    runs AS (SELECT code, sg, island, count(*) AS length FROM rs WHERE sg <> 0 GROUP BY 1, 2, 3)"""


@query(
    "B11_average_hold",
    "code:s avg_hold:d",
    f"WITH {PNL_SQL}, {runs_sql('sign(pos)')} SELECT code, avg(length) AS avg_hold FROM runs GROUP BY code",
)
def b11(spark, sf_dir):
    return bt.average_hold(pnl(spark, sf_dir))


def quality_sql(runs: str, bars: str, hold: str) -> str:
    r = f"({runs} / greatest({bars} / 12.0, 1))"
    log2 = f"(ln(greatest({r}, 1e-12)) / ln(2))"
    return f"""(CASE WHEN {r} <= 0 THEN -2 WHEN {r} < 0.05 THEN -2 + {r} / 0.05 WHEN {r} < 0.5
      THEN -1 + ({r} - 0.05) / 0.45 WHEN {r} <= 2 THEN exp(-0.5 * {log2} * {log2})
      WHEN {r} <= 8 THEN 0.5 - ({r} - 2) / 6 * 1.5 ELSE -2 END
      + CASE WHEN {runs} > 0 THEN least(0.3, ln(greatest({hold}, 1)) / ln(30) * 0.3) ELSE 0 END)"""


@query(
    "B12_turnover_quality",
    "code:s runs:i avg_hold:d quality:d",
    f"""WITH {PNL_SQL}, {runs_sql('dir')}, a AS (SELECT code, count(*) AS runs, avg(length) AS avg_hold FROM runs GROUP BY code),
    b AS (SELECT code, count(*) AS bars FROM pnl GROUP BY code)
    SELECT code, runs, avg_hold, {quality_sql('runs', 'bars', 'avg_hold')} AS quality FROM a JOIN b USING (code)""",
)
def b12(spark, sf_dir):
    """Runs of the discretised direction: only whole positions count as trades."""
    df = pnl(spark, sf_dir)
    runs = bt.holding_runs(df, S, F.col("dir")).groupBy("code").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("length").alias("avg_hold")
    )
    bars = df.groupBy("code").agg(F.count(F.lit(1)).alias("bars"))
    return runs.join(bars, "code").withColumn(
        "quality", bt.turnover_quality(F.col("runs"), F.col("bars"), F.col("avg_hold"))
    )


# -- scores ----------------------------------------------------------------------------
_SHARES = """avg(CASE WHEN pos > 0.05 THEN 1.0 ELSE 0 END) AS lo, avg(CASE WHEN pos < -0.05 THEN 1.0 ELSE 0 END) AS sh,
  avg(CASE WHEN pos > 0 THEN 1.0 ELSE 0 END) AS up, avg(CASE WHEN pos < 0 THEN 1.0 ELSE 0 END) AS down"""
_SIDE = """CASE WHEN greatest(lo, sh) > 0.85 THEN -2 * (greatest(lo, sh) - 0.85) / 0.15
  WHEN greatest(lo, sh) > 0.7 THEN -0.5 * (greatest(lo, sh) - 0.7) / 0.15 ELSE 0 END"""
_HALF = "CASE WHEN bars < 20 THEN 0 WHEN s1 > 0 AND s2 > 0 THEN 0.5 WHEN s1 * s2 < 0 THEN -1 ELSE 0 END"


def components_ctes(source: str, name: str) -> str:
    """Per-series score components of a P&L relation with rn, bars, factor."""
    return f"""{name}c AS (SELECT *, sum(pnl) OVER (PARTITION BY code ORDER BY ts) AS c_cum,
        lag(factor) OVER (PARTITION BY code ORDER BY ts) AS fp FROM {source}),
      {name}d AS (SELECT *, max(c_cum) OVER (PARTITION BY code ORDER BY ts) - c_cum AS c_dd FROM {name}c),
      {name}a AS (SELECT code, count(*) AS bars, avg(pnl) * 6240 AS ann_ret, {sortino_sql()} AS sortino,
        max(c_dd) AS mdd, covar_pop(factor, ret) / (stddev_pop(factor) * stddev_pop(ret) + 1e-8) AS ic, {_SHARES},
        avg(abs(pos)) AS expo, avg(turnover) AS turn, {sortino_sql('pnl', 'rn <= bars // 2')} AS s1,
        {sortino_sql('pnl', 'rn > bars // 2')} AS s2,
        covar_pop(factor, fp) / (stddev_pop(factor) FILTER (fp IS NOT NULL) * stddev_pop(fp) + 1e-8) AS ac1,
        {sortino_sql('(pos * ret - turnover * 0.0006)')} AS stress0 FROM {name}d GROUP BY code),
      {name} AS (SELECT *, greatest(least(ann_ret / greatest(mdd, 1e-8), 10), -10) AS calmar,
        CASE WHEN bars < 10 THEN 0 ELSE greatest(least(ic / 1e-6, 3), -3) END AS ts_ic, -2.0 AS quality,
        CASE WHEN expo < 0.1 THEN (expo / 0.1 - 1) * 2 ELSE 0 END AS exposure_pen, {_SIDE} AS side_pen,
        {_HALF} AS half, greatest(least(1 - abs(ac1) + CASE WHEN ac1 < 0 THEN 0.5 ELSE 0 END, 2), -1) AS reversal,
        greatest(least(1 - 2 * (abs(up - 0.5) + abs(down - 0.5)), 1), -1) AS symmetry,
        greatest(least(stress0, 5), -5) AS stress, -greatest(least((turn - 0.2) * 3, 3), 0) AS turnover_pen
        FROM {name}a)"""


@query(
    "B13_penalties",
    "code:s exposure_pen:d side_pen:d turnover_pen:d",
    f"WITH {PNL_SQL}, {components_ctes('pnl', 'k')} SELECT code, exposure_pen, side_pen, turnover_pen FROM k",
)
@query(
    "B14_half_consistency",
    "code:s half:d",
    f"WITH {PNL_SQL}, {components_ctes('pnl', 'k')} SELECT code, half FROM k",
)
@query(
    "B17_reversal_symmetry",
    "code:s reversal:d symmetry:d",
    f"WITH {PNL_SQL}, {components_ctes('pnl', 'k')} SELECT code, reversal, symmetry FROM k",
)
def components(spark, sf_dir):
    return bt.score_inputs(pnl(spark, sf_dir))


_CONSISTENCY_SQL = """mv AS (SELECT *, abs(abs(pos) - abs(lag(pos) OVER (PARTITION BY code ORDER BY ts))) AS move FROM pnl),
    pc AS (SELECT code, {sortino} AS sortino, count(*) FILTER (move > 0.1) AS n_trades, max(bars) AS bars,
      covar_pop(factor, ret) / (stddev_pop(factor) * stddev_pop(ret) + 1e-8) AS ic FROM mv GROUP BY code),
    sc AS (SELECT avg(CASE WHEN n_trades < greatest(5, bars // 100) THEN 1.0 ELSE 0 END) AS inactive_share,
      min(sortino) AS worst, avg(CASE WHEN sortino > 0 THEN 1.0 ELSE 0 END)
        FILTER (n_trades >= greatest(5, bars // 100)) AS positive_share FROM pc),
    cons AS (SELECT *, CASE WHEN inactive_share > 0.4 THEN -3 WHEN worst < -2 THEN -2
      WHEN positive_share IS NULL THEN -3 WHEN positive_share < 0.6 THEN (positive_share - 0.6) / 0.6
      ELSE (positive_share - 0.6) / 0.4 + CASE WHEN positive_share = 1 THEN 0.5 ELSE 0 END END AS consistency FROM sc)""".format(
    sortino=sortino_sql()
)


@query(
    "B15_symbol_consistency",
    "inactive_share:d worst:d positive_share:d consistency:d",
    f"WITH {PNL_SQL}, {_CONSISTENCY_SQL} SELECT * FROM cons",
)
def b15(spark, sf_dir):
    df = pnl(spark, sf_dir).withColumn("_move", F.abs(F.abs("pos") - F.abs(S.lag("pos", 1))))
    codes = df.groupBy("code").agg(
        bt.sortino().alias("sortino"), F.count(F.when(F.col("_move") > 0.1, 1)).alias("n_trades"), F.max("bars").alias("bars")
    )
    return bt.symbol_consistency(codes)


@query(
    "B16_cost_stress",
    "code:s multiple:i ann_ret:d sortino:d sharpe:d profitable:b",
    f"""WITH {PNL_SQL}, st AS (SELECT code, k.multiple, pos * ret - turnover * 0.0003 * k.multiple AS pnl
      FROM pnl, (VALUES (1), (2), (3), (5)) k(multiple))
    SELECT code, multiple, avg(pnl) * 6240 AS ann_ret, greatest(least({sortino_sql()}, 5), -5) AS sortino,
      avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(6240) AS sharpe, avg(pnl) > 0 AS profitable FROM st GROUP BY 1, 2""",
)
def b16(spark, sf_dir):
    multiples = F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 5)]))
    df = pnl(spark, sf_dir).withColumn("multiple", multiples)
    df = df.withColumn("pnl", F.col("pos") * F.col("ret") - F.col("turnover") * bt.COST_RATE * F.col("multiple"))
    return df.groupBy("code", "multiple").agg(
        (F.avg("pnl") * bt.PERIODS_PER_YEAR).alias("ann_ret"),
        bt.clamp(bt.sortino(), -5.0, 5.0).alias("sortino"),
        bt.sharpe().alias("sharpe"),
        (F.avg("pnl") > 0).alias("profitable"),
    )


_ONE = {
    m: " + ".join(f"{w} * {n}" for n, w in bt.SCORE_WEIGHTS[(m, False)].items()) + " + exposure_pen + side_pen + half"
    for m in ("default", "ftmo", "forex")
}
_MANY = {
    m: " + ".join(f"{w} * {n}" for n, w in bt.SCORE_WEIGHTS[(m, True)].items()) + " + exposure_pen + side_pen + half"
    for m in ("default", "ftmo")
}


@query(
    "B18_score_single_series",
    "code:s score_default:d score_ftmo:d score_forex:d",
    f"WITH {PNL_SQL}, {components_ctes('pnl', 'k')} SELECT code, {_ONE['default']} AS score_default,"
    f" {_ONE['ftmo']} AS score_ftmo, {_ONE['forex']} AS score_forex FROM k",
)
def b18(spark, sf_dir):
    inputs = bt.score_inputs(pnl(spark, sf_dir))
    return inputs.select("code", *[bt.score(m, False).alias(f"score_{m}") for m in ("default", "ftmo", "forex")])


@query(
    "B18_score_several_series",
    "ann_ret:d sortino:d calmar:d ts_ic:d consistency:d stress:d quality:d score_default:d score_ftmo:d",
    f"""WITH {PNL_SQL}, {_CONSISTENCY_SQL},
    fl AS (SELECT *, sum(pnl) OVER (ORDER BY code, ts) AS level FROM pnl),
    fd AS (SELECT *, max(level) OVER (ORDER BY code, ts) - level AS fdd FROM fl),
    ag AS (SELECT avg(pnl) * 6240 AS ann_ret, {sortino_sql()} AS sortino, max(fdd) AS mdd, {_SHARES},
      avg(abs(pos)) AS expo, {sortino_sql('pnl', 'rn <= bars // 2')} AS s1, {sortino_sql('pnl', 'rn > bars // 2')} AS s2,
      {sortino_sql('(pos * ret - turnover * 0.0006)')} AS stress0, max(bars) AS bars FROM fd),
    allc AS (SELECT *, greatest(least(ann_ret / greatest(mdd, 1e-8), 10), -10) AS calmar,
      (SELECT greatest(least(avg(ic) / (stddev_pop(ic) + 1e-6), 3), -3) FROM pc) AS ts_ic,
      (SELECT consistency FROM cons) AS consistency, greatest(least(stress0, 5), -5) AS stress, -2.0 AS quality,
      CASE WHEN expo < 0.1 THEN (expo / 0.1 - 1) * 2 ELSE 0 END AS exposure_pen, {_SIDE} AS side_pen, {_HALF} AS half FROM ag)
    SELECT *, {_MANY['default']} AS score_default, {_MANY['ftmo']} AS score_ftmo FROM allc""",
)
def b18_many(spark, sf_dir):
    inputs = bt.several_score_inputs(pnl(spark, sf_dir))
    return inputs.select("*", *[bt.score(m, True).alias(f"score_{m}") for m in ("default", "ftmo")])


_FOLDS = 4


def _parts_sql(train: str, val: str) -> str:
    """P&L rows relabelled per part, with rn and bars restarted."""
    return f"""lab AS (SELECT * EXCLUDE (rn, bars), rn AS g, bars AS total FROM pnl),
    tr AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts) AS rn, count(*) OVER (PARTITION BY code) AS bars
      FROM lab WHERE {train}),
    va AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts) AS rn, count(*) OVER (PARTITION BY code) AS bars
      FROM lab WHERE {val})"""


_MULT = "CASE WHEN {s} <= 0 THEN greatest(0.1, 0.5 + {s} * 0.4) ELSE least(1.2, 1 + {s} * 0.1) END"


@query(
    "B19_fold_scores",
    "code:s train_score:d val_score:d",
    f"""WITH {PNL_SQL}, {_parts_sql('g <= total // 2', 'g > total // 2 + 8 AND g <= total - 2')},
    {components_ctes('tr', 'a')}, {components_ctes('va', 'b')}
    SELECT a.code, a.s + a.turnover_pen AS train_score, b.s * {_MULT.format(s='b.sortino')} AS val_score
    FROM (SELECT *, {_ONE['default']} AS s FROM a) a JOIN (SELECT *, {_ONE['default']} AS s FROM b) b ON a.code = b.code""",
)
def b19(spark, sf_dir):
    """First half trains; validation starts 8 bars later and stops before the boundary labels."""
    half = F.floor(F.col("bars") / 2)
    part = F.when(F.col("rn") <= half, "train").when(
        (F.col("rn") > half + 8) & (F.col("rn") <= F.col("bars") - 2), "val"
    )
    parts = bt.restart(pnl(spark, sf_dir), part)
    inputs = bt.score_inputs(parts, Series(keys=("code", "part")))
    scored = inputs.withColumn("score", bt.score("default", False))
    value = F.when(F.col("part") == "train", F.col("score") + F.col("turnover_pen")).otherwise(
        F.col("score") * bt.oos_multiplier(F.col("sortino"))
    )
    return scored.groupBy("code").agg(
        F.max(F.when(F.col("part") == "train", value)).alias("train_score"),
        F.max(F.when(F.col("part") == "val", value)).alias("val_score"),
    )


@query(
    "B20_evaluate_80_20",
    "code:s score:d mean_oos:d",
    f"""WITH {PNL_SQL}, {_parts_sql('g <= floor(total * 0.8)', 'g > floor(total * 0.8)')}, {components_ctes('tr', 'a')},
    o AS (SELECT code, {sortino_sql()} AS oos, avg(pnl) AS mean_oos FROM va GROUP BY code)
    SELECT code, (s + turnover_pen) * {_MULT.format(s='oos')} AS score, mean_oos
    FROM (SELECT *, {_ONE['default']} AS s FROM a) JOIN o USING (code)""",
)
def b20(spark, sf_dir):
    split = F.floor(F.col("bars") * 0.8)
    parts = bt.restart(pnl(spark, sf_dir), F.when(F.col("rn") <= split, "train").otherwise("test"))
    train = bt.score_inputs(parts.where(F.col("part") == "train"))
    test = parts.where(F.col("part") == "test").groupBy("code").agg(
        bt.sortino().alias("oos"), F.avg("pnl").alias("mean_oos")
    )
    total = (bt.score("default", False) + F.col("turnover_pen")) * bt.oos_multiplier(F.col("oos"))
    return train.join(test, "code").select("code", total.alias("score"), "mean_oos")


_AUDIT_RULES = [
    ("LOW_RETURN", "ann_ret < 0.02", "INVALID"),
    ("LOW_SHARPE", "sharpe < 0.5", "SUSPICIOUS"),
    ("DRAWDOWN_10", "mdd > 0.10", "SUSPICIOUS"),
    ("DRAWDOWN_20", "mdd > 0.20", "INVALID"),
    ("ONE_SIDED", "greatest(long_share, short_share) > 0.85", "SUSPICIOUS"),
    ("HALVES_DISAGREE", "h1_ann * h2_ann < 0", "SUSPICIOUS"),
    ("FOLDS_NEGATIVE", "folds_positive < 1.5", "SUSPICIOUS"),
    ("COST_2X_LOSS", "ann_2x <= 0", "SUSPICIOUS"),
]
_VERDICT = (
    "CASE WHEN " + " OR ".join(f"({r})" for _, r, v in _AUDIT_RULES if v == "INVALID") + " THEN 'INVALID' WHEN "
    + " OR ".join(f"({r})" for _, r, v in _AUDIT_RULES if v == "SUSPICIOUS") + " THEN 'SUSPICIOUS' ELSE 'VALID' END"
)


@query(
    "B21_audit_verdict",
    "ann_ret:d sharpe:d mdd:d long_share:d short_share:d trade_count:i h1_ann:d h2_ann:d folds_positive:i ann_2x:d "
    "verdict:s issues:s",
    f"""WITH {PNL_SQL}, pc AS (SELECT *, sum(pnl) OVER (ORDER BY ts) AS cum FROM port),
    pd AS (SELECT *, max(cum) OVER (ORDER BY ts) - cum AS dd FROM pc),
    fo AS (SELECT count(*) FILTER (a > 0) AS folds_positive FROM (SELECT avg(pnl) AS a FROM port
      WHERE rn > bars // 4 AND rn <= 4 * (bars // 4) GROUP BY (rn - 1) // (bars // 4))),
    fd AS (SELECT code, dir, lag(dir) OVER (PARTITION BY code ORDER BY ts) AS pd FROM
      (SELECT code, ts, CASE WHEN pos > 0.05 THEN 1 WHEN pos < -0.05 THEN -1 ELSE 0 END AS dir FROM pnl) WHERE dir <> 0),
    st AS (SELECT ts, avg(pos * ret - turnover * 0.0006) AS p2 FROM pnl GROUP BY ts),
    m AS (SELECT avg(pnl) * 6240 AS ann_ret, CASE WHEN stddev_pop(pnl) > 1e-8 THEN
        avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(6240) ELSE 0 END AS sharpe, max(dd) AS mdd,
      avg(pnl) FILTER (rn <= bars // 2) * 6240 AS h1_ann, avg(pnl) FILTER (rn > bars // 2) * 6240 AS h2_ann FROM pd),
    a AS (SELECT *, (SELECT avg(CASE WHEN pos > 0.05 THEN 1.0 ELSE 0 END) FROM pnl) AS long_share,
      (SELECT avg(CASE WHEN pos < -0.05 THEN 1.0 ELSE 0 END) FROM pnl) AS short_share,
      (SELECT count(*) FROM fd WHERE dir <> pd) AS trade_count, (SELECT avg(p2) * 6240 FROM st) AS ann_2x FROM m, fo)
    SELECT *, {_VERDICT} AS verdict, concat_ws(';', {', '.join(f"CASE WHEN {r} THEN '{n}' END" for n, r, _ in _AUDIT_RULES)})
      AS issues FROM a""",
)
def b21(spark, sf_dir):
    df = pnl(spark, sf_dir)
    port = df.groupBy("ts").agg(
        F.avg("pnl").alias("pnl"),
        F.avg(F.col("pos") * F.col("ret") - F.col("turnover") * (2 * bt.COST_RATE)).alias("pnl_2x"),
    )
    port = port.withColumn("code", F.lit("PORTFOLIO"))
    port = port.withColumns({"rn": ALL.position(), "bars": F.count(F.lit(1)).over(bt.Window.partitionBy("code"))})
    size = F.floor(F.col("bars") / 4)
    fold = F.when((F.col("rn") > size) & (F.col("rn") <= 4 * size), F.floor((F.col("rn") - 1) / size))
    half = F.floor(F.col("bars") / 2)
    port = bt.cumulative(port.withColumns({"fold": fold, "_half": half}), ALL)
    annual = bt.PERIODS_PER_YEAR
    main = port.agg(
        (F.avg("pnl") * annual).alias("ann_ret"),
        F.when(F.stddev_pop("pnl") > 1e-8, bt.sharpe()).otherwise(0.0).alias("sharpe"),
        F.max("drawdown").alias("mdd"),
        (F.avg(F.when(F.col("rn") <= F.col("_half"), F.col("pnl"))) * annual).alias("h1_ann"),
        (F.avg(F.when(F.col("rn") > F.col("_half"), F.col("pnl"))) * annual).alias("h2_ann"),
        (F.avg("pnl_2x") * annual).alias("ann_2x"),
        *[F.avg(F.when(F.col("fold") == k, F.col("pnl"))).alias(f"_f{k}") for k in (1, 2, 3)],
    )
    side = F.when(F.col("pos") > 0.05, 1).when(F.col("pos") < -0.05, -1).otherwise(0)
    active = df.withColumn("_side", side).where(F.col("_side") != 0)
    flips = active.withColumn("_was", S.lag("_side", 1)).where(F.col("_side") != F.col("_was"))
    shares = df.agg(
        F.avg((F.col("pos") > 0.05).cast("double")).alias("long"), F.avg((F.col("pos") < -0.05).cast("double")).alias("short")
    )
    positive = sum(F.when(F.col(f"_f{k}") > 0, 1).otherwise(0) for k in (1, 2, 3))
    out = main.select(
        "ann_ret", "sharpe", "mdd", "h1_ann", "h2_ann", "ann_2x",
        shares.select("long").scalar().alias("long_share"),
        shares.select("short").scalar().alias("short_share"),
        flips.agg(F.count(F.lit(1)).alias("n")).scalar().alias("trade_count"),
        positive.alias("folds_positive"),
    )
    issues = F.concat_ws(";", *[F.expr(f"CASE WHEN {rule} THEN '{name}' END") for name, rule, _ in _AUDIT_RULES])
    return out.withColumns({"verdict": F.expr(_VERDICT), "issues": issues})


# Token lists over the momentum leaf, scanned together (fixed strategies).
STRATEGIES = {
    "momentum": ["mom", "TS_ZSCORE_10"],
    "reversal": ["mom", "NEG", "TS_ZSCORE_10"],
    "neutral": ["mom", "TS_ZSCORE_10", "CS_NEUTRALIZE"],
    "smooth": ["mom", "WMA", "TS_ZSCORE_10"],
}


def strategy_pnl(spark, sf_dir):
    """All strategies as columns of one job, stacked into (strategy, code, ts) rows."""
    df = factor_table(spark, sf_dir, tokens=["mom"]).drop("factor", "invalid")
    for name, tokens in STRATEGIES.items():
        df = evaluate(df, tokens, S, leaves=["mom"], factor=f"s_{name}", normalise=False).drop("invalid")
    stacked = df.select("code", "ts", "open", *[f"s_{n}" for n in STRATEGIES]).unpivot(
        ["code", "ts", "open"], [f"s_{n}" for n in STRATEGIES], "strategy", "factor"
    )
    return bt.pnl_table(stacked, Series(keys=("strategy", "code")))


STRATEGY_SQL = f"""{FACTOR_SQL}, wm AS (
  SELECT *, (3 * mom + 2 * coalesce(lag(mom, 1) OVER c, 0.0) + coalesce(lag(mom, 2) OVER c, 0.0)) / 6 AS wma
  FROM mom WINDOW c AS (PARTITION BY code ORDER BY ts)),
wl AS (SELECT *, list_concat(list_resize(CAST([] AS DOUBLE[]), greatest(10 - rn, 0), 0.0), list(wma) OVER
  (PARTITION BY code ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS l FROM wm),
strat AS (
  SELECT 's_momentum' AS strategy, code, ts, open, z AS factor FROM z
  UNION ALL SELECT 's_reversal', code, ts, open, -z FROM z
  UNION ALL SELECT 's_neutral', code, ts, open, factor FROM factors
  UNION ALL SELECT 's_smooth', code, ts, open, CASE WHEN list_aggregate(l, 'var_pop') < 1e-18 THEN 0.0
    ELSE (wma - list_sum(l) / 10) / (sqrt(list_aggregate(l, 'var_pop')) + 1e-9) END FROM wl),
sp AS (SELECT *, CASE WHEN abs(tanh(factor)) >= 0.05 THEN tanh(factor) ELSE 0.0 END AS pos,
  coalesce(ln(lead(open, 2) OVER c / lead(open, 1) OVER c), 0.0) AS ret FROM strat
  WINDOW c AS (PARTITION BY strategy, code ORDER BY ts)),
spn AS (SELECT *, pos * ret - abs(pos - coalesce(lag(pos) OVER (PARTITION BY strategy, code ORDER BY ts), 0.0)) * 0.0003
  AS pnl FROM sp),
spc AS (SELECT *, sum(pnl) OVER (PARTITION BY strategy, code ORDER BY ts) AS cum FROM spn),
spd AS (SELECT *, max(cum) OVER (PARTITION BY strategy, code ORDER BY ts) - cum AS dd FROM spc)"""


@query(
    "B22_batch_factor_scan",
    "strategy:s code:s bars:i ann_ret:d total_ret:d sharpe:d mdd:d valid:b",
    f"""WITH {STRATEGY_SQL} SELECT strategy, code, count(*) AS bars, avg(pnl) * 6240 AS ann_ret, sum(pnl) AS total_ret,
      avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(6240) AS sharpe, max(dd) AS mdd, avg(pnl) > 0 AS valid
    FROM spd GROUP BY 1, 2""",
)
def b22(spark, sf_dir):
    s = Series(keys=("strategy", "code"))
    return bt.cumulative(strategy_pnl(spark, sf_dir), s).groupBy("strategy", "code").agg(
        F.count(F.lit(1)).alias("bars"),
        (F.avg("pnl") * bt.PERIODS_PER_YEAR).alias("ann_ret"),
        F.sum("pnl").alias("total_ret"),
        bt.sharpe().alias("sharpe"),
        F.max("drawdown").alias("mdd"),
        (F.avg("pnl") > 0).alias("valid"),
    )


@query(
    "B23_L6_holdout_evaluation",
    "code:s bars:i total_log_pnl:d sharpe:d sortino:d mean_exposure:d mean_turnover:d",
    f"""WITH {PNL_SQL}, ho AS (SELECT code, ts, pos, ret, lag(pos) OVER c AS pp FROM
      (SELECT * FROM pnl WHERE rn > bars - greatest(3, ceil(bars * 0.1)) AND rn <= bars - 2)
      WINDOW c AS (PARTITION BY code ORDER BY ts)),
    hp AS (SELECT *, abs(pos - coalesce(pp, 0.0)) AS turnover, pos * ret - abs(pos - coalesce(pp, 0.0)) * 0.0003 AS pnl FROM ho)
    SELECT code, count(*) AS bars, sum(pnl) AS total_log_pnl, avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(6240) AS sharpe,
      {sortino_sql()} AS sortino, avg(abs(pos)) AS mean_exposure, avg(turnover) AS mean_turnover FROM hp GROUP BY code""",
)
def b23(spark, sf_dir):
    """The suffix of max(3, 10%) bars without the two boundary labels; the position restarts at 0."""
    held_out = F.greatest(F.lit(3), F.ceil(F.col("bars") * 0.1))
    suffix = pnl(spark, sf_dir).where((F.col("rn") > F.col("bars") - held_out) & (F.col("rn") <= F.col("bars") - 2))
    turnover = F.abs(F.col("pos") - S.lag("pos", 1, 0.0))
    df = suffix.withColumn("turnover", turnover)
    df = df.withColumn("pnl", F.col("pos") * F.col("ret") - F.col("turnover") * bt.COST_RATE)
    return df.groupBy("code").agg(
        F.count(F.lit(1)).alias("bars"),
        F.sum("pnl").alias("total_log_pnl"),
        bt.sharpe().alias("sharpe"),
        bt.sortino().alias("sortino"),
        F.avg(F.abs("pos")).alias("mean_exposure"),
        F.avg("turnover").alias("mean_turnover"),
    )


_FROZEN = ["RET5", "RSI14", "VOL_Z"]
_FROZEN_V = f"""v AS (SELECT code, ts, rn, {', '.join(f'{final_name(n)} AS {n.lower()}' for n in _FROZEN)} FROM {feature_ctes(_FROZEN)[1]})"""
_HELD_OUT = "greatest(3, ceil(count(*) OVER (PARTITION BY code) * 0.1))"


@query(
    "L6_development_view",
    "code:s ts:t ret5:d rsi14:d vol_z:d target:d",
    "WITH "
    + ",\n".join([BARS_SQL, ALIGNED_SQL.replace("src AS", "whole AS", 1),
        f"src AS (SELECT * FROM whole QUALIFY rn <= count(*) OVER (PARTITION BY code) - {_HELD_OUT})", *feature_ctes(_FROZEN)[0], _FROZEN_V])
    + """ SELECT v.code, v.ts, ret5, rsi14, vol_z, coalesce(ln(two.open / one.open), 0.0) AS target FROM v
      LEFT JOIN src one ON one.code = v.code AND one.rn = v.rn + 1 LEFT JOIN src two ON two.code = v.code AND two.rn = v.rn + 2""",
)
def l6(spark, sf_dir):
    """Features and labels of the development prefix, recomputed on it."""
    prefix = labels.development_view(common_timeline(bars_hourly(spark, sf_dir)), S)
    table = features(prefix, _FROZEN, keep=["open"]).withColumn("target", bt.target_return(S))
    return table.withColumnsRenamed({n: n.lower() for n in _FROZEN})


@query(
    "B23_frozen_snapshot",
    "evaluable_bars:i formula_count:i total_log_pnl:d simple_return_equivalent:d annualized_log_return:d sharpe:d sortino:d calmar:d "
    "max_drawdown_log:d mean_exposure:d mean_turnover:d",
    "WITH "
    + ",\n".join([BARS_SQL, ALIGNED_SQL, *feature_ctes(_FROZEN)[0], _FROZEN_V])
    + f""", f AS (SELECT v.code, v.ts, v.rn, tanh((ret5 + rsi14 * vol_z) / 2) AS raw, ln(two.open / one.open) AS ret FROM v
        JOIN src one ON one.code = v.code AND one.rn = v.rn + 1 JOIN src two ON two.code = v.code AND two.rn = v.rn + 2
        WHERE v.rn > (SELECT max(rn) - greatest(3, ceil(max(rn) * 0.1)) FROM src)),
      p AS (SELECT code, ts, ret, CASE WHEN abs(raw) >= 0.05 THEN raw ELSE 0 END AS pos FROM f),
      t AS (SELECT *, abs(pos - lag(pos, 1, 0) OVER (PARTITION BY code ORDER BY ts)) AS turnover FROM p),
      r AS (SELECT *, pos * ret - turnover * 0.0003 AS pnl FROM t),
      flat AS (SELECT *, sum(pnl) OVER (ORDER BY code, ts) AS cum FROM r),
      falls AS (SELECT *, max(cum) OVER (ORDER BY code, ts) - cum AS fall FROM flat),
      book AS (SELECT ts, avg(pnl) AS pnl FROM r GROUP BY ts),
      walk AS (SELECT *, sum(pnl) OVER (ORDER BY ts) AS cum FROM book),
      deep AS (SELECT *, max(cum) OVER (ORDER BY ts) - cum AS fall FROM walk),
      a AS (SELECT count(*) AS evaluable_bars, sum(pnl) AS total_log_pnl, exp(sum(pnl)) - 1 AS simple_return_equivalent, avg(pnl) * 6240 AS annualized_log_return,
        avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(6240) AS sharpe, max(fall) AS max_drawdown_log FROM deep),
      b AS (SELECT {sortino_sql()} AS sortino, greatest(least(avg(pnl) * 6240 / greatest(max(fall), 1e-8), 10), -10) AS calmar,
        avg(abs(pos)) AS mean_exposure, avg(turnover) AS mean_turnover FROM falls)
      SELECT a.*, b.*, 2 AS formula_count FROM a, b""",
)
def b23_snapshot(spark, sf_dir):
    """Two frozen formulas, computed on all bars and judged together on the held-out tenth."""
    table = features(common_timeline(bars_hourly(spark, sf_dir)), _FROZEN, keep=["open"])
    keep = ["code", "ts", "open", *_FROZEN]
    first = evaluate(table, ["RET5"], S, normalise=False, factor="first").select(*keep, "first")
    both = evaluate(first, ["RSI14", "VOL_Z", "MUL"], S, normalise=False, factor="second").select("code", "ts", "open", "first", "second")
    return bt.frozen_snapshot(labels.split_chronologically(both, S), ["first", "second"], S)


@query(
    "G7_resample_24_bars",
    "code:s block:i pnl:d",
    f"""WITH {PNL_SQL} SELECT code, (rn - 1) // 24 AS block, sum(pnl) AS pnl FROM pnl
    GROUP BY 1, 2 HAVING count(*) = 24""",
)
def g7(spark, sf_dir):
    return bt.blocks_sum(pnl(spark, sf_dir), 24, keep_tail=False)


@query(
    "B25_daily_limits",
    "code:s max_daily_loss:d violations:i trading_days:i target_day:i",
    f"""WITH {PNL_SQL}, d AS (SELECT code, (rn - 1) // 24 AS block, sum(pnl) / 50 AS pnl FROM pnl GROUP BY 1, 2
      HAVING count(*) = 24), c AS (SELECT *, sum(pnl) OVER w AS cum, sum(CASE WHEN abs(pnl) > 1e-11 THEN 1 ELSE 0 END)
      OVER w AS day FROM d WINDOW w AS (PARTITION BY code ORDER BY block)),
    p AS (SELECT *, greatest(max(cum - pnl) OVER (PARTITION BY code ORDER BY block), 0) AS peak FROM c)
    SELECT code, max(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) AS max_daily_loss,
      count(*) FILTER (cum < peak - 0.1) AS violations, max(day) AS trading_days,
      min(day) FILTER (cum >= 0.1) AS target_day FROM p GROUP BY code""",
)
def b25(spark, sf_dir):
    daily = bt.blocks_sum(pnl(spark, sf_dir), 24, keep_tail=False).withColumn("pnl", F.col("pnl") / 50)
    return bt.daily_limits(daily, Series(order="block"))


@query(
    "G9_segment_sums",
    "code:s first_half:d second_half:d third_1:d third_2:d third_3:d",
    f"""WITH {PNL_SQL} SELECT code, sum(pnl) FILTER (rn <= bars // 2) AS first_half, sum(pnl) FILTER (rn > bars // 2)
      AS second_half, sum(pnl) FILTER (rn <= bars // 3) AS third_1,
      sum(pnl) FILTER (rn > bars // 3 AND rn <= 2 * bars // 3) AS third_2, sum(pnl) FILTER (rn > 2 * bars // 3) AS third_3
    FROM pnl GROUP BY code""",
)
def g9(spark, sf_dir):
    rn, bars = F.col("rn"), F.col("bars")

    def part(condition):
        return F.sum(F.when(condition, F.col("pnl")))

    one, two = F.floor(bars / 3), F.floor(2 * bars / 3)
    return pnl(spark, sf_dir).groupBy("code").agg(
        part(rn <= F.floor(bars / 2)).alias("first_half"),
        part(rn > F.floor(bars / 2)).alias("second_half"),
        part(rn <= one).alias("third_1"),
        part((rn > one) & (rn <= two)).alias("third_2"),
        part(rn > two).alias("third_3"),
    )


@query(
    "G10_pseudo_months",
    "code:s block:i pnl:d",
    f"""WITH {PNL_SQL} SELECT code, (rn - 1) // 520 AS block, sum(pnl) AS pnl FROM pnl GROUP BY 1, 2
    HAVING count(*) = 520""",
)
def g10(spark, sf_dir):
    return bt.blocks_sum(pnl(spark, sf_dir), 520, keep_tail=False)


@query(
    "G10_pseudo_years",
    "code:s block:i pnl:d",
    f"WITH {PNL_SQL} SELECT code, (rn - 1) // 6240 AS block, sum(pnl) AS pnl FROM pnl GROUP BY 1, 2",
)
def g10_years(spark, sf_dir):
    return bt.blocks_sum(pnl(spark, sf_dir), bt.PERIODS_PER_YEAR, keep_tail=True)
