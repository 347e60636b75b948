"""Shared plans: ticks -> bars -> momentum factor -> P&L."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.series import Series
from factorloom.operators.backtest import pnl_table
from factorloom.plans.formula import evaluate
from factorloom.plans.registry import BARS_SQL
from factorloom.sources.market import bars_hourly

S = Series()
MOMENTUM = ["mom", "TS_ZSCORE_10", "CS_NEUTRALIZE"]


def with_momentum(bars: DataFrame, s: Series = S) -> DataFrame:
    back = s.lag("close", 5)
    return bars.withColumn("mom", F.coalesce(F.log(F.col("close") / (back + 1e-9)), F.lit(0.0)))


def factor_table(spark, sf_dir, tokens=MOMENTUM, bars: DataFrame | None = None) -> DataFrame:
    bars = bars_hourly(spark, sf_dir) if bars is None else bars
    return evaluate(with_momentum(bars), tokens, S, leaves=["mom"], normalise=False)


def pnl(spark, sf_dir) -> DataFrame:
    return pnl_table(factor_table(spark, sf_dir).select("code", "ts", "open", "factor"), S)


FACTOR_SQL = f"""{BARS_SQL}, mom AS (
  SELECT *, coalesce(ln(close / (lag(close, 5) OVER c + 1e-9)), 0.0) AS mom FROM bars
  WINDOW c AS (PARTITION BY code ORDER BY ts)),
moml AS (
  SELECT *, list_concat(list_resize(CAST([] AS DOUBLE[]), greatest(10 - rn, 0), 0.0), list(mom) OVER
    (PARTITION BY code ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS l FROM mom),
z AS (
  SELECT *, CASE WHEN list_aggregate(l, 'var_pop') < 1e-18 THEN 0.0
    ELSE (mom - list_sum(l) / 10) / (sqrt(list_aggregate(l, 'var_pop')) + 1e-9) END AS z FROM moml),
factors AS (
  SELECT code, ts, rn, open, close, volume, CASE WHEN count(*) OVER (PARTITION BY ts) = 1 THEN z
    ELSE z - avg(z) OVER (PARTITION BY ts) END AS factor FROM z)"""
PNL_SQL = f"""{FACTOR_SQL},
pos AS (
  SELECT *, CASE WHEN abs(tanh(factor)) >= 0.05 THEN tanh(factor) ELSE 0.0 END AS pos,
    coalesce(ln(lead(open, 2) OVER c / lead(open, 1) OVER c), 0.0) AS ret,
    count(*) OVER (PARTITION BY code) AS bars FROM factors WINDOW c AS (PARTITION BY code ORDER BY ts)),
turn AS (
  SELECT *, coalesce(lag(pos) OVER c, 0.0) AS prev, abs(pos - coalesce(lag(pos) OVER c, 0.0)) AS turnover,
    CASE WHEN pos >= 0.05 THEN 1 WHEN pos <= -0.05 THEN -1 ELSE 0 END AS dir
  FROM pos WINDOW c AS (PARTITION BY code ORDER BY ts)),
pnl AS (SELECT *, pos * ret - turnover * 0.0003 AS pnl FROM turn),
cum AS (SELECT *, sum(pnl) OVER (PARTITION BY code ORDER BY ts) AS cum FROM pnl),
dd AS (SELECT *, max(cum) OVER (PARTITION BY code ORDER BY ts) AS peak FROM cum),
port AS (SELECT ts, avg(pnl) AS pnl, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS bars
         FROM pnl GROUP BY ts)"""
