"""Registered queries of signals, leave-one-out statistics, labels and splits (X, L, F65-F67)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorloom.functions import scalar
from factorloom.functions.series import Series
from factorloom.operators import joins, labels as lb, panel as pn, signals as sg
from factorloom.plans.catalog_panel import MASK_SQL, TRADABLE_SQL, masked, tradable
from factorloom.plans.registry import DESKS_SQL, MEMBERS_SQL, PANEL_SQL, WEEKLY_SQL, query
from factorloom.plans.research import PNL_SQL, pnl
from factorloom.sources.market import desks, membership, panel, stored

D = sg.PANEL


# -- shared relations ------------------------------------------------------------------
def rank_sql(x: str, by: str = "date", source_count: str | None = None) -> str:
    """Average-tie rank pct of x within ``by``; NULLs stay NULL."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"
    )


def winsor_ctes(source: str, names: list[str], out: str) -> str:
    bounds = ", ".join(
        f"quantile_cont({n}, 0.01) OVER (PARTITION BY date) AS lo_{n}, quantile_cont({n}, 0.99) OVER (PARTITION BY date) AS hi_{n}"
        for n in names
    )
    clips = ", ".join(
        f"CASE WHEN {n} IS NOT NULL THEN greatest(least({n}, hi_{n}), lo_{n}) END AS c_{n}" for n in names
    )
    ranks = ", ".join(f"{rank_sql(f'c_{n}')} AS {n}_rank" for n in names)
    return f"""{out}_b AS (SELECT *, {bounds} FROM {source}), {out}_c AS (SELECT *, {clips} FROM {out}_b),
{out} AS (SELECT *, {ranks} FROM {out}_c)"""


SIGNALS_SQL = f"""{PANEL_SQL}, s0 AS (SELECT *, ln(close / lag(close) OVER c) AS r_1d, ln(close / lag(close, 20) OVER c) AS MOM_20,
  -ln(close / lag(close, 5) OVER c) AS REV_5 FROM panel WINDOW c AS (PARTITION BY code ORDER BY date)),
s1 AS (SELECT *, CASE WHEN count(r_1d) OVER w = 20 THEN -stddev_pop(r_1d) OVER w END AS LOW_VOL_20,
  CASE WHEN count(amount) OVER w = 20 THEN median(amount) OVER w END AS median_amount_20 FROM s0
  WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
LOO_SQL = f"""{SIGNALS_SQL}, mk AS (SELECT date, avg(r_1d) AS market_return_1d,
    avg(CASE WHEN r_1d > 0 THEN 1.0 WHEN r_1d IS NOT NULL THEN 0.0 END) AS market_breadth FROM s1 GROUP BY date),
mv AS (SELECT *, CASE WHEN count(market_return_1d) OVER w = 20 THEN stddev_pop(market_return_1d) OVER w END AS market_volatility_20
  FROM mk WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
pairs AS (SELECT a.date, a.code, count(b.r_1d) AS n, avg(b.r_1d) AS m, stddev_pop(b.r_1d) AS sd,
    avg(CASE WHEN b.r_1d > 0 THEN 1.0 WHEN b.r_1d IS NOT NULL THEN 0.0 END) AS br, avg(b.MOM_20) AS mom
  FROM s1 a LEFT JOIN s1 b ON b.date = a.date AND b.industry = a.industry AND b.code <> a.code GROUP BY 1, 2),
ctx AS (SELECT s1.*, mv.market_return_1d, mv.market_breadth, mv.market_volatility_20, p.n AS industry_member_count_loo,
  p.m AS industry_return_1d_loo, p.br AS industry_breadth_loo, CASE WHEN p.n >= 2 THEN p.sd END AS industry_dispersion_1d_loo,
  p.mom AS industry_mom, p.m - mv.market_return_1d AS industry_relative_market_1d, s1.r_1d - p.m AS stock_residual_1d
  FROM s1 JOIN mv USING (date) JOIN pairs p ON p.date = s1.date AND p.code = s1.code)"""


def stock_panel(spark, sf_dir):
    return sg.stock_signals(panel(spark, sf_dir))


def context(spark, sf_dir):
    return sg.industry_context(sg.market_context(stored(stock_panel(spark, sf_dir))))


_BASIC = ["MOM_20", "REV_5", "LOW_VOL_20"]


@query(
    "X1_X12_winsor_rank_ensemble",
    "code:i date:t MOM_20_rank:d REV_5_rank:d LOW_VOL_20_rank:d simple_ensemble:d valid_signal:b",
    f"""WITH {SIGNALS_SQL}, {winsor_ctes('s1', _BASIC, 'rk')} SELECT *, (MOM_20_rank + REV_5_rank + LOW_VOL_20_rank) / 3 AS simple_ensemble,
      MOM_20_rank + REV_5_rank + LOW_VOL_20_rank IS NOT NULL AS valid_signal FROM rk""",
)
def x1(spark, sf_dir):
    df = sg.winsor_rank(stock_panel(spark, sf_dir), _BASIC)
    df = df.withColumn("simple_ensemble", sg.ensemble([f"{n}_rank" for n in _BASIC]))
    return df.withColumn("valid_signal", F.col("simple_ensemble").isNotNull())


@query(
    "X2_X4_stock_signals",
    "code:i date:t r_1d:d MOM_20:d REV_5:d LOW_VOL_20:d median_amount_20:c",
    f"WITH {SIGNALS_SQL} SELECT * FROM s1",
)
def x2(spark, sf_dir):
    return stock_panel(spark, sf_dir)


@query(
    "X5_X6_market_context",
    "code:i date:t market_return_1d:d market_breadth:d market_volatility_20:d",
    f"WITH {LOO_SQL} SELECT * FROM ctx",
)
@query(
    "X7_X8_industry_leave_one_out",
    "code:i date:t industry_member_count_loo:i industry_return_1d_loo:d industry_breadth_loo:d "
    "industry_relative_market_1d:d stock_residual_1d:d",
    f"WITH {LOO_SQL} SELECT * FROM ctx",
)
def x7(spark, sf_dir):
    return context(spark, sf_dir)


@query(
    "X9_X10_leave_one_out_moments",
    "code:i date:t n:i mean:d std:d crowded:d",
    f"""WITH {SIGNALS_SQL} SELECT a.code, a.date, count(b.MOM_20) AS n, avg(b.MOM_20) AS mean,
      CASE WHEN count(b.MOM_20) >= 2 THEN stddev_pop(b.MOM_20) END AS std,
      avg(CASE WHEN b.MOM_20 IS NULL THEN NULL WHEN b.volume < 60 THEN 1.0 ELSE 0.0 END) AS crowded
    FROM s1 a LEFT JOIN s1 b ON a.date = b.date AND a.industry = b.industry AND a.code <> b.code GROUP BY 1, 2""",
)
def x9(spark, sf_dir):
    wg = Window.partitionBy("date", "industry")
    stats = sg.loo(F.col("MOM_20"), wg)
    crowded = sg.loo_fraction(F.col("volume") < 60, F.col("MOM_20").isNotNull(), wg)
    return stock_panel(spark, sf_dir).select(
        "code", "date", stats["count"].alias("n"), stats["mean"].alias("mean"), stats["std"].alias("std"), crowded.alias("crowded")
    )


_CAND = [
    "market_residual_momentum_20", "industry_loo_residual_momentum_20", "stock_residual_volatility_20", "industry_breadth_loo",
    "industry_dispersion_1d_loo", "tradability_crowding_loo", "index_weight_change_pct", "membership_age_days",
]
CAND_SQL = f"""{TRADABLE_SQL}, {MEMBERS_SQL}, bars0 AS (SELECT *, ln(close / lag(close) OVER c) AS r_1d, ln(close / lag(close, 20) OVER c) AS MOM_20
    FROM tradable WINDOW c AS (PARTITION BY code ORDER BY date)),
  sp0 AS (SELECT *, CASE WHEN date_diff('day', lag(date) OVER c, date) > 400 THEN 1 ELSE 0 END AS nw FROM members
    WINDOW c AS (PARTITION BY code ORDER BY date)),
  sp AS (SELECT *, sum(nw) OVER (PARTITION BY code ORDER BY date) AS spell_id FROM sp0),
  spe AS (SELECT *, min(date) OVER (PARTITION BY code, spell_id) AS entry FROM sp),
  mp AS (SELECT m.date, m.code, m.weight_pct, m.entry, b.industry, b.r_1d, b.MOM_20, NOT (b.can_buy_open AND b.can_sell_open) AS blocked
    FROM spe m JOIN bars0 b ON b.date = m.date AND b.code = m.code),
  pr AS (SELECT a.date, a.code, avg(b.r_1d) FILTER (b.industry = a.industry) AS ind_r,
    CASE WHEN count(b.r_1d) FILTER (b.industry = a.industry) >= 2 THEN stddev_pop(b.r_1d) FILTER (b.industry = a.industry) END AS disp,
    avg(b.MOM_20) AS mkt_mom, avg(b.MOM_20) FILTER (b.industry = a.industry) AS ind_mom,
    avg(CASE WHEN b.r_1d > 0 THEN 1.0 WHEN b.r_1d IS NOT NULL THEN 0.0 END) FILTER (b.industry = a.industry) AS br,
    avg(CASE WHEN b.blocked THEN 1.0 ELSE 0.0 END) FILTER (b.industry = a.industry) AS crowd
    FROM mp a LEFT JOIN mp b ON a.date = b.date AND a.code <> b.code GROUP BY 1, 2),
  q AS (SELECT mp.*, pr.* EXCLUDE (date, code), mp.r_1d - pr.ind_r AS res FROM mp JOIN pr ON pr.date = mp.date AND pr.code = mp.code)
  SELECT code, date, MOM_20 - mkt_mom AS market_residual_momentum_20, MOM_20 - ind_mom AS industry_loo_residual_momentum_20,
    CASE WHEN count(res) OVER w = 20 THEN stddev_pop(res) OVER w END AS stock_residual_volatility_20, br AS industry_breadth_loo,
    disp AS industry_dispersion_1d_loo, crowd AS tradability_crowding_loo, weight_pct - CASE WHEN date = entry THEN 0.0
      ELSE lag(weight_pct) OVER (PARTITION BY code ORDER BY date) END AS index_weight_change_pct,
    date_diff('day', entry, date) AS membership_age_days FROM q
  WINDOW w AS (PARTITION BY code, entry, industry ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


@query("X11_candidate_features", "code:i date:t " + " ".join(f"{n}:d" for n in _CAND), f"WITH {CAND_SQL}")
def x11(spark, sf_dir):
    bars = stored(sg.stock_signals(tradable(spark, sf_dir)).withColumn("has_quote", F.lit(True)))
    spelled = pn.with_spells(membership(bars.select("date", "code", "amount")), gap_days=400)
    members = stored(spelled.join(bars, ["date", "code"]))
    return sg.candidate_features(sg.industry_context(sg.market_context(members)))


# -- residual signals on the dense weekly grid -----------------------------------------
GRID_SQL = f"""{DESKS_SQL.replace('panel AS (', 'weekly AS (', 1)}, {MEMBERS_SQL.replace('FROM panel', 'FROM weekly').replace('<= 60', '<= 30')},
ind AS (SELECT code, any_value(industry) AS industry FROM weekly GROUP BY code),
grid AS (SELECT d.date, c.code, c.industry, w.close, w.amount, m.code IS NOT NULL AS is_member FROM (SELECT DISTINCT date FROM weekly) d
  CROSS JOIN ind c LEFT JOIN weekly w ON w.date = d.date AND w.code = c.code LEFT JOIN members m ON m.date = d.date AND m.code = c.code),
ret AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER c > 0 THEN ln(close / lag(close) OVER c) END AS r_1d FROM grid
  WINDOW c AS (PARTITION BY code ORDER BY date)),
mr AS (SELECT *, CASE WHEN is_member THEN r_1d END AS mem_r FROM ret),
gp AS (SELECT a.date, a.code, count(b.mem_r) FILTER (b.industry = a.industry) AS n, avg(b.mem_r) FILTER (b.industry = a.industry) AS m,
  avg(b.mem_r) AS mk FROM mr a LEFT JOIN mr b ON a.date = b.date AND a.code <> b.code AND b.mem_r IS NOT NULL GROUP BY 1, 2),
eps AS (SELECT mr.*, gp.n, gp.m, gp.mk, CASE WHEN n >= 5 THEN mem_r - m END AS epsilon,
  mem_r - CASE WHEN n >= 5 THEN m ELSE n / 5.0 * coalesce(m, 0) + (1 - n / 5.0) * mk END AS shrink
  FROM mr JOIN gp ON gp.date = mr.date AND gp.code = mr.code)"""


def member_grid(spark, sf_dir, size=30):
    """Weekly sessions x desks with returns between quoted neighbouring sessions and membership of the ``size`` largest."""
    weekly = stored(desks(spark, sf_dir))
    members = membership(weekly, size).select("date", "code", F.lit(True).alias("is_member"))
    industry = weekly.groupBy("code").agg(F.first("industry").alias("industry"))
    grid = joins.dense_grid(weekly, "week").join(industry, "code")
    grid = grid.join(weekly.select("date", "code", "close", "amount"), ["date", "code"], "left")
    grid = grid.join(members, ["date", "code"], "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))
    return grid.withColumn("r_1d", scalar.safe_log_return(F.col("close"), D.lag("close", 1)))


@query(
    "X13_industry_residual",
    "code:i date:t epsilon:d",
    f"WITH {GRID_SQL} SELECT code, date, epsilon FROM eps",
)
def x13(spark, sf_dir):
    return sg.industry_residual(member_grid(spark, sf_dir))


_SLOW = ["IDIO_LOW_VOL_60", "RES_MOM_120_20", "RES_TREND_EFF_60_5"]
# a wider membership for the long windows: with 30 members few codes stay long enough for the minimum counts
WIDE = 36
WIDE_SQL = GRID_SQL.replace("<= 30", f"<= {WIDE}")
SLOW_SQL = f"""{WIDE_SQL}, slow AS (SELECT *, CASE WHEN count(epsilon) OVER v >= 54 THEN -stddev_pop(epsilon) OVER v END AS IDIO_LOW_VOL_60,
  CASE WHEN count(epsilon) OVER m >= 90 THEN 100.0 / count(epsilon) OVER m * sum(epsilon) OVER m END AS RES_MOM_120_20,
  CASE WHEN count(epsilon) OVER t >= 50 THEN sum(epsilon) OVER t / (sum(abs(epsilon)) OVER t + 1e-12) END AS RES_TREND_EFF_60_5
  FROM eps WINDOW v AS (PARTITION BY code ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
    m AS (PARTITION BY code ORDER BY date ROWS BETWEEN 119 PRECEDING AND 20 PRECEDING),
    t AS (PARTITION BY code ORDER BY date ROWS BETWEEN 59 PRECEDING AND 5 PRECEDING))"""


def slow_panel(spark, sf_dir):
    return sg.slow_signals(sg.industry_residual(member_grid(spark, sf_dir, WIDE)))


@query(
    "X14_X16_slow_residual_signals",
    "code:i date:t " + " ".join(f"{n}:d" for n in _SLOW),
    f"WITH {SLOW_SQL} SELECT * FROM slow",
)
def x14(spark, sf_dir):
    return slow_panel(spark, sf_dir)


@query(
    "X17_slow_residual_ensemble",
    "code:i date:t slow_residual_ensemble:d",
    f"""WITH {SLOW_SQL}, {winsor_ctes('slow', _SLOW, 'rk')} SELECT code, date, ({' + '.join(f'{n}_rank' for n in _SLOW)}) / 3
      AS slow_residual_ensemble FROM rk""",
)
def x17(spark, sf_dir):
    df = sg.winsor_rank(slow_panel(spark, sf_dir), _SLOW)
    return df.withColumn("slow_residual_ensemble", sg.ensemble([f"{n}_rank" for n in _SLOW]))


@query(
    "X18_shrunk_residual",
    "code:i date:t peer_count:i strict:d shrink:d",
    f"WITH {GRID_SQL} SELECT code, date, n AS peer_count, epsilon AS strict, shrink FROM eps",
)
def x18(spark, sf_dir):
    grid = member_grid(spark, sf_dir)
    return sg.shrunk_residual(grid.withColumn("r_1d", F.when(F.col("is_member"), F.col("r_1d"))))


def _scenario_sql(name: str) -> str:
    x, vol, vol_min, mom, skip, mom_min, tr, tskip, tmin = sg.SCENARIOS[name]
    x = {"strict": "epsilon", "shrink": "shrink"}[x]
    return f"""SELECT '{name}' AS scenario, code, date, CASE WHEN count({x}) OVER v >= {vol_min} THEN -stddev_pop({x}) OVER v END AS low_vol,
      CASE WHEN count({x}) OVER m >= {mom_min} THEN sum({x}) OVER m * {mom - skip} / count({x}) OVER m END AS momentum,
      CASE WHEN count({x}) OVER t >= {tmin} THEN sum({x}) OVER t / (sum(abs({x})) OVER t + 1e-12) END AS efficiency FROM eps
      WINDOW v AS (PARTITION BY code ORDER BY date ROWS BETWEEN {vol - 1} PRECEDING AND CURRENT ROW),
        m AS (PARTITION BY code ORDER BY date ROWS BETWEEN {mom - 1} PRECEDING AND {skip} PRECEDING),
        t AS (PARTITION BY code ORDER BY date ROWS BETWEEN {tr - 1} PRECEDING AND {tskip} PRECEDING)"""


@query(
    "X19_scenario_signals",
    "scenario:s code:i date:t low_vol:d momentum:d efficiency:d",
    f"WITH {WIDE_SQL} {' UNION ALL '.join(_scenario_sql(n) for n in sg.SCENARIOS)}",
)
def x19(spark, sf_dir):
    grid = member_grid(spark, sf_dir, WIDE)
    masked_grid = grid.withColumn("r_1d", F.when(F.col("is_member"), F.col("r_1d")))
    base = stored(sg.shrunk_residual(masked_grid).select("code", "date", "strict", "shrink"))
    out = None
    for name in sg.SCENARIOS:
        part = sg.scenario_signals(base, name).select(F.lit(name).alias("scenario"), "code", "date", "low_vol", "momentum", "efficiency")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "X20_reference_only_universe",
    "code:i date:t peer_count:i shrink:d low_vol_20:d",
    f"""WITH {MASK_SQL}, gp AS (SELECT a.date, a.code, count(b.r_1d) FILTER (b.industry = a.industry) AS n, avg(b.r_1d) FILTER (b.industry = a.industry)
        AS m, avg(b.r_1d) AS mk FROM masked a LEFT JOIN masked b ON a.date = b.date AND a.code <> b.code GROUP BY 1, 2),
    e AS (SELECT k.code, k.date, gp.n, CASE WHEN k.industry IS NOT NULL THEN k.r_1d - CASE WHEN n >= 5 THEN m ELSE n / 5.0 * coalesce(m, 0)
        + (1 - n / 5.0) * mk END END AS shrink, k.industry FROM masked k JOIN gp ON gp.date = k.date AND gp.code = k.code)
    SELECT code, date, CASE WHEN industry IS NOT NULL THEN n END AS peer_count, shrink,
      CASE WHEN count(shrink) OVER w >= 18 THEN -stddev_pop(shrink) OVER w END AS low_vol_20 FROM e WHERE code % 2 = 0
    WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def x20(spark, sf_dir):
    """References use the extended pool after masking; only original codes are returned."""
    full = sg.shrunk_residual(masked(spark, sf_dir))
    target = full.where(F.col("code") % 2 == 0)
    frame = D.last(20)
    enough = F.count("shrink").over(frame) >= 18
    return target.withColumn("low_vol_20", F.when(enough, -F.stddev_pop("shrink").over(frame)))


@query(
    "X22_X23_midrank_and_rank_mean",
    "code:i date:t mid:d mean_rank:d",
    f"""WITH {SIGNALS_SQL} SELECT code, date, CASE WHEN close IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY close)
      + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0 - 0.5) / count(close) OVER (PARTITION BY date) - 0.5 END AS mid,
      ({rank_sql('close')} + {rank_sql('volume')}) / 2 AS mean_rank FROM s1""",
)
def x22(spark, sf_dir):
    wd = Window.partitionBy("date")
    df = stock_panel(spark, sf_dir).withColumns(
        {n: sg.rank_pct(F.col(x), wd) for n, x in (("_a", "close"), ("_b", "volume"))}
    )
    return df.withColumns({"mid": sg.midrank(F.col("close"), wd), "mean_rank": sg.ensemble(["_a", "_b"])})


# -- panel features --------------------------------------------------------------------
RUN_SQL = f"""{WEEKLY_SQL}, cal AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM weekly)),
rn0 AS (SELECT w.*, p - row_number() OVER (PARTITION BY code ORDER BY date) AS run FROM weekly w JOIN cal USING (date)),
rn1 AS (SELECT *, row_number() OVER (PARTITION BY code, run ORDER BY date) AS rr FROM rn0)"""


@query(
    "F65_contiguous_run_features",
    "code:i date:t run_row:i dev5:d ready:b",
    f"""WITH {RUN_SQL} SELECT code, date, rr AS run_row, (close - sum(close) OVER w / 5) / (sum(close) OVER w / 5 + 1e-9) AS dev5, rr > 12 AS ready
    FROM rn1 WINDOW w AS (PARTITION BY code, run ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def f65(spark, sf_dir):
    """Padded windows inside unbroken runs; the first rows of a run are not ready."""
    weekly = stored(panel(spark, sf_dir, "week"))
    df = pn.contiguous_runs(weekly, joins.number_calendar(weekly))
    s = Series(keys=("code", "run"), order="date", at=("date",))
    mean = s.pmean("close", 5)
    return df.withColumns({"dev5": (F.col("close") - mean) / (mean + 1e-9), "ready": F.col("run_row") > 12})


@query(
    "F66_F67_member_cross_section",
    "code:i date:t rank:d demean:d zscore:d",
    f"""WITH {SIGNALS_SQL}, {MEMBERS_SQL}, v AS (SELECT s.code, s.date, CASE WHEN m.code IS NOT NULL THEN REV_5 END AS x FROM s1 s
      LEFT JOIN members m ON m.date = s.date AND m.code = s.code)
    SELECT code, date, CASE WHEN count(x) OVER d >= 2 THEN {rank_sql('x')} END AS rank, x - avg(x) OVER d AS demean,
      CASE WHEN count(x) OVER d >= 2 AND stddev_pop(x) OVER d >= 1e-12 THEN (x - avg(x) OVER d) / stddev_pop(x) OVER d END AS zscore
    FROM v WINDOW d AS (PARTITION BY date)""",
)
def f66(spark, sf_dir):
    df = stored(stock_panel(spark, sf_dir))
    members = membership(df.select("date", "code", "amount")).select("date", "code", F.lit(True).alias("m"))
    df = df.join(members, ["date", "code"], "left").withColumn("x", F.when(F.col("m"), F.col("REV_5")))
    wd, x = Window.partitionBy("date"), F.col("x")
    return df.select(
        "code", "date", sg.member_rank(x, wd).alias("rank"), sg.member_demean(x, wd).alias("demean"),
        sg.member_zscore(x, wd).alias("zscore"),
    )


# -- labels ----------------------------------------------------------------------------
LABEL_SQL = f"""{TRADABLE_SQL}, {MEMBERS_SQL}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM (SELECT DISTINCT date FROM tradable)),
lb0 AS (SELECT m.date, m.code, t.industry, h.horizon, e.date AS entry_date, x.date AS exit_date FROM members m
  JOIN tradable t ON t.date = m.date AND t.code = m.code JOIN cal ON cal.date = m.date CROSS JOIN (VALUES (1), (3), (5)) h(horizon)
  LEFT JOIN cal x ON x.p = cal.p + 1 + h.horizon LEFT JOIN cal e ON e.p = cal.p + 1 AND x.date IS NOT NULL),
lb1 AS (SELECT b.*, e.open AS entry_open_tr, x.open AS exit_open_tr, CASE WHEN e.open > 0 AND x.open > 0 THEN ln(x.open / e.open) END
    AS gross_log_return, NOT coalesce(e.open > 0 AND e.can_buy_open, false) AS entry_blocked,
    NOT coalesce(x.open > 0 AND x.can_sell_open, false) AS exit_blocked
  FROM lb0 b LEFT JOIN tradable e ON e.date = b.entry_date AND e.code = b.code LEFT JOIN tradable x ON x.date = b.exit_date AND x.code = b.code),
lb AS (SELECT *, CASE WHEN NOT entry_blocked AND NOT exit_blocked THEN gross_log_return END AS executable_log_return FROM lb1),
ex AS (SELECT a.date, a.code, a.horizon, avg(b.gross_log_return) AS peers FROM lb a LEFT JOIN lb b ON a.date = b.date AND a.horizon = b.horizon
  AND a.industry = b.industry AND a.code <> b.code GROUP BY 1, 2, 3),
long AS (SELECT lb.date, lb.code, lb.horizon, k.label_type, CASE k.label_type WHEN 'ABSOLUTE' THEN gross_log_return WHEN 'MARKET_EXCESS' THEN
    gross_log_return - avg(gross_log_return) OVER (PARTITION BY lb.date, lb.horizon, k.label_type) ELSE gross_log_return - ex.peers END AS value
  FROM lb JOIN ex ON ex.date = lb.date AND ex.code = lb.code AND ex.horizon = lb.horizon
  CROSS JOIN (VALUES ('ABSOLUTE'), ('MARKET_EXCESS'), ('INDUSTRY_EXCESS')) k(label_type))"""


def member_labels(spark, sf_dir):
    rows = stored(tradable(spark, sf_dir).select("date", "code", "industry", "open", "amount", "can_buy_open", "can_sell_open"))
    members = membership(rows.select("date", "code", "amount")).select("date", "code")
    members = members.join(rows.select("date", "code", "industry"), ["date", "code"])
    prices = rows.select("date", "code", F.col("open").alias("open_tr"))
    return lb.horizon_labels(members, prices, rows, rows)


@query(
    "L2_horizon_labels",
    "code:i date:t horizon:i entry_date:t exit_date:t gross_log_return:d executable_log_return:d entry_blocked:b exit_blocked:b",
    f"WITH {LABEL_SQL} SELECT * FROM lb",
)
def l2(spark, sf_dir):
    return member_labels(spark, sf_dir)


@query(
    "L3_G13_excess_labels",
    "code:i date:t horizon:i label_type:s value:d",
    f"WITH {LABEL_SQL} SELECT * FROM long",
)
def l3(spark, sf_dir):
    return lb.excess_labels(member_labels(spark, sf_dir))


@query(
    "L11_panel_target",
    "code:i date:t target_ret:d",
    f"""WITH {LABEL_SQL} SELECT t.code, t.date, l.value AS target_ret FROM tradable t LEFT JOIN long l ON l.date = t.date AND l.code = t.code
      AND l.horizon = 1 AND l.label_type = 'ABSOLUTE'""",
)
def l11(spark, sf_dir):
    return lb.panel_target(lb.excess_labels(member_labels(spark, sf_dir)), panel(spark, sf_dir))


@query(
    "J10_feature_label_join",
    "horizon:i label_type:s n:i mean_product:d",
    f"""WITH {LABEL_SQL} SELECT horizon, label_type, count(*) AS n, avg(t.close * l.value) AS mean_product FROM long l
      JOIN tradable t ON t.date = l.date AND t.code = l.code GROUP BY 1, 2""",
)
def j10(spark, sf_dir):
    long = lb.excess_labels(member_labels(spark, sf_dir)).withColumnRenamed("date", "signal_date")
    features = panel(spark, sf_dir).select(F.col("date").alias("signal_date"), "code", "close")
    return features.join(long, ["signal_date", "code"]).groupBy("horizon", "label_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("close") * F.col("value")).alias("mean_product")
    )


# -- splits ----------------------------------------------------------------------------
_WF = """fold, CASE WHEN rn - 1 < first + fold * (size + 20) THEN 'train' WHEN rn - 1 >= first + fold * (size + 20) + 20
    AND rn - 1 < first + fold * (size + 20) + 20 + size THEN 'validation' END AS role"""
FOLD_SQL = f"""{PNL_SQL}, fb AS (SELECT *, (bars - 2 - 80) // 5 AS size, bars - 2 - 4 * ((bars - 2 - 80) // 5 + 20) AS first FROM pnl),
folds AS (SELECT fb.*, {_WF} FROM fb, range(4) f(fold))"""


@query(
    "L4_walk_forward_folds",
    "code:s fold:i role:s n:i first_ts:t last_ts:t",
    f"WITH {FOLD_SQL} SELECT code, fold, role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM folds WHERE role IS NOT NULL GROUP BY ALL",
)
def l4(spark, sf_dir):
    df = lb.walk_forward(pnl(spark, sf_dir)).where(F.col("role").isNotNull())
    return df.groupBy("code", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def split_sql(source: str, out: str, share=0.4, hold=104, years=2, purge=6, embargo=2) -> str:
    return f"""{out}_c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS n, max(date) OVER () AS last
    FROM (SELECT DISTINCT date FROM {source})),
  {out}_h AS (SELECT *, n - greatest(ceil(n * 0.1), {hold}, (SELECT count(*) FROM {out}_c WHERE date >= last - INTERVAL {years} YEAR)) AS dev FROM {out}_c),
  {out}_f AS (SELECT *, greatest({purge + 20}, floor(dev * {share})) AS first FROM {out}_h),
  {out}_s AS (SELECT *, CAST(floor((dev - first - {4 * embargo}) / 5.0) AS BIGINT) AS size FROM {out}_f),
  {out}_b AS (SELECT s.*, fold, first + fold * (size + {embargo}) AS a, CASE WHEN fold = 4 THEN dev ELSE first + fold * (size + {embargo}) + size END AS z
    FROM {out}_s s, range(5) r(fold)),
  {out} AS (SELECT date, fold, CASE WHEN p >= dev THEN 'holdout' WHEN p >= a AND p < z THEN 'validation' WHEN p >= a - {purge} AND p < a THEN 'purge'
    WHEN fold < 4 AND p >= z AND p < z + {embargo} THEN 'embargo' WHEN p < a - {purge} AND NOT EXISTS (SELECT 1 FROM {out}_b e WHERE e.date = b.date
      AND e.fold < b.fold AND e.p >= e.z AND e.p < e.z + {embargo}) THEN 'train' END AS role FROM {out}_b b)"""


def weekly_split(spark, sf_dir):
    return lb.purged_split(stored(panel(spark, sf_dir, "week").select("date").distinct()), holdout_min=104, purge=6, embargo=2)


@query(
    "L5_purged_embargoed_split",
    "date:t fold:i role:s",
    f"WITH {WEEKLY_SQL}, {split_sql('weekly', 'sp')} SELECT * FROM sp",
)
def l5(spark, sf_dir):
    return weekly_split(spark, sf_dir)


@query(
    "L7_development_guard",
    "violations:i",
    f"WITH {PANEL_SQL} SELECT count(*) AS violations FROM panel WHERE date >= DATE '2001-06-01'",
)
def l7(spark, sf_dir):
    return lb.development_violations(panel(spark, sf_dir), F.lit("2001-06-01").cast("date"))


@query(
    "L8_oof_restriction",
    "date:t folds:i kept:i dropped:i ambiguous:b",
    f"""WITH {WEEKLY_SQL}, {split_sql('weekly', 'sp')}, v AS (SELECT fold, min(date) AS a, max(date) AS b FROM sp WHERE role = 'validation' GROUP BY fold),
    k AS (SELECT w.date, w.code % 5 AS fold, w.date BETWEEN a AND b AS inside FROM weekly w JOIN v ON v.fold = w.code % 5)
    SELECT date, count(DISTINCT fold) FILTER (inside) AS folds, count(*) FILTER (inside) AS kept, count(*) FILTER (NOT inside) AS dropped,
      count(DISTINCT fold) FILTER (inside) > 1 AS ambiguous FROM k GROUP BY date""",
)
def l8(spark, sf_dir):
    validation = weekly_split(spark, sf_dir).where(F.col("role") == "validation")
    ranges = validation.groupBy("fold").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    rows = panel(spark, sf_dir, "week").withColumn("fold", (F.col("code") % 5).cast("int"))
    return lb.one_fold_per_date(rows, ranges)


@query(
    "L9_causal_alignment",
    "code:s n:i last_ts:t",
    f"WITH {PNL_SQL} SELECT code, count(*) AS n, max(ts) AS last_ts FROM pnl WHERE rn <= bars - 5 GROUP BY code",
)
def l9(spark, sf_dir):
    return lb.drop_tail(pnl(spark, sf_dir), 5).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@query(
    "L10_nested_folds",
    "outer_fold:i inner_fold:i n_dates:i clashes:i",
    f"""WITH {WEEKLY_SQL}, {split_sql('weekly', 'sp')}, inn AS (SELECT date, fold AS outer_fold, row_number() OVER (PARTITION BY fold ORDER BY date) - 1 AS p,
      count(*) OVER (PARTITION BY fold) AS n FROM sp WHERE role = 'train'),
    iv AS (SELECT date, outer_fold, p * 4 // n AS inner_fold FROM inn WHERE p * 4 // n > 0)
    SELECT outer_fold, inner_fold, count(*) AS n_dates, count(*) FILTER (em.first < outer_fold) AS clashes
    FROM iv LEFT JOIN (SELECT date, min(fold) AS first FROM sp WHERE role = 'embargo' GROUP BY 1) em USING (date) GROUP BY 1, 2""",
)
def l10(spark, sf_dir):
    """Inner validation quarters of every outer training set never hit a session that an earlier fold embargoes."""
    outer = stored(weekly_split(spark, sf_dir))
    fold = Window.partitionBy("fold")
    place = F.row_number().over(fold.orderBy("date")) - 1
    train = outer.where(F.col("role") == "train").withColumns({"position": place, "total": F.count(F.lit(1)).over(fold)})
    inner = train.select(
        "date", F.col("fold").alias("outer_fold"), F.floor(F.col("position") * 4 / F.col("total")).alias("fold"), F.lit("validation").alias("role")
    ).where(F.col("fold") > 0)
    return lb.nested_violations(inner, outer)


@query(
    "G6_C18_coverage_by_fold",
    "fold:i cause:s n:i share:d",
    f"""WITH {GRID_SQL}, {split_sql('weekly', 'sp')}, c AS (SELECT sp.fold, CASE WHEN e.code % 10 = 3 THEN 'missing_industry' WHEN r_1d IS NULL THEN 'missing_return'
      WHEN n < 5 THEN 'fewer_than_5_peers' ELSE 'valid' END AS cause FROM eps e JOIN sp ON sp.date = e.date AND sp.role = 'validation' WHERE is_member)
    SELECT fold, cause, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY fold) AS share FROM c GROUP BY 1, 2""",
)
def g6(spark, sf_dir):
    grid = member_grid(spark, sf_dir)
    grid = sg.shrunk_residual(grid.withColumn("r_1d", F.when(F.col("is_member"), F.col("r_1d")))).where("is_member")
    folds = weekly_split(spark, sf_dir).where(F.col("role") == "validation").select("date", "fold")
    industry = F.when(F.col("code") % 10 != 3, F.col("industry"))
    cause = scalar.coverage_cause(industry, F.col("r_1d"), F.col("peer_count")).alias("cause")
    counts = grid.join(folds, "date").groupBy("fold", cause).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("fold")))
