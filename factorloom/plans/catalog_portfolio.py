"""Registered queries of ranked portfolios, ledgers and allocation inputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorloom.operators import allocation as al
from factorloom.operators import joins, portfolio as pf, signals as sg
from factorloom.plans.catalog_eval import DAILY_SQL, DRAWS, boot_sql, paired
from factorloom.plans.catalog_signals import SIGNALS_SQL, stock_panel
from factorloom.plans.registry import DESKS_SQL, query
from factorloom.plans.research import PNL_SQL, pnl
from factorloom.session import checkpointed
from factorloom.sources.market import bars_hourly, desks, stored

HORIZONS = (1, 3)
TOP = 10
COST = 0.001
ANNUAL = 52

BOOK_SQL = f"""{DESKS_SQL.replace('panel AS (', 'dk AS (', 1)}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM (SELECT DISTINCT date FROM dk)),
sc AS (SELECT *, -ln(close / lag(close, 5) OVER (PARTITION BY code ORDER BY date)) AS rev FROM dk),
tp AS (SELECT * FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY rev DESC, code) AS place FROM sc WHERE rev IS NOT NULL) WHERE place <= {TOP}),
pk AS (SELECT h.h, cal.p % h.h AS phase, cal.p, tp.code, 1.0 / count(*) OVER (PARTITION BY h.h, cal.p) AS w FROM tp JOIN cal USING (date), (VALUES (1), (3)) h(h)),
px AS (SELECT dk.code, cal.p, pow(dk.open, 0.05) AS open FROM dk JOIN cal USING (date)),
mv AS (SELECT a.code, a.p, b.open / a.open - 1 AS mv FROM px a JOIN px b ON b.code = a.code AND b.p = a.p + 1),
hd AS (SELECT h, phase, pk.p + k AS p, code, w FROM pk, range(1, 4) r(k) WHERE k <= h AND pk.p + k < (SELECT max(p) FROM cal)),
gn AS (SELECT hd.*, w * coalesce(mv.mv, 0.0) AS gain FROM hd LEFT JOIN mv ON mv.code = hd.code AND mv.p = hd.p),
ch AS (SELECT h, phase, p, code, abs(sum(dw)) AS turnover FROM (SELECT h, phase, p + 1 AS p, code, w AS dw FROM pk UNION ALL
  SELECT h, phase, p + h + 1, code, -w FROM pk) WHERE p < (SELECT max(p) FROM cal) GROUP BY 1, 2, 3, 4),
ledger AS (SELECT coalesce(g.h, c.h) AS horizon, coalesce(g.phase, c.phase) AS phase, coalesce(g.p, c.p) AS position, coalesce(g.code, c.code) AS code,
  coalesce(g.w, 0.0) AS weight, coalesce(g.gain, 0.0) AS gain_return, coalesce(c.turnover, 0.0) AS turnover, coalesce(c.turnover, 0.0) * {COST} AS fee_return
  FROM gn g FULL OUTER JOIN ch c ON g.h = c.h AND g.phase = c.phase AND g.p = c.p AND g.code = c.code),
book AS (SELECT horizon, phase, position, sum(gain_return) AS gross_return, sum(gain_return) - sum(fee_return) AS net_return, sum(turnover) AS turnover,
  sum(weight) AS exposure, sum(fee_return) AS cost FROM ledger GROUP BY 1, 2, 3),
perf AS (SELECT horizon, phase, count(*) AS days, avg(net_return) / stddev_samp(net_return) * sqrt({ANNUAL}) AS sharpe,
  exp(sum(ln(1 + net_return)) * {ANNUAL} / count(*)) - 1 AS annual_return, avg(exposure) AS mean_exposure, sum(cost) AS total_cost FROM book GROUP BY 1, 2)"""


def ledger(spark, sf_dir, cost=COST, n=TOP):
    bars = stored(desks(spark, sf_dir))
    calendar = joins.number_calendar(bars)
    # the level of the unit prices jumps between lines; the damped price has returns of a few percent
    opens = bars.select("date", "code", F.pow("open", F.lit(0.05)).alias("open"))
    return pf.stock_day_ledger(sg.stock_signals(bars), calendar, "REV_5", n, HORIZONS, cost, opens)


@query(
    "B26_rebalance_schedule",
    "horizon:i phase:i position:i date:t",
    f"WITH {BOOK_SQL} SELECT h AS horizon, p % h AS phase, p AS position, date FROM cal, (VALUES (1), (3)) t(h)",
)
def b26(spark, sf_dir):
    return pf.rebalance_days(joins.number_calendar(desks(spark, sf_dir)), HORIZONS)


@query(
    "B27_top_n_ledger",
    "horizon:i phase:i position:i code:i weight:d gain_return:d turnover:d fee_return:d",
    f"WITH {BOOK_SQL} SELECT * FROM ledger",
)
def b27(spark, sf_dir):
    return ledger(spark, sf_dir)


@query(
    "B27_top_n_daily_returns",
    "horizon:i phase:i position:i gross_return:d net_return:d turnover:d exposure:d",
    f"WITH {BOOK_SQL} SELECT * FROM book",
)
def b27_daily(spark, sf_dir):
    return pf.daily_book(ledger(spark, sf_dir))


@query(
    "B28_phase_medians",
    "horizon:i median_sharpe:d median_return:d worst_sharpe:d phases:i",
    f"""WITH {BOOK_SQL} SELECT horizon, median(sharpe) AS median_sharpe, median(annual_return) AS median_return, min(sharpe) AS worst_sharpe, count(*) AS phases
    FROM perf GROUP BY 1""",
)
def b28(spark, sf_dir):
    return pf.phase_medians(pf.replay_performance(pf.daily_book(ledger(spark, sf_dir)), ["horizon", "phase"], ANNUAL))


@query(
    "B29_replay_performance",
    "horizon:i phase:i days:i sharpe:d annual_return:d mean_exposure:d total_cost:d",
    f"WITH {BOOK_SQL} SELECT * FROM perf",
)
def b29(spark, sf_dir):
    return pf.replay_performance(pf.daily_book(ledger(spark, sf_dir)), ["horizon", "phase"], ANNUAL)


@query(
    "B30_replay_comparison",
    "horizon:i phase:i sharpe_delta:d return_delta:d better:b",
    f"""WITH {BOOK_SQL}, q AS (SELECT * FROM perf), b AS (SELECT sharpe AS s, annual_return AS a FROM perf WHERE horizon = 1)
    SELECT horizon, phase, sharpe - s AS sharpe_delta, annual_return - a AS return_delta, sharpe > s AS better FROM q, b WHERE horizon = 3""",
)
def b30(spark, sf_dir):
    perf = pf.replay_performance(pf.daily_book(ledger(spark, sf_dir)), ["horizon", "phase"], ANNUAL)
    # the one-session book has a single phase; it is the baseline of every phase
    spread = F.explode(F.when(F.col("horizon") == 1, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.col("phase").cast("int"))))
    return pf.compare_replays(perf.withColumn("phase", spread), "horizon", F.col("horizon") == 1)


@query(
    "B31_ledger_attribution",
    "horizon:i code:i linked:d industry:s industry_linked:d total:d compounded:d",
    f"""WITH {BOOK_SQL}, nv AS (SELECT *, exp(coalesce(sum(ln(1 + net_return)) OVER (PARTITION BY horizon, phase ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND
      1 PRECEDING), 0)) AS nav FROM book), attr AS (SELECT l.horizon, l.code, sum((gain_return - fee_return) * nav / l.horizon) AS linked FROM ledger l JOIN nv
      ON nv.horizon = l.horizon AND nv.phase = l.phase AND nv.position = l.position GROUP BY 1, 2),
    cp AS (SELECT horizon, avg(c) AS compounded FROM (SELECT horizon, phase, exp(sum(ln(1 + net_return))) - 1 AS c FROM book GROUP BY 1, 2) GROUP BY 1),
    iy AS (SELECT code, any_value(industry) AS industry FROM dk GROUP BY 1)
    SELECT a.horizon, a.code, a.linked, iy.industry, sum(a.linked) OVER (PARTITION BY a.horizon, iy.industry) AS industry_linked,
      sum(a.linked) OVER (PARTITION BY a.horizon) AS total, cp.compounded FROM attr a JOIN iy ON iy.code = a.code JOIN cp ON cp.horizon = a.horizon""",
)
def b31(spark, sf_dir):
    """Per code and rolled up to industries; the total reconciles to the mean compounded return of the phases."""
    book = checkpointed(ledger(spark, sf_dir))
    daily = pf.daily_book(book)
    per_code = pf.linked_attribution(book, daily).groupBy("horizon", "code").agg(F.sum("linked").alias("linked"))
    compounded = daily.groupBy("horizon", "phase").agg(F.expm1(F.sum(F.log1p("net_return"))).alias("_c"))
    compounded = compounded.groupBy("horizon").agg(F.avg("_c").alias("compounded"))
    industry = desks(spark, sf_dir).groupBy("code").agg(F.first("industry").alias("industry"))
    per_code = checkpointed(per_code.join(industry, "code"))
    rolled = per_code.groupBy("horizon", "industry").agg(F.sum("linked").alias("industry_linked"))
    total = rolled.groupBy("horizon").agg(F.sum("industry_linked").alias("total"))
    same = per_code["industry"].eqNullSafe(rolled["industry"]) & (per_code["horizon"] == rolled["horizon"])
    return per_code.join(rolled, same).drop(rolled["horizon"], rolled["industry"]).join(total, "horizon").join(compounded, "horizon")


@query(
    "B32_concentration",
    "horizon:i total:d positive:d negative:d top5:d top10:d max_weight:d",
    f"""WITH {BOOK_SQL}, nv AS (SELECT *, exp(coalesce(sum(ln(1 + net_return)) OVER (PARTITION BY horizon, phase ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND
      1 PRECEDING), 0)) AS nav FROM book), attr AS (SELECT l.horizon, l.code, sum((gain_return - fee_return) * nav / l.horizon) AS v FROM ledger l JOIN nv
      ON nv.horizon = l.horizon AND nv.phase = l.phase AND nv.position = l.position GROUP BY 1, 2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY v DESC, code) AS k, (SELECT max(weight) FROM ledger l WHERE l.horizon = attr.horizon) AS mw FROM attr)
    SELECT horizon, any_value(mw) AS max_weight, sum(v) AS total, coalesce(sum(v) FILTER (v > 0), 0) AS positive, coalesce(sum(v) FILTER (v < 0), 0) AS negative,
      sum(v) FILTER (k <= 5) AS top5, sum(v) FILTER (k <= 10) AS top10 FROM rk GROUP BY 1""",
)
def b32(spark, sf_dir):
    book = checkpointed(ledger(spark, sf_dir))
    linked = pf.linked_attribution(book, pf.daily_book(book)).groupBy("horizon", "code").agg(F.sum("linked").alias("v"))
    heaviest = book.groupBy("horizon").agg(F.max("weight").alias("max_weight"))
    return pf.concentration(linked, "v", ["horizon"]).join(heaviest, "horizon")


@query(
    "B33_experiment_grid",
    "rule:s multiple:d horizon:i phase:i sharpe:d annual_return:d total_cost:d",
    f"""WITH {BOOK_SQL}, g AS (SELECT 'top10' AS rule, m.multiple, horizon, phase, position, gross_return - cost * m.multiple AS r, cost * m.multiple AS c
      FROM book, (VALUES (1.0), (1.5), (2.0)) m(multiple))
    SELECT rule, multiple, horizon, phase, avg(r) / stddev_samp(r) * sqrt({ANNUAL}) AS sharpe, exp(sum(ln(1 + r)) * {ANNUAL} / count(*)) - 1 AS annual_return,
      sum(c) AS total_cost FROM g GROUP BY 1, 2, 3, 4""",
)
def b33(spark, sf_dir):
    """Cost multiples are exploded over one daily book instead of re-running it."""
    daily = pf.daily_book(ledger(spark, sf_dir)).withColumn("multiple", F.explode(F.array(*[F.lit(m) for m in (1.0, 1.5, 2.0)])))
    daily = daily.withColumn("cost", F.col("cost") * F.col("multiple"))
    daily = daily.withColumns({"net_return": F.col("gross_return") - F.col("cost"), "rule": F.lit("top10")})
    return pf.replay_performance(daily, ["rule", "multiple", "horizon", "phase"], ANNUAL)


# -- experiment lattice ----------------------------------------------------------------
SIZES, MULTIPLES, FOLDS = (5, 10), (0.0, 1.0, 1.5, 2.0), 4
LATTICE_SQL = f"""{BOOK_SQL}, gs AS (SELECT 'REV_5' AS score, date, code, rev AS x FROM sc UNION ALL
  SELECT 'MOM_20', date, code, ln(close / lag(close, 20) OVER (PARTITION BY code ORDER BY date)) FROM dk),
gt AS (SELECT *, row_number() OVER (PARTITION BY score, date ORDER BY x DESC, code) AS place FROM gs WHERE x IS NOT NULL),
gp AS (SELECT score, n.n, h.h, cal.p % h.h AS phase, cal.p, code, 1.0 / count(*) OVER (PARTITION BY score, n.n, h.h, cal.p) AS w
  FROM gt JOIN cal USING (date) JOIN (VALUES (5), (10)) n(n) ON place <= n.n JOIN (VALUES (1), (3)) h(h) ON true),
mx AS (SELECT max(p) AS m FROM cal),
gh AS (SELECT score, n, h, phase, gp.p + k AS p, code, w FROM gp JOIN range(1, 4) r(k) ON k <= h, mx WHERE gp.p + k < m),
gg AS (SELECT score, n, h, phase, gh.p, sum(w * coalesce(mv.mv, 0.0)) AS gross, sum(w) AS exposure FROM gh LEFT JOIN mv ON mv.code = gh.code AND mv.p = gh.p GROUP BY 1, 2, 3, 4, 5),
gc AS (SELECT score, n, h, phase, p, sum(t) AS turnover FROM (SELECT score, n, h, phase, p, code, abs(sum(dw)) AS t FROM (SELECT score, n, h, phase, p + 1 AS p, code, w AS dw FROM gp
  UNION ALL SELECT score, n, h, phase, p + h + 1, code, -w FROM gp), mx WHERE p < m GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4, 5),
gd AS (SELECT score, n, h, phase, p, coalesce(gross, 0.0) AS gross, coalesce(exposure, 0.0) AS exposure, coalesce(turnover, 0.0) AS turnover
  FROM gg FULL OUTER JOIN gc USING (score, n, h, phase, p)),
gl AS (SELECT gd.*, p * {FOLDS} // (m + 1) AS fold, c.c AS multiple, turnover * {COST} * c.c AS cost, gross - turnover * {COST} * c.c AS net
  FROM gd, mx, (VALUES {', '.join(f'({m})' for m in MULTIPLES)}) c(c)),
gm AS (SELECT score, n AS size, h AS horizon, phase, fold, CAST(multiple AS DOUBLE) AS multiple, count(*) AS days,
  CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt({ANNUAL}) END AS sharpe,
  exp(sum(ln(1 + net)) * {ANNUAL} / count(*)) - 1 AS annual_return, avg(exposure) AS mean_exposure, sum(cost) AS total_cost FROM gl GROUP BY 1, 2, 3, 4, 5, 6)"""


def lattice(spark, sf_dir):
    """The stored daily book of two scores, two sizes and the schedules of horizons 1 and 3."""
    bars = stored(desks(spark, sf_dir))
    opens = bars.select("date", "code", F.pow("open", F.lit(0.05)).alias("open"))
    calendar = stored(joins.number_calendar(bars))
    return checkpointed(pf.lattice_book(sg.stock_signals(bars), calendar, ["REV_5", "MOM_20"], SIZES, HORIZONS, opens, FOLDS))


@query(
    "B33_experiment_lattice",
    "score:s size:i horizon:i phase:i fold:i multiple:d days:i sharpe:d annual_return:d mean_exposure:d total_cost:d",
    f"WITH {LATTICE_SQL} SELECT * FROM gm",
)
def b33_lattice(spark, sf_dir):
    return pf.lattice_performance(lattice(spark, sf_dir), COST, MULTIPLES, ANNUAL)


@query(
    "B30_replay_levels",
    "score:s size:i horizon:i phase:i multiple:d sharpe_delta:d return_delta:d folds_better:i folds:i",
    f"""WITH {LATTICE_SQL}, b1 AS (SELECT score, size, fold, multiple, median(sharpe) AS s, median(annual_return) AS a FROM gm WHERE horizon = 1 GROUP BY 1, 2, 3, 4)
    SELECT score, size, horizon, phase, multiple, median(sharpe - s) AS sharpe_delta, median(annual_return - a) AS return_delta, count(*) FILTER (sharpe > s) AS folds_better,
      count(*) AS folds FROM gm JOIN b1 USING (score, size, fold, multiple) WHERE horizon <> 1 GROUP BY 1, 2, 3, 4, 5""",
)
def b30_levels(spark, sf_dir):
    return pf.compare_levels(pf.lattice_performance(lattice(spark, sf_dir), COST, MULTIPLES, ANNUAL))


# -- allocation ------------------------------------------------------------------------
CAL_SQL = f"""{DAILY_SQL}, cq AS (SELECT date, code, target AS y, (rank() OVER (PARTITION BY date ORDER BY REV_5) + (count(*) OVER (PARTITION BY date, REV_5) - 1) / 2.0 - 0.5)
  / count(*) OVER (PARTITION BY date) - 0.5 AS q FROM pr),
cd AS (SELECT date, avg(q) AS q, avg(y) AS y, avg(q * q) AS qq, avg(q * y) AS qy FROM cq GROUP BY date)"""
_SLOPE = "greatest(0, (avg(qy) - avg(q) * avg(y)) / greatest(avg(qq) - avg(q) * avg(q), 1e-12))"


@query(
    "A1_calibrator",
    "intercept:d slope:d",
    f"WITH {CAL_SQL} SELECT avg(y) - {_SLOPE} * avg(q) AS intercept, {_SLOPE} AS slope FROM cd",
)
def a1(spark, sf_dir):
    return al.coefficients(al.calibration_days(paired(spark, sf_dir), "REV_5", "target"))


COV_SQL = f"""{CAL_SQL}, se AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS position FROM cd), {boot_sql('se', 20, DRAWS, 20260917)},
cf AS (SELECT draw, avg(y) - {_SLOPE} * avg(q) AS i, {_SLOPE} AS s FROM draws JOIN se USING (position) WHERE slot < n GROUP BY draw),
cv AS (SELECT var_samp(i) AS var_intercept, covar_samp(i, s) AS cov, var_samp(s) AS var_slope, quantile_cont(s, 0.05) AS slope_q05 FROM cf)"""


@query("A2_calibrator_covariance", "var_intercept:d cov:d var_slope:d slope_q05:d", f"WITH {COV_SQL} SELECT * FROM cv")
def a2(spark, sf_dir):
    return al.coefficient_covariance(al.calibration_days(paired(spark, sf_dir), "REV_5", "target"), draws=DRAWS)


@query(
    "A3_expected_return",
    "date:t code:i expected_return:d standard_error:d",
    f"""WITH {COV_SQL}, ab AS (SELECT avg(y) - {_SLOPE} * avg(q) AS a, {_SLOPE} AS b FROM cd)
    SELECT date, code, a + b * q AS expected_return, sqrt(greatest(var_intercept + 2 * q * cov + q * q * var_slope, 0)) AS standard_error FROM cq, ab, cv""",
)
def a3(spark, sf_dir):
    rows = paired(spark, sf_dir)
    days = checkpointed(al.calibration_days(rows, "REV_5", "target"))
    line, cov = al.coefficients(days), al.coefficient_covariance(days, draws=DRAWS)
    values = [cov.select(c).scalar() for c in ("var_intercept", "cov", "var_slope")]
    q = sg.midrank(F.col("REV_5"), Window.partitionBy("date"))
    parts = al.expected_return(F.col("q"), line.select("intercept").scalar(), line.select("slope").scalar(), tuple(values))
    return rows.withColumn("q", q).withColumns(parts)


LW_SQL = f"""{DESKS_SQL}, wk AS (SELECT code, date, ln(close / lag(close) OVER (PARTITION BY code ORDER BY date)) AS r, row_number() OVER (PARTITION BY code ORDER BY date) AS k,
  (SELECT count(DISTINCT date) FROM panel) AS m FROM panel), lr AS (SELECT code, (k - 2) // 4 AS period, sum(r) AS r FROM wk WHERE k >= 2 AND (k - 2) // 4 < (m - 1) // 4 GROUP BY 1, 2),
x AS (SELECT period, code, r - avg(r) OVER (PARTITION BY code) AS x FROM lr WHERE code IN (SELECT code FROM lr GROUP BY code HAVING count(*) = (SELECT count(DISTINCT period) FROM lr))),
sz AS (SELECT count(DISTINCT period)::DOUBLE AS n, count(DISTINCT code)::DOUBLE AS p FROM x),
s AS (SELECT l.code AS a, r.code AS b, sum(l.x * r.x) / any_value(n) AS s FROM x l JOIN x r ON l.period = r.period, sz GROUP BY 1, 2),
st AS (SELECT sum(s * s) AS d, sum(s) FILTER (a = b) AS t, (SELECT sum(q * q) FROM (SELECT sum(x * x) AS q FROM x GROUP BY period)) AS bs FROM s),
pr2 AS (SELECT t / p AS mu, (d - 2 * (t / p) * t + p * (t / p) * (t / p)) / p AS delta, (bs / n - d) / (p * n) AS beta FROM st, sz)"""


@query(
    "A4_shrunk_covariance",
    "a:i b:i covariance:d shrinkage:d",
    f"""WITH {LW_SQL} SELECT a, b, (1 - least(beta, delta) / delta) * s + CASE WHEN a = b THEN least(beta, delta) / delta * mu ELSE 0 END AS covariance,
      least(beta, delta) / delta AS shrinkage FROM s, pr2""",
)
def a4(spark, sf_dir):
    """Non-overlapping four-week returns of the desks over all complete periods."""
    bars = desks(spark, sf_dir).withColumns(
        {"r": sg.safe_log_return(F.col("close"), sg.PANEL.lag("close", 1)), "k": sg.PANEL.position()}
    )
    weeks = bars.agg(F.countDistinct("date")).scalar()
    rows = bars.where((F.col("k") >= 2) & (F.floor((F.col("k") - 2) / 4) < F.floor((weeks - 1) / 4)))
    periods = rows.groupBy("code", F.floor((F.col("k") - 2) / 4).alias("period")).agg(F.sum("r").alias("r"))
    return al.shrunk_covariance(checkpointed(periods), blocks=4)


@query(
    "A5_trade_costs",
    "horizon:i phase:i position:i proportional:d minimum_extra:d",
    f"""WITH {BOOK_SQL}, d AS (SELECT h, phase, p, code, sum(dw) AS dw FROM (SELECT h, phase, p + 1 AS p, code, w AS dw FROM pk UNION ALL SELECT h, phase, p + h + 1, code, -w FROM pk)
      GROUP BY 1, 2, 3, 4) SELECT h AS horizon, phase, p AS position, sum(CASE WHEN dw > 0 THEN dw * 0.00076 ELSE -dw * 0.00126 END) AS proportional,
      sum(CASE WHEN abs(dw) > 1e-10 THEN greatest(0, 0.00005 - abs(dw) * 0.00025) ELSE 0 END) AS minimum_extra FROM d GROUP BY 1, 2, 3""",
)
def a5(spark, sf_dir):
    bars = stored(desks(spark, sf_dir))
    days = pf.rebalance_days(joins.number_calendar(bars), HORIZONS)
    ranked = pf.top_n(sg.stock_signals(bars).where(F.col("REV_5").isNotNull()), "REV_5", TOP).select("date", "code")
    count = F.count(F.lit(1)).over(Window.partitionBy("horizon", "phase", "position"))
    picks = ranked.join(days, "date").withColumn("w", 1.0 / count)
    keys = ["horizon", "phase", "position", "code"]
    inn = picks.select("horizon", "phase", (F.col("position") + 1).alias("position"), "code", F.col("w").alias("dw"))
    out = picks.select("horizon", "phase", (F.col("position") + F.col("horizon") + 1).alias("position"), "code", (-F.col("w")).alias("dw"))
    delta = inn.unionByName(out).groupBy(*keys).agg(F.sum("dw").alias("dw"))
    parts = al.trade_cost(F.col("dw"), account=100_000.0)
    return delta.withColumns(parts).groupBy("horizon", "phase", "position").agg(
        F.sum("proportional").alias("proportional"), F.sum("minimum_extra").alias("minimum_extra")
    )


@query(
    "A6_capacity_flags",
    "code:i date:t status:s upper:d lower:d",
    f"""WITH {SIGNALS_SQL}, m AS (SELECT *, CASE WHEN count(amount) OVER w = 20 THEN avg(amount) OVER w END AS mean_amount, code % 7 / 100.0 AS cur, code % 5 / 50.0 AS tgt
      FROM s1 WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT code, date, CASE WHEN tgt > cur + 1e-9 AND (median_amount_20 IS NULL OR mean_amount IS NULL) THEN 'LIQUIDITY_INFORMATION_MISSING'
      WHEN tgt > cur + 1e-9 AND median_amount_20 < 250000 THEN 'BLOCKED_LIQUIDITY' ELSE 'OK' END AS status,
      CASE WHEN median_amount_20 IS NULL OR median_amount_20 < 250000 OR mean_amount IS NULL THEN cur ELSE cur + 0.01 * mean_amount / 1000000 END AS upper,
      greatest(0, CASE WHEN mean_amount IS NULL THEN 0 ELSE cur - 0.01 * mean_amount / 1000000 END) AS lower FROM m""",
)
def a6(spark, sf_dir):
    frame = sg.PANEL.last(20)
    df = stock_panel(spark, sf_dir).withColumns(
        {
            "mean_amount": F.when(F.count("amount").over(frame) == 20, F.avg("amount").over(frame)),
            "cur": F.col("code") % 7 / 100.0,
            "tgt": F.col("code") % 5 / 50.0,
        }
    )
    return df.withColumns(al.capacity(F.col("tgt"), F.col("cur"), F.col("median_amount_20"), F.col("mean_amount"), 1_000_000.0, 250_000.0))


@query(
    "A7_reference_weights",
    "code:i date:t inverse_volatility:d equal:d",
    f"""WITH {SIGNALS_SQL}, v AS (SELECT code, date, LOW_VOL_20 * LOW_VOL_20 AS var FROM s1)
    SELECT code, date, CASE WHEN var > 0 THEN 0.9 / sqrt(var) / sum(CASE WHEN var > 0 THEN 1 / sqrt(var) END) OVER (PARTITION BY date) END AS inverse_volatility,
      CASE WHEN var > 0 THEN 0.9 / count(CASE WHEN var > 0 THEN 1 END) OVER (PARTITION BY date) END AS equal FROM v""",
)
def a7(spark, sf_dir):
    df = stock_panel(spark, sf_dir).withColumn("var", F.col("LOW_VOL_20") * F.col("LOW_VOL_20"))
    return df.withColumns(al.reference_weights(F.col("var"), 0.9, ["date"]))


@query(
    "A8_volatility_parity",
    "code:s atr:d signal:d expected:d ratio:d alert:s",
    f"""WITH {PNL_SQL}, b AS (SELECT p.code, p.rn, p.bars, p.pos, b.high - b.low AS hl, p.pnl FROM pnl p JOIN bars b ON b.code = p.code AND b.ts = p.ts),
    a AS (SELECT code, avg(hl) FILTER (rn > bars - 14) AS atr, max(pos) FILTER (rn = bars) AS signal, avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(6240) AS sh FROM b GROUP BY 1),
    w AS (SELECT *, 0.01 * length(code) AS held, CASE WHEN sh <= 0 THEN 0.5 ELSE greatest(0.5, least(1.5, sqrt(sh / 2))) END AS wt FROM a),
    e AS (SELECT *, CASE WHEN abs(signal) > 0 THEN abs(signal) * wt * (SELECT 0.01 * atr * 100 FROM w WHERE code = 'click') / (atr * 100) ELSE 0 END AS expected FROM w),
    r AS (SELECT *, CASE WHEN expected > 0 THEN held / expected ELSE 0 END AS ratio FROM e)
    SELECT code, atr, signal, expected, ratio, CASE WHEN expected > 0 AND ratio > 1.35 THEN 'ABOVE_EXPECTED' WHEN expected = 0 AND held > 0 THEN 'HELD_WHILE_FLAT' END AS alert FROM r""",
)
def a8(spark, sf_dir):
    from factorloom.operators.backtest import sharpe

    money = pnl(spark, sf_dir).join(bars_hourly(spark, sf_dir).select("code", "ts", "high", "low"), ["code", "ts"])
    recent = F.col("rn") > F.col("bars") - 14
    per = money.groupBy("code").agg(
        F.avg(F.when(recent, F.col("high") - F.col("low"))).alias("atr"),
        F.max(F.when(F.col("rn") == F.col("bars"), F.col("pos"))).alias("signal"),
        sharpe().alias("sh"),
    ).withColumn("held", 0.01 * F.length("code"))
    return al.volatility_parity(per, F.col("code") == "click", F.lit(100.0), al.sharpe_weight(F.col("sh"), 2.0))
