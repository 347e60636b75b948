"""Registered queries of the holding-period gate on the weekly desk book."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import feasibility as fe, joins, portfolio as pf, signals as sg
from factorloom.plans.catalog_eval import DRAWS, boot_sql
from factorloom.plans.catalog_portfolio import ANNUAL, BOOK_SQL, COST, TOP
from factorloom.plans.catalog_signals import winsor_ctes
from factorloom.plans.registry import query
from factorloom.sources.market import desks, stored

HORIZONS = (1, 3, 5)
SIGNALS = ["MOM_20", "REV_5", "LOW_VOL_20"]
FOLDS, BLOCK, SEED = 5, 6, 17




def _ranked(source: str, keys: str, x: str = "x", y: str = "value") -> str:
    return (
        f"SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0 AS rx,"
        f" rank() OVER (PARTITION BY {keys} ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2.0 AS ry FROM {source}"
    )


_SHARPE = f"CASE WHEN stddev_pop({{x}}) > 1e-12 THEN avg({{x}}) / stddev_pop({{x}}) * sqrt({ANNUAL}) ELSE 0 END"
_YEARLY = f"exp(sum(ln(1 + {{x}})) * {ANNUAL} / count({{x}})) - 1"
_SIGN = "CASE WHEN {x} > 1e-12 THEN 1 WHEN {x} < -1e-12 THEN -1 ELSE 0 END"

GO_SQL = f"""{BOOK_SQL.replace('(VALUES (1), (3)) h(h)', '(VALUES (1), (3), (5)) h(h)').replace('range(1, 4) r(k)', 'range(1, 6) r(k)')},
lp AS (SELECT max(p) + 1 AS n FROM cal),
bk AS (SELECT book.*, cal.date, book.position * {FOLDS} // lp.n AS fold FROM book JOIN cal ON cal.p = book.position, lp WHERE book.position * {FOLDS} // lp.n >= 1),
fx0 AS (SELECT *, ln(close / lag(close) OVER c) AS r_1d, ln(close / lag(close, 20) OVER c) AS MOM_20, -ln(close / lag(close, 5) OVER c) AS REV_5
  FROM dk WINDOW c AS (PARTITION BY code ORDER BY date)),
fx1 AS (SELECT *, CASE WHEN count(r_1d) OVER w = 20 THEN -stddev_pop(r_1d) OVER w END AS LOW_VOL_20 FROM fx0
  WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
{winsor_ctes('fx1', SIGNALS, 'fr')},
fx AS (SELECT fr.code, fr.date, fr.industry, cal.p, cal.p * {FOLDS} // lp.n AS fold, MOM_20, REV_5, LOW_VOL_20,
  (MOM_20_rank + REV_5_rank + LOW_VOL_20_rank) / 3 AS simple_ensemble FROM fr JOIN cal USING (date), lp),
lv AS (SELECT a.code, a.p, h.h, ln(c.open / b.open) AS value FROM px a JOIN px b ON b.code = a.code AND b.p = a.p + 1
  JOIN (VALUES (1), (3), (5)) h(h) ON true JOIN px c ON c.code = a.code AND c.p = a.p + 1 + h.h),
jn AS (SELECT fx.*, lv.h, lv.value FROM fx JOIN lv USING (code, p) WHERE fold >= 1),
eq AS (SELECT *, exp(sum(ln(1 + net_return)) OVER w) AS equity FROM bk WINDOW w AS (PARTITION BY horizon, phase ORDER BY position)),
fl AS (SELECT *, 1 - equity / max(equity) OVER (PARTITION BY horizon, phase ORDER BY position) AS fall FROM eq),
pm AS (SELECT horizon, phase, {_SHARPE.format(x='net_return')} AS sharpe, {_YEARLY.format(x='net_return')} AS annual, max(fall) AS fall FROM fl GROUP BY 1, 2),
hm AS (SELECT horizon, median(sharpe) AS ms, median(annual) AS ma, median(fall) AS md, min(sharpe) AS ws FROM pm GROUP BY 1),
h1 AS (SELECT ms AS bs, ma AS ba, md AS bd FROM hm WHERE horizon = 1),
ho AS (SELECT hm.*, h1.*, CAST(sign(ms - bs) AS INTEGER) AS os, (SELECT count(*) FILTER (({_SIGN.format(x='(pm.sharpe - bs)')}) = ({_SIGN.format(x='(ms - bs)')})) FROM pm WHERE pm.horizon = hm.horizon) AS pa
  FROM hm, h1 WHERE horizon > 1),
si AS ({' UNION ALL '.join(f"SELECT '{s}' AS signal, h, fold, date, code, industry, {s} AS x, value FROM jn WHERE {s} IS NOT NULL AND value IS NOT NULL" for s in (*SIGNALS, 'simple_ensemble'))}),
sr AS ({_ranked('si', 'signal, h, date')}),
sd AS (SELECT signal, h, fold, date, corr(rx, ry) AS ic FROM sr GROUP BY ALL HAVING count(*) >= 10),
sg AS (SELECT a.signal, a.h, a.ic - b.ic AS delta FROM (SELECT signal, h, avg(ic) AS ic FROM sd GROUP BY 1, 2) a
  JOIN (SELECT signal, h, avg(ic) AS ic FROM sd GROUP BY 1, 2) b ON b.signal = a.signal AND b.h = 1 WHERE a.h > 1),
mf AS (SELECT horizon, fold, position, median(net_return) AS r FROM bk GROUP BY 1, 2, 3),
fm AS (SELECT a.horizon, a.fold, {_YEARLY.format(x='a.r')} - ({_YEARLY.format(x='b.r')}) AS gain FROM mf a JOIN mf b ON b.position = a.position AND b.horizon = 1
  WHERE a.horizon > 1 GROUP BY 1, 2 HAVING count(*) >= 2),
ff AS (SELECT h, fold, avg(ic) AS ic FROM sd WHERE signal = 'simple_ensemble' GROUP BY 1, 2),
fa AS (SELECT fm.horizon, count(*) FILTER (sign(gain) = os AND sign(a.ic - b.ic) = os AND os <> 0) AS fa FROM fm JOIN ff a ON a.h = fm.horizon AND a.fold = fm.fold
  JOIN ff b ON b.h = 1 AND b.fold = fm.fold JOIN ho ON ho.horizon = fm.horizon GROUP BY 1),
sa AS (SELECT h AS horizon, count(*) FILTER (sign(delta) = os AND os <> 0) AS sa FROM sg JOIN ho ON ho.horizon = sg.h WHERE signal <> 'simple_ensemble' GROUP BY 1),
agreed AS (SELECT horizon, os, pa, coalesce(fa, 0) AS fa, coalesce(sa, 0) AS sa FROM ho LEFT JOIN fa USING (horizon) LEFT JOIN sa USING (horizon))"""


def book_and_rows(spark, sf_dir):
    """The daily book of horizons 1, 3 and 5 and the joined signals and labels, on out-of-fold dates (all folds but the first)."""
    bars = stored(desks(spark, sf_dir))
    calendar = stored(joins.number_calendar(bars))
    size = calendar.agg(F.max("position") + 1).scalar()
    fold = F.floor(F.col("position") * FOLDS / size).cast("int")
    opens = bars.select("date", "code", F.pow("open", F.lit(0.05)).alias("open"))
    signals = stored(sg.stock_signals(bars))
    daily = pf.daily_book(pf.stock_day_ledger(signals, calendar, "REV_5", TOP, HORIZONS, COST, opens))
    book = daily.join(calendar, "position").withColumn("fold", fold).where("fold >= 1")
    features = sg.winsor_rank(signals, SIGNALS).withColumn("simple_ensemble", sg.ensemble([f"{n}_rank" for n in SIGNALS]))
    features = features.select("date", "code", "industry", *SIGNALS, "simple_ensemble").join(calendar, "date").withColumn("fold", fold).where("fold >= 1")
    prices = opens.join(calendar, "date").select("code", "position", "open")
    entry = prices.select("code", (F.col("position") - 1).alias("position"), F.col("open").alias("_in"))
    leave = prices.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
    leave = leave.select("code", "horizon", (F.col("position") - 1 - F.col("horizon")).alias("position"), F.col("open").alias("_out"))
    labels = entry.join(leave, ["code", "position"]).select("code", "position", "horizon", F.log(F.col("_out") / F.col("_in")).alias("value"))
    return stored(book), stored(features.join(labels, ["code", "position"]))


@query("V24_horizon_agreement", "horizon:i overall_sign:i phases_agreeing:i folds_agreeing:i signals_agreeing:i",
       f"WITH {GO_SQL} SELECT horizon, os AS overall_sign, pa AS phases_agreeing, fa AS folds_agreeing, sa AS signals_agreeing FROM agreed")
def v24(spark, sf_dir):
    return fe.agreement(*book_and_rows(spark, sf_dir), SIGNALS, "simple_ensemble", ANNUAL)


ROBUST_SQL = f"""{GO_SQL},
fd AS (SELECT horizon, position, date, median(net_return) AS r FROM bk GROUP BY 1, 2, 3 HAVING count(*) = horizon),
yd AS (SELECT a.horizon, a.date, a.r, b.r AS b FROM fd a JOIN fd b ON b.position = a.position AND b.horizon = 1 WHERE a.horizon > 1),
yr AS (SELECT horizon, y, {_SHARPE.format(x='r')} - ({_SHARPE.format(x='b')}) AS delta FROM yd, (SELECT DISTINCT year(date) AS y FROM yd) WHERE year(date) <> y
  GROUP BY 1, 2 HAVING count(*) >= 40),
en AS (SELECT * FROM si WHERE signal = 'simple_ensemble'),
ov AS (SELECT h, delta AS overall FROM sg WHERE signal = 'simple_ensemble'),
gi AS (SELECT en.*, g.g FROM en, (SELECT DISTINCT industry AS g FROM en) g WHERE industry <> g),
gr AS ({_ranked('gi', 'g, h, date')}),
gd AS (SELECT g, h, avg(ic) AS ic FROM (SELECT g, h, date, corr(rx, ry) AS ic FROM gr GROUP BY 1, 2, 3 HAVING count(*) >= 10) GROUP BY 1, 2),
cb AS (SELECT h, code, avg(x * value) AS c FROM en WHERE h > 1 GROUP BY 1, 2),
tp5 AS (SELECT h AS ch, code FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY c DESC, code) AS i, count(*) OVER (PARTITION BY h) AS k FROM cb) WHERE i <= ceil(0.05 * k)),
ki AS (SELECT en.*, c.ch FROM en JOIN (VALUES (3), (5)) c(ch) ON h = ch OR h = 1 WHERE NOT EXISTS (SELECT 1 FROM tp5 WHERE tp5.ch = c.ch AND tp5.code = en.code)),
kr AS ({_ranked('ki', 'ch, h, date')}),
kd AS (SELECT ch, h, avg(ic) AS ic FROM (SELECT ch, h, date, corr(rx, ry) AS ic FROM kr GROUP BY 1, 2, 3 HAVING count(*) >= 10) GROUP BY 1, 2),
conc AS (SELECT yr.horizon, 'year' AS kind, CAST(y AS VARCHAR) AS dropped, delta, NULL AS overall, os = 0 OR sign(delta) = os AS agrees FROM yr JOIN ho ON ho.horizon = yr.horizon
  UNION ALL SELECT a.h, 'industry', a.g, a.ic - b.ic, overall, sign(overall) = 0 OR sign(a.ic - b.ic) = sign(overall) FROM gd a JOIN gd b ON b.g = a.g AND b.h = 1 JOIN ov ON ov.h = a.h WHERE a.h > 1
  UNION ALL SELECT a.h, 'stock', 'top5pct', a.ic - b.ic, overall, os = 0 OR sign(a.ic - b.ic) = os OR abs(a.ic - b.ic) < 1e-12 FROM kd a JOIN kd b ON b.ch = a.ch AND b.h = 1
    JOIN ov ON ov.h = a.h JOIN ho ON ho.horizon = a.h WHERE a.h = a.ch),
cq AS (SELECT horizon, count(*) FILTER (kind = 'year') AS y, count(*) FILTER (kind = 'year' AND agrees) AS ya, count(*) FILTER (kind = 'industry') AS g,
  count(*) FILTER (kind = 'industry' AND NOT agrees) AS gf, count(*) FILTER (kind = 'stock' AND NOT agrees) AS sf FROM conc GROUP BY 1),
rob AS (SELECT horizon, y >= 2 AND ya >= least(2, greatest(1, y - 1)) AS year_ok, gf = 0 OR gf / greatest(g, 1) < 0.5 AS industry_ok, sf = 0 AS stock_ok FROM cq)"""


@query("V22_concentration", "horizon:i kind:s dropped:s delta:d overall:d agrees:b", f"WITH {ROBUST_SQL} SELECT * FROM conc")
def v22(spark, sf_dir):
    book, rows = book_and_rows(spark, sf_dir)
    return fe.concentration(book, rows.where("simple_ensemble IS NOT NULL"), "simple_ensemble", "industry", ANNUAL)


_NAMES = [(h, p, f"h{h}_{p}") for h in HORIZONS for p in range(h)]
_MIDDLE = {h: f"list_sort([{', '.join(_SHARPE.format(x=n) for k, _, n in _NAMES if k == h)}])[{h // 2 + 1}]" for h in (3, 5)}
GATE_SQL = f"""{ROBUST_SQL},
wd AS (SELECT position AS spot, {', '.join(f"max(net_return) FILTER (horizon = {h} AND phase = {p}) AS {n}" for h, p, n in _NAMES)} FROM bk GROUP BY 1),
se AS (SELECT *, row_number() OVER (ORDER BY spot) - 1 AS position FROM wd WHERE {' AND '.join(f'{n} IS NOT NULL' for _, _, n in _NAMES)}),
{boot_sql('se', BLOCK, DRAWS, SEED)},
st AS (SELECT draw, {_MIDDLE[3]} - ({_SHARPE.format(x='h1_0')}) AS s3, {_MIDDLE[5]} - ({_SHARPE.format(x='h1_0')}) AS s5 FROM draws JOIN se USING (position) WHERE slot < n GROUP BY draw),
bt AS (SELECT 3 AS horizon, quantile_cont(s3, 0.025) AS ci_low, (1 + count(*) FILTER (s3 <= 0)) / (1 + count(*)) AS p FROM st
  UNION ALL SELECT 5, quantile_cont(s5, 0.025), (1 + count(*) FILTER (s5 <= 0)) / (1 + count(*)) FROM st),
hl AS (SELECT horizon, ci_low, max(raw) OVER (ORDER BY p, horizon) < 0.05 AS reject FROM (SELECT *, least(1.0, p * (2 - row_number() OVER (ORDER BY p, horizon) + 1)) AS raw FROM bt)),
ck AS (SELECT ho.horizon, [CASE WHEN NOT ms - bs >= 0.15 THEN 'sharpe_improvement' END, CASE WHEN NOT ma - ba >= 0.02 THEN 'annualized_improvement' END,
  CASE WHEN NOT ci_low > 0 THEN 'bootstrap_ci_lower_positive' END, CASE WHEN NOT reject THEN 'holm_family' END,
  CASE WHEN agreed.pa < CASE ho.horizon WHEN 3 THEN 2 ELSE 3 END THEN 'phase_direction' END, CASE WHEN ws < bs - 0.25 THEN 'worst_phase_floor' END,
  CASE WHEN fa < 3 THEN 'fold_direction' END, CASE WHEN md > bd * 1.2 + 1e-12 THEN 'drawdown_bound' END, CASE WHEN sa < 2 THEN 'signal_direction' END,
  CASE WHEN NOT (year_ok AND industry_ok AND stock_ok) THEN 'not_single_year_or_group' END] AS c
  FROM ho JOIN agreed USING (horizon) JOIN rob USING (horizon) JOIN hl USING (horizon)),
dc AS (SELECT horizon, list_filter(c, lambda x: x IS NOT NULL) AS f FROM ck),
cc AS (SELECT bool_or(horizon = 3 AND len(f) = 0) AS a, bool_or(horizon = 5 AND len(f) = 0) AS b FROM dc)"""


@query(
    "V25_horizon_gate",
    "horizon:i passed:b n_passed:i failed:s conclusion:s status:s",
    f"""WITH {GATE_SQL} SELECT horizon, len(f) = 0 AS passed, 10 - len(f) AS n_passed, array_to_string(f, ';') AS failed,
      CASE WHEN a AND b THEN 'HORIZON_FEASIBLE_BOTH' WHEN a THEN 'HORIZON_FEASIBLE_3D' WHEN b THEN 'HORIZON_FEASIBLE_5D' ELSE 'KEEP_1D_BASELINE' END AS conclusion,
      CASE WHEN a OR b THEN 'RESEARCH_GATE_PASSED' ELSE 'KEEP_1D_BASELINE' END AS status FROM dc, cc""",
)
def v25(spark, sf_dir):
    book, rows = book_and_rows(spark, sf_dir)
    robust = fe.concentration_ok(fe.concentration(book, rows.where("simple_ensemble IS NOT NULL"), "simple_ensemble", "industry", ANNUAL))
    boot = fe.phase_bootstrap(book, HORIZONS[1:], ANNUAL, BLOCK, DRAWS, SEED)
    decided = stored(fe.gate(fe.horizon_metrics(book, ANNUAL), fe.agreement(book, rows, SIGNALS, "simple_ensemble", ANNUAL), robust, boot))
    end = fe.classify(decided)
    return decided.withColumn("conclusion", end.select("conclusion").scalar()).withColumn("status", end.select("status").scalar())
