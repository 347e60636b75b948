"""Registered queries of the evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorloom.functions.series import Series
from factorloom.operators import controls, evaluate as ev
from factorloom.operators import joins, labels as lb, signals as sg
from factorloom.operators.backtest import sharpe
from factorloom.operators.ranks import quantile_table, value_table
from factorloom.plans.catalog_backtest import STRATEGIES, STRATEGY_SQL, strategy_pnl
from factorloom.plans.catalog_signals import FOLD_SQL, SIGNALS_SQL, rank_sql, stock_panel
from factorloom.plans.registry import BARS_SQL, query
from factorloom.plans.research import pnl
from factorloom.session import checkpointed
from factorloom.sources.market import bars_hourly, panel, stored

NAMES = [f"s_{n}" for n in STRATEGIES]

CANDIDATES_SQL = f"""{STRATEGY_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY strategy, code ORDER BY ts) AS rn,
  count(*) OVER (PARTITION BY strategy, code) AS bars FROM spn),
cand AS (SELECT * FROM numbered WHERE rn <= bars - 2)"""


def candidates(spark, sf_dir):
    """(strategy, code, ts) rows with factor and target; the last two rows have no label."""
    return lb.drop_tail(strategy_pnl(spark, sf_dir), 2)


def stored_candidates(spark, sf_dir, more=()):
    """The candidate rows with their lineage cut: several statistics read them."""
    return checkpointed(candidates(spark, sf_dir).select("strategy", "code", "ts", "factor", "pos", "ret", "turnover", "pnl", *more))


def _wide(rows):
    return rows.groupBy("code", "ts").agg(*[F.max(F.when(F.col("strategy") == n, F.col("factor"))).alias(n) for n in NAMES])


IC_SQL = f"""{CANDIDATES_SQL}, rk AS (SELECT *, rank() OVER (PARTITION BY strategy, code ORDER BY factor)
    + (count(*) OVER (PARTITION BY strategy, code, factor) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY strategy, code ORDER BY ret)
    + (count(*) OVER (PARTITION BY strategy, code, ret) - 1) / 2.0 AS ry FROM cand),
ics AS (SELECT strategy, code, count(*) AS n, corr(factor, ret) AS ic, corr(rx, ry) AS rank_ic FROM rk GROUP BY 1, 2)"""


@query("V1_series_ic", "strategy:s code:s n:i ic:d rank_ic:d", f"WITH {IC_SQL} SELECT * FROM ics")
def v1(spark, sf_dir):
    return ev.series_ic(candidates(spark, sf_dir), ["strategy", "code"], "factor", "ret")


@query(
    "V2_ic_stability",
    "strategy:s ic:d rank_ic:d ir:d stability:d",
    f"""WITH {IC_SQL} SELECT strategy, avg(ic) AS ic, avg(rank_ic) AS rank_ic, avg(ic) / (stddev_pop(ic) + 1e-10) AS ir,
      greatest(least(avg(ic) / (stddev_pop(ic) + 1e-6), 3), -3) AS stability FROM ics GROUP BY 1""",
)
def v2(spark, sf_dir):
    return ev.mean_ic(ev.series_ic(candidates(spark, sf_dir), ["strategy", "code"], "factor", "ret"), ["strategy"])


DAILY_SQL = f"""{SIGNALS_SQL}, tg AS (SELECT *, lead(r_1d) OVER (PARTITION BY code ORDER BY date) AS target FROM s1),
pr AS (SELECT * FROM tg WHERE REV_5 IS NOT NULL AND MOM_20 IS NOT NULL AND target IS NOT NULL),
dr AS (SELECT *, {rank_sql('REV_5')} AS r_old, {rank_sql('MOM_20')} AS r_new, {rank_sql('target')} AS r_t FROM pr),
daily AS (SELECT date, count(*) AS n, corr(REV_5, target) AS ic, corr(r_old, r_t) AS rank_ic, corr(r_new, r_t) AS new_ic FROM dr
  GROUP BY date HAVING count(*) >= 10)"""


def paired(spark, sf_dir):
    """Rows with both signals and the next month's return."""
    df = stock_panel(spark, sf_dir).withColumn("target", sg.PANEL.lead("r_1d", 1))
    return df.dropna(subset=["REV_5", "MOM_20", "target"]).select("date", "code", "industry", "REV_5", "MOM_20", "target", "amount")


def daily_ic(spark, sf_dir):
    rows = stored(paired(spark, sf_dir))
    old = ev.cross_section_ic(rows, "REV_5", "target")
    new = ev.cross_section_ic(rows, "MOM_20", "target").select("date", F.col("rank_ic").alias("new_ic"))
    return old.join(new, "date")


@query(
    "V3_daily_rank_ic",
    "dates:i rank_ic:d rank_icir:d positive_rate:d",
    f"""WITH {DAILY_SQL} SELECT count(*) AS dates, avg(rank_ic) AS rank_ic, avg(rank_ic) / stddev_samp(rank_ic) AS rank_icir,
      avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0 END) AS positive_rate FROM daily""",
)
def v3(spark, sf_dir):
    return ev.ic_summary(ev.cross_section_ic(paired(spark, sf_dir), "REV_5", "target"))


@query("V3_daily_series", "date:t n:i ic:d rank_ic:d new_ic:d", f"WITH {DAILY_SQL} SELECT * FROM daily")
def v3_daily(spark, sf_dir):
    return daily_ic(spark, sf_dir)


@query(
    "V4_period_ic",
    "strategy:s code:s block:i n:i ic:d",
    f"""WITH {CANDIDATES_SQL}, b AS (SELECT *, greatest(20, least(252, bars // 8)) AS w FROM cand),
    p AS (SELECT *, (rn - 1) // w AS block FROM b) SELECT strategy, code, block, count(*) AS n, corr(factor, ret) AS ic FROM p
    WHERE (block + 1) * w <= bars GROUP BY 1, 2, 3""",
)
def v4(spark, sf_dir):
    df = candidates(spark, sf_dir).withColumn("block", ev.period_block(F.col("rn"), F.col("bars")))
    return df.where(F.col("block").isNotNull()).groupBy("strategy", "code", "block").agg(
        F.count(F.lit(1)).alias("n"), ev.guarded_corr("factor", "ret").alias("ic")
    )


def _mi_sql(source: str, by: str) -> str:
    """Bins from list quantiles; everything per group of ``by``."""
    return f"""nb AS (SELECT {by}, greatest(5, least(20, CAST(floor(sqrt(count(*))) AS INTEGER))) AS k, list_sort(list(factor)) AS lx, list_sort(list(ret)) AS ly,
      count(*) AS n FROM {source} GROUP BY {by}),
    ed AS (SELECT *, list_transform(range(k + 1), lambda i: i * (n - 1)::DOUBLE / k) AS h FROM nb),
    ed2 AS (SELECT {by}, n, list_distinct(list_transform(h, lambda q: lx[CAST(floor(q + 1e-12) AS BIGINT) + 1] + greatest(q - floor(q + 1e-12), 0)
        * (lx[least(CAST(floor(q + 1e-12) AS BIGINT) + 2, n)] - lx[CAST(floor(q + 1e-12) AS BIGINT) + 1]))) AS ux,
      list_distinct(list_transform(h, lambda q: ly[CAST(floor(q + 1e-12) AS BIGINT) + 1] + greatest(q - floor(q + 1e-12), 0)
        * (ly[least(CAST(floor(q + 1e-12) AS BIGINT) + 2, n)] - ly[CAST(floor(q + 1e-12) AS BIGINT) + 1]))) AS uy FROM ed),
    ed3 AS (SELECT {by}, n, list_slice(list_sort(ux), 2, len(ux) - 1) AS ex, list_slice(list_sort(uy), 2, len(uy) - 1) AS ey FROM ed2),
    bn AS (SELECT s.{by}, e.n, len(list_filter(ex, lambda q: q <= s.factor)) AS bx, len(list_filter(ey, lambda q: q <= s.ret)) AS byy
      FROM {source} s JOIN ed3 e ON e.{by} = s.{by}),
    jt AS (SELECT {by}, bx, byy, count(*)::DOUBLE / any_value(n) AS p FROM bn GROUP BY 1, 2, 3),
    mg AS (SELECT *, sum(p) OVER (PARTITION BY {by}, bx) AS px, sum(p) OVER (PARTITION BY {by}, byy) AS py FROM jt),
    mi AS (SELECT {by}, greatest(sum(p * ln(p / (px * py))), 0) AS mi FROM mg GROUP BY 1)"""


@query(
    "V5_mutual_information",
    "strategy:s mi:d",
    f"WITH {CANDIDATES_SQL}, {_mi_sql('cand', 'strategy')} SELECT * FROM mi",
)
def v5(spark, sf_dir):
    return ev.mutual_information(stored_candidates(spark, sf_dir), ["strategy"], "factor", "ret")


@query(
    "V6_V19_degeneracy_coverage",
    "strategy:s degenerate:b coverage:d dead_share:d",
    f"""WITH {CANDIDATES_SQL} SELECT strategy, count(factor) < 2 OR stddev_pop(factor) < 1e-8 AS degenerate, count(factor) / count(*) AS coverage,
      avg(CASE WHEN pos = 0 THEN 1.0 ELSE 0 END) AS dead_share FROM cand GROUP BY 1""",
)
def v6(spark, sf_dir):
    return candidates(spark, sf_dir).groupBy("strategy").agg(
        ev.degeneracy("factor").alias("degenerate"),
        (F.count("factor") / F.count(F.lit(1))).alias("coverage"),
        F.avg((F.col("pos") == 0).cast("double")).alias("dead_share"),
    )


CORR_SQL = f"""{CANDIDATES_SQL}, cm AS (SELECT a.strategy AS a, b.strategy AS b, abs(corr(a.factor, b.factor)) AS corr FROM cand a
  JOIN cand b ON a.code = b.code AND a.ts = b.ts AND a.strategy < b.strategy GROUP BY 1, 2)"""


@query("V7_correlation_matrix", "a:s b:s corr:d", f"WITH {CORR_SQL} SELECT * FROM cm")
def v7(spark, sf_dir):
    return ev.correlation_matrix(_wide(candidates(spark, sf_dir)), sorted(NAMES))


IMPORTANCE_SQL = f"""{IC_SQL}, {_mi_sql('cand', 'strategy')}, r AS (SELECT strategy AS candidate, avg(rank_ic) AS rank_ic FROM ics GROUP BY 1),
    j AS (SELECT r.*, mi.mi FROM r JOIN mi ON mi.strategy = r.candidate), jn AS (SELECT *, greatest(count(*) OVER () - 1, 1) AS top FROM j),
    imp AS (SELECT candidate, rank_ic, mi, 0.6 * (row_number() OVER (ORDER BY round(abs(rank_ic), 9), candidate) - 1) / top
      + 0.4 * (row_number() OVER (ORDER BY round(mi, 9), candidate) - 1) / top AS importance FROM jn)"""


@query("V8_importance", "candidate:s rank_ic:d mi:d importance:d", f"WITH {IMPORTANCE_SQL} SELECT * FROM imp")
def v8(spark, sf_dir):
    return scored(stored_candidates(spark, sf_dir))


@query(
    "V8_importance_of_all",
    "candidate:s unscorable:b rank_ic:d ir:d mi:d importance:d place:i",
    f"""WITH {IC_SQL}, {_mi_sql('cand', 'strategy')}, one AS (SELECT strategy AS candidate, avg(rank_ic) AS rank_ic,
      avg(ic) / (stddev_pop(ic) + 1e-10) AS ir, any_value(mi) AS mi FROM ics JOIN mi USING (strategy) GROUP BY 1),
    below AS (SELECT a.candidate, count(*) FILTER (round(abs(b.rank_ic), 9) < round(abs(a.rank_ic), 9)
        OR (round(abs(b.rank_ic), 9) = round(abs(a.rank_ic), 9) AND b.candidate < a.candidate)) AS under_ic,
      count(*) FILTER (round(b.mi, 9) < round(a.mi, 9) OR (round(b.mi, 9) = round(a.mi, 9) AND b.candidate < a.candidate)) AS under_mi
      FROM one a, one b GROUP BY 1),
    good AS (SELECT one.*, (0.6 * under_ic + 0.4 * under_mi) / (SELECT count(*) - 1 FROM one) AS importance FROM one JOIN below USING (candidate))
    SELECT candidate, false AS unscorable, rank_ic, ir, mi, importance, rank() OVER (ORDER BY importance DESC, candidate) AS place FROM good
    UNION ALL SELECT candidate, true, 0, 0, 0, NULL, k + (SELECT count(*) FROM one) FROM (VALUES ('a_flat', 1), ('a_missing', 2), ('z_single', 3)) AS t(candidate, k)""",
)
def v8_all(spark, sf_dir):
    """The strategies and three candidates without information: a constant, one without values, one with a single value."""
    rows = stored_candidates(spark, sf_dir).select(F.col("strategy").alias("candidate"), "code", "ts", "factor", "ret")
    base = rows.where(F.col("candidate") == NAMES[0])
    first = base.agg(F.min(F.struct("code", "ts")).alias("at"))
    single = F.when(F.struct("code", "ts") == first.scalar(), F.col("factor"))
    for name, value in [("a_flat", F.lit(0.25)), ("a_missing", F.lit(None).cast("double")), ("z_single", single)]:
        rows = rows.unionByName(base.withColumns({"candidate": F.lit(name), "factor": value}))
    # -inf has no rounded value
    return ev.score_candidates(rows).withColumn("importance", F.when(~F.col("unscorable"), F.col("importance")))


def scored(rows):
    ic = ev.mean_ic(ev.series_ic(rows, ["strategy", "code"], "factor", "ret"), ["strategy"])
    mi = ev.mutual_information(rows, ["strategy"], "factor", "ret")
    table = ic.join(mi, "strategy").withColumnRenamed("strategy", "candidate").withColumn("unscorable", F.lit(False))
    return ev.importance(table)


@query(
    "V9_correlation_prune",
    "candidate:s importance:d status:s in_favour_of:s",
    f"""WITH RECURSIVE {IMPORTANCE_SQL}, cm AS (SELECT a.strategy AS a, b.strategy AS b, abs(corr(a.factor, b.factor)) AS corr FROM cand a
      JOIN cand b ON a.code = b.code AND a.ts = b.ts AND a.strategy < b.strategy GROUP BY 1, 2),
    o AS (SELECT candidate, importance, row_number() OVER (ORDER BY importance DESC, candidate) AS k FROM imp),
    q AS (SELECT o.candidate, o.importance, o.k, list(p.k ORDER BY p.k) FILTER (p.k IS NOT NULL) AS foes FROM o LEFT JOIN (SELECT o1.k AS mine, o2.k FROM o o1 JOIN o o2
      ON o2.importance - o1.importance > 0.01 JOIN cm ON cm.a = least(o1.candidate, o2.candidate) AND cm.b = greatest(o1.candidate, o2.candidate) AND cm.corr >= 0.5) p
      ON p.mine = o.k GROUP BY 1, 2, 3),
    step(k, kept, beaten) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT)
      UNION ALL SELECT q.k, CASE WHEN len(list_intersect(coalesce(q.foes, []), step.kept)) = 0 THEN list_append(step.kept, q.k) ELSE step.kept END,
        list_min(list_intersect(coalesce(q.foes, []), step.kept)) FROM step JOIN q ON q.k = step.k + 1)
    SELECT o.candidate, o.importance, CASE WHEN beaten IS NULL THEN 'retained' ELSE 'pruned' END AS status, w.candidate AS in_favour_of
      FROM step JOIN o USING (k) LEFT JOIN o w ON w.k = step.beaten""",
)
def v9(spark, sf_dir):
    """Correlations from 0.5 on count as conflicts: the four candidates then hold a chain of them."""
    data = stored_candidates(spark, sf_dir)
    return controls.prune(checkpointed(scored(data).select("candidate", "importance")), ev.correlation_matrix(_wide(data), sorted(NAMES)), threshold=0.5)


@query(
    "V10_ablation",
    "candidate:s marginal:d drop:b",
    f"""WITH {CANDIDATES_SQL}, w AS (SELECT *, (rn - 1) // (bars // 5) AS wd FROM cand), ic AS (SELECT wd, strategy, code, corr(factor, ret) AS ic FROM w
      WHERE wd < 5 GROUP BY 1, 2, 3), m AS (SELECT wd, strategy, abs(avg(ic)) AS a FROM ic GROUP BY 1, 2),
    d AS (SELECT m.wd, m.strategy, (SELECT avg(a) FROM m x WHERE x.wd = m.wd) - (SELECT avg(a) FROM m x WHERE x.wd = m.wd
      AND x.strategy <> m.strategy) AS v FROM m)
    SELECT strategy AS candidate, avg(v) AS marginal, avg(v) <= -0.01 AS drop FROM d GROUP BY 1""",
)
def v10(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("window", F.floor((F.col("rn") - 1) / F.floor(F.col("bars") / 5)))
    rows = rows.where(F.col("window") < 5)
    ic = rows.groupBy("window", "strategy", "code").agg(ev.guarded_corr("factor", "ret").alias("ic"))
    table = ic.groupBy("window", F.col("strategy").alias("candidate")).agg(F.abs(F.avg("ic")).alias("abs_ic"))
    return ev.ablation(table, F.col("candidate"))


@query(
    "V11_fold_metrics",
    "code:s fold:i ic:d rank_ic:d net_sharpe:d turnover:d",
    f"""WITH {FOLD_SQL}, v AS (SELECT * FROM folds WHERE role = 'validation'), r AS (SELECT *, rank() OVER (PARTITION BY code, fold ORDER BY factor)
      + (count(*) OVER (PARTITION BY code, fold, factor) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY code, fold ORDER BY ret)
      + (count(*) OVER (PARTITION BY code, fold, ret) - 1) / 2.0 AS ry FROM v)
    SELECT code, fold, corr(factor, ret) AS ic, corr(rx, ry) AS rank_ic, avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(6240) AS net_sharpe,
      avg(turnover) AS turnover FROM r GROUP BY 1, 2""",
)
def v11(spark, sf_dir):
    rows = lb.walk_forward(pnl(spark, sf_dir)).where(F.col("role") == "validation")
    ic = ev.series_ic(rows, ["code", "fold"], "factor", "ret")
    money = rows.groupBy("code", "fold").agg(sharpe().alias("net_sharpe"), F.avg("turnover").alias("turnover"))
    return ic.join(money, ["code", "fold"])


_LCG = "(({h}) * 48271 % 2147483647)"


#: Resamples of every bootstrap (fixed value).
DRAWS = 2000


def boot_sql(series: str, block: int, samples: int, seed: int) -> str:
    h = f"((draw * 1000003 + block * 10007 + {seed}) % 2147483647 + 1)"
    for _ in range(3):
        h = _LCG.format(h=h)
    return f"""size AS (SELECT count(*) AS n, least({block}, count(*)) AS w FROM {series}),
    draws AS (SELECT d AS draw, b AS block, {h.replace('draw', 'd').replace('block', 'b')} % (n - w + 1) + o AS position, n, w, o, b * w + o AS slot
      FROM size, range({samples}) x(d), unnest(range(ceil(n / w::DOUBLE)::BIGINT)) y(b), range({block}) z(o) WHERE o < w)"""


@query(
    "V12_moving_block_bootstrap",
    "ci_low:d ci_high:d p_value:d samples:i",
    f"""WITH {DAILY_SQL}, se AS (SELECT rank_ic, row_number() OVER (ORDER BY date) - 1 AS position FROM daily), {boot_sql('se', 5, DRAWS, 7)},
    st AS (SELECT draw, avg(rank_ic) AS stat FROM draws JOIN se USING (position) WHERE slot < n GROUP BY draw)
    SELECT quantile_cont(stat, 0.025) AS ci_low, quantile_cont(stat, 0.975) AS ci_high, (1 + count(*) FILTER (stat <= 0)) / (1 + count(*)) AS p_value,
      count(*) AS samples FROM st""",
)
def v12(spark, sf_dir):
    series = stored(_numbered(ev.cross_section_ic(paired(spark, sf_dir), "REV_5", "target")))
    draws = ev.moving_block_bootstrap(series, ["rank_ic"], block=5, samples=DRAWS, seed=7)
    return ev.bootstrap_summary(draws.groupBy("draw").agg(F.avg("rank_ic").alias("stat")))


def _numbered(daily):
    """A daily table has one row per session: one task numbers it."""
    return daily.withColumn("position", F.row_number().over(Window.orderBy("date")) - 1)


PHASE_SQL = f"""{SIGNALS_SQL}, ph AS (SELECT date, (year(date) * 12 + month(date)) % 3 AS p0, code % 3 AS phase, avg(r_1d) AS net FROM s1 WHERE r_1d IS NOT NULL
  GROUP BY ALL), al AS (SELECT date, max(net) FILTER (phase = 0) AS a0, max(net) FILTER (phase = 1) AS a1, max(net) FILTER (phase = 2) AS a2 FROM ph GROUP BY date),
mb AS (SELECT date, avg(r_1d) AS baseline FROM s1 WHERE r_1d IS NOT NULL GROUP BY date),
aligned AS (SELECT al.*, baseline FROM al JOIN mb USING (date) WHERE a0 IS NOT NULL AND a1 IS NOT NULL AND a2 IS NOT NULL)"""


def phase_returns(spark, sf_dir):
    """Three phases (supplier groups) of monthly mean returns and the market as baseline."""
    rows = stored(stock_panel(spark, sf_dir).where(F.col("r_1d").isNotNull()).select("date", "code", "r_1d"))
    phases = rows.groupBy("date", (F.col("code") % 3).alias("phase")).agg(F.avg("r_1d").alias("net_return"))
    return phases, rows.groupBy("date").agg(F.avg("r_1d").alias("net_return"))


@query("J13_phase_alignment", "date:t phase_0:d phase_1:d phase_2:d baseline:d",
       f"WITH {PHASE_SQL} SELECT date, a0 AS phase_0, a1 AS phase_1, a2 AS phase_2, baseline FROM aligned")
def j13(spark, sf_dir):
    return joins.align_phases(*phase_returns(spark, sf_dir), [0, 1, 2])


_SH = "CASE WHEN stddev_pop({x}) > 1e-12 THEN avg({x}) / stddev_pop({x}) * sqrt(12) ELSE 0 END"


@query(
    "V13_paired_phase_bootstrap",
    "ci_low:d ci_high:d p_value:d samples:i",
    f"""WITH {PHASE_SQL}, se AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS position FROM aligned), {boot_sql('se', 6, DRAWS, 11)},
    st AS (SELECT draw, list_sort([{', '.join(_SH.format(x=f'a{i}') for i in range(3))}])[2] - {_SH.format(x='baseline')} AS stat
      FROM draws JOIN se USING (position) WHERE slot < n GROUP BY draw)
    SELECT quantile_cont(stat, 0.025) AS ci_low, quantile_cont(stat, 0.975) AS ci_high, (1 + count(*) FILTER (stat <= 0)) / (1 + count(*)) AS p_value,
      count(*) AS samples FROM st""",
)
def v13(spark, sf_dir):
    """The same blocks resample every phase and the baseline; statistic = median Sharpe minus baseline Sharpe."""
    names = ["phase_0", "phase_1", "phase_2"]
    series = stored(_numbered(joins.align_phases(*phase_returns(spark, sf_dir), [0, 1, 2])))
    draws = ev.moving_block_bootstrap(series, [*names, "baseline"], block=6, samples=DRAWS, seed=11)
    per = draws.groupBy("draw").agg(*[ev.annual_sharpe(n, 12).alias(n) for n in (*names, "baseline")])
    middle = F.element_at(F.array_sort(F.array(*names)), 2)
    return ev.bootstrap_summary(per.select("draw", (middle - F.col("baseline")).alias("stat")))


@query(
    "V14_holm_adjustment",
    "name:s p_value:d p_holm:d reject:b",
    f"""WITH {IC_SQL}, p AS (SELECT strategy || ':' || code AS name, least(1.0, exp(-abs(rank_ic) * sqrt(n))) AS p_value FROM ics),
    r AS (SELECT *, least(1.0, p_value * (count(*) OVER () - row_number() OVER (ORDER BY p_value, name) + 1)) AS raw FROM p),
    h AS (SELECT *, max(raw) OVER (ORDER BY p_value, name) AS p_holm FROM r) SELECT name, p_value, p_holm, p_holm < 0.05 AS reject FROM h""",
)
def v14(spark, sf_dir):
    ics = ev.series_ic(candidates(spark, sf_dir), ["strategy", "code"], "factor", "ret")
    p = F.least(F.lit(1.0), F.exp(-F.abs("rank_ic") * F.sqrt("n")))
    return ev.holm(ics.select(F.concat_ws(":", "strategy", "code").alias("name"), p.alias("p_value")))


@query(
    "V15_quantile_groups",
    "strategy:s bucket:i n:i mean_target:d monotonicity:d",
    f"""WITH {CANDIDATES_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY factor) - 1
      + (count(*) OVER (PARTITION BY strategy, factor) - 1) / 2.0 AS r0, count(*) OVER (PARTITION BY strategy) AS t FROM cand),
    b AS (SELECT strategy, least(4, CAST(floor(r0 * 5 / t) AS BIGINT)) AS bucket, count(*) AS n, avg(ret) AS mean_target FROM r GROUP BY 1, 2),
    m AS (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY mean_target) AS rr FROM b)
    SELECT strategy, bucket, n, mean_target, round(abs(corr(rr, bucket) OVER (PARTITION BY strategy)), 12) AS monotonicity FROM m""",
)
def v15(spark, sf_dir):
    return ev.group_returns(stored_candidates(spark, sf_dir), ["strategy"], "factor", "ret")


_SEG_RANK = """rank() OVER (PARTITION BY {k} ORDER BY factor) + (count(*) OVER (PARTITION BY {k}, factor) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {k} ORDER BY ret) + (count(*) OVER (PARTITION BY {k}, ret) - 1) / 2.0 AS ry"""


@query(
    "V16_segment_rank_ic",
    "segment:s n:i rank_ic:d",
    f"""WITH {FOLD_SQL}, lc AS (SELECT code, ts, ln(close) - lag(ln(close)) OVER (PARTITION BY code ORDER BY ts) AS lr FROM bars),
    vo AS (SELECT code, ts, CASE WHEN count(*) OVER w = 20 THEN stddev_pop(coalesce(lr, 0.0)) OVER w END AS vol FROM lc
      WINDOW w AS (PARTITION BY code ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    oo AS (SELECT DISTINCT f.code, f.ts, f.factor, f.ret, vo.vol FROM folds f JOIN vo USING (code, ts) WHERE role = 'validation'),
    q AS (SELECT quantile_cont(vol, 1/3) AS lo, quantile_cont(vol, 2/3) AS hi FROM oo),
    sg AS (SELECT 'year:' || year(ts) AS segment, factor, ret FROM oo UNION ALL SELECT 'code:' || code, factor, ret FROM oo
      UNION ALL SELECT 'regime:' || CASE WHEN vol <= lo THEN 'low' WHEN vol >= hi THEN 'high' ELSE 'mid' END, factor, ret FROM oo, q WHERE vol IS NOT NULL),
    r AS (SELECT *, {_SEG_RANK.format(k='segment')} FROM sg) SELECT segment, count(*) AS n, corr(rx, ry) AS rank_ic FROM r GROUP BY 1 HAVING count(*) >= 20""",
)
def v16(spark, sf_dir):
    """Out-of-sample rows by year, code and volatility tercile of the 20 bars before the current one."""
    s = Series()
    bars = bars_hourly(spark, sf_dir).withColumn("_lr", F.coalesce(F.log("close") - F.log(s.lag("close", 1)), F.lit(0.0)))
    frame = s.between(-20, -1)
    vol = bars.select("code", "ts", F.when(F.count("_lr").over(frame) == 20, F.stddev_pop("_lr").over(frame)).alias("vol"))
    oos = lb.walk_forward(pnl(spark, sf_dir)).where(F.col("role") == "validation").select("code", "ts", "factor", "ret").join(vol, ["code", "ts"])
    oos = checkpointed(oos)
    one = oos.withColumn("_all", F.lit(1))
    terciles = quantile_table(value_table(one, ["_all"], "vol"), ["_all"], "vol", lambda k: (k + 1) / 3.0, 2)
    lo, hi = terciles.select(F.col("q")[0]).scalar(), terciles.select(F.col("q")[1]).scalar()
    regime = F.when(F.col("vol") <= lo, "low").when(F.col("vol") >= hi, "high").otherwise("mid")
    segments = F.array(
        F.concat(F.lit("year:"), F.year("ts").cast("string")),
        F.concat(F.lit("code:"), F.col("code")),
        F.when(F.col("vol").isNotNull(), F.concat(F.lit("regime:"), regime)),
    )
    rows = oos.select(F.explode(segments).alias("segment"), "factor", "ret").where(F.col("segment").isNotNull())
    return ev.series_ic(rows, ["segment"], "factor", "ret", bounded=False).where(F.col("n") >= 20)


METRICS_SQL = f"""{IC_SQL}, mx AS (SELECT s, max(corr) AS max_correlation FROM (WITH cm AS (SELECT a.strategy AS a, b.strategy AS b, abs(corr(a.factor, b.factor)) AS corr
    FROM cand a JOIN cand b ON a.code = b.code AND a.ts = b.ts AND a.strategy < b.strategy GROUP BY 1, 2) SELECT a AS s, corr FROM cm UNION ALL SELECT b, corr FROM cm) GROUP BY 1),
  me AS (SELECT strategy, avg(ic) AS ic, avg(rank_ic) AS rank_ic, avg(ic) / (stddev_samp(ic) + 1e-12) AS icir, avg(rank_ic) / (stddev_samp(rank_ic) + 1e-12) AS rank_icir,
    avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0 END) AS direction_ratio, min(rank_ic) AS ci_low, max(rank_ic) AS ci_high FROM ics GROUP BY 1),
  pn AS (SELECT strategy, avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(6240) AS net_sharpe, count(factor) / count(*) AS coverage FROM cand GROUP BY 1),
  metrics AS (SELECT me.*, mx.max_correlation, pn.net_sharpe, pn.coverage FROM me JOIN mx ON mx.s = me.strategy JOIN pn USING (strategy))"""


def metrics(rows):
    ics = ev.series_ic(rows, ["strategy", "code"], "factor", "ret").groupBy("strategy").agg(
        F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"),
        (F.avg("ic") / (F.stddev_samp("ic") + 1e-12)).alias("icir"),
        (F.avg("rank_ic") / (F.stddev_samp("rank_ic") + 1e-12)).alias("rank_icir"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("direction_ratio"),
        F.min("rank_ic").alias("ci_low"), F.max("rank_ic").alias("ci_high"),
    )
    pairs = ev.correlation_matrix(_wide(rows), sorted(NAMES))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("strategy"), "corr")
    money = rows.groupBy("strategy").agg(
        sharpe().alias("net_sharpe"), F.avg("turnover").alias("turnover"), (F.count("factor") / F.count(F.lit(1))).alias("coverage")
    )
    return ics.join(ends.groupBy("strategy").agg(F.max("corr").alias("max_correlation")), "strategy").join(money, "strategy")


_RULES = [
    ("INVALID_FORMULA", "coverage > 0"), ("COVERAGE", "coverage >= 0.95"), ("RANK_IC", "abs(rank_ic) >= 0.005"), ("ICIR", "abs(icir) >= 0.05"),
    ("RANK_ICIR", "abs(rank_icir) >= 0.05"), ("BOOTSTRAP_CROSSES_ZERO", "NOT (ci_low <= 0 AND ci_high >= 0)"), ("DIRECTION", "direction_ratio >= 0.60"),
    ("FOLD_DIRECTION", "direction_ratio >= 0.75"), ("NO_INCREMENT", "ic > 0"), ("INCREMENT_FOLDS", "direction_ratio >= 0.75"),
    ("CORRELATED", "NOT (max_correlation >= 0.80 AND ic < 0.003)"), ("NET_SHARPE", "net_sharpe >= -0.25"), ("MONOTONICITY", "monotonicity >= 0.50"),
    ("SEGMENTS", "direction_ratio >= 0.60"), ("PORTFOLIO_WORSE", "net_sharpe >= -1e-12"),
]


@query(
    "V17_retention_gate",
    "strategy:s accepted:b reasons:s",
    f"""WITH {METRICS_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY factor) - 1
      + (count(*) OVER (PARTITION BY strategy, factor) - 1) / 2.0 AS r0, count(*) OVER (PARTITION BY strategy) AS t FROM cand),
    b AS (SELECT strategy, least(4, CAST(floor(r0 * 5 / t) AS BIGINT)) AS bucket, avg(ret) AS mt FROM r GROUP BY 1, 2),
    g AS (SELECT strategy, round(abs(corr(rr, bucket)), 12) AS monotonicity FROM (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY mt) AS rr FROM b) GROUP BY 1),
    f AS (SELECT strategy, concat_ws(';', {', '.join(f"CASE WHEN NOT ({r}) THEN '{n}' END" for n, r in _RULES)}) AS reasons FROM metrics JOIN g USING (strategy))
    SELECT strategy, reasons = '' AS accepted, reasons FROM f""",
)
def v17(spark, sf_dir):
    rows = stored_candidates(spark, sf_dir)
    mono = ev.group_returns(rows, ["strategy"], "factor", "ret").groupBy("strategy").agg(F.max("monotonicity").alias("monotonicity"))
    # codes stand in for folds and segments, the IC for the model increment
    df = metrics(rows).join(mono, "strategy").withColumns(
        {
            "valid": F.col("coverage") > 0, "fold_direction_ratio": F.col("direction_ratio"), "increment": F.col("ic"),
            "increment_fold_ratio": F.col("direction_ratio"), "segment_direction_ratio": F.col("direction_ratio"),
            "portfolio_delta": F.col("net_sharpe"),
        }
    )
    df = df.withColumn("_failed", ev.failed_checks(ev.retention_checks()))
    return df.select("strategy", (F.size("_failed") == 0).alias("accepted"), F.concat_ws(";", "_failed").alias("reasons"))


_CLIP = "greatest(least({x}, 1), 0)"


@query(
    "V18_V20_V21_ranking_scores",
    "strategy:s ranking:d penalised:d gated:d",
    f"""WITH {METRICS_SQL}, t AS (SELECT strategy, avg(turnover) AS turnover FROM (SELECT strategy, abs(pos - coalesce(lag(pos) OVER (PARTITION BY strategy, code ORDER BY ts), 0.0))
      AS turnover, rn, bars FROM numbered) WHERE rn <= bars - 2 GROUP BY 1)
    SELECT strategy, 0.25 * {_CLIP.format(x='abs(rank_icir)')} + 0.2 * {_CLIP.format(x='abs(icir)')} + 0.25 * {_CLIP.format(x='ic / 0.03')} + 0.2 * {_CLIP.format(x='net_sharpe / 2')}
      + 0.1 * {_CLIP.format(x='direction_ratio')} - 0.1 * max_correlation - 0.05 * least(1, turnover) - 0.03 * 3 / 16 AS ranking,
      net_sharpe * CASE WHEN max_correlation > 0.85 THEN 0.8 ELSE 1 END AS penalised,
      net_sharpe * CASE WHEN ic > 0.01 THEN 1.15 WHEN ic < -0.01 THEN 0.75 ELSE 1 END AS gated FROM metrics JOIN t USING (strategy)""",
)
def v18(spark, sf_dir):
    df = metrics(stored_candidates(spark, sf_dir)).withColumns({"increment": F.col("ic"), "operators": F.lit(3)})
    return df.select(
        "strategy",
        ev.ranking_score().alias("ranking"),
        ev.correlation_penalty(F.col("net_sharpe"), F.col("max_correlation")).alias("penalised"),
        ev.ic_gate(F.col("net_sharpe"), F.col("ic")).alias("gated"),
    )


@query(
    "V22_leave_one_group_out",
    "kind:s dropped:s overall:d without:d sign_flip:b",
    f"""WITH {DAILY_SQL}, x AS (SELECT *, (r_new - r_old) * r_t AS v FROM dr), t AS (SELECT sum(v) AS s, count(v) AS n FROM x),
    k AS (SELECT 'year' AS kind, CAST(year(date) AS VARCHAR) AS dropped, v FROM x UNION ALL SELECT 'industry', industry, v FROM x UNION ALL SELECT 'code', CAST(code AS VARCHAR), v FROM x),
    g AS (SELECT kind, dropped, sum(v) AS gs, count(v) AS gn FROM k GROUP BY 1, 2)
    SELECT kind, dropped, s / n AS overall, (s - gs) / (n - gn) AS without, sign(s / n) <> sign((s - gs) / (n - gn)) AS sign_flip FROM g, t""",
)
def v22(spark, sf_dir):
    wd = Window.partitionBy("date")
    rows = paired(spark, sf_dir)
    rank = {n: sg.rank_pct(F.col(x), wd) for n, x in (("_o", "REV_5"), ("_n", "MOM_20"), ("_t", "target"))}
    rows = stored(rows.withColumns(rank).withColumn("v", (F.col("_n") - F.col("_o")) * F.col("_t")).withColumn("year", F.year("date")))
    out = None
    for kind in ("year", "industry", "code"):
        part = ev.leave_one_group_out(rows, kind, "v").withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "V23_deletion_rank_ic",
    "scenario:s dates:i rows:i rank_ic:d",
    f"""WITH {DAILY_SQL}, sc AS (SELECT * FROM (VALUES ('baseline', 1000000000, -1), ('drop_mod_10', 10, 3), ('drop_mod_4', 4, 1)) t(scenario, m, r)),
    k AS (SELECT sc.scenario, pr.date, REV_5, target FROM pr, sc WHERE code % m <> r),
    q AS (SELECT *, {rank_sql('REV_5', 'scenario, date')} AS a, {rank_sql('target', 'scenario, date')} AS b FROM k),
    d AS (SELECT scenario, date, count(*) AS n, corr(a, b) AS ic FROM q GROUP BY 1, 2 HAVING count(*) >= 10)
    SELECT scenario, count(*) AS dates, sum(n) AS rows, avg(ic) AS rank_ic FROM d GROUP BY 1""",
)
def v23(spark, sf_dir):
    rows = stored(paired(spark, sf_dir))
    codes = rows.select("code").distinct()
    removed = codes.where(F.col("code") % 10 == 3).withColumn("scenario", F.lit("drop_mod_10"))
    removed = removed.unionByName(codes.where(F.col("code") % 4 == 1).withColumn("scenario", F.lit("drop_mod_4")))
    nothing = codes.limit(1).select(F.lit(None).cast("bigint").alias("code"), F.lit("baseline").alias("scenario"))
    return ev.deletion_rank_ic(rows, removed.unionByName(nothing), "REV_5", "target")


@query(
    "V24_agreement_counts",
    "agree:i disagree:i years_agreeing:i",
    f"""WITH {DAILY_SQL}, s AS (SELECT sign(avg(rank_ic)) AS o FROM daily), y AS (SELECT year(date) AS y, sign(avg(rank_ic)) AS g FROM daily GROUP BY 1)
    SELECT (SELECT count(*) FILTER (sign(CASE WHEN abs(rank_ic) < 1e-12 THEN 0 ELSE rank_ic END) = o) FROM daily, s) AS agree,
      (SELECT count(*) FILTER (sign(CASE WHEN abs(rank_ic) < 1e-12 THEN 0 ELSE rank_ic END) = -o) FROM daily, s) AS disagree,
      (SELECT count(*) FILTER (g = o) FROM y, s) AS years_agreeing""",
)
def v24(spark, sf_dir):
    daily = stored(ev.cross_section_ic(paired(spark, sf_dir), "REV_5", "target"))
    overall = daily.agg(F.signum(F.avg("rank_ic")).alias("o")).scalar()
    years = daily.groupBy(F.year("date").alias("y")).agg(F.signum(F.avg("rank_ic")).alias("g"))
    sign = F.signum(F.when(F.abs("rank_ic") < 1e-12, 0.0).otherwise(F.col("rank_ic")))
    return daily.agg(
        F.count(F.when(sign == overall, 1)).alias("agree"),
        F.count(F.when(sign == -overall, 1)).alias("disagree"),
    ).withColumn("years_agreeing", years.agg(F.count(F.when(F.col("g") == overall, 1)).alias("n")).scalar())


@query(
    "V25_gate_decision",
    "strategy:s passed:i failed:s status:s",
    f"""WITH {METRICS_SQL}, c AS (SELECT strategy, concat_ws(';', CASE WHEN NOT net_sharpe >= 0.1 THEN 'sharpe_improvement' END, CASE WHEN NOT direction_ratio >= 0.6
      THEN 'direction' END, CASE WHEN NOT ci_low > 0 THEN 'bootstrap_ci_lower_positive' END, CASE WHEN NOT max_correlation <= 0.99 THEN 'correlation_bound' END) AS failed,
      (net_sharpe >= 0.1)::INT + (direction_ratio >= 0.6)::INT + (ci_low > 0)::INT + (max_correlation <= 0.99)::INT AS passed FROM metrics)
    SELECT strategy, passed, failed, CASE WHEN passed = 4 THEN 'RESEARCH_GATE_PASSED' ELSE 'KEEP_BASELINE' END AS status FROM c""",
)
def v25(spark, sf_dir):
    checks = {
        "sharpe_improvement": F.col("net_sharpe") >= 0.1,
        "direction": F.col("direction_ratio") >= 0.6,
        "bootstrap_ci_lower_positive": F.col("ci_low") > 0,
        "correlation_bound": F.col("max_correlation") <= 0.99,
    }
    df = metrics(stored_candidates(spark, sf_dir)).withColumn("_failed", ev.failed_checks(checks))
    passed = F.lit(len(checks)) - F.size("_failed")
    return df.select(
        "strategy", passed.alias("passed"), F.concat_ws(";", "_failed").alias("failed"),
        F.when(passed == len(checks), "RESEARCH_GATE_PASSED").otherwise("KEEP_BASELINE").alias("status"),
    )


@query(
    "V26_cost_attribution",
    "strategy:s gross:d net:d drag:d gross_alpha:d cost_reduction:d net_delta:d residual:d",
    f"""WITH {STRATEGY_SQL}, a AS (SELECT strategy, avg(pos * ret) * 6240 AS gross, avg(pnl) * 6240 AS net FROM spn GROUP BY 1),
    b AS (SELECT gross AS g0, net AS n0 FROM a WHERE strategy = 's_momentum')
    SELECT strategy, gross, net, gross - net AS drag, gross - g0 AS gross_alpha, (g0 - n0) - (gross - net) AS cost_reduction, net - n0 AS net_delta, 0.0 AS residual FROM a, b""",
)
def v26(spark, sf_dir):
    table = strategy_pnl(spark, sf_dir).groupBy("strategy").agg(
        (F.avg(F.col("pos") * F.col("ret")) * 6240).alias("gross"), (F.avg("pnl") * 6240).alias("net")
    )
    base = table.where(F.col("strategy") == "s_momentum")
    g0, n0 = base.select("gross").scalar(), base.select("net").scalar()
    df = table.withColumn("drag", F.col("gross") - F.col("net"))
    df = df.withColumns({"gross_alpha": F.col("gross") - g0, "cost_reduction": (g0 - n0) - F.col("drag"), "net_delta": F.col("net") - n0})
    return df.withColumn("residual", F.abs(F.col("gross_alpha") + F.col("cost_reduction") - F.col("net_delta")))


#: Rounds of the boosted trees, folds of the split and bins of a feature (that of Spark's trees).
ROUNDS = 60
FOLDS = 5
BINS = 32


@query("V27_model_increment", "fold:i baseline_ic:d with_candidate_ic:d delta:d")
def v27(spark, sf_dir):
    """Boosted trees per fold with and without the candidate on the same rows; mean daily RankIC delta.

    The panel is monthly, so purge, embargo and holdout are months; models fit side by side.  Trees see features as
    bins: all rows are counted into cells of bins, and the models learn from the weighted cells (``ev.binned``).
    """
    from multiprocessing.pool import ThreadPool

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = checkpointed(paired(spark, sf_dir))
    split = lb.purged_split(rows, folds=FOLDS, holdout_min=6, holdout_years=0, purge=3, embargo=1)
    rows = rows.join(split.where(F.col("role").isin("train", "validation")), "date")
    base, extended = ["REV_5", "amount"], ["REV_5", "amount", "MOM_20"]
    rows = stored(ev.binned(rows, ["fold"], extended, F.col("role") == "train", BINS))
    # at most BINS ** 3 cells a fold, however many rows
    cells = stored(ev.cells(rows.where(F.col("role") == "train"), ["fold"], extended, "target").coalesce(FOLDS))
    seen = stored(rows.where(F.col("role") == "validation").select("fold", *[f"b_{c}" for c in extended]).distinct().coalesce(FOLDS))

    def scored(job):
        fold, name, columns = job
        bins = [f"b_{c}" for c in columns]
        table = cells.where(F.col("fold") == fold)
        merged = table if columns == extended else ev.merged_cells(table, bins)
        assembler = VectorAssembler(inputCols=bins, outputCol="features")
        trees = GBTRegressor(labelCol="mean", weightCol="n", featuresCol="features", maxIter=ROUNDS, maxDepth=3, maxBins=BINS, seed=1)
        model = trees.fit(assembler.transform(merged.coalesce(1)).select("features", "mean", "n"))
        answers = assembler.transform(seen.where(F.col("fold") == fold).select("fold", *bins).distinct())
        return model.transform(answers).select("fold", *bins, F.col("prediction").alias(name))

    jobs = [(k, name, columns) for k in range(FOLDS) for name, columns in (("baseline_ic", base), ("with_candidate_ic", extended))]
    with ThreadPool(4) as pool:
        tables = pool.map(scored, jobs)
    out = None
    for which, name, columns in ((0, "baseline_ic", base), (1, "with_candidate_ic", extended)):
        predictions = None
        for part in tables[which::2]:
            predictions = part if predictions is None else predictions.unionByName(part)
        here = rows.where(F.col("role") == "validation").join(stored(predictions), ["fold", *[f"b_{c}" for c in columns]])
        found = ev.cross_section_ic(here, name, "target", ("fold", "date")).groupBy("fold").agg(F.avg("rank_ic").alias(name))
        out = found if out is None else out.join(found, "fold")
    return out.withColumn("delta", F.col("with_candidate_ic") - F.col("baseline_ic"))


@query(
    "V28_candidate_cleaning",
    "candidate:s state:s duplicate_of:s",
    f"""WITH {BARS_SQL} SELECT * FROM (VALUES ('close_a', 'retained', NULL), ('close_b', 'duplicate', 'close_a'), ('flat', 'unusable', NULL),
      ('missing', 'unusable', NULL), ('volume', 'retained', NULL)) t(candidate, state, duplicate_of) WHERE (SELECT count(*) FROM bars) > 0""",
)
def v28(spark, sf_dir):
    bars = bars_hourly(spark, sf_dir)
    wide = bars.select(
        "code", "ts", F.col("close").alias("close_a"), F.col("close").alias("close_b"), F.lit(1.0).alias("flat"),
        F.lit(None).cast("double").alias("missing"), "volume",
    )
    names = ["close_a", "close_b", "flat", "missing", "volume"]
    long = wide.unpivot(["code", "ts"], names, "candidate", "value")
    return ev.clean_candidates(long, "candidate", ["code", "ts"], "value")


SUBSET_SQL = f"""{CANDIDATES_SQL}, fo AS (SELECT strategy, (rn - 1) * 4 // bars AS fold, code, factor, ret FROM cand),
  fi AS (SELECT strategy, fold, avg(ic) AS score FROM (SELECT strategy, fold, code, corr(factor, ret) AS ic FROM fo GROUP BY 1, 2, 3) GROUP BY 1, 2),
  fm AS (SELECT a.strategy AS grp, 1 AS size, a.fold, a.score, b.score AS baseline FROM fi a JOIN fi b ON b.fold = a.fold AND b.strategy = 's_neutral' WHERE a.strategy <> 's_neutral')"""


@query(
    "V29_subset_sweep",
    "grp:s mean_score:d delta:d positive_folds:d eligible:b best:b",
    f"""WITH {SUBSET_SQL}, g AS (SELECT grp, avg(score) AS mean_score, avg(score - baseline) AS delta, avg(CASE WHEN score > baseline THEN 1.0 ELSE 0 END) AS positive_folds FROM fm GROUP BY 1),
    e AS (SELECT *, delta >= 0.001 AND positive_folds >= 0.6 AS eligible FROM g)
    SELECT *, row_number() OVER (ORDER BY eligible DESC, mean_score DESC, grp) = 1 AND eligible AS best FROM e""",
)
def v29(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("fold", F.floor((F.col("rn") - 1) * 4 / F.col("bars")))
    per_code = rows.groupBy("strategy", "fold", "code").agg(ev.guarded_corr("factor", "ret").alias("ic"))
    fold = per_code.groupBy("strategy", "fold").agg(F.avg("ic").alias("score"))
    base = fold.where(F.col("strategy") == "s_neutral").select("fold", F.col("score").alias("baseline"))
    table = fold.where(F.col("strategy") != "s_neutral").join(base, "fold").withColumnRenamed("strategy", "grp").withColumn("size", F.lit(1))
    return ev.subset_scores(table)


@query(
    "V32_periods_per_year",
    "ppy:i",
    f"""WITH {BARS_SQL}, p AS (SELECT greatest(10, least(600000, round(count(*) / ((epoch(max(ts)) - epoch(min(ts))) / (365.25 * 86400))))) AS ppy FROM bars GROUP BY code)
    SELECT list_sort(list(ppy))[count(*) // 2 + 1] AS ppy FROM p""",
)
def v32(spark, sf_dir):
    return ev.periods_per_year(bars_hourly(spark, sf_dir))


@query(
    "V33_elite_formulas",
    "tokens:s score:d",
    f"""WITH {IC_SQL} SELECT strategy AS tokens, max(abs(ic)) AS score FROM ics GROUP BY 1 ORDER BY score DESC, tokens LIMIT 3""",
)
def v33(spark, sf_dir):
    ics = ev.series_ic(candidates(spark, sf_dir), ["strategy", "code"], "factor", "ret")
    return ev.elite(ics.select(F.col("strategy").alias("tokens"), F.abs("ic").alias("score")), 3)


@query(
    "V34_fingerprint",
    "n_rows:i digest:i",
)
def v34(spark, sf_dir):
    from factorloom.sources.store import fingerprint

    return fingerprint(bars_hourly(spark, sf_dir))


@query(
    "V35_leave_one_code_out",
    "code:i rank_ic:d without:d change:d",
    f"""WITH {DAILY_SQL}, k AS (SELECT c.code AS gone, pr.date, pr.code, REV_5, target FROM pr, (SELECT DISTINCT code FROM pr) c WHERE pr.code <> c.code),
    q AS (SELECT *, {rank_sql('REV_5', 'gone, date')} AS a, {rank_sql('target', 'gone, date')} AS b FROM k),
    d AS (SELECT gone, date, corr(a, b) AS ic FROM q GROUP BY 1, 2 HAVING count(*) >= 10), m AS (SELECT gone, avg(ic) AS without FROM d GROUP BY 1),
    o AS (SELECT avg(rank_ic) AS rank_ic FROM daily) SELECT gone AS code, rank_ic, without, without - rank_ic AS change FROM m, o""",
)
def v35(spark, sf_dir):
    return ev.leave_one_code_out(paired(spark, sf_dir), "REV_5", "target")


# -- control draws ---------------------------------------------------------------------
CONTROL_DRAWS, CONTROL_SEED = 20, 5


def _prior(draw: str, head: str, target: str, control: str) -> str:
    h = f"(({draw} * 1000003 + {head} * 7919 + {target} * 10007 + {control} * 104729 + {CONTROL_SEED}) % 2147483646 + 1)"
    for _ in range(3):
        h = _LCG.format(h=h)
    return h


_PICK = f"list_sort(list_transform({{pool}}, lambda c: {{{{'h': {_prior('t.draw', 't.head_id', 't.code', 'c.control')}, 'control': c.control, 'gap': c.gap}}}}))[1]"
#: Two heads: the 5 % of the codes with the greatest mean contribution of either signal; nations stand for industries.
DRAWN_SQL = f"""{DAILY_SQL}, me AS (SELECT code, any_value(s_nationkey) AS industry, count(*) AS member_days FROM pr JOIN supplier ON s_suppkey = code GROUP BY 1),
co AS (SELECT code, avg(REV_5 * target) AS a, avg(MOM_20 * target) AS b FROM pr GROUP BY 1),
hk AS (SELECT code, row_number() OVER (ORDER BY a DESC, code) AS ia, row_number() OVER (ORDER BY b DESC, code) AS ib, greatest(1, ceil(0.05 * count(*) OVER ())) AS k FROM co),
hd AS (SELECT 'mom' AS head, 1 AS head_id, code FROM hk WHERE ib <= k UNION ALL SELECT 'rev', 2, code FROM hk WHERE ia <= k),
un AS (SELECT head, draw, code AS control FROM (SELECT s.head, s.n, d.draw, me.code, row_number() OVER (PARTITION BY s.head, d.draw
    ORDER BY {_prior('d.draw', 's.head_id', '0', 'me.code')}, me.code) AS i FROM me, (SELECT head, head_id, count(*) AS n FROM hd GROUP BY 1, 2) s, range({CONTROL_DRAWS}) d(draw)) WHERE i <= n),
cl AS (SELECT hd.head, hd.head_id, hd.code, list_sort(list({{'gap': abs(a.member_days - b.member_days), 'control': b.code}}) FILTER (a.industry = b.industry)) AS own,
    list_sort(list({{'gap': abs(a.member_days - b.member_days), 'control': b.code}})) AS every
  FROM hd JOIN me a ON a.code = hd.code JOIN me b ON NOT EXISTS (SELECT 1 FROM hd x WHERE x.head = hd.head AND x.code = b.code) GROUP BY 1, 2, 3),
tn AS (SELECT cl.*, d.draw, row_number() OVER (PARTITION BY head, draw ORDER BY code) AS k FROM cl, range({CONTROL_DRAWS}) d(draw)),
mt(head, draw, k, taken, code, control, gap, fallback) AS (
  SELECT DISTINCT head, draw, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false FROM tn
  UNION ALL SELECT head, draw, k, list_append(taken, p.control), code, p.control, p.gap, fb FROM (
    SELECT t.head, t.draw, t.k, m.taken, t.code, len(o.l) = 0 AS fb, CASE WHEN len(o.l) = 0 THEN {_PICK.format(pool='e.l')} ELSE {_PICK.format(pool='o.l')} END AS p
    FROM mt m JOIN tn t ON t.head = m.head AND t.draw = m.draw AND t.k = m.k + 1,
      LATERAL (SELECT list_slice(list_filter(coalesce(t.own, []), lambda c: NOT list_contains(m.taken, c.control)), 1, 10) AS l) o,
      LATERAL (SELECT list_slice(list_filter(t.every, lambda c: NOT list_contains(m.taken, c.control)), 1, 10) AS l) e))"""


def heads_and_rows(spark, sf_dir):
    """(rows, meta, heads): rows of both signals with the next return; history length and nation per code; two heads."""
    rows = stored(paired(spark, sf_dir))
    nation = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("industry"))
    meta = stored(rows.groupBy("code").agg(F.count(F.lit(1)).alias("member_days")).join(nation, "code"))
    share = rows.groupBy("code").agg(F.avg(F.col("REV_5") * F.col("target")).alias("a"), F.avg(F.col("MOM_20") * F.col("target")).alias("b"))
    top = share.agg(F.greatest(F.lit(1), F.ceil(0.05 * F.count(F.lit(1))))).scalar()
    heads = None
    for name, number, by in (("mom", 1, "b"), ("rev", 2, "a")):
        # one row per code: the ordering of the codes is one small task
        place = F.row_number().over(Window.orderBy(F.desc(by), "code"))
        part = share.withColumn("_i", place).where(F.col("_i") <= top).select(F.lit(name).alias("head"), F.lit(number).alias("head_id"), "code")
        heads = part if heads is None else heads.unionByName(part)
    return rows, meta, stored(heads)


@query(
    "V37_matched_controls",
    "head:s family:s draw:i code:i control:i gap:i fallback:b",
    f"""WITH RECURSIVE {DRAWN_SQL} SELECT head, 'matched' AS family, draw, code, control, gap, fallback FROM mt WHERE k > 0 AND control IS NOT NULL
      UNION ALL SELECT head, 'uniform', draw, NULL, control, NULL, false FROM un""",
)
def v37(spark, sf_dir):
    _, meta, heads = heads_and_rows(spark, sf_dir)
    return _drawn(meta, heads)


def _drawn(meta, heads):
    matched = controls.matched_controls(meta, heads, CONTROL_DRAWS, CONTROL_SEED).withColumn("family", F.lit("matched"))
    uniform = controls.uniform_controls(meta, heads, CONTROL_DRAWS, CONTROL_SEED).withColumns(
        {"family": F.lit("uniform"), "code": F.lit(None).cast("bigint"), "gap": F.lit(None).cast("bigint"), "fallback": F.lit(False)}
    )
    return matched.unionByName(uniform)


@query(
    "V36_control_quantiles",
    "head:s family:s draws:i q05:d q50:d q95:d share_at_or_below:d",
    f"""WITH RECURSIVE {DRAWN_SQL}, sets AS (SELECT head || ':head:0' AS scenario, code FROM hd UNION ALL SELECT head || ':uniform:' || draw, control FROM un
      UNION ALL SELECT head || ':matched:' || draw, control FROM mt WHERE control IS NOT NULL),
    k AS (SELECT s.scenario, pr.date, REV_5, target FROM pr, (SELECT DISTINCT scenario FROM sets) s WHERE NOT EXISTS (SELECT 1 FROM sets x WHERE x.scenario = s.scenario AND x.code = pr.code)),
    q AS (SELECT *, {rank_sql('REV_5', 'scenario, date')} AS a, {rank_sql('target', 'scenario, date')} AS b FROM k),
    d AS (SELECT scenario, avg(ic) AS delta FROM (SELECT scenario, date, corr(a, b) AS ic FROM q GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY 1),
    n AS (SELECT split_part(scenario, ':', 1) AS head, split_part(scenario, ':', 2) AS family, delta - (SELECT avg(rank_ic) FROM daily) AS delta FROM d)
    SELECT c.head, c.family, count(*) AS draws, quantile_cont(c.delta, 0.05) AS q05, quantile_cont(c.delta, 0.5) AS q50, quantile_cont(c.delta, 0.95) AS q95,
      avg(CASE WHEN c.delta <= t.delta THEN 1.0 ELSE 0 END) AS share_at_or_below FROM n c JOIN n t ON t.head = c.head AND t.family = 'head' WHERE c.family <> 'head' GROUP BY 1, 2""",
)
def v36(spark, sf_dir):
    """Change of the mean daily RankIC when a head is left out, against the draws of both families left out."""
    rows, meta, heads = heads_and_rows(spark, sf_dir)
    drawn = _drawn(meta, heads).select("head", "family", F.col("draw").cast("string").alias("draw"), F.col("control").alias("code"))
    sets = drawn.unionByName(heads.select("head", F.lit("head").alias("family"), F.lit("0").alias("draw"), "code"))
    nothing = meta.limit(1).select(F.lit("all").alias("scenario"), F.lit(None).cast("bigint").alias("code"))
    cases = stored(sets.select(F.concat_ws(":", "head", "family", "draw").alias("scenario"), "code").unionByName(nothing))
    ics = stored(ev.deletion_rank_ic(rows, cases, "REV_5", "target"))
    base = ics.where(F.col("scenario") == "all").select("rank_ic").scalar()
    part = F.split("scenario", ":")
    deltas = ics.where(F.col("scenario") != "all").select(part[0].alias("head"), part[1].alias("family"), (F.col("rank_ic") - base).alias("delta"))
    targets = deltas.where(F.col("family") == "head").select("head", F.col("delta").alias("target"))
    return ev.control_quantiles(deltas.where(F.col("family") != "head"), targets)
