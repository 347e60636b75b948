"""Registered queries of the retention gate and the ranking of accepted candidates on measured inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import evaluate as ev, retention as rt
from factorloom.plans.catalog_backtest import STRATEGIES
from factorloom.plans.catalog_eval import DRAWS, METRICS_SQL, _CLIP, boot_sql, metrics, stored_candidates
from factorloom.plans.registry import query
from factorloom.session import checkpointed

FOLDS, BLOCK, SEED = 4, 3, 23


def _ranks(keys: str) -> str:
    return (
        f"rank() OVER (PARTITION BY {keys} ORDER BY factor) + (count(*) OVER (PARTITION BY {keys}, factor) - 1) / 2.0 AS rx, "
        f"rank() OVER (PARTITION BY {keys} ORDER BY ret) + (count(*) OVER (PARTITION BY {keys}, ret) - 1) / 2.0 AS ry"
    )


_SHARPE = "avg({x}) / (stddev_pop({x}) + 1e-8) * sqrt(6240)"
NAMES = [f"s_{n}" for n in STRATEGIES]
GATE_SQL = f"""{METRICS_SQL}, cf AS (SELECT *, (rn - 1) * {FOLDS} // bars AS fold, CAST(ts AS DATE) AS day, sum(pos) OVER a AS ps, sum(pnl) OVER a AS gs, count(*) OVER a AS k
  FROM cand WINDOW a AS (PARTITION BY code, ts)),
sd0 AS (SELECT strategy, sign(rank_ic) AS side FROM metrics),
fr AS (SELECT *, {_ranks('strategy, fold, code')} FROM cf),
fi AS (SELECT strategy, fold, avg(ic) AS ic FROM (SELECT strategy, fold, code, corr(rx, ry) AS ic FROM fr GROUP BY 1, 2, 3) GROUP BY 1, 2),
fdr AS (SELECT strategy, avg(CASE WHEN sign(ic) = side THEN 1.0 ELSE 0 END) AS fold_direction_ratio FROM fi JOIN sd0 USING (strategy) GROUP BY 1),
sg0 AS (SELECT strategy, 'code:' || code AS segment, factor, ret FROM cf UNION ALL SELECT strategy, 'day:' || (dayofweek(ts) + 1), factor, ret FROM cf),
sg1 AS (SELECT *, {_ranks('strategy, segment')} FROM sg0), sg2 AS (SELECT strategy, segment, corr(rx, ry) AS ic FROM sg1 GROUP BY 1, 2 HAVING count(*) >= 20),
sdr AS (SELECT strategy, avg(CASE WHEN sign(ic) = side THEN 1.0 ELSE 0 END) AS segment_direction_ratio FROM sg2 JOIN sd0 USING (strategy) GROUP BY 1),
in0 AS (SELECT strategy, fold, avg(d) AS d FROM (SELECT strategy, fold, code, corr(ps / k, ret) - corr((ps - pos) / (k - 1), ret) AS d FROM cf GROUP BY 1, 2, 3) GROUP BY 1, 2),
inc AS (SELECT strategy, avg(d) AS increment, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0 END) AS increment_fold_ratio FROM in0 GROUP BY 1),
pd0 AS (SELECT strategy, ts, avg(gs / k) AS a, avg((gs - pnl) / (k - 1)) AS b FROM cf GROUP BY 1, 2),
pdl AS (SELECT strategy, {_SHARPE.format(x='a')} - {_SHARPE.format(x='b')} AS portfolio_delta FROM pd0 GROUP BY 1),
dr AS (SELECT *, {_ranks('strategy, day')} FROM cf), di AS (SELECT strategy, day, corr(rx, ry) AS ic FROM dr GROUP BY 1, 2 HAVING count(*) >= 10),
wd AS (SELECT day, {', '.join(f"max(ic) FILTER (strategy = '{n}') AS {n}" for n in NAMES)} FROM di GROUP BY 1),
se AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS position FROM wd WHERE {' AND '.join(f'{n} IS NOT NULL' for n in NAMES)}), {boot_sql('se', BLOCK, DRAWS, SEED)},
st AS (SELECT draw, {', '.join(f'avg({n}) AS {n}' for n in NAMES)} FROM draws JOIN se USING (position) WHERE slot < n GROUP BY draw),
ci AS ({' UNION ALL '.join(f"SELECT '{n}' AS strategy, quantile_cont({n}, 0.025) AS lo, quantile_cont({n}, 0.975) AS hi FROM st" for n in NAMES)}),
mr AS (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY factor) - 1 + (count(*) OVER (PARTITION BY strategy, factor) - 1) / 2.0 AS r0, count(*) OVER (PARTITION BY strategy) AS tt FROM cand),
mb AS (SELECT strategy, least(4, CAST(floor(r0 * 5 / tt) AS BIGINT)) AS bucket, avg(ret) AS mt FROM mr GROUP BY 1, 2),
mg2 AS (SELECT strategy, round(abs(corr(rr, bucket)), 12) AS monotonicity FROM (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY mt) AS rr FROM mb) GROUP BY 1),
real AS (SELECT m.* EXCLUDE (ci_low, ci_high), ci.lo AS ci_low, ci.hi AS ci_high, fold_direction_ratio, segment_direction_ratio, increment, increment_fold_ratio, portfolio_delta, monotonicity
  FROM metrics m JOIN fdr USING (strategy) JOIN sdr USING (strategy) JOIN inc USING (strategy) JOIN pdl USING (strategy) JOIN ci USING (strategy) JOIN mg2 USING (strategy))"""

_RULES = [
    ("INVALID_FORMULA", "coverage > 0"), ("COVERAGE", "coverage >= 0.95"), ("RANK_IC", "abs(rank_ic) >= 0.005"), ("ICIR", "abs(icir) >= 0.05"),
    ("RANK_ICIR", "abs(rank_icir) >= 0.05"), ("BOOTSTRAP_CROSSES_ZERO", "NOT (ci_low <= 0 AND ci_high >= 0)"), ("DIRECTION", "direction_ratio >= 0.60"),
    ("FOLD_DIRECTION", "fold_direction_ratio >= 0.75"), ("NO_INCREMENT", "increment > 0"), ("INCREMENT_FOLDS", "increment_fold_ratio >= 0.75"),
    ("CORRELATED", "NOT (max_correlation >= 0.80 AND increment < 0.003)"), ("NET_SHARPE", "net_sharpe >= -0.25"), ("MONOTONICITY", "monotonicity >= 0.50"),
    ("SEGMENTS", "segment_direction_ratio >= 0.60"), ("PORTFOLIO_WORSE", "portfolio_delta >= -1e-12"),
]
_REASONS = f"concat_ws(';', {', '.join(f'''CASE WHEN NOT coalesce({r}, false) THEN '{n}' END''' for n, r in _RULES)})"


def measured(spark, sf_dir):
    """One row per strategy with every input of the gate computed from the candidate rows themselves."""
    rows = stored_candidates(spark, sf_dir, ("rn", "bars"))
    base = checkpointed(metrics(rows).drop("ci_low", "ci_high"))
    mono = ev.group_returns(rows, ["strategy"], "factor", "ret").groupBy("strategy").agg(F.max("monotonicity").alias("monotonicity"))
    parts = [
        rt.fold_direction(rows, base), rt.segment_direction(rows, base), rt.increments(rows, FOLDS), rt.daily_interval(rows, NAMES, BLOCK, DRAWS, SEED), mono,
    ]
    for part in parts:
        base = base.join(part, "strategy")
    df = base.withColumn("valid", F.col("coverage") > 0).withColumn("_failed", ev.failed_checks(ev.retention_checks()))
    return checkpointed(df.withColumns({"accepted": F.size("_failed") == 0, "reasons": F.concat_ws(";", "_failed")}))


@query(
    "V17_retention_on_measured_inputs",
    "strategy:s fold_direction_ratio:d segment_direction_ratio:d increment:d increment_fold_ratio:d portfolio_delta:d ci_low:d ci_high:d accepted:b reasons:s",
    f"WITH {GATE_SQL}, f AS (SELECT *, {_REASONS} AS reasons FROM real) SELECT *, reasons = '' AS accepted FROM f",
)
def v17(spark, sf_dir):
    return measured(spark, sf_dir)


@query(
    "V18_ranking_of_accepted",
    "strategy:s n_reasons:i eligible:b ranking:d place:i",
    f"""WITH {GATE_SQL}, t AS (SELECT strategy, avg(turnover) AS turnover FROM (SELECT strategy, abs(pos - coalesce(lag(pos) OVER (PARTITION BY strategy, code ORDER BY ts), 0.0))
      AS turnover, rn, bars FROM numbered) WHERE rn <= bars - 2 GROUP BY 1), f AS (SELECT *, {_REASONS} AS reasons FROM real),
    g AS (SELECT *, CASE WHEN reasons = '' THEN 0 ELSE len(string_split(reasons, ';')) END AS n_reasons FROM f),
    e AS (SELECT g.*, turnover, n_reasons <= 5 AS eligible FROM g JOIN t USING (strategy)),
    s AS (SELECT strategy, n_reasons, eligible, CASE WHEN eligible THEN 0.25 * {_CLIP.format(x='abs(rank_icir)')} + 0.2 * {_CLIP.format(x='abs(icir)')} + 0.25 * {_CLIP.format(x='increment / 0.03')}
      + 0.2 * {_CLIP.format(x='net_sharpe / 2')} + 0.1 * {_CLIP.format(x='direction_ratio')} - 0.1 * max_correlation - 0.05 * least(1, turnover) - 0.03 * 3 / 16 END AS ranking FROM e)
    SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY ranking DESC, strategy) END AS place FROM s""",
)
def v18(spark, sf_dir):
    """Only eligible candidates are ranked; the fixture lets up to five failed rules pass, so that some are."""
    df = measured(spark, sf_dir).withColumns({"n_reasons": F.size("_failed"), "operators": F.lit(3)}).withColumn("eligible", F.col("n_reasons") <= 5)
    return ev.ranked_candidates(df, F.col("eligible"))
