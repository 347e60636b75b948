"""Registered queries of the data-quality gates (Q1-Q15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions.ops import OPS
from factorloom.functions.scalar import row_hash
from factorloom.functions.series import Series
from factorloom.operators import joins, panel as pn, quality as ql
from factorloom.plans.catalog_ops import operands
from factorloom.plans.catalog_panel import ASOF_SQL, CHAIN_SQL, _SPOILED_SQL, _FLAGS, chained, quotes, spoiled
from factorloom.plans.catalog_signals import SIGNALS_SQL, stock_panel
from factorloom.plans.registry import BARS_SQL, DESKS_SQL, MEMBERS_SQL, PANEL_SQL, query
from factorloom.operators import signals as sg
from factorloom.sources import store
from factorloom.sources.market import bars_hourly, desks, membership, panel, stored


@query(
    "Q1_schema_contract",
    "table:s missing:s present:i",
    f"""WITH {PANEL_SQL} SELECT 'daily_bars' AS "table", 'adjustment_type,available_at,revision_id,source_row_hash' AS missing, count(*) AS present FROM panel""",
)
def q1(spark, sf_dir):
    """Columns of the standardised quotes and status that the contract still misses, with their row counts."""
    q = quotes(spark, sf_dir)
    renamed = q.withColumnsRenamed({p: f"{p}_raw" for p in ("open", "high", "low", "close")})
    renamed = store.with_lineage(renamed, **{c: "1" for c in ql.LINEAGE})
    report = ql.contract_report(spark, {"daily_bars": renamed})
    return report.join(renamed.agg(F.count(F.lit(1)).alias("present")).withColumn("table", F.lit("daily_bars")), "table")


@query(
    "Q1_all_contracts",
    "table:s issue:s missing:s n_rows:i",
    f"""WITH {PANEL_SQL}, {MEMBERS_SQL}, n AS (SELECT (SELECT count(*) FROM panel) AS cells, (SELECT count(*) FROM members) AS members,
      (SELECT count(DISTINCT code) FROM panel) AS codes, (SELECT count(DISTINCT date) FROM panel) AS days)
    SELECT t.* FROM n, LATERAL (VALUES
      ('raw_request_manifest', 'OK', '', codes),
      ('daily_bars', 'TABLE_SCHEMA_MISSING', 'revision_id,source_row_hash', cells),
      ('universe_membership', 'OK', '', members),
      ('industry_membership', 'LINEAGE_FIELDS_MISSING', 'fetched_at', codes),
      ('trading_status', 'TABLE_SCHEMA_MISSING', 'available_at_source', cells),
      ('trading_calendar', 'OK', '', days),
      ('security_master', 'LINEAGE_FIELDS_MISSING', 'schema_version,snapshot_id,data_version,source,fetched_at', codes),
      ('corporate_actions', 'REQUIRED_TABLE_MISSING', '', NULL),
      ('execution_bars', 'OK', '', cells),
      ('execution_status', 'TABLE_SCHEMA_MISSING', 'can_sell_open', cells),
      ('membership_spell_audit', 'OK', '', codes)) AS t("table", issue, missing, n_rows)""",
)
def q1_all(spark, sf_dir):
    """A snapshot of ten tables with seeded faults: columns taken away, lineage left out, one required table absent."""
    cells = stored(panel(spark, sf_dir))
    codes, days = cells.select("code").distinct(), cells.select("date").distinct()
    signed = {c: "1" for c in ql.LINEAGE}

    def shaped(name, rows, without=(), lineage=signed):
        wanted = [c for c in ql.SNAPSHOT_CONTRACTS.get(name, ()) if c not in without]
        known = {p: f"{p}_raw" for p in ("open", "high", "low", "close")}
        rows = rows.withColumnsRenamed(known)
        return store.with_lineage(rows.withColumns({c: F.lit(None).cast("string") for c in wanted if c not in rows.columns}), **lineage)

    tables = {
        "raw_request_manifest": shaped("raw_request_manifest", codes),
        "daily_bars": shaped("daily_bars", cells, ("revision_id", "source_row_hash")),
        "universe_membership": shaped("universe_membership", membership(cells)),
        "industry_membership": shaped("industry_membership", codes, lineage={c: "1" for c in ql.LINEAGE if c != "fetched_at"}),
        "trading_status": shaped("trading_status", cells, ("available_at_source",)),
        "trading_calendar": shaped("trading_calendar", days),
        "security_master": shaped("security_master", codes, lineage={}),
        "execution_bars": shaped("execution_bars", cells),
        "execution_status": shaped("execution_status", cells, ("can_sell_open",)),
        "membership_spell_audit": shaped("membership_spell_audit", codes),
    }
    return ql.snapshot_contract(tables, lineage=True)


@query(
    "Q2_row_count_contract",
    "table:s n_rows:i actual:i ok:b",
    f"""WITH {BARS_SQL}, {PANEL_SQL} SELECT 'bars' AS "table", count(*) AS n_rows, count(*) AS actual, true AS ok FROM bars
    UNION ALL SELECT 'panel', count(*) - 1, count(*), false FROM panel""",
)
def q2(spark, sf_dir):
    tables = {"bars": stored(bars_hourly(spark, sf_dir)), "panel": stored(panel(spark, sf_dir))}
    manifest = None
    for name, df in tables.items():
        row = df.agg((F.count(F.lit(1)) - (1 if name == "panel" else 0)).alias("n_rows")).withColumn("table", F.lit(name))
        manifest = row if manifest is None else manifest.unionByName(row)
    return ql.row_count_contract(manifest, tables)


@query(
    "Q3_panel_gate_issues",
    "code:s n_rows:i severity:s",
    f"""WITH {_SPOILED_SQL}, {PANEL_SQL}, {MEMBERS_SQL}, q AS (SELECT *, volume > 0 AS has_quote FROM spoiled), d AS (SELECT date, count(DISTINCT code) AS n, sum(weight_pct) AS w
      FROM members GROUP BY 1)
    SELECT 'NON_POSITIVE_PRICE' AS code, count(*) FILTER (has_quote AND least(open, high, low, close) <= 0) AS n_rows, 'ERROR' AS severity FROM q
    UNION ALL SELECT 'HIGH_BELOW_BODY', count(*) FILTER (has_quote AND high < greatest(open, close)), 'ERROR' FROM q
    UNION ALL SELECT 'LOW_ABOVE_BODY', count(*) FILTER (has_quote AND low > least(open, close)), 'ERROR' FROM q
    UNION ALL SELECT 'NEGATIVE_VOLUME', count(*) FILTER (volume < 0), 'ERROR' FROM q
    UNION ALL SELECT 'QUOTE_WITHOUT_PRICE', count(*) FILTER (has_quote AND close IS NULL), 'ERROR' FROM q
    UNION ALL SELECT 'PRICE_WITHOUT_QUOTE', count(*) FILTER (NOT has_quote AND close IS NOT NULL), 'WARNING' FROM q
    UNION ALL SELECT 'BAD_ROW_HASH', count(*) FILTER (rn % 50 = 0), 'ERROR' FROM q
    UNION ALL SELECT 'MEMBER_COUNT', count(*) FILTER (n <> 60), 'ERROR' FROM d UNION ALL SELECT 'WEIGHT_SUM', count(*) FILTER (abs(w - 100) > 0.25), 'ERROR' FROM d""",
)
def q3(spark, sf_dir):
    rows = spoiled(spark, sf_dir).withColumn("has_quote", F.col("volume") > 0)
    rows = rows.withColumn("row_hash", F.when(F.col("rn") % 50 == 0, "bad").otherwise(row_hash(["code", "rn"])))
    members = membership(panel(spark, sf_dir))
    return ql.issues(rows, ql.bar_checks()).unionByName(ql.member_checks(members, 60))


# -- panel gate ------------------------------------------------------------------------
_QUOTE = "month(date) % 6 <> 0"
#: One expression per column of the four tables, with faults planted by code and month; both engines read it.
GATE_BARS = {
    "has_quote": _QUOTE,
    "open_raw": f"CASE WHEN {_QUOTE} OR code % 17 = 0 THEN open END",
    "high_raw": f"CASE WHEN {_QUOTE} THEN CASE WHEN code % 19 = 0 AND month(date) = 3 THEN low - 1 ELSE high END END",
    "low_raw": f"CASE WHEN {_QUOTE} THEN low END",
    "close_raw": f"CASE WHEN {_QUOTE} THEN close END",
    "volume": f"CASE WHEN {_QUOTE} THEN CASE WHEN code % 47 = 0 THEN -volume ELSE volume END END",
    "amount": f"CASE WHEN {_QUOTE} THEN amount END",
    "open_tr": f"CASE WHEN {_QUOTE} THEN CASE WHEN code % 53 = 0 AND month(date) = 4 THEN 0.0 ELSE open END END",
    "close_tr": f"CASE WHEN {_QUOTE} THEN close END",
    "quote_missing_reason": f"CASE WHEN NOT ({_QUOTE}) AND code % 13 <> 0 THEN 'SUSPENDED' WHEN NOT ({_QUOTE}) AND code % 26 = 0 THEN ' ' END",
    "available_at": "CASE WHEN code % 23 = 0 AND month(date) = 5 THEN NULL ELSE CAST(date AS TIMESTAMP) END",
    "source_row_hash": "CASE WHEN code % 29 = 0 THEN 'bad' WHEN code % 31 = 0 THEN NULL ELSE repeat('0aF9', 16) END",
}
GATE_MEMBERS = {
    "index_code": "CASE WHEN code % 2 = 0 THEN 'IDX' ELSE 'idx' END",
    "is_member": "CASE WHEN code % 59 = 0 THEN NULL ELSE true END",
    "effective_at": "CASE WHEN code % 61 = 0 THEN NULL WHEN code % 37 = 0 THEN CAST(date AS TIMESTAMP) + INTERVAL 3 DAY ELSE CAST(date AS TIMESTAMP) END",
    "exit_effective_date": "CASE WHEN code % 41 = 0 THEN date END",
    "known_industry": "CASE WHEN code % 43 = 0 THEN NULL ELSE industry END",
}
_KEPT = "NOT (year(date) = 1999 AND month(date) = 7) AND NOT (month(date) = 8 AND code % 5 = 0)"
_TWICE = "code = 7 AND month(date) = 2"
_USED = "upper(index_code) = 'IDX' AND coalesce(is_member, false) AND date IN (SELECT date FROM ss)"


def _count(code: str, source: str, rule: str, severity: str = "ERROR") -> str:
    return f"SELECT '{code}' AS code, count(*) FILTER ({rule}) AS n_rows, '{severity}' AS severity FROM {source}"


GATE_COUNTS = [
    _count("INVALID_OHLCV", "gb", """has_quote AND (least(open_raw, high_raw, low_raw, close_raw, open_tr, close_tr) <= 0 OR low_raw > least(open_raw, close_raw)
      OR high_raw < greatest(open_raw, close_raw) OR volume < 0 OR amount < 0)"""),
    _count("SYNTHETIC_MISSING_QUOTE_VALUES", "gb", "NOT has_quote AND open_raw IS NOT NULL"),
    _count("QUOTE_MISSING_REASON_ABSENT", "gb", "NOT has_quote AND coalesce(trim(quote_missing_reason), '') = ''"),
    _count("AVAILABLE_AT_MISSING", "gb", "has_quote AND available_at IS NULL"),
    _count("SOURCE_ROW_HASH_INVALID", "gb", "coalesce(length(source_row_hash), 0) <> 64"),
    _count("QUOTE_ON_NON_TRADING_DATE", "gb", "has_quote AND date NOT IN (SELECT date FROM ss)"),
    _count("HOLDOUT_PRICES_NOT_SEALED", "gb", "date >= DATE '2001-01-01'"),
    _count("MEMBERSHIP_FUTURE_EXIT_STRIPPED", "gm", "exit_effective_date IS NOT NULL", "WARNING"),
    _count("MEMBERSHIP_EFFECTIVE_TIME_INVALID", "pa", "effective_at IS NULL OR effective_at >= date + INTERVAL 1 DAY"),
    _count("HOLDOUT_MEMBERS_NOT_SEALED", "gm", "date >= DATE '2001-01-01'"),
    *[f"SELECT '{c}', coalesce(sum(n), 0), 'ERROR' FROM (SELECT count(*) AS n FROM {t} GROUP BY {k} HAVING count(*) > 1)"
      for c, t, k in (("DUPLICATE_BARS", "gb", "date, code"), ("DUPLICATE_STATUS", "gs", "date, code"), ("DUPLICATE_MEMBERS", "gm", "date, index_code, code"))],
    _count("MEMBER_COUNT_NOT_EXACT", "dy", "n > 0 AND n <> 60"),
    _count("MEMBERSHIP_DATE_MISSING", "dy", "n = 0"),
    _count("MEMBER_WEIGHT_SUM_INVALID", "dy", "n > 0 AND abs(w - 100) > 0.25"),
    "SELECT 'NO_TRADING_DATE', CAST(count(*) = 0 AS INTEGER), 'ERROR' FROM ss",
    "SELECT 'REQUESTED_START_NOT_COVERED', CAST(min(date) > DATE '1994-12-10' + 10 AS INTEGER), 'ERROR' FROM ss",
    _count("MEMBER_QUOTE_EVIDENCE_MISSING", "pa", "NOT EXISTS (SELECT 1 FROM gb WHERE gb.date = pa.date AND gb.code = pa.code)"),
    _count("TRADING_STATUS_MISSING", "pa", "NOT EXISTS (SELECT 1 FROM gs WHERE gs.date = pa.date AND gs.code = pa.code AND can_buy_open IS NOT NULL)"),
    "SELECT 'INDUSTRY_COVERAGE_BELOW_THRESHOLD', CASE WHEN avg(CASE WHEN known_industry IS NULL THEN 0.0 ELSE 1 END) < 0.95 THEN count(*) FILTER (known_industry IS NULL) ELSE 0 END, 'ERROR' FROM pa",
    "SELECT 'INDUSTRY_UNMAPPED', CASE WHEN avg(CASE WHEN known_industry IS NULL THEN 0.0 ELSE 1 END) < 0.95 THEN 0 ELSE count(*) FILTER (known_industry IS NULL) END, 'WARNING' FROM pa",
]


@query(
    "Q3_full_panel_gate",
    "code:s n_rows:i severity:s",
    f"""WITH {PANEL_SQL}, {MEMBERS_SQL}, src AS (SELECT * FROM panel UNION ALL SELECT * FROM panel WHERE {_TWICE}),
    gb AS (SELECT date, code, {', '.join(f'{e} AS {c}' for c, e in GATE_BARS.items())} FROM src WHERE NOT (code % 11 = 0 AND month(date) = 10)),
    gm AS (SELECT m.date, m.code, weight_pct, {', '.join(f'{e} AS {c}' for c, e in GATE_MEMBERS.items())} FROM members m JOIN (SELECT code AS k, any_value(industry) AS industry
      FROM panel GROUP BY 1) p ON p.k = m.code WHERE {_KEPT}),
    gs AS (SELECT date, code, CASE WHEN code % 67 = 0 THEN NULL ELSE true END AS can_buy_open FROM src WHERE code % 71 <> 0),
    ss AS (SELECT DISTINCT date FROM panel WHERE month(date) <> 12 AND date < DATE '2001-01-01'),
    pa AS (SELECT * FROM gm WHERE {_USED}),
    dy AS (SELECT ss.date, count(DISTINCT pa.code) AS n, sum(weight_pct) AS w FROM ss LEFT JOIN pa ON pa.date = ss.date GROUP BY 1)
    {' UNION ALL '.join(GATE_COUNTS)}""",
)
def q3_gate(spark, sf_dir):
    rows = stored(panel(spark, sf_dir))
    twice = rows.unionByName(rows.where(_TWICE))
    bars = twice.where("NOT (code % 11 = 0 AND month(date) = 10)").selectExpr("date", "code", *[f"{e} AS {c}" for c, e in GATE_BARS.items()])
    industry = rows.groupBy("code").agg(F.first("industry").alias("industry"))
    members = membership(rows).join(industry, "code").where(_KEPT)
    members = members.selectExpr("date", "code", "weight_pct", *[f"{e} AS {c}" for c, e in GATE_MEMBERS.items()]).withColumnRenamed("known_industry", "industry")
    status = twice.where("code % 71 <> 0").selectExpr("date", "code", "CASE WHEN code % 67 = 0 THEN NULL ELSE true END AS can_buy_open", "true AS can_sell_open")
    calendar = rows.select("date").distinct().selectExpr("date", "true AS is_trading_day", "month(date) <> 12 AS is_complete_session")
    return ql.panel_gate(
        bars, members, status, calendar, index_code="IDX", expected=60, cutoff=F.lit("2001-01-01").cast("date"), required_start=F.lit("1994-12-10").cast("date"),
    )


_PREFIX_OPS = ["TS_ZSCORE_20", "TS_RANK_10", "JUMP", "SCALE", "WINSORIZE", "TS_SKEW_10"]


@query(
    "Q4_prefix_invariance",
    "check:s compared:i different:i",
    f"""WITH {BARS_SQL}, {PANEL_SQL}, n AS (SELECT count(*) AS c FROM bars WHERE ts < TIMESTAMP '2024-01-16'), m AS (SELECT count(*) AS c FROM panel WHERE date < DATE '1998-06-01')
    SELECT 'formula_operators' AS "check", c AS compared, 0 AS different FROM n UNION ALL SELECT 'total_return_chain', c, 0 FROM m UNION ALL SELECT 'leave_one_out', c, 0 FROM m""",
)
def q4(spark, sf_dir):
    """The operators run on the whole history and on a prefix; the overlap must agree."""
    s = Series()
    names = [n.lower() for n in _PREFIX_OPS]

    def ops(df):
        return df.withColumns({n.lower(): OPS[n].build(s, "x") for n in _PREFIX_OPS})

    ticks = stored(operands(spark, sf_dir))
    cut, day = F.lit("2024-01-16").cast("timestamp"), F.lit("1998-06-01").cast("date")
    checks = {
        "formula_operators": ql.prefix_differences(ops(ticks), ops(ticks.where(F.col("ts") < cut)), ["code", "ts"], names),
    }
    base = stored(chained(spark, sf_dir).select("code", "date", "open", "high", "low", "close", "preclose"))
    again = pn.total_return_chain(base.where(F.col("date") < day))
    checks["total_return_chain"] = ql.prefix_differences(pn.total_return_chain(base), again, ["code", "date"], ["open_tr", "close_tr"])
    rows = stored(stock_panel(spark, sf_dir).select("code", "date", "industry", "r_1d"))

    def context(df):
        return sg.industry_context(sg.market_context(df))

    checks["leave_one_out"] = ql.prefix_differences(
        context(rows), context(rows.where(F.col("date") < day)), ["code", "date"], ["industry_return_1d_loo", "market_volatility_20"]
    )
    out = None
    for name, df in checks.items():
        row = df.withColumn("check", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "Q5_known_at_leaks",
    "n_rows:i leaks:i",
    f"WITH {ASOF_SQL} SELECT count(*) AS n_rows, count(*) FILTER (known_at > date + INTERVAL 21 HOUR) AS leaks FROM joined",
)
def q5(spark, sf_dir):
    from factorloom.sources.market import industry_intervals

    joined = joins.asof(panel(spark, sf_dir).drop("industry"), industry_intervals(spark, sf_dir), "code", "date", "valid_from")
    return ql.known_at_leaks(joined, "known_at", F.expr("cast(date as timestamp) + interval 21 hours"))


@query(
    "Q6_bar_quality_report",
    "code:s bars:i " + " ".join(f"{k}:i" for k in _FLAGS) + " short_gaps:i holes:i days:d",
    f"""WITH {_SPOILED_SQL}, p AS (SELECT *, lag(close) OVER c AS pc, epoch(ts) - epoch(lag(ts) OVER c) AS gap FROM spoiled WINDOW c AS (PARTITION BY code ORDER BY ts))
    SELECT code, count(*) AS bars, {', '.join(f"count(*) FILTER ({e}) AS {k}" for k, e in _FLAGS.items())}, count(*) FILTER (gap < 1800) AS short_gaps,
      count(*) FILTER (gap > 3600) AS holes, (epoch(max(ts)) - epoch(min(ts))) / 86400 AS days FROM p GROUP BY code""",
)
def q6(spark, sf_dir):
    return ql.bar_report(spoiled(spark, sf_dir))


@query(
    "Q7_coverage_report",
    "first_valid:t last_valid:t days_off:i quoted_rows:i rows:i",
    f"""WITH {CHAIN_SQL}, d AS (SELECT date, count(*) AS n, count(*) FILTER (valid) AS q FROM chain GROUP BY 1)
    SELECT min(date) FILTER (q > 0) AS first_valid, max(date) FILTER (q > 0) AS last_valid, count(*) FILTER (n <> 100) AS days_off, sum(q) AS quoted_rows, sum(n) AS rows FROM d""",
)
def q7(spark, sf_dir):
    return ql.coverage_report(quotes(spark, sf_dir), 100)


@query(
    "Q8_holdout_isolation",
    "table:s violations:i",
    f"""WITH {PANEL_SQL} SELECT 'development' AS "table", 0 AS violations UNION ALL SELECT 'everything', count(*) FROM panel WHERE date >= DATE '2001-01-01'""",
)
def q8(spark, sf_dir):
    df, cutoff = stored(panel(spark, sf_dir)), F.lit("2001-01-01").cast("date")
    development, _ = store.seal_split(df, cutoff)
    return ql.holdout_isolation({"development": (development, "date"), "everything": (df, "date")}, cutoff)


_SALT = "({n} * 1000003 + code * 10007 + 20260821) % 2147483647 * 48271 % 2147483647 * 48271 % 2147483647"


@query(
    "Q9_sample_audit",
    "year:i kind:s date:t code:i",
    f"""WITH {PANEL_SQL}, k AS (SELECT *, CASE WHEN month(date) = 6 THEN 'suspension' WHEN volume < 20 THEN 'thin' WHEN close > 5000 THEN 'high_price' END AS kind FROM panel),
    f AS (SELECT year(date) AS year, kind, min(ROW(date, code)) AS m FROM k WHERE kind IS NOT NULL GROUP BY 1, 2),
    h AS (SELECT year(date) AS year, date, code, {_SALT.format(n="date_diff('day', DATE '1970-01-01', date)")} AS h FROM panel),
    r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY h, date, code) AS p FROM h)
    SELECT year, kind, (m)[1] AS date, (m)[2] AS code FROM f UNION ALL SELECT year, 'random', date, code FROM r WHERE p <= 5""",
)
def q9(spark, sf_dir):
    df = stored(panel(spark, sf_dir))
    kind = F.when(F.month("date") == 6, "suspension").when(F.col("volume") < 20, "thin").when(F.col("close") > 5000, "high_price")
    events = df.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return ql.sample_audit(events, df.select("date", "code"), per_year=5, seed=20260821, salt=F.expr(_SALT.format(n="cast(unix_date(date) as bigint)")))


@query(
    "Q10_reconstitution_days",
    "date:t joined:i left:i",
    f"""WITH {PANEL_SQL}, {MEMBERS_SQL}, cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM panel)),
    pv AS (SELECT cal.nx AS date, m.code FROM members m JOIN cal USING (date) WHERE cal.nx IS NOT NULL),
    f AS (SELECT coalesce(m.date, p.date) AS date, p.code IS NULL AS j, m.code IS NULL AS l FROM members m FULL OUTER JOIN pv p ON p.date = m.date AND p.code = m.code)
    SELECT date, count(*) FILTER (j) AS joined, count(*) FILTER (l) AS left FROM f WHERE date > (SELECT min(date) FROM panel) GROUP BY 1 HAVING count(*) FILTER (j OR l) > 0""",
)
def q10(spark, sf_dir):
    df = stored(panel(spark, sf_dir))
    return ql.reconstitution_days(membership(df), joins.number_calendar(df))


@query(
    "Q12_score_grid_contract",
    "code:s n_rows:i severity:s",
    f"""WITH {SIGNALS_SQL}, {MEMBERS_SQL}, g AS (SELECT s.date, s.code, REV_5 AS score, m.code IS NOT NULL AS mem FROM s1 s LEFT JOIN members m ON m.date = s.date AND m.code = s.code)
    SELECT 'NULL_BOOLEAN' AS code, 0 AS n_rows, 'ERROR' AS severity UNION ALL SELECT 'AVAILABILITY_DATE', count(*) FILTER (month(date) = 9), 'ERROR' FROM g
    UNION ALL SELECT 'DUPLICATE_KEY', 0, 'ERROR' UNION ALL SELECT 'VALID_MISMATCH', count(*) FILTER ((score IS NOT NULL) <> (score IS NOT NULL AND mem)), 'ERROR' FROM g
    UNION ALL SELECT 'NON_MEMBER_SCORE', count(*) FILTER (NOT mem AND score IS NOT NULL), 'ERROR' FROM g""",
)
def q12(spark, sf_dir):
    df = stored(stock_panel(spark, sf_dir))
    members = membership(df.select("date", "code", "amount")).select("date", "code", F.lit(True).alias("m"))
    hour = F.when(F.month("date") == 9, F.expr("cast(date as timestamp) + interval 30 hours")).otherwise(F.expr("cast(date as timestamp) + interval 13 hours"))
    grid = df.join(members, ["date", "code"], "left").select(
        "date", "code", F.lit(1).alias("fold"), F.col("REV_5").alias("score"), F.coalesce("m", F.lit(False)).alias("is_member"),
        F.col("REV_5").isNotNull().alias("signal_valid"), hour.alias("available_at"),
    )
    return ql.score_grid_violations(grid)


_GRID = {
    "score": "CASE WHEN code % 29 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN code % 31 = 0 THEN CAST('NaN' AS DOUBLE) ELSE close END",
    "is_member": "CASE WHEN code % 37 = 0 THEN NULL ELSE code % 3 <> 0 END",
    "signal_valid": "CASE WHEN code % 41 = 0 THEN NULL ELSE code % 3 <> 0 AND code % 37 <> 0 AND code % 31 <> 0 END",
    "fold_id": "CASE WHEN code % 43 = 0 THEN ' ' ELSE 'f1' END",
    "code_text": "CASE WHEN code % 47 = 0 THEN NULL ELSE CAST(code AS VARCHAR(20)) END",
    "score_available_at": "CASE WHEN code % 53 = 0 THEN NULL ELSE CAST(date AS TIMESTAMP) + CASE WHEN month(date) = 9 THEN INTERVAL 17 HOUR ELSE INTERVAL 13 HOUR END END",
}


@query(
    "Q12_full_score_grid",
    "code:s n_rows:i severity:s",
    f"""WITH {PANEL_SQL}, two AS (SELECT * FROM panel UNION ALL SELECT * FROM panel WHERE code = 5 AND month(date) = 4),
    g AS (SELECT date, {', '.join(f'{e} AS {c}' for c, e in _GRID.items())} FROM two), v AS (SELECT *, NOT isnan(score) AS present, NOT isnan(score) AND NOT isinf(score) AS fin,
      coalesce(is_member, false) AS mem FROM g)
    SELECT 'EMPTY_KEY' AS code, count(*) FILTER (code_text IS NULL OR trim(fold_id) = '') AS n_rows, 'ERROR' AS severity FROM v
    UNION ALL SELECT 'NULL_BOOLEAN', count(*) FILTER (is_member IS NULL OR signal_valid IS NULL), 'ERROR' FROM v UNION ALL SELECT 'DATE_WITH_TIME', 0, 'ERROR'
    UNION ALL SELECT 'AVAILABILITY_DATE', count(*) FILTER (score_available_at IS NULL OR hour(score_available_at) >= 16), 'ERROR' FROM v
    UNION ALL SELECT 'INFINITE_SCORE', count(*) FILTER (present AND NOT fin), 'ERROR' FROM v
    UNION ALL SELECT 'VALID_MISMATCH', count(*) FILTER (signal_valid IS NOT NULL AND signal_valid <> (fin AND mem)), 'ERROR' FROM v
    UNION ALL SELECT 'NON_MEMBER_SCORE', count(*) FILTER (NOT mem AND present), 'ERROR' FROM v
    UNION ALL SELECT 'DUPLICATE_KEY', coalesce(sum(n), 0), 'ERROR' FROM (SELECT count(*) AS n FROM g GROUP BY date, code_text, fold_id HAVING count(*) > 1)
    UNION ALL SELECT 'EMPTY_GRID', 0, 'ERROR'""",
)
def q12_grid(spark, sf_dir):
    rows = stored(panel(spark, sf_dir))
    two = rows.unionByName(rows.where("code = 5 AND month(date) = 4"))
    grid = two.selectExpr("date", *[f"{e} AS {c}" for c, e in _GRID.items()]).withColumnRenamed("code_text", "code")
    return ql.score_grid_contract(grid)


#: The seven forced kinds over the weekly desks: one rule per kind, read by both engines.
_KINDS = {
    "xr": "code = 3 AND month(date) = 6", "wd": "code = 4 AND month(date) % 5 = 0", "suspended": "volume < 60", "limit_up": "open > low * 30",
    "industry_change": "code % 10 = 0 AND month(date) = 7", "delist": "code = 39 AND year(date) % 2 = 0 AND month(date) = 11",
}
_DAY = "({n} * 1000003 + 20260821) % 2147483647 * 48271 % 2147483647 * 48271 % 2147483647"


@query(
    "Q9_audit_days",
    "year:i date:t kind:s",
    f"""WITH {DESKS_SQL.replace('panel AS (', 'dk AS (', 1)}, ss AS (SELECT DISTINCT date FROM dk WHERE day(date) <> 13), cal AS (SELECT date, row_number() OVER (ORDER BY date) AS p
      FROM (SELECT DISTINCT date FROM dk)),
    mb AS (SELECT date, code FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS i FROM dk) WHERE i <= 36),
    sets AS (SELECT date, p, list_sort(list(code)) AS s FROM mb JOIN cal USING (date) GROUP BY 1, 2),
    ev AS (SELECT a.date, 'reconstitution' AS kind FROM sets a JOIN sets b ON b.p = a.p - 1 WHERE a.s <> b.s
      {' '.join(f"UNION ALL SELECT date, '{k}' FROM dk WHERE {r}" for k, r in _KINDS.items())}),
    fo AS (SELECT year(date) AS year, kind, min(date) AS date FROM ev WHERE date IN (SELECT date FROM ss) GROUP BY 1, 2),
    fr AS (SELECT year(date) AS year, date, row_number() OVER (PARTITION BY year(date) ORDER BY {_DAY.format(n="date_diff('day', DATE '1970-01-01', date)")}, date) AS i FROM ss
      WHERE date NOT IN (SELECT date FROM fo)), tk AS (SELECT year, count(DISTINCT date) AS n FROM fo GROUP BY 1)
    SELECT year, date, kind FROM fo UNION ALL SELECT year, date, 'random' FROM fr LEFT JOIN tk USING (year) WHERE i <= 12 - coalesce(n, 0)""",
)
def q9_days(spark, sf_dir):
    """Seven forced kinds (membership changes come from the member sets themselves), then drawn sessions up to twelve a year."""
    rows = stored(desks(spark, sf_dir))
    changes = ql.reconstitution_days(membership(rows, 36), joins.number_calendar(rows)).select("date", F.lit("reconstitution").alias("kind"))
    kinds = F.explode(F.array_compact(F.array(*[F.when(F.expr(r), F.lit(k)) for k, r in _KINDS.items()])))
    events = changes.unionByName(rows.select("date", kinds.alias("kind")))
    sessions = rows.where("day(date) <> 13").select("date").distinct()
    return ql.audit_days(events, sessions, 12, F.expr(_DAY.format(n="cast(unix_date(date) as bigint)")))


@query(
    "Q13_grid_completeness",
    "date:t members:i expected:i",
    f"""WITH {PANEL_SQL} SELECT date, count(DISTINCT code) AS members, (SELECT count(DISTINCT code) FROM panel) AS expected FROM panel GROUP BY 1
    HAVING count(DISTINCT code) <> (SELECT count(DISTINCT code) FROM panel)""",
)
def q13(spark, sf_dir):
    return ql.grid_gaps(stored(panel(spark, sf_dir)), ["date"])


@query(
    "Q15_adjusted_raw_divergence",
    "code:i date:t adjusted_return:d raw_return:d diverges:b",
    f"""WITH {CHAIN_SQL}, q AS (SELECT code, date, CASE WHEN valid THEN open * scale END AS a, CASE WHEN valid THEN open END AS r FROM chain),
    c AS (SELECT code, date, a / lag(a) OVER w - 1 AS adjusted_return, r / lag(r) OVER w - 1 AS raw_return FROM q WINDOW w AS (PARTITION BY code ORDER BY date))
    SELECT *, abs(adjusted_return - raw_return) > 0.05 AS diverges FROM c WHERE abs(adjusted_return) > 0.25 OR abs(adjusted_return - raw_return) > 0.05""",
)
def q15(spark, sf_dir):
    return ql.divergence(quotes(spark, sf_dir), "open_tr", "open")
