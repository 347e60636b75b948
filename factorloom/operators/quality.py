"""Data-quality gates (Q1-Q15): every check is a small aggregated DataFrame of violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.session import stored

LINEAGE = ("schema_version", "snapshot_id", "data_version", "source", "fetched_at")

# Required columns of the standardised tables.
CONTRACTS = {
    "daily_bars": (
        "date code open_raw high_raw low_raw close_raw volume amount preclose open_tr high_tr low_tr close_tr "
        "adjustment_type available_at has_quote quote_missing_reason revision_id source_row_hash"
    ).split(),
    "universe_membership": (
        "date index_code code is_member weight_pct effective_at known_at available_at entry_effective_date "
        "known_at_source membership_source source_request_id"
    ).split(),
    "industry_membership": (
        "code valid_from industry_system industry_code industry_name level valid_to effective_at known_at known_at_source"
    ).split(),
    "trading_status": (
        "date code is_suspended is_st is_xr is_wd can_buy_open can_sell_open limit_up_price limit_down_price preclose "
        "buy_block_reason sell_block_reason available_at"
    ).split(),
    "trading_calendar": "date market is_trading_day is_complete_session session_open session_close available_at".split(),
    "security_master": "code name exchange security_type board list_date delist_date valid_from valid_to known_at".split(),
    "corporate_actions": (
        "action_id code action_type announcement_at known_at record_date ex_date payment_date effective_at cash_dividend "
        "stock_dividend_ratio rights_ratio rights_price raw_payload_hash"
    ).split(),
    "membership_spell_audit": "code spell_id entry_effective_date realized_exit_date censored_at_snapshot_end".split(),
}


# Tables a published snapshot must hold, and the columns its gate requires of each.
REQUIRED_TABLES = (
    "raw_request_manifest daily_bars universe_membership industry_membership trading_status trading_calendar "
    "security_master corporate_actions"
).split()
SNAPSHOT_CONTRACTS = {
    "daily_bars": (
        "date code open_raw high_raw low_raw close_raw volume amount preclose open_tr close_tr adjustment_type available_at "
        "available_at_source has_quote quote_missing_reason revision_id source_row_hash"
    ).split(),
    "universe_membership": (
        "date index_code code is_member weight_pct effective_at known_at known_at_source entry_effective_date "
        "membership_source source_request_id"
    ).split(),
    "industry_membership": CONTRACTS["industry_membership"],
    "trading_status": [*CONTRACTS["trading_status"][:-1], "available_at", "available_at_source"],
    "trading_calendar": CONTRACTS["trading_calendar"],
    "security_master": CONTRACTS["security_master"],
    "corporate_actions": [*CONTRACTS["corporate_actions"], "known_at_source"],
    "execution_bars": (
        "date code open_raw high_raw low_raw close_raw volume amount preclose open_tr close_tr has_quote quote_missing_reason"
    ).split(),
    "execution_status": "date code can_buy_open can_sell_open".split(),
    "membership_spell_audit": CONTRACTS["membership_spell_audit"],
}


def snapshot_contract(tables: Mapping[str, DataFrame], lineage: bool) -> DataFrame:
    """Q1: (table, issue, missing, n_rows) of every table of a snapshot, the required ones that are absent included.

    Only the first fault of a table is named: it is absent, required columns are missing, or (for snapshots that
    promise lineage) lineage columns are missing; ``OK`` otherwise.  Rows are counted by scans without columns.
    """
    spark = next(iter(tables.values())).sparkSession
    verdicts = []
    for name in [*REQUIRED_TABLES, *sorted(set(tables) - set(REQUIRED_TABLES))]:
        columns = set(tables[name].columns) if name in tables else set()
        missing = sorted(set(SNAPSHOT_CONTRACTS.get(name, ())) - columns)
        unsigned = [c for c in LINEAGE if c not in columns] if lineage else []
        if name not in tables:
            verdicts.append((name, "REQUIRED_TABLE_MISSING", ""))
        elif missing:
            verdicts.append((name, "TABLE_SCHEMA_MISSING", ",".join(missing)))
        elif unsigned:
            verdicts.append((name, "LINEAGE_FIELDS_MISSING", ",".join(unsigned)))
        else:
            verdicts.append((name, "OK", ""))
    report = spark.createDataFrame(verdicts, "table string, issue string, missing string")
    counts = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table", F.lit(name))
        counts = row if counts is None else counts.unionByName(row)
    return report.join(counts, "table", "left")


def contract(df: DataFrame, table: str, lineage: bool = True) -> list[str]:
    """Q1: required columns that are missing (metadata only, no job)."""
    return [c for c in [*CONTRACTS[table], *(LINEAGE if lineage else ())] if c not in df.columns]


def row_count_contract(manifest: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Q2: manifest rows next to the actual rows; the counts are metadata-only scans."""
    actual = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("actual")).withColumn("table", F.lit(name))
        actual = row if actual is None else actual.unionByName(row)
    joined = manifest.join(actual, "table", "full_outer")
    return joined.withColumn("ok", F.coalesce(F.col("n_rows") == F.col("actual"), F.lit(False)))


def issues(df: DataFrame, checks: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Q3: one pass over ``df`` that counts the rows of every check; severity is a label."""
    counted = df.agg(*[F.count(F.when(rule, 1)).alias(name) for name, (rule, _) in checks.items()])
    rows = [
        F.struct(F.lit(name).alias("code"), F.col(name).alias("n_rows"), F.lit(severity).alias("severity"))
        for name, (_, severity) in checks.items()
    ]
    return counted.select(F.inline(F.array(*rows)))


def bar_checks() -> dict[str, tuple[Column, str]]:
    """Price and hash rules of the panel gate."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    quoted = F.col("has_quote")
    return {
        "NON_POSITIVE_PRICE": (quoted & ((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)), "ERROR"),
        "HIGH_BELOW_BODY": (quoted & (h < F.greatest(o, c)), "ERROR"),
        "LOW_ABOVE_BODY": (quoted & (l > F.least(o, c)), "ERROR"),
        "NEGATIVE_VOLUME": (v < 0, "ERROR"),
        "QUOTE_WITHOUT_PRICE": (quoted & c.isNull(), "ERROR"),
        "PRICE_WITHOUT_QUOTE": (~quoted & c.isNotNull(), "WARNING"),
        "BAD_ROW_HASH": (~F.coalesce(F.col("row_hash").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "ERROR"),
    }


def member_checks(members: DataFrame, expected: int, tolerance: float = 0.25) -> DataFrame:
    """Q3: dates with a wrong number of members or a weight sum off 100."""
    days = members.groupBy("date").agg(F.countDistinct("code").alias("n"), F.sum("weight_pct").alias("w"))
    return issues(
        days,
        {
            "MEMBER_COUNT": (F.col("n") != expected, "ERROR"),
            "WEIGHT_SUM": (F.abs(F.col("w") - 100) > tolerance, "ERROR"),
        },
    )


def observed_issues(df: DataFrame, checks: Mapping[str, tuple[Column, str]], name: str) -> tuple[DataFrame, DataFrame]:
    """Q3: write ``df`` to the shared folder and count the rows of every check in the same scan; (table, issues).

    The counts ride on the write as observed metrics, so the gate costs no pass of its own.
    """
    seen = Observation(f"{name} gate")
    table = stored(df.observe(seen, *[F.count(F.when(rule, 1)).alias(code) for code, (rule, _) in checks.items()]), name)
    rows = [(code, int(seen.get[code]), severity) for code, (_, severity) in checks.items()]
    return table, df.sparkSession.createDataFrame(rows, "code string, n_rows bigint, severity string")


def repeated_keys(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """Rows whose key occurs more than once; counts are combined before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return counts.agg(F.lit(code).alias("code"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.lit("ERROR").alias("severity"))


#: Fixed value: least share of member rows with an industry.
INDUSTRY_COVERAGE = 0.95


def panel_gate(
    bars: DataFrame, members: DataFrame, status: DataFrame, calendar: DataFrame, *, index_code: str, expected: int, cutoff: Column,
    required_start: Column, coverage: float = INDUSTRY_COVERAGE, tolerance: float = 0.25,
) -> DataFrame:
    """Q3: (code, n_rows, severity) of the 21 checks of the panel gate, those without a violation included.

    ``members`` carries the industry known at its date.  Every table is written once beside its row checks; checks
    per session work on one row per date, and a member row meets the other tables by (date, code).
    """
    sessions = stored(calendar.where(F.coalesce("is_trading_day", F.lit(False)) & F.coalesce("is_complete_session", F.lit(False)) & (F.col("date") < cutoff)).select("date").distinct(), "sessions")
    marked = bars.join(sessions.withColumn("_open", F.lit(True)), "date", "left")
    quoted = F.coalesce("has_quote", F.lit(False))
    o, h, l, c = (F.col(f"{x}_raw") for x in ("open", "high", "low", "close"))
    numbers = ["open_raw", "high_raw", "low_raw", "close_raw", "volume", "amount", "open_tr", "close_tr"]
    broken = F.least(o, h, l, c, F.col("open_tr"), F.col("close_tr")) <= 0
    broken = broken | (l > F.least(o, c)) | (h < F.greatest(o, c)) | (F.least("volume", "amount") < 0)
    bar_rules = {
        "INVALID_OHLCV": (quoted & broken, "ERROR"),
        "SYNTHETIC_MISSING_QUOTE_VALUES": (~quoted & F.coalesce(*[F.col(n).cast("double") for n in numbers]).isNotNull(), "ERROR"),
        "QUOTE_MISSING_REASON_ABSENT": (~quoted & (F.trim(F.coalesce("quote_missing_reason", F.lit(""))) == ""), "ERROR"),
        "AVAILABLE_AT_MISSING": (quoted & F.col("available_at").isNull(), "ERROR"),
        "SOURCE_ROW_HASH_INVALID": (~F.coalesce(F.col("source_row_hash").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "ERROR"),
        "QUOTE_ON_NON_TRADING_DATE": (quoted & F.col("_open").isNull(), "ERROR"),
        "HOLDOUT_PRICES_NOT_SEALED": (F.col("date") >= cutoff, "ERROR"),
    }
    bars, out = observed_issues(marked, bar_rules, "gate_bars")
    own = (F.upper("index_code") == index_code) & F.coalesce("is_member", F.lit(False))
    used = own & F.col("_open").isNotNull()
    late = F.col("effective_at").isNull() | (F.col("effective_at").cast("date") > F.col("date"))
    member_rules = {
        "MEMBERSHIP_FUTURE_EXIT_STRIPPED": (F.col("exit_effective_date").isNotNull(), "WARNING"),
        "MEMBERSHIP_EFFECTIVE_TIME_INVALID": (used & late, "ERROR"),
        "HOLDOUT_MEMBERS_NOT_SEALED": (F.col("date") >= cutoff, "ERROR"),
    }
    table, found = observed_issues(members.join(sessions.withColumn("_open", F.lit(True)), "date", "left"), member_rules, "gate_members")
    out = out.unionByName(found)
    out = out.unionByName(repeated_keys(bars, ["date", "code"], "DUPLICATE_BARS")).unionByName(repeated_keys(status, ["date", "code"], "DUPLICATE_STATUS"))
    out = out.unionByName(repeated_keys(table, ["date", "index_code", "code"], "DUPLICATE_MEMBERS"))
    panel = table.where(used).drop("exit_effective_date", "_open")
    days = sessions.join(panel.groupBy("date").agg(F.countDistinct("code").alias("n"), F.sum("weight_pct").alias("w")), "date", "left")
    off = F.col("n").isNotNull() & ~F.coalesce(F.abs(F.col("w") - 100) <= tolerance, F.lit(False))
    day_rules = {
        "MEMBER_COUNT_NOT_EXACT": (F.col("n") != expected, "ERROR"),
        "MEMBERSHIP_DATE_MISSING": (F.col("n").isNull(), "ERROR"),
        "MEMBER_WEIGHT_SUM_INVALID": (off, "ERROR"),
    }
    out = out.unionByName(issues(days, day_rules))
    start = sessions.agg(F.min("date").alias("first"))
    calendar_rules = {
        "NO_TRADING_DATE": (F.col("first").isNull(), "ERROR"),
        "REQUESTED_START_NOT_COVERED": (F.col("first") > F.date_add(required_start, 10), "ERROR"),
    }
    out = out.unionByName(issues(start, calendar_rules))
    evidence = bars.groupBy("date", "code").agg(F.lit(True).alias("_quote"))
    known = status.groupBy("date", "code").agg(F.min("can_buy_open").alias("_buy"), F.min("can_sell_open").alias("_sell"))
    joined = panel.join(evidence, ["date", "code"], "left").join(known, ["date", "code"], "left")
    unmapped = joined.agg(F.count(F.lit(1)).alias("_rows"), F.count(F.when(F.col("industry").isNull(), 1)).alias("_none"), F.count(F.when(F.col("_quote").isNull(), 1)).alias("_q"),
                          F.count(F.when(F.col("_buy").isNull() | F.col("_sell").isNull(), 1)).alias("_s"))
    below = 1 - F.col("_none") / F.greatest(F.col("_rows"), F.lit(1)) < coverage
    rows = F.array(
        F.struct(F.lit("MEMBER_QUOTE_EVIDENCE_MISSING").alias("code"), F.col("_q").alias("n_rows"), F.lit("ERROR").alias("severity")),
        F.struct(F.lit("TRADING_STATUS_MISSING").alias("code"), F.col("_s").alias("n_rows"), F.lit("ERROR").alias("severity")),
        F.struct(F.lit("INDUSTRY_COVERAGE_BELOW_THRESHOLD").alias("code"), F.when(below, F.col("_none")).otherwise(0).alias("n_rows"), F.lit("ERROR").alias("severity")),
        F.struct(F.lit("INDUSTRY_UNMAPPED").alias("code"), F.when(below, 0).otherwise(F.col("_none")).alias("n_rows"), F.lit("WARNING").alias("severity")),
    )
    return out.unionByName(unmapped.select(F.inline(rows)))


def prefix_differences(full: DataFrame, prefix: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Q4: rows of the prefix run that differ from the full run; a causal operator gives 0."""
    joined = prefix.select(*keys, *[F.col(v).alias(f"_p_{v}") for v in values]).join(
        full.select(*keys, F.lit(True).alias("_seen"), *values), list(keys), "left"
    )
    changed = F.col("_seen").isNull()
    for v in values:
        gap = F.abs(F.col(v) - F.col(f"_p_{v}")) > tolerance
        changed = changed | F.coalesce(gap, ~F.col(v).eqNullSafe(F.col(f"_p_{v}")))
    return joined.agg(F.count(F.lit(1)).alias("compared"), F.count(F.when(changed, 1)).alias("different"))


def known_at_leaks(df: DataFrame, known_at: str, used_at: Column) -> DataFrame:
    """Q5: rows that use information before it was known."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col(known_at) > used_at, 1)).alias("leaks"))


def bar_report(df: DataFrame, keys: Sequence[str] = ("code",), ts: str = "ts", period_seconds: int = 3600) -> DataFrame:
    """Q6: issue counts, suspiciously small gaps and the covered span per series."""
    from factorloom.functions.scalar import sanity_flags

    w = Window.partitionBy(*keys).orderBy(ts)
    df = df.withColumns({"_pc": F.lag("close").over(w), "_gap": F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))})
    flags = sanity_flags(F.col("_pc"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"),
        *[F.count(F.when(rule, 1)).alias(name) for name, rule in flags.items()],
        F.count(F.when(F.col("_gap") < period_seconds / 2, 1)).alias("short_gaps"),
        F.count(F.when(F.col("_gap") > period_seconds, 1)).alias("holes"),
        ((F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))) / 86400.0).alias("days"),
    )


def coverage_report(panel: DataFrame, expected: int) -> DataFrame:
    """Q7: first and last date, quoted rows and dates with a wrong number of members."""
    days = panel.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("has_quote"), 1)).alias("q"))
    return days.agg(
        F.min(F.when(F.col("q") > 0, F.col("date"))).alias("first_valid"),
        F.max(F.when(F.col("q") > 0, F.col("date"))).alias("last_valid"),
        F.count(F.when(F.col("n") != expected, 1)).alias("days_off"),
        F.sum("q").alias("quoted_rows"),
        F.sum("n").alias("rows"),
    )


def holdout_isolation(tables: Mapping[str, tuple[DataFrame, str]], cutoff: Column) -> DataFrame:
    """Q8: rows at or after the cutoff per development table; all must be 0."""
    out = None
    for name, (df, date) in tables.items():
        row = df.where(F.col(date) >= cutoff).agg(F.count(F.lit(1)).alias("violations")).withColumn("table", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def sample_audit(events: DataFrame, rows: DataFrame, per_year: int, seed: int, salt: Column | None = None) -> DataFrame:
    """Q9: the first event of each kind per year plus ``per_year`` hash-ordered rows per year.

    ``salt`` is the pseudo-random order of the rows; by default a seeded hash of (date, code).

    Small per-year minima are kept through aggregation; nothing is sorted as a whole.
    """
    forced = events.groupBy(F.year("date").alias("year"), "kind").agg(
        F.min(F.struct("date", "code")).alias("_f")
    ).select("year", F.col("_f.date").alias("date"), F.col("_f.code").alias("code"), "kind")
    salt = F.xxhash64("date", "code", F.lit(seed)) if salt is None else salt
    hashed = rows.withColumns({"year": F.year("date"), "_h": salt, "_part": F.pmod(salt, F.lit(64))})
    # the smallest hashes of a year are among the smallest of its 64 parts
    local = Window.partitionBy("year", "_part").orderBy("_h", "date", "code")
    few = hashed.withColumn("_k", F.row_number().over(local)).where(F.col("_k") <= per_year)
    chosen = few.withColumn("_k", F.row_number().over(Window.partitionBy("year").orderBy("_h", "date", "code"))).where(F.col("_k") <= per_year)
    return forced.unionByName(chosen.select("year", "date", "code", F.lit("random").alias("kind")))


def reconstitution_days(members: DataFrame, calendar: DataFrame) -> DataFrame:
    """Q10: dates whose member set differs from the previous session, with joins and leaves.

    Compared by membership of (date, code) pairs instead of by collecting the sets.
    """
    numbered = members.select("date", "code").join(calendar, "date")
    now = numbered.select("position", "code", F.lit(1).alias("_now"))
    before = numbered.select((F.col("position") + 1).alias("position"), "code", F.lit(1).alias("_before"))
    both = now.join(before, ["position", "code"], "full_outer")
    days = both.groupBy("position").agg(
        F.count(F.when(F.col("_before").isNull(), 1)).alias("joined"), F.count(F.when(F.col("_now").isNull(), 1)).alias("left")
    )
    days = days.where((F.col("joined") > 0) | (F.col("left") > 0)).join(calendar, "position")
    return days.where(F.col("position") > 0).select("date", "joined", "left")


def score_grid_violations(df: DataFrame) -> DataFrame:
    """Q12: rules of a published score grid (date, code, fold, score, is_member, signal_valid, available_at)."""
    finite = F.col("score").isNotNull() & ~F.isnan("score")
    repeated = F.count(F.lit(1)).over(Window.partitionBy("date", "code", "fold")) > 1
    df = df.withColumn("_dup", repeated)
    return issues(
        df,
        {
            "NULL_BOOLEAN": (F.col("is_member").isNull() | F.col("signal_valid").isNull(), "ERROR"),
            "AVAILABILITY_DATE": (F.coalesce(F.col("available_at").cast("date") != F.col("date"), F.lit(True)), "ERROR"),
            "DUPLICATE_KEY": (F.col("_dup"), "ERROR"),
            "VALID_MISMATCH": (F.col("signal_valid") != (finite & F.col("is_member")), "ERROR"),
            "NON_MEMBER_SCORE": (~F.col("is_member") & finite, "ERROR"),
        },
    )


def score_grid_contract(df: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """Q12: all rules of a published score grid (date, code, fold_id, score, is_member, signal_valid, score_available_at).

    Row rules take one pass; repeated keys are counted before the shuffle.
    """
    present = F.col("score").isNotNull() & ~F.isnan("score")
    finite = present & (F.abs("score") < float("inf"))
    local = F.from_utc_timestamp("score_available_at", zone).cast("date")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    member = F.coalesce("is_member", F.lit(False))
    rules = {
        "EMPTY_KEY": (blank("code") | blank("fold_id") | F.col("date").isNull(), "ERROR"),
        "NULL_BOOLEAN": (F.col("is_member").isNull() | F.col("signal_valid").isNull(), "ERROR"),
        "DATE_WITH_TIME": (F.col("date").cast("timestamp") != F.date_trunc("day", F.col("date").cast("timestamp")), "ERROR"),
        "AVAILABILITY_DATE": (F.coalesce(local != F.col("date").cast("date"), F.lit(True)), "ERROR"),
        "INFINITE_SCORE": (present & ~finite, "ERROR"),
        "VALID_MISMATCH": (F.coalesce(F.col("signal_valid") != (finite & member), F.lit(False)), "ERROR"),
        "NON_MEMBER_SCORE": (~member & present, "ERROR"),
    }
    empty = df.agg(F.lit("EMPTY_GRID").alias("code"), (F.count(F.lit(1)) == 0).cast("bigint").alias("n_rows"), F.lit("ERROR").alias("severity"))
    return issues(df, rules).unionByName(repeated_keys(df, ["date", "code", "fold_id"], "DUPLICATE_KEY")).unionByName(empty)




def audit_days(events: DataFrame, sessions: DataFrame, days: int, priority: Column) -> DataFrame:
    """Q9: (year, date, kind) of the sample: per year the first session of each kind of event, then sessions by priority up to ``days``.

    ``events`` is (date, kind); only sessions count.  Both parts are aggregates over sessions, at most a calendar: the
    draw is the same whatever the partitions.
    """
    real = events.select("date", "kind").join(sessions.select("date"), "date", "left_semi")
    forced = real.groupBy(F.year("date").alias("year"), "kind").agg(F.min("date").alias("date"))
    taken = forced.groupBy("year").agg(F.countDistinct("date").alias("_n"))
    free = sessions.select("date", priority.alias("_p")).join(forced.select("date"), "date", "left_anti").withColumn("year", F.year("date"))
    place = F.row_number().over(Window.partitionBy("year").orderBy("_p", "date"))
    rest = free.withColumn("_i", place).join(taken, "year", "left").where(F.col("_i") <= days - F.coalesce("_n", F.lit(0)))
    return forced.select("year", "date", "kind").unionByName(rest.select("year", "date", F.lit("random").alias("kind")))


def grid_gaps(df: DataFrame, group: Sequence[str], member: str = "code") -> DataFrame:
    """Q13: groups whose number of distinct members differs from the whole table's."""
    whole = df.agg(F.countDistinct(member).alias("n")).scalar()
    return df.groupBy(*group).agg(F.countDistinct(member).alias("members")).where(F.col("members") != whole).withColumn("expected", whole)


def divergence(df: DataFrame, adjusted: str, raw: str, by: str = "code", order: str = "date", jump: float = 0.25, gap: float = 0.05) -> DataFrame:
    """Q15: rows where the adjusted and raw returns jump or drift apart."""
    w = Window.partitionBy(by).orderBy(order)

    def change(x: str) -> Column:
        return F.try_divide(F.col(x), F.lag(x).over(w)) - 1

    df = df.withColumns({"adjusted_return": change(adjusted), "raw_return": change(raw)})
    far = F.abs(F.col("adjusted_return") - F.col("raw_return")) > gap
    return df.where((F.abs("adjusted_return") > jump) | far).withColumn("diverges", far)


def contract_report(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    rows = [(name, ",".join(contract(df, name))) for name, df in tables.items()]
    return spark.createDataFrame(rows, "table string, missing string")
