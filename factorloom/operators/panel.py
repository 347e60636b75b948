"""Building the point-in-time panel.

Windows by ``code`` run over tables with at most one row per (code, session); a partition is
bounded by the length of the calendar whatever the trading volume of the code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.features import features
from factorloom.functions.scalar import at_local, exchange, trade_date
from factorloom.functions.series import Series

PRICES = ("open", "high", "low", "close")


def positive(*names: str) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & (F.col(n) > 0) & ~F.isnan(n) & (F.col(n) < float("inf"))
    return F.coalesce(test, F.lit(False))


def total_return_chain(df: DataFrame, by: str = "code", order: str = "date") -> DataFrame:
    """Adds open_tr .. close_tr and chain_valid.

    The first valid row of a run has close_tr = 1; later rows scale by the previous close_tr over
    their own preclose.  An invalid row ends the run.
    """
    w = Window.partitionBy(by).orderBy(order)
    df = df.withColumn("chain_valid", positive(*PRICES, "preclose"))
    broken = F.sum(F.when(F.col("chain_valid"), 0).otherwise(1))
    df = df.withColumn("_run", broken.over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(by, "_run", "chain_valid").orderBy(order)
    first = F.row_number().over(run) == 1
    df = df.withColumn("_step", F.when(first, 1.0).otherwise(F.col("close") / F.col("preclose")))
    level = F.product("_step").over(run.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_level", F.when(F.col("chain_valid"), level))
    scale = F.coalesce(F.lag("_level").over(run), F.lit(1.0)) / F.col("preclose")
    df = df.withColumn("_scale", F.when(F.col("chain_valid"), scale))
    out = df.withColumns({f"{p}_tr": F.col(p) * F.col("_scale") for p in PRICES[:3]})
    return out.withColumn("close_tr", F.col("_level")).drop("_run", "_step", "_level", "_scale")


def with_spells(members: DataFrame, gap_days: int = 10, by: str = "code", date: str = "date") -> DataFrame:
    """Number the membership spells of each code and add the start of the current spell."""
    w = Window.partitionBy(by).orderBy(date)
    gap = F.datediff(F.col(date), F.lag(date).over(w)) > gap_days
    df = members.withColumn("_new", F.when(gap, 1).otherwise(0))
    df = df.withColumn("spell_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return df.withColumn("entry_effective_date", F.min(date).over(Window.partitionBy(by, "spell_id")))


def spell_audit(spelled: DataFrame, by: str = "code", date: str = "date") -> DataFrame:
    """One row per spell; the exit of a spell that reaches the snapshot end is unknown."""
    end = spelled.agg(F.max(date).alias("end")).scalar()
    spells = spelled.groupBy(by, "spell_id").agg(
        F.min(date).alias("entry_effective_date"), F.max(date).alias("_last"), F.count(F.lit(1)).alias("n_rows")
    )
    open_ = F.col("_last") == end
    return spells.withColumns(
        {"realized_exit_date": F.when(~open_, F.col("_last")), "censored_at_snapshot_end": open_}
    ).drop("_last")


def resolve_conflicts(intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of several intervals with one (code, valid_from) keep the open-ended, then the latest end,
    then the first industry; the rest go to the exception table."""
    w = Window.partitionBy("code", "valid_from")
    order = w.orderBy(F.col("valid_to").isNull().desc(), F.col("valid_to").desc(), F.col("industry"))
    ranked = intervals.withColumn("_place", F.row_number().over(order))
    kept = ranked.where(F.col("_place") == 1).drop("_place")
    dropped = ranked.where(F.col("_place") > 1).drop("_place")
    return kept, dropped.withColumn("reason", F.lit("CONFLICTING_PRIMARY_DROPPED"))


def close_gaps(intervals: DataFrame) -> DataFrame:
    """An interval lasts until the day before the next one of its code."""
    following = F.lead("valid_from").over(Window.partitionBy("code").orderBy("valid_from"))
    return intervals.withColumn("valid_to", F.coalesce(F.date_sub(following, 1), F.col("valid_to")))


def level_one(codes: DataFrame, suffix: str = ".SI") -> DataFrame:
    """P5"""
    level = F.col("level_type").cast("string").try_cast("int")
    return codes.where((level == 1) & F.upper("index_code").endswith(suffix))


def missing_history(wanted: DataFrame, intervals: DataFrame) -> DataFrame:
    """Wanted codes without any interval."""
    missing = wanted.select("code").distinct().join(intervals.select("code"), "code", "left_anti")
    return missing.withColumn("reason", F.lit("MISSING_INDUSTRY_HISTORY"))


def assemble_quotes(bars: DataFrame, preclose: DataFrame, on: Sequence[str] = ("date", "code")) -> DataFrame:
    """Preclose joined, the chain of P1, and every number blank where there is no quote."""
    df = total_return_chain(bars.join(preclose, list(on), "left"))
    df = df.withColumn("has_quote", F.col("chain_valid") & (F.col("volume") >= 0) & (F.col("amount") >= 0))
    numbers = [*PRICES, "volume", "amount", "preclose", *[f"{p}_tr" for p in PRICES]]
    df = df.withColumns({n: F.when(F.col("has_quote"), F.col(n)) for n in numbers})
    reason = F.when(~F.col("has_quote"), "NO_VALID_VENDOR_QUOTE")
    return df.withColumn("quote_missing_reason", reason)


def member_slice(members: DataFrame, quotes: DataFrame, on: Sequence[str] = ("date", "code")) -> DataFrame:
    """Member keys with their quotes; rows without one are marked."""
    df = members.select(*on).join(quotes, list(on), "left")
    return df.withColumns(
        {
            "has_quote": F.coalesce("has_quote", F.lit(False)),
            "quote_missing_reason": F.when(
                ~F.coalesce("has_quote", F.lit(False)),
                F.coalesce("quote_missing_reason", F.lit("MISSING_VENDOR_ROW")),
            ),
        }
    )


def ever_members(table: DataFrame, members: DataFrame) -> DataFrame:
    """All rows of codes that were a member at any time."""
    return table.join(members.select("code"), "code", "left_semi")


def build_calendar(dates: DataFrame, date: str = "date") -> DataFrame:
    """P10"""
    out = dates.select(date).where(F.col(date).isNotNull()).distinct()
    return out.withColumns(
        {
            "session_open": at_local(F.col(date), "09:30:00"),
            "session_close": at_local(F.col(date), "15:00:00"),
            "available_at": at_local(F.col(date), "21:00:00"),
            "is_complete_session": F.lit(True),
        }
    )


ACTION_FIELDS = {
    "code": "string", "action_type": "string", "announcement_at": "date", "record_date": "date", "ex_date": "date",
    "payment_date": "date", "effective_at": "date", "cash_dividend": "double", "stock_dividend_ratio": "double",
    "rights_ratio": "double", "rights_price": "double", "known_at": "date", "known_at_source": "string",
    "raw_payload_hash": "string",
}
# Vendor column names by event type, first existing one wins.
ACTION_SOURCES = {
    "DIVIDEND": {
        "announcement_at": ("DATE_DVD_ANN", "ANN_DATE", "announcement_at"),
        "record_date": ("DATE_RECORD", "record_date"),
        "ex_date": ("DATE_EX", "EX_DATE", "ex_date"),
        "payment_date": ("DATE_PAY", "payment_date"),
        "effective_at": ("DATE_EX", "EX_DATE", "ex_date"),
        "cash_dividend": ("DVD_PER_SHARE_PRE_TAX_CASH", "CASH_DIVIDEND", "cash_dividend"),
        "stock_dividend_ratio": ("DVD_PER_SHARE_STOCK", "STOCK_DIVIDEND_RATIO", "stock_dividend_ratio"),
    },
    "RIGHT_ISSUE": {
        "announcement_at": ("ANN_DATE", "EXECUTE_DATE", "announcement_at"),
        "ex_date": ("DATE_EX", "EX_DATE", "ex_date"),
        "effective_at": ("DATE_EX", "EX_DATE", "ex_date"),
        "rights_ratio": ("RIGHTS_RATIO", "RATIO", "rights_ratio"),
        "rights_price": ("RIGHTS_PRICE", "PRICE", "rights_price"),
    },
    "EQUITY_CHANGE": {
        "announcement_at": ("ANN_DATE", "announcement_at"),
        "effective_at": ("CHANGE_DATE", "effective_at"),
    },
}


def corporate_actions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Event tables of different vendors in one schema, with a content hash as identifier."""
    from factorloom.functions.scalar import payload_hash

    out = None
    for kind, df in tables.items():
        code = next(c for c in ("MARKET_CODE", "code") if c in df.columns)
        columns = {"code": F.upper(F.col(code)), "action_type": F.lit(kind), "raw_payload_hash": payload_hash(df.columns)}
        for field, names in ACTION_SOURCES[kind].items():
            source = next((n for n in names if n in df.columns), None)
            if source is None:
                continue
            value = F.col(source)
            kind_of = ACTION_FIELDS[field]
            columns[field] = trade_date(value.cast("string")) if kind_of == "date" else value.cast("string").try_cast(kind_of)
        announced = columns.get("announcement_at", F.lit(None).cast("date"))
        columns["known_at"] = announced
        columns["known_at_source"] = F.when(announced.isNotNull(), "NATIVE").otherwise("MISSING")
        rows = df.select(*[columns.get(f, F.lit(None)).cast(t).alias(f) for f, t in ACTION_FIELDS.items()])
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn(
        "action_id", F.sha2(F.concat_ws("|", "code", "action_type", "raw_payload_hash"), 256)
    )


def security_master(codes: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """One row per code; codes without a source row get a stub."""
    base = codes.select(F.upper(F.trim("code")).alias("code")).distinct().withColumn("exchange", exchange(F.col("code")))
    if listed is None:
        return base.withColumns({"list_date": F.lit(None).cast("date"), "delist_date": F.lit(None).cast("date")})
    known = listed.groupBy(F.upper(F.trim("code")).alias("code")).agg(
        F.min("list_date").alias("list_date"), F.max("delist_date").alias("delist_date")
    )
    return base.join(known, "code", "left")


# Fixed values of rows without a status.
STATUS_FLAGS = ("is_suspended", "is_st", "is_xr", "is_wd", "can_buy_open", "can_sell_open")
NO_STATUS, DERIVED = "STATUS_UNAVAILABLE_FROM_VENDOR", "DERIVED_POLICY"


def fill_status(keys: DataFrame, status: DataFrame, on: Sequence[str] = ("date", "code")) -> DataFrame:
    """Keys without a status row have no flag, are not tradable and say why; they count as known when their day has closed."""
    df = keys.select(*on).join(status.withColumn("_known", F.lit(True)), list(on), "left")
    fill = {
        **{c: F.lit(False) for c in STATUS_FLAGS}, "buy_block_reason": F.lit(NO_STATUS), "sell_block_reason": F.lit(NO_STATUS),
        "available_at": at_local(F.col("date"), "21:00:00"), "available_at_source": F.lit(DERIVED),
    }
    return df.withColumns({c: F.when(F.col("_known"), F.col(c)).otherwise(x) for c, x in fill.items()}).drop("_known")


# Availability columns of one reference row.
RETURN_TIMES = ("quote_available_at", "status_available_at", "preclose_available_at", "previous_quote_available_at")
REQUIRED_TIMES = (*RETURN_TIMES, "membership_available_at", "industry_available_at")


def mask_unavailable(df: DataFrame, cutoff: Column, original: Column, ret: str = "r_1d", industry: str = "industry") -> DataFrame:
    """Blank returns and industries that were not known at the cutoff of their date.

    ``original`` marks rows of the original universe; added rows also need a known industry.
    """
    df = df.withColumn("signal_at", cutoff)

    def known(c: str) -> Column:
        return F.coalesce(F.col(c) <= F.col("signal_at"), F.lit(False))

    all_times = F.lit(True)
    complete = F.lit(True)
    for c in RETURN_TIMES:
        all_times, complete = all_times & known(c), complete & F.col(c).isNotNull()
    df = df.withColumns(
        {
            "return_time_usable": all_times,
            "return_available_at": F.when(complete, F.greatest(*RETURN_TIMES)),
            "membership_time_usable": known("membership_available_at"),
            "industry_time_usable": known("industry_available_at"),
        }
    )
    df = df.withColumn(industry, F.when(F.col("industry_time_usable"), F.col(industry)))
    eligible = F.col("return_time_usable") & F.col("membership_time_usable")
    eligible = eligible & (original | (F.col("industry_time_usable") & F.col(industry).isNotNull()))
    df = df.withColumn("reference_input_usable", eligible)
    return df.withColumn(ret, F.when(F.col("reference_input_usable"), F.col(ret)))


def signal_time_issues(df: DataFrame, date: str = "date", signal_at: str = "signal_at") -> DataFrame:
    """Dates whose signal time is missing, ambiguous or on another market date."""
    from factorloom.functions.scalar import local_date

    wrong = F.coalesce(local_date(F.col(signal_at)) != F.col(date), F.lit(False))
    out = df.groupBy(date).agg(
        F.countDistinct(signal_at).alias("distinct_times"),
        F.sum(F.col(signal_at).isNull().cast("int")).alias("missing"),
        F.sum(wrong.cast("int")).alias("wrong_day"),
    )
    return out.where((F.col("distinct_times") != 1) | (F.col("missing") > 0) | (F.col("wrong_day") > 0))


def previous_session(df: DataFrame, calendar: DataFrame, value: str, name: str, date: str = "date") -> DataFrame:
    """The value of the same code on the previous session of the calendar (numbered)."""
    here = df.join(calendar, date)
    there = df.join(calendar, date).select("code", (F.col("position") + 1).alias("position"), F.col(value).alias(name))
    return here.join(there, ["code", "position"], "left")


def session_return(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """ln(close / preclose) where the previous session was quoted."""
    joined = previous_session(df, calendar, "close", "_prior")
    good = (F.col("close") > 0) & (F.col("preclose") > 0) & F.col("_prior").isNotNull()
    return joined.withColumn("r_1d", F.when(good, F.log(F.col("close") / F.col("preclose")))).drop("_prior")


def provenance(df: DataFrame, times: Sequence[str], source: Column) -> DataFrame:
    """A provenance label next to each availability column."""
    return df.withColumns({f"{t}_source": F.when(F.col(t).isNotNull(), source).otherwise("MISSING") for t in times})


POLICY = "DERIVED_POLICY"


def one_per_cell(df: DataFrame, what: str) -> DataFrame:
    """``df`` with one row per (date, code); a second row of a cell ends the job instead of doubling rows in a join."""
    values = [c for c in df.columns if c not in ("date", "code")]
    cells = df.groupBy("date", "code").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values])
    twice = F.raise_error(F.concat(F.lit(f"{what}: several rows of "), F.col("date").cast("string"), F.lit(" "), F.col("code").cast("string")))
    return cells.withColumn("code", F.when(F.col("_n") == 1, F.col("code")).otherwise(twice.cast(df.schema["code"].dataType))).drop("_n")


def timing(rows: DataFrame, native: DataFrame, bars: DataFrame, statuses: DataFrame, calendar: DataFrame, original: Column, policy: Column) -> DataFrame:
    """The six availability times of every row of ``rows`` and where each comes from.

    Rows of the ``original`` universe take the times recorded in ``native`` (date, code, available_at, available_at_quote,
    available_at_source, has_quote, available_at_status, available_at_source_status, industry_known_at, industry_known_at_source);
    a quote time counts where there was a quote, and returns rest on the quote, so the previous close has its time.  The
    other rows have no recorded times: a quote with a positive close in ``bars`` (date, code, close), a status row and its positive
    ``preclose`` in ``statuses`` count as known at ``policy`` (a function of the date), as do membership and a known
    industry.  The previous quote is that of the session before in ``calendar`` (date, position), of the row's own universe.
    A time that is missing has the label MISSING.  The previous quote has the policy's label, so a recorded quote of another
    source ends the job, as does a second row of one cell.
    """
    native = one_per_cell(native, "native times")
    here = rows.withColumn("_old", original)
    foreign = F.raise_error(F.concat(F.lit("quote time of another source: "), F.col("available_at_source")))
    uniform = F.when(F.coalesce(F.col("available_at_source"), F.lit(POLICY)) == POLICY, F.col("available_at_source")).otherwise(foreign)
    old = (
        here.where("_old").select("date", "code").join(native, ["date", "code"], "left")
        .withColumn("available_at_source", uniform)
        .select(
            "date", "code",
            F.when(F.col("has_quote"), F.col("available_at_quote")).alias("quote_available_at"),
            F.col("available_at_status").alias("status_available_at"),
            F.col("available_at_quote").alias("preclose_available_at"),
            F.col("available_at").alias("membership_available_at"),
            F.col("industry_known_at").alias("industry_available_at"),
            F.col("available_at_source").alias("quote_available_at_source"),
            F.col("available_at_source_status").alias("status_available_at_source"),
            F.col("available_at_source").alias("preclose_available_at_source"),
            F.lit(POLICY).alias("membership_available_at_source"),
            F.col("industry_known_at_source").alias("industry_available_at_source"),
        )
    )
    quoted = one_per_cell(bars, "bars").select("date", "code", F.when(F.col("close") > 0, policy).alias("quote_available_at"))
    status = one_per_cell(statuses, "statuses").select(
        "date", "code", policy.alias("status_available_at"), F.when(F.col("preclose") > 0, policy).alias("preclose_available_at")
    )
    new = (
        here.where(~F.col("_old")).select("date", "code", "industry").join(quoted, ["date", "code"], "left").join(status, ["date", "code"], "left")
        .select(
            "date", "code", "quote_available_at", "status_available_at", "preclose_available_at",
            policy.alias("membership_available_at"),
            F.when(F.col("industry").isNotNull(), policy).alias("industry_available_at"),
            *[F.lit(POLICY).alias(f"{c}_source") for c in REQUIRED_TIMES if c != "previous_quote_available_at"],
        )
    )
    # bars of the other universe reach beyond its rows, recorded quotes do not
    quotes = [old.select("date", "code", "quote_available_at", F.lit(True).alias("_old")), quoted.withColumn("_old", F.lit(False))]
    prior = quotes[0].unionByName(quotes[1]).join(calendar, "date").select(
        (F.col("position") + 1).alias("position"), "code", "_old", F.col("quote_available_at").alias("previous_quote_available_at")
    )
    times = old.unionByName(new)
    found = (
        here.join(times, ["date", "code"]).join(calendar, "date", "left").join(prior, ["position", "code", "_old"], "left")
        .withColumn("previous_quote_available_at_source", F.lit(POLICY))
    )
    labels = {f"{c}_source": F.when(F.col(c).isNull(), "MISSING").otherwise(F.col(f"{c}_source")) for c in REQUIRED_TIMES}
    return found.withColumns(labels).select(*rows.columns, *REQUIRED_TIMES, *labels)


def contiguous_runs(df: DataFrame, calendar: DataFrame, by: str = "code", date: str = "date") -> DataFrame:
    """number the unbroken runs of consecutive sessions and the rows inside each run.

    On consecutive sessions the calendar position and the row number advance together, so their
    difference names the run; windows that also partition by it never cross a gap.
    """
    w = Window.partitionBy(by).orderBy(date)
    df = df.join(calendar, date).withColumn("run", F.col("position") - F.row_number().over(w))
    return df.withColumn("run_row", F.row_number().over(Window.partitionBy(by, "run").orderBy(date)))


#: Fixed value: rows of a run that only warm the windows up.
WARM_UP = 60


def run_features(bars: DataFrame, calendar: DataFrame, usable: Column, names: Sequence[str], warm_up: int = WARM_UP) -> DataFrame:
    """the named features on every unbroken run of usable sessions, one row per row of ``bars``.

    A gap ends a series: runs are series of their own (code, run), so no window, recursion or norm reaches over a
    suspension, and cross-section features see their own code alone.  Features are NULL on unusable rows and on
    the first ``warm_up`` rows of a run; ``ready`` tells which rows have them.
    """
    rows = contiguous_runs(bars.where(usable), calendar)
    s = Series(keys=("code", "run"), order="date", at=("code", "run", "date"))
    wide = features(rows, names, s, keep=["run_row"])
    ready = F.coalesce(F.col("run_row") > warm_up, F.lit(False))
    joined = bars.select("code", "date").join(wide, ["code", "date"], "left")
    return joined.select("code", "date", "run_row", ready.alias("ready"), *[F.when(ready, F.col(n)).alias(n) for n in names])
