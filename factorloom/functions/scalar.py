"""Row-level conversions, predicates and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dates that stand for "no date" in vendor tables.
DATE_SENTINELS = (0, 18991231, 19000101, 20991231, 20999999, 99991231, 99999999)
FLAG_WORDS = ("1", "Y", "TRUE", "T", "YES")
MARKET_ZONE = "Asia/Shanghai"
# Fixed values: (symbol prefixes, symbol parts, cost rate); the first match wins.
COST_RULES = (
    (("XAU", "XAG"), (), 0.00020),
    (("US", "JP"), (".cash",), 0.00030),
)
DEFAULT_COST = 0.00015


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Seconds from a numeric column whose unit follows from its largest magnitude.

    The maximum of the whole column is one scalar subquery.
    """
    top = df.agg(F.max(F.abs(F.col(column))).alias("top")).scalar()
    x = F.col(column).cast("double")
    return F.when(top < 1e7, x * 1000).when(top > 1e16, x / 1e9).when(top > 1e10, x / 1000).otherwise(x)


def epoch_from_text(text: Column) -> Column:
    """C1 for text columns: UTC parse, NULL if it is no time."""
    return F.try_to_timestamp(text).cast("double")


def to_number(text: Column) -> Column:
    """Unparseable, NaN and infinite values become NULL."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def valid_quote(volume: str = "volume") -> Column:
    """C3"""
    prices = [F.col(p) for p in ("open", "high", "low", "close")]
    test = (F.col(volume) >= 0) & ~F.isnan(F.col(volume)) & (F.col(volume) < float("inf"))
    for p in prices:
        test = test & (p > 0) & ~F.isnan(p) & (p < float("inf"))
    return F.coalesce(test, F.lit(False))


def trade_date(value: Column) -> Column:
    """YYYYMMDD numbers or text; sentinels and dates before 1900-01-01 become NULL."""
    number = value.try_cast("bigint")
    bad = number.isin(*DATE_SENTINELS) | (number < 19000101)
    return F.when(~F.coalesce(bad, F.lit(False)), F.coalesce(
        F.try_to_date(number.cast("string"), "yyyyMMdd"), F.try_to_date(value.cast("string"))
    ))


def local_date(instant: Column, zone: str = MARKET_ZONE) -> Column:
    """The market date of a UTC instant."""
    return F.from_utc_timestamp(instant, zone).cast("date")


def at_local(date: Column, clock: str, zone: str = MARKET_ZONE) -> Column:
    """The UTC instant of a wall-clock time on a market date."""
    return F.to_utc_timestamp(F.concat(date.cast("string"), F.lit(" " + clock)).cast("timestamp"), zone)


def flag(value: Column) -> Column:
    """C8"""
    text = value.cast("string")
    number = text.try_cast("double")
    return F.coalesce((number != 0), F.lit(False)) | F.coalesce(F.upper(F.trim(text)).isin(*FLAG_WORDS), F.lit(False))


def tradability(
    open_: Column, volume: Column, amount: Column, suspended: Column, limit_up: Column, limit_down: Column,
    margin: float = 0.01,
) -> dict[str, Column]:
    """buyable/sellable at the open and the reason where not (later reasons win)."""
    quoted = F.coalesce((open_ > 0) & (volume > 0) & (amount > 0), F.lit(False))
    trading = quoted & ~F.coalesce(suspended, F.lit(False))
    buyable = trading & F.coalesce(open_ < limit_up - margin, F.lit(False))
    sellable = trading & F.coalesce(open_ > limit_down + margin, F.lit(False))

    def reason(able: Column, label: str) -> Column:
        return (
            F.when(trading & ~able, label)
            .when(F.coalesce(suspended, F.lit(False)), "SUSPENDED")
            .when(~quoted, "MISSING_QUOTE")
        )

    return {
        "can_buy_open": buyable,
        "can_sell_open": sellable,
        "buy_block_reason": reason(buyable, "LIMIT_UP_OPEN"),
        "sell_block_reason": reason(sellable, "LIMIT_DOWN_OPEN"),
    }


def row_hash(columns: Sequence[str]) -> Column:
    """C10"""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def payload_hash(columns: Sequence[str]) -> Column:
    """C11: hash of the JSON object with sorted keys; NULL fields are part of the payload."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def code_key(code: Column) -> Column:
    """C12"""
    return F.upper(F.trim(code))


def exchange(code: Column) -> Column:
    return F.element_at(F.split(code, r"\."), -1)


def sanity_flags(prev_close: Column) -> dict[str, Column]:
    """C13"""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return {
        "high_below_body": h < F.greatest(o, c),
        "low_above_body": l > F.least(o, c),
        "high_below_low": h < l,
        "bad_price": F.least(o, h, l, c) <= 0,
        "zero_volume": v == 0,
        "jump": F.coalesce(F.abs(F.try_divide(c - prev_close, prev_close)) > 0.5, F.lit(False)),
    }


def safe_log_return(current: Column, previous: Column) -> Column:
    """C14"""
    return F.when((current > 0) & (previous > 0), F.log(F.try_divide(current, previous)))


def coverage_cause(industry: Column, ret: Column, peers: Column, need: int = 5) -> Column:
    """C18"""
    return (
        F.when(industry.isNull(), "missing_industry")
        .when(ret.isNull(), "missing_return")
        .when(peers < need, f"fewer_than_{need}_peers")
        .otherwise("valid")
    )


def cost_by_class(code: Column, rules=COST_RULES, default: float = DEFAULT_COST) -> Column:
    """First matching rule (prefixes, substrings, rate) wins."""
    out = None
    for prefixes, parts, rate in rules:
        test = F.lit(False)
        for p in prefixes:
            test = test | code.startswith(p)
        for p in parts:
            test = test | code.contains(p)
        out = F.when(test, rate) if out is None else out.when(test, rate)
    return out.otherwise(default)


def half_spread(bid: Column, ask: Column, default: float = 0.0001) -> Column:
    """C20: half the spread over the mid price."""
    mid = (ask + bid) / 2
    return F.coalesce(F.try_divide((ask - bid) / 2, mid), F.lit(default))
