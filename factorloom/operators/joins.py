"""Point-in-time joins.

No join here is a cross join and no side is force-broadcast: sizes are left to the optimizer's
thresholds and to adaptive execution.  Windows by ``code`` run over panels with at most one row
per (code, session), which bounds a partition by the length of the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common_timeline(bars: DataFrame, code: str = "code", ts: str = "ts") -> DataFrame:
    """Keep the times at which every code has a row.

    The number of codes is a scalar subquery; the time filter is a semi join.
    """
    codes = bars.agg(F.countDistinct(code).alias("n"))
    shared = bars.groupBy(ts).agg(F.countDistinct(code).alias("n")).where(F.col("n") == codes.scalar())
    return bars.join(shared.select(ts), ts, "left_semi")


def asof(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str) -> DataFrame:
    """J2/J15 without validity: every left row gets the columns of the latest right row at or before it.

    Both sides are unioned and the last right row is carried forward: one shuffle by key and no
    join blow-up.  Right columns must not clash with left ones.
    """
    carried = [c for c in right.columns if c != by]
    l = left.select("*", F.lit(None).cast(_struct_type(right, carried)).alias("_right"), F.lit(1).alias("_side"))
    l = l.withColumn("_at", F.col(left_on))
    r = right.select(
        F.col(by), F.struct(*carried).alias("_right"), F.lit(0).alias("_side"), F.col(right_on).alias("_at")
    )
    w = Window.partitionBy(by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    both = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    return both.select(*left.columns, *[F.col(f"_right.{c}").alias(c) for c in carried])


def _struct_type(df: DataFrame, columns: Sequence[str]):
    from pyspark.sql import types as T

    return T.StructType([df.schema[c] for c in columns])


def valid_interval(
    df: DataFrame, columns: Sequence[str], date: str = "date", valid_to: str = "valid_to",
    known_at: str = "known_at", cutoff: Column | None = None,
) -> DataFrame:
    """Blank the joined columns where the interval has ended or was not known at the cutoff.

    The latest interval is picked first and never replaced by an older one.
    """
    ended = F.col(valid_to).isNotNull() & (F.col(date) > F.col(valid_to))
    bad = ended | F.col(known_at).isNull()
    if cutoff is not None:
        bad = bad | F.coalesce(F.col(known_at) > cutoff, F.lit(False))
    return df.withColumns({c: F.when(~bad, F.col(c)) for c in columns})


def expand_intervals(intervals: DataFrame, calendar: DataFrame, step: str, date: str = "date") -> DataFrame:
    """One row per calendar date inside [valid_from, valid_to]; open ends run to the last date.

    Each interval explodes to the dates of its own span, then a semi join keeps real sessions.
    """
    bounds = calendar.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    # start on the calendar grid at or after valid_from
    shift = F.greatest(F.col("valid_from"), lo)
    grid = F.date_trunc(step, shift.cast("timestamp")).cast("date")
    start = F.when(grid < shift, F.add_months(grid, 1) if step == "month" else F.date_add(grid, 7)).otherwise(grid)
    end = F.least(F.coalesce(F.col("valid_to"), hi), hi)
    unit = F.expr(f"interval 1 {step}")
    df = intervals.withColumns({"_start": start, "_end": end}).where(F.col("_start") <= F.col("_end"))
    df = df.withColumn(date, F.explode(F.sequence("_start", "_end", unit))).drop("_start", "_end")
    return df.join(calendar.select(date).distinct(), date, "left_semi")


def conflicts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def member_led(members: DataFrame, quotes: DataFrame, status: DataFrame, on: Sequence[str] = ("date", "code")) -> DataFrame:
    """Members with their quotes and status; both right sides must be unique on ``on``."""
    return members.join(quotes, list(on), "left").join(status, list(on), "left")


def dense_grid(panel: DataFrame, step: str, date: str = "date", code: str = "code") -> DataFrame:
    """Every (code, session) pair: each code explodes the date range, a semi join keeps sessions."""
    bounds = panel.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    dates = F.sequence(
        bounds.select("lo").scalar(), bounds.select("hi").scalar(), F.expr(f"interval 1 {step}")
    )
    grid = panel.select(code).distinct().withColumn(date, F.explode(dates))
    return grid.join(panel.select(date).distinct(), date, "left_semi")


def number_calendar(dates: DataFrame, date: str = "date") -> DataFrame:
    """Sessions numbered from 0.  The table has one row per session, so one task suffices."""
    return dates.select(date).distinct().withColumn("position", F.row_number().over(Window.orderBy(date)) - 1)


def calendar_offset(df: DataFrame, calendar: DataFrame, offsets: dict[str, Column], date: str = "date") -> DataFrame:
    """Add the dates ``position + offset`` sessions away (NULL outside the calendar)."""
    out = df.join(calendar, date)
    for name, offset in offsets.items():
        other = calendar.select(F.col("position").alias(f"_p_{name}"), F.col(date).alias(name))
        out = out.withColumn("_want", F.col("position") + offset)
        out = out.join(other, F.col("_want") == F.col(f"_p_{name}"), "left").drop("_want", f"_p_{name}")
    return out


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of keys on one side only."""
    l = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    r = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = l.join(r, list(keys), "full_outer")
    return both.agg(
        F.count(F.when(F.col("_r").isNull(), 1)).alias("left_only"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("right_only"),
        F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("shared"),
    )


def reconcile(old: DataFrame, new: DataFrame, on: Sequence[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Paired rows, largest difference and rows beyond the tolerance."""
    pairs = old.select(*on, F.col(value).alias("_old")).join(new.select(*on, F.col(value).alias("_new")), list(on))
    gap = F.abs(F.col("_old") - F.col("_new"))
    return pairs.where(F.col("_old").isNotNull() & F.col("_new").isNotNull()).agg(
        F.count(F.lit(1)).alias("paired_rows"),
        F.max(gap).alias("max_abs_difference"),
        F.coalesce(F.sum((gap > tolerance).cast("int")), F.lit(0)).alias("rows_different"),
    )


def overlap_with_core(bars: DataFrame, core: Sequence[str], at_least: int, code: str = "code", ts: str = "ts") -> DataFrame:
    """How many times of each code lie on the common timeline of the core codes."""
    timeline = common_timeline(bars.where(F.col(code).isin(*core)), code, ts).select(ts).distinct()
    counts = bars.select(code, ts).distinct().join(timeline, ts, "left_semi")
    return counts.groupBy(code).agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= at_least)


def align_phases(candidate: DataFrame, baseline: DataFrame, phases: Sequence[int], value: str = "net_return") -> DataFrame:
    """One row per date with the return of every phase next to the baseline; incomplete dates go."""
    wide = candidate.groupBy("date").agg(
        *[F.max(F.when(F.col("phase") == p, F.col(value))).alias(f"phase_{p}") for p in phases]
    )
    joined = wide.join(baseline.select("date", F.col(value).alias("baseline")), "date")
    names = [f"phase_{p}" for p in phases] + ["baseline"]
    finite = F.lit(True)
    for n in names:
        finite = finite & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return joined.where(finite)
