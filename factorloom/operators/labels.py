"""Forward labels, folds and holdout roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.series import Series
from factorloom.operators.joins import calendar_offset, number_calendar
from factorloom.operators.signals import loo


def horizon_labels(
    members: DataFrame, bars: DataFrame, status: DataFrame | None, dates: DataFrame,
    horizons: Sequence[int] = (1, 3, 5), lag: int = 1,
) -> DataFrame:
    """L2: entry ``lag`` sessions after the signal, exit ``horizon`` sessions after the entry.

    ``bars`` (date, code, open_tr) has prices of quoted rows only; ``status`` has can_buy_open and
    can_sell_open.  The horizons are exploded, so all labels come from one pair of price joins.
    """
    calendar = number_calendar(dates)
    last = calendar.agg(F.max("position").alias("p")).scalar()
    df = members.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    df = calendar_offset(df, calendar, {"entry_date": F.lit(lag), "exit_date": F.lit(lag) + F.col("horizon")})
    inside = F.col("position") + lag + F.col("horizon") <= last
    df = df.withColumns({c: F.when(inside, F.col(c)) for c in ("entry_date", "exit_date")})
    price = bars.select("date", "code", "open_tr")
    if status is not None:
        price = price.join(status.select("date", "code", "can_buy_open", "can_sell_open"), ["date", "code"], "full_outer")
    else:
        price = price.withColumns({"can_buy_open": F.lit(True), "can_sell_open": F.lit(True)})
    for side, flag in (("entry", "can_buy_open"), ("exit", "can_sell_open")):
        part = price.select(
            F.col("date").alias(f"{side}_date"), "code", F.col("open_tr").alias(f"{side}_open_tr"), F.col(flag).alias(f"_{side}_ok")
        )
        df = df.join(part, [f"{side}_date", "code"], "left")

    def good(side: str) -> Column:
        return F.coalesce(F.col(f"{side}_open_tr") > 0, F.lit(False))

    gross = F.when(good("entry") & good("exit"), F.log(F.try_divide(F.col("exit_open_tr"), F.col("entry_open_tr"))))
    df = df.withColumns(
        {
            "gross_log_return": gross,
            "entry_blocked": ~good("entry") | ~F.coalesce("_entry_ok", F.lit(False)),
            "exit_blocked": ~good("exit") | ~F.coalesce("_exit_ok", F.lit(False)),
        }
    )
    free = ~F.col("entry_blocked") & ~F.col("exit_blocked")
    return df.withColumn("executable_log_return", F.when(free, F.col("gross_log_return"))).drop(
        "_entry_ok", "_exit_ok", "position"
    )


def excess_labels(labels: DataFrame, industry: str = "industry") -> DataFrame:
    """L3: absolute, market-excess and industry-excess labels in long format."""
    gross = F.col("gross_log_return")
    by_day = Window.partitionBy("date", "horizon")
    peers = loo(gross, Window.partitionBy("date", "horizon", industry))
    wide = labels.withColumns(
        {
            "ABSOLUTE": gross,
            "MARKET_EXCESS": gross - F.avg(gross).over(by_day),
            "INDUSTRY_EXCESS": F.when(F.col(industry).isNotNull(), gross - peers["mean"]),
        }
    )
    kinds = ["ABSOLUTE", "MARKET_EXCESS", "INDUSTRY_EXCESS"]
    return wide.unpivot([c for c in wide.columns if c not in kinds], kinds, "label_type", "value")


# -- folds -----------------------------------------------------------------------------
def walk_forward(df: DataFrame, folds: int = 5, gap: int = 20, horizon: int = 2, position: str = "rn", total: str = "bars") -> DataFrame:
    """L4: expanding folds per series; adds ``fold`` and ``role`` (train, validation, NULL in the gap).

    One initial training block is followed by ``folds - 1`` validation blocks, each after a purge
    gap; the last ``horizon`` rows have no label.  The bounds are arithmetic on the length of the
    series, so the fold table never leaves the row.
    """
    usable = F.col(total) - horizon
    size = F.floor((usable - (folds - 1) * gap) / folds)
    first = usable - (folds - 1) * (size + gap)
    at = F.col(position) - 1
    df = df.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(folds - 1)])))
    train_end = first + F.col("fold") * (size + gap)
    start = train_end + gap
    role = F.when(at < train_end, "train").when((at >= start) & (at < start + size), "validation")
    return df.withColumn("role", role)


def purged_split(
    dates: DataFrame, folds: int = 5, holdout_share: float = 0.10, holdout_min: int = 480, holdout_years: int = 2,
    initial_share: float = 0.40, purge: int = 20, embargo: int = 5, date: str = "date",
) -> DataFrame:
    """(date, fold, role) for every session and fold; roles train, purge, validation, embargo, holdout.

    The final holdout is the longest of a share, a number of sessions and a number of years.
    Sessions embargoed after an earlier validation block are left out of later training sets.
    """
    calendar = number_calendar(dates, date)
    stats = calendar.agg(F.count(F.lit(1)).alias("n"), F.max(date).alias("last"))
    recent = calendar.where(
        F.col(date) >= F.add_months(stats.select("last").scalar(), -12 * holdout_years)
    ).agg(F.count(F.lit(1)).alias("n"))
    n = stats.select("n").scalar()
    held = F.greatest(F.ceil(n * F.lit(holdout_share)), F.lit(holdout_min), recent.scalar())
    df = calendar.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(folds)])))
    df = df.withColumn("_dev", n - held)
    df = df.withColumn("_first", F.greatest(F.lit(purge + 20), F.floor(F.col("_dev") * initial_share)))
    df = df.withColumn("_size", F.floor((F.col("_dev") - F.col("_first") - (folds - 1) * embargo) / folds))
    at, dev, first, size = (F.col(x) for x in ("position", "_dev", "_first", "_size"))

    def bounds(k: Column) -> tuple[Column, Column]:
        start = first + k * (size + embargo)
        return start, F.when(k == folds - 1, dev).otherwise(start + size)

    start, end = bounds(F.col("fold"))
    after_earlier = F.lit(False)
    for k in range(folds - 1):
        _, earlier_end = bounds(F.lit(k))
        after_earlier = after_earlier | ((F.col("fold") > k) & (at >= earlier_end) & (at < earlier_end + embargo))
    role = (
        F.when(at >= dev, "holdout")
        .when((at >= start) & (at < end), "validation")
        .when((at >= start - purge) & (at < start), "purge")
        .when((at >= end) & (at < end + embargo) & (F.col("fold") < folds - 1), "embargo")
        .when((at < start - purge) & ~after_earlier, "train")
    )
    return df.withColumn("role", role).select(date, "fold", "role")


def nested_violations(inner: DataFrame, outer: DataFrame, date: str = "date") -> DataFrame:
    """Inner validation sessions that an earlier outer fold has embargoed, per (outer, inner) fold.

    ``inner`` has (outer_fold, fold, role); ``outer`` (fold, role).
    """
    validation = inner.where(F.col("role") == "validation").select(date, "outer_fold", F.col("fold").alias("inner_fold"))
    embargoed = outer.where(F.col("role") == "embargo").select(date, F.col("fold").alias("_f"))
    clash = validation.join(embargoed, date).where(F.col("_f") < F.col("outer_fold"))
    counts = clash.groupBy("outer_fold", "inner_fold").agg(F.countDistinct(date).alias("clashes"))
    every = validation.groupBy("outer_fold", "inner_fold").agg(F.count(F.lit(1)).alias("n_dates"))
    return every.join(counts, ["outer_fold", "inner_fold"], "left").na.fill(0, ["clashes"])


def development_violations(df: DataFrame, holdout_start: Column, date: str = "date") -> DataFrame:
    """Rows at or after the holdout start; must be 0."""
    return df.agg(F.count(F.when(F.col(date) >= holdout_start, 1)).alias("violations"))


def holdout_bars(total: Column, share: float = 0.1, least: int = 3) -> Column:
    """Length of the chronological holdout."""
    return F.greatest(F.lit(least), F.ceil(total * share))


def split_chronologically(df: DataFrame, s: Series, share: float = 0.1, least: int = 3, development: int = 10) -> DataFrame:
    """Adds rn, bars and split, the number of rows before the holdout; a series with too few ends the job."""
    whole = Window.partitionBy(*s.keys)
    df = df.withColumns({"rn": s.position(), "bars": F.count(F.lit(1)).over(whole)})
    split = F.col("bars") - holdout_bars(F.col("bars"), share, least)
    short = F.raise_error(F.concat(F.lit("not enough development rows: "), split.cast("string")))
    return df.withColumn("split", F.when(split >= development, split).otherwise(short.cast("long")))


def development_view(df: DataFrame, s: Series, share: float = 0.1) -> DataFrame:
    """The rows before the holdout alone.

    Features and labels are computed on the result, never cut from the whole series: the last two labels are 0 because
    their prices lie in the holdout, and no feature can look ahead whatever its formula.
    """
    return split_chronologically(df, s, share).where(F.col("rn") <= F.col("split")).drop("rn", "bars", "split")


def drop_tail(df: DataFrame, horizon: int, position: str = "rn", total: str = "bars") -> DataFrame:
    """The last ``horizon`` rows have no complete label."""
    return df.where(F.col(position) <= F.col(total) - horizon)


def one_fold_per_date(df: DataFrame, ranges: DataFrame, date: str = "date") -> DataFrame:
    """Keep rows whose date lies in its fold's range; count dropped rows and double-assigned dates."""
    keyed = df.join(ranges, "fold")
    inside = (F.col(date) >= F.col("start")) & (F.col(date) <= F.col("end"))
    per_date = keyed.withColumn("_in", inside).groupBy(date).agg(
        F.countDistinct(F.when(F.col("_in"), F.col("fold"))).alias("folds"),
        F.count(F.when(F.col("_in"), 1)).alias("kept"),
        F.count(F.when(~F.col("_in"), 1)).alias("dropped"),
    )
    return per_date.withColumn("ambiguous", F.col("folds") > 1)


def panel_target(labels: DataFrame, grid: DataFrame) -> DataFrame:
    """The one-session absolute label on the full (date, code) grid; missing stays NULL."""
    wanted = labels.where((F.col("horizon") == 1) & (F.col("label_type") == "ABSOLUTE"))
    return grid.select("date", "code").join(
        wanted.select("date", "code", F.col("value").alias("target_ret")), ["date", "code"], "left"
    )
