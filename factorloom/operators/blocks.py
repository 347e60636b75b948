"""Splitting one long series into blocks, exactly.

A window partitioned by ``code`` puts all rows of a code into one task.  That is fine for bars
on a calendar grid (an hourly bar series has at most 8 784 rows per year whatever the tick
volume), but not for tick-level series where one code may hold a third of all rows.  Here such
a series is cut into blocks of ``block_rows`` rows.  Every block also receives the ``halo``
rows before it, so any window of at most ``halo + 1`` rows gives the same value as on the
uncut series.  Running totals are carried over from pre-aggregated slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.series import Series


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_of: Column,
    running: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ``rn`` (1-based position in the series) and running sums without one task per series.

    ``slice_of`` must be non-decreasing along ``order`` (for example the day of the timestamp).
    Rows are numbered inside (key, slice); counts and sums per slice are pre-aggregated on the
    map side, accumulated over the small slice table and joined back as offsets.
    """
    running = dict(running or {})
    sliced = df.withColumn("_slice", slice_of).withColumns({f"_v_{n}": e for n, e in running.items()})
    totals = sliced.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in running]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_o_rows"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_o_{n}") for n in running],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = sliced.join(offsets, [*keys, "_slice"])
    numbered = joined.withColumn("rn", F.row_number().over(inside) + F.col("_o_rows"))
    for n in running:
        numbered = numbered.withColumn(n, F.sum(f"_v_{n}").over(upto) + F.col(f"_o_{n}"))
    return numbered.drop("_slice", "_o_rows", *[f"_v_{n}" for n in running], *[f"_o_{n}" for n in running])


def split(numbered: DataFrame, halo: int, block_rows: int = 50_000) -> DataFrame:
    """Assign ``block`` and copy each block's preceding ``halo`` rows into it as ``is_halo``.

    ``halo`` must not exceed ``block_rows``: a row then belongs to one block and is copied to at
    most one more, so the data grows by ``halo / block_rows``.
    """
    if halo > block_rows:
        raise ValueError("halo must not exceed block_rows")
    own = F.floor((F.col("rn") - 1) / block_rows)
    last = F.floor((F.col("rn") - 1 + halo) / block_rows)
    return (
        numbered.withColumn("_own", own)
        .withColumn("block", F.explode(F.sequence(own, last)))
        .withColumn("is_halo", F.col("block") != F.col("_own"))
        .drop("_own")
    )


def block_series(s: Series) -> Series:
    """The same series with windows inside blocks, ordered by the global position."""
    return Series(keys=(*s.keys, "block"), order="rn", at=s.at, member=s.member, blocked=True)


def trim(df: DataFrame) -> DataFrame:
    """Drop the halo copies once all windows are computed."""
    return df.where(~F.col("is_halo")).drop("is_halo", "block")
