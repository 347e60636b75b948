"""Exact ranks and quantiles of large groups, without one task per group.

A time series of a code (or all rows of a candidate) can hold a third of the table.  Rows are
first counted per distinct value, which combines on the map side and removes hot values.  The
distinct values are cut into ranges at approximate quantiles of their group; only the small
range totals are accumulated per group, the rest happens inside (group, range).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.session import stored

RANGES = 64


def value_table(df: DataFrame, by: Sequence[str], value: str, ranges: int = RANGES) -> DataFrame:
    """(by, value, n, start, total): how often each value occurs, how many rows of the group are
    smaller and how many rows the group has.  NULL values are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    cuts = [i / ranges for i in range(1, ranges)]
    edges = counts.groupBy(*by).agg(
        F.percentile_approx(value, cuts, 1000).alias("_edges"), F.sum("n").alias("total")
    )
    # approximate quantiles depend on the order in which partitions meet: both readers below need the same ranges
    edges = stored(edges, "edges")
    placed = counts.join(edges, list(by)).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(value))))
    totals = placed.groupBy(*by, "_range").agg(F.sum("n").alias("_in"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(offsets, [*by, "_range"]).withColumn(
        "start", F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    return ranked.select(*by, value, "n", "start", "total")


def with_average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the 1-based average rank of ``value`` within ``by`` (inner join: NULL values drop out)."""
    table = value_table(df, by, value)
    ranks = table.select(*by, value, (F.col("start") + (F.col("n") + 1) / 2.0).alias(name))
    return df.join(ranks, [*by, value])


def quantile_table(values: DataFrame, by: Sequence[str], value: str, share: Callable[[Column], Column], count: int) -> DataFrame:
    """Linear quantiles of each group from its ``value_table`` as the array ``q``.

    ``share`` maps the index k in 0..count-1 to a probability and may read ``total``.  A row is
    looked at once and emits only the quantiles it borders, so ``2 * count`` rows per group move.
    """

    def place(k: Column) -> Column:
        return share(k) * (F.col("total") - 1)

    def low(k: Column) -> Column:
        return F.floor(place(k) + 1e-12)

    def high(k: Column) -> Column:
        return F.least(low(k) + 1, F.col("total") - 1)

    def holds(index: Column) -> Column:
        return (F.col("start") <= index) & (index < F.col("start") + F.col("n"))

    ks = F.sequence(F.lit(0), F.lit(count - 1))
    hits = values.withColumn("_k", F.explode(F.filter(ks, lambda k: holds(low(k)) | holds(high(k)))))
    k = F.col("_k")
    ends = hits.groupBy(*by, "_k").agg(
        F.max("total").alias("total"),
        F.max(F.when(holds(low(k)), F.col(value))).alias("_lo"),
        F.max(F.when(holds(high(k)), F.col(value))).alias("_hi"),
    )
    part = F.greatest(place(k) - low(k), F.lit(0.0))
    point = F.struct("_k", (F.col("_lo") + part * (F.col("_hi") - F.col("_lo"))).alias("v"))
    lists = ends.groupBy(*by).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(point)).alias("_q"))
    return lists.select(*by, "total", F.transform("_q", lambda p: p["v"]).alias("q"))
