"""Bars and panels derived from the warehouse tables.

``bars_hourly`` turns raw ticks into OHLCV bars.  The aggregation is map-side combined, so a
code that holds a third of all ticks costs its mappers, not one reducer, and the result has at
most one row per (code, hour).  The supplier panels do the same by month or week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.session import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrival(ts: str, tie: str) -> Column:
    """One sortable number per tick: microseconds, then the BIGINT expression ``tie`` (below 10^22).

    First and last prices are min_by/max_by over it.  A DECIMAL(38) keeps the aggregation buffer
    updatable in place, so Spark aggregates by hash on the map side; ordering by a struct would
    sort all ticks first.
    """
    micros = f"cast(unix_micros(cast({ts} as timestamp)) as decimal(16,0))"
    shift = "cast('10000000000000000000000' as decimal(23,0))"
    return F.expr(f"cast(cast({micros} * {shift} as decimal(38,0)) + cast({tie} as decimal(22,0)) as decimal(38,0))")


def stored(df: DataFrame) -> DataFrame:
    """A derived table that several branches of a query read: written once to the shared checkpoint
    folder instead of being aggregated from the ticks in every branch."""
    return checkpointed(df)


def ohlcv(ticks: DataFrame, keys: list, order: Column, price: Column, volume: Column, amount: Column) -> DataFrame:
    """First/last/extreme price, volume and amount of each group of ticks."""
    first, last = F.min_by(price, order), F.max_by(price, order)
    return ticks.groupBy(*keys).agg(
        first.alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        last.alias("close"),
        volume.cast("double").alias("volume"),
        F.round(amount, 6).alias("amount"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("code"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"
    )


def bars_hourly(spark: SparkSession, sf_dir: str, every: str = "hour") -> DataFrame:
    """One bar per (code, hour): code = event type, price = event value, volume = tick count."""
    return ohlcv(
        ticks(spark, sf_dir),
        ["code", F.date_trunc(every, "ts").alias("ts")],
        arrival("ts", "event_id"),
        F.col("value"),
        F.count(F.lit(1)),
        F.sum("value"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_suppkey").alias("code"),
        F.col("l_shipdate").cast("date").alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("value"),
        arrival("l_shipdate", "l_orderkey * 1000 + l_linenumber").alias("seq"),
    )


def supplier_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> region, used as the industry.  Joins are left to the optimizer's size checks."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("industry"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("code", "industry")
    )


def panel(spark: SparkSession, sf_dir: str, every: str = "month") -> DataFrame:
    """One row per (supplier, month or week) with OHLCV of the unit price and the industry."""
    period = F.date_trunc(every, F.col("day").cast("timestamp")).cast("date").alias("date")
    bars = ohlcv(
        trades(spark, sf_dir), ["code", period], F.col("seq"), F.col("price"), F.sum("quantity"), F.sum("value")
    )
    return bars.join(supplier_industry(spark, sf_dir), "code")


def desks(spark: SparkSession, sf_dir: str, count: int = 40, every: str = "week") -> DataFrame:
    """Weekly bars of ``count`` desks (groups of suppliers) in four industries; nearly every cell is filled."""
    period = F.date_trunc(every, F.col("day").cast("timestamp")).cast("date").alias("date")
    rows = trades(spark, sf_dir).withColumn("code", F.col("code") % count)
    bars = ohlcv(rows, ["code", period], F.col("seq"), F.col("price"), F.sum("quantity"), F.sum("value"))
    return bars.withColumn("industry", F.concat(F.lit("I"), (F.col("code") % 4).cast("string")))


def membership(panel: DataFrame, top: int = 60) -> DataFrame:
    """Members of each date: the ``top`` codes by traded amount, weight = share of the date's amount."""
    from pyspark.sql import Window

    by_date = Window.partitionBy("date")
    ranked = panel.select(
        "date",
        "code",
        "amount",
        F.row_number().over(by_date.orderBy(F.desc("amount"), "code")).alias("place"),
        F.sum("amount").over(by_date).alias("total"),
    )
    return ranked.where(F.col("place") <= top).select(
        "date", "code", (F.col("amount") / F.col("total") * 100).alias("weight_pct")
    )


def industry_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal industry history: suppliers divisible by 10 switch on 1998-07-01.

    ``known_at`` is 21:00 of ``valid_from``; for suppliers divisible by 20 the switch becomes
    known 400 days late.
    """
    base = supplier_industry(spark, sf_dir)
    switches = F.col("code") % 10 == 0
    first = base.select(
        "code",
        F.lit("1990-01-01").cast("date").alias("valid_from"),
        F.when(switches, F.lit("1998-06-30").cast("date")).alias("valid_to"),
        "industry",
        F.lit("1990-01-01 21:00:00").cast("timestamp").alias("known_at"),
    )
    late = F.when(F.col("code") % 20 == 0, F.lit("1999-08-05 21:00:00")).otherwise(F.lit("1998-07-01 21:00:00"))
    second = base.where(switches).select(
        "code",
        F.lit("1998-07-01").cast("date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        F.concat(F.col("industry"), F.lit("_NEW")).alias("industry"),
        late.cast("timestamp").alias("known_at"),
    )
    return first.unionByName(second)
