"""Streaming twins of the polling loop (T1-T7) on Structured Streaming.

Ticks arrive as files (any streaming source with the same columns works).  Every job writes to a
table in the shared checkpoint folder with its own checkpoint, so it restarts after a failure
where it stopped, and no result passes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factorloom.operators.backtest import DEAD_BAND, direction
from factorloom.session import shared_folder
from factorloom.sources.market import arrival, ohlcv

#: Bars of a code that signals are evaluated on.
KEEP_BARS = 500


def stream_folder(spark: SparkSession) -> str:
    """A fresh folder for one stream below the folder that driver and executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def tick_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Ticks of a folder (or glob) of Parquet files as a stream of (code, ts, event_id, value)."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.select(F.col("event_type").alias("code"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def run_available(stream: DataFrame, folder: str, name: str, batch: Callable | None = None) -> DataFrame:
    """Process everything that is available, append it to ``folder/name`` and return that table."""
    spark = stream.sparkSession
    target = f"{folder}/{name}"
    writer = stream.writeStream.outputMode("append").trigger(availableNow=True)
    writer = writer.option("checkpointLocation", f"{folder}/_checkpoints/{name}")
    if batch is None:
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(lambda df, epoch: batch(df, epoch, target)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target) if batch is None else spark.read.parquet(target)


def ingest(ticks: DataFrame, every: str = "minute", delay: str = "10 minutes") -> DataFrame:
    """One row per (code, minute); repeats within the watermark are dropped."""
    keyed = ticks.withColumn("minute", F.date_trunc(every, "ts")).withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["code", "minute"]).select("code", "minute")


def bar_versions(bars: DataFrame, keep: str = "30 days") -> DataFrame:
    """T1 with values: the newest version of every bar seen so far, emitted again whenever a delivery touches it.

    ``bars`` has (code, ts, open, high, low, close, volume, version); deliveries overlap and come late or twice.  State holds one
    row per (code, ts) until ``keep`` has passed, combined before the shuffle, and survives a restart.  Run it in
    update mode with ``upsert_available``.
    """
    values = F.struct("open", "high", "low", "close", "volume", "version")
    newest = bars.withWatermark("ts", keep).groupBy("code", "ts").agg(F.max_by(values, F.col("version")).alias("b"))
    return newest.select("code", "ts", "b.*")


def upsert_available(updates: DataFrame, folder: str, name: str) -> DataFrame:
    """Process everything that is available in update mode; (all columns, corrections): newest version per (code, ts).

    A batch lands in a folder of its own, written over if it runs again, so a retried batch counts once.
    """
    spark, target = updates.sparkSession, f"{folder}/{name}"

    def land(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    writer = updates.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/_checkpoints/{name}")
    writer.foreachBatch(land).start().awaitTermination()
    landed = spark.read.option("basePath", target).parquet(target)
    rest = [c for c in updates.columns if c not in ("code", "ts")]
    newest = landed.groupBy("code", "ts").agg(F.max_by(F.struct(*rest), F.struct("version", "epoch")).alias("b"), F.countDistinct("version").alias("versions"))
    return newest.select("code", "ts", "b.*", (F.col("versions") - 1).alias("corrections"))


def closed_bars(ticks: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """OHLCV bars, emitted only after the watermark has passed their end."""
    window = F.window("ts", width).alias("w")
    bars = ohlcv(
        ticks.withWatermark("ts", delay), ["code", window], arrival("ts", "event_id"), F.col("value"),
        F.count(F.lit(1)), F.sum("value"),
    )
    return bars.select("code", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def bar_direction() -> Column:
    """Direction of a closed bar: sign of the squashed log move with a dead band."""
    return direction(F.tanh(F.log(F.col("close") / F.col("open"))), DEAD_BAND)


def _flips(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One code: compare each closed bar with the last known direction.

    A trigger brings the newly closed bars of a code, a handful of rows by the calendar grid.
    """
    rows = pd.concat(list(frames), ignore_index=True).sort_values("ts")
    now = rows["dir"].to_numpy()
    before = np.concatenate(([state.get[0] if state.exists else now[0]], now[:-1]))
    flip = before != now
    state.update((int(now[-1]),))
    if flip.any():
        yield pd.DataFrame({"code": key[0], "ts": rows["ts"][flip], "previous": before[flip], "direction": now[flip]})


def direction_flips(bars: DataFrame) -> DataFrame:
    """An alert whenever the direction of a code differs from its last known direction."""
    return bars.withColumn("dir", bar_direction()).select("code", "ts", "dir").groupBy("code").applyInPandasWithState(
        _flips, "code string, ts timestamp, previous int, direction int", "direction int", "append", GroupStateTimeout.NoTimeout
    )


def latest_signal(
    bars: DataFrame, min_bars: int, factor: Callable[[DataFrame], DataFrame], now: Column | None = None, period: int = 3600
) -> DataFrame:
    """T4: one row per code with state, direction and strength of its newest bar.

    ``factor`` adds the column ``factor`` to the bars.  With ``now`` (epoch seconds) a newest bar that opened less
    than half a ``period`` before it is still forming and the state is pending.
    """
    newest = factor(bars).groupBy("code").agg(
        F.count(F.lit(1)).alias("bars_used"), F.max("ts").alias("last_ts"), F.max_by("factor", "ts").alias("factor")
    )
    enough = F.col("bars_used") >= min_bars
    pos = F.tanh(F.col("factor"))
    forming = F.lit(False) if now is None else now - F.unix_timestamp("last_ts") < period - period // 2
    finite = F.coalesce(F.abs("factor") < float("inf"), F.lit(False))  # NaN is above every number
    state = F.when(~enough, "insufficient").when(forming, "pending").when(~finite, "error").otherwise("ok")
    newest = newest.withColumn("state", state)
    ok = F.col("state") == "ok"
    return newest.select(
        "code", "bars_used", "last_ts", "state",
        F.when(ok, direction(pos, DEAD_BAND)).alias("direction"), F.when(ok, F.abs(pos)).alias("strength"),
    )


def refresh_signals(folder: str, factor: Callable[[DataFrame], DataFrame], min_bars: int = 100, keep: int = KEEP_BARS) -> Callable:
    """A foreachBatch body that re-evaluates all codes whenever bars close.

    The newest ``keep`` bars of every code are carried from batch to batch in ``folder``, so a batch reads them and its
    own bars only, and the cross-section also holds codes without a new bar.  A batch writes its own
    ``epoch=N`` folders and reads those of the batch before: repeated after a failure it writes the same again.
    ``keep`` has to cover the reach of ``factor`` and, for cross-section operators, the longest pause of a code.
    """
    newest_first = Window.partitionBy("code").orderBy(F.desc("ts"))

    def evaluate(batch: DataFrame, epoch: int, target: str) -> None:
        read = batch.sparkSession.read.schema(batch.schema)
        bars = batch.unionByName(read.parquet(f"{folder}/tail/{epoch - 1}")) if epoch else batch
        tail = bars.withColumn("_n", F.row_number().over(newest_first)).where(F.col("_n") <= keep).drop("_n")
        tail.write.mode("overwrite").parquet(f"{folder}/tail/{epoch}")
        signals = latest_signal(read.parquet(f"{folder}/tail/{epoch}"), min_bars, factor)
        signals.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return evaluate


def newest_epoch(signals: DataFrame) -> DataFrame:
    """The signals that the last batch wrote."""
    return signals.where(F.col("epoch") == signals.agg(F.max("epoch")).scalar()).drop("epoch")


def next_close(last_open: Column, now: Column, period: int) -> Column:
    """When the forming bar closes (epoch seconds); NULL while the market is closed."""
    tolerance = max(2 * period, 7200)
    closed = last_open + period
    steps = F.greatest(F.floor((now - (last_open + 2 * period)) / period) + 1, F.lit(0))
    following = last_open + 2 * period + steps * period
    open_market = (now - closed <= tolerance) & (following - closed <= tolerance)
    return F.when(closed > now, closed).when(open_market, following)
