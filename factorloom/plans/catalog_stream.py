"""Registered queries of the streaming jobs (T1-T7) with their batch twins, and of block-split tick series."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions.ops import OPS
from factorloom.functions.recursion import EMA_REACH, with_ema
from factorloom.functions.series import Series
from factorloom.operators import blocks
from factorloom.functions.features import features
from factorloom.plans.catalog_features import feature_sql
from factorloom.plans.catalog_ops import padded
from factorloom.plans.registry import BARS_SQL, query
from factorloom.plans.research import FACTOR_SQL, MOMENTUM, factor_table
from factorloom.sources.market import arrival, bars_hourly, ohlcv, stored, ticks
from factorloom.streaming import stream as st

_CLOSED = "ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def _ticks(spark, sf_dir):
    return st.tick_stream(spark, f"{sf_dir}/event[s].parquet")


def _closed(spark, sf_dir, folder):
    return st.run_available(st.closed_bars(_ticks(spark, sf_dir)), folder, "bars")


def _bar_stream(spark, bars, folder):
    return spark.readStream.schema(bars.schema).parquet(f"{folder}/bars")


@query("T7_tick_to_bar", "code:s ts:t open:d high:d low:d close:d volume:d amount:d", f"WITH {BARS_SQL} SELECT * FROM bars")
def t7(spark, sf_dir):
    return bars_hourly(spark, sf_dir)


@query("T1_stream_ingest", "code:s minute:t", "SELECT DISTINCT event_type AS code, date_trunc('minute', ts) AS minute FROM events")
def t1(spark, sf_dir):
    return st.run_available(st.ingest(_ticks(spark, sf_dir)), st.stream_folder(spark), "ticks")


_MINUTE_BARS = """SELECT event_type AS code, date_trunc('minute', ts) AS ts, arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ROW(ts, event_id)) AS close, count(*) AS volume, 2 - min(event_id % 3) AS corrections FROM events GROUP BY 1, 2"""


@query("T1_bar_versions", "code:s ts:t open:d high:d low:d close:d volume:i corrections:i", _MINUTE_BARS)
def t1_versions(spark, sf_dir):
    """Three overlapping deliveries of minute bars (over a third, two thirds and all of the ticks), the first one sent twice, one file a trigger."""
    folder, rows = st.stream_folder(spark), stored(ticks(spark, sf_dir).select("event_id", "code", "ts", "value"))
    for number, version in enumerate((0, 1, 0, 2)):
        minute = F.date_trunc("minute", "ts").alias("ts")
        part = rows.where(F.col("event_id") % 3 <= version).withColumn("_order", arrival("ts", "event_id"))
        bars = ohlcv(part, ["code", minute], F.col("_order"), F.col("value"), F.count(F.lit(1)), F.sum("value"))
        bars.withColumn("version", F.lit(version)).select("code", "ts", "open", "high", "low", "close", "volume", "version").coalesce(1).write.parquet(f"{folder}/in/d{number}")
    schema = spark.read.parquet(f"{folder}/in/d0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    return st.upsert_available(st.bar_versions(stream), folder, "bars")


@query(
    "T2_stream_closed_bars",
    "code:s ts:t open:d high:d low:d close:d volume:d",
    f"WITH {BARS_SQL} SELECT * FROM bars WHERE {_CLOSED}",
)
def t2(spark, sf_dir):
    return _closed(spark, sf_dir, st.stream_folder(spark))


_DIR_SQL = f"""{BARS_SQL}, dr AS (SELECT code, ts, CASE WHEN tanh(ln(close / open)) >= 0.05 THEN 1 WHEN tanh(ln(close / open)) <= -0.05 THEN -1 ELSE 0 END AS d
  FROM bars WHERE {{where}}), pv AS (SELECT *, lag(d) OVER (PARTITION BY code ORDER BY ts) AS p FROM dr)
SELECT code, ts, p AS previous, d AS direction FROM pv WHERE p IS NOT NULL AND p <> d"""


@query("T5_stream_direction_flips", "code:s ts:t previous:i direction:i", "WITH " + _DIR_SQL.format(where=_CLOSED))
def t5_stream(spark, sf_dir):
    """Closed bars land in a table; a second stream reads that table and keeps the direction per code."""
    folder = st.stream_folder(spark)
    bars = _closed(spark, sf_dir, folder)
    return st.run_available(st.direction_flips(_bar_stream(spark, bars, folder)), folder, "flips")


@query("T5_batch_direction_flips", "code:s ts:t previous:i direction:i", "WITH " + _DIR_SQL.format(where=_CLOSED))
def t5_batch(spark, sf_dir):
    newest = ticks(spark, sf_dir).agg(F.max("ts").alias("m")).scalar()
    closed = bars_hourly(spark, sf_dir).where(F.col("ts") + F.expr("interval 1 hour") <= newest - F.expr("interval 10 minutes"))
    df = closed.withColumn("direction", st.bar_direction())
    df = df.withColumn("previous", Series().lag("direction", 1))
    return df.where(F.col("previous").isNotNull() & (F.col("previous") != F.col("direction")))


_CLOSED_FACTOR_SQL = FACTOR_SQL.replace(
    "FROM events GROUP BY 1, 2",
    "FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2",
)


@query(
    "T3_T4_stream_latest_signal",
    "code:s bars_used:i last_ts:t state:s direction:i strength:d",
    f"""WITH {_CLOSED_FACTOR_SQL}
    SELECT code, least(count(*), 500) AS bars_used, max(ts) AS last_ts, 'ok' AS state, CASE WHEN tanh(arg_max(factor, ts)) >= 0.05 THEN 1 WHEN tanh(arg_max(factor, ts)) <= -0.05
      THEN -1 ELSE 0 END AS direction, abs(tanh(arg_max(factor, ts))) AS strength FROM factors GROUP BY code""",
)
def t4(spark, sf_dir):
    """foreachBatch: newly closed bars trigger a re-evaluation of all codes over their newest bars."""
    folder = st.stream_folder(spark)
    bars = _closed(spark, sf_dir, folder)
    refresh = st.refresh_signals(folder, lambda b: factor_table(spark, sf_dir, MOMENTUM, bars=b))
    return st.newest_epoch(st.run_available(_bar_stream(spark, bars, folder), folder, "signals", refresh))


@query(
    "T6_next_close",
    "code:s ts:t due:i",
    f"""WITH {BARS_SQL}, n AS (SELECT code, ts, CAST(epoch(ts) AS BIGINT) AS o, CAST(epoch(ts) AS BIGINT) + 3600 - 600 + rn * 977 % 12000 AS now FROM bars),
    f AS (SELECT *, o + 7200 + greatest(CAST(floor((now - (o + 7200)) / 3600.0) AS BIGINT) + 1, 0) * 3600 AS nx FROM n)
    SELECT code, ts, CASE WHEN o + 3600 > now THEN o + 3600 WHEN now - (o + 3600) <= 7200 AND nx - (o + 3600) <= 7200 THEN nx END AS due FROM f""",
)
def t6(spark, sf_dir):
    bars = bars_hourly(spark, sf_dir).withColumn("rn", Series().position())
    opened = F.unix_timestamp("ts")
    now = opened + 3600 - 600 + F.col("rn") * 977 % 12000
    return bars.select("code", "ts", st.next_close(opened, now, 3600).alias("due"))


# -- tick-level series: one code may hold a third of all rows --------------------------
_TICK_OPS = ["TS_MEAN_20", "TS_STD_20", "TS_RANK_10", "TS_ZSCORE_20", "DELTA_5", "WINSORIZE"]
TICK_SQL = """tk AS (SELECT event_id, event_type AS code, ts, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)"""


def tick_blocks(spark, sf_dir, halo, block_rows, running=None):
    """Numbered ticks cut into blocks; the day is the slice in which rows are numbered."""
    rows = ticks(spark, sf_dir).withColumnRenamed("value", "x")
    numbered = blocks.number_rows(rows, ["code"], ["ts", "event_id"], F.to_date("ts"), running)
    return blocks.split(numbered, halo, block_rows)


def tick_windows(spark, sf_dir, block_rows=10_000):
    s = blocks.block_series(Series())
    df = tick_blocks(spark, sf_dir, 32, block_rows)
    return blocks.trim(df.withColumns({n.lower(): OPS[n].build(s, "x") for n in _TICK_OPS}))


def _tick_sql():
    from factorloom.plans.catalog_ops import SQL_OPS

    lists = ", ".join(f"{padded('x', d)} AS x{d}" for d in (10, 20))
    cols = ", ".join(f"{SQL_OPS[n]} AS {n.lower()}" for n in _TICK_OPS)
    return f"""WITH {TICK_SQL}, l AS (SELECT *, {lists}, lag(x, 5) OVER (PARTITION BY code ORDER BY rn) AS p5 FROM tk) SELECT code, event_id, rn, {cols} FROM l"""


@query(
    "W_tick_series_in_blocks",
    "code:s event_id:i rn:i " + " ".join(f"{n.lower()}:d" for n in _TICK_OPS),
    _tick_sql().replace("ORDER BY ts ROWS", "ORDER BY rn ROWS"),
)
def w_ticks(spark, sf_dir):
    return tick_windows(spark, sf_dir)


@query(
    "U3_W40_tick_recursion_in_blocks",
    "code:s event_id:i rn:i ema_5:d scale:d",
    f"""WITH RECURSIVE {TICK_SQL}, e AS (SELECT code, event_id, rn, x, x AS y FROM tk WHERE rn = 1 UNION ALL
      SELECT t.code, t.event_id, t.rn, t.x, e.y * (1 - 2.0::DOUBLE / 6) + t.x * (2.0::DOUBLE / 6) FROM e JOIN tk t ON t.code = e.code AND t.rn = e.rn + 1)
    SELECT code, event_id, rn, y AS ema_5, x / (sum(abs(x)) OVER (PARTITION BY code ORDER BY rn) + 1e-6) AS scale FROM e""",
)
def u3_ticks(spark, sf_dir, block_rows=10_000):
    """The recursion restarts in each block behind a halo long enough for double precision; running
    sums are carried over from day totals."""
    s = blocks.block_series(Series())
    df = tick_blocks(spark, sf_dir, 5 * EMA_REACH, block_rows, {"total": F.abs(F.col("x"))})
    df = with_ema(df.select("code", "event_id", "x", "rn", "total", "block", "is_halo"), s, {"ema_5": ("x", (5,))})
    return blocks.trim(df).withColumn("scale", F.col("x") / (F.col("total") + 1e-6))


# -- features of minute bars: long series, cut into blocks ------------------------------
_MINUTE = ["RET5", "DEV60", "RSI14", "VOL_Z", "PV_CORR", "BOLL_WIDTH", "ROLL_SKEW_20", "DMI_ADX_14", "HURST_50"]


def minute_features(spark, sf_dir, halo=500, block_rows=1000):
    """Minute bars have no small bound per code: features are computed inside blocks with a halo.

    The longest chain here looks back 200 (norm) + 60 (window) + 10 (correlation) rows.
    """
    bars = stored(bars_hourly(spark, sf_dir, every="minute"))
    numbered = blocks.number_rows(bars, ["code"], ["ts"], F.to_date("ts"))
    cut = blocks.split(numbered, halo, block_rows)
    return blocks.trim(features(cut, _MINUTE, blocks.block_series(Series()), keep=["is_halo"]))


@query(
    "F_minute_features_in_blocks",
    "code:s ts:t " + " ".join(f"{n.lower()}:d" for n in _MINUTE),
    feature_sql(_MINUTE, False, cleaned=True).replace("date_trunc('hour', ts)", "date_trunc('minute', ts)"),
)
def minute_query(spark, sf_dir):
    return minute_features(spark, sf_dir).withColumnsRenamed({n: n.lower() for n in _MINUTE})
