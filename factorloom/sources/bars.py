"""Reading, normalising and maintaining bar tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.scalar import epoch_from_text, epoch_seconds, to_number

# Accepted column names, first match wins.
COLUMN_ALIASES = {
    "time": ("time", "datetime", "date", "trade_date", "日期", "时间", "交易日期"),
    "open": ("open", "open_price", "开盘", "开盘价"),
    "high": ("high", "high_price", "最高", "最高价"),
    "low": ("low", "low_price", "最低", "最低价"),
    "close": ("close", "close_price", "收盘", "收盘价"),
    "volume": ("volume", "tick_volume", "vol", "成交量", "成交量_股", "成交量(股)"),
    "symbol": ("symbol", "code", "stock_code", "ts_code", "股票代码", "证券代码", "代码"),
}
# Timeframe names by canonical timeframe.
TIMEFRAMES = {
    "M1": ("m1", "1m", "1min", "min1"),
    "M5": ("m5", "5m", "5min", "min5"),
    "M15": ("m15", "15m", "15min", "min15"),
    "M30": ("m30", "30m", "30min", "min30"),
    "H1": ("h1", "1h", "60m", "60min", "min60", "60"),
    "H4": ("h4", "4h", "240m", "240min", "min240", "240"),
    "D1": ("d1", "1d", "day", "daily", "1440m", "1440min"),
    "W1": ("w1", "1w", "week", "weekly"),
    "MN1": ("mn1", "1mo", "1mon", "month", "monthly"),
}
# Price-adjustment suffixes that are not part of a symbol.
ADJUSTMENTS = ("qfq", "hfq", "bfq", "forward", "backward", "adjusted", "adj")
MIN_BARS = 100


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename known aliases (case and outer blanks ignored); canonical names win."""
    by_name = {}
    for c in df.columns:
        by_name[c.strip().lower()] = c
    renames: dict[str, str] = {}
    for name, aliases in COLUMN_ALIASES.items():
        if name in df.columns:
            continue
        found = next((by_name[a] for a in aliases if by_name.get(a) and by_name[a] not in renames), None)
        if found is not None:
            renames[found] = name
    return df.withColumnsRenamed(renames)


def file_symbol(path: Column) -> Column:
    """S3: struct(symbol, timeframe) of ``{symbol}_{timeframe}.parquet``; NULL if it does not fit."""
    stem = F.regexp_extract(path, r"([^/]+)\.(?i:parquet)$", 1)
    token = F.lower(F.regexp_replace(F.regexp_extract(stem, r"_([^_]+)$", 1), "-", ""))
    name = F.regexp_extract(stem, r"^(.*)_[^_]+$", 1)
    suffix = r"(?i)^(.+?)(?:_+(?:" + "|".join(ADJUSTMENTS) + r"))*_*$"
    symbol = F.regexp_extract(F.regexp_replace(name, r"^_+|_+$", ""), suffix, 1)
    pairs = [F.lit(x) for tf, aliases in TIMEFRAMES.items() for a in aliases for x in (a, tf)]
    timeframe = F.try_element_at(F.create_map(*pairs), token)
    return F.when(
        timeframe.isNotNull() & (symbol != ""), F.struct(symbol.alias("symbol"), timeframe.alias("timeframe"))
    )


def only_symbol(symbol: Column) -> Column:
    """S4 as an aggregate: the single upper-cased non-blank symbol of a file, else NULL."""
    text = F.upper(F.trim(symbol.cast("string")))
    text = F.when(text != "", text)
    return F.when(F.min(text) == F.max(text), F.min(text))


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """C4: one row per key, the last by ``order``; map-side combined, so repeated keys do not skew."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return newest.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def enough_history(df: DataFrame, key: str = "code", rows: int = MIN_BARS) -> DataFrame:
    """Rows of keys with at least ``rows`` rows."""
    long = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= rows)
    return df.join(long.select(key), key, "left_semi")


def clean_bars(raw: DataFrame, order: str, min_rows: int = MIN_BARS, time: str = "time") -> DataFrame:
    """Coerce, drop bad quotes, deduplicate on (code, time), require a minimum history.

    ``raw`` has canonical columns plus ``code`` and ``order``, the position in the source.
    """
    kind = dict(raw.dtypes)[time]
    seconds = epoch_from_text(F.col(time)) if kind == "string" else (
        F.col(time).cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else epoch_seconds(raw, time)
    )
    numbers = {c: to_number(F.col(c).cast("string")) for c in ("open", "high", "low", "close", "volume")}
    df = raw.withColumns({"time": seconds, **numbers})
    df = df.dropna(subset=["time", "open", "high", "low", "close", "volume"])
    good = (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0)
    df = keep_last(df.where(good), ["code", "time"], order)
    df = df.select("code", F.timestamp_seconds(F.col("time")).alias("ts"), "open", "high", "low", "close", "volume")
    return enough_history(df, "code", min_rows)


def read_bars(spark: SparkSession, path: str, min_rows: int = MIN_BARS) -> DataFrame:
    """S1 + S2 + S3 + S4 + S6: every ``{symbol}_{timeframe}.parquet`` below ``path`` as one bar table."""
    files = spark.read.option("mergeSchema", "true").parquet(path)
    files = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    raw = canonical_columns(files)
    raw = raw.withColumn("_name", file_symbol(F.col("_file"))).where(F.col("_name").isNotNull())
    if "symbol" in raw.columns:
        inside = raw.groupBy("_file").agg(only_symbol(F.col("symbol")).alias("_inside"))
        raw = raw.join(inside, "_file").withColumn("code", F.coalesce("_inside", "_name.symbol"))
    else:
        raw = raw.withColumn("code", F.col("_name.symbol"))
    return clean_bars(raw.withColumn("_seq", F.struct("_file", "_row")), "_seq", min_rows)


def inspect(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ("code",)) -> DataFrame:
    """Bars, first and last time, years covered and whether the history is long enough."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    span = F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")
    return out.withColumns(
        {"years": F.round(span / (365.25 * 86400), 2), "enough": F.col("bars") >= MIN_BARS}
    )


def list_files(spark: SparkSession, path: str, ts: str) -> DataFrame:
    """Rows, newest time and size per file; one pass over two columns and the file metadata."""
    df = spark.read.parquet(path).select(ts, "_metadata.file_name", "_metadata.file_size")
    return df.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(ts).alias("last_ts"), F.max("file_size").alias("file_size")
    )


def append_new(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("code",), ts: str = "ts") -> DataFrame:
    """Incoming rows newer than the stored last time of their key, without duplicates, plus the stored rows."""
    last = stored.groupBy(*keys).agg(F.max(ts).alias("_last"))
    fresh = incoming.join(last, list(keys), "left").where(F.col("_last").isNull() | (F.col(ts) > F.col("_last")))
    return stored.unionByName(fresh.drop("_last").dropDuplicates([*keys, ts]))


def update_report(before: DataFrame, after: DataFrame, key: str = "code") -> DataFrame:
    """Rows per key before and after an update."""
    b = before.groupBy(key).agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.groupBy(key).agg(F.count(F.lit(1)).alias("rows_after"))
    out = b.join(a, key, "full_outer").na.fill(0, ["rows_before", "rows_after"])
    return out.withColumn("rows_added", F.col("rows_after") - F.col("rows_before"))


def decode_candles(json: Column) -> Column:
    """``[ts_ms, open, high, low, close, volume, _, _, confirmed]`` text to a struct."""
    items = F.from_json(json, "array<string>")

    def number(i: int) -> Column:
        return items.getItem(i).try_cast("double")

    return F.struct(
        F.timestamp_millis(items.getItem(0).try_cast("bigint")).alias("ts"),
        number(1).alias("open"),
        number(2).alias("high"),
        number(3).alias("low"),
        number(4).alias("close"),
        number(5).alias("volume"),
        (F.coalesce(items.getItem(8), F.lit("1")) != "0").alias("confirmed"),
    )


def merge_pages(pages: Sequence[DataFrame], keys: Sequence[str] = ("code", "ts")) -> DataFrame:
    """Union of history pages, one row per key."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out.dropDuplicates(list(keys))


def main_contract(df: DataFrame, at: Sequence[str], contract: str = "contract", volume: str = "volume") -> DataFrame:
    """Per time the row with the largest volume; ties by contract name.

    A max over a struct combines on the map side, so a time with many contracts does not skew.
    """
    rest = [c for c in df.columns if c not in at]
    best = df.groupBy(*at).agg(F.min_by(F.struct(*rest), F.struct(-F.col(volume), F.col(contract))).alias("_b"))
    return best.select(*at, *[F.col(f"_b.{c}").alias(c) for c in rest])


def downsample(df: DataFrame, key: str, position: str, total: str, points: int = 1500) -> DataFrame:
    """At most ``points`` evenly spaced rows per key, first and last included."""
    index, last, steps = F.col(position) - 1, F.greatest(F.col(total) - 1, F.lit(1)), F.lit(points - 1)
    # index i is kept if it is floor(j * last / steps) for some whole j: try the smallest candidate
    j = F.floor((index * steps + last - 1) / last)
    return df.where((F.col(total) <= points) | (F.floor(j * last / steps) == index))
