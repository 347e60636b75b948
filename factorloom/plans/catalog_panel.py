"""Registered queries of sources, conversions, joins, aggregations and panel construction (S, C, J, G, P)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorloom.functions import scalar
from factorloom.functions.series import Series
from factorloom.operators import backtest as bt
from factorloom.operators import joins, panel as pn
from factorloom.plans.catalog_backtest import TRADES_SQL
from factorloom.plans.registry import BARS_SQL, INTERVALS_SQL, MEMBERS_SQL, PANEL_SQL, WEEKLY_SQL, query
from factorloom.plans.research import PNL_SQL, pnl
from factorloom.session import shared_folder
from factorloom.sources import bars as src
from factorloom.sources import store
from factorloom.sources.market import (
    bars_hourly, industry_intervals, membership, panel, stored, table, ticks,
)

DATED = Series(keys=("code",), order="date", at=("date",))

# -- raw text feed derived from the ticks: what a vendor file looks like -----------------
RAW_SQL = """raw AS (SELECT event_id, event_type AS code, date_trunc('minute', ts) AS minute, value,
  CASE WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 13 = 0 THEN 'inf' WHEN event_id % 17 = 0 THEN 'nan'
       WHEN event_id % 19 = 0 THEN CAST(-value AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS price_text FROM events)"""


def raw_feed(spark, sf_dir):
    e = ticks(spark, sf_dir)
    i = F.col("event_id")
    text = (
        F.when(i % 11 == 0, "n/a").when(i % 13 == 0, "inf").when(i % 17 == 0, "nan")
        .when(i % 19 == 0, (-F.col("value")).cast("string")).otherwise(F.col("value").cast("string"))
    )
    return e.select("event_id", "code", F.date_trunc("minute", "ts").alias("minute"), "value", text.alias("price_text"))


_NUM = "CASE WHEN price_text IN ('n/a', 'inf', 'nan') THEN NULL ELSE CAST(price_text AS DOUBLE) END"


@query(
    "S1_clean_bars",
    "code:s ts:t close:d volume:d",
    f"""WITH {RAW_SQL}, g AS (SELECT code, minute AS ts, {_NUM} AS close, CAST(event_id % 5 AS DOUBLE) AS volume, event_id
      FROM raw), d AS (SELECT *, row_number() OVER (PARTITION BY code, ts ORDER BY event_id DESC) AS k FROM g WHERE close > 0)
    SELECT code, ts, close, volume FROM d WHERE k = 1 AND code IN
      (SELECT code FROM d WHERE k = 1 GROUP BY code HAVING count(*) >= 100)""",
)
def s1(spark, sf_dir):
    raw = raw_feed(spark, sf_dir)
    price = [F.col("price_text").alias(c) for c in ("open", "high", "low", "close")]
    vendor = raw.select(
        "code", F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("时间"), *price,
        (F.col("event_id") % 5).cast("string").alias(" VOL "), "event_id",
    )
    named = src.canonical_columns(vendor.withColumnRenamed("code", "_code")).withColumnRenamed("_code", "code")
    return src.clean_bars(named, "event_id")


@query(
    "S2_column_aliases",
    "code:s time:t close:d volume:d",
    "SELECT event_type AS code, ts AS time, value AS close, CAST(event_id % 5 AS DOUBLE) AS volume FROM events",
)
def s2(spark, sf_dir):
    e = ticks(spark, sf_dir).select(
        F.col("code").alias("tag"), F.date_trunc("second", "ts").alias("x"), F.col("ts").alias(" Trade_Date"),
        F.col("value").alias("收盘价"), (F.col("event_id") % 5).cast("double").alias("成交量"),
    )
    return src.canonical_columns(e).withColumn("code", F.col("tag"))


_TF = [(a, tf) for tf, names in src.TIMEFRAMES.items() for a in names]


@query(
    "S3_symbol_from_file_name",
    "path:s symbol:s timeframe:s n:i",
    f"""WITH m AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{tf}')" for i, (a, tf) in enumerate(_TF))}) t(i, alias, tf)),
    p AS (SELECT event_id % {len(_TF) + 1} AS i, event_type, event_id % 3 AS k FROM events)
    SELECT 'dir/' || event_type || CASE k WHEN 0 THEN '_' ELSE '_QFQ_' END || coalesce(alias, 'tick') || '.parquet' AS path,
      CASE WHEN tf IS NOT NULL THEN event_type END AS symbol, tf AS timeframe, count(*) AS n
    FROM p LEFT JOIN m USING (i) GROUP BY ALL""",
)
def s3(spark, sf_dir):
    i = F.col("event_id") % (len(_TF) + 1)
    alias = F.element_at(F.array(*[F.lit(a) for a, _ in _TF], F.lit("tick")), (i + 1).cast("int"))
    mark = F.when(F.col("event_id") % 3 == 0, "_").otherwise("_QFQ_")
    path = F.concat(F.lit("dir/"), F.col("code"), mark, alias, F.lit(".parquet"))
    df = ticks(spark, sf_dir).groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return df.withColumn("_f", src.file_symbol(F.col("path"))).select("path", "_f.symbol", "_f.timeframe", "n")


@query(
    "S4_in_file_symbol",
    "file:i symbol:s",
    """SELECT file, CASE WHEN count(DISTINCT s) = 1 THEN any_value(s) END AS symbol FROM (SELECT user_id AS file,
      nullif(upper(trim(CASE WHEN user_id % 2 = 0 THEN '  aa ' WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END)), '') AS s
      FROM events) GROUP BY file""",
)
def s4(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("user_id") % 2 == 0, "  aa ").when(F.col("event_id") % 4 == 0, " ").otherwise(F.col("event_type"))
    return e.groupBy(F.col("user_id").alias("file")).agg(src.only_symbol(text).alias("symbol"))


@query(
    "S5_Q11_inspect_bars",
    "code:s bars:i first_ts:t last_ts:t years:d enough:b",
    f"""WITH {BARS_SQL} SELECT code, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts,
      round((epoch(max(ts)) - epoch(min(ts))) / (365.25 * 86400), 2) AS years, count(*) >= 100 AS enough FROM bars GROUP BY code""",
)
def s5(spark, sf_dir):
    return src.inspect(bars_hourly(spark, sf_dir))


@query(
    "S6_multi_part_read",
    "n_rows:i total:c",
    "SELECT count(*) AS n_rows, sum(l_extendedprice) AS total FROM lineitem",
)
def s6(spark, sf_dir):
    parts = spark.read.option("mergeSchema", "true").parquet(f"{sf_dir}/lineitem.parquet")
    return parts.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_extendedprice").alias("total"))


@query(
    "S7_list_files",
    "file_name:s n_rows:i last_ts:t",
    "SELECT 'events.parquet' AS file_name, count(*) AS n_rows, date_trunc('second', max(ts)) AS last_ts FROM events",
)
def s7(spark, sf_dir):
    files = src.list_files(spark, f"{sf_dir}/events.parquet", "ts")
    return files.withColumn("last_ts", F.date_trunc("second", "last_ts"))


_OLD, _NEW = "ts < TIMESTAMP '2024-01-20'", "ts >= TIMESTAMP '2024-01-18'"


def _old_new(spark, sf_dir):
    bars = bars_hourly(spark, sf_dir).select("code", "ts", "close")
    old = bars.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    new = bars.where(F.col("ts") >= F.lit("2024-01-18").cast("timestamp"))
    return old, new.unionByName(new)


@query(
    "S8_incremental_append",
    "code:s ts:t close:d",
    f"WITH {BARS_SQL} SELECT code, ts, close FROM bars",
)
def s8(spark, sf_dir):
    return src.append_new(*_old_new(spark, sf_dir))


@query(
    "S9_update_report",
    "code:s rows_before:i rows_after:i rows_added:i",
    f"""WITH {BARS_SQL} SELECT code, count(*) FILTER ({_OLD}) AS rows_before, count(*) AS rows_after,
      count(*) - count(*) FILTER ({_OLD}) AS rows_added FROM bars GROUP BY code""",
)
def s9(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return src.update_report(old, src.append_new(old, new))


@query(
    "S10_candle_json",
    "code:s ts:t close:d volume:d",
    f"""WITH {BARS_SQL} SELECT code, ts, close, volume FROM bars WHERE ts < (SELECT max(ts) FROM bars b WHERE b.code = bars.code)""",
)
def s10(spark, sf_dir):
    bars = bars_hourly(spark, sf_dir)
    newest = F.max("ts").over(Window.partitionBy("code"))
    text = F.to_json(
        F.array(
            F.unix_millis("ts").cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")],
            F.lit("0"), F.lit("0"), F.when(F.col("ts") == newest, "0").otherwise("1"),
        )
    )
    decoded = bars.select("code", text.alias("payload")).select("code", src.decode_candles(F.col("payload")).alias("c"))
    return decoded.select("code", "c.*").where("confirmed")


@query("S11_merge_pages", "code:s ts:t close:d", f"WITH {BARS_SQL} SELECT code, ts, close FROM bars")
def s11(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return src.merge_pages([old, new])


@query(
    "S12_V34_snapshot_manifest",
    "table:s n_rows:i digest:i",
)
def s12(spark, sf_dir):
    out = None
    for name, df in {"bars": bars_hourly(spark, sf_dir), "industry": industry_intervals(spark, sf_dir)}.items():
        row = store.fingerprint(store.with_lineage(df, schema_version="1", source="warehouse"))
        row = row.withColumn("table", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


_BAR_TEXT = "code || '|' || epoch(ts)::BIGINT || '|' || CAST(floor(close * 1000000::DOUBLE + 0.5::DOUBLE) AS BIGINT) || '|' || CAST(volume AS BIGINT)"
_HEAD = "('0x' || left(md5({x}), 8))::BIGINT"


def bar_texts():
    """Columns of a bar as texts: prices in millionths."""
    return ["code", F.unix_timestamp("ts").cast("string"), F.floor(F.col("close") * 1000000.0 + 0.5).cast("bigint").cast("string"), F.col("volume").cast("bigint").cast("string")]


@query(
    "S12_snapshot_publish",
    "table:s n_rows:i digest:i broken:i",
    f"""WITH {BARS_SQL}, {INTERVALS_SQL} SELECT 'bars' AS "table", count(*) AS n_rows, sum({_HEAD.format(x=_BAR_TEXT)}) AS digest, 0 AS broken FROM bars
      UNION ALL SELECT 'industry', count(*), sum({_HEAD.format(x="code || '|' || CAST(valid_from AS VARCHAR) || '|' || industry")}), 0 FROM intervals""",
)
def s12_publish(spark, sf_dir):
    """Both tables written, published, verified and read back from the published version."""
    tables = {"bars": store.with_lineage(bars_hourly(spark, sf_dir), schema_version="1"), "industry": industry_intervals(spark, sf_dir)}
    version = store.publish_snapshot(tables, f"{shared_folder(spark)}/snapshots", {"bars": "code"})
    broken = store.verify_snapshot(spark, version).groupBy("table").agg(F.count(F.lit(1)).alias("broken"))
    texts = {"bars": bar_texts(), "industry": [F.col("code").cast("string"), F.col("valid_from").cast("string"), "industry"]}
    out = None
    for name, columns in texts.items():
        row = store.text_fingerprint(store.open_snapshot(spark, version, name), columns).withColumn("table", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.join(broken, "table", "left").na.fill(0, ["broken"])


@query("V34_text_fingerprint", "n_rows:i digest:i", f"WITH {BARS_SQL} SELECT count(*) AS n_rows, sum({_HEAD.format(x=_BAR_TEXT)}) AS digest FROM bars")
def v34_text(spark, sf_dir):
    return store.text_fingerprint(bars_hourly(spark, sf_dir), bar_texts())


@query(
    "S13_G18_sealed_split",
    "part:s n_rows:i first:t last:t shared:i",
    f"""WITH {PANEL_SQL} SELECT CASE WHEN date < DATE '2000-01-01' THEN 'development' ELSE 'holdout' END AS part,
      count(*) AS n_rows, min(date) AS first, max(date) AS last, 0 AS shared FROM panel GROUP BY 1""",
)
def s13(spark, sf_dir):
    df = stored(panel(spark, sf_dir))
    parts = store.seal_split(df, F.lit("2000-01-01").cast("date"))
    shared = parts[0].select("date").intersect(parts[1].select("date")).agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = [
        p.agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last"))
        .withColumns({"part": F.lit(n), "shared": shared})
        for n, p in zip(("development", "holdout"), parts)
    ]
    return rows[0].unionByName(rows[1])


@query(
    "S14_factor_store_upsert",
    "factor_id:i value:d updated_at:i",
    """SELECT user_id AS factor_id, arg_max(value, event_id) AS value, max(event_id) AS updated_at FROM events GROUP BY 1""",
)
def s14(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("factor_id"), "value", F.col("event_id").alias("updated_at")
    )
    return store.upsert(e.where(F.col("updated_at") % 2 == 0), e.where(F.col("updated_at") % 2 == 1))


@query(
    "S15_equity_export",
    "code:s rn:i payload:s",
    f"""WITH {PNL_SQL}, k AS (SELECT DISTINCT code, bars, unnest(list_transform(range(200), lambda j: j * (bars - 1) // 199)) AS i
      FROM (SELECT DISTINCT code, bars FROM pnl))
    SELECT c.code, c.rn, '{{"rn":' || c.rn || ',"up":' || CAST(CAST(round(c.cum * 1000000) AS BIGINT) AS VARCHAR) || '}}' AS payload
    FROM cum c JOIN k ON k.code = c.code AND k.i = c.rn - 1""",
)
def s15(spark, sf_dir):
    """Cumulative P&L in millionths at 200 evenly spaced rows per code, as JSON."""
    curve = src.downsample(bt.cumulative(pnl(spark, sf_dir)), "code", "rn", "bars", points=200)
    micro = F.round(F.col("cum") * 1000000).cast("bigint").alias("up")
    return curve.select("code", "rn", F.to_json(F.struct("rn", micro)).alias("payload"))


@query(
    "S16_report_json",
    "code:s trade:s",
    f"""WITH {TRADES_SQL} SELECT code, '{{"direction":' || direction || ',"entry_rn":' || entry_rn || ',"hold_bars":' || hold_bars || ',"micro_pnl":'
      || CAST(floor(pnl * 1000000::DOUBLE + 0.5::DOUBLE) AS BIGINT) || '}}' AS trade FROM trades""",
)
def s16(spark, sf_dir):
    """One JSON text per trade, P&L in millionths."""
    micro = F.floor(F.col("pnl") * 1000000.0 + 0.5).alias("micro_pnl")
    return store.trade_report(bt.trades(pnl(spark, sf_dir)).select("code", "direction", "entry_rn", "hold_bars", micro))


@query(
    "S17_main_contract",
    "ts:t contract:i price:d volume:d",
    """SELECT ts, contract, price, volume FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY volume DESC, contract) AS k
      FROM (SELECT date_trunc('hour', ts) AS ts, user_id AS contract, round(avg(value), 6) AS price,
            CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)) WHERE k = 1""",
)
def s17(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    contracts = e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), F.col("user_id").alias("contract")).agg(
        F.round(F.avg("value"), 6).alias("price"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return src.main_contract(contracts, ["ts"])


# -- scalar conversions ----------------------------------------------------------------
@query(
    "C1_epoch_units",
    "event_id:i from_s:i from_ms:i from_ns:i from_legacy:i from_text:i",
    """SELECT event_id, s AS from_s, s AS from_ms, s AS from_ns, s AS from_legacy, CASE WHEN event_id % 9 <> 0 THEN s END AS from_text
    FROM (SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events)""",
)
def c1(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    e = e.select(
        "event_id", "s", (F.col("s") * 1000).alias("ms"), (F.col("s") * 1000000000).alias("ns"),
        (F.col("s") / 1000).alias("legacy"),
        F.when(F.col("event_id") % 9 == 0, "no time").otherwise(F.timestamp_seconds("s").cast("string")).alias("text"),
    )
    return e.select(
        "event_id",
        *[F.round(scalar.epoch_seconds(e, c)).alias(f"from_{c}") for c in ("s", "ms", "ns", "legacy")],
        scalar.epoch_from_text(F.col("text")).alias("from_text"),
    )


@query(
    "C2_numeric_coercion",
    "event_id:i value:d",
    f"WITH {RAW_SQL} SELECT event_id, {_NUM} AS value FROM raw",
)
def c2(spark, sf_dir):
    return raw_feed(spark, sf_dir).select("event_id", scalar.to_number(F.col("price_text")).alias("value"))


_SPOILED_SQL = f"""{BARS_SQL}, spoiled AS (SELECT code, ts, rn, open, high, CASE WHEN rn % 7 = 0 THEN high + 1 ELSE low END AS low,
  CASE WHEN rn % 11 = 0 THEN -close WHEN rn % 13 = 0 THEN NULL ELSE close END AS close,
  CASE WHEN rn % 17 = 0 THEN -1 WHEN rn % 5 = 0 THEN 0 ELSE volume END AS volume FROM bars)"""


def spoiled(spark, sf_dir):
    """Hourly bars with planted defects, to exercise predicates and quality checks."""
    bars = bars_hourly(spark, sf_dir).withColumn("rn", Series().position())
    rn = F.col("rn")
    return bars.select(
        "code", "ts", "rn", "open", "high",
        F.when(rn % 7 == 0, F.col("high") + 1).otherwise(F.col("low")).alias("low"),
        F.when(rn % 11 == 0, -F.col("close")).when(rn % 13 == 0, None).otherwise(F.col("close")).alias("close"),
        F.when(rn % 17 == 0, -1.0).when(rn % 5 == 0, 0.0).otherwise(F.col("volume")).alias("volume"),
    )


@query(
    "C3_valid_quote",
    "code:s ts:t",
    f"WITH {_SPOILED_SQL} SELECT code, ts FROM spoiled WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0",
)
def c3(spark, sf_dir):
    return spoiled(spark, sf_dir).where(scalar.valid_quote())


@query(
    "C4_keep_last",
    "code:s minute:t value:d event_id:i",
    """SELECT event_type AS code, date_trunc('minute', ts) AS minute, arg_max(value, event_id) AS value, max(event_id) AS event_id
    FROM events GROUP BY 1, 2""",
)
def c4(spark, sf_dir):
    df = raw_feed(spark, sf_dir).select("code", "minute", "value", "event_id")
    return src.keep_last(df, ["code", "minute"], "event_id")


@query(
    "C5_minimum_history",
    "o_custkey:i n:i",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12",
)
def c5(spark, sf_dir):
    kept = src.enough_history(table(spark, sf_dir, "orders"), "o_custkey", 12)
    return kept.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C6_trade_date",
    "o_orderkey:i d:t",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL
      ELSE CAST(o_orderdate AS DATE) END AS d FROM orders""",
)
def c6(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    number = F.date_format("o_orderdate", "yyyyMMdd")
    text = (
        F.when(F.col("o_orderkey") % 6 == 0, "19000101").when(F.col("o_orderkey") % 6 == 1, "18500101")
        .when(F.col("o_orderkey") % 6 == 2, "not a date").when(F.col("o_orderkey") % 6 == 3, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(number)
    )
    return o.select("o_orderkey", scalar.trade_date(text).alias("d"))


@query(
    "C7_derived_availability",
    "date:t session_open:t available_at:t market_date:t",
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) + INTERVAL 90 MINUTE AS session_open,
      CAST(o_orderdate AS DATE) + INTERVAL 13 HOUR AS available_at, CAST(o_orderdate AS DATE) AS market_date FROM orders""",
)
def c7(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    at = scalar.at_local(F.col("date"), "21:00:00")
    return d.select(
        "date", scalar.at_local(F.col("date"), "09:30:00").alias("session_open"), at.alias("available_at"),
        scalar.local_date(at).alias("market_date"),
    )


@query(
    "C8_flags",
    "o_orderkey:i flag:b",
    """SELECT o_orderkey, o_orderkey % 8 IN (0, 2, 4, 7) AS flag FROM orders""",
)
def c8(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in (" y", "N", "true", "0", "2.5", "", "off", "YES ")])
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", scalar.flag(F.element_at(words, (F.col("o_orderkey") % 8 + 1).cast("int"))).alias("flag"))


PRE_SQL = f"""{PANEL_SQL}, pre AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date)
  * (1 - 0.01 * (month(date) % 2)) AS preclose, month(date) = 6 AND code % 3 = 0 AS suspended FROM panel)"""


def with_preclose(df):
    close = F.lag("close").over(DATED.ordered())
    return df.withColumns(
        {
            "preclose": close * (1 - 0.01 * (F.month("date") % 2)),
            "suspended": (F.month("date") == 6) & (F.col("code") % 3 == 0),
        }
    )


TRADABLE_SQL = f"""{PRE_SQL}, tradable AS (SELECT *, NOT suspended AND coalesce(open < preclose * 1.1 - 0.01, false) AS can_buy_open,
  NOT suspended AND coalesce(open > preclose * 0.9 + 0.01, false) AS can_sell_open FROM pre)"""


def tradable(spark, sf_dir):
    df = with_preclose(stored(panel(spark, sf_dir)))
    return df.withColumns(
        scalar.tradability(
            F.col("open"), F.col("volume"), F.col("amount"), F.col("suspended"), F.col("preclose") * 1.1, F.col("preclose") * 0.9
        )
    )


@query(
    "C9_tradability",
    "code:i date:t can_buy_open:b can_sell_open:b buy_block_reason:s sell_block_reason:s",
    f"""WITH {TRADABLE_SQL} SELECT code, date, can_buy_open, can_sell_open,
      CASE WHEN suspended THEN 'SUSPENDED' WHEN NOT can_buy_open THEN 'LIMIT_UP_OPEN' END AS buy_block_reason,
      CASE WHEN suspended THEN 'SUSPENDED' WHEN NOT can_sell_open THEN 'LIMIT_DOWN_OPEN' END AS sell_block_reason FROM tradable""",
)
def c9(spark, sf_dir):
    return tradable(spark, sf_dir)


@query(
    "C10_row_hash",
    "s_suppkey:i hash:s",
    """SELECT s_suppkey, sha256(concat_ws('|', CAST(s_suppkey AS VARCHAR), s_name,
      coalesce(CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) END, ''))) AS hash FROM supplier""",
)
def c10(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("n", F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")))
    return s.select("s_suppkey", scalar.row_hash(["s_suppkey", "s_name", "n"]).alias("hash"))


@query(
    "C11_payload_hash",
    "s_suppkey:i hash:s",
    """SELECT s_suppkey, sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}')
      AS hash FROM supplier""",
)
def c11(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", scalar.payload_hash(["s_suppkey", "s_name", "s_nationkey"]).alias("hash"))


@query(
    "C12_code_normalisation",
    "code:s exchange:s n:i",
    """SELECT upper(o_orderstatus) || '.' || upper(substr(o_orderpriority, 3)) AS code, upper(substr(o_orderpriority, 3)) AS exchange,
      count(*) AS n FROM orders GROUP BY 1, 2""",
)
def c12(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.lower("o_orderstatus"), F.lit("."), F.expr("substring(o_orderpriority, 3)"), F.lit(" "))
    code = scalar.code_key(raw)
    o = table(spark, sf_dir, "orders").select(code.alias("code"))
    return o.groupBy("code", scalar.exchange(F.col("code")).alias("exchange")).agg(F.count(F.lit(1)).alias("n"))


_FLAGS = {
    "high_below_body": "high < greatest(open, close)", "low_above_body": "low > least(open, close)",
    "high_below_low": "high < low", "bad_price": "least(open, high, low, close) <= 0", "zero_volume": "volume = 0",
    "jump": "coalesce(abs((close - pc) / pc) > 0.5, false)",
}


@query(
    "C13_Q14_sanity_flags",
    "code:s n_rows:i " + " ".join(f"{k}:i" for k in _FLAGS),
    f"""WITH {_SPOILED_SQL}, p AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY ts) AS pc FROM spoiled)
    SELECT code, count(*) AS n_rows, {', '.join(f"count(*) FILTER ({e}) AS {k}" for k, e in _FLAGS.items())} FROM p GROUP BY code""",
)
def c13(spark, sf_dir):
    df = spoiled(spark, sf_dir).withColumn("pc", F.lag("close").over(Series().ordered()))
    flags = scalar.sanity_flags(F.col("pc"))
    return df.groupBy("code").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(e, 1)).alias(k) for k, e in flags.items()]
    )


@query(
    "C14_F68_safe_log_return",
    "code:s ts:t r1:d r5:d",
    f"""WITH {_SPOILED_SQL}, p AS (SELECT *, lag(close) OVER c AS p1, lag(close, 5) OVER c AS p5 FROM spoiled
      WINDOW c AS (PARTITION BY code ORDER BY ts))
    SELECT code, ts, CASE WHEN close > 0 AND p1 > 0 THEN ln(close / p1) END AS r1,
      CASE WHEN close > 0 AND p5 > 0 THEN ln(close / p5) END AS r5 FROM p""",
)
def c14(spark, sf_dir):
    s = Series()
    return spoiled(spark, sf_dir).select(
        "code", "ts",
        scalar.safe_log_return(F.col("close"), s.lag("close", 1)).alias("r1"),
        scalar.safe_log_return(F.col("close"), s.lag("close", 5)).alias("r5"),
    )


@query(
    "C19_cost_by_asset_class",
    "symbol:s cost:d n:i",
    """SELECT symbol, CASE WHEN symbol LIKE 'XA%' THEN 0.0002 WHEN symbol IN ('US30.cash', 'JP225', 'DE40.cash') THEN 0.0003
      ELSE 0.00015 END AS cost, count(*) AS n FROM (SELECT (['XAUUSD', 'US30.cash', 'JP225', 'EURUSD', 'DE40.cash'])[c_nationkey % 5 + 1]
      AS symbol FROM customer) GROUP BY 1, 2""",
)
def c19(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("XAUUSD", "US30.cash", "JP225", "EURUSD", "DE40.cash")])
    c = table(spark, sf_dir, "customer").select(F.element_at(names, (F.col("c_nationkey") % 5 + 1).cast("int")).alias("symbol"))
    return c.groupBy("symbol", scalar.cost_by_class(F.col("symbol")).alias("cost")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "C20_half_spread",
    "code:s ts:t cost:d",
    f"""WITH {BARS_SQL} SELECT code, ts, CASE WHEN volume > 1 THEN (high - low) / 2 / ((high + low) / 2) ELSE 0.0001 END AS cost FROM bars""",
)
def c20(spark, sf_dir):
    quoted = F.col("volume") > 1
    bid, ask = F.when(quoted, F.col("low")), F.when(quoted, F.col("high"))
    return bars_hourly(spark, sf_dir).select("code", "ts", scalar.half_spread(bid, ask).alias("cost"))


# -- joins -----------------------------------------------------------------------------
@query(
    "J1_timeline_intersection",
    "code:s ts:t close:d",
    f"""WITH {BARS_SQL} SELECT code, ts, close FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts
      HAVING count(DISTINCT code) = (SELECT count(DISTINCT code) FROM bars))""",
)
def j1(spark, sf_dir):
    return joins.common_timeline(bars_hourly(spark, sf_dir))


ASOF_SQL = f"""{PANEL_SQL}, {INTERVALS_SQL}, joined AS (SELECT p.code, p.date, i.valid_from, i.valid_to, i.known_at,
  i.industry AS asof_industry FROM panel p ASOF LEFT JOIN intervals i ON p.code = i.code AND p.date >= i.valid_from)"""


def with_industry(spark, sf_dir, base=None):
    """Panel rows with the industry as it was known at 21:00 of the date."""
    base = panel(spark, sf_dir) if base is None else base
    intervals = industry_intervals(spark, sf_dir).withColumnRenamed("industry", "asof_industry")
    joined = joins.asof(base, intervals, "code", "date", "valid_from")
    cutoff = F.expr("cast(date as timestamp) + interval 21 hours")
    return joins.valid_interval(joined, ["asof_industry"], cutoff=cutoff)


@query(
    "J2_asof_with_validity",
    "code:i date:t asof_industry:s",
    f"""WITH {ASOF_SQL} SELECT code, date, CASE WHEN (valid_to IS NULL OR date <= valid_to) AND known_at IS NOT NULL
      AND known_at <= CAST(date AS TIMESTAMP) + INTERVAL 21 HOUR THEN asof_industry END AS asof_industry FROM joined""",
)
def j2(spark, sf_dir):
    return with_industry(spark, sf_dir)


@query(
    "J15_asof_latest_attribute",
    "code:i date:t filled:s",
    f"WITH {ASOF_SQL} SELECT code, date, asof_industry AS filled FROM joined",
)
def j15(spark, sf_dir):
    intervals = industry_intervals(spark, sf_dir).withColumnRenamed("industry", "filled")
    return joins.asof(panel(spark, sf_dir), intervals, "code", "date", "valid_from")


@query(
    "J3_interval_expansion",
    "date:t code:i industry:s",
    f"""WITH {PANEL_SQL}, {INTERVALS_SQL}, cal AS (SELECT DISTINCT date FROM panel)
    SELECT cal.date, i.code, i.industry FROM intervals i JOIN cal ON cal.date >= i.valid_from
      AND (i.valid_to IS NULL OR cal.date <= i.valid_to)""",
)
def j3(spark, sf_dir):
    calendar = stored(panel(spark, sf_dir).select("date").distinct())
    return joins.expand_intervals(industry_intervals(spark, sf_dir), calendar, "month")


@query(
    "J4_member_led_join",
    "date:t code:i weight_pct:d close:d can_buy_open:b",
    f"""WITH {TRADABLE_SQL}, {MEMBERS_SQL} SELECT m.date, m.code, m.weight_pct, CASE WHEN month(m.date) <> 5 THEN t.close END AS close,
      CASE WHEN month(m.date) <> 5 THEN t.can_buy_open END AS can_buy_open FROM members m LEFT JOIN tradable t
      ON t.date = m.date AND t.code = m.code""",
)
def j4(spark, sf_dir):
    all_rows = tradable(spark, sf_dir)
    members = membership(all_rows.select("date", "code", "amount"))
    known = all_rows.where(F.month("date") != 5)
    return joins.member_led(members, known.select("date", "code", "close"), known.select("date", "code", "can_buy_open"))


@query(
    "J5_P9_ever_members",
    "date:t code:i close:d",
    f"WITH {PANEL_SQL}, {MEMBERS_SQL} SELECT date, code, close FROM panel WHERE code IN (SELECT code FROM members)",
)
def j5(spark, sf_dir):
    df = stored(panel(spark, sf_dir))
    return pn.ever_members(df, membership(df))


@query(
    "J6_added_candidates",
    "date:t code:i",
    f"""WITH {PANEL_SQL}, {MEMBERS_SQL} SELECT date, code FROM panel WHERE industry IN ('ASIA', 'EUROPE') AND volume >= 100
      AND (date, code) NOT IN (SELECT (date, code) FROM members)""",
)
def j6(spark, sf_dir):
    df = stored(panel(spark, sf_dir))
    tech = df.where(F.col("industry").isin("ASIA", "EUROPE")).select("date", "code")
    other = df.where(F.col("volume") >= 100).select("date", "code")
    return tech.join(other, ["date", "code"]).join(membership(df), ["date", "code"], "left_anti")


@query(
    "J7_dense_grid",
    "date:t code:i has_quote:b is_member:b",
    f"""WITH {WEEKLY_SQL}, {MEMBERS_SQL.replace('FROM panel', 'FROM weekly')}
    SELECT d.date, c.code, w.close IS NOT NULL AS has_quote, m.code IS NOT NULL AS is_member
    FROM (SELECT DISTINCT date FROM weekly) d CROSS JOIN (SELECT DISTINCT code FROM weekly) c
    LEFT JOIN weekly w ON w.date = d.date AND w.code = c.code LEFT JOIN members m ON m.date = d.date AND m.code = c.code""",
)
def j7(spark, sf_dir):
    df = stored(panel(spark, sf_dir, "week"))
    members = membership(df).select("date", "code", F.lit(True).alias("is_member"))
    grid = joins.dense_grid(df, "week")
    out = grid.join(df.select("date", "code", "close"), ["date", "code"], "left").join(members, ["date", "code"], "left")
    return out.select(
        "date", "code", F.col("close").isNotNull().alias("has_quote"), F.coalesce("is_member", F.lit(False)).alias("is_member")
    )


@query(
    "J8_calendar_offset",
    "code:i date:t entry_date:t exit_date:t",
    f"""WITH {WEEKLY_SQL}, cal AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM weekly))
    SELECT w.code, w.date, e.date AS entry_date, x.date AS exit_date FROM weekly w JOIN cal USING (date)
    LEFT JOIN cal e ON e.p = cal.p + 1 LEFT JOIN cal x ON x.p = cal.p + 6""",
)
def j8(spark, sf_dir):
    df = stored(panel(spark, sf_dir, "week")).select("code", "date")
    calendar = joins.number_calendar(df)
    return joins.calendar_offset(df, calendar, {"entry_date": F.lit(1), "exit_date": F.lit(6)})


@query(
    "J9_previous_session",
    "code:i date:t prior:d",
    f"""WITH {WEEKLY_SQL}, cal AS (SELECT date, lag(date) OVER (ORDER BY date) AS pd FROM (SELECT DISTINCT date FROM weekly))
    SELECT w.code, w.date, q.close AS prior FROM weekly w JOIN cal USING (date) LEFT JOIN weekly q ON q.code = w.code AND q.date = pd""",
)
def j9(spark, sf_dir):
    df = stored(panel(spark, sf_dir, "week")).select("code", "date", "close")
    return pn.previous_session(df, joins.number_calendar(df), "close", "prior")


@query(
    "J11_reconciliation",
    "paired_rows:i max_abs_difference:d rows_different:i",
    f"""WITH {PANEL_SQL} SELECT count(*) AS paired_rows, max(CASE WHEN code % 7 = 0 THEN 0.5 ELSE 0.0 END) AS max_abs_difference,
      count(*) FILTER (code % 7 = 0) AS rows_different FROM panel WHERE month(date) <> 3""",
)
def j11(spark, sf_dir):
    df = stored(panel(spark, sf_dir)).select("date", "code", "close")
    new = df.withColumn("close", F.when(F.col("code") % 7 == 0, F.col("close") + 0.5).otherwise(F.col("close")))
    return joins.reconcile(df, new.where(F.month("date") != 3), ["date", "code"], "close")


@query(
    "J12_key_set_equality",
    "left_only:i right_only:i shared:i",
    f"""WITH {PANEL_SQL} SELECT count(*) FILTER (code % 9 <> 0 AND month(date) = 2) AS left_only,
      count(*) FILTER (code % 9 = 0 AND month(date) <> 2) AS right_only, count(*) FILTER (code % 9 <> 0 AND month(date) <> 2) AS shared FROM panel""",
)
def j12(spark, sf_dir):
    df = stored(panel(spark, sf_dir))
    return joins.key_differences(df.where(F.col("code") % 9 != 0), df.where(F.month("date") != 2), ["date", "code"])


@query(
    "J14_overlap_with_core",
    "code:s overlap:i",
    f"""WITH {BARS_SQL}, core AS (SELECT ts FROM bars WHERE code IN ('click', 'view') GROUP BY ts HAVING count(DISTINCT code) = 2)
    SELECT code, count(*) AS overlap FROM bars WHERE ts IN (SELECT ts FROM core) GROUP BY code HAVING count(*) >= 100""",
)
def j14(spark, sf_dir):
    return joins.overlap_with_core(bars_hourly(spark, sf_dir), ["click", "view"], 100)


# -- aggregations ----------------------------------------------------------------------
@query(
    "G1_membership_exceptions",
    "date:t member_count:i weight_sum:d reason:s",
    f"""WITH {PANEL_SQL}, {MEMBERS_SQL}, g AS (SELECT date, count(DISTINCT code) AS member_count, sum(weight_pct) AS weight_sum
      FROM members GROUP BY date)
    SELECT *, concat_ws(';', CASE WHEN member_count <> 60 THEN 'member_count=' || member_count END,
      CASE WHEN abs(weight_sum - 100) > 15 THEN 'weight_sum off' END) AS reason FROM g
    WHERE member_count <> 60 OR abs(weight_sum - 100) > 15""",
)
def g1(spark, sf_dir):
    days = membership(panel(spark, sf_dir)).groupBy("date").agg(
        F.countDistinct("code").alias("member_count"), F.sum("weight_pct").alias("weight_sum")
    )
    count_off, weight_off = F.col("member_count") != 60, F.abs(F.col("weight_sum") - 100) > 15
    reason = F.concat_ws(
        ";", F.when(count_off, F.concat(F.lit("member_count="), F.col("member_count"))), F.when(weight_off, "weight_sum off")
    )
    return days.where(count_off | weight_off).withColumn("reason", reason)


@query(
    "G2_weight_unit",
    "unit:s median_sum:d scaled_total:d",
    f"""WITH {PANEL_SQL}, w AS (SELECT date, amount / sum(amount) OVER (PARTITION BY date) AS weight FROM panel),
    s AS (SELECT median(d) AS m FROM (SELECT sum(weight) AS d FROM w GROUP BY date))
    SELECT CASE WHEN m BETWEEN 99 AND 101 THEN 'PERCENT' WHEN m BETWEEN 0.99 AND 1.01 THEN 'FRACTION' ELSE 'UNKNOWN' END AS unit,
      m AS median_sum, (SELECT sum(weight) FROM w) * CASE WHEN m BETWEEN 0.99 AND 1.01 THEN 100 ELSE 1 END AS scaled_total FROM s""",
)
def g2(spark, sf_dir):
    df = stored(panel(spark, sf_dir))
    totals = df.groupBy("date").agg(F.sum("amount").alias("total"))
    weights = df.join(totals, "date").select("date", (F.col("amount") / F.col("total")).alias("weight"))
    sums = weights.groupBy("date").agg(F.sum("weight").alias("d"))
    m = F.col("median_sum")
    unit = F.when(m.between(99, 101), "PERCENT").when(m.between(0.99, 1.01), "FRACTION").otherwise("UNKNOWN")
    out = sums.agg(F.median("d").alias("median_sum"), F.sum("d").alias("_all")).withColumn("unit", unit)
    return out.withColumn("scaled_total", F.col("_all") * F.when(F.col("unit") == "FRACTION", 100).otherwise(1))


@query(
    "G3_industry_context",
    "date:t industry:s members:i mean_return:d breadth:d",
    f"""WITH {PANEL_SQL}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY code ORDER BY date)) AS r FROM panel)
    SELECT date, industry, count(DISTINCT code) AS members, avg(r) AS mean_return,
      avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS breadth FROM r GROUP BY 1, 2""",
)
def g3(spark, sf_dir):
    df = panel(spark, sf_dir).withColumn("r", scalar.safe_log_return(F.col("close"), DATED.lag("close", 1)))
    return df.groupBy("date", "industry").agg(
        F.countDistinct("code").alias("members"), F.avg("r").alias("mean_return"),
        F.avg((F.col("r") > 0).cast("double")).alias("breadth"),
    )


_COVER_SQL = f"""{PANEL_SQL}, cov AS (SELECT date, industry, code, volume >= 60 AS valid FROM panel),
  daily AS (SELECT date, count(*) FILTER (valid) / count(*) AS coverage FROM cov GROUP BY date)"""


def coverage(spark, sf_dir):
    return panel(spark, sf_dir).select("date", "industry", "code", (F.col("volume") >= 60).alias("valid"))


@query(
    "G4_coverage_summary",
    "days:i lowest:d q05:d q25:d q50:d q75:d q95:d days_below:i",
    f"""WITH {_COVER_SQL} SELECT count(*) AS days, min(coverage) AS lowest, quantile_cont(coverage, 0.05) AS q05,
      quantile_cont(coverage, 0.25) AS q25, quantile_cont(coverage, 0.5) AS q50, quantile_cont(coverage, 0.75) AS q75,
      quantile_cont(coverage, 0.95) AS q95, count(*) FILTER (coverage < 0.85) AS days_below FROM daily""",
)
def g4(spark, sf_dir):
    daily = coverage(spark, sf_dir).groupBy("date").agg(F.avg(F.col("valid").cast("double")).alias("coverage"))
    out = daily.agg(
        F.count(F.lit(1)).alias("days"), F.min("coverage").alias("lowest"),
        F.percentile("coverage", [0.05, 0.25, 0.5, 0.75, 0.95]).alias("q"),
        F.count(F.when(F.col("coverage") < 0.85, 1)).alias("days_below"),
    )
    names = ("q05", "q25", "q50", "q75", "q95")
    return out.withColumns({n: F.col("q")[i] for i, n in enumerate(names)})


@query(
    "G5_coverage_by_industry",
    "industry:s valid:i total:i coverage:d",
    f"""WITH {_COVER_SQL} SELECT CASE WHEN code % 10 = 3 THEN 'UNKNOWN' ELSE industry END AS industry, count(*) FILTER (valid) AS valid,
      count(*) AS total, count(*) FILTER (valid) / count(*) AS coverage FROM cov GROUP BY 1""",
)
def g5(spark, sf_dir):
    df = coverage(spark, sf_dir).withColumn("industry", F.when(F.col("code") % 10 != 3, F.col("industry")))
    return df.groupBy(F.coalesce("industry", F.lit("UNKNOWN")).alias("industry")).agg(
        F.count(F.when(F.col("valid"), 1)).alias("valid"), F.count(F.lit(1)).alias("total"),
        F.avg(F.col("valid").cast("double")).alias("coverage"),
    )


@query(
    "G8_failure_histogram",
    "reason:s n:i",
    f"""WITH {TRADABLE_SQL} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN suspended THEN 'SUSPENDED'
      WHEN NOT can_buy_open THEN 'LIMIT_UP_OPEN' END AS reason FROM tradable) WHERE reason IS NOT NULL
    GROUP BY reason ORDER BY n DESC, reason LIMIT 3""",
)
def g8(spark, sf_dir):
    df = tradable(spark, sf_dir).where(F.col("buy_block_reason").isNotNull())
    counts = df.groupBy(F.col("buy_block_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "reason").limit(3)


@query(
    "G11_value_counts",
    "event_type:s n:i",
    "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
)
def g11(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "G12_tagged_union",
    "pool_origin:s n:i overlap:i",
    f"""WITH {PANEL_SQL}, {MEMBERS_SQL} SELECT CASE WHEN (date, code) IN (SELECT (date, code) FROM members) THEN 'original'
      ELSE 'added' END AS pool_origin, count(*) AS n, 0 AS overlap FROM panel GROUP BY 1""",
)
def g12(spark, sf_dir):
    df = stored(panel(spark, sf_dir))
    members = membership(df).select("date", "code")
    rest = df.select("date", "code").join(members, ["date", "code"], "left_anti")
    both = members.withColumn("pool_origin", F.lit("original")).unionByName(rest.withColumn("pool_origin", F.lit("added")))
    overlap = joins.conflicts(both, ["date", "code"]).agg(F.count(F.lit(1)).alias("n")).scalar()
    return both.groupBy("pool_origin").agg(F.count(F.lit(1)).alias("n")).withColumn("overlap", overlap)


@query(
    "G14_P18_pivot_matrix",
    "date:t AFRICA:d AMERICA:d ASIA:d EUROPE:d",
    f"""WITH {PANEL_SQL} SELECT date, avg(close) FILTER (industry = 'AFRICA') AS AFRICA, avg(close) FILTER (industry = 'AMERICA') AS AMERICA,
      avg(close) FILTER (industry = 'ASIA') AS ASIA, avg(close) FILTER (industry = 'EUROPE') AS EUROPE FROM panel GROUP BY date""",
)
def g14(spark, sf_dir):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
    return panel(spark, sf_dir).groupBy("date").pivot("industry", names).agg(F.avg("close"))


@query(
    "G15_top_n_per_date",
    "date:t code:i place:i",
    f"""WITH {PANEL_SQL} SELECT date, code, place FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY close DESC, code)
      AS place FROM panel WHERE volume >= 30) WHERE place <= 20""",
)
def g15(spark, sf_dir):
    from factorloom.operators.portfolio import top_n

    return top_n(panel(spark, sf_dir).where(F.col("volume") >= 30), "close", 20)


@query(
    "G16_global_top_k",
    "code:i total:d",
    f"WITH {PANEL_SQL} SELECT code, sum(amount) AS total FROM panel GROUP BY code ORDER BY total DESC, code LIMIT 10",
)
def g16(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("code").agg(F.sum("amount").alias("total")).orderBy(F.desc("total"), "code").limit(10)


@query(
    "G17_duplicates",
    "minute:t code:s n:i",
    "SELECT date_trunc('minute', ts) AS minute, event_type AS code, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
)
def g17(spark, sf_dir):
    return joins.conflicts(raw_feed(spark, sf_dir), ["minute", "code"])


@query(
    "G18_calendar_minus_holdout",
    "date:t",
    f"WITH {PANEL_SQL} SELECT DISTINCT date FROM panel WHERE date < DATE '2000-06-01'",
)
def g18(spark, sf_dir):
    dates = panel(spark, sf_dir).select("date").distinct()
    return dates.exceptAll(dates.where(F.col("date") >= F.lit("2000-06-01").cast("date")))


# -- panel construction ----------------------------------------------------------------
CHAIN_SQL = f"""{PRE_SQL}, ok AS (SELECT *, NOT suspended AND coalesce(preclose > 0, false) AS valid FROM pre),
runs AS (SELECT *, sum(CASE WHEN valid THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY date) AS run FROM ok),
steps AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY code, run, valid ORDER BY date) = 1 THEN 0.0
  ELSE ln(close / preclose) END AS lstep FROM runs),
lev AS (SELECT *, CASE WHEN valid THEN exp(sum(lstep) OVER (PARTITION BY code, run, valid ORDER BY date)) END AS close_tr FROM steps),
chain AS (SELECT *, CASE WHEN valid THEN coalesce(lag(close_tr) OVER (PARTITION BY code, run, valid ORDER BY date), 1.0) / preclose END
  AS scale FROM lev)"""


def chained(spark, sf_dir):
    """Suspended months lose their price, which breaks the chain."""
    df = with_preclose(panel(spark, sf_dir))
    df = df.withColumn("preclose", F.when(~F.col("suspended"), F.col("preclose")))
    return pn.total_return_chain(df)


@query(
    "P1_total_return_chain",
    "code:i date:t open_tr:d high_tr:d low_tr:d close_tr:d chain_valid:b",
    f"""WITH {CHAIN_SQL} SELECT code, date, open * scale AS open_tr, high * scale AS high_tr, low * scale AS low_tr, close_tr,
      valid AS chain_valid FROM chain""",
)
def p1(spark, sf_dir):
    return chained(spark, sf_dir)


SPELLS_SQL = f"""{PANEL_SQL}, {MEMBERS_SQL}, sp0 AS (SELECT *, CASE WHEN date_diff('day', lag(date) OVER c, date) > 45 THEN 1 ELSE 0 END AS nw
  FROM members WINDOW c AS (PARTITION BY code ORDER BY date)),
spells AS (SELECT *, sum(nw) OVER (PARTITION BY code ORDER BY date) AS spell_id FROM sp0)"""


@query(
    "P2_membership_spells",
    "code:i spell_id:i entry_effective_date:t realized_exit_date:t censored_at_snapshot_end:b n_rows:i",
    f"""WITH {SPELLS_SQL} SELECT code, spell_id, min(date) AS entry_effective_date,
      CASE WHEN max(date) <> (SELECT max(date) FROM members) THEN max(date) END AS realized_exit_date,
      max(date) = (SELECT max(date) FROM members) AS censored_at_snapshot_end, count(*) AS n_rows FROM spells GROUP BY 1, 2""",
)
def p2(spark, sf_dir):
    return pn.spell_audit(pn.with_spells(membership(stored(panel(spark, sf_dir))), gap_days=45))


_CONFLICT_SQL = f"""{INTERVALS_SQL}, conf AS (SELECT code, valid_from, valid_to, industry FROM intervals
  UNION ALL SELECT code, valid_from, DATE '1999-12-31', 'X_' || industry FROM intervals WHERE code % 4 = 0
  UNION ALL SELECT code, valid_from, valid_to, 'A_' || industry FROM intervals WHERE code % 6 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY code, valid_from ORDER BY valid_to IS NULL DESC, valid_to DESC, industry) AS place FROM conf)"""


def _conflicting(spark, sf_dir):
    base = industry_intervals(spark, sf_dir).select("code", "valid_from", "valid_to", "industry")
    x = base.where(F.col("code") % 4 == 0).withColumns(
        {"valid_to": F.lit("1999-12-31").cast("date"), "industry": F.concat(F.lit("X_"), "industry")}
    )
    a = base.where(F.col("code") % 6 == 0).withColumn("industry", F.concat(F.lit("A_"), "industry"))
    return base.unionByName(x).unionByName(a)


@query(
    "P3_conflict_resolution",
    "code:i valid_from:t valid_to:t industry:s kept:b",
    f"WITH {_CONFLICT_SQL} SELECT code, valid_from, valid_to, industry, place = 1 AS kept FROM ranked",
)
def p3(spark, sf_dir):
    kept, dropped = pn.resolve_conflicts(_conflicting(spark, sf_dir))
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.drop("reason").withColumn("kept", F.lit(False)))


@query(
    "P4_close_interval_gaps",
    "code:i valid_from:t valid_to:t",
    f"""WITH {_CONFLICT_SQL} SELECT code, valid_from, coalesce(lead(valid_from) OVER (PARTITION BY code ORDER BY valid_from) - INTERVAL 1 DAY,
      valid_to)::DATE AS valid_to FROM ranked WHERE place = 1""",
)
def p4(spark, sf_dir):
    return pn.close_gaps(pn.resolve_conflicts(_conflicting(spark, sf_dir))[0])


@query(
    "P5_level_one_codes",
    "index_code:s",
    "SELECT n_name || '.si' AS index_code FROM nation WHERE n_nationkey % 3 = 1 AND n_nationkey % 2 = 0",
)
def p5(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(
        F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, ".si").otherwise(".XX")).alias("index_code"),
        (F.col("n_nationkey") % 3).cast("string").alias("level_type"),
    )
    return pn.level_one(n)


@query(
    "P6_missing_history",
    "code:i reason:s",
    f"""WITH {PANEL_SQL}, {INTERVALS_SQL} SELECT DISTINCT code, 'MISSING_INDUSTRY_HISTORY' AS reason FROM panel
    WHERE code NOT IN (SELECT code FROM intervals WHERE code % 13 <> 5)""",
)
def p6(spark, sf_dir):
    known = industry_intervals(spark, sf_dir).where(F.col("code") % 13 != 5)
    return pn.missing_history(panel(spark, sf_dir), known)


def quotes(spark, sf_dir, base=None):
    df = with_preclose(stored(panel(spark, sf_dir)) if base is None else base)
    pre = df.where(~F.col("suspended")).select("date", "code", "preclose")
    return pn.assemble_quotes(df.drop("preclose"), pre)


@query(
    "P7_quote_assembly",
    "code:i date:t close:d close_tr:d has_quote:b quote_missing_reason:s",
    f"""WITH {CHAIN_SQL} SELECT code, date, CASE WHEN valid THEN close END AS close, close_tr, valid AS has_quote,
      CASE WHEN NOT valid THEN 'NO_VALID_VENDOR_QUOTE' END AS quote_missing_reason FROM chain""",
)
def p7(spark, sf_dir):
    return quotes(spark, sf_dir)


@query(
    "P8_member_slice",
    "code:i date:t close_tr:d has_quote:b quote_missing_reason:s",
    f"""WITH {CHAIN_SQL}, {MEMBERS_SQL}, q AS (SELECT * FROM chain WHERE month(date) <> 11)
    SELECT m.code, m.date, q.close_tr, coalesce(q.valid, false) AS has_quote, CASE WHEN q.valid THEN NULL WHEN q.code IS NULL
      THEN 'MISSING_VENDOR_ROW' ELSE 'NO_VALID_VENDOR_QUOTE' END AS quote_missing_reason
    FROM members m LEFT JOIN q ON q.code = m.code AND q.date = m.date""",
)
def p8(spark, sf_dir):
    df = stored(panel(spark, sf_dir))
    return pn.member_slice(membership(df), quotes(spark, sf_dir, df).where(F.month("date") != 11))


@query(
    "P10_calendar",
    "date:t session_open:t session_close:t available_at:t is_complete_session:b",
    f"""WITH {WEEKLY_SQL} SELECT DISTINCT date, date + INTERVAL 90 MINUTE AS session_open, date + INTERVAL 7 HOUR AS session_close,
      date + INTERVAL 13 HOUR AS available_at, true AS is_complete_session FROM weekly""",
)
def p10(spark, sf_dir):
    return pn.build_calendar(panel(spark, sf_dir, "week"))


@query(
    "P11_corporate_actions",
    "action_type:s code:s announcement_at:t ex_date:t cash_dividend:d rights_ratio:d known_at_source:s action_id:s",
    """WITH o AS (SELECT *, 'c' || o_custkey AS c, strftime(o_orderdate, '%Y%m%d') AS d, CAST(o_totalprice / 1000 AS VARCHAR) AS v, CAST(o_orderdate AS DATE) AS dd FROM orders),
    r AS (SELECT 'DIVIDEND' AS action_type, upper(c) AS code, CASE WHEN o_orderkey % 2 = 0 THEN dd END AS announcement_at, dd AS ex_date, o_totalprice / 1000 AS cash_dividend,
        NULL AS rights_ratio, '{"ANN_DATE":' || CASE WHEN o_orderkey % 2 = 0 THEN '"' || d || '"' ELSE 'null' END || ',"CASH_DIVIDEND":"' || v || '","DATE_EX":"' || d
        || '","MARKET_CODE":"' || c || '"}' AS payload FROM o WHERE o_orderstatus = 'F'
      UNION ALL SELECT 'RIGHT_ISSUE', upper(c), dd, NULL, NULL, o_totalprice / 1000, '{"EXECUTE_DATE":"' || d || '","RATIO":"' || v || '","code":"' || c || '"}' FROM o WHERE o_orderstatus = 'O'
      UNION ALL SELECT 'EQUITY_CHANGE', upper(c), NULL, NULL, NULL, NULL, '{"CHANGE_DATE":"' || d || '","code":"' || c || '"}' FROM o WHERE o_orderstatus = 'P')
    SELECT *, CASE WHEN announcement_at IS NULL THEN 'MISSING' ELSE 'NATIVE' END AS known_at_source, sha256(code || '|' || action_type || '|' || sha256(payload)) AS action_id FROM r""",
)
def p11(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    code = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    day = F.date_format("o_orderdate", "yyyyMMdd")
    per_share = (F.col("o_totalprice") / 1000).cast("string")
    by = {s: o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}
    return pn.corporate_actions(
        {
            "DIVIDEND": by["F"].select(code.alias("MARKET_CODE"), day.alias("DATE_EX"), per_share.alias("CASH_DIVIDEND"),
                                       F.when(F.col("o_orderkey") % 2 == 0, day).alias("ANN_DATE")),
            "RIGHT_ISSUE": by["O"].select(code.alias("code"), day.alias("EXECUTE_DATE"), per_share.alias("RATIO")),
            "EQUITY_CHANGE": by["P"].select(code.alias("code"), day.alias("CHANGE_DATE")),
        }
    )


@query(
    "P12_security_master",
    "code:s exchange:s list_date:t delist_date:t",
    """SELECT 'S' || s_suppkey || '.N' || s_nationkey AS code, 'N' || s_nationkey AS exchange, l.a AS list_date, l.b AS delist_date
    FROM supplier LEFT JOIN (SELECT l_suppkey, CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b
      FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1) l ON l.l_suppkey = s_suppkey""",
)
def p12(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit(" s"), F.col("s_suppkey").cast("string"), F.lit(".n"), F.col("s_nationkey").cast("string"))
    codes = s.select("s_suppkey", name.alias("code"))
    shipped = table(spark, sf_dir, "lineitem").where(F.col("l_suppkey") % 3 != 0).groupBy("l_suppkey").agg(
        F.min(F.col("l_shipdate").cast("date")).alias("list_date"), F.max(F.col("l_shipdate").cast("date")).alias("delist_date")
    )
    listed = codes.join(shipped, F.col("s_suppkey") == F.col("l_suppkey"))
    return pn.security_master(codes, listed)


@query(
    "P13_status_fill",
    "code:i date:t is_suspended:b is_st:b is_xr:b is_wd:b can_buy_open:b buy_block_reason:s available_at:t available_at_source:s",
    f"""WITH {TRADABLE_SQL}, k AS (SELECT *, month(date) <> 5 AS known FROM tradable)
    SELECT code, date, known AND suspended AS is_suspended, known AND code % 6 = 0 AS is_st, known AND month(date) = 7 AS is_xr,
      known AND code % 7 = 1 AS is_wd, known AND can_buy_open AS can_buy_open, CASE WHEN NOT known THEN 'STATUS_UNAVAILABLE_FROM_VENDOR'
      WHEN suspended THEN 'SUSPENDED' WHEN NOT can_buy_open THEN 'LIMIT_UP_OPEN' END AS buy_block_reason,
      CAST(date AS DATE) + CASE WHEN known THEN INTERVAL 12 HOUR ELSE INTERVAL 13 HOUR END AS available_at,
      CASE WHEN known THEN 'VENDOR' ELSE 'DERIVED_POLICY' END AS available_at_source FROM k""",
)
def p13(spark, sf_dir):
    """The vendor knows no status in May."""
    df = tradable(spark, sf_dir).withColumnRenamed("suspended", "is_suspended")
    flags = {"is_st": F.col("code") % 6 == 0, "is_xr": F.month("date") == 7, "is_wd": F.col("code") % 7 == 1}
    times = {"available_at": F.col("date").cast("timestamp") + F.expr("INTERVAL 12 HOUR"), "available_at_source": F.lit("VENDOR")}
    status = df.where(F.month("date") != 5).withColumns({**flags, **times}).select(
        "date", "code", *pn.STATUS_FLAGS, "buy_block_reason", "sell_block_reason", "available_at", "available_at_source"
    )
    return pn.fill_status(df.select("date", "code"), status)


_TIMES = {
    "quote_available_at": "CASE WHEN code % 17 <> 4 THEN date + INTERVAL 13 HOUR END",
    "status_available_at": "date + INTERVAL 12 HOUR",
    "preclose_available_at": "CASE WHEN code % 11 = 0 THEN date + INTERVAL 14 HOUR ELSE date + INTERVAL 8 HOUR END",
    "previous_quote_available_at": "date - INTERVAL 11 HOUR",
    "membership_available_at": "CASE WHEN code % 19 = 0 THEN date + INTERVAL 20 HOUR ELSE date + INTERVAL 1 HOUR END",
    "industry_available_at": "CASE WHEN code % 7 = 0 THEN date + INTERVAL 15 HOUR ELSE date + INTERVAL 1 HOUR END",
}
MASK_SQL = f"""{PANEL_SQL}, r AS (SELECT code, CAST(date AS TIMESTAMP) AS date, industry,
    ln(close / lag(close) OVER (PARTITION BY code ORDER BY date)) AS r_1d FROM panel),
  tm AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _TIMES.items())} FROM r),
  us AS (SELECT *, coalesce(quote_available_at <= date + INTERVAL 13 HOUR, false) AND status_available_at <= date + INTERVAL 13 HOUR
    AND preclose_available_at <= date + INTERVAL 13 HOUR AND previous_quote_available_at <= date + INTERVAL 13 HOUR AS rt,
    membership_available_at <= date + INTERVAL 13 HOUR AS mt, industry_available_at <= date + INTERVAL 13 HOUR AS it FROM tm),
  masked AS (SELECT CAST(date AS DATE) AS date, code, rt AS return_time_usable, mt AS membership_time_usable, it AS industry_time_usable,
    CASE WHEN it THEN industry END AS industry, rt AND mt AND (code % 2 = 0 OR it) AS reference_input_usable,
    CASE WHEN rt AND mt AND (code % 2 = 0 OR it) THEN r_1d END AS r_1d, CASE WHEN quote_available_at IS NOT NULL THEN
    greatest(quote_available_at, status_available_at, preclose_available_at, previous_quote_available_at) END AS return_available_at FROM us)"""


def timed(spark, sf_dir):
    """Reference rows with six availability times; even codes are the original universe."""
    df = panel(spark, sf_dir).select(
        "code", "date", "industry", scalar.safe_log_return(F.col("close"), DATED.lag("close", 1)).alias("r_1d")
    )
    at = "cast(date as timestamp)"
    return df.withColumns({c: F.expr(e.replace("date +", f"{at} +").replace("date -", f"{at} -")) for c, e in _TIMES.items()})


def masked(spark, sf_dir):
    cutoff = scalar.at_local(F.col("date"), "21:00:00")
    return pn.mask_unavailable(timed(spark, sf_dir), cutoff, F.col("code") % 2 == 0)


@query(
    "P14_availability_mask",
    "code:i date:t return_time_usable:b industry_time_usable:b reference_input_usable:b industry:s r_1d:d return_available_at:t",
    f"""WITH {MASK_SQL} SELECT * FROM masked""",
)
def p14(spark, sf_dir):
    return masked(spark, sf_dir)


@query(
    "P15_signal_time_contract",
    "date:t distinct_times:i missing:i wrong_day:i",
    f"""WITH {PANEL_SQL}, s AS (SELECT date, CASE WHEN month(date) = 2 AND code % 5 = 0 THEN NULL WHEN month(date) = 3 AND code % 5 = 1
      THEN date + INTERVAL 12 HOUR WHEN month(date) = 4 THEN date + INTERVAL 17 HOUR ELSE date + INTERVAL 13 HOUR END AS sg FROM panel),
    g AS (SELECT date, count(DISTINCT sg) AS distinct_times, count(*) - count(sg) AS missing,
      count(*) FILTER (CAST(sg + INTERVAL 8 HOUR AS DATE) <> date) AS wrong_day FROM s GROUP BY date)
    SELECT * FROM g WHERE distinct_times <> 1 OR missing > 0 OR wrong_day > 0""",
)
def p15(spark, sf_dir):
    month, code = F.month("date"), F.col("code")
    at = (
        F.when((month == 2) & (code % 5 == 0), None)
        .when((month == 3) & (code % 5 == 1), scalar.at_local(F.col("date"), "20:00:00"))
        .when(month == 4, F.expr("cast(date as timestamp) + interval 17 hours"))
        .otherwise(scalar.at_local(F.col("date"), "21:00:00"))
    )
    return pn.signal_time_issues(panel(spark, sf_dir).withColumn("signal_at", at))


@query(
    "P16_timing_provenance",
    "code:i date:t quote_available_at_source:s preclose_available_at_source:s",
    f"""WITH {MASK_SQL} SELECT code, CAST(date AS DATE) AS date, CASE WHEN quote_available_at IS NULL THEN 'MISSING' ELSE 'DERIVED_POLICY' END
      AS quote_available_at_source, 'DERIVED_POLICY' AS preclose_available_at_source FROM tm""",
)
def p16(spark, sf_dir):
    return pn.provenance(timed(spark, sf_dir), pn.REQUIRED_TIMES, F.lit("DERIVED_POLICY"))


_TIMED_OUT = "quote status preclose previous_quote membership industry".split()


@query(
    "P16_timing_of_two_universes",
    "code:i date:t " + " ".join(f"{c}_available_at:t {c}_available_at_source:s" for c in _TIMED_OUT),
    f"""WITH {PANEL_SQL}, p AS (SELECT *, CAST(date AS TIMESTAMP) AS d, lag(close) OVER (PARTITION BY code ORDER BY date) AS before FROM panel),
    days AS (SELECT date, lag(date) OVER (ORDER BY date) AS earlier FROM (SELECT DISTINCT date FROM panel)),
    odd_quotes AS (SELECT code, date, d + INTERVAL 13 HOUR AS at FROM p WHERE code % 2 = 1 AND (code + month(date)) % 9 <> 0),
    even_quotes AS (SELECT code, date, d + INTERVAL 13 HOUR AS at FROM p WHERE code % 2 = 0 AND volume >= 40 AND (code + month(date)) % 5 <> 0),
    even AS (
      SELECT p.code, p.date, q.at AS quote_available_at, CASE WHEN p.code % 6 <> 0 THEN n.code IS NOT NULL END AS has_status,
        CASE WHEN n.code IS NOT NULL AND p.code % 6 <> 0 THEN p.d + INTERVAL 12 HOUR END AS status_available_at,
        CASE WHEN n.code IS NOT NULL THEN p.d + INTERVAL 13 HOUR END AS preclose_available_at, w.at AS previous_quote_available_at,
        CASE WHEN n.code IS NOT NULL THEN p.d + INTERVAL 14 HOUR END AS membership_available_at,
        CASE WHEN n.code IS NOT NULL AND month(p.date) <> 2 THEN p.d - INTERVAL 5 DAY END AS industry_available_at
      FROM p JOIN days USING (date)
      LEFT JOIN (SELECT code, date FROM p WHERE (code + month(date)) % 5 <> 0) n ON n.code = p.code AND n.date = p.date
      LEFT JOIN even_quotes q ON q.code = p.code AND q.date = p.date LEFT JOIN even_quotes w ON w.code = p.code AND w.date = earlier
      WHERE p.code % 2 = 0),
    odd AS (
      SELECT p.code, p.date, q.at AS quote_available_at, CASE WHEN (p.code + month(p.date)) % 7 <> 0 THEN p.d + INTERVAL 13 HOUR END AS status_available_at,
        CASE WHEN (p.code + month(p.date)) % 7 <> 0 AND p.before > 0 THEN p.d + INTERVAL 13 HOUR END AS preclose_available_at,
        w.at AS previous_quote_available_at, p.d + INTERVAL 13 HOUR AS membership_available_at,
        CASE WHEN p.code % 10 <> 3 THEN p.d + INTERVAL 13 HOUR END AS industry_available_at
      FROM p JOIN days USING (date) LEFT JOIN odd_quotes q ON q.code = p.code AND q.date = p.date
      LEFT JOIN odd_quotes w ON w.code = p.code AND w.date = earlier WHERE p.code % 2 = 1),
    u AS (SELECT * EXCLUDE (has_status) FROM even UNION ALL BY NAME SELECT * FROM odd)
    SELECT *, {", ".join(f"CASE WHEN {c}_available_at IS NULL THEN 'MISSING' ELSE 'DERIVED_POLICY' END AS {c}_available_at_source" for c in ("quote", "preclose", "previous_quote", "membership"))},
      CASE WHEN status_available_at IS NULL THEN 'MISSING' WHEN code % 4 = 0 THEN 'NATIVE' ELSE 'DERIVED_POLICY' END AS status_available_at_source,
      CASE WHEN industry_available_at IS NULL THEN 'MISSING' WHEN code % 2 = 0 THEN 'NATIVE' ELSE 'DERIVED_POLICY' END AS industry_available_at_source
    FROM u""",
)
def p16_two_universes(spark, sf_dir):
    """Even codes have recorded times (four of five cells), odd codes bars and statuses with gaps."""
    p = stored(panel(spark, sf_dir)).withColumn("industry", F.when(F.col("code") % 10 != 3, F.col("industry")))
    month, at = F.month("date"), F.col("date").cast("timestamp")
    hours = lambda n: at + F.expr(f"interval {n} hours")
    native = p.where((F.col("code") % 2 == 0) & ((F.col("code") + month) % 5 != 0)).select(
        "date", "code", hours(14).alias("available_at"), hours(13).alias("available_at_quote"),
        F.lit(pn.POLICY).alias("available_at_source"), (F.col("volume") >= 40).alias("has_quote"),
        F.when(F.col("code") % 6 != 0, hours(12)).alias("available_at_status"),
        F.when(F.col("code") % 4 == 0, "NATIVE").otherwise(pn.POLICY).alias("available_at_source_status"),
        F.when(month != 2, at - F.expr("interval 5 days")).alias("industry_known_at"), F.lit("NATIVE").alias("industry_known_at_source"),
    )
    odd = p.withColumn("preclose", DATED.lag("close", 1)).where(F.col("code") % 2 == 1)
    bars = odd.where((F.col("code") + month) % 9 != 0).select("date", "code", "close")
    statuses = odd.where((F.col("code") + month) % 7 != 0).select("date", "code", "preclose")
    days = p.select("date").distinct().withColumn("position", F.row_number().over(Window.orderBy("date")))
    return pn.timing(p, native, bars, statuses, days, F.col("code") % 2 == 0, scalar.at_local(F.col("date"), "21:00:00"))


@query(
    "P17_session_return",
    "code:i date:t r_1d:d",
    f"""WITH {WEEKLY_SQL}, cal AS (SELECT date, lag(date) OVER (ORDER BY date) AS pd FROM (SELECT DISTINCT date FROM weekly)),
    w AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) * (1 - 0.01 * (month(date) % 2)) AS preclose FROM weekly)
    SELECT w.code, w.date, CASE WHEN q.close IS NOT NULL AND w.preclose > 0 THEN ln(w.close / w.preclose) END AS r_1d
    FROM w JOIN cal USING (date) LEFT JOIN weekly q ON q.code = w.code AND q.date = pd""",
)
def p17(spark, sf_dir):
    df = with_preclose(stored(panel(spark, sf_dir, "week"))).select("code", "date", "close", "preclose")
    return pn.session_return(df, joins.number_calendar(df))
