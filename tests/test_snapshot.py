"""Snapshots, versioned ingest, the panel gate and features across suspensions."""

import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factorloom.operators import joins, panel as pn, quality as ql
from factorloom.sources import store
from factorloom.streaming import stream as st


def test_a_broken_file_is_found(spark, tmp_path):
    tables = {"a": spark.range(1000).withColumn("k", F.col("id") % 3), "b": spark.range(5)}
    version = store.publish_snapshot(tables, str(tmp_path), {"a": "k"})
    assert store.verify_snapshot(spark, version).count() == 0
    assert store.open_snapshot(spark, version, "a").count() == 1000
    files = [os.path.join(d, f) for d, _, fs in os.walk(f"{version}/data/a") for f in fs if f.endswith(".parquet")]
    with open(files[0], "ab") as f:
        f.write(b"x")
    os.remove(os.path.join(os.path.dirname(files[0]), f".{os.path.basename(files[0])}.crc"))
    os.remove(files[-1])
    spark.range(1).write.mode("append").parquet(f"{version}/data/b")
    assert {(r["table"], r["problem"]) for r in store.verify_snapshot(spark, version).collect()} == {("a", "changed"), ("a", "missing"), ("b", "unknown")}


def test_an_unpublished_version_does_not_exist(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/version-x/data/a")
    with pytest.raises(Exception):
        store.open_snapshot(spark, f"{tmp_path}/version-x", "a")
    version = store.publish_snapshot({"a": spark.range(3)}, str(tmp_path))
    with pytest.raises(ValueError):
        store.open_snapshot(spark, version, "other")


def test_text_fingerprint_ignores_order(spark):
    df = spark.range(100)
    cols = [F.col("id").cast("string")]
    one, two = (store.text_fingerprint(x, cols).collect()[0] for x in (df, df.repartition(7).orderBy(F.desc("id"))))
    assert one == two and one != store.text_fingerprint(df.where("id < 99"), cols).collect()[0]


def test_late_and_repeated_bars_over_batches(spark, tmp_path):
    schema = "code string, ts timestamp, open double, high double, low double, close double, volume double, version int"
    t = datetime(2024, 1, 1)

    def bar(code, minute, close, version):
        return (code, t + timedelta(minutes=minute), 1.0, close + 1, 0.5, close, 10.0 * version, version)

    deliveries = [
        [bar("a", 0, 5.0, 1), bar("a", 1, 6.0, 1), bar("b", 0, 1.0, 1)],
        [bar("a", 1, 6.5, 2), bar("a", 2, 7.0, 2)],
        [bar("a", 1, 6.0, 1), bar("a", 0, 5.0, 1)],  # the first delivery once more, late
        [bar("a", 0, 5.5, 3)],
    ]
    folder = str(tmp_path)
    for i, rows in enumerate(deliveries):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/d{i}")
        if i == 1:  # two deliveries, then a restart of the job
            st.upsert_available(st.bar_versions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")), folder, "bars")
    got = st.upsert_available(st.bar_versions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")), folder, "bars").collect()
    best = {(r["code"], (r["ts"] - t).seconds // 60): (r["close"], r["volume"], r["version"], r["corrections"]) for r in got}
    assert best == {("a", 0): (5.5, 30.0, 3, 1), ("a", 1): (6.5, 20.0, 2, 1), ("a", 2): (7.0, 20.0, 2, 0), ("b", 0): (1.0, 10.0, 1, 0)}


def gate_tables(spark):
    days = [date(2024, 1, d) for d in range(1, 6)]
    bars = [dict(date=d, code=c, has_quote=True, open_raw=2.0, high_raw=3.0, low_raw=1.0, close_raw=2.0, volume=1.0, amount=1.0, open_tr=2.0, close_tr=2.0,
                 quote_missing_reason=None, available_at=datetime(2024, 1, 1), source_row_hash="a" * 64) for d in days for c in (1, 2)]
    members = [dict(date=d, index_code="idx", code=c, is_member=True, weight_pct=50.0, effective_at=datetime(2023, 1, 1), exit_effective_date=None, industry="i") for d in days for c in (1, 2)]
    status = [dict(date=d, code=c, can_buy_open=True, can_sell_open=True) for d in days for c in (1, 2)]
    calendar = [dict(date=d, is_trading_day=True, is_complete_session=True) for d in days]
    return bars, members, status, calendar


FAULTS = {
    "INVALID_OHLCV": lambda b, m, s, c: b[0].update(high_raw=1.5),
    "SYNTHETIC_MISSING_QUOTE_VALUES": lambda b, m, s, c: b[0].update(has_quote=False, quote_missing_reason="X"),
    "AVAILABLE_AT_MISSING": lambda b, m, s, c: b[0].update(available_at=None),
    "SOURCE_ROW_HASH_INVALID": lambda b, m, s, c: b[0].update(source_row_hash="a" * 63 + "g"),
    "MEMBERSHIP_FUTURE_EXIT_STRIPPED": lambda b, m, s, c: m[0].update(exit_effective_date=date(2025, 1, 1)),
    "MEMBERSHIP_EFFECTIVE_TIME_INVALID": lambda b, m, s, c: m[0].update(effective_at=None),
    "DUPLICATE_BARS": lambda b, m, s, c: b.append(b[0]),
    "DUPLICATE_STATUS": lambda b, m, s, c: s.append(s[0]),
    "MEMBER_WEIGHT_SUM_INVALID": lambda b, m, s, c: m[0].update(weight_pct=49.0),
    "MEMBER_QUOTE_EVIDENCE_MISSING": lambda b, m, s, c: b.pop(0),
    "TRADING_STATUS_MISSING": lambda b, m, s, c: s.pop(0),
    "INDUSTRY_COVERAGE_BELOW_THRESHOLD": lambda b, m, s, c: m[0].update(industry=None),
    "QUOTE_ON_NON_TRADING_DATE": lambda b, m, s, c: b.append(dict(b[0], date=date(2024, 2, 1))),
    "REQUESTED_START_NOT_COVERED": lambda b, m, s, c: None,
    "HOLDOUT_PRICES_NOT_SEALED": lambda b, m, s, c: b.append(dict(b[0], date=date(2024, 9, 1), has_quote=False, quote_missing_reason="X", **dict.fromkeys(("open_raw", "high_raw", "low_raw", "close_raw", "volume", "amount", "open_tr", "close_tr")))),
    "MEMBER_COUNT_NOT_EXACT": lambda b, m, s, c: m.pop(0) and m[0].update(weight_pct=100.0),
    "MEMBERSHIP_DATE_MISSING": lambda b, m, s, c: (m.pop(0), m.pop(0)),
}


@pytest.mark.parametrize("fault", [None, *FAULTS])
def test_each_check_finds_its_fault(spark, fault):
    tables = gate_tables(spark)
    if fault:
        FAULTS[fault](*tables)
    b, m, s, c = tables
    types = [
        "date date, code int, has_quote boolean, open_raw double, high_raw double, low_raw double, close_raw double, volume double, amount double, open_tr double, "
        "close_tr double, quote_missing_reason string, available_at timestamp, source_row_hash string",
        "date date, index_code string, code int, is_member boolean, weight_pct double, effective_at timestamp, exit_effective_date date, industry string",
        "date date, code int, can_buy_open boolean, can_sell_open boolean", "date date, is_trading_day boolean, is_complete_session boolean",
    ]
    frames = [spark.createDataFrame(rows, t) for rows, t in zip((b, m, s, c), types)]
    start = "2023-06-01" if fault == "REQUESTED_START_NOT_COVERED" else "2024-01-01"
    got = ql.panel_gate(*frames, index_code="IDX", expected=2, cutoff=F.lit("2024-08-01").cast("date"), required_start=F.lit(start).cast("date")).collect()
    assert {r["code"] for r in got if r["n_rows"]} == ({fault} if fault else set()) and len(got) == 22


def test_a_suspension_resets_features(spark):
    def table(scale):
        rows = []
        for i in range(25):
            p = (scale if i < 9 else 1.0) * (10 + i % 4)
            rows.append((1, date(2024, 1, 1) + timedelta(days=i), p, p + 1, p - 1, p, float(i < 9 or i >= 12)))
        return spark.createDataFrame(rows, "code long, date date, open double, high double, low double, close double, volume double")

    names, out = ["RET", "RSI14", "MA_DIFF", "CS_RANK_RET5", "MACD_HIST"], []
    for scale in (1.0, 1000.0):
        df = table(scale)
        got = pn.run_features(df, joins.number_calendar(df), F.col("volume") > 0, names, warm_up=2).orderBy("date").collect()
        assert [r["ready"] for r in got] == [2 <= i < 9 or i >= 14 for i in range(25)]
        assert all(r[n] is None for r in got[9:14] for n in names)
        out.append([tuple(r) for r in got[12:]])
    assert out[0] == out[1]
