"""Hand-calculated rows of the panel, joins, labels and signals."""

import math
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions.series import Series
from factorloom.operators import backtest as bt
from factorloom.operators import evaluate as ev
from factorloom.operators import joins, labels, panel as pn, portfolio, quality, signals
from factorloom.sources import bars as src
from factorloom.sources import store


def d(day):
    return date(2024, 1, day)


def test_chain_restarts_after_a_break(spark):
    rows = [(d(1), 10.0, 11.0, 10.0), (d(2), 11.0, 12.1, 11.0), (d(3), 12.0, None, 12.0), (d(4), 20.0, 21.0, 20.0), (d(5), 21.0, 23.1, 21.0)]
    df = spark.createDataFrame(rows, "date date, open double, close double, preclose double").withColumn("code", F.lit("a"))
    df = df.withColumns({"high": F.col("open") + 5, "low": F.col("open") - 5})
    got = pn.total_return_chain(df).orderBy("date").toPandas()
    assert got["close_tr"].round(9).where(got["chain_valid"], -1).tolist() == [1.0, 1.1, -1, 1.0, 1.1]
    assert got["open_tr"].round(9).where(got["chain_valid"], -1).tolist() == [1.0, 1.0, -1, 1.0, 1.0]


def test_spells_and_censoring(spark):
    rows = [("a", d(1)), ("a", d(5)), ("a", d(20)), ("b", d(2)), ("b", d(3))]
    got = pn.spell_audit(pn.with_spells(spark.createDataFrame(rows, "code string, date date"), 10)).orderBy("code", "spell_id").collect()
    assert [(r["code"], r["spell_id"], r["realized_exit_date"], r["censored_at_snapshot_end"]) for r in got] == [
        ("a", 0, d(5), False), ("a", 1, None, True), ("b", 0, d(3), False),
    ]


def test_asof_never_falls_back(spark):
    left = spark.createDataFrame([("a", d(1)), ("a", d(10)), ("a", d(20)), ("z", d(10))], "code string, date date")
    right = spark.createDataFrame(
        [("a", d(1), None, "old", datetime(2024, 1, 1)), ("a", d(10), d(15), "new", datetime(2024, 1, 12))],
        "code string, valid_from date, valid_to date, industry string, known_at timestamp",
    )
    joined = joins.asof(left, right, "code", "date", "valid_from")
    got = joins.valid_interval(joined, ["industry"], cutoff=F.col("date").cast("timestamp")).orderBy("code", "date").collect()
    # the newer interval is not known yet on day 10 and has ended by day 20: no older value takes over
    assert [r["industry"] for r in got] == ["old", None, None, None]


def test_conflicts_and_gaps(spark):
    rows = [("a", d(1), d(5), "x"), ("a", d(1), None, "y"), ("a", d(9), d(12), "z")]
    kept, dropped = pn.resolve_conflicts(spark.createDataFrame(rows, "code string, valid_from date, valid_to date, industry string"))
    assert [r["industry"] for r in dropped.collect()] == ["x"]
    assert [r["valid_to"] for r in pn.close_gaps(kept).orderBy("valid_from").collect()] == [d(8), d(12)]


def test_leave_one_out_and_shrinkage(spark):
    rows = [("a", 0.1, "i"), ("b", 0.3, "i"), ("c", None, "i"), ("d", 0.5, "j"), ("e", 0.2, None)]
    df = spark.createDataFrame(rows, "code string, r_1d double, industry string").withColumn("date", F.lit(d(1)))
    got = {r["code"]: r for r in signals.shrunk_residual(df).collect()}
    market = (0.3 + 0.5 + 0.2) / 3
    assert math.isclose(got["a"]["shrink"], 0.1 - (0.2 * 0.3 + 0.8 * market))
    assert math.isclose(got["d"]["shrink"], 0.5 - (0.1 + 0.3 + 0.2) / 3)
    assert got["e"]["shrink"] is None and got["c"]["shrink"] is None and got["a"]["strict"] is None


def test_winsor_rank_matches_pandas(spark):
    x = pd.Series(np.r_[np.random.default_rng(1).normal(size=60), [0.5, 0.5, np.nan]])
    df = spark.createDataFrame([(i, None if math.isnan(v) else float(v)) for i, v in enumerate(x)], "code int, s double")
    got = signals.winsor_rank(df.withColumn("date", F.lit(d(1))), ["s"]).orderBy("code").toPandas()["s_rank"]
    want = x.clip(x.quantile(0.01), x.quantile(0.99)).rank(method="average", pct=True)
    np.testing.assert_allclose(got.astype(float), want)


def test_labels_use_calendar_positions(spark):
    prices = [("a", d(i), float(i)) for i in (1, 2, 3, 5)]  # no quote on day 4
    bars = spark.createDataFrame(prices, "code string, date date, open_tr double")
    dates = spark.createDataFrame([(d(i),) for i in range(1, 6)], "date date")
    members = spark.createDataFrame([("a", d(1), "i"), ("a", d(2), "i"), ("a", d(3), "i")], "code string, date date, industry string")
    got = labels.horizon_labels(members, bars, None, dates, horizons=(1,)).orderBy("date").collect()
    assert math.isclose(got[0]["gross_log_return"], math.log(3 / 2))
    assert got[1]["gross_log_return"] is None and got[1]["exit_blocked"] and not got[1]["entry_blocked"]
    assert got[2]["entry_blocked"] and got[2]["exit_date"] == d(5)


def test_purged_split_roles(spark):
    days = pd.date_range("2015-01-01", periods=400, freq="D")
    df = spark.createDataFrame(pd.DataFrame({"date": days.date}))
    got = labels.purged_split(df, holdout_min=50, holdout_years=0, purge=10, embargo=3).toPandas()
    for _, f in got.sort_values("date").groupby("fold"):
        roles = f["role"].tolist()
        assert roles.count("purge") == 10 and roles.count("holdout") == 50
        first = roles.index("validation")
        assert roles[first - 1] == "purge" and "train" not in roles[first:]


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p_value double")
    got = {r["name"]: (round(r["p_holm"], 6), r["reject"]) for r in ev.holm(df).collect()}
    assert got == {"a": (0.03, True), "b": (0.06, False), "c": (0.06, False)}


def test_leave_one_code_out_equals_brute_force():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=25).round(1), rng.normal(size=25).round(1)
    got = ev._drop_each(x, y)
    for j in range(25):
        keep = np.arange(25) != j
        a, b = (pd.Series(v[keep]).rank() for v in (x, y))
        assert math.isclose(got[j], a.corr(b), abs_tol=1e-12)


def test_bootstrap_is_reproducible_and_covers(spark):
    series = spark.createDataFrame([(i, float(i * 37 % 101)) for i in range(60)], "position long, v double")
    a = ev.moving_block_bootstrap(series, ["v"], block=5, samples=50, seed=1)
    assert a.groupBy("draw").count().where("count != 60").count() == 0
    stats = a.groupBy("draw").agg(F.avg("v").alias("stat"))
    again = ev.moving_block_bootstrap(series, ["v"], block=5, samples=50, seed=1).groupBy("draw").agg(F.avg("v").alias("stat"))
    assert stats.exceptAll(again).count() == 0 and stats.select("stat").distinct().count() > 20
    observed = series.agg(F.avg("v")).first()[0]
    summary = ev.bootstrap_summary(stats).first()
    assert summary["ci_low"] < observed < summary["ci_high"] and summary["p_value"] == pytest.approx(1 / 51)


def test_prune_prefers_the_better_candidate():
    scores = [("a", 0.9), ("b", 0.5), ("c", 0.895)]
    assert ev.correlation_prune(scores, {("a", "b"): 0.95, ("a", "c"): 0.99, ("b", "c"): 0.1}) == {"a": None, "c": None, "b": "a"}


def test_clean_candidates(spark):
    rows = [("k", i, v) for i, v in enumerate([1.0, 2.0, None])]
    long = None
    for name, f in (("p", 1.0), ("q", 1.0), ("r", 2.0)):
        part = spark.createDataFrame([(name, i, None if v is None else v * f) for _, i, v in rows], "candidate string, k int, value double")
        long = part if long is None else long.unionByName(part)
    got = {r["candidate"]: (r["state"], r["duplicate_of"]) for r in ev.clean_candidates(long, "candidate", ["k"], "value").collect()}
    assert got == {"p": ("retained", None), "q": ("duplicate", "p"), "r": ("retained", None)}


def test_reconstitution_and_prefix_checks(spark):
    members = spark.createDataFrame([(d(1), "a"), (d(1), "b"), (d(2), "a"), (d(2), "c"), (d(3), "a"), (d(3), "c")], "date date, code string")
    got = quality.reconstitution_days(members, joins.number_calendar(members)).collect()
    assert [(r["date"], r["joined"], r["left"]) for r in got] == [(d(2), 1, 1)]
    full = members.withColumn("v", F.lit(1.0))
    bad = full.withColumn("v", F.when(F.col("code") == "a", 2.0).otherwise(1.0))
    assert quality.prefix_differences(full, bad, ["date", "code"], ["v"]).first()["different"] == 3


def test_schema_contract(spark):
    df = spark.createDataFrame([(1,)], "code int")
    assert "spell_id" in quality.contract(df, "membership_spell_audit") and "code" not in quality.contract(df, "membership_spell_audit")


def test_bar_files_with_localised_columns(spark, tmp_path):
    n = 120
    frame = pd.DataFrame(
        {"时间": pd.date_range("2024-01-01", periods=n, freq="h").strftime("%Y-%m-%d %H:%M:%S"), "开盘": 1.0, "最高": 2.0, "最低": 0.5, "收盘价": 1.5, "成交量": 10}
    )
    frame.loc[5, "收盘价"] = -1.0
    frame.to_parquet(tmp_path / "000001_qfq_60min.parquet")
    frame.head(20).to_parquet(tmp_path / "SHORT_H1.parquet")
    frame.to_parquet(tmp_path / "notimeframe.parquet")
    got = src.read_bars(spark, str(tmp_path))
    assert got.columns == ["code", "ts", "open", "high", "low", "close", "volume"]
    assert [(r["code"], r["count"]) for r in got.groupBy("code").count().collect()] == [("000001", n - 1)]


def test_snapshot_round_trip(spark, tmp_path):
    df = store.with_lineage(spark.range(10), schema_version="1")
    manifest = store.write_snapshot({"t": df}, str(tmp_path)).first()
    assert manifest["n_rows"] == 10 and manifest["digest"] == store.fingerprint(df).first()["digest"]
    store.write_sealed(df.withColumn("date", F.lit(d(5))), F.lit(d(6)), f"{tmp_path}/dev", f"{tmp_path}/sealed")
    assert spark.read.parquet(f"{tmp_path}/dev").count() == 10 and spark.read.parquet(f"{tmp_path}/sealed").count() == 0


def test_downsample_matches_linspace(spark):
    total = 1000
    df = spark.range(total).select((F.col("id") + 1).alias("rn"), F.lit(total).alias("bars"), F.lit("a").alias("code"))
    got = sorted(r["rn"] - 1 for r in src.downsample(df, "code", "rn", "bars", 37).collect())
    assert got == sorted({j * (total - 1) // 36 for j in range(37)})


def test_ledger_reconciles(spark):
    days = pd.date_range("2024-01-01", periods=12, freq="D").date
    rng = np.random.default_rng(2)
    rows = [(day, i, float(rng.normal()), float(100 + rng.normal())) for day in days for i in range(6)]
    df = spark.createDataFrame(rows, "date date, code int, score double, open double")
    calendar = joins.number_calendar(df)
    book = portfolio.stock_day_ledger(df, calendar, "score", 2, (1, 2), 0.001, df.select("date", "code", "open"))
    daily = portfolio.daily_book(book)
    assert daily.where("exposure > 1.0000001").count() == 0
    linked = portfolio.linked_attribution(book, daily).groupBy("horizon").agg(F.sum("linked").alias("v")).toPandas().set_index("horizon")["v"]
    total = daily.groupBy("horizon", "phase").agg(F.expm1(F.sum(F.log1p("net_return"))).alias("c")).groupBy("horizon").agg(F.avg("c").alias("c"))
    for r in total.collect():
        assert linked[r["horizon"]] == pytest.approx(r["c"], abs=1e-10)


def test_quotes_of_days_without_trades_stay(spark):
    bar = "date date, code string, open double, high double, low double, close double, volume double, amount double"
    bars = spark.createDataFrame([(d(1), "a", 10.0, 11.0, 9.0, 10.0, 0.0, 0.0), (d(2), "a", 10.0, 11.0, 9.0, 10.5, -1.0, 5.0)], bar)
    before = spark.createDataFrame([(d(1), "a", 10.0), (d(2), "a", 10.0)], "date date, code string, preclose double")
    first, second = pn.assemble_quotes(bars, before).orderBy("date").collect()
    assert first["has_quote"] and first["close"] == 10.0 and first["volume"] == 0.0
    assert not second["has_quote"] and second["close"] is None


def timing_inputs(spark, source="DERIVED_POLICY", twice=False):
    day = "timestamp'2024-01-0{}'"
    rows = spark.sql("select * from values (date'2024-01-02', 2, 'a'), (date'2024-01-03', 2, null), (date'2024-01-03', 3, null) t(date, code, industry)")
    native = spark.sql(
        f"select *, '{source}' available_at_source, 'NATIVE' available_at_source_status, 'NATIVE' industry_known_at_source from values "
        f"(date'2024-01-02', 2, {day.format(2)}, {day.format(2)}, true, {day.format(2)}, null), "
        f"(date'2024-01-03', 2, {day.format(3)}, {day.format(3)}, false, null, {day.format(1)}) "
        "t(date, code, available_at, available_at_quote, has_quote, available_at_status, industry_known_at)"
    )
    bars = spark.sql("select * from values (date'2024-01-02', 3, 1.0), (date'2024-01-03', 3, 0.0) t(date, code, close)")
    statuses = spark.sql("select date'2024-01-03' date, 3 code, 2.0 preclose")
    calendar = spark.sql("select * from values (date'2024-01-02', 1), (date'2024-01-03', 2) t(date, position)")
    bars = bars.union(bars) if twice else bars
    return pn.timing(rows, native, bars, statuses, calendar, F.col("code") == 2, F.col("date").cast("timestamp") + F.expr("interval 13 hours"))


def test_timing_of_both_universes(spark):
    got = {(r["date"].day, r["code"]): r for r in timing_inputs(spark).collect()}
    assert len(got) == 3
    first, second, new = got[2, 2], got[3, 2], got[3, 3]
    assert first["quote_available_at_source"] == "DERIVED_POLICY" and first["previous_quote_available_at_source"] == "MISSING"
    assert first["industry_available_at_source"] == "MISSING" and first["status_available_at_source"] == "NATIVE"
    # no quote: no quote time, but the previous close is timed by the recorded row
    assert second["quote_available_at"] is None and second["preclose_available_at"].day == 3
    assert second["previous_quote_available_at"].day == 2 and second["status_available_at_source"] == "MISSING"
    # a bar without a positive close is no quote; the bar of the session before is one though it has no row here
    assert new["quote_available_at_source"] == "MISSING" and new["previous_quote_available_at"].hour == 13
    assert new["preclose_available_at"].hour == 13 and new["industry_available_at"] is None


@pytest.mark.parametrize("fault", [{"source": "NATIVE"}, {"twice": True}])
def test_timing_refuses_other_sources_and_repeated_cells(spark, fault):
    with pytest.raises(Exception, match="another source|several rows"):
        timing_inputs(spark, **fault).collect()


def holdout_bars_of(spark, last):
    rows = [(c, i, 10.0 + i if i < 20 else last) for c in "ab" for i in range(24)]
    return spark.createDataFrame(rows, "code string, ts int, open double")


def test_development_view_never_sees_the_holdout(spark):
    views = [labels.development_view(holdout_bars_of(spark, last), Series()) for last in (1.0, 999.0)]
    # 24 rows: 3 are held out; the label is computed on the prefix, so its last two are 0
    got = [v.withColumn("y", bt.target_return(Series())).orderBy("code", "ts").collect() for v in views]
    assert [(r["code"], r["ts"]) for r in got[0]] == [(c, i) for c in "ab" for i in range(21)]
    assert [r["y"] for r in got[0]][19:21] == [0.0, 0.0] and got[0][17]["y"] == pytest.approx(math.log(29 / 28))
    short = holdout_bars_of(spark, 1.0).where("ts < 12")
    with pytest.raises(Exception, match="not enough development rows"):
        labels.development_view(short, Series()).collect()


def test_frozen_snapshot_by_hand(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame([(c, i, float(rng.uniform(9, 11)), float(rng.normal()), float(rng.normal())) for c in "abc" for i in range(40)], columns=["code", "ts", "open", "f", "g"])
    df = labels.split_chronologically(spark.createDataFrame(data), Series())
    got = bt.frozen_snapshot(df, ["f", "g"], cost=0.001, periods=100).first()
    per_code = []
    for _, own in data.groupby("code"):
        raw = np.tanh((own.f + own.g) / 2).to_numpy()[36:38]
        pos = np.where(np.abs(raw) >= 0.05, raw, 0.0)
        price = own.open.to_numpy()
        per_code.append(pos * np.log(price[38:40] / price[37:39]) - np.abs(np.diff(pos, prepend=0.0)) * 0.001)
    flat, book = np.concatenate(per_code), np.mean(per_code, axis=0)
    cum = np.cumsum(flat)
    fall = (np.maximum.accumulate(cum) - cum).max()
    assert got["evaluable_bars"] == 2 and got["formula_count"] == 2
    assert got["total_log_pnl"] == pytest.approx(book.sum()) and got["simple_return_equivalent"] == pytest.approx(np.expm1(book.sum()))
    assert got["calmar"] == pytest.approx(np.clip(flat.mean() * 100 / max(fall, 1e-8), -10, 10))
    assert got["sharpe"] == pytest.approx(book.mean() / (book.std() + 1e-8) * 10)
    with pytest.raises(Exception, match="no value"):
        bt.frozen_snapshot(df.withColumn("f", F.lit(None).cast("double")), ["f"]).collect()


def test_unscorable_candidates_stay_behind(spark):
    rng = np.random.default_rng(3)
    rows = []
    for code in "ab":
        for i in range(60):
            ret = float(rng.normal())
            for name, value in [("good", ret + float(rng.normal())), ("noise", float(rng.normal())), ("flat", 1.0), ("none", None)]:
                rows.append((name, code, i, value, ret))
    df = spark.createDataFrame(rows, "candidate string, code string, ts int, factor double, ret double")
    got = {r["candidate"]: r for r in ev.score_candidates(df).collect()}
    assert [c for c, r in sorted(got.items(), key=lambda x: x[1]["place"])] == ["good", "noise", "flat", "none"]
    assert got["flat"]["unscorable"] and got["none"]["importance"] == -math.inf and got["none"]["mi"] == 0.0
    assert got["good"]["importance"] == pytest.approx(1.0) and got["noise"]["importance"] == pytest.approx(0.0)
    # a single scorable candidate has rank 1, none at all keeps every row
    alone = {r["candidate"]: r for r in ev.score_candidates(df.where("candidate in ('good', 'flat')")).collect()}
    assert alone["good"]["importance"] == pytest.approx(1.0) and alone["flat"]["place"] == 2
    assert ev.score_candidates(df.where("candidate = 'none'")).count() == 1
