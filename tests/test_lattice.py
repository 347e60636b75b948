"""The experiment lattice against single ledgers, audit days, the score grid and the retention inputs."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factorloom.operators import evaluate as ev, joins, portfolio as pf, quality as ql, retention as rt

DAYS = [date(2024, 1, 1) + timedelta(days=i) for i in range(40)]


def test_lattice_equals_single_ledgers(spark):
    rng = random.Random(1)
    rows = [(d, c, rng.choice([None, 1.0, 2.0, rng.random()]), rng.random(), 1 + rng.random()) for d in DAYS for c in range(12) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "date date, code long, a double, b double, open double")
    calendar, opens = joins.number_calendar(df), df.select("date", "code", "open")
    book = pf.lattice_book(df, calendar, ["a", "b"], (2, 5), (1, 3), opens, 4).collect()
    for score in ("a", "b"):
        for size in (2, 5):
            one = pf.daily_book(pf.stock_day_ledger(df, calendar, score, size, (1, 3), 0.0, opens)).collect()
            want = {(r["horizon"], r["phase"], r["position"]): (r["gross_return"], r["turnover"], r["exposure"]) for r in one}
            got = {(r["horizon"], r["phase"], r["position"]): (r["gross_return"], r["turnover"], r["exposure"]) for r in book if (r["score"], r["size"]) == (score, size)}
            assert got.keys() == want.keys()
            assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert {r["fold"] for r in book} == {0, 1, 2, 3}


def test_levels_hold_every_combination(spark):
    rows = [("s", 5, h, p, f, m, 0.1 * h * (f + 1) - m, 0.01 * h) for h in (1, 3) for p in range(h) for f in range(3) for m in (1.0, 2.0)]
    df = spark.createDataFrame(rows, "score string, size int, horizon int, phase int, fold int, multiple double, sharpe double, annual_return double")
    got = pf.compare_levels(df).collect()
    assert len(got) == 6 and all(r["folds"] == r["folds_better"] == 3 and r["sharpe_delta"] == pytest.approx(0.4) for r in got)


def test_audit_draw_does_not_depend_on_partitions(spark):
    days = [date(2023, 1, 1) + timedelta(days=i) for i in range(500)]
    sessions = spark.createDataFrame([(d,) for d in days if d.weekday() < 5], "date date")
    events = spark.createDataFrame([(d, k) for i, d in enumerate(days) for k in ("xr", "wd") if i % (40 if k == "xr" else 75) == 6], "date date, kind string")
    priority = F.xxhash64("date", F.lit(5))
    draws = [sorted(map(tuple, ql.audit_days(events.repartition(n), sessions.repartition(n), 6, priority).collect())) for n in (1, 64)]
    assert draws[0] == draws[1]
    for year in (2023, 2024):
        own = [r for r in draws[0] if r[0] == year]
        assert {"xr", "wd", "random"} == {r[2] for r in own} and len({r[1] for r in own}) == 6
        assert all(r[1].weekday() < 5 for r in own)


def test_score_grid_rules(spark):
    good = dict(date=DAYS[0], code="a", fold_id="f", score=1.0, is_member=True, signal_valid=True, score_available_at=datetime(2024, 1, 1, 13))
    faults = {
        "EMPTY_KEY": dict(code=" "), "NULL_BOOLEAN": dict(signal_valid=None), "AVAILABILITY_DATE": dict(score_available_at=datetime(2024, 1, 1, 17)),
        "INFINITE_SCORE": dict(score=float("inf"), signal_valid=False), "VALID_MISMATCH": dict(score=None), "NON_MEMBER_SCORE": dict(is_member=False, signal_valid=False),
    }
    schema = "date date, code string, fold_id string, score double, is_member boolean, signal_valid boolean, score_available_at timestamp"
    for fault, change in faults.items():
        rows = [dict(good, code="b"), dict(good, **change)]
        got = {r["code"] for r in ql.score_grid_contract(spark.createDataFrame(rows, schema)).collect() if r["n_rows"]}
        assert got == {fault}
    assert {r["code"] for r in ql.score_grid_contract(spark.createDataFrame([good, good], schema)).collect() if r["n_rows"]} == {"DUPLICATE_KEY"}
    assert {r["code"] for r in ql.score_grid_contract(spark.createDataFrame([], schema)).collect() if r["n_rows"]} == {"EMPTY_GRID"}


def test_increment_of_a_useless_candidate(spark):
    rng = random.Random(2)
    rows = []
    for code in ("x", "y"):
        for i in range(200):
            ret = rng.gauss(0, 1)
            for s, pos in (("good", ret + rng.gauss(0, 1)), ("other", ret + rng.gauss(0, 1)), ("noise", rng.gauss(0, 3))):
                rows.append((s, code, datetime(2024, 1, 1) + timedelta(hours=i), pos, pos, ret, pos * ret, 0.0, i + 1, 202))
    df = spark.createDataFrame(rows, "strategy string, code string, ts timestamp, factor double, pos double, ret double, pnl double, turnover double, rn int, bars int")
    got = {r["strategy"]: r for r in rt.increments(df).collect()}
    assert got["good"]["increment"] > 0.02 and got["good"]["increment_fold_ratio"] == 1 and got["noise"]["increment"] < 0
    assert got["noise"]["increment_fold_ratio"] == 0 and got["noise"]["portfolio_delta"] < 0
    overall = ev.series_ic(df, ["strategy", "code"], "factor", "ret").groupBy("strategy").agg(F.avg("rank_ic").alias("rank_ic"))
    assert {r["strategy"]: r["fold_direction_ratio"] for r in rt.fold_direction(df, overall).collect()}["good"] == 1
    assert {r["strategy"]: r["segment_direction_ratio"] for r in rt.segment_direction(df, overall).collect()}["good"] == 1
    ci = {r["strategy"]: r for r in rt.daily_interval(df, ["good", "noise", "other"], 2, 300, 7).collect()}
    assert ci["good"]["ci_low"] > 0.2 and ci["noise"]["ci_low"] < ci["noise"]["ci_high"]


def test_only_accepted_candidates_are_ranked(spark):
    cols = "strategy string, rank_icir double, icir double, increment double, net_sharpe double, direction_ratio double, max_correlation double, turnover double, operators int, ok boolean"
    rows = [("a", 0.1, 0.1, 0.01, 1.0, 0.6, 0.1, 0.1, 3, True), ("b", 9.0, 9.0, 9.0, 9.0, 1.0, 0.0, 0.0, 1, False), ("c", 0.5, 0.5, 0.02, 1.0, 0.9, 0.1, 0.1, 3, True)]
    got = {r["strategy"]: (r["ranking"] is not None, r["place"]) for r in ev.ranked_candidates(spark.createDataFrame(rows, cols), F.col("ok")).collect()}
    assert got == {"a": (True, 2), "b": (False, None), "c": (True, 1)}
