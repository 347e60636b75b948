"""Re-ranking without groups and rows, control draws and rounds of greedy selection against plain versions."""

import random
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from factorloom.operators import controls, evaluate as ev, feasibility as fe


def plain_ic(x, y):
    x, y = pd.Series(x).rank(), pd.Series(y).rank()
    return x.corr(y) if x.nunique() > 1 and y.nunique() > 1 else np.nan


def test_rank_ic_without_each_row():
    rng = np.random.default_rng(1)
    for n, values in ((12, 4), (40, 6), (60, 1000), (30, 2)):
        x, y = rng.integers(0, values, n).astype(float), rng.integers(0, values, n).astype(float)
        want = [plain_ic(np.delete(x, i), np.delete(y, i)) for i in range(n)]
        np.testing.assert_allclose(ev._drop_each(x, y), want, atol=1e-9)


def test_rank_ic_without_each_row_of_a_wide_date():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal(100_000), rng.standard_normal(100_000)
    got = ev._drop_each(x, y)
    for i in (0, 77, 99_999):
        assert abs(got[i] - plain_ic(np.delete(x, i), np.delete(y, i))) < 1e-9


def test_rank_ic_without_groups(spark):
    rng = random.Random(3)
    rows = [(d, c, rng.choice(["a", "b", "c", None]), float(rng.randrange(7)), rng.choice([None, 1.0, 2.0, 5.0, 8.5])) for d in range(4) for c in range(40)]
    df = spark.createDataFrame(rows, "date int, code int, g string, x double, y double")
    got = {(r["date"], r["dropped"]): (r["n"], r["rank_ic"]) for r in fe.without_group_ic(df, ["date"], "g", "x", "y").collect()}
    frame = df.toPandas().dropna(subset=["x", "y"])
    assert len(got) == 12
    for (d, g), (n, ic) in got.items():
        rest = frame[(frame.date == d) & ((frame.g != g) | frame.g.isna())]
        assert n == len(rest) and abs(ic - plain_ic(rest.x, rest.y)) < 1e-12


def _priority(draw, head, target, control, seed):
    h = (draw * 1000003 + head * 7919 + target * 10007 + control * 104729 + seed) % 2147483646 + 1
    for _ in range(3):
        h = h * 48271 % 2147483647
    return h


def test_draws_without_replacement(spark):
    rng = random.Random(4)
    meta = {c: (rng.choice("xxxyyz"), rng.randrange(100, 130)) for c in range(60)}
    meta[60] = meta[61] = ("lone", 110)  # an industry that the head uses up
    heads = {"h1": (1, [3, 9, 20, 60, 61]), "h2": (2, list(range(30, 42)))}
    table = spark.createDataFrame([(c, *v) for c, v in meta.items()], "code long, industry string, member_days long")
    sets = spark.createDataFrame([(n, i, c) for n, (i, cs) in heads.items() for c in cs], "head string, head_id int, code long")
    got = {(r["head"], r["draw"], r["code"]): (r["control"], r["gap"], r["fallback"]) for r in controls.matched_controls(table, sets, 6, 5).collect()}
    want = {}
    for name, (number, codes) in heads.items():
        for draw in range(6):
            free = set(meta) - set(codes)
            for t in sorted(codes):
                pool = [c for c in free if meta[c][0] == meta[t][0]]
                fallback = not pool
                near = sorted(pool or free, key=lambda c: (abs(meta[c][1] - meta[t][1]), c))[:10]
                pick = min(near, key=lambda c: _priority(draw, number, t, c, 5))
                want[name, draw, t] = (pick, abs(meta[pick][1] - meta[t][1]), fallback)
                free.remove(pick)
    assert got == want and any(w[2] for w in want.values())
    drawn = controls.uniform_controls(table, sets, 6, 5).toPandas()
    assert (drawn.groupby(["head", "draw"]).control.nunique() == drawn.groupby(["head", "draw"]).size()).all()
    assert set(drawn.groupby(["head", "draw"]).size()["h2"]) == {12}


def test_many_targets_draw_in_tasks_of_one_industry(spark):
    """200 targets in four industries: no target lists controls, a task holds the codes of one industry."""
    rng = random.Random(8)
    meta = {c: (c % 4, rng.randrange(60, 84)) for c in range(1600)}
    codes = sorted(rng.sample(range(1600), 200))
    table = spark.createDataFrame([(c, *v) for c, v in meta.items()], "code long, industry int, member_days long")
    sets = spark.createDataFrame([("h", 1, c) for c in codes], "head string, head_id int, code long")
    plan = controls.matched_controls(table, sets, 2, 5)
    got = {(r["draw"], r["code"]): (r["control"], r["gap"], r["fallback"]) for r in plan.collect()}
    want = {}
    for draw in range(2):
        free = set(meta) - set(codes)
        for t in codes:
            near = sorted((c for c in free if meta[c][0] == meta[t][0]), key=lambda c: (abs(meta[c][1] - meta[t][1]), c))[:10]
            pick = min(near, key=lambda c: _priority(draw, 1, t, c, 5))
            want[draw, t] = (pick, abs(meta[pick][1] - meta[t][1]), False)
            free.remove(pick)
    assert got == want
    # no column of lists: a row is a code
    assert "ArrayType" not in str(plan._jdf.queryExecution().analyzed().schema()) and "targets" not in plan._jdf.queryExecution().analyzed().toString()


def test_deleted_codes_are_ranked_out_without_copies(spark):
    rng = random.Random(12)
    rows = [(date(2020, 1, 1 + d), c, float(rng.randrange(9)), rng.choice([None, 1.0, 2.0, 5.0, 8.5, 9.0])) for d in range(5) for c in range(30)]
    df = spark.createDataFrame(rows, "date date, code long, x double, y double")
    gone = {"all": [], "few": [3, 4, 3], "most": list(range(19)), "none_left": list(range(30))}
    cases = [(s, c) for s, cs in gone.items() for c in (cs or [None])]
    plan = ev.deletion_rank_ic(df, spark.createDataFrame(cases, "scenario string, code long"), "x", "y", need=6)
    got = {r["scenario"]: (r["dates"], r["rows"], r["rank_ic"]) for r in plan.collect()}
    frame = df.toPandas().dropna()
    for name, codes in gone.items():
        daily = [(len(p), plain_ic(p.x, p.y)) for _, p in frame[~frame.code.isin(codes)].groupby("date")]
        daily = [(n, ic) for n, ic in daily if n >= 6 and not np.isnan(ic)]
        assert (name in got) == bool(daily)
        if daily:
            assert got[name][:2] == (len(daily), sum(n for n, _ in daily)) and abs(got[name][2] - np.mean([ic for _, ic in daily])) < 1e-9
    # every scenario used to copy all rows before the ranks
    assert "explode" not in plan._jdf.queryExecution().analyzed().toString()


def test_pruning_rounds(spark):
    rng = random.Random(6)
    scores = [(f"c{i:02}", rng.randrange(40) / 20) for i in range(40)]
    pairs = {(a, b): rng.choice([0.2, 0.95]) if rng.random() < 0.3 else 0.1 for a, _ in scores for b, _ in scores if a < b}
    want = ev.correlation_prune(scores, pairs)
    table = spark.createDataFrame([(a, b, c) for (a, b), c in pairs.items()], "a string, b string, corr double")
    got = controls.prune(spark.createDataFrame(scores, "candidate string, importance double"), table).collect()
    assert {r["candidate"]: r["in_favour_of"] for r in got} == want
    assert {r["status"] for r in got if want[r["candidate"]]} == {"pruned"}


def test_concentration_rows(spark):
    """Without its one good industry the gain turns; the year rule needs two years of 40 sessions."""
    days = [date(2020 + i // 60, 1 + i % 12, 1 + i % 28) for i in range(180)]
    book = [(h, p, i // 60, i, days[i], 0.002 * h + 0.001 * ((i * 7 + p) % 5 - 2)) for h in (1, 3) for p in range(h) for i in range(180)]
    book = spark.createDataFrame(book, "horizon int, phase int, fold int, position int, date date, net_return double")
    rng = random.Random(9)
    rows = []
    for i in range(6):
        for code in range(30):
            good = code < 15
            x = rng.random()
            for h in (1, 3):
                y = x if good and h == 3 else -x if h == 3 else rng.random() * 0.1 + 0.5 * x * good
                rows.append((h, 0, days[i], code, "good" if good else "bad", x, y))
    rows = spark.createDataFrame(rows, "horizon int, fold int, date date, code int, industry string, s double, value double")
    got = fe.concentration(book, rows, "s", "industry", 250).collect()
    kinds = {k: [r for r in got if r["kind"] == k] for k in ("year", "industry", "stock")}
    assert len(kinds["year"]) == 3 and all(r["agrees"] for r in kinds["year"])
    assert {r["dropped"] for r in kinds["industry"]} == {"good", "bad"} and len(kinds["stock"]) == 1
    assert len({np.sign(r["delta"]) for r in kinds["industry"]}) == 2
    ok = fe.concentration_ok(spark.createDataFrame(got)).collect()[0]
    assert ok["year_ok"] and not ok["industry_ok"] and not ok["concentration_ok"]


def test_gate_over_ten_checks(spark):
    row = dict(horizon=3, median_sharpe=1.0, base_median_sharpe=0.5, median_return=0.2, base_median_return=0.1, ci_low=0.1, reject=True, phases_agreeing=2,
               worst_sharpe=0.3, folds_agreeing=3, median_drawdown=0.1, base_median_drawdown=0.1, signals_agreeing=2, concentration_ok=True)
    bad = dict(row, horizon=5, ci_low=-0.1, worst_sharpe=0.2, concentration_ok=False)
    df = spark.createDataFrame([row, bad]).withColumn("f", ev.failed_checks(fe.gate_checks()))
    got = {r["horizon"]: r["f"] for r in df.collect()}
    assert got == {3: [], 5: ["bootstrap_ci_lower_positive", "phase_direction", "worst_phase_floor", "not_single_year_or_group"]}
    end = fe.classify(df.select("horizon", (F.size("f") == 0).alias("passed"))).collect()[0]
    assert tuple(end) == ("HORIZON_FEASIBLE_3D", "RESEARCH_GATE_PASSED")
