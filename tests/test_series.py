"""Padded windows, operators and recursions against naive NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions.features import NAMES, NORMED, features
from factorloom.functions.ops import OPS, both, either, gt, lt
from factorloom.functions.recursion import _ema, _robust
from factorloom.functions.series import Series
from factorloom.plans.formula import OP_NAMES, evaluate, restricted_shape, stack_shape, token_names

S = Series()


def make(spark, n_codes, length, seed=1):
    rng = np.random.default_rng(seed)
    rows = [
        (f"c{i}", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=t), float(rng.normal()), float(rng.normal()))
        for i in range(n_codes)
        for t in range(length)
    ]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["code", "ts", "x", "y"]))


def padded(x, t, d):
    real = x[max(0, t - d + 1) : t + 1]
    return np.concatenate([np.zeros(d - len(real)), real])


NAIVE = {
    "TS_MEAN_10": lambda w: w.mean(),
    "TS_STD_20": lambda w: w.std() + 1e-6,
    "TS_RANK_5": lambda w: (w < w[-1]).mean(),
    "TS_SUM_20": lambda w: w.sum(),
    "TS_MAX_10": lambda w: w.max(),
    "TS_MIN_20": lambda w: w.min(),
    "TS_ARG_MAX_5": lambda w: w.argmax() / 4,
    "TS_ARG_MIN_5": lambda w: w.argmin() / 4,
    "TS_ZSCORE_10": lambda w: 0.0 if w.std() < 1e-9 else (w[-1] - w.mean()) / (w.std() + 1e-9),
    "TS_SKEW_10": lambda w: ((w - w.mean()) ** 3).mean() / (w.std() + 1e-6) ** 3,
    "WINSORIZE": lambda w: np.clip(w[-1], np.quantile(w, 0.05), np.quantile(w, 0.95)),
    "DECAY_LINEAR_5": lambda w: (w * [1, 2, 3, 4, 5]).sum() / 15,
}
WIDTH = {"WINSORIZE": 20}


@pytest.mark.parametrize("n_codes,length", [(1, 1), (3, 5), (3, 30), (1, 60)])
def test_padded_operators(spark, n_codes, length):
    df = make(spark, n_codes, length)
    got = df.withColumns({n: OPS[n].build(S, "x") for n in NAIVE}).toPandas()
    for _, g in got.sort_values("ts").groupby("code"):
        x = g["x"].to_numpy()
        for name, fn in NAIVE.items():
            d = WIDTH.get(name) or int(name.rsplit("_", 1)[1])
            want = [fn(padded(x, t, d)) for t in range(len(x))]
            np.testing.assert_allclose(g[name], want, atol=1e-9, err_msg=name)


def test_operator_registry():
    assert len(OPS) == 62 and len(NAMES) == 65
    assert not {"GT", "LT", "AND", "OR"} & set(OPS)
    assert OP_NAMES[0] == "ADD" and OP_NAMES[44] == "CS_RANK" and OP_NAMES[-1] == "IF_GT"


def test_comparison_helpers(spark):
    a, b = F.lit(1.0), F.lit(-1.0)
    row = spark.range(1).select(gt(a, b), lt(a, b), both(a, b), either(a, b)).first()
    assert list(row) == [1.0, 0.0, 0.0, 1.0]


def test_ema_equals_loop():
    x = np.random.default_rng(0).normal(size=5000)
    for span in (2, 5, 26, 50):
        a, y = 2 / (span + 1), [x[0]]
        for v in x[1:]:
            y.append(a * v + (1 - a) * y[-1])
        np.testing.assert_allclose(_ema(x, span), y, atol=1e-10)


def test_robust_norm_uses_lower_medians():
    x = np.random.default_rng(0).normal(size=260)
    got = _robust(x, 200)
    assert not got[:199].any()
    for t in (199, 230, 259):
        w = np.sort(x[t - 199 : t + 1])
        median = w[99]
        mad = np.sort(np.abs(w - median))[99] + 1e-6
        assert math.isclose(got[t], np.clip((x[t] - median) / mad, -5, 5), rel_tol=1e-12)
    assert not _robust(x[:150], 200).any()


def bars(spark, length, codes=2, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(codes):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, length)))
        for t in range(length):
            lo, hi = price[t] * 0.99, price[t] * 1.01
            rows.append((f"c{i}", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=t), price[t] * 0.995, hi, lo, price[t], float(rng.integers(1, 50))))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["code", "ts", "open", "high", "low", "close", "volume"]))


def test_all_features_are_causal_and_finite(spark):
    full = bars(spark, 230)
    whole = features(full, NAMES).toPandas().set_index(["code", "ts"]).sort_index()
    cut = pd.Timestamp("2024-01-01") + pd.Timedelta(hours=210)
    prefix = features(full.where(F.col("ts") < F.lit(cut)), NAMES).toPandas().set_index(["code", "ts"]).sort_index()
    assert np.isfinite(whole.to_numpy()).all()
    np.testing.assert_allclose(prefix.to_numpy(), whole.loc[prefix.index].to_numpy(), atol=1e-8)
    warm = whole.groupby(level=0).head(199)
    assert not warm[[n for n in NAMES if n in NORMED]].to_numpy().any()
    assert (whole["WILLR_14"].abs() < 1e-12).all()  # the ratio is never negative, so the clamp leaves 0


def test_formula_shapes():
    assert stack_shape(["a", "b", "ADD"]) and not stack_shape(["a", "ADD"]) and not stack_shape(["a", "b"])
    assert token_names([0, 65]) == ["RET", "ADD"] and token_names([999]) is None
    leaves = ["a", "b"]
    assert restricted_shape(["a", "b", "ADD", "CS_RANK"], leaves)
    assert not restricted_shape(["a", "WMA"], leaves)
    assert not restricted_shape(["a"] + ["NEG"] * 13, leaves)
    assert not restricted_shape(["a"] + ["NEG"] * 7, leaves)


def test_formula_remembers_invalid_inputs(spark):
    df = make(spark, 2, 4).withColumn("x", F.when(F.col("x") > 0.5, F.lit(float("inf"))).otherwise(F.col("x")))
    out = evaluate(df, ["x", "y", "MUL"], S, leaves=["x", "y"], normalise=False).toPandas()
    bad = np.isinf(out["x"])
    assert (out["invalid"] == bad).all() and np.isfinite(out["factor"]).all()
    assert np.allclose(out["factor"][bad], out["y"][bad])  # infinity counts as 1
    assert evaluate(df, ["x", "ADD"], S, leaves=["x"]).where("factor is not null").count() == 0
