"""Hot keys: block splitting, rank tables and carried sums give the same values as the plain forms."""

import pytest

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from factorloom.operators import blocks
from factorloom.operators.allocation import shrunk_covariance
from factorloom.operators.ranks import quantile_table, value_table, with_average_rank
from factorloom.plans import catalog_stream as cs
from factorloom.session import checkpointed
from tests.conftest import SF


def same(a, b, keys):
    a, b = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (a, b))
    assert len(a) == len(b) and list(a.columns) == list(b.columns)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c], b[c], atol=1e-9, err_msg=c)
        else:
            assert (a[c] == b[c]).all(), c


def test_small_blocks_equal_one_block(spark):
    one = cs.tick_windows(spark, SF, block_rows=1_000_000)
    many = cs.tick_windows(spark, SF, block_rows=40)
    same(one.drop("ts"), many.drop("ts"), ["code", "rn"])


def test_recursion_in_blocks(spark):
    same(cs.u3_ticks(spark, SF, 1_000_000), cs.u3_ticks(spark, SF, 120), ["code", "rn"])


def test_rows_are_numbered_without_gaps(spark):
    df = spark.range(1000).select(F.lit("hot").alias("code"), F.col("id").alias("t"))
    numbered = blocks.number_rows(df, ["code"], ["t"], F.floor(F.col("t") / 70), {"run": F.col("t").cast("double")})
    got = numbered.orderBy("t").toPandas()
    assert (got["rn"] == np.arange(1, 1001)).all()
    assert (got["run"] == np.cumsum(np.arange(1000))).all()
    cut = blocks.split(numbered, halo=10, block_rows=100)
    sizes = cut.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_halo").cast("int")).alias("h")).toPandas()
    # every block hands its last ten rows on; the block after the last one holds nothing else
    assert sizes["n"].max() == 110 and sizes["h"].sum() == 100
    assert blocks.trim(cut).count() == 1000


def skewed(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros(700), rng.normal(size=1300).round(2)])
    g = np.where(rng.random(2000) < 0.8, "hot", "cold")
    return pd.DataFrame({"g": g, "x": x, "id": np.arange(2000)})


def test_average_ranks_of_a_hot_value(spark):
    pdf = skewed(spark)
    got = with_average_rank(spark.createDataFrame(pdf), ["g"], "x", "r").toPandas().set_index("id").sort_index()
    want = pdf.groupby("g")["x"].rank(method="average")
    np.testing.assert_allclose(got["r"], want)


def test_exact_quantiles(spark):
    pdf = skewed(spark)
    table = value_table(spark.createDataFrame(pdf), ["g"], "x")
    got = quantile_table(table, ["g"], "x", lambda k: k / 10.0, 11).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, "q"], np.quantile(part["x"], np.arange(11) / 10), atol=1e-12)


def test_features_in_blocks(spark):
    one = cs.minute_features(spark, "/root/testdata/sf0.01", halo=500, block_rows=100_000)
    many = cs.minute_features(spark, "/root/testdata/sf0.01", halo=500, block_rows=600)
    same(one, many, ["code", "ts"])


def test_blocks_refuse_what_they_cannot_answer(spark):
    from factorloom.functions.series import Series
    from factorloom.operators.blocks import block_series

    blocked = block_series(Series())
    for window in (blocked.cross, blocked.so_far):
        with pytest.raises(ValueError):
            window()
    blocked.last(5)


def test_covariance_tiles_and_period_slices(spark):
    """Tiles of codes and slices of periods add up to the plain product; an incomplete code drops out."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(100, 13)) @ rng.normal(size=(13, 13))
    rows = [(p, f"c{c:02d}", float(values[p, c])) for p in range(100) for c in range(13)] + [(5, "short", 1.0)]
    returns = spark.createDataFrame(rows, "period int, code string, r double")
    x = values - values.mean(axis=0)
    s = x.T @ x / 100
    mu = np.trace(s) / 13
    delta = ((s - mu * np.eye(13)) ** 2).sum() / 13
    beta = (((x**2).sum(axis=1) ** 2).sum() / 100 - (s**2).sum()) / (13 * 100)
    w = min(beta, delta) / delta
    want = (1 - w) * s + w * mu * np.eye(13)
    for n, span in ((1, 1000), (3, 7), (20, 100)):
        got = shrunk_covariance(returns, blocks=n, span=span).toPandas()
        assert len(got) == 169
        np.testing.assert_allclose(got.pivot(index="a", columns="b", values="covariance").to_numpy(), want, atol=1e-9)
        np.testing.assert_allclose(got.shrinkage, w, atol=1e-9)
    assert shrunk_covariance(returns.limit(0)).collect() == []


def test_bins_and_cells_stand_for_the_rows(spark):
    """Edges lie halfway between the neighbours at k * rows / bins; trees on weighted cells are the trees on binned rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from factorloom.operators import evaluate as ev

    rng = np.random.default_rng(6)
    n = 6000
    pdf = pd.DataFrame({"fold": np.arange(n) % 2, "a": rng.normal(size=n), "b": rng.normal(size=n), "learn": rng.random(n) < 0.7})
    pdf["y"] = np.sin(pdf.a * 2) + pdf.b * (pdf.a > 0) + rng.normal(size=n)
    rows = checkpointed(ev.binned(spark.createDataFrame(pdf).repartition(16), ["fold"], ["a", "b"], F.col("learn"), 8))
    got = rows.toPandas()
    assert len(got) == n
    for (fold, name) in ((0, "a"), (1, "a"), (0, "b"), (1, "b")):
        part = got[got.fold == fold]
        x = np.sort(part[part.learn][name].to_numpy())
        at = np.floor(np.arange(1, 8) * len(x) / 8 + 0.5).astype(int)
        edges = (x[at - 1] + x[at]) / 2
        assert (part[f"b_{name}"].to_numpy() == np.searchsorted(edges, part[name].to_numpy(), "left")).all()
    assemble = VectorAssembler(inputCols=["b_a", "b_b"], outputCol="features").transform
    trees = dict(featuresCol="features", maxIter=4, maxDepth=3, seed=1)
    train = assemble(rows.where("learn and fold = 0"))
    cells = assemble(ev.cells(rows.where("learn"), ["fold"], ["a", "b"], "y").where("fold = 0"))
    assert cells.count() <= 64
    plain = GBTRegressor(labelCol="y", **trees).fit(train)
    small = GBTRegressor(labelCol="mean", weightCol="n", **trees).fit(cells)
    both = [[r["prediction"] for r in m.transform(cells).orderBy("b_a", "b_b").collect()] for m in (plain, small)]
    np.testing.assert_allclose(both[0], both[1], atol=1e-9)


def test_ranks_of_many_partitions_are_gapless(spark):
    """The ranges of a group are the same wherever they are read."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": np.arange(20_000) % 3, "x": rng.normal(size=20_000)})
    table = value_table(spark.createDataFrame(pdf).repartition(40), ["g"], "x").toPandas()
    for _, part in table.groupby("g"):
        assert (part.sort_values("x").start.to_numpy() == np.arange(len(part))).all()
