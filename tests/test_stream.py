"""Streaming jobs over several micro-batches against one evaluation of the whole table."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from factorloom.plans.research import MOMENTUM, factor_table
from factorloom.session import shared_folder
from factorloom.streaming import stream as st


def momentum(bars):
    return factor_table(bars.sparkSession, "", MOMENTUM, bars=bars)


@pytest.fixture()
def bars(spark):
    """Four codes; ``old`` has no bar in the second half of the hours."""
    hours = spark.range(60).withColumn("code", F.explode(F.array(*map(F.lit, ("a", "b", "c", "old")))))
    hours = hours.where((F.col("code") != "old") | (F.col("id") < 30))
    close = 100 + (F.col("id") * 37 + F.ascii("code") * 11) % 17
    return hours.select(
        "code", F.timestamp_seconds(F.col("id") * 3600 + 1_700_000_000).alias("ts"),
        (close - 1.0).alias("open"), (close + 1.0).alias("high"), (close - 2.0).alias("low"), close.cast("double").alias("close"),
        F.lit(5.0).alias("volume"), "id",
    )


def test_signals_of_many_batches_equal_one(spark, bars):
    source = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    for part in range(3):
        bars.where((F.col("id") / 20).cast("int") == part).drop("id").coalesce(1).write.mode("append").parquet(source)
    for keep in (500, 50):
        folder = st.stream_folder(spark)
        stream = spark.readStream.schema(bars.drop("id").schema).option("maxFilesPerTrigger", 1).parquet(source)
        written = st.run_available(stream, folder, "signals", st.refresh_signals(folder, momentum, 20, keep))
        assert written.agg(F.max("epoch")).first()[0] == 2
        got = {r["code"]: r for r in st.newest_epoch(written).collect()}
        want = {r["code"]: r for r in st.latest_signal(bars.drop("id"), 20, momentum).collect()}
        assert set(got) == {"a", "b", "c", "old"}
        for code, row in want.items():
            assert got[code]["bars_used"] == min(keep, row["bars_used"])
            assert (got[code]["last_ts"], got[code]["state"], got[code]["direction"]) == (row["last_ts"], "ok", row["direction"])
            assert math.isclose(got[code]["strength"], row["strength"], abs_tol=1e-12)


def test_states_of_a_signal(spark, bars):
    now = F.lit(1_700_000_000 + 59 * 3600 + 1799)
    signal = st.latest_signal(bars.drop("id"), 40, momentum, now)
    states = {r["code"]: (r["state"], r["direction"]) for r in signal.collect()}
    assert states["a"] == ("pending", None) and states["old"] == ("insufficient", None)
    for bad in (float("nan"), float("inf"), None):
        broken = st.latest_signal(bars.drop("id"), 20, lambda b: b.withColumn("factor", F.lit(bad).cast("double")), now + 1)
        assert {r["state"] for r in broken.collect()} == {"error"}
