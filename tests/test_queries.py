"""The registered queries: names, twins and a cross-section of them checked against SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from factorloom.plans import catalog, catalog_stream as cs
from tests.conftest import SF
from tools.check import TABLES, same, sort_key

CHECKED = [
    "E1_factor_backtest", "W13_W15_ts_mean", "W45_cs_rank", "U1_W63_W64_formula_factor", "C9_tradability", "J2_asof_with_validity",
    "P1_total_return_chain", "X7_X8_industry_leave_one_out", "L2_horizon_labels", "V12_moving_block_bootstrap", "B7_trades",
    "A4_shrunk_covariance", "Q3_panel_gate_issues", "T2_stream_closed_bars", "T5_stream_direction_flips",
]


def test_registry():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 200
    # the optional corpus operators have brute-force tests of their own
    without = set(catalog.QUERIES) - set(oracles)
    assert without == {"S12_V34_snapshot_manifest", "V34_fingerprint", "V27_model_increment"}


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 5 and all(r["bars"] > 100 for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = sorted((tuple(r) for r in entry_module.queries()[name](spark, SF).collect()), key=sort_key)
    want = sorted(con.execute(entry_module.oracle_sql()[name]).fetchall(), key=sort_key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(same(x, y, 1e-6) for x, y in zip(a, b)), (a, b)


def test_stream_equals_batch(spark):
    stream = cs.t5_stream(spark, SF).select("code", "ts", "previous", "direction")
    batch = cs.t5_batch(spark, SF).select("code", "ts", "previous", "direction")
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0
