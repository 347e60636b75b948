"""Registry of the named queries and their SQL twins.

A query declares the columns it returns once, as ``name:type`` pairs; both the DataFrame and
the SQL text are finished with the same projection, so names, types and rounding agree.
Types: ``s`` text, ``t`` time or date as text, ``i`` integer, ``b`` boolean, ``d`` number
rounded to 6 decimals, ``c`` number rounded to 3 decimals (half up, by the same arithmetic on
both sides).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_DIGITS = {"d": 6, "c": 3}


def _pairs(columns: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in columns.split()]


def finish(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _pairs(columns):
        c = F.col(name)
        if kind in _DIGITS:
            scale = 10.0 ** _DIGITS[kind]
            c = F.floor(c.cast("double") * scale + 0.5) / scale
        elif kind in "st":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "b":
            c = c.cast("boolean")
        out.append(c.alias(name))
    return df.select(*out)


def finish_sql(sql: str, columns: str) -> str:
    out = []
    for name, kind in _pairs(columns):
        if kind in _DIGITS:
            scale = f"CAST({10 ** _DIGITS[kind]} AS DOUBLE)"
            out.append(f"floor(CAST(\"{name}\" AS DOUBLE) * {scale} + CAST(0.5 AS DOUBLE)) / {scale} AS \"{name}\"")
        else:
            cast = {"s": "VARCHAR", "t": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN"}[kind]
            out.append(f"CAST(\"{name}\" AS {cast}) AS \"{name}\"")
    return f"SELECT {', '.join(out)} FROM (\n{sql}\n) AS finished"


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir), columns)
        if sql is not None:
            ORACLES[name] = finish_sql(sql, columns)
        return fn

    return register


# -- SQL twins of the derived sources ------------------------------------------------
BARS_SQL = """bars AS (
  SELECT event_type AS code, date_trunc('hour', ts) AS ts,
         arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ROW(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume,
         round(sum(value), 6) AS amount,
         row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) AS rn
  FROM events GROUP BY 1, 2)"""

_PANEL_SQL = """{name} AS (
  SELECT l.code, l.date, l.open, l.high, l.low, l.close, l.volume, l.amount, r_name AS industry FROM (
    SELECT l_suppkey AS code, CAST(date_trunc('{every}', l_shipdate) AS DATE) AS date,
           arg_min(l_extendedprice / l_quantity, ROW(l_shipdate, l_orderkey, l_linenumber)) AS open,
           max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
           arg_max(l_extendedprice / l_quantity, ROW(l_shipdate, l_orderkey, l_linenumber)) AS close,
           CAST(sum(l_quantity) AS DOUBLE) AS volume, round(sum(l_extendedprice), 6) AS amount
    FROM lineitem GROUP BY 1, 2) l
  JOIN supplier ON s_suppkey = l.code JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey)"""
PANEL_SQL = _PANEL_SQL.format(name="panel", every="month")
WEEKLY_SQL = _PANEL_SQL.format(name="weekly", every="week")

DESKS_SQL = """panel AS (
  SELECT l_suppkey % 40 AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         arg_min(l_extendedprice / l_quantity, ROW(l_shipdate, l_orderkey, l_linenumber)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, ROW(l_shipdate, l_orderkey, l_linenumber)) AS close,
         CAST(sum(l_quantity) AS DOUBLE) AS volume, round(sum(l_extendedprice), 6) AS amount,
         'I' || (l_suppkey % 40 % 4) AS industry
  FROM lineitem GROUP BY 1, 2, 9)"""

MEMBERS_SQL = """members AS (
  SELECT date, code, amount / total * 100 AS weight_pct FROM (
    SELECT date, code, amount, sum(amount) OVER (PARTITION BY date) AS total,
           row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS place FROM panel)
  WHERE place <= 60)"""

INTERVALS_SQL = """intervals AS (
  SELECT s_suppkey AS code, DATE '1990-01-01' AS valid_from,
         CASE WHEN s_suppkey % 10 = 0 THEN DATE '1998-06-30' END AS valid_to, r_name AS industry,
         TIMESTAMP '1990-01-01 21:00:00' AS known_at
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL
  SELECT s_suppkey, DATE '1998-07-01', NULL, r_name || '_NEW',
         CASE WHEN s_suppkey % 20 = 0 THEN TIMESTAMP '1999-08-05 21:00:00'
              ELSE TIMESTAMP '1998-07-01 21:00:00' END
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE s_suppkey % 10 = 0)"""
