"""Sequential recursions that a window function cannot express, as grouped Arrow tasks.

Both helpers run once per series (or per block of a long series, see ``operators.blocks``) on
data that Spark has already shuffled by the same keys the surrounding windows use.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factorloom.functions.series import Series

EMA_REACH = 20  # in spans: beyond it the weight of a row is below double precision


def _ema(x: np.ndarray, span: int) -> np.ndarray:
    """y[0] = x[0];  y[t] = a*x[t] + (1-a)*y[t-1]  with a = 2/(span+1)."""
    alpha = 2.0 / (span + 1.0)
    if alpha >= 1.0 or len(x) == 0:
        return x.copy()
    keep = 1.0 - alpha
    width = max(1, int(-30.0 / np.log(keep)))  # keep**-width stays near e**30
    powers = keep ** np.arange(width)
    out = np.empty_like(x)
    carry = x[0]
    for start in range(0, len(x), width):
        part = x[start : start + width]
        p = powers[: len(part)]
        local = np.cumsum(alpha * part / p) * p
        out[start : start + width] = local + carry * keep * p
        carry = out[start + len(part) - 1]
    return out


def _robust(x: np.ndarray, width: int) -> np.ndarray:
    """(x - median) / MAD over the last ``width`` rows, lower medians, clipped to +-5."""
    out = np.zeros_like(x)
    middle = (width - 1) // 2
    windows = np.lib.stride_tricks.sliding_window_view(x, width) if len(x) >= width else x[:0]
    for start in range(0, len(windows), 4096):
        part = windows[start : start + 4096]
        median = np.partition(part, middle, axis=1)[:, middle]
        spread = np.partition(np.abs(part - median[:, None]), middle, axis=1)[:, middle] + 1e-6
        at = start + width - 1
        out[at : at + len(part)] = np.clip((x[at : at + len(part)] - median) / spread, -5.0, 5.0)
    return out


def _per_group(df: DataFrame, s: Series, added: Mapping[str, str], compute) -> DataFrame:
    """Add float columns ``added`` to ``df``; ``compute(column getter) -> {name: array}``."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(c, T.DoubleType()) for c in added])
    order = s.order

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        arrays = compute(lambda c: table.column(c).to_numpy().astype("float64"))
        for name in added:
            table = table.append_column(name, pa.array(arrays[name], pa.float64()))
        return table

    return df.groupBy(*s.keys).applyInArrow(run, schema)


def with_ema(df: DataFrame, s: Series, specs: Mapping[str, tuple[str, Sequence[int]]]) -> DataFrame:
    """Add exponential averages: ``specs[new] = (source column, spans applied in turn)``."""

    def compute(column):
        out, known = {}, {}
        for name, (source, spans) in specs.items():
            done, values = (source,), None
            for span in spans:
                step = done + (span,)
                if step not in known:
                    known[step] = _ema(column(source) if values is None else values, span)
                done, values = step, known[step]
            out[name] = values
        return out

    return _per_group(df, s, dict.fromkeys(specs, ""), compute)


def with_robust_norm(df: DataFrame, s: Series, columns: Mapping[str, str], width: int = 200) -> DataFrame:
    """Add rolling robust z-scores: ``columns[new] = source``.  Short histories give zeros.

    The first ``width - 1`` rows of a series are 0, so a block that starts inside a series must
    carry at least ``width - 1`` rows of halo.
    """
    return _per_group(
        df, s, columns, lambda column: {new: _robust(column(old), width) for new, old in columns.items()}
    )
