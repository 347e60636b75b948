"""The 62 formula operators as Column expressions.

Every operator maps columns of one ``Series`` to a column.  ``kind`` tells the formula builder
what the operator needs: ``map`` (same row), ``time`` (a window over the series), ``cross`` (a
window over all members at one time) or ``ema`` (the sequential recursion of ``recursion.py``).
Window operators take *column names*, because Spark does not nest window functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.functions.series import Series, clamp, let


@dataclass(frozen=True)
class Op:
    name: str
    arity: int
    kind: str
    build: Callable[..., Column]
    span: int = 0


def _signed(x: Column, magnitude: Column) -> Column:
    return F.signum(x) * magnitude


def _div(s: Series, x, y) -> Column:
    below = F.col(y) + 1e-6
    limit = F.signum(F.col(x)) * float("inf")
    return F.when(below == 0, limit).otherwise(F.col(x) / F.when(below != 0, below))


def _jump(s: Series, x) -> Column:
    mean = F.avg(x).over(s.so_far())
    spread = F.sqrt(F.greatest(F.var_pop(x).over(s.so_far()), F.lit(1e-12))) + 1e-6
    return F.when(s.position() <= 5, 0.0).otherwise(F.tanh((F.col(x) - mean) / spread - 1.5))


def _weighted(s: Series, x, weights) -> Column:
    """Newest weight first; rows before the start count as zero."""
    total = float(sum(weights))
    terms = [F.col(x) * (weights[0] / total)]
    terms += [s.lag(x, k, 0.0) * (w / total) for k, w in enumerate(weights) if k]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


def _max3(s: Series, x) -> Column:
    return F.greatest(F.col(x), s.lag(x, 1, 0.0), s.lag(x, 2, 0.0))


def _delta(d: int):
    return lambda s, x: F.coalesce(F.col(x) - s.lag(x, d), F.lit(0.0))


def _arg(d: int, pick):
    def build(s: Series, x) -> Column:
        return let(s.plist(x, d), lambda window: (F.array_position(window, pick(window)) - 1) / float(d - 1))

    return build


def _skew10(s: Series, x) -> Column:
    return s.pm3(x, 10) / F.pow(s.pstd(x, 10) + 1e-6, F.lit(3.0))


def _product5(s: Series, x) -> Column:
    logs = F.log1p(F.greatest(F.col(x), F.lit(-0.999)))
    return F.expm1(clamp(F.sum(logs).over(s.last(5)), -10.0, 10.0))


def _power2(s: Series, x) -> Column:
    return clamp(_signed(F.col(x), F.col(x) * F.col(x)), -1e9, 1e9)


def _cs_rank(s: Series, x) -> Column:
    members = F.count(F.lit(1)).over(s.cross())
    place = F.row_number().over(s.cross().orderBy(F.col(x), F.col(s.member))) - 1
    return F.when(members == 1, F.col(x)).otherwise(place / F.when(members > 1, members - 1))


def _cs_scale(s: Series, x) -> Column:
    low, high = F.min(x).over(s.cross()), F.max(x).over(s.cross())
    scaled = F.when(high - low < 1e-9, 0.5).otherwise(F.try_divide(F.col(x) - low, high - low))
    return F.when(F.count(F.lit(1)).over(s.cross()) == 1, F.col(x)).otherwise(scaled)


def _cs_neutralize(s: Series, x) -> Column:
    alone = F.count(F.lit(1)).over(s.cross()) == 1
    return F.when(alone, F.col(x)).otherwise(F.col(x) - F.avg(x).over(s.cross()))


def _zscore(d: int):
    def build(s: Series, x) -> Column:
        std = s.pstd(x, d)
        return F.when(std < 1e-9, 0.0).otherwise((F.col(x) - s.pmean(x, d)) / (std + 1e-9))

    return build


def _winsorize(s: Series, x) -> Column:
    """Clamp to the linear 5% / 95% quantiles of the padded 20-row window."""

    def clamped(window: Column) -> Column:
        def between(low_index: int, share: float) -> Column:
            low, high = F.element_at(window, low_index + 1), F.element_at(window, low_index + 2)
            return low + share * (high - low)

        low, high = between(0, 0.95), between(18, 0.05)
        return F.when(high - low < 1e-9, F.col(x)).otherwise(F.greatest(F.least(F.col(x), high), low))

    return let(F.array_sort(s.plist(x, 20)), clamped)


def _mean(d: int):
    return lambda s, x: s.pmean(x, d)


# Fixed order of the registered operators: it defines the token ids of integer formulas.
_ALL = [
    Op("ADD", 2, "map", lambda s, x, y: F.col(x) + F.col(y)),
    Op("SUB", 2, "map", lambda s, x, y: F.col(x) - F.col(y)),
    Op("MUL", 2, "map", lambda s, x, y: F.col(x) * F.col(y)),
    Op("DIV", 2, "map", _div),
    Op("NEG", 1, "map", lambda s, x: -F.col(x)),
    Op("ABS", 1, "map", lambda s, x: F.abs(F.col(x))),
    Op("SIGN", 1, "map", lambda s, x: F.signum(F.col(x))),
    Op("GATE", 3, "map", lambda s, c, x, y: F.when(F.col(c) > 0, F.col(x)).otherwise(F.col(y))),
    Op("JUMP", 1, "time", _jump),
    Op("DECAY", 1, "time", lambda s, x: _weighted(s, x, [1.0, 0.8, 0.6])),
    Op("DELAY1", 1, "time", lambda s, x: s.lag(x, 1, 0.0)),
    Op("MAX3", 1, "time", _max3),
    Op("TS_MEAN_5", 1, "time", _mean(5)),
    Op("TS_MEAN_10", 1, "time", _mean(10)),
    Op("TS_MEAN_20", 1, "time", _mean(20)),
    Op("TS_STD_5", 1, "time", lambda s, x: s.pstd(x, 5) + 1e-6),
    Op("TS_STD_10", 1, "time", lambda s, x: s.pstd(x, 10) + 1e-6),
    Op("TS_STD_20", 1, "time", lambda s, x: s.pstd(x, 20) + 1e-6),
    Op("TS_RANK_5", 1, "time", lambda s, x: s.prank(x, 5)),
    Op("TS_RANK_10", 1, "time", lambda s, x: s.prank(x, 10)),
    Op("TS_RANK_20", 1, "time", lambda s, x: s.prank(x, 20)),
    Op("TS_CORR_10", 2, "time", lambda s, x, y: s.pcorr(x, y, 10)),
    Op("MOMENTUM_5", 1, "time", lambda s, x: s.pmean(x, 5) - s.pmean(x, 20)),
    Op("MOMENTUM_10", 1, "time", lambda s, x: s.pmean(x, 10) - s.pmean(x, 20)),
    Op("TS_MAX_10", 1, "time", lambda s, x: s.pmax(x, 10)),
    Op("TS_MIN_10", 1, "time", lambda s, x: s.pmin(x, 10)),
    Op("WMA", 1, "time", lambda s, x: _weighted(s, x, [3.0, 2.0, 1.0])),
    Op("DELAY4", 1, "time", lambda s, x: s.lag(x, 4, 0.0)),
    Op("EMA_5", 1, "ema", None, 5),
    Op("EMA_20", 1, "ema", None, 20),
    Op("TS_QUANTILE_10", 1, "time", lambda s, x: s.prank(x, 10)),
    Op("TS_SKEW_10", 1, "time", _skew10),
    Op("TS_MIN_20", 1, "time", lambda s, x: s.pmin(x, 20)),
    Op("TS_MAX_20", 1, "time", lambda s, x: s.pmax(x, 20)),
    Op("DELTA", 1, "time", _delta(1)),
    Op("TS_ARG_MAX_5", 1, "time", _arg(5, F.array_max)),
    Op("TS_ARG_MIN_5", 1, "time", _arg(5, F.array_min)),
    Op("DECAY_LINEAR_5", 1, "time", lambda s, x: _weighted(s, x, [5.0, 4.0, 3.0, 2.0, 1.0])),
    Op("SCALE", 1, "time", lambda s, x: F.col(x) / (F.sum(F.abs(F.col(x))).over(s.so_far()) + 1e-6)),
    Op("COVARIANCE_10", 2, "time", lambda s, x, y: s.pcov(x, y, 10)),
    Op("PRODUCT_5", 1, "time", _product5),
    Op("DELTA_5", 1, "time", _delta(5)),
    Op("SIGNED_POWER_2", 1, "map", _power2),
    Op("TS_DECAY_EXP_5", 1, "time", lambda s, x: _weighted(s, x, [1.0, 2.0, 4.0, 8.0, 16.0])),
    Op("CS_RANK", 1, "cross", _cs_rank),
    Op("CS_SCALE", 1, "cross", _cs_scale),
    Op("CS_NEUTRALIZE", 1, "cross", _cs_neutralize),
    Op("TS_SUM_5", 1, "time", lambda s, x: s.psum(x, 5)),
    Op("TS_SUM_10", 1, "time", lambda s, x: s.psum(x, 10)),
    Op("TS_SUM_20", 1, "time", lambda s, x: s.psum(x, 20)),
    Op("MIN", 2, "map", lambda s, x, y: F.least(F.col(x), F.col(y))),
    Op("MAX", 2, "map", lambda s, x, y: F.greatest(F.col(x), F.col(y))),
    Op("POWER", 1, "map", _power2),
    Op("SIGNED_LOG", 1, "map", lambda s, x: _signed(F.col(x), F.log1p(F.abs(F.col(x))))),
    Op("SQRT", 1, "map", lambda s, x: _signed(F.col(x), F.sqrt(F.abs(F.col(x))))),
    Op("TS_ZSCORE_10", 1, "time", _zscore(10)),
    Op("TS_ZSCORE_20", 1, "time", _zscore(20)),
    Op("WINSORIZE", 1, "time", _winsorize),
    Op("CLIP", 1, "map", lambda s, x: clamp(F.col(x), -3.0, 3.0)),
    Op("SIGMOID", 1, "map", lambda s, x: F.tanh(F.col(x) / 2.0)),
    Op("TANH_SQUASH", 1, "map", lambda s, x: F.tanh(F.col(x))),
    Op("IF_GT", 3, "map", lambda s, x, y, z: F.when(F.col(x) > 0, F.col(y)).otherwise(F.col(z))),
]
OPS: dict[str, Op] = {op.name: op for op in _ALL}


# Plain comparison helpers; deliberately not registered as formula operators.
def gt(x: Column, y: Column) -> Column:
    return (x > y).cast("double")


def lt(x: Column, y: Column) -> Column:
    return (x < y).cast("double")


def both(x: Column, y: Column) -> Column:
    return ((x > 0) & (y > 0)).cast("double")


def either(x: Column, y: Column) -> Column:
    return ((x > 0) | (y > 0)).cast("double")
