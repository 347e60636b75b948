"""Window specs and zero-padded window statistics of an ordered series.

A padded window of width ``d`` always has ``d`` entries: the ``n`` real ones plus ``d - n``
zeros in front.  The statistics below are computed from the plain Spark aggregates of the
real rows and corrected for the zeros in closed form, so nothing is collected into arrays
unless the statistic is an order statistic.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """``keys`` identify one series, ``order`` sorts it, ``at`` is the cross-section key.

    A ``blocked`` series is one block of a longer one with copied rows in front: cross-sections would
    count the copies, and windows from the start of the series would restart, so both are refused.
    """

    keys: Sequence[str] = ("code",)
    order: str = "ts"
    at: Sequence[str] = ("ts",)
    member: str = "code"
    blocked: bool = False

    def _whole(self, what: str) -> None:
        if self.blocked:
            raise ValueError(f"{what} needs the whole series: trim the blocks first, or carry running sums")

    def ordered(self):
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def last(self, d: int):
        return self.ordered().rowsBetween(-(d - 1), 0)

    def between(self, start: int, end: int):
        return self.ordered().rowsBetween(start, end)

    def so_far(self):
        self._whole("a window from the start")
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)

    def cross(self):
        self._whole("a cross-section")
        return Window.partitionBy(*self.at)

    # -- plain access ---------------------------------------------------------------
    def lag(self, x, k: int, default=None) -> Column:
        return F.lag(x, k, default).over(self.ordered())

    def lead(self, x, k: int) -> Column:
        return F.lead(x, k).over(self.ordered())

    def position(self) -> Column:
        return F.row_number().over(self.ordered())

    # -- zero-padded statistics -----------------------------------------------------
    def real(self, d: int) -> Column:
        return F.count(F.lit(1)).over(self.last(d)).cast("double")

    def psum(self, x, d: int) -> Column:
        return F.sum(x).over(self.last(d))

    def pmean(self, x, d: int) -> Column:
        return self.psum(x, d) / F.lit(float(d))

    def pvar(self, x, d: int) -> Column:
        n, mean = self.real(d), F.avg(x).over(self.last(d))
        return (n / d) * F.var_pop(x).over(self.last(d)) + n * (d - n) / float(d * d) * mean * mean

    def pstd(self, x, d: int) -> Column:
        return F.sqrt(F.greatest(self.pvar(x, d), F.lit(0.0)))

    def pcov(self, x, y, d: int) -> Column:
        n = self.real(d)
        product = F.avg(x).over(self.last(d)) * F.avg(y).over(self.last(d))
        return (n / d) * F.covar_pop(x, y).over(self.last(d)) + n * (d - n) / float(d * d) * product

    def pcorr(self, x, y, d: int) -> Column:
        """Padded Pearson correlation; a window with a (nearly) constant side gives 0."""
        sx, sy = self.pstd(x, d), self.pstd(y, d)
        flat = (sx < 1e-6) | (sy < 1e-6)
        return F.when(flat, 0.0).otherwise(self.pcov(x, y, d) / (sx * sy + 1e-8))

    def pm3(self, x, d: int) -> Column:
        """Third central moment of the padded window."""
        n, frame = self.real(d), self.last(d)
        k, mean, var = d - n, F.avg(x).over(frame), F.var_pop(x).over(frame)
        m3 = F.coalesce(F.nanvl(F.skewness(x).over(frame), F.lit(0.0)), F.lit(0.0)) * var * F.sqrt(var)
        shift = k * mean / d
        pad_mean = n * mean / d
        real_part = (n / d) * (m3 + 3 * var * shift + F.pow(shift, F.lit(3.0)))
        return real_part - (k / d) * F.pow(pad_mean, F.lit(3.0))

    def pm4(self, x, d: int) -> Column:
        """Fourth central moment of the padded window."""
        n, frame = self.real(d), self.last(d)
        k, mean, var = d - n, F.avg(x).over(frame), F.var_pop(x).over(frame)
        m3 = F.coalesce(F.nanvl(F.skewness(x).over(frame), F.lit(0.0)), F.lit(0.0)) * var * F.sqrt(var)
        m4 = (F.coalesce(F.nanvl(F.kurtosis(x).over(frame), F.lit(-3.0)), F.lit(-3.0)) + 3.0) * var * var
        shift = k * mean / d
        pad_mean = n * mean / d
        real_part = m4 + 4 * m3 * shift + 6 * var * shift * shift + F.pow(shift, F.lit(4.0))
        return (n / d) * real_part + (k / d) * F.pow(pad_mean, F.lit(4.0))

    def pmax(self, x, d: int) -> Column:
        top = F.max(x).over(self.last(d))
        return F.when(self.real(d) < d, F.greatest(top, F.lit(0.0))).otherwise(top)

    def pmin(self, x, d: int) -> Column:
        low = F.min(x).over(self.last(d))
        return F.when(self.real(d) < d, F.least(low, F.lit(0.0))).otherwise(low)

    def plist(self, x, d: int) -> Column:
        """The padded window itself, oldest first (``d`` is a small constant)."""
        real = F.collect_list(x).over(self.last(d))
        return F.concat(F.array_repeat(F.lit(0.0), F.lit(d) - F.size(real)), real)

    def prank(self, x: str, d: int) -> Column:
        """Share of the padded window strictly below the current value."""

        def share(values: Column) -> Column:
            below = F.size(F.filter(values, lambda v: v < F.col(x)))
            pads = F.when(F.col(x) > 0, F.lit(d) - F.size(values)).otherwise(F.lit(0))
            return (below + pads) / float(d)

        return let(F.collect_list(x).over(self.last(d)), share)

    def pslope(self, x: str, position: str, d: int) -> Column:
        """Least-squares slope of the padded window per step (``position`` is the row number)."""
        weighted = F.sum(F.col(x) * F.col(position)).over(self.last(d))
        centre = (d - 1) / 2.0 - F.col(position)
        return (weighted + centre * self.psum(x, d)) / (d * (d * d - 1) / 12.0 + 1e-9)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often the expression mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean(x: Column, nan: float = 0.0, high: float = 0.0, low: float = 0.0) -> Column:
    """Replace NULL/NaN and the infinities by fixed numbers."""
    inf = F.lit(float("inf"))
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(nan))
        .when(x == inf, F.lit(high))
        .when(x == -inf, F.lit(low))
        .otherwise(x)
    )


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))
