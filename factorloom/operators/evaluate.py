"""Factor evaluation statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.ranks import quantile_table, value_table, with_average_rank
from factorloom.plans.formula import average_rank

FLAT = 1e-8


def guarded_corr(x: str, y: str, need: int = 2, flat: float = FLAT) -> Column:
    """Aggregate Pearson correlation; NULL for too few pairs or a constant side."""
    good = (F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= need) & (
        F.stddev_pop(x) >= flat
    ) & (F.stddev_pop(y) >= flat)
    return F.when(good, F.corr(x, y))


# -- information coefficients ----------------------------------------------------------
def series_ic(df: DataFrame, by: Sequence[str], x: str, y: str, bounded: bool = True) -> DataFrame:
    """V1 per series: ic and rank_ic over time.

    ``bounded`` says that a group is a bar series on a calendar grid, small enough to sort in one
    task.  Groups without such a bound (segments, whole candidates, ticks) are ranked through
    value counts, so that no group has to fit anywhere.
    """
    pairs = df.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if bounded:
        window = Window.partitionBy(*by)
        ranked = pairs.withColumns({"_rx": average_rank(F.col(x), window), "_ry": average_rank(F.col(y), window)})
    else:
        ranked = with_average_rank(with_average_rank(pairs, by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), guarded_corr(x, y).alias("ic"), guarded_corr("_rx", "_ry").alias("rank_ic")
    )


def mean_ic(per_series: DataFrame, by: Sequence[str]) -> DataFrame:
    """V1/V2: mean IC and RankIC over the codes, IR and stability."""
    m, d = F.avg("ic"), F.stddev_pop("ic")
    return per_series.groupBy(*by).agg(
        m.alias("ic"),
        F.avg("rank_ic").alias("rank_ic"),
        F.when(d > 1e-10, m / (d + 1e-10)).otherwise(0.0).alias("ir"),
        F.greatest(F.least(m / (d + 1e-6), F.lit(3.0)), F.lit(-3.0)).alias("stability"),
    )


def cross_section_ic(df: DataFrame, x: str, y: str, by: Sequence[str] = ("date",), need: int = 10) -> DataFrame:
    """V3/V4 per date: rank_ic and ic over the codes (bounded groups)."""
    window = Window.partitionBy(*by)
    pairs = df.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pairs.withColumns({"_rx": average_rank(F.col(x), window), "_ry": average_rank(F.col(y), window)})
    out = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), guarded_corr(x, y, flat=1e-12).alias("ic"), guarded_corr("_rx", "_ry").alias("rank_ic")
    )
    return out.where((F.col("n") >= need) & F.col("rank_ic").isNotNull())


def ic_summary(daily: DataFrame, by: Sequence[str] = (), value: str = "rank_ic") -> DataFrame:
    """V3: dates, mean, ICIR (sample deviation) and share of positive dates."""
    std = F.stddev_samp(value)
    return daily.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dates"),
        F.avg(value).alias("rank_ic"),
        F.when(std > 1e-12, F.avg(value) / std).alias("rank_icir"),
        F.avg((F.col(value) > 0).cast("double")).alias("positive_rate"),
    )


def period_block(position: Column, total: Column) -> Column:
    """V4 with a single code: blocks of 20 to 252 rows; rows of an incomplete last block are NULL."""
    width = F.greatest(F.lit(20), F.least(F.lit(252), F.floor(total / 8)))
    block = F.floor((position - 1) / width)
    return F.when((block + 1) * width <= total, block)


# -- mutual information ----------------------------------------------------------------
def mutual_information(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """V5: equal-frequency bins on both sides, natural logarithm."""
    pairs = df.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def bins(total: Column) -> Column:
        return F.greatest(F.lit(5), F.least(F.lit(20), F.floor(F.sqrt(total))))

    def edges(value: str, name: str) -> DataFrame:
        table = value_table(pairs, by, value)
        q = quantile_table(table, by, value, lambda k: F.least(k / bins(F.col("total")), F.lit(1.0)), 21)
        unique = F.array_distinct("q")
        return q.select(*by, F.slice(unique, 2, F.greatest(F.size(unique) - 2, F.lit(0))).alias(name))

    placed = pairs.join(edges(x, "_ex"), list(by)).join(edges(y, "_ey"), list(by))
    bx = F.size(F.filter("_ex", lambda e: e <= F.col(x))).alias("_bx")
    by_ = F.size(F.filter("_ey", lambda e: e <= F.col(y))).alias("_by")
    joint = placed.groupBy(*by, bx, by_).agg(F.count(F.lit(1)).alias("_n"))
    # at most 20 x 20 cells per candidate from here on
    cells = joint.withColumns(
        {
            "_p": F.col("_n") / F.sum("_n").over(Window.partitionBy(*by)),
            "_px": F.sum("_n").over(Window.partitionBy(*by, "_bx")) / F.sum("_n").over(Window.partitionBy(*by)),
            "_py": F.sum("_n").over(Window.partitionBy(*by, "_by")) / F.sum("_n").over(Window.partitionBy(*by)),
        }
    )
    total = F.sum(F.col("_p") * F.log(F.col("_p") / (F.col("_px") * F.col("_py"))))
    return cells.groupBy(*by).agg(F.greatest(total, F.lit(0.0)).alias("mi"))


# -- candidates ------------------------------------------------------------------------
def degeneracy(x: str) -> Column:
    """V6 as an aggregate."""
    return (F.count(x) < 2) | F.coalesce(F.stddev_pop(x) < FLAT, F.lit(True))


def correlation_matrix(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """V7: absolute correlations of all pairs of columns in one pass, in long format (a < b)."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]

    def cell(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        flat = (F.count(x) < 2) | (F.stddev_pop(x) < FLAT) | (F.stddev_pop(y) < FLAT)
        return F.when(flat, 0.0).otherwise(F.abs(F.corr(x, y)))

    row = wide.agg(*[cell(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    structs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*structs)))


def rank_normalised(value: str, scorable: Column) -> Column:
    """V8: ordinal rank of the scorable candidates mapped to [0, 1]; one candidate gives 1.

    Candidates are a short list (one row each), so a window over the whole table is fine.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(F.when(scorable, F.col(value)).asc_nulls_last(), F.col("candidate"))
    n = F.sum(F.when(scorable, 1).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(w) - 1
    return F.when(scorable, F.when(n == 1, 1.0).otherwise(place / F.when(n > 1, n - 1))).otherwise(0.0)


def importance(scores: DataFrame) -> DataFrame:
    """V8: 0.6 x rank of |RankIC| + 0.4 x rank of MI; unscorable candidates get -inf."""
    # equal up to rounding noise counts as equal, so that mirrored candidates keep a stable order
    df = scores.withColumns({"_a": F.round(F.abs("rank_ic"), 9), "_m": F.round("mi", 9)})
    ok = ~F.col("unscorable")
    df = df.withColumns({"_ra": rank_normalised("_a", ok), "_rm": rank_normalised("_m", ok)})
    score = F.when(ok, 0.6 * F.col("_ra") + 0.4 * F.col("_rm")).otherwise(float("-inf"))
    return df.withColumn("importance", score).drop("_a", "_m", "_ra", "_rm")


def score_candidates(rows: DataFrame, code: str = "code", x: str = "factor", y: str = "ret") -> DataFrame:
    """V8: candidate, ic, rank_ic, ir, mi, unscorable, importance, place of every candidate in ``rows``.

    A candidate whose values are missing or flat (V6) is unscorable: it stays in the report with zeros, importance -inf and
    a place behind all others, and does not count in the ranks of the scorable ones.
    """
    state = rows.groupBy("candidate").agg(degeneracy(x).alias("unscorable"))
    good = rows.join(state.where(~F.col("unscorable")).select("candidate"), "candidate", "left_semi")
    ic = mean_ic(series_ic(good, ["candidate", code], x, y), ["candidate"]).select("candidate", "ic", "rank_ic", "ir")
    scores = state.join(ic, "candidate", "left").join(mutual_information(good, ["candidate"], x, y), "candidate", "left")
    ranked = importance(scores.na.fill(0.0, ["ic", "rank_ic", "ir", "mi"]))
    # one row per candidate
    order = Window.orderBy(F.desc("importance"), "candidate")
    return ranked.withColumn("place", F.row_number().over(order))


def correlation_prune(
    scores: Sequence[tuple[str, float]], correlations: dict[tuple[str, str], float], threshold: float = 0.9,
    margin: float = 0.01,
) -> dict[str, str | None]:
    """V9: greedy by score; a candidate is dropped in favour of the first retained one that is
    highly correlated and clearly better.  Works on the short list of candidates, not on data."""
    retained: list[tuple[str, float]] = []
    out: dict[str, str | None] = {}
    for name, value in sorted(scores, key=lambda s: (-s[1], s[0])):
        beaten = None
        for other, better in retained:
            corr = correlations.get((min(name, other), max(name, other)), 0.0)
            if corr >= threshold and better - value > margin:
                beaten = other
                break
        out[name] = beaten
        if beaten is None:
            retained.append((name, value))
    return out


def ablation(ics: DataFrame, candidates: Column) -> DataFrame:
    """V10 from a (window, candidate, abs_ic) table: mean of with - without over the windows.

    Leaving one candidate out of a mean is arithmetic on sums, so no subset is re-evaluated.
    """
    w = Window.partitionBy("window")
    total, n = F.sum("abs_ic").over(w), F.count("abs_ic").over(w)
    rest = F.when(n > 1, (total - F.col("abs_ic")) / (n - 1)).otherwise(0.0)
    df = ics.where(F.col("abs_ic").isNotNull()).withColumn("_m", total / n - rest)
    out = df.groupBy("candidate").agg(F.avg("_m").alias("marginal"))
    return out.withColumn("drop", F.col("marginal") <= -0.01)


def group_returns(df: DataFrame, by: Sequence[str], x: str, y: str, groups: int = 5) -> DataFrame:
    """Mean target of equal groups by average rank, with the monotonicity of the group means."""
    pairs = df.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    table = value_table(pairs, by, x)
    place = F.col("start") + (F.col("n") - 1) / 2.0
    bucket = F.least(F.lit(groups - 1), F.floor(place * groups / F.col("total")))
    binned = pairs.join(table.select(*by, x, bucket.alias("bucket")), [*by, x])
    means = binned.groupBy(*by, "bucket").agg(F.avg(y).alias("mean_target"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    order = w.orderBy("mean_target").rowsBetween(Window.unboundedPreceding, 0)
    ranked = means.withColumn("_r", F.count(F.lit(1)).over(order))
    # a correlation of five ranks takes few values: rounding keeps exact thresholds exact
    return ranked.withColumn("monotonicity", F.round(F.abs(F.corr("_r", "bucket").over(w)), 12)).drop("_r")


# -- bootstrap -------------------------------------------------------------------------
def _minstd(x: Column) -> Column:
    """One step of the minimal standard generator on BIGINT."""
    return (x * F.lit(48271)) % F.lit(2147483647)


def block_draws(spark, samples: int, blocks: Column, seed: int) -> DataFrame:
    """(draw, block, h): a reproducible pseudo-random number per draw and block."""
    draws = spark.range(samples).select(F.col("id").alias("draw"))
    table = draws.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    h = (F.col("draw") * 1000003 + F.col("block").cast("bigint") * 10007 + seed) % 2147483647
    return table.withColumn("h", _minstd(_minstd(_minstd(h + 1))))


def moving_block_bootstrap(series: DataFrame, values: Sequence[str], block: int, samples: int, seed: int) -> DataFrame:
    """One row per (draw, position) with the resampled values.

    ``series`` is numbered by ``position`` from 0 (a daily series, bounded by the calendar).  All
    ``values`` are taken from the same blocks, which makes paired comparisons possible.
    """
    spark = series.sparkSession
    n = series.agg(F.count(F.lit(1)).alias("n")).scalar()
    width = F.least(F.lit(block), n)
    draws = block_draws(spark, samples, F.ceil(n / width).cast("int"), seed)
    picked = draws.withColumn("start", F.col("h") % (n - width + 1))
    picked = picked.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("bigint"), width.cast("bigint") - 1)))
    picked = picked.where(F.col("block") * width + F.col("offset") < n)
    picked = picked.select("draw", (F.col("start") + F.col("offset")).alias("position"))
    return picked.join(series.select("position", *values), "position")


def bootstrap_summary(draws: DataFrame, by: Sequence[str] = (), value: str = "stat", alpha: float = 0.05) -> DataFrame:
    """Percentile interval and one-sided p-value over the draws (their number is a parameter)."""
    ends = F.percentile(value, [alpha / 2, 1 - alpha / 2])
    n = F.count(F.lit(1))
    return draws.groupBy(*by).agg(
        ends[0].alias("ci_low"),
        ends[1].alias("ci_high"),
        ((1 + F.sum((F.col(value) <= 0).cast("int"))) / (1 + n)).alias("p_value"),
        n.alias("samples"),
    )


def holm(p_values: DataFrame, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """V14 over a (name, p_value) table of one or more families."""
    family = Window.partitionBy(*(by or [F.lit(1)]))
    order = family.orderBy("p_value", "name")
    raw = F.least(F.lit(1.0), F.col("p_value") * (F.count(F.lit(1)).over(family) - F.row_number().over(order) + 1))
    df = p_values.withColumn("_raw", raw)
    adjusted = F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("p_holm", adjusted).withColumn("reject", F.col("p_holm") < alpha).drop("_raw")


# -- robustness ------------------------------------------------------------------------
def leave_one_group_out(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean of ``value`` without each group, from group totals.  Each row is read once."""
    per = df.groupBy(group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    everything = Window.partitionBy(F.lit(1))
    s, n = F.sum("_s").over(everything), F.sum("_n").over(everything)
    out = per.select(
        F.col(group).cast("string").alias("dropped"), (s / n).alias("overall"), ((s - F.col("_s")) / (n - F.col("_n"))).alias("without")
    )
    return out.withColumn("sign_flip", F.signum("overall") != F.signum("without"))


def _without(x: np.ndarray, y: np.ndarray, dropped: np.ndarray, case: np.ndarray, cases: int) -> list[tuple[int, float | None]]:
    """(rows, RankIC) of each case: rows ``dropped[case == k]`` left out, the others ranked again with averaged ties.

    Ranks follow from the counts per distinct value less those left out, so a case costs no sort.
    """
    inv_x, inv_y = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    count_x, count_y = np.bincount(inv_x), np.bincount(inv_y)
    order = np.argsort(case, kind="stable")
    ends = np.searchsorted(case[order], np.arange(cases + 1))
    out = []
    for k in range(cases):
        gone = dropped[order[ends[k] : ends[k + 1]]]
        m = len(x) - len(gone)
        cx = count_x - np.bincount(inv_x[gone], minlength=len(count_x))
        cy = count_y - np.bincount(inv_y[gone], minlength=len(count_y))
        # average ranks less their mean (m + 1) / 2: small sums keep their digits
        rx, ry = (np.cumsum(c) - (c - 1) / 2.0 - (m + 1) / 2.0 for c in (cx, cy))
        vx, vy = float(cx @ (rx * rx)), float(cy @ (ry * ry))
        cov = float(rx[inv_x] @ ry[inv_y] - rx[inv_x[gone]] @ ry[inv_y[gone]])
        out.append((m, cov / math.sqrt(vx * vy) if vx > 1e-9 and vy > 1e-9 else None))
    return out


def deletion_rank_ic(df: DataFrame, scenarios: DataFrame, x: str, y: str, need: int = 10) -> DataFrame:
    """Mean daily RankIC per scenario after removing the scenario's codes and re-ranking.

    ``scenarios`` lists (scenario, code) to remove; a NULL code removes nothing.  A row carries the numbers of the
    scenarios that remove it, so rows are not copied per scenario; a task sees one date (at most one row per code) and
    re-ranks it for all scenarios.
    """
    labels = scenarios.agg(F.array_sort(F.collect_set("scenario")).alias("_all")).scalar()  # a short list
    valid = df.select("date", "code", x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out_of = scenarios.where(F.col("code").isNotNull()).select("code", (F.array_position(labels, F.col("scenario")) - 1).cast("int").alias("_case"))
    marked = valid.join(out_of.groupBy("code").agg(F.collect_set("_case").alias("_out")), "code", "left")
    rows = marked.select("date", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), "_out", F.size(labels).alias("_cases"))

    def per_date(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy() for c in ("_x", "_y"))
        out = table.column("_out").combine_chunks()
        dropped, case = (np.asarray(v.to_numpy(zero_copy_only=False), np.int64) for v in (pc.list_parent_indices(out), pc.list_flatten(out)))
        found = _without(x, y, dropped, case, table.column("_cases")[0].as_py())
        kept = [(k, n, ic) for k, (n, ic) in enumerate(found) if n >= need and ic is not None]
        kinds = {"_case": pa.int32(), "n": pa.int64(), "rank_ic": pa.float64()}
        return pa.table({name: pa.array([r[i] for r in kept], kind) for i, (name, kind) in enumerate(kinds.items())})

    daily = rows.groupBy("date").applyInArrow(per_date, "_case int, n bigint, rank_ic double")
    per = daily.groupBy("_case").agg(F.avg("rank_ic").alias("rank_ic"), F.count(F.lit(1)).alias("dates"), F.sum("n").alias("rows"))
    return per.select(F.element_at(labels, F.col("_case") + 1).alias("scenario"), "rank_ic", "dates", "rows")


def _above(qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """How many points (px, py) lie above each query on both axes; queries and points never tie on an axis.

    All are put in the order of x; y is then split bit by bit, and at every bit a query meets the points of its
    half-plane block by one running count: O(n log n), no loop over rows.
    """
    n = len(qx)
    x, point = np.concatenate([qx, px]), np.concatenate([np.zeros(n, np.int64), np.ones(len(px), np.int64)])
    y = np.unique(np.concatenate([qy, py]), return_inverse=True)[1]
    order = np.argsort(x, kind="stable")
    y, point, row = y[order], point[order], order
    total = np.zeros(len(x), np.int64)
    for bit in range(int(y.max()).bit_length() - 1, -1, -1):
        # stable by the higher bits, so that x stays in order within a block of equal higher bits
        block = y >> (bit + 1)
        by = np.argsort(block, kind="stable")
        block, upper, here = block[by], (y[by] >> bit) & 1, point[by]
        reach = np.concatenate([np.cumsum((here * upper)[::-1])[::-1], [0]])
        ends = np.flatnonzero(np.concatenate([block[1:] != block[:-1], [True]])) + 1
        end = ends[np.cumsum(np.concatenate([[0], block[1:] != block[:-1]]))]
        total[by] += np.where(upper == 0, reach[:-1] - reach[end], 0)
        y, point, row, total = y[by], point[by], row[by], total[by]
    out = np.empty(len(x), np.int64)
    out[row] = total
    return out[:n]


def _drop_each(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """RankIC of all rows but one, for every row, with exact average ranks, in O(n log n).

    Without row i the rank of row j falls by s_ij = [x_i < x_j] + [x_i = x_j] / 2.  The sums over the remaining rows follow
    from running sums over both orders and from counts of rows above i on both axes.
    """
    n = len(x)

    def side(v):
        order = np.argsort(v, kind="stable")
        s = v[order]
        left, right = np.searchsorted(s, v, "left"), np.searchsorted(s, v, "right")
        return order, left, right, (left + right + 1) / 2.0

    (ox, lx, hx, rx), (oy, ly, hy, ry) = side(x), side(y)
    rx, ry = rx - (n + 1) / 2, ry - (n + 1) / 2  # centred: small sums keep their digits

    def falls(order, left, right, value):
        """Sum over j of s_ij * value_j, row i itself included with one half."""
        run = np.concatenate([[0.0], np.cumsum(value[order])])
        return ((run[n] - run[right]) + (run[n] - run[left])) / 2

    ones = np.ones(n)
    sx, sy = falls(ox, lx, hx, ones) - 0.5, falls(oy, ly, hy, ones) - 0.5
    xx = (n - hx) + (hx - lx - 1) / 4.0  # sum of squared falls of the other rows
    yy = (n - hy) + (hy - ly - 1) / 4.0
    # s_ij * t_ij = quarter of the counts over strict and weak comparisons on both axes; row i itself adds one quarter
    kx, ky = 2 * lx, 2 * ly
    both = sum(_above(kx + a, ky + b, kx, ky) for a in (1, -1) for b in (1, -1)) / 4.0 - 0.25
    m = n - 1
    own_x, own_y = rx, ry
    a_sum, b_sum = rx.sum() - own_x - sx, ry.sum() - own_y - sy
    ab = (rx * ry).sum() - own_x * own_y - (falls(oy, ly, hy, rx) - own_x / 2) - (falls(ox, lx, hx, ry) - own_y / 2) + both
    aa = (rx * rx).sum() - own_x**2 - 2 * (falls(ox, lx, hx, rx) - own_x / 2) + xx
    bb = (ry * ry).sum() - own_y**2 - 2 * (falls(oy, ly, hy, ry) - own_y / 2) + yy
    cov, va, vb = ab - a_sum * b_sum / m, aa - a_sum * a_sum / m, bb - b_sum * b_sum / m
    good = (va > 1e-9) & (vb > 1e-9)
    return np.where(good, cov / np.sqrt(np.where(good, va * vb, 1.0)), np.nan)


def leave_one_code_out(df: DataFrame, x: str, y: str, need: int = 10) -> DataFrame:
    """Influence of every code on the mean daily RankIC.

    A task sees one date (at most one row per code).  Per date it returns one row per code, so
    the output has the size of the input; dates without a code keep their baseline value.
    """
    valid = df.select("date", "code", x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    schema = "date date, code bigint, without double, baseline double"

    def per_date(table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy().astype("float64") for c in (x, y))
        n = len(a)
        without = _drop_each(a, b) if n > need else np.full(n, np.nan)
        base = float("nan")
        if n >= need:
            ra, rb = (np.searchsorted(np.sort(v), v, "left") + np.searchsorted(np.sort(v), v, "right") for v in (a, b))
            if ra.std() > 0 and rb.std() > 0:
                base = float(np.corrcoef(ra, rb)[0, 1])

        def nullable(values):
            return pa.array(values, pa.float64(), from_pandas=True)

        return pa.table(
            {
                "date": table.column("date"),
                "code": table.column("code").cast(pa.int64()),
                "without": nullable(without),
                "baseline": nullable(np.full(n, base)),
            }
        )

    rows = valid.groupBy("date").applyInArrow(per_date, schema)
    per_code = rows.groupBy("code").agg(
        F.sum("without").alias("_w"), F.count("without").alias("_wn"), F.sum("baseline").alias("_b"), F.count("baseline").alias("_bn")
    )
    dates = rows.groupBy("date").agg(F.max("baseline").alias("b"))
    total = dates.agg(F.sum("b").alias("s"), F.count("b").alias("n"))
    s, n = total.select("s").scalar(), total.select("n").scalar()
    loo = (s - F.coalesce("_b", F.lit(0.0)) + F.coalesce("_w", F.lit(0.0))) / (n - F.col("_bn") + F.col("_wn"))
    out = per_code.select("code", (s / n).alias("rank_ic"), loo.alias("without"))
    return out.withColumn("change", F.col("without") - F.col("rank_ic"))


# -- tables of bins --------------------------------------------------------------------
def binned(df: DataFrame, by: Sequence[str], columns: Sequence[str], learn: Column, bins: int) -> DataFrame:
    """Add the bin ``b_<column>`` (from 0) of every column: equal-frequency bins of the rows that ``learn`` marks.

    The k-th edge lies halfway between the neighbours at place ``k * rows / bins``, as Spark's trees place their
    splits, but over all rows instead of a sample.  A value on an edge belongs to the lower bin.
    """

    def share(k: Column) -> Column:
        return (F.floor((k + 1) * F.col("total") / bins + 0.5) - 0.5) / F.greatest(F.col("total") - 1, F.lit(1))

    out = df
    for column in columns:
        values = value_table(df.where(learn), by, column)
        edges = quantile_table(values, by, column, lambda k: F.greatest(F.lit(0.0), F.least(share(k), F.lit(1.0))), bins - 1)
        out = out.join(edges.select(*by, F.col("q").alias("_edges")), list(by))
        out = out.withColumn(f"b_{column}", F.size(F.filter("_edges", lambda e: e < F.col(column)))).drop("_edges")
    return out


def cells(df: DataFrame, by: Sequence[str], columns: Sequence[str], y: str) -> DataFrame:
    """(by, bins, n, mean): rows and mean of ``y`` per cell of bins.

    Trees that split on bins by the variance of ``y`` gain the same from these weighted means as from the rows: the
    variance inside a cell is the same before and after every split.
    """
    return df.groupBy(*by, *[f"b_{c}" for c in columns]).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(y).alias("mean"))


def merged_cells(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of fewer bins: counts add up, means are weighted."""
    return table.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))


# -- gates -----------------------------------------------------------------------------
def failed_checks(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, as an array (NULL counts as failed)."""
    every = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return F.filter(every, lambda x: x.isNotNull())


# Fixed values of the retention gate.
RETENTION = {
    "min_coverage": 0.95, "min_abs_rank_ic": 0.005, "min_abs_icir": 0.05, "min_abs_rank_icir": 0.05,
    "min_direction_ratio": 0.60, "min_segment_direction_ratio": 0.60, "min_group_monotonicity": 0.50,
    "max_correlation": 0.80, "high_corr_min_increment": 0.003, "min_increment": 0.0, "min_positive_fold_ratio": 0.75,
    "min_net_sharpe": -0.25,
}
# Scales of the ranking score.
RANKING_SCALES = {"rank_icir": 1.0, "icir": 1.0, "increment": 0.03, "net_sharpe": 2.0, "direction_ratio": 1.0}


def retention_checks(cfg=RETENTION) -> dict[str, Column]:
    """V17 over the metric columns of one candidate per row: the 15 rules of the gate."""
    correlated = F.col("max_correlation") >= cfg["max_correlation"]
    return {
        "INVALID_FORMULA": F.col("valid"),
        "COVERAGE": F.col("coverage") >= cfg["min_coverage"],
        "RANK_IC": F.abs("rank_ic") >= cfg["min_abs_rank_ic"],
        "ICIR": F.abs("icir") >= cfg["min_abs_icir"],
        "RANK_ICIR": F.abs("rank_icir") >= cfg["min_abs_rank_icir"],
        "BOOTSTRAP_CROSSES_ZERO": ~((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)),
        "DIRECTION": F.col("direction_ratio") >= cfg["min_direction_ratio"],
        "FOLD_DIRECTION": F.col("fold_direction_ratio") >= cfg["min_positive_fold_ratio"],
        "NO_INCREMENT": F.col("increment") > cfg["min_increment"],
        "INCREMENT_FOLDS": F.col("increment_fold_ratio") >= cfg["min_positive_fold_ratio"],
        "CORRELATED": ~(correlated & (F.col("increment") < cfg["high_corr_min_increment"])),
        "NET_SHARPE": F.col("net_sharpe") >= cfg["min_net_sharpe"],
        "MONOTONICITY": F.col("monotonicity") >= cfg["min_group_monotonicity"],
        "SEGMENTS": F.col("segment_direction_ratio") >= cfg["min_segment_direction_ratio"],
        "PORTFOLIO_WORSE": F.col("portfolio_delta") >= -1e-12,
    }


#: Fixed values of the ranking score: what counts for a candidate (weights, sign ignored or not) and against it.
RANKING_GAINS = (
    ("rank_icir", 0.25, "magnitude"), ("icir", 0.20, "magnitude"), ("increment", 0.25, "signed"), ("net_sharpe", 0.20, "signed"),
    ("direction_ratio", 0.10, "signed"),
)
RANKING_COSTS = (("max_correlation", 0.10, None, None), ("turnover", 0.05, 1.0, 1.0), ("operators", 0.03, 16.0, 1.0))


def ranking_score(scales: dict[str, float] = RANKING_SCALES) -> Column:
    """Weighted measures in units of their scale, each within 0 and 1, less the weighted costs up to their limit."""
    score = F.lit(0.0)
    for measure, weight, kind in RANKING_GAINS:
        size = F.col(measure) if kind == "signed" else F.abs(measure)
        score = score + weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), size / scales.get(measure, 1.0)))
    for measure, weight, unit, limit in RANKING_COSTS:
        cost = F.col(measure) if unit is None else F.least(F.lit(limit), F.col(measure) / unit)
        score = score - weight * cost
    return score


def ranked_candidates(df: DataFrame, accepted: Column) -> DataFrame:
    """Ranking score and place of the accepted candidates (a short list); NULL for the others."""
    scored = df.withColumn("_in", accepted).withColumn("ranking", F.when(F.col("_in"), ranking_score()))
    order = Window.partitionBy("_in").orderBy(F.desc("ranking"), "strategy")
    return scored.withColumn("place", F.when(F.col("_in"), F.row_number().over(order))).drop("_in")


def correlation_penalty(score: Column, max_corr: Column, threshold: float = 0.85, factor: float = 0.8) -> Column:
    """V20"""
    return F.when(max_corr > threshold, score * factor).otherwise(score)


def ic_gate(score: Column, ic: Column) -> Column:
    """V21"""
    return F.when(ic > 0.01, score * 1.15).when(ic < -0.01, score * 0.75).otherwise(score)


def clean_candidates(long: DataFrame, name: str, keys: Sequence[str], value: str) -> DataFrame:
    """State of each candidate on the training rows: unusable, duplicate of the smallest
    identical name, or retained.  Identity is an order-free hash over (key, value)."""
    h = F.xxhash64(*keys, F.coalesce(F.col(value), F.lit(float("nan"))))
    stats = long.groupBy(name).agg(
        F.count(value).alias("finite"),
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
        F.bit_xor(h).alias("_x"),
        F.sum(F.shiftright(h, 20)).alias("_s"),
    )
    usable = (F.col("finite") >= 2) & (F.col("_lo") < F.col("_hi"))
    stats = stats.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    twin = F.min(F.when(F.col("_ok"), F.col(name))).over(Window.partitionBy("finite", "_lo", "_hi", "_x", "_s"))
    return stats.select(
        F.col(name),
        F.when(~F.col("_ok"), "unusable").when(twin != F.col(name), "duplicate").otherwise("retained").alias("state"),
        F.when(F.col("_ok") & (twin != F.col(name)), twin).alias("duplicate_of"),
    )


def subset_scores(fold_metrics: DataFrame, min_delta: float = 0.001, min_positive: float = 0.6) -> DataFrame:
    """All candidate groups of one sweep from a (grp, size, fold, score, baseline) table.

    The best eligible group is the one with the highest score, then the fewest factors, then the
    first name."""
    delta = F.col("score") - F.col("baseline")
    out = fold_metrics.groupBy("grp").agg(
        F.max("size").alias("size"),
        F.avg("score").alias("mean_score"),
        F.avg(delta).alias("delta"),
        F.avg((delta > 0).cast("double")).alias("positive_folds"),
    )
    out = out.withColumn("eligible", (F.col("delta") >= min_delta) & (F.col("positive_folds") >= min_positive))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("eligible"), F.desc("mean_score"), "size", "grp")
    return out.withColumn("best", (F.row_number().over(order) == 1) & F.col("eligible"))


def periods_per_year(bars: DataFrame, ts: str = "ts", code: str = "code") -> DataFrame:
    """Bars per year of each code, clamped; the upper median over the codes."""
    per = bars.groupBy(code).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    years = (F.unix_timestamp("b") - F.unix_timestamp("a")) / (365.25 * 86400.0)
    per = per.where(years > 0).select(
        F.greatest(F.lit(10), F.least(F.lit(600000), F.round(F.col("n") / years))).cast("bigint").alias("ppy")
    )
    order = Window.partitionBy(F.lit(1)).orderBy("ppy")
    numbered = per.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    return numbered.where(F.col("_i") == F.floor(F.col("_n") / 2)).select("ppy")


def elite(scored: DataFrame, k: int = 60, tokens: str = "tokens", score: str = "score") -> DataFrame:
    """Best score per formula text, the ``k`` best formulas."""
    best = scored.groupBy(tokens).agg(F.max(score).alias(score))
    return best.orderBy(F.desc(score), tokens).limit(k)


def control_quantiles(controls: DataFrame, targets: DataFrame) -> DataFrame:
    """Quantiles of the control deltas per (head, family) and the share at or below the target."""
    joined = controls.join(targets, "head")
    q = F.percentile("delta", [0.05, 0.5, 0.95])
    return joined.groupBy("head", "family").agg(
        F.count(F.lit(1)).alias("draws"), q[0].alias("q05"), q[1].alias("q50"), q[2].alias("q95"),
        F.avg((F.col("delta") <= F.col("target")).cast("double")).alias("share_at_or_below"),
    )


def annual_sharpe(x: str, annual: int) -> Column:
    std = F.stddev_pop(x)
    return F.when(std > 1e-12, F.avg(x) / std * math.sqrt(annual)).otherwise(0.0)
