"""Does a longer holding period pay?  Agreement, leave-one-group robustness and the gate.

Inputs are a daily book (horizon, phase, fold, position, net_return) and rows
(horizon, fold, date, code, group, signals, value); horizon 1 is the baseline.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators import evaluate as ev

#: Fixed values of the gate.
GATE = {
    "min_sharpe_improvement": 0.15, "min_annualized_improvement": 0.02, "family_alpha": 0.05, "worst_phase_sharpe_gap": 0.25,
    "max_drawdown_ratio": 1.2, "min_phase_agree": {3: 2, 5: 3}, "min_fold_agree": 3, "min_signal_agree": 2,
}
#: Groups that one pass re-ranks without; a classification has some dozens.
MOST_GROUPS = 500


def direction(x: Column) -> Column:
    return F.when(x > 1e-12, 1).when(x < -1e-12, -1).otherwise(0)


def sharpe(x: str, annual: int) -> Column:
    return ev.annual_sharpe(x, annual)


def annual_return(x: str, annual: int) -> Column:
    return F.expm1(F.sum(F.log1p(x)) * annual / F.count(x))


def horizon_metrics(book: DataFrame, annual: int) -> DataFrame:
    """Medians over the phases of each horizon, the worst phase and how many phases side with the median."""
    upto = Window.partitionBy("horizon", "phase").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    equity = book.withColumn("_equity", F.exp(F.sum(F.log1p("net_return")).over(upto)))
    fallen = equity.withColumn("_fall", 1 - F.col("_equity") / F.max("_equity").over(upto))
    phases = fallen.groupBy("horizon", "phase").agg(
        sharpe("net_return", annual).alias("sharpe"), annual_return("net_return", annual).alias("annual"), F.max("_fall").alias("fall")
    )
    out = phases.groupBy("horizon").agg(
        F.median("sharpe").alias("median_sharpe"), F.median("annual").alias("median_return"), F.median("fall").alias("median_drawdown"),
        F.min("sharpe").alias("worst_sharpe"), F.collect_list("sharpe").alias("_all"),  # one value per phase
    )
    base = out.where("horizon = 1")
    for name in ("median_sharpe", "median_return", "median_drawdown"):
        out = out.withColumn(f"base_{name}", base.select(name).scalar())
    gain = F.col("median_sharpe") - F.col("base_median_sharpe")
    agreeing = F.size(F.filter("_all", lambda s: direction(s - F.col("base_median_sharpe")) == direction(gain)))
    return out.withColumns(
        {"overall_sign": F.signum(gain).cast("int"), "phases_agreeing": F.when(F.col("horizon") == 1, F.size("_all")).otherwise(agreeing)}
    ).drop("_all")


def signal_ics(rows: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Daily RankIC of every signal: (signal, horizon, fold, date, rank_ic)."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("x")) for s in signals]))
    long = rows.select("horizon", "fold", "date", "value", each.alias("s")).select("horizon", "fold", "date", "value", "s.signal", "s.x")
    return ev.cross_section_ic(long, "x", "value", ("signal", "horizon", "fold", "date"))


def against_baseline(means: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of longer horizons with the difference of ``value`` to horizon 1 on the same keys, as ``delta``."""
    base = means.where("horizon = 1").select(*keys, F.col(value).alias("_base"))
    longer = means.where("horizon > 1")
    joined = longer.join(base, list(keys)) if keys else longer.withColumn("_base", base.select("_base").scalar())
    return joined.withColumn("delta", F.col(value) - F.col("_base")).drop("_base")


def date_medians(book: DataFrame) -> DataFrame:
    return book.groupBy("horizon", "fold", "position").agg(F.median("net_return").alias("r"))


def agreement(book: DataFrame, rows: DataFrame, signals: Sequence[str], ensemble: str, annual: int) -> DataFrame:
    """V24 per horizon: phases, folds and signals that side with the overall gain in Sharpe.

    A fold sides when both its annualised return and its RankIC of the ensemble moved that way.
    """
    metrics = horizon_metrics(book, annual)
    signs = metrics.where("horizon > 1").select("horizon", "overall_sign", "phases_agreeing")
    medians = date_medians(book)
    base = medians.where("horizon = 1").select("position", F.col("r").alias("_b"))
    paired = medians.where("horizon > 1").join(base, "position")
    money = paired.groupBy("horizon", "fold").agg(
        (annual_return("r", annual) - annual_return("_b", annual)).alias("gain"), F.count(F.lit(1)).alias("n")
    ).where("n >= 2")
    ics = signal_ics(rows, [*signals, ensemble])
    per_fold = ics.where(F.col("signal") == ensemble).groupBy("horizon", "fold").agg(F.avg("rank_ic").alias("ic"))
    folds = money.join(against_baseline(per_fold, ["fold"], "ic"), ["horizon", "fold"]).join(signs, "horizon")
    sides = (F.signum("gain") == F.col("overall_sign")) & (F.signum("delta") == F.col("overall_sign")) & (F.col("overall_sign") != 0)
    folds = folds.groupBy("horizon").agg(F.count(F.when(sides, 1)).alias("folds_agreeing"))
    per_signal = ics.where(F.col("signal") != ensemble).groupBy("signal", "horizon").agg(F.avg("rank_ic").alias("ic"))
    by_signal = against_baseline(per_signal, ["signal"], "ic").join(signs, "horizon")
    sides = (F.signum("delta") == F.col("overall_sign")) & (F.col("overall_sign") != 0)
    by_signal = by_signal.groupBy("horizon").agg(F.count(F.when(sides, 1)).alias("signals_agreeing"))
    return signs.join(folds, "horizon", "left").join(by_signal, "horizon", "left").na.fill(0, ["folds_agreeing", "signals_agreeing"])


def without_group_ic(df: DataFrame, by: Sequence[str], group: str, x: str, y: str, need: int = 10) -> DataFrame:
    """RankIC per ``by`` after dropping each group: (by, dropped, n, rank_ic), NULL groups are never dropped.

    The rows of a cross-section are sorted once per side.  Running counts per group over that sort give
    what each group contributes to every rank, and subtracting it gives the ranks without the group; no group is
    sorted again.  A row then enters one partial sum per other group before the shuffle.
    """
    valid = df.select(*by, group, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    groups = sorted(r[0] for r in valid.select(group).where(F.col(group).isNotNull()).distinct().limit(MOST_GROUPS + 1).collect())
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups in {group!r}")

    def parts(side: str) -> Column:
        upto = Window.partitionBy(*by).orderBy(side).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        here = Window.partitionBy(*by).orderBy(side).rangeBetween(Window.currentRow, Window.currentRow)

        def rank(inside: Column) -> Column:
            return F.sum(inside.cast("double")).over(upto) - F.sum(inside.cast("double")).over(here) / 2

        everyone = rank(F.lit(True))
        return F.array(*[everyone - rank(F.coalesce(F.col(group) == g, F.lit(False))) for g in groups])

    ranked = valid.withColumns({"_x": parts(x), "_y": parts(y)})
    names = F.array(*[F.lit(g) for g in groups])
    each = ranked.select(*by, F.col(group).alias("_own"), x, y, F.explode(F.arrays_zip(names.alias("g"), F.col("_x").alias("a"), F.col("_y").alias("b"))).alias("z"))
    rest = each.where(~F.col("_own").eqNullSafe(F.col("z.g"))).select(*by, F.col("z.g").alias("dropped"), F.col("z.a").alias("_a"), F.col("z.b").alias("_b"))
    out = rest.groupBy(*by, "dropped").agg(F.count(F.lit(1)).alias("n"), ev.guarded_corr("_a", "_b").alias("rank_ic"))
    return out.where((F.col("n") >= need) & F.col("rank_ic").isNotNull())


def concentration(book: DataFrame, rows: DataFrame, ensemble: str, group: str, annual: int, need_days: int = 40) -> DataFrame:
    """(horizon, kind, dropped, delta, overall, agrees) for dropped years and groups and the dropped top 5 % of the codes."""
    metrics = horizon_metrics(book, annual).where("horizon > 1").select("horizon", "overall_sign")
    # years: median of the phases against the baseline, dates on which every phase has a return
    phases = book.groupBy("horizon").agg(F.countDistinct("phase").alias("_need"))
    full = book.groupBy("horizon", "position", "date").agg(F.median("net_return").alias("r"), F.count("net_return").alias("_n"))
    full = full.join(phases, "horizon").where("_n = _need")
    base = full.where("horizon = 1").select("position", F.col("r").alias("_b"))
    days = full.where("horizon > 1").join(base, "position").withColumn("year", F.year("date"))
    years = days.agg(F.array_sort(F.collect_set("year")).alias("y")).scalar()
    kept = days.withColumn("dropped", F.explode(years)).where(F.col("dropped") != F.col("year"))
    by_year = kept.groupBy("horizon", "dropped").agg((sharpe("r", annual) - sharpe("_b", annual)).alias("delta"), F.count(F.lit(1)).alias("_n"))
    by_year = by_year.where(F.col("_n") >= need_days).join(metrics, "horizon").select(
        "horizon", F.lit("year").alias("kind"), F.col("dropped").cast("string").alias("dropped"), "delta", F.lit(None).cast("double").alias("overall"),
        ((F.col("overall_sign") == 0) | (F.signum("delta") == F.col("overall_sign"))).alias("agrees"),
    )
    # groups: RankIC of the ensemble against horizon 1, re-ranked without the group
    mean = ev.cross_section_ic(rows, ensemble, "value", ("horizon", "date")).groupBy("horizon").agg(F.avg("rank_ic").alias("ic"))
    overall = against_baseline(mean, [], "ic").select("horizon", F.col("delta").alias("overall"))
    apart = without_group_ic(rows, ("horizon", "date"), group, ensemble, "value").groupBy("horizon", "dropped").agg(F.avg("rank_ic").alias("ic"))
    by_group = against_baseline(apart, ["dropped"], "ic").join(overall, "horizon").select(
        "horizon", F.lit("industry").alias("kind"), "dropped", "delta", "overall",
        ((F.signum("overall") == 0) | (F.signum("delta") == F.signum("overall"))).alias("agrees"),
    )
    # codes: without the 5 % of greatest mean contribution, chosen per horizon and taken from the baseline too
    share = rows.where("horizon > 1").groupBy("horizon", "code").agg(F.avg(F.col(ensemble) * F.col("value")).alias("c"))
    place = Window.partitionBy("horizon").orderBy(F.desc_nulls_last("c"), "code")
    counts = share.groupBy("horizon").agg(F.ceil(0.05 * F.count(F.lit(1))).alias("_k"))
    top = share.withColumn("_i", F.row_number().over(place)).join(counts, "horizon").where("_i <= _k").select(F.col("horizon").alias("case"), "code")
    cases = top.agg(F.array_sort(F.collect_set("case")).alias("c")).scalar()
    kept = rows.withColumn("case", F.explode(cases)).where("horizon = case OR horizon = 1").join(top, ["case", "code"], "left_anti")
    rest = ev.cross_section_ic(kept, ensemble, "value", ("case", "horizon", "date")).groupBy("case", "horizon").agg(F.avg("rank_ic").alias("ic"))
    by_code = against_baseline(rest, ["case"], "ic").join(overall, "horizon").join(metrics, "horizon").select(
        "horizon", F.lit("stock").alias("kind"), F.lit("top5pct").alias("dropped"), "delta", "overall",
        ((F.col("overall_sign") == 0) | (F.signum("delta") == F.col("overall_sign")) | (F.abs("delta") < 1e-12)).alias("agrees"),
    )
    return by_year.unionByName(by_group).unionByName(by_code)


def concentration_ok(cases: DataFrame) -> DataFrame:
    """(horizon, year_ok, industry_ok, stock_ok, concentration_ok) from the rows of ``concentration``."""
    def count(kind: str, extra: Column | None = None) -> Column:
        return F.count(F.when((F.col("kind") == kind) & (F.lit(True) if extra is None else extra), 1))

    per = cases.groupBy("horizon").agg(
        count("year").alias("_y"), count("year", F.col("agrees")).alias("_ya"), count("industry").alias("_g"),
        count("industry", ~F.col("agrees")).alias("_gf"), count("stock", ~F.col("agrees")).alias("_sf"),
    )
    years = (F.col("_y") >= 2) & (F.col("_ya") >= F.least(F.lit(2), F.greatest(F.lit(1), F.col("_y") - 1)))
    groups = (F.col("_gf") == 0) | (F.col("_gf") / F.greatest(F.col("_g"), F.lit(1)) < 0.5)
    out = per.select("horizon", years.alias("year_ok"), groups.alias("industry_ok"), (F.col("_sf") == 0).alias("stock_ok"))
    return out.withColumn("concentration_ok", F.col("year_ok") & F.col("industry_ok") & F.col("stock_ok"))


def gate_checks(cfg=GATE) -> dict[str, Column]:
    """The ten checks over one row per horizon."""
    gain = F.col("median_sharpe") - F.col("base_median_sharpe")
    phases = F.when(F.col("horizon") == 3, cfg["min_phase_agree"][3]).otherwise(cfg["min_phase_agree"][5])
    return {
        "sharpe_improvement": gain >= cfg["min_sharpe_improvement"],
        "annualized_improvement": F.col("median_return") - F.col("base_median_return") >= cfg["min_annualized_improvement"],
        "bootstrap_ci_lower_positive": F.col("ci_low") > 0,
        "holm_family": F.col("reject"),
        "phase_direction": F.col("phases_agreeing") >= phases,
        "worst_phase_floor": F.col("worst_sharpe") >= F.col("base_median_sharpe") - cfg["worst_phase_sharpe_gap"],
        "fold_direction": F.col("folds_agreeing") >= cfg["min_fold_agree"],
        "drawdown_bound": F.col("median_drawdown") <= F.col("base_median_drawdown") * cfg["max_drawdown_ratio"] + 1e-12,
        "signal_direction": F.col("signals_agreeing") >= cfg["min_signal_agree"],
        "not_single_year_or_group": F.col("concentration_ok"),
    }


def classify(decided: DataFrame) -> DataFrame:
    """The conclusion over the decisions (horizon, passed) of horizons 3 and 5, as one row."""
    three, five = (F.coalesce(F.bool_or(F.when(F.col("horizon") == h, F.col("passed"))), F.lit(False)) for h in (3, 5))
    conclusion = F.when(three & five, "HORIZON_FEASIBLE_BOTH").when(three, "HORIZON_FEASIBLE_3D").when(five, "HORIZON_FEASIBLE_5D").otherwise("KEEP_1D_BASELINE")
    return decided.agg(conclusion.alias("conclusion"), F.when(three | five, "RESEARCH_GATE_PASSED").otherwise("KEEP_1D_BASELINE").alias("status"))


def phase_bootstrap(book: DataFrame, horizons: Sequence[int], annual: int, block: int, samples: int, seed: int) -> DataFrame:
    """(horizon, ci_low, ci_high, p_value, samples): median Sharpe of the phases less the baseline's, on common dates and draws."""
    names = {h: [f"h{h}_{p}" for p in range(h)] for h in (1, *horizons)}
    flat = [(h, p, n) for h, ns in names.items() for p, n in enumerate(ns)]
    wide = book.groupBy("position").agg(*[F.max(F.when((F.col("horizon") == h) & (F.col("phase") == p), F.col("net_return"))).alias(n) for h, p, n in flat])
    wide = wide.dropna().withColumnRenamed("position", "_at")
    # a series of sessions, bounded by the calendar
    series = wide.withColumn("position", F.row_number().over(Window.orderBy("_at")) - 1)
    draws = ev.moving_block_bootstrap(series, [n for _, _, n in flat], block, samples, seed)
    per = draws.groupBy("draw").agg(*[sharpe(n, annual).alias(n) for _, _, n in flat])

    def middle(h: int) -> Column:
        s, k = F.array_sort(F.array(*names[h])), len(names[h])
        return (F.element_at(s, (k + 1) // 2) + F.element_at(s, k // 2 + 1)) / 2

    stats = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (middle(h) - F.col("h1_0")).alias("stat")) for h in horizons]))
    return ev.bootstrap_summary(per.select(stats.alias("s")).select("s.horizon", "s.stat"), ["horizon"])


def gate(metrics: DataFrame, agreeing: DataFrame, robust: DataFrame, bootstrap: DataFrame, cfg=GATE) -> DataFrame:
    """(horizon, passed, n_passed, failed) with Holm's adjustment over the horizons."""
    p = bootstrap.select(F.col("horizon"), F.concat(F.col("horizon").cast("string"), F.lit("d_vs_1d")).alias("name"), "p_value", "ci_low")
    adjusted = ev.holm(p, cfg["family_alpha"]).select("horizon", "ci_low", "p_holm", "reject")
    joined = metrics.where("horizon > 1").drop("phases_agreeing", "overall_sign").join(agreeing, "horizon").join(robust, "horizon").join(adjusted, "horizon")
    checks = gate_checks(cfg)
    failed = joined.withColumn("_failed", ev.failed_checks(checks))
    return failed.select(
        "horizon", (F.size("_failed") == 0).alias("passed"), (F.lit(len(checks)) - F.size("_failed")).alias("n_passed"), F.concat_ws(";", "_failed").alias("failed")
    )
