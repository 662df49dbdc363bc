"""Demand over time: series, zero periods, trends, forecasts, rolling-origin evaluation."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def demand_series(jobs: DataFrame, mentions: DataFrame, unit: str = "MONTH") -> DataFrame:
    """``(period, skill, jobs, eligible, rate)``: jobs that mention a skill among all dated jobs of a period.

    ``jobs`` is ``(job_id, day)`` with ``day`` a date; undated jobs are left out.
    """
    dated = jobs.filter(F.col("day").isNotNull()).select("job_id", F.date_trunc(unit, "day").cast("date").alias("period"))
    eligible = dated.groupBy("period").agg(F.countDistinct("job_id").alias("eligible"))
    counts = dated.join(mentions.select("job_id", "skill").distinct(), "job_id").groupBy("period", "skill").agg(
        F.countDistinct("job_id").alias("jobs")
    )
    return counts.join(eligible, "period").select(
        "period", "skill", "jobs", "eligible", F.round(F.col("jobs") * 100.0 / F.col("eligible"), 4).alias("rate")
    )


def with_zero_periods(series: DataFrame, jobs: DataFrame, unit: str = "MONTH") -> DataFrame:
    """The series with a zero for every period with dated jobs between a skill's first and last period."""
    eligible = (
        jobs.filter(F.col("day").isNotNull())
        .groupBy(F.date_trunc(unit, "day").cast("date").alias("period"))
        .agg(F.countDistinct("job_id").alias("eligible"))
    )
    step = {"MONTH": F.expr("interval 1 month"), "QUARTER": F.expr("interval 3 months"), "YEAR": F.expr("interval 1 year")}[unit]
    spans = series.groupBy("skill").agg(F.min("period").alias("_a"), F.max("period").alias("_b"))
    wanted = spans.select("skill", F.explode(F.sequence("_a", "_b", step)).alias("period")).join(eligible, "period")
    got = series.select("period", "skill", F.col("jobs").alias("_j"))
    return wanted.join(got, ["period", "skill"], "left").select(
        "period", "skill", F.coalesce("_j", F.lit(0)).cast("long").alias("jobs"), "eligible",
        F.round(F.coalesce("_j", F.lit(0)) * 100.0 / F.col("eligible"), 4).alias("rate"),
    )


def _ordered(series: DataFrame) -> DataFrame:
    up, down = W.partitionBy("skill").orderBy("period"), W.partitionBy("skill").orderBy(F.desc("period"))
    return series.withColumns(
        {
            "_i": F.row_number().over(up) - 1,
            "_back": F.row_number().over(down),
            "_d": F.col("rate") - F.lag("rate").over(up),
        }
    )


def trend_table(series: DataFrame, recent: int = 3) -> DataFrame:
    """One row per skill: recent and earlier means, change, slope, volatility, share of rises and a label.

    Label, in order: fewer than 4 periods ``insufficient``; new within the
    recent window ``emerging``; change and slope of one sign beyond half a point
    ``rising`` or ``falling``; deviation above half the mean ``volatile``; else ``stable``.
    """
    x = _ordered(series)
    last = F.col("_back") <= recent
    e4 = F.round(F.col("rate") * 10_000).cast("long")
    t = x.groupBy("skill").agg(
        F.count("*").alias("periods"),
        F.avg(F.when(last, F.col("rate"))).alias("_now"),
        F.avg(F.when(~last, F.col("rate"))).alias("_then"),
        F.coalesce(F.regr_slope("rate", "_i"), F.lit(0.0)).alias("_slope"),
        # Rates have four digits, so whole numbers keep the deviation exact in any order of summing.
        (F.sqrt(F.count("*") * F.sum(e4 * e4) - F.sum(e4) * F.sum(e4)) / F.count("*") / 10_000).alias("_dev"),
        F.avg("rate").alias("_mean"),
        F.avg(F.when(last & F.col("_d").isNotNull(), (F.col("_d") > 0).cast("double"))).alias("_rises"),
        F.sum(F.when(~last, F.col("jobs")).otherwise(0)).alias("_before"),
    )
    change = F.round(F.col("_now") - F.coalesce("_then", F.lit(0.0)), 4)
    slope = F.round(F.col("_slope"), 6)
    label = (
        F.when(F.col("periods") < 4, "insufficient")
        .when(F.col("_before") == 0, "emerging")
        .when((change > 0.5) & (slope > 0), "rising")
        .when((change < -0.5) & (slope < 0), "falling")
        .when(F.round(F.col("_dev"), 6) > F.round(F.col("_mean") / 2, 6), "volatile")
        .otherwise("stable")
    )
    return t.select(
        "skill", "periods", F.round("_now", 4).alias("recent_rate"), F.round("_then", 4).alias("earlier_rate"),
        change.alias("change"), slope.alias("slope"), F.round("_dev", 4).alias("volatility"),
        F.round(F.coalesce("_rises", F.lit(0.0)), 4).alias("rise_share"), label.alias("trend"),
    )


def _clip(c: Column) -> Column:
    return F.round(F.greatest(F.least(c, F.lit(100.0)), F.lit(0.0)), 4)


def forecasts(series: DataFrame, horizon: int = 3, least: int = 8) -> DataFrame:
    """``(skill, step, last_value, mean_3, linear)`` for skills with ``least`` periods, within [0, 100]."""
    x = _ordered(series)
    fit = x.groupBy("skill").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("_back") == 1, F.col("rate"))).alias("_last"),
        F.avg(F.when(F.col("_back") <= 3, F.col("rate"))).alias("_mean"),
        F.coalesce(F.regr_slope("rate", "_i"), F.lit(0.0)).alias("_b"),
        F.coalesce(F.regr_intercept("rate", "_i"), F.avg("rate")).alias("_a"),
    )
    return (
        fit.filter(F.col("n") >= least)
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(
            "skill", "step", _clip(F.col("_last")).alias("last_value"), _clip(F.col("_mean")).alias("mean_3"),
            _clip(F.col("_a") + F.col("_b") * (F.col("n") - 1 + F.col("step"))).alias("linear"),
        )
    )


def rolling_origin(series: DataFrame, least: int = 4) -> DataFrame:
    """``(skill, model, n, mae, rmse, direction)``: one-step forecasts from every origin with ``least`` periods before.

    ``direction`` is the share of forecasts with the sign of the true change
    (no forecast change counts as none).
    """
    up = W.partitionBy("skill").orderBy("period")
    before = up.rowsBetween(W.unboundedPreceding, -1)
    # Whole ten-thousandths, so that sums are exact in any order of adding.
    e4 = F.round(F.col("rate") * 10_000).cast("long")
    x = series.withColumns({"_i": (F.row_number().over(up) - 1).cast("long"), "_r": e4})
    made = x.withColumns(
        {
            "last_value": F.lag("_r").over(up),
            "_m3": F.sum("_r").over(up.rowsBetween(-3, -1)),
            "_n": F.count("*").over(before),
            "_si": F.sum("_i").over(before),
            "_sii": F.sum(F.col("_i") * F.col("_i")).over(before),
            "_sr": F.sum("_r").over(before),
            "_sir": F.sum(F.col("_i") * F.col("_r")).over(before),
        }
    ).filter(F.col("_n") >= least)
    n, top = F.col("_n").cast("double"), (F.col("_n") * F.col("_sir") - F.col("_si") * F.col("_sr")).cast("double")
    b = top / (F.col("_n") * F.col("_sii") - F.col("_si") * F.col("_si")).cast("double")
    ahead = (F.col("_sr").cast("double") - b * F.col("_si").cast("double")) / n + b * F.col("_i").cast("double")
    long = made.withColumns(
        {
            "linear": F.greatest(F.round(ahead).cast("long"), F.lit(0).cast("long")),
            "mean_3": F.floor((F.col("_m3") * 2 + 3) / 6).cast("long"),
            "_prev": F.col("last_value"),
        }
    ).unpivot(["skill", "_r", "_prev"], ["last_value", "mean_3", "linear"], "model", "forecast")
    error = F.col("forecast") - F.col("_r")
    right = (F.signum(F.col("forecast") - F.col("_prev")) == F.signum(F.col("_r") - F.col("_prev"))).cast("long")

    def mean(total: Column) -> Column:
        """Halves up, in ten-thousandths."""
        return F.floor((total * 2 + F.col("n")) / (F.col("n") * 2)) / 10_000

    sums = long.groupBy("skill", "model").agg(
        F.count("*").alias("n"), F.sum(F.abs(error)).alias("_abs"), F.sum(error * error).alias("_sq"), F.sum(right).alias("_right")
    )
    return sums.select(
        "skill", "model", "n", mean(F.col("_abs")).alias("mae"),
        F.round(F.sqrt(F.col("_sq") / F.col("n")) / 10_000, 4).alias("rmse"),
        mean(F.col("_right") * 10_000).alias("direction"),
    )


def best_models(scores: DataFrame) -> DataFrame:
    """``(skill, model, mae)`` with the smallest error; ties go to the first name."""
    return scores.groupBy("skill").agg(
        F.min(F.struct("mae", "model")).alias("_m")
    ).select("skill", F.col("_m.model").alias("model"), F.col("_m.mae").alias("mae"))


def direction_bands(series: DataFrame, edge: float = 0.5) -> DataFrame:
    """``(skill, direction)``: mean of the last three periods against the three before, half a point either way."""
    x = _ordered(series)
    t = x.groupBy("skill").agg(
        F.avg(F.when(F.col("_back") <= 3, F.col("rate"))).alias("now"),
        F.avg(F.when(F.col("_back").between(4, 6), F.col("rate"))).alias("then"),
    )
    gap = F.round(F.col("now") - F.col("then"), 6)
    return t.filter(F.col("then").isNotNull()).select(
        "skill", F.when(gap > edge, "higher").when(gap < -edge, "lower").otherwise("broadly similar").alias("direction")
    )


def lag_features(series: DataFrame) -> DataFrame:
    """``(skill, period, rate, lag_1, lag_2, lag_3, mean_3)`` of the periods that have three before them."""
    up = W.partitionBy("skill").orderBy("period")
    lags = {f"lag_{k}": F.lag("rate", k).over(up) for k in (1, 2, 3)}
    return (
        series.select("skill", "period", "rate")
        .withColumns(lags)
        .filter(F.col("lag_3").isNotNull())
        .withColumn("mean_3", F.round((F.col("lag_1") + F.col("lag_2") + F.col("lag_3")) / 3, 6))
    )


def _grown(x: np.ndarray, y: np.ndarray, leaf: int = 2) -> tuple | float:
    """A regression tree as ``(feature, bound, left, right)`` or a mean; no leaf has fewer than ``leaf`` rows."""
    n, best = len(y), None
    if n >= 2 * leaf and y.max() > y.min():
        order = np.argsort(x, axis=0, kind="stable")
        xs, ys = np.take_along_axis(x, order, axis=0), y[order]
        left = np.cumsum(ys, axis=0)[leaf - 1 : n - leaf]
        k = np.arange(leaf, n - leaf + 1)[:, None]
        low, high = xs[leaf - 1 : n - leaf], xs[leaf : n - leaf + 1]
        gain = np.where(high > low, left**2 / k + (y.sum() - left) ** 2 / (n - k), -np.inf)
        at, f = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if np.isfinite(gain[at, f]):
            best = (int(f), float((low[at, f] + high[at, f]) / 2))
    if best is None:
        return float(y.mean())
    # Halfway between neighbours can round to the upper one.
    here = x[:, best[0]] <= best[1]
    return float(y.mean()) if here.all() else (*best, _grown(x[here], y[here], leaf), _grown(x[~here], y[~here], leaf))


def _forest_next(values: list[float], trees: int, steps: int, seed: list[int]) -> list[float]:
    """The next ``steps`` values by a forest on the lags of one series, each fed back for the one after it."""
    rows = [[values[i - 1], values[i - 2], values[i - 3], sum(values[i - 3 : i]) / 3] for i in range(3, len(values))]
    x, y, draw = np.array(rows), np.array(values[3:]), np.random.default_rng(seed)
    grown = [_grown(x[k], y[k]) for k in draw.integers(0, len(y), (trees, len(y)))]

    def told(tree: tuple | float, row: list[float]) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    state = list(values[-3:])
    for _ in range(steps):
        row = [state[-1], state[-2], state[-3], sum(state[-3:]) / 3]
        state.append(min(100.0, max(0.0, sum(told(t, row) for t in grown) / trees)))
    return state[3:]


def forest_forecast(series: DataFrame, trees: int = 150, horizon: int = 3, least: int = 4, seed: int = 42) -> DataFrame:
    """``(skill, step, forecast)``: the next rates by a random forest on the lags of each skill with ``least`` periods."""

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("period")
        if len(one) < max(least, 4):
            return pd.DataFrame([], columns=["skill", "step", "forecast"])
        skill = one["skill"].iloc[0]
        got = _forest_next(one["rate"].astype(float).tolist(), trees, horizon, [seed, zlib.crc32(skill.encode())])
        return pd.DataFrame({"skill": skill, "step": range(1, horizon + 1), "forecast": [round(v, 4) for v in got]})

    return series.select("skill", "period", "rate").groupBy("skill").applyInPandas(run, "skill string, step int, forecast double")


def forest_origins(series: DataFrame, trees: int = 100, least: int = 12, seed: int = 42) -> DataFrame:
    """The table of :func:`rolling_origin` with the model ``forest``; all models over the same origins.

    Every origin has ``least`` periods before it, and its forest sees only those.
    """
    first = max(least, 11)  # eight rows with three lags

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("period")
        values, skill = one["rate"].astype(float).tolist(), one["skill"].iloc[0]
        key = [seed, zlib.crc32(skill.encode())]
        made = [(values[i], values[i - 1], _forest_next(values[:i], trees, 1, [*key, i])[0]) for i in range(first, len(values))]
        return pd.DataFrame([(skill, *m) for m in made], columns=["skill", "rate", "_prev", "forecast"])

    made = series.select("skill", "period", "rate").groupBy("skill").applyInPandas(
        run, "skill string, rate double, _prev double, forecast double"
    )
    error = F.col("forecast") - F.col("rate")
    right = (F.signum(F.round(F.col("forecast") - F.col("_prev"), 9)) == F.signum(F.round(F.col("rate") - F.col("_prev"), 9))).cast("double")
    scores = made.groupBy("skill").agg(
        F.lit("forest").alias("model"),
        F.count("*").alias("n"),
        F.round(F.avg(F.abs(error)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        F.round(F.avg(right), 4).alias("direction"),
    )
    return rolling_origin(series, first).unionByName(scores)
