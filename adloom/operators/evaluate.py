"""Scoring predicted values and sets against reference labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.stats import wilson
from adloom.functions.text import normalised


def compare_text(expected: Column, got: Column) -> Column:
    """Outcome of one field: ``both_missing``, ``missing``, ``extra``, ``exact``, ``normalised``, ``similar``, ``wrong``.

    Values are trimmed; blank ones are missing. Normalised means equal after
    lower case and without punctuation, similar a word-set Jaccard of 0.8 or more.
    """
    e, g = F.nullif(F.trim(expected), F.lit("")), F.nullif(F.trim(got), F.lit(""))

    plain = normalised
    we, wg = F.array_distinct(F.split(plain(e), " ")), F.array_distinct(F.split(plain(g), " "))
    shared = F.size(F.array_intersect(we, wg))
    jaccard = shared / (F.size(we) + F.size(wg) - shared)
    return (
        F.when(e.isNull() & g.isNull(), "both_missing")
        .when(g.isNull(), "missing")
        .when(e.isNull(), "extra")
        .when(e == g, "exact")
        .when(plain(e) == plain(g), "normalised")
        .when(jaccard >= 0.8, "similar")
        .otherwise("wrong")
    )


def field_outcomes(pairs: DataFrame, fields: dict[str, tuple[str, str]], keep: tuple[str, ...]) -> DataFrame:
    """Long ``(keep..., field, outcome)`` of several fields; ``fields`` maps a name to its two columns."""
    rows = F.array(*(F.struct(F.lit(n).alias("field"), compare_text(F.col(e), F.col(g)).alias("outcome")) for n, (e, g) in fields.items()))
    return pairs.select(*keep, F.explode(rows).alias("_r")).select(*keep, "_r.field", "_r.outcome")


_GOOD = ("exact", "normalised", "similar")


def field_metrics(outcomes: DataFrame) -> DataFrame:
    """Per field: eligible, correct, missing, extra, agreement with its Wilson interval."""
    eligible = ~F.col("outcome").isin("both_missing", "extra")
    good = F.col("outcome").isin(*_GOOD)
    t = outcomes.groupBy("field").agg(
        F.count_if(eligible).alias("eligible"),
        F.count_if(good).alias("correct"),
        F.count_if(F.col("outcome") == "exact").alias("exact"),
        F.count_if(F.col("outcome") == "missing").alias("missing"),
        F.count_if(F.col("outcome") == "extra").alias("extra"),
    )
    low, high = wilson(F.col("correct"), F.col("eligible"))
    return t.withColumns(
        {
            "agreement": F.when(F.col("eligible") > 0, F.round(F.col("correct") / F.col("eligible"), 4)),
            "ci_low": low,
            "ci_high": high,
        }
    )


def stratified(outcomes: DataFrame, strata: list[str]) -> DataFrame:
    """Agreement by each stratum in one pass (grouping sets): ``(stratum, value, eligible, correct, share)``."""
    eligible = F.count_if(~F.col("outcome").isin("both_missing", "extra"))
    good = F.count_if(F.col("outcome").isin(*_GOOD))
    sets = [[F.col(c)] for c in strata]
    t = outcomes.groupingSets(sets, *map(F.col, strata)).agg(
        F.grouping_id(*strata).alias("_g"), eligible.alias("eligible"), good.alias("correct")
    )
    n = len(strata)
    name = F.coalesce(*(F.when(F.col("_g") == (2**n - 1) ^ (1 << (n - 1 - k)), c) for k, c in enumerate(strata)))
    value = F.coalesce(*(F.when(F.col("_g") == (2**n - 1) ^ (1 << (n - 1 - k)), F.col(c)) for k, c in enumerate(strata)))
    return t.select(
        name.alias("stratum"), value.alias("value"), "eligible", "correct",
        F.when(F.col("eligible") > 0, F.round(F.col("correct") / F.col("eligible"), 4)).alias("share"),
    )


def set_scores(expected: DataFrame, got: DataFrame, *keys: str) -> DataFrame:
    """One row of precision, recall and F1 over distinct ``keys`` tuples; zero where undefined."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    g = got.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = e.join(g, list(keys), "full")
    tp = F.count_if(F.col("_e").isNotNull() & F.col("_g").isNotNull())
    t = both.agg(tp.alias("tp"), F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_g").isNull()).alias("fn"))
    return _prf(t)


def label_scores(expected: DataFrame, got: DataFrame, key: str, label: str) -> DataFrame:
    """Precision, recall and F1 of each label."""
    e = expected.select(key, label).distinct().withColumn("_e", F.lit(1))
    g = got.select(key, label).distinct().withColumn("_g", F.lit(1))
    t = (
        e.join(g, [key, label], "full")
        .groupBy(label)
        .agg(
            F.count_if(F.col("_e").isNotNull() & F.col("_g").isNotNull()).alias("tp"),
            F.count_if(F.col("_e").isNull()).alias("fp"),
            F.count_if(F.col("_g").isNull()).alias("fn"),
        )
    )
    return _prf(t)


def _prf(t: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return t.withColumns(
        {
            "precision": F.round(p, 6),
            "recall": F.round(r, 6),
            "f1": F.round(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0), 6),
        }
    )


def threshold_sweep(scored: DataFrame, expected: DataFrame, thresholds: list[float], keys: tuple[str, ...], score: str) -> DataFrame:
    """Precision, recall and F1 of the pairs whose best score reaches each threshold, in one pass."""
    best = scored.groupBy(*keys).agg(F.max(score).alias("_s"))
    both = expected.select(*keys).distinct().withColumn("_e", F.lit(1)).join(best, list(keys), "full")
    long = both.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit = F.coalesce(F.col("_s") >= F.col("threshold"), F.lit(False))
    true = F.col("_e").isNotNull()
    return _prf(
        long.groupBy("threshold").agg(
            F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn")
        )
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the best F1, then precision, then the smallest threshold."""
    order = F.struct("f1", "precision", -F.col("threshold"))
    return sweep.agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"), order).alias("_b")).select("_b.*")


def numeric_errors(pairs: DataFrame, expected: str, got: str, *keys: str) -> DataFrame:
    """``(keys..., n, mae, median_error, rmse)`` over rows that have both numbers."""
    error = F.abs(F.col(expected) - F.col(got))
    return pairs.filter(error.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.avg(error), 4).alias("mae"),
        F.round(F.percentile(error, F.lit(0.5)), 4).alias("median_error"),
        F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
    )
