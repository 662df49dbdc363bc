"""Fields compared by their type against reviewed references: nine outcomes, and the figures made of them.

A reference has a status: ``verified``, ``unavailable``, ``ambiguous`` or
``not_reviewed``. Outcomes are ``not_reviewed``, ``ambiguous_excluded``,
``correct_absence``, ``over_extracted``, ``missing_prediction``, ``correct``,
``incorrect``, ``incompatible_currency`` and ``incompatible_pay_period``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.text import normalised

# What people write for a currency or a pay period in references.
CURRENCIES = {
    "lkr": "LKR", "slr": "LKR", "rs": "LKR", "inr": "INR", "₹": "INR", "lpa": "INR", "sgd": "SGD", "s$": "SGD", "myr": "MYR", "rm": "MYR",
    "ringgit": "MYR", "usd": "USD", "us$": "USD", "eur": "EUR", "€": "EUR", "gbp": "GBP", "£": "GBP",
}
_NOTHING = ("", "nan", "none", "null")


def filled(c: Column) -> Column:
    """The trimmed text, null where it says nothing."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*_NOTHING), t)


def number_of(c: Column) -> Column:
    """A number written with or without commas; null where it is none."""
    return F.regexp_replace(filled(c.cast("string")), ",", "").try_cast("double")


def currency_of(c: Column) -> Column:
    """The code of a currency; unknown ones in capitals, nothing as empty text."""
    t = filled(c)
    known = F.create_map(*(F.lit(x) for kv in CURRENCIES.items() for x in kv))
    return F.coalesce(F.element_at(known, F.lower(t)), F.upper(t), F.lit(""))


def period_of(c: Column) -> Column:
    """``hourly``, ``daily``, ``monthly``, ``annual`` or ``unspecified``."""
    t = F.lower(filled(c))
    return (
        F.when(t.contains("hour"), "hourly")
        .when(t.contains("day") | t.contains("daily"), "daily")
        .when(t.contains("month"), "monthly")
        .when(t.rlike("year|annum|annual|lpa"), "annual")
        .otherwise("unspecified")
    )


def _outcome(status: Column, got: Column, verdict: Column, absent: Column | None = None) -> Column:
    """The frame of all types: ``got`` is null for no prediction, ``absent`` true where the reference has no value."""
    unavailable = (status == "unavailable") if absent is None else (status == "unavailable") | absent
    return (
        F.when(status == "not_reviewed", "not_reviewed")
        .when(status == "ambiguous", "ambiguous_excluded")
        .when(unavailable & got.isNull(), "correct_absence")
        .when(unavailable, "over_extracted")
        .when(got.isNull(), "missing_prediction")
        .otherwise(verdict)
    )


def text_outcome(status: Column, expected: Column, got: Column, least: float = 0.8, plain: Callable[[Column], Column] = normalised) -> Column:
    """Text agrees if it is equal after ``plain``, or its word sets have a Jaccard of ``least``."""
    e, g = plain(F.coalesce(expected, F.lit(""))), F.nullif(plain(F.coalesce(filled(got), F.lit(""))), F.lit(""))
    we, wg = (F.array_distinct(F.filter(F.split(x, " "), lambda w: w != "")) for x in (e, g))
    shared = F.size(F.array_intersect(we, wg))
    close = (F.size(we) > 0) & (F.size(wg) > 0) & (shared >= least * (F.size(we) + F.size(wg) - shared))
    return _outcome(status, g, F.when((e == g) | close, "correct").otherwise("incorrect"))


def date_outcome(status: Column, expected: Column, got: Column) -> Column:
    """Dates agree if they are the same day; both are given as dates."""
    return _outcome(status, got, F.when(expected.eqNullSafe(got), "correct").otherwise("incorrect"))


def number_outcome(
    status: Column, expected: Column, got: Column, currencies: tuple[Column, Column], periods: tuple[Column, Column], within: float = 1.0
) -> Column:
    """Amounts agree within ``within`` where neither currency nor period (as of :func:`currency_of`, :func:`period_of`) forbids it."""
    (ce, cg), (pe, pg) = currencies, periods
    verdict = (
        F.when((ce != "") & (cg != "") & (ce != cg), "incompatible_currency")
        .when((pe != "unspecified") & (pg != "unspecified") & (pe != pg), "incompatible_pay_period")
        .when(F.abs(got - expected) <= within, "correct")
        .otherwise("incorrect")
    )
    return _outcome(status, got, verdict, expected.isNull())


def set_outcome(status: Column, expected: Column, got: Column, least: float = 0.5) -> Column:
    """Sets agree if their Jaccard is ``least`` or the prediction holds all that is expected."""
    e = F.array_distinct(F.coalesce(expected, F.array().cast("array<string>")))
    g = F.array_distinct(got)
    g = F.when(F.size(g) > 0, g)
    shared = F.size(F.array_intersect(e, g))
    good = (shared >= least * (F.size(e) + F.size(g) - shared)) | (shared == F.size(e))
    return _outcome(status, g, F.when(good, "correct").otherwise("incorrect"))


def outcome_figures(outcomes: DataFrame) -> DataFrame:
    """Per field of ``(field, outcome, error)``: counts, coverage, correctness, precision, recall, F1, hallucination, errors of numbers."""
    o = F.col("outcome")
    wrong = o.isin("incorrect", "incompatible_currency", "incompatible_pay_period")
    t = outcomes.groupBy("field").agg(
        F.count_if((o == "correct") | wrong | (o == "missing_prediction")).alias("eligible"),
        F.count_if((o == "correct") | wrong).alias("matched"),
        F.count_if(o == "correct").alias("correct"),
        F.count_if(wrong).alias("incorrect"),
        F.count_if(o == "missing_prediction").alias("missing"),
        F.count_if(o == "correct_absence").alias("absences"),
        F.count_if(o == "over_extracted").alias("over_extracted"),
        F.round(F.avg("error"), 4).alias("mae"),
        F.round(F.percentile("error", F.lit(0.5)), 4).alias("median_error"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)

    n, m, c, w, x = (F.col(k) for k in ("eligible", "matched", "correct", "incorrect", "over_extracted"))
    return t.withColumns(
        {
            "coverage": share(m, n),
            "correctness": share(c, m),
            "precision": share(c, c + w),
            "recall": share(c, n),
            "f1": share(2 * c, 2 * c + w + (n - c)),
            "hallucination": share(x, x + F.col("absences")),
        }
    )


def macro_figures(figures: DataFrame) -> DataFrame:
    """One row: the means of the rates over the fields that have eligible references."""
    own = figures.filter(F.col("eligible") > 0)
    # Rates have four digits, so whole ten-thousandths add up alike in any order.
    return own.agg(
        F.count("*").alias("fields"),
        *(
            F.round(F.sum(F.round(F.col(c) * 10_000).cast("long")) / F.count("*") / 10_000, 4).alias(f"macro_{c}")
            for c in ("coverage", "correctness", "precision", "recall", "f1")
        ),
    )


def label_averages(labels: DataFrame) -> DataFrame:
    """Micro and macro precision, recall and F1 of ``(tp, fp, fn)`` per label, over labels that the reference has."""
    own = labels.filter(F.col("tp") + F.col("fn") > 0)
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)

    def mean(c: str) -> Column:
        return F.round(F.sum(F.round(F.col(c) * 1_000_000).cast("long")) / F.count("*") / 1_000_000, 4)

    return own.agg(
        F.count("*").alias("labels"),
        share(tp, tp + fp).alias("micro_precision"), share(tp, tp + fn).alias("micro_recall"), share(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
        mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"),
    )
