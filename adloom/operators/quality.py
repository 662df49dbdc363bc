"""Data quality: rules in one scan, duplicates, deduplication, failures, relevance, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.functions.names import fresh


def rule_report(df: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """``(rule, violations, rows, status)`` of all rules in one scan.

    A rule is a name, the condition that marks a bad row (null is not bad) and
    its severity, ``fail`` or ``warning``; no bad row gives ``pass``.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{k}") for k, (_, c, _) in enumerate(rules))
    )
    each = F.array(
        *(
            F.struct(F.lit(n).alias("rule"), F.col(f"r{k}").alias("violations"), F.lit(s).alias("severity"))
            for k, (n, _, s) in enumerate(rules)
        )
    )
    return counts.select("rows", F.explode(each).alias("_r")).select(
        "_r.rule", "_r.violations", "rows", F.when(F.col("_r.violations") == 0, "pass").otherwise(F.col("_r.severity")).alias("status")
    )


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, missing, pct)``: null or blank values of each column in one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))).alias(f"m{k}") for k, c in enumerate(columns)),
    )
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{k}").alias("missing")) for k, c in enumerate(columns)))
    return counts.select("rows", F.explode(each).alias("_r")).select(
        "_r.column", "_r.missing", F.when(F.col("rows") > 0, F.round(F.col("_r.missing") * 100.0 / F.col("rows"), 2)).otherwise(0.0).alias("pct")
    )


def duplicate_counts(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``(key, duplicates, groups)``: rows beyond the first of each key, and keys that occur more than once."""
    parts = []
    for name, c in keys.items():
        g = df.filter(c.isNotNull()).groupBy(c.alias("_k")).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
        parts.append(g.agg(F.lit(name).alias("key"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("groups")))
    return reduce(DataFrame.unionByName, parts)


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; rows without a key all stay.

    A key can hold a large share of the rows, so the first is found by a
    minimum, which combines before the shuffle, and not by sorting the group.
    """
    k, o = fresh(df, "_key"), fresh(df, "_row")
    whole = df.withColumn(k, key)
    first = (
        whole.filter(F.col(k).isNotNull())
        .groupBy(k)
        .agg(F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.struct(*(F.col(c) for c in df.columns)).alias("v"))).alias(o))
        .select(F.col(f"{o}.v.*"))
    )
    return first.unionByName(whole.filter(F.col(k).isNull()).drop(k))


def duplicate_flags(df: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``repeated`` (the key occurs more than once) and ``later`` (not its first row by ``order``)."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return df.join(counts, key, "left").withColumns(
        {
            "repeated": F.coalesce(F.col("_n") > 1, F.lit(False)),
            "later": F.coalesce(F.col(order) > F.col("_first"), F.lit(False)),
        }
    ).drop("_n", "_first")


def failure_class(status: Column, text: Column) -> Column:
    """Class of a failed record by its status and message."""
    s, t = F.lower(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(s.contains("network") | t.contains("timeout"), "network")
        .when(s.contains("blocked") | t.contains("captcha") | t.contains("forbidden"), "blocked")
        .when(s.contains("parse") | t.contains("parse"), "parsing")
        .when(s.contains("partial"), "incomplete")
        .when(s.isin("success", "ok", "completed"), "none")
        .otherwise("unknown")
    )


def retryable(kind: Column) -> Column:
    """Whether another attempt can help."""
    return kind.isin("network", "incomplete", "unknown")


#: Weights and limits of the relevance score.
TITLE, CATEGORY, SKILL, TEXT, IT, AMBIGUOUS = 0.5, 0.1, 0.08, 0.05, 0.40, 0.15


def relevance(title: Column, text: Column, n_skills: Column, strong: list[str], weak: list[str], excluded: list[str]) -> tuple[Column, Column]:
    """Score in [0, 1] and label ``it``, ``ambiguous`` or ``non_it`` of an advert.

    An excluded title word sends an advert to ``non_it`` unless a strong title word stands beside it.
    """

    def hits(c: Column, words: list[str]) -> Column:
        return F.coalesce(F.lower(c).rlike(r"\b(?:" + "|".join(words) + r")\b"), F.lit(False))

    in_title, in_text, bad = hits(title, strong), hits(text, weak), hits(title, excluded)
    score = F.least(
        F.lit(1.0),
        F.when(in_title, TITLE).otherwise(0.0)
        + F.when(in_text, CATEGORY).otherwise(0.0)
        + F.least(F.coalesce(n_skills, F.lit(0)), F.lit(5)) * SKILL,
    )
    score = F.round(F.when(bad & ~in_title, 0.0).otherwise(score), 4)
    return score, F.when(score >= IT, "it").when(score >= AMBIGUOUS, "ambiguous").otherwise("non_it")


def text_profile(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """``(keys..., rows, with_text, yield_pct, shortest, longest, mean, median, non_ascii_pct)`` of a text column."""
    t = F.nullif(F.trim(F.col(text)), F.lit(""))
    n = F.length(t)
    odd = F.length(F.regexp_replace(t, r"[\x00-\x7F]", ""))
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count(t).alias("with_text"),
        F.round(F.count(t) * 100.0 / F.count("*"), 2).alias("yield_pct"),
        F.min(n).alias("shortest"),
        F.max(n).alias("longest"),
        F.round(F.avg(n), 2).alias("mean"),
        F.round(F.percentile(n, F.lit(0.5)), 2).alias("median"),
        F.round(F.coalesce(F.sum(odd) * 100.0 / F.sum(n), F.lit(0.0)), 4).alias("non_ascii_pct"),
    )


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (a maximum, combined before the shuffle)."""
    own = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(key).agg(F.max_by(own, F.struct(*order)).alias("_v")).select("_v.*")


def sample_per_stratum(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum by a hash of the key and seed."""
    rank = F.row_number().over(W.partitionBy(*strata).orderBy(F.xxhash64(key, F.lit(seed)), key))
    return df.withColumn("_k", rank).filter(F.col("_k") <= n).drop("_k")
