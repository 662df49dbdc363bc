"""Comparison of groups: demand grids, gaps, salary spread, profile similarity, sensitivity, funnels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.functions.stats import Z95, average_rank, erfc, wilson

SMALL = 30


def demand_grid(facts: DataFrame) -> DataFrame:
    """Zero-filled ``(market, skill)`` grid: jobs, share in percent, Wilson interval, small-sample flag.

    ``facts`` holds distinct ``(market, job_id, skill)``. Only jobs with a skill
    count in a market's total.
    """
    totals = facts.groupBy("market").agg(F.countDistinct("job_id").alias("total"))
    counts = facts.groupBy("market", "skill").agg(F.count("*").alias("jobs"))
    vocabulary = facts.agg(F.collect_set("skill")).scalar()
    grid = totals.select("market", "total", F.explode(vocabulary).alias("skill"))
    jobs = F.coalesce("jobs", F.lit(0)).cast("long")
    low, high = wilson(F.col("jobs"), F.col("total"), Z95, 100.0, 2)
    return (
        grid.join(counts, ["market", "skill"], "left")
        .withColumn("jobs", jobs)
        .select(
            "market", "skill", "jobs", "total",
            F.round(F.col("jobs") * 100.0 / F.col("total"), 2).alias("pct"),
            low.alias("ci_low"), high.alias("ci_high"),
            (F.col("total") < SMALL).alias("small_sample"),
        )
    )


def demand_gaps(grid: DataFrame, focal: str) -> DataFrame:
    """Focal market against every other: gap in points, unpooled 95 % interval, pooled z-test, flags.

    Both shares zero give no test (z 0, p 1). The evidence is ``insufficient``
    where either sample is small.
    """
    own = grid.filter(F.col("market") == focal).select(
        "skill", F.col("jobs").cast("double").alias("x1"), F.col("total").cast("double").alias("n1")
    )
    other = grid.filter(F.col("market") != focal).select(
        "market", "skill", F.col("jobs").cast("double").alias("x2"), F.col("total").cast("double").alias("n2")
    )
    p1, p2 = F.col("x1") / F.col("n1"), F.col("x2") / F.col("n2")
    pool = (F.col("x1") + F.col("x2")) / (F.col("n1") + F.col("n2"))
    spread = F.sqrt(p1 * (1 - p1) / F.col("n1") + p2 * (1 - p2) / F.col("n2"))
    pooled = F.sqrt(pool * (1 - pool) * (1 / F.col("n1") + 1 / F.col("n2")))
    z = F.when(pooled > 0, (p1 - p2) / pooled).otherwise(0.0)
    return other.join(own, "skill").select(
        "market",
        "skill",
        F.round((p1 - p2) * 100, 2).alias("gap"),
        F.round((p1 - p2 - Z95 * spread) * 100, 2).alias("gap_low"),
        F.round((p1 - p2 + Z95 * spread) * 100, 2).alias("gap_high"),
        F.round(z, 4).alias("z"),
        F.round(F.when(pooled > 0, erfc(F.abs(z) / F.sqrt(F.lit(2.0)))).otherwise(1.0), 4).alias("p_value"),
        ((F.col("x1") == 0) | (F.col("x2") == 0)).alias("zero_count"),
        F.when((F.col("n1") < SMALL) | (F.col("n2") < SMALL), "insufficient").otherwise("usable").alias("evidence"),
    )


def role_distribution(jobs: DataFrame) -> DataFrame:
    """``(market, role, jobs, pct)``: share of each role in its market."""
    counts = jobs.filter(F.col("market").isNotNull()).groupBy("market", "role").agg(F.count("*").alias("jobs"))
    total = F.sum("jobs").over(W.partitionBy("market"))
    return counts.withColumn("pct", F.round(F.col("jobs") * 100.0 / total, 2))


def unclassified_summary(jobs: DataFrame, label: str = "unclassified") -> DataFrame:
    """``(market, jobs, unclassified, pct)``."""
    return (
        jobs.filter(F.col("market").isNotNull())
        .groupBy("market")
        .agg(F.count("*").alias("jobs"), F.count_if(F.col("role") == label).alias("unclassified"))
        .withColumn("pct", F.round(F.col("unclassified") * 100.0 / F.col("jobs"), 2))
    )


def role_skill_demand(facts: DataFrame, least: int = 3) -> DataFrame:
    """``(market, role, skill, jobs, total, pct)`` of groups with ``least`` jobs or more."""
    totals = facts.groupBy("market", "role").agg(F.countDistinct("job_id").alias("total")).filter(F.col("total") >= least)
    counts = facts.groupBy("market", "role", "skill").agg(F.countDistinct("job_id").alias("jobs"))
    return counts.join(totals, ["market", "role"]).withColumn("pct", F.round(F.col("jobs") * 100.0 / F.col("total"), 2))


def monthly(amount: Column, period: Column) -> Column:
    """A monthly amount: a year is 12 months, a month 160 hours or 20 days; null for other periods."""
    return F.round(
        F.when(period == "monthly", amount)
        .when(period == "annual", amount / 12)
        .when(period == "hourly", amount * 160)
        .when(period == "daily", amount * 20),
        2,
    )


def salary_summary(salaries: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Spread of ``amount`` by ``keys``: n, quartiles (linear), range, mean, sample deviation (0 for one value)."""
    q = F.percentile("amount", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        salaries.filter(F.col("amount").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            q.alias("_q"),
            F.round(F.min("amount"), 2).alias("low"),
            F.round(F.max("amount"), 2).alias("high"),
            F.round(F.avg("amount"), 2).alias("mean"),
            F.round(F.coalesce(F.stddev_samp("amount"), F.lit(0.0)), 2).alias("deviation"),
        )
        .filter(F.col("n") >= least)
        .select(
            *keys, "n", F.round(F.col("_q")[0], 2).alias("p25"), F.round(F.col("_q")[1], 2).alias("median"),
            F.round(F.col("_q")[2], 2).alias("p75"), F.round(F.col("_q")[2] - F.col("_q")[0], 2).alias("iqr"),
            "low", "high", "mean", "deviation",
        )
    )


def disclosure(jobs: DataFrame) -> DataFrame:
    """``(market, jobs, disclosed, pct)``."""
    return (
        jobs.filter(F.col("market").isNotNull())
        .groupBy("market")
        .agg(F.count("*").alias("jobs"), F.count_if(F.col("salary_disclosed") == 1).alias("disclosed"))
        .withColumn("pct", F.round(F.col("disclosed") * 100.0 / F.col("jobs"), 2))
    )


def profile_similarity(grid: DataFrame, top: int = 10) -> DataFrame:
    """Every pair of markets: cosine of demand shares, Jaccard of the top skills, Spearman of ranks."""
    share = F.col("jobs") / F.col("total")
    w = W.partitionBy("market").orderBy(F.desc("_s"))
    ties = F.count("*").over(W.partitionBy("market", "_s"))
    ranked = grid.withColumn("_s", share).select(
        "market", "skill", "_s",
        average_rank(F.rank().over(w), ties).alias("_r"),
        (F.row_number().over(W.partitionBy("market").orderBy(F.desc("_s"), "skill")) <= top).cast("int").alias("_t"),
    )
    a = ranked.select(F.col("market").alias("market_a"), "skill", F.col("_s").alias("sa"), F.col("_r").alias("ra"), F.col("_t").alias("ta"))
    b = ranked.select(F.col("market").alias("market_b"), "skill", F.col("_s").alias("sb"), F.col("_r").alias("rb"), F.col("_t").alias("tb"))
    pairs = a.join(b, "skill").filter(F.col("market_a") < F.col("market_b"))
    norm = F.sqrt(F.sum(F.col("sa") * F.col("sa"))) * F.sqrt(F.sum(F.col("sb") * F.col("sb")))
    shared = F.sum(F.col("ta") * F.col("tb"))
    n = F.count("*").cast("double")
    cov = F.sum(F.col("ra") * F.col("rb")) - F.sum("ra") * F.sum("rb") / n
    va = F.sum(F.col("ra") * F.col("ra")) - F.sum("ra") * F.sum("ra") / n
    vb = F.sum(F.col("rb") * F.col("rb")) - F.sum("rb") * F.sum("rb") / n
    return pairs.groupBy("market_a", "market_b").agg(
        F.round(F.when(norm > 0, F.sum(F.col("sa") * F.col("sb")) / norm).otherwise(0.0), 4).alias("cosine"),
        F.round(shared / (F.sum("ta") + F.sum("tb") - shared), 4).alias("top_jaccard"),
        F.round(F.when((va > 1e-9) & (vb > 1e-9), cov / F.sqrt(va * vb)), 4).alias("spearman"),
    )


def first_failure(df: DataFrame, rules: list[tuple[str, Column]], out: str = "reason") -> DataFrame:
    """Add the name of the first rule that a row fails, ``eligible`` where it passes all; null counts as failing."""
    reason = reduce(
        lambda c, rule: c.when(~F.coalesce(rule[1], F.lit(False)), rule[0]),
        rules[1:],
        F.when(~F.coalesce(rules[0][1], F.lit(False)), rules[0][0]),
    )
    return df.withColumn(out, reason.otherwise("eligible"))


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """``(stage, position, rows, pct)``: rows that pass each stage by itself, in one scan."""
    total = F.count(F.lit(1))
    counts = df.agg(total.alias("all"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"s{k}") for k, (_, c) in enumerate(stages)))
    rows = F.array(
        F.struct(F.lit("all").alias("stage"), F.lit(0).alias("position"), F.col("all").alias("rows")),
        *(
            F.struct(F.lit(name).alias("stage"), F.lit(k + 1).alias("position"), F.col(f"s{k}").alias("rows"))
            for k, (name, _) in enumerate(stages)
        ),
    )
    pct = F.when(F.col("all") > 0, F.round(F.col("_r.rows") * 100.0 / F.col("all"), 2)).otherwise(0.0)
    return counts.select("all", F.explode(rows).alias("_r")).select("_r.stage", "_r.position", "_r.rows", pct.alias("pct"))


def sensitivity(facts: DataFrame, scenarios: dict[str, Column]) -> DataFrame:
    """Per scenario: jobs kept, mean and largest shift of demand shares against ``baseline``, and the top five skills.

    ``facts`` is ``(job_id, skill, ...)`` with the columns that the scenarios test.
    """
    flagged = facts.select("job_id", "skill", F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in scenarios.items())).alias("_n"))
    long = flagged.select("job_id", "skill", F.explode(F.array_compact("_n")).alias("scenario"))
    totals = long.groupBy("scenario").agg(F.countDistinct("job_id").alias("jobs"))
    shares = (
        long.groupBy("scenario", "skill")
        .agg(F.countDistinct("job_id").alias("n"))
        .join(totals, "scenario")
        .select("scenario", "skill", (F.col("n") * 100.0 / F.col("jobs")).alias("pct"))
    )
    names = F.array(*map(F.lit, scenarios))
    base = shares.filter(F.col("scenario") == "baseline").select("skill", F.col("pct").alias("base"))
    grid = base.select("skill", "base", F.explode(names).alias("scenario"))
    shift = (
        grid.join(shares, ["scenario", "skill"], "left")
        .withColumn("_d", F.abs(F.coalesce("pct", F.lit(0.0)) - F.col("base")))
        .groupBy("scenario")
        .agg(F.round(F.avg("_d"), 2).alias("mean_shift"), F.round(F.max("_d"), 2).alias("largest_shift"))
    )
    order = W.partitionBy("scenario").orderBy(F.desc("pct"), "skill")
    top = (
        shares.withColumn("_k", F.row_number().over(order))
        .filter(F.col("_k") <= 5)
        .groupBy("scenario")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "skill"))), lambda x: x["skill"]), ", ").alias("top_skills"))
    )
    return shift.join(totals, "scenario", "left").join(top, "scenario", "left").select(
        "scenario", F.coalesce("jobs", F.lit(0)).cast("long").alias("jobs"), "mean_shift", "largest_shift", "top_skills"
    )
