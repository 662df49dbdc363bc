"""Roles: skill frequency by role, distinctiveness tests, rank divergence, stability under resampling."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.functions.stats import average_rank, erfc, yates_chi2
from adloom.session import stored


def role_skill_frequency(facts: DataFrame) -> DataFrame:
    """``(role, method, skill, jobs, pct)``; the share is of the role's jobs with a skill by that method."""
    totals = facts.groupBy("role", "method").agg(F.countDistinct("job_id").alias("total"))
    counts = facts.groupBy("role", "method", "skill").agg(F.countDistinct("job_id").alias("jobs"))
    return counts.join(totals, ["role", "method"]).select(
        "role", "method", "skill", "jobs", F.round(F.col("jobs") * 100.0 / F.col("total"), 1).alias("pct")
    )


def both_methods(facts: DataFrame, methods: tuple[str, str] = ("lexical", "semantic")) -> DataFrame:
    """The facts that both methods give, as method ``both``."""
    two = facts.filter(F.col("method").isin(*methods)).groupBy("job_id", "role", "skill").agg(F.countDistinct("method").alias("_m"))
    return two.filter(F.col("_m") == 2).select("job_id", "role", F.lit("both").alias("method"), "skill")


def role_skill_matrix(facts: DataFrame, roles: list[str]) -> DataFrame:
    """Wide matrix of jobs: one row for each skill, one column for each role, with the row's total and position."""
    counts = facts.groupBy("skill").pivot("role", roles).agg(F.countDistinct("job_id"))
    filled = counts.na.fill(0, roles)
    total = sum((F.col(f"`{r}`") for r in roles[1:]), F.col(f"`{roles[0]}`"))
    return filled.withColumn("total", total).withColumn(
        "position", F.row_number().over(W.orderBy(F.desc("total"), "skill"))
    )


def contingency(facts: DataFrame) -> DataFrame:
    """2x2 tables by ``(role, skill, method)``: a in role with skill, b in role without, c and d outside."""
    # Four counts read the facts, which come from whole texts; they are worked out once.
    own = stored(facts.select("job_id", "role", "method", "skill").distinct())
    in_role = own.groupBy("role", "method").agg(F.countDistinct("job_id").alias("n_role"))
    everywhere = own.groupBy("method").agg(F.countDistinct("job_id").alias("n_all"))
    with_skill = own.groupBy("method", "skill").agg(F.countDistinct("job_id").alias("n_skill"))
    cell = own.groupBy("role", "method", "skill").agg(F.count("*").alias("a"))
    t = cell.join(in_role, ["role", "method"]).join(with_skill, ["method", "skill"]).join(everywhere, "method")
    return t.select(
        "role", "method", "skill", "a",
        (F.col("n_role") - F.col("a")).alias("b"),
        (F.col("n_skill") - F.col("a")).alias("c"),
        (F.col("n_all") - F.col("n_role") - F.col("n_skill") + F.col("a")).alias("d"),
    )


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p: the sum over all tables with these margins no likelier than the one seen."""
    row, col, n = a + b, a + c, a + b + c + d

    def log_choose(x: int, y: int) -> float:
        return math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)

    def log_p(x: int) -> float:
        return log_choose(row, x) + log_choose(n - row, col - x) - log_choose(n, col)

    seen = log_p(a) + math.log1p(1e-7)
    low, high = max(0, row + col - n), min(row, col)
    return min(1.0, math.fsum(math.exp(p) for x in range(low, high + 1) if (p := log_p(x)) <= seen))


def distinctiveness(tables: DataFrame, alpha: float = 0.05, within: tuple[str, ...] = ("role", "method")) -> DataFrame:
    """Chi-square with Yates' correction, or Fisher's exact test where an expected count is below 5.

    Over-represented significant skills are ranked ``within`` role and method by p,
    then chi-square, then name; the others have no rank. An empty margin gives no test.
    """
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    least = F.least((a + b) * (a + c), (a + b) * (b + d), (c + d) * (a + c), (c + d) * (b + d)) / n
    margins = ((a + b) > 0) & ((c + d) > 0) & ((a + c) > 0) & ((b + d) > 0)
    chi2 = yates_chi2(a, b, c, d)
    test = F.when(~margins, "none").when(least < 5, "fisher").otherwise("chi_square")

    @F.pandas_udf("double")
    def fisher(w: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([fisher_exact(*map(int, t)) for t in zip(w, x, y, z)])

    tested = tables.withColumns({"test": test, "chi2": F.round(chi2, 6)})
    # Only the tables that need the exact test go through Python.
    exact = tested.filter(F.col("test") == "fisher").withColumn("p_value", F.round(fisher("a", "b", "c", "d"), 6))
    plain = tested.filter(F.col("test") != "fisher").withColumn(
        "p_value", F.round(F.when(F.col("test") == "chi_square", F.least(erfc(F.sqrt(chi2 / 2)), F.lit(1.0))), 6)
    )
    odds = F.when(b * c > 0, F.round(a * d / (b * c), 4))
    over = F.coalesce((a / (a + b)) > F.when((c + d) > 0, c / (c + d)).otherwise(0.0), F.lit(False))
    scored = exact.unionByName(plain).withColumns({"odds_ratio": odds, "over": over})
    chosen = F.coalesce((F.col("p_value") < alpha) & F.col("over"), F.lit(False))
    order = W.partitionBy(*within, chosen).orderBy("p_value", F.desc("chi2"), "skill")
    return scored.withColumn("rank", F.when(chosen, F.row_number().over(order)))


def rank_divergence(facts: DataFrame, methods: tuple[str, str] = ("lexical", "semantic"), top: int = 10) -> DataFrame:
    """Per role: Spearman of skill ranks by two methods and the overlap of their top skills."""
    counts = facts.filter(F.col("method").isin(*methods)).groupBy("role", "skill").pivot("method", list(methods)).agg(F.countDistinct("job_id"))
    filled = counts.na.fill(0, list(methods))
    x, y = methods

    def rank(c: str):
        w = W.partitionBy("role").orderBy(F.desc(c))
        return average_rank(F.rank().over(w), F.count("*").over(W.partitionBy("role", c)))

    def best(c: str):
        return (F.row_number().over(W.partitionBy("role").orderBy(F.desc(c), "skill")) <= top).cast("int")

    r = filled.select("role", rank(x).alias("rx"), rank(y).alias("ry"), best(x).alias("tx"), best(y).alias("ty"))
    n = F.count("*").cast("double")
    cov = F.sum(F.col("rx") * F.col("ry")) - F.sum("rx") * F.sum("ry") / n
    vx = F.sum(F.col("rx") * F.col("rx")) - F.sum("rx") * F.sum("rx") / n
    vy = F.sum(F.col("ry") * F.col("ry")) - F.sum("ry") * F.sum("ry") / n
    return r.groupBy("role").agg(
        F.count("*").alias("skills"),
        F.round(F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy)), 4).alias("spearman"),
        F.sum(F.col("tx") * F.col("ty")).alias("top_shared"),
    )


def drawn_tables(facts: DataFrame, replicates: int, seed: int) -> DataFrame:
    """The 2x2 tables of :func:`contingency` for every replicate ``draw`` in which a skill is seen in the role.

    Every job gets a Poisson(1) weight for each replicate from a hash of its id,
    the replicate and the seed, so a replicate needs no gathering of the jobs.
    """
    u = (F.pmod(F.xxhash64("job_id", "draw", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    steps = [(k, sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(7)]
    weight = F.lit(7)
    for k, bound in reversed(steps):
        weight = F.when(u < bound, k).otherwise(weight)

    def drawn(name: str, *by: str) -> DataFrame:
        jobs = facts.select("job_id", *by).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        return jobs.groupBy("draw", *by).agg(F.sum(weight).alias(name))

    # No table without the skill in the role can be over-represented.
    cell = drawn("a", "role", "method", "skill").filter(F.col("a") > 0)
    t = (
        cell.join(drawn("n_role", "role", "method"), ["draw", "role", "method"])
        .join(drawn("n_skill", "method", "skill"), ["draw", "method", "skill"])
        .join(drawn("n_all", "method"), ["draw", "method"])
    )
    return t.select(
        "draw", "role", "method", "skill", "a",
        (F.col("n_role") - F.col("a")).alias("b"),
        (F.col("n_skill") - F.col("a")).alias("c"),
        (F.col("n_all") - F.col("n_role") - F.col("n_skill") + F.col("a")).alias("d"),
    )


def bootstrap_stability(facts: DataFrame, replicates: int = 30, top: int = 5, seed: int = 42) -> DataFrame:
    """``(role, method, skill, hits, hit_rate)`` of the top distinctive skills of each role and method.

    A hit is a replicate of redrawn jobs in which the test, made again, has the
    skill among the top ones; skills without a hit have 0.
    """
    best = distinctiveness(contingency(facts)).filter(F.col("rank") <= top).select("role", "method", "skill")
    again = distinctiveness(drawn_tables(facts, replicates, seed), within=("draw", "role", "method"))
    hits = again.filter(F.col("rank") <= top).groupBy("role", "method", "skill").agg(F.count("*").alias("hits"))
    return (
        best.join(hits, ["role", "method", "skill"], "left")
        .withColumn("hits", F.coalesce("hits", F.lit(0)))
        .withColumn("hit_rate", F.round(F.col("hits") / float(replicates), 4))
    )
