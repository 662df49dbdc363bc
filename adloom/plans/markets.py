"""Queries that compare markets."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.functions.stats import ERFC_SQL
from adloom.operators import facts, regional
from adloom.plans.baskets import mentions
from adloom.plans.registry import Catalogue
from adloom.plans.sqltext import BASKETS, GRID, JOBS
from adloom.session import table

catalogue = Catalogue()
Z = "1.959963984540054"


def jobs_in_markets(spark, sf_dir):
    """Jobs with market and role."""
    jobs = facts.markets(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "ref_countries"))
    aliases = facts.role_aliases(table(spark, sf_dir, "ref_titles"))
    return jobs.withColumn("role", facts.role_of(F.col("job_title"), F.col("job_description"), aliases))


def market_facts(spark, sf_dir):
    skills = mentions(spark, sf_dir).select("job_id", "skill").distinct()
    placed = facts.markets(table(spark, sf_dir, "jobs").select("job_id", "country"), table(spark, sf_dir, "ref_countries"))
    return placed.filter(F.col("market").isNotNull()).select("job_id", "market").join(skills, "job_id")


def grid(spark, sf_dir):
    return regional.demand_grid(market_facts(spark, sf_dir))


_WILSON = """
  round(greatest(((jobs::DOUBLE / total) + {z} * {z} / (2 * total)) / (1 + {z} * {z} / total)
    - {z} * sqrt((jobs::DOUBLE / total) * (1 - jobs::DOUBLE / total) / total + {z} * {z} / (4 * total::DOUBLE * total)) / (1 + {z} * {z} / total), 0.0) * 100.0::DOUBLE, 2) AS ci_low,
  round(least(((jobs::DOUBLE / total) + {z} * {z} / (2 * total)) / (1 + {z} * {z} / total)
    + {z} * sqrt((jobs::DOUBLE / total) * (1 - jobs::DOUBLE / total) / total + {z} * {z} / (4 * total::DOUBLE * total)) / (1 + {z} * {z} / total), 1.0) * 100.0::DOUBLE, 2) AS ci_high"""


@catalogue.add(
    "demand_grid",
    f"""WITH {GRID} SELECT market, skill, jobs, total, round(jobs * 100.0::DOUBLE / total, 2) AS pct, {_WILSON.format(z=f"{Z}::DOUBLE")},
    total < 30 AS small_sample FROM g""",
)
def demand_grid(spark, sf_dir):
    return grid(spark, sf_dir)


@catalogue.add(
    "demand_gaps",
    f"""WITH {GRID}, o AS (
      SELECT y.market, y.skill, x.jobs::DOUBLE AS x1, x.total::DOUBLE AS n1, y.jobs::DOUBLE AS x2, y.total::DOUBLE AS n2,
             x.jobs::DOUBLE / x.total AS p1, y.jobs::DOUBLE / y.total AS p2, (x.jobs + y.jobs)::DOUBLE / (x.total + y.total) AS pool
      FROM g x JOIN g y ON x.skill = y.skill AND x.market = 'Sri Lanka' AND y.market <> 'Sri Lanka'),
    q AS (SELECT *, sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) AS se, sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2)) AS sp FROM o),
    w AS (SELECT *, CASE WHEN sp > 0 THEN (p1 - p2) / sp ELSE 0.0 END AS z FROM q)
    SELECT market, skill, round((p1 - p2) * 100, 2) AS gap, round((p1 - p2 - {Z}::DOUBLE * se) * 100, 2) AS gap_low,
      round((p1 - p2 + {Z}::DOUBLE * se) * 100, 2) AS gap_high, round(z, 4) AS z,
      round(CASE WHEN sp > 0 THEN {ERFC_SQL.format(x="abs(z) / sqrt(2.0)")} ELSE 1.0 END, 4) AS p_value,
      x1 = 0 OR x2 = 0 AS zero_count, CASE WHEN n1 < 30 OR n2 < 30 THEN 'insufficient' ELSE 'usable' END AS evidence FROM w""",
)
def demand_gaps(spark, sf_dir):
    return regional.demand_gaps(grid(spark, sf_dir), "Sri Lanka")


@catalogue.add(
    "role_distribution",
    f"""WITH {JOBS}, c AS (SELECT market, role, count(*) AS jobs FROM jm WHERE market IS NOT NULL GROUP BY 1, 2)
    SELECT market, role, jobs, round(jobs * 100.0::DOUBLE / sum(jobs) OVER (PARTITION BY market), 2) AS pct FROM c""",
)
def role_distribution(spark, sf_dir):
    return regional.role_distribution(jobs_in_markets(spark, sf_dir))


@catalogue.add(
    "unclassified_summary",
    f"""WITH {JOBS} SELECT market, count(*) AS jobs, count(*) FILTER (role = 'unclassified') AS unclassified,
      round(count(*) FILTER (role = 'unclassified') * 100.0::DOUBLE / count(*), 2) AS pct FROM jm WHERE market IS NOT NULL GROUP BY 1""",
)
def unclassified_summary(spark, sf_dir):
    return regional.unclassified_summary(jobs_in_markets(spark, sf_dir))


@catalogue.add(
    "role_skill_demand",
    f"""WITH {BASKETS}, {JOBS}, rf AS (SELECT jm.market, jm.role, b.job_id, b.skill FROM b JOIN jm ON b.job_id = jm.job_id WHERE market IS NOT NULL),
    t AS (SELECT market, role, count(DISTINCT job_id) AS total FROM rf GROUP BY 1, 2 HAVING count(DISTINCT job_id) >= 3)
    SELECT rf.market, rf.role, rf.skill, count(DISTINCT job_id) AS jobs, t.total, round(count(DISTINCT job_id) * 100.0::DOUBLE / t.total, 2) AS pct
    FROM rf JOIN t ON rf.market = t.market AND rf.role = t.role GROUP BY 1, 2, 3, 5""",
)
def role_skill_demand(spark, sf_dir):
    skills = mentions(spark, sf_dir).select("job_id", "skill").distinct()
    placed = jobs_in_markets(spark, sf_dir).filter(F.col("market").isNotNull()).select("job_id", "market", "role")
    return regional.role_skill_demand(placed.join(skills, "job_id"))


_SALARY = """sal AS (SELECT market, role, salary_currency_normalized AS currency, round(CASE salary_period_normalized
      WHEN 'monthly' THEN v WHEN 'annual' THEN v / 12 WHEN 'hourly' THEN v * 160 WHEN 'daily' THEN v * 20 END, 2) AS amount
    FROM (SELECT *, (coalesce(salary_min_normalized, salary_max_normalized) + coalesce(salary_max_normalized, salary_min_normalized)) / 2 AS v FROM jm
          WHERE market IS NOT NULL AND salary_currency_normalized IS NOT NULL))"""
_SPREAD = """count(*) AS n, round(quantile_cont(amount, 0.25), 2) AS p25, round(quantile_cont(amount, 0.5), 2) AS median, round(quantile_cont(amount, 0.75), 2) AS p75,
      round(quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25), 2) AS iqr, round(min(amount), 2) AS low, round(max(amount), 2) AS high,
      round(avg(amount), 2) AS mean, round(coalesce(stddev_samp(amount), 0.0), 2) AS deviation"""


def salaries(spark, sf_dir):
    """Monthly midpoints in the stated currency."""
    low, high = F.col("salary_min_normalized"), F.col("salary_max_normalized")
    middle = (F.coalesce(low, high) + F.coalesce(high, low)) / 2
    return (
        jobs_in_markets(spark, sf_dir)
        .filter(F.col("market").isNotNull() & F.col("salary_currency_normalized").isNotNull())
        .select(
            "market", "role", F.col("salary_currency_normalized").alias("currency"),
            regional.monthly(middle, F.col("salary_period_normalized")).alias("amount"),
        )
    )


@catalogue.add("salary_summary", f"WITH {JOBS}, {_SALARY} SELECT market, currency, {_SPREAD} FROM sal WHERE amount IS NOT NULL GROUP BY 1, 2")
def salary_summary(spark, sf_dir):
    return regional.salary_summary(salaries(spark, sf_dir), "market", "currency")


@catalogue.add(
    "salary_by_role",
    f"WITH {JOBS}, {_SALARY} SELECT market, currency, role, {_SPREAD} FROM sal WHERE amount IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3",
)
def salary_by_role(spark, sf_dir):
    return regional.salary_summary(salaries(spark, sf_dir), "market", "currency", "role", least=3)


@catalogue.add(
    "salary_disclosure",
    f"""WITH {JOBS} SELECT market, count(*) AS jobs, count(*) FILTER (salary_disclosed = 1) AS disclosed,
      round(count(*) FILTER (salary_disclosed = 1) * 100.0::DOUBLE / count(*), 2) AS pct FROM jm WHERE market IS NOT NULL GROUP BY 1""",
)
def salary_disclosure(spark, sf_dir):
    return regional.disclosure(jobs_in_markets(spark, sf_dir))


@catalogue.add(
    "profile_similarity",
    f"""WITH {GRID}, s AS (SELECT market, skill, jobs::DOUBLE / total AS s FROM g),
    r AS (SELECT *, rank() OVER (PARTITION BY market ORDER BY s DESC) + (count(*) OVER (PARTITION BY market, s) - 1) / 2.0::DOUBLE AS r,
      CASE WHEN row_number() OVER (PARTITION BY market ORDER BY s DESC, skill) <= 10 THEN 1 ELSE 0 END AS t FROM s),
    q AS (SELECT a.market AS market_a, b.market AS market_b, a.s AS sa, b.s AS sb, a.r AS ra, b.r AS rb, a.t AS ta, b.t AS tb
      FROM r a JOIN r b ON a.skill = b.skill AND a.market < b.market),
    u AS (SELECT market_a, market_b, sqrt(sum(sa * sa)) * sqrt(sum(sb * sb)) AS nm, sum(sa * sb) AS dot, sum(ta * tb)::DOUBLE AS sh, sum(ta) + sum(tb) AS tt,
      sum(ra * rb) - sum(ra) * sum(rb) / count(*) AS cv, sum(ra * ra) - sum(ra) * sum(ra) / count(*) AS va, sum(rb * rb) - sum(rb) * sum(rb) / count(*) AS vb FROM q GROUP BY 1, 2)
    SELECT market_a, market_b, round(CASE WHEN nm > 0 THEN dot / nm ELSE 0.0 END, 4) AS cosine, round(sh / (tt - sh), 4) AS top_jaccard,
      round(CASE WHEN va > 1e-9 AND vb > 1e-9 THEN cv / sqrt(va * vb) END, 4) AS spearman FROM u""",
)
def profile_similarity(spark, sf_dir):
    return regional.profile_similarity(grid(spark, sf_dir))


_RULES_SQL = """CASE WHEN market IS NULL THEN 'market' WHEN NOT coalesce(classification_status = 'it', false) THEN 'classification'
  WHEN role = 'unclassified' THEN 'role' WHEN job_id NOT IN (SELECT job_id FROM m) THEN 'skills'
  WHEN NOT coalesce(salary_disclosed = 1, false) THEN 'salary' ELSE 'eligible' END"""


def _judged(spark, sf_dir):
    with_skill = mentions(spark, sf_dir).select("job_id").distinct().withColumn("_has", F.lit(True))
    return jobs_in_markets(spark, sf_dir).join(with_skill, "job_id", "left")


def _rules():
    return [
        ("market", F.col("market").isNotNull()),
        ("classification", F.col("classification_status") == "it"),
        ("role", F.col("role") != "unclassified"),
        ("skills", F.col("_has")),
        ("salary", F.col("salary_disclosed") == 1),
    ]


@catalogue.add("eligibility_reasons", f"WITH {BASKETS}, {JOBS} SELECT {_RULES_SQL} AS reason, count(*) AS jobs FROM jm GROUP BY 1")
def eligibility_reasons(spark, sf_dir):
    return regional.first_failure(_judged(spark, sf_dir), _rules()).groupBy("reason").agg(F.count("*").alias("jobs"))


@catalogue.add(
    "eligibility_funnel",
    f"""WITH {BASKETS}, {JOBS}, c AS (SELECT count(*) AS a, count(*) FILTER (market IS NOT NULL) AS s1, count(*) FILTER (classification_status = 'it') AS s2,
      count(*) FILTER (role <> 'unclassified') AS s3, count(*) FILTER (job_id IN (SELECT job_id FROM m)) AS s4, count(*) FILTER (salary_disclosed = 1) AS s5 FROM jm)
    SELECT stage, position, rows, round(rows * 100.0::DOUBLE / a, 2) AS pct FROM (
      SELECT a, unnest(['all', 'market', 'classification', 'role', 'skills', 'salary']) AS stage, unnest([0, 1, 2, 3, 4, 5])::INTEGER AS position,
             unnest([a, s1, s2, s3, s4, s5]) AS rows FROM c)""",
)
def eligibility_funnel(spark, sf_dir):
    return regional.funnel(_judged(spark, sf_dir), _rules())


@catalogue.add(
    "sensitivity",
    f"""WITH {BASKETS}, {JOBS}, ft AS (SELECT b.job_id, b.skill, market, classification_status AS cs, salary_disclosed AS sd, role FROM b JOIN jm ON b.job_id = jm.job_id),
    l AS (SELECT 'baseline' AS scenario, job_id, skill FROM ft WHERE market IS NOT NULL
      UNION ALL SELECT 'it_only', job_id, skill FROM ft WHERE market IS NOT NULL AND cs = 'it'
      UNION ALL SELECT 'salary_only', job_id, skill FROM ft WHERE market IS NOT NULL AND sd = 1
      UNION ALL SELECT 'classified_only', job_id, skill FROM ft WHERE market IS NOT NULL AND role <> 'unclassified'
      UNION ALL SELECT 'any_market', job_id, skill FROM ft),
    t AS (SELECT scenario, count(DISTINCT job_id) AS jobs FROM l GROUP BY 1),
    sh AS (SELECT l.scenario, skill, count(DISTINCT job_id) * 100.0::DOUBLE / t.jobs AS pct FROM l JOIN t ON l.scenario = t.scenario GROUP BY 1, 2, t.jobs),
    gr AS (SELECT base.skill, base.pct AS base, u.scenario FROM (SELECT * FROM sh WHERE scenario = 'baseline') base,
      (SELECT unnest(['baseline', 'it_only', 'salary_only', 'classified_only', 'any_market']) AS scenario) u),
    d AS (SELECT gr.scenario, abs(coalesce(sh.pct, 0.0) - gr.base) AS d FROM gr LEFT JOIN sh ON sh.scenario = gr.scenario AND sh.skill = gr.skill),
    tp AS (SELECT scenario, string_agg(skill, ', ' ORDER BY k) AS top_skills FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY pct DESC, skill) AS k FROM sh) WHERE k <= 5 GROUP BY 1)
    SELECT d.scenario, coalesce(any_value(t.jobs), 0) AS jobs, round(avg(d), 2) AS mean_shift, round(max(d), 2) AS largest_shift, any_value(top_skills) AS top_skills
    FROM d LEFT JOIN t ON t.scenario = d.scenario LEFT JOIN tp ON tp.scenario = d.scenario GROUP BY 1""",
)
def sensitivity(spark, sf_dir):
    skills = mentions(spark, sf_dir).select("job_id", "skill").distinct()
    placed = jobs_in_markets(spark, sf_dir).select("job_id", "market", "classification_status", "salary_disclosed", "role")
    here = F.col("market").isNotNull()
    return regional.sensitivity(
        placed.join(skills, "job_id"),
        {
            "baseline": here,
            "it_only": here & (F.col("classification_status") == "it"),
            "salary_only": here & (F.col("salary_disclosed") == 1),
            "classified_only": here & (F.col("role") != "unclassified"),
            "any_market": F.lit(True),
        },
    )
