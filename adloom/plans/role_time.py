"""Queries on roles and on demand over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.functions.stats import ERFC_SQL
from adloom.operators import roles, temporal
from adloom.plans.baskets import mentions
from adloom.plans.markets import jobs_in_markets
from adloom.plans.registry import Catalogue
from adloom.plans.sqltext import FILLED, ROLE_FACTS, SERIES
from adloom.session import table

catalogue = Catalogue()


def role_facts(spark, sf_dir):
    """``(job_id, role, method, skill)`` with the method ``both`` added."""
    placed = jobs_in_markets(spark, sf_dir).select("job_id", "role")
    own = placed.join(mentions(spark, sf_dir), "job_id").select("job_id", "role", "method", "skill")
    return own.unionByName(roles.both_methods(own))


@catalogue.add(
    "role_skill_frequency",
    f"""WITH {ROLE_FACTS}, t AS (SELECT role, method, count(DISTINCT job_id) AS total FROM rf GROUP BY 1, 2)
    SELECT rf.role, rf.method, rf.skill, count(DISTINCT job_id) AS jobs, round(count(DISTINCT job_id) * 100.0::DOUBLE / t.total, 1) AS pct
    FROM rf JOIN t ON rf.role = t.role AND rf.method = t.method GROUP BY 1, 2, 3, t.total""",
)
def role_skill_frequency(spark, sf_dir):
    return roles.role_skill_frequency(role_facts(spark, sf_dir))


# The families of the title list, and what no title is in.
_ROLES = ["data", "dev", "qa", "ops", "lead", "sec", "design", "biz", "unclassified"]


def _matrix(name: str, method: str) -> None:
    total = " + ".join(_ROLES)
    sql = f"""WITH {ROLE_FACTS}, c AS (SELECT skill, {", ".join(f"count(DISTINCT CASE WHEN role = '{r}' THEN job_id END) AS {r}" for r in _ROLES)}
      FROM rf WHERE method = '{method}' GROUP BY 1)
    SELECT *, {total} AS total, row_number() OVER (ORDER BY {total} DESC, skill)::INTEGER AS position FROM c"""
    catalogue.add(name, sql)(lambda spark, sf_dir: roles.role_skill_matrix(role_facts(spark, sf_dir).filter(F.col("method") == method), _ROLES))


_matrix("role_skill_matrix", "lexical")
_matrix("role_skill_matrix_semantic", "semantic")
_matrix("role_skill_matrix_both", "both")


_TABLES = """nr AS (SELECT role, method, count(DISTINCT job_id) AS k FROM rf GROUP BY 1, 2), na AS (SELECT method, count(DISTINCT job_id) AS k FROM rf GROUP BY 1),
    ns AS (SELECT method, skill, count(DISTINCT job_id) AS k FROM rf GROUP BY 1, 2), ce AS (SELECT role, method, skill, count(DISTINCT job_id) AS a FROM rf GROUP BY 1, 2, 3),
    ct AS (SELECT ce.role, ce.method, ce.skill, a, nr.k - a AS b, ns.k - a AS c, na.k - nr.k - ns.k + a AS d FROM ce
      JOIN nr ON nr.role = ce.role AND nr.method = ce.method JOIN ns ON ns.method = ce.method AND ns.skill = ce.skill JOIN na ON na.method = ce.method)"""


@catalogue.add("role_contingency", f"WITH {ROLE_FACTS}, {_TABLES} SELECT * FROM ct")
def role_contingency(spark, sf_dir):
    return roles.contingency(role_facts(spark, sf_dir))


@catalogue.add(
    "role_chi_square",
    f"""WITH {ROLE_FACTS}, {_TABLES}, w AS (SELECT *, a + b + c + d AS n, (a + b)::DOUBLE * (c + d) * (a + c) * (b + d) AS mg,
      least((a + b)::DOUBLE * (a + c), (a + b)::DOUBLE * (b + d), (c + d)::DOUBLE * (a + c), (c + d)::DOUBLE * (b + d)) / (a + b + c + d) AS le FROM ct),
    x AS (SELECT *, CASE WHEN mg > 0 THEN n * greatest(abs(a::DOUBLE * d - b::DOUBLE * c) - n / 2.0::DOUBLE, 0.0) * greatest(abs(a::DOUBLE * d - b::DOUBLE * c) - n / 2.0::DOUBLE, 0.0) / mg END AS chi FROM w WHERE mg > 0 AND le >= 5)
    SELECT role, method, skill, round(chi, 6) AS chi2, round(least({ERFC_SQL.format(x="sqrt(chi / 2)")}, 1.0), 6) AS p_value FROM x""",
)
def role_chi_square(spark, sf_dir):
    tested = roles.distinctiveness(roles.contingency(role_facts(spark, sf_dir)))
    return tested.filter(F.col("test") == "chi_square").select("role", "method", "skill", "chi2", "p_value")


@catalogue.add("role_distinctiveness")
def role_distinctiveness(spark, sf_dir):
    return roles.distinctiveness(roles.contingency(role_facts(spark, sf_dir)))


@catalogue.add(
    "rank_divergence",
    f"""WITH {ROLE_FACTS}, c AS (SELECT role, skill, count(DISTINCT CASE WHEN method = 'lexical' THEN job_id END) AS x, count(DISTINCT CASE WHEN method = 'semantic' THEN job_id END) AS y
      FROM rf WHERE method IN ('lexical', 'semantic') GROUP BY 1, 2),
    r AS (SELECT role, rank() OVER (PARTITION BY role ORDER BY x DESC) + (count(*) OVER (PARTITION BY role, x) - 1) / 2.0::DOUBLE AS rx,
      rank() OVER (PARTITION BY role ORDER BY y DESC) + (count(*) OVER (PARTITION BY role, y) - 1) / 2.0::DOUBLE AS ry,
      CASE WHEN row_number() OVER (PARTITION BY role ORDER BY x DESC, skill) <= 10 THEN 1 ELSE 0 END AS tx,
      CASE WHEN row_number() OVER (PARTITION BY role ORDER BY y DESC, skill) <= 10 THEN 1 ELSE 0 END AS ty FROM c),
    u AS (SELECT role, count(*) AS skills, sum(rx * ry) - sum(rx) * sum(ry) / count(*) AS cv, sum(rx * rx) - sum(rx) * sum(rx) / count(*) AS vx,
      sum(ry * ry) - sum(ry) * sum(ry) / count(*) AS vy, sum(tx * ty)::BIGINT AS top_shared FROM r GROUP BY 1)
    SELECT role, skills, round(CASE WHEN vx > 1e-9 AND vy > 1e-9 THEN cv / sqrt(vx * vy) END, 4) AS spearman, top_shared FROM u""",
)
def rank_divergence(spark, sf_dir):
    return roles.rank_divergence(role_facts(spark, sf_dir))


@catalogue.add("role_bootstrap")
def role_bootstrap(spark, sf_dir):
    return roles.bootstrap_stability(role_facts(spark, sf_dir))


def dated_jobs(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("job_id", F.to_date(F.try_to_timestamp("posting_date")).alias("day"))


def series(spark, sf_dir, unit="MONTH"):
    return temporal.demand_series(dated_jobs(spark, sf_dir), mentions(spark, sf_dir), unit)


def filled(spark, sf_dir):
    return temporal.with_zero_periods(series(spark, sf_dir), dated_jobs(spark, sf_dir))


@catalogue.add("demand_series", f"WITH {SERIES} SELECT * FROM s")
def demand_series(spark, sf_dir):
    return series(spark, sf_dir)


@catalogue.add("demand_by_quarter", f"WITH {SERIES.replace(chr(39) + 'month' + chr(39), chr(39) + 'quarter' + chr(39))} SELECT * FROM s")
def demand_by_quarter(spark, sf_dir):
    return series(spark, sf_dir, "QUARTER")


@catalogue.add("demand_zero_filled", f"WITH {FILLED} SELECT * FROM z")
def demand_zero_filled(spark, sf_dir):
    return filled(spark, sf_dir)


@catalogue.add(
    "trend_table",
    f"""WITH {FILLED}, t AS (SELECT skill, count(*) AS periods, avg(CASE WHEN back <= 3 THEN rate END) AS nw, avg(CASE WHEN back > 3 THEN rate END) AS th,
      coalesce(CASE WHEN count(*) > 1 THEN regr_slope(rate, i) END, 0.0) AS sl, sqrt(count(*) * sum(CAST(round(rate * 10000) AS BIGINT) * CAST(round(rate * 10000) AS BIGINT)) - sum(CAST(round(rate * 10000) AS BIGINT)) * sum(CAST(round(rate * 10000) AS BIGINT))) / count(*) / 10000 AS dv, avg(rate) AS mn,
      avg(CASE WHEN back <= 3 AND d IS NOT NULL THEN CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0.0 END END) AS rs, sum(CASE WHEN back > 3 THEN jobs ELSE 0 END) AS bf FROM x GROUP BY 1),
    c AS (SELECT *, round(nw - coalesce(th, 0.0), 4) AS ch, round(sl, 6) AS s6 FROM t)
    SELECT skill, periods, round(nw, 4) AS recent_rate, round(th, 4) AS earlier_rate, ch AS change, s6 AS slope, round(dv, 4) AS volatility,
      round(coalesce(rs, 0.0), 4) AS rise_share,
      CASE WHEN periods < 4 THEN 'insufficient' WHEN bf = 0 THEN 'emerging' WHEN ch > 0.5 AND s6 > 0 THEN 'rising' WHEN ch < -0.5 AND s6 < 0 THEN 'falling'
           WHEN round(dv, 6) > round(mn / 2, 6) THEN 'volatile' ELSE 'stable' END AS trend FROM c""",
)
def trend_table(spark, sf_dir):
    return temporal.trend_table(filled(spark, sf_dir))


@catalogue.add(
    "demand_forecasts",
    f"""WITH {FILLED}, t AS (SELECT skill, count(*) AS n, max(CASE WHEN back = 1 THEN rate END) AS l, avg(CASE WHEN back <= 3 THEN rate END) AS a3,
      coalesce(regr_slope(rate, i), 0.0) AS b, coalesce(regr_intercept(rate, i), avg(rate)) AS a FROM x GROUP BY 1 HAVING count(*) >= 8)
    SELECT skill, step::INTEGER AS step, round(greatest(least(l, 100.0), 0.0), 4) AS last_value, round(greatest(least(a3, 100.0), 0.0), 4) AS mean_3,
      round(greatest(least(a + b * (n - 1 + step), 100.0), 0.0), 4) AS linear FROM t, (SELECT unnest([1, 2, 3]) AS step)""",
)
def demand_forecasts(spark, sf_dir):
    return temporal.forecasts(filled(spark, sf_dir))


_ROLLING = f"""{FILLED}, xr AS (SELECT skill, period, i, CAST(round(rate * 10000) AS BIGINT) AS r FROM x),
    k AS (SELECT *, lag(r) OVER w AS lv, sum(r) OVER (PARTITION BY skill ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3,
      count(*) OVER b AS n, sum(i) OVER b AS si, sum(i * i) OVER b AS sii, sum(r) OVER b AS sr, sum(i * r) OVER b AS sir FROM xr
      WINDOW w AS (PARTITION BY skill ORDER BY period), b AS (PARTITION BY skill ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    h AS (SELECT *, CAST(n * sir - si * sr AS DOUBLE) / CAST(n * sii - si * si AS DOUBLE) AS bb FROM k WHERE n >= 4),
    o AS (SELECT skill, r, lv AS prev, unnest(['last_value', 'mean_3', 'linear']) AS model,
      unnest([CAST(lv AS BIGINT), CAST((m3 * 2 + 3) // 6 AS BIGINT),
        greatest(CAST(round((CAST(sr AS DOUBLE) - bb * CAST(si AS DOUBLE)) / n + bb * i) AS BIGINT), 0)]) AS fc FROM h),
    sc AS (SELECT skill, model, count(*) AS n, CAST((sum(abs(fc - r)) * 2 + count(*)) // (count(*) * 2) AS DOUBLE) / 10000 AS mae,
      round(sqrt(CAST(sum((fc - r) * (fc - r)) AS DOUBLE) / count(*)) / 10000, 4) AS rmse,
      CAST((sum(CASE WHEN sign(fc - prev) = sign(r - prev) THEN 10000 ELSE 0 END) * 2 + count(*)) // (count(*) * 2) AS DOUBLE) / 10000 AS direction
      FROM o GROUP BY 1, 2)"""


@catalogue.add("rolling_origin", f"WITH {_ROLLING} SELECT * FROM sc")
def rolling_origin(spark, sf_dir):
    return temporal.rolling_origin(filled(spark, sf_dir))


@catalogue.add("best_models", f"WITH {_ROLLING} SELECT skill, arg_min(model, (mae, model)) AS model, min(mae) AS mae FROM sc GROUP BY 1")
def best_models(spark, sf_dir):
    return temporal.best_models(temporal.rolling_origin(filled(spark, sf_dir)))


@catalogue.add(
    "direction_bands",
    f"""WITH {FILLED}, t AS (SELECT skill, avg(CASE WHEN back <= 3 THEN rate END) AS nw, avg(CASE WHEN back BETWEEN 4 AND 6 THEN rate END) AS th FROM x GROUP BY 1)
    SELECT skill, CASE WHEN round(nw - th, 6) > 0.5 THEN 'higher' WHEN round(nw - th, 6) < -0.5 THEN 'lower' ELSE 'broadly similar' END AS direction
    FROM t WHERE th IS NOT NULL""",
)
def direction_bands(spark, sf_dir):
    return temporal.direction_bands(filled(spark, sf_dir))
