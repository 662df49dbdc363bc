"""Common table expressions that several SQL twins share."""

from __future__ import annotations

#: m: distinct (job_id, method, skill); names resolve missing ids.
MENTIONS = """
names AS (
  SELECT lower(trim(n)) AS name, min(skill_id) AS skill_id FROM (
    SELECT skill_id, canonical_name AS n FROM skills
    UNION ALL SELECT skill_id, unnest(CAST(aliases_json AS JSON)::VARCHAR[]) FROM skills) GROUP BY 1
), m AS (
  SELECT DISTINCT e.job_id, e.method, s.canonical_name AS skill
  FROM extracted_skills e LEFT JOIN names n ON e.canonical_skill_id IS NULL AND n.name = lower(trim(e.skill_name))
  JOIN skills s ON s.skill_id = coalesce(e.canonical_skill_id, n.skill_id)
)"""

#: b: distinct (job_id, skill); f: jobs by skill; n: jobs with a skill; p: pairs that occur; v: all pairs.
BASKETS = (
    MENTIONS
    + """, b AS (SELECT DISTINCT job_id, skill FROM m),
f AS (SELECT skill, count(*) AS jobs FROM b GROUP BY 1),
n AS (SELECT count(DISTINCT job_id) AS n FROM b),
p AS (SELECT x.skill AS skill_a, y.skill AS skill_b, count(*) AS jobs FROM b x JOIN b y ON x.job_id = y.job_id AND x.skill < y.skill GROUP BY 1, 2),
v AS (SELECT x.skill AS skill_a, y.skill AS skill_b, x.jobs AS jobs_a, y.jobs AS jobs_b FROM f x JOIN f y ON x.skill < y.skill)"""
)

#: jm: jobs with market and role.
JOBS = """
al AS (
  SELECT lower(title) AS alias, family AS role FROM ref_titles
  UNION SELECT lower(unnest(aliases)), family FROM ref_titles
), co AS (
  SELECT lower(trim(country)) AS k, country AS market FROM ref_countries
  UNION SELECT lower(trim(code)), country FROM ref_countries
), ro AS (
  SELECT job_id, arg_min(role, (-length(alias), alias, role)) AS role FROM jobs JOIN al ON contains(lower(job_title), alias) GROUP BY 1
), rd AS (
  SELECT job_id, arg_min(role, (-length(alias), alias, role)) AS role FROM jobs JOIN al ON contains(lower(job_description), alias) GROUP BY 1
), jm AS (
  SELECT jobs.*, co.market, coalesce(ro.role, rd.role, 'unclassified') AS role
  FROM jobs LEFT JOIN co ON lower(trim(jobs.country)) = co.k LEFT JOIN ro ON jobs.job_id = ro.job_id LEFT JOIN rd ON jobs.job_id = rd.job_id
)"""

#: g: the zero-filled demand grid of markets.
GRID = (
    BASKETS
    + ","
    + JOBS
    + """, mf AS (SELECT jm.market, b.job_id, b.skill FROM b JOIN jm ON b.job_id = jm.job_id WHERE jm.market IS NOT NULL),
mt AS (SELECT market, count(DISTINCT job_id) AS total FROM mf GROUP BY 1),
mc AS (SELECT market, skill, count(*) AS jobs FROM mf GROUP BY 1, 2),
g AS (
  SELECT mt.market, w.skill, coalesce(mc.jobs, 0) AS jobs, mt.total
  FROM mt CROSS JOIN (SELECT DISTINCT skill FROM mf) w LEFT JOIN mc ON mc.market = mt.market AND mc.skill = w.skill
)"""
)

#: rf: (job_id, role, method, skill) with the method 'both' added.
ROLE_FACTS = (
    MENTIONS
    + ","
    + JOBS
    + """, r1 AS (SELECT m.job_id, jm.role, m.method, m.skill FROM m JOIN jm ON m.job_id = jm.job_id),
rf AS (
  SELECT * FROM r1 UNION ALL
  SELECT job_id, role, 'both', skill FROM r1 GROUP BY 1, 2, 4 HAVING count(DISTINCT method) = 2
)"""
)

#: s: the monthly demand series; e: dated jobs by month.
SERIES = (
    MENTIONS
    + """, dj AS (SELECT job_id, CAST(date_trunc('month', TRY_CAST(posting_date AS DATE)) AS DATE) AS period FROM jobs WHERE TRY_CAST(posting_date AS DATE) IS NOT NULL),
e AS (SELECT period, count(DISTINCT job_id) AS eligible FROM dj GROUP BY 1),
s AS (
  SELECT dj.period, b.skill, count(DISTINCT dj.job_id) AS jobs, any_value(e.eligible) AS eligible,
         round(count(DISTINCT dj.job_id) * 100.0::DOUBLE / any_value(e.eligible), 4) AS rate
  FROM dj JOIN (SELECT DISTINCT job_id, skill FROM m) b ON dj.job_id = b.job_id JOIN e ON e.period = dj.period GROUP BY 1, 2
)"""
)

#: z: the series with zero periods; x: numbered.
FILLED = (
    SERIES
    + """, sp AS (SELECT skill, min(period) AS a, max(period) AS b FROM s GROUP BY 1),
z AS (
  SELECT e.period, sp.skill, coalesce(s.jobs, 0) AS jobs, e.eligible, round(coalesce(s.jobs, 0) * 100.0::DOUBLE / e.eligible, 4) AS rate
  FROM sp JOIN e ON e.period BETWEEN sp.a AND sp.b LEFT JOIN s ON s.skill = sp.skill AND s.period = e.period
), x AS (
  SELECT *, row_number() OVER (PARTITION BY skill ORDER BY period) - 1 AS i,
         row_number() OVER (PARTITION BY skill ORDER BY period DESC) AS back,
         rate - lag(rate) OVER (PARTITION BY skill ORDER BY period) AS d
  FROM z
)"""
)
