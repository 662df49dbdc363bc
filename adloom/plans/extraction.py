"""Queries on extraction, key figures, method comparison and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.functions.stats import average_rank
from adloom.operators import extract, pages, quality, temporal
from adloom.plans.baskets import mentions
from adloom.plans.registry import Catalogue
from adloom.plans.role_time import filled
from adloom.plans.sqltext import FILLED, MENTIONS
from adloom.session import table

catalogue = Catalogue()

_NAMES = """nm AS (SELECT lower(trim(n)) AS name, min(skill_id) AS skill_id FROM (SELECT skill_id, canonical_name AS n FROM skills
    UNION ALL SELECT skill_id, unnest(CAST(aliases_json AS JSON)::VARCHAR[]) FROM skills) GROUP BY 1)"""


# Words and signs are set apart by a mark, so that whole words are found by plain search.
_MARKED = "chr(1) || replace(regexp_replace({c}, '([^\\p{{L}}\\p{{N}}_])', chr(1) || '\\1' || chr(1), 'g'), chr(1) || chr(1), chr(1)) || chr(1)"
_LEXICAL = f"""jt AS MATERIALIZED (SELECT job_id, {_MARKED.format(c="lower(concat_ws(' ', job_title, job_description, requirements))")} AS t FROM jobs),
    mk AS MATERIALIZED (SELECT skill_id, {_MARKED.format(c='name')} AS name FROM nm),
    fx AS (SELECT DISTINCT job_id, CAST(skill_id AS BIGINT) AS skill_id FROM jt JOIN mk ON contains(t, name))"""


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("job_id", F.concat_ws(" ", "job_title", "job_description", "requirements").alias("text"))


@catalogue.add("lexical_skills", f"WITH {_NAMES}, {_LEXICAL} SELECT * FROM fx")
def lexical_skills(spark, sf_dir):
    return extract.lexical_skills(_texts(spark, sf_dir), table(spark, sf_dir, "skills"), "job_id", "text")


@catalogue.add(
    "extraction_run",
    f"""WITH {_NAMES}, {_LEXICAL} SELECT job_id, 'run_lexical_00' AS run_id, 'lexical' AS method, skill_id FROM fx x
    WHERE NOT EXISTS (SELECT 1 FROM extracted_skills e WHERE e.job_id = x.job_id AND e.run_id = 'run_lexical_00' AND e.method = 'lexical' AND e.canonical_skill_id = x.skill_id)""",
)
def extraction_run(spark, sf_dir):
    def lexical(texts, skills):
        return extract.lexical_skills(texts, skills, "job_id", "text")

    existing = table(spark, sf_dir, "extracted_skills").withColumnRenamed("canonical_skill_id", "skill_id")
    return extract.extraction_run(_texts(spark, sf_dir), table(spark, sf_dir, "skills"), {"lexical": lexical}, existing, "run_lexical_00")


@catalogue.add("page_fields")
def page_fields(spark, sf_dir):
    raw = table(spark, sf_dir, "extraction_results").select("job_id", "source_url", "job_description_raw").distinct()
    return pages.with_page_fields(raw, "source_url", "job_description_raw").select("job_id", "fields.*")


_HEAD = r"nullif(trim(regexp_replace(regexp_replace(regexp_extract(job_description_raw, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '')".replace("\\\\", "\\")


@catalogue.add("page_titles", f"SELECT DISTINCT job_id, {_HEAD} AS title FROM extraction_results WHERE trim(job_description_raw) <> '' AND {_HEAD} IS NOT NULL AND NOT contains({_HEAD}, '&')")
def page_titles(spark, sf_dir):
    raw = table(spark, sf_dir, "extraction_results").filter(F.trim("job_description_raw") != "").select("job_id", "source_url", "job_description_raw").distinct()
    named = raw.filter(F.col("job_description_raw").rlike(r"(?is)<h1\b[^>]*>.*?</h1\s*>"))
    read = pages.with_page_fields(named, "source_url", "job_description_raw", registry=(pages.GENERIC,))
    return read.filter(~F.col("fields.title").contains("&")).select("job_id", "fields.title").distinct()


_TITLE_CASE = "array_to_string(list_transform(string_split(lower(replace(trim({c}), '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@catalogue.add(
    "normalised_skills",
    f"""WITH {_NAMES}, bn AS (SELECT regexp_replace(name, '[^a-z0-9]', '', 'g') AS b, min(s.canonical_name) AS c FROM nm JOIN skills s ON s.skill_id = nm.skill_id GROUP BY 1),
    it AS (SELECT skill_name, count(*) AS n FROM (SELECT skill_name FROM extracted_skills UNION ALL SELECT work_mode FROM jobs UNION ALL SELECT title FROM ref_titles UNION ALL SELECT 'N/A') GROUP BY 1),
    sa AS (SELECT *, CASE WHEN lower(trim(skill_name)) NOT IN ('', 'nan', 'none', 'nat', 'null', 'undefined', 'n/a', '-') THEN trim(skill_name) END AS said FROM it)
    SELECT sa.skill_name, sa.n, CASE WHEN said IS NULL THEN NULL ELSE coalesce(s.canonical_name, bn.c, {_TITLE_CASE.format(c='said')}) END AS canonical,
      CASE WHEN said IS NULL THEN 'placeholder' WHEN s.canonical_name IS NOT NULL THEN 'alias' WHEN bn.c IS NOT NULL THEN 'alias_without_signs' ELSE 'title_case' END AS rule
    FROM sa LEFT JOIN nm ON nm.name = lower(said) LEFT JOIN skills s ON s.skill_id = nm.skill_id LEFT JOIN bn ON bn.b = regexp_replace(lower(said), '[^a-z0-9]', '', 'g')""",
)
def normalised_skills(spark, sf_dir):
    """Names as extracted, with work modes, titles and a placeholder, which no alias knows."""
    spoken = table(spark, sf_dir, "extracted_skills").select("skill_name")
    others = table(spark, sf_dir, "jobs").select("work_mode"), table(spark, sf_dir, "ref_titles").select("title"), spark.sql("SELECT 'N/A'")
    items = reduce(lambda a, b: a.union(b), others, spoken).groupBy("skill_name").agg(F.count("*").alias("n"))
    return extract.normalised_skills(items, table(spark, sf_dir, "skills"), "skill_name")


@catalogue.add("nearest_centroids")
def nearest_centroids(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return extract.nearest_centroids(vectors, extract.centroids(vectors, "label", "embedding"), "vec_id", "embedding")


@catalogue.add(
    "page_links",
    """SELECT DISTINCT job_id, href, CASE WHEN regexp_matches(lower(href), '/(?:job|jobs|vacanc|career|position|stellen|kerja)') THEN 10 ELSE 0 END
      + CASE WHEN regexp_matches(lower(href), '/[a-z\\-]*\\d{3,}') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(lower(href), '[?&](?:id|job|jobid|ref)=') THEN 8 ELSE 0 END
      + CASE WHEN len(string_split(regexp_replace(lower(href), '^[a-z]+://[^/]*', ''), '/')) > 3 THEN 2 ELSE 0 END AS score
    FROM (SELECT job_id, unnest(regexp_extract_all(job_description_raw, '<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"''#]+)', 1)) AS href FROM extraction_results)""",
)
def page_links(spark, sf_dir):
    return extract.links(table(spark, sf_dir, "extraction_results"), "job_id", "job_description_raw").select(
        "job_id", "href", extract.link_score(F.col("href")).alias("score")
    ).distinct()


@catalogue.add(
    "url_verdicts",
    """SELECT CASE WHEN NOT coalesce(regexp_matches(u, '^https?://'), false) THEN 'scheme' WHEN h = '' THEN 'host' WHEN contains(a, '@') THEN 'credentials'
      WHEN p NOT IN ('', '80', '443') THEN 'port' WHEN h = 'mixpost.example' OR h LIKE '%.mixpost.example' THEN 'blocked'
      WHEN regexp_matches(h, '^(?:localhost|127\\.|10\\.|192\\.168\\.|169\\.254\\.|0\\.)') THEN 'private' ELSE 'ok' END AS verdict, count(*) AS n
    FROM (SELECT u, a, regexp_replace(regexp_replace(a, '^.*@', ''), ':\\d+$', '') AS h, regexp_extract(a, ':(\\d+)$', 1) AS p
      FROM (SELECT lower(trim(source_url)) AS u, regexp_extract(lower(trim(source_url)), '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1) AS a FROM jobs)) GROUP BY 1""",
)
def url_verdicts(spark, sf_dir):
    verdict = extract.url_verdict(F.col("source_url"), ["mixpost.example"])
    return table(spark, sf_dir, "jobs").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@catalogue.add("requirement_lines")
def requirement_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return docs.select("doc_id", extract.requirement_lines(F.col("text")).alias("lines")).filter(F.size("lines") > 0)


@catalogue.add(
    "key_figures",
    f"""WITH {MENTIONS} SELECT (SELECT count(*) FROM jobs) AS jobs, (SELECT count(DISTINCT nullif(trim(source_platform), '')) FROM jobs) AS sources,
      (SELECT count(DISTINCT nullif(trim(country), '')) FROM jobs) AS countries, (SELECT count(DISTINCT company_name) FROM jobs) AS companies,
      (SELECT count(DISTINCT skill) FROM m) AS skills, (SELECT count(DISTINCT job_id) FROM m) AS jobs_with_skill""",
)
def key_figures(spark, sf_dir):
    m = mentions(spark, sf_dir)
    jobs = table(spark, sf_dir, "jobs")
    skills, covered = m.agg(F.countDistinct("skill")).scalar(), m.agg(F.countDistinct("job_id")).scalar()

    def said(c):
        return F.countDistinct(F.nullif(F.trim(c), F.lit("")))

    return jobs.agg(
        F.count("*").alias("jobs"), said("source_platform").alias("sources"), said("country").alias("countries"), F.countDistinct("company_name").alias("companies")
    ).select("*", skills.alias("skills"), covered.alias("jobs_with_skill"))


@catalogue.add(
    "skill_board",
    """SELECT canonical_skill_id, count(DISTINCT job_id) AS jobs, count(*) AS mentions, round(avg(confidence), 4) AS confidence,
      round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM extracted_skills WHERE canonical_skill_id IS NOT NULL), 4) AS share FROM extracted_skills WHERE canonical_skill_id IS NOT NULL GROUP BY 1""",
)
def skill_board(spark, sf_dir):
    raw = table(spark, sf_dir, "extracted_skills").filter(F.col("canonical_skill_id").isNotNull())
    total = raw.agg(F.count("*").alias("n")).scalar()
    return raw.groupBy("canonical_skill_id").agg(
        F.countDistinct("job_id").alias("jobs"), F.count("*").alias("mentions"), F.round(F.avg("confidence"), 4).alias("confidence"),
    ).withColumn("share", F.round(F.col("mentions") * 100.0 / total, 4))


@catalogue.add(
    "source_cube",
    """SELECT source_platform, work_mode, classification_status, grouping_id(source_platform, work_mode, classification_status)::BIGINT AS level, count(*) AS jobs, count(DISTINCT company_name) AS firms
    FROM jobs GROUP BY CUBE (source_platform, work_mode, classification_status)""",
)
def source_cube(spark, sf_dir):
    keys = ("source_platform", "work_mode", "classification_status")
    return table(spark, sf_dir, "jobs").cube(*keys).agg(
        F.grouping_id(*keys).alias("level"), F.count("*").alias("jobs"), F.countDistinct("company_name").alias("firms")
    )


@catalogue.add(
    "method_rank_shift",
    f"""WITH {MENTIONS}, c AS (SELECT skill, count(DISTINCT CASE WHEN method = 'lexical' THEN job_id END) AS lexical, count(DISTINCT CASE WHEN method = 'semantic' THEN job_id END) AS semantic, count(DISTINCT job_id) AS combined FROM m GROUP BY 1)
    SELECT skill, lexical, semantic, combined, row_number() OVER (ORDER BY lexical DESC, skill)::INTEGER - row_number() OVER (ORDER BY semantic DESC, skill)::INTEGER AS shift FROM c""",
)
def method_rank_shift(spark, sf_dir):
    m = mentions(spark, sf_dir)

    def of(method):
        return F.countDistinct(F.when(F.col("method") == method, F.col("job_id")))

    c = m.groupBy("skill").agg(of("lexical").alias("lexical"), of("semantic").alias("semantic"), F.countDistinct("job_id").alias("combined"))
    # The vocabulary is a taxonomy's, so one window over it is small.
    x, y = (F.row_number().over(W.orderBy(F.desc(k), "skill")) for k in ("lexical", "semantic"))
    return c.withColumn("shift", x - y)


@catalogue.add(
    "method_agreement",
    f"""WITH {MENTIONS}, c AS (SELECT skill, count(DISTINCT CASE WHEN method = 'lexical' THEN job_id END) AS x, count(DISTINCT CASE WHEN method = 'semantic' THEN job_id END) AS y FROM m GROUP BY 1),
    r AS (SELECT *, rank() OVER (ORDER BY x DESC) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y DESC) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry,
      CASE WHEN row_number() OVER (ORDER BY x DESC, skill) <= 10 THEN 1 ELSE 0 END AS tx, CASE WHEN row_number() OVER (ORDER BY y DESC, skill) <= 10 THEN 1 ELSE 0 END AS ty FROM c)
    SELECT count(*) AS skills, round((sum(rx * ry) - sum(rx) * sum(ry) / count(*)) / sqrt((sum(rx * rx) - sum(rx) * sum(rx) / count(*)) * (sum(ry * ry) - sum(ry) * sum(ry) / count(*))), 4) AS spearman,
      round(sum(tx * ty)::DOUBLE / (sum(tx) + sum(ty) - sum(tx * ty)), 4) AS top_jaccard FROM r""",
)
def method_agreement(spark, sf_dir):
    c = method_rank_shift(spark, sf_dir)

    def rank(k):
        return average_rank(F.rank().over(W.orderBy(F.desc(k))), F.count("*").over(W.partitionBy(k)))

    def top(k):
        return (F.row_number().over(W.orderBy(F.desc(k), "skill")) <= 10).cast("int")

    r = c.select(rank("lexical").alias("rx"), rank("semantic").alias("ry"), top("lexical").alias("tx"), top("semantic").alias("ty"))
    n = F.count("*").cast("double")

    def s(a, b):
        return F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n

    shared = F.sum(F.col("tx") * F.col("ty"))
    return r.agg(
        F.count("*").alias("skills"),
        F.round(s("rx", "ry") / F.sqrt(s("rx", "rx") * s("ry", "ry")), 4).alias("spearman"),
        F.round(shared / (F.sum("tx") + F.sum("ty") - shared), 4).alias("top_jaccard"),
    )


@catalogue.add(
    "lag_features",
    f"""WITH {FILLED}, l AS (SELECT skill, period, rate, lag(rate, 1) OVER w AS lag_1, lag(rate, 2) OVER w AS lag_2, lag(rate, 3) OVER w AS lag_3 FROM z WINDOW w AS (PARTITION BY skill ORDER BY period))
    SELECT skill, period, rate, lag_1, lag_2, lag_3, round((lag_1 + lag_2 + lag_3) / 3, 6) AS mean_3 FROM l WHERE lag_3 IS NOT NULL""",
)
def lag_features(spark, sf_dir):
    return temporal.lag_features(filled(spark, sf_dir))


@catalogue.add("forest_forecast")
def forest_forecast(spark, sf_dir):
    return temporal.forest_forecast(filled(spark, sf_dir))


@catalogue.add("forest_origins")
def forest_origins(spark, sf_dir):
    return temporal.forest_origins(filled(spark, sf_dir))


@catalogue.add("source_sample")
def source_sample(spark, sf_dir):
    jobs = table(spark, sf_dir, "jobs").select("job_id", "source_platform", "job_title")
    return quality.sample_per_stratum(jobs, ["source_platform"], "job_id", 5)


@catalogue.add(
    "title_search",
    """SELECT job_id, job_title, company_name FROM jobs WHERE contains(lower(job_title), 'data') OR contains(lower(company_name), 'data')""",
)
def title_search(spark, sf_dir):
    jobs = table(spark, sf_dir, "jobs")
    hit = F.lower("job_title").contains("data") | F.lower("company_name").contains("data")
    return jobs.filter(hit).select("job_id", "job_title", "company_name")
