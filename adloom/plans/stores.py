"""Queries on integrated datasets, stores, scopes and small columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.functions import text as tx
from adloom.operators import datasets, store
from adloom.plans.registry import Catalogue
from adloom.session import table

catalogue = Catalogue()
_URL = r"nullif(regexp_replace(regexp_replace(lower(trim({c})), '#.*$', ''), '/+$', ''), '')"


@catalogue.add(
    "job_skill_lists",
    """WITH x AS (SELECT e.job_id, coalesce(s.canonical_name, e.skill_name) AS n, contains(lower(method), 'semantic') AND NOT contains(lower(method), 'lexical') AS sem, original_span, run_id
      FROM extracted_skills e LEFT JOIN skills s ON s.skill_id = e.canonical_skill_id),
    l AS (SELECT job_id, list_sort(list_distinct(list(n) FILTER (NOT coalesce(sem, false)))) AS a, list_sort(list_distinct(list(n) FILTER (sem))) AS b, count(DISTINCT original_span) AS spans, min(run_id) AS batch FROM x GROUP BY 1)
    SELECT j.job_id, coalesce(job_title, '') AS title, coalesce(country, '') AS country, CASE WHEN a IS NULL OR len(a) = 0 THEN '[]' ELSE '["' || array_to_string(a, '","') || '"]' END AS lexical_skills,
      CASE WHEN b IS NULL OR len(b) = 0 THEN '[]' ELSE '["' || array_to_string(b, '","') || '"]' END AS semantic_skills, spans, batch FROM jobs j JOIN l ON l.job_id = j.job_id""",
)
def job_skill_lists(spark, sf_dir):
    return datasets.skill_lists(*(table(spark, sf_dir, t) for t in ("jobs", "extracted_skills", "skills")))


def _both_sources(spark, sf_dir):
    jobs = table(spark, sf_dir, "jobs").select("job_id", "source_url", F.col("job_title").alias("title"), F.col("country"))
    raw = table(spark, sf_dir, "extraction_results").select("job_id", "source_url", F.col("job_title_raw").alias("title"), F.col("country_raw").alias("country")).distinct()
    return datasets.harmonised(jobs, raw)


@catalogue.add(
    "harmonised_adverts",
    f"""SELECT job_id, source_url, job_title AS title, country, 'reviewed' AS origin FROM jobs UNION ALL
    SELECT *, 'predicted' FROM (SELECT DISTINCT job_id, source_url, job_title_raw, country_raw FROM extraction_results) r
    WHERE {_URL.format(c='r.source_url')} IS NULL OR {_URL.format(c='r.source_url')} NOT IN (SELECT {_URL.format(c='source_url')} FROM jobs WHERE {_URL.format(c='source_url')} IS NOT NULL)""",
)
def harmonised_adverts(spark, sf_dir):
    return _both_sources(spark, sf_dir)


_LV = """lv AS (SELECT DISTINCT job_id, version_id, lower(trim(content_hash)) AS h, epoch_us(CAST(observed_at AS TIMESTAMPTZ)) AS t FROM job_versions WHERE trim(content_hash) <> ''),
    la AS (SELECT job_id, arg_max(h, (t, version_id)) AS content_hash, count(*) AS n FROM lv GROUP BY 1)"""


@catalogue.add(
    "new_versions",
    f"""WITH {_LV} SELECT la.job_id, la.content_hash, CAST(la.n + 1 AS BIGINT) AS version_no FROM la LEFT JOIN jobs j ON j.job_id = la.job_id
    WHERE j.job_id IS NULL OR lower(j.content_hash) IS DISTINCT FROM la.content_hash""",
)
def new_versions(spark, sf_dir):
    last = store.latest_versions(table(spark, sf_dir, "job_versions"))
    existing = table(spark, sf_dir, "jobs").select("job_id", "content_hash")
    history = last.select("job_id", F.col("versions").alias("version_no"))
    return store.version_rows(existing, last.select("job_id", "content_hash"), history, "job_id", "content_hash")


@catalogue.add(
    "merged_skills",
    """WITH i AS (SELECT canonical_skill_id AS skill_id, max(lower(skill_name)) AS canonical_name FROM extracted_skills WHERE canonical_skill_id % 2 = 0 GROUP BY 1)
    SELECT coalesce(i.skill_id, s.skill_id) AS skill_id, CASE WHEN i.skill_id IS NOT NULL THEN i.canonical_name ELSE s.canonical_name END AS canonical_name FROM skills s FULL JOIN i ON i.skill_id = s.skill_id""",
)
def merged_skills(spark, sf_dir):
    """A delivery of other spellings for the even skill ids, merged into the list."""
    m = table(spark, sf_dir, "extracted_skills").filter(F.col("canonical_skill_id") % 2 == 0)
    incoming = m.select(F.col("canonical_skill_id").alias("skill_id"), F.lower("skill_name").alias("canonical_name"))
    return store.merged(table(spark, sf_dir, "skills").select("skill_id", "canonical_name"), incoming, "skill_id")


@catalogue.add(
    "latest_runs",
    "SELECT run_id, run_type, (started_at, run_id) = (SELECT max((q.started_at, q.run_id)) FROM extraction_runs q WHERE q.run_type = r.run_type) AS is_latest FROM extraction_runs r",
)
def latest_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "extraction_runs").select("run_id", "run_type", "started_at")
    return store.latest_flags(runs, "run_type", ["started_at", "run_id"]).drop("started_at")


@catalogue.add(
    "batch_manifest",
    """SELECT collection_batch_id, count(*) AS rows, count(*) FILTER (extraction_status = 'success') AS succeeded, count(*) FILTER (coalesce(extraction_status = 'failed', true)) AS failed,
      CAST(min(TRY_CAST(scraped_at AS TIMESTAMPTZ)) AS TIMESTAMP) AS began, CAST(max(TRY_CAST(scraped_at AS TIMESTAMPTZ)) AS TIMESTAMP) AS ended FROM extraction_results GROUP BY 1""",
)
def batch_manifest(spark, sf_dir):
    done = store.manifest(table(spark, sf_dir, "extraction_results"), "collection_batch_id", "extraction_status")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("began", "ended")})


@catalogue.add(
    "failure_log",
    "SELECT DISTINCT job_id, collection_batch_id, extraction_status FROM extraction_results WHERE NOT coalesce(extraction_status IN ('success', 'partial'), false)",
)
def failure_log(spark, sf_dir):
    _, failed = store.split_failures(table(spark, sf_dir, "extraction_results"), "extraction_status")
    return failed.select("job_id", "collection_batch_id", "extraction_status").distinct()


@catalogue.add(
    "collection_metrics",
    """SELECT extractor_name, count(*) AS rows, count(DISTINCT source_hostname) AS hosts, count(*) FILTER (extraction_status = 'success') AS succeeded,
      round(count(*) FILTER (extraction_status = 'success') * 100.0::DOUBLE / count(*), 2) AS success_pct, count(DISTINCT job_id) AS jobs FROM extraction_results GROUP BY 1""",
)
def collection_metrics(spark, sf_dir):
    good = F.count_if(F.col("extraction_status") == "success")
    return table(spark, sf_dir, "extraction_results").groupBy("extractor_name").agg(
        F.count("*").alias("rows"), F.countDistinct("source_hostname").alias("hosts"), good.alias("succeeded"),
        F.round(good * 100.0 / F.count("*"), 2).alias("success_pct"), F.countDistinct("job_id").alias("jobs"),
    )


@catalogue.add("platform_counts", "SELECT source_platform, count(*) AS jobs, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM jobs), 2) AS pct FROM jobs GROUP BY 1")
def platform_counts(spark, sf_dir):
    jobs = table(spark, sf_dir, "jobs")
    total = jobs.agg(F.count("*")).scalar()
    return jobs.groupBy("source_platform").agg(F.count("*").alias("jobs")).withColumn("pct", F.round(F.col("jobs") * 100.0 / total, 2))


@catalogue.add(
    "category_sums",
    "SELECT coalesce(category, 'unmapped') AS category, count(*) AS mentions, count(DISTINCT e.canonical_skill_id) AS skills FROM extracted_skills e LEFT JOIN skills s ON s.skill_id = e.canonical_skill_id GROUP BY 1",
)
def category_sums(spark, sf_dir):
    dim = table(spark, sf_dir, "skills").select(F.col("skill_id").alias("canonical_skill_id"), "category")
    named = table(spark, sf_dir, "extracted_skills").join(dim, "canonical_skill_id", "left")
    return named.groupBy(F.coalesce("category", F.lit("unmapped")).alias("category")).agg(F.count("*").alias("mentions"), F.countDistinct("canonical_skill_id").alias("skills"))


@catalogue.add(
    "scoped_jobs",
    "SELECT source_platform, count(*) AS jobs FROM jobs WHERE trim(country) = 'Singapore' AND trim(work_mode) = 'hybrid' GROUP BY 1",
)
def scoped_jobs(spark, sf_dir):
    own = datasets.in_scope(table(spark, sf_dir, "jobs"), country="Singapore", work_mode="hybrid", source_platform=datasets.ALL, classification_status=None)
    return own.groupBy("source_platform").agg(F.count("*").alias("jobs"))


@catalogue.add(
    "filter_choices",
    """SELECT DISTINCT * FROM (SELECT unnest(['country', 'source_platform', 'work_mode', 'classification_status']) AS column,
      unnest([trim(country), trim(source_platform), trim(work_mode), trim(classification_status)]) AS value FROM jobs) WHERE value <> ''""",
)
def filter_choices(spark, sf_dir):
    return datasets.choices(table(spark, sf_dir, "jobs"), "country", "source_platform", "work_mode", "classification_status")


@catalogue.add("with_any_text", "SELECT job_id FROM jobs WHERE coalesce(trim(job_title) <> '', false) OR coalesce(trim(job_description) <> '', false) OR coalesce(trim(requirements) <> '', false)")
def with_any_text(spark, sf_dir):
    return table(spark, sf_dir, "jobs").filter(datasets.any_text("job_title", "job_description", "requirements")).select("job_id")


@catalogue.add(
    "image_adverts",
    r"""SELECT DISTINCT job_id FROM extraction_results WHERE coalesce(contains(lower(description_type), 'image'), false)
      OR coalesce(regexp_matches(lower(job_description_raw), '<img[^>]*>') AND trim(regexp_replace(job_description_raw, '<[^>]*>', '', 'g')) = '', false)""",
)
def image_adverts(spark, sf_dir):
    raw = table(spark, sf_dir, "extraction_results")
    return raw.filter(datasets.is_image_advert(F.col("description_type"), F.lit(None).cast("string"), F.col("job_description_raw"))).select("job_id").distinct()


@catalogue.add(
    "url_lists",
    r"""SELECT job_id, regexp_matches(source_url, '^https?://[^/\s]+') AS valid, '["' || source_url || '"]' AS urls FROM jobs WHERE source_url IS NOT NULL""",
)
def url_lists(spark, sf_dir):
    urls = F.to_json(F.array("source_url"), {"ignoreNullFields": "false"})
    jobs = table(spark, sf_dir, "jobs").filter(F.col("source_url").isNotNull())
    return jobs.select("job_id", datasets.valid_url_list(urls).alias("valid"), urls.alias("urls"))


@catalogue.add(
    "provenance_json",
    """SELECT job_id, '{"description_source":"' || CASE WHEN trim(job_description) <> '' THEN 'html_text' ELSE 'none' END || '","source":"' || source_hostname || '"}' AS provenance FROM jobs WHERE source_hostname IS NOT NULL""",
)
def provenance_json(spark, sf_dir):
    jobs = table(spark, sf_dir, "jobs").filter(F.col("source_hostname").isNotNull())
    was = F.to_json(F.struct(F.lit("old").alias("description_source"), F.col("source_hostname").alias("source")))
    now = F.when(F.coalesce(F.trim("job_description") != "", F.lit(False)), "html_text").otherwise("none")
    return jobs.select("job_id", datasets.json_updated(was, description_source=now).alias("provenance"))


@catalogue.add(
    "overridden_status",
    """SELECT job_id, CASE WHEN work_mode = 'remote' THEN 'it' ELSE classification_status END AS status, CASE WHEN work_mode = 'remote' THEN 'Manual Override' END AS reason FROM jobs""",
)
def overridden_status(spark, sf_dir):
    told = F.when(F.col("work_mode") == "remote", F.lit('{"new_status": "it"}')).when(F.col("work_mode") == "hybrid", F.lit('{"new_status": ""}')).otherwise(F.lit("not json"))
    status, reason = datasets.override(told, F.col("classification_status"))
    return table(spark, sf_dir, "jobs").select("job_id", status.alias("status"), reason.alias("reason"))


@catalogue.add(
    "known_before_runs",
    """SELECT run_id, (SELECT count(*) FROM jobs WHERE TRY_CAST(first_seen_at AS TIMESTAMPTZ) <= TRY_CAST(started_at AS TIMESTAMPTZ)) AS jobs FROM extraction_runs""",
)
def known_before_runs(spark, sf_dir):
    return datasets.known_before(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "extraction_runs"))


_GRID = """d AS (SELECT DISTINCT e.job_id, j.country AS market, s.canonical_name AS skill FROM extracted_skills e JOIN jobs j ON j.job_id = e.job_id JOIN skills s ON s.skill_id = e.canonical_skill_id WHERE j.country IS NOT NULL),
    g AS (SELECT market, skill, count(*) AS jobs FROM d GROUP BY 1, 2)"""


def _grid(spark, sf_dir):
    jobs = table(spark, sf_dir, "jobs").filter(F.col("country").isNotNull()).select("job_id", F.col("country").alias("market"))
    dim = table(spark, sf_dir, "skills").select(F.col("skill_id").alias("canonical_skill_id"), F.col("canonical_name").alias("skill"))
    m = table(spark, sf_dir, "extracted_skills").join(dim, "canonical_skill_id").join(jobs, "job_id").select("job_id", "market", "skill").distinct()
    return m.groupBy("market", "skill").agg(F.count("*").alias("jobs"))


def _focal(name: str, focal: str) -> None:
    sql = f"""WITH {_GRID}, t AS (SELECT skill, sum(CASE WHEN market = '{focal}' THEN jobs ELSE 0 END) AS own, sum(jobs) AS every FROM g GROUP BY 1),
    k AS (SELECT skill FROM t ORDER BY CASE WHEN (SELECT max(own) FROM t) > 0 THEN own ELSE every END DESC, skill LIMIT 10)
    SELECT market, skill, jobs FROM g WHERE skill IN (SELECT skill FROM k)"""
    catalogue.add(name, sql)(lambda spark, sf_dir: datasets.top_by_focal(_grid(spark, sf_dir), focal, 10))


_focal("focal_top_skills", "Singapore")
_focal("focal_fallback_skills", "Atlantis")


@catalogue.add(
    "trend_agreement",
    """WITH m AS (SELECT DISTINCT e.job_id, e.method, s.canonical_name AS skill FROM extracted_skills e JOIN skills s ON s.skill_id = e.canonical_skill_id),
    c AS (SELECT method, skill, count(*) AS n FROM m GROUP BY 1, 2), l AS (SELECT method, skill, CASE WHEN n >= 20 THEN 'frequent' WHEN n >= 5 THEN 'usual' ELSE 'rare' END AS label FROM c),
    b AS (SELECT x.label AS a, y.label AS b FROM l x JOIN l y ON x.skill = y.skill WHERE x.method = 'lexical' AND y.method = 'semantic')
    SELECT count(*) AS both, count(*) FILTER (a = b) AS same, round(CAST(count(*) FILTER (a = b) AS DOUBLE) / count(*), 4) AS share FROM b""",
)
def trend_agreement(spark, sf_dir):
    dim = table(spark, sf_dir, "skills").select(F.col("skill_id").alias("canonical_skill_id"), F.col("canonical_name").alias("skill"))
    m = table(spark, sf_dir, "extracted_skills").join(dim, "canonical_skill_id").select("job_id", "method", "skill").distinct()
    n = m.groupBy("method", "skill").agg(F.count("*").alias("n"))
    label = F.when(F.col("n") >= 20, "frequent").when(F.col("n") >= 5, "usual").otherwise("rare")
    named = n.select("method", "skill", label.alias("label"))
    return datasets.label_agreement(named.filter("method = 'lexical'"), named.filter("method = 'semantic'"), "skill", "label")


@catalogue.add(
    "market_verdicts",
    f"""WITH {_GRID}, t AS (SELECT sum(jobs) FILTER (market = 'Singapore') AS a, sum(jobs) FILTER (market <> 'Singapore') AS b FROM g),
    s AS (SELECT skill, CAST(coalesce(sum(jobs) FILTER (market = 'Singapore'), 0) AS DOUBLE) / (SELECT a FROM t) AS h, CAST(coalesce(sum(jobs) FILTER (market <> 'Singapore'), 0) AS DOUBLE) / (SELECT b FROM t) AS o FROM g GROUP BY 1)
    SELECT skill, CASE WHEN h = 0 THEN 'absent' WHEN o = 0 THEN 'only here' WHEN h / o >= 2 THEN 'much more common' WHEN h / o >= 1.2 THEN 'more common' WHEN h / o > 0.8 THEN 'about as common' ELSE 'less common' END AS verdict,
      CASE WHEN round(h * 1000, 6) >= 80 THEN 'Reliable' WHEN round(h * 1000, 6) >= 50 THEN 'Somewhat reliable' ELSE 'Unstable' END AS stability FROM s""",
)
def market_verdicts(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    here = F.when(F.col("market") == "Singapore", F.col("jobs")).otherwise(0)
    per = grid.groupBy("skill").agg(F.sum(here).alias("_a"), F.sum(F.col("jobs") - here).alias("_b"))
    total = per.agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    h, o = F.col("_a") / F.col("_ta"), F.col("_b") / F.col("_tb")
    # One row of totals.
    return per.join(total).select("skill", datasets.times_label(h, o).alias("verdict"), datasets.stability_label(F.round(h * 1000, 6)).alias("stability"))


@catalogue.add(
    "match_candidates",
    r"""SELECT job_id, len(list_filter(list_transform(regexp_split_to_array(job_description, '[.!?]+\s+|[\r\n]+|\s*[•·▪]\s*'), lambda x: trim(x)), lambda x: length(x) > 3)) AS parts FROM jobs WHERE job_description IS NOT NULL""",
)
def match_candidates(spark, sf_dir):
    jobs = table(spark, sf_dir, "jobs").filter(F.col("job_description").isNotNull())
    return jobs.select("job_id", F.size(datasets.candidates(F.col("job_description"))).alias("parts"))


_PATH = r"lower(regexp_replace(u.url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', ''))"


@catalogue.add(
    "url_classes",
    rf"""WITH u AS (SELECT source_url AS url FROM jobs UNION ALL SELECT source_url FROM extraction_results),
    h AS (SELECT u.*, r.source_hostname IS NOT NULL AS known FROM u LEFT JOIN ref_sources r ON r.source_hostname = nullif(lower(regexp_extract(trim(u.url), '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), ''))
    SELECT CASE WHEN NOT known THEN 'unsupported' WHEN regexp_matches({_PATH}, '/(?:job|jobs|advert|vacancy|stelle|kerja|position)s?/[^/?#]+') THEN 'detail'
      WHEN regexp_matches({_PATH}, '/(?:search|browse|jobs|vacancies|category|categories)(?:[/?#]|$)') THEN 'listing' ELSE 'other' END AS kind, count(*) AS n FROM h u GROUP BY 1""",
)
def url_classes(spark, sf_dir):
    urls = table(spark, sf_dir, "jobs").select(F.col("source_url").alias("url")).unionByName(table(spark, sf_dir, "extraction_results").select(F.col("source_url").alias("url")))
    hosts = table(spark, sf_dir, "ref_sources").select(F.col("source_hostname").alias("_h"), F.lit(True).alias("_known"))
    known = urls.withColumn("_h", tx.hostname(F.col("url"))).join(hosts, "_h", "left")
    return known.groupBy(datasets.url_class(F.col("url"), F.col("_known")).alias("kind")).agg(F.count("*").alias("n"))


@catalogue.add(
    "mentioned_jobs",
    "SELECT count(*) AS jobs FROM jobs WHERE job_id IN (SELECT job_id FROM extracted_skills)",
)
def mentioned_jobs(spark, sf_dir):
    m = table(spark, sf_dir, "extracted_skills").select("job_id")
    return table(spark, sf_dir, "jobs").join(m, "job_id", "left_semi").agg(F.count("*").alias("jobs"))


@catalogue.add(
    "batch_demand",
    """WITH b AS (SELECT CAST(date_trunc('month', TRY_CAST(posting_date AS DATE)) AS DATE) AS period, job_id, source_platform FROM jobs WHERE TRY_CAST(posting_date AS DATE) IS NOT NULL),
    t AS (SELECT period, count(DISTINCT job_id) AS all_jobs FROM b GROUP BY 1)
    SELECT b.period, canonical_skill_id AS skill_id, count(DISTINCT b.job_id) AS jobs, count(DISTINCT source_platform) AS sources, round(count(DISTINCT b.job_id) * 100.0::DOUBLE / any_value(all_jobs), 3) AS rate
    FROM b JOIN extracted_skills e ON e.job_id = b.job_id JOIN t ON t.period = b.period WHERE canonical_skill_id IS NOT NULL GROUP BY 1, 2""",
)
def batch_demand(spark, sf_dir):
    day = F.col("posting_date").try_cast("date")
    dated = table(spark, sf_dir, "jobs").filter(day.isNotNull()).select("job_id", "source_platform", F.trunc(day, "month").alias("period"))
    total = dated.groupBy("period").agg(F.countDistinct("job_id").alias("_all"))
    # Distinct facts are few beside the mentions, and everything after is a plain count of them.
    m = table(spark, sf_dir, "extracted_skills").filter(F.col("canonical_skill_id").isNotNull()).select("job_id", F.col("canonical_skill_id").alias("skill_id")).distinct()
    return dated.join(m, "job_id").join(total, "period").groupBy("period", "skill_id").agg(
        F.countDistinct("job_id").alias("jobs"), F.countDistinct("source_platform").alias("sources"),
        F.round(F.countDistinct("job_id") * 100.0 / F.first("_all"), 3).alias("rate"),
    )



