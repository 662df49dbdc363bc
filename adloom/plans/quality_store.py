"""Queries on evaluation, data quality, text functions, imports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.functions import text as tx
from adloom.operators import evaluate, quality, store
from adloom.plans.baskets import mentions
from adloom.plans.records import paragraphs_sql
from adloom.plans.registry import Catalogue
from adloom.plans.sqltext import MENTIONS
from adloom.session import table
from adloom.streaming import micro_batch as mb

catalogue = Catalogue()
FIELDS = {
    "title": ("job_title", "job_title_raw"),
    "company": ("company_name", "company_raw"),
    "location": ("location", "location_raw"),
    "country": ("country", "country_raw"),
}


def aligned(spark, sf_dir):
    """Adverts beside their raw record."""
    raw = table(spark, sf_dir, "extraction_results").select("job_id", "job_title_raw", "company_raw", "location_raw", "country_raw", "description_type").distinct()
    jobs = table(spark, sf_dir, "jobs").select("job_id", "job_title", "company_name", "location", "country", "source_platform")
    return jobs.join(raw, "job_id")


_PLAIN = "trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))"
_OUTCOMES = f"""al AS (SELECT DISTINCT job_id, job_title_raw, company_raw, location_raw, country_raw, description_type FROM extraction_results),
  pr AS (SELECT j.job_id, j.source_platform, al.description_type, unnest(['title', 'company', 'location', 'country']) AS field,
      unnest([nullif(trim(j.job_title), ''), nullif(trim(j.company_name), ''), nullif(trim(j.location), ''), nullif(trim(j.country), '')]) AS e,
      unnest([nullif(trim(job_title_raw), ''), nullif(trim(company_raw), ''), nullif(trim(location_raw), ''), nullif(trim(country_raw), '')]) AS g
    FROM jobs j JOIN al ON j.job_id = al.job_id),
  pw AS (SELECT *, list_distinct(string_split({_PLAIN.format(c="e")}, ' ')) AS we, list_distinct(string_split({_PLAIN.format(c="g")}, ' ')) AS wg FROM pr),
  oc AS (SELECT job_id, source_platform, description_type, field,
    CASE WHEN e IS NULL AND g IS NULL THEN 'both_missing' WHEN g IS NULL THEN 'missing' WHEN e IS NULL THEN 'extra' WHEN e = g THEN 'exact'
      WHEN {_PLAIN.format(c="e")} = {_PLAIN.format(c="g")} THEN 'normalised'
      WHEN len(list_intersect(we, wg))::DOUBLE / (len(we) + len(wg) - len(list_intersect(we, wg))) >= 0.8 THEN 'similar' ELSE 'wrong' END AS outcome FROM pw)"""
_GOOD = "outcome IN ('exact', 'normalised', 'similar')"
_ELIGIBLE = "outcome NOT IN ('both_missing', 'extra')"
_Z = "1.959963984540054::DOUBLE"


@catalogue.add("field_outcomes", f"WITH {_OUTCOMES} SELECT field, outcome, count(*) AS n FROM oc GROUP BY 1, 2")
def field_outcomes(spark, sf_dir):
    return evaluate.field_outcomes(aligned(spark, sf_dir), FIELDS, ("job_id",)).groupBy("field", "outcome").agg(F.count("*").alias("n"))


@catalogue.add(
    "field_metrics",
    f"""WITH {_OUTCOMES}, c AS (SELECT field, count(*) FILTER ({_ELIGIBLE}) AS eligible, count(*) FILTER ({_GOOD}) AS correct, count(*) FILTER (outcome = 'exact') AS exact,
      count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'extra') AS extra FROM oc GROUP BY 1),
    d AS (SELECT *, eligible::DOUBLE AS n, correct::DOUBLE / eligible AS p FROM c)
    SELECT field, eligible, correct, exact, missing, extra, round(correct::DOUBLE / eligible, 4) AS agreement,
      round(greatest((p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n), 0.0), 4) AS ci_low,
      round(least((p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n), 1.0), 4) AS ci_high FROM d""",
)
def field_metrics(spark, sf_dir):
    return evaluate.field_metrics(evaluate.field_outcomes(aligned(spark, sf_dir), FIELDS, ("job_id",)))


@catalogue.add(
    "stratified_agreement",
    f"""WITH {_OUTCOMES} SELECT CASE WHEN grouping(field) = 0 THEN 'field' WHEN grouping(source_platform) = 0 THEN 'source_platform' ELSE 'description_type' END AS stratum,
      CASE WHEN grouping(field) = 0 THEN field WHEN grouping(source_platform) = 0 THEN source_platform ELSE description_type END AS value,
      count(*) FILTER ({_ELIGIBLE}) AS eligible, count(*) FILTER ({_GOOD}) AS correct,
      CASE WHEN count(*) FILTER ({_ELIGIBLE}) > 0 THEN round(count(*) FILTER ({_GOOD})::DOUBLE / count(*) FILTER ({_ELIGIBLE}), 4) END AS share
    FROM oc GROUP BY GROUPING SETS ((field), (source_platform), (description_type))""",
)
def stratified_agreement(spark, sf_dir):
    outcomes = evaluate.field_outcomes(aligned(spark, sf_dir), FIELDS, ("source_platform", "description_type"))
    return evaluate.stratified(outcomes, ["field", "source_platform", "description_type"])


_PRF = """round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1"""
_SETS = f"""{MENTIONS}, ex AS (SELECT job_id, skill FROM m WHERE method = 'lexical'), go AS (SELECT job_id, skill FROM m WHERE method = 'semantic')"""


def _sides(spark, sf_dir):
    m = mentions(spark, sf_dir)
    return m.filter(F.col("method") == "lexical"), m.filter(F.col("method") == "semantic")


@catalogue.add(
    "set_scores",
    f"""WITH {_SETS}, c AS (SELECT (SELECT count(*) FROM ex JOIN go USING (job_id, skill)) AS tp, (SELECT count(*) FROM go) AS g, (SELECT count(*) FROM ex) AS e),
    d AS (SELECT tp, g - tp AS fp, e - tp AS fn FROM c) SELECT tp, fp, fn, {_PRF} FROM d""",
)
def set_scores(spark, sf_dir):
    return evaluate.set_scores(*_sides(spark, sf_dir), "job_id", "skill")


@catalogue.add(
    "label_scores",
    f"""WITH {_SETS}, u AS (SELECT coalesce(ex.skill, go.skill) AS skill, ex.job_id AS e, go.job_id AS g FROM ex FULL JOIN go ON ex.job_id = go.job_id AND ex.skill = go.skill),
    d AS (SELECT skill, count(*) FILTER (e IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (e IS NULL) AS fp, count(*) FILTER (g IS NULL) AS fn FROM u GROUP BY 1)
    SELECT skill, tp, fp, fn, {_PRF} FROM d""",
)
def label_scores(spark, sf_dir):
    return evaluate.label_scores(*_sides(spark, sf_dir), "job_id", "skill")


_THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
_SWEEP = f"""bs AS (SELECT job_id, canonical_skill_id AS k, max(confidence) AS s FROM extracted_skills WHERE method = 'semantic' AND canonical_skill_id IS NOT NULL GROUP BY 1, 2),
    exx AS (SELECT DISTINCT job_id, canonical_skill_id AS k FROM extracted_skills WHERE method = 'lexical' AND canonical_skill_id IS NOT NULL),
    fj AS (SELECT exx.job_id IS NOT NULL AS e, bs.s FROM exx FULL JOIN bs ON exx.job_id = bs.job_id AND exx.k = bs.k),
    sw AS (SELECT t.threshold, count(*) FILTER (coalesce(s >= threshold, false) AND e) AS tp, count(*) FILTER (coalesce(s >= threshold, false) AND NOT e) AS fp,
      count(*) FILTER (NOT coalesce(s >= threshold, false) AND e) AS fn FROM fj, (SELECT unnest({_THRESHOLDS})::DOUBLE AS threshold) t GROUP BY 1)"""


def _sweep(spark, sf_dir):
    raw = table(spark, sf_dir, "extracted_skills").filter(F.col("canonical_skill_id").isNotNull()).select("job_id", F.col("canonical_skill_id").alias("k"), "method", "confidence")
    return evaluate.threshold_sweep(
        raw.filter(F.col("method") == "semantic"), raw.filter(F.col("method") == "lexical"), _THRESHOLDS, ("job_id", "k"), "confidence"
    )


@catalogue.add("threshold_sweep", f"WITH {_SWEEP} SELECT threshold, tp, fp, fn, {_PRF} FROM sw")
def threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@catalogue.add(
    "best_threshold",
    f"WITH {_SWEEP}, q AS (SELECT threshold, {_PRF} FROM sw) SELECT threshold, f1, precision, recall FROM q ORDER BY f1 DESC, precision DESC, threshold LIMIT 1",
)
def best_threshold(spark, sf_dir):
    return evaluate.best_threshold(_sweep(spark, sf_dir))


_AS_OF = "2025-09-01"


@catalogue.add(
    "validation_report",
    f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (job_title IS NULL OR trim(job_title) = '') AS r0, count(*) FILTER (NOT regexp_matches(source_url, '^https?://[^/ ]+')) AS r1,
      count(*) FILTER (posting_date IS NOT NULL AND TRY_CAST(posting_date AS DATE) IS NULL) AS r2, count(*) FILTER (TRY_CAST(posting_date AS DATE) > DATE '{_AS_OF}') AS r3,
      count(*) FILTER (salary_min_normalized > salary_max_normalized) AS r4, count(*) FILTER (salary_disclosed = 0 AND salary_min_normalized IS NOT NULL) AS r5,
      count(*) FILTER (classification_status NOT IN ('it', 'non_it', 'ambiguous')) AS r6, count(*) FILTER (length(job_description) < 100) AS r7 FROM jobs)
    SELECT rule, violations, n AS rows, CASE WHEN violations = 0 THEN 'pass' ELSE severity END AS status FROM (SELECT n,
      unnest(['title', 'url', 'date', 'future', 'range', 'undisclosed', 'class', 'short']) AS rule, unnest([r0, r1, r2, r3, r4, r5, r6, r7]) AS violations,
      unnest(['fail', 'fail', 'fail', 'warning', 'fail', 'warning', 'fail', 'warning']) AS severity FROM c)""",
)
def validation_report(spark, sf_dir):
    day = F.to_date(F.try_to_timestamp("posting_date"))
    return quality.rule_report(
        table(spark, sf_dir, "jobs"),
        [
            ("title", F.col("job_title").isNull() | (F.trim("job_title") == ""), "fail"),
            ("url", ~F.col("source_url").rlike(r"^https?://[^/ ]+"), "fail"),
            ("date", F.col("posting_date").isNotNull() & day.isNull(), "fail"),
            ("future", day > F.lit(_AS_OF).cast("date"), "warning"),
            ("range", F.col("salary_min_normalized") > F.col("salary_max_normalized"), "fail"),
            ("undisclosed", (F.col("salary_disclosed") == 0) & F.col("salary_min_normalized").isNotNull(), "warning"),
            ("class", ~F.col("classification_status").isin("it", "non_it", "ambiguous"), "fail"),
            ("short", F.length("job_description") < 100, "warning"),
        ],
    )


_CHECKED = ["country", "posting_date", "job_description", "requirements", "salary_text_raw", "work_mode"]


@catalogue.add(
    "missing_report",
    "WITH c AS (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS m{k}" for k, c in enumerate(_CHECKED)) + " FROM jobs) "
    f"""SELECT "column", missing, round(missing * 100.0::DOUBLE / n, 2) AS pct FROM (SELECT n, unnest({_CHECKED}) AS "column", unnest([{", ".join(f"m{k}" for k in range(len(_CHECKED)))}]) AS missing FROM c)""",
)
def missing_report(spark, sf_dir):
    return quality.missing_report(table(spark, sf_dir, "jobs"), _CHECKED)


@catalogue.add(
    "duplicate_counts",
    """SELECT 'job_id' AS key, coalesce(sum(n - 1), 0)::BIGINT AS duplicates, count(*) AS groups FROM (SELECT count(*) AS n FROM extraction_results WHERE job_id IS NOT NULL GROUP BY job_id HAVING count(*) > 1)
    UNION ALL SELECT 'text', coalesce(sum(n - 1), 0)::BIGINT, count(*) FROM (SELECT count(*) AS n FROM extraction_results WHERE job_description_raw IS NOT NULL GROUP BY sha256(job_description_raw) HAVING count(*) > 1)""",
)
def duplicate_counts(spark, sf_dir):
    raw = table(spark, sf_dir, "extraction_results")
    return quality.duplicate_counts(raw, {"job_id": F.col("job_id"), "text": F.sha2("job_description_raw", 256)})


@catalogue.add(
    "deduplicated_records",
    """SELECT job_id, collection_batch_id, extraction_status FROM extraction_results
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY CASE extraction_status WHEN 'success' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, collection_batch_id DESC) = 1""",
)
def deduplicated_records(spark, sf_dir):
    raw = table(spark, sf_dir, "extraction_results").select("job_id", "collection_batch_id", "extraction_status")
    rank = F.when(F.col("extraction_status") == "success", 0).when(F.col("extraction_status") == "partial", 1).otherwise(2)
    newest = -F.regexp_extract("collection_batch_id", r"(\d+)$", 1).cast("long")
    return quality.keep_first(raw, F.col("job_id"), [rank, newest])


@catalogue.add(
    "duplicate_flags",
    """SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) > 1 AND text IS NOT NULL AS repeated,
      text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY md5(text)) AS later FROM documents""",
)
def duplicate_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("_h"))
    return quality.duplicate_flags(docs, "_h", "doc_id").select("doc_id", "repeated", "later")


@catalogue.add(
    "failure_classes",
    """SELECT origin, kind, kind IN ('network', 'incomplete', 'unknown') AS again, count(*) AS n FROM (SELECT origin, CASE WHEN contains(s, 'network') OR contains(t, 'timeout') THEN 'network'
      WHEN contains(s, 'blocked') OR contains(t, 'captcha') OR contains(t, 'forbidden') THEN 'blocked' WHEN contains(s, 'parse') OR contains(t, 'parse') THEN 'parsing'
      WHEN contains(s, 'partial') THEN 'incomplete' WHEN s IN ('success', 'ok', 'completed') THEN 'none' ELSE 'unknown' END AS kind
      FROM (SELECT 'record' AS origin, lower(coalesce(extraction_status, '')) AS s, lower(coalesce(description_type, '') || ' ' || coalesce(job_description_raw, '')) AS t FROM extraction_results
        UNION ALL SELECT 'import', lower(coalesce(status, '')), lower(coalesce(notes, '')) FROM import_runs)) GROUP BY 1, 2, 3""",
)
def failure_classes(spark, sf_dir):
    said = F.concat(F.coalesce("description_type", F.lit("")), F.lit(" "), F.coalesce("job_description_raw", F.lit("")))
    raw = table(spark, sf_dir, "extraction_results").select(F.lit("record").alias("origin"), F.col("extraction_status").alias("s"), said.alias("t"))
    runs = table(spark, sf_dir, "import_runs").select(F.lit("import").alias("origin"), F.col("status").alias("s"), F.col("notes").alias("t"))
    kinds = raw.unionByName(runs).select("origin", quality.failure_class(F.col("s"), F.col("t")).alias("kind"))
    return kinds.groupBy("origin", "kind", quality.retryable(F.col("kind")).alias("again")).agg(F.count("*").alias("n"))


_STRONG = ["engineer", "developer", "architect", "analyst", "administrator", "tester", "devops", "programmer"]
_WEAK = ["software", "data", "code", "systems", "cloud"]
_EXCLUDED = ["chef", "cook", "driver", "nurse", "teacher", "sales", "civil"]


@catalogue.add(
    "relevance_scores",
    f"""WITH {MENTIONS}, k AS (SELECT job_id, count(DISTINCT skill) AS n FROM m GROUP BY 1),
    h AS (SELECT j.job_id, coalesce(regexp_matches(lower(job_title), '\\b(?:{"|".join(_STRONG)})\\b'), false) AS s, coalesce(regexp_matches(lower(job_description), '\\b(?:{"|".join(_WEAK)})\\b'), false) AS w,
      coalesce(regexp_matches(lower(job_title), '\\b(?:{"|".join(_EXCLUDED)})\\b'), false) AS x, coalesce(k.n, 0) AS n FROM jobs j LEFT JOIN k ON k.job_id = j.job_id),
    c AS (SELECT job_id, round(CASE WHEN x AND NOT s THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN s THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN w THEN 0.1::DOUBLE ELSE 0 END + least(n, 5) * 0.08::DOUBLE) END, 4) AS score FROM h)
    SELECT job_id, score, CASE WHEN score >= 0.40 THEN 'it' WHEN score >= 0.15 THEN 'ambiguous' ELSE 'non_it' END AS label FROM c""",
)
def relevance_scores(spark, sf_dir):
    counts = mentions(spark, sf_dir).groupBy("job_id").agg(F.countDistinct("skill").alias("_n"))
    jobs = table(spark, sf_dir, "jobs").select("job_id", "job_title", "job_description").join(counts, "job_id", "left")
    score, label = quality.relevance(F.col("job_title"), F.col("job_description"), F.col("_n"), _STRONG, _WEAK, _EXCLUDED)
    return jobs.select("job_id", score.alias("score"), label.alias("label"))


@catalogue.add(
    "text_profile",
    """SELECT description_type, count(*) AS rows, count(t) AS with_text, round(count(t) * 100.0::DOUBLE / count(*), 2) AS yield_pct, min(length(t)) AS shortest, max(length(t)) AS longest,
      round(avg(length(t)), 2) AS mean, round(quantile_cont(length(t), 0.5), 2) AS median,
      round(coalesce(sum(length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))) * 100.0::DOUBLE / sum(length(t)), 0.0), 4) AS non_ascii_pct
    FROM (SELECT description_type, nullif(trim(job_description_raw), '') AS t FROM extraction_results) GROUP BY 1""",
)
def text_profile(spark, sf_dir):
    return quality.text_profile(table(spark, sf_dir, "extraction_results"), "job_description_raw", "description_type")


_UNESCAPED = "regexp_replace({c}, '<[^>]*>', ' ', 'g')"
for _entity, _char in tx.ENTITIES.items():
    _char = _char.replace("'", "''")
    _UNESCAPED = f"replace({_UNESCAPED}, '{_entity}', '{_char}')"


@catalogue.add(
    "clean_html",
    f"SELECT DISTINCT job_id, trim(regexp_replace({_UNESCAPED.format(c='job_description_raw')}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS plain FROM extraction_results WHERE job_description_raw IS NOT NULL",
)
def clean_html(spark, sf_dir):
    raw = table(spark, sf_dir, "extraction_results").filter(F.col("job_description_raw").isNotNull())
    return raw.select("job_id", tx.clean_html(F.col("job_description_raw")).alias("plain")).distinct()


@catalogue.add("page_paragraphs", f"SELECT DISTINCT job_id, {paragraphs_sql('job_description_raw')} AS lines FROM extraction_results WHERE job_description_raw IS NOT NULL")
def page_paragraphs(spark, sf_dir):
    raw = table(spark, sf_dir, "extraction_results").filter(F.col("job_description_raw").isNotNull())
    return raw.select("job_id", tx.paragraphs(F.col("job_description_raw")).alias("lines")).distinct()


@catalogue.add(
    "source_keys",
    """SELECT job_id, regexp_replace(regexp_replace(lower(trim(source_url)), '#.*$', ''), '/+$', '') AS url,
      nullif(lower(regexp_extract(trim(source_url), '^[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '') AS host,
      source_hostname || '_hash_' || substr(sha256(regexp_replace(regexp_replace(lower(trim(source_url)), '#.*$', ''), '/+$', '')), 1, 16) AS hash_id FROM jobs""",
)
def source_keys(spark, sf_dir):
    url = F.col("source_url")
    nothing = F.lit(None).cast("string")
    return table(spark, sf_dir, "jobs").select(
        "job_id", tx.canonical_url(url).alias("url"), tx.hostname(url).alias("host"), tx.stable_id(F.col("source_hostname"), nothing, url).alias("hash_id")
    )


@catalogue.add(
    "title_similarity",
    f"""WITH q AS (SELECT DISTINCT j.job_id, list_filter(list_distinct(string_split({_PLAIN.format(c="job_title")}, ' ')), lambda w: w <> '') AS x,
      list_filter(list_distinct(string_split({_PLAIN.format(c="job_title_raw")}, ' ')), lambda w: w <> '') AS y FROM jobs j JOIN extraction_results e ON j.job_id = e.job_id)
    SELECT DISTINCT job_id, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) ELSE 0.0 END, 6) AS similarity FROM q""",
)
def title_similarity(spark, sf_dir):
    return aligned(spark, sf_dir).select("job_id", F.round(tx.word_jaccard(F.col("job_title"), F.col("job_title_raw")), 6).alias("similarity")).distinct()


@catalogue.add(
    "record_hashes",
    "SELECT job_id, sha256(coalesce(job_title, '') || chr(31) || coalesce(company_name, '') || chr(31) || coalesce(location, '')) AS hash FROM jobs",
)
def record_hashes(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("job_id", tx.content_hash(F.col("job_title"), F.col("company_name"), F.col("location")).alias("hash"))


@catalogue.add("term_snippets")
def term_snippets(spark, sf_dir):
    jobs = table(spark, sf_dir, "jobs").filter(F.col("job_description").isNotNull())
    return jobs.select("job_id", tx.snippet(F.col("job_description"), "Corvid SQL").alias("snippet"))


_HYBRID, _REMOTE, _SITE = r"\bhybrid\b", r"\b(?:remote|work from home|home based|telecommute)\b", r"\bon-?site\b|\bin office\b"


def _mode_sql(c):
    h, r, s = (f"regexp_matches({c}, '{p}')" for p in (_HYBRID, _REMOTE, _SITE))
    return f"CASE WHEN {h} THEN 'hybrid' WHEN {r} AND {s} THEN 'unspecified' WHEN {r} THEN 'remote' WHEN {s} THEN 'on_site' END"


@catalogue.add(
    "work_modes",
    f"SELECT job_id, coalesce({_mode_sql('h')}, {_mode_sql('d')}, 'unspecified') AS mode FROM (SELECT job_id, lower(concat_ws(' ', job_title, location)) AS h, lower(job_description) AS d FROM jobs)",
)
def work_modes(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("job_id", tx.work_mode(F.col("job_title"), F.col("location"), F.col("job_description")).alias("mode"))


_LATEST = """lv AS (SELECT DISTINCT job_id, version_id, lower(trim(content_hash)) AS h, import_run_id, epoch_us(CAST(observed_at AS TIMESTAMPTZ)) AS t FROM job_versions WHERE trim(content_hash) <> ''),
    la AS (SELECT job_id, arg_max(h, (t, version_id)) AS content_hash, arg_max(import_run_id, (t, version_id)) AS import_run_id, count(*) AS versions, max(t) AS last_observed FROM lv GROUP BY 1)"""


@catalogue.add("latest_versions", f"WITH {_LATEST} SELECT * FROM la")
def latest_versions(spark, sf_dir):
    return store.latest_versions(table(spark, sf_dir, "job_versions"))


@catalogue.add(
    "import_actions",
    f"""WITH {_LATEST} SELECT CASE WHEN j.job_id IS NULL THEN 'insert' WHEN lower(j.content_hash) IS NOT DISTINCT FROM la.content_hash THEN 'skip' ELSE 'update' END AS action, count(*) AS n
    FROM la LEFT JOIN jobs j ON j.job_id = la.job_id GROUP BY 1""",
)
def import_actions(spark, sf_dir):
    incoming = store.latest_versions(table(spark, sf_dir, "job_versions")).select("job_id", "content_hash")
    done = store.classify_import(table(spark, sf_dir, "jobs").select("job_id", "content_hash"), incoming, "job_id", "content_hash")
    return done.groupBy("action").agg(F.count("*").alias("n"))


@catalogue.add(
    "upserted_jobs",
    f"""WITH {_LATEST} SELECT coalesce(j.job_id, la.job_id) AS job_id,
      CASE WHEN la.job_id IS NOT NULL AND (j.job_id IS NULL OR lower(j.content_hash) IS DISTINCT FROM la.content_hash) THEN la.content_hash ELSE j.content_hash END AS content_hash,
      greatest(j.seen, la.last_observed) AS seen FROM (SELECT job_id, content_hash, epoch_us(TRY_CAST(last_seen_at AS TIMESTAMPTZ)) AS seen FROM jobs) j FULL JOIN la ON j.job_id = la.job_id""",
)
def upserted_jobs(spark, sf_dir):
    incoming = store.latest_versions(table(spark, sf_dir, "job_versions")).select("job_id", "content_hash", F.col("last_observed").alias("seen"))
    seen = F.unix_micros(F.try_to_timestamp("last_seen_at"))
    existing = table(spark, sf_dir, "jobs").select("job_id", "content_hash", seen.alias("seen"))
    return store.upserted(existing, incoming, "job_id", "content_hash", "seen")


@catalogue.add(
    "new_mentions",
    """WITH o AS (SELECT DISTINCT job_id, canonical_skill_id FROM extracted_skills WHERE method = 'lexical'), i AS (SELECT DISTINCT job_id, canonical_skill_id FROM extracted_skills WHERE method = 'semantic' AND canonical_skill_id IS NOT NULL)
    SELECT i.* FROM i ANTI JOIN o ON i.job_id = o.job_id AND i.canonical_skill_id = o.canonical_skill_id""",
)
def new_mentions(spark, sf_dir):
    raw = table(spark, sf_dir, "extracted_skills").select("job_id", "canonical_skill_id", "method")
    incoming = raw.filter((F.col("method") == "semantic") & F.col("canonical_skill_id").isNotNull()).drop("method")
    return store.insert_or_ignore(raw.filter(F.col("method") == "lexical"), incoming, "job_id", "canonical_skill_id")


@catalogue.add(
    "run_rollup",
    """SELECT r.run_id, r.run_type, r.completed_at IS NOT NULL AS completed, coalesce(c.mentions, 0) AS mentions, coalesce(c.jobs, 0) AS jobs, coalesce(c.without_id, 0) AS without_id, c.confidence
    FROM extraction_runs r LEFT JOIN (SELECT run_id, count(*) AS mentions, count(DISTINCT job_id) AS jobs, count(*) FILTER (canonical_skill_id IS NULL) AS without_id, round(avg(confidence), 4) AS confidence
      FROM extracted_skills GROUP BY 1) c ON c.run_id = r.run_id""",
)
def run_rollup(spark, sf_dir):
    return store.run_rollup(table(spark, sf_dir, "extraction_runs"), table(spark, sf_dir, "extracted_skills"))


@catalogue.add(
    "stream_windows",
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def stream_windows(spark, sf_dir):
    counts = mb.windowed_counts(mb.table_stream(spark, sf_dir, "events"), "ts", "event_type", "value")
    return mb.drained(counts, "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@catalogue.add("stream_once", "SELECT DISTINCT event_id FROM events")
def stream_once(spark, sf_dir):
    return mb.drained(mb.once_ever(mb.table_stream(spark, sf_dir, "events").select("event_id"), "event_id"))


@catalogue.add("stream_bounds", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1")
def stream_bounds(spark, sf_dir):
    return mb.drained(mb.seen_bounds(mb.table_stream(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts"), "complete")
