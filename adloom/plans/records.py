"""Queries on cleaning raw records, the checks on stored adverts, and comparisons by type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions import text as tx
from adloom.functions.text import DROPPED
from adloom.operators import evaluate, quality, records, typed
from adloom.plans.registry import Catalogue
from adloom.session import table

catalogue = Catalogue()
#: The day that counts as today in the test tables.
AS_OF = "2025-08-01"

_ENTITIES = "replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
_HTML = "trim(regexp_replace(" + _ENTITIES.format(x="regexp_replace({c}, '<[^>]*>', ' ', 'g')") + r", '\s+', ' ', 'g'))"


def paragraphs_sql(c: str) -> str:
    """The lines of a page as SQL."""
    for name in DROPPED:
        c = rf"regexp_replace({c}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', ' ', 'g')"
    c = rf"regexp_replace({c}, '(?i)<li\b[^>]*>', chr(10) || '• ', 'g')"
    c = rf"regexp_replace({c}, '(?i)<(?:br|/?p|/?div|/?h[1-6]|/?tr|/?ul|/?ol)\b[^>]*>', chr(10), 'g')"
    c = _ENTITIES.format(x=f"regexp_replace({c}, '<[^>]*>', ' ', 'g')")
    lines = rf"list_transform(regexp_split_to_array({c}, '\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))"
    return f"array_to_string(list_filter({lines}, lambda x: x <> '' AND x <> '•'), chr(10))"


_NOTICE = "({c} IS NULL OR trim({c}) = '' OR regexp_matches(lower({c}), '" + "|".join(records.BOILERPLATE) + "'))"


def written_sql(c: str) -> str:
    """An absolute date as SQL."""

    def made(pattern: str, y: int, m: int, d: int, month: str | None = None) -> str:
        part = [f"nullif(regexp_extract(lower(trim({c})), '{pattern}', {k}), '')" for k in (y, m, d)]
        if month:
            part[1] = month.format(m=part[1])
        return f"TRY_CAST(lpad({part[0]}, 4, '0') || '-' || lpad({part[1]}, 2, '0') || '-' || lpad({part[2]}, 2, '0') AS DATE)"

    at = f"instr('{records._MONTHS}', {{m}})"
    month = f"(CASE WHEN {at} > 0 AND {at} % 3 = 1 THEN CAST(({at} + 2) // 3 AS VARCHAR) END)"
    return "coalesce(" + ", ".join(
        (
            made(r"^(\d{4})-(\d{2})-(\d{2})", 1, 2, 3),
            made(r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
            made(r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:\D|$)", 3, 2, 1),
            made(r"(?:^|[^\d])(\d{1,2})(?:st|nd|rd|th)?[ -]([a-z]{3})[a-z]*\.?,?[ -](\d{4})(?:\D|$)", 3, 2, 1, month),
        )
    ) + ")"


def relative_sql(c: str, base: str) -> str:
    """A day counted back, as SQL."""
    t = f"lower(trim({c}))"

    def number(unit: str) -> str:
        return rf"TRY_CAST(nullif(regexp_extract({t}, '(\d{{1,4}})\s+{unit}', 1), '') AS INTEGER)"

    return (
        f"({base} - (CASE WHEN contains({t}, 'today') THEN 0 WHEN contains({t}, 'yesterday') THEN 1 WHEN contains({t}, 'day') THEN {number('day')} "
        f"WHEN contains({t}, 'week') THEN coalesce({number('week')} * 7, CASE WHEN contains({t}, 'a week') OR contains({t}, 'one week') THEN 7 END) "
        f"WHEN contains({t}, 'month') THEN {number('month')} * 30 END))"
    )


_BASE = "CAST(TRY_CAST(scraped_at AS TIMESTAMPTZ) AS DATE)"
_COLUMNS = (
    "job_id, source_job_id, source_url, source_platform, collection_batch_id, description_type, title, company, requirements, location, posted, closes, "
    "date_method, scraped, description, description_source, reason, status"
)
_CLEAN = f"""raw1 AS (
  SELECT *, {relative_sql('posted_date_raw', _BASE)} AS rel, {written_sql('posted_date_raw')} AS wri,
    coalesce({relative_sql('closing_date_raw', _BASE)}, {written_sql('closing_date_raw')}) AS clo, {paragraphs_sql('job_description_raw')} AS page
  FROM extraction_results
), raw2 AS (
  SELECT coalesce(trim(job_id), '') AS job_id, coalesce(trim(source_job_id), '') AS source_job_id, coalesce(trim(source_url), '') AS source_url,
    coalesce(trim(source_platform), '') AS source_platform, coalesce(trim(collection_batch_id), '') AS collection_batch_id,
    coalesce(trim(description_type), '') AS description_type, coalesce(trim(extraction_status), '') AS was,
    coalesce({_HTML.format(c='job_title_raw')}, '') AS title, coalesce({_HTML.format(c='company_raw')}, '') AS company,
    coalesce({_HTML.format(c='requirements_raw')}, '') AS requirements, coalesce(trim(regexp_replace(location_raw, '\\s+', ' ', 'g')), '') AS location,
    coalesce(strftime(coalesce(rel, wri), '%Y-%m-%d'), '') AS posted, coalesce(strftime(clo, '%Y-%m-%d'), '') AS closes,
    CASE WHEN rel IS NOT NULL THEN 'relative' WHEN wri IS NOT NULL THEN 'absolute' ELSE 'failed' END AS date_method,
    coalesce(epoch_us(TRY_CAST(scraped_at AS TIMESTAMPTZ)), 0) AS scraped,
    CASE WHEN NOT {_NOTICE.format(c='page')} AND length(page) >= 30 THEN page ELSE '' END AS description
  FROM raw1
), raw3 AS (
  SELECT *, CASE WHEN description <> '' THEN 'html_text' ELSE 'none' END AS description_source,
    CASE WHEN posted <> '' AND posted > '{AS_OF}' THEN 'future_date' WHEN length(title) < 3 THEN 'short_title'
      WHEN description_type IN ('html_text', 'jsonld') AND length(description) < 100 THEN 'short_description' ELSE '' END AS reason FROM raw2
), cl AS (
  SELECT * EXCLUDE (was), CASE WHEN reason <> '' THEN 'excluded' WHEN description = '' THEN 'manual_review' ELSE was END AS status FROM raw3
), rk AS (SELECT *, CASE status WHEN 'success' THEN 0 WHEN 'partial' THEN 1 WHEN 'excluded' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END AS o FROM cl)"""
_URL = r"nullif(regexp_replace(regexp_replace(lower(trim(source_url)), '#.*$', ''), '/+$', ''), '')"
_STEPS = f"""{_CLEAN}, s1 AS (
  SELECT * FROM rk QUALIFY source_job_id = '' OR row_number() OVER (PARTITION BY lower(source_job_id) ORDER BY o, -scraped, {_COLUMNS}) = 1
), s2 AS (
  SELECT * FROM s1 QUALIFY {_URL} IS NULL OR row_number() OVER (PARTITION BY {_URL} ORDER BY o, -scraped, {_COLUMNS}) = 1
), s3 AS (
  SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY title, company, description ORDER BY o, -scraped, {_COLUMNS}) = 1
)"""


def _cleaned(spark, sf_dir):
    return records.cleaned(table(spark, sf_dir, "extraction_results"), AS_OF)


@catalogue.add("cleaned_records", f"WITH {_CLEAN} SELECT * FROM cl")
def cleaned_records(spark, sf_dir):
    return _cleaned(spark, sf_dir)


@catalogue.add("cleaned_adverts", f"WITH {_STEPS} SELECT * EXCLUDE (o) FROM s3")
def cleaned_adverts(spark, sf_dir):
    return records.deduplicated(_cleaned(spark, sf_dir))[-1]


@catalogue.add(
    "exclusion_counts",
    f"""WITH {_STEPS}, n AS (SELECT (SELECT count(*) FROM cl) AS a, (SELECT count(*) FROM s1) AS b, (SELECT count(*) FROM s2) AS c, (SELECT count(*) FROM s3) AS d,
      (SELECT count(*) FROM s3 WHERE status <> 'excluded') AS e, (SELECT count(*) FROM cl WHERE reason = 'future_date') AS f,
      (SELECT count(*) FROM cl WHERE reason = 'short_title') AS g, (SELECT count(*) FROM cl WHERE reason = 'short_description') AS h)
    SELECT unnest(['records', 'future_date', 'short_title', 'short_description', 'removed_by_id', 'removed_by_url', 'removed_by_text', 'internal', 'team']) AS counter,
      unnest([a, f, g, h, a - b, b - c, c - d, d, e]) AS n FROM n""",
)
def exclusion_counts(spark, sf_dir):
    clean = _cleaned(spark, sf_dir)
    return records.exclusion_counts(clean, records.deduplicated(clean))


@catalogue.add(
    "team_table",
    f"""WITH {_STEPS} SELECT job_id, title AS job_title, company, location, description AS job_description, requirements, posted AS posted_date,
      closes AS closing_date, source_platform, source_url FROM s3 WHERE status <> 'excluded'""",
)
def team_table(spark, sf_dir):
    return records.team_table(records.deduplicated(_cleaned(spark, sf_dir))[-1])


@catalogue.add(
    "posting_days",
    f"""SELECT DISTINCT job_id, f AS field, coalesce({relative_sql('v', 'b')}, {written_sql('v')}) AS day,
      CASE WHEN {relative_sql('v', 'b')} IS NOT NULL THEN 'relative' WHEN {written_sql('v')} IS NOT NULL THEN 'absolute' ELSE 'failed' END AS method
    FROM (SELECT job_id, {_BASE} AS b, unnest(['posted_date_raw', 'closing_date_raw']) AS f, unnest([posted_date_raw, closing_date_raw]) AS v FROM extraction_results) WHERE v IS NOT NULL""",
)
def posting_days(spark, sf_dir):
    raw = table(spark, sf_dir, "extraction_results")
    long = raw.withColumn("_b", F.to_date(F.try_to_timestamp("scraped_at"))).unpivot(["job_id", "_b"], ["posted_date_raw", "closing_date_raw"], "field", "_v")
    read = records.with_posting_day(long.filter(F.col("_v").isNotNull()), "_v", F.col("_b"), "day", "method")
    return read.select("job_id", "field", "day", "method").distinct()


_AGO = r"(?i)^\s*(\d{1,5})\s*(minutes?|mins?|hours?|hrs?|hr|h|days?|d|weeks?|wks?|w|months?|mon|mos?|m|years?|yrs?|y)\s+ago\s*$"


@catalogue.add(
    "ago_instants",
    f"""WITH r AS (SELECT DISTINCT job_id, posted_date_raw AS v, CAST(TRY_CAST(scraped_at AS TIMESTAMPTZ) AS TIMESTAMP) AS b FROM extraction_results WHERE regexp_matches(posted_date_raw, '{_AGO}')),
    p AS (SELECT *, CAST(regexp_extract(v, '{_AGO}', 1) AS INTEGER) AS n, lower(regexp_extract(v, '{_AGO}', 2)) AS u FROM r)
    SELECT job_id, v AS posted_date_raw, strftime(CASE WHEN u IN ('m', 'mo', 'mos', 'mon', 'month', 'months') THEN b - to_months(n) WHEN u[1] = 'y' THEN b - to_months(n * 12)
      WHEN u[1] = 'w' THEN b - to_days(n * 7) WHEN u[1] = 'd' THEN b - to_days(n) WHEN u[1] = 'h' THEN b - to_hours(n) ELSE b - to_minutes(n) END, '%Y-%m-%d %H:%M:%S') AS utc FROM p""",
)
def ago_instants(spark, sf_dir):
    raw = table(spark, sf_dir, "extraction_results").select("job_id", "posted_date_raw", F.try_to_timestamp("scraped_at").alias("_b")).distinct()
    at = records.ago_instant(F.col("posted_date_raw"), F.col("_b"))
    return raw.filter(F.col("posted_date_raw").rlike(_AGO)).select("job_id", "posted_date_raw", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("utc"))


@catalogue.add(
    "year_strata",
    "SELECT coalesce(CAST(year(TRY_CAST(posting_date AS DATE)) AS VARCHAR), 'Unknown date') AS stratum, count(*) AS jobs FROM jobs GROUP BY 1",
)
def year_strata(spark, sf_dir):
    day = F.col("posting_date").try_cast("date")
    return table(spark, sf_dir, "jobs").groupBy(F.coalesce(F.year(day).cast("string"), F.lit("Unknown date")).alias("stratum")).agg(F.count("*").alias("jobs"))


_PLAINER = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))"


def _firm_sql(c: str) -> str:
    out = _PLAINER.format(c=c)
    for form in records.LEGAL_FORMS:
        out = f"regexp_replace({out}, '{form}', '', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


@catalogue.add("firm_keys", f"SELECT {_firm_sql('company_name')} AS firm, count(DISTINCT company_name) AS spellings, count(*) AS jobs FROM jobs WHERE company_name IS NOT NULL GROUP BY 1")
def firm_keys(spark, sf_dir):
    jobs = table(spark, sf_dir, "jobs").filter(F.col("company_name").isNotNull())
    return jobs.groupBy(records.firm_key(F.col("company_name")).alias("firm")).agg(F.countDistinct("company_name").alias("spellings"), F.count("*").alias("jobs"))


@catalogue.add(
    "plain_places",
    r"""SELECT trim(regexp_replace(trim(regexp_replace(location, '\s+', ' ', 'g')), '(?i),\s*sri lanka', '', 'g')) AS place, count(*) AS jobs FROM jobs GROUP BY 1""",
)
def plain_places(spark, sf_dir):
    return table(spark, sf_dir, "jobs").groupBy(records.plain_place(F.col("location"), "sri lanka").alias("place")).agg(F.count("*").alias("jobs"))


_HOLDERS = "('', 'nan', 'none', 'nat', 'null', 'undefined', 'n/a', '-')"


@catalogue.add(
    "extraction_texts",
    f"""WITH p AS (SELECT job_id, {', '.join(f"CASE WHEN lower(trim({c})) NOT IN {_HOLDERS} THEN trim({c}) END AS {n}" for n, c in (('t', 'job_title'), ('d', 'job_description'), ('r', 'requirements')))} FROM jobs)
    SELECT job_id, concat_ws(' ', t, d, r) AS text, CASE WHEN {_NOTICE.format(c='d')} THEN 'title_fallback' WHEN contains(d, '--- OCR Text ---') THEN 'hybrid' ELSE 'description' END AS provenance FROM p""",
)
def extraction_texts(spark, sf_dir):
    text, source = records.extraction_text(F.col("job_title"), F.col("job_description"), F.col("requirements"))
    return table(spark, sf_dir, "jobs").select("job_id", text.alias("text"), source.alias("provenance"))


def _blank(c: str) -> str:
    return f"coalesce(trim({c}) = '', true)"


_BAD_DAY = r"NOT {b} AND (NOT regexp_matches(posting_date, '^\d{{4}}-\d{{2}}-\d{{2}}$') OR TRY_CAST(posting_date AS DATE) IS NULL)".format(b=_blank("posting_date"))
_LOW, _HIGH = ("CASE WHEN NOT isnan(salary_{}_normalized) THEN salary_{}_normalized END".format(x, x) for x in ("min", "max"))
_MODE = "lower(coalesce(work_mode, ''))"
_RULES = [
    ("source_url_http", r"NOT coalesce(regexp_matches(lower(source_url), '^https?://[^/\s]+'), false)", "fail"),
    ("critical_fields", " OR ".join(map(_blank, ("job_id", "job_title", "company_name", "source_url"))), "fail"),
    ("posting_date_iso", _BAD_DAY, "fail"),
    ("posting_date_future", f"NOT ({_BAD_DAY}) AND substr(posting_date, 1, 10) > '{AS_OF}'", "fail"),
    ("first_seen_instant", "TRY_CAST(first_seen_at AS TIMESTAMPTZ) IS NULL", "fail"),
    ("last_seen_instant", "TRY_CAST(last_seen_at AS TIMESTAMPTZ) IS NULL", "fail"),
    ("seen_in_order", "TRY_CAST(first_seen_at AS TIMESTAMPTZ) > TRY_CAST(last_seen_at AS TIMESTAMPTZ)", "fail"),
    ("content_hash_hex", "NOT coalesce(regexp_matches(lower(trim(content_hash)), '^[0-9a-f]{64}$'), false)", "warning"),
    ("pay_not_negative", f"({_LOW}) < 0 OR ({_HIGH}) < 0", "fail"),
    ("pay_in_order", f"({_LOW}) > ({_HIGH})", "fail"),
    ("pay_has_currency", f"salary_disclosed = 1 AND (coalesce({_LOW}, 0) <> 0 OR coalesce({_HIGH}, 0) <> 0) AND {_blank('salary_currency_normalized')}", "warning"),
    ("pay_period_known", "lower(coalesce(salary_period_normalized, '')) NOT IN ('hourly', 'daily', 'weekly', 'monthly', 'annual', 'unspecified', '')", "fail"),
    ("country_known", f"NOT {_blank('country')} AND lower(trim(country)) NOT IN (SELECT lower(country) FROM ref_countries UNION ALL SELECT lower(code) FROM ref_countries)", "warning"),
    ("work_mode_known", f"{_MODE} NOT IN ('remote', 'hybrid', 'on_site', 'unspecified', 'unknown', '')", "warning"),
    (
        "work_mode_place",
        f"({_MODE} = 'on_site' AND contains(lower(coalesce(location, '')), '100% remote')) OR ({_MODE} = 'remote' AND trim(coalesce(location, '')) = '' AND NOT regexp_matches(lower(concat_ws(' ', job_title, job_description)), 'remote|wfh'))",
        "warning",
    ),
    ("class_known", "coalesce(classification_status, '') NOT IN ('it', 'non_it', 'ambiguous', 'insufficient_data', '')", "warning"),
    ("provenance", " OR ".join(map(_blank, ("source_url", "job_id", "first_seen_at"))), "fail"),
    ("description_present", _blank("job_description"), "warning"),
]
_DUPES = (
    ("job_id_once", "SELECT count(*) - count(DISTINCT job_id) FROM jobs WHERE job_id IS NOT NULL"),
    ("source_url_once", f"SELECT count(*) - count(DISTINCT u) FROM (SELECT {_URL} AS u FROM jobs) WHERE u IS NOT NULL"),
    ("content_once", "SELECT count(*) - count(DISTINCT lower(trim(content_hash))) FROM jobs WHERE content_hash IS NOT NULL"),
)


@catalogue.add(
    "validation_full",
    "WITH r AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS violations, count(*) AS rows, '{s}' AS sev FROM jobs" for n, c, s in _RULES)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{n}', ({q}), (SELECT count(*) FROM jobs), '{'warning' if n == 'content_once' else 'fail'}'" for n, q in _DUPES)
    + ") SELECT rule, violations, rows, CASE WHEN violations = 0 THEN 'pass' ELSE sev END AS status FROM r",
)
def validation_full(spark, sf_dir):
    jobs = table(spark, sf_dir, "jobs")
    known = [x for r in table(spark, sf_dir, "ref_countries").select("country", "code").collect() for x in r]
    single = records.checks(jobs, AS_OF, known)
    keys = {
        "job_id_once": F.col("job_id"),
        "source_url_once": F.nullif(tx.canonical_url(F.col("source_url")), F.lit("")),
        "content_once": F.lower(F.trim("content_hash")),
    }
    twice = quality.duplicate_counts(jobs, keys).join(jobs.agg(F.count("*").alias("rows")))
    severity = F.when(F.col("key") == "content_once", "warning").otherwise("fail")
    return single.unionByName(
        twice.select(F.col("key").alias("rule"), F.col("duplicates").alias("violations"), "rows", F.when(F.col("duplicates") == 0, "pass").otherwise(severity).alias("status"))
    )


_STATUSES, _TYPES = ("success", "partial", "failed", "excluded"), ("html_text", "image", "hybrid", "missing", "jsonld")
_FIELDS = (
    "posted_date_raw", "closing_date_raw", "company_raw", "location_raw", "requirements_raw", "salary_text_raw", "skills_raw", "job_description_raw",
    "country_raw", "source_job_id",
)
_METRICS = {
    "records": "true",
    **{f"status_{s}": f"extraction_status = '{s}'" for s in _STATUSES},
    **{f"type_{s}": f"description_type = '{s}'" for s in _TYPES},
    **{f"missing_{c}": _blank(c) for c in _FIELDS},
    "with_pay": "regexp_matches(salary_text_raw, '[0-9]')",
    "with_text": "length(trim(job_description_raw)) >= 30 AND description_type <> 'missing'",
    "with_skills": "length(trim(skills_raw)) > 2",
}


def _metrics() -> list[Column]:
    """The conditions of the metrics, in the same order."""
    return [
        F.lit(True),
        *(F.col("extraction_status") == s for s in _STATUSES),
        *(F.col("description_type") == s for s in _TYPES),
        *(F.coalesce(F.trim(c) == "", F.lit(True)) for c in _FIELDS),
        F.col("salary_text_raw").rlike("[0-9]"),
        (F.length(F.trim("job_description_raw")) >= 30) & (F.col("description_type") != "missing"),
        F.length(F.trim("skills_raw")) > 2,
    ]


@catalogue.add(
    "validation_metrics",
    f"""WITH c AS (SELECT {', '.join(f'count(*) FILTER (WHERE {q}) AS m{k}' for k, q in enumerate(_METRICS.values()))} FROM extraction_results)
    SELECT unnest([{', '.join(f"'{n}'" for n in _METRICS)}]) AS metric, unnest([{', '.join(f'm{k}' for k in range(len(_METRICS)))}]) AS n, unnest([{', '.join(f'round(m{k} * 100.0::DOUBLE / m0, 2)' for k in range(len(_METRICS)))}]) AS pct FROM c""",
)
def validation_metrics(spark, sf_dir):
    counts = table(spark, sf_dir, "extraction_results").agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"m{k}") for k, c in enumerate(_metrics())))
    each = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"m{k}").alias("n"), F.round(F.col(f"m{k}") * 100.0 / F.col("m0"), 2).alias("pct")) for k, n in enumerate(_METRICS)))
    return counts.select(F.explode(each).alias("_m")).select("_m.*")


# ------------------------------------------------------------- comparisons by type

_STATUS = "CASE WHEN j.classification_status = 'ambiguous' THEN 'ambiguous' WHEN j.classification_status IS NULL OR j.classification_status = 'insufficient_data' THEN 'not_reviewed' WHEN {e} IS NULL THEN 'unavailable' ELSE 'verified' END"
_FILLED = "CASE WHEN lower(trim({c})) NOT IN ('', 'nan', 'none', 'null') THEN trim({c}) END"
_CURRENCY = "coalesce(CASE lower({f}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in typed.CURRENCIES.items()) + " END, upper({f}), '')"
_PERIOD = "CASE WHEN contains(lower({f}), 'hour') THEN 'hourly' WHEN contains(lower({f}), 'day') OR contains(lower({f}), 'daily') THEN 'daily' WHEN contains(lower({f}), 'month') THEN 'monthly' WHEN regexp_matches(lower({f}), 'year|annum|annual|lpa') THEN 'annual' ELSE 'unspecified' END"


def _frame(verdict: str, got: str, absent: str = "false") -> str:
    return f"""CASE WHEN st = 'not_reviewed' THEN 'not_reviewed' WHEN st = 'ambiguous' THEN 'ambiguous_excluded' WHEN (st = 'unavailable' OR {absent}) AND {got} IS NULL THEN 'correct_absence'
      WHEN st = 'unavailable' OR {absent} THEN 'over_extracted' WHEN {got} IS NULL THEN 'missing_prediction' ELSE {verdict} END"""


_TEXTS = {"title": ("j.job_title", "r.job_title_raw", 0.8), "company": ("j.company_name", "r.company_raw", 0.8), "location": ("j.location", "r.location_raw", 0.8), "requirements": ("j.requirements", "r.requirements_raw", 0.6)}
_TYPED = f"""rr AS (SELECT DISTINCT job_id, job_title_raw, company_raw, location_raw, requirements_raw, posted_date_raw, scraped_at, salary_text_raw FROM extraction_results),
tx AS ({' UNION ALL '.join(f"SELECT '{n}' AS field, {l} AS least, j.job_id, {_STATUS.format(e=e)} AS st, {_PLAINER.format(c=f'coalesce({e}, {chr(39)*2})')} AS e, nullif({_PLAINER.format(c='coalesce(' + _FILLED.format(c=g) + ', ' + chr(39)*2 + ')')}, '') AS g FROM jobs j JOIN rr r ON r.job_id = j.job_id" for n, (e, g, l) in _TEXTS.items())}),
tw AS (SELECT *, list_distinct(list_filter(string_split(e, ' '), lambda w: w <> '')) AS we, list_distinct(list_filter(string_split(g, ' '), lambda w: w <> '')) AS wg FROM tx),
ti AS (SELECT *, len(list_intersect(we, wg)) AS s FROM tw),
dd AS (SELECT 'posting_date' AS field, j.job_id, {_STATUS.format(e="TRY_CAST(j.posting_date AS DATE)")} AS st, TRY_CAST(j.posting_date AS DATE) AS e,
  coalesce({relative_sql('r.posted_date_raw', 'CAST(TRY_CAST(r.scraped_at AS TIMESTAMPTZ) AS DATE)')}, {written_sql('r.posted_date_raw')}) AS g FROM jobs j JOIN rr r ON r.job_id = j.job_id),
nn AS (SELECT 'salary_min' AS field, j.job_id, {_STATUS.format(e="CASE WHEN NOT isnan(j.salary_min_normalized) THEN j.salary_min_normalized END")} AS st, CASE WHEN NOT isnan(j.salary_min_normalized) THEN j.salary_min_normalized END AS e,
  TRY_CAST(replace(nullif(regexp_extract(r.salary_text_raw, '\\d[\\d,]*', 0), ''), ',', '') AS DOUBLE) AS g, {_CURRENCY.format(f=_FILLED.format(c='j.salary_currency_normalized'))} AS ce,
  {_CURRENCY.format(f="nullif(regexp_extract(r.salary_text_raw, '[A-Z]{{3}}', 0), '')".format())} AS cg, {_PERIOD.format(f=_FILLED.format(c='j.salary_period_normalized'))} AS pe, {_PERIOD.format(f=_FILLED.format(c='r.salary_text_raw'))} AS pg
  FROM jobs j JOIN rr r ON r.job_id = j.job_id),
ty AS (
  SELECT field, job_id, {_frame("CASE WHEN e = g OR (len(we) > 0 AND len(wg) > 0 AND s >= least * (len(we) + len(wg) - s)) THEN 'correct' ELSE 'incorrect' END", 'g')} AS outcome, CAST(NULL AS DOUBLE) AS error FROM ti
  UNION ALL SELECT field, job_id, {_frame("CASE WHEN e IS NOT DISTINCT FROM g THEN 'correct' ELSE 'incorrect' END", 'g')}, NULL FROM dd
  UNION ALL SELECT field, job_id, {_frame("CASE WHEN ce <> '' AND cg <> '' AND ce <> cg THEN 'incompatible_currency' WHEN pe <> 'unspecified' AND pg <> 'unspecified' AND pe <> pg THEN 'incompatible_pay_period' WHEN abs(g - e) <= 1 THEN 'correct' ELSE 'incorrect' END", 'g', 'e IS NULL')}, NULL FROM nn
), tz AS (SELECT ty.field, ty.job_id, ty.outcome, CASE WHEN ty.field = 'salary_min' AND outcome IN ('correct', 'incorrect') THEN abs(nn.g - nn.e) END AS error FROM ty LEFT JOIN nn ON ty.field = 'salary_min' AND nn.job_id = ty.job_id)"""


def typed_outcomes(spark, sf_dir):
    """``(field, job_id, outcome, error)`` of adverts against their records; the status of a reference follows its classification."""
    raw = table(spark, sf_dir, "extraction_results").select(
        "job_id", "job_title_raw", "company_raw", "location_raw", "requirements_raw", "posted_date_raw", "scraped_at", "salary_text_raw"
    ).distinct()
    own = ("job_id", "job_title", "company_name", "location", "requirements", "posting_date", "classification_status")
    jobs = table(spark, sf_dir, "jobs").select(*own, "salary_min_normalized", "salary_currency_normalized", "salary_period_normalized")
    both = jobs.join(raw, "job_id")
    kind = F.col("classification_status")

    def status(e):
        return (
            F.when(kind == "ambiguous", "ambiguous").when(kind.isNull() | (kind == "insufficient_data"), "not_reviewed").when(e.isNull(), "unavailable").otherwise("verified")
        )

    def text(e, g, least):
        return typed.text_outcome(status(F.col(e)), F.col(e), F.col(g), least)

    day = F.col("posting_date").try_cast("date")
    got_day, _ = records.posting_day(F.col("posted_date_raw"), F.to_date(F.try_to_timestamp("scraped_at")))
    pay = F.when(~F.isnan("salary_min_normalized"), F.col("salary_min_normalized"))
    told = F.col("salary_text_raw")
    got_pay = typed.number_of(F.nullif(F.regexp_extract(told, r"\d[\d,]*", 0), F.lit("")))
    currencies = (typed.currency_of(F.col("salary_currency_normalized")), typed.currency_of(F.nullif(F.regexp_extract(told, "[A-Z]{3}", 0), F.lit(""))))
    periods = (typed.period_of(F.col("salary_period_normalized")), typed.period_of(told))
    number = typed.number_outcome(status(pay), pay, got_pay, currencies, periods)
    none = F.lit(None).cast("double")
    rows = [
        *((n, text(e.split(".")[1], g.split(".")[1], least), none) for n, (e, g, least) in _TEXTS.items()),
        ("posting_date", typed.date_outcome(status(day), day, got_day), none),
        ("salary_min", number, F.when(number.isin("correct", "incorrect"), F.abs(got_pay - pay))),
    ]
    each = F.array(*(F.struct(F.lit(n).alias("field"), o.alias("outcome"), x.alias("error")) for n, o, x in rows))
    return both.select("job_id", F.explode(each).alias("_o")).select("_o.field", "job_id", "_o.outcome", "_o.error")


@catalogue.add("typed_outcomes", f"WITH {_TYPED} SELECT DISTINCT field, job_id, outcome FROM ty")
def typed_outcomes_query(spark, sf_dir):
    return typed_outcomes(spark, sf_dir).select("field", "job_id", "outcome").distinct()


_SHARE = "CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) / ({b}), 4) ELSE 0.0 END"
_FIGURES = f"""{_TYPED}, c AS (SELECT field, count(*) FILTER (WHERE outcome IN ('correct', 'incorrect', 'incompatible_currency', 'incompatible_pay_period', 'missing_prediction')) AS eligible,
  count(*) FILTER (WHERE outcome IN ('correct', 'incorrect', 'incompatible_currency', 'incompatible_pay_period')) AS matched, count(*) FILTER (WHERE outcome = 'correct') AS correct,
  count(*) FILTER (WHERE outcome IN ('incorrect', 'incompatible_currency', 'incompatible_pay_period')) AS incorrect, count(*) FILTER (WHERE outcome = 'missing_prediction') AS missing,
  count(*) FILTER (WHERE outcome = 'correct_absence') AS absences, count(*) FILTER (WHERE outcome = 'over_extracted') AS over_extracted FROM ty GROUP BY 1),
fg AS (SELECT *, {_SHARE.format(a='matched', b='eligible')} AS coverage, {_SHARE.format(a='correct', b='matched')} AS correctness, {_SHARE.format(a='correct', b='correct + incorrect')} AS precision,
  {_SHARE.format(a='correct', b='eligible')} AS recall, {_SHARE.format(a='2 * correct', b='2 * correct + incorrect + (eligible - correct)')} AS f1, {_SHARE.format(a='over_extracted', b='over_extracted + absences')} AS hallucination FROM c)"""


@catalogue.add("typed_figures", f"WITH {_FIGURES} SELECT * FROM fg")
def typed_figures(spark, sf_dir):
    return typed.outcome_figures(typed_outcomes(spark, sf_dir)).drop("mae", "median_error")


@catalogue.add(
    "amount_errors",
    f"WITH {_TYPED} SELECT field, count(error) AS n, round(avg(error), 4) AS mae, round(quantile_cont(error, 0.5), 4) AS median_error FROM tz GROUP BY 1 HAVING count(error) > 0",
)
def amount_errors(spark, sf_dir):
    return evaluate_amounts(typed_outcomes(spark, sf_dir))


def evaluate_amounts(outcomes):
    """``(field, n, mae, median_error)`` of the fields with numbers."""
    return outcomes.filter(F.col("error").isNotNull()).groupBy("field").agg(
        F.count("*").alias("n"), F.round(F.avg("error"), 4).alias("mae"), F.round(F.percentile("error", F.lit(0.5)), 4).alias("median_error")
    )


@catalogue.add(
    "macro_averages",
    f"WITH {_FIGURES} SELECT count(*) AS fields, "
    + ", ".join(f"round(CAST(sum(CAST(round({c} * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000, 4) AS macro_{c}" for c in ("coverage", "correctness", "precision", "recall", "f1"))
    + " FROM fg WHERE eligible > 0",
)
def macro_averages(spark, sf_dir):
    return typed.macro_figures(typed.outcome_figures(typed_outcomes(spark, sf_dir)))


@catalogue.add(
    "label_averages",
    """WITH e AS (SELECT DISTINCT job_id, canonical_skill_id AS s FROM extracted_skills WHERE method = 'lexical' AND canonical_skill_id IS NOT NULL),
    g AS (SELECT DISTINCT job_id, canonical_skill_id AS s FROM extracted_skills WHERE method = 'semantic' AND canonical_skill_id IS NOT NULL),
    l AS (SELECT coalesce(e.s, g.s) AS s, count(*) FILTER (WHERE e.s IS NOT NULL AND g.s IS NOT NULL) AS tp, count(*) FILTER (WHERE e.s IS NULL) AS fp, count(*) FILTER (WHERE g.s IS NULL) AS fn
      FROM e FULL JOIN g ON e.job_id = g.job_id AND e.s = g.s GROUP BY 1 HAVING count(*) FILTER (WHERE e.s IS NOT NULL) > 0),
    p AS (SELECT *, round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END, 6) AS pr, round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS re, round(CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn), 6) AS f FROM l)
    SELECT count(*) AS labels, round(CAST(sum(tp) AS DOUBLE) / sum(tp + fp), 4) AS micro_precision, round(CAST(sum(tp) AS DOUBLE) / sum(tp + fn), 4) AS micro_recall,
      round(CAST(2 * sum(tp) AS DOUBLE) / sum(2 * tp + fp + fn), 4) AS micro_f1, round(CAST(sum(CAST(round(pr * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000, 4) AS macro_precision,
      round(CAST(sum(CAST(round(re * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000, 4) AS macro_recall, round(CAST(sum(CAST(round(f * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000, 4) AS macro_f1 FROM p""",
)
def label_averages(spark, sf_dir):
    m = table(spark, sf_dir, "extracted_skills").filter(F.col("canonical_skill_id").isNotNull())
    sides = [m.filter(F.col("method") == k).select("job_id", "canonical_skill_id") for k in ("lexical", "semantic")]
    return typed.label_averages(evaluate.label_scores(*sides, "job_id", "canonical_skill_id"))
