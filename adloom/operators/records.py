"""Raw records to clean adverts: text, dates, exclusions, deduplication, and the checks on the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions import text as tx
from adloom.functions.names import bound, fresh, ref
from adloom.operators.quality import keep_first, rule_report

# Patterns of descriptions that only stand for a missing one.
BOILERPLATE = (
    r"please refer (?:the|to the) full details",
    r"refer (?:the|to the) (?:full details|vacancy advert|advertisement|image flyer)",
    r"topjobs sri lanka job network",
    r"most popular online job site in sri lanka",
    r"recruitment automation for employers",
    r"please see the full job description",
    r"all terms and conditions apply",
)
# Legal forms at the end of a firm's name, removed in this order.
LEGAL_FORMS = (
    r"\bpvt\s*ltd\b", r"\bprivate\s*limited\b", r"\bpte\s*ltd\b", r"\bsdn\s*bhd\b", r"\bbhd\b", r"\bberhad\b", r"\bltd\b", r"\blimited\b",
    r"\binc\b", r"\bcorporation\b", r"\bcorp\b", r"\bco\b", r"\bllc\b", r"\bgmbh\b", r"\bhiring\s*for\s*client\s*(?:companies)?\b",
)
#: Limits of cleaning, in characters.
SHORT_TITLE, SHORT_PAGE, SHORT_TEXT = 3, 30, 100
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def stands_for_nothing(c: Column) -> Column:
    """Whether a description is missing, blank or only a portal's notice."""
    return F.coalesce((F.trim(c) == "") | F.lower(c).rlike("|".join(BOILERPLATE)), F.lit(True))


def firm_key(c: Column) -> Column:
    """A firm's name for comparison: lower case, no punctuation, no legal form."""
    name = tx.normalised(c)
    for form in LEGAL_FORMS:
        name = F.regexp_replace(name, form, "")
    return F.trim(F.regexp_replace(name, " +", " "))


def plain_place(c: Column, country: str) -> Column:
    """A place with single blanks and without its country's name; null stays, blank stays blank."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), rf"(?i),\s*{country}", ""))


def _made(y: Column, m: Column, d: Column) -> Column:
    """A date of text parts; null if there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def written_date(c: Column) -> Column:
    """The day of an absolute date: ISO, eight digits, day first in numbers, or with an English month."""
    t = F.lower(F.trim(c))

    def part(pattern: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))

    iso, eight = r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d{4})(\d{2})(\d{2})$"
    first = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:\D|$)"
    named = r"(?:^|[^\d])(\d{1,2})(?:st|nd|rd|th)?[ -]([a-z]{3})[a-z]*\.?,?[ -](\d{4})(?:\D|$)"
    month = F.instr(F.lit(_MONTHS), part(named, 2))
    number = F.when((month > 0) & (month % 3 == 1), ((month + 2) / 3).cast("int").cast("string"))
    return F.coalesce(
        _made(part(iso, 1), part(iso, 2), part(iso, 3)),
        _made(part(eight, 1), part(eight, 2), part(eight, 3)),
        _made(part(first, 3), part(first, 2), part(first, 1)),
        _made(part(named, 3), number, part(named, 1)),
    )


def counted_back(raw: Column, base: Column) -> Column:
    """The day of a date counted back from ``base`` ("today", "3 days ago", "a week ago"), months of 30 days; null if it is not."""
    t = F.lower(F.trim(raw))

    def number(unit: str) -> Column:
        return F.nullif(F.regexp_extract(t, rf"(\d{{1,4}})\s+{unit}", 1), F.lit("")).cast("int")

    ago = (
        F.when(t.contains("today"), 0)
        .when(t.contains("yesterday"), 1)
        .when(t.contains("day"), number("day"))
        .when(t.contains("week"), F.coalesce(number("week") * 7, F.when(t.contains("a week") | t.contains("one week"), 7)))
        .when(t.contains("month"), number("month") * 30)
    )
    return F.date_sub(base, ago)


def posting_day(raw: Column, base: Column) -> tuple[Column, Column]:
    """Day and method (``relative``, ``absolute``, ``failed``) of a posting date."""
    return _day_and_method(counted_back(raw, base), written_date(raw))


def _day_and_method(relative: Column, absolute: Column) -> tuple[Column, Column]:
    method = F.when(relative.isNotNull(), "relative").when(absolute.isNotNull(), "absolute").otherwise("failed")
    return F.coalesce(relative, absolute), method


def with_posting_day(df: DataFrame, raw: str, base: Column, day: str, method: str) -> DataFrame:
    """``df`` with ``day`` and ``method`` of a date column; both ways to read it are worked out once, apart from each other."""
    r, a = fresh(df, "_back"), fresh(df, "_written")
    read = bound(bound(df, **{r: counted_back(ref(raw), base)}), **{a: written_date(ref(raw))})
    found, how = _day_and_method(F.col(r), F.col(a))
    return read.withColumns({day: found, method: how}).drop(r, a)


def ago_instant(raw: Column, base: Column) -> Column:
    """The instant of "N unit ago" before ``base`` with calendar months and years; null if it is not written so."""
    pattern = (
        r"(?i)^\s*(\d{1,5})\s*(minutes?|mins?|hours?|hrs?|hr|h|days?|d|weeks?|wks?|w|months?|mon|mos?|m|years?|yrs?|y)\s+ago\s*$"
    )
    n = F.nullif(F.regexp_extract(raw, pattern, 1), F.lit("")).cast("int")
    unit = F.lower(F.regexp_extract(raw, pattern, 2))
    none = F.lit(0)

    def back(months: Column = none, days: Column = none, hours: Column = none, minutes: Column = none) -> Column:
        return base - F.make_interval(none, months, none, days, hours, minutes)

    return (
        F.when(unit.isin("m", "mo", "mos", "mon", "month", "months"), back(months=n))
        .when(unit.rlike("^y"), back(months=n * 12))
        .when(unit.rlike("^w"), back(days=n * 7))
        .when(unit.rlike("^d"), back(days=n))
        .when(unit.rlike("^h"), back(hours=n))
        .when(unit.rlike("^mi"), back(minutes=n))
    )


#: Order in which statuses are kept by deduplication; others come last.
STATUS = ("success", "partial", "excluded", "failed")


def cleaned(records: DataFrame, as_of: str) -> DataFrame:
    """Every record cleaned, with its ``status`` and the ``reason`` of an exclusion; nulls come out as empty text.

    A record is excluded for a posting date after ``as_of``, a title below
    three characters, or a text description below a hundred. Where no usable
    description is left, a record that is not excluded goes to ``manual_review``.
    """
    records = bound(records, _base=F.try_to_timestamp("scraped_at"))
    base = F.col("_base")
    page = F.coalesce(tx.paragraphs(F.col("job_description_raw")), F.lit(""))
    records = with_posting_day(records, "posted_date_raw", F.to_date(base), "_posted", "_method")
    records = with_posting_day(records, "closing_date_raw", F.to_date(base), "_closing", "_unused")
    # A long expression that several columns read, worked out once.
    t = bound(records, _page=page).select(
        *(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("job_id", "source_job_id", "source_url", "source_platform", "collection_batch_id", "description_type", "extraction_status")),
        F.coalesce(tx.clean_html(F.col("job_title_raw")), F.lit("")).alias("title"),
        F.coalesce(tx.clean_html(F.col("company_raw")), F.lit("")).alias("company"),
        F.coalesce(tx.clean_html(F.col("requirements_raw")), F.lit("")).alias("requirements"),
        F.coalesce(F.trim(F.regexp_replace("location_raw", r"\s+", " ")), F.lit("")).alias("location"),
        "_page",
        F.coalesce(F.date_format("_posted", "yyyy-MM-dd"), F.lit("")).alias("posted"),
        F.coalesce(F.date_format("_closing", "yyyy-MM-dd"), F.lit("")).alias("closes"),
        F.col("_method").alias("date_method"),
        F.coalesce(F.unix_micros(base), F.lit(0)).alias("scraped"),
    )
    usable = ~stands_for_nothing(F.col("_page")) & (F.length("_page") >= SHORT_PAGE)
    t = t.withColumn("description", F.when(usable, F.col("_page")).otherwise("")).withColumn(
        "description_source", F.when(usable, "html_text").otherwise("none")
    )
    reason = (
        F.when((F.col("posted") != "") & (F.col("posted") > as_of), "future_date")
        .when(F.length("title") < SHORT_TITLE, "short_title")
        .when(F.col("description_type").isin("html_text", "jsonld") & (F.length("description") < SHORT_TEXT), "short_description")
        .otherwise("")
    )
    t = t.withColumn("reason", reason)
    status = (
        F.when(F.col("reason") != "", "excluded").when(F.col("description") == "", "manual_review").otherwise(F.col("extraction_status"))
    )
    return t.withColumn("status", status).drop("_page", "extraction_status")


def deduplicated(clean: DataFrame) -> list[DataFrame]:
    """The rows after each of three steps: by the source's id, by canonical URL, by title, firm and description.

    Of equal rows the better status stays, then the later one, then the first by
    all columns. Rows without an id or URL all pass that step.
    """
    rank = reduce(lambda c, s: c.when(F.col("status") == s[1], s[0]), list(enumerate(STATUS))[1:], F.when(F.col("status") == STATUS[0], 0)).otherwise(len(STATUS))
    order = [rank, -F.col("scraped")]
    one = keep_first(clean, F.nullif(F.lower("source_job_id"), F.lit("")), order)
    two = keep_first(one, F.nullif(tx.canonical_url(F.col("source_url")), F.lit("")), order)
    three = keep_first(two, F.sha2(F.concat_ws("\x1f", "title", "company", "description"), 256), order)
    return [one, two, three]


def exclusion_counts(clean: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``(counter, n)``: records, exclusions by reason, what each step of deduplication removed, what is left."""
    c = clean.agg(
        F.count("*").alias("records"),
        *(F.count_if(F.col("reason") == r).alias(r) for r in ("future_date", "short_title", "short_description")),
    )
    sizes = [s.agg(F.count("*").alias(f"_{k}"), F.count_if(F.col("status") != "excluded").alias(f"_t{k}")) for k, s in enumerate(steps)]
    # One row each.
    wide = reduce(lambda a, b: a.join(b), sizes, c)
    named = {
        "records": F.col("records"),
        "future_date": F.col("future_date"),
        "short_title": F.col("short_title"),
        "short_description": F.col("short_description"),
        "removed_by_id": F.col("records") - F.col("_0"),
        "removed_by_url": F.col("_0") - F.col("_1"),
        "removed_by_text": F.col("_1") - F.col("_2"),
        "internal": F.col("_2"),
        "team": F.col("_t2"),
    }
    each = F.array(*(F.struct(F.lit(n).alias("counter"), v.alias("n")) for n, v in named.items()))
    return wide.select(F.explode(each).alias("_c")).select("_c.counter", "_c.n")


#: Columns of the table that teams get, and where each comes from.
TEAM = {
    "job_id": "job_id", "job_title": "title", "company": "company", "location": "location", "job_description": "description",
    "requirements": "requirements", "posted_date": "posted", "closing_date": "closes", "source_platform": "source_platform", "source_url": "source_url",
}


def team_table(rows: DataFrame) -> DataFrame:
    """What is not excluded, in the teams' columns."""
    return rows.filter(F.col("status") != "excluded").select(*(F.col(c).alias(n) for n, c in TEAM.items()))


def extraction_text(title: Column, description: Column, requirements: Column) -> tuple[Column, Column]:
    """The text that extraction reads, and where its substance comes from."""
    parts = [tx.null_if_placeholder(c) for c in (title, description, requirements)]
    body = parts[1]
    source = (
        F.when(body.isNull() | stands_for_nothing(body), "title_fallback").when(body.contains("--- OCR Text ---"), "hybrid").otherwise("description")
    )
    return F.concat_ws(" ", *parts), source


def checks(rows: DataFrame, as_of: str, countries: list[str]) -> DataFrame:
    """``(rule, violations, rows, status)`` of the checks on stored adverts that look at single rows, in one scan."""

    def blank(c: str) -> Column:
        return F.coalesce(F.trim(c) == "", F.lit(True))

    def bad_day(c: str) -> Column:
        return ~blank(c) & (~F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(c, "yyyy-MM-dd").isNull())

    low, high = F.col("salary_min_normalized"), F.col("salary_max_normalized")
    low, high = (F.when(~F.isnan(c), c) for c in (low, high))
    amount = (F.coalesce(low, F.lit(0.0)) != 0) | (F.coalesce(high, F.lit(0.0)) != 0)
    mode, place = F.lower(F.coalesce("work_mode", F.lit(""))), F.lower(F.coalesce("location", F.lit("")))
    told = F.lower(F.concat_ws(" ", "job_title", "job_description")).rlike("remote|wfh")
    rules = [
        ("source_url_http", ~F.coalesce(F.lower("source_url").rlike(r"^https?://[^/\s]+"), F.lit(False)), "fail"),
        ("critical_fields", blank("job_id") | blank("job_title") | blank("company_name") | blank("source_url"), "fail"),
        ("posting_date_iso", bad_day("posting_date"), "fail"),
        ("posting_date_future", ~bad_day("posting_date") & (F.substring("posting_date", 1, 10) > as_of), "fail"),
        ("first_seen_instant", F.try_to_timestamp("first_seen_at").isNull(), "fail"),
        ("last_seen_instant", F.try_to_timestamp("last_seen_at").isNull(), "fail"),
        ("seen_in_order", F.try_to_timestamp("first_seen_at") > F.try_to_timestamp("last_seen_at"), "fail"),
        ("content_hash_hex", ~F.coalesce(F.lower(F.trim("content_hash")).rlike(r"^[0-9a-f]{64}$"), F.lit(False)), "warning"),
        ("pay_not_negative", (low < 0) | (high < 0), "fail"),
        ("pay_in_order", low > high, "fail"),
        ("pay_has_currency", (F.col("salary_disclosed") == 1) & amount & blank("salary_currency_normalized"), "warning"),
        ("pay_period_known", ~F.lower(F.coalesce("salary_period_normalized", F.lit(""))).isin("hourly", "daily", "weekly", "monthly", "annual", "unspecified", ""), "fail"),
        ("country_known", ~blank("country") & ~F.lower(F.trim("country")).isin(*(c.lower() for c in countries)), "warning"),
        ("work_mode_known", ~mode.isin("remote", "hybrid", "on_site", "unspecified", "unknown", ""), "warning"),
        ("work_mode_place", ((mode == "on_site") & place.contains("100% remote")) | ((mode == "remote") & (F.trim(place) == "") & ~told), "warning"),
        ("class_known", ~F.coalesce("classification_status", F.lit("")).isin("it", "non_it", "ambiguous", "insufficient_data", ""), "warning"),
        ("provenance", blank("source_url") | blank("job_id") | blank("first_seen_at"), "fail"),
        ("description_present", blank("job_description"), "warning"),
    ]
    return rule_report(rows, rules)
