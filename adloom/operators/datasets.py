"""Integrated datasets: skills per advert, two sources of adverts in one, scopes, labels and small JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.functions.text import canonical_url


def skill_lists(jobs: DataFrame, mentions: DataFrame, skills: DataFrame, run: str | None = None) -> DataFrame:
    """``(job_id, title, country, lexical_skills, semantic_skills, provenance, batch)``: adverts with mentions, skills as sorted JSON lists.

    A skill is named by its canonical name, else as written. Methods that are
    neither count as lexical. ``run`` keeps the mentions of one run.
    """
    own = mentions if run is None else mentions.filter(F.col("run_id") == run)
    names = skills.select(F.col("skill_id").alias("canonical_skill_id"), "canonical_name")
    named = own.join(names, "canonical_skill_id", "left").withColumn("_s", F.coalesce("canonical_name", "skill_name"))
    semantic = F.lower("method").contains("semantic") & ~F.lower("method").contains("lexical")
    lists = named.groupBy("job_id").agg(
        F.to_json(F.array_sort(F.collect_set(F.when(~F.coalesce(semantic, F.lit(False)), F.col("_s"))))).alias("lexical_skills"),
        F.to_json(F.array_sort(F.collect_set(F.when(semantic, F.col("_s"))))).alias("semantic_skills"),
        F.count_distinct("original_span").alias("spans"),
        F.min("run_id").alias("batch"),
    )
    return jobs.select(
        "job_id", F.coalesce("job_title", F.lit("")).alias("title"), F.coalesce("country", F.lit("")).alias("country")
    ).join(lists, "job_id")


def harmonised(first: DataFrame, second: DataFrame, url: str = "source_url") -> DataFrame:
    """``first`` and those rows of ``second`` whose canonical URL it does not have, with ``origin``; same columns."""
    key = F.nullif(canonical_url(F.col(url)), F.lit(""))
    known = first.select(key.alias("_u")).filter(F.col("_u").isNotNull()).distinct()
    rest = second.withColumn("_u", key).join(known, "_u", "left_anti").drop("_u")
    return first.withColumn("origin", F.lit("reviewed")).unionByName(rest.withColumn("origin", F.lit("predicted")))


#: The value of a scope that lets all rows pass.
ALL = "All"


def in_scope(df: DataFrame, **scope: str | None) -> DataFrame:
    """Rows with the given values; ``None`` and ``All`` let a column pass."""
    for column, value in scope.items():
        if value not in (None, ALL):
            df = df.filter(F.trim(column) == value)
    return df


def choices(df: DataFrame, *columns: str) -> DataFrame:
    """``(column, value)``: the distinct trimmed values to choose from; blanks are none."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns))
    return df.select(F.explode(each).alias("_c")).select("_c.*").filter(F.col("value") != "").distinct()


def any_text(*columns: str) -> Column:
    """Whether any of the columns holds text."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.trim(c) != "", F.lit(False))
    return cond


def is_image_advert(kind: Column, urls: Column, page: Column) -> Column:
    """Whether an advert is a picture: by its type, by image URLs, or by a page that is an image without text."""
    listed = F.coalesce(F.size(F.from_json(urls, "array<string>")) > 0, F.lit(False))
    only = F.coalesce(F.lower(page).rlike("<img[^>]*>") & (F.trim(F.regexp_replace(page, "<[^>]*>", "")) == ""), F.lit(False))
    return F.coalesce(F.lower(kind).contains("image"), F.lit(False)) | listed | only


def valid_url_list(text: Column) -> Column:
    """Whether a text is a JSON list of web addresses; an empty list is valid, null and other JSON are not."""
    items = F.from_json(text, "array<string>")
    return F.coalesce(F.trim(text).startswith("[") & items.isNotNull() & F.forall(items, lambda u: F.coalesce(u.rlike(r"^https?://[^/\s]+"), F.lit(False))), F.lit(False))


def json_updated(text: Column, **entries: Column) -> Column:
    """A JSON object with entries set, keys in order; text that is no object counts as an empty one."""
    own = F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))))
    both = F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(*entries)), new)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both))))


def override(text: Column, status: Column) -> tuple[Column, Column]:
    """The status after a manual override written as JSON (``new_status``, ``reason``), and its reason."""
    new = F.nullif(F.get_json_object(text, "$.new_status"), F.lit(""))
    reason = F.when(new.isNotNull(), F.coalesce(F.get_json_object(text, "$.reason"), F.lit("Manual Override")))
    return F.coalesce(new, status), reason


def times_label(here: Column, there: Column) -> Column:
    """How much more common something is here: shares to words."""
    ratio = here / there
    return (
        F.when(here == 0, "absent").when(there == 0, "only here").when(ratio >= 2, "much more common").when(ratio >= 1.2, "more common")
        .when(ratio > 0.8, "about as common").otherwise("less common")
    )


def stability_label(share: Column) -> Column:
    """Reliability of a result by the percentage of resamples that repeat it."""
    return F.when(share >= 80, "Reliable").when(share >= 50, "Somewhat reliable").otherwise("Unstable")


def candidates(text: Column) -> Column:
    """The sentences, lines and list items of a text that are longer than three characters."""
    parts = F.split(text, r"[.!?]+\s+|[\r\n]+|\s*[•·▪]\s*")
    return F.filter(F.transform(parts, F.trim), lambda x: F.length(x) > 3)


def url_class(url: Column, host_known: Column) -> Column:
    """``detail``, ``listing``, ``other`` or ``unsupported`` for a page address."""
    path = F.lower(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""))
    return (
        F.when(~F.coalesce(host_known, F.lit(False)), "unsupported")
        .when(path.rlike(r"/(?:job|jobs|advert|vacancy|stelle|kerja|position)s?/[^/?#]+"), "detail")
        .when(path.rlike(r"/(?:search|browse|jobs|vacancies|category|categories)(?:[/?#]|$)"), "listing")
        .otherwise("other")
    )


#: Largest registry of runs that becomes a literal.
RUN_LIMIT = 10_000


def known_before(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """``(run, jobs)``: how many adverts had been seen when each run began; runs without adverts have 0.

    Counts per instant are summed up once and looked up by the run's place among
    them, so adverts are not paired with runs.
    """
    seen = jobs.select(F.unix_micros(F.try_to_timestamp("first_seen_at")).alias("at")).filter(F.col("at").isNotNull())
    starts = runs.select("run_id", F.unix_micros(F.try_to_timestamp("started_at")).alias("start"))
    # Runs are a registry of checked size: their starts become the steps that every advert is put on.
    rows = starts.filter(F.col("start").isNotNull()).select("start").distinct().limit(RUN_LIMIT + 1).collect()
    if len(rows) > RUN_LIMIT:
        raise ValueError(f"more than {RUN_LIMIT} runs; give a smaller registry")
    steps = F.array(*(F.lit(r.start) for r in sorted(rows))).cast("array<long>")
    step = F.array_min(F.filter(steps, lambda s: s >= F.col("at")))
    counted = seen.groupBy(step.alias("start")).agg(F.count("*").alias("n")).filter(F.col("start").isNotNull())
    every = starts.select("start").distinct().join(counted, "start", "left")
    # As many rows as runs.
    running = every.withColumn("jobs", F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy("start").rowsBetween(W.unboundedPreceding, 0)))
    return starts.join(running.select("start", "jobs"), "start", "left").select("run_id", F.coalesce("jobs", F.lit(0)).alias("jobs"))


def top_by_focal(grid: DataFrame, focal: str, k: int) -> DataFrame:
    """The rows of the ``k`` skills most asked for in the focal market; where it has no skill, those of all markets together.

    ``grid`` has ``(market, skill, jobs)``. Ties go to the name.
    """
    total = grid.groupBy("skill").agg(F.sum(F.when(F.col("market") == focal, F.col("jobs")).otherwise(0)).alias("own"), F.sum("jobs").alias("all"))
    has = total.agg(F.max("own").alias("m")).select(F.coalesce(F.col("m") > 0, F.lit(False))).scalar()
    top = total.orderBy(F.when(has, F.col("own")).otherwise(F.col("all")).desc(), "skill").limit(k)
    return grid.join(top.select("skill"), "skill", "left_semi")


def label_agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """One row ``(both, same, share)``: how often two tables give a key the same label."""
    both = a.select(key, F.col(label).alias("_a")).join(b.select(key, F.col(label).alias("_b")), key)
    return both.agg(F.count("*").alias("both"), F.count_if(F.col("_a") == F.col("_b")).alias("same")).select(
        "both", "same", F.when(F.col("both") > 0, F.round(F.col("same") / F.col("both"), 4)).alias("share")
    )
