"""Queries on labels, pivots, drill-downs, audits, alignment and streamed upserts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.functions.text import canonical_url
from adloom.operators import basket, facts, regional
from adloom.plans.baskets import mentions
from adloom.plans.markets import _SALARY, _SPREAD, jobs_in_markets, salaries
from adloom.plans.registry import Catalogue
from adloom.plans.role_time import dated_jobs
from adloom.plans.sqltext import BASKETS, JOBS
from adloom.session import table
from adloom.streaming import micro_batch as mb

catalogue = Catalogue()


@catalogue.add("role_labels", f"WITH {JOBS} SELECT job_id, market, role FROM jm")
def role_labels(spark, sf_dir):
    return jobs_in_markets(spark, sf_dir).select("job_id", "market", "role")


_COLUMNS = ["data", "dev", "qa", "ops", "lead", "sec", "design", "biz", "unclassified"]


@catalogue.add(
    "market_role_pivot",
    f"WITH {JOBS} SELECT market, {', '.join(f'count(*) FILTER (role = {chr(39)}{r}{chr(39)}) AS {r}' for r in _COLUMNS)} FROM jm WHERE market IS NOT NULL GROUP BY 1",
)
def market_role_pivot(spark, sf_dir):
    placed = jobs_in_markets(spark, sf_dir).filter(F.col("market").isNotNull())
    return placed.groupBy("market").pivot("role", _COLUMNS).agg(F.count("job_id")).na.fill(0, _COLUMNS)


@catalogue.add(
    "salary_quartiles_long",
    f"""WITH {JOBS}, {_SALARY}, q AS (SELECT market, currency, {_SPREAD} FROM sal WHERE amount IS NOT NULL GROUP BY 1, 2)
    SELECT market, currency, measure, amount FROM (UNPIVOT (SELECT market, currency, p25, median, p75 FROM q) ON p25, median, p75 INTO NAME measure VALUE amount)""",
)
def salary_quartiles_long(spark, sf_dir):
    wide = regional.salary_summary(salaries(spark, sf_dir), "market", "currency")
    return wide.unpivot(["market", "currency"], ["p25", "median", "p75"], "measure", "amount")


@catalogue.add(
    "pair_drilldown",
    f"WITH {BASKETS} SELECT x.job_id FROM b x JOIN b y ON x.job_id = y.job_id WHERE x.skill = 'Corvid SQL' AND y.skill = 'Pylonscript'",
)
def pair_drilldown(spark, sf_dir):
    held = mentions(spark, sf_dir).groupBy("job_id").agg(F.collect_set("skill").alias("has"))
    both = F.array_contains("has", "Corvid SQL") & F.array_contains("has", "Pylonscript")
    return held.filter(both).select("job_id")


@catalogue.add(
    "stack_support",
    f"""WITH {BASKETS}, st AS (SELECT unnest([['Corvid SQL', 'Pylonscript'], ['Corvid SQL', 'Kestrel', 'Pylonscript'], ['Tessel']]) AS s)
    SELECT array_to_string(s, ' + ') AS stack, (SELECT count(*) FROM (SELECT job_id FROM b WHERE list_contains(s, skill) GROUP BY job_id HAVING count(*) = len(s))) AS jobs FROM st""",
)
def stack_support(spark, sf_dir):
    stacks = [["Corvid SQL", "Pylonscript"], ["Corvid SQL", "Kestrel", "Pylonscript"], ["Tessel"]]
    held = facts.baskets(mentions(spark, sf_dir).select("job_id", "skill").distinct())
    each = F.array(*(F.array(*map(F.lit, s)) for s in stacks))
    inside = F.size(F.array_except("_s", "basket")) == 0
    return (
        held.withColumn("_s", F.explode(each))
        .groupBy(F.array_join("_s", " + ").alias("stack"))
        .agg(F.coalesce(F.sum(F.when(inside, F.col("weight"))), F.lit(0)).alias("jobs"))
    )


@catalogue.add(
    "recount_audit",
    f"""WITH {BASKETS}, again AS (SELECT skill, count(DISTINCT job_id) AS b FROM m GROUP BY 1)
    SELECT CASE WHEN f.skill IS NULL THEN 'missing' WHEN again.skill IS NULL THEN 'extra' WHEN f.jobs = again.b THEN 'same' ELSE 'differs' END AS status, count(*) AS skills
    FROM f FULL JOIN again ON again.skill = f.skill GROUP BY 1""",
)
def recount_audit(spark, sf_dir):
    m = mentions(spark, sf_dir)
    mine = basket.item_frequency(facts.baskets(m.select("job_id", "skill").distinct())).select("skill", F.col("jobs").alias("a"))
    again = m.groupBy("skill").agg(F.countDistinct("job_id").alias("b"))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.col("a") == F.col("b"), "same").otherwise("differs")
    return mine.join(again, "skill", "full").groupBy(status.alias("status")).agg(F.count("*").alias("skills"))


@catalogue.add(
    "monthly_calendar",
    """WITH d AS (SELECT CAST(date_trunc('month', TRY_CAST(posting_date AS DATE)) AS DATE) AS m FROM jobs WHERE TRY_CAST(posting_date AS DATE) IS NOT NULL),
    c AS (SELECT CAST(unnest(generate_series((SELECT min(m) FROM d), (SELECT max(m) FROM d), INTERVAL 1 MONTH)) AS DATE) AS period)
    SELECT c.period, count(d.m) AS jobs, sum(count(d.m)) OVER (ORDER BY c.period)::BIGINT AS running FROM c LEFT JOIN d ON d.m = c.period GROUP BY 1""",
)
def monthly_calendar(spark, sf_dir):
    months = dated_jobs(spark, sf_dir).filter(F.col("day").isNotNull()).groupBy(F.date_trunc("MONTH", "day").cast("date").alias("period")).agg(F.count("*").alias("n"))
    every = months.agg(F.sequence(F.min("period"), F.max("period"), F.expr("interval 1 month")).alias("_p")).select(F.explode("_p").alias("period"))
    # One row for each month of the calendar, so a single window is small.
    return every.join(months, "period", "left").select("period", F.coalesce("n", F.lit(0)).cast("long").alias("jobs")).withColumn(
        "running", F.sum("jobs").over(W.orderBy("period"))
    )


@catalogue.add(
    "aligned_records",
    """WITH e AS (SELECT DISTINCT job_id, regexp_replace(lower(trim(source_url)), '/+$', '') AS u FROM extraction_results),
    eu AS (SELECT u, min(job_id) AS record FROM e WHERE u <> '' GROUP BY 1), ei AS (SELECT DISTINCT job_id FROM e)
    SELECT j.job_id, coalesce(eu.record, ei.job_id) AS record, CASE WHEN eu.record IS NOT NULL THEN 'url' WHEN ei.job_id IS NOT NULL THEN 'id' ELSE 'none' END AS way
    FROM jobs j LEFT JOIN eu ON eu.u = regexp_replace(lower(trim(j.source_url)), '/+$', '') LEFT JOIN ei ON ei.job_id = j.job_id""",
)
def aligned_records(spark, sf_dir):
    raw = table(spark, sf_dir, "extraction_results").select("job_id", canonical_url(F.col("source_url")).alias("_u")).distinct()
    by_url = raw.filter(F.col("_u") != "").groupBy("_u").agg(F.min("job_id").alias("_record"))
    by_id = raw.select(F.col("job_id").alias("_id")).distinct()
    jobs = table(spark, sf_dir, "jobs").select("job_id", canonical_url(F.col("source_url")).alias("_own"))
    both = jobs.join(by_url, F.col("_own") == F.col("_u"), "left").join(by_id, F.col("job_id") == F.col("_id"), "left")
    way = F.when(F.col("_record").isNotNull(), "url").when(F.col("_id").isNotNull(), "id").otherwise("none")
    return both.select("job_id", F.coalesce("_record", "_id").alias("record"), way.alias("way"))


@catalogue.add("posted_between", "SELECT job_id, posting_date FROM jobs WHERE TRY_CAST(posting_date AS DATE) BETWEEN DATE '2025-01-01' AND DATE '2025-03-31'")
def posted_between(spark, sf_dir):
    day = F.to_date(F.try_to_timestamp("posting_date"))
    return table(spark, sf_dir, "jobs").filter(day.between("2025-01-01", "2025-03-31")).select("job_id", "posting_date")


@catalogue.add(
    "stream_upsert",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1",
)
def stream_upsert(spark, sf_dir):
    events = mb.table_stream(spark, sf_dir, "events", files_per_batch=1).select("user_id", "event_id", "ts")
    return mb.upserted_stream(events, "user_id", ["ts", "event_id"])


@catalogue.add("stream_not_ahead", "SELECT event_type, count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def stream_not_ahead(spark, sf_dir):
    events = mb.not_ahead(mb.table_stream(spark, sf_dir, "events").select("event_type", "ts"), "ts", "2024-01-15 00:00:00")
    return mb.drained(events.groupBy("event_type").agg(F.count("*").alias("n")), "complete")
