"""Queries of the training-data problems that belong to the core: units, history, instants."""

from __future__ import annotations

from adloom.operators.history import validity_periods
from adloom.operators.instants import normalised_dates
from adloom.operators.units import monthly_pay
from adloom.plans.registry import Catalogue
from adloom.session import table

catalogue = Catalogue()


@catalogue.add("p4_found")
def p4_found(spark, sf_dir):
    return monthly_pay(*(table(spark, sf_dir, t) for t in ("jobs", "ref_units", "ref_countries")))


@catalogue.add(
    "p6_found",
    """
    WITH seen AS (
      SELECT DISTINCT job_id, lower(trim(content_hash)) AS h, version_id,
             epoch_us(CAST(observed_at AS TIMESTAMPTZ)) AS t
      FROM job_versions WHERE trim(content_hash) <> ''
    ), marked AS (
      SELECT *, lag(h) OVER (PARTITION BY job_id ORDER BY t, version_id, h) AS prev FROM seen
    ), runs AS (
      SELECT job_id, h, t,
             lead(t) OVER (PARTITION BY job_id ORDER BY t, version_id, h) AS nxt,
             row_number() OVER (PARTITION BY job_id ORDER BY t, version_id, h) AS k
      FROM marked WHERE prev IS NULL OR prev <> h
    )
    SELECT r.job_id, r.h AS content_hash,
           strftime(make_timestamp(CASE WHEN k = 1 THEN epoch_us(CAST(first_seen_at AS TIMESTAMPTZ)) ELSE t END),
                    '%Y-%m-%d %H:%M:%S') AS valid_from,
           strftime(make_timestamp(coalesce(nxt, epoch_us(CAST(last_seen_at AS TIMESTAMPTZ)))),
                    '%Y-%m-%d %H:%M:%S') AS valid_to
    FROM runs r JOIN jobs j ON r.job_id = j.job_id
    """,
)
def p6_found(spark, sf_dir):
    return validity_periods(table(spark, sf_dir, "job_versions"), table(spark, sf_dir, "jobs"))


@catalogue.add("p7_found")
def p7_found(spark, sf_dir):
    return normalised_dates(table(spark, sf_dir, "extraction_results"), table(spark, sf_dir, "ref_sources"))
