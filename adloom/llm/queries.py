"""Queries of the training-data problems over texts and item lists, with their SQL."""

from __future__ import annotations

from adloom.llm import boilerplate, cooccurrence, matching, packing, personal, tokens, truncation
from adloom.plans.registry import Catalogue
from adloom.session import table

catalogue = Catalogue()

_PAIRS = r"""
    WITH once AS (
      SELECT DISTINCT job_id, skills_raw FROM extraction_results WHERE skills_raw IS NOT NULL AND job_id IS NOT NULL
    ), parts AS (
      SELECT job_id, unnest(
        CASE WHEN trim(skills_raw) LIKE '[%]'
             THEN regexp_extract_all(skills_raw, '"[^"]*"|''[^'']*''|[^\[\],"'']+')
             ELSE regexp_split_to_array(skills_raw, '[;|\n,]') END) AS part
      FROM once
    ), said AS (
      SELECT job_id, lower(trim(regexp_replace(trim(part), '^["'']|["'']$', '', 'g'))) AS item FROM parts
    ), names AS (
      SELECT DISTINCT skill_id, lower(trim(name)) AS name FROM (
        SELECT skill_id, canonical_name AS name FROM skills
        UNION ALL SELECT skill_id, unnest(CAST(aliases_json AS JSON)::VARCHAR[]) FROM skills)
    ), has AS (
      SELECT DISTINCT job_id, CAST(skill_id AS BIGINT) AS s FROM said JOIN names ON item = name
    ), total AS (SELECT count(DISTINCT job_id) AS n FROM has),
    single AS (SELECT s, count(*) AS n FROM has GROUP BY s),
    both_ AS (
      SELECT x.s AS a, y.s AS b, count(*) AS n FROM has x JOIN has y ON x.job_id = y.job_id AND x.s < y.s GROUP BY 1, 2
    )
"""


@catalogue.add("p1_found")
def p1_found(spark, sf_dir):
    names = ("jobs", "ref_locations", "ref_titles", "skills")
    return truncation.truncated_values(*(table(spark, sf_dir, t) for t in names))


@catalogue.add("p1_report")
def p1_report(spark, sf_dir):
    names = ("jobs", "ref_locations", "ref_titles", "skills")
    return truncation.truncation_report(*(table(spark, sf_dir, t) for t in names))


@catalogue.add("p2_found")
def p2_found(spark, sf_dir):
    names = ("jobs", "extraction_results", "ref_locations", "ref_titles", "skills")
    return boilerplate.boilerplate_pieces(*(table(spark, sf_dir, t) for t in names))


def _entries(spark, sf_dir):
    tables = ("jobs", "ref_locations", "ref_titles", "ref_countries", "ref_sources")
    return matching.canonical_entries(*(table(spark, sf_dir, t) for t in tables))


@catalogue.add("p3_found")
def p3_found(spark, sf_dir):
    return _entries(spark, sf_dir)


@catalogue.add("p3_unmatched")
def p3_unmatched(spark, sf_dir):
    return matching.unmatched_report(_entries(spark, sf_dir), table(spark, sf_dir, "jobs"))


@catalogue.add(
    "p5_found",
    _PAIRS
    + """
    SELECT a AS skill_id_a, b AS skill_id_b
    FROM both_, total, single x, single y
    WHERE x.s = a AND y.s = b AND both_.n >= 3 AND 400 * both_.n >= total.n AND both_.n * total.n >= 2 * x.n * y.n
    """,
)
def p5_found(spark, sf_dir):
    scores = cooccurrence.skill_pairs(table(spark, sf_dir, "extraction_results"), table(spark, sf_dir, "skills"))
    return cooccurrence.frequent_pairs(scores)


@catalogue.add(
    "p5_scores",
    _PAIRS
    + """
    SELECT a AS skill_id_a, b AS skill_id_b, both_.n AS n_ab, x.n AS n_a, y.n AS n_b, total.n AS n_baskets,
           round(both_.n / total.n, 6) AS support,
           round(both_.n / x.n, 6) AS confidence_ab,
           round(both_.n / y.n, 6) AS confidence_ba,
           round(CAST(both_.n AS DOUBLE) * total.n / (x.n * y.n), 6) AS lift,
           round(CASE WHEN both_.n < x.n THEN (1 - y.n / total.n) / (1 - both_.n / x.n) END, 6) AS conviction_ab,
           round(log2(CAST(both_.n AS DOUBLE) * total.n / (x.n * y.n)), 6) AS pmi,
           round(CASE WHEN both_.n < total.n
                 THEN log2(CAST(both_.n AS DOUBLE) * total.n / (x.n * y.n)) / -log2(both_.n / total.n)
                 ELSE 1.0 END, 6) AS npmi
    FROM both_, total, single x, single y WHERE x.s = a AND y.s = b
    """,
)
def p5_scores(spark, sf_dir):
    return cooccurrence.skill_pairs(table(spark, sf_dir, "extraction_results"), table(spark, sf_dir, "skills"))


@catalogue.add("p8_ids")
def p8_ids(spark, sf_dir):
    return tokens.encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


@catalogue.add("p9_containers")
def p9_containers(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


@catalogue.add("p9_fill")
def p9_fill(spark, sf_dir):
    limits = table(spark, sf_dir, "pack_limits")
    return packing.fill_report(packing.packed(table(spark, sf_dir, "documents"), limits), limits)


@catalogue.add("p10_found")
def p10_found(spark, sf_dir):
    return personal.personal_found(table(spark, sf_dir, "documents"))


@catalogue.add("p10_texts")
def p10_texts(spark, sf_dir):
    # A key for the test tables only; every corpus takes a secret one of its own.
    return personal.readable_texts(table(spark, sf_dir, "documents"), key="key of the test tables")
