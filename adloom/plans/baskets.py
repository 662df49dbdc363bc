"""Basket queries over the extracted skills."""

from __future__ import annotations

from adloom.operators import basket, facts
from adloom.plans.registry import Catalogue
from adloom.plans.sqltext import BASKETS, MENTIONS
from adloom.session import table

catalogue = Catalogue()


def mentions(spark, sf_dir):
    return facts.skill_mentions(table(spark, sf_dir, "extracted_skills"), table(spark, sf_dir, "skills"))


def baskets(spark, sf_dir):
    return facts.baskets(mentions(spark, sf_dir).select("job_id", "skill").distinct())


@catalogue.add("skill_mentions", f"WITH {MENTIONS} SELECT * FROM m")
def skill_mentions(spark, sf_dir):
    return mentions(spark, sf_dir)


@catalogue.add(
    "skill_frequency",
    f"WITH {BASKETS} SELECT skill, jobs, round(jobs * 100.0::DOUBLE / n.n, 2) AS pct FROM f, n",
)
def skill_frequency(spark, sf_dir):
    return basket.item_frequency(baskets(spark, sf_dir))


@catalogue.add("pair_frequency", f"WITH {BASKETS} SELECT * FROM p")
def pair_frequency(spark, sf_dir):
    return basket.pair_frequency(baskets(spark, sf_dir))


@catalogue.add(
    "cooccurrence_matrix",
    f"""WITH {BASKETS}, u AS (SELECT v.skill_a, v.skill_b, coalesce(p.jobs, 0) AS jobs FROM v LEFT JOIN p USING (skill_a, skill_b))
    SELECT skill AS skill_a, skill AS skill_b, jobs FROM f UNION ALL SELECT * FROM u UNION ALL SELECT skill_b, skill_a, jobs FROM u""",
)
def cooccurrence_matrix(spark, sf_dir):
    return basket.cooccurrence_matrix(baskets(spark, sf_dir))


_JACCARD = "jac AS (SELECT v.skill_a, v.skill_b, round(coalesce(p.jobs, 0)::DOUBLE / (v.jobs_a + v.jobs_b - coalesce(p.jobs, 0)), 6) AS jaccard FROM v LEFT JOIN p USING (skill_a, skill_b))"
_PMI = """pm AS (
  SELECT skill_a, skill_b, jobs, round(s, 6) AS pmi,
         round(CASE WHEN h > 0 THEN greatest(least(s / h, 1.0), -1.0) WHEN s > 0 THEN 1.0 ELSE 0.0 END, 6) AS npmi
  FROM (SELECT p.skill_a, p.skill_b, p.jobs, log2(p.jobs::DOUBLE * n.n / (v.jobs_a * v.jobs_b)) AS s, -log2(p.jobs::DOUBLE / n.n) AS h
        FROM p JOIN v USING (skill_a, skill_b), n))"""


@catalogue.add("skill_jaccard", f"WITH {BASKETS}, {_JACCARD} SELECT * FROM jac")
def skill_jaccard(spark, sf_dir):
    return basket.jaccard(baskets(spark, sf_dir))


@catalogue.add("skill_pmi", f"WITH {BASKETS}, {_PMI} SELECT * FROM pm")
def skill_pmi(spark, sf_dir):
    return basket.pmi(baskets(spark, sf_dir))


@catalogue.add(
    "association_rules",
    f"""WITH {BASKETS}, r AS (SELECT p.*, v.jobs_a, v.jobs_b, n.n FROM p JOIN v USING (skill_a, skill_b), n WHERE p.jobs::DOUBLE / n.n >= 0.01)
    SELECT skill_a AS antecedent, skill_b AS consequent, jobs::DOUBLE / n AS support, jobs::DOUBLE / jobs_a AS confidence,
           jobs::DOUBLE * n / (jobs_a * jobs_b) AS lift FROM r
    UNION ALL SELECT skill_b, skill_a, jobs::DOUBLE / n, jobs::DOUBLE / jobs_b, jobs::DOUBLE * n / (jobs_a * jobs_b) FROM r""",
)
def association_rules(spark, sf_dir):
    return basket.association_rules(baskets(spark, sf_dir))


@catalogue.add(
    "strong_rules",
    f"""WITH {BASKETS}, r AS (SELECT p.*, v.jobs_a, v.jobs_b, n.n FROM p JOIN v USING (skill_a, skill_b), n
      WHERE p.jobs::DOUBLE / n.n >= CASE WHEN n.n < 20 THEN greatest(0.01, 1.0::DOUBLE / n.n) ELSE greatest(0.01, 2.0::DOUBLE / n.n) END),
    d AS (SELECT skill_a AS antecedent, skill_b AS consequent, jobs::DOUBLE / jobs_a AS confidence, jobs::DOUBLE * n / (jobs_a * jobs_b) AS lift FROM r
    UNION ALL SELECT skill_b, skill_a, jobs::DOUBLE / jobs_b, jobs::DOUBLE * n / (jobs_a * jobs_b) FROM r)
    SELECT * FROM d WHERE confidence >= 0.1 AND lift >= 1.2""",
)
def strong_rules(spark, sf_dir):
    from pyspark.sql import functions as F

    b = baskets(spark, sf_dir)
    rules = basket.association_rules(b, 0.0).filter(F.col("support") >= basket.adaptive_support(b))
    return rules.filter("confidence >= 0.1 AND lift >= 1.2").select("antecedent", "consequent", "confidence", "lift")


@catalogue.add(
    "frequent_stacks",
    f"""WITH {BASKETS}, k AS (SELECT skill FROM f, n WHERE f.jobs::DOUBLE / n.n >= 0.05), q AS (SELECT b.* FROM b JOIN k USING (skill)),
    s2 AS (SELECT x.job_id, x.skill AS a, y.skill AS b FROM q x JOIN q y ON x.job_id = y.job_id AND x.skill < y.skill),
    s3 AS (SELECT s2.*, z.skill AS c FROM s2 JOIN q z ON s2.job_id = z.job_id AND z.skill > s2.b),
    s4 AS (SELECT s3.*, z.skill AS d FROM s3 JOIN q z ON s3.job_id = z.job_id AND z.skill > s3.c),
    t AS (SELECT a || ' + ' || b AS stack, 2 AS size, count(*) AS jobs FROM s2 GROUP BY 1
          UNION ALL SELECT a || ' + ' || b || ' + ' || c, 3, count(*) FROM s3 GROUP BY 1
          UNION ALL SELECT a || ' + ' || b || ' + ' || c || ' + ' || d, 4, count(*) FROM s4 GROUP BY 1)
    SELECT stack, size, jobs, round(jobs::DOUBLE / n.n, 6) AS support, CASE WHEN jobs >= 2 THEN 'recurring' ELSE 'single' END AS class
    FROM t, n WHERE jobs::DOUBLE / n.n >= 0.05""",
)
def frequent_stacks(spark, sf_dir):
    return basket.frequent_stacks(baskets(spark, sf_dir))


_RELATION = f"{_JACCARD}, {_PMI}, rt AS (SELECT skill_a, skill_b, pm.jobs, jaccard, pmi, npmi, round(jaccard * greatest(pmi, 0.0), 6) AS strength FROM pm JOIN jac USING (skill_a, skill_b))"


@catalogue.add("relationship_table", f"WITH {BASKETS}, {_RELATION} SELECT * FROM rt")
def relationship_table(spark, sf_dir):
    return basket.relationship_table(baskets(spark, sf_dir))


@catalogue.add(
    "network_edges",
    f"WITH {BASKETS}, {_RELATION} SELECT * FROM rt WHERE jobs >= 5 OR (SELECT max(jobs) FROM p) < 5",
)
def network_edges(spark, sf_dir):
    return basket.network_edges(baskets(spark, sf_dir), 5)


@catalogue.add(
    "node_degrees",
    f"""WITH {BASKETS}, ed AS (SELECT * FROM p WHERE jobs >= 5 OR (SELECT max(jobs) FROM p) < 5),
    en AS (SELECT skill_a AS skill, jobs FROM ed UNION ALL SELECT skill_b, jobs FROM ed)
    SELECT skill, count(*) AS degree, sum(jobs)::BIGINT AS weighted_degree,
      (SELECT round(CASE WHEN k > 1 THEN 2.0::DOUBLE * (SELECT count(*) FROM ed) / (k * (k - 1)) ELSE 0.0 END, 6) FROM (SELECT count(DISTINCT skill)::DOUBLE AS k FROM en)) AS density
    FROM en GROUP BY 1""",
)
def node_degrees(spark, sf_dir):
    return basket.node_degrees(basket.network_edges(baskets(spark, sf_dir), 5))


@catalogue.add(
    "graph_components",
    f"""WITH RECURSIVE {BASKETS}, ed AS (SELECT skill_a AS x, skill_b AS y FROM p WHERE jobs >= 5 UNION SELECT skill_b, skill_a FROM p WHERE jobs >= 5),
    reach(x, y) AS (SELECT x, x FROM ed UNION SELECT r.x, e.y FROM reach r JOIN ed e ON r.y = e.x)
    SELECT x AS skill, min(y) AS component FROM reach GROUP BY 1""",
)
def graph_components(spark, sf_dir):
    edges = basket.pair_frequency(baskets(spark, sf_dir)).filter("jobs >= 5")
    return basket.components(edges)


@catalogue.add("graph_centrality")
def graph_centrality(spark, sf_dir):
    return basket.centrality(basket.network_edges(baskets(spark, sf_dir), 5))


@catalogue.add("graph_communities")
def graph_communities(spark, sf_dir):
    return basket.communities(basket.network_edges(baskets(spark, sf_dir), 5))


@catalogue.add(
    "ego_network",
    f"""WITH {BASKETS}, {_RELATION} SELECT * FROM rt WHERE skill_a = 'Corvid SQL' OR skill_b = 'Corvid SQL'
    ORDER BY strength DESC, skill_a, skill_b LIMIT 10""",
)
def ego_network(spark, sf_dir):
    return basket.ego_edges(basket.relationship_table(baskets(spark, sf_dir)), "Corvid SQL", 10)


@catalogue.add(
    "method_overlap",
    f"""WITH {MENTIONS}, o AS (SELECT job_id, skill, bool_or(method = 'lexical') AS x, bool_or(method = 'semantic') AS y FROM m GROUP BY 1, 2)
    SELECT skill, CASE WHEN x AND y THEN 'both' WHEN x THEN 'lexical_only' ELSE 'semantic_only' END AS side, count(*) AS jobs
    FROM o GROUP BY 1, 2""",
)
def method_overlap(spark, sf_dir):
    return basket.method_overlap(mentions(spark, sf_dir))


@catalogue.add(
    "pair_evidence",
    f"""WITH {BASKETS}, t AS (SELECT skill_a, skill_b, jobs FROM p ORDER BY jobs DESC, skill_a, skill_b LIMIT 10)
    SELECT t.skill_a, t.skill_b, t.jobs, min(x.job_id) AS first_job FROM t
    JOIN b x ON x.skill = t.skill_a JOIN b y ON y.skill = t.skill_b AND y.job_id = x.job_id GROUP BY 1, 2, 3""",
)
def pair_evidence(spark, sf_dir):
    from pyspark.sql import functions as F

    items = mentions(spark, sf_dir).select("job_id", "skill").distinct()
    top = basket.pair_frequency(facts.baskets(items)).orderBy(F.desc("jobs"), "skill_a", "skill_b").limit(10)
    held = items.groupBy("job_id").agg(F.collect_set("skill").alias("has"))
    a = top.join(items.withColumnRenamed("skill", "skill_a"), "skill_a").join(held, "job_id")
    return a.filter(F.array_contains("has", F.col("skill_b"))).groupBy("skill_a", "skill_b", "jobs").agg(F.min("job_id").alias("first_job"))


@catalogue.add(
    "coverage_report",
    f"""WITH {MENTIONS} SELECT (SELECT count(*) FROM jobs) AS jobs,
      (SELECT count(DISTINCT job_id) FROM m WHERE method = 'lexical') AS with_lexical,
      (SELECT count(DISTINCT job_id) FROM m WHERE method = 'semantic') AS with_semantic,
      (SELECT round(count(DISTINCT job_id) * 100.0::DOUBLE / (SELECT count(*) FROM jobs), 2) FROM m) AS coverage_pct,
      (SELECT count(DISTINCT skill) FROM m) AS skills, (SELECT count(*) FROM extracted_skills) AS raw_mentions""",
)
def coverage_report(spark, sf_dir):
    from pyspark.sql import functions as F

    m = mentions(spark, sf_dir)
    jobs = table(spark, sf_dir, "jobs").agg(F.count("*").alias("n")).scalar()
    raw = table(spark, sf_dir, "extracted_skills").agg(F.count("*").alias("n")).scalar()

    def of(method):
        return F.countDistinct(F.when(F.col("method") == method, F.col("job_id")))

    return m.agg(
        of("lexical").alias("with_lexical"), of("semantic").alias("with_semantic"),
        F.countDistinct("job_id").alias("_c"), F.countDistinct("skill").alias("skills"),
    ).select(
        jobs.alias("jobs"), "with_lexical", "with_semantic", F.round(F.col("_c") * 100.0 / jobs, 2).alias("coverage_pct"),
        "skills", raw.alias("raw_mentions"),
    )
