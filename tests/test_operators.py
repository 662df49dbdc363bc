"""Hand values of the core operators, empty inputs, files and safety checks."""

from __future__ import annotations

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from adloom.functions import text as tx
from adloom.operators import basket, extract, facts, quality, roles, store, temporal
from adloom.plans import quality_store
from adloom.sources import files

TRAYS = {
    "t1": "tea cup spoon",
    "t2": "tea cup",
    "t3": "tea cup pot",
    "t4": "ink pen pot",
    "t5": "ink pen",
}


@pytest.fixture(scope="module")
def trays(spark):
    rows = [(t, item) for t, items in TRAYS.items() for item in items.split()]
    return facts.baskets(spark.createDataFrame(rows * 2, "job_id string, skill string").distinct())


@pytest.fixture(scope="module")
def none(spark):
    return facts.baskets(spark.createDataFrame([], "job_id string, skill string"))


def test_matrix(trays):
    m = {(r.skill_a, r.skill_b): r.jobs for r in basket.cooccurrence_matrix(trays).collect()}
    assert m["tea", "tea"] == 3 and m["cup", "tea"] == m["tea", "cup"] == 3 and m["ink", "tea"] == 0 and m["pot", "pot"] == 2


def test_similarity(trays):
    j = {(r.skill_a, r.skill_b): r.jaccard for r in basket.jaccard(trays).collect()}
    assert j["pot", "tea"] == 0.25 and j["ink", "pen"] == 1.0
    p = {(r.skill_a, r.skill_b): r for r in basket.pmi(trays).collect()}
    assert p["ink", "pen"].pmi == round(math.log2(2.5), 6) and p["ink", "pen"].npmi == 1.0
    for r in basket.association_rules(trays).collect():
        pair = p[min(r.antecedent, r.consequent), max(r.antecedent, r.consequent)]
        assert math.isclose(r.lift, 2**pair.pmi, rel_tol=1e-5)


def test_empty_keeps_schema(none):
    for f in (basket.item_frequency, basket.pair_frequency, basket.cooccurrence_matrix, basket.jaccard, basket.pmi, basket.association_rules, basket.frequent_stacks, basket.relationship_table):
        df = f(none)
        assert df.columns and df.count() == 0


def test_components_and_centrality(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("d", "e", 2)], "skill_a string, skill_b string, jobs long")
    assert {r.skill: r.component for r in basket.components(edges).collect()} == dict(a="a", b="a", c="a", d="d", e="d")
    c = {r.skill: r for r in basket.centrality(edges).collect()}
    assert c["b"].betweenness == 1.0 and c["a"].betweenness == 0.0 and c["b"].closeness == 1.0 and c["a"].closeness == round(2 / 3, 6)


def test_distinctiveness(spark):
    rows = []
    for role, own, with_it, without in (("north", "snow", 21, 14), ("south", "sand", 33, 12)):
        for i in range(with_it + without):
            job = f"{role}{i}"
            rows += [(job, role, "lexical", "rain")] + ([(job, role, "lexical", own)] if i < with_it else [])
    t = roles.contingency(spark.createDataFrame(rows, "job_id string, role string, method string, skill string"))
    got = {(r.role, r.skill): r for r in roles.distinctiveness(t).collect()}
    r = got["north", "snow"]
    assert (r.a, r.b, r.c, r.d) == (21, 14, 0, 45) and r.test == "chi_square" and r["rank"] == 1 and r.p_value < 0.05
    assert got["north", "rain"].test == "none" and got["north", "rain"]["rank"] is None


def test_bootstrap_tests_again(spark):
    rows = [(f"{r}{i}", r, m, s) for r in "xy" for i in range(40) for m in ("lexical", "semantic") for s in ("common", f"own_{r}")]
    rows += [(f"x{i}", "x", "lexical", "barely") for i in range(7)]
    f = spark.createDataFrame(rows, "job_id string, role string, method string, skill string")
    got = {(r.role, r.method, r.skill): (r.hits, r.hit_rate) for r in roles.bootstrap_stability(f).collect()}
    # What all jobs have is frequent but never distinctive.
    assert set(got) == {(r, m, f"own_{r}") for r in "xy" for m in ("lexical", "semantic")} | {("x", "lexical", "barely")}
    assert all(v == (30, 1.0) for k, v in got.items() if k[2] != "barely") and 0 < got["x", "lexical", "barely"][0] < 30
    tables = roles.drawn_tables(f, 30, 42).filter("method = 'lexical' and skill = 'own_x'").collect()
    assert len(tables) == 30 and all(t.b == t.c == 0 and t.a > 0 for t in tables) and len({t.a for t in tables}) > 3


def test_forest_feeds_back_and_is_scored(spark):
    rows = [("up_down", f"2{k:03}-01-01", [10.0, 20.0, 60.0][k % 3]) for k in range(30)] + [("short", f"2{k:03}-01-01", 5.0) for k in range(3)]
    series = spark.createDataFrame(rows, "skill string, period string, rate double").withColumn("period", F.to_date("period"))
    got = {(r.skill, r.step): r.forecast for r in temporal.forest_forecast(series).collect()}
    # The cycle goes on only if each forecast is fed back.
    assert set(got) == {("up_down", k) for k in (1, 2, 3)}
    assert all(abs(got["up_down", k] - v) < 2 for k, v in ((1, 10), (2, 20), (3, 60)))
    scores = {r.model: r for r in temporal.forest_origins(series).collect()}
    assert set(scores) == {"last_value", "mean_3", "linear", "forest"} and {r.n for r in scores.values()} == {18}
    assert scores["forest"].mae < 3 < scores["mean_3"].mae and scores["forest"].direction == 1.0


def test_stream_once_drops_no_late_file(spark, tmp_path):
    """Files for several micro-batches, the newest events first."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(200):
        at = dt.datetime(2024, 6, 1) - dt.timedelta(days=k)
        pq.write_table(pa.table({"event_id": pa.array([k, k // 2]), "ts": pa.array([at, at])}), folder / f"part-{k:05}.parquet")
        os.utime(folder / f"part-{k:05}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    got = [r.event_id for r in quality_store.stream_once(spark, str(tmp_path)).collect()]
    assert sorted(got) == list(range(200))


def test_every_label_above_the_threshold(spark):
    vectors = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "id long, e array<double>")
    means = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 2.0]), (9, [-1.0, 0.0])], "label int, centroid array<double>")
    got = sorted(map(tuple, extract.nearest_centroids(vectors, means, "id", "e", 0.5).collect()))
    assert got == [(1, 7, 0.7071), (1, 8, 0.7071), (2, 7, 1.0)]


def test_fisher():
    assert math.isclose(roles.fisher_exact(3, 0, 1, 4), 0.142857142857, rel_tol=1e-6)
    assert math.isclose(roles.fisher_exact(8, 2, 1, 5), 0.0349650349, rel_tol=1e-6)


def test_lexical(spark):
    skills = spark.createDataFrame([(1, "Kestrel", '["kestrel framework"]'), (2, "C++", "[]"), (3, "Go", None)], "skill_id int, canonical_name string, aliases_json string")
    texts = spark.createDataFrame([("a", "kestrel framework, C++ and Golang"), ("b", None), ("c", ""), ("d", "über GO! kestrels")], "k string, t string")
    got = {tuple(r) for r in extract.lexical_skills(texts, skills, "k", "t").collect()}
    assert got == {("a", 1), ("a", 2), ("d", 3)}


def test_urls_and_postings(spark):
    urls = ["https://a.example/x", "ftp://a.example", "http://u:p@a.example", "https://a.example:8443/", "https://x.bad.example", "http://10.0.0.1/", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.v for r in df.select(extract.url_verdict(F.col("u"), ["bad.example"]).alias("v")).collect()]
    assert got == ["ok", "scheme", "credentials", "port", "blocked", "private", "scheme"]
    page = '<script type="application/ld+json">{"@type": "JobPosting", "title": "Tester", "hiringOrganization": {"name": "F"}}</script>'
    r = spark.createDataFrame([(page,), ("<p>x</p>",)], "p string").select(extract.job_posting(F.col("p")).alias("j")).collect()
    assert r[0].j.title == "Tester" and r[0].j.company == "F" and r[1].j.title is None


def test_text(spark):
    df = spark.createDataFrame([("<p>A &amp; B</p><ul><li>x</li></ul><script>y</script>", " nan ")], "h string, n string")
    r = df.select(tx.clean_html(F.col("h")).alias("c"), tx.paragraphs(F.col("h")).alias("p"), tx.null_if_placeholder(F.col("n")).alias("n")).first()
    assert r.c == "A & B x y" and r.p == "A & B\n• x" and r.n is None


def test_keep_first_and_upsert(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 6)], "k string, v int")
    assert sorted(r.v for r in quality.keep_first(df, F.col("k"), [F.col("v")]).collect()) == [1, 5, 6]
    old = spark.createDataFrame([("a", "H1", 1), ("b", "h2", 1)], "id string, hash string, seen int")
    new = spark.createDataFrame([("a", "h1", 2), ("b", "h9", 2), ("c", "h3", 2), (None, "x", 2)], "id string, hash string, seen int")
    assert {r.id: r.action for r in store.classify_import(old, new, "id", "hash").collect()} == {"a": "skip", "b": "update", "c": "insert", None: "reject"}
    once = store.upserted(old, new, "id", "hash", "seen")
    rows = sorted(map(tuple, once.collect()))
    assert rows == [("a", "H1", 2), ("b", "h9", 2), ("c", "h3", 2)]
    assert sorted(map(tuple, store.upserted(once, new, "id", "hash", "seen").collect())) == rows


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"\nz', None)], "Job_ID string, text string, n string")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_text_csv(spark, str(tmp_path / "c"))
    assert tuple(back.first()) == ("a", 'x "y"\nz', "")
    assert files.read_csv_tree(spark, str(tmp_path)).columns[-1] == "_input_file"
    got = files.resolved(back, {"job_id": ["id"], "body": ["Text"], "none": []})
    assert tuple(got.first()) == ("a", 'x "y"\nz', None)
    files.write_json_lines(df, str(tmp_path / "j"))
    assert files.read_json_list(spark, str(tmp_path / "j")).count() == 1
    (tmp_path / "t.json").write_text('{"categories": [{"name": "lang", "skills": [{"id": "1", "name": "Go", "aliases": ["golang"]}]}]}')
    assert sorted(r.alias for r in files.read_taxonomy(spark, str(tmp_path / "t.json")).collect()) == ["go", "golang"]


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
