"""Hand values of cleaning, comparison by type, stores, pages, streams, communities and file formats."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from adloom.operators import basket, datasets, extract, history, pages, records, store, typed, units
from adloom.sources import files
from adloom.streaming import micro_batch as mb

RECORD = (
    "job_id string, source_job_id string, source_url string, source_platform string, collection_batch_id string, description_type string, "
    "extraction_status string, job_title_raw string, company_raw string, requirements_raw string, location_raw string, job_description_raw string, "
    "posted_date_raw string, closing_date_raw string, scraped_at string"
)
LONG = "<p>We look for somebody who keeps our trams running on time.</p><ul><li>Weekend duty</li><li>Night duty every other month, paid twice</li></ul>"


def record(job, sid=None, url=None, status="success", title="Tram Driver &amp; Guard", page=LONG, posted="3 days ago", at="2025-03-10T08:00:00Z"):
    return (job, sid, url or f"https://x.example/{job}", "x", "b1", "html_text", status, title, "Tram Co", None, " Old  Town ", page, posted, None, at)


def test_cleaning(spark):
    rows = [
        record("a", "7"), record("b", "7", at="2025-03-11T08:00:00Z"), record("c", url="https://X.example/a/#top"), record("d", title="X"),
        record("e", page="<p>short</p>"), record("f", posted="2031-01-05"), record("g", page="All terms and conditions apply."), record("h", page=None), record(None),
    ]
    clean = records.cleaned(spark.createDataFrame(rows, RECORD), "2025-08-01")
    got = {r.job_id: r for r in clean.collect()}
    assert got["a"].title == "Tram Driver & Guard" and got["a"].posted == "2025-03-07" and got["a"].date_method == "relative"
    assert "• Weekend duty" in got["a"].description.split("\n") and got["a"].location == "Old Town"
    assert {k: got[k].reason for k in "defgh"} == {"d": "short_title", "e": "short_description", "f": "future_date", "g": "short_description", "h": "short_description"}
    steps = records.deduplicated(clean)
    assert {r.job_id for r in steps[0].collect() if r.source_job_id} == {"b"}
    counts = {r.counter: r.n for r in records.exclusion_counts(clean, steps).collect()}
    assert counts["records"] == 9 and counts["removed_by_id"] == 1 and counts["internal"] == steps[2].count()
    assert records.exclusion_counts(clean.limit(0), records.deduplicated(clean.limit(0))).filter("n <> 0").count() == 0


def test_dates(spark):
    day = dt.datetime(2025, 3, 31, 12)
    cases = {
        "2 months ago": (dt.datetime(2025, 1, 31, 12), dt.date(2025, 1, 30)), "1 month ago": (dt.datetime(2025, 2, 28, 12), dt.date(2025, 3, 1)),
        "1 year ago": (dt.datetime(2024, 3, 31, 12), None), "5 hours ago": (dt.datetime(2025, 3, 31, 7), None), "a week ago": (None, dt.date(2025, 3, 24)),
        "today": (None, dt.date(2025, 3, 31)), "31.12.2024": (None, dt.date(2024, 12, 31)), "Fri, 02 May 2025 15:01": (None, dt.date(2025, 5, 2)),
        "20250229": (None, None), "31 Foo 2025": (None, None), "": (None, None),
    }
    df = spark.createDataFrame([(t, day) for t in cases], "t string, b timestamp")
    rows = df.select("t", records.ago_instant(F.col("t"), F.col("b")).alias("i"), records.posting_day(F.col("t"), F.to_date("b"))[0].alias("d")).collect()
    assert {r.t: (r.i, r.d) for r in rows} == cases


def test_outcomes_by_type(spark):
    texts = [("verified", "Zug-Fahrer", "zug fahrer"), ("verified", "பொறியாளர்", "ஆசிரியர்"), ("verified", "a b c d", "a b c e"), ("verified", "a b c d e", "e d c b a"), ("verified", "x", None),
             ("unavailable", None, "x"), ("unavailable", None, " "), ("ambiguous", "x", "y"), ("not_reviewed", "x", "y")]
    df = spark.createDataFrame(texts, "s string, e string, g string")
    got = [r.o for r in df.select(typed.text_outcome(F.col("s"), F.col("e"), F.col("g")).alias("o")).collect()]
    assert got == ["correct", "incorrect", "incorrect", "correct", "missing_prediction", "over_extracted", "correct_absence", "ambiguous_excluded", "not_reviewed"]
    pay = spark.createDataFrame(
        [(100.0, "1,00.5", "S$", "sgd", "per month", "monthly"), (100.0, "100", "rm", "usd", "", ""), (100.0, "100", "", "usd", "day", "hourly"), (None, "100", "", "", "", ""), (100.0, "no", "", "", "", "")],
        "e double, g string, ce string, cg string, pe string, pg string",
    )
    pairs = [tuple(f(F.col(c)) for c in cs) for f, cs in ((typed.currency_of, ("ce", "cg")), (typed.period_of, ("pe", "pg")))]
    got = [r.o for r in pay.select(typed.number_outcome(F.lit("verified"), F.col("e"), typed.number_of(F.col("g")), *pairs).alias("o")).collect()]
    assert got == ["correct", "incompatible_currency", "incompatible_pay_period", "over_extracted", "missing_prediction"]
    sets = spark.createDataFrame([(["a"], ["a", "b", "c"]), (["a", "b"], ["b", "c"]), (["a"], []), (["a", "b", "c"], ["a", "b"])], "e array<string>, g array<string>")
    got = [r.o for r in sets.select(typed.set_outcome(F.lit("verified"), F.col("e"), F.col("g")).alias("o")).collect()]
    assert got == ["correct", "incorrect", "missing_prediction", "correct"]
    long = spark.createDataFrame([("t", o, None) for o in ("correct", "correct", "incorrect", "missing_prediction", "over_extracted", "correct_absence")], "field string, outcome string, error double")
    r = typed.outcome_figures(long).first()
    assert (r.eligible, r.matched, r.coverage, r.correctness, r.recall, r.hallucination) == (4, 3, 0.75, 0.6667, 0.5, 0.5)
    assert typed.outcome_figures(long.limit(0)).count() == 0


def test_stores(spark):
    old = spark.createDataFrame([("a", "H1"), ("b", "h2")], "k string, h string")
    new = spark.createDataFrame([("a", "h1"), ("b", "h3"), ("c", "h4"), (None, "h5")], "k string, h string")
    history_ = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "k string, version_no long")
    assert {(r.k, r.h, r.version_no) for r in store.version_rows(old, new, history_, "k", "h").collect()} == {("b", "h3", 3), ("c", "h4", 1)}
    merged = store.merged(old, new.filter("k is not null"), "k")
    assert {tuple(r) for r in merged.collect()} == {("a", "h1"), ("b", "h3"), ("c", "h4")}
    assert {tuple(r) for r in store.merged(merged, new.filter("k is not null"), "k").collect()} == {tuple(r) for r in merged.collect()}
    runs = spark.createDataFrame([("r1", "x", "1"), ("r2", "x", "2"), ("r3", "y", None)], "run string, kind string, at string")
    assert {r.run for r in store.latest_flags(runs, "kind", ["at", "run"]).filter("is_latest").collect()} == {"r2", "r3"}
    a, b = store.fingerprint(runs).first(), store.fingerprint(runs.orderBy(F.desc("run")).repartition(3)).first()
    assert a == b and store.fingerprint(runs.limit(2)).first() != a and store.fingerprint(runs.limit(0)).first().rows == 0


def test_small_json(spark):
    df = spark.createDataFrame([('{"b": "1"}',), ("no json",), (None,), ('["https://a.example/1"]',), ('["ftp://x"]',), ("[]",)], "t string")
    rows = df.select(datasets.json_updated(F.col("t"), a=F.lit("2")).alias("j"), datasets.valid_url_list(F.col("t")).alias("u")).collect()
    assert json.loads(rows[0].j) == {"a": "2", "b": "1"} and json.loads(rows[2].j) == {"a": "2"}
    assert [r.u for r in rows] == [False, False, False, True, False, True]


NESTED = """<html><head><title>Jobs</title><script type="application/ld+json">not json</script>
<script type="application/ld+json">{"@context": "x", "@graph": [{"@type": "WebSite"}, {"@type": ["Thing", "JobPosting"], "title": "Lock Keeper",
"hiringOrganization": {"name": "Canal &amp; Co"}, "jobLocation": [{"address": {"addressLocality": "Ghent", "addressCountry": {"name": "Belgium"}}}],
"baseSalary": {"currency": "EUR", "value": {"minValue": 2100, "maxValue": 2500, "unitText": "MONTH"}}, "description": "<p>Opens
locks</p>"}]}</script></head><body><h1>Other</h1><dl><dt>Closing date</dt><dd>1 June</dd></dl></body></html>"""


def test_pages(spark):
    adapter = pages.by_host("shop", "shop.example", {"title": r"<b class=t>(.*?)</b>", "place": r"in <i>(.*?)</i>"})
    rows = [("https://a.example/1", NESTED), ("https://www.shop.example/1", "<b class=t>Baker</b> in <i>Lund</i><h1>No</h1>"), ("https://notshop.example/", "<b class=t>Baker</b><h1>Plain</h1>"), (None, " "), (None, None)]
    df = spark.createDataFrame(rows, "url string, html string").withColumn("fields", F.lit(1))
    got = pages.with_page_fields(df, "url", "html", registry=(pages.STRUCTURED, adapter, pages.GENERIC)).collect()
    f = got[0].fields_1
    assert (f.title, f.company, f.place, f.country, f.low, f.high, f.period, f.closes, f.extractor) == ("Lock Keeper", "Canal & Co", "Ghent", "Belgium", "2100", "2500", "MONTH", "1 June", "jsonld")
    assert f.description == "Opens locks"
    assert (got[1].fields_1.title, got[1].fields_1.place, got[1].fields_1.extractor) == ("Baker", "Lund", "shop")
    assert got[2].fields_1.title == "Plain" and got[3].fields_1 is None and got[4].fields_1 is None
    deep = {"@type": "JobPosting", "title": "x"}
    for _ in range(3000):
        deep = [deep]
    assert len(list(pages.nodes_of(deep, "JobPosting"))) == 1


def test_extraction_run_is_idempotent(spark):
    texts = spark.createDataFrame([("1", "knows Reeds and ropes"), ("2", "ropes"), ("3", None)], "job_id string, text string")
    skills = spark.createDataFrame([(1, "Reeds", "[]"), (2, "Rope", '["ropes"]')], "skill_id int, canonical_name string, aliases_json string")
    read = {"lexical": lambda t, s: extract.lexical_skills(t, s, "job_id", "text")}
    none = spark.createDataFrame([], "job_id string, run_id string, method string, skill_id long")
    first = extract.extraction_run(texts, skills, read, none, "r")
    assert {(r.job_id, r.skill_id) for r in first.collect()} == {("1", 1), ("1", 2), ("2", 2)}
    assert extract.extraction_run(texts, skills, read, first, "r").count() == 0


def test_communities(spark):
    def modularity(groups, edges):
        m = sum(w for *_, w in edges)
        at = {v: k for k, g in enumerate(groups) for v in g}
        deg = {}
        for a, b, w in edges:
            deg[a], deg[b] = deg.get(a, 0) + w, deg.get(b, 0) + w
        inside = sum(w for a, b, w in edges if at[a] == at[b]) / m
        return inside - sum((sum(deg[v] for v in g) / (2 * m)) ** 2 for g in groups)

    edges = [(a, b, 1.0) for group in ("abcd", "wxyz") for a, b in itertools.combinations(group, 2)] + [("d", "w", 1.0)]
    found = basket.modular(edges)
    assert found == [set("abcd"), set("wxyz")] and modularity(found, edges) > modularity([set("abcdwxyz")], edges)
    assert basket.modular(list(reversed(edges))) == found
    df = spark.createDataFrame([(a, b, 1) for a, b, _ in edges] + [("p", "q", 2)], "skill_a string, skill_b string, jobs long")
    got = {(r.component, r.community, r.skill) for r in basket.communities(df).collect()}
    assert {s for c, k, s in got if (c, k) == ("a", 0)} == set("abcd") and ("p", 0, "q") in got and len(got) == 10


def test_upserted_stream_goes_on_after_a_stop(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "user_id long, event_id long, ts long"

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return {r.user_id: r.event_id for r in mb.upserted_stream(stream, "user_id", ["ts", "event_id"], folder, 4).collect()}

    deliver([(k, k, 1) for k in range(20)])
    assert run() == {k: k for k in range(20)}
    deliver([(3, 103, 2), (4, 104, 0), (50, 150, 1)])
    assert run() == {**{k: k for k in range(20)}, 3: 103, 50: 150}
    assert run() == {**{k: k for k in range(20)}, 3: 103, 50: 150}


def test_late_rows_leave_the_windows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    day = dt.datetime(2025, 1, 1)
    times = [day, day + dt.timedelta(days=5), day + dt.timedelta(days=5, hours=1), day + dt.timedelta(minutes=1), day + dt.timedelta(days=9)]
    for k, at in enumerate(times):
        spark.createDataFrame([(at, "e", 1.0)], "ts timestamp, kind string, value double").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        part = next(p for p in (tmp_path / f"p{k}").iterdir() if p.suffix == ".parquet")
        part.rename(source / f"{k}.parquet")
        os.utime(source / f"{k}.parquet", (1_700_000_000 + k * 60,) * 2)
    stream = spark.readStream.schema("ts timestamp, kind string, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
    got = {r.window_start: r.n for r in mb.drained(mb.windowed_counts(stream, "ts", "kind", "value")).collect()}
    # The fourth file came after the watermark had passed its window; the last window is still open.
    assert got == dict.fromkeys(times[:3], 1)


def test_units_without_a_factor(spark):
    rows = [("1", "USD 123456789012345678901 per month"), ("2", "JPY 400,000 per month"), ("3", "CHF 6000 per month"), ("4", "XTS 50 a month"), ("5", "USD 100, 8 hours per day"), ("6", None), ("7", "USD 10 per week")]
    jobs = spark.createDataFrame([(j, t, None, "monthly", "Japan") for j, t in rows], "job_id string, salary_text_raw string, salary_currency_normalized string, salary_period_normalized string, country string")
    factors = spark.createDataFrame([("currency", "USD", 1.0, 1.0), ("currency", "XTS", 2.0, 1.0), ("period", "monthly", 1.0, 1.0)], "kind string, unit string, multiply_by double, divide_by double")
    countries = spark.createDataFrame([("Japan", "JP", "USD")], "country string, code string, currency string")
    got = {r.job_id: r.usd_month_min for r in units.monthly_pay(jobs, factors, countries).collect()}
    assert got == {"4": 100, "5": 100}


def test_formats(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "wb") as f:
        f.write("Job ID;x\n".replace(";", ",").encode() + "1,größe\n2,\n".encode("latin-1"))
    df = files.read_upload(spark, path)
    assert [tuple(r) for r in df.collect()] == [("1", "größe"), ("2", "")]
    with open(path, "wb") as f:
        f.write("\ufeffa,b\n1,ü\n".encode())
    assert files.read_upload(spark, path).columns == ["a", "b"]
    words = files.read_keywords("## strong\nengineer | Engineer\n# note\n\ndeveloper\n## weak\ndata")
    assert words == {"strong": [("engineer", "Engineer"), ("developer", "developer")], "weak": [("data", "data")]}
    registry = files.read_registry(spark, _json(tmp_path, [{"host": "a.example", "aliases": ["www.a.example"], "status": "open"}, {"host": "b.example", "status": "restricted"}]))
    assert {(r.host, r.status) for r in registry.collect()} == {("a.example", "open"), ("www.a.example", "open"), ("b.example", "restricted")}
    runs = files.found_runs(spark.createDataFrame([("/x/evaluation_20250102_030405.json",), ("/x/other.txt",)], "path string"))
    assert [(r.run, r.at) for r in runs.collect()] == [("20250102_030405", dt.datetime(2025, 1, 2, 3, 4, 5))]
    raw = files.to_raw_schema(spark.createDataFrame([("https://A.example/j/1", "Cook", None), ("https://a.example/j/2", None, "17")], "URL string, `Job Title` string, `Source Job ID` string"))
    got = {r.source_url: r for r in raw.collect()}
    assert got["https://a.example/j/2"].job_id == "a.example_17" and got["https://A.example/j/1"].job_id.startswith("a.example_hash_") and got["https://A.example/j/1"].job_title_raw == "Cook"
    bench = files.read_benchmark(spark.createDataFrame([("1", "verified", "1,200"), ("2", "odd", "x"), (None, "verified", "1")], "benchmark_id string, status_salary string, expected_salary_min string"))
    assert {(r.benchmark_id, r.problem) for r in bench.collect()} == {("1", None), ("2", "status_salary"), (None, "benchmark_id")}
    assert files.markdown_table(["a", "b"], [(1, "x|y"), (None, 2.5)]) == "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n|  | 2.5 |"
    out = str(tmp_path / "report")
    record_ = files.write_export(spark.createDataFrame([(1, ["a"])], "k int, v array<string>"), out, "figures")
    assert record_["rows"] == 1 and len(record_["sha256"]) == 64 and files.read_text_csv(spark, f"{out}/figures").first().v == '["a"]'


def _json(tmp_path, data):
    path = str(tmp_path / "r.json")
    with open(path, "w") as f:
        json.dump({"sources": data}, f)
    return path


def test_history_of_one_hot_entity(spark):
    """An entity with a third of all rows, and the same runs by a plain loop."""
    import random

    rng = random.Random(3)
    rows = [("hot", rng.randrange(10**15), rng.choice("ab")) for _ in range(3000)] + [(f"e{k % 700}", rng.randrange(10**15), "x") for k in range(6000)]
    got = history.coalesce_runs(spark.createDataFrame(rows, "e string, t long, p string"), "e", "t", "p").filter("entity = 'hot'").orderBy("lo").collect()
    runs = []
    for _, t, p in sorted({r for r in rows if r[0] == "hot"}, key=lambda r: (r[1], r[2])):
        if not runs or runs[-1][1] != p:
            runs.append((t, p))
    assert [(r.lo, r.payload) for r in got] == runs


def test_choices_and_scopes(spark):
    df = spark.createDataFrame([("x", " a "), ("x", "a"), (None, ""), ("y", None)], "c string, d string")
    assert {(r.column, r.value) for r in datasets.choices(df, "c", "d").collect()} == {("c", "x"), ("c", "y"), ("d", "a")}
    assert datasets.in_scope(df, c="All", d=None).count() == 4 and datasets.in_scope(df, c="x", d="a").count() == 2


def test_cluster_without_a_shared_folder(monkeypatch):
    from adloom import session

    class Context:
        master = "yarn"

    class Conf:
        def get(self, *_):
            return None

    class Spark:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session._shared_folder(Spark())
