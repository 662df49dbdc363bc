"""Operators over texts and item lists: hand values, brute force, round trips, odd inputs."""

from __future__ import annotations

import base64
import itertools
from collections import Counter
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adloom.llm import boilerplate, cooccurrence, matching, packing, personal, queries, tokens, truncation
from tests.llm import heldout
from tests.oracle import connection, difference


@pytest.mark.parametrize("name", sorted(queries.catalogue.queries))
def test_query(spark, sf_dir, name):
    df = queries.catalogue.queries[name](spark, sf_dir)
    if name in queries.catalogue.sql:
        mine, other = difference(df, connection(sf_dir), queries.catalogue.sql[name])
        assert not mine and not other, (list(mine)[:3], list(other)[:3])
    else:
        rows = df.count()
        assert rows > 0
        if name.endswith("_found"):
            assert df.distinct().count() == rows


# Truncation


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(6.0, 0.4, 20_000), 2)
    limit = 6.3
    values, n = np.unique(np.minimum(x, limit), return_counts=True)
    mean, dev = truncation.censored_fit(values, n.astype(float), limit)
    assert abs(mean - 6.0) < 0.02 and abs(dev - 0.4) < 0.02


def _texts(spark, rows):
    return spark.createDataFrame(rows, "key string, field string, source string, text string")


def test_truncated_endings(spark):
    rng = random.Random(1)
    nouns = ["batch jobs", "data models", "alert rules", "test suites"]
    rows = []
    for i in range(400):
        lines = [f"Answer questions about {rng.choice(nouns)}" for _ in range(3)] + [f"Degree in computing or {rng.randrange(9)} years in logistics"] * 2
        rng.shuffle(lines)
        rows.append((f"w{i}", "d", "s", "\n".join(lines)))
    cut = [("c1", "Degree in computing or 7 ye"), ("c2", "Answer questions about"), ("c3", "Degree in comp"), ("c4", "Degree in computing or 7 years in logist…")]
    whole = [("k1", "Degree in computing or 7 years in logistics"), ("k2", "Answer questions about data models"), ("k3", "Anything at all.")]
    rows += [(k, "d", "s", "Answer questions about batch jobs\n" + t) for k, t in cut + whole]
    rows += [("n1", "d", "s", None), ("n2", "d", "s", ""), ("n3", "d", "s", "  "), ("x", "d", None, "Degree in computing or 7 years in logistics\n" * 5000 + "Degree in comp")]
    got = {r.key for r in truncation.truncation_odds(_texts(spark, rows).fillna("", ["source"])).filter(F.col("log_odds") > truncation.CUT).collect()}
    assert got == {"c1", "c2", "c3", "c4", "x"}


def test_truncation_of_nothing(spark):
    assert truncation.truncation_odds(_texts(spark, [])).count() == 0


# Boilerplate


def test_pieces_are_numbered_by_tags_and_lines():
    page = "<div id='x 12'><p>One<br/>two</p>\n three &amp;<script>var a=1;</script></div> <b>four</b>"
    assert boilerplate.pieces(page) == [
        (1, "div#x 9/p", "One"), (2, "div#x 9/p", "two"), (3, "div#x 9", "three &amp;"), (4, "div#x 9/script", "var a=1;"), (5, "", "four"),
    ]
    assert boilerplate.pieces(None) == boilerplate.pieces("") == boilerplate.pieces(" \n ") == []
    assert len(boilerplate.pieces("<p>x" * 20_000)) == 20_000
    assert boilerplate.pieces("</p></div>a<")[0][2] == "a<"


def test_boilerplate(spark):
    body = "<main><article><p>{0} builds software, and {0} likes it.</p><ul><li>Write code for {1}</li></ul></article></main>"
    nav, foot = "<nav><a>Sign in</a><a>Saved jobs</a></nav>", "<footer><span>About Portal · Press</span></footer>"
    rows = []
    for i in range(60):
        firm, noun = f"Firm{i % 7} Labs", ["billing", "leasing"][i % 2]
        rows.append((f"h{i}", "s", "Portal", firm, nav + body.format(firm, noun) + foot))
    for i in range(60):  # the same words in a layout that tells nothing
        rows.append((f"d{i}", "s", "Portal", "F", f"<div><p>Sign in</p></div><div><p>Write code for {['billing', 'leasing'][i % 2]}</p></div>"))
    rows += [("n", "s", None, None, None), ("e", "s", None, None, ""), ("h0", "s", "Portal", "Firm0 Labs", rows[0][4])]
    records = spark.createDataFrame(rows, "job_id string, source_hostname string, source_platform string, company_raw string, job_description_raw string")
    plain = [("p1", "s", "Portal", "F", "Sign in\nWrite code for billing\nAbout Portal · Press"), ("p2", None, None, None, None)]
    jobs = spark.createDataFrame(plain, "job_id string, source_hostname string, source_platform string, company_name string, job_description string")
    dims = (
        spark.createDataFrame([("Here", "There", "Land")], "city string, region string, country string"),
        spark.createDataFrame([("Tester",)], "title string"),
        spark.createDataFrame([("Corvid",)], "canonical_name string"),
    )
    got = {(r.job_id, r.field, r.seg_no) for r in boilerplate.boilerplate_pieces(jobs, records, *dims).collect()}
    raw = "job_description_raw"
    want = {(f"h{i}", raw, k) for i in range(60) for k in (1, 2, 5)} | {(f"d{i}", raw, 1) for i in range(60)}
    assert got == want | {("p1", "job_description", 1), ("p1", "job_description", 3)}


def test_wording_is_the_whole_text():
    of = boilerplate.Wording(["St. Alwyn"], ["Data Steward"], []).of
    assert of("Data Steward, St. Alwyn (new)", "", "") == "\x02, \x05 (new)"
    assert of("Questions? Ask Ann.", "", "") != of("Questions? Call us.", "", "")
    assert of("word " * 200 + "one", "", "") != of("word " * 200 + "two", "", "")


def test_boilerplate_behind_a_shared_first_sentence(spark):
    page = "<nav><a>Questions? Visit our help centre.</a></nav><main><article><p>Questions? Ask the hiring team about shifts.</p></article></main>"
    mixed = "<div><p>Questions? Visit our help centre.</p></div><div><p>Questions? Ask the hiring team about shifts.</p></div>"
    rows = [(f"{k}{i}", "s", None, None, t) for k, t in (("h", page), ("d", mixed)) for i in range(30)]
    records = spark.createDataFrame(rows, "job_id string, source_hostname string, source_platform string, company_raw string, job_description_raw string")
    jobs = records.limit(0).withColumnsRenamed({"company_raw": "company_name", "job_description_raw": "job_description"})
    dims = (
        spark.createDataFrame([("Here", "There", "Land")], "city string, region string, country string"),
        spark.createDataFrame([("Tester",)], "title string"),
        spark.createDataFrame([("Corvid",)], "canonical_name string"),
    )
    got = {(r.job_id, r.seg_no) for r in boilerplate.boilerplate_pieces(jobs, records, *dims).collect()}
    assert got == {(f"{k}{i}", 1) for k in "hd" for i in range(30)}


def test_paths_by_ratio(spark):
    """Layouts whose tags tell nothing: length and punctuation select and reject paths."""
    rows = [("s", p, k, 40, 40 * size, 40 * marks) for k, (p, size, marks) in enumerate([("div/div", 7, 0), ("div/section", 200, 3), ("div/span", 40, 1), ("div/h3", 7, 0)])]
    rows += [("s", "script", 8, 40, 400_000, 9000), ("s", "main/p", 9, 40, 40, 0), ("s", "b/b", 10, 3, 21, 0)]
    got = boilerplate.path_ratios(spark.createDataFrame(rows, "source string, path string, said long, n long, chars long, marks long"))
    assert {r.path: r.label for r in got.collect()} == {
        "div/div": 1.0, "div/section": 0.0, "div/span": None, "div/h3": None, "script": 1.0, "main/p": 0.0, "b/b": None,
    }


def test_boilerplate_of_bare_layouts(spark):
    text = "We run the {0} depot for the region, and you will plan its shifts, check its stock, and train new staff; ask {1}."
    page = "<div><div>Sign in</div><section>" + text + "</section></div>"
    rows = [(f"d{i}", "s", None, None, page.format(["north", "south"][i % 2], ["us", "them"][i % 2])) for i in range(40)]
    records = spark.createDataFrame(rows, "job_id string, source_hostname string, source_platform string, company_raw string, job_description_raw string")
    jobs = records.limit(0).withColumnsRenamed({"company_raw": "company_name", "job_description_raw": "job_description"})
    dims = (
        spark.createDataFrame([("Here", "There", "Land")], "city string, region string, country string"),
        spark.createDataFrame([("Tester",)], "title string"),
        spark.createDataFrame([("Corvid",)], "canonical_name string"),
    )
    got = {(r.job_id, r.seg_no) for r in boilerplate.boilerplate_pieces(jobs, records, *dims).collect()}
    assert got == {(f"d{i}", 1) for i in range(40)}


# Matching


def test_slips():
    assert matching.slips("kandelle", "kandelle", 3) == 0
    assert matching.slips("kandelle", "kadnelle", 3) == 1
    assert matching.slips("kandelle", "kandlle", 3) == 1
    assert matching.slips("kandelle", "xandeele", 3) == 2
    assert matching.slips("abc", "abcdefgh", 3) == 4


def test_prefix_join_loses_no_pair(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    values, keys = sorted(set(words[:80])), sorted(set(words[60:]))
    a = spark.createDataFrame([("k", w) for w in values], "kind string, text string")
    b = spark.createDataFrame([("k", w) for w in keys] + [("other", "abcd")], "kind string, key string")

    def grams(w):
        p = f"^{w}$"
        return {p[i : i + 2] for i in range(len(p) - 1)}

    want = {(x, y) for x, y in itertools.product(values, keys) if len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= 0.4}
    got = {(r.text, r.key) for r in matching.prefix_join(a, b, 0.4).collect()}
    assert got == want and want


def test_entries(spark):
    locations = spark.createDataFrame(
        [(1, "Ashcombe", "Fenland", "United Kingdom", ["AHE"]), (2, "Ashcombe", "Gum Coast", "Australia", ["AHT"]), (3, "East Ashcombe", "Fenland", "United Kingdom", None)],
        "location_id int, city string, region string, country string, aliases array<string>",
    )
    titles = spark.createDataFrame([(10, "Data Engineer", ["DE"]), (11, "Full Stack Developer", [])], "title_id int, title string, aliases array<string>")
    countries = spark.createDataFrame([("United Kingdom", "GB"), ("Australia", "AU")], "country string, code string")
    sources = spark.createDataFrame([("h", "Australia")], "source_hostname string, country string")
    rows = [
        ("1", "Ashcombe, AU", "Sr. Data Engr II", "United Kingdom", "h"),
        ("2", "ashcombe (hybrid)", "Developer, Full Stack", "gb", "h"),
        ("3", "Gum Coast / Ashcmobe", "DataEngineer wanted!!", None, "h"),
        ("4", "aht", "Pastry Cook", None, None),
        ("5", "East Ashcombe HQ", "Data Engineer", "Australia", "h"),
        ("6", " ", None, None, None),
        ("7", "Nowhere", "de", None, None),
        ("8", "Ashcombe", "", None, None),
        ("9", "ashcombe", "x" * 20_000, None, "h"),
    ]
    jobs = spark.createDataFrame(rows, "job_id string, location string, job_title string, country string, source_hostname string")
    got = {(r.job_id, r.field): r.entry_id for r in matching.canonical_entries(jobs, locations, titles, countries, sources).collect()}
    assert got == {
        ("1", "location"): 2, ("1", "job_title"): 10, ("2", "location"): 1, ("2", "job_title"): 11, ("3", "location"): 2, ("3", "job_title"): 10,
        ("4", "location"): 2, ("4", "job_title"): -1, ("5", "location"): 3, ("7", "location"): -1, ("7", "job_title"): 10, ("9", "location"): 2, ("9", "job_title"): -1,
    }
    assert matching.canonical_entries(jobs.limit(0), locations, titles, countries, sources).count() == 0


# Items together


def test_item_lists(spark):
    rows = ['["a", "B, c", ""]', "['a', ' b ']", "a; b|c", "a|b", "a\nb", "a, b", "None", "", None, "[]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").select("i", cooccurrence.item_list(F.col("r")).alias("l"))
    got = {r.i: r.l for r in df.collect()}
    assert got == {0: ["a", "b, c"], 1: ["a", "b"], 2: ["a", "b|c"], 3: ["a", "b"], 4: ["a", "b"], 5: ["a", "b"], 6: ["none"], 7: [], 8: [], 9: []}


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    baskets = [sorted(set(rng.choices(range(1, 9), k=rng.randrange(1, 6)))) for _ in range(300)] + [[1, 2]] * 150
    items = spark.createDataFrame([(str(k), i) for k, b in enumerate(baskets) for i in b + b[:1]], "key string, item long").distinct()
    got = {(r.skill_id_a, r.skill_id_b): r for r in cooccurrence.pair_scores(cooccurrence.pair_weights(cooccurrence.weighted_baskets(items))).collect()}
    for a, b in itertools.combinations(range(1, 9), 2):
        n = sum(a in x and b in x for x in baskets)
        assert (n == 0) == ((a, b) not in got)
        if n:
            na, nb = sum(a in x for x in baskets), sum(b in x for x in baskets)
            assert got[a, b].n_ab == n and got[a, b].lift == pytest.approx(n * len(baskets) / (na * nb), abs=1e-6)
    none = items.limit(0)
    assert cooccurrence.pair_scores(cooccurrence.pair_weights(cooccurrence.weighted_baskets(none))).count() == 0


# Tokens


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    p = pytest.importorskip("public_tokenizers")
    path = str(p.path("byte_bpe_50k.tiktoken"))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={}), tokens.BytePairEncoder(ranks, p.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("aeinrst ,.\n'ü中🚀", max_size=200))
def test_encoder_equals_the_public_one(public, text):
    theirs, mine = public
    ids = mine.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert mine.decode(ids) == text


def test_encoded_texts(spark, public):
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "a" * 30_000 + "<|endoftext|>", "x"), (5, "hi", "x"), (5, "hi", "x")]
    df = tokens.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string"))
    got = {r[0]: list(r[3]) for r in df.collect()}
    assert got[1] == [] and got[2] == [] and got[3] == public[0].encode_ordinary(" ") and got[4] == public[0].encode_ordinary(rows[3][1])
    back = tokens.decoded(df.select("doc_id", F.col("ids_1").alias("ids")))
    assert {r.doc_id: r.text for r in back.collect()} == {1: "", 2: "", 3: " ", 4: rows[3][1], 5: "hi"}


# Packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 64), st.integers(0, 3), st.integers(0, 9)), max_size=120))
def test_best_fit(items):
    rows = [(i, 0, size, s, c if c < 5 and size else None) for i, (size, s, c) in enumerate(items)]
    out = packing.best_fit(rows, 64)
    assert sorted(o[0] for o in out) == list(range(len(rows)))
    load, held = {}, {}
    for i, _, size, b in out:
        load[b] = load.get(b, 0) + size
        held.setdefault(b, []).append(rows[i])
    assert all(v <= 64 for v in load.values())
    total = sum(r[2] for r in rows)
    needed = max(1, -(-total // 64))
    for b in held.values():
        seen = [(c, size) for _, _, size, _, c in b if c is not None]
        for same in set(seen):
            copies = sum((c, size) == same for _, _, size, _, c in rows)
            assert seen.count(same) <= -(-copies // needed)


def test_best_fit_leaves_little_space_unused():
    import random

    rng = random.Random(5)
    sizes = [min(2048, int(rng.lognormvariate(5, 1))) for _ in range(6000)]
    # A third of the items are copies of one another, in groups up to 300, and there are more groups than machine bits.
    rows = [(i, 0, s, i % 7, None) for i, s in enumerate(sizes)]
    rows += [(10_000 + i, 0, 100 + i % 3, i % 7, i % 10) for i in range(3000)] + [(20_000 + i, 0, 30, 1, 100 + i // 2) for i in range(9000)]
    out = packing.best_fit(rows, 2048)
    total = sum(r[2] for r in rows)
    bins = len({b for *_, b in out})
    assert bins <= 1.01 * -(-total // 2048) + 1
    pairs = Counter((b, rows_by[i]) for rows_by in [{r[0]: r[4] for r in rows}] for i, _, _, b in out if rows_by[i] is not None)
    assert max(n for (b, c), n in pairs.items() if c >= 100) == 1


def test_best_fit_finds_a_bin_without_the_source_among_any_number():
    # Thirty equally tight bins, the first of which alone lacks source "a".
    rows = [(0, 0, 6, "b", None), *((i, 0, 6, "a", None) for i in range(1, 30)), (99, 0, 4, "a", None)]
    at = {i: b for i, _, _, b in packing.best_fit(rows, 10)}
    assert at[99] == at[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 9, 20, 33]), st.integers(0, 3), st.integers(0, 40)), min_size=60, max_size=200))
def test_best_fit_against_all_bins(items):
    rows = {i: (i, 0, size, s, c if c < 20 and size else None) for i, (size, s, c) in enumerate(items)}
    needed = max(1, -(-sum(r[2] for r in rows.values()) // 64))
    times = Counter(r[4] for r in rows.values())
    # Only clusters that fit apart: larger ones may share.
    rows = {i: r if times[r[4]] <= needed else (*r[:4], None) for i, r in rows.items()}
    bins = {}
    for i, _, size, b in packing.best_fit(list(rows.values()), 64):
        source, copies = rows[i][3], rows[i][4]
        left = {k: 64 - sum(r[2] for r in held) for k, held in bins.items() if copies is None or all(r[4] != copies for r in held)}
        tight = min((x for x in left.values() if x >= size), default=None)
        best = [k for k, x in left.items() if x == tight]
        best = [k for k in best if all(r[3] != source for r in bins[k])] or best
        assert b in best if best else b not in bins
        bins.setdefault(b, []).append(rows[i])


def test_packed(spark):
    rows = [(i, "word " * (i % 40), "s") for i in range(300)] + [(900, "word " * 3000, "s"), (901, None, None), (902, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limits = spark.createDataFrame([(1, 64), (2, 512), (3, 0), (4, None)], "limit_id int, capacity_tokens int")
    out = packing.packed(docs, limits, group_items=100)
    used = out.groupBy("limit_id", "container_id").agg(F.sum("tokens").alias("t")).join(limits, "limit_id")
    assert used.filter("t > capacity_tokens").count() == 0
    pieces = {r.limit_id: r for r in out.filter("doc_id = 900").groupBy("limit_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    assert pieces[1].n == -(-pieces[1].t // 64) and pieces[2].n == -(-pieces[2].t // 512)
    assert {r.limit_id: r.n for r in out.groupBy("limit_id").agg(F.countDistinct("doc_id").alias("n")).collect()} == {1: 303, 2: 303}
    assert out.filter("doc_id < 900").groupBy("limit_id", "doc_id").count().filter("count > 1").count() == 0
    assert packing.packed(docs.limit(0), limits).count() == 0
    twice = packing.packed(docs.unionByName(docs.filter("doc_id < 50")), limits, group_items=100)
    assert twice.groupBy("limit_id", "doc_id", "piece_no").count().filter("count > 1").count() == 0


# Personal information

TEXT = """Dear Gektese,
For questions reach Dr. Keirkruni Neinmourane (NEINMOURANE34@POSTKASTEN.CO.EXAMPLE), 077-0006439.
Ms Neinmourane agreed. My IC is 701335-14-4199. Ticket 202577553314 was closed on 10-10-2024.
The build 3.12.545-5387 runs on 192.0.2.161. Ping @oxbow-team. Install @quillstore/core version 2.8.0 first.
Tel +44 (0)20 7946 0041 ext. 63 and ask for SIRHASKO, Kosthike.
Anschrift: Schlossallee 101b,
00883 Münzbrück.
Thurtthokwell & Brunthaimidze Consulting is the client.
write to rgershaisane [at] nukrem [dot] test
Walk in at No. 56/3, Station Mawatha, Velmora 00 between 9 and 12.
Viele Grüße
Murlokin van der Quell
"""


def test_found():
    got = [(e.kind, personal.found_text(e)) for e in personal.find(TEXT)]
    assert got == [
        ("person_name", "Gektese"), ("person_name", "Keirkruni Neinmourane"), ("email", "NEINMOURANE34@POSTKASTEN.CO.EXAMPLE"), ("phone", "077-0006439"),
        ("person_name", "Neinmourane"), ("id_number", "701335-14-4199"), ("phone", "+44 (0)20 7946 0041"), ("person_name", "SIRHASKO, Kosthike"),
        ("address", "Schlossallee 101b, 00883 Münzbrück"), ("email", "rgershaisane [at] nukrem [dot] test"), ("address", "No. 56/3, Station Mawatha, Velmora 00"),
        ("person_name", "Murlokin van der Quell"),
    ]


def test_surrogates():
    redacted, fake, rows = personal.replaced(TEXT, b"k")
    assert "Neinmourane" not in redacted and "[PHONE_1]" in redacted and "Ticket 202577553314" in redacted
    names = {f: s for k, f, s in rows if k == "person_name"}
    assert names["Keirkruni Neinmourane"].split()[1] == names["Neinmourane"]
    assert names["SIRHASKO, Kosthike"].split(",")[0].isupper() and " van der " in names["Murlokin van der Quell"]
    by_kind = {}
    for k, f, s in rows:
        assert f != s
        by_kind.setdefault(k, {}).setdefault(s.lower(), set()).add(f.lower())
    assert all(len(v) == 1 for d in by_kind.values() for v in d.values())
    phone = next(s for k, f, s in rows if f.startswith("+44"))
    assert phone.startswith("+44 (0)") and len(phone) == len("+44 (0)20 7946 0041")
    assert personal.replaced(TEXT, b"k") == (redacted, fake, rows) and personal.replaced(TEXT, b"other")[1] != fake


def test_surrogates_stay_distinct():
    made = personal.Surrogates(b"k", "".join(map(chr, range(65, 91))))
    letters = [chr(65 + k) for k in range(26)] + ["É", "Ł"]
    initials = [made.of(personal.Entity("person_name", 0, 0, f"{c}. Marlow")).split(".")[0] for c in letters]
    assert len(set(initials)) == 28 and all(a != b for a, b in zip(letters, initials))
    made = personal.Surrogates(b"k", "")
    words = ["".join(c) for c in itertools.product("abcdefghij", repeat=4)][:3000]
    names = [made.of(personal.Entity("person_name", 0, 0, f"X{w} Y{w}")) for w in words]
    assert len({n.split()[0].lower() for n in names}) == len({n.split()[1].lower() for n in names}) == 3000
    towns = [f"Am Markt {k}, 00000 Velmora" for k in range(1, 10)] + ["Am Markt 0, 00000 Velmora", "Plot A, Old Cross, Hill Layout, Velmora", "Plot B, Old Cross, Hill Layout, Velmora"]
    places = [made.of(personal.Entity("address", 0, 0, t)) for t in towns]
    assert len({p.lower() for p in places}) == len(towns)
    mails = [made.of(personal.Entity("email", 0, 0, f"{c}@x{k}.example")) for k in range(2) for c in "abcdefghijklmnopqrstuvwxyz"]
    assert len(set(mails)) == 52


def test_odd_documents(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, TEXT * 40, "x"), (5, "a@b.example", "x"), (5, "a@b.example", "x"), (6, "(" * 5000 + "0" * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, personal string")
    assert personal.with_personal(df, "k").columns == ["doc_id", "text", "personal", "personal_1"]
    assert personal.personal_found(df).filter("doc_id in (1, 2, 3, 6)").count() == 0
    assert personal.personal_found(df).filter("doc_id = 5").count() == 1
    out = {r.doc_id: r for r in personal.readable_texts(df, "k").collect()}
    assert out[1].redacted is None and out[2].redacted == "" and out[5].redacted == "[EMAIL_1]"
    assert personal.personal_found(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        personal.with_personal(df, "")


def test_held_out_sentences():
    right = wanted = wrong = 0
    for text, true in heldout.HELD_OUT:
        got = {(e.kind, personal.found_text(e)) for e in personal.find(text)}
        right, wanted, wrong = right + len(got & true), wanted + len(true), wrong + len(got - true)
    assert right >= 0.9 * wanted and wrong <= 0.1 * wanted
    assert not any(personal.find(t) for t in heldout.NOTHING)


def test_names_by_the_corpus(spark):
    """A run without a cue is a name where its words or its surroundings are those of persons."""
    texts = [f"Dear Ms {n},\nall is well." for n in ("Farkuna Toloma", "Birelle Santor", "Mokani Deshun") for _ in range(3)]
    texts += [f"We ship crates beside {n} and 4 drivers." for n in ("Farkuna Toloma", "Birelle Santor", "Mokani Deshun", "Unseen Velkor")]
    texts += [f"We ship crates into {n} by truck." for n in ("Harbour Point", "Harbour Gate", "Mill Gate", "Mill Point")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.found_text) for r in personal.personal_found(df).collect()}
    assert {(9, "Farkuna Toloma"), (10, "Birelle Santor"), (11, "Mokani Deshun"), (12, "Unseen Velkor")} <= got
    assert not any(d >= 13 for d, _ in got)


# Long values


def test_truncation_of_one_long_line(spark):
    """A line of a megabyte without a sentence mark, and a word of 100,000 letters, cost no more than their length."""
    line = " ".join(f"w{k % 977}" for k in range(170_000))
    rows = [(str(k), "f", "s", f"short line {k % 5}\nand the other line {k % 3}.") for k in range(50)]
    rows += [("long", "f", "s", line), ("word", "f", "s", "before\n" + "x" * 100_000), ("cut", "f", "s", "short line 1\nand the oth")]
    df = spark.createDataFrame(rows, "key string, field string, source string, text string")
    got = {r.key for r in truncation.truncation_odds(df).filter(F.col("log_odds") > truncation.CUT).collect()}
    assert "cut" in got and not got & {str(k) for k in range(50)}


def test_censoring_of_many_lengths():
    import pandas as pd

    hist = pd.DataFrame({"source": "s", "field": "f", "length": range(1, 200_001), "n": 1})
    hist.loc[hist["length"] == 100_000, "n"] = 5000
    out = truncation.censoring(hist)
    assert out.loc[out["length"] == 100_000, "posterior"].item() > 0.9 and out["posterior"].max() <= 0.995


def test_openings():
    a, b = truncation.openings("one two three"), truncation.openings("one two four five")
    assert a[:2] == b[:2] and a[2] != b[2] and len(b) == 4 and all(-(1 << 63) <= h < 1 << 63 for h in a + b)


def test_paths_of_any_depth():
    """Closing tags find their opening ones, however deep a page nests."""
    page = "<div><article>" + "<div>" * 50 + "in" + "</div>" * 50 + "<p>after</p></article></div><p>end</p>"
    got = {t: p for _, p, t in boilerplate.pieces(page)}
    assert got["after"] == "div/article/p" and got["end"] == "p"
    assert got["in"].startswith("div/article/div") and got["in"].count("/") < 50
    other = "<div><article>" + "<div>" * 49 + "<ul>in" + "</ul>" * 50
    assert boilerplate.pieces(other)[0][1] != got["in"]
    assert len(boilerplate.pieces("<div><p>x" * 5_000)) == 5_000
