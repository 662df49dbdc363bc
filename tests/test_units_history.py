"""Pay texts by hand, and histories against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from adloom.operators.history import coalesce_runs, validity_periods
from adloom.operators.units import UnitScanner, monthly_pay

TEXTS = [
    ("SGD 17,000 – 26,000 a year", (17000, 26000, "SGD", "annual")),
    ("₹not more than 2,90,000 a month plus medical", (-1, 290000, "INR", "monthly")),
    ("between 14'000 and 16'000 € per annum", (14000, 16000, "EUR", "annual")),
    ("SGD between 2.1 and 2.7k / mo gross", (2100, 2700, "SGD", "monthly")),
    ("2,3 bis 2,8 k € monatlich, 5 days week", (2300, 2800, "EUR", "monthly")),
    ("17 lpa INR negotiable", (1700000, 1700000, "INR", "annual")),
    ("rs.up to 3.2L pm", (-1, 320000, None, "monthly")),
    ("Hourly: From 25 + 10% bonus", (25, -1, None, "hourly")),
    ("US dollars 1.4k..1.6k per month", (1400, 1600, "USD", "monthly")),
    ("26.000–32.000 Euro", (26000, 32000, "EUR", None)),
    ("10000000 ~ 19000000 (2 vacancies)", (10000000, 19000000, None, None)),
    ("5 – 9", (5, 9, None, None)),
    ("Ref 4501/24", None),
    ("13th month bonus", None),
    ("Call after 5 pm", None),
    ("EPF 12% + ETF 3%", None),
    ("Scale M3 to M5", None),
    ("Competitive", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("text,want", TEXTS)
def test_scanner(text, want):
    got = UnitScanner().parse(text)
    if want is None:
        assert got is None
    else:
        assert (*(x if x == -1 else x / 10_000 for x in got[:2]), *got[2:]) == want


def test_monthly_pay(spark):
    units = spark.createDataFrame(
        [("currency", "EUR", 108.0, 100.0), ("currency", "GBP", 127.0, 100.0), ("period", "monthly", 1.0, 1.0), ("period", "annual", 1.0, 12.0)],
        "kind string, unit string, multiply_by double, divide_by double",
    )
    countries = spark.createDataFrame([("Germany", "DE", "EUR"), ("United Kingdom", "GB", "GBP")], "country string, code string, currency string")
    cols = "job_id string, salary_text_raw string, salary_currency_normalized string, salary_period_normalized string, country string, currency string"
    rows = [
        ("a", "100 to 200 monthly", None, None, "de", "clash"),
        ("b", "£12 k pa", "EUR", "monthly", "Germany", "clash"),
        ("c", "up to 1,000", None, "annual", " GERMANY ", None),
        ("d", "1,000", None, "unspecified", "Germany", None),  # no period
        ("e", "1,000 monthly", None, None, None, None),  # no currency
        ("f", None, "EUR", "monthly", "Germany", None),
    ]
    got = {r.job_id: (r.usd_month_min, r.usd_month_max) for r in monthly_pay(spark.createDataFrame(rows, cols), units, countries).collect()}
    assert got == {"a": (108, 216), "b": (1270, 1270), "c": (-1, 90)}
    assert monthly_pay(spark.createDataFrame([], cols), units, countries).count() == 0


def test_runs_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for e in ["hot"] * 6 + ["a", "b"]:
        for _ in range(120):
            rows.append((e, rng.randrange(0, 1 << rng.choice([20, 40, 51])), rng.choice("xyz")))
    rows += rows[:50]
    seen = {}
    for e, t, h in rows:
        seen.setdefault((e, t), set()).add(h)
    rows = [r for r in rows if len(seen[r[0], r[1]]) == 1]
    got = coalesce_runs(spark.createDataFrame(rows + [(None, 1, "x"), ("a", None, "x"), ("a", 5, None)], "e string, t long, h string"), "e", "t", "h")
    mine = sorted((r.entity, r.lo, r.hi, r.payload, r.first, r.last) for r in got.collect())
    want = []
    for e in {r[0] for r in rows}:
        runs = []
        for t, h in sorted({(t, h) for x, t, h in rows if x == e}):
            if not runs or runs[-1][1] != h:
                runs.append((t, h))
        for k, (t, h) in enumerate(runs):
            nxt = runs[k + 1][0] if k + 1 < len(runs) else None
            want.append((e, t, nxt, h, k == 0, k == len(runs) - 1))
    key = lambda r: (r[0], r[1])
    assert sorted(mine, key=key) == sorted(want, key=key)


def test_periods_of_odd_rows(spark):
    v = "job_id string, content_hash string, observed_at string, version_id long, valid_from string"
    j = "job_id string, first_seen_at string, last_seen_at string"
    rows = [("a", "AB", "2025-01-02T00:00:00Z", 2, ""), ("a", "ab", "2025-01-01T05:30:00+05:30", 1, ""), ("a", None, "2025-01-03T00:00:00Z", 3, ""), ("x", "c", "2025-01-03T00:00:00Z", 4, "")]
    jobs = spark.createDataFrame([("a", "2025-01-01T00:00:00Z", "2025-01-09T00:00:00.5Z"), ("b", None, None)], j)
    got = validity_periods(spark.createDataFrame(rows, v), jobs).collect()
    assert [tuple(r) for r in got] == [("a", "ab", "2025-01-01 00:00:00", "2025-01-09 00:00:00")]
    assert validity_periods(spark.createDataFrame([], v), jobs).count() == 0
    assert F is not None
