"""Instants against hand values and against a brute-force reading."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from adloom.operators.instants import normalised_dates, utc_instants

NOW = "2025-03-30T10:00:00+00:00"
CASES = [
    ("31/01/2025", "Asia/Colombo", "en-GB", "2025-01-30 18:30:00"),
    ("01/31/2025", "America/Toronto", "en-US", "2025-01-31 05:00:00"),
    ("31.01.25, 18.48 Uhr", "Europe/Berlin", "de-DE", "2025-01-31 17:48:00"),
    ("21. März 2025", "Europe/Berlin", "de-DE", "2025-03-20 23:00:00"),
    ("18 Mei 2025", "Asia/Kuala_Lumpur", "ms-MY", "2025-05-17 16:00:00"),
    ("2025-10-26T02:15:00+02:00[Europe/Berlin]", "Europe/Berlin", "de-DE", "2025-10-26 00:15:00"),
    ("2025-10-26 02:15 CET", "Europe/Berlin", "de-DE", "2025-10-26 01:15:00"),
    ("Fri, 31 Jan 2025 10:00:00 -0500", "Asia/Kolkata", "en-IN", "2025-01-31 15:00:00"),
    ("1754650361683", "Asia/Colombo", "en-GB", "2025-08-08 10:52:41"),
    ("20250118", "Asia/Kolkata", "en-IN", "2025-01-17 18:30:00"),
    ("12:05 am on 4 November 2024", "Asia/Kuala_Lumpur", "ms-MY", "2024-11-03 16:05:00"),
    ("Posted 3d ago", "Europe/London", "en-GB", "2025-03-27 00:00:00"),
    ("Today", "Europe/London", "en-GB", "2025-03-30 00:00:00"),
    ("tomorrow", "Europe/London", "en-GB", "2025-03-30 23:00:00"),
    ("a week ago", "Europe/London", "en-GB", "2025-03-23 00:00:00"),
    ("vor 22 Stunden", "Europe/Berlin", "de-DE", "2025-03-29 12:00:00"),
    ("2025-03-30 01:30", "Europe/London", "en-GB", None),  # skipped by the clock
    ("31/02/2025", "Europe/London", "en-GB", None),
    ("0000-00-00", "Europe/London", "en-GB", None),
    ("30+ days ago", "Europe/London", "en-GB", None),
    ("ASAP", "Europe/London", "en-GB", None),
    ("", "Europe/London", "en-GB", None),
    (None, "Europe/London", "en-GB", None),
    ("2025-01-31", None, "en-GB", None),
    ("2025-01-31", "No/Zone", "en-GB", None),
    ("2025-01-31T00:00:00Z", None, None, "2025-01-31 00:00:00"),
    ("x" * 50_000, "Europe/London", "en-GB", None),
]


def test_hand_values(spark):
    # "utc" and "_n" clash with names the operator would use itself.
    df = spark.createDataFrame([(*c[:3], NOW, c[3], i) for i, c in enumerate(CASES)], "v string, tz string, loc string, now string, utc string, _n int")
    got = utc_instants(df, "v", "tz", "loc", "now")
    assert got.columns[:6] == df.columns and len(got.columns) == 7
    assert {r["_n"]: r[6] for r in got.collect()} == {i: c[3] for i, c in enumerate(CASES)}


def test_empty_and_repeated(spark):
    cols = "job_id string, source_hostname string, posted_date_raw string, closing_date_raw string, scraped_at string, field string"
    sources = spark.createDataFrame([("h", "Europe/London", "en-GB")], "source_hostname string, tz string, locale string")
    assert normalised_dates(spark.createDataFrame([], cols), sources).count() == 0
    rows = [("a", "h", "Today", None, NOW, "x"), ("a", "h", "Today", None, NOW, "y"), ("b", "none", "Today", None, NOW, "x")]
    assert [tuple(r) for r in normalised_dates(spark.createDataFrame(rows, cols), sources).collect()] == [("a", "posted_date_raw", "2025-03-30 00:00:00")]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.datetimes(dt.datetime(1990, 1, 1), dt.datetime(2037, 12, 31)), min_size=150, max_size=150))
def test_local_times_against_zoneinfo(spark, times):
    zones = ["Europe/Berlin", "America/Toronto", "Australia/Sydney", "Asia/Kolkata"]
    rows, want = [], {}
    for i, t in enumerate(times):
        t = t.replace(microsecond=0)
        z = zones[i % 4]
        aware = t.replace(tzinfo=ZoneInfo(z))
        back = aware.astimezone(dt.timezone.utc)
        real = back.astimezone(ZoneInfo(z)).replace(tzinfo=None) == t
        rows.append((i, t.strftime("%Y-%m-%d %H:%M:%S"), z, "en-GB"))
        want[i] = back.strftime("%Y-%m-%d %H:%M:%S") if real else None
    got = utc_instants(spark.createDataFrame(rows, "i int, v string, tz string, l string"), "v", "tz", "l")
    assert {r.i: r.utc for r in got.collect()} == want
