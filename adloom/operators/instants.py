"""Mixed timestamp formats and time zones to one UTC instant.

All layouts are compiled into one regular expression, an alternation with named
groups. A single ``regexp_replace`` pass rewrites a value into its components
(the groups of the branches that did not take part come out empty), so every
value is scanned once, inside the JVM. Components are then checked against the
calendar and assembled by integer day arithmetic; only values without an offset
of their own consult the zone rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.names import bound, fresh, ref

# Month names of the locales in use (English, German, Malay).
MONTHS = {
    1: ("january", "januar", "januari", "jänner", "jan"),
    2: ("february", "februar", "februari", "feb"),
    3: ("march", "märz", "maerz", "mac", "mar", "mär", "mrz"),
    4: ("april", "apr"),
    5: ("may", "mai", "mei"),
    6: ("june", "juni", "jun"),
    7: ("july", "juli", "julai", "jul"),
    8: ("august", "ogos", "aug", "ogo"),
    9: ("september", "sept", "sep"),
    10: ("october", "oktober", "oct", "okt"),
    11: ("november", "nov"),
    12: ("december", "dezember", "disember", "dec", "dez", "dis"),
}

# Offsets in minutes of the zone abbreviations in use.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "IST": 330, "SLST": 330, "SGT": 480, "MYT": 480, "AEST": 600, "AEDT": 660,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "PST": -480, "PDT": -420,
}

# Words for a day relative to now.
DAY_WORDS = {
    0: ("today", "heute", "hari ini"),
    1: ("tomorrow", "morgen", "esok"),
    -1: ("yesterday", "gestern", "semalam", "kelmarin"),
}

_SEP = "\x01"
_ZONE_NAME = r"^(?:(?:Africa|America|Antarctica|Arctic|Asia|Atlantic|Australia|Europe|Indian|Pacific)/[A-Za-z_]+(?:/[A-Za-z_]+)?|UTC|GMT)$"
_MONTH = "|".join(sorted((n for names in MONTHS.values() for n in names), key=lambda n: (-len(n), n)))
_LEAD = (
    r"(?:(?:posted|listed|closing|closes|published|apply|deadline|expires|veröffentlicht|bewerbungsfrist|"
    r"tarikh tutup|disiarkan|bewerben bis)(?:\s+(?:on|by|before|date|am|bis|pada|sebelum))?\s*:?\s+)?"
)
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"


@dataclass
class _Layouts:
    """Collects branches; gives each component of a branch its own group name."""

    branches: list[str] = field(default_factory=list)
    groups: dict[str, list[str]] = field(default_factory=dict)

    def add(self, pattern: str) -> None:
        k = len(self.branches)
        parts, names = pattern.split("<<"), []
        out = [parts[0]]
        for part in parts[1:]:
            name, rest = part.split(">>", 1)
            group = f"{name}{k}"
            self.groups.setdefault(name, []).append(group)
            names.append(group)
            out.append(f"(?<{group}>{rest}")
        self.branches.append("".join(out))


def _layouts() -> _Layouts:
    """The branches; ``<<name>>...)`` opens a named group for component ``name``."""
    x = _Layouts()
    hms = r"<<h>>\d{1,2}):<<mi>>\d{2})(?::<<s>>\d{2})(?:[.,]\d{1,9})?)?"
    zone = (
        r"(?:\s*(?:(?:gmt|utc)?<<off>>[+-]\d{2}:?\d{2})|<<abbr>>(?!am\b|pm\b)[a-z]{1,4}))"
        r"(?:\[[a-z_]+/[a-z_/]+\])?|\s*\[?<<zone>>[a-z]+/[a-z_]+(?:/[a-z_]+)?)\]?)?"
    )
    # 2025-01-31, 2025/01/31, with or without a time and a zone.
    x.add(rf"<<y>>\d{{4}})[-/.]<<mo>>\d{{1,2}})[-/.]<<d>>\d{{1,2}})(?:[t\s]+{hms}{zone})?")
    # 20250131
    x.add(r"<<y>>(?:19|20)\d{2})<<mo>>\d{2})<<d>>\d{2})")
    # Seconds or milliseconds since 1970.
    x.add(r"<<epoch>>\d{10})(?:<<ms>>\d{3}))?")
    # 31/01/2025, 31.1.25, in the order of the locale, with 24 or 12 hour time.
    x.add(
        r"<<a>>\d{1,2})[-/.]<<b>>\d{1,2})[-/.]<<y>>\d{4}|\d{2})"
        rf"(?:,?\s+<<h>>\d{{1,2}})[:.]<<mi>>\d{{2}})(?:[:.]<<s>>\d{{2}}))?(?:\s*<<ap>>[ap])\.?m\.?|\s*uhr)?{zone})?"
    )
    # Fri, 31st Jan 2025 10:00:00 +0100; 31. Januar 2025; 31-Jan-25; 31 Jan 2025, 10:00 CET
    x.add(
        rf"{_WEEKDAY}<<d>>\d{{1,2}})(?:st|nd|rd|th|\.)?[\s-]+<<mon>>{_MONTH})\.?,?[\s-]+<<y>>\d{{4}}|\d{{2}})"
        rf"(?:,?\s+{hms}(?:\s*<<ap>>[ap])\.?m\.?)?(?:\s*uhr)?{zone})?"
    )
    # January 31, 2025
    x.add(
        rf"{_WEEKDAY}<<mon>>{_MONTH})\.?\s+<<d>>\d{{1,2}})(?:st|nd|rd|th)?,?\s+<<y>>\d{{4}})"
        rf"(?:,?\s+(?:at\s+)?{hms}(?:\s*<<ap>>[ap])\.?m\.?)?{zone})?"
    )
    # 4:29 pm on 5 September 2025
    x.add(
        rf"{hms}\s*(?:<<ap>>[ap])\.?m\.?)?\s+(?:on|am|pada)\s+<<d>>\d{{1,2}})(?:st|nd|rd|th|\.)?\s+"
        rf"<<mon>>{_MONTH})\.?,?\s+<<y>>\d{{4}}){zone}"
    )
    # Relative to now.
    back = r"(?:ago|back|lepas|lalu|yang lalu)"
    one = r"(?:a|an|one|einem|einer|ein|eine|sebulan)"
    x.add(rf"<<dback>>\d{{1,4}})\s*(?:d|days?|hari)\s+{back}")
    x.add(rf"<<wback>>\d{{1,3}})\s*(?:w|wks?|weeks?|minggu)\s+{back}")
    x.add(rf"<<hback>>\d{{1,4}})\s*(?:h|hrs?|hours?|jam)\s+{back}")
    x.add(r"vor\s+<<dback>>\d{1,4})\s+tag(?:en)?")
    x.add(r"vor\s+<<wback>>\d{1,3})\s+wochen?")
    x.add(r"vor\s+<<hback>>\d{1,4})\s+stunden?")
    x.add(rf"<<dback1>>{one}\s+(?:day|hari)\s+{back}|vor\s+{one}\s+tag|sehari\s+{back})")
    x.add(rf"<<wback1>>{one}\s+week\s+{back}|last week|letzte woche|vor\s+{one}\s+woche|seminggu\s+{back})")
    x.add(rf"<<hback1>>{one}\s+(?:hour|jam)\s+{back}|vor\s+{one}\s+stunde|sejam\s+{back})")
    x.add(r"(?:closes\s+|closing\s+|ends\s+)?in\s+<<dfwd>>\d{1,4})\s+(?:days?|tagen?)")
    x.add(r"(?:closes\s+|closing\s+|ends\s+)?in\s+<<wfwd>>\d{1,3})\s+(?:weeks?|wochen?)")
    x.add(r"(?:closes\s+|closing\s+|ends\s+)?in\s+<<hfwd>>\d{1,4})\s+(?:hours?|stunden?)")
    x.add(r"<<dfwd>>\d{1,4})\s+(?:days?|hari)\s+(?:left|to go|remaining|lagi)")
    x.add(r"<<wfwd>>\d{1,3})\s+(?:weeks?|minggu)\s+(?:left|to go|remaining|lagi)")
    x.add(r"<<hfwd>>\d{1,4})\s+(?:hours?|jam)\s+(?:left|to go|remaining|lagi)")
    x.add(r"(?:noch|tinggal)\s+<<dfwd>>\d{1,4})\s+(?:tage?|hari)(?:\s+lagi)?")
    for days, words in DAY_WORDS.items():
        name = {0: "today", 1: "tomorrow", -1: "yesterday"}[days]
        x.add(rf"<<{name}>>{'|'.join(words)})")
    return x


_LAYOUTS = _layouts()
PATTERN = "(?iu)^\\s*" + _LEAD + "(?:" + "|".join(_LAYOUTS.branches) + ")\\s*$"
_COMPONENTS = tuple(_LAYOUTS.groups)
_REPLACEMENT = "x" + "".join(
    _SEP + name + "".join("${" + g + "}" for g in _LAYOUTS.groups[name]) for name in _COMPONENTS
)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    y0 = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(y0 / 400).cast("long")
    yoe = y0 - era * 400
    shifted = F.when(m > 2, m - 3).otherwise(m + 9)
    doy = F.floor((shifted * 153 + 2) / 5).cast("long") + d - 1
    doe = yoe * 365 + F.floor(yoe / 4).cast("long") - F.floor(yoe / 100).cast("long") + doy
    return era * 146097 + doe - 719468


def _lookup(values: dict[str, int], key: Column) -> Column:
    items = [F.lit(x) for pair in values.items() for x in pair]
    return F.element_at(F.create_map(*items), key)


def _ntz(seconds: Column) -> Column:
    """Whole seconds since 1970 as a timestamp without zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )


def utc_instants(
    df: DataFrame,
    value: str,
    tz: str,
    locale: str,
    now: str | None = None,
    out: str = "utc",
) -> DataFrame:
    """Add ``out``: the UTC instant of ``value`` as ``YYYY-MM-DD HH:MM:SS``, or null.

    ``tz`` names the column with the IANA zone that holds for values without
    one, ``locale`` the column with the writer's locale (``en-US`` puts the
    month first), ``now`` the column with the UTC instant (ISO text) that
    relative values count from.

    Defined results: null, blank, unparseable, out-of-calendar and
    clock-skipped values (a local time that a daylight-saving change leaves
    out) give null, as do values that need a zone or ``now`` where that column
    is null or no valid zone. A local time that occurs twice means the first.
    Days before a relative value's day count in the zone and give its start.
    Fractions of a second are cut. Extra columns are kept, whatever their names.
    """
    whole = df.columns
    own = {n: fresh(whole, f"_{n}") for n in ("parts", "c", "n", "x", "w")}
    text = F.regexp_replace(ref(value), F.lit(PATTERN), F.lit(_REPLACEMENT))
    got = bound(df, **{own["parts"]: F.split(text, _SEP)})
    parts = F.col(own["parts"])

    def taken(k: int, name: str) -> Column:
        piece = F.substring(F.get(parts, F.lit(k + 1)), len(name) + 1, 64)
        return F.when((parts[0] == "x") & (piece != ""), piece).alias(name)

    got = bound(got, **{own["c"]: F.struct(*(taken(k, n) for k, n in enumerate(_COMPONENTS)))})

    def piece(name: str) -> Column:
        return F.col(f"{own['c']}.{name}")

    def number(name: str) -> Column:
        return piece(name).cast("long")

    months = {n: k for k, names in MONTHS.items() for n in names}
    month_first = F.lower(ref(locale)) == "en-us"
    a, b, year = number("a"), number("b"), number("y")
    sign = F.when(piece("off").startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(piece("off"), "[^0-9]", "")
    offset = sign * (F.substring(digits, 1, 2).cast("long") * 60 + F.substring(digits, 3, 2).cast("long"))
    half, h = F.lower(piece("ap")), number("h")
    first = {
        "year": F.when(F.length(piece("y")) == 2, year + 2000).otherwise(year),
        "month": F.coalesce(
            number("mo"), _lookup(months, F.lower(piece("mon"))), F.when(month_first, a).otherwise(b)
        ),
        "day": F.coalesce(number("d"), F.when(month_first, b).otherwise(a)),
        "clock": F.when(h.isNull(), True)
        .when(half.isNull(), h.between(0, 23))
        .otherwise(h.between(1, 12))
        & F.coalesce(number("mi"), F.lit(0)).between(0, 59)
        & F.coalesce(number("s"), F.lit(0)).between(0, 59),
        "second": F.coalesce(F.when(half.isNull(), h).when(half == "p", h % 12 + 12).otherwise(h % 12), F.lit(0)) * 3600
        + F.coalesce(number("mi"), F.lit(0)) * 60
        + F.coalesce(number("s"), F.lit(0)),
        "offset": F.coalesce(offset, _lookup(ABBREVIATIONS, F.upper(piece("abbr")))),
        "zone": F.coalesce(piece("zone"), ref(tz)),
        "zoned": piece("abbr").isNotNull(),
        "epoch": number("epoch"),
    }
    if now is not None:
        first |= {
            "ago": F.coalesce(
                number("hback"), F.when(piece("hback1").isNotNull(), 1), -number("hfwd")
            ),
            "shift": F.coalesce(
                number("dfwd"),
                number("wfwd") * 7,
                -number("dback"),
                -number("wback") * 7,
                F.when(piece("dback1").isNotNull(), -1),
                F.when(piece("wback1").isNotNull(), -7),
                F.when(piece("today").isNotNull(), 0),
                F.when(piece("tomorrow").isNotNull(), 1),
                F.when(piece("yesterday").isNotNull(), -1),
            ),
            "at": F.unix_seconds(F.try_to_timestamp(ref(now))),
        }
    else:
        first |= {n: F.lit(None).cast("long") for n in ("ago", "shift", "at")}
    got = bound(got, **{own["n"]: F.struct(*(c.alias(n) for n, c in first.items()))})
    n = {k: F.col(f"{own['n']}.{k}") for k in first}
    leap = ((n["year"] % 4 == 0) & (n["year"] % 100 != 0)) | (n["year"] % 400 == 0)
    longest = (
        F.when(n["month"].isin(4, 6, 9, 11), 30)
        .when(n["month"] == 2, F.when(leap, 29).otherwise(28))
        .otherwise(31)
    )
    real = (
        (n["year"] >= 1)
        & n["month"].between(1, 12)
        & n["day"].between(1, longest)
        & n["clock"]
        & (~n["zoned"] | n["offset"].isNotNull())
    )
    local = F.when(real, _days(n["year"], n["month"], n["day"]) * 86400 + n["second"])
    # A column can hold a zone name the JVM does not know; only well-formed ones are used.
    zone = F.when(n["zone"].rlike(_ZONE_NAME), n["zone"])
    utc = F.lit("UTC")
    today = F.to_date(F.convert_timezone(utc, zone, _ntz(n["at"])))
    start = F.date_add(today, n["shift"].cast("int")).cast("timestamp_ntz")
    got = bound(got, **{own["x"]: F.struct(
        F.when(n["shift"].isNotNull(), start).otherwise(_ntz(local)).alias("wall"),
        F.coalesce(n["epoch"], n["at"] - n["ago"] * 3600, local - n["offset"] * 60).alias("exact"),
        zone.alias("zone"),
        n["shift"].isNotNull().alias("day"),
    )})
    x = {k: F.col(f"{own['x']}.{k}") for k in ("wall", "exact", "zone", "day")}
    got = bound(got, **{own["w"]: F.convert_timezone(x["zone"], utc, x["wall"])})
    w = F.col(own["w"])
    skipped = (F.convert_timezone(utc, x["zone"], w) != x["wall"]) & ~x["day"]
    instant = F.when(x["exact"].isNotNull(), _ntz(x["exact"])).when(~skipped, w)
    final = fresh(whole, out)
    return bound(got, **{final: F.substring(instant.cast("string"), 1, 19)}).drop(*own.values())


def normalised_dates(
    records: DataFrame,
    sources: DataFrame,
    fields: tuple[str, ...] = ("posted_date_raw", "closing_date_raw"),
    key: str = "job_id",
    now: str = "scraped_at",
) -> DataFrame:
    """``(key, field, utc)`` of every date value that fixes one instant, no row twice.

    Records are delivered more than once; equal values of one record collapse
    before any date is parsed. ``sources`` gives locale and zone by
    ``source_hostname``; it is a dimension that Spark broadcasts when its size
    allows.
    """
    dims = sources.select("source_hostname", "tz", "locale").dropDuplicates(["source_hostname"])
    slim = records.select(ref(key).alias("_key"), "source_hostname", ref(now).alias("_now"), *map(ref, fields))
    long = (
        slim.join(dims, "source_hostname", "left")
        .select(
            "_key", "_now", "tz", "locale",
            F.explode(
                F.array(*(F.struct(F.lit(f).alias("field"), ref(f).alias("value")) for f in fields))
            ).alias("_v"),
        )
        .select("_key", "_now", "tz", "locale", "_v.field", "_v.value")
        .filter(F.trim("value") != "")
    )
    parsed = utc_instants(long, "value", "tz", "locale", "_now", "utc")
    return (
        parsed.filter(F.col("utc").isNotNull())
        .select(F.col("_key").alias(key), "field", "utc")
        .distinct()
    )
