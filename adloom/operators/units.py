"""Quantities written in different units and scales, to common units.

A multi-pattern automaton (Aho-Corasick) finds every alias of a currency,
period, scale, bound or range word in one pass over a text. Longest match
settles overlaps, word limits drop aliases inside other words, and the fields
beside the text settle what the text leaves open. Numbers without a unit's
neighbourhood (percentages, vacancies, hours, grades) are not amounts. The
factors are then joined from the unit table, and the arithmetic is exact.

Every unit of the table is an alias of itself, and callers can give more, so a
new unit needs no change here. A currency that stands beside the amount without
being in the table (its three-letter code or its sign) is a currency all the
same: such a text is no case, rather than priced in another currency.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.names import bound, fresh, ref

# What people write for a unit. A sign shared by several currencies has no entry.
CURRENCY_ALIASES = {
    "USD": ("usd", "us$", "us dollars", "us dollar", "u.s. dollars"),
    "LKR": ("lkr", "slr", "sri lankan rupees"),
    "INR": ("inr", "₹", "indian rupees"),
    "SGD": ("sgd", "s$", "singapore dollars"),
    "MYR": ("myr", "rm", "ringgit"),
    "EUR": ("eur", "€", "euro", "euros"),
    "GBP": ("gbp", "£", "pounds sterling"),
    "CAD": ("cad", "c$", "ca$", "canadian dollars"),
    "AUD": ("aud", "a$", "au$", "australian dollars"),
}
SHARED_SIGNS = ("$", "rs", "rs.", "rupees", "dollars")
PERIOD_ALIASES = {
    "monthly": (
        "per month", "a month", "/month", "/ month", "/mo", "/ mo", "/mth", "monthly", "pm", "p.m.", "p.m", "pcm",
        "im monat", "pro monat", "/monat", "/ monat", "monatlich", "sebulan", "/bulan", "/ bulan", "bulanan",
    ),
    "annual": (
        "per annum", "per year", "a year", "/year", "/ year", "/yr", "/ yr", "yearly", "annually", "annual", "pa",
        "p.a.", "p.a", "im jahr", "pro jahr", "/jahr", "/ jahr", "jährlich", "setahun", "/tahun", "/ tahun",
    ),
    "daily": (
        "per day", "a day", "/day", "/ day", "daily", "pro tag", "am tag", "/tag", "/ tag", "täglich", "sehari",
        "/hari", "/ hari",
    ),
    "weekly": ("per week", "/week", "/ week", "/wk", "/ wk", "weekly", "pro woche", "/woche", "wöchentlich", "seminggu", "/minggu"),
    "hourly": (
        "per hour", "an hour", "/hour", "/ hour", "/hr", "/ hr", "hourly", "die stunde", "pro stunde", "/std.",
        "/ std.", "/std", "/ std", "/stunde", "/ stunde", "stündlich", "sejam", "/jam", "/ jam",
    ),
}
SCALE_ALIASES = {
    1_000: ("k", "thousand", "tausend"),
    100_000: ("l", "lac", "lacs", "lakh", "lakhs"),
    10_000_000: ("cr", "crore", "crores"),
    1_000_000: ("mn", "million", "millions"),
}
#: Scale and period in one word: lakhs a year.
BOTH_ALIASES = {(100_000, "annual"): ("lpa", "l.p.a.")}
UPPER_WORDS = ("up to", "max", "max.", "maximum", "not more than", "bis zu", "at most", "sehingga", "maksimum")
LOWER_WORDS = ("from", "min", "min.", "minimum", "starting at", "at least", "ab", "mindestens", "bermula", "dari")
RANGE_WORDS = ("to", "-", "–", "—", "~", "..", "and", "bis", "hingga")
#: A number before one of these counts something else than pay.
COUNT_WORDS = (
    "%", "days week", "day week", "days", "vacancies", "vacancy", "openings", "opening", "rounds", "round", "meals",
    "hrs", "hours", "weeks", "months", "years", "th month", "th", "st", "nd", "rd", "people", "positions", "leave",
)
#: A number after one of these names something.
NAME_WORDS = ("ref", "ref.", "grade", "level", "scale", "m", "after", "no.", "#", "band", "step", "job")

# Three-letter codes of currencies (ISO 4217, those in use).
CURRENCY_CODES = frozenset(
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC "
    "CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD "
    "JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD "
    "NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP "
    "SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWG".split()
)
#: What counts hours or days of work: a period behind it says how often one works, not what the pay is for.
_WORKED = re.compile(r"(?:days?|hours?|hrs?\.?|tage?n?|stunden?|hari|jam)\s*$")
#: Amounts from here on are no pay; they would not fit the arithmetic.
TOO_MUCH = 10**13

_SPACE = re.compile(r"\s+")
_REFERENCE = re.compile(r"\b(?:ref|job|no)\b[.:# ]*[a-z]*[-/]?\d+(?:[-/]\d+)*")
# An amount: grouped digits (any of the usual separators), or plain ones, with decimals.
_NUMBER = re.compile(
    r"(?<!\d)(?<!\d[.,'’])"
    r"(?:\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?(?!\d)"
    r"|\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?(?!\d)"
    r"|\d{1,3}(?:['’]\d{3})+(?:[.,]\d{1,2})?(?!\d)"
    r"|\d{1,3}(?: \d{3})+(?:[.,]\d{1,2})?(?!\d)"
    r"|\d+(?:[.,]\d{1,2})?(?!\d))"
)


def _aliases(more: tuple[tuple[str, str, str], ...] = ()) -> dict[str, set[tuple[str, object]]]:
    """What every alias means; ``more`` holds further ``(kind, unit, alias)``."""
    table: dict[str, set[tuple[str, object]]] = {}

    def add(kind: str, value: object, words) -> None:
        for w in words:
            table.setdefault(w, set()).add((kind, value))

    for unit, words in CURRENCY_ALIASES.items():
        add("currency", unit, words)
    for unit, words in PERIOD_ALIASES.items():
        add("period", unit, words)
    for unit, words in SCALE_ALIASES.items():
        add("scale", unit, words)
    for (scale, period), words in BOTH_ALIASES.items():
        add("scale", scale, words)
        add("period", period, words)
    add("sign", None, SHARED_SIGNS)
    add("upper", None, UPPER_WORDS)
    add("lower", None, LOWER_WORDS)
    add("range", None, RANGE_WORDS)
    add("count", None, COUNT_WORDS)
    add("name", None, NAME_WORDS)
    for kind, unit, alias in more:
        known = {k for k, _ in table.get(alias.strip().lower(), ())}
        if alias.strip() and kind not in known:
            add(kind, unit, (alias.strip().lower(),))
    return table


class UnitScanner:
    """Finds unit aliases near numbers; pure Python around one automaton."""

    def __init__(self, more: tuple[tuple[str, str, str], ...] = ()) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for alias, meanings in _aliases(more).items():
            self.automaton.add_word(alias, (alias, tuple(sorted(meanings, key=str))))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, tuple]]:
        """Longest non-overlapping matches, left to right, on word limits."""
        found = []
        for end, (alias, meanings) in self.automaton.iter(text):
            start, stop = end - len(alias) + 1, end + 1
            before, after = text[start - 1 : start], text[stop : stop + 1]
            if alias[0].isalpha() and before.isalpha():
                continue
            if alias[-1].isalpha() and after.isalpha():
                continue
            found.append((start, stop, meanings))
        found.sort(key=lambda m: (m[0], -m[1]))
        out, reach = [], 0
        for m in found:
            if m[0] >= reach:
                out.append(m)
                reach = m[1]
        return out

    def parse(self, raw: str | None) -> tuple[int, int, str | None, str | None] | None:
        """``(low, high, currency, period)`` in ten-thousandths; -1 for an open end; None for no pay."""
        if raw is None:
            return None
        cased = _SPACE.sub(" ", raw.replace("rs.", "rs. ").replace("Rs.", "Rs. ")).strip()
        # Letters whose lower case is longer than they are stay, so that places in both texts are the same.
        text = "".join(c.lower() if len(c.lower()) == 1 else c for c in cased)
        text = _REFERENCE.sub(lambda m: " " * len(m.group()), text)
        numbers = [(m.start(), m.end(), m.group()) for m in _NUMBER.finditer(text)]
        if not numbers:
            return None
        found = self.matches(text)

        def near(kind: str, at: int, before: bool) -> object | None:
            """The value of a match of ``kind`` that touches ``at``, blanks aside."""
            for start, stop, meanings in found:
                gap = text[stop:at] if before else text[at:start]
                if (stop <= at if before else start >= at) and not gap.strip(" "):
                    for k, value in meanings:
                        if k == kind:
                            return value if value is not None else True
            return None

        amounts = []
        for start, stop, digits in numbers:
            if near("count", stop, False) or near("name", start, True):
                if not near("scale", stop, False):
                    continue
            if text[start - 1 : start].isalpha() and near("sign", start, True) is None and near("currency", start, True) is None:
                continue
            amounts.append((start, stop, digits, near("scale", stop, False)))
        if not amounts:
            return None
        # Only numbers that a range joins belong together; the first such group is the pay.
        first = amounts[0]
        pair = None
        if len(amounts) > 1:
            between = text[first[1] : amounts[1][0]]
            kinds = {k for s, e, ms in found if s >= first[1] and e <= amounts[1][0] for k, _ in ms}
            if "range" in kinds and not re.search(r"[,(+]", between):
                pair = amounts[1]
        currency = period = None
        for start, _, meanings in found:
            for kind, value in meanings:
                if kind == "currency" and currency is None:
                    currency = value
                if kind == "period" and period is None and not _WORKED.search(text[:start]):
                    period = value
        if currency is None:
            currency = _other_currency(cased, amounts[0][0], (pair or first)[1])
        scale = first[3] or (pair[3] if pair else None) or 1
        low = _value(first[2], bool(first[3] or (pair and pair[3]))) * (first[3] or scale)
        high = _value(pair[2], bool(pair[3] or first[3])) * (pair[3] or scale) if pair else low
        if max(low, high) >= TOO_MUCH:
            return None
        if pair:
            low, high = min(low, high), max(low, high)
            return int(low * 10_000), int(high * 10_000), currency, period
        head = {k for s, e, ms in found if e <= first[0] for k, _ in ms}
        cents = int(low * 10_000)
        if "upper" in head:
            return -1, cents, currency, period
        if "lower" in head:
            return cents, -1, currency, period
        return cents, cents, currency, period


_CODE_BEFORE = re.compile(r"(?<![^\W\d_])([A-Z]{3}) ?\Z")
_CODE_AFTER = re.compile(r" ?(?:[kKlLmM](?:[nN])? ?)?([A-Z]{3})(?![^\W\d_])")


def _other_currency(cased: str, start: int, stop: int) -> str | None:
    """The code or sign of a currency beside ``cased[start:stop]`` that no alias knows; null if there is none."""
    before, after = cased[:start], cased[stop:]
    for m in (_CODE_BEFORE.search(before), _CODE_AFTER.match(after)):
        if m and m[1] in CURRENCY_CODES:
            return m[1]
    for sign in (before.rstrip(" ")[-1:], after.lstrip(" ")[:1]):
        if sign and sign not in "$" and unicodedata.category(sign) == "Sc":
            return sign
    return None


def _value(digits: str, scaled: bool) -> Decimal:
    """The number written; one separator before one or two last digits is the decimal mark."""
    plain = re.sub(r"[ '’]", "", digits)
    m = re.fullmatch(r"(.*?)[.,](\d{1,2})", plain)
    if m:
        return Decimal(re.sub(r"[.,]", "", m[1]) + "." + m[2])
    return Decimal(re.sub(r"[.,]", "", plain))


_PARSED = "low long, high long, currency string, period string"


@lru_cache(maxsize=8)
def _scanner(more: tuple[tuple[str, str, str], ...]) -> UnitScanner:
    return UnitScanner(more)


def stated_pay(text: Column, more: tuple[tuple[str, str, str], ...] = ()) -> Column:
    """Struct ``(low, high, currency, period)`` of what a pay text states; null fields if it states none.

    ``more`` holds aliases beyond those known here, as ``(kind, unit, alias)``.
    Amounts of 10**13 and more are none.
    """

    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(more)
        for batch in texts:
            rows = [scanner.parse(t) or (None, None, None, None) for t in batch]
            out = pd.DataFrame(rows, columns=["low", "high", "currency", "period"])
            yield out.astype({"low": "Int64", "high": "Int64"})

    return F.pandas_udf(scan, _PARSED)(text)


#: Largest unit table; it becomes part of the automaton on every worker.
UNIT_LIMIT = 10_000


def unit_aliases(units: DataFrame) -> tuple[tuple[str, str, str], ...]:
    """``(kind, unit, alias)``: the units of the table (a dimension of checked size) as their own aliases."""
    rows = (
        units.select("kind", F.trim("unit").alias("unit"))
        .filter(F.col("kind").isin("currency", "period") & (F.col("unit") != ""))
        .distinct()
        .limit(UNIT_LIMIT + 1)
        .collect()
    )
    if len(rows) > UNIT_LIMIT:
        raise ValueError(f"more than {UNIT_LIMIT} units; give a smaller table")
    return tuple(
        sorted((r.kind, r.unit.upper() if r.kind == "currency" else r.unit.lower(), r.unit.lower()) for r in rows)
    )


def to_common_units(
    df: DataFrame,
    units: DataFrame,
    countries: DataFrame,
    text: str = "salary_text_raw",
    currency: str = "salary_currency_normalized",
    period: str = "salary_period_normalized",
    country: str = "country",
    aliases: tuple[tuple[str, str, str], ...] = (),
) -> DataFrame:
    """Add ``usd_month_min`` and ``usd_month_max`` (bigint), plus the unit each side was read in.

    Currency: the text, else the column, else that of the country (name or code
    in any case). Period: the text, else the column, where ``unspecified`` is
    none. An end that is not given is -1. Both are null where the text states no
    amount, no period or currency is known, or the unit has no factor. Halves
    round up. The unit and country tables are dimensions; extra columns stay.
    ``aliases`` holds ``(kind, unit, alias)`` beyond those known here.
    """
    own = {n: fresh(df, f"_{n}") for n in ("pay", "cur", "per", "name")}
    got = df.withColumn(own["pay"], F.when(ref(text).rlike("[0-9]"), stated_pay(ref(text), (*aliases, *unit_aliases(units)))))
    name = F.lower(F.trim(ref(country)))
    by_country = countries.select(
        F.explode(F.array(F.lower(F.trim("country")), F.lower(F.trim("code")))).alias(own["name"]),
        F.upper("currency").alias("_native"),
    ).dropDuplicates([own["name"]])
    got = got.join(by_country, name == F.col(own["name"]), "left")
    blank = F.upper(F.trim(ref(currency)))
    told = F.lower(F.trim(ref(period)))
    got = got.withColumns(
        {
            own["cur"]: F.coalesce(F.col(f"{own['pay']}.currency"), F.when(blank != "", blank), F.col("_native")),
            own["per"]: F.coalesce(
                F.col(f"{own['pay']}.period"), F.when(~told.isin("", "unspecified", "none"), told)
            ),
        }
    )

    def factors(kind: str, key: str) -> DataFrame:
        unit = F.upper(F.trim("unit")) if kind == "currency" else F.lower(F.trim("unit"))
        return (
            units.filter(F.col("kind") == kind)
            .select(
                unit.alias(own[key]),
                F.col("multiply_by").cast("decimal(18,6)").alias(f"_{key}_by"),
                F.col("divide_by").cast("decimal(18,6)").alias(f"_{key}_over"),
            )
            .dropDuplicates([own[key]])
        )

    got = got.join(factors("currency", "cur"), own["cur"], "left").join(factors("period", "per"), own["per"], "left")

    def dollars(end: str) -> Column:
        e4 = F.col(f"{own['pay']}.{end}")
        # Halves up of (amount * by) / (10000 * over), in whole numbers.
        by = (F.col("_cur_by") * F.col("_per_by")).cast("decimal(18,4)")
        over = (F.col("_cur_over") * F.col("_per_over")).cast("decimal(18,4)")
        num = (e4.cast("decimal(18,0)") * by).cast("decimal(38,4)")
        den = (over * 10_000).cast("decimal(24,4)")
        whole = F.floor((num * 2 + den) / (den * 2)).cast("long")
        return F.when(F.col("_cur_by").isNotNull() & F.col("_per_by").isNotNull(), F.when(e4 == -1, -1).otherwise(whole))

    return got.withColumns(
        {
            fresh(df, "usd_month_min"): dollars("low").cast("long"),
            fresh(df, "usd_month_max"): dollars("high").cast("long"),
        }
    ).drop(*own.values(), "_native", "_cur_by", "_cur_over", "_per_by", "_per_over")


def monthly_pay(jobs: DataFrame, units: DataFrame, countries: DataFrame) -> DataFrame:
    """``(job_id, usd_month_min, usd_month_max)`` of every job whose pay can be converted."""
    slim = jobs.select(
        "job_id", "salary_text_raw", "salary_currency_normalized", "salary_period_normalized", "country"
    ).filter(F.col("salary_text_raw").isNotNull())
    done = to_common_units(slim, units, countries)
    return done.filter(F.col("usd_month_min").isNotNull()).select("job_id", "usd_month_min", "usd_month_max")
