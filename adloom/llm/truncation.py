"""Text cut off by field limits: right-censored length fits combined with ending evidence.

Lengths. For every source and field the histogram of lengths gives candidate
limits (lengths far more frequent than their surroundings). A log-normal length
distribution is fitted by maximum likelihood with the lengths from the limit on
taken as right-censored; what a length holds beyond the fitted density is the
posterior that a value of that length was censored.

Endings. Every line or sentence with another one after it is known to be
whole. Their words, with names and numbers as slots, tell for a context of
words how often a text goes on after it. A value without a closing mark is
judged by the most specific context with enough evidence; a last word never
seen whole, but seen as the beginning of another word, was cut inside.

The two combine as odds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.boilerplate import _FIRM_NAME, _FIRM_WORD, Wording, _bounded
from adloom.session import stored

#: Share of values cut at no limit (transfers that broke off), before any evidence.
BASE = 0.03
#: Occurrences of a context from which it is trusted.
ENOUGH = 4
#: Odds that a mark of omission at the end adds.
MARKED = 6.0
#: Odds that the beginning of a character entity at the end adds.
BROKEN = 1e4
#: Final units without a closing mark that recur so often are whole, unless whole units begin alike.
RECURS = 5
#: Share of endings never seen before that are whole all the same.
NEW = 0.012
#: Log likelihood ratio from which a length is more frequent than its surroundings.
UNLIKELY = 7.5
#: Characters below a limit that still count as at the limit (words kept whole, blanks cut, marks added).
REACH = 12

_LINE = re.compile(r"[\r\n]+")
_STOP = re.compile(r"(?<=[a-zäöüß\d)][a-zäöüß\d)][.!?])(?<![ (]no\.)(?<![ (]nr\.)(?<!Ref\.)(?<!Nr\.)\s+")
# The beginning of a character entity: a transfer that broke off inside it.
_BROKEN = re.compile(r"&(?:#x?\w*|a(?:mp?|po?s?)?|nb?s?p?|qu?o?t?|l[ts]?|gt?|nd?a?s?h?|md?a?s?h?|he?l?l?i?p?)$")
_OMITTED = re.compile(r"\s*(?:\[\s*(?:…|\.\.\.)\s*\]|…|\.\.\.)\s*(?:mehr|more|read more|weiterlesen|lagi|baca lagi)?\s*$", re.I)
_CLOSED = re.compile(r"[.!?]['\"”’)\]]*\s*$")
_NOISE = re.compile(r"[^\w\x02-\x06+&'’/-]+")
_BULLET = re.compile(r"^\s*(?:[\-–—•*·▪●◦]|\d{1,2}[.)])\s*")
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")


class Units:
    """Cuts texts into units of words: lines, and sentences within lines."""

    def __init__(self, vocabulary: tuple[tuple[str, ...], ...]) -> None:
        self.slots = Wording(*map(list, vocabulary)).slots
        self.words = lru_cache(maxsize=1 << 15)(self.compute)

    def compute(self, unit: str) -> str:
        t = _BULLET.sub("", unit)
        for pattern, slot in self.slots:
            if pattern is not _FIRM_NAME or _FIRM_WORD.search(t):
                t = pattern.sub(f" {slot} ", t)
        return " ".join(_NOISE.sub(" ", _DIGITS.sub("9", t)).lower().split())

    @staticmethod
    def cut(text: str) -> list[str]:
        return [s for line in _LINE.split(text) if line.strip() for s in _STOP.split(line.strip()) if s]


@lru_cache(maxsize=4)
def _units(vocabulary: tuple[tuple[str, ...], ...]) -> Units:
    return Units(vocabulary)


def openings(unit: str) -> list[int]:
    """A hash of the first ``i`` words of a unit for every ``i``, each from the one before."""
    out, h = [], 0
    for w in unit.split(" "):
        h = xxhash.xxh3_64_intdigest(w, seed=h)
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


_CUT = "key string, field string, source string, length long, unit string, opens array<long>, factor double, n long"
_CUT_ARROW = pa.schema(
    [
        ("key", pa.string()), ("field", pa.string()), ("source", pa.string()), ("length", pa.int64()), ("unit", pa.string()),
        ("opens", pa.list_(pa.int64())), ("factor", pa.float64()), ("n", pa.int64()),
    ]
)
#: Distinct units that a worker sums before it passes them on.
SUMMED = 100_000


def cut_units(values: DataFrame, vocabulary: tuple[tuple[str, ...], ...]) -> DataFrame:
    """One pass over all texts: rows of units known to be whole, and rows of open last units.

    A whole unit (another follows, or it has a closing mark) has ``n``, how often
    it occurs; a last unit without a closing mark has the ``key``, ``field``,
    ``source`` and ``length`` of its text and ``factor``, what marks of omission
    add to the odds. ``opens`` are the :func:`openings`; last units have the two
    longest only (all but the last word, and all).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(vocabulary)
        seen: Counter[str] = Counter()

        def summed() -> pa.RecordBatch:
            seen.pop("", None)
            said = list(seen)
            none, nothing = pa.nulls(len(said), pa.string()), pa.nulls(len(said), pa.int64())
            columns = [
                none, none, none, nothing, pa.array(said, pa.string()), pa.array(map(openings, said), pa.list_(pa.int64())),
                pa.nulls(len(said), pa.float64()), pa.array(seen.values(), pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=_CUT_ARROW)

        for batch in batches:
            last = []
            for key, field, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                t = text.rstrip() if text else ""
                if not t:
                    continue
                mark = _OMITTED.search(t)
                closed = mark is None and _CLOSED.search(t)
                parts = units.cut(t[: mark.start()] if mark else t)
                seen.update(map(units.words, parts if closed else parts[:-1]))
                if not closed:
                    factor = BROKEN if _BROKEN.search(t) else MARKED if mark else 1.0
                    unit = units.words(parts[-1]) if parts else ""
                    last.append((key, field, source, len(text), unit, openings(unit)[-2:], factor, None))
            if last:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*last), _CUT_ARROW)]
                yield pa.RecordBatch.from_arrays(columns, schema=_CUT_ARROW)
            if len(seen) >= SUMMED:
                yield summed()
                seen.clear()
        yield summed()

    return values.select("key", "field", "source", "text").mapInArrow(run, _CUT)


def _contexts(words: Column, i: Column, opening: Column) -> Column:
    """Keys of the contexts that end with the first ``i`` words, most specific first; each has a bounded number of words."""
    last = F.get(words, i - 1)
    before = F.coalesce(F.get(words, i - 2), F.lit("^"))
    third = F.coalesce(F.get(words, i - 3), F.lit("^"))
    one, two = F.get(words, F.lit(0)), F.when(i > 1, F.get(words, F.lit(1)))
    return F.array(
        F.xxhash64(F.lit(0), opening),
        F.xxhash64(F.lit(1), one, two, before, last),
        F.xxhash64(F.lit(2), one, two, F.lit("..."), last),
        F.xxhash64(F.lit(3), third, before, last),
        F.xxhash64(F.lit(4), before, last),
        F.xxhash64(F.lit(5), last),
    )


def context_counts(units: DataFrame) -> DataFrame:
    """``(context, seen, ends)``: how often a context of words occurs and how often its unit ends there."""
    steps = F.transform(
        F.sequence(F.lit(1), F.size("_w")),
        lambda i: F.struct(_contexts(F.col("_w"), i, F.get("opens", i - 1)).alias("c"), (i == F.size("_w")).alias("e")),
    )
    return (
        units.select(F.split("unit", " ").alias("_w"), "opens", "n")
        .select("n", F.explode(steps).alias("_s"))
        .select("n", F.col("_s.e").alias("_e"), F.explode("_s.c").alias("context"))
        .groupBy("context")
        .agg(F.sum("n").alias("seen"), F.sum(F.when(F.col("_e"), F.col("n")).otherwise(0)).alias("ends"))
    )


#: Characters of the beginning of a word in its key; longer beginnings are told apart by their length as well.
BEGINNING = 64


def _beginning(before: Column, start: Column) -> Column:
    return F.xxhash64(before, F.substring(start, 1, BEGINNING))


def word_beginnings(units: DataFrame) -> DataFrame:
    """``(beginning, longest)``: keys of a word before and a beginning of the word after it, and the longest such word."""
    words = F.split("unit", " ")
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("_w")),
        lambda i: F.struct(F.coalesce(F.get(F.col("_w"), i - 2), F.lit("^")).alias("b"), F.get(F.col("_w"), i - 1).alias("w")),
    )
    return (
        units.select(words.alias("_w"))
        .select(F.explode(pairs).alias("_p"))
        .distinct()
        .filter(F.length("_p.w") > 1)
        .select(
            F.length("_p.w").alias("length"),
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.least(F.length("_p.w"), F.lit(BEGINNING))),
                    lambda k: F.xxhash64(F.col("_p.b"), F.substring(F.col("_p.w"), F.lit(1), k)),
                )
            ).alias("beginning"),
        )
        .groupBy("beginning")
        .agg(F.max("length").alias("longest"))
    )


def _norm_cdf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)), otypes=[float])(x)


def censored_fit(x: np.ndarray, n: np.ndarray, limit: float, rounds: int = 40) -> tuple[float, float]:
    """Mean and deviation of a normal distribution, values from ``limit`` on right-censored there (EM)."""
    free = x < limit
    total, cut = n.sum(), n[~free].sum()
    if n[free].sum() < 2:
        return float(np.average(x, weights=n)), 1.0
    mean = float(np.average(x[free], weights=n[free]))
    dev = max(float(np.sqrt(np.average((x[free] - mean) ** 2, weights=n[free]))), 1e-3)
    first, square = float((x[free] * n[free]).sum()), float((x[free] ** 2 * n[free]).sum())
    for _ in range(rounds):
        z = (limit - mean) / dev
        tail = max(0.5 * math.erfc(z / math.sqrt(2.0)), 1e-12)
        hazard = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        e1 = mean + dev * hazard
        e2 = mean * mean + dev * dev + dev * hazard * (limit + mean)
        new = (first + cut * e1) / total
        second = (square + cut * e2) / total
        spread = math.sqrt(max(second - new * new, 1e-6))
        done = abs(new - mean) + abs(spread - dev) < 1e-6
        mean, dev = new, spread
        if done:
            break
    return mean, dev


def censoring(hist: pd.DataFrame) -> pd.DataFrame:
    """Posterior of censoring for every length of one source and field; ``hist`` has ``length`` and ``n``."""
    hist = hist.sort_values("length")
    length, n = hist["length"].to_numpy(), hist["n"].to_numpy().astype(float)
    total = n.sum()
    post = np.full(len(length), BASE)
    limits = np.zeros(len(length), dtype=np.int64)
    # A limit: a length that is frequent beside its wider surroundings, with little above it.
    summed = np.concatenate([[0.0], np.cumsum(n)])
    low, high = np.searchsorted(length, length - 60, "left"), np.searchsorted(length, length - 2, "right")
    surround = (summed[high] - summed[low]) / 59
    above = total - np.cumsum(n)
    # Far above the expected number, by ratio and by likelihood: few values need a larger ratio.
    usual = surround + 0.5
    likelier = n * np.log(n / usual) - (n - usual)
    strong = np.where((likelier > UNLIKELY) & (n > 6 * usual) & (above <= total * 0.5))[0]
    done: set[int] = set()
    for k in strong[::-1]:
        if any(0 <= d - length[k] <= REACH for d in done):
            continue
        top = int(length[k])
        done.add(top)
        near = (length > top - REACH) & (length <= top + 1)
        mean, dev = censored_fit(np.log(length), n, math.log(max(top - REACH, 1)))
        edges = lambda a: _norm_cdf((np.log(a) - mean) / dev)
        here = length[near].astype(float)
        expected = np.minimum(total * (edges(here + 0.5) - edges(np.maximum(here - 0.5, 0.5))), n[near])
        excess = 1 - np.maximum(expected, np.minimum(surround[k] + 0.5, n[near])) / n[near]
        post[near] = np.clip(np.maximum(post[near], excess), BASE, 0.995)
        limits[near] = top
    return pd.DataFrame(
        {"source": hist["source"], "field": hist["field"], "length": length, "posterior": post, "limit_at": limits}
    )


_CENSORED = "source string, field string, length long, posterior double, limit_at long"


def censoring_posteriors(values: DataFrame) -> DataFrame:
    """``(source, field, length, posterior, limit_at)``; groups are histograms of lengths, bounded by the field."""
    hist = values.groupBy("source", "field", F.length("text").cast("long").alias("length")).agg(F.count("*").alias("n"))
    return hist.filter(F.col("length") > 0).groupBy("source", "field").applyInPandas(censoring, _CENSORED)


def truncation_odds(values: DataFrame, vocabulary: tuple[tuple[str, ...], ...] = ((), (), ())) -> DataFrame:
    """``(key, field, source, posterior, whole_share, log_odds)`` of all values without a closing mark.

    ``values`` has ``(key, field, source, text)``. Null, empty and blank texts
    have no row; neither have texts that end with a closing mark.
    """
    own = values.filter(F.trim("text") != "")
    # The only pass over the texts by Python; units with counts are small beside the texts, three statistics read them.
    cut = stored(cut_units(own, vocabulary))
    units = cut.filter(F.col("n").isNotNull()).groupBy("unit").agg(F.first("opens").alias("opens"), F.sum("n").alias("n"))
    units = stored(units)
    open_ = cut.filter(F.col("n").isNull()).select("key", "field", "source", "length", "unit", "factor", "opens")
    # Each distinct ending is judged once.
    endings = open_.groupBy("unit").agg(F.count("*").alias("finals"), F.first("opens").alias("opens"))
    words = F.split("unit", " ")
    whole = F.element_at("opens", -1)
    asked = endings.select("unit", F.posexplode(_contexts(words, F.size(words), whole)))
    tail = F.element_at(words, -1)
    before = F.coalesce(F.get(words, F.size(words) - 2), F.lit("^"))
    counts = context_counts(units)
    got = (
        asked.withColumnRenamed("col", "context")
        .join(counts, "context")
        .filter(F.col("seen") >= F.when(F.col("pos") == 5, 1).otherwise(ENOUGH))
        .groupBy("unit")
        .agg(F.min_by(F.struct("pos", "seen", "ends"), "pos").alias("best"))
    )
    # Units begin alike if all but the last word was seen as an opening.
    opening = F.when(F.size("opens") > 1, F.xxhash64(F.lit(0), F.element_at("opens", 1)))
    started = counts.select(F.col("context").alias("opening"), F.lit(True).alias("started"))
    judged = (
        endings.join(got, "unit", "left")
        .withColumn("opening", opening)
        .join(started, "opening", "left")
        .withColumn("beginning", _beginning(before, tail))
        .join(word_beginnings(units), "beginning", "left")
        .withColumn("inside", F.col("longest") > F.length(tail))
    )
    seen, ends = F.col("best.seen"), F.col("best.ends")
    # The last word alone says little: the pair it ends was never seen often enough.
    weak = seen.isNull() | (F.col("best.pos") == 5)
    share = (
        F.when(F.col("unit") == "", 0.5)
        .when(F.col("inside") & (weak | (F.col("best.pos") == 4)), NEW)
        .when(~weak, (ends + 0.02) / (seen + 0.5))
        .when((F.col("finals") >= RECURS) & F.col("started").isNull(), 0.9)
        .otherwise(NEW)
    )
    share = F.least(F.greatest(share, F.lit(0.002)), F.lit(0.998))
    ended = judged.select("unit", share.alias("whole_share"))
    lengths = censoring_posteriors(own)
    prior = F.coalesce("posterior", F.lit(BASE))
    odds = (
        F.log(prior / (1 - prior))
        + F.log((1 - F.col("whole_share")) / F.col("whole_share"))
        + F.log("factor")
    )
    return (
        open_.drop("opens")
        .join(ended, "unit")
        .join(lengths, ["source", "field", "length"], "left")
        .select("key", "field", "source", "length", "unit", prior.alias("posterior"), "limit_at", "whole_share", odds.alias("log_odds"))
    )


#: Log odds from which a value counts as cut.
CUT = 0.0


def _values(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        F.col("job_id").alias("key"),
        F.coalesce("source_hostname", F.lit("")).alias("source"),
        F.explode(
            F.array(
                *(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("job_description", "requirements"))
            )
        ).alias("_v"),
    ).select("key", "source", "_v.field", "_v.text")


def slot_words(locations: DataFrame, titles: DataFrame, skills: DataFrame) -> tuple[tuple[str, ...], ...]:
    """The words that become slots: places, titles, skills; each list is bounded."""
    return (
        _bounded(locations, "city", "region", "country"),
        _bounded(titles, "title"),
        _bounded(skills, "canonical_name"),
    )


def truncated_values(jobs: DataFrame, locations: DataFrame, titles: DataFrame, skills: DataFrame) -> DataFrame:
    """``(job_id, field)`` of the descriptions and requirements that stop before their text does."""
    odds = truncation_odds(_values(jobs), slot_words(locations, titles, skills))
    return odds.filter(F.col("log_odds") > CUT).select(F.col("key").alias("job_id"), "field")


def truncation_report(jobs: DataFrame, locations: DataFrame, titles: DataFrame, skills: DataFrame) -> DataFrame:
    """``(source, field, n_values, n_cut, cut_share, usual_limit)``: how often each source truncates."""
    values = _values(jobs)
    odds = truncation_odds(values, slot_words(locations, titles, skills))
    cut = odds.filter(F.col("log_odds") > CUT).groupBy("source", "field").agg(
        F.count("*").alias("n_cut"), F.mode(F.when(F.col("limit_at") > 0, F.col("limit_at"))).alias("usual_limit")
    )
    every = values.filter(F.trim("text") != "").groupBy("source", "field").agg(F.count("*").alias("n_values"))
    n_cut = F.coalesce("n_cut", F.lit(0))
    return every.join(cut, ["source", "field"], "left").select(
        "source", "field", "n_values", n_cut.alias("n_cut"), F.round(n_cut / F.col("n_values"), 6).alias("cut_share"), "usual_limit"
    )
