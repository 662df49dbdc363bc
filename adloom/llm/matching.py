"""Free-entered values to the closest entry of a reference list, by prefix-filtered similarity join.

A value becomes the set of its character bigrams. Bigrams are ordered by global
rarity, only the rarest prefix of each set is joined, candidates are cut by the
length and positional filters, Jaccard is verified exactly, an edit-distance
check drops pairs that cannot mean the same, and the most similar is kept.
Every distinct value is matched once, however many rows hold it.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Jaccard similarity of bigram sets that candidates must reach.
THRESHOLD = 0.3
#: Slips (a letter wrong, missing, doubled, or two swapped) that still mean the entry, by the entry's length.
SLIPS = ((4, 0), (5, 1), (8, 2), (12, 2), (1 << 30, 3))
#: Places are single names, so a third slip is allowed from this length on; titles share words with others.
PLACE_LENGTH = 9

# Letters with marks and their plain forms.
_MARKED = "äöüáàâãåéèêëíìîïóòôõúùûçñýøœæ"
_PLAIN = "aouaaaaaeeeeiiiioooouuucnyooa"

# What typed titles add to the entry, and short forms of its words.
GRADES = (
    "senior", "sr", "junior", "jr", "lead", "principal", "staff", "trainee", "intern", "associate", "mid-level",
    "mid level", "entry-level", "entry level", "graduate", "experienced", "head", "chief", "assistant",
)
TITLE_NOTES = (
    r"\d+\+? ?(?:yrs?|years?)(?: of)?(?: exp(?:erience)?)?", r"(?:night|day|rotating) shift", r"remote", r"hybrid",
    r"on-?site", r"immediate joiners?", r"part[ -]time", r"full[ -]time", r"urgent(?:ly)?(?: hiring)?", r"wanted",
    r"contract", r"freelance", r"permanent", r"temporary", r"x ?\d+", r"ref[ .:#]*\w*\d\w*", r"\d+ (?:openings?|posts?)",
)
SHORT_WORDS = {
    r"\beng\.?(?=ing\b)|\bengr(?=ing\b)": "engineer",
    r"\b(?:engr|eng|enginr)\b\.?": "engineer",
    r"\bdev\b\.?": "developer",
    r"\bmgr\b\.?": "manager",
    r"\barch\b\.?": "architect",
    r"\b(?:anlst|analst)\b\.?": "analyst",
    r"\bcons\b\.?": "consultant",
    r"\bspec\b\.?": "specialist",
    r"\bprog\b\.?": "programmer",
    r"\btech\b\.(?= )": "technical",
    r"\badmin\b\.?": "administrator",
    r"\bs/w\b": "software",
}
# What typed places add to the city.
PLACE_NOTES = (
    r"hybrid", r"remote", r"on-?site", r"office", r"hq", r"headquarters", r"area", r"cbd", r"city cent(?:re|er)",
    r"tech park", r"north", r"south", r"east", r"west", r"central", r"downtown", r"district \d+", r"zone \d+", r"\d+",
    r"city", r"region", r"suburbs?", r"metro(?:politan)?(?: area)?", r"industrial (?:park|estate)", r"business park",
)
PLACE_LEADS = (r"located in", r"based in", r"office:?", r"location:?", r"greater", r"near", r"around", r"in")


def plain(c: Column) -> Column:
    """Lower case without marks, with single blanks."""
    low = F.translate(F.lower(c), _MARKED, _PLAIN)
    low = F.regexp_replace(low, "ß", "ss")
    return F.trim(F.regexp_replace(low, r"[\s ]+", " "))


def title_core(c: Column) -> Column:
    """A typed title without grade, contract, shift or reference notes, short words written out."""
    t = plain(c)
    t = F.regexp_replace(t, r"[\[(][^\])]*[\])]?", " ")
    notes = "|".join(TITLE_NOTES)
    t = F.regexp_replace(t, rf"(?:^|[\s\-–—|/,:]+)(?:{notes})\s*!*(?=$|[\s\-–—|/,!])", " ")
    t = F.regexp_replace(t, r"[!?*]+", " ")
    t = F.trim(F.regexp_replace(t, r"^\s*([^,]+?)\s*,\s*([^,]+?)\s*$", "$2 $1"))
    t = F.regexp_replace(t, rf"^\s*(?:(?:{'|'.join(GRADES)})\b\.?[\s\-]*)+(?=\S)", "")
    t = F.regexp_replace(t, r"\s(?:i{1,3}|iv|v)\s*$", "")
    return _written_out(t)


def _written_out(c: Column) -> Column:
    for pattern, word in SHORT_WORDS.items():
        c = F.regexp_replace(c, pattern, word)
    return c


def place_segments(c: Column) -> Column:
    """The parts of a typed place, each without notes."""
    parts = F.split(plain(c), r"\s*[,/|;()\[\]]+\s*|\s+[-–—]\s+")
    notes = "|".join(PLACE_NOTES)

    def core(x: Column) -> Column:
        x = F.regexp_replace(x, rf"^(?:(?:{'|'.join(PLACE_LEADS)})\s+)+(?=\S)", "")
        return F.trim(F.regexp_replace(x, rf"(?<=\S)(?:[\s\-]+(?:{notes}))+\.?$", ""))

    return F.array_distinct(F.filter(F.transform(parts, core), lambda x: x != ""))


def squashed(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def bigrams(c: Column) -> Column:
    """The set of character bigrams of ``^text$``."""
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    )


def prefix_join(
    values: DataFrame, entries: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """``(kind, text, key, similarity)``: pairs of equal ``kind`` whose bigram sets reach ``threshold``.

    ``values`` has ``(kind, text)``, ``entries`` ``(kind, key)``; each side must
    be distinct. Empty texts pair with nothing.
    """
    sides = {
        "text": values.select("kind", "text").filter(F.col("text") != ""),
        "key": entries.select("kind", "key").filter(F.col("key") != ""),
    }
    grams = {n: d.withColumn("_g", F.explode(bigrams(F.col(n)))) for n, d in sides.items()}
    rarity = (
        reduce(DataFrame.unionByName, (g.select("_g") for g in grams.values()))
        .groupBy("_g")
        .agg(F.count("*").alias("_df"))
    )

    def prefixes(name: str) -> DataFrame:
        order = F.array_sort(F.collect_list(F.struct("_df", "_g")))
        ranked = (
            grams[name]
            .join(rarity, "_g")
            .groupBy("kind", name)
            .agg(F.transform(order, lambda x: x["_g"]).alias("_set"))
        )
        size = F.size("_set")
        keep = size - F.ceil(size * threshold) + 1
        return ranked.select(
            "kind", name, F.col("_set").alias(f"_set_{name}"), F.posexplode(F.slice("_set", F.lit(1), keep.cast("int")))
        ).withColumnsRenamed({"pos": f"_pos_{name}", "col": "_g"})

    x, y = prefixes("text"), prefixes("key")
    nx, ny = F.size("_set_text"), F.size("_set_key")
    need = F.ceil((nx + ny) * (threshold / (1 + threshold)) - 1e-9)
    reach = F.least(nx - F.col("_pos_text"), ny - F.col("_pos_key"))
    candidates = (
        x.join(y, ["kind", "_g"])
        .filter((nx >= ny * threshold) & (ny >= nx * threshold) & (reach >= 1))
        .groupBy("kind", "text", "key")
        .agg(
            F.first("_set_text").alias("_set_text"),
            F.first("_set_key").alias("_set_key"),
            # The first shared bigram bounds the overlap that is still possible.
            F.max(reach).alias("_reach"),
        )
        .filter(F.col("_reach") >= need)
    )
    shared = F.size(F.array_intersect("_set_text", "_set_key"))
    similarity = shared / (nx + ny - shared)
    return candidates.select("kind", "text", "key", similarity.alias("similarity")).filter(
        F.col("similarity") >= threshold
    )


def slips(a: str, b: str, most: int) -> int:
    """Letters wrong, missing, added or swapped with a neighbour between two words; ``most + 1`` if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row[j] = cost
        if min(row) > most and min(before) > most:
            return most + 1
    return min(row[-1], most + 1)


@F.pandas_udf(T.IntegerType())
def _slips(a: pd.Series, b: pd.Series) -> pd.Series:
    most = SLIPS[-1][1]
    return pd.Series([slips(x, y, most) for x, y in zip(a, b)], dtype="int32")


# Kept above the exchange before it; the optimizer moves other filters below.
_slips = _slips.asNondeterministic()


def _best(pairs: DataFrame) -> DataFrame:
    """The most similar entry key of each text by Jaccard, of those that few enough slips tell from it; ties stay together."""
    allowed = reduce(
        lambda c, step: c.when(F.length("key") <= step[0], step[1]), SLIPS[1:], F.when(F.length("key") <= SLIPS[0][0], SLIPS[0][1])
    )
    # A swap counts twice in the plain edit distance, so this leaves out no pair within the allowance.
    close = pairs.filter(F.levenshtein("text", "key", 2 * SLIPS[-1][1]) >= 0)
    allowed = F.when((F.col("kind") == "location") & (F.length("key") >= PLACE_LENGTH), SLIPS[-1][1]).otherwise(allowed)
    # Few rows come out of the join, which would all go to one task; a fixed number of partitions is not merged.
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = close.repartition(parts, "text", "key").withColumn("edits", _slips("text", "key")).filter(F.col("edits") <= allowed)
    most = W.partitionBy("kind", "text")
    return (
        near.withColumn("_most", F.max("similarity").over(most))
        .filter(F.col("similarity") == F.col("_most"))
        .select("kind", "text", "key", "similarity", "edits")
    )


def entry_keys(locations: DataFrame, titles: DataFrame) -> DataFrame:
    """``(kind, key, entry_id, country, region)``: every spelling of every reference entry."""
    cities = locations.select(
        F.lit("location").alias("kind"),
        F.explode(
            F.concat(
                F.array("city", F.regexp_replace("city", r"\bSt\.? (?=\p{L})", "Saint ")), F.coalesce("aliases", F.array())
            )
        ).alias("name"),
        F.col("location_id").cast("long").alias("entry_id"),
        plain(F.col("country")).alias("country"),
        plain(F.col("region")).alias("region"),
    ).withColumn("key", squashed(plain(F.col("name"))))
    jobs = titles.select(
        F.lit("job_title").alias("kind"),
        F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array()))).alias("name"),
        F.col("title_id").cast("long").alias("entry_id"),
        F.lit(None).cast("string").alias("country"),
        F.lit(None).cast("string").alias("region"),
    ).withColumn("key", squashed(_written_out(plain(F.col("name")))))
    return cities.unionByName(jobs).drop("name").filter(F.col("key") != "").distinct()


def value_entries(values: DataFrame, entries: DataFrame, countries: DataFrame) -> DataFrame:
    """``(kind, value, hits, areas)`` for distinct ``(kind, value)``.

    ``hits`` lists the closest entries (empty if none is meant), ``areas`` the
    countries and regions that the value names.
    """
    parts = F.when(F.col("kind") == "location", place_segments(F.col("value"))).otherwise(
        F.array(title_core(F.col("value")))
    )
    long = values.select("kind", "value", F.posexplode(parts).alias("_k", "_part"))
    areas = (
        entries.filter(F.col("kind") == "location")
        .select(F.explode(F.array("country", "region")).alias("_area"), F.col("country").alias("_in"))
        .unionByName(
            countries.select(plain(F.col("code")).alias("_area"), plain(F.col("country")).alias("_in"))
        )
        .distinct()
    )
    # A word such as a region can stand for several countries only if the list says so.
    area_of = areas.groupBy("_area").agg(F.collect_set("_in").alias("_in"))
    tagged = long.join(area_of, (F.col("kind") == "location") & (F.col("_part") == F.col("_area")), "left").withColumn(
        "text", squashed(F.col("_part"))
    )
    texts = tagged.filter(F.col("_area").isNull()).select("kind", "text").distinct()
    keys = entries.select("kind", "key").distinct()
    best = _best(prefix_join(texts, keys))
    hits = best.join(entries, ["kind", "key"]).groupBy("kind", "text").agg(
        F.collect_set(F.struct("edits", (-F.col("similarity")).alias("unlike"), "entry_id", "country", "region")).alias("_hits")
    )
    matched = tagged.join(hits, ["kind", "text"], "left")
    return matched.groupBy("kind", "value").agg(
        F.flatten(F.collect_list("_hits")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("_in"))).alias("areas"),
        F.collect_set(F.when(F.col("_area").isNotNull(), F.col("_part"))).alias("names"),
    )


def canonical_entries(
    jobs: DataFrame, locations: DataFrame, titles: DataFrame, countries: DataFrame, sources: DataFrame
) -> DataFrame:
    """``(job_id, field, entry_id)`` of every typed location and title; -1 where the list has no entry.

    Null and blank values and those that are letter for letter an entry's name
    are left out. The most similar entry is taken; of equally similar ones the one
    in an area that the value names, then the one in the advert's country, then the
    one in its source's country, then the smallest id.
    """
    long = jobs.select(
        "job_id",
        "country",
        "source_hostname",
        F.explode(
            F.array(
                F.struct(F.lit("location").alias("kind"), F.col("location").alias("value")),
                F.struct(F.lit("job_title").alias("kind"), F.col("job_title").alias("value")),
            )
        ).alias("_v"),
    ).select("job_id", "country", "source_hostname", "_v.kind", "_v.value")
    names = (
        locations.select(F.lit("location").alias("kind"), F.col("city").alias("value"))
        .unionByName(titles.select(F.lit("job_title").alias("kind"), F.col("title").alias("value")))
        .distinct()
    )
    typed = long.filter(F.regexp_replace("value", r"[\s ]", "") != "").join(names, ["kind", "value"], "left_anti")
    entries = entry_keys(locations, titles)
    mapped = value_entries(typed.select("kind", "value").distinct(), entries, countries)
    native = countries.select(
        F.explode(F.array(plain(F.col("country")), plain(F.col("code")))).alias("_said"),
        plain(F.col("country")).alias("_own"),
    ).dropDuplicates(["_said"])
    hosts = sources.select("source_hostname", plain(F.col("country")).alias("_host")).dropDuplicates(["source_hostname"])
    joined = (
        typed.join(mapped, ["kind", "value"], "left")
        .withColumn("_typed", plain(F.col("country")))
        .join(native, F.col("_typed") == F.col("_said"), "left")
        .join(hosts, "source_hostname", "left")
    )

    def rank(h: Column) -> Column:
        named = F.array_contains("names", h["region"]) | F.array_contains("areas", h["country"])
        return F.struct(
            h["unlike"].alias("unlike"),
            F.when(F.coalesce(named, F.lit(False)), 0)
            .when(h["country"] == F.col("_own"), 1)
            .when(h["country"] == F.col("_host"), 2)
            .otherwise(3)
            .alias("far"),
            h["entry_id"].alias("entry_id"),
        )

    best = F.array_min(F.transform(F.col("hits"), rank))
    return joined.select(
        "job_id", F.col("kind").alias("field"), F.coalesce(best["entry_id"], F.lit(-1).cast("long")).alias("entry_id")
    )


def unmatched_report(found: DataFrame, jobs: DataFrame) -> DataFrame:
    """``(field, value, n_jobs)`` of the typed values that have no entry."""
    none = found.filter(F.col("entry_id") == -1).select("job_id", "field")
    values = jobs.select(
        "job_id",
        F.explode(
            F.array(
                F.struct(F.lit("location").alias("field"), F.col("location").alias("value")),
                F.struct(F.lit("job_title").alias("field"), F.col("job_title").alias("value")),
            )
        ).alias("_v"),
    ).select("job_id", "_v.field", "_v.value")
    return (
        none.join(values, ["job_id", "field"])
        .groupBy("field", F.trim("value").alias("value"))
        .agg(F.count("*").alias("n_jobs"))
    )
