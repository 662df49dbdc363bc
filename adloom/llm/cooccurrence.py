"""Items that appear together, by basket collapsing.

Identical deduplicated item arrays are grouped into weighted baskets, pairs are
enumerated once per distinct basket, and weights are summed. The number of rows
past the first shuffle is that of distinct baskets, not of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.names import ref
from adloom.session import stored

#: The pseudo item that every basket holds, so that single counts and the total come out as pairs.
ANY = -1


def item_list(text: Column) -> Column:
    """The items of a list written as JSON, Python or delimited text; null gives no items.

    A text in square brackets is read as a quoted list; otherwise the first
    delimiter present of ``; | newline ,`` splits it.
    """
    t = F.trim(text)
    quoted = F.transform(
        F.regexp_extract_all(t, F.lit(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\.)*)\'|([^\[\],"\'\s][^\[\],"\']*)'), F.lit(0)),
        lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", ""),
    )
    delimited = (
        F.when(t.contains(";"), F.split(t, ";"))
        .when(t.contains("|"), F.split(t, r"\|"))
        .when(t.contains("\n"), F.split(t, r"\n"))
        .otherwise(F.split(t, ","))
    )
    items = F.when(t.rlike(r"(?s)^\[.*\]$"), quoted).otherwise(delimited)
    cleaned = F.filter(F.transform(items, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.coalesce(F.array_distinct(cleaned), F.array().cast("array<string>"))


def canonical_items(records: DataFrame, skills: DataFrame, key: str, raw: str) -> DataFrame:
    """``(key, item)``: the distinct skill ids that each record's list names, whatever the case."""
    alias = F.explode(
        F.concat(F.array("canonical_name"), F.coalesce(F.from_json("aliases_json", "array<string>"), F.array()))
    )
    names = (
        skills.select(F.col("skill_id").cast("long").alias("item"), alias.alias("_alias"))
        .select("item", F.lower(F.trim("_alias")).alias("_alias"))
        .filter(F.col("_alias") != "")
        .groupBy("_alias")
        .agg(F.min("item").alias("item"))
    )
    said = (
        records.select(ref(key).alias("key"), ref(raw).alias("_raw"))
        .filter(F.col("key").isNotNull() & F.col("_raw").isNotNull())
        .select("key", F.explode(item_list(F.col("_raw"))).alias("_alias"))
    )
    return said.join(names, "_alias").select("key", "item").distinct()


def weighted_baskets(items: DataFrame) -> DataFrame:
    """``(basket, weight)``: every distinct sorted item array and the number of keys that hold it."""
    return (
        items.groupBy("key")
        .agg(F.array_sort(F.collect_set("item")).alias("basket"))
        .groupBy("basket")
        .agg(F.count("*").alias("weight"))
    )


def pair_weights(baskets: DataFrame) -> DataFrame:
    """``(a, b, n)`` with ``a < b``; pairs with :data:`ANY` count single items, ``(ANY, ANY)`` all baskets."""
    any_item = F.lit(ANY).cast("long")
    # A row for each first item, so that a basket of k items never stands as k * k / 2 pairs in one row.
    firsts = baskets.select(F.concat(F.array(any_item), F.col("basket")).alias("_all"), "weight").select(
        "weight", "_all", F.posexplode("_all").alias("_i", "a")
    )
    later = F.slice("_all", F.col("_i") + 2, F.size("_all"))
    seconds = F.when(F.col("_i") == 0, F.concat(F.array(any_item), later)).otherwise(later)
    return firsts.select("a", F.explode(seconds).alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("n"))


def pair_scores(counts: DataFrame) -> DataFrame:
    """Counts and scores of each pair: support, both confidences, lift, conviction, PMI and NPMI.

    ``conviction_ab`` is null where a never comes without b. No row comes out of
    an empty input.
    """
    single = counts.filter((F.col("a") == ANY) & (F.col("b") != ANY))
    total = counts.filter((F.col("a") == ANY) & (F.col("b") == ANY)).select(F.col("n").cast("double")).scalar()
    n_a = single.select(F.col("b").alias("a"), F.col("n").alias("n_a"))
    n_b = single.select(F.col("b"), F.col("n").alias("n_b"))
    p = counts.filter(F.col("a") != ANY).join(n_a, "a").join(n_b, "b").withColumn("baskets", total)
    share = F.col("n") / F.col("baskets")
    lift = F.col("n") * F.col("baskets") / (F.col("n_a") * F.col("n_b"))
    conf = F.col("n") / F.col("n_a")
    conviction = F.when(conf < 1, (1 - F.col("n_b") / F.col("baskets")) / (1 - conf))
    return p.select(
        F.col("a").alias("skill_id_a"),
        F.col("b").alias("skill_id_b"),
        F.col("n").alias("n_ab"),
        "n_a",
        "n_b",
        F.col("baskets").cast("long").alias("n_baskets"),
        F.round(share, 6).alias("support"),
        F.round(conf, 6).alias("confidence_ab"),
        F.round(F.col("n") / F.col("n_b"), 6).alias("confidence_ba"),
        F.round(lift, 6).alias("lift"),
        F.round(conviction, 6).alias("conviction_ab"),
        F.round(F.log2(lift), 6).alias("pmi"),
        F.round(F.when(share < 1, F.log2(lift) / -F.log2(share)).otherwise(1.0), 6).alias("npmi"),
    )


def skill_pairs(records: DataFrame, skills: DataFrame) -> DataFrame:
    """Scores of all skill pairs of ``skills_raw``; every ``job_id`` counts once, each skill once in it.

    Items that are no canonical name or alias are ignored, null lists and
    records delivered twice add nothing.
    """
    # The scores read the counts four times; they are as many as pairs of items.
    return pair_scores(stored(pair_weights(weighted_baskets(canonical_items(records, skills, "job_id", "skills_raw")))))


def frequent_pairs(scores: DataFrame, at_least: int = 3, share: int = 400, times: int = 2) -> DataFrame:
    """Pairs seen ``at_least`` times, in one of ``share`` baskets, and ``times`` as often as chance."""
    enough = (F.col("n_ab") >= at_least) & (F.col("n_ab") * share >= F.col("n_baskets"))
    above = F.col("n_ab") * F.col("n_baskets") >= times * F.col("n_a") * F.col("n_b")
    return scores.filter(enough & above).select("skill_id_a", "skill_id_b")
