"""The facts that the analyses start from: mentions, baskets, markets, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.names import ref

UNCLASSIFIED = "unclassified"


def alias_names(skills: DataFrame) -> DataFrame:
    """``(name, skill_id)``: every canonical name and alias in lower case; the smallest id wins a clash."""
    names = F.concat(F.array("canonical_name"), F.coalesce(F.from_json("aliases_json", "array<string>"), F.array()))
    return (
        skills.select(F.col("skill_id").cast("long").alias("skill_id"), F.explode(names).alias("_n"))
        .select("skill_id", F.lower(F.trim("_n")).alias("name"))
        .filter(F.col("name") != "")
        .groupBy("name")
        .agg(F.min("skill_id").alias("skill_id"))
    )


def skill_mentions(mentions: DataFrame, skills: DataFrame) -> DataFrame:
    """Distinct ``(job_id, method, skill)``; a mention without an id is looked up by its name.

    Mentions that name no skill of the dimension are left out.
    """
    by_name = alias_names(skills)
    slim = mentions.select(
        "job_id", "method", F.col("canonical_skill_id").cast("long").alias("_id"), F.lower(F.trim("skill_name")).alias("name")
    )
    named = slim.join(by_name, F.col("_id").isNull() & (slim["name"] == by_name["name"]), "left").select(
        "job_id", "method", F.coalesce("_id", by_name["skill_id"]).alias("skill_id")
    )
    dim = skills.select(F.col("skill_id").cast("long").alias("skill_id"), F.col("canonical_name").alias("skill"))
    return named.join(dim, "skill_id").select("job_id", "method", "skill").distinct()


def baskets(pairs: DataFrame, key: str = "job_id", item: str = "skill") -> DataFrame:
    """``(basket, weight)``: each distinct sorted item array with the number of keys that hold it."""
    return (
        pairs.groupBy(key)
        .agg(F.array_sort(F.collect_set(ref(item))).alias("basket"))
        .groupBy("basket")
        .agg(F.count("*").alias("weight"))
    )


def markets(jobs: DataFrame, countries: DataFrame, column: str = "country") -> DataFrame:
    """``jobs`` with ``market``: the country by name or code in any case, else null."""
    names = countries.select(
        F.explode(F.array(F.lower(F.trim("country")), F.lower(F.trim("code")))).alias("_said"),
        F.col("country").alias("market"),
    ).dropDuplicates(["_said"])
    return jobs.join(names, F.lower(F.trim(ref(column))) == F.col("_said"), "left").drop("_said")


#: Largest title list that is turned into a literal.
TITLE_LIMIT = 20_000


def role_aliases(titles: DataFrame) -> Column:
    """All titles and aliases of the title list (a dimension of checked size) as one literal, longest first."""
    rows = (
        titles.select(
            F.col("family").alias("role"), F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array()))).alias("_a")
        )
        .select(F.lower("_a").alias("alias"), "role")
        .distinct()
        .limit(TITLE_LIMIT + 1)
        .collect()
    )
    if len(rows) > TITLE_LIMIT:
        raise ValueError(f"more than {TITLE_LIMIT} titles; give a smaller list")
    ordered = sorted(((r.alias, r.role) for r in rows), key=lambda x: (-len(x[0]), *x))
    if not ordered:
        return F.array().cast("array<struct<alias: string, role: string>>")
    return F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(r).alias("role")) for a, r in ordered))


def role_of(title: Column, text: Column, aliases: Column) -> Column:
    """The role whose longest alias stands in the title, else in the text, else ``unclassified``."""

    def first(c: Column) -> Column:
        # The text in lower case is made once, as the only element of an array, and not for every alias.
        told = F.transform(F.array(F.lower(c)), lambda t: F.get(F.filter(aliases, lambda a: t.contains(a["alias"])), F.lit(0))["role"])
        return F.get(told, F.lit(0))

    return F.coalesce(first(title), first(text), F.lit(UNCLASSIFIED))
