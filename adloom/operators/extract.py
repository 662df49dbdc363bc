"""Extraction from texts and pages: skills by their aliases, nearest centroids, links, URL safety, structured data."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.names import ref
from adloom.functions.text import null_if_placeholder
from adloom.operators.facts import alias_names

#: Largest list that becomes a literal pattern or matrix.
LIMIT = 20_000


def _checked(df: DataFrame) -> list:
    rows = df.limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"more than {LIMIT} rows in a dimension; give a smaller one")
    return rows


def lexical_skills(texts: DataFrame, skills: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct ``(key, skill_id)``: skills of which an alias stands in the text as whole words, in any case.

    One pass with one pattern, longest alias first; an alias found also counts
    for the aliases inside it. The alias list is a dimension of checked size, so
    texts are scanned where they are and nothing is paired with them.
    """
    names = {r.name: r.skill_id for r in _checked(alias_names(skills))}
    if not names:
        return texts.select(ref(key).alias(key), F.lit(0).cast("long").alias("skill_id")).limit(0)
    ordered = sorted(names, key=lambda a: (-len(a), a))
    inside = {
        a: sorted({names[b] for b in ordered if re.search(rf"(?<!\w){re.escape(b)}(?!\w)", a)}) for a in ordered
    }
    quoted = "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", a) for a in ordered)
    found = F.regexp_extract_all(F.lower(ref(text)), F.lit(rf"(?U)(?<!\w)({quoted})(?!\w)"), F.lit(1))
    ids = F.create_map(*(x for a in ordered for x in (F.lit(a), F.array(*(F.lit(i).cast("long") for i in inside[a])))))
    each = texts.select(ref(key).alias(key), F.explode(F.array_distinct(found)).alias("_a"))
    return each.select(key, F.explode(F.element_at(ids, F.col("_a"))).alias("skill_id")).distinct()


def normalised_skills(items: DataFrame, skills: DataFrame, item: str) -> DataFrame:
    """``items`` with ``canonical`` and ``rule``: placeholder, alias, alias without signs, or the item in title case."""
    names = alias_names(skills)
    dim = skills.select(F.col("skill_id").cast("long").alias("skill_id"), F.col("canonical_name").alias("_name"))
    exact = names.join(dim, "skill_id").select(F.col("name").alias("_exact"), F.col("_name").alias("_by_alias"))
    bare = (
        names.join(dim, "skill_id")
        .select(F.regexp_replace("name", r"[^a-z0-9]", "").alias("_bare"), "_name")
        .groupBy("_bare")
        .agg(F.min("_name").alias("_by_bare"))
    )
    said = null_if_placeholder(ref(item))
    got = (
        items.withColumn("_said", said)
        .join(exact, F.lower("_said") == F.col("_exact"), "left")
        .join(bare, F.regexp_replace(F.lower("_said"), r"[^a-z0-9]", "") == F.col("_bare"), "left")
    )
    return got.withColumns(
        {
            "canonical": F.coalesce("_by_alias", "_by_bare", F.initcap(F.replace("_said", F.lit("_"), F.lit(" ")))),
            "rule": F.when(F.col("_said").isNull(), "placeholder")
            .when(F.col("_by_alias").isNotNull(), "alias")
            .when(F.col("_by_bare").isNotNull(), "alias_without_signs")
            .otherwise("title_case"),
        }
    ).drop("_said", "_exact", "_by_alias", "_bare", "_by_bare")


def centroids(vectors: DataFrame, label: str, embedding: str) -> DataFrame:
    """``(label, centroid)``: the mean vector of each label."""
    return (
        vectors.select(ref(label).alias("label"), F.posexplode(ref(embedding)))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("col").cast("double")).alias("_v"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_v"))), lambda x: x["_v"]).alias("centroid"))
    )


def nearest_centroids(vectors: DataFrame, means: DataFrame, key: str, embedding: str, least: float = 0.0) -> DataFrame:
    """``(key, label, cosine)``: every label whose centroid's cosine to the vector reaches ``least``.

    The centroids are a dimension of checked size; vectors are compared in
    batches by matrix products. Null and zero vectors have none.
    """
    rows = sorted(_checked(means), key=lambda r: r.label)
    labels = np.array([r.label for r in rows])
    matrix = np.array([r.centroid for r in rows], dtype=float).reshape(len(rows), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    kind = pa.list_(pa.struct([("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[list[dict] | None] = []
            for v in batch.to_pylist():
                x = np.array(v if v else [], dtype=float)
                size = np.linalg.norm(x) if x.size == unit.shape[1] else 0.0
                if not size or not len(labels):
                    out.append(None)
                    continue
                scores = unit @ (x / size)
                out.append([{"label": int(labels[k]), "cosine": float(scores[k])} for k in np.flatnonzero(scores >= least)])
            yield pa.array(out, kind)

    near = F.arrow_udf(run, "array<struct<label: int, cosine: double>>")(ref(embedding))
    scored = vectors.select(ref(key).alias(key), F.explode(near).alias("_n"))
    return scored.select(key, "_n.label", F.round("_n.cosine", 4).alias("cosine"))


def links(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Distinct ``(key, href)`` of the anchors of each page."""
    hrefs = F.regexp_extract_all(ref(page), F.lit(r"""<a\b[^>]*\bhref\s*=\s*["']([^"'#]+)"""), F.lit(1))
    return pages.select(ref(key).alias(key), F.explode(F.array_distinct(hrefs)).alias("href"))


def link_score(href: Column) -> Column:
    """How likely a link leads to an advert: words of the path, numeric ids, query ids and depth."""
    h = F.lower(href)
    return (
        F.when(h.rlike(r"/(?:job|jobs|vacanc|career|position|stellen|kerja)"), 10).otherwise(0)
        + F.when(h.rlike(r"/[a-z\-]*\d{3,}"), 8).otherwise(0)
        + F.when(h.rlike(r"[?&](?:id|job|jobid|ref)="), 8).otherwise(0)
        + F.when(F.size(F.split(F.regexp_replace(h, r"^[a-z]+://[^/]*", ""), "/")) > 3, 2).otherwise(0)
    )


def url_verdict(url: Column, blocked: list[str]) -> Column:
    """``ok`` or why a URL must not be fetched: scheme, credentials, port, blocked host or a parent of it, private address."""
    u = F.lower(F.trim(url))
    authority = F.regexp_extract(u, r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d+$", "")
    port = F.nullif(F.regexp_extract(authority, r":(\d+)$", 1), F.lit(""))
    under = F.lit(False)
    for b in blocked:
        under = under | (host == b) | host.endswith("." + b)
    private = host.rlike(
        r"^(?:localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|0\.|\[?::1)"
    )
    return (
        F.when(u.isNull() | ~u.rlike(r"^https?://"), "scheme")
        .when(host == "", "host")
        .when(authority.contains("@"), "credentials")
        .when(port.isNotNull() & ~port.isin("80", "443"), "port")
        .when(under, "blocked")
        .when(private, "private")
        .otherwise("ok")
    )


def job_posting(page: Column) -> Column:
    """Struct of the fields of the first JSON-LD job posting in a page; null fields where there is none."""
    block = F.regexp_extract(
        page, r"""(?is)<script[^>]*application/ld\+json[^>]*>\s*(\{(?:(?!</script>).)*"@type"\s*:\s*"JobPosting"(?:(?!</script>).)*\})\s*</script>""", 1
    )
    json = F.nullif(block, F.lit(""))
    paths = {
        "title": "$.title",
        "company": "$.hiringOrganization.name",
        "place": "$.jobLocation.address.addressLocality",
        "country": "$.jobLocation.address.addressCountry",
        "posted": "$.datePosted",
        "closes": "$.validThrough",
        "currency": "$.baseSalary.currency",
        "low": "$.baseSalary.value.minValue",
        "high": "$.baseSalary.value.maxValue",
    }
    return F.struct(*(F.get_json_object(json, p).alias(n) for n, p in paths.items()))


def requirement_lines(text: Column) -> Column:
    """The lines below a heading of requirements or tasks, up to the next heading."""
    part = F.regexp_extract(
        text, r"(?is)(?:^|\n)\s*(?:requirements|qualifications|what you need|what you will do|anforderungen|ihre aufgaben|kelayakan|tugas anda)\s*:?\s*\n(.*?)(?=\n\s*(?:benefits|das bieten wir|faedah|how to apply|bewerbung|cara memohon)\s*\n|\n[^\n]{1,40}:\s*\n|\z)", 1
    )
    lines = F.transform(F.split(part, r"\n+"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[\-–•*]\s*", "")))
    return F.filter(lines, lambda x: x != "")


def extraction_run(texts: DataFrame, skills: DataFrame, extractors: dict, existing: DataFrame, run: str) -> DataFrame:
    """New mentions ``(job_id, run_id, method, skill_id)`` of one run over ``(job_id, text)``.

    ``extractors`` maps a method to any ``(texts, skills) -> (job_id, skill_id)``.
    Mentions that ``existing`` (``job_id, run_id, method, skill_id``) has are left
    out, so a run that is repeated adds nothing.
    """
    from functools import reduce

    found = [
        read(texts, skills).select("job_id", F.lit(run).alias("run_id"), F.lit(method).alias("method"), F.col("skill_id").cast("long").alias("skill_id"))
        for method, read in extractors.items()
    ]
    every = reduce(DataFrame.unionByName, found).distinct()
    return every.join(existing.select("job_id", "run_id", "method", "skill_id"), ["job_id", "run_id", "method", "skill_id"], "left_anti")
