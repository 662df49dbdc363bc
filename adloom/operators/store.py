"""Idempotent imports: classify incoming rows, keep versions, registries, insert-or-ignore."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.functions.names import fresh


def classify_import(existing: DataFrame, incoming: DataFrame, key: str, payload: str) -> DataFrame:
    """``incoming`` with ``action``: ``insert``, ``update`` or ``skip``, by key and payload hash in any case.

    Rows without a key are ``reject``. Both sides must hold a key once.
    """
    old = existing.select(F.col(key).alias("_k"), F.lower(payload).alias("_h"), F.lit(True).alias("_there"))
    joined = incoming.join(old, F.col(key) == F.col("_k"), "left")
    action = (
        F.when(F.col(key).isNull(), "reject")
        .when(F.col("_there").isNull(), "insert")
        .when(F.lower(payload).eqNullSafe(F.col("_h")), "skip")
        .otherwise("update")
    )
    return joined.withColumn(fresh(incoming, "action"), action).drop("_k", "_h", "_there")


def upserted(existing: DataFrame, incoming: DataFrame, key: str, payload: str, seen: str) -> DataFrame:
    """The table after the import: changed and new rows taken, ``seen`` of unchanged rows moved forward.

    Columns are those of ``existing``; applying the same import again changes nothing.
    """
    names = existing.columns
    new = incoming.filter(F.col(key).isNotNull())
    both = existing.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    same = F.lower(F.col(f"o.{payload}")).eqNullSafe(F.lower(F.col(f"n.{payload}")))
    take = F.col(f"n.{key}").isNotNull() & (F.col(f"o.{key}").isNull() | ~same)
    columns = []
    for c in names:
        if c == seen:
            columns.append(F.greatest(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            columns.append(F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*columns)


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """The incoming rows whose key is new, one for each key."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def latest_versions(versions: DataFrame) -> DataFrame:
    """``(job_id, content_hash, import_run_id, versions, last_observed)``: the last snapshot of each advert, how many there are, and its microsecond."""
    at = F.unix_micros(F.try_to_timestamp("observed_at"))
    good = versions.filter(F.trim("content_hash") != "").select(
        "job_id", "version_id", F.lower(F.trim("content_hash")).alias("content_hash"), "import_run_id", at.alias("_at")
    ).distinct()
    return good.groupBy("job_id").agg(
        F.max_by("content_hash", F.struct("_at", "version_id")).alias("content_hash"),
        F.max_by("import_run_id", F.struct("_at", "version_id")).alias("import_run_id"),
        F.count("*").alias("versions"),
        F.max("_at").alias("last_observed"),
    )


def run_rollup(runs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per extraction run: mentions, jobs, mentions without an id, whether it ended."""
    counts = mentions.groupBy("run_id").agg(
        F.count("*").alias("mentions"),
        F.countDistinct("job_id").alias("jobs"),
        F.count_if(F.col("canonical_skill_id").isNull()).alias("without_id"),
        F.round(F.avg("confidence"), 4).alias("confidence"),
    )
    return runs.select("run_id", "run_type", F.col("completed_at").isNotNull().alias("completed")).join(counts, "run_id", "left").na.fill(
        0, ["mentions", "jobs", "without_id"]
    )


def version_rows(existing: DataFrame, incoming: DataFrame, history: DataFrame, key: str, payload: str) -> DataFrame:
    """The rows that an import adds to the history: ``(key, payload, version_no)`` of new and changed entities.

    ``history`` has ``(key, version_no)``; numbers go on from the largest one.
    """
    done = classify_import(existing, incoming, key, payload).filter(F.col("action").isin("insert", "update"))
    last = history.groupBy(key).agg(F.max("version_no").alias("_last"))
    return done.join(last, key, "left").select(key, F.lower(payload).alias(payload), (F.coalesce("_last", F.lit(0)) + 1).cast("long").alias("version_no"))


def merged(existing: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Insert or replace by ``keys``: the incoming row where there is one; ``existing`` gives the columns and must hold a key once.

    Of several incoming rows of a key the largest by all columns is taken.
    """
    own = F.struct(*(F.col(c) for c in existing.columns))
    new = incoming.groupBy(*keys).agg(F.max(own).alias("_n"))
    old = existing.select(*keys, own.alias("_o"))
    return old.join(new, list(keys), "full").select(F.coalesce("_n", "_o").alias("_v")).select("_v.*")


def latest_flags(runs: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``runs`` with ``is_latest``: true for the last run of its group; ties by all columns of ``order``."""
    last = runs.groupBy(group).agg(F.max(F.struct(*order)).alias("_last"))
    return runs.join(last, group, "left").withColumn(
        fresh(runs, "is_latest"), F.coalesce(F.struct(*order) == F.col("_last"), F.lit(False))
    ).drop("_last")


def split_failures(rows: DataFrame, status: str, good: tuple[str, ...] = ("success", "partial")) -> tuple[DataFrame, DataFrame]:
    """The batch to append, and the failure log of the rows whose status is not good (null counts as failed)."""
    ok = F.coalesce(F.col(status).isin(*good), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def manifest(rows: DataFrame, batch: str, status: str) -> DataFrame:
    """A row for each batch: rows, good and failed ones, first and last instant."""
    at = F.try_to_timestamp("scraped_at")
    return rows.groupBy(batch).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(status) == "success").alias("succeeded"),
        F.count_if(F.coalesce(F.col(status) == "failed", F.lit(True))).alias("failed"),
        F.min(at).alias("began"),
        F.max(at).alias("ended"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """One row ``(rows, digest)``: a hash of all rows that does not depend on their order, for reproducibility records."""
    each = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns)))), 256)
    # Sums of the first 15 hexadecimal digits, in two halves so that they cannot overflow.
    parts = [F.conv(F.substring(each, k, 7), 16, 10).cast("decimal(38,0)") for k in (1, 8)]
    return df.agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(p), F.lit(0)).alias(f"_{k}") for k, p in enumerate(parts))).select(
        "rows", F.sha2(F.concat_ws("|", "rows", "_0", "_1"), 256).alias("digest")
    )
