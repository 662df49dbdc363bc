"""Validity history of changing entities from periodic snapshots.

Every snapshot is a unit interval; neighbouring intervals of one entity with an
equal payload are merged by tree reduction. A node of the tree covers a range
of ``2**k`` microseconds of one entity. A node merges the runs of its children,
passes on only those that may still grow to the left or the right (two at
most), and finishes all others. After a fixed number of rounds one node is left
for each entity, however hot: past the leaves no task ever holds more than
``2 * 2**STEP`` runs of an entity, and a leaf holds the distinct snapshots of
one entity within ``2**LEAF`` microseconds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adloom.functions.names import ref
from adloom.session import stored

#: Microseconds of a leaf, as a power of two (about three days).
LEAF = 38
#: Children of a node, as a power of two.
STEP = 6
#: The last round before the root; years 1 to 9999 give an entity at most 512 such nodes.
ROOT = 50


def coalesce_runs(
    snapshots: DataFrame, entity: str, at: str, payload: str, order: str | None = None
) -> DataFrame:
    """``(entity, payload, lo, hi, first, last)``: one row for each run of equal payloads.

    ``at`` is the instant in microseconds (bigint), ``order`` breaks ties at one
    instant (otherwise the payload does). ``lo`` is the run's first snapshot,
    ``hi`` the next run's first snapshot (null for the last run); ``first`` and
    ``last`` mark an entity's first and last run.

    Rows with a null entity, instant or payload are no observation. Identical
    snapshots count once. A payload that returns after another starts a new run.
    An empty input gives no rows.
    """
    runs = (
        snapshots.select(
            ref(entity).alias("entity"),
            ref(at).cast("long").alias("lo"),
            ref(payload).alias("payload"),
            (ref(order).cast("long") if order else F.lit(0).cast("long")).alias("rank"),
        )
        .dropna(subset=["entity", "lo", "payload"])
        .groupBy("entity", "lo", "payload")
        .agg(F.min("rank").alias("rank"))
        .withColumn("hi", F.lit(None).cast("long"))
    )
    finished = []
    bits = LEAF
    while True:
        root = bits > ROOT
        node = [F.col("entity")] if root else [F.col("entity"), F.shiftright("lo", bits).alias("node")]
        keys = ["entity"] if root else ["entity", "node"]
        by_time = W.partitionBy(*keys).orderBy("lo", "rank", "payload")
        # A run that already has an end does not reach its neighbour: the runs between are finished.
        before = F.when(F.lag("hi").over(by_time).isNull(), F.lag("payload").over(by_time))
        merged = (
            runs.select(*node, "lo", "rank", "payload", "hi")
            .withColumn("start", (before.isNull() | (before != F.col("payload"))).cast("int"))
            .withColumn("run", F.sum("start").over(by_time))
            .groupBy(*keys, "run")
            .agg(
                F.min(F.struct("lo", "rank")).alias("at"),
                F.first("payload").alias("payload"),
                F.max_by("hi", F.struct("lo", "rank")).alias("hi"),
            )
        )
        ordered = W.partitionBy(*keys).orderBy("run")
        merged = merged.select(
            "entity", "payload", F.col("at.lo").alias("lo"), F.col("at.rank").alias("rank"),
            F.coalesce("hi", F.lead("at.lo").over(ordered)).alias("hi"),
            (F.lag("run").over(ordered).isNull()).alias("first"),
            (F.lead("run").over(ordered).isNull()).alias("last"),
        )
        if root:
            finished.append(merged.drop("rank"))
            break
        # Two branches read the round: what is finished, and what the next one merges. It is worked out once.
        merged = stored(merged)
        # A node's first run may continue the node before, its last one the node after.
        grows = F.col("first") | F.col("last")
        inner = merged.filter(~grows).drop("rank")
        finished.append(inner.withColumns({"first": F.lit(False), "last": F.lit(False)}))
        runs = merged.filter(grows).select("entity", "lo", "rank", "payload", "hi")
        bits += STEP
    return reduce(DataFrame.unionByName, finished)


def micros(column: str):
    """Microseconds since 1970 of an ISO instant given as text; null if it is none."""
    return F.unix_micros(F.try_to_timestamp(F.trim(ref(column))))


def _text(c):
    seconds = F.floor(c / 1_000_000).cast("decimal(18,6)")
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )
    return F.substring(moment.cast("string"), 1, 19)


def validity_periods(versions: DataFrame, entities: DataFrame) -> DataFrame:
    """``(job_id, content_hash, valid_from, valid_to)`` of every advert in ``entities``.

    The letter case of hashes makes no difference; blank hashes are no
    observation; rows delivered twice count once. The first period starts at
    ``first_seen_at``, every other at its first observation; each ends where the
    next starts, the last at ``last_seen_at``. Adverts without an observation
    have no period; a null bound stays null.
    """
    observed = versions.select(
        "job_id",
        F.lower(F.trim("content_hash")).alias("content_hash"),
        micros("observed_at").alias("at"),
        "version_id",
    ).filter(F.col("content_hash") != "")
    runs = coalesce_runs(observed, "job_id", "at", "content_hash", "version_id")
    spans = entities.select(
        "job_id", micros("first_seen_at").alias("seen_from"), micros("last_seen_at").alias("seen_to")
    )
    return runs.join(spans, F.col("entity") == F.col("job_id")).select(
        "job_id",
        F.col("payload").alias("content_hash"),
        _text(F.when(F.col("first"), F.col("seen_from")).otherwise(F.col("lo"))).alias("valid_from"),
        _text(F.when(F.col("last"), F.col("seen_to")).otherwise(F.col("hi"))).alias("valid_to"),
    )
