"""Structured Streaming forms of the incremental operators.

Every function takes a streaming DataFrame and returns one; :func:`drained`
runs it over all data that is there and gives the result as a batch table in
the shared folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.session import _file_system, _shared_folder


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A stream over the files of a table, with the table's own schema."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    # A bracket makes the path a pattern, so that single files and folders both work.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path[:-1] + "[t]")


def windowed_counts(events: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling windows with a watermark: ``(window_start, key, n, total)``."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(
        F.col("window.start").alias("window_start"), key, "n", "total"
    )


def once(events: DataFrame, at: str, *keys: str, late: str = "1 day") -> DataFrame:
    """The first delivery of each key within the watermark."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(list(keys)).drop("_at")


def once_ever(events: DataFrame, *keys: str) -> DataFrame:
    """The first delivery of each key, however late; the state holds every key."""
    return events.dropDuplicates(list(keys))


def not_ahead(events: DataFrame, at: str, now: str) -> DataFrame:
    """Only events that are not later than ``now``."""
    return events.filter(F.col(at) <= F.lit(now).cast("timestamp_ntz"))


def seen_bounds(events: DataFrame, key: str, at: str) -> DataFrame:
    """``(key, first_seen, last_seen, n)``, kept as running state (complete or update mode)."""
    return events.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read the result back.

    Append mode writes to a file sink; complete mode replaces the table at
    every batch, so the last batch is the result.
    """
    spark = stream.sparkSession
    root = os.path.join(_shared_folder(spark), f"adloom-stream-{uuid.uuid4().hex}")
    fs, path = _file_system(spark, root)
    fs.deleteOnExit(path)
    out, state = os.path.join(root, "out"), os.path.join(root, "state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _versions(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, str]:
    """The newest finished path of every bucket of an upserted table, of versions before ``below``."""
    fs, _ = _file_system(spark, folder)
    pattern = spark._jvm.org.apache.hadoop.fs.Path
    done = [str(s.getPath().getParent().toString()) for s in fs.globStatus(pattern(f"{folder}/v*/_SUCCESS")) or []]
    numbered = sorted((int(p.rsplit("/v", 1)[1]), p) for p in done)
    newest: dict[int, str] = {}
    for number, path in numbered:
        if below is None or number < below:
            for s in fs.globStatus(pattern(f"{path}/_bucket=*")) or []:
                own = str(s.getPath().toString())
                newest[int(own.rsplit("=", 1)[1])] = own
    return newest


def upserted_stream(stream: DataFrame, key: str, order: list[str], folder: str | None = None, buckets: int = 16) -> DataFrame:
    """The last row of each key, kept as a table in ``folder`` that every micro-batch merges into.

    The table is split into ``buckets`` by a hash of the key; a batch rewrites
    the buckets it has keys of, as the next version beside the present one and
    named by the batch. What is present is read from the folder, so a stream
    that is started again with the same folder goes on where it stopped, and a
    batch that is run again after a failure gives the same. Rows without a key
    are left out. Without a folder the table lives as long as the application.
    """
    spark = stream.sparkSession
    if folder is None:
        folder = os.path.join(_shared_folder(spark), f"adloom-upsert-{uuid.uuid4().hex}")
        fs, path = _file_system(spark, folder)
        fs.deleteOnExit(path)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.filter(F.col(key).isNotNull())
        # As many values as there are buckets at most.
        touched = [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]
        present = _versions(spark, folder, number)
        old = [present[b] for b in touched if b in present]
        if old:
            rows = rows.unionByName(spark.read.schema(stream.schema).parquet(*old))
        own = F.struct(*(F.col(c) for c in rows.columns))
        last = rows.groupBy(key).agg(F.max_by(own, F.struct(*order)).alias("_v")).select("_v.*")
        last.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/v{number}")

    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
    paths = sorted(_versions(spark, folder).values())
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)
