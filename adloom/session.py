"""Session helpers shared by tests, the benchmark and local runs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are written for."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("adloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_LOCAL: list[str] = []


def _shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="adloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where that is unset (tests on one machine) a temporary one is used.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once, as a table in the shared checkpoint folder, and read back.

    For results that several branches of a plan use and that cost more to
    compute than to read: columns are compressed, and later scans prune them.
    The table is deleted when the application ends, or by :func:`released`.
    """
    folder = os.path.join(_shared_folder(df.sparkSession), f"adloom-{uuid.uuid4().hex}")
    df.write.parquet(folder)
    fs, path = _file_system(df.sparkSession, folder)
    fs.deleteOnExit(path)
    _STORED.append(folder)
    return df.sparkSession.read.parquet(folder)


_STORED: list[str] = []


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def released(spark: SparkSession) -> int:
    """Delete the tables of :func:`stored`; for when the results that read them have been written. Their number."""
    n = len(_STORED)
    while _STORED:
        fs, path = _file_system(spark, _STORED.pop())
        fs.delete(path, True)
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table as a DataFrame."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
