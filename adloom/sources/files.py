"""Readers and writers of the formats that the pipelines exchange."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV files with a header, every column text, missing values as empty text; quoted line breaks are allowed."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path).na.fill("")


def read_csv_tree(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files below a folder, malformed lines dropped, with the file each row came from in ``_input_file``."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.csv")
    return reader.csv(path).withColumn("_input_file", F.col("_metadata.file_path"))


def read_json_list(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON file that holds a list of objects, or JSON lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``(skill_id, name, category, alias)`` from nested categories of skills with aliases."""
    skills = T.ArrayType(
        T.StructType(
            [T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType()))]
        )
    )
    categories = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("skills", skills)]))
    raw = spark.read.option("multiLine", True).schema(T.StructType([T.StructField("categories", categories)])).json(path)
    each = raw.select(F.explode("categories").alias("c")).select(F.col("c.name").alias("category"), F.explode("c.skills").alias("s"))
    return each.select(
        F.col("s.id").alias("skill_id"), F.col("s.name").alias("name"), "category",
        F.explode(F.array_distinct(F.concat(F.array(F.lower("s.name")), F.transform(F.coalesce("s.aliases", F.array()), F.lower)))).alias("alias"),
    )


def key_of(name: str) -> str:
    """A column name without case and signs, for matching headers."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def resolved(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """The wanted columns, each from the first of its aliases that the frame has; null text where it has none."""
    have = {}
    for c in df.columns:
        have.setdefault(key_of(c), c)
    chosen = []
    for name, aliases in wanted.items():
        hit = next((have[key_of(a)] for a in [name, *aliases] if key_of(a) in have), None)
        chosen.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(name))
    return df.select(*chosen)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that are missing added with their default; present ones stay."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet, partitioned where asked; ``append`` adds a batch."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, for histories."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; arrays and structs as JSON text."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in df.columns]
    df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """One uploaded table, all text: CSV in UTF-8 (a mark at its start is dropped), else in Latin-1; XLSX where pandas can read it.

    An upload is one file of a person; its bytes are looked at on the driver only to tell the encoding.
    """
    if path.lower().endswith((".xlsx", ".xls")):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, dtype=str).fillna("")).na.fill("")
    content = spark.read.format("binaryFile").load(path).select("content").first().content
    try:
        content.decode("utf-8")
        encoding = "UTF-8"
    except UnicodeDecodeError:
        encoding = "ISO-8859-1"
    df = read_text_csv(spark, path, encoding=encoding)
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))


#: Columns of raw records, with other names that exports use for them.
RAW = {
    "source_job_id": ["Source Job ID", "Job Ref", "External ID"],
    "source_url": ["URL", "Link", "Job URL", "Posting URL"],
    "job_title_raw": ["Job Title", "Title", "Position"],
    "company_raw": ["Company", "Company Name", "Employer"],
    "location_raw": ["Location", "City"],
    "country_raw": ["Country"],
    "job_description_raw": ["Description", "Job Description"],
    "requirements_raw": ["Requirements", "Qualifications"],
    "posted_date_raw": ["Posted Date", "Posting Date", "Date Posted"],
    "closing_date_raw": ["Closing Date", "Deadline"],
    "skills_raw": ["Skills"],
}


def to_raw_schema(df: DataFrame) -> DataFrame:
    """A table of any export as raw records: columns by their aliases, placeholders null, host and stable id from URL and source id."""
    from adloom.functions.text import hostname, null_if_placeholder, stable_id

    own = resolved(df, RAW)
    own = own.select(*(null_if_placeholder(F.col(c).cast("string")).alias(c) for c in own.columns))
    host = hostname(F.col("source_url"))
    return own.select(stable_id(host, F.col("source_job_id"), F.col("source_url")).alias("job_id"), host.alias("source_hostname"), *own.columns)


#: Values that the status of a reference can have.
REVIEWED = ("verified", "unavailable", "ambiguous", "not_reviewed")


def read_benchmark(df: DataFrame) -> DataFrame:
    """A table of references with its amounts as numbers, and ``problem``: the first column that is not as it should be.

    Ids must be there and once in the table's row, statuses one of :data:`REVIEWED`, amounts numbers.
    """
    from adloom.operators.typed import filled, number_of

    status = [c for c in df.columns if c.startswith("status_")]
    amounts = [c for c in df.columns if c.startswith("expected_salary_m")]
    checks = [F.when(filled(F.col("benchmark_id")).isNull(), "benchmark_id")]
    checks += [F.when(~F.coalesce(F.lower(F.trim(c)).isin(*REVIEWED), F.lit(False)), c) for c in status]
    checks += [F.when(filled(F.col(c)).isNotNull() & number_of(F.col(c)).isNull(), c) for c in amounts]
    return df.select(*(number_of(F.col(c)).alias(c) if c in amounts else F.col(c) for c in df.columns), F.coalesce(*checks).alias("problem"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``(host, status)`` of a registry of sources in JSON; every alias of a host has its status."""
    source = T.StructType([T.StructField("host", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("status", T.StringType())])
    raw = read_json_list(spark, path, T.StructType([T.StructField("sources", T.ArrayType(source))]))
    each = raw.select(F.explode("sources").alias("s"))
    hosts = F.explode(F.array_distinct(F.concat(F.array(F.lower("s.host")), F.transform(F.coalesce("s.aliases", F.array()), F.lower))))
    return each.select(hosts.alias("host"), F.col("s.status").alias("status"))


def read_keywords(text: str) -> dict[str, list[tuple[str, str]]]:
    """Sections of ``word | label`` lines below ``##`` headings; a word is its own label, ``#`` lines are notes."""
    sections: dict[str, list[tuple[str, str]]] = {}
    current: list[tuple[str, str]] | None = None
    for line in map(str.strip, text.splitlines()):
        if line.startswith("##"):
            current = sections.setdefault(line.lstrip("#").strip(), [])
        elif line and not line.startswith("#") and current is not None:
            word, _, label = (p.strip() for p in line.partition("|"))
            current.append((word, label or word))
    return sections


def found_runs(paths: DataFrame, name: str = "evaluation") -> DataFrame:
    """``(run, at, path)`` of result files named ``name_YYYYMMDD_HHMMSS``, latest first; other files are left out."""
    run = F.regexp_extract("path", rf"{name}_(\d{{8}}_\d{{6}})[^/]*$", 1)
    return (
        paths.select(run.alias("run"), "path")
        .filter(F.col("run") != "")
        .select("run", F.try_to_timestamp("run", F.lit("yyyyMMdd_HHmmss")).alias("at"), "path")
        .orderBy(F.desc("at"), "path")
    )


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    """A small result as a Markdown table; the pipe character is escaped, nothing is empty."""

    def cell(v: object) -> str:
        return "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")

    lines = [columns, ["---"] * len(columns), *rows]
    return "\n".join("| " + " | ".join(cell(v) for v in line) + " |" for line in lines)


def write_export(df: DataFrame, folder: str, name: str) -> dict[str, object]:
    """``df`` as CSV below ``folder``, with a record of rows and a hash of all rows for reproducing it."""
    from adloom.operators.store import fingerprint

    write_csv(df, f"{folder}/{name}")
    r = fingerprint(df).first()
    return {"name": name, "rows": r.rows, "sha256": r.digest}


def write_report(results: dict[str, DataFrame], folder: str, top: int = 20) -> str:
    """Every result as CSV below ``folder``, and a Markdown report of their first ``top`` rows; the report's text."""
    parts = []
    for name, df in results.items():
        record = write_export(df, folder, name)
        head = [tuple(r) for r in df.limit(top).collect()]
        parts.append(f"## {name}\n\n{record['rows']} rows, sha256 {record['sha256']}\n\n{markdown_table(df.columns, head)}")
    text = "\n\n".join(parts) + "\n"
    spark = next(iter(results.values())).sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report")
    return text
