"""Sources and sinks: page snapshots, side tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
ROBOTS = "base_url string, status int, body string"
SITEMAPS = "url string, status int, content_type string, body string"
LINK_STATUS = "url string, code int"
AUDITS = "brand_id string, audit_id string, created_at timestamp, overall_score int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pages a task. Reading one costs milliseconds, so a task takes seconds, however large the table is.
PAGES_A_TASK = 1_000


def spread(stored: DataFrame, key: str) -> DataFrame:
    """A stored table dealt out by its key, over all cores at least, in tasks of about ``PAGES_A_TASK`` rows.

    The splits of the files tell little of the work: a row group is never divided, so the longest task would be the largest row
    group. Reading a page costs far more than sending it. The rows are counted in the footers of the files.
    """
    cores = stored.sparkSession.sparkContext.defaultParallelism
    return stored.repartition(max(cores, -(-stored.count() // PAGES_A_TASK)), key)


def pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A page snapshot, without what ``fetched`` leaves out."""
    return fetched(spark.read.format(fmt).load(path))


def fetched(found: DataFrame) -> DataFrame:
    """Of pages with a status or a type, the failed and the non-HTML ones are left out; an unknown one stays."""
    if "status_code" in found.columns:
        found = found.where(F.col("status_code").isNull() | (F.col("status_code") < 400))
    if "content_type" in found.columns:
        found = found.where(F.col("content_type").isNull() | F.col("content_type").contains("text/html"))
    return found


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of HTML files as pages: the url is the file's path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.decode("content", "utf-8").alias("html"))


def json_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Raw responses, one file each: ``source, payload``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("payload"))


def separated(spark: SparkSession, path: str) -> DataFrame:
    """A semicolon-separated report with a header; everything as text."""
    return spark.read.csv(path, sep=";", header=True)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A report of several sheets: a folder of CSV files with a header for each; nested columns as JSON."""
    for name, df in sheets.items():
        flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in df.columns]
        df.select(*flat).write.mode("overwrite").csv(f"{path}/{name}", header=True)


def as_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON document."""
    return df.select(F.to_json(F.struct("*")).alias("document"))
