"""Audits of a stream of page snapshots (an extension: the batch rules, applied as pages arrive)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelumen.functions.urls import export_normal, netloc
from pagelumen.operators import audit
from pagelumen.sources.tables import PAGES


def read_pages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of pages, with the time of arrival."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("seen_at", F.current_timestamp())


def once_per_url(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """A url counts once within the time; the state of older ones is dropped."""
    return stream.withColumn("norm_url", export_normal(F.col("url"))).withWatermark("seen_at", within).dropDuplicatesWithinWatermark(["norm_url"])


def scored(stream: DataFrame) -> DataFrame:
    """Overall scores: a stateless transformation of each page."""
    wide = audit.parsed(stream)
    scores = wide.select("page_id", "url", "seen_at", *(audit._score(wide, n).alias(n) for n in audit.ORDER))
    return scores.select("page_id", "url", "seen_at", audit.overall(scores).alias("overall_score"))


def by_host(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean score per host and window of arrival; pages later than ``late`` don't count."""
    host = F.lower(netloc(F.col("url"))).alias("host")
    return scored(stream).withWatermark("seen_at", late).groupBy(F.window("seen_at", window), host).agg(F.count("*").alias("pages"), F.avg("overall_score").alias("mean_score"))


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs over what is there, writes Parquet, and stops."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
