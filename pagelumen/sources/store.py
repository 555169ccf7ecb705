"""A store of keyed rows (brands, audits) as a folder of Parquet, written batch by batch.

A batch is one partition of the folder, named by the caller (a date, a run's number), and later batches are newer. Writing a batch
replaces that partition as a whole and nothing else: a run that fails leaves no half of one, and a run that is
repeated leaves what one run would have. Reading takes the newest row of every key. ``compact`` merges batches into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch"


def _newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key, the last in the order. Combines before the shuffle; a null key is a key."""
    others = [c for c in rows.columns if c != key]
    whole = F.struct(*(F.col(f"`{c}`") for c in others))
    best = rows.groupBy(key).agg(F.max(F.struct(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)), whole.alias("row"))).alias("m"))
    return best.select(key, *(F.col(f"m.row.{c}").alias(c) for c in others))


def upsert(rows: DataFrame, path: str, key: str, batch: str) -> None:
    """Writes the rows as a batch. Of rows with one key in it the greatest counts, column by column.

    Columns must be ones that can be put in order; the store and the rows may have different columns.
    """
    if BATCH in rows.columns:
        raise ValueError(f"a column named {BATCH} is the store's own")
    once = _newest(rows, key, [c for c in rows.columns if c != key])
    # With a letter before it, a name of digits stays text when Spark reads folder names as values.
    once.withColumn(BATCH, F.lit(f"b{batch}")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their batch, as text: the order of batches is that of their names."""
    found = spark.read.option("mergeSchema", "true").parquet(path)
    return found.withColumn(BATCH, F.substring(F.col(BATCH).cast("string"), 2, 1 << 20))


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of every key, without its batch."""
    return _newest(batches(spark, path), key, [BATCH]).drop(BATCH)


def compact(spark: SparkSession, path: str, to: str, key: str) -> None:
    """Writes the newest row of every key to a new store, each under the batch it came from."""
    newest = _newest(batches(spark, path), key, [BATCH])
    newest.withColumn(BATCH, F.concat(F.lit("b"), BATCH)).write.mode("overwrite").partitionBy(BATCH).parquet(to)
