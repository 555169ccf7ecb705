"""Brands and their audits over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deltas(audits: DataFrame, brand: str = "brand_id", at: str = "created_at", score: str = "overall_score", tie: str = "audit_id") -> DataFrame:
    """Every audit with the change against the brand's previous one; null for the first."""
    order = Window.partitionBy(brand).orderBy(F.desc(at), F.desc(tie))
    return audits.withColumn("delta", F.col(score) - F.lead(score).over(order))


def overview(audits: DataFrame, brand: str = "brand_id", at: str = "created_at", score: str = "overall_score", tie: str = "audit_id") -> DataFrame:
    """Per brand: number of audits, latest and previous score, their difference and trend.

    Two aggregations that combine before the shuffle, so a brand with very many audits is no hot group.
    """
    order = F.struct(F.col(at), F.col(tie))
    latest = audits.groupBy(brand).agg(F.count("*").alias("audits"), F.max(F.struct(order.alias("o"), F.col(score).alias("s"))).alias("last"))
    older = audits.join(latest.select(brand, F.col("last.o").alias("top")), brand).where(order < F.col("top"))
    previous = older.groupBy(brand).agg(F.max(F.struct(order.alias("o"), F.col(score).alias("s")))["s"].alias("previous_score"))
    rows = latest.join(previous, brand, "left").select(brand, "audits", F.col("last.s").alias("latest_score"), "previous_score")
    delta = F.col("latest_score") - F.col("previous_score")
    return rows.withColumn("delta", delta).withColumn("trend", F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "flat"))


def newest(rows: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """Rows newest first."""
    ordered = rows.orderBy(F.desc(by))
    return ordered if k is None else ordered.limit(k)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
