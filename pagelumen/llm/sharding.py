"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked there; the fractional rank (rank plus a
half, over the size of the source) spreads every source evenly over 0 to 1. All rows are sorted by it and
the order is cut into runs, so that each shard has the mixture of the whole table. Law ``rows``: counts
are at most one apart. This law knows no groups: equal texts are dealt like other rows, and can lie in
several shards.

Both ranks come from range-partitioned sorts: a row's number within its partition plus the rows before
that partition. So no window holds a whole source, however large it is. Only ids and numbers are sorted,
never texts.

Cases: a null source is a source of its own; null text has size 1 and crc 0; rows that are alike in all
sort keys are interchangeable, each gets its own slot; fewer rows than shards leave the last ones empty;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelumen.llm.common import checkpointed

_IN_PARTITION = (1 << 33) - 1


def _numbered(df: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """``_n``: each row's number from 0 in the order, counted anew for every value of the columns ``within``.

    ``within`` must be the leading columns of the order.
    """
    partitions = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND(F.lit(_IN_PARTITION)))
    # Read twice below: written once, so that both readings see the same partitions even if executors are lost.
    placed = checkpointed(placed)
    blocks = placed.groupBy(*within, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))  # partitions plus sources
    if within:
        before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    else:
        before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).drop("_rows", "_first")
    return placed.join(blocks, [*within, "_part"]).withColumn("_n", F.col("_at") + F.col("_before")).drop("_at", "_part", "_before")


def interleave(docs: DataFrame, shards: int = 8, seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, source``, one row per input row."""
    data = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "utf-8")
    rows = docs.select(
        F.concat(F.lit("="), F.col(source).cast("string")).alias("s"),
        F.col(key).alias("doc_id"),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    rows = rows.withColumn("s", F.coalesce("s", F.lit("")))  # the null source
    rows = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))))
    # Rows that are alike in all else are told apart by their place in the input: else all would sort into one task.
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    rows = _numbered(rows, ["s", "h", "doc_id", "text_crc32", "size", "place"], ["s"]).drop("place")
    totals = rows.groupBy("s").agg(F.count("*").alias("of"))  # a row per source
    rows = rows.join(totals, "s").withColumn("f", (F.col("_n") + F.lit(0.5)) / F.col("of")).drop("of")
    ranked = _numbered(rows.withColumnRenamed("_n", "rank"), ["f", "s", "rank"], [])
    n = ranked.count()
    at = F.col("_n")
    # Shard k holds the numbers from ceil(k * n / shards): integer arithmetic throughout.
    shard = F.expr(f"(_n * {shards}) div {max(n, 1)}")
    ranked = ranked.withColumn("shard", shard.cast("int"))
    start = F.expr(f"(shard * cast({n} as bigint) + {shards - 1}) div {shards}")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (at - start).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.when(F.col("s") != "", F.expr("substring(s, 2)")).alias("source"),
    )
