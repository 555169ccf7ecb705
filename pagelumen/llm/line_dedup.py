"""Line dedup over the corpus: a line stays only in the first document that holds it.

Every line gets a 128-bit hash of its key (the line stripped of white space, A-Z lower-cased). The hashes
are range-partitioned and sorted by hash, document and position; a stream over the sorted rows knows the
first document of each hash and gives the lines of all others up. What comes out is a keep bitmap for
each document, run-length coded, never text: ``keep`` lists the kept runs as (first, n). Texts meet
their bitmap only where they are read (``bitmaps`` counts lines, ``deduplicated`` rewrites texts).

A range of hashes can't split one hash. Lines so common that a range could not hold them are therefore
found first by a sketch of heavy hitters (at most ``HEAVY`` hashes, whatever the input), and their first
documents by an aggregation that combines before the shuffle; such a line is judged where it lies.
Whether a hash is taken for heavy changes the way, not the result. All of it is DataFrame expressions.

Cases: null or empty text is one empty line; keys under ``LEAST`` code points stay, always; rows with one
``doc_id`` are one document, and rows alike in text as well get the same bitmap; a null ``doc_id`` counts
as the last document; a document that loses all its lines has an empty text and an empty bitmap; an
empty table gives an empty result; other columns play no part, and pass through ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelumen.llm.common import free_name, scratch, stored

#: Code points that a key needs.
LEAST = 10
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Heavy hitters kept, and counters of their sketch: every hash of over one in ``HEAVY`` rows is among them.
HEAVY, COUNTERS = 1000, 10_000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _text(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def _hashed_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, t, pos, h, g``: a row for each line that can repeat; t tells texts of one doc_id apart."""
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(_text(text)).alias("t"), F.posexplode(F.split(_text(text), "\n")).alias("pos", "line"))
    rows = rows.where(F.char_length("line") >= LEAST).select("doc", "t", "pos", line_key(F.col("line")).alias("k"))
    return rows.where(F.char_length("k") >= LEAST).select("doc", "t", "pos", F.xxhash64("k").alias("h"), F.xxhash64(F.lit(1), "k").alias("g"))


def _heavy(lines: DataFrame) -> DataFrame:
    """``h`` of the most frequent hashes: at most ``HEAVY`` rows, so they may be broadcast."""
    found = lines.agg(F.expr(f"approx_top_k(h, {HEAVY}, {COUNTERS})").alias("top")).first()["top"] or []
    return lines.sparkSession.createDataFrame([(x["item"],) for x in found], "h long")


def _first_elsewhere(lines: DataFrame) -> DataFrame:
    """The lines whose key an earlier document holds: what is dropped."""
    heavy = _heavy(lines)
    common = lines.join(F.broadcast(heavy), "h")
    first = common.groupBy("h", "g").agg(F.min("doc").alias("first"))
    common = common.join(F.broadcast(first), ["h", "g"])
    rest = lines.join(F.broadcast(heavy), "h", "left_anti")
    partitions = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rest.repartitionByRange(partitions, "h", "g")
    # The window needs the rows of a hash in one partition, which ranges of hashes provide, and in order.
    stream = Window.partitionBy("h", "g").orderBy(F.asc_nulls_last("doc"), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = ranged.withColumn("first", F.first("doc").over(stream))
    columns = ["doc", "t", "pos", "first"]
    return common.select(*columns).unionByName(rest.select(*columns)).where(~F.col("doc").eqNullSafe(F.col("first")))


def _dropped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, t, gone``: per text that loses lines, their numbers in order. Written in the shared folder."""
    with scratch() as keep:
        lines = keep(_hashed_lines(docs, key, text))
        gone = _first_elsewhere(lines).groupBy("doc", "t").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
        return stored(gone.select("doc", "t", _runs(F.col("gone")).alias("gone")))


def _runs(at: Column) -> Column:
    """Sorted numbers as runs: array<struct<first, n>>."""
    starts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n")))


def _kept(gone: Column, n_lines: Column) -> Column:
    """The runs between the dropped ones."""
    whole = F.struct(n_lines.alias("first"), F.lit(0).alias("n"))
    stops = F.concat(gone, F.array(whole))
    begins = F.concat(F.array(F.lit(0)), F.transform(gone, lambda r: r["first"] + r["n"]))
    return F.filter(F.zip_with(begins, stops, lambda b, s: F.struct(b.alias("first"), (s["first"] - b).alias("n"))), lambda r: r["n"] > 0)


def _with_bitmaps(rows: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Adds ``keep`` to rows that have ``doc``, ``t`` and ``n_lines``."""
    gone = _dropped(docs, key, text).select(F.col("doc").alias("_doc"), F.col("t").alias("_t"), "gone")
    met = rows.join(gone, rows["doc"].eqNullSafe(gone["_doc"]) & (rows["t"] == gone["_t"]), "left")
    none = F.array().cast("array<struct<first:int,n:int>>")
    return met.withColumn("keep", _kept(F.coalesce("gone", none), F.col("n_lines"))).drop("_doc", "_t", "gone")


def bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, keep``, one row per input row; keep: runs of kept lines as (first, n)."""
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(_text(text)).alias("t"), F.size(F.split(_text(text), "\n")).alias("n_lines"))
    found = _with_bitmaps(rows, docs, key, text)
    kept = F.aggregate("keep", F.lit(0), lambda n, r: n + r["n"])
    return found.select(F.col("doc").alias(key), F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - kept).cast("long").alias("n_dropped"), "keep")


def kept_text(text: Column, keep: Column) -> Column:
    """The kept lines of a text, joined again."""
    lines = F.split(text, "\n")
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["first"] + 1, r["n"]))), "\n")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows with their text rewritten, and ``n_lines, n_dropped`` (which replace columns of these names).

    ``keep`` names the input columns to carry beside the text (default: all).
    """
    made = ["n_lines", "n_dropped"]
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*made, text.lower())]
    row = free_name(docs, "row")
    rows = docs.select(
        F.struct(F.lit(0).alias("f"), *(F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(carried))).alias(row),
        F.col(f"`{key}`").alias("doc"),
        _text(text).alias("body"),
        F.xxhash64(_text(text)).alias("t"),
        F.size(F.split(_text(text), "\n")).alias("n_lines"),
    )
    found = _with_bitmaps(rows, docs, key, text)
    left = F.aggregate("keep", F.lit(0), lambda n, r: n + r["n"])
    return found.select(
        *(F.col(f"{row}.f{i}").alias(c) for i, c in enumerate(carried)),
        kept_text(F.col("body"), F.col("keep")).alias(text),
        F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - left).cast("long").alias("n_dropped"),
    )
