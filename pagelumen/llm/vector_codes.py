"""Vector compression by product quantisation in exact integers.

A component x becomes floor(1024 * x). Vectors are cut into equal parts, and each part's place has a codebook
of up to 256 entries, which begins as that part of the vectors with the smallest ids. Each round sends the
codebooks to all tasks (256 integers a dimension, whatever the rows), where Arrow batches are assigned to
their nearest entries: all distances of a batch come from the norms and one 64-bit integer matrix product,
and the first least one counts. Tasks hand on the sums of their rows by entry; a grouped shuffle adds them
up, and every entry moves to the componentwise floor of its mean. No vector is ever shuffled.

Cases: vectors that are null or hold null or non-finite components are dropped; shorter vectors are continued
by zeros; if the length doesn't divide, the first parts are one longer; fewer vectors than entries make
smaller codebooks; ids that are alike, or null (which come last), are taken in order of their vectors; entries
that are alike leave the later one unused; integers are held within the square root of 2^60 / length, where all sums of
squares fit 64 bits; null labels are a label; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelumen.llm.common import bound_batches, give_back, stored
from pagelumen.llm.vectors import equally_long, finite, integers

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4

Codebooks = list[np.ndarray]


def _cuts(dim: int, parts: int) -> list[slice]:
    """The parts as slices; the first ones are longer if they can't be equal."""
    sizes = [dim // parts + (i < dim % parts) for i in range(parts)]
    ends = np.cumsum([0, *sizes])
    return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def assign(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of several, and its squared distance."""
    # |x - c|^2 = |x|^2 - 2 x.c + |c|^2; the row's own norm doesn't change which entry is nearest.
    beyond = (codebook * codebook).sum(1)[None, :] - 2 * (x @ codebook.T)
    nearest = beyond.argmin(1)
    return nearest, (x * x).sum(1) + beyond[np.arange(len(x)), nearest]


def _first_codebooks(vectors: DataFrame, dim: int, parts: int, entries: int, scale: int) -> Codebooks:
    first = vectors.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).toArrow().column("v")
    x = integers(pa.concat_arrays(first.chunks), dim, scale) if len(first) else np.zeros((0, dim), np.int64)
    return [x[:, cut].copy() for cut in _cuts(dim, parts)]


def _sums(vectors: DataFrame, codebooks: Codebooks, dim: int, scale: int) -> DataFrame:
    """``part, entry, at, total``: per entry the number of its rows (at -1) and their sums by component."""
    sent = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        cuts = _cuts(dim, len(books))
        totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            x = integers(batch.column(0), dim, scale)
            for total, book, cut in zip(totals, books, cuts, strict=True):
                nearest, _ = assign(x[:, cut], book)
                np.add.at(total[:, 1:], nearest, x[:, cut])
                total[:, 0] += np.bincount(nearest, minlength=len(book))
        rows = [(p, e, t[e].tolist()) for p, t in enumerate(totals) for e in np.flatnonzero(t[:, 0]).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["part", "entry", "sums"])
        give_back()

    each = vectors.select("v").mapInArrow(run, "part int, entry int, sums array<long>")
    flat = each.select("part", "entry", F.posexplode("sums").alias("at", "n"))
    return flat.groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("total"))


def _moved(codebooks: Codebooks, sums: DataFrame) -> Codebooks:
    """Every used entry at the floor of its mean; the sums are as many as the codebooks' integers."""
    found = {(r["part"], r["entry"], r["at"]): int(r["total"]) for r in sums.collect()}
    out = [b.copy() for b in codebooks]
    for (part, entry, at), total in found.items():
        if at > 0:
            out[part][entry, at - 1] = total // found[part, entry, 0]
    return out


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> tuple[Codebooks, int]:
    """The codebooks of the parts, and the vectors' length."""
    bound_batches(vectors.sparkSession)
    rows, dim = equally_long(vectors.where(finite(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")))
    codebooks = _first_codebooks(rows, dim, parts, entries, scale)
    for _ in range(rounds if len(codebooks[0]) else 0):
        codebooks = _moved(codebooks, _sums(rows, codebooks, dim, scale))
    return codebooks, dim


def encode(vectors: DataFrame, codebooks: Codebooks, dim: int, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, code, error`` of every usable vector; code: an entry of each part, a byte each."""
    bound_batches(vectors.sparkSession)
    v = F.col(vector).cast("array<double>")
    rows = vectors.where(finite(F.col(vector)) & (F.size(vector) <= dim))
    rows = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.concat(v, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(v))).alias("v"))
    sent = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            x = integers(batch.column(2), dim, scale)
            code, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, (book, cut) in enumerate(zip(books, _cuts(dim, len(books)), strict=True)):
                code[:, p], distance = assign(x[:, cut], book)
                error += distance
            packed = pa.array([row.tobytes() for row in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(error)], ["id", "label", "code", "error"])
        give_back()

    schema = rows.select("id", "label").schema.add("code", "binary").add("error", "long")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)


def decode(codes: DataFrame, codebooks: Codebooks, scale: int = SCALE, code: str = "code") -> DataFrame:
    """Adds ``approximation``: the vector that a code stands for, in the original scale."""
    tables = [F.lit([[float(x) / scale for x in row] for row in b.tolist()]) for b in codebooks]
    byte = lambda p: F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("approximation", F.concat(*(F.get(t, byte(p)) for p, t in enumerate(tables))))


def digest(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for b in codebooks for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``."""
    codebooks, dim = train(vectors, key=key, vector=vector)
    # Read twice below. As a written table its size is known, so Spark broadcasts the labels' sums if they are few.
    coded = stored(encode(vectors, codebooks, dim, key=key, vector=vector, label=label))
    sums = stored(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).select(F.col("label").alias("of"), F.least("total", F.lit((1 << 63) - 1)).cast("long").alias("label_error")))
    met = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    return met.select(key, F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
