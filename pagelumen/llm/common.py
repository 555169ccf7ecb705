"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a file in the folder of ``spark.checkpoint.dir``, which executors share.

    The setting is read from the session. Only where it is unset and Spark runs on one machine, as in tests,
    a temporary folder takes its place; on a cluster that is an error.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if not wanted and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(wanted or os.path.join(tempfile.gettempdir(), "pagelumen-checkpoints"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Like ``checkpointed``, but as a compressed Parquet table in the shared folder; for larger tables."""
    return _written(df, f"{_shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Yields a function like ``stored`` whose tables are deleted at the end; nothing lazy may need them then."""
    made: list[tuple[SparkSession, str]] = []

    def keep(df: DataFrame) -> DataFrame:
        path = f"{_shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
        made.append((df.sparkSession, path))
        return _written(df, path)

    try:
        yield keep
    finally:
        for spark, path in made:
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to ``BATCH_BYTES``; by number of rows alone, a batch of
    long texts, held several times over by a worker, has no bound."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES or int(now) <= 0:
        spark.conf.set(setting, str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks, and what one stage has freed
    would else stand beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def annotate(
    df: DataFrame,
    per_batch: Callable[[pa.Array], dict[str, pa.Array]],
    fields: T.StructType,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds the columns of ``fields``, which ``per_batch`` derives from the text column.

    ``keep`` names the input columns to carry (default: all). Where an input column has the name of a
    new one, the new one replaces it. Other columns pass through Python untouched, as Arrow data.
    """
    bound_batches(df.sparkSession)
    names = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    packed = df.select(packed_row(kept), F.col(f"`{text}`").cast("string").alias("_text"))
    order = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = per_batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(made[n] for n in order)], ["_row", *order])
        give_back()

    schema = T.StructType([packed.schema["_row"], *fields.fields])
    return packed.mapInArrow(run, schema).select(*unpacked(kept), *order)


def packed_row(columns: list[str]) -> Column:
    """The columns as one struct ``_row``, fields by place: their names can clash with nothing.

    The first field is there so that a struct of no column is one, too.
    """
    return F.struct(F.lit(0).alias("f"), *(F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(columns))).alias("_row")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col(f"_row.f{i}").alias(c) for i, c in enumerate(columns)]


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def grouped_by_size(items: Iterable[bytes], most: int = 1 << 20) -> Iterator[list[tuple[int, bytes]]]:
    """Splits (index, bytes) into runs of about ``most`` bytes, so that arrays over them stay small."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, item in enumerate(items):
        if held and size + len(item) > most:
            yield held
            held, size = [], 0
        held.append((i, item))
        size += len(item)
    if held:
        yield held


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (shift, xor, multiply); every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: ASCII punctuation, controls and space become a space, A-Z lower case; every byte of a non-ASCII
#: character is part of a word.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
