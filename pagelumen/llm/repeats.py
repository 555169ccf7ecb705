"""Removal of repeated byte strings by distributed prefix doubling.

A byte is removed if it lies in a ``LENGTH``-byte string that also starts anywhere else. A suffix sort of
all byte positions would say so, and prefix doubling sorts it by pairs of ranks at growing offsets. Done
on every position, the pairs are many times the input. Two properties of the question shrink the work
without changing the answer:

* *Ranks need no sort to be equal.* Only equality of prefixes matters here, so a rank is a 64-bit
  fingerprint, made by doubling: 8 bytes are their own rank; that of 2n bytes comes from the pair of ranks
  at offsets 0 and n. (Two different strings share a rank with probability 2**-64.)
* *Equal strings pick equal anchors.* Each ``LENGTH``-byte window is represented by the least rank of a
  ``GRAM``-byte string in it (leftmost of equals); equal windows choose it at the same offset. Consecutive
  windows share anchors, so there is about one anchor per 137 bytes.

Spark then reranks in rounds of growing length, and positions that turn out unique leave. In each round a
run of windows has a *core*, the bytes that all its windows share, and a *span*, the bytes of all its windows.
A core that occurs once has no repeated window. Of a span that occurs several times all windows repeat, and
one such run stands for the others; where one core has spans of several kinds, runs are cut smaller:

1. the windows of an anchor; the core is the anchor's gram (128 bytes);
2. segments of ``SEGMENT`` windows at fixed distances from the anchor; the core has 369 bytes;
3. single windows, by the pair of ranks at offsets 0 and ``LENGTH - 256`` (400 bytes).

Texts are shuffled only if they have open runs, or something to remove: a bitmap of their keys, of bounded
size, sorts out the others within the scan (it may let some through, but loses none).

Cases: null and empty text, and text under ``LENGTH`` bytes, keep everything; exact copies lose every
byte; overlapping repeats within one document count; repeated rows are copies; texts of any length are
read in overlapping slices; an empty table gives an empty result; other input columns pass through, those
with an output's name are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelumen.llm.common import bound_batches, grouped_by_size, mix64, packed_row, stored, unpacked, utf8

LENGTH, GRAM = 400, 128
#: Windows of a segment; bytes that all windows of a full one share.
SEGMENT = 32
CORE = LENGTH - SEGMENT + 1
#: Bits of a bitmap for each key, and at most (as a power of two).
BITS_EACH, MOST_BITS = 16, 29
#: Window starts in a slice of a text; positions within a slice must fit the low bits of an anchor's key.
SLICE, LOW_BITS = 1 << 17, 18
_C1, _C2, _C3 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rank of the pair of ranks (x, y)."""
    z = (y ^ (y >> np.uint64(31))) * _C2
    z ^= x * _C1
    z ^= z >> np.uint64(29)
    z *= _C3
    z ^= z >> np.uint64(32)
    return z


def _ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the ``GRAM`` and of the 256 bytes at each position, by doubling."""
    rank = data.astype(np.uint64)
    for n in (1, 2, 4):  # exact: the bytes themselves
        rank = rank[:-n] | rank[n:] << np.uint64(8 * n)
    for n in (8, 16, 32, 64):
        rank = _pair(rank[:-n], rank[n:])
    return rank, _pair(rank[:-GRAM], rank[GRAM:])


def _window_ranks(rank256: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return _pair(rank256[starts], rank256[starts + (LENGTH - 256)])


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Per group of texts: rank of each anchor's gram, number of its text, its position, its first and last
    window and the rank of its span. Long texts come in slices, short ones several to a group."""
    low = np.uint64((1 << LOW_BITS) - 1)
    pieces = [(i, a, t[a : a + SLICE + LENGTH - 1]) for i, t in enumerate(texts) for a in range(0, len(t) - LENGTH + 1, SLICE)]
    for group in grouped_by_size((piece for _, _, piece in pieces), SLICE + LENGTH - 1):
        data = np.frombuffer(b"".join(p for _, p in group), np.uint8)
        gram, rank256 = _ranks(data)
        least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        reach, width = 1, LENGTH - GRAM + 1  # how many grams a window has
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        rest = width - reach
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        chosen = (least & low).astype(np.int64)  # by window
        sizes = np.array([len(p) for _, p in group])
        begins = np.cumsum(sizes) - sizes
        inside = np.zeros(len(chosen) + 1, np.int8)  # windows that lie within one piece
        inside[begins] += 1
        inside[begins + sizes - LENGTH + 1] -= 1
        inside = np.cumsum(inside[:-1]).astype(bool)
        fresh = np.concatenate([[True], chosen[1:] != chosen[:-1]])
        fresh[begins] = True
        first = np.flatnonzero(fresh & inside)
        stop = np.flatnonzero(np.concatenate([fresh[1:] | ~inside[1:], [True]]) & inside)
        at = chosen[first]
        size = stop - first + LENGTH
        span = _pair(_pair(rank256[first], rank256[first + (size - 256) // 2]), rank256[stop + LENGTH - 256])
        span = _pair(span, ((at - first) * 4096 + size).astype(np.uint64))
        piece = np.searchsorted(begins, first, side="right") - 1
        of = np.array([pieces[k][0] for k, _ in group])[piece]
        shift = (np.array([pieces[k][1] for k, _ in group]) - begins)[piece]
        yield gram[at], of, at + shift, first + shift, stop + shift, span


_FIELDS = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("kept_text", T.StringType()),
    ]
)


def _key(text: str):
    """A text's key: 64 bits, null for null."""
    return F.xxhash64(F.col(text).cast("string"))


def _find_anchors(df: DataFrame, text: str) -> DataFrame:
    """``tid, core, span, at, lo, hi``: the anchors of every text, with their first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tid", "core", "span", "at", "lo", "hi"]
        for batch in batches:
            there = [(i, t) for i, t in enumerate(utf8(batch.column(1))) if t is not None and len(t) >= LENGTH]
            keys = batch.column(0).take(pa.array([i for i, _ in there], pa.int64()))
            for gram, of, at, lo, hi, span in anchors([t for _, t in there]):
                columns = [gram.view(np.int64), span.view(np.int64), at, lo, hi]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), *map(pa.array, columns)], names)

    rows = df.select(_key(text).alias("tid"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "tid long, core long, span long, at long, lo long, hi long")


class Bitmap:
    """Keys hashed into a bitmap. Says of every key in it that it is there, and of few others."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.data = np.zeros(1 << (bits - 3), np.uint8)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys.astype(np.int64).view(np.uint64)) >> self.shift
        return (h >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (h & np.uint64(7)).astype(np.uint8)).astype(np.uint8)

    def add(self, keys: np.ndarray) -> None:
        at, bit = self._places(keys)
        np.bitwise_or.at(self.data, at, bit)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at, bit = self._places(keys)
        return (self.data[at] & bit) != 0


def _bitmap(keys: DataFrame):
    """A broadcast bitmap of a column of keys; its size follows their number up to ``2 ** MOST_BITS`` bits.

    Beyond that it lets more through, which costs time and is never wrong.
    """
    name, slice_ = keys.columns[0], 1 << 16
    bits = min(MOST_BITS, max(19, int(BITS_EACH * keys.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bitmap(bits)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False))
        rows = [(i, own.data[i * slice_ : (i + 1) * slice_]) for i in range(len(own.data) // slice_)]
        rows = [(i, part.tobytes()) for i, part in rows if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["slice", "bits"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(slice_, np.uint8)
        for blob in table.column("bits"):
            out |= np.frombuffer(blob.as_buffer(), np.uint8)
        return pa.table({"slice": [key[0].as_py()], "bits": [out.tobytes()]}, pa.schema([("slice", pa.int32()), ("bits", pa.binary())]))

    whole = Bitmap(bits)
    for row in keys.select(name).mapInArrow(mark, "slice int, bits binary").groupBy("slice").applyInArrow(join, "slice int, bits binary").collect():
        whole.data[row.slice * slice_ : (row.slice + 1) * slice_] = np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)  # bounded by MOST_BITS


def _only(df: DataFrame, held, column: str) -> DataFrame:
    """The rows whose key may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(held.value.has(keys), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _kinds(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of runs ``tid, core, span, at, lo, hi, alone``: those that repeat whole (``tid, lo, hi``), and the open ones.

    Open are one run of each kind of a core that has several kinds; it is ``alone`` if it needs a verdict,
    which a run that repeats whole has already.
    """
    one = F.struct("tid", "at", "lo", "hi")
    kinds = stored(runs.groupBy("core", "span").agg(F.count("*").alias("n"), F.min(one).alias("one"), F.bool_and("alone").alias("alone")))
    whole = runs.where("alone").join(kinds.where(F.col("n") > 1).select("core", "span"), ["core", "span"]).select("tid", "lo", "hi")
    several = kinds.groupBy("core").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1).select("core")
    open_ = kinds.join(several, "core").select("one.*", (F.col("alone") & (F.col("n") == 1)).alias("alone"))
    return whole, stored(open_)


def _texts_with(df: DataFrame, text: str, runs: DataFrame) -> DataFrame:
    """``tid, text, runs`` for the texts that have open runs; of copies, one."""
    held = _bitmap(runs.select("tid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of the texts that pass, copies within a task leave before the shuffle
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            keep = held.value.has(keys)
            for i in np.flatnonzero(keep).tolist():
                keep[i] = int(keys[i]) not in seen
                seen.add(int(keys[i]))
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = df.where(F.octet_length(F.col(text).cast("string")) >= LENGTH).select(_key(text).alias("tid"), F.col(text).cast("string").alias("text"))
    passed = rows.mapInArrow(run, "tid long, text string")
    by_text = runs.groupBy("tid").agg(F.collect_list(F.struct("at", "lo", "hi", "alone")).alias("runs"))  # bounded by a text's length
    return passed.join(by_text, "tid").groupBy("tid").agg(F.first("text").alias("text"), F.first("runs").alias("runs"))


def _cut(texts: DataFrame, single: bool) -> DataFrame:
    """The runs of texts, cut into segments or into single windows: ``tid, core, span, at, lo, hi, alone``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tid", "core", "span", "at", "lo", "hi", "alone"]
        for batch in batches:
            for tid, value, runs in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2), strict=True):
                at, lo, hi, alone = (np.array(runs.values.field(i)) for i in range(4))
                parts = []
                for start in range(0, len(value) - LENGTH + 1, SLICE):
                    mine = (lo >= start) & (lo < start + SLICE)  # a run lies within the slice it begins in, or a window's length beyond
                    if mine.any():
                        _, rank256 = _ranks(np.frombuffer(value[start : start + SLICE + 2 * LENGTH + GRAM], np.uint8))
                        parts.append(_pieces(rank256, at[mine] - start, lo[mine] - start, hi[mine] - start, alone[mine], single, start))
                made = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made[0]), tid)), *map(pa.array, made)], names)

    return texts.mapInArrow(run, "tid long, core long, span long, at long, lo long, hi long, alone boolean")


def _pieces(rank256: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, alone: np.ndarray, single: bool, start: int) -> tuple[np.ndarray, ...]:
    width = 1 if single else SEGMENT
    nearest, farthest = (at - hi) // width, (at - lo) // width  # pieces by distance from the anchor
    many = farthest - nearest + 1
    of = np.repeat(np.arange(len(at)), many)
    number = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + nearest[of]
    first = np.maximum(lo[of], at[of] - number * width - width + 1)
    last = np.minimum(hi[of], at[of] - number * width)
    if single:
        core = _window_ranks(rank256, first)
        span = core
    else:
        begin = at[of] - number * width
        core = _pair(_pair(rank256[begin], rank256[begin + CORE - 256]), number.astype(np.uint64))
        span = _pair(_pair(rank256[first], rank256[last + LENGTH - 256]), (last - first + number * 4096).astype(np.uint64))
    return core.view(np.int64), span.view(np.int64), at[of] + start, first + start, last + start, alone[of]


def repeated_windows(df: DataFrame, text: str = "text") -> DataFrame:
    """``tid, lo, hi``: runs of window starts that repeat, by the key of their text; runs may touch."""
    bound_batches(df.sparkSession)
    found = stored(_find_anchors(df, text))
    cores = found.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("core")
    # Round 1. Anchors that don't pass the bitmap of repeated grams are unique.
    runs = _only(found, _bitmap(stored(cores)), "core").withColumn("alone", F.lit(True))
    whole, open_ = _kinds(runs)
    # Round 2, on the segments of what is open.
    segments = stored(_cut(_texts_with(df, text, open_), single=False))
    whole_segments, open_ = _kinds(segments)
    # Round 3, on single windows.
    windows = stored(_cut(_texts_with(df, text, open_), single=True))
    ranks = windows.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("core")
    single = windows.where("alone").join(ranks, "core").select("tid", "lo", "hi")
    return whole.unionByName(whole_segments).unionByName(single)


def remove_repeats(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_bytes, n_removed, n_spans, kept_sha256, kept_text`` to every row.

    ``kept_text`` is the text without its repeats; what is left of a character that was cut is not in it, but
    counts in the digest, which is of the bytes.
    """
    order = df.columns if keep is None else keep
    runs = stored(repeated_windows(df, text).groupBy("tid").agg(F.collect_set(F.struct("lo", "hi")).alias("_runs")))  # bounded by a text's length
    held = _bitmap(runs.select("tid"))
    fields = {f.name for f in _FIELDS}
    kept = [c for c in order if c.lower() not in fields]
    rows = df.select(packed_row(kept), F.col(text).cast("string").alias("_text"), _key(text).alias("tid"))
    schema = T.StructType([rows.schema["_row"], *_FIELDS.fields])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.filter(pa.array(~held.value.has(batch.column(2).to_numpy(zero_copy_only=False)), pa.bool_()))
            yield _measured(out.column(0), utf8(out.column(1)), [None] * out.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _measured(batch.column(0), utf8(batch.column(1)), batch.column(2).to_pylist())

    joined = _only(rows, held, "tid").join(runs, "tid", "left").select("_row", "_text", "_runs")
    out = rows.mapInArrow(untouched, schema).unionByName(joined.mapInArrow(touched, schema))
    return out.select(*unpacked(kept), *(f.name for f in _FIELDS))


def _measured(rows: pa.Array, texts: list[bytes | None], runs: list[list[dict] | None]) -> pa.RecordBatch:
    sizes, removed, spans, sums, left = [], [], [], [], []
    for value, found in zip(texts, runs, strict=True):
        value = value or b""
        gone = merged([(r["lo"], r["hi"] + LENGTH) for r in found or []])
        parts, at = [], 0
        for s, e in gone:
            parts.append(value[at:s])
            at = e
        sizes.append(len(value))
        removed.append(sum(e - s for s, e in gone))
        spans.append(len(gone))
        rest = b"".join([*parts, value[at:]])
        sums.append(hashlib.sha256(rest).hexdigest())
        left.append(rest.decode("utf-8", "ignore"))  # a cut within a character leaves bytes that are none
    made = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string()), pa.array(left, pa.string())]
    return pa.RecordBatch.from_arrays([rows, *made], ["_row", *(f.name for f in _FIELDS)])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, maximal runs; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
