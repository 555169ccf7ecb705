"""Near-duplicate classes by improved consistent weighted sampling.

1. *Weights.* A document's shingles (five words; the whole document if it has fewer) weigh their count
   times an inverse document frequency. Frequencies are counted over all documents, in a fixed number of
   hashed buckets, and the inverse frequency is damped to lie between 1 and ``1 + DAMPED``: a common
   shingle counts less, but never so much less that an edit weighs like a different text.
2. *Sketches.* ``BANDS * ROWS`` consistent weighted samples; two texts agree in one with a probability
   that is their weighted Jaccard similarity. Each band of ``ROWS`` samples is a bucket key.
3. *Candidates.* Equal texts are one node. In each bucket every node is paired with one leader, the member
   with the most company in its buckets, and each pair is verified by the exact weighted Jaccard similarity of the
   whole texts. A bucket's main component is the one that most of its members are in; members in others are
   verified against ``DRAWN`` draws from it. That joins nearly all that belong to it, in a number of pairs
   that is linear in the bucket.
4. *The rest.* Members still apart could be similar to any member of another component. In buckets below
   ``LARGE`` members they are verified against all of those. In larger ones they meet only where two texts could
   be similar at all: at a shingle that comes early enough in both when shingles are ordered rarest first (prefix
   filtering, which is exact). Loose copies of one text share its bands but hardly any rare shingle, so
   a large group of them is not compared pair by pair. Pairs within one component need no check. So the
   classes are those that verifying every pair of every bucket would give.

Cases: null text is in no class but its own; texts without words match only their exact copies; short
texts have one shingle; repeated rows are exact copies; an empty table gives an empty result; long texts
are read whole; other input columns pass through, those with an output's name are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelumen.llm.common import WORD_BYTES, bound_batches, checkpointed, give_back, grouped_by_size, mix64, scratch, stored, utf8
from pagelumen.llm.components import connected_components

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 14, 4
#: Hashed buckets of document frequencies (a fixed size, whatever the corpus), and how many travel in a row.
BUCKETS, SLICE = 1 << 18, 1 << 14
DAMPED = 0.25
#: Members drawn from a main component; members from which on a bucket is large.
DRAWN, LARGE = 4, 64
#: What two texts must share for ``SIMILAR``, of the sum of their weights; a hair less, for rounding.
NEEDED = SIMILAR / (1 + SIMILAR) * (1 - 1e-9)
#: Cells in which the shingles of large buckets are counted, at most (as a power of two), and cells of a slice.
MOST_CELL_BITS, CELL_SLICE = 25, 1 << 16
#: Bytes hashed at once; powers are kept for so many.
PIECE = 1 << 19

_POOL = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_held_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    if n > PIECE + 1:  # a single very long word
        return _powers(_BASE, n), _powers(inverse, n)
    if not _held_powers:
        _held_powers[:] = [_powers(_BASE, PIECE + 1), _powers(inverse, PIECE + 1)]
    return _held_powers[0], _held_powers[1]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words between spaces."""
    up, down = _power_tables(len(data))
    inside = data != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edges[::2], edges[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    return starts, mix64((total[ends] - total[starts]) * down[starts])


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text cut at spaces."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            cut = data.find(b" ", end) if cut <= at else cut
            end = len(data) if cut < 0 else cut
        yield data[at:end]
        at = end


def shingles(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its shingles, with repetitions."""
    for group in grouped_by_size(texts, PIECE // 2):
        data = b"".join(t.translate(WORD_BYTES) + b" " for _, t in group)
        if len(data) <= PIECE:
            starts, words = _word_hashes(np.frombuffer(data, np.uint8))
            first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for _, t in group)]))
        else:  # one long text, alone in its group or the last of it
            found, first = [], [0]
            for _, t in group:
                found += [_word_hashes(np.frombuffer(piece, np.uint8))[1] for piece in _pieces(t.translate(WORD_BYTES))]
                first.append(sum(map(len, found)))
            words = np.concatenate(found) if found else np.zeros(0, np.uint64)
        several = np.zeros(0, np.uint64)
        if len(words) >= WORDS:
            n = len(words) - WORDS + 1
            several = sum((words[i : i + n] * _STEPS[i] for i in range(1, WORDS)), words[:n] * _STEPS[0])
            several = mix64(several)
        for k in range(len(group)):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= WORDS:
                yield np.sort(several[a : b - WORDS + 1])
            elif b > a:
                yield mix64(np.array([(words[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64)], np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(hashes):
        return hashes, np.zeros(0)
    at = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[at], np.diff(np.concatenate([at, [len(hashes)]])).astype(np.float64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


class Weights:
    """Damped inverse document frequencies by hashed bucket."""

    def __init__(self, frequencies: np.ndarray, documents: int):
        rare = 1 - np.log1p(np.minimum(frequencies, documents)) / np.log1p(max(documents, 1))
        self.of_bucket = (1 + DAMPED * rare).astype(np.float32)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, counts = _counted(hashes)
        return distinct, counts * self.of_bucket[_bucket(distinct)]


def learn_weights(df: DataFrame, text: str = "text") -> Weights:
    """Counts, over all documents, in how many the shingles of each bucket occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for hashes in shingles([t for t in utf8(batch.column(0)) if t]):
                counts += np.bincount(np.unique(_bucket(hashes)), minlength=BUCKETS) if len(hashes) > BUCKETS else 0
                if len(hashes) <= BUCKETS:
                    counts[np.unique(_bucket(hashes))] += 1
                n += 1
        rows = [(i // SLICE, counts[i : i + SLICE].tobytes(), n if i == 0 else 0) for i in range(0, BUCKETS, SLICE)] if n else []
        slices, blobs, ns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(blobs, pa.binary()), pa.array(ns, pa.int64())], ["slice", "counts", "n"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for blob in table.column("counts"):
            total += np.frombuffer(blob.as_buffer(), np.int64)
        return pa.table({"slice": [key[0].as_py()], "counts": [total.tobytes()], "n": [sum(x.as_py() for x in table.column("n"))]}, pa.schema([("slice", pa.int32()), ("counts", pa.binary()), ("n", pa.int64())]))

    schema = "slice int, counts binary, n long"
    partial = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, schema)
    counts, n = np.zeros(BUCKETS, np.int64), 0
    for row in partial.groupBy("slice").applyInArrow(add, schema).collect():  # BUCKETS / SLICE rows
        counts[row.slice * SLICE : (row.slice + 1) * SLICE] = np.frombuffer(row["counts"], np.int64)
        n += row.n
    return Weights(counts, n)


class Sampler:
    """Consistent weighted samples. Random numbers of a (shingle, sample) come from a seeded pool."""

    def __init__(self) -> None:
        rng = np.random.default_rng(5)
        self.multipliers = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2, 1, _POOL).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, _POOL)).astype(np.float32)
        self.beta = rng.random(_POOL, dtype=np.float32)
        self.inverse_r = (1 / self.r).astype(np.float32)

    def bands(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, np.int64)
        logs = np.log(weights).astype(np.float32)
        picked = np.zeros(BANDS * ROWS, np.uint64)
        block = 1 << 13  # long texts go in blocks of shingles
        least = np.full(BANDS * ROWS, np.inf, np.float32)
        for at in range(0, len(hashes), block):
            h = hashes[at : at + block]
            draw = ((self.multipliers[:, None] * h[None]) >> np.uint64(48)).astype(np.int32)
            r, beta = self.r[draw], self.beta[draw]
            t = np.floor(logs[None, at : at + block] * self.inverse_r[draw] + beta)
            a = self.log_c[draw] - r * (t - beta + np.float32(1))
            best = a.argmin(1)
            rows = np.arange(len(best))
            lower = a[rows, best] < least
            least = np.where(lower, a[rows, best], least)
            picked = np.where(lower, h[best] + t[rows, best].astype(np.int64).astype(np.uint64) * _STEPS[0], picked)
        keys = mix64(picked * _STEPS[1]).reshape(BANDS, ROWS)
        joined = (keys * _STEPS[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEPS[4]
        return mix64(joined).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    union = a[1].sum() + b[1].sum() - shared
    return float(shared / union) if union > 0 else 0.0


_sampler: list[Sampler] = []


def _sketches(df: DataFrame, weights, text: str, key: str) -> DataFrame:
    """``key, tid, weight, bands``: tid is the text's digest; no bands for a text without words, no tid for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _sampler:
            _sampler.append(Sampler())
        for batch in batches:
            texts = utf8(batch.column(1))
            tids = [None if t is None else hashlib.md5(t).digest() for t in texts]
            weighted = [weights.value.of(h) for h in shingles([t or b"" for t in texts])]
            bands = [_sampler[0].bands(*x) for x in weighted]
            totals = [float(w.sum()) for _, w in weighted]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tids, pa.binary()), pa.array(totals, pa.float64()), pa.array(bands, pa.list_(pa.int64()))], ["k", "tid", "weight", "bands"])
        give_back()

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, tid binary, weight double, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, tuple] = {}
            keep = []
            for part in range(0, batch.num_rows, 256):
                some = batch.slice(part, 256)
                left, right = some.column(0).to_pylist(), some.column(1).to_pylist()
                known = {}
                for node, column in ((left, 2), (right, 3)):
                    fresh = {n: t for n, t in zip(node, utf8(some.column(column)), strict=True) if n not in known}
                    known |= dict(zip(fresh, map(weights.value.of, shingles(list(fresh.values()))), strict=True))
                keep += [similarity(known[a], known[b]) >= SIMILAR for a, b in zip(left, right, strict=True)]
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], ["a", "b"])
        give_back()

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long")


def _pairs_in_small(placed: DataFrame, mains: DataFrame) -> DataFrame:
    """``a, b``: in buckets below ``LARGE`` members, those apart with all of other components that weigh alike."""
    small = placed.where(F.col("n") < LARGE).join(mains, "bucket").select("bucket", "node", "weight", "component", (F.col("component") != F.col("main")).alias("apart"))
    others = small.select("bucket", *(F.col(c).alias(f"o_{c}") for c in ("node", "weight", "component", "apart")))
    alike = F.least("weight", "o_weight") >= (F.col("weight") + F.col("o_weight")) * NEEDED
    once = ~F.col("o_apart") | (F.col("node") < F.col("o_node"))
    return small.where("apart").join(others, "bucket").where((F.col("component") != F.col("o_component")) & alike & once).select(F.col("node").alias("a"), F.col("o_node").alias("b"))


def _cell_counts(texts: DataFrame, shingles_in_all: float):
    """A broadcast table of how many of the texts have a shingle of each hashed cell; counts end at 255.

    Its size follows the number of shingles up to ``2 ** MOST_CELL_BITS`` bytes. Beyond, cells are shared by more shingles, which makes
    rare ones look less rare: more pairs are verified, never fewer.
    """
    bits = min(MOST_CELL_BITS, max(16, int(4 * shingles_in_all).bit_length()))
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for hashes in shingles(utf8(batch.column(1))):
                found.append((np.unique(hashes) >> shift, None))
                held += len(found[-1][0])
                if held > 1 << 22:
                    found, held = [_summed(found)], 0
        cells, counts = _summed(found)
        cuts = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, CELL_SLICE, dtype=np.uint64))
        rows = [(i, cells[x:y].astype(np.uint16).tobytes(), counts[x:y].tobytes()) for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["slice", "cells", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(CELL_SLICE, np.uint16)
        for cells, counts in zip(table.column("cells"), table.column("counts"), strict=True):
            at = np.frombuffer(cells.as_buffer(), np.uint16)
            total[at] = np.minimum(total[at] + np.frombuffer(counts.as_buffer(), np.uint8), 255)
        return pa.table({"slice": [key[0].as_py()], "cells": [b""], "counts": [total.astype(np.uint8).tobytes()]}, pa.schema([("slice", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())]))

    schema = "slice int, cells binary, counts binary"
    out = np.zeros(1 << bits, np.uint8)
    for row in texts.select("node", "text").mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect():  # a fixed size
        out[row.slice * CELL_SLICE : (row.slice + 1) * CELL_SLICE] = np.frombuffer(row["counts"], np.uint8)
    return texts.sparkSession.sparkContext.broadcast((shift, out))


def _summed(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells and their counts, at most 255 each; a part is cells with counts, or cells that count one."""
    cells = np.concatenate([np.zeros(0, np.uint64), *(c for c, _ in found)])
    weights = np.concatenate([np.zeros(0), *(np.ones(len(c)) if n is None else n.astype(float) for c, n in found)])
    distinct, at = np.unique(cells, return_inverse=True)
    return distinct, np.minimum(np.bincount(at, weights, len(distinct)), 255).astype(np.uint8)


def _prefixes(texts: DataFrame, members: DataFrame, weights, counts) -> DataFrame:
    """``x, node, weight, component, apart, after``: the shingles of each text, rarest first, as long as no more
    lies before than the text can spare; ``after`` is the weight from the shingle on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, count = counts.value
        for batch in batches:
            spare, made = batch.column(5).to_pylist(), []
            for i, hashes in enumerate(shingles(utf8(batch.column(0)))):
                distinct, w = weights.value.of(hashes)
                often = count[(distinct >> shift).astype(np.int64)]
                order = np.lexsort((distinct, often))
                before = np.cumsum(w[order]) - w[order]
                # What no other text has can't meet.
                kept = order[(before <= spare[i]) & (often[order] > 1)]
                at = np.empty(len(order))
                at[order] = before
                made.append((np.full(len(kept), i), distinct[kept].view(np.int64), w.sum() - at[kept]))
            row, x, after = (np.concatenate([m[k] for m in made]) if made else np.zeros(0) for k in range(3))
            own = [batch.column(c).take(pa.array(row, pa.int64())) for c in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), *own, pa.array(after, pa.float64())], ["x", "node", "weight", "component", "apart", "after"])
        give_back()

    rows = texts.join(members, "node").select("text", "node", "weight", "component", "apart", "spare")
    return rows.mapInArrow(run, "x long, node long, weight double, component long, apart boolean, after double")


def _pairs_in_large(placed: DataFrame, mains: DataFrame, texts: DataFrame, weights, kept) -> DataFrame:
    """``a, b``: in buckets of ``LARGE`` members and more, the pairs of different components that can be similar.

    Exact, by prefixes. A similarity J of weights x and y with s in common is s / (x + y - s), so J >= t asks
    for s >= (x + y) t / (1 + t). Put the shingles of all texts in one order, the rarest first: what two texts
    have in common then begins at a shingle before which neither has more than it can spare, and all that
    they share lies from there on. Texts meet at such shingles only. Edits make shingles that few or no other text
    has, so loose copies of one text, which share its bands, rarely meet.
    """
    large = placed.where(F.col("n") >= LARGE).join(mains, "bucket")
    least = large.groupBy("bucket").agg(F.min("weight").alias("least"))
    members = large.join(least, "bucket").groupBy("node").agg(F.first("weight").alias("weight"), F.first("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("apart"), F.min("least").alias("least"))
    # Similar texts weigh at least SIMILAR of each other, and no less than the least of the bucket.
    spare = F.col("weight") - (F.col("weight") + F.greatest(F.col("weight") * SIMILAR, F.col("least"))) * NEEDED
    members = kept(members.withColumn("spare", spare + F.col("weight") * 1e-6))
    total = members.agg(F.sum("weight")).first()[0] or 0.0
    counts = _cell_counts(texts.join(members.select("node"), "node"), total)
    prefix = kept(_prefixes(texts, members, weights, counts))
    others = prefix.select("x", *(F.col(c).alias(f"o_{c}") for c in ("node", "weight", "component", "apart", "after")))
    enough = F.least("after", "o_after") >= (F.col("weight") + F.col("o_weight")) * (NEEDED - 1e-6)
    once = ~F.col("o_apart") | (F.col("node") < F.col("o_node"))
    heads = prefix.where("apart")
    return heads.join(others, (heads["x"] == others["x"]) & (F.col("component") != F.col("o_component")) & enough & once).select(F.col("node").alias("a"), F.col("o_node").alias("b"))


def _placed(members: DataFrame, parts: DataFrame, kept) -> tuple[DataFrame, DataFrame]:
    """The members with their component, and the main component of each bucket that has several."""
    placed = kept(members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    mains = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts"))
    return placed, mains.where(F.col("parts") > 1).select("bucket", "main")


def classes(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, tid, class_id, component``, one row per input row. A class is named by its least key; null text has
    no tid and no component."""
    bound_batches(df.sparkSession)
    context = df.sparkSession.sparkContext
    weights = context.broadcast(learn_weights(df, text))  # fixed size
    sketches = stored(_sketches(df, weights, text, key))
    nodes = sketches.where(F.col("tid").isNotNull()).groupBy("tid").agg(F.min("k").alias("k"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    in_band = nodes.select(F.explode("bands").alias("bucket"), "node", "weight")
    shared = in_band.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    with scratch() as kept:
        # A text with much company in its buckets is near to what a group has in common: the best to compare with.
        members = kept(in_band.join(shared, "bucket"))
        company = members.groupBy("node").agg(F.sum("n").alias("company"))
        members = kept(members.join(company, "node"))
        # Whatever is compared later is in a shared bucket, so these are all the texts that are needed. Joined by
        # key and digest together, so that the copies of one text do not meet in one task.
        wanted = company.select("node").join(nodes.select("node", "tid", _plain("k").alias("k")), "node")
        by_tid = df.where(F.col(text).isNotNull()).select(_plain(key).alias("k"), _tid(text).alias("tid"), F.col(text).cast("string").alias("text"))
        texts = kept(by_tid.join(wanted, ["k", "tid"]).groupBy("node").agg(F.first("text").alias("text")))
        best = F.max_by("node", F.struct("company", "node"))
        leaders = members.groupBy("bucket").agg(best.alias("leader"))
        pairs = members.join(leaders, "bucket").where(F.col("node") != F.col("leader")).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        tried = kept(pairs.distinct())
        links = kept(_verified(tried, texts, weights))
        # Those apart from a bucket's main component, with members of it that have the most company.
        placed, mains = _placed(members, connected_components(links), kept)
        ours = placed.join(mains, "bucket").where(F.col("component") == F.col("main"))
        draws = ours.groupBy("bucket").agg(*(F.max_by("node", F.struct(_lot(i), "node")).alias(f"d{i}") for i in range(DRAWN)))
        apart = placed.join(mains, "bucket").where(F.col("component") != F.col("main")).join(draws, "bucket")
        pairs = apart.select("node", F.explode(F.array_distinct(F.array(*(f"d{i}" for i in range(DRAWN))))).alias("other"))
        fresh = kept(_new(pairs, tried))
        tried, links = tried.unionByName(fresh), links.unionByName(kept(_verified(fresh, texts, weights)))
        # Whatever is still apart, with all that it can be similar to.
        placed, mains = _placed(members, connected_components(links), kept)
        pairs = _pairs_in_small(placed, mains)
        if not placed.where(F.col("n") >= LARGE).join(mains, "bucket").isEmpty():
            pairs = pairs.unionByName(_pairs_in_large(placed, mains, texts, weights, kept))
        fresh = kept(_new(pairs, tried))
        links = links.unionByName(kept(_verified(fresh, texts, weights)))
        parts = checkpointed(connected_components(links))
    placed = nodes.select("tid", "node", "k").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = placed.groupBy("component").agg(F.min("k").alias("class_id"))
    sizes = placed.join(named, "component").select("tid", "class_id", "component")
    found = sketches.select("k", "tid").join(sizes, "tid", "left")
    return found.select(F.col("k").alias(key), "tid", F.coalesce("class_id", "k").alias("class_id"), "component")


def _new(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    pairs = pairs.select(F.least(*pairs.columns).alias("a"), F.greatest(*pairs.columns).alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def _lot(i: int):
    """Company, shaken a little: several draws, each with much of it."""
    return F.col("company") * (1 + F.pmod(F.xxhash64(F.lit(i), "node"), F.lit(1000)) / 10000 * int(i > 0))


def _plain(key: str):
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def _tid(text: str):
    return F.unhex(F.md5(F.col(text).cast("string").cast("binary")))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, class_id``, one row per input row; the least key of a class is its class_id."""
    return classes(df, text, key).select(key, "class_id")


def keep_first(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The input with one row of each class: that of the least key, then least digest; rows of null text all stay."""
    found = classes(df, text, key).where(F.col("component").isNotNull())
    best = found.groupBy("component").agg(F.min(F.struct(F.col(key).alias("k"), "tid")).alias("best"))
    # Joined by key and digest together, so that the copies of one text do not meet in one task.
    best = best.select(F.struct(_plain("best.k").alias("k"), F.col("best.tid").alias("tid")).alias("_of"))
    rows = df.where(F.col(text).isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.struct(_plain(key).alias("k"), _tid(text).alias("tid")).alias("_of"))
    kept = rows.join(best, "_of", "left_semi").dropDuplicates(["_of"])
    return kept.select("_row.*").unionByName(df.where(F.col(text).isNull()))
