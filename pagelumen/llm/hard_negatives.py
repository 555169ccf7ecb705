"""Hard negatives by inner product, searched behind an orthogonal rotation.

Components become floor(256 * x). For every anchor the best rows of its own label are its positives; for
every positive the best rows of other labels are wanted whose score lies between a share of the
positive's score and another (``FROM`` and ``TO``, in per cent).

All rows are rotated onto the principal axes of the table (a covariance of length^2 numbers, added up over
all rows). A product over the leading axes is then most of the score, and the rest is at most the product of
the two residual norms: |a.x - a'.x'| <= |a_rest| |x_rest| + slack, where the slack bounds what rounding and the
rotation's departure from orthogonality can do. Pairs whose bound can't reach what an anchor still needs are
discarded after an eighth, a quarter or half of the axes. Survivors are verified by 64-bit integer products, so the
result is exact.

Rows lie in shards of bounded size and anchors in blocks; every (shard, block) pair is a group, which keeps no
more than the wanted number for each anchor, and the groups' best are ranked. So a row is sent once a block of ``BLOCK_ANCHORS``
anchors, and an anchor once a shard: the anchors are a stated query set against all rows.

Cases: rows with a null label or vector, or with null or non-finite components take no part; shorter vectors are continued
by zeros; several anchors with one id count as the one of least vector and label; an anchor never meets rows of its own id;
rows with repeated ids are rows of their own, a null id is no anchor and comes last among ties; integers are held within the
square root of 2^60 / length, where every score fits 64 bits; an anchor without positives, and a positive without
negatives in its window, give no row; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelumen.llm.common import bound_batches, give_back, stored
from pagelumen.llm.vectors import equally_long, finite, integers

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: The window of a negative's score, in per cent of the positive's.
FROM, TO = 50, 95
SHARD_ROWS, BLOCK_ANCHORS = 32_768, 8192
#: Anchors and rows of one matrix of partial products; pairs verified at a time.
TILE_ANCHORS, TILE_ROWS, PAIRS = 512, 4096, 1 << 16
NULL_ID = (1 << 63) - 1


class Rotated:
    """Vectors as integers and on the principal axes, with the norms of what lies beyond the first m axes."""

    def __init__(self, x: np.ndarray, axes: np.ndarray, steps: list[int]):
        self.x = x
        self.y = x.astype(np.float64) @ axes
        squares = np.cumsum((self.y**2)[:, ::-1], axis=1)[:, ::-1]
        # Sums of rounded squares: a part in 2^40 more than they are is surely enough.
        self.rest = {m: np.sqrt(squares[:, m]) * (1 + 2.0**-40) if m < x.shape[1] else np.zeros(len(x)) for m in steps}
        self.norm = np.sqrt((self.y**2).sum(1)) * (1 + 2.0**-40)


def steps_of(dim: int) -> list[int]:
    """After how many axes the bound is tried."""
    return sorted({max(1, dim // 8), max(1, dim // 4), max(1, dim // 2)})


def slack_of(axes: np.ndarray) -> float:
    """What rounding and departure from orthogonality add to a score, as a share of the norms' product."""
    dim = len(axes)
    departure = float(np.linalg.norm(axes.T @ axes - np.eye(dim)))
    return departure + 16 * (dim + 2) * np.finfo(float).eps * (1 + dim)


class Best:
    """For each of n slots the k pairs of highest score, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.slot, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, slot: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, row = np.concatenate([self.slot, slot]), np.concatenate([self.row, row])
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, slot))
        slot, row, score, ids = slot[order], row[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        kept = place < self.k
        self.slot, self.row, self.score, self.id = slot[kept], row[kept], score[kept], ids[kept]
        full = place == self.k - 1
        self.least[slot[full]] = score[full]


def _survivors(anchors: Rotated, rows: Rotated, a: np.ndarray, r: np.ndarray, steps: list[int], slack: float, low: np.ndarray, high: np.ndarray, meets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs among anchors ``a`` and rows ``r`` whose score can lie within low..high of the anchor.

    ``meets`` tells which pairs count at all. Bounds tighten step by step; only what is left takes the next one.
    """
    i = j = part = None
    before = 0
    for m in steps:
        if i is None:
            part = anchors.y[a, :m] @ rows.y[r, :m].T
            room = anchors.rest[m][a][:, None] * rows.rest[m][r][None, :] + slack * anchors.norm[a][:, None] * rows.norm[r][None, :]
            i, j = np.nonzero(meets & (part + room >= low[:, None]) & (part - room <= high[:, None]))
            part = part[i, j]
        else:
            keep = np.zeros(len(i), bool)
            for at in range(0, len(i), PAIRS):
                s = slice(at, at + PAIRS)
                p, q = a[i[s]], r[j[s]]
                part[s] += np.einsum("ij,ij->i", anchors.y[p, before:m], rows.y[q, before:m])
                room = anchors.rest[m][p] * rows.rest[m][q] + slack * anchors.norm[p] * rows.norm[q]
                keep[s] = (part[s] + room >= low[i[s]]) & (part[s] - room <= high[i[s]])
            i, j, part = i[keep], j[keep], part[keep]
        before = m
    return i, j


def _exact(anchors: Rotated, rows: Rotated, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = np.empty(len(p), np.int64)
    for at in range(0, len(p), PAIRS):
        s = slice(at, at + PAIRS)
        out[s] = (anchors.x[p[s]] * rows.x[q[s]]).sum(1)
    return out


def _positives(anchors: Rotated, rows: Rotated, anchor_ids, row_ids, anchor_labels, row_labels, steps, slack, k) -> Best:
    best = Best(len(anchors.x), k)
    for label in np.unique(anchor_labels):
        mine, theirs = np.flatnonzero(anchor_labels == label), np.flatnonzero(row_labels == label)
        for at in range(0, len(mine), TILE_ANCHORS):
            a = mine[at : at + TILE_ANCHORS]
            # Small tiles first: they set a bar that most pairs of the later ones fail.
            lo, width = 0, 4 * k
            while lo < len(theirs):
                r = theirs[lo : lo + width]
                meets = anchor_ids[a][:, None] != row_ids[r][None, :]
                i, j = _survivors(anchors, rows, a, r, steps, slack, best.least[a], np.full(len(a), np.inf), meets)
                p, q = a[i], r[j]
                best.add(p, q, _exact(anchors, rows, p, q), row_ids[q])
                lo, width = lo + width, min(4 * width, TILE_ROWS)
    return best


def _negatives(anchors: Rotated, rows: Rotated, anchor_ids, row_ids, anchor_labels, row_labels, low, high, steps, slack, k) -> Best:
    """``low`` and ``high``: a column for each positive of an anchor, low above high where there is none."""
    n, width_of = low.shape
    best = Best(n * width_of, k)
    for at in range(0, n, TILE_ANCHORS):
        a = np.arange(at, min(at + TILE_ANCHORS, n))
        lo, width = 0, 4 * k
        while lo < len(row_ids):
            r = np.arange(lo, min(lo + width, len(row_ids)))
            floor = np.maximum(low[a], best.least.reshape(n, width_of)[a])
            floor = np.where(low[a] > high[a], np.inf, floor)
            meets = (anchor_labels[a][:, None] != row_labels[r][None, :]) & (anchor_ids[a][:, None] != row_ids[r][None, :])
            i, j = _survivors(anchors, rows, a, r, steps, slack, floor.min(1), np.where(low[a] > high[a], -np.inf, high[a]).max(1), meets)
            p, q = a[i], r[j]
            score = _exact(anchors, rows, p, q)
            for w in range(width_of):
                fits = (score >= floor[i, w]) & (score <= high[p, w])
                best.add(p[fits] * width_of + w, q[fits], score[fits], row_ids[q[fits]])
            lo, width = lo + width, min(4 * width, TILE_ROWS)
    return best


def _axes(rows: DataFrame, dim: int, scale: int) -> np.ndarray:
    """Orthogonal principal axes of all rows, greatest first, as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = integers(batch.column(0), dim, scale).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["at", "line"])
        give_back()

    lines = rows.select("v").mapInArrow(run, "at int, line array<double>").select("at", F.posexplode("line").alias("by", "x"))
    found = np.zeros((dim, dim))
    for r in lines.groupBy("at", "by").agg(F.sum("x").alias("x")).collect():  # length^2 numbers
        found[r["at"], r["by"]] = r["x"]
    _, axes = np.linalg.eigh((found + found.T) / 2 / max(1.0, float(np.abs(found).max(initial=0.0))))
    return axes[:, ::-1].copy()


def _blocks(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``shard`` and ``block``, each row copied to where it is needed."""
    n, asked = rows.count(), anchors.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(n // SHARD_ROWS + 1, min(cores, n // 1024 + 1))
    blocks = asked // BLOCK_ANCHORS + 1
    # Dealt by place: no id, label or vector is hot.
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    left = rows.withColumn("shard", dealt).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # Both sides come from one table: new names keep their columns apart.
    return left.select(*(F.col(c).alias(c) for c in left.columns)), right.select(*(F.col(c).alias(c) for c in right.columns))


def _labels(own: pa.Table, asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Labels of any type as small numbers, alike on both sides."""
    both = pa.chunked_array([*own.column("label").chunks, *asked.column("label").chunks], own.schema.field("label").type).combine_chunks().dictionary_encode()
    codes = (both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both).indices.to_numpy(zero_copy_only=False)
    return codes[: len(own)], codes[len(own) :]


def _matrix(table: pa.Table, dim: int, scale: int) -> np.ndarray:
    return integers(table.column("v").combine_chunks(), dim, scale)


def usable(vectors: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """``id, v, label`` of the rows that take part, and the vectors' length."""
    kept = vectors.where(finite(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), label.alias("label"))
    return equally_long(kept.where(F.col("label").isNotNull()))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, between: tuple[int, int] = (FROM, TO), scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank``.

    ``is_anchor`` is an expression over ``id`` (the key), ``label`` one over the columns of the table.
    """
    bound_batches(vectors.sparkSession)
    rows, dim = usable(vectors, label, key, vector)
    anchors = rows.where(is_anchor & F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("v", "label")).alias("a")).select("id", "a.v", "a.label")
    axes = _axes(rows, dim, scale)
    steps, slack = steps_of(dim), slack_of(axes)
    kept = positives

    def sides(own: pa.Table, asked: pa.Table):
        own_ids = own.column("id").fill_null(NULL_ID).to_numpy()
        row_labels, anchor_labels = _labels(own, asked)
        sides = Rotated(_matrix(asked, dim, scale), axes, steps), Rotated(_matrix(own, dim, scale), axes, steps)
        return *sides, asked.column("id").to_numpy(), own_ids, anchor_labels, row_labels

    def find_positives(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(own) or not len(asked) or not dim:
            return _result([], [], [], [], own, asked)
        left, right, anchor_ids, row_ids, anchor_labels, row_labels = sides(own, asked)
        best = _positives(left, right, anchor_ids, row_ids, anchor_labels, row_labels, steps, slack, kept)
        give_back()
        return _result(best.slot, best.row, np.zeros(len(best.slot), np.int64), best.score, own, asked)

    def find_negatives(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(own) or not len(asked) or not dim:
            return _result([], [], [], [], own, asked)
        left, right, anchor_ids, row_ids, anchor_labels, row_labels = sides(own, asked)
        low, high = np.full((len(asked), kept), 1, np.int64), np.zeros((len(asked), kept), np.int64)
        for i, scores in enumerate(asked.column("scores").to_pylist()):
            for w, score in enumerate(scores):
                low[i, w], high[i, w] = -(-between[0] * score // 100), between[1] * score // 100
        best = _negatives(left, right, anchor_ids, row_ids, anchor_labels, row_labels, low, high, steps, slack, negatives)
        give_back()
        return _result(best.slot // kept, best.row, best.slot % kept, best.score, own, asked)

    def searched(asked: DataFrame, find) -> DataFrame:
        left, right = _blocks(rows, asked)
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(find, "anchor_id long, slot int, id long, score long")

    found = searched(anchors, find_positives)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    near = found.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < positives)
    near = stored(near.select("anchor_id", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))  # read twice below
    scores = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    asked = anchors.join(scores.withColumnRenamed("anchor_id", "id"), "id")
    hard = searched(asked, find_negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    met = ranked.join(near, ["anchor_id", "slot"])
    return met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", (F.col("slot") + 1).cast("int").alias("positive_rank"))


def _result(slot, row, which, score, own: pa.Table, asked: pa.Table) -> pa.Table:
    slot, row = pa.array(np.asarray(slot, np.int64)), pa.array(np.asarray(row, np.int64))
    return pa.table({
        "anchor_id": asked.column("id").take(slot).cast(pa.int64()),
        "slot": pa.array(np.asarray(which, np.int32), pa.int32()),
        "id": own.column("id").take(row).cast(pa.int64()),
        "score": pa.array(np.asarray(score, np.int64), pa.int64()),
    })
