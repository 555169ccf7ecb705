"""Approximate nearest neighbours by collision counting over query-centred windows.

Vectors lie in shards of bounded size. A shard projects its vectors on ``PROJECTIONS`` random directions
and sorts each projection by itself. A query opens, in every sorted array, a window centred on its own
projection, of width ``WIDTH`` times the radius; virtual rehashing widens the windows by widening the
radius, and only what the wider window adds is counted. A vector that lies in the windows of at least
``THRESHOLD`` projections is verified by its exact distance. A shard is done with a query once it has
verified the wanted number of neighbours within the radius (nearer ones have then collided with high
probability: at distance r = radius a projection collides with probability 0.83), or all its vectors.
The best of all shards make the answer.

No list of candidates is capped: windows widen until the stopping rule holds. Every (shard, block of
queries) pair is one bounded group, so no task holds more than a shard and a block.

Cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors meet only
those of their own dimension; exact copies are neighbours at distance 0, ties go to the smaller id; a
query has fewer rows if there are fewer candidates; several query rows with one id count as the least of
them; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, THRESHOLD = 32, 19
WIDTH = 2.719
GROWTH = 1.4
#: Rows of a shard, queries of a block: a vector is sent once a block, a query once a shard, and a group holds both.
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        directions = np.random.default_rng(vectors.shape[1]).standard_normal((vectors.shape[1], PROJECTIONS))
        self.directions = directions
        projected = vectors @ directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected, self.order.T, 0).T.copy()
        # A first radius at which few vectors collide: the scale of gaps between neighbours on a line.
        # Where most vectors are alike, the whole extent sets the scale.
        spread = float(np.median(np.abs(projected - np.median(projected, axis=0))))
        extent = float(np.ptp(projected, axis=0).max(initial=0.0))
        self.first = max(spread / 16, extent / 4096, float(np.abs(projected).max(initial=0.0)) / (1 << 20), 1e-300)

    def nearest(self, query: np.ndarray, k: int, skip: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest found, nearest first, ties to the smaller id; never those of ``skip``."""
        size = len(self.vectors)
        counts = np.zeros(size, np.int64)
        distance = np.full(size, np.nan)
        centre = query @ self.directions
        reach = max(float(np.abs(self.sorted[:, [0, -1]] - centre[:, None]).max()) * 2 / WIDTH, self.first)
        radii = self.first * GROWTH ** np.arange(int(np.ceil(np.log(reach / self.first) / np.log(GROWTH))) + 2)
        half = radii * WIDTH / 2
        lo = np.array([np.searchsorted(s, c - half, "left") for s, c in zip(self.sorted, centre, strict=True)])
        hi = np.array([np.searchsorted(s, c + half, "right") for s, c in zip(self.sorted, centre, strict=True)])
        allowed = size - int(skip.sum())
        for r, radius in enumerate(radii):
            # What the windows gain at this radius: at first all of them, then a strip on either side.
            if r == 0:
                gained = [self.order[j, lo[j, 0] : hi[j, 0]] for j in range(PROJECTIONS)]
            else:
                gained = [self.order[j, lo[j, r] : lo[j, r - 1]] for j in range(PROJECTIONS)]
                gained += [self.order[j, hi[j, r - 1] : hi[j, r]] for j in range(PROJECTIONS)]
            counts += np.bincount(np.concatenate(gained), minlength=size)
            fresh = np.flatnonzero((counts >= THRESHOLD) & np.isnan(distance) & ~skip)
            distance[fresh] = np.sqrt(((self.vectors[fresh] - query) ** 2).sum(1))
            verified = ~np.isnan(distance)
            if int((distance[verified] <= radius).sum()) >= min(k, allowed) or int(verified.sum()) == allowed:
                break
        rows = np.flatnonzero(~np.isnan(distance))
        best = rows[np.lexsort((ids[rows], distance[rows]))][:k]
        return best, distance[best]


def _usable(v: Column) -> Column:
    """Finite, not null, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its k nearest other rows by Euclidean distance."""
    usable = vectors.where(_usable(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    n, asked = usable.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = int(n // SHARD_ROWS) + 1, int(asked // BLOCK_QUERIES) + 1
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")  # by place, so that no id or vector is hot
    rows = usable.select("id", "v", F.size("v").alias("dim"), dealt.alias("shard"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = usable.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def answer(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(own) and len(asked):
            ids = own["id"].to_numpy()
            shard = Shard(np.stack(own["v"].to_numpy()))
            for query_id, q in zip(asked["id"].to_numpy(), asked["v"], strict=True):
                at, distance = shard.nearest(np.asarray(q), k, ids == query_id, ids)
                found += [(query_id, ids[i], d) for i, d in zip(at, distance, strict=True)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    where = ["dim", "shard", "block"]
    found = rows.groupBy(*where).cogroup(queries.groupBy(*where)).applyInPandas(answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
