"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelumen.llm import hard_negatives
from pagelumen.llm.queries import op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, noisy=True):
    good = [(i, v, y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, v, _ in good), default=0)
    good = [(i, [math.floor(256 * x) for x in v] + [0] * (dim - len(v)), (y + 1) % 10 if noisy and i is not None and i % 7 == 0 else y, v) for i, v, y in good]
    order = lambda s: (-s[0], s[1] is None, s[1])
    anchors = {}
    for i, v, y, raw in sorted((r for r in good if r[0] is not None and r[0] % every == 0), key=lambda r: (r[0], r[3], r[2])):
        anchors.setdefault(i, (v, y))
    out = []
    for a, (v, y) in anchors.items():
        scored = [(sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, w, z, _ in good if i != a]
        best = sorted((s for s in scored if s[2] == y), key=order)[:5]
        for place, (p, pid, _) in enumerate(best):
            hard = sorted((s for s in scored if s[2] != y and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:3]
            out += [(a, place + 1, pid, n + 1, i, p, s) for n, (s, i, _) in enumerate(hard)]
    return sorted(out, key=repr)


COLUMNS = ("anchor_id", "positive_rank", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def rows_of(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


def mined(frame, every=50):
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows_of(hard_negatives.mine(frame, F.col("id") % every == 0, noisy))


def test_whole_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert rows_of(op12_hard_negatives(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("many", [False, True])
def test_ties_shards_and_blocks(spark, monkeypatch, many):
    if many:
        for name, n in (("SHARD_ROWS", 90), ("BLOCK_ANCHORS", 7), ("TILE_ANCHORS", 3), ("TILE_ROWS", 40), ("PAIRS", 50)):
            monkeypatch.setattr(hard_negatives, name, n)
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + rng.choice([0, 0, 0.5, -0.25]))) for c in rng.choice(centres)], rng.choice([0, 1, 1, 1, 2, 9])) for i in range(500)]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(4), every=20) == brute(rows, every=20)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [0.5, 2.0], 2), (50, [0.0, 0.0], 3), (1, [1.0, 2.0], 1), (2, [0.9, 1.6], 5), (2, [0.9, 1.6], 5), (3, [0.9, 1.5, 0.0], 4), (None, [1.0, 1.9], 1), (None, [0.8, 1.5], 6), (4, [0.7], 1), (5, [], 3), (6, None, 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [1.0, 2.0], None), (100, [-1.0, -2.0], 7), (12, [1.0, 2.0], 7), (13, [1e3, 1e3], 1), (14, [-0.001, 0.001], 8)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("slot", F.lit("x")).withColumn("v", F.lit(1)).withColumn("shard", F.lit(0)).withColumn("id", F.lit(3))
    assert mined(frame) == brute(rows)
    assert mined(frame.limit(0)) == [] and mined(frame.where("vec_id = 6")) == [] and mined(frame.where("vec_id in (1, 2)")) == []


def test_bounds_hold_and_discard(spark):
    """Every pair's score lies within the bound of each step, and most pairs are gone before the last one."""
    rng = np.random.default_rng(4)
    basis = rng.standard_normal((6, 32))
    x = np.floor(256 * (rng.standard_normal((400, 6)) @ basis / 10 + 0.01 * rng.standard_normal((400, 32)))).astype(np.int64)
    _, axes = np.linalg.eigh((x.T @ x).astype(float))
    axes, steps = axes[:, ::-1].copy(), hard_negatives.steps_of(32)
    slack, r = hard_negatives.slack_of(axes), hard_negatives.Rotated(x, axes, steps)
    exact = x @ x.T
    for m in steps:
        part = r.y[:, :m] @ r.y[:, :m].T
        assert (np.abs(exact - part) <= np.outer(r.rest[m], r.rest[m]) + slack * np.outer(r.norm, r.norm)).all()
    every = np.arange(400)
    bar = np.sort(exact, axis=1)[:, -6].astype(float)
    i, j = hard_negatives._survivors(r, r, every, every, steps, slack, bar, np.full(400, np.inf), np.ones((400, 400), bool))
    assert set(map(tuple, np.argwhere(exact >= bar[:, None]))) <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(i) < 400 * 400 / 4
