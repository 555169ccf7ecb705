import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagelumen.llm import nearest
from pagelumen.llm.common import table


def brute(rows, asked, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for q, v in good:
        if asked(q):
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def test_recall_on_the_table(spark):
    frame = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    got = {}
    for r in nearest.search(frame, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 11))
        assert [found[i] for i in sorted(found)] == sorted(found.values())
        hits += len({i for _, i in found.values()} & {i for _, i in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def test_recall_over_several_shards(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((300, 32))
    vectors = (centres[rng.integers(0, 300, 40_000)] + 0.4 * rng.standard_normal((40_000, 32))).astype(np.float32)
    assert len(vectors) > 4 * nearest.SHARD_ROWS
    flat = pa.array(vectors.ravel())
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, 32), pa.int32()), flat)
    pq.write_table(pa.table({"vec_id": np.arange(40_000), "embedding": column}), f"{tmp_path}/v.parquet")
    got = {}
    for r in nearest.search(spark.read.parquet(f"{tmp_path}/v.parquet"), F.col("vec_id") % 400 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    exact, hits = vectors.astype(float), 0
    assert len(got) == 100
    for q, found in got.items():
        distance = ((exact - exact[q]) ** 2).sum(1)
        distance[q] = np.inf
        hits += len(found & set(np.argsort(distance)[:10].tolist()))
    assert hits / 1000 >= 0.9


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 7)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5), 1.0]) for i in range(30)] + [(40, None), (41, []), (42, [0.0, 0.0]), (43, [1.0, None]), (44, [nan, 1.0]), (45, [inf, 1.0]), (50, [1.0, 2.0, 3.0]), (60, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    want = brute(rows, lambda i: i % 10 == 0)
    got = {}
    for r in nearest.search(frame, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want.pop(50)  # the only vector of its dimension
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    for q in got:
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]])
    assert nearest.search(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_identical_vectors(spark):
    frame = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(50)], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in nearest.search(frame, F.col("vec_id") == 20).orderBy("rank").collect()]
    assert got == [(i, 0.0) for i in range(10)]
