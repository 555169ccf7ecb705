"""Product quantisation against plain Python integers."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from pagelumen.llm import vector_codes
from pagelumen.llm.queries import op11_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """By (id, code, error, label_error, digest), with Python's own integers."""
    good = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, v, _ in good), default=0)
    sizes = [dim // parts + (p < dim % parts) for p in range(parts)]
    good = [(i, [math.floor(1024 * x) for x in v] + [0] * (dim - len(v)), y) for i, v, y in good]
    good.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    cut = lambda v: [v[sum(sizes[:p]) : sum(sizes[: p + 1])] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in good[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        held = [{} for _ in range(parts)]
        for _, v, _ in good:
            for p, x in enumerate(cut(v)):
                held[p].setdefault(near(x, books[p])[1], []).append(x)
        for p in range(parts):
            for e, xs in held[p].items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [(i, [near(x, books[p]) for p, x in enumerate(cut(v))], y) for i, v, y in good]
    errors = [(i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), y) for i, n, y in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, d, sum(o for _, _, o, z in errors if z == y), digest) for i, code, d, y in errors), key=repr)


def result(frame):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in vector_codes.compress(frame).collect()), key=repr)


def test_whole_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in op11_vector_codes(spark, sf_dir).collect()), key=repr)
    assert got == brute(rows)


def test_many_vectors_share_entries(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.5, -0.001, 0.0, 0.25, 3.7]) + rng.randrange(3) / 7 for _ in range(8)], rng.choice([1, 2, None])) for i in range(700)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute([(i, [x for x in v], y) for i, v, y in [tuple(r) for r in spark.createDataFrame(rows, SCHEMA).collect()]])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5, -0.5, 2.0, 1.0], 1), (5, [0.5, -0.5, 2.0, 1.0], 1), (None, [9.0, 9.0, 9.0, 9.0, 9.0], None), (1, [1.0], 2), (2, [], 2), (3, None, 2), (4, [1.0, None], 2), (6, [nan] * 4, 2), (7, [inf, 0.0, 0.0, 0.0], 2), (8, [-inf], 2), (9, [-0.25] * 6, None), (9, [0.25] * 6, 3)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("error", F.lit(1)).withColumn("v", F.lit(2))
    assert result(frame) == brute(rows)
    assert vector_codes.compress(frame.limit(0)).count() == 0
    assert vector_codes.compress(frame.where("vec_id = 3")).count() == 0
    alike = spark.createDataFrame([(i, [1.0] * 4, 1) for i in range(300)], SCHEMA)
    assert {r.code for r in vector_codes.compress(alike).collect()} == {"00000000"}


def test_codes_stand_for_near_vectors(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books, dim = vector_codes.train(frame)
    back = vector_codes.decode(vector_codes.encode(frame, books, dim), books).join(frame, "vec_id")
    for r in back.collect():
        away = sum((math.floor(1024 * x) - 1024 * y) ** 2 for x, y in zip(r.embedding, r.approximation, strict=True))
        assert away == r.error
