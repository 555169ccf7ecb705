import hashlib
import zlib
from collections import Counter

from pagelumen.llm import sharding
from pagelumen.llm.common import table


def check(rows, shards, inputs):
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted((k or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in inputs)
    counts = Counter(r.shard for r in rows)
    assert all(0 <= s < shards for s in counts)
    sizes = [counts.get(i, 0) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for i in range(shards):
        assert sorted(r.slot for r in rows if r.shard == i) == list(range(sizes[i]))
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)
    for source, n in Counter(s for _, _, s in inputs).items():
        for i in range(shards):
            own = sum(r.shard == i and r.source == source for r in rows)
            assert abs(own - n / shards) <= 2, (source, i)


def brute(inputs, shards, seed=42):
    """(doc_id, size, crc, shard, slot) of all rows, by sorting lists."""
    by_source = {}
    for k, t, source in inputs:
        data = (t or "").encode()
        h = hashlib.md5((f"{seed}:{k}" if k is not None else f"{seed}").encode()).hexdigest()
        by_source.setdefault("" if source is None else f"={source}", []).append((h, k is not None, k or 0, zlib.crc32(data), len(data) + 1))
    rows = []
    for s, own in by_source.items():
        rows += [((rank + 0.5) / len(own), s, rank, row) for rank, row in enumerate(sorted(own))]
    out = []
    for at, (_, _, _, (_, known, k, crc, size)) in enumerate(sorted(rows, key=lambda r: r[:3])):
        shard = at * shards // len(rows)
        out.append((k if known else None, size, crc, shard, at - -(-shard * len(rows) // shards)))
    return out


def same(rows, inputs, shards):
    text = lambda r: tuple(map(str, r))
    assert sorted(map(text, ((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows))) == sorted(map(text, brute(inputs, shards)))


def test_table(spark, sf_dir):
    frame = table(spark, sf_dir, "documents")
    inputs = [(r.doc_id, r.text, r.source) for r in frame.collect()]
    rows = sharding.interleave(frame).collect()
    check(rows, 8, inputs)
    same(rows, inputs, 8)
    again = sharding.interleave(frame.repartition(3)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_edges(spark):
    inputs = [(1, None, None), (1, None, None), (None, "", "a"), (2, "ß", ""), (3, "x" * 5000, "a")] + [(9, "same", "hot")] * 40
    frame = spark.createDataFrame(inputs, "doc_id long, text string, source string").selectExpr("*", "'x' as shard", "'y' as s")
    check(sharding.interleave(frame, 8).collect(), 8, inputs)
    for shards in (1, 3, 8, 64):
        same(sharding.interleave(frame, shards).collect(), inputs, shards)
    check(sharding.interleave(frame.limit(3), 8).collect(), 8, [tuple(r)[:3] for r in frame.limit(3).collect()])
    assert sharding.interleave(frame.limit(0)).count() == 0
