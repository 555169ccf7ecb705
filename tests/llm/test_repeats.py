import hashlib
import random
from collections import Counter

from pagelumen.llm import repeats
from pagelumen.llm.common import table
from tests.llm.fixtures import docs

LENGTH = repeats.LENGTH


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.blake2b(t[i : i + LENGTH], digest_size=12).digest() for t in data for i in range(len(t) - LENGTH + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - LENGTH + 1):
            if seen[hashlib.blake2b(t[i : i + LENGTH], digest_size=12).digest()] > 1:
                gone[i : i + LENGTH] = b"\x01" * LENGTH
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    frame = docs(spark, texts, "n_spans")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, i


def noise(rng, n, letters="abcdefghij é"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_matches_brute_force(spark):
    rng = random.Random(1)
    passages = [noise(rng, n) for n in (390, 399, 400, 401, 402, 500, 900, 3000)]
    texts = [None, "", "short", "a" * 399, "a" * 400, "a" * 401, "ab" * 600, noise(rng, 400), noise(rng, 700)]
    for _ in range(60):
        texts.append("".join(rng.choice([noise(rng, rng.randint(0, 500)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 300) :]]) for _ in range(rng.randint(1, 5))))
    texts += [texts[-1], texts[-1], texts[-2] + "x", "x" + texts[-3]]
    check(spark, texts)


def test_overlaps_within_a_document(spark):
    rng = random.Random(2)
    a, b = noise(rng, 450), noise(rng, 380)
    check(spark, [a + b + a, b * 4, "".join(rng.choice("01") for _ in range(3000)), ("xyz" * 300) + b + ("xyz" * 200)])


def test_long_texts_in_slices(spark, monkeypatch):
    rng = random.Random(3)
    p = noise(rng, 1500)
    monkeypatch.setattr(repeats, "SLICE", 1000)
    texts = [noise(rng, 2500) + p + noise(rng, 1700) + p, p[100:] + noise(rng, 5000), noise(rng, 30) + p]
    data = [t.encode() for t in texts]
    got = [[] for _ in texts]
    for _, of, _, lo, hi, _ in repeats.anchors(data):
        for i, a, b in zip(of.tolist(), lo.tolist(), hi.tolist(), strict=True):
            got[i] += range(a, b + 1)
    assert [sorted(x) for x in got] == [list(range(len(t) - LENGTH + 1)) for t in data]  # every window once


def test_kept_text_and_names_that_clash(spark):
    rng = random.Random(9)
    p = noise(rng, 500)
    frame = spark.createDataFrame([(1, "before " + p, 8), (2, p + " after", 9), (3, None, 7)], "doc_id long, text string, _pad long").selectExpr("*", "1 as _row", "2 as tid", "3 as f0")
    out = {r.doc_id: r for r in repeats.remove_repeats(frame).collect()}
    assert [out[i].kept_text for i in (1, 2, 3)] == ["before ", " after", ""]
    assert [(out[i]["_pad"], out[i]["_row"], out[i].tid, out[i].f0) for i in (1, 2, 3)] == [(8, 1, 2, 3), (9, 1, 2, 3), (7, 1, 2, 3)]


def test_empty_table(spark):
    assert repeats.remove_repeats(docs(spark, ["a"]).limit(0)).count() == 0


def test_query_on_the_table(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(table(spark, sf_dir, "documents")).collect()}
    for r, want in zip(rows, brute([r.text for r in rows]), strict=True):
        assert got[r.doc_id] == want
