import random

import numpy as np
import pytest

from pagelumen.llm import near_dups as n
from pagelumen.llm.common import table
from pagelumen.llm.components import connected_components
from tests.llm.fixtures import docs


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows, weights):
    """Classes from the exact similarity of every pair of distinct texts that share a shingle."""
    kept = [(k, t) for k, t in rows if t is not None]
    by_text = {}
    for k, t in kept:
        by_text.setdefault(t, []).append(k)
    texts = list(by_text)
    found = [weights.of(h) for h in n.shingles([t.encode() for t in texts])]
    parent, holders = list(range(len(texts))), {}
    for i, (hashes, _) in enumerate(found):
        for h in hashes.tolist():
            holders.setdefault(h, []).append(i)
    tried = set()
    for own in holders.values():
        for i in own:
            for j in own:
                if i < j and (i, j) not in tried:
                    tried.add((i, j))
                    if n.similarity(found[i], found[j]) >= n.SIMILAR:
                        parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, t in enumerate(texts):
        root = find(parent, i)
        least[root] = min(least.get(root, by_text[t][0]), *by_text[t])
    out = {k: k for k, t in rows if t is None}
    for i, t in enumerate(texts):
        out |= {k: least[find(parent, i)] for k in by_text[t]}
    return out


def edited(words, rng, rate):
    return [w if rng.random() > rate else f"new{rng.randrange(999)}" for w in words]


def test_shingles_are_of_five_words_and_ignore_punctuation():
    a, b, c, d, e = n.shingles([b"One, two three four five six", b"one two three four five six!", b"one two", b"", b"one two three four five"])
    assert len(a) == 2 and (a == b).all() and len(c) == 1 and len(d) == 0
    assert e[0] in a
    long_ = b" ".join(b"w%d" % i for i in range(200_000))
    assert len(next(n.shingles([long_]))) == 199_996


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(2)
    sampler, agree, true = n.Sampler(), [], []
    for _ in range(200):
        shared = rng.integers(0, 1 << 63, 170, dtype=np.uint64)
        a = np.sort(np.concatenate([shared, rng.integers(0, 1 << 63, 15, dtype=np.uint64)]))
        b = np.sort(np.concatenate([shared, rng.integers(0, 1 << 63, 15, dtype=np.uint64)]))
        wa, wb = np.ones(len(a)), np.ones(len(b))
        agree.append((sampler.bands(a, wa) == sampler.bands(b, wb)).mean())
        true.append(n.similarity((a, wa), (b, wb)) ** n.ROWS)
    assert abs(np.mean(agree) - np.mean(true)) < 0.05



@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, i) for i in range(201, 240)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        ra, rb = find(parent, a), find(parent, b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(parent, x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(400)]
    texts = [None, None, "", "", "!!", "one two", "one  two.", "three"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 80, 300]))]
        texts += [" ".join(edited(base, rng, rate)) for rate in (0, 0, 0.004, 0.01, 0.02, 0.05, 0.3)]
    group = [rng.choice(vocabulary) for _ in range(150)]
    texts += [" ".join(edited(group, rng, 0.012)) for _ in range(60)]
    frame = docs(spark, texts, "class_id")
    weights = n.learn_weights(frame)
    got = {r.doc_id: r.class_id for r in n.near_duplicates(frame).collect()}
    assert got == brute(list(enumerate(texts)), weights)
    kept = sorted(r.doc_id for r in n.keep_first(frame).collect())
    assert kept == sorted({c for k, c in got.items() if texts[k] is not None} | {0, 1})
    assert n.keep_first(frame).columns == frame.columns
    assert n.near_duplicates(frame.limit(0)).count() == 0


def test_large_loose_groups_match_brute_force(spark, monkeypatch):
    """Buckets above LARGE, with and without the text that the copies were made from."""
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(900)]
    texts = []
    for with_base in (True, False, False):
        base = [rng.choice(vocabulary) for _ in range(150)]
        texts += [" ".join(base)] * with_base
        texts += [" ".join(edited(base, rng, rng.choice([0.005, 0.015, 0.02, 0.03]))) for _ in range(140)]
    frame = docs(spark, texts)
    weights = n.learn_weights(frame)
    want = brute(list(enumerate(texts)), weights)
    reached = []
    own = n._pairs_in_large
    monkeypatch.setattr(n, "_pairs_in_large", lambda *args: reached.append(1) or own(*args))
    assert {r.doc_id: r.class_id for r in n.near_duplicates(frame).collect()} == want
    assert reached
    monkeypatch.setattr(n, "LARGE", 3)
    assert {r.doc_id: r.class_id for r in n.near_duplicates(frame).collect()} == want


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "c", "d" * 70, "efg"]) for _ in range(400)).encode(), b"x" * 500, b"", b"one two"]
    whole = [h.tolist() for h in n.shingles(texts)]
    monkeypatch.setattr(n, "PIECE", 64)
    n._held_powers.clear()
    assert [h.tolist() for h in n.shingles(texts)] == whole
    n._held_powers.clear()


def test_names_that_clash(spark):
    rows = [(1, "a b c d e f g", 8, "x"), (2, "a b c d e f g", 9, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _k long, _tid string").selectExpr("*", "1 as _row", "2 as _of", "3 as best")
    assert [tuple(r) for r in n.keep_first(frame).collect()] == [(1, "a b c d e f g", 8, "x", 1, 2, 3)]


def test_repeated_rows_and_null_keys(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (1, "a b c d e f g"), (1, "h i j k l m"), (1, "h i j k l m"), (2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert n.near_duplicates(frame).count() == 6
    kept = [(r.doc_id, r.text) for r in n.keep_first(frame).collect()]
    assert len(kept) == 3 and {t for _, t in kept} == {"a b c d e f g", "h i j k l m", None}


def test_query_on_the_table(spark):
    frame = table(spark, "/root/testdata/sf0.01", "documents")
    weights = n.learn_weights(frame)
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in n.near_duplicates(frame).collect()} == brute(rows, weights)
