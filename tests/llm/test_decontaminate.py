import random
import re

import numpy as np
from pyspark.sql import functions as F

from pagelumen.llm import decontaminate as d
from pagelumen.llm.queries import op9_decontaminate
from tests.llm.fixtures import docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "Dé", "e5", "ß", "中"]
    items = [(str(i), rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 10, 14, 40])))) for i in range(6)]
    items[0] = ("0", " ".join(["a"] * 12))
    texts = [None, "", "a " * 300]
    for _ in range(40):
        parts = [rng.choice(vocabulary + ["zz", "!!"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            parts += words(items[rng.randrange(6)][1])[rng.randint(0, 3) :] * rng.randint(1, 3)
        texts.append(" ".join(parts))
    return texts, [(i, t) for i, t in items if i != "1"] if seed % 2 else [(i, t) for i, t in items if len(words(t)) >= 10]


def test_matches_brute_force(spark):
    for seed in range(6):
        texts, items = random_case(seed)
        bench = spark.createDataFrame(items + [("n", None)], "item_id string, text string")
        rows = {r.doc_id: r for r in d.find_passages(docs(spark, texts, "n_words"), bench).collect()}
        for i, want in enumerate(brute(texts, items)):
            got = rows[i]
            assert (got.n_words, sum(s.end - s.first for s in got.hit_spans), got.hit_items) == want, (seed, i)


def test_several_passes_give_the_same(spark, monkeypatch):
    texts, items = random_case(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(d, "PASS_BYTES", 40)
    rows = {r.doc_id: r for r in d.find_passages(docs(spark, texts), bench).collect()}
    for i, want in enumerate(brute(texts, items)):
        assert (rows[i].n_words, sum(s.end - s.first for s in rows[i].hit_spans), rows[i].hit_items) == want


def test_index_locates_every_occurrence():
    rng = np.random.default_rng(0)
    text = np.concatenate([np.append(rng.integers(1, 4, 60), 0) for _ in range(20)])
    index = d.FmIndex(text, 3)
    for n in (1, 3, 5):
        pattern = rng.integers(1, 4, (30, n))
        alive, lo, hi = index.search(pattern)
        found = {int(a): sorted(index.locate(np.arange(x, y)).tolist()) for a, x, y in zip(alive, lo, hi, strict=True)}
        for k, p in enumerate(pattern):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert found.get(k, []) == want


def test_empty_tables_and_removal(spark):
    bench = spark.createDataFrame([("7", "one two three four five six seven eight nine ten eleven")], "item_id string, text string")
    frame = docs(spark, ["keep this. One two, three four five six seven eight nine ten! And this", None, "clean"])
    out = {r.doc_id: r.text for r in d.remove_passages(frame, bench).collect()}
    assert out == {0: "keep this. ! And this", 1: None, 2: "clean"}
    assert d.find_passages(frame.limit(0), bench).count() == 0
    assert d.find_passages(frame, bench.limit(0)).agg(F.sum(F.size("hit_spans"))).first()[0] == 0


def test_query_on_the_table(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in op9_decontaminate(spark, sf_dir).collect()}
    for r, want in zip(texts, brute([r.text for r in texts], items), strict=True):
        got = rows[r.doc_id]
        assert (got.n_words, got.n_hit, got.n_items) == (want[0], want[1], len(want[2]))


def test_items_without_an_id_are_hit(spark):
    bench = spark.createDataFrame([(None, "one two three four five six seven eight nine ten"), ("a", "five six")], "item_id string, text string")
    frame = docs(spark, ["keep one two three four five six seven eight nine ten keep", "five six", "clean"])
    out = {r.doc_id: ([tuple(s) for s in r.hit_spans], r.hit_items) for r in d.find_passages(frame, bench).collect()}
    assert out == {0: ([(1, 11)], ["a"]), 1: ([(0, 2)], ["a"]), 2: ([], [])}
    alone = bench.where("item_id is null")
    assert {r.doc_id: (len(r.hit_spans), r.hit_items) for r in d.find_passages(frame, alone).collect()}[0] == (1, [])
    assert {r.doc_id: r.text for r in d.remove_passages(frame, alone).collect()}[0] == "keep  keep"


def test_names_that_clash(spark, monkeypatch):
    """Extra columns with the names of helpers and of outputs, over several passes."""
    monkeypatch.setattr(d, "PASS_BYTES", 40)
    passage = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(i, f"{passage} item{i}") for i in range(4)], "item_id long, text string")
    frame = spark.createDataFrame([(1, f"start {passage} end", 5)], "doc_id long, text string, _pad long").selectExpr("*", "'s' as _spans", "'i' as _items", "'h' as hit_spans", "4 as _row", "6 as _text")
    row = d.remove_passages(frame, bench).first()
    assert (row["_pad"], row["_spans"], row["_items"], row.hit_spans, row["_row"], row["_text"]) == (5, "s", "i", "h", 4, 6)
    assert row.text == "start  end"
    assert d.remove_passages(frame, bench).columns == frame.columns


def test_a_large_benchmark_fits_one_step():
    import os
    import subprocess
    import sys

    code = """
import resource, sys, numpy as np
from pagelumen.llm import decontaminate as d
rng = np.random.default_rng(1)
words = np.array([f"w{i:06}" for i in range(400_000)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
items = [(str(i), " ".join(rng.choice(words, 2000))) for i in range(1049)]
assert sum(len(t) for _, t in items) > d.PASS_BYTES
windows = d.Windows(items)
assert windows.count > 2_000_000 and windows.owners(5)
found = d._find([items[3][1].encode(), b"w000001 w000002"], windows)
assert set(found[1].tolist()) == {0} and sorted(found[2].tolist()) == list(range(1991))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    path = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": path}, check=True)
    assert int(out.stdout) < 1500
