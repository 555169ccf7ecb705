"""Line dedup against a plain loop."""

import hashlib
import random

import pytest
from tests.llm.fixtures import docs
from pyspark.sql import functions as F

from pagelumen.llm import line_dedup
from pagelumen.llm.queries import op13_line_dedup

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows):
    """Rows of (doc_id, text) to (text, n_lines, n_dropped), in their order."""
    last = float("inf")
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), last), last if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (last if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def made():
    rng = random.Random(3)
    pool = [f"{'Common' if i % 3 else 'common'} line number {i}" for i in range(40)] + ["short", "", " \t ", "123456789", "1234567890", "zehn Zeichen üß", "ÀÉ not lowered ÀÉ", "àé not lowered àé"]
    texts = ["\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool) + rng.choice(["", "\r", " \x0b"]) for _ in range(rng.randrange(1, 25))) for _ in range(120)]
    tail = "trailing space before a separator  "
    return [None, "", "\n", "\n\n", tail, tail.rstrip(" "), *texts, "\n".join(["very common line here"] * 3), *["very common line here\nunique %d tail" % i for i in range(300)], "x" * 200_000 + "\nvery common line here"]


def result(frame, **more):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.deduplicated(frame, **more).collect()), key=repr)


@pytest.mark.parametrize("heavy", [1000, 1])
def test_against_a_loop(spark, monkeypatch, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)  # most hashes are streamed, or most are judged where they lie
    texts = made()
    assert result(docs(spark, texts)) == sorted(brute(list(enumerate(texts))), key=repr)


def test_bitmaps_without_texts(spark):
    texts = made()
    want = {i: (n, d) for i, _, n, d in brute(list(enumerate(texts)))}
    got = {r.doc_id: r for r in line_dedup.bitmaps(docs(spark, texts)).collect()}
    assert {i: (r.n_lines, r.n_dropped) for i, r in got.items()} == want
    for i, text, _, _ in brute(list(enumerate(texts))):
        lines = (texts[i] or "").split("\n")
        assert "\n".join(x for run in got[i].keep for x in lines[run.first : run.first + run.n]) == text


def test_null_and_repeated_ids(spark):
    a, b = "one line of text\nanother one", "another one\nmy own line, long"
    rows = [(None, a), (None, b), (7, a), (7, a), (7, b), (9, b), (3, "another one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("theirs")).withColumn("t", F.lit(1)).withColumn("n_lines", F.lit("x")).withColumn("row", F.lit("r"))
    assert result(frame) == sorted(brute(rows), key=repr)
    out = line_dedup.deduplicated(frame)
    assert out.columns == ["doc_id", "h", "t", "row", "text", "n_lines", "n_dropped"]
    assert {tuple(r) for r in out.select("h", "t", "row").collect()} == {("theirs", 1, "r")}
    assert line_dedup.deduplicated(frame.limit(0)).count() == 0
    assert line_dedup.bitmaps(frame.limit(0)).count() == 0


def test_query_without_python(spark, sf_dir):
    frame = op13_line_dedup(spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in frame.collect()} == want
