import random

import pytest
from pyspark.sql import functions as F

from pagelumen.llm import language_id
from pagelumen.llm.common import table
from tests.llm.fixtures import docs


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 8, 30, 64):
        words = language_id.codewords(n)
        gaps = [(words[i] != words[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (1 if n == 2 else 2)
        assert (abs(words.sum(0)) < n).all()
    assert language_id.codewords(1).shape == (1, 0)


def test_held_out_accuracy(spark):
    frame = table(spark, "/root/testdata/sf0.01", "documents")
    codes = language_id.learn(frame, usable=language_id.fold() != 1)
    found = language_id.identify(frame, codes).where(language_id.fold() == 1).where(F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    assert found.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_edges(spark):
    frame = docs(spark, [None, "", "12 34 !!", "the and of this", "the and of this"], "score")
    codes = language_id.Codes([("de", "der und die das ist nicht"), ("en", "the and of this that with"), ("fr", "le la les une est dans")])
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(frame, codes).collect()}
    assert [out[i] for i in range(3)] == [("und", 0.0)] * 3
    assert out[3][0] == "en" and out[3] == out[4]
    nothing = language_id.learn(frame.where("false"))
    assert {r.lang_pred for r in language_id.identify(frame, nothing).collect()} == {"und"}
    one = language_id.Codes([("en", "some words")])
    assert one.predict(["anything"])[0] == ["en"]


def test_every_language_is_learned(spark, monkeypatch):
    rng = random.Random(5)
    vocabularies = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(30)] for i in range(90)}
    # The first languages have more rows than the rest.
    rows = [(f"{lang}-{k}", " ".join(rng.choices(words, k=60)), lang) for lang, words in vocabularies.items() for k in range(5 if lang < "l64" else 3)]
    codes = language_id.learn(spark.createDataFrame(rows, "doc_id string, text string, lang string"))
    assert codes.languages == sorted(vocabularies)
    fresh = [(" ".join(rng.choices(words, k=60)), lang) for lang, words in vocabularies.items()]
    assert sum(p == lang for p, (_, lang) in zip(codes.predict([t for t, _ in fresh])[0], fresh, strict=True)) >= 88
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 89)
    with pytest.raises(ValueError, match="89"):
        language_id.learn(spark.createDataFrame(rows, "doc_id string, text string, lang string"))


def test_rows_of_one_key_and_copies_teach(spark):
    english, french = "the cat and the dog went over the hill with them", "le chat et la souris sont dans les bois avec eux"
    rows = [(7, f"{english} {i}", "en") for i in range(2000)] + [(7, french, "fr")] * 2000
    codes = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert codes.languages == ["en", "fr"]
    assert codes.predict([english, french])[0] == ["en", "fr"]
    rows = [(None, english, "en")] * 1000 + [(None, french, "fr")] * 1000
    assert language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["en", "fr"]


def test_long_texts_in_parts(monkeypatch):
    rows = [("en", "the cat and the dog went over the hill with them"), ("fr", "le chat et la souris sont dans les bois avec eux")]
    codes = language_id.Codes(rows)
    whole = codes.predict([rows[0][1] * 40])
    monkeypatch.setattr(language_id, "PART", 50)
    parts = codes.predict([rows[0][1] * 40])
    assert whole[0] == parts[0] and abs(whole[1][0] - parts[1][0]) < 1e-9
    assert abs(language_id.Codes(rows).weights - codes.weights).max() < 1e-6


def test_decoding_against_a_plain_loop(spark):
    import math

    frame = table(spark, "/root/testdata/sf0.001", "documents")
    codes = language_id.learn(frame)
    texts = [t for (t,) in frame.select("text").collect() if t][:40] + ["a", "é", "x" * 70_000, "Ünd ß 12"]
    langs, scores = codes.predict(texts)
    size = language_id.BUCKETS
    for text, lang, score in zip(texts, langs, scores, strict=True):
        data = b" " + text.encode().translate(language_id.WORD_BYTES) + b"   "
        sums, n = [0.0] * codes.words.shape[1], len(data) - 3
        for at in range(n):
            three = data[at] | data[at + 1] << 8 | data[at + 2] << 16
            four = three | data[at + 3] << 24
            shift = 33 - int(math.log2(size))
            for bucket in ((three * 2654435761 % 2**32) >> shift, ((four * 2246822519 % 2**32) >> shift) + size // 2):
                sums = [s + float(w) for s, w in zip(sums, codes.weights[bucket], strict=True)]
        losses = []
        for word in codes.words:
            loss = 0.0
            for j, sign in enumerate(word):
                z = 3 * (sums[j] / (2 * n) - codes.middle[j]) / codes.spread[j]
                loss += codes.trust[j] * math.log1p(math.exp(-float(sign) * z))
            losses.append(loss)
        best = min(range(len(losses)), key=lambda i: losses[i])
        assert lang == codes.languages[best]
        assert abs(score - 1 / sum(math.exp(losses[best] - x) for x in losses)) < 1e-6


def test_two_thousand_labels_and_long_texts(spark, monkeypatch):
    rng = random.Random(6)
    sounds = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(4000)]
    own = {f"l{i:04}": rng.sample(sounds, 12) for i in range(2000)}
    rows = [(f"{lang}-{k}", " ".join(rng.choices(words, k=25)), lang) for lang, words in own.items() for k in range(2)]
    codes = language_id.learn(spark.createDataFrame(rows, "doc_id string, text string, lang string"))
    assert codes.languages == sorted(own)
    asked = rng.sample(sorted(own), 60)
    assert sum(p == lang for p, lang in zip(codes.predict([" ".join(rng.choices(own[lang], k=40)) for lang in asked])[0], asked, strict=True)) >= 54
    held = []
    monkeypatch.setattr(language_id, "Codes", held.append)
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 50)
    language_id.learn(spark.createDataFrame([(i, f"{i} " + "word " * 100_000, "en") for i in range(5)], "doc_id long, text string, lang string"))
    assert sorted(len(t) for _, t in held[0]) == [50] * 5
