import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from pagelumen.llm import bpe
from tests.llm.fixtures import docs

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(open(PATH, "rb").read(), PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_random_texts_match_the_library(codec, library):
    rng = random.Random(3)
    parts = ["a", "ab", " ", "\n", "\t ", "é", "ß", "中文", "😀", "0", "12", "'s", "!!", "\x1c", "\xa0", "the", "ing", "aaaa", "<|endoftext|>", "́", "=="]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert codec.encode(text) == library.encode_ordinary(text)
    for _ in range(500):
        text = "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(20)) + "".join(rng.choice("aeinrst") for _ in range(80))
        assert codec.encode(text) == library.encode_ordinary(text)


def test_long_repetitive_piece(codec, library):
    for text in ("a" * 5000, "ab" * 3000, "=" * 4000, " " * 3000):
        assert codec.encode(text) == library.encode_ordinary(text)


def test_other_vocabulary_matches_the_library():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.codec(open(path, "rb").read(), PATTERN)
    library = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in ("Größenwahn für alle", "ещё один текст", "naïve café", "日本語の文章です"):
        assert own.encode(text) == library.encode_ordinary(text)


def test_round_trip_rows(spark, codec, library):
    texts = [None, "", "plain words", "plain words", "x" * 20000, "tab\tß\n"]
    out = {r.doc_id: r for r in bpe.round_trip(docs(spark, texts, "N_Tokens"), PATH, PATTERN).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert out[i].source == f"src{i % 3}"


def test_encode_gives_ids_and_empty_table(spark, library):
    frame = docs(spark, ["hello world", None])
    assert {r.doc_id: r.ids for r in bpe.encode(frame, PATH, PATTERN).collect()} == {0: library.encode_ordinary("hello world"), 1: []}
    assert bpe.encode(frame.limit(0), PATH, PATTERN).count() == 0
