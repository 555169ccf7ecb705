"""Byte-level BPE by backtracking over longest matches.

A merge-by-merge encoder is quadratic in the piece. Here the vocabulary sits in an Aho-Corasick
automaton (bytes mapped to Latin-1 characters), which reports in one pass the longest token that starts
at each position. Tokens are laid greedily, longest first; a token may follow another only if the pair is
*compatible*, that is if merging their joined bytes by rank gives back exactly these two tokens. A
sequence whose neighbours are all compatible is the one the merges produce, and the encoding of each
prefix is unique, so a position from which laying failed can be marked dead and never tried again: the
work is linear in the piece. Compatibility is memoised per pair of tokens.

Cases: null text encodes as the empty text; empty text has no ids and the digest of the empty string;
texts of any length are encoded whole; repeated rows give repeated results; an empty table gives an empty
result; input columns with the name of an output column are replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagelumen.llm.common import annotate

#: Entries a worker's memo may hold before it starts anew.
MEMO_ENTRIES = 200_000
_NEVER = 1 << 60


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Reads a rank file: on each line a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class ByteBpe:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]
        self.split = regex.compile(pattern).findall
        size = len(self.tokens)
        self.left, self.right = [-1] * size, [-1] * size
        self.shorter = [-1] * size
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._automaton = ahocorasick.Automaton()
        reachable: set[bytes] = set()
        for rank, token in enumerate(self.tokens):
            if token and (len(token) == 1 or self._find_parts(rank, token)):
                reachable.add(token)
                self._automaton.add_word(token.decode("latin-1"), rank)
        for token in reachable:
            for cut in range(len(token) - 1, 0, -1):
                if token[:cut] in reachable:
                    self.shorter[ranks[token]] = ranks[token[:cut]]
                    break
        if reachable:
            self._automaton.make_automaton()

    def _find_parts(self, rank: int, token: bytes) -> bool:
        """Finds the two tokens whose merge makes this one; False if merging never makes it."""
        for cut in range(1, len(token)):
            a, b = self.ranks.get(token[:cut], _NEVER), self.ranks.get(token[cut:], _NEVER)
            if a < rank and b < rank and self._whole(a) and self._whole(b) and self._stay_apart(a, b, rank):
                self.left[rank], self.right[rank] = a, b
                return True
        return False

    def _whole(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.left[token] >= 0

    def _stay_apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge with a rank below ``until`` crosses the border between tokens a and b.

        Going back in time, the tokens that touch the border are a and b, then the right part of a or the
        left part of b, whichever of the two was merged later, and so on down to bytes. A crossing merge
        would have come first if its rank is lower than that of the merge which used up its left member,
        or not higher than that of its right member (of equal ranks the leftmost merges first).
        """
        a_used = b_used = until
        rank_of, tokens, left, right = self.ranks.get, self.tokens, self.left, self.right
        while True:
            crossing = rank_of(tokens[a] + tokens[b], _NEVER)
            if crossing < a_used and crossing <= b_used and crossing < until:
                return False
            a_parts, b_parts = right[a] >= 0, left[b] >= 0
            if a_parts and (a > b or not b_parts):
                a_used, a = a, right[a]
            elif b_parts:
                b_used, b = b, left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMO_ENTRIES:
                self._pairs.clear()
            known = self._pairs[key] = self._stay_apart(a, b)
        return known

    def _encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        tokens, shorter = self.tokens, self.shorter
        size = len(data)
        longest = [-1] * size
        for end, token in self._automaton.iter(data.decode("latin-1")):
            longest[end + 1 - len(tokens[token])] = token  # later ends are longer
        laid: list[int] = []
        at = [0]
        dead = bytearray(size + 1)
        token = longest[0]
        while at[-1] < size:
            while token >= 0:
                end = at[-1] + len(tokens[token])
                if not dead[end] and (not laid or self.compatible(laid[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                laid.append(token)
                at.append(end)
                token = longest[end] if end < size else -1
            else:
                dead[at.pop()] = 1
                if not laid:
                    raise ValueError("the vocabulary lacks a byte of the text")
                token = shorter[laid.pop()]
        return tuple(laid)

    def encode(self, text: str) -> list[int]:
        memo, ids = self._pieces, []
        get = memo.get
        for piece in self.split(text):
            got = get(piece)
            if got is None:
                got = self._encode_piece(piece.encode())
                if len(piece) <= 64:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[piece] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def ids_text(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


_built: dict[tuple[bytes, str], ByteBpe] = {}


def codec(data: bytes, pattern: str) -> ByteBpe:
    """The codec of a rank file's bytes, built once in each process."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _built:
        _built[key] = ByteBpe(parse_ranks(data), pattern)
    return _built[key]


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """All input columns and ``ids`` (array of int), the token ids of the whole text."""
    held = df.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())  # fixed size: the vocabulary

    def batch(column: pa.Array) -> dict[str, pa.Array]:
        bpe = codec(held.value, pattern)
        return {"ids": pa.array([bpe.encode(t) for t in _texts(column)], pa.list_(pa.int32()))}

    return annotate(df, batch, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), True))]), text)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes every whole text, decodes the ids again and adds their number and both digests.

    New columns: ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space) and
    ``decoded_sha256`` (of the decoded bytes). Ids never leave the worker, so no array columns cross
    to the JVM.
    """
    held = df.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())  # fixed size: the vocabulary

    def batch(column: pa.Array) -> dict[str, pa.Array]:
        bpe = codec(held.value, pattern)
        counts, ids_sums, text_sums = [], [], []
        for value in _texts(column):
            ids = bpe.encode(value)
            counts.append(len(ids))
            ids_sums.append(hashlib.sha256(bpe.ids_text(ids).encode()).hexdigest())
            text_sums.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sums, pa.string()), "decoded_sha256": pa.array(text_sums, pa.string())}

    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return annotate(df, batch, fields, text, keep)
