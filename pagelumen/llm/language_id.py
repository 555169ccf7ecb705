"""Language identification by error-correcting output codes.

Every language has a codeword of plus and minus ones. For each bit a binary classifier over hashed byte
n-grams (log-odds of the n-gram under the languages on either side) predicts its sign; decoding adds up,
over the bits, the logistic loss of each codeword's sign against the classifier's margin, weighted by the
bit's accuracy in training, and chooses the codeword of least loss. A close second flags ambiguity.

Training uses a sample of labelled rows: about ``SAMPLE_EACH`` rows of least hash of key and text for every
language, and one at least; copies of one row count once. Of each the first ``SAMPLE_CHARS`` characters teach, or fewer where there are so many
languages that all together would pass ``SAMPLE_ALL``; that bounds what the driver holds, besides a table of buckets by bits.
Every label is learned. ``MOST_LANGUAGES``, several times the number of written languages, bounds the codewords; more different labels are
no languages, and an error. Prediction reads the whole of every text.

Cases: null text, or text without a letter, is ``und`` with score 0; rows with a null language teach
nothing; with no labelled row at all every text is ``und``; repeated rows and ties in hash are harmless
(the sample stays bounded, ties between codewords go to the first language by name); an empty table gives
an empty result; input columns with an output's name are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelumen.llm.common import WORD_BYTES, annotate, grouped_by_size

SAMPLE_EACH, MOST_LANGUAGES = 300, 32_768
SAMPLE_CHARS, SAMPLE_ALL = 10_000, 1 << 26
BUCKETS, PART = 1 << 15, 1 << 16
UND = "und"
#: Posterior of the best language below which a text is ambiguous.
SURE = 0.6
_LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int) -> np.ndarray:
    """n rows of signs: all distinct splits for few languages, else the best of some seeded random tables."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        splits = [[1, *(1 if s >> i & 1 else -1 for i in range(n - 1))] for s in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.int8).T
    rng, bits = np.random.default_rng(7), int(np.ceil(8 * np.log2(n)))
    best, best_gap = None, -1
    for _ in range(max(1, 40 * 1024 // max(n, 1024))):
        table = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        table[:, np.abs(table.sum(0)) == n] *= np.where(np.arange(n) == 0, -1, 1)[:, None].astype(np.int8)
        gap = _least_distance(table)
        if gap > best_gap:
            best, best_gap = table, gap
    return best


def _least_distance(table: np.ndarray) -> float:
    """In how many bits the two nearest codewords differ; block by block, as all pairs of many words would not fit."""
    signs, (n, bits) = table.astype(np.float32), table.shape
    least = float(bits)
    for at in range(0, n, 1024):
        apart = (bits - signs[at : at + 1024] @ signs.T) / 2
        apart[np.arange(len(apart)), at + np.arange(len(apart))] = bits
        least = min(least, float(apart.min()))
    return least


def _ngrams(data: np.ndarray) -> np.ndarray:
    """Hashes of the 3-byte and (in the other half of the buckets) 4-byte strings at each position."""
    x = data.astype(np.uint32)
    three = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16)
    four = three | x[3:] << np.uint32(24)
    half = np.uint32(34 - BUCKETS.bit_length())
    return np.concatenate([(three * np.uint32(2654435761)) >> half, ((four * np.uint32(2246822519)) >> half) + np.uint32(BUCKETS // 2)])


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of all n-grams, for a long text part by part, so that arrays over them stay small."""
    for at in range(0, len(data) - 3, PART):
        yield _ngrams(data[at : at + PART + 3])


def _prepared(text: str) -> bytes:
    return b" " + text.encode().translate(WORD_BYTES) + b"   "


class Codes:
    """Trained classifiers and codewords."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in rows})
        self.words = codewords(len(self.languages))
        number = {lang: i for i, lang in enumerate(self.languages)}
        texts = [(number[lang], np.frombuffer(_prepared(text), np.uint8)) for lang, text in rows if text]
        by_language: list[list[np.ndarray]] = [[] for _ in self.languages]
        for i, data in texts:
            by_language[i].append(data)
        bits = self.words.shape[1]
        # A language's rates are added to either side of each bit and let go: a table of buckets by bits, whatever the number of languages.
        plus, minus = np.zeros((BUCKETS, bits)), np.zeros((BUCKETS, bits))
        for i, own in enumerate(by_language):
            counts = np.zeros(BUCKETS)
            for data in own:
                for part in _parts(data):
                    counts += np.bincount(part, minlength=BUCKETS)
            seen = np.flatnonzero(counts)
            rates = counts[seen] / max(counts.sum(), 1)
            for side, sign in ((plus, 1), (minus, -1)):
                side[np.ix_(seen, np.flatnonzero(self.words[i] == sign))] += rates[:, None]
        plus /= np.maximum((self.words == 1).sum(0), 1)
        minus /= np.maximum((self.words == -1).sum(0), 1)
        self.weights = np.log((plus + 1e-6) / (minus + 1e-6)).astype(np.float32)
        self.middle, self.spread, self.trust = np.zeros(bits), np.ones(bits), np.ones(bits)
        if bits and texts:
            margins = np.array([self._margins(d) for _, d in texts])
            signs = self.words[[i for i, _ in texts]]
            for j in range(bits):
                means = [margins[signs[:, j] == s, j].mean() if (signs[:, j] == s).any() else 0.0 for s in (1, -1)]
                self.middle[j] = (means[0] + means[1]) / 2
                self.spread[j] = max((means[0] - means[1]) / 2, 1e-6)
                right = (np.sign(margins[:, j] - self.middle[j]) == signs[:, j]).mean()
                self.trust[j] = max(2 * right - 1, 0.01)

    def _margins(self, data: np.ndarray) -> np.ndarray:
        """Mean weight of the text's n-grams, by bit."""
        return sum(self.weights[part].sum(0, dtype=np.float64) for part in _parts(data)) / (2 * (len(data) - 3))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss-weighted decoding: number of the best language, and its posterior."""
        z = 3.0 * (margins - self.middle) / self.spread
        # The loss of a bit is one of two values, whichever sign the codeword has there.
        loss = (np.logaddexp(0, -z) * self.trust) @ (self.words == 1).T + (np.logaddexp(0, z) * self.trust) @ (self.words == -1).T
        posterior = np.exp(loss.min(1, keepdims=True) - loss)
        posterior /= posterior.sum(1, keepdims=True)
        best = loss.argmin(1)
        return best, posterior[np.arange(len(best)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        for group in grouped_by_size((_prepared(texts[i]) for i in rows), 1 << 18):
            if not self.words.shape[1]:
                margins = np.zeros((len(group), 0))
            else:
                margins = np.array([self._margins(np.frombuffer(d, np.uint8)) for _, d in group], np.float64)
            for (k, _), lang, score in zip(group, *self.decode(margins), strict=True):
                langs[rows[k]], scores[rows[k]] = self.languages[lang], float(score)
        return langs, scores


def learn(df: DataFrame, usable: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Codes:
    """Trains on a sample of the rows for which ``usable`` holds, with every language among them."""
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if usable is None else usable))
    # By key and text: rows that share a key don't fall in or out together.
    h = F.xxhash64(F.lit("language"), F.col(key).cast("string"), F.col(text).cast("string"))
    counts = known.groupBy(lang).agg(F.count("*").alias("n"), F.min(h).alias("first")).limit(MOST_LANGUAGES + 1).collect()
    if not counts:
        return Codes([])
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels in {lang}")
    # Hashes are uniform, so a share of their range holds about that share of a language's rows: no ranking.
    edges = {r[0]: -(1 << 63) + min((1 << 64) * SAMPLE_EACH // r.n, (1 << 64) - 1) for r in counts}
    edges = {r[0]: max(edges[r[0]], r["first"]) for r in counts}  # at least one row of each
    chars = max(1, min(SAMPLE_CHARS, SAMPLE_ALL // (SAMPLE_EACH * len(edges))))
    last = df.sparkSession.createDataFrame(sorted(edges.items()), T.StructType([T.StructField("_lang", df.schema[lang].dataType), T.StructField("_last", T.LongType())]))
    near = known.select(F.col(lang).alias("_own"), F.substring(F.col(text).cast("string"), 1, chars).alias("_text"), h.alias("_h")).join(F.broadcast(last), F.col("_own") == F.col("_lang")).where(F.col("_h") <= F.col("_last"))
    # Copies of one row have one hash; a row of each is enough, and keeps the sample bounded. Twice what is to be expected is a bound that
    # isn't met by chance; beyond it the rows of least hash would count.
    rows = near.groupBy("_own", "_h").agg(F.min("_text").alias("_text")).orderBy("_h", "_own").limit(2 * SAMPLE_EACH * len(edges)).collect()
    return Codes([(r[0], r["_text"]) for r in rows])


_FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def identify(df: DataFrame, codes: Codes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``."""
    held = df.sparkSession.sparkContext.broadcast(codes)  # bounded: buckets times bits

    def batch(column: pa.Array) -> dict[str, pa.Array]:
        langs, scores = held.value.predict(column.to_pylist())
        return {
            "lang_pred": pa.array(langs, pa.string()),
            "score": pa.array(scores, pa.float64()),
            "ambiguous": pa.array([s < SURE for s in scores], pa.bool_()),
        }

    return annotate(df, batch, _FIELDS, text, keep)


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 3; rows with 1 are held out. A null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3
