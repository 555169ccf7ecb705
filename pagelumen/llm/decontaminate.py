"""Benchmark decontamination with an FM-index per training shard.

Documents and benchmark items become sequences of words (A-Z lower-cased; a word is a run of ASCII
letters, digits and non-ASCII characters). A shard of documents is indexed: its word sequence is suffix
sorted by prefix doubling, the Burrows-Wheeler transform goes into a wavelet matrix, and suffix positions
are kept at every ``SAMPLED``-th word. All benchmark windows are searched backwards at once; occurrences
are located by walking to a sampled position and their word spans merged.

Before indexing, two exact reductions: words that no window has, and neighbours that are neighbours in no
window, cannot lie inside an occurrence, so only the stretches between them are indexed, and stretches
are cut into overlapping pieces of bounded length (each occurrence lies whole in one of them), which
bounds the rounds of the suffix sort whatever is repeated.

Cases: null and empty text have no words and no hits; an item of fewer than ``WINDOW`` words is one
window; an item without words has none; repeated items count each; an item with a null
id has hits like the others and is not named; an empty benchmark hits nothing; an
empty table gives an empty result; input columns with an output's name are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelumen.llm.common import WORD_BYTES, annotate, free_name, grouped_by_size, packed_row, stored, unpacked

WINDOW = 10
#: Every so many words a suffix position is kept.
SAMPLED = 8
#: Words of a piece of the indexed text, and bytes of text in a shard.
PIECE, SHARD_BYTES = 96, 8 << 20
#: Bytes of benchmark text that one pass holds, some fifteen times as many in memory. Larger benchmarks take several passes, one after
#: another: what a pass has found is written before the next one begins, so a task never holds the windows of two.
PASS_BYTES = 16 << 20


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


class Windows:
    """The distinct windows of some benchmark items, as sorted arrays of word numbers, and which items have each.

    Arrays throughout: besides the vocabulary a window takes its words' numbers (four bytes each) and eight bytes an owner.
    """

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        texts = [np.array([number(w, len(self.vocabulary) + 1) for w in words_of((text or "").encode())], np.int32) for _, text in items]
        self.names = sorted({item for item, _ in items if item is not None})
        place = {name: i for i, name in enumerate(self.names)}
        owner = [place.get(item, -1) for item, _ in items]
        self.by_length: list[tuple[int, np.ndarray]] = []  # first window's number, windows of one length
        pairs, owned, self.count = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], 0
        base = len(self.vocabulary) + 1
        for length in sorted({min(len(t), WINDOW) for t in texts} - {0}):
            whole = [i for i, t in enumerate(texts) if min(len(t), WINDOW) == length]
            every = np.concatenate([np.lib.stride_tricks.sliding_window_view(texts[i], length) for i in whole])
            own = np.repeat([owner[i] for i in whole], [len(texts[i]) - length + 1 for i in whole])
            same, which = np.unique(every, axis=0, return_inverse=True)
            del every
            owned.append(np.unique(np.stack([which.reshape(-1) + self.count, own], 1)[own >= 0], axis=0))
            pairs += [same[:, i].astype(np.int64) * base + same[:, i + 1] for i in range(length - 1)]
            self.by_length.append((self.count, same))
            self.count += len(same)
        self.shortest = min((same.shape[1] for _, same in self.by_length), default=0)
        self.pairs = np.unique(np.concatenate(pairs))
        # Owners lie one after another, those of a window from owner_from[window] on.
        by_window = np.concatenate(owned)
        self.owner_of = by_window[:, 1].astype(np.int32)
        self.owner_from = np.searchsorted(by_window[:, 0], np.arange(self.count + 1))

    def owners(self, window: int) -> list[str]:
        """The items that have a window, sorted; those with a null id aren't named."""
        return [self.names[i] for i in self.owner_of[self.owner_from[window] : self.owner_from[window + 1]]]


class WaveletMatrix:
    """Rank over a sequence of small numbers: one row of bit counts for each binary digit."""

    def __init__(self, values: np.ndarray, largest: int):
        self.levels: list[tuple[int, int, np.ndarray]] = []
        for shift in range(max(int(largest).bit_length(), 1) - 1, -1, -1):
            bits = (values >> shift & 1).astype(np.int32)
            ones = np.concatenate([np.zeros(1, np.int32), np.cumsum(bits, dtype=np.int32)])
            self.levels.append((shift, len(values) - int(ones[-1]), ones))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the end given with it."""
        first, last = np.zeros_like(ends), ends
        for shift, zeros, ones in self.levels:
            up = (symbols >> shift & 1).astype(bool)
            first = np.where(up, zeros + ones[first], first - ones[first])
            last = np.where(up, zeros + ones[last], last - ones[last])
        return last - first


class FmIndex:
    """Full-text index of pieces of word numbers; each piece ends with a 0."""

    def __init__(self, text: np.ndarray, largest: int):
        self.suffixes = _suffix_array(text)
        size = len(text)
        self.bwt = text[self.suffixes - 1]
        self.before = np.searchsorted(np.sort(text), np.arange(largest + 2))
        self.wavelet = WaveletMatrix(self.bwt, largest)
        starts = np.zeros(size, bool)
        starts[0] = True
        starts[1:] = text[:-1] == 0  # walks never cross a piece's border
        kept = starts[self.suffixes] | (self.suffixes % SAMPLED == 0)
        self.kept = kept
        self.number = np.cumsum(kept) - 1
        self.sampled = self.suffixes[kept]
        del self.suffixes
        self.size = size

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of windows of one length: numbers of those found, first and last row of each."""
        alive = np.arange(len(windows))
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.size, np.int64)
        for j in range(windows.shape[1] - 1, -1, -1):
            c = windows[alive, j]
            lo = self.before[c] + self.wavelet.rank(c, lo)
            hi = self.before[c] + self.wavelet.rank(c, hi)
            there = lo < hi
            alive, lo, hi = alive[there], lo[there], hi[there]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to a sampled position."""
        out = np.zeros(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows, 0
        while len(open_):
            done = self.kept[at]
            out[open_[done]] = self.sampled[self.number[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            c = self.bwt[at]
            at = self.before[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling. Zeros differ by position, so ranks are unique once the offset passes a piece's length."""
    ends = text == 0
    count = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends) - 1, text + count).astype(np.int64)
    offset = 1
    while True:
        behind = np.full(len(rank), 0, np.int64)
        behind[:-offset] = rank[offset:] + 1
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty_like(fresh)
        rank[order] = fresh
        offset *= 2
        if fresh[-1] == len(text) - 1 or offset >= len(text):
            return order


def _stretches(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of word numbers in which a window could occur."""
    known = ids > 0
    linked = np.zeros(len(ids), bool)  # to the next word
    if len(ids) > 1:
        keys = ids[:-1].astype(np.int64) * (len(windows.vocabulary) + 1) + ids[1:]
        both = np.flatnonzero(known[:-1] & known[1:])
        if len(windows.pairs):
            at = np.minimum(np.searchsorted(windows.pairs, keys[both]), len(windows.pairs) - 1)
            linked[both[windows.pairs[at] == keys[both]]] = True
    starts = np.flatnonzero(known & ~np.concatenate([[False], linked[:-1]]))
    ends = np.flatnonzero(known & ~linked) + 1
    long_ = ends - starts >= windows.shortest
    return starts[long_], ends[long_]


def _find(texts: list[bytes], windows: Windows) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """One shard: words per text, and for every occurrence its text, first word and window number."""
    get = windows.vocabulary.get
    split = [words_of(t) for t in texts]
    counts = [len(w) for w in split]
    nothing = np.zeros(0, np.int64)
    if not windows.count:
        return counts, nothing, nothing, nothing
    bounds = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
    ids = np.zeros(bounds[-1], np.int32)  # a 0 stays after each text
    for a, w in zip(bounds.tolist(), split, strict=False):
        ids[a : a + len(w)] = [get(x, 0) for x in w]
    del split
    starts, ends = _stretches(ids, windows)
    if not len(starts):
        return counts, nothing, nothing, nothing
    pieces = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        pieces += [(a, min(a + PIECE, e)) for a in range(s, max(s + 1, e - WINDOW + 1), PIECE - WINDOW + 1)]
    first = np.array([a for a, _ in pieces], np.int64)
    size = np.array([b - a for a, b in pieces], np.int64) + 1
    offset = np.concatenate([[0], np.cumsum(size)])
    origin = np.arange(offset[-1]) - np.repeat(offset[:-1] - first, size)
    text = ids[np.minimum(origin, len(ids) - 1)].astype(np.int64)
    text[offset[1:] - 1] = 0
    index = FmIndex(text, len(windows.vocabulary))
    found: list[np.ndarray] = []
    where: list[np.ndarray] = []
    for number, same in windows.by_length:
        alive, lo, hi = index.search(same)
        many = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        where.append(origin[index.locate(rows)])
        found.append(np.repeat(alive + number, many))
    at, window = np.concatenate(where), np.concatenate(found)
    doc = np.searchsorted(bounds, at, side="right") - 1
    return counts, doc, at - bounds[doc], window


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])
_FIELDS = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(_SPAN)), T.StructField("hit_items", T.ArrayType(T.StringType()))]
)
_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _passes(benchmark: DataFrame, item: str, text: str) -> Iterator[Windows]:
    """The benchmark's windows in passes of about ``PASS_BYTES``, so that what is broadcast stays bounded.

    Parts are dealt by a hash of the item; the driver holds one of them at a time.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.length(F.encode("text", "utf-8")))).first()[0] or 0
    parts = int(size // PASS_BYTES) + 1
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        yield Windows([(r.item, r.text) for r in mine.collect()])


def find_passages(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words``, ``hit_spans`` (merged spans of word numbers) and ``hit_items`` (sorted strings)."""
    context = df.sparkSession.sparkContext
    out, passes = df, 0
    for windows in _passes(benchmark, item, text):
        held = context.broadcast(windows)  # bounded by PASS_BYTES

        def batch(column: pa.Array, held=held) -> dict[str, pa.Array]:
            model, n_words, spans, items = held.value, [], [], []
            firsts = np.repeat([same.shape[1] for _, same in model.by_length], [len(same) for _, same in model.by_length]).astype(np.int64)
            texts = ((v.as_py() or "").encode() for v in column)
            for shard in grouped_by_size(texts, SHARD_BYTES):
                counts, doc, at, window = _find([t for _, t in shard], model)
                n_words += counts
                mine: dict[int, tuple[set, set]] = {}
                for d, s, w in zip(doc.tolist(), at.tolist(), window.tolist(), strict=True):
                    got = mine.setdefault(d, (set(), set()))
                    got[0].add((s, s + int(firsts[w])))
                    got[1].update(model.owners(w))
                for d in range(len(shard)):
                    got = mine.get(d)
                    spans.append([{"first": s, "end": e} for s, e in _merged(list(got[0]))] if got else [])
                    items.append(sorted(got[1]) if got else [])
            return {"n_words": pa.array(n_words, pa.int64()), "hit_spans": pa.array(spans, _ARROW_SPANS), "hit_items": pa.array(items, pa.list_(pa.string()))}

        if not passes:
            out = annotate(df, batch, _FIELDS, text, None if keep is None else [*keep, text])
        else:
            out = stored(out)
            spans, items = free_name(out, "_spans"), free_name(out, "_items")
            out = annotate(out.withColumnsRenamed({"hit_spans": spans, "hit_items": items}), batch, _FIELDS, text)
            out = out.withColumn("hit_items", F.array_sort(F.array_distinct(F.concat(items, "hit_items"))))
            out = out.withColumn("hit_spans", _union(F.concat(spans, "hit_spans"))).drop(spans, items)
        passes += 1
    return out if keep is None or text in keep else out.drop(text)


def _union(spans):
    """Merges an array of spans into disjoint ones."""
    empty = F.array().cast(T.ArrayType(_SPAN))

    def add(done, span):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (span["first"] <= F.get(done, F.size(done) - 1)["end"])
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, add)


def remove_passages(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The same rows and columns, each merged span of hit words cut out of ``text``, with what lies between them."""
    rest = [c for c in df.columns if c != text]
    # Outputs of the search replace input columns of their names in what was found, so those come from the input.
    clash = {c: free_name(df, f"{c}_input") for c in rest if c.lower() in {f.name for f in _FIELDS}}
    found = find_passages(df.withColumnsRenamed(clash), benchmark, text, item)
    packed = found.select(packed_row([clash.get(c, c) for c in rest]), F.col(f"`{text}`").cast("string").alias("_text"), "hit_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [cut(v.as_py(), s.as_py()) if len(s) else v.as_py() for v, s in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string())], ["_row", "_text"])

    schema = T.StructType([packed.schema["_row"], T.StructField("_text", T.StringType())])
    out = packed.mapInArrow(run, schema).select(*unpacked(rest), F.col("_text").alias(text))
    return out.select(*(f"`{c}`" for c in df.columns))


def cut(text: str, spans: list[dict]) -> str:
    """The text without spans of word numbers."""
    data = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(WORD_BYTES))]
    kept, last = [], 0
    for span in spans:
        kept.append(data[last : at[span["first"]][0]])
        last = at[span["end"] - 1][1]
    return b"".join([*kept, data[last:]]).decode()
