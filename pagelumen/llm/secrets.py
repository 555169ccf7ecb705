r"""Secret scanning: fixed patterns, and formats learned by grammar inference.

The base patterns find assignments, access keys and long hexadecimal runs. Their finds in all documents,
a bounded number of values drawn by hash, are labelled credentials: for each kind a prefix tree over character classes
is built, and states whose outgoing counts are statistically compatible (Hoeffding bound on every
symbol, all the way down) are merged, position by position and then across positions, into a probabilistic automaton. A
background automaton is inferred in the same way from the sample's ordinary tokens. Then every other token
of every document, and what base finds leave of one, is a candidate, of any length and any characters of
the class (lengths at which no string at all could pass are skipped): it is a find of kind ``learned`` if the best credential automaton
gives it a likelihood that beats the background's by a margin set from a stated rate of false finds, and that is one the
format's own strings have. The
unlabelled tokens may hold credentials the patterns miss, so the margin doesn't depend on them, and those
that look like credentials beside a background of one state are left out of the background.

Cases: null and empty text have no spans; texts of any length are scanned whole; repeated rows repeat
their results; with fewer than ``LEAST`` labelled credentials of a kind that kind's automaton is not
built; an empty table gives an empty result; input columns with an output's name are replaced by it.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelumen.llm.common import annotate, bound_batches, give_back, scratch

#: Bounds of the training sample: documents for ordinary tokens, labelled credentials per kind, ordinary tokens.
SAMPLE_DOCS, SAMPLE_EACH, SAMPLE_ORDINARY = 8192, 1000, 4000
#: Characters of a value that are learned from; longer ones count as of this length. Scoring reads all.
SAMPLE_CHARS = 128
LEAST = 8
#: Confidence parameter of the compatibility test: the larger, the more states stay apart.
ALPHA = 0.05
#: Share of a format's own strings that may be left out as odd, and how far below the rest a find's mean log-likelihood may lie.
ODD, FIT_SLACK = 0.02, 0.1
#: Share of background tokens that may pass as finds: an odds ratio above 1/r has at most probability r.
FALSE_RATE = 1e-6

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates, and what one may have in front that isn't part of the credential (a name and an equals sign):
#: both over class symbols.
TOKEN = rb"[0hlHU+/_.=-]{%d,}"
_NAME = re.compile(rb"^[hlHU_.-]{1,40}=+")
_MARKS = b"+/_.=-"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base finds, by start and then by kind.

    Access keys and hexadecimal runs are whole runs of their class, so asking for the least length in the
    pattern finds the same spans as dropping short runs afterwards.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def _symbols(text: str) -> bytes:
    """Digits 0, a-f h, other small letters l, A-F H, other capitals U; the rest of ASCII stands for itself.

    One byte a code point, so positions stay; no character beyond ASCII becomes part of a token.
    """
    return text.encode("latin-1", "replace").translate(_CLASSES)


_CLASSES = bytes(
    next((ord(k) for k, cs in {"0": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}.items() if chr(c) in cs), c)
    for c in range(256)
)


def candidates(text: str, base: list[tuple[int, int, int]], least: int = 1) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, symbols) of the tokens and of the parts of tokens that no base find covers.

    Where a find was cut off, the marks that join it to the rest go too.
    """
    symbols = _symbols(text)
    if base:
        uncovered = bytearray(symbols)
        for s, _, e in base:
            uncovered[s:e] = bytes(e - s)
        symbols = bytes(uncovered)
    ends = {e for _, _, e in base}
    starts = {s for s, _, _ in base}
    for m in re.finditer(TOKEN % least, symbols):
        token, s, e = m.group(), m.start(), m.end()
        if s in ends:
            token = token.lstrip(_MARKS)
            s = e - len(token)
        if e in starts:
            token = token.rstrip(_MARKS)
            e = s + len(token)
        if token:
            yield s, e, token


#: Characters each class stands for: a class's probability is spread over them.
_WIDTH = {ord("0"): 10, ord("h"): 6, ord("l"): 20, ord("H"): 6, ord("U"): 20}
_ALPHABET = b"0hlHU" + _MARKS
_END = ord("$")


class Automaton:
    """A probabilistic automaton inferred from strings by merging compatible prefix-tree states.

    States that equally long beginnings lead to are merged first, level by level: what the strings do at each position is then
    known from many of them. Only then are states of different positions compared. Those of a fixed length or layout differ where the
    end or a mark comes, now or later, and stay apart; those that repeat become loops. Ends are transitions like others.
    """

    def __init__(self, strings: list[str]):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [defaultdict(int)]
        for s in strings:
            state = 0
            for symbol in _symbols(s):
                self.count[state][symbol] += 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                state = self.next[state][symbol]
            self.count[state][_END] += 1
        self._into = list(range(len(self.next)))
        self._merge_levels()
        self._merge_states()
        self.logs: list[dict[int, float]] = []
        for counts in self.count:
            total = sum(counts.values()) + 0.5 * (len(_ALPHABET) + 1)
            self.logs.append({s: math.log((counts.get(s, 0) + 0.5) / total / _WIDTH.get(s, 1)) for s in (*_ALPHABET, _END)})
        self.floor = self._floor(strings)

    def _find(self, state: int) -> int:
        """The state that a merged one has become."""
        while self._into[state] != state:
            self._into[state] = self._into[self._into[state]]
            state = self._into[state]
        return state

    def _alike(self, a: int, b: int) -> bool:
        """Whether two states' behaviour could be the same: Hoeffding's bound at every pair of states below."""
        todo, met = [(a, b)], set()
        while todo:
            a, b = map(self._find, todo.pop())
            if a == b or (a, b) in met:
                continue
            met.add((a, b))
            x, y = self.count[a], self.count[b]
            n, m = sum(x.values()), sum(y.values())
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(x.get(s, 0) / n - y.get(s, 0) / m) > bound for s in x.keys() | y.keys()):
                return False
            todo += [(t, self.next[b][s]) for s, t in self.next[a].items() if s in self.next[b]]
        return True

    def _merge(self, a: int, b: int) -> None:
        """Makes two states one, and what follows on either with what follows by the same symbol on the other."""
        todo = [(a, b)]
        while todo:
            a, b = map(self._find, todo.pop())
            if a == b:
                continue
            self._into[b] = a
            for s, n in self.count[b].items():
                self.count[a][s] += n
            for s, t in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], t))
                else:
                    self.next[a][s] = t

    def _after(self, states: list[int]) -> list[int]:
        """The successors of states, each once, in order of their symbols."""
        return list(dict.fromkeys(self._find(self.next[r][s]) for r in states for s in sorted(self.next[r])))

    def _merge_levels(self) -> None:
        level = [0]
        while level:
            own: list[int] = []
            for state in sorted(self._after(level), key=lambda k: (-sum(self.count[k].values()), k)):
                state = self._find(state)
                if state in own:
                    continue
                twin = next((r for r in own if self._alike(r, state)), None)
                if twin is None:
                    own.append(state)
                else:
                    self._merge(twin, state)
            level = list(dict.fromkeys(map(self._find, own)))

    def _merge_states(self) -> None:
        red = [0]
        while blue := [t for t in self._after(red) if t not in red]:
            twin = next((r for r in red if self._alike(r, blue[0])), None)
            if twin is None:
                red.append(blue[0])
            else:
                self._merge(twin, blue[0])
                red = list(dict.fromkeys(map(self._find, red)))
        number = {s: i for i, s in enumerate(red)}
        self.next = [{s: number[self._find(t)] for s, t in self.next[r].items()} for r in red]
        self.count = [self.count[r] for r in red]

    def _floor(self, strings: list[str]) -> float:
        """The mean log-likelihood a symbol that a string of the format has, but for ``ODD`` of them."""
        means = sorted(self.mean(_symbols(s)) for s in strings)
        return means[int(ODD * len(means))] - FIT_SLACK if means else math.inf

    def mean(self, symbols: bytes) -> float:
        """Log-likelihood a symbol, the end included."""
        return self.score_symbols(symbols) / (len(symbols) + 1)

    def score(self, token: str) -> float:
        """Log-likelihood of the token."""
        return self.score_symbols(_symbols(token))

    def score_symbols(self, symbols: bytes) -> float:
        """Log-likelihood of the symbols and the end after them. An unseen symbol stays put."""
        state, total = 0, 0.0
        for symbol in symbols:
            total += self.logs[state][symbol]
            state = self.next[state].get(symbol, state)
        return total + self.logs[state][_END]


class OneState(Automaton):
    """All states merged: too coarse to learn a rare format from its own few tokens."""

    def _alike(self, a: int, b: int) -> bool:
        return True


class Formats:
    """Credential automata against a background; ``margin`` is the log-odds a find must pass.

    Odds alone would take whatever the background doesn't know. So a find must also fit the format: its mean log-likelihood a symbol
    must be one that the format's own strings have.

    The background is learned twice. First with one state, which tells the unlabelled tokens that look like
    credentials; then from the others. Tokens without a letter (numbers, dates) always stay in.
    """

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str]):
        self.kinds = {k: Automaton(v) for k, v in credentials.items() if len(v) >= LEAST}
        self.margin = math.log(max(len(self.kinds), 1) / FALSE_RATE)
        self.background: Automaton = OneState(ordinary)
        self.background = Automaton([t for t in ordinary if not (any(c.isalpha() for c in t) and (self.odds(t) or 0.0) > self.margin)])
        self.least = self._least()
        self._known: dict[bytes, int] = {}

    def odds(self, token: str) -> float | None:
        """Log-odds of a token, without a name in front; minus infinity if it fits no format, None where there is nothing to score."""
        return self._odds(_NAME.sub(b"", _symbols(token)))

    def _odds(self, symbols: bytes) -> float | None:
        if not symbols or not self.kinds:
            return None
        fitting = [total for a in self.kinds.values() if (total := a.score_symbols(symbols)) >= a.floor * (len(symbols) + 1)]
        return max(fitting) - self.background.score_symbols(symbols) if fitting else -math.inf

    def _least(self, most: int = 12) -> int:
        """The least length at which some string passes, or ``most``: the highest odds over all strings of
        each length, by pairs of states."""
        back, least = self.background, most
        for a in self.kinds.values():
            best = {(0, 0): 0.0}
            for n in range(1, least):
                after: dict[tuple[int, int], float] = {}
                for (x, y), odds in best.items():
                    for symbol in _ALPHABET:
                        to = (a.next[x].get(symbol, x), back.next[y].get(symbol, y))
                        now = odds + a.logs[x][symbol] - back.logs[y][symbol]
                        if now > after.get(to, -math.inf):
                            after[to] = now
                best = after
                if max(odds + a.logs[x][_END] - back.logs[y][_END] for (x, y), odds in best.items()) > self.margin - 1e-6:
                    least = n
                    break
        return least

    def _skip(self, token: bytes) -> int:
        """Where the credential starts in the token, or -1: kept for short tokens, as many have the same symbols."""
        skip = self._known.get(token)
        if skip is None:
            name = _NAME.match(token)
            skip = name.end() if name else 0
            odds = self._odds(token[skip:])
            if odds is None or odds <= self.margin:
                skip = -1
            if len(token) <= 64:
                if len(self._known) >= 100_000:
                    self._known.clear()
                self._known[token] = skip
        return skip

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Learned finds in what the base finds leave."""
        if not self.kinds:
            return []
        return [(s + skip, len(KINDS), e) for s, e, token in candidates(text, base, self.least) if (skip := self._skip(token)) >= 0]


def learn(df: DataFrame, text: str = "text", key: str = "doc_id") -> Formats:
    """Infers the formats from the base finds of all documents and ordinary tokens of a sample.

    Of each kind the ``SAMPLE_EACH`` values of least hash are learned from, however rare they are. Ordinary
    tokens come from the documents whose text has a hash in a share of the range that holds about
    ``SAMPLE_DOCS`` of them. Both depend on values alone, so a lost executor or another order changes nothing,
    and keys, null or repeated, play no part.
    """
    bound_batches(df.sparkSession)
    n = df.count()
    # Hashes are uniform, so a share of their range holds about that share of the texts.
    edge = -(1 << 63) + min((1 << 64) * SAMPLE_DOCS // max(n, 1), (1 << 64) - 1)
    value = F.col(text).cast("string")
    texts = df.select(value.alias("text"), (F.xxhash64(F.lit("secrets"), value) <= edge).alias("sampled"))
    most = {**dict.fromkeys(KINDS, SAMPLE_EACH), "ordinary": SAMPLE_ORDINARY}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The values of least hash of the partition: those of the whole table are among them."""
        least: dict[str, dict[str, str]] = {k: {} for k in most}
        for batch in batches:
            for row, sampled in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for kind, value in _labelled(row.as_py() or "", sampled):
                    if value not in least[kind]:
                        least[kind][value] = hashlib.md5(value.encode()).hexdigest()
                for kind, held in least.items():
                    if len(held) > 4 * most[kind]:
                        least[kind] = dict(sorted(held.items(), key=lambda v: v[1])[: most[kind]])
        for kind, held in least.items():
            values = sorted(held.items(), key=lambda v: v[1])[: most[kind]]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(values), pa.string()), *(pa.array([v[i] for v in values], pa.string()) for i in (0, 1))], ["kind", "value", "o"])
        give_back()

    with scratch() as keep:
        rows = keep(texts.mapInArrow(gather, "kind string, value string, o string").distinct())
        # How many values begin with which digits tells up to where the least hashes reach: no ranking, no kind in one task.
        digits = F.substring("o", 1, 4)
        cells: dict[str, dict[str, int]] = {k: {} for k in most}
        for r in rows.groupBy("kind", digits.alias("d")).count().collect():  # 65,536 a kind at most
            cells[r.kind][r.d] = r["count"]
        last = F.lit("")
        for kind, cell in cells.items():
            sums = itertools.accumulate(cell[d] for d in sorted(cell))
            last = F.when(F.col("kind") == kind, next((d for d, n in zip(sorted(cell), sums, strict=True) if n >= most[kind]), "g")).otherwise(last)
        found = sorted((r.o, r.kind, r.value) for r in rows.where(digits <= last).collect())
    sample = {k: [value for _, kind, value in found if kind == k][: most[k]] for k in most}
    return Formats({k: sample[k] for k in KINDS}, sample["ordinary"])


def _labelled(text: str, sampled: bool = True) -> list[tuple[str, str]]:
    """Credentials by kind (of an assignment, its value), and some of the tokens that are none."""
    base = base_spans(text)
    out = [(KINDS[k], ASSIGN.match(text, s).group(2)[:SAMPLE_CHARS] if k == 0 else text[s:e][:SAMPLE_CHARS]) for s, k, e in base]
    for s, e, _ in candidates(text, base) if sampled else ():
        value = text[s:e][:SAMPLE_CHARS]
        if hashlib.md5(value.encode()).digest()[0] < 32:
            out.append(("ordinary", value))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "learned")
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


_FIELDS = T.StructType(
    [
        *(T.StructField(f"n_{k}", T.LongType()) for k in (*KINDS, "learned")),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def scan(df: DataFrame, formats: Formats | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_assign, n_access, n_hex, n_learned, base_sha256, spans`` to every row.

    ``spans`` lists all finds as kind:start:end (code points, end exclusive) by start, then kind.
    """
    formats = formats or learn(df, text)
    held = df.sparkSession.sparkContext.broadcast(formats)  # bounded by the training sample

    def batch(column: pa.Array) -> dict[str, pa.Array]:
        model = held.value
        counts: list[list[int]] = [[], [], [], []]
        sums, all_spans = [], []
        for row in column:
            value = row.as_py() or ""
            base = base_spans(value)
            spans = sorted(base + model.spans(value, base))
            for k, n in enumerate(counts):
                n.append(sum(s[1] == k for s in spans))
            sums.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            all_spans.append(_joined(spans))
        return {
            **{f"n_{k}": pa.array(n, pa.int64()) for k, n in zip((*KINDS, "learned"), counts, strict=True)},
            "base_sha256": pa.array(sums, pa.string()),
            "spans": pa.array(all_spans, pa.string()),
        }

    return annotate(df, batch, _FIELDS, text, keep)


def redact(df: DataFrame, formats: Formats | None = None, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every find in ``text`` replaced by ``mark``; overlapping finds merge.

    Null text stays null.
    """
    formats = formats or learn(df, text)
    held = df.sparkSession.sparkContext.broadcast(formats)  # bounded by the training sample

    def batch(column: pa.Array) -> dict[str, pa.Array]:
        model, out = held.value, []
        for row in column:
            value = row.as_py()
            if value:
                base = base_spans(value)
                parts, at = [], 0
                for start, _, end in sorted(base + model.spans(value, base)):
                    if start >= at:
                        parts += [value[at:start], mark]
                    at = max(at, end)
                value = "".join([*parts, value[at:]])
            out.append(value)
        return {text: pa.array(out, pa.string())}

    order = df.columns
    return annotate(df, batch, T.StructType([T.StructField(text, T.StringType())]), text).select(*(f"`{c}`" for c in order))
