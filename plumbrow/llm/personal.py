"""Personal data in texts: fixed patterns, and a skip-chain conditional random field over what resembles them.

Candidates are the words of a document with a digit or an at sign, digit words in a row taken as one number, and words that
spell the local part of an address of the same document. Every candidate is a variable with the
labels of the patterns and "none". Its potentials come from its shape, its digits and the words beside it. Neighbours that
stand close share a chain potential. Candidates that repeat each other or are similar (the same digits in
another spelling, the last ten digits of a longer number, the local part of an address) share a skip potential, however far apart they are: each is
linked with the one before it and with the first of its kind that a pattern has found, so links grow with the candidates. Loopy
message passing, in a fixed number of rounds, gives the marginals. Candidates inside a pattern's span are observed; others
with a label at or above ``least`` add a span, unless it overlaps a pattern's.

Training: the patterns mark the texts, and pseudo-likelihood fits the potentials. Beside half of the spans a copy is put in that no pattern
finds (other separators, no plus sign, the local part alone), and beside the other half such a copy with other digits or letters, which belongs to
nothing in the text. So the potentials learn that a doubtful string counts where the document has its full form. The fit takes the ``sample`` distinct texts with the
least hash that hold a digit or an at sign; patterns, candidates and messages cover every text whole.

Positions are code points, ends are exclusive. Null and empty texts have no spans, repeated rows are searched each with the same result, an
empty table gives no rows, other columns are kept on request and not read. Time and memory are linear in a text's length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.llm import text as T

# The kinds in their order. The patterns are those of the kinds, in possessive form, which finds the same matches in linear time.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(rb"[0-9]")
#: What a span of the random field is called.
NEAR = tuple(f"near_{k}" for k in KINDS)
LABELS = len(KINDS) + 1  # the last is "none"
NONE = LABELS - 1

SPANS = "array<struct<kind: string, start: int, end: int>>"
_LOCAL = np.zeros(256, bool)
_LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
_SHAPE = bytes(
    57 if 48 <= b < 58 else 65 if 65 <= b < 91 else 97 if 97 <= b < 123 else 117 if b > 127 else b for b in range(256)
)
_NO_DIGITS = bytes(b for b in range(256) if not 48 <= b < 58)
_NO_LETTERS = bytes(np.flatnonzero(~T._LETTER).tolist())
_LOWER = bytes(T._LOWER)
_EDGE = b".,;:!?\"'()[]{}<>*#$%&=|"


@dataclass(frozen=True)
class Settings:
    least: float = 0.5  # marginal of a label that adds a span
    rounds: int = 10
    damping: float = 0.25
    near: int = 32  # bytes between neighbours that share a chain potential
    sample: int = 4096  # distinct texts of the fit
    per_text: int = 4096  # candidates that the fit takes of each
    features: int = 4096  # hashed
    steps: int = 300
    rate: float = 0.1
    decay: float = 1e-4


def luhn(digits: bytes) -> bool:
    """Whether the check digit fits."""
    total = 0
    for n, d in enumerate(reversed(digits)):
        d -= 48
        total += d if n % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(found: bytes) -> bytes:
    return found.translate(None, _NO_DIGITS)


def _good_ip(found: bytes) -> bool:
    return all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in found.split(b"."))


def _good_card(found: bytes) -> bool:
    digits = _digits(found)
    return 16 <= len(digits) <= 19 and luhn(digits)


def pattern_spans(body: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of every match of a pattern that holds, by kind and start."""
    out = []
    at = body.find(b"@")
    if at >= 0:
        breaks = np.flatnonzero(~_LOCAL[np.frombuffer(body, np.uint8)])
        last = 0
        while at >= 0:
            before = int(np.searchsorted(breaks, at))
            start = max(int(breaks[before - 1]) + 1 if before else 0, last)
            found = DOMAIN.match(body, at + 1) if start < at else None
            if found:
                last = found.end()
                out.append((0, start, last))
            at = body.find(b"@", at + 1)
    out += [(1, *m.span()) for m in IP.finditer(body) if _good_ip(m[0])]
    out += [(2, *m.span()) for m in CARD.finditer(body) if m.end() - m.start() > 15 and _good_card(m[0])]
    if b"+" in body:
        out += [(3, *m.span()) for m in PHONE.finditer(body) if 8 <= len(_digits(m[0])) <= 15]
    return out


@dataclass
class Words:
    """Words of a buffer with what stands in them."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    digits: np.ndarray
    wordy: np.ndarray  # letters or an at sign

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        start, end, row = T.word_spans(data, offsets)
        digit = (data >= 48) & (data < 58)
        other = T._LETTER[data] & ~digit | (data == 64)
        count = lambda mask: (lambda sums: sums[end] - sums[start])(np.concatenate([[0], np.cumsum(mask)]))
        return cls(start, end, row, count(digit), count(other) > 0)


def _trimmed(body: bytes, start: int, end: int) -> tuple[int, int]:
    word = body[start:end]
    kept = word.lstrip(_EDGE)
    start += len(word) - len(kept)
    return start, start + len(kept.rstrip(_EDGE))


def local_part(word: bytes) -> bytes:
    """What stands before an at sign or a bracket, in small letters; a whole word without one."""
    return re.split(rb"[@\[({]", word, maxsplit=1)[0].translate(_LOWER)


def candidates(body: bytes, base: list[tuple[int, int, int]], words: Sequence[tuple[int, int, int, bool]]) -> list[tuple[int, int, bool]]:
    """(start, end, number) of every candidate of a text, in order. ``words``: start, end, digits, wordy."""
    names = {local_part(body[a:b]) for kind, a, b in base if kind == 0}
    names = {n for n in names if len(n) >= 4}
    found: list[tuple[int, int, bool]] = []
    for start, end, digits, wordy in words:
        if not digits and not (wordy and (b"@" in body[start:end] or names)):
            continue
        if digits and not wordy:
            word = body[start:end]
            sign = word[: DIGIT.search(word).start()]
            first, last = start + len(sign.rstrip(b"+(")), start + len(word.rstrip(_NO_DIGITS))
            joins = found and found[-1][2] and first == start and word[:1] != b"+" and body[found[-1][1] : start] in (b" ", b") ")
            if joins and len(_digits(body[found[-1][0] : found[-1][1]])) < 16:
                found[-1] = (found[-1][0], last, True)
            else:
                found.append((first, last, True))
            continue
        start, end = _trimmed(body, start, end)
        if start < end and (digits or b"@" in body[start:end] or body[start:end].translate(_LOWER) in names):
            found.append((start, end, False))
    return found


def similar_keys(word: bytes, number: bool) -> list[bytes]:
    """Spellings under which candidates are linked."""
    if number:
        digits = _digits(word)
        if len(digits) < 7:
            return []
        return [b"n" + (digits[-10:] if 10 <= len(digits) <= 15 else digits)]
    whole = word.translate(_LOWER, _NO_LETTERS)
    name = local_part(word)
    keys = [b"w" + whole] if len(whole) >= 4 else []
    if len(name) >= 4:
        keys.append(b"l" + name.strip(_EDGE))
    digits = _digits(word)
    return keys + ([b"n" + (digits[-10:] if 10 <= len(digits) <= 15 else digits)] if len(digits) >= 7 else [])


def shape(word: bytes) -> bytes:
    """Classes of characters, runs cut to three."""
    return re.sub(rb"(.)\1{3,}", rb"\1\1\1", word[:48].translate(_SHAPE))


def observations(body: bytes, start: int, end: int, number: bool, features: int) -> list[int]:
    """Hashed features of a candidate; always as many."""
    word = body[start:end]
    digits = _digits(word)
    before, after = body[max(0, start - 24) : start].split(), body[end : end + 24].split()
    n = len(digits)
    size = 0 if n == 0 else 1 if n < 4 else 2 if n < 7 else 3 if n < 10 else 4 if n < 16 else 5 if n < 20 else 6
    dots = word.split(b".")
    facts = (
        b"bias", b"s" + shape(word), b"p" + (shape(before[-1])[-6:] if before else b""), b"n" + (shape(after[0])[:6] if after else b""),
        b"k%d%d" % (number, size), b"c%d" % (16 <= n <= 19 and luhn(digits)), b"+%d" % (word[:1] == b"+"),
        b"@%d" % (b"@" in word) + (b"." if b"." in word.rpartition(b"@")[2] else b""),
        b"i%d%d" % (len(dots), len(dots) == 4 and all(p.isdigit() for p in dots) and _good_ip(word)),
    )
    return [crc32(f) % features for f in facts]


@dataclass
class Graph:
    """Candidates of several texts: their row, span, features, label (-1: not observed) and edges."""

    row: list[int]
    start: list[int]
    end: list[int]
    facts: list[list[int]]
    label: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]

    @classmethod
    def empty(cls) -> Graph:
        return cls([], [], [], [], [], [], [])

    def add(self, row: int, body: bytes, base: list[tuple[int, int, int]], words, settings: Settings) -> None:
        """The candidates of a text; every candidate is linked with the one before, and by its spellings."""
        by_start = sorted((a, b, kind) for kind, a, b in base)
        reach, furthest = [], 0  # the furthest end up to each span
        for _, b, _ in by_start:
            furthest = max(furthest, b)
            reach.append(furthest)
        begins = [a for a, _, _ in by_start]
        last: dict[bytes, int] = {}
        full: dict[bytes, int] = {}
        for start, end, number in candidates(body, base, words):
            n = len(self.row)
            kind, at = -1, bisect_left(begins, end) - 1
            while at >= 0 and reach[at] > start:
                if by_start[at][1] > start:
                    kind = by_start[at][2] if kind < 0 else min(kind, by_start[at][2])
                at -= 1
            if n and self.row[-1] == row and start - self.end[-1] <= settings.near:
                self.chain.append((n - 1, n))
            linked = set()
            for key in similar_keys(body[start:end], number):
                linked |= {d[key] for d in (last, full) if key in d}
                last[key] = n
                if kind >= 0:
                    full.setdefault(key, n)
            self.skip += [(other, n) for other in sorted(linked)]
            self.row.append(row)
            self.start.append(start)
            self.end.append(end)
            self.facts.append(observations(body, start, end, number, settings.features))
            self.label.append(kind)


@dataclass
class Potentials:
    """Logarithms: ``unary`` of a feature and label, ``chain`` and ``skip`` of the labels of an earlier and a later candidate."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by place."""
    return np.stack([np.bincount(at, values[:, k], size) for k in range(values.shape[1])], axis=1)


def _edges(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array(pairs, np.int64).reshape(-1, 2)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def marginals(unary: np.ndarray, edges: Sequence[tuple[np.ndarray, np.ndarray]], rounds: int, damping: float) -> np.ndarray:
    """Label probabilities of every variable by loopy message passing. ``edges``: pairs of variables, and their potential."""
    u = np.concatenate([np.empty(0, np.int64), *(e[:, 0] for e, _ in edges)])
    v = np.concatenate([np.empty(0, np.int64), *(e[:, 1] for e, _ in edges)])
    which = np.repeat(np.arange(len(edges)), [len(e) for e, _ in edges])
    tables = np.stack([p for _, p in edges])[which] if len(u) else np.zeros((0, *[unary.shape[1]] * 2))
    to_v, to_u = np.zeros((len(u), unary.shape[1])), np.zeros((len(u), unary.shape[1]))

    def passed(x: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Logarithm of the sum over the labels of the first axis of the table, normalised."""
        joint = x[:, :, None] + table
        top = joint.max(axis=1)
        out = top + np.log(np.exp(joint - top[:, None, :]).sum(axis=1))
        return out - out.max(axis=1, keepdims=True)

    belief = unary
    for _ in range(rounds if len(u) else 0):
        new_v = passed(belief[u] - to_u, tables)
        new_u = passed(belief[v] - to_v, tables.transpose(0, 2, 1))
        to_v = damping * to_v + (1 - damping) * new_v
        to_u = damping * to_u + (1 - damping) * new_u
        belief = unary + _sums(np.concatenate([v, u]), np.concatenate([to_v, to_u]), len(unary))
    return _softmax(belief) if len(belief) else belief


def fit_potentials(facts: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray, settings: Settings) -> Potentials:
    """Pseudo-likelihood: every candidate given the labels of the linked ones, by Adam over all candidates."""
    shapes = ((settings.features, LABELS), (LABELS, LABELS), (LABELS, LABELS))
    params = [np.zeros(s) for s in shapes]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    truth = np.eye(LABELS)[label]
    n, width = facts.shape
    for step in range(1, settings.steps + 1):
        unary, *pair = params
        logits = unary[facts].sum(axis=1)
        for edges, table in zip((chain, skip), pair):
            logits += _sums(edges[:, 1], table[label[edges[:, 0]]], n) + _sums(edges[:, 0], table.T[label[edges[:, 1]]], n)
        error = (_softmax(logits) - truth) / n
        grads = [_sums(facts.ravel(), np.repeat(error, width, axis=0), settings.features)]
        for edges in (chain, skip):
            by_first = _sums(label[edges[:, 0]], error[edges[:, 1]], LABELS)
            by_last = _sums(label[edges[:, 1]], error[edges[:, 0]], LABELS)
            grads.append(by_first + by_last.T)
        for k, g in enumerate(grads):
            g = g + settings.decay * params[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            rate = settings.rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            params[k] = params[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-9)
    return Potentials(*params)


def _scan(column: pa.Array) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]], list[tuple[int, int, int, bool]]]]:
    """Row, bytes, pattern spans and words of every text with a digit or an at sign; words without either are listed where an address stands."""
    data, offsets = T.buffers(column)
    marked = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58) | (data == 64))])[offsets]
    words = Words.of(data, offsets)
    mark = (words.digits > 0) | (_count_at(data, words) > 0)
    edges = np.searchsorted(words.row, np.arange(len(column) + 1))
    for row in np.flatnonzero(np.diff(marked)).tolist():
        begin = int(offsets[row])
        body = data[begin : offsets[row + 1]].tobytes()
        base = pattern_spans(body)
        at = np.arange(edges[row], edges[row + 1])
        if not any(kind == 0 for kind, _, _ in base):
            at = at[mark[at]]
        parts = (words.start[at] - begin, words.end[at] - begin, words.digits[at], words.wordy[at])
        yield row, body, base, list(zip(*(p.tolist() for p in parts)))


def _count_at(data: np.ndarray, words: Words) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(data == 64)])
    return sums[words.end] - sums[words.start]


def disguised(kind: int, found: bytes, other: bool, turn: int) -> bytes:
    """A span in a form that no pattern finds; with ``other``, of other digits and letters."""
    if other:
        found = bytes((b - 48 + 3) % 10 + 48 if 48 <= b < 58 else (b - 97 + 5) % 26 + 97 if 97 <= b < 123 else b for b in found)
    if kind == 0:
        name, _, domain = found.partition(b"@")
        return (name, name + b"[at]" + domain, name + b"(at)" + domain)[turn % 3]
    if kind == 1:
        return found.replace(b".", (b"-", b":", b"/")[turn % 3])
    digits = _digits(found)
    if kind == 2:
        return (b"/".join(digits[k : k + 4] for k in range(0, len(digits), 4)), b".".join(digits[k : k + 4] for k in range(0, len(digits), 4)))[turn % 2]
    return (digits, digits[-10:], b"-".join((digits[:-7], digits[-7:-4], digits[-4:])))[turn % 3]


def disguise(body: bytes, base: list[tuple[int, int, int]]) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The text with a disguised copy for every span, at a place that its hash decides, and where copies of own spans stand."""
    spaces = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)[:4096]
    free = [int(s) for s in spaces if not any(a <= s < b for _, a, b in base[:64])] or [len(body)]
    puts = []
    for kind, a, b in base[:64]:
        turn = crc32(body[a:b])
        puts.append((free[turn % len(free)], kind, disguised(kind, body[a:b], other=turn // 7 % 2 == 0, turn=turn // 14), turn // 7 % 2 == 1))
    out, marks, done = [], [], 0
    size = 0
    for place, kind, copy, own in sorted(puts):
        out += [body[done:place], b" ", copy]
        size += place - done + 1
        if own:
            marks.append((kind, size, size + len(copy)))
        size += len(copy)
        done = place
    return b"".join([*out, body[done:]]), marks


def fit(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> Potentials:
    """Potentials from a bounded sample of the texts that hold a digit or an at sign."""
    rows = docs.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    rows = rows.select("text", F.xxhash64("text").alias("h"))
    least = rows.select("h").distinct().orderBy("h").limit(settings.sample).agg(F.max("h")).first()[0]
    if least is None:
        return Potentials(np.zeros((settings.features, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    chosen = rows.filter(F.col("h") <= least).dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                hashes = piece.column("h").to_pylist()
                for row, body, base, _ in _scan(piece.column("text")):
                    body, marks = disguise(body, base)
                    graph = Graph.empty()
                    for _, body, base, words in _scan(pa.array([body], pa.binary())):
                        graph.add(0, body, base, words, settings)
                    for n, (a, b) in enumerate(zip(graph.start, graph.end)):
                        inside = [kind for kind, c, d in marks if c < b and a < d]
                        graph.label[n] = graph.label[n] if graph.label[n] >= 0 else min(inside, default=NONE)
                    most = settings.per_text
                    graph.facts, graph.label = graph.facts[:most], graph.label[:most]
                    graph.chain, graph.skip = ([e for e in edges if e[1] < most] for edges in (graph.chain, graph.skip))
                    flat = lambda pairs: [x for p in pairs for x in p]
                    columns = (flat(graph.facts), graph.label, flat(graph.chain), flat(graph.skip))
                    yield pa.record_batch([pa.array([hashes[row]]), *(pa.array([c], pa.list_(pa.int32())) for c in columns)], names)

    names = ["h", "facts", "label", "chain", "skip"]
    graphs = chosen.mapInArrow(run, "h long, " + ", ".join(f"{n} array<int>" for n in names[1:])).orderBy("h").toArrow().to_pylist()
    facts, label, chain, skip, first = [], [], [], [], 0
    for g in graphs:
        n = len(g["label"])
        facts.append(np.array(g["facts"], np.int64).reshape(n, -1) if n else np.empty((0, 0), np.int64))
        label.append(np.array(g["label"], np.int64))
        chain.append(np.array(g["chain"], np.int64).reshape(-1, 2) + first)
        skip.append(np.array(g["skip"], np.int64).reshape(-1, 2) + first)
        first += n
    facts = [f for f in facts if len(f)]
    if not facts:
        return Potentials(np.zeros((settings.features, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    return fit_potentials(np.concatenate(facts), np.concatenate(label), np.concatenate(chain), np.concatenate(skip), settings)


def _found(column: pa.Array, potentials: Potentials, settings: Settings) -> list[tuple[list, list]]:
    """Pattern spans and all spans of every text, in bytes."""
    base_of: dict[int, list[tuple[int, int, int]]] = {}
    graph = Graph.empty()
    for row, body, base, words in _scan(column):
        base_of[row] = base
        graph.add(row, body, base, words, settings)
    added: dict[int, list[tuple[int, int, int]]] = {}
    if graph.row:
        unary = potentials.unary[np.array(graph.facts)].sum(axis=1)
        known = np.array(graph.label)
        seen = known >= 0
        unary[seen] = -100.0
        unary[seen, known[seen]] = 0.0
        edges = [(_edges(e), table) for e, table in ((graph.chain, potentials.chain), (graph.skip, potentials.skip))]
        edges = [(e[~(seen[e[:, 0]] & seen[e[:, 1]])], table) for e, table in edges]  # nothing passes between observed ones
        chance = marginals(unary, edges, settings.rounds, settings.damping)
        best = chance.argmax(axis=1)
        for n in np.flatnonzero(~seen & (best != NONE) & (chance.max(axis=1) >= settings.least)).tolist():
            added.setdefault(graph.row[n], []).append((len(KINDS) + int(best[n]), graph.start[n], graph.end[n]))
    return [(base_of.get(row, []), base_of.get(row, []) + sorted(added.get(row, []))) for row in range(len(column))]


def _listed(rows: list[list[tuple[int, int, int]]], data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Spans in code points of their row."""
    names = KINDS + NEAR
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.array([s for r in rows for s in r], np.int64).reshape(-1, 3)
    row = np.repeat(np.arange(len(rows)), lengths)
    begin = offsets[row]
    start, end = (points[begin + flat[:, k]] - points[begin] for k in (1, 2))
    spans = pa.StructArray.from_arrays(
        [pa.array([names[k] for k in flat[:, 0]], pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["kind", "start", "end"]
    )
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), spans)


def find_personal(
    docs: DataFrame, potentials: Potentials, keep: Sequence[str] = (), text: str = "text", settings: Settings = Settings(),
) -> DataFrame:
    """The ``keep`` columns with ``base``, the spans of the patterns, and ``spans``, those and the added ones, by kind and start."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast((potentials.unary, potentials.chain, potentials.skip))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Potentials(*sent.value)
        for batch in batches:
            for piece in T.pieces(batch, "_text"):
                data, offsets = T.buffers(piece.column("_text"))
                found = _found(piece.column("_text"), known, settings)
                lists = [_listed([f[k] for f in found], data, offsets) for k in (0, 1)]
                yield pa.record_batch([*(piece.column(c) for c in keep), *lists], [*keep, "base", "spans"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema]
    return rows.mapInArrow(run, ", ".join([*schema, f"base {SPANS}", f"spans {SPANS}"]))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
