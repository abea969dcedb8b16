"""Benchmark passages in documents, found by the q-gram lemma and verified by banded alignment.

Texts are compared as bytes, with the capitals of ASCII and Latin-1 as small letters and runs of space
as one space. Every item is cut into short windows at a small stride, so that an excerpt of ``window + stride - 1``
bytes holds a whole one; a window occurs in a text if it aligns to a part of it with at most ``edits``
insertions, deletions and replacements, which is a share of its length. Such an occurrence of a window of m
bytes with e edits shares at least ``m + 1 - q - q e`` q-grams with the text, all within e + 1 diagonals.
So q-gram hits are counted in overlapping bands of diagonals, a band and window that reach the
bound are aligned inside the band, and what exceeds the budget goes.

Items are a query set: they are broadcast in blocks of bounded size, each against all documents. Items that are
shorter than ``least`` bytes after folding occur where their words stand in a row, without edits and between spaces
or ends of the text. Null items and items without words occur nowhere.
Null and empty texts hold nothing. Repeated rows are searched each, equal items are each reported. An
empty table gives no rows. Other columns are kept by :func:`clean_documents` and not read by :func:`passages`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbrow.llm import text as T


POSTINGS = 1 << 20  # expanded at a time
ALIGNED = 1 << 15  # bands aligned at a time


@dataclass(frozen=True)
class Settings:
    q: int = 12
    window: int = 56
    stride: int = 8
    edits: float = 0.05
    least: int = 40
    band: int = 16
    block_bytes: int = 8 << 20  # items broadcast at a time, with window / stride postings of 8 bytes a byte


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, row offsets and the place of every byte in the original buffer."""
    space = ~T._WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    keep = ~space
    if len(data):
        keep[1:] |= space[1:] & ~space[:-1] & ~edge[1:-1]  # the first space of a run inside a row
    at = np.flatnonzero(keep)
    out = T._LOWER[data[at]]
    out[space[at]] = 32
    accent = np.flatnonzero(out[:-1] == 0xC3) + 1  # capitals of Latin-1 but the multiplication sign
    capital = (out[accent] >= 0x80) & (out[accent] <= 0x9E) & (out[accent] != 0x97)
    out[accent[capital]] += 32
    return out, np.searchsorted(at, offsets), at


def _gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at every place of the buffer that has one."""
    prefix = T.prefix_hash(data)
    n = len(data) - q + 1
    return (prefix[q:] - prefix[:-q]) * T._power(T._INVERSE, n) if n > 0 else np.empty(0, np.uint64)


class Index:
    """Windows and q-grams of a block of items."""

    def __init__(self, items: list[tuple], settings: Settings):
        self.settings = settings
        data, offsets = T.buffers(pa.array([t for _, t in items], pa.string()))
        data, offsets, _ = folded(data, offsets)
        self.ids, self.bytes = [], []
        short: dict[int, dict[bytes, list]] = {}  # by length: bodies with the places of their items
        for n, (item, _) in enumerate(items):
            body = data[offsets[n] : offsets[n + 1]]
            if len(body) >= settings.least:
                self.ids.append(item)
                self.bytes.append(body)
            elif words := body.tobytes().strip(b" "):
                short.setdefault(len(words), {}).setdefault(words, []).append(item)
        self.short = []
        for length, bodies in sorted(short.items()):
            ends = np.arange(len(bodies) + 1) * length
            hashes = T.span_hash(T.prefix_hash(np.frombuffer(b"".join(bodies), np.uint8)), ends[:-1], ends[1:])
            order, pairs = np.argsort(hashes, kind="stable"), list(bodies.items())
            self.short.append((length, hashes[order], [pairs[k] for k in order]))
        # windows: item, start, length, budget, bound
        rows = []
        for item, body in enumerate(self.bytes):
            m = min(settings.window, len(body))
            e = max(0, min(math.floor(settings.edits * m), (m - settings.q) // settings.q))
            begin = [*range(0, len(body) - m, settings.stride), len(body) - m]
            rows += [(item, a, m, e, m + 1 - settings.q - settings.q * e) for a in dict.fromkeys(begin)]
        self.windows = np.array(rows, np.int64).reshape(-1, 5)
        self.most = int(self.windows[:, 3].max()) if len(rows) else 0
        # one posting a q-gram of a window
        grams, window, place = [], [], []
        hashes = [_gram_hashes(b, settings.q) for b in self.bytes]
        for w, (item, a, m, _, _) in enumerate(rows):
            h = hashes[item][a : a + m - settings.q + 1]
            grams.append(h)
            window.append(np.full(len(h), w, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        empty = np.empty(0, np.int32)
        grams = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.window = (np.concatenate(window) if window else empty)[order]
        self.place = (np.concatenate(place) if place else empty)[order]
        self.keys, self.first = np.unique(grams[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(order)))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of every verified passage: overlapping windows of an item are joined.

        Start and end are bytes of the row's text; edits are the fewest of any of its windows.
        """
        raw, raw_offsets = T.buffers(column)
        data, offsets, at = folded(raw, raw_offsets)
        if not len(data):
            return []
        return self._exact(data, offsets, at, raw_offsets) + self._near(data, offsets, at, raw_offsets)

    def _exact(self, data, offsets, at, raw_offsets):
        """Short items as whole words; overlapping ones are each reported."""
        found = []
        if not self.short:
            return found
        prefix = T.prefix_hash(data)
        border = np.zeros(len(data) + 1, bool)  # a word may start here, or end before
        border[offsets] = True
        border[:-1] |= data == 32
        border[1:] |= data == 32
        starts = np.flatnonzero(border[:-1] & (data != 32))
        for length, hashes, bodies in self.short:
            begin = starts[: np.searchsorted(starts, len(data) - length, side="right")]
            row = np.searchsorted(offsets, begin, side="right") - 1
            good = border[begin + length] & (begin + length <= offsets[row + 1])
            begin, row = begin[good], row[good]
            if not len(begin):
                continue
            h = T.span_hash(prefix, begin, begin + length)
            first, last = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for n in np.flatnonzero(last > first):
                b, r = int(begin[n]), int(row[n])
                body = data[b : b + length].tobytes()
                for words, items in bodies[first[n] : last[n]]:
                    if words == body:
                        found += [(r, i, int(at[b] - raw_offsets[r]), int(at[b + length - 1] + 1 - raw_offsets[r]), 0) for i in items]
        return found

    def _near(self, data, offsets, at, raw_offsets):
        if not len(self.windows):
            return []
        s = self.settings
        h = _gram_hashes(data, s.q)
        hit = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        key = np.searchsorted(self.keys, h[hit])
        key[key == len(self.keys)] = 0
        good = self.keys[key] == h[hit]
        hit, key = hit[good], key[good]
        row = np.searchsorted(offsets, hit, side="right") - 1
        inside = hit + s.q <= offsets[row + 1]
        hit, key = hit[inside], key[inside]
        window, low = self._banded_hits(hit, key, len(data))
        if not len(window):
            return []
        parts = [self._align(data, offsets, window[n : n + ALIGNED], low[n : n + ALIGNED]) for n in range(0, len(window), ALIGNED)]
        return self._joined(window, low, *(np.concatenate(x) for x in zip(*parts)), offsets, at, raw_offsets)

    def _banded_hits(self, hit, key, size):
        """Windows and lowest diagonals of the bands that hold enough shared q-grams.

        Hits are taken with ``POSTINGS`` postings at a time, in the order of the text. A band that lies behind the
        text that is still to come is settled, so the counts that are kept belong to a short stretch of text.
        """
        s = self.settings
        span = size // s.band + 2 * s.window
        bound, edits = self.windows[:, 4], self.windows[:, 3]
        ends = np.cumsum(self.count[key])
        total = int(ends[-1]) if len(ends) else 0
        code, counts, done = np.empty(0, np.int64), np.empty(0, np.int64), []
        for first in range(0, total, POSTINGS):
            place = np.arange(first, min(first + POSTINGS, total))
            n = np.searchsorted(ends, place, side="right")
            posting = place - (ends[n] - self.count[key[n]]) + self.first[key[n]]
            window = self.window[posting].astype(np.int64)
            diagonal = hit[n] - self.place[posting] + s.window  # not negative
            band = diagonal // s.band
            twice = (diagonal % s.band <= edits[window]) & (band > 0)
            new = np.concatenate([window * span + band, window[twice] * span + band[twice] - 1])
            code, counts = T.pooled(np.concatenate([code, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
            # Every later hit lies on a diagonal above its own place in the text.
            settled = (code % span + 1) * s.band + self.most < hit[n[-1]] if place[-1] + 1 < total else np.ones(len(code), bool)
            done.append(code[settled & (counts >= bound[code // span])])
            code, counts = code[~settled], counts[~settled]
        code = np.sort(np.concatenate([np.empty(0, np.int64), *done]))
        return code // span, code % span * s.band - s.window

    def _align(self, data, offsets, window, low):
        """Fewest edits of each window inside its band, the row and the place where that alignment ends.

        Cell (i, d) is the cost of the first i bytes ending at diagonal ``low + d``. A band that runs
        over a row border is searched in both rows: the row is that of its middle, and of each end.
        """
        s = self.settings
        width = s.band + self.most + 1
        edges = [np.clip(low + k, 0, len(data) - 1) for k in (0, width // 2, width - 1)]
        edges += [np.clip(low + k + self.windows[window, 2], 0, len(data) - 1) for k in (0, width - 1)]
        best = np.full(len(window), 1 << 20)
        end = np.zeros(len(window), np.int64)
        owner = np.zeros(len(window), np.int64)
        tried = []
        for edge in edges:
            row = np.searchsorted(offsets, edge, side="right") - 1
            fresh = np.ones(len(window), bool)
            for old in tried:
                fresh &= row != old
            tried.append(row)
            at = np.flatnonzero(fresh)
            if len(at):
                cost, place = self._banded(data, offsets[row[at]], offsets[row[at] + 1], window[at], low[at], width)
                better = cost < best[at]
                at = at[better]
                best[at], end[at], owner[at] = cost[better], place[better], row[at]
        return best, end, owner

    def _banded(self, data, begin, stop, window, low, width):
        item, start, length, budget, _ = self.windows[window].T
        size = int(length.max())
        pattern = np.zeros((len(window), size), np.int16)
        for n, (i, a, m) in enumerate(zip(item, start, length)):
            pattern[n, :m] = self.bytes[i][a : a + m]
        step = np.arange(width)
        usable = step[None, :] <= (self.settings.band + budget)[:, None]
        far = 1 << 15
        place = low[:, None] + step[None, :]
        # A start must lie in the row; the free start costs nothing anywhere in the band.
        cost = np.where(usable & (place >= begin[:, None]) & (place <= stop[:, None]), 0, far).astype(np.int32)
        final = np.full(cost.shape, far, np.int32)
        for i in range(size):
            at = place + i
            there = (at >= begin[:, None]) & (at < stop[:, None])
            byte = np.where(there, data[np.clip(at, 0, len(data) - 1)], -1)
            new = cost + (byte != pattern[:, i : i + 1])
            new[~there] = far
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            new[~usable] = far
            new = np.minimum.accumulate(new - step, axis=1) + step
            outside = (at + 1 < begin[:, None]) | (at + 1 > stop[:, None]) | ~usable
            new[outside] = far
            cost = new
            done = length == i + 1
            final[done] = cost[done]
        best = final.argmin(axis=1)
        return final[np.arange(len(window)), best], low + best + length

    def _joined(self, window, low, cost, end, row, offsets, at, raw_offsets):
        item, _, length, budget, _ = self.windows[window].T
        good = np.flatnonzero(cost <= budget)
        found = []
        for n in good[np.lexsort((end[good], item[good], row[good]))]:
            begin = max(int(end[n] - length[n]), int(offsets[row[n]]))
            new = (int(row[n]), int(item[n]), begin, int(end[n]), int(cost[n]))
            if found and found[-1][:2] == new[:2] and new[2] <= found[-1][3]:
                last = found[-1]
                found[-1] = (*last[:2], min(last[2], begin), max(last[3], new[3]), min(last[4], new[4]))
            else:
                found.append(new)
        return [
            (r, self.ids[i], int(at[a] - raw_offsets[r]), int(at[b - 1] + 1 - raw_offsets[r]), e) for r, i, a, b, e in found
        ]


def _blocks(items: DataFrame, item_id: str, text: str, settings: Settings) -> list[list[tuple]]:
    """The items in blocks of bounded size."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL")
    blocks, size = [[]], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        if size + len(r.t) > settings.block_bytes and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((r.i, r.t))
        size += len(r.t)
    return blocks


def passages(
    docs: DataFrame, items: DataFrame, settings: Settings = Settings(),
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, start, end and edits of every benchmark passage in a document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()

    def one(block: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Index(block, settings))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in T.pieces(batch):
                    found = sent.value.search(piece.column("text"))
                    if found:
                        row, item, start, end, edits = zip(*found)
                        yield pa.record_batch(
                            [piece.column("doc_id").take(pa.array(row)), pa.array(item), pa.array(start), pa.array(end), pa.array(edits)],
                            ["doc_id", "item_id", "start", "end", "edits"],
                        )

        schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, end long, edits long"
        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [one(b) for b in _blocks(items, item_id, item_text, settings)])


def clean_documents(
    docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark passage. Nothing is shuffled."""
    for block in _blocks(items, item_id, item_text, settings):
        docs = _without(docs, Index(block, settings), text)
    return docs


def _without(docs: DataFrame, index: Index, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, text):
                keep = np.ones(piece.num_rows, bool)
                keep[[f[0] for f in sent.value.search(piece.column(text))]] = False
                yield piece.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
