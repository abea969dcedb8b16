"""Removal of repeated byte strings with suffix arrays.

Every byte that is covered by a string of ``length`` bytes which also starts anywhere else goes.
The table is cut down to the passages that can hold such strings, and these are suffix-sorted:

1. Anchors. Of the ``gram``-byte strings inside any string of ``length`` bytes, those with the least
   hash are anchors, so equal strings have equal anchors. A string belongs to the last of its least grams;
   the strings of an anchor start side by side, and its passage is what they cover. Anchors and digests of
   their passages are dealt to buckets. A passage that occurs
   twice is repeated as a whole; where it stands next to a different one of the same anchor, one
   occurrence is asked for.
2. Passages of an anchor meet in a suffix array of the suffixes that start its strings. Suffixes smaller than their successors are sorted
   directly, the others are induced by scans over the buckets of first bytes. Neighbours in that
   order whose common prefix has ``length`` bytes are repeats.
3. An anchor with more than ``group`` different passages (by a sketch that never counts too few) is not
   gathered. Its strings of ``length`` bytes are dealt to buckets one by one and counted there;
   equal ones are pooled before they travel, so a frequent string loads no task.
4. The covered ranges go back to the documents, which are cut.

Strings are judged on the input. Matches do not cross documents. Null and empty texts have no bytes.
Repeated rows are documents each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbrow.llm import text as T
from plumbrow.llm.sketch import Sketch, count_keys
from plumbrow.session import settle


@dataclass(frozen=True)
class Settings:
    length: int = 400
    gram: int = 200
    group: int = 4096  # different passages of an anchor that are sorted together: about 2 MB
    chunk: int = 150_000  # anchors that a task packs at a time
    bucket: int = 200_000  # anchors in a bucket
    sorted_bytes: int = 1 << 21  # text in a suffix array, about


# ---------------------------------------------------------------- suffix sorting


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least, by two-stage sorting.

    With ``wanted`` (a flag for each place) only those, and what they are induced from: the places up to the next
    small suffix.

    A suffix is small if it precedes the suffix that starts one byte later. Small ones are sorted directly.
    A large suffix starts with a byte above its successor's, or with the same byte as a large
    successor; going through the buckets of first bytes upwards, every ready suffix puts the large one before
    it at the next free place of that one's bucket. The last suffix is large: nothing follows it.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    falls, rises = data[:-1] > data[1:], data[:-1] < data[1:]
    # The type of a run of equal bytes is that of its end.
    decided = np.append(falls | rises, True)
    ahead = np.where(decided, np.arange(n), n)
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]
    large = np.append(falls, True)[ahead]
    active = np.ones(n, bool)
    if wanted is not None:  # a place is active if it is wanted or follows an active large one
        places = np.arange(n)
        run = np.maximum.accumulate(np.where(np.append(True, ~large[:-1]), places, 0))  # large ones and the small one behind
        active = np.maximum.accumulate(np.where(wanted, places, -1)) >= run
    raw = data.tobytes()
    small = np.array(sorted(np.flatnonzero(~large & active).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    small_first = np.searchsorted(data[small], np.arange(257)) if len(small) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if active[-1]:
        waiting[data[-1]].append(np.array([n - 1]))
    out = []

    def induce(ready: np.ndarray, byte: int) -> np.ndarray:
        """Hand on the large suffixes before ``ready``; returns those of the same bucket."""
        before = ready[ready > 0] - 1
        before = before[large[before] & active[before]]
        first = data[before]
        here = before[first == byte]
        others = first > byte
        before, first = before[others], first[others]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            edges = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:]):
                waiting[first[a]].append(before[a:b])
        return here

    for byte in range(256):
        ready = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        while len(ready):  # large suffixes of this bucket, then those one byte longer in the same run
            out.append(ready)
            ready = induce(ready, byte)
        ready = small[small_first[byte] : small_first[byte + 1]]
        if len(ready):
            out.append(ready)
            induce(ready, byte)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the next one in order, up to ``most`` bytes."""
    if len(order) < 2:
        return np.zeros(max(len(order) - 1, 0), np.int64)
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    words = np.empty(len(data) + most + 1, np.uint64)  # the 8 bytes from each place on
    for shift in range(8):
        part = padded[shift : shift + (len(words) - shift) // 8 * 8 + 8]
        whole = part[: len(part) // 8 * 8].view(np.uint64)
        words[shift::8] = whole[: len(words[shift::8])]
    a, b = order[:-1], order[1:]
    room = np.minimum(len(data) - np.maximum(a, b), most)
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    at = 0
    while len(alive) and at < most:
        differ = words[a[alive] + at] ^ words[b[alive] + at]
        same = differ == 0
        ended = alive[~same]
        low = differ[~same]
        out[ended] = at + (np.bitwise_count(low ^ (low - np.uint64(1))).astype(np.int64) - 1) // 8
        alive = alive[same]
        at += 8
        out[alive] = at
    return np.minimum(out, room)


def repeated_starts(passages: list[bytes], length: int) -> list[np.ndarray]:
    """Starts of the strings of ``length`` bytes of each passage that occur in another of the passages, or twice in it."""
    lengths = np.array([len(p) for p in passages])
    data = np.frombuffer(b"".join(passages), np.uint8)
    ends = np.cumsum(lengths)
    fits = np.repeat(ends, lengths) - np.arange(len(data)) >= length
    order = suffix_array(data, length, fits)
    order = order[fits[order]]  # others stand between, but equal strings are next to each other
    equal = common_prefixes(data, order, length) >= length
    hit = np.zeros(len(order), bool)
    hit[:-1] |= equal
    hit[1:] |= equal
    found = np.sort(order[hit])
    edges = np.searchsorted(found, np.concatenate([[0], ends]))
    return [found[a:b] - start for a, b, start in zip(edges[:-1], edges[1:], (ends - lengths).tolist())]


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal ranges that the strings at ``starts`` (ascending) cover."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > length) + 1
    first = starts[np.concatenate([[0], new])]
    last = starts[np.concatenate([new - 1, [len(starts) - 1]])]
    return list(zip(first.tolist(), (last + length).tolist()))


# ---------------------------------------------------------------- anchors


def owned(place: np.ndarray, h: np.ndarray, row: np.ndarray, offsets: np.ndarray, settings: Settings):
    """First and last start of the strings of every anchor, of which it is the last least gram; none if last < first.

    The next gram that is as small ends an anchor's strings. Owners go up with the starts, so that an anchor's
    strings begin behind those of all anchors before it.
    """
    w = settings.length - settings.gram + 1
    last = np.minimum(place, offsets[row + 1] - settings.length)
    open_, step = np.arange(len(place)), 1
    while len(open_):
        open_ = open_[open_ + step < len(place)]
        open_ = open_[place[open_ + step] - place[open_] < w]
        ended = h[open_ + step] <= h[open_]
        last[open_[ended]] = np.minimum(last[open_[ended]], place[open_[ended] + step] - w)
        open_, step = open_[~ended], step + 1
    before = np.concatenate([[-1], np.maximum.accumulate(last)[:-1]]) if len(place) else last
    return np.maximum(before + 1, offsets[row]), last


def anchors(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the buffer and hash of every anchor: the least gram (the last of equal ones) of every ``length`` bytes."""
    g, w = settings.gram, settings.length - settings.gram + 1
    n = len(data) - g + 1
    none = np.empty(0, np.int64)
    if n < w:
        return none, none, np.empty(0, np.uint64)
    prefix = T.prefix_hash(data)
    h = T.mix((prefix[g:] - prefix[:-g]) * T._power(T._INVERSE, n))
    least = -_greatest(-h, w)[w - 1 :]  # two's complement turns the order of hashes above 0 round
    row = np.searchsorted(offsets, np.arange(n - w + 1), side="right") - 1
    whole = np.arange(n - w + 1) + settings.length <= offsets[row + 1]
    # The least of any string that holds a gram is at most that gram's hash; it is an anchor if some reach it.
    reach = _greatest(np.concatenate([np.where(whole, least, np.uint64(0)), np.zeros(w - 1, np.uint64)]), w)
    place = np.flatnonzero((reach == h) & (h > 0))
    return np.searchsorted(offsets, place, side="right") - 1, place, h[place]


def _greatest(values: np.ndarray, w: int) -> np.ndarray:
    """Greatest of the up to ``w`` values that end at each place: running maxima from both ends of blocks."""
    size = -(-len(values) // w) * w + w
    padded = np.zeros(size, np.uint64)
    padded[w - 1 : w - 1 + len(values)] = values  # the window of place i is padded[i : i + w]
    grid = padded.reshape(-1, w)
    ahead = np.maximum.accumulate(grid, axis=1).ravel()
    behind = np.maximum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(behind[: len(values)], ahead[w - 1 : w - 1 + len(values)])


# ---------------------------------------------------------------- the table


def _passages(piece: pa.RecordBatch, settings: Settings):
    """Of every anchor: row, start in the row, hash, and the digest, start and end of its passage; and the buffers."""
    data, offsets = T.buffers(piece.column("text"))
    row, place, h = anchors(data, offsets, settings)
    start, end = owned(place, h, row, offsets, settings)
    some = end >= start
    row, place, h, start, end = row[some], place[some], h[some], start[some], end[some] + settings.length
    digest = np.empty(0, np.uint64)
    if len(place):
        prefix = T.prefix_hash(data)
        digest = T.chain(T.span_hash(prefix, start, end), (place - start).astype(np.uint64))
    return data, offsets, row, h, digest, start - offsets[row], end - offsets[row]


def _strings(data, offsets, row, start, end, length):
    """Every string of ``length`` bytes in the given passages, once: row, start, hash and first bytes."""
    count = end - start - length + 1
    at = np.repeat(offsets[row] + start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.unique(at)
    row = np.searchsorted(offsets, at, side="right") - 1
    h = T.span_hash(T.prefix_hash(data), at, at + length)
    return row, at - offsets[row], h


SENT = ["bucket", "h", "digest", "k1", "k2", "start", "end", "many", "mark"]
MARK = "k1 long, k2 long, start int, end int"


def _pool(h, digest, k1, k2, start, end):
    """One of each (hash, digest), and whether there are more; the places of all that are not alone."""
    order = np.lexsort((digest, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (digest[order[1:]] != digest[order[:-1]])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(order)))
    many = sizes > 1
    repeated = order[np.repeat(many, sizes)]
    return order[first], many, repeated


def _joined(k1, k2, start, end):
    """The given ranges, those of a document that overlap as one."""
    order = np.lexsort((end, start, k2, k1))
    k1, k2, start, end = k1[order], k2[order], start[order], end[order]
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    document = np.cumsum(new) << 32
    reach = np.maximum.accumulate(document + end)
    new[1:] |= reach[:-1] < document[1:] + start[1:]
    first = np.flatnonzero(new)
    close = np.append(first[1:], len(k1)) - 1
    return k1[first], k2[first], start[first], (reach[close] - document[close]).astype(np.int32)


def _send(settings: Settings, buckets: int, sketch):
    """Packed anchors of every chunk of documents, a row a bucket; ranges known to be repeated go along in buckets below 0."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[tuple]] = [[], []]  # anchors, and strings of frequent anchors
        size = 0

        def flush():
            out = []
            for kind, parts in enumerate(waiting):
                if not sum(len(p[0]) for p in parts):
                    continue
                h, digest, k1, k2, start, end = (np.concatenate(c) for c in zip(*parts))
                take, many, repeated = _pool(h, digest, k1, k2, start, end)
                bucket = (h[take] % np.uint64(buckets)).astype(np.int64) + kind * buckets
                order = np.argsort(bucket, kind="stable")
                take, many, bucket = take[order], many[order], bucket[order]
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                for a, b in zip(edges[:-1], edges[1:]):
                    t = take[a:b]
                    out.append((int(bucket[a]), *(x[t].tobytes() for x in (h, digest, k1, k2, start, end)), many[a:b].tobytes(), None))
                if len(repeated):
                    k1, k2, start, end = _joined(k1[repeated], k2[repeated], start[repeated], end[repeated])
                    repeated = np.arange(len(k1))
                    out.append((-1 - int(k1[repeated[0]] % buckets), None, None, *(x[repeated].tobytes() for x in (k1, k2, start, end)), None, b"1"))
            columns = list(zip(*out)) if out else [()] * 9
            return pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], SENT)

        for batch in batches:
            for piece in T.pieces(batch):
                data, offsets, row, h, digest, start, end = _passages(piece, settings)
                if not len(h):
                    continue
                k1, k2 = (piece.column(k).to_numpy() for k in ("k1", "k2"))
                hot = sketch.value.counts(h) > settings.group
                cold = ~hot
                waiting[0].append((h[cold], digest[cold], k1[row[cold]], k2[row[cold]], start[cold].astype(np.int32), end[cold].astype(np.int32)))
                size += len(h)
                if hot.any():
                    r, s, w = _strings(data, offsets, row[hot], start[hot], end[hot], settings.length)
                    waiting[1].append((w, T.mix(w), k1[r], k2[r], s.astype(np.int32), (s + settings.length).astype(np.int32)))
                    size += len(w)
                if size > settings.chunk:
                    yield flush()
                    waiting, size = [[], []], 0
        if size:
            yield flush()

    return send


def _meet(buckets: int):
    """Repeated ranges of a bucket (group -1), and the passages that have to be sorted (group: their anchor)."""

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        column = lambda c, t: np.frombuffer(b"".join(rows[c]), t)
        k1, k2, start, end = column("k1", "i8"), column("k2", "i8"), column("start", "i4"), column("end", "i4")
        if key[0] < 0:
            return pd.DataFrame({"k1": k1, "k2": k2, "start": start, "end": end, "sorted": False, "anchor": np.int64(0)})
        h, digest, many = column("h", "u8"), column("digest", "u8"), column("many", bool)
        order = np.lexsort((digest, h))
        new = np.ones(len(order), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        fresh = new.copy()
        fresh[1:] |= digest[order[1:]] != digest[order[:-1]]
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.append(first, len(order)))
        repeated = np.repeat(sizes > 1, sizes)  # in another chunk; those of one chunk are known there
        whole = np.logical_or.reduceat(many[order], first) | (sizes > 1) if len(first) else np.zeros(0, bool)
        out = [(order[repeated], False)]
        if key[0] < buckets:  # one of each passage whose anchor has others, unless all are repeated anyway
            group = np.cumsum(new)[first] - 1
            differ, known = np.bincount(group), np.bincount(group, whole)
            out.append((order[first[(differ[group] > 1) & (known[group] < differ[group])]], True))
        return pd.concat([
            pd.DataFrame({"k1": k1[t], "k2": k2[t], "start": start[t], "end": end[t], "sorted": s, "anchor": h[t].view(np.int64)})
            for t, s in out
        ])

    return meet


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the passages that are asked for, those of a document joined where they overlap."""
    for batch in batches:
        data, offsets = T.buffers(batch.column("text"))
        out = []
        for i, (k1, k2, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "asked")))):
            by: dict[int, list] = {}
            for r in asked:
                by.setdefault(r["part"], []).append((r["start"], r["end"]))
            for part, ranges in by.items():
                for a, b in _merged(ranges):
                    out.append((part, k1, k2, a, data[offsets[i] + a : offsets[i] + b].tobytes()))
        columns = list(zip(*out)) if out else [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["part", "k1", "k2", "start", "passage"])


def _sort_passages(length: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["k1", "k2", "start"])  # equal rows of the table ask for the same
        out = []
        for k1, k2, start, places in zip(rows["k1"], rows["k2"], rows["start"], repeated_starts(rows["passage"].tolist(), length)):
            out += [(k1, k2, start + a, start + b) for a, b in covered(places, length)]
        return pd.DataFrame(out, columns=["k1", "k2", "start", "end"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without their marked ranges."""
    for batch in batches:
        for piece in T.pieces(batch):
            data, offsets = T.buffers(piece.column("text"))
            size, removed, spans, kept = [], [], [], []
            for a, b, marks in zip(offsets[:-1].tolist(), offsets[1:].tolist(), piece.column("marks").to_pylist()):
                ranges = _merged([(r["start"], r["end"]) for r in marks or ()])
                body = data[a:b].tobytes()
                parts, at = [], 0
                for s, e in ranges:
                    parts.append(body[at:s])
                    at = e
                parts.append(body[at:])
                size.append(b - a)
                removed.append(sum(e - s for s, e in ranges))
                spans.append(len(ranges))
                kept.append(b"".join(parts))
            long = pa.int64()
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array(size, long), pa.array(removed, long), pa.array(spans, long), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeats(
    docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row."""
    spark, length = docs.sparkSession, settings.length
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"), F.xxhash64(F.col(text), F.col(doc_id), F.lit(1)).alias("k2"),
    )
    long_rows = rows.filter(F.octet_length("text") >= length).select("text", "k1", "k2")
    size = long_rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = 2 * size // (length - settings.gram + 2)

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        found = []
        for piece in T.pieces(batch):
            _, _, _, h, digest, _, _ = _passages(piece, settings)
            found.append(np.stack([h, digest], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.uint64)
        return pairs[:, 0]

    sketch = spark.sparkContext.broadcast(Sketch(count_keys(long_rows.select("text"), keys, number)))
    buckets = max(1, math.ceil(number / settings.bucket))
    schema = "bucket long, " + ", ".join(f"{c} binary" for c in SENT[1:])
    sent = long_rows.mapInArrow(_send(settings, buckets, sketch), schema)
    met = settle(
        sent.repartition(buckets, "bucket").groupBy("bucket")
        .applyInPandas(_meet(buckets), f"{MARK}, sorted boolean, anchor long")
    )
    asked = met.filter("sorted")
    parts = max(1, math.ceil((asked.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0) / settings.sorted_bytes))
    asked = asked.select("k1", "k2", F.struct(F.pmod(F.xxhash64("anchor"), F.lit(parts)).alias("part"), "start", "end").alias("r"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_set("r").alias("asked"))
    texts = long_rows.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "asked")
    passages = texts.mapInArrow(_fetch, "part long, k1 long, k2 long, start int, passage binary")
    found = passages.repartition(parts, "part").groupBy("part").applyInPandas(_sort_passages(length), MARK)
    marks = met.filter("NOT sorted").select("k1", "k2", "start", "end").unionByName(found)
    marks = marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("marks"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "marks").mapInArrow(
        _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
