"""Words, hashes and packed columns of Arrow batches, computed on whole byte buffers with NumPy.

Texts are UTF-8. A word is a longest run of bytes other than 0x20 and 0x09-0x0D; A-Z count as
a-z. Null texts are empty. Hashes have 64 bits: a polynomial over random byte values, finished
by a mixing function, so they do not depend on where a word stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
HASH_BYTES = 512 << 10  # texts whose words are hashed at a time; this takes some 50 times as much memory
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit moves every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_WORD = ~_SPACE
# ASCII letters and digits, and every byte of a character beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_FOLDED = _BYTES[_LOWER]


def _power(base: int, n: int) -> np.ndarray:
    """``base ** 0 … base ** (n - 1)`` modulo 2**64, kept for later calls."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(n - 1, 1).bit_length()
        known = np.full(size, np.uint64(base & _MASK))
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[base] = known
    return known[:n]


def prefix_hash(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Running polynomial hash, from which :func:`span_hash` takes the hash of any span."""
    values = (_FOLDED if fold else _BYTES)[data]
    values *= _power(_BASE, len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers = _power(_INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * powers[starts] + (ends - starts).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the row offsets into them; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, or one longer row."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = max(last, first + 1)
        yield batch.slice(first, last - first)
        first = last


def word_spans(
    data: np.ndarray, offsets: np.ndarray, letters: bool = False,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows. ``letters``: punctuation ends a word too."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    inside = (_LETTER if letters else _WORD)[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(column: pa.Array, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a text column, in order."""
    data, offsets = buffers(column)
    starts, ends, row = word_spans(data, offsets, letters)
    if not len(starts):
        return np.empty(0, np.uint64), row
    return span_hash(prefix_hash(data, fold=True), starts, ends), row


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted within the row, and the offsets of the rows.

    A row with fewer than ``width`` words has one shingle, its whole sequence; a row without
    words has none.
    """
    h, row = word_hashes(column)
    rows = len(column)
    counts = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    keys, owner = [], []
    if len(h) >= width:
        n = len(h) - width + 1
        grams = h[:n].copy()
        for k in range(1, width):
            grams = chain(grams, h[k : n + k])
        whole = row[:n] == row[width - 1 :]
        keys.append(grams[whole])
        owner.append(row[:n][whole])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        g = h[first[short]].copy()
        for k in range(1, width):
            more = counts[short] > k
            g[more] = chain(g[more], h[first[short[more]] + k])
        keys.append(mix(g + counts[short].astype(np.uint64)))  # apart from every full shingle
        owner.append(short)
    if not keys:
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[keep], own[keep]
    return key, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=rows))])


def planes(values: np.ndarray) -> bytes:
    """Fixed-width integers as byte planes: sorted ones then compress well in a shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(blob: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pooled(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of their weights."""
    if not len(keys):
        return (keys, *weights)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[begin], *(np.add.reduceat(w[order], begin) for w in weights))


def packed(bucket: np.ndarray, prints: np.ndarray, *weights: np.ndarray) -> Iterator[tuple]:
    """(bucket, prints, weights …) with byte planes, one entry a bucket; prints of 32 bits ascend."""
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | prints)
    bucket, prints = bucket[order], prints[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(bucket[a]), planes(prints[a:b]), *(planes(w[order[a:b]]) for w in weights)
