"""A count-min sketch of 64-bit keys: its counts are never too small."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbrow.llm import text as T

ROWS = 2
BITS = (16, 24)  # least and most; the table has at most 2 * 2**24 counters of 4 bytes
PART = 14


def _place(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (T.mix(keys + np.uint64(row + 7)) >> np.uint64(64 - bits)).astype(np.int64)


class Sketch:
    def __init__(self, table: np.ndarray):
        self.table, self.bits = table, int(table.shape[1]).bit_length() - 1

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([self.table[row][_place(keys, row, self.bits)] for row in range(ROWS)])


def count_keys(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], expected: int) -> np.ndarray:
    """Counters of the keys that ``keys`` finds in every batch of ``rows``, sized by their expected number."""
    bits = min(max((int(expected) // 16).bit_length(), BITS[0]), BITS[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, out = keys(batch), []
            for row in range(ROWS):
                at, n = np.unique(_place(found, row, bits), return_counts=True)
                out += [(row, *p) for p in T.packed(at >> PART, (at & ((1 << PART) - 1)).astype(np.uint32), n.astype(np.uint32))]
            columns = list(zip(*out)) if out else [()] * 4
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["row", "part", "at", "n"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << PART, np.int64)
        for at, n in zip(rows["at"], rows["n"]):
            total += np.bincount(T.from_planes(at, "u4"), T.from_planes(n, "u4"), 1 << PART).astype(np.int64)
        return pd.DataFrame({"row": [key[0]], "part": [key[1]], "n": [total.clip(max=2**32 - 1).astype(np.uint32).tobytes()]})

    parts = rows.mapInArrow(count, "row long, part long, at binary, n binary")
    parts = parts.groupBy("row", "part").applyInPandas(add, "row long, part long, n binary").toPandas()
    table = np.zeros((ROWS, 1 << bits), np.uint32)
    for r in parts.itertuples(index=False):
        table[r.row, r.part << PART : (r.part + 1) << PART] = np.frombuffer(r.n, np.uint32)
    return table
