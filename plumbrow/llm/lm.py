"""Language-model scoring from a log-frequency Bloom filter.

Counts are quantised to levels, ``1 + floor(log_b count)``, and an n-gram enters the filter once
for each level it reaches, so that probing level 1, 2, … until the first miss gives its count
back. N-grams are hashed to buckets; every bucket is a filter of its own, sized by its entries and
built by one task, so neither counting nor building has a step that sees everything.

The model is a chain of Dirichlet-smoothed estimates, all counts taken from the filter:
``P(w) = (c(w) + 1) / (N + V + 1)`` and ``P(w | u) = (c(u w) + m P(w)) / (c(u) + m)``, and so on
for longer contexts. Every text ends with one end token.

A filter of up to ``broadcast_bytes`` is broadcast. A larger one stays where it is: the distinct
n-grams of every block of texts travel to their buckets, and their levels travel back. Both ways
read the same bits and give the same scores.

Null and empty texts are the end token alone. Repeated rows are scored each. An empty table
gives no rows; with no training rows all counts are 0. Other columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.llm import text as T
from plumbrow.session import scratch_path, settle

END = np.uint64(0x5851F42D4C957F2D)
BEGIN = np.uint64(0x14057B7EF767814F)
HEAD = 1 << 21  # at most so many tokens can each hold a share of 1 / HEAD of all tokens
BUFFER = 1_000_000  # tokens that a task pools before it passes them on


@dataclass(frozen=True)
class Settings:
    order: int = 2
    base: float = 1.5  # of the quantiser
    probes: int = 8  # hash functions: a miss is taken for a hit once in 2**probes
    prior: tuple[float, ...] = (200.0, 50.0, 50.0, 50.0)  # m of orders 2, 3, …
    bucket_tokens: int = 2_000_000
    broadcast_bytes: int = 160 << 20
    block_bytes: int = 16 << 20  # texts that travel together when the filter is too large


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one end token after every row, and the row of each."""
    h, row = T.word_hashes(column)
    rows = len(column)
    counts = np.bincount(row, minlength=rows)
    at = np.arange(len(h)) + row
    out = np.full(len(h) + rows, END)
    out[at] = h
    return out, np.repeat(np.arange(rows), counts + 1)


def _number(key: np.ndarray, order: int) -> np.ndarray:
    return T.mix(key + np.uint64(order))


def grams(h: np.ndarray, row: np.ndarray, order: int) -> list[np.ndarray]:
    """For every order, the n-gram that ends at each token.

    Texts are preceded by begin marks, so that every token has an n-gram of every order. The
    context of a token is then the n-gram one order shorter at the token before it, or at the
    first token of a text a run of begin marks.
    """
    begin = _begins(row)
    back = [h]  # the tokens 0, 1, … places before
    for _ in range(1, order):
        shifted = np.concatenate([[BEGIN], back[-1][:-1]])
        shifted[begin] = BEGIN
        back.append(shifted)
    out = [_number(h, 1)]
    for n in range(2, order + 1):
        run = back[n - 1]
        for k in range(n - 2, -1, -1):
            run = T.chain(run, back[k])
        out.append(_number(run, n))
    return out


def _begins(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)


def _marks(order: int) -> np.ndarray:
    """The contexts of begin marks alone, which every text has once."""
    run, out = np.array([BEGIN]), []
    for n in range(1, order):
        out.append(_number(run, n))
        run = T.chain(run, np.array([BEGIN]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _split(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit print of an n-gram."""
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), key.astype(np.uint32)


class _Counter:
    """Pools n-gram or token counts of a task."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def take(self) -> tuple[np.ndarray, ...]:
        out = T.pooled(*(np.concatenate(c) for c in zip(*self.parts)))
        self.parts, self.size = [], 0
        return out


def token_counts(docs: DataFrame, train: Column) -> DataFrame:
    """Distinct token hashes with their counts in training texts and in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Counter()

        def flush():
            h, n, total = pool.take()
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n), pa.array(total)], ["h", "n", "total"])

        for batch in batches:
            for piece in T.pieces(batch):
                h, row = tokens(piece.column("text"))
                learnt = piece.column("learnt").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                pool.add(*T.pooled(h, learnt, np.ones(len(h), np.int64)))
                if pool.size > BUFFER:
                    yield flush()
        if pool.size:
            yield flush()

    rows = docs.select("text", train.alias("learnt")).mapInArrow(count, "h long, n long, total long")
    return rows.groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _bucket_counts(train: DataFrame, settings: Settings, buckets: int) -> DataFrame:
    """Counted n-grams of every task, packed by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Counter()

        def flush():
            key, n = pool.take()
            found = list(T.packed(*_split(key, buckets), np.minimum(n, 2**32 - 1).astype(np.uint32)))
            return pa.record_batch(
                [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                ["bucket", "prints", "counts"],
            )

        for batch in batches:
            for piece in T.pieces(batch):
                h, row = tokens(piece.column("text"))
                marks = np.repeat(_marks(settings.order), piece.num_rows)
                keys = np.concatenate([marks, *grams(h, row, settings.order)])
                pool.add(*T.pooled(keys, np.ones(len(keys), np.int64)))
                if pool.size > BUFFER:
                    yield flush()
        if pool.size:
            yield flush()

    return train.select("text").mapInArrow(count, "bucket long, prints binary, counts binary")


def _hash_pair(prints: np.ndarray, bucket, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the positions of (n-gram, level) in its bucket's bits."""
    seed = (np.asarray(bucket).astype(np.uint64) << np.uint64(32)) + prints.astype(np.uint64)
    h = T.mix(seed * np.uint64(0x9FB21C651E98DF25) + np.uint64(level))
    return h, T.mix(h) | np.uint64(1)


def _place(a: np.ndarray, size) -> np.ndarray:
    """The upper half of a hash, scaled to a position below ``size`` (under 2**32)."""
    return (((a >> np.uint64(32)) * size) >> np.uint64(32)).astype(np.int64)


def _levels(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def _level_values(base: float) -> np.ndarray:
    """The count that a level stands for: the middle of the counts that reach it. Level 0 is 0."""
    edges = np.ceil(base ** np.arange(0, 130) - 1e-9)
    values = [0.0]
    for low, high in zip(edges, edges[1:]):
        values.append((low + max(high - 1, low)) / 2)
    return np.array(values)


def _build(settings: Settings):
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        prints, counts = T.pooled(
            np.concatenate([T.from_planes(b, "u4") for b in rows["prints"]]),
            np.concatenate([T.from_planes(b, "u4") for b in rows["counts"]]).astype(np.int64),
        )
        levels = _levels(counts, settings.base)
        size = max(64, math.ceil(levels.sum() * settings.probes / math.log(2)))
        bits = np.zeros(size, bool)
        for level in range(1, int(levels.max()) + 1):
            a, step = _hash_pair(prints[levels >= level], key[0], level)
            for _ in range(settings.probes):
                bits[_place(a, np.uint64(size))] = True
                a += step
        return pd.DataFrame({"bucket": [key[0]], "size": [size], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    return build


@dataclass
class Filter:
    """Buckets of bits laid end to end, each from a byte boundary."""

    bits: np.ndarray
    start: np.ndarray
    size: np.ndarray
    probes: int

    @classmethod
    def of(cls, rows, buckets: int, probes: int, length: int) -> Filter:
        """From (bucket, size, bits) rows of ``length`` bytes in all; a bucket without a row is empty."""
        start, size = np.zeros(buckets, np.int64), np.zeros(buckets, np.uint64)
        bits, at = np.empty(length, np.uint8), 0
        for bucket, n, blob in rows:
            start[bucket], size[bucket] = at * 8, n
            bits[at : at + len(blob)] = np.frombuffer(blob, np.uint8)
            at += len(blob)
        return cls(bits, start, size, probes)

    def levels(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Probe level after level until the first miss."""
        out = np.zeros(len(prints), np.int64)
        alive, level = np.flatnonzero(self.size[bucket] > 0), 1
        while len(alive):
            alive = self._holding(bucket, prints, alive, level)
            out[alive] = level
            level += 1
        return out

    def _holding(self, bucket, prints, alive, level):
        """Those of ``alive`` that hold every position of a level; misses leave in batches."""
        at_bucket = bucket[alive]
        a, step = _hash_pair(prints[alive], at_bucket, level)
        size, start = self.size[at_bucket], self.start[at_bucket]
        left = np.ones(len(alive), bool)
        for i in range(self.probes):
            at = start + _place(a, size)
            hit = self.bits.take(at >> 3)
            hit >>= (at & 7).astype(np.uint8)
            left &= (hit & 1).view(bool)
            a += step
            if np.count_nonzero(left) < 0.6 * len(left) or i == self.probes - 1:
                alive = alive[left]
                if i < self.probes - 1:
                    a, step, size, start = a[left], step[left], size[left], start[left]
                    left = np.ones(len(alive), bool)
        return alive


def _looked_up(key: np.ndarray, lookup, buckets: int) -> np.ndarray:
    """Levels of n-grams: the distinct ones are probed bucket by bucket, so that probes stay close together."""
    bucket, prints = _split(key, buckets)
    code, where = np.unique((bucket.astype(np.uint64) << np.uint64(32)) | prints, return_inverse=True)
    return lookup((code >> np.uint64(32)).astype(np.int64), code.astype(np.uint32))[where]


def _score(h: np.ndarray, row: np.ndarray, rows: int, distinct: np.ndarray, where: np.ndarray, lookup, model: Model) -> np.ndarray:
    """log10 probability of every row; ``distinct[where]`` are the tokens."""
    if not len(h):
        return np.zeros(rows)
    value, begin, marks = _level_values(model.settings.base), _begins(row), _marks(model.settings.order)
    seen = value[_looked_up(_number(distinct, 1), lookup, model.buckets)][where]
    probability = (seen + 1) / (model.n + model.v + 1)
    for n, full in enumerate(grams(h, row, model.settings.order)[1:], start=2):
        total = np.concatenate([[0], seen[:-1]])
        total[begin] = value[lookup(*_split(marks[n - 2 : n - 1], model.buckets))]
        seen = np.minimum(value[_looked_up(full, lookup, model.buckets)], total)
        prior = model.settings.prior[min(n - 2, len(model.settings.prior) - 1)]
        probability = (seen + prior * probability) / (total + prior)
    return np.bincount(row, np.log10(probability), minlength=rows)


def _emit(piece: pa.RecordBatch, lookup, head: tuple[np.ndarray, np.ndarray], model: Model) -> pa.RecordBatch:
    """One row a text, and one a distinct rare token of a text, whose count is yet to be joined."""
    h, row = tokens(piece.column("text"))
    rows = piece.num_rows
    distinct, where = np.unique(h, return_inverse=True)
    score = _score(h, row, rows, distinct, where, lookup, model)
    at = np.searchsorted(head[0], distinct)
    at[at == len(head[0])] = 0
    common = head[0][at] == distinct if len(head[0]) else np.zeros(len(distinct), bool)
    count = np.where(common, head[1][at], 0) if len(head[0]) else np.zeros(len(distinct), np.int64)
    is_common, counts = common[where], count[where]
    base = np.bincount(row[is_common], np.log10((counts[is_common] + 1) / (model.n + model.v + 1)), minlength=rows)
    known = np.bincount(row[is_common & (counts > 0)], minlength=rows)
    pair, times = T.pooled(row[~is_common] * len(distinct) + where[~is_common], np.ones((~is_common).sum(), np.int64))
    owner, token = (pair // len(distinct), distinct[pair % len(distinct)]) if len(pair) else (pair, distinct[:0])
    key = piece.column("key").to_numpy(zero_copy_only=False)
    take = np.concatenate([np.arange(rows), owner]).astype(np.int64)
    zeros = np.zeros(len(owner), np.int64)
    return pa.record_batch(
        [
            pa.array(key[take]),
            piece.column("doc_id").take(pa.array(take)), piece.column("held_out").take(pa.array(take)),
            pa.array(np.concatenate([T.mix(key.view(np.uint64)), token]).view(np.int64)),
            pa.array(np.concatenate([np.zeros(rows, np.int64), times])),
            pa.array(np.concatenate([np.bincount(row, minlength=rows), zeros])),
            pa.array(np.concatenate([known, zeros])),
            pa.array(np.concatenate([base, zeros.astype(float)])),
            pa.array(np.concatenate([score, zeros.astype(float)])),
        ],
        ["key", "doc_id", "held_out", "h", "times", "n_tokens", "n_known", "base_score", "score"],
    )


SCORED = (
    "key long, doc_id string, held_out boolean, h long, times long, n_tokens long, n_known long, base_score double, score double"
)


@dataclass
class Model:
    """A fitted model: the stored filter, the stored token counts and the totals."""

    settings: Settings
    buckets: int
    n: int
    v: int
    limit: float  # tokens of at least so many occurrences are common
    counts: DataFrame = field(repr=False)
    filter: DataFrame = field(repr=False)

    def _plain(self) -> Model:
        return Model(self.settings, self.buckets, self.n, self.v, self.limit, None, None)

    def score(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
        spark = docs.sparkSession
        rows = docs.select(
            F.monotonically_increasing_id().alias("key"), F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"),
            (F.lit(False) if held_out is None else held_out).alias("held_out"),
        )
        common = self.counts.filter(F.col("total") >= self.limit).select("h", "n").toArrow()
        h = common["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        head = spark.sparkContext.broadcast((h[order], common["n"].to_numpy()[order]))
        size = self.filter.agg(F.sum(F.length("bits"))).first()[0] or 0
        near = size <= self.settings.broadcast_bytes
        flat = self._near(rows, head, size) if near else self._far(rows, head)
        rare = self.counts.filter(F.col("total") < self.limit).select(F.col("h").alias("token"), F.col("n").alias("c"))
        d = float(self.n + self.v + 1)
        c = F.coalesce("c", F.lit(0))
        joined = flat.join(rare, F.col("h") == F.col("token"), "left").select(
            "key", "doc_id", "held_out", "n_tokens", "score",
            (F.col("n_known") + F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"),
            (F.col("base_score") + F.col("times") * F.log10((c + 1) / d)).alias("base_score"),
        )
        # Every row of a key has its id: grouping by both keeps the hash aggregate.
        return joined.groupBy("key", "doc_id", "held_out").agg(
            F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
            F.lit(self.n).cast("long").alias("train_tokens"),
            F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
        ).drop("key").withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))

    def _near(self, rows: DataFrame, head, size: int) -> DataFrame:
        """The whole filter, of ``size`` bytes, is broadcast; the driver holds one copy of it."""
        parts = self.filter.select("bucket", "size", "bits").toLocalIterator()
        bits = rows.sparkSession.sparkContext.broadcast(Filter.of(parts, self.buckets, self.settings.probes, size))
        model = self._plain()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in T.pieces(batch):
                    yield _emit(piece, bits.value.levels, head.value, model)

        return rows.mapInArrow(run, SCORED)

    def _far(self, rows: DataFrame, head) -> DataFrame:
        """N-grams travel to their buckets and their levels back, block by block."""
        model = self._plain()
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(1, math.ceil(size / self.settings.block_bytes))
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
        types = pa.schema([("key", pa.int64()), ("doc_id", pa.string()), ("text", pa.string()), ("held_out", pa.bool_())])

        def wanted(column) -> np.ndarray:
            h, row = tokens(column)
            bucket, prints = _split(np.concatenate([_marks(model.settings.order), *grams(h, row, model.settings.order)]), model.buckets)
            return np.unique((bucket.astype(np.uint64) << np.uint64(32)) | prints)

        def ask(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            code = wanted(pa.array(part["text"], pa.string(), from_pandas=True))
            bucket = (code >> np.uint64(32)).astype(np.int64)
            found = [(key[0], b, p) for b, p in T.packed(bucket, code.astype(np.uint32))]
            return pd.DataFrame(found, columns=["block", "bucket", "prints"])

        def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            part = Filter.of(
                held[["bucket", "size", "bits"]].itertuples(index=False), model.buckets, model.settings.probes, sum(map(len, held["bits"])),
            )
            levels = [
                part.levels(np.full(len(p) // 4, b), T.from_planes(p, "u4")).astype(np.uint8).tobytes()
                for b, p in zip(asked["bucket"], asked["prints"])
            ]
            return asked.assign(levels=levels)[["block", "bucket", "prints", "levels"]]

        def finish(told: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            told = told.sort_values("bucket")
            code = np.concatenate(
                [(np.uint64(b) << np.uint64(32)) | T.from_planes(p, "u4") for b, p in zip(told["bucket"], told["prints"])]
            )
            levels = np.concatenate([np.frombuffer(x, np.uint8) for x in told["levels"]]).astype(np.int64)

            def lookup(bucket, prints):
                return levels[np.searchsorted(code, (bucket.astype(np.uint64) << np.uint64(32)) | prints)]

            batch = pa.RecordBatch.from_pandas(part[types.names], types, preserve_index=False)
            return pa.Table.from_batches([_emit(p, lookup, head.value, model) for p in T.pieces(batch)]).to_pandas()

        asked = dealt.groupBy("block").applyInPandas(ask, "block long, bucket long, prints binary")
        told = asked.groupBy("bucket").cogroup(self.filter.groupBy("bucket")).applyInPandas(
            answer, "block long, bucket long, prints binary, levels binary"
        )
        return told.groupBy("block").cogroup(dealt.groupBy("block")).applyInPandas(finish, SCORED)


def fit(docs: DataFrame, text: str = "text", train: Column | None = None, settings: Settings = Settings()) -> Model:
    """Count the n-grams of the rows where ``train`` holds (all by default) and build the filter.

    The counts of single tokens are kept exactly as well, for the base score.
    """
    rows = docs.select(F.col(text).alias("text"), (F.lit(True) if train is None else train).alias("learnt"))
    counts = settle(token_counts(rows, F.col("learnt")))
    n, v, total = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("total"), F.lit(0))
    ).first()
    buckets = max(1, math.ceil(n * settings.order / settings.bucket_tokens))
    packed = _bucket_counts(rows.filter("learnt"), settings, buckets)
    built = packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(
        _build(settings), "bucket long, size long, bits binary"
    )
    path = scratch_path(docs.sparkSession, "filter")
    built.write.parquet(path)
    stored = docs.sparkSession.read.schema("bucket long, size long, bits binary").parquet(path)
    return Model(settings, buckets, int(n), int(v), max(total / HEAD, 1), counts, stored)
