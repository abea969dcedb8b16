"""Exact top-k search by inner product, term at a time.

Rows are sparse integer vectors. A task takes a chunk of candidates and turns it into postings:
for every term the rows that hold it and their weights. Every query of the block scatters its
weights times these postings into one dense score array, selects its best entries by
partition, and only those leave the task; they are merged by query. Queries come in blocks of bounded size, each
broadcast by itself, so neither the driver nor a task holds more than one block of queries and
one chunk of candidates; every candidate is scored.

Rows whose id or vector is null, or whose vector holds a null, NaN or infinite component, take
no part. Vectors of different lengths are compared on the terms they share. A query never meets
a row of its own id; repeated rows are candidates each; a query without candidates has no rows.
Scores are 64-bit integers; ties go to the smaller id, then to equal rows in any order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbrow.session import settle

QUERY_BLOCK = 4096
CHUNK = 16384


def quantised(vector: Column, scale: int = 256) -> Column:
    """Array of ``floor(scale * x)``, or null if the array holds anything but finite numbers."""
    doubles = vector.cast("array<double>")
    good = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(doubles, lambda x: F.floor(x * scale)))


def _postings(lists: pa.Array) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For every term: the rows that hold it, and their weights."""
    lists = lists.cast(pa.large_list(pa.int64()))
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(len(lists)), counts)
    terms = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], counts)
    there = values != 0
    rows, terms, values = rows[there], terms[there], values[there]
    order = np.argsort(terms, kind="stable")
    rows, terms, values = rows[order], terms[order], values[order]
    edges = np.searchsorted(terms, np.arange(int(terms[-1]) + 2 if len(terms) else 1))
    return [(rows[a:b], values[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, then smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _scan(queries, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = queries.value
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                chunk = batch.slice(first, CHUNK)
                ids = chunk.column("vec_id").to_numpy()
                postings = _postings(chunk.column("vector"))
                found = []
                for query, (terms, weights) in zip(query_ids, vectors):
                    scores = np.zeros(len(ids), np.int64)
                    for term, weight in zip(terms, weights):
                        if term < len(postings):
                            rows, values = postings[term]
                            if len(rows) == len(ids):
                                scores += weight * values
                            else:
                                scores[rows] += weight * values
                    others = np.flatnonzero(ids != query)
                    at = others[_best(scores[others], ids[others], k)]
                    found.append((np.full(len(at), query), ids[at], scores[at]))
                if found:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "score"])

    return scan


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every query row.

    ``vector`` is an ``array<bigint>`` column; ``is_query`` is a condition on the id column.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = settle(rows.filter("vec_id IS NOT NULL AND vector IS NOT NULL"))
    asked = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asked"))
    asked = asked.filter("asked AND vec_id IS NOT NULL AND vector IS NOT NULL").select("vec_id", "vector").dropDuplicates(["vec_id"])
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    asked = settle(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    spark, parts = vectors.sparkSession, None
    for block in range(blocks):
        queries = asked.filter(F.col("block") == block).select("vec_id", "vector").toArrow()
        sparse = []
        for values in queries["vector"].to_pylist():
            dense = np.array(values, np.int64)
            sparse.append((np.flatnonzero(dense), dense[dense != 0]))
        sent = spark.sparkContext.broadcast((queries["vec_id"].to_numpy(), sparse))
        best = _ranked(rows.mapInArrow(_scan(sent, k), "query_id long, vec_id long, score long"), k)
        if blocks > 1:
            best = settle(best)
            sent.unpersist()
        parts = best if parts is None else parts.unionByName(best)
    return parts


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
