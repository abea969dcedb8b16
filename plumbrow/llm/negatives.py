"""Hard negatives by inner product: rows of another label that score a little below an anchor's positives.

Candidates lie in buckets of similar length. A task holds one tile of a bucket, with the
coordinates of its normalised vectors as sorted lists. An anchor that looks for scores of at
least t needs a cosine of at least ``t / (|anchor| * longest)`` in that tile; a cosine above one
skips the tile. Otherwise the angle that is left around the anchor bounds every coordinate, so the
lists of the anchor's focus coordinates (its largest ones) are cut to the feasible range, and only
rows that lie in all ranges are verified by their integer inner product.

A first search finds the positives, the best rows of the anchor's own label: the rows at the end of an
anchor's focus lists give the bound, which the k-th best of them has reached already. A second search finds
the negatives: the bound is the lowest share of any positive's score. Anchors are dealt in blocks
to the tiles, so no group holds more than a block and a tile; the best of all tiles are merged by a window.

Rows whose id, label or vector is null, or whose vector holds a null, take no part. Vectors of
different lengths are compared on the components they share. An anchor never meets a row of its own
id; of several rows with an anchor's id the least label and vector is the anchor. Repeated rows
are candidates each, equal scores go to the smaller id, then to equal rows in any order. A label with a single row has no positives, an anchor
without positives or without fitting rows no negatives; an empty table gives no rows. Other columns are not read.
Scores are exact while lengths multiply to less than 2**62.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbrow.session import settle

FOUND = "anchor_id long, found_id long, score long"
MINED = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Settings:
    k: int = 5
    low: int = 80  # a negative has at least this percentage of the positive's score, and at most all of it
    focus: int = 4  # coordinates whose lists are intersected
    tile: int = 8192  # candidates a group
    block: int = 1024  # anchors a group
    buckets: int = 64  # length buckets at most
    cells: int = 1 << 22  # vector components a tile or block


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows of integers, zeros after their end."""
    lists = pa.chunked_array([c.cast(pa.large_list(pa.int64())) for c in column.chunks], pa.large_list(pa.int64())).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max([width, *sizes])), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Tile:
    """Candidates of one length bucket, and the sorted lists of their coordinates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, focus: int):
        self.ids, self.vectors, self.focus = ids, vectors, focus
        self.exact = vectors.astype(np.float64)
        self.length = np.sqrt((self.exact**2).sum(axis=1))
        self.unit = self.exact / np.where(self.length > 0, self.length, 1)[:, None]
        self.longest, self.shortest = self.length.max(initial=0.0), self.length.min(initial=math.inf)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of a coordinate in order, and the rows that hold them."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = self.unit[order, f], order
        return self.lists[f]

    def _products(self, rows: np.ndarray, anchor: np.ndarray, length: float) -> np.ndarray:
        if length * self.longest < 2**52:  # every partial sum is an exact double
            return (self.exact[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ anchor

    def seeded(self, anchor: np.ndarray, k: int, others: np.ndarray) -> int | None:
        """A score that at least k candidates reach: the k-th best at the ends of the focus lists."""
        length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        ends = []
        for f in np.argsort(-np.abs(anchor), kind="stable")[: self.focus]:
            order = self._list(int(f))[1]
            ends.append(order[-8 * k :] if anchor[f] > 0 else order[: 8 * k])
        rows = np.unique(np.concatenate(ends)) if ends else np.empty(0, np.int64)
        rows = rows[others[rows]]
        if len(rows) < k:
            return None
        scores = self._products(rows, anchor, length)
        return int(np.partition(scores, len(rows) - k)[len(rows) - k])

    def reaching(self, anchor: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose inner product with ``anchor`` is at least ``least`` (any, if None), and the products."""
        length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        rows = self._feasible(anchor, length, least)
        scores = self._products(rows, anchor, length)
        if least is not None:
            good = scores >= least
            rows, scores = rows[good], scores[good]
        return rows, scores

    def _feasible(self, anchor: np.ndarray, length: float, least: int | None) -> np.ndarray:
        every = np.arange(len(self.ids))
        if least is None or not len(every):
            return every
        # The least cosine of any row here that can reach the score.
        reach = length * (self.longest if least > 0 else self.shortest)
        if reach == 0:
            return every if least <= 0 else every[:0]
        cosine = least / reach - 1e-9
        if cosine > 1:
            return every[:0]
        if cosine <= -1:
            return every
        angle = math.acos(cosine) + 1e-7
        ranges = []
        for f in np.argsort(-np.abs(anchor), kind="stable")[: self.focus]:
            own = math.acos(max(-1.0, min(1.0, anchor[f] / length)))
            low = math.cos(min(math.pi, own + angle)) - 1e-9
            high = math.cos(max(0.0, own - angle)) + 1e-9
            values, order = self._list(int(f))
            first, last = np.searchsorted(values, low), np.searchsorted(values, high, side="right")
            if last - first < len(every):
                ranges.append((last - first, int(f), low, high, order[first:last]))
        if not ranges:
            return every
        ranges.sort(key=lambda r: r[0])
        rows = ranges[0][4]
        for _, f, low, high, _ in ranges[1:]:
            rows = rows[(self.unit[rows, f] >= low) & (self.unit[rows, f] <= high)]
        return np.sort(rows)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, then smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _positives(settings: Settings):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
        if held.num_rows and asked.num_rows:
            vectors = _matrix(held["vector"])
            anchors = _matrix(asked["vector"], vectors.shape[1])
            tile = Tile(held["vec_id"].to_numpy(), vectors, settings.focus)
            for own, anchor in zip(asked["vec_id"].to_numpy(), anchors[:, : vectors.shape[1]]):
                others = tile.ids != own
                rows, scores = tile.reaching(anchor, tile.seeded(anchor, settings.k, others))
                rows, scores = rows[others[rows]], scores[others[rows]]
                at = _best(scores, tile.ids[rows], settings.k)
                for column, values in zip(columns, (np.full(len(at), own), tile.ids[rows[at]], scores[at])):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in columns], ["anchor_id", "found_id", "score"])

    return run


def _negatives(settings: Settings):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in names]
        if held.num_rows and asked.num_rows:
            vectors = _matrix(held["vector"])
            anchors = _matrix(asked["vector"], vectors.shape[1])
            tile, labels = Tile(held["vec_id"].to_numpy(), vectors, settings.focus), held["label"].to_numpy()
            facts = zip(asked["vec_id"].to_numpy(), asked["label"].to_numpy(), asked["positives"].to_pylist(), anchors[:, : vectors.shape[1]])
            for own, label, positives, anchor in facts:
                lows = [-(-settings.low * p["score"] // 100) for p in positives]  # rounded up
                rows, scores = tile.reaching(anchor, min(lows))
                good = (labels[rows] != label) & (tile.ids[rows] != own)
                rows, scores = rows[good], scores[good]
                order = np.lexsort((tile.ids[rows], -scores))
                ids, scores = tile.ids[rows[order]], scores[order]
                for p, low in zip(positives, lows):
                    first = np.searchsorted(-scores, -p["score"])
                    last = min(np.searchsorted(-scores, -low, side="right"), first + settings.k)
                    n = max(last - first, 0)
                    values = (np.full(n, own), np.full(n, p["id"]), ids[first:last], np.full(n, p["score"]), scores[first:last])
                    for column, part in zip(columns, values):
                        column.append(part)
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in columns], names)

    return run


def _dealt(rows: DataFrame, asked: DataFrame, settings: Settings, width: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Tiles of candidates and the anchors they meet, inside a ``pool``.

    A pool's rows in one length bucket are cut into as many tiles as their number asks for, its anchors
    into blocks; every tile meets every block.
    """
    tile = max(1, min(settings.tile, settings.cells // width))
    block = max(1, min(settings.block, settings.cells // width))
    total, pools = rows.agg(F.count("*"), F.count_distinct("pool")).first()
    buckets = max(1, min(settings.buckets, total // (tile * max(pools, 1))))
    cuts = rows.agg(F.percentile_approx("length", [i / buckets for i in range(1, buckets)])).first()[0] if buckets > 1 else []
    rows = rows.withColumn("bucket", sum(((F.col("length") > c).cast("int") for c in sorted(set(cuts))), F.lit(0)))
    tiles = rows.groupBy("pool", "bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    blocks = asked.groupBy("pool").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = tiles.join(blocks, "pool")
    salt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["pool", "bucket", "tile", "block"]
    held = rows.join(sizes, ["pool", "bucket"]).withColumn("tile", salt("place", "tiles")).withColumn("block", each("blocks"))
    met = asked.join(sizes, "pool").withColumn("block", salt("vec_id", "blocks")).withColumn("tile", each("tiles"))
    apart = [F.col(c).alias(c) for c in cell]  # columns of their own on either side
    return held.select(*apart, "vec_id", "label", "vector"), met.select(*apart, *asked.drop("pool").columns), cell


def mine(
    vectors: DataFrame, is_anchor: Column, settings: Settings = Settings(),
    vec_id: str = "vec_id", label: str = "label", vector: str = "vector",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vector`` is an ``array<bigint>`` column; ``is_anchor`` is a condition on the id column.
    """
    named = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("place"),
    )
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = settle(named.filter(good).withColumn("length", F.sqrt(square)))
    width = max(rows.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    anchors = rows.filter("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("least"))
    anchors = settle(anchors.select("vec_id", "least.label", "least.vector"))

    pool = F.col("label")
    held, met, cell = _dealt(rows.withColumn("pool", pool), anchors.withColumn("pool", pool), settings, width)
    found = held.groupBy(*cell).cogroup(met.groupBy(*cell)).applyInArrow(_positives(settings), FOUND)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "found_id")
    found = found.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= settings.k)
    # At most k rows a group; equal positives are one.
    gathered = found.groupBy("anchor_id").agg(F.collect_set(F.struct(F.col("found_id").alias("id"), "score")).alias("positives"))
    asked = settle(anchors.join(gathered, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"))

    pool = F.pmod("vec_id", F.lit(1))  # one pool, by a column that joins as any other
    held, met, cell = _dealt(rows.withColumn("pool", pool), asked.withColumn("pool", pool), settings, width)
    mined = held.groupBy(*cell).cogroup(met.groupBy(*cell)).applyInArrow(_negatives(settings), MINED)
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
