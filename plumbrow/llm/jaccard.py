"""Jaccard join of documents on word shingles.

A document is its set of distinct shingles, as sorted 64-bit hashes. The join is exact and takes
these steps, each of which loses no link:

1. A document can only have a partner if three quarters of its shingles occur in other documents.
   All shingles are dealt to buckets, which tell how many of a document's shingles they have seen twice.
2. What is left is reduced to distinct sets. A sketch of their shingle counts orders shingles from rare
   to frequent; linked sets share one of the first ``n - ceil(t n) + 1`` of both in that order.
3. Sets that share such a shingle form a tile. In a tile only sets of close sizes meet, and a pair goes on
   only if its hashed parity bitmaps allow the overlap: the bits in which they differ are no more
   than the shingles in which the sets differ. Tiles of frequent shingles are split into size bands and blocks.
4. Pairs that go on make clusters. Every set travels once to its cluster (or to each tile of blocks of a
   large one), where bitmaps are compared again and sorted arrays are intersected.
5. Links make components. Links between equal sets are counted from the size of the class.

A document of fewer words than a shingle has one shingle, its whole sequence; one without words has
none and no links. Null texts have no words. Repeated rows are equal documents. The component of a document is
named by its smallest id; null ids are never smallest. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbrow.llm import text as T
from plumbrow.llm.components import components
from plumbrow.llm.sketch import Sketch, count_keys
from plumbrow.session import settle


@dataclass(frozen=True)
class Settings:
    width: int = 5
    percent: int = 75  # least similarity
    chunk: int = 2_000_000  # shingles that a task packs at a time
    bucket: int = 2_000_000  # shingles in a bucket
    tile: int = 1024  # sets in a block of a large tile or cluster


def _needed(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any partner, at least."""
    return -(-n * percent // 100)


def _digests(keys: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128-bit names of sets."""
    sums = []
    for salt in (1, 2):
        mixed = T.mix(keys * np.uint64(2) + np.uint64(salt))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
        sums.append(T.mix(total[offsets[1:]] - total[offsets[:-1]] + np.uint64(salt)))
    pairs = np.stack(sums, axis=1)
    return [p.tobytes() for p in pairs]


# ---------------------------------------------------------------- step 1: documents that can have a partner


def _pack_sets(settings: Settings, buckets: int):
    """Every chunk of documents as one row a bucket, and one row that lists the documents."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk = TaskContext.get().partitionId(), 0
        waiting, size = [], 0

        def flush():
            ids = pa.concat_arrays([w[0] for w in waiting])
            counts = np.concatenate([np.diff(w[2]) for w in waiting])
            names = [d for w in waiting for d in _digests(w[1], w[2])]
            keys = np.concatenate([w[1] for w in waiting])
            waiting.clear()  # a chunk is in memory once
            row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable").astype(np.int32)  # rows ascend already
            edges = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
            del bucket
            out = []
            for b in range(buckets):
                part = order[edges[b] : edges[b + 1]]
                if len(part):
                    held = np.bincount(row[part], minlength=len(counts)).astype(np.uint32)
                    out.append((b, T.planes(held), T.planes(keys[part].astype(np.uint32))))
            number = (task << 24) + chunk
            none = pa.nulls(len(ids), pa.binary())
            return [
                pa.record_batch(
                    [
                        pa.array([o[0] for o in out], pa.int64()), pa.array([number] * len(out), pa.int64()),
                        pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary()),
                        pa.nulls(len(out), ids.type), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.binary()),
                    ],
                    NAMES,
                ),
                pa.record_batch(
                    [
                        pa.array(np.full(len(ids), -1 - number)), pa.array(np.full(len(ids), number)), none, none,
                        ids, pa.array(np.arange(len(ids))), pa.array(counts.astype(np.int64)), pa.array(names, pa.binary()),
                    ],
                    NAMES,
                ),
            ]

        for batch in batches:
            for piece in T.pieces(batch, limit=T.HASH_BYTES):
                keys, offsets = T.shingle_sets(piece.column("text"), settings.width)
                waiting.append((piece.column("doc_id"), keys, offsets))
                size += len(keys) + piece.num_rows
                if size > settings.chunk:
                    yield from flush()
                    size, chunk = 0, chunk + 1
        if waiting:
            yield from flush()

    return pack


NAMES = ["bucket", "chunk", "held", "prints", "doc_id", "place", "n", "name"]


def _seen_twice(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk in a bucket, how many of every document's shingles occur in another document.

    Lists of documents pass as they are.
    """
    if key[0] < 0:
        return rows.assign(twice=None)[["chunk", "twice", "doc_id", "place", "n", "name"]]
    held = [T.from_planes(b, "u4") for b in rows["held"]]
    prints = np.concatenate([T.from_planes(b, "u4") for b in rows["prints"]])
    order = np.argsort(prints, kind="stable")
    ranked = prints[order]
    same = np.zeros(len(prints) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(prints), np.int64)
    twice[order] = same[:-1] | same[1:]
    total = np.concatenate([[0], np.cumsum(twice)])
    out, at = [], 0
    for h in held:
        ends = at + np.cumsum(h, dtype=np.int64)
        out.append(T.planes((total[ends] - total[ends - h]).astype(np.uint32)))
        at = int(ends[-1])
    return pd.DataFrame({"chunk": rows["chunk"], "twice": out, "doc_id": None, "place": 0, "n": 0, "name": None})


def shingled(docs: DataFrame, settings: Settings, doc_id: str, text: str) -> DataFrame:
    """doc_id, n, name of the set, and whether the document can have a partner."""
    # The id travels as text, behind a hash of the document's text.
    spelled = F.concat_ws(":", F.xxhash64(text), F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("-")))
    rows = docs.select(spelled.alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / 6 / settings.bucket))
    schema = "bucket long, chunk long, held binary, prints binary, doc_id string, place long, n long, name binary"
    packed = rows.mapInArrow(_pack_sets(settings, buckets), schema).repartition(buckets, "bucket")
    seen = packed.groupBy("bucket").applyInPandas(
        _seen_twice, "chunk long, twice binary, doc_id string, place long, n long, name binary"
    )

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        listed = rows[rows["name"].notna()].sort_values("place")
        total = np.zeros(len(listed), np.int64)
        for blob in rows["twice"].dropna():
            total += T.from_planes(blob, "u4")
        return listed.assign(live=(listed["n"] > 0) & (total * 100 >= listed["n"] * settings.percent))[["doc_id", "n", "name", "live"]]

    out = settle(seen.groupBy("chunk").applyInPandas(add, "doc_id string, n long, name binary, live boolean"))
    spelled = F.regexp_extract("doc_id", "^[^:]*:=(?s)(.*)$", 1)
    return out.select(
        F.when(~F.col("doc_id").endswith(":-") | F.col("doc_id").contains(":="), spelled).cast(docs.schema[doc_id].dataType).alias("doc_id"),
        F.substring_index("doc_id", ":", 1).cast("long").alias("text_hash"), "n", "name", "live",
    )


# ---------------------------------------------------------------- steps 2 and 3: candidates


def _sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = T.buffers(batch.column("shingles"))
    return np.frombuffer(data.tobytes(), np.uint64), offsets // 8


def parity_bits(keys: np.ndarray, width: int) -> int:
    """Bitmap in which every shingle flips one bit."""
    flips = np.bincount((keys >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return int.from_bytes(np.packbits(flips.astype(bool), bitorder="little").tobytes(), "little")


def _bit_width(n: int) -> int:
    return min(max(64, 1 << (n - 1).bit_length()), 4096)


def _fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits >> width) ^ (bits & ((1 << width) - 1))
    return bits


def _band(n: int, percent: int) -> int:
    """Sets of linked sizes are at most one band apart."""
    return math.floor(math.log(n) / math.log(100 / percent) + 1e-9)


def _entries(settings: Settings, sketch, buckets: int):
    """Prefix shingles of every set, with the tiles they go to."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, offsets = _sets_of(batch)
            if not len(keys):
                continue
            counts = sketch.value.counts(keys)
            level = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
            tiles, take, bands, bitmaps = [], [], [], []
            names = batch.column("name").to_pylist()
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                n = b - a
                own = keys[a:b]
                order = np.lexsort((own, level[a:b]))[: n - _needed(n, settings.percent) + 1]
                order = order[counts[a:b][order] > 1]  # counters are never too small: a 1 is a shingle of one set
                bitmaps.append(parity_bits(own, _bit_width(n)).to_bytes(_bit_width(n) // 8, "little"))
                plain = order[counts[a:b][order] <= settings.tile]
                tiles.append(own[plain])
                bands.append(np.full(len(plain), -1))
                take.append(np.full(len(plain), i))
                band = _band(n, settings.percent)
                for k in order[counts[a:b][order] > settings.tile]:
                    blocks = -(-int(counts[a + k]) // settings.tile)
                    mine = int.from_bytes(names[i][:8], "little") % blocks
                    other = np.arange(blocks)
                    low, high = np.minimum(mine, other), np.maximum(mine, other)
                    for t in (band, band - 1):
                        tile = T.chain(np.full(blocks, own[k]), (low * blocks + high).astype(np.uint64) * np.uint64(512) + np.uint64(t + 1))
                        tiles.append(tile)
                        bands.append(np.full(blocks, t))
                        take.append(np.full(blocks, i))
            tile, at, band = np.concatenate(tiles), np.concatenate(take), np.concatenate(bands)
            sizes = np.diff(offsets)
            yield pa.record_batch(
                [
                    pa.array((tile % np.uint64(buckets)).astype(np.int64)), pa.array(tile.view(np.int64)),
                    pa.array(band.astype(np.int32)), batch.column("name").take(pa.array(at)), pa.array(sizes[at].astype(np.int32)),
                    pa.array(bitmaps, pa.binary()).take(pa.array(at)),
                ],
                ["bucket", "tile", "band", "name", "n", "bits"],
            )

    return emit


class Forest:
    """Union-find over hashable names."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _may_link(a: tuple, b: tuple, percent: int) -> bool:
    """Sizes and bitmaps of two sets, the smaller first, allow the similarity."""
    if 100 * a[0] < percent * b[0]:
        return False
    width = min(a[2], b[2])
    differ = (_fold(a[1], a[2], width) ^ _fold(b[1], b[2], width)).bit_count()
    # overlap <= (|a| + |b| - differ) / 2 and similarity = overlap / (|a| + |b| - overlap)
    return (100 + percent) * (a[0] + b[0] - differ) >= 2 * percent * (a[0] + b[0])


def _pair_up(settings: Settings):
    """Pairs of a bucket's tiles that may link, as a spanning forest of them."""

    def pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tile", "n"], kind="stable")
        names, sizes, bands = rows["name"].tolist(), rows["n"].tolist(), rows["band"].tolist()
        bitmaps, tiles = rows["bits"].tolist(), rows["tile"].to_numpy()
        cache: dict = {}

        def bits(i):
            if names[i] not in cache:
                cache[names[i]] = (sizes[i], int.from_bytes(bitmaps[i], "little"), len(bitmaps[i]) * 8)
            return cache[names[i]]

        forest, edges = Forest(), []
        starts = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1], [True]]))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            groups: dict = defaultdict(list)  # trees of the tile's sets so far, each by rising size
            for j in range(a, b):
                root = forest.find(names[j])
                if len(groups) == 1 and root in groups:
                    groups[root].append(j)
                    continue
                floor, new = settings.percent * sizes[j], bits(j)
                for other in list(groups):
                    if other == root:
                        continue
                    for i in reversed(groups[other]):
                        if 100 * sizes[i] < floor:
                            break
                        if bands[j] >= 0 and _band(sizes[i], settings.percent) != bands[j]:
                            continue
                        if names[i] != names[j] and _may_link(bits(i), new, settings.percent):
                            forest.join(names[i], names[j])
                            edges.append((names[i], names[j]))
                            mine, theirs = groups.pop(root, []), groups.pop(other)
                            root = forest.find(names[j])
                            groups[root] = sorted(mine + theirs)
                            break
                groups[root].append(j)
        return pd.DataFrame(edges, columns=["a", "b"])

    return pair


# ---------------------------------------------------------------- step 4: links


def _links(settings: Settings):
    """Verified links of a tile: a spanning forest of them, and the number of links of every set.

    A tile holds one block of a cluster, or two; of two, only pairs between them count.
    """

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("name").sort_values(["n", "name"]).reset_index(drop=True)
        n, block = rows["n"].to_numpy(), rows["block"].to_numpy()
        names, copies = rows["name"].tolist(), rows["copies"].to_numpy()
        two = len(np.unique(block)) > 1
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
        offsets = np.concatenate([[0], np.cumsum(n)])
        width = _bit_width(int(np.median(n)))
        bits = np.array([np.frombuffer(parity_bits(s, width).to_bytes(width // 8, "little"), np.uint64) for s in sets])
        mark = np.zeros(len(flat), bool)
        links, forest, edges = np.zeros(len(rows), np.int64), Forest(), []
        for i in range(len(rows) - 1):
            # sizes rise: partners come after i, up to the size bound
            end = int(np.searchsorted(n, n[i] * 100 // settings.percent, side="right"))
            if end <= i + 1:
                continue
            differ = np.bitwise_count(bits[i + 1 : end] ^ bits[i]).sum(axis=1, dtype=np.int64)
            total = n[i + 1 : end] + n[i]
            near = (100 + settings.percent) * (total - differ) >= 2 * settings.percent * total
            if two:
                near &= block[i + 1 : end] != block[i]
            near = np.flatnonzero(near) + i + 1
            if not len(near):
                continue
            mark[ids[offsets[i] : offsets[i + 1]]] = True
            if len(near) > 0.3 * (end - i - 1):
                run = np.concatenate([[0], np.cumsum(mark[ids[offsets[i + 1] : offsets[end]]])])
                at = offsets[near] - offsets[i + 1]
                shared = run[at + n[near]] - run[at]
            else:
                shared = np.array([np.count_nonzero(mark[ids[offsets[j] : offsets[j + 1]]]) for j in near])
            mark[ids[offsets[i] : offsets[i + 1]]] = False
            linked = near[100 * shared >= settings.percent * (n[near] + n[i] - shared)]
            links[i] += copies[linked].sum()
            links[linked] += copies[i]
            for j in linked.tolist():
                if forest.join(i, j):
                    edges.append((names[i], names[j]))
        some = np.flatnonzero(links)
        return pd.DataFrame(
            [(names[i], None, int(links[i])) for i in some] + [(a, b, 0) for a, b in edges], columns=["a", "b", "links"]
        )

    return verify


def jaccard_join(
    docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row, and a hash of its text."""
    return _joined(docs, settings, doc_id, text).drop("label")


def _joined(docs: DataFrame, settings: Settings, doc_id: str, text: str) -> DataFrame:
    """:func:`jaccard_join` with the label of the component, null where nothing is shared."""
    listed = shingled(docs, settings, doc_id, text)
    classes = settle(
        listed.filter("live").groupBy("name").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n").alias("n"))
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    firsts = classes.select(F.col("first_id").alias("f")).distinct()
    chosen = rows.join(firsts, F.col("doc_id").eqNullSafe(F.col("f")), "left_semi").select("text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, limit=T.HASH_BYTES):
                keys, offsets = T.shingle_sets(piece.column("text"), settings.width)
                names = pa.array(_digests(keys, offsets), pa.binary())
                blob = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(names), [None, pa.py_buffer((offsets * 8).astype(np.int64)), pa.py_buffer(keys)]
                )
                yield pa.record_batch([names, blob.cast(pa.binary())], ["name", "shingles"]).filter(pa.array(np.diff(offsets) > 0))

    sets = settle(chosen.mapInArrow(build, "name binary, shingles binary").dropDuplicates(["name"]))
    total = (sets.agg(F.sum(F.length("shingles"))).first()[0] or 0) // 8
    sketch = Sketch(count_keys(sets.select("shingles"), lambda batch: _sets_of(batch)[0], total))
    sketch = docs.sparkSession.sparkContext.broadcast(sketch)
    buckets = max(1, math.ceil(total * (100 - settings.percent) / 100 / 50_000))
    entries = sets.mapInArrow(
        _entries(settings, sketch, buckets), "bucket long, tile long, band int, name binary, n int, bits binary"
    )
    near = entries.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_pair_up(settings), "a binary, b binary")
    clusters = components(near)

    # Every set goes to its cluster; large clusters are cut into blocks, and every two blocks meet once.
    sizes = clusters.groupBy("label").count().filter(F.col("count") > settings.tile)
    sizes = sizes.select(F.col("label").alias("l"), F.ceil(F.col("count") / settings.tile).cast("int").alias("blocks"))
    placed = clusters.join(sizes, F.col("label") == F.col("l"), "left").select(
        "node", "label", F.coalesce("blocks", F.lit(1)).alias("blocks"),
    ).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("node", "label", "block", other).select(
        "node", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    held = sets.join(classes.select(F.col("name").alias("c"), "copies", "n"), F.col("name") == F.col("c"))
    held = held.join(placed, F.col("name") == F.col("node"))
    found = settle(
        held.select("label", "low", "high", "block", "name", "n", "copies", "shingles")
        .groupBy("label", "low", "high").applyInPandas(_links(settings), "a binary, b binary, links long")
    )
    labels = components(found.filter("b IS NOT NULL").select("a", "b"))
    links = found.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    named = classes.join(labels, F.col("name") == F.col("node"), "left").withColumn("label", F.coalesce("label", "name"))
    lowest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.select("name", "label", "copies").join(lowest, "label").join(links, F.col("name") == F.col("a"), "left")
    named = named.select(
        F.col("name").alias("c"), "label", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return listed.join(named, F.col("live") & (F.col("name") == F.col("c")), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_hash", "label",
    )


def one_of_each_group(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but of each group only the one with the least id, nulls last, then text hash.

    Documents without words are groups of their own and all stay.
    """
    joined = settle(_joined(docs, settings, doc_id, text).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "label"))
    counted = joined.filter("label IS NOT NULL").groupBy("label", "_id", "_hash").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_hash", "n")).alias("least")
    chosen = counted.groupBy("label").agg(least).select("least._id", "least._hash", (F.col("least.n") > 1).alias("_more"))
    alone = joined.filter("label IS NULL").select("_id", "_hash").distinct().withColumn("_more", F.lit(False))
    names = settle(chosen.unionByName(alone))
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    single = docs.join(names.filter("NOT _more").select("_id", "_hash"), same, "left_semi")
    repeated = names.filter("_more").select("_id", "_hash")
    if repeated.isEmpty():
        return single
    some = docs.join(repeated, same).dropDuplicates(["_id", "_hash"]).select(*docs.columns)
    return single.unionByName(some)
