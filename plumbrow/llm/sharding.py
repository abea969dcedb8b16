"""Resharding by minimum-cost flow: the block transfers that move the fewest bytes.

Old shards have sizes, new shards have capacities. A flow from old to new shards is solved on
these sizes alone; bytes that stay in the shard of the same number cost nothing, others cost one
a byte (or what a cost function says). Rows are dealt to blocks inside their old shard by a
hash of the text, so that equal texts share a block; whole blocks then fill the flow, the large
ones first. Only a block above half a shard is split, by row. Blocks are cut further into cells
of bounded size, in which rows are numbered, so no task sorts a whole shard. Last the shards that
gain or lose rows are written anew, in parts of bounded size; the files of the others stay.

The tables that the driver sees are old shards and cells, of which there are about
``total bytes / cell bytes``. Null and empty texts have size 1. Repeated rows and equal texts
share a shard; an empty table gives no rows; other columns are only read to be written.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbrow.session import settle

CELLS = 1024  # cells per new shard, unless they grow over CELL_BYTES
CELL_BYTES = 256 << 20
FILE_BYTES = 32 << 20  # texts of a part of a shard, which one task writes
NEAR_CELLS = 1_000_000  # a table of up to so many cells (some 50 MB) is broadcast


def cheapest_flow(
    supply: Sequence[int], capacity: Sequence[int], cost: Callable[[int, int], float],
) -> dict[tuple[int, int], int]:
    """Amounts (old, new) of least total cost that empty all supplies; successive shortest paths.

    Capacities must hold the supplies. Distances run over the new shards only: from one to
    another by way of an old shard that already sends to the first.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards cannot hold the old ones")
    flow: dict[tuple[int, int], int] = defaultdict(int)
    senders: list[set[int]] = [set() for _ in capacity]
    free = list(capacity)
    for old, left in sorted(enumerate(supply), key=lambda x: -x[1]):
        while left:
            # Dijkstra does not apply (rerouting can save cost): relax until nothing improves.
            best = [(cost(old, new), None) for new in range(len(capacity))]
            changed = True
            while changed:
                changed = False
                for a in range(len(capacity)):
                    for i in senders[a]:
                        for b in range(len(capacity)):
                            d = best[a][0] + cost(i, b) - cost(i, a)
                            if b != a and d < best[b][0] - 1e-12:
                                best[b], changed = (d, (a, i)), True
            end = min((new for new in range(len(capacity)) if free[new]), key=lambda new: best[new][0])
            path, at, amount = [], end, min(left, free[end])
            while best[at][1]:
                a, i = best[at][1]
                path.append((i, a, at))
                amount = min(amount, flow[i, a])
                at = a
            flow[old, at] += amount
            senders[at].add(old)
            for i, a, b in path:
                flow[i, a] -= amount
                flow[i, b] += amount
                senders[b].add(i)
                if not flow[i, a]:
                    senders[a].discard(i)
            free[end] -= amount
            left -= amount
    return {k: v for k, v in flow.items() if v}


def place_blocks(
    blocks: Sequence[tuple[int, int, int]], capacity: Sequence[int], cost: Callable[[int, int], float],
) -> dict[tuple[int, int], int]:
    """New shard of every (old, block, bytes): large blocks by themselves, the others along the flow."""
    olds = 1 + max((old for old, _, _ in blocks), default=-1)
    small = max(1, sum(capacity) // max(len(capacity) * CELLS, 1)) * 2
    free, supply, out = list(capacity), [0] * olds, {}
    for old, block, size in sorted(blocks, key=lambda b: (-b[2], b)):
        if size <= small:
            supply[old] += size
            continue
        fits = [new for new in range(len(free)) if free[new] >= size] or [max(range(len(free)), key=lambda j: free[j])]
        new = min(fits, key=lambda j: (cost(old, j), -free[j], j))
        out[old, block] = new
        free[new] -= size
    room = [max(f, 0) for f in free]
    spare = sum(room) - sum(supply)
    for j in range(len(room)):  # over-full shards leave the others less than their capacity
        cut = min(room[j], max(spare, 0))
        if sum(room) - cut >= sum(supply):
            room[j], spare = room[j] - cut, spare - cut
    flow = cheapest_flow(supply, room, cost)
    quota: dict[int, list] = defaultdict(list)
    for (old, new), amount in flow.items():
        heapq.heappush(quota[old], (-amount, new))
    for old, block, size in sorted(blocks, key=lambda b: (-b[2], b)):
        if size <= small:
            left, new = heapq.heappop(quota[old])
            out[old, block] = new
            heapq.heappush(quota[old], (left + size, new))
    return out


def _measured(docs: DataFrame, old: Column, doc_id: str, text: str, *more: Column) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), old.cast("int").alias("old_shard"), F.xxhash64(body).alias("group"),
        F.xxhash64(F.col(doc_id), body, F.lit(1)).alias("tie"), *more,
    )


def _layout(
    rows: DataFrame, shards: int, capacities: Sequence[int] | None, cost: Callable[[int, int], float],
) -> tuple[Callable[[DataFrame], DataFrame], set[int], set[int]]:
    """What deals measured rows to shard, part and slot; the shards, old and new, that change; those that hold rows."""
    spark = rows.sparkSession
    olds = {r.old_shard: r.size for r in rows.groupBy("old_shard").agg(F.sum("size").alias("size")).collect()}
    total = sum(olds.values())
    if not total:
        zero = F.lit(0).cast("long")
        return lambda more: more.withColumns({"shard": F.lit(0), "part": zero, "slot": zero}), set(), set()
    if capacities is None:
        capacities = [total // shards + (j < total % shards) for j in range(shards)]
    cell = max(1, min(math.ceil(total / (shards * CELLS)), CELL_BYTES))
    parts = spark.createDataFrame([(k, math.ceil(v / cell)) for k, v in olds.items()], "o int, blocks long")

    def blocked(more: DataFrame) -> DataFrame:
        more = more.join(F.broadcast(parts), F.col("old_shard") == F.col("o"))
        return more.withColumn("block", F.pmod("group", "blocks")).drop("o", "blocks")

    found = blocked(rows).groupBy("old_shard", "block").agg(F.sum("size").alias("size")).filter(F.col("size") > 2 * cell).collect()
    half = max(min(capacities) // 2, 1)
    large = spark.createDataFrame(
        [(r.old_shard, r.block, math.ceil(r.size / cell), r.size > half) for r in found], "o int, b long, cells long, loose boolean"
    )

    def celled(more: DataFrame) -> DataFrame:
        more = blocked(more).join(F.broadcast(large), (F.col("old_shard") == F.col("o")) & (F.col("block") == F.col("b")), "left")
        more = more.withColumn("cell", F.coalesce(F.pmod("tie", "cells"), F.lit(0))).withColumn("loose", F.coalesce("loose", F.lit(False)))
        return more.drop("o", "b", "cells")

    cells = celled(rows).groupBy("old_shard", "block", "cell", "loose").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    cells.sort(key=lambda r: (r.old_shard, r.block, r.cell))
    unit, names = defaultdict(int), {}
    for r in cells:  # what moves together: a block, or a cell of a block above half a shard
        unit[r.old_shard, names.setdefault((r.old_shard, r.block, r.cell if r.loose else -1), len(names))] += r.size
    placed = place_blocks([(o, b, size) for (o, b), size in unit.items()], capacities, cost)
    filled, weight, table, changed = [0] * shards, [0] * shards, [], set()
    for r in cells:
        shard = placed[r.old_shard, names[r.old_shard, r.block, r.cell if r.loose else -1]]
        table.append((r.old_shard, r.block, r.cell, shard, weight[shard] // FILE_BYTES, filled[shard]))
        filled[shard] += r.n
        weight[shard] += r.size
        if r.old_shard != shard:
            changed |= {r.old_shard, shard}
    where = spark.createDataFrame(table, "o int, b long, c long, shard int, part long, first long")
    if len(table) <= NEAR_CELLS:
        where = F.broadcast(where)

    def deal(more: DataFrame) -> DataFrame:
        same = (F.col("old_shard") == F.col("o")) & (F.col("block") == F.col("b")) & (F.col("cell") == F.col("c"))
        order = Window.partitionBy("shard", "part", "old_shard", "block", "cell").orderBy("tie", "doc_id")
        # Rows of a part of a shard meet in one task, which numbers and writes them.
        dealt = celled(more).join(where, same).repartition("shard", "part")
        return dealt.withColumn("slot", F.col("first") + F.row_number().over(order) - 1)

    return deal, changed, {t[3] for t in table}


def reshard(
    docs: DataFrame, old: Column, shards: int, capacities: Sequence[int] | None = None,
    cost: Callable[[int, int], float] = lambda old, new: float(old != new), doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard and slot of every row; nothing is rewritten.

    ``old`` numbers the shard in which a row lies now, from 0. Without ``capacities`` the new
    shards are to be equally large.
    """
    rows = settle(_measured(docs, old, doc_id, text))
    deal, _, _ = _layout(rows, shards, capacities, cost)
    return deal(rows).select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")


def reshard_files(
    docs: DataFrame, old: Column, shards: int, path: str, capacities: Sequence[int] | None = None,
    cost: Callable[[int, int], float] = lambda old, new: float(old != new), doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Place the rows and write the changed shards under ``path``; doc_id, size, text_crc32, shard and slot of every row.

    The files hold all columns of ``docs`` and the slot, one folder ``shard=...`` a shard; columns
    ``shard`` and ``slot`` of ``docs`` are replaced. Rows of written shards are read from the files.
    Shards that keep their rows are not touched, and their rows are those of the placement. ``docs`` may
    be the layout under ``path`` itself, if ``old`` is the number of the folder. No key is needed.
    """
    rows = settle(_measured(docs, old, doc_id, text))
    deal, changed, held = _layout(rows, shards, capacities, cost)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    whole = deal(_measured(docs, old, doc_id, text, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")))
    whole = whole.filter(F.col("shard").isin(sorted(changed & held))).select("row.*", "slot", "shard")
    stay = deal(rows).filter(~F.col("shard").isin(sorted(changed))).select("doc_id", "size", "text_crc32", "shard", "slot")
    if not changed:
        return stay
    _replace(whole, path, changed, held)
    files = docs.sparkSession.read.schema(whole.schema).parquet(path).filter(F.col("shard").isin(sorted(changed & held)))
    body = F.coalesce(F.col(text), F.lit(""))
    return files.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), "shard", "slot"
    ).unionByName(stay)


def _replace(rows: DataFrame, path: str, changed: set[int], held: set[int]) -> None:
    """Write ``rows`` by shard over the folders of their shards; folders of changed shards without rows go."""
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    for shard in sorted(changed - held):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        folder.getFileSystem(conf).delete(folder, True)


def changed_shards(placed: DataFrame, shards: int) -> list[int]:
    """New shards that gain or lose rows; the files of the others stay."""
    moves = placed.filter("old_shard <> shard").select("old_shard", "shard").distinct().collect()
    return sorted({s for r in moves for s in r if s < shards})


def rewrite(docs: DataFrame, placed: DataFrame, path: str, shards: int, doc_id: str = "doc_id", text: str = "text") -> list[int]:
    """Write the rows of changed shards of a placement under ``path``, one folder a shard; returns their numbers.

    Rows are matched by id and text; those that share both are matched one to one, in any order.
    Shards that keep their rows are not touched. :func:`reshard_files` places and writes in one go.
    """
    changed = changed_shards(placed, shards)
    gone = {r.old_shard for r in placed.select("old_shard").distinct().collect() if r.old_shard >= shards}
    body = F.coalesce(F.col(text), F.lit(""))
    nth = F.row_number().over(Window.partitionBy("_id", "_size", "_crc").orderBy("_id"))
    left = docs.drop("shard", "slot")
    names = left.columns
    left = left.withColumns({"_id": F.col(doc_id), "_size": (F.octet_length(body) + 1).cast("long"), "_crc": F.crc32(body)}).withColumn("_nth", nth)
    right = placed.select(F.col("doc_id").alias("_i"), F.col("size").alias("_s"), F.col("text_crc32").alias("_c"), "shard", "slot")
    right = right.withColumn("_n", F.row_number().over(Window.partitionBy("_i", "_s", "_c").orderBy("shard", "slot")))
    right = settle(right.filter(F.col("shard").isin(changed)))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_size") == F.col("_s")) & (F.col("_crc") == F.col("_c")) & (F.col("_nth") == F.col("_n"))
    held = {r.shard for r in right.select("shard").distinct().collect()}
    if changed or gone:
        _replace(left.join(right, same).select(*names, "slot", "shard"), path, {*changed, *gone}, held)
    return changed
