"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target, a number of words to take. A document of a source with rate
``r = target / size`` is taken ``floor(r)`` times for certain and once more with probability
``r - floor(r)``. Which documents are taken once more is drawn by the cube method: the
probabilities of three documents move along the direction that keeps both their number and their
words, until one of them is 0 or 1; so document and word totals of a source stay where they are.
That runs in blocks of bounded size; what each block leaves undecided (two documents, and its part
of a reserve of eight) moves on to the next round, until the source fits one block. There the flight
stops short of the last eight documents. They and the two left over are the landing problem: of all
their outcomes the one nearest to the source's words is taken. Every source lands in the round in
which it fits, whatever the size of the others.

Blocks, their order and the random steps follow from the rows alone, so reruns agree. Null texts
have size 0, a null source is a source of its own and the last. Repeated rows are drawn each.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbrow.session import settle

BLOCK_ROWS = 4096
PART_BYTES = 8 << 20  # texts that meet their numbers in one task, about
LANDING = 8  # documents of a source that the landing decides, beside the two that the flight leaves
MAX_SOURCES = 1_000_000  # sources with their totals are collected; more are refused
NEAR_SOURCES = 100_000  # up to so many sources are broadcast to their rows


def word_count(text: Column) -> Column:
    """Number of runs of anything but 0x20 and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Column:
    """Hash of a row of documents, 128 bits in hexadecimal; equal rows share it."""
    spelled = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (doc_id, source, text)]
    return F.md5(F.concat_ws("\n", *spelled))


def shared_out(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Share ``share`` of all sizes by weight; no target exceeds ``cap`` sizes, what is over goes to the others."""
    targets, active = [0.0] * len(sizes), list(range(len(sizes)))
    left = share * sum(sizes)
    while active:
        unit = left / sum(weights[i] for i in active)
        full = [i for i in active if unit * weights[i] >= cap * sizes[i]]
        for i in full or active:
            targets[i] = float(cap * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(targets[i] for i in full)
        active = [i for i in active if i not in set(full)]
    return targets


def flight(p: list[float], size: list[int], random: Callable[[], float]) -> list[int]:
    """Move the probabilities ``p`` in place until two at most are undecided; returns those."""
    active: list[int] = []
    for new in range(len(p)):
        if 0 < p[new] < 1:
            active.append(new)
        while len(active) == 3:
            i, j, k = active
            u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            scale = max(abs(x) for x in u)
            up = down = math.inf
            for at, x in zip(active, u):
                x /= scale
                if x > 0:
                    up, down = min(up, (1 - p[at]) / x), min(down, p[at] / x)
                elif x < 0:
                    up, down = min(up, -p[at] / x), min(down, (p[at] - 1) / x)
            step = up if random() * (up + down) < down else -down
            for at, x in zip(active, u):
                q = p[at] + step * x / scale
                p[at] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
            active = [at for at in active if 0 < p[at] < 1]
    return active


def landing(p: list[float], size: list[int], open_: list[int]) -> None:
    """Decide the last few: the outcome whose words, then whose number, is nearest to the expected."""
    words, number = sum(p[i] * size[i] for i in open_), sum(p[i] for i in open_)
    outcomes = []
    for mask in range(1 << len(open_)):
        chosen = [i for n, i in enumerate(open_) if mask >> n & 1]
        outcomes.append((abs(sum(size[i] for i in chosen) - words), abs(len(chosen) - number), mask))
    mask = min(outcomes)[2]
    for n, i in enumerate(open_):
        p[i] = float(mask >> n & 1)


def _draw(seed: int, names: list[str], block_rows: int):
    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blocks = -(-int(rows["remain"].iloc[0]) // block_rows)
        last = blocks <= 1
        reserve = LANDING if last else min(-(-LANDING // blocks), block_rows // 8)
        rows = rows.sort_values(["tie", "size"], kind="stable").reset_index(drop=True)
        p, size = rows["p"].tolist(), rows["size"].tolist()
        generator = np.random.default_rng([seed, int(key[0]) & 0xFFFFFFFF, int(key[1]) & 0xFFFFFFFF])
        draws = iter(generator.random(len(p) + 3).tolist())
        held_back = [i for i in range(len(p)) if 0 < p[i] < 1][-reserve:] if reserve else []
        start = held_back[0] if held_back else len(p)
        head = p[:start]
        open_ = flight(head, size, lambda: next(draws))
        p[:start] = head
        if last:
            landing(p, size, open_ + held_back)
        return rows.assign(p=p)[names]

    return draw


def mix_sources(
    docs: DataFrame, weights: Callable[[int], float], share: float = 1.5, cap: float = 2.0, seed: int = 7,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """doc_id, tie, size, source_size, target, copies and taken of every row.

    ``weights`` gives the weight of the n-th source by code point, nulls last. ``tie`` is a hash
    of the row; rows with the same hash are the same rows. ``copies`` says how often the row is in the mix.
    """
    spark = docs.sparkSession
    rows = settle(docs.select(
        F.col(doc_id).cast("string").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        row_hash(doc_id, text, source).alias("tie"),
    ))
    kind = rows.schema["source"].dataType.simpleString()
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    totals.sort(key=lambda r: (r.source is None, r.source))
    targets = shared_out([r.size for r in totals], [weights(i) for i in range(len(totals))], share, cap)
    table = spark.createDataFrame(
        [(r.source, i, r.n, r.size, t, t / r.size if r.size else 0.0) for i, (r, t) in enumerate(zip(totals, targets))],
        f"s_source {kind}, number int, n long, source_size long, target double, rate double",
    )
    if len(totals) <= NEAR_SOURCES:
        table = F.broadcast(table)
    state = rows.join(table, F.col("source").eqNullSafe(F.col("s_source"))).select(
        "doc_id", "tie", "size", "number", "n", "source_size", "target", F.floor("rate").alias("base"),
        (F.col("rate") - F.floor("rate")).alias("p"),
    )
    done, names, schema = None, state.columns, state.schema
    remain, largest = F.col("n"), max((r.n for r in totals), default=0)
    for turn in itertools.count():
        block = F.pmod(F.xxhash64("tie", F.lit(seed + turn)), F.greatest(F.ceil(F.col("remain") / BLOCK_ROWS), F.lit(1)))
        state = state.withColumn("remain", remain).withColumn("block", block)
        drawn = settle(state.groupBy("number", "block").applyInPandas(_draw(seed + turn, names, BLOCK_ROWS), schema))
        decided = drawn.filter("p = 0 OR p = 1")
        done = decided if done is None else done.unionByName(decided)
        if largest <= BLOCK_ROWS:
            break
        # Only sources of more than one block have rows left; they are joined with their numbers of rows.
        state = drawn.filter("p > 0 AND p < 1")
        left = settle(state.groupBy(F.col("number").alias("_number")).agg(F.count("*").alias("_left")))
        largest = left.agg(F.max("_left")).first()[0] or 0
        if not largest:
            break
        state, remain = state.join(F.broadcast(left), F.col("number") == F.col("_number")).select(*names, "_left"), F.col("_left")
    copies = (F.col("base") + F.col("p")).cast("long")
    return done.select(
        F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "tie", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, weights: Callable[[int], float], share: float = 1.5, cap: float = 2.0, seed: int = 7,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    mixed = mix_sources(docs, weights, share, cap, seed, doc_id, text, source)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, math.ceil(size / PART_BYTES))
    taken = mixed.groupBy(F.col("tie").alias("_tie")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    taken = taken.filter("_copies > 0").repartition(parts, "_tie")
    rows = docs.withColumn("_row", row_hash(doc_id, text, source)).repartition(parts, "_row")
    # The few numbers of a part are hashed and the texts pass by: only texts that occur more than once are sorted.
    match = lambda wanted: rows.join(taken.filter(wanted).hint("shuffle_hash"), F.col("_row") == F.col("_tie"))
    alone = match("_rows = 1").withColumn("_times", F.col("_copies"))
    # Equal rows share what was drawn for them.
    number = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    times = F.floor(F.col("_copies") / F.col("_rows")) + (number <= F.col("_copies") % F.col("_rows")).cast("long")
    equal = match("_rows > 1").withColumn("_times", times).filter("_times > 0")
    rows = alone.unionByName(equal)
    return rows.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*docs.columns)
