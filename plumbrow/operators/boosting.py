"""Boosted trees with second-order gains over distributed histograms.

Features are cut into bins by quantiles once, and rows are stored as blocks of bin numbers. A job
walks the blocks through the tree that grows, sums gradients and curvatures by (node, feature, bin) in
every task, merges the sums of a (node, feature) in a shuffle and returns its best cut, so the
driver sees one candidate for each. Sums are whole numbers (2^-24 units): a fit does not depend on
the order in which tasks end, nor on the partitions.

Trees grow by levels, or by leaves. For the latter the leaf with the greatest gain is split until there are
``leaves``; a job evaluates all children that this order can reach with the gains known so far, so a tree
takes about as many jobs as it is deep. Margins are stored again every ``stored`` rounds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.functions.batches import map_rows, to_matrix
from plumbrow.session import settle

UNIT = float(1 << 24)
JOB_CELLS = 1 << 22  # sums that a task holds at a time
BLOCK = "bins binary, y binary, w binary, margin binary, held binary"


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``leaves`` 0: by levels. ``patience`` 0: all rounds, with all rows."""

    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    depth: int = 0  # 0: no bound
    bins: int = 255
    ridge: float = 0.0
    least_rows: int = 20
    least_curvature: float = 1e-3
    patience: int = 0
    tolerance: float = 1e-7
    valid: float = 0.1
    stored: int = 10


@dataclass
class Tree:
    """Parallel lists by node; node 0 is the root, ``feature`` -1 a leaf. Rows with bin <= ``cut`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for column, start in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                column.append(start)
        return self.left[node], self.right[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        at, moving = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(moving := moving[feature[at[moving]] >= 0]):
            node = at[moving]
            at[moving] = np.where(bins[moving, feature[node]] <= cut[node], left[node], right[node])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


# ---------------------------------------------------------------- bins


def fit_cuts(rows: DataFrame, column: str, bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 ascending cuts of every position, by one aggregate of quantile sketches."""
    width = rows.select(F.max(F.size(column))).first()[0] or 0
    if not width:
        return []
    share = F.lit([i / bins for i in range(1, bins)])  # one column for all positions
    finite = lambda i: F.when(~F.isnan(F.col(column)[i]), F.col(column)[i])
    found = rows.agg(*[F.percentile_approx(finite(i), share, 10_000).alias(f"q{i}") for i in range(width)]).first()
    return [np.unique(np.array(q if q else [], float)) for q in found]


def to_bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers; a value that equals a cut stays below it, and NaN goes behind the last one."""
    out = np.empty(x.shape, np.uint8)
    for i, edges in enumerate(cuts):
        out[:, i] = np.searchsorted(edges, x[:, i], side="left")
    return out


def _blocks(cuts: Sequence[np.ndarray], base: float):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = to_bins(to_matrix(batch.column("f")), cuts)
            columns = [bins, *(batch.column(c).to_numpy().astype(float) for c in ("y", "w"))]
            columns += [np.full(len(bins), base), batch.column("held").to_numpy(zero_copy_only=False).astype(np.uint8)]
            yield pa.record_batch([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], ["bins", "y", "w", "margin", "held"])

    return pack


def _open(batch: pa.RecordBatch, i: int, width: int, trees: Sequence[Tree]):
    """Bins, labels, weights, margins with ``trees`` added, and the held-out flag of a block."""
    raw = lambda c, t: np.frombuffer(batch.column(c)[i].as_py(), t)
    bins = raw("bins", np.uint8).reshape(-1, width)
    margin = raw("margin", float).copy()
    for tree in trees:
        margin += tree.predict(bins)
    return bins, raw("y", float), raw("w", float), margin, raw("held", np.uint8).astype(bool)


# ---------------------------------------------------------------- histograms


def _sums(width: int, size: int, trees: Sequence[Tree], tree: Tree, asked: Sequence[int]):
    """Function of one partition: for each asked node and feature the sums of gradient, curvature and rows by bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(tree.feature), -1)
        place[list(asked)] = np.arange(len(asked))
        total = np.zeros((3, width, len(asked) * size), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                bins, y, w, margin, held = _open(batch, i, width, trees)
                slot = place[tree.nodes(bins)]
                take = (slot >= 0) & ~held
                p = 1 / (1 + np.exp(-margin[take]))
                g = np.rint(w[take] * (p - y[take]) * UNIT)
                h = np.rint(w[take] * p * (1 - p) * UNIT)
                start = slot[take] * size
                for f in range(width):
                    cell = start + bins[take, f]
                    # Sums of a block stay below 2^53, so that adding doubles is exact.
                    for kind, weights in enumerate((g, h, None)):
                        total[kind, f] += np.bincount(cell, weights, len(asked) * size).astype(np.int64)
        out = [
            (node, f, np.ascontiguousarray(total[:, f, k * size : (k + 1) * size]).tobytes())
            for k, node in enumerate(asked) for f in range(width) if total[2, f, k * size : (k + 1) * size].any()
        ]
        columns = list(zip(*out)) if out else [()] * 3
        types = (pa.int32(), pa.int32(), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["node", "feature", "sums"])

    return run


def best_cut(sums: np.ndarray, ridge: float, least_rows: int, least_curvature: float) -> tuple[float, int]:
    """Greatest gain of a cut behind a bin and that bin (the first of equal ones); gain 0 if none is allowed."""
    g, h, n = sums[0] / UNIT, sums[1] / UNIT, sums[2]
    left = [np.cumsum(c)[:-1] for c in (g, h, n)]
    right = [c.sum() - a for c, a in zip((g, h, n), left)]
    allowed = np.minimum(left[2], right[2]) >= max(least_rows, 1)
    allowed &= np.minimum(left[1], right[1]) >= least_curvature
    part = lambda a, b: np.divide(a * a, b + ridge, out=np.zeros(np.shape(a)), where=(b + ridge) > 0)
    gain = part(left[0], left[1]) + part(right[0], right[1]) - part(np.array(g.sum()), np.array(h.sum()))
    gain = np.where(allowed, gain, 0.0)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax())


def _cuts(growth: Growth):
    """Function of one partition that holds all sums of its (node, feature): their best cuts. A job's sums are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for node, feature, sums in zip(*(batch.column(c).to_pylist() for c in ("node", "feature", "sums"))):
                part = np.frombuffer(sums, np.int64).reshape(3, -1)
                total[node, feature] = total[node, feature] + part if (node, feature) in total else part
        out = []
        for (node, feature), sums in total.items():
            gain, cut = best_cut(sums, growth.ridge, growth.least_rows, growth.least_curvature)
            out.append((node, feature, gain, cut, int(sums[0].sum()), int(sums[1].sum())))
        columns = list(zip(*out)) if out else [()] * 6
        types = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["node", "feature", "gain", "cut", "g", "h"])

    return run


CANDIDATE = "node int, feature int, gain double, cut int, g long, h long"


@dataclass
class _Leaf:
    gain: float
    feature: int
    cut: int
    value: float


def _evaluate(blocks: DataFrame, width: int, growth: Growth, trees: Sequence[Tree], tree: Tree, asked: Sequence[int]) -> dict[int, _Leaf]:
    """Best cut and value of the asked leaves, in jobs of bounded memory."""
    size, out = growth.bins, {}
    step = max(1, JOB_CELLS // (3 * width * size))
    for at in range(0, len(asked), step):
        sums = blocks.mapInArrow(_sums(width, size, trees, tree, asked[at : at + step]), "node int, feature int, sums binary")
        for r in sums.repartition("node", "feature").mapInArrow(_cuts(growth), CANDIDATE).collect():
            value = -r.g / (r.h + growth.ridge * UNIT) if r.h + growth.ridge * UNIT > 0 else 0.0
            leaf = out.get(r.node)
            if leaf is None or (-r.gain, r.feature) < (-leaf.gain, leaf.feature):
                out[r.node] = _Leaf(r.gain, r.feature, r.cut, value * growth.rate)
    return out


# ---------------------------------------------------------------- growing


def _grow(blocks: DataFrame, width: int, growth: Growth, trees: Sequence[Tree]) -> Tree:
    """One tree. ``full`` holds every node evaluated so far; the returned tree only those that the order picks."""
    full, depth = Tree(), {0: 0}
    known = _evaluate(blocks, width, growth, trees, full, [0])
    while True:
        picked, missing = _picked(full, known, depth, growth)
        if not missing:
            return _pruned(full, known, picked)
        asked = []
        for node in missing:
            children = full.split(node, known[node].feature, known[node].cut)
            depth.update({child: depth[node] + 1 for child in children})
            asked += children
        known.update(_evaluate(blocks, width, growth, trees, full, asked))


def _picked(full: Tree, known: dict[int, _Leaf], depth: dict[int, int], growth: Growth) -> tuple[set[int], list[int]]:
    """Nodes that are split, greatest gain first (the older of equal ones), and those of them without evaluated children."""
    may = lambda node: node in known and known[node].gain > 0 and not (growth.depth and depth[node] >= growth.depth)
    heap = [(-known[0].gain, 0)] if may(0) else []
    picked, missing = set(), []
    while heap and not (growth.leaves and len(picked) + 1 >= growth.leaves):
        _, node = heapq.heappop(heap)
        picked.add(node)
        if full.feature[node] < 0:
            missing.append(node)
            continue
        for child in (full.left[node], full.right[node]):
            if may(child):
                heapq.heappush(heap, (-known[child].gain, child))
    return picked, missing


def _pruned(full: Tree, known: dict[int, _Leaf], picked: set[int]) -> Tree:
    tree, waiting = Tree(), [(0, 0)]
    for old, new in waiting:
        if old in picked:
            waiting += zip((full.left[old], full.right[old]), tree.split(new, full.feature[old], full.cut[old]))
        elif old in known:
            tree.value[new] = known[old].value
    return tree


def _losses(width: int, trees: Sequence[Tree]):
    """Function of one partition: weighted logistic loss and weight of the training and of the held-out rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, y, w, margin, held = _open(batch, i, width, trees)
                loss = w * (np.logaddexp(0, margin) - y * margin)
                row = [loss[~held].sum(), w[~held].sum(), loss[held].sum(), w[held].sum()]
                yield pa.record_batch([pa.array([v], pa.float64()) for v in row], ["l", "n", "hl", "hn"])

    return run


def losses(blocks: DataFrame, width: int, trees: Sequence[Tree]) -> tuple[float, float]:
    """Mean loss of the training and of the held-out rows (NaN without any)."""
    r = blocks.mapInArrow(_losses(width, trees), "l double, n double, hl double, hn double").groupBy().sum().first()
    mean = lambda a, b: a / b if b else math.nan
    return mean(r[0], r[1]), mean(r[2], r[3])


def _advanced(width: int, trees: Sequence[Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [_open(batch, i, width, trees)[3].tobytes() for i in range(batch.num_rows)]
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins, pa.binary()))

    return run


@dataclass(frozen=True)
class BoostedTrees:
    """Base margin, cuts of the features and the trees."""

    base: float
    cuts: list[np.ndarray]
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = to_bins(x, self.cuts)
        return self.base + sum((tree.predict(bins) for tree in self.trees), np.zeros(len(x)))

    def probability(self, column: Column) -> Column:
        """Positive-class probability of an ``array<double>`` column."""
        return F.element_at(map_rows(column, lambda x: 1 / (1 + np.exp(-self.margins(x)))[:, None]), 1)


def fit_boosted(rows: DataFrame, growth: Growth = Growth(), column: str = "f", label: str = "label", weight: str | None = None) -> BoostedTrees:
    """Fit on an array column of a stored table.

    Rows without label and missing arrays are refused; NaN counts as greater than all numbers. One class or an empty
    table gives trees without splits. With ``patience`` a share of the rows, by the hash of their values, is held out,
    and rounds end when its loss has not fallen by ``tolerance`` for so many rounds; the trees up to the best round stay.
    """
    if growth.bins > 256:
        raise ValueError("at most 256 bins")
    held = F.pmod(F.xxhash64(column, F.lit(1)), F.lit(1_000_000)) < int(growth.valid * 1_000_000) if growth.patience else F.lit(False)
    rows = rows.select(
        F.col(column).cast("array<double>").alias("f"), F.col(label).cast("double").alias("y"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), held.alias("held"),
    )
    if rows.filter("y IS NULL OR f IS NULL").limit(1).count():
        raise ValueError("rows without label or features")
    total = rows.filter("NOT held").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos")).first()
    share = min(max((total["pos"] or 0.0) / (total["n"] or 1.0), 1e-6), 1 - 1e-6)
    base = math.log(share / (1 - share))
    cuts = fit_cuts(rows, "f", growth.bins)
    width, done, fresh = len(cuts), [], []
    if not width:
        return BoostedTrees(base, cuts, [])
    blocks = settle(rows.mapInArrow(_blocks(cuts, base), BLOCK))
    best, best_loss = 0, math.inf
    for number in range(1, growth.rounds + 1):
        tree = _grow(blocks, width, growth, fresh)
        if tree.feature[0] < 0:  # nothing left to gain
            break
        done.append(tree)
        fresh.append(tree)
        if growth.patience:
            loss = losses(blocks, width, fresh)[1]
            if math.isnan(loss) or loss < best_loss - growth.tolerance:
                best, best_loss = number, loss if not math.isnan(loss) else math.inf
            elif number - best >= growth.patience:
                break
        if len(fresh) == growth.stored:
            blocks, fresh = settle(blocks.mapInArrow(_advanced(width, fresh), BLOCK)), []
    return BoostedTrees(base, cuts, done[:best] if growth.patience else done)
