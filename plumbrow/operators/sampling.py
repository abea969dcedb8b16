"""Samples, splits and folds that do not depend on row order.

Every decision orders rows by ``md5(seed:key…)`` inside a stratum. A sample or split is then
a small set of cut points in that order: one histogram of digest prefixes finds the bucket a
cut falls in, the rows of that bucket alone are ranked, and the cut row becomes a literal.
Applying the result is a projection, so no row is shuffled and no stratum is sorted as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbrow.functions.columns import digest, plain
from plumbrow.session import settle

PREFIX = 3  # hexadecimal digits per histogram: 4,096 buckets per stratum
BUCKET_ROWS = 1_000_000  # rank rows of a bucket directly up to this size


@dataclass(frozen=True)
class HashOrder:
    """Total order of rows: digest of ``key``, then the ``ties`` columns, then the key itself.

    ``key`` and ``ties`` together must identify a row (or, for group splits, a vector); a cut that
    falls between rows which they do not tell apart is refused.
    """

    key: tuple[str, ...]
    ties: tuple[str, ...] = ()
    seed: str = "42"
    stored: str = ""  # column that holds the digest already

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.ties, *self.key]))

    def digest(self, df: DataFrame) -> Column:
        return F.col(self.stored) if self.stored else digest([plain(df, k) for k in self.key], self.seed)

    def place(self, df: DataFrame) -> Column:
        return F.struct(self.digest(df).alias("h"), *[plain(df, t).alias(t) for t in self.columns])


@dataclass(frozen=True)
class BlockModel:
    """Fitted cut points. Block 0 is the head of the hash order of a stratum, then 1, 2, …"""

    order: HashOrder
    strata: str | None
    counts: dict[Any, int]
    ranks: dict[Any, list[int]]
    cuts: dict[Any, list[tuple | None]] = field(repr=False)

    def block(self, df: DataFrame) -> Column:
        here = self.order.place(df)
        types = {f.name: f.dataType for f in df.schema}

        def after(cut: tuple) -> Column:
            fields = [F.lit(cut[0]).alias("h")]
            fields += [F.lit(v).cast(types[t]).alias(t) for t, v in zip(self.order.columns, cut[1:])]
            return (here > F.struct(*fields)).cast("int")

        def position(value: Any) -> Column:
            place = F.lit(0)
            for rank, cut in zip(self.ranks[value], self.cuts[value]):
                if rank <= 0:
                    place = place + 1
                elif cut is not None:
                    place = place + after(cut)
            return place

        if self.strata is None:
            return position(None)
        out = F.lit(0) if not self.ranks else None  # no stratum: the table was empty
        for value in self.ranks:
            test = F.col(self.strata).eqNullSafe(F.lit(value))
            out = F.when(test, position(value)) if out is None else out.when(test, position(value))
        return out

    def transform(self, df: DataFrame, out: str, names: Sequence[str] | None = None) -> DataFrame:
        block = self.block(df)
        if names is not None:
            block = F.element_at(F.array(*[F.lit(n) for n in names]), block + 1)
        return df.withColumn(out, block)

    def head(self, df: DataFrame) -> DataFrame:
        return df.filter(self.block(df) == 0)


def fit_blocks(
    df: DataFrame,
    order: HashOrder,
    ranks_for: Callable[[dict[Any, int]], dict[Any, list[int]]],
    strata: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> BlockModel:
    """Find the rows at the wanted ranks (1-based) of every stratum.

    ``ranks_for`` receives the rows per stratum. Strata are classes, so the histogram that
    reaches the driver has at most 4,096 rows per class whatever the size of the table.
    """
    group = F.col(strata) if strata else F.lit(None).cast("string")
    rows = df.select(group.alias("s"), order.place(df).alias("p"))

    def histogram(part: DataFrame, digits: int) -> dict[Any, dict[str, int]]:
        found: dict[Any, dict[str, int]] = {}
        keyed = part.groupBy("s", F.substring("p.h", 1, digits).alias("b")).agg(F.count("*").alias("n"))
        for r in keyed.collect():
            found.setdefault(r["s"], {})[r["b"]] = r["n"]
        return found

    digits = PREFIX
    hist = histogram(rows, digits)
    counts = {s: sum(h.values()) for s, h in sorted(hist.items(), key=lambda kv: str(kv[0]))}
    if strata is None and not counts:
        counts = {None: 0}
    ranks = ranks_for(counts)
    targets = []  # (stratum, position in the rank list, digest prefix, rank inside it)
    for s, wanted in ranks.items():
        for i, rank in enumerate(wanted):
            if 0 < rank < counts[s]:
                targets.append((s, i, *_locate(hist[s], rank)))

    def inside(found: list[tuple]) -> Column:
        prefix = F.substring("p.h", 1, digits)
        test = F.lit(False)
        for s in {t[0] for t in found}:
            hit = prefix.isin(sorted({t[2] for t in found if t[0] == s}))
            test = test | (F.col("s").eqNullSafe(F.lit(s)) & hit)
        return test

    while targets and digits < 30 and max(hist[t[0]][t[2]] for t in targets) > bucket_rows:
        part = rows.filter(inside(targets))
        digits += PREFIX
        hist = histogram(part, digits)
        targets = [
            (s, i, *_locate({b: n for b, n in hist[s].items() if b.startswith(prefix)}, rank))
            for s, i, prefix, rank in targets
        ]

    cuts: dict[Any, list[tuple | None]] = {s: [None] * len(w) for s, w in ranks.items()}
    if targets:
        prefix = F.substring("p.h", 1, digits)
        order_in = Window.partitionBy("s", "b").orderBy("p")
        ranked = (
            rows.filter(inside(targets))
            .withColumn("b", prefix)
            .withColumn("rn", F.row_number().over(order_in))
            .withColumn("same", F.coalesce(F.lead("p").over(order_in).eqNullSafe(F.col("p")), F.lit(False)))
            .filter(F.col("rn").isin(sorted({t[3] for t in targets})))
            .collect()
        )
        wanted_places = {(t[0], t[2], t[3]) for t in targets}
        if any(r["same"] and (r["s"], r["b"], r["rn"]) in wanted_places for r in ranked):
            raise ValueError(f"{order.columns} do not identify the rows at a cut")
        found = {(r["s"], r["b"], r["rn"]): tuple(r["p"]) for r in ranked}
        for s, i, b, rank in targets:
            cuts[s][i] = found[(s, b, rank)]
    return BlockModel(order, strata, counts, ranks, cuts)


def _locate(hist: dict[str, int], rank: int) -> tuple[str, int]:
    """Bucket that holds the given rank, and the rank inside it."""
    for bucket in sorted(hist):
        if rank <= hist[bucket]:
            return bucket, rank
        rank -= hist[bucket]
    raise ValueError("rank beyond the rows of the stratum")


# ---------------------------------------------------------------- quotas


def largest_remainder(counts: dict[Any, int], draws: int) -> dict[Any, int]:
    """Share ``draws`` over classes by size: floors first, then the largest remainders."""
    total = sum(counts.values())
    exact = {c: draws * n / total for c, n in counts.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    by_rest = sorted(counts, key=lambda c: (-(exact[c] - quota[c]), str(c)))
    for c in by_rest[: draws - sum(quota.values())]:
        quota[c] += 1
    return quota


def fold_sizes(counts: dict[Any, int], k: int) -> dict[Any, list[int]]:
    """Rows of each class in each fold: classes laid end to end and dealt out in turn."""
    sizes, start = {}, 0
    for c, n in counts.items():
        sizes[c] = [len(range((f - start) % k, n, k)) for f in range(k)]
        start += n
    return sizes


# ---------------------------------------------------------------- samples


def sample_fraction(
    df: DataFrame, label: str, key: Sequence[str], fractions: dict[Any, float],
    ties: Sequence[str] = (), seed: str | int = 42,
) -> DataFrame:
    """Keep ``round(fraction * n)`` rows of each named class and all rows of the others."""
    model = fit_blocks(
        df, HashOrder(tuple(key), tuple(ties), str(seed)),
        lambda n: {c: [round(fractions.get(c, 1.0) * m)] for c, m in n.items()}, label,
    )
    return model.head(df)


def sample_per_class(
    df: DataFrame, label: str, key: Sequence[str], targets: dict[Any, int],
    ties: Sequence[str] = (), seed: str | int = 42, strict: bool = False,
) -> DataFrame:
    """Keep a fixed number of rows per class; classes without a target are dropped.

    A class smaller than its target is kept whole, or refused when ``strict``.
    """

    def ranks(n: dict[Any, int]) -> dict[Any, list[int]]:
        short = {c: t for c, t in targets.items() if n.get(c, 0) < t}
        if strict and short:
            raise ValueError(f"classes smaller than their target: {short}")
        return {c: [targets.get(c, 0)] for c in n}

    return fit_blocks(df, HashOrder(tuple(key), tuple(ties), str(seed)), ranks, label).head(df)


def sample_uniform(
    df: DataFrame, key: Sequence[str], n: int, ties: Sequence[str] = (), seed: str | int = 42,
) -> DataFrame:
    """Keep exactly ``min(n, rows)`` rows."""
    order = HashOrder(tuple(key), tuple(ties), str(seed))
    return fit_blocks(df, order, lambda c: {None: [n]}).head(df)


# ---------------------------------------------------------------- splits


def fit_stratified_split(
    df: DataFrame, label: str, key: Sequence[str], test: float = 0.2,
    ties: Sequence[str] = (), seed: str | int = 42,
) -> BlockModel:
    """``ceil(test * n)`` test rows, shared over classes by largest remainder."""

    def ranks(n: dict[Any, int]) -> dict[Any, list[int]]:
        quota = largest_remainder(n, math.ceil(test * sum(n.values())))
        return {c: [quota[c]] for c in n}

    return fit_blocks(df, HashOrder(tuple(key), tuple(ties), str(seed)), ranks, label)


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str], test: float = 0.2,
    ties: Sequence[str] = (), seed: str | int = 42, out: str = "split",
) -> DataFrame:
    model = fit_stratified_split(df, label, key, test, ties, seed)
    return model.transform(df, out, ["test", "train"])


def dev_split(
    train: DataFrame, label: str, key: Sequence[str], rows: int | None = None, valid: float = 0.25,
    ties: Sequence[str] = (), seed: str | int = 42, out: str = "split",
) -> DataFrame:
    """A stratified validation split of the training side, or of a uniform sample of ``rows`` of it."""
    salted = f"{seed}:dev"
    sample = train if rows is None else sample_uniform(train, key, rows, ties, salted)
    model = fit_stratified_split(sample, label, key, valid, ties, f"{salted}:valid")
    return model.transform(sample, out, ["valid", "train"])


def fit_stratified_folds(
    df: DataFrame, label: str, key: Sequence[str], k: int = 5,
    ties: Sequence[str] = (), seed: str | int = 42,
) -> BlockModel:
    def ranks(n: dict[Any, int]) -> dict[Any, list[int]]:
        ends = {}
        for c, sizes in fold_sizes(n, k).items():
            ends[c] = [sum(sizes[: i + 1]) for i in range(k - 1)]
        return ends

    return fit_blocks(df, HashOrder(tuple(key), tuple(ties), f"{seed}:folds"), ranks, label)


def stratified_folds(
    df: DataFrame, label: str, key: Sequence[str], k: int = 5,
    ties: Sequence[str] = (), seed: str | int = 42, out: str = "fold",
) -> DataFrame:
    """Fold number 0…k-1; class sizes per fold differ by at most one row."""
    return fit_stratified_folds(df, label, key, k, ties, seed).transform(df, out)


def group_split(
    df: DataFrame, features: Sequence[str], test: float = 0.2, seed: str | int = 42, out: str = "split",
) -> DataFrame:
    """``ceil(test * groups)`` distinct vectors go to the test side with all their rows.

    The side of a row follows from its own vector, so the groups are found once, stored for
    the two passes of the fit and never joined back: a vector that owns a third of the table
    costs nothing extra.
    """
    groups = settle(df.select(*features).distinct())
    order = HashOrder(tuple(features), tuple(features), str(seed))
    model = fit_blocks(groups, order, lambda c: {None: [math.ceil(test * n)] for n in c.values()})
    return model.transform(df, out, ["test", "train"])


def validation_tail(
    df: DataFrame, key: Sequence[str], share: float = 0.1,
    ties: Sequence[str] = (), seed: str | int = 42, out: str = "is_valid", stored: str = "",
) -> DataFrame:
    """Flag the last ``n - floor(n * (1 - share))`` rows of the hash order."""
    order = HashOrder(tuple(key), tuple(ties), f"{seed}:tail", stored)
    model = fit_blocks(df, order, lambda c: {None: [math.floor(n * (1 - share))] for n in c.values()})
    return model.transform(df, out)


def attach_split(df: DataFrame, assignment: DataFrame, key: Sequence[str]) -> DataFrame:
    """Join a stored split table back to its rows; a row without an assignment ends the query.

    The key is unique, so the join is balanced. Missing key parts match missing ones.
    """
    named = assignment.select(*[F.col(c).alias(f"_{c}") if c in key else F.col(c) for c in assignment.columns], F.lit(1).alias("_there"))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    joined = df.join(named, match, "left")
    unknown = F.raise_error(F.concat(F.lit("no split is stored for the key "), F.to_json(F.struct(*key))))
    out = [c for c in assignment.columns if c not in key]
    return joined.select(*df.columns, *[F.when(F.col("_there").isNull(), unknown).otherwise(F.col(c)).alias(c) for c in out])
