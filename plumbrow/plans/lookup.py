"""A scorer that SQL can state: the training share of positives among equal vectors.

It is the best accuracy-maximising function of the vector that the training rows support,
and it makes every metric checkable. Rows are reduced to one record per vector first; the
score is a column of that record, so no row is joined to its vector.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.operators.sampling import BlockModel, fold_sizes


def train_prior(model: BlockModel) -> float:
    """Share of positives on the training side of a fitted stratified split."""
    train = {c: n - model.ranks[c][0] for c, n in model.counts.items()}
    return train.get(1, 0) / max(sum(train.values()), 1)


def _count(test: Column) -> Column:
    return F.count(F.when(test, 1))


def _scored(config: str, score: Column) -> list[Column]:
    return [F.lit(config).alias("config"), score.alias("score"), (score >= 0.5).cast("int").alias("pred")]


def vector_sides(df: DataFrame, features: Sequence[str], label: str = "label", split: str = "split") -> DataFrame:
    """Training rows ``_n`` and positives ``_p``, test positives ``_pos`` and negatives ``_neg`` per vector."""
    train, test = F.col(split) == "train", F.col(split) == "test"
    hit = F.col(label) == 1
    return df.groupBy(*features).agg(
        _count(train).alias("_n"), _count(train & hit).alias("_p"),
        _count(test & hit).alias("_pos"), _count(test & ~hit).alias("_neg"),
    )


def lookup_counts(sides: DataFrame, features: Sequence[str], config: str, prior: float) -> DataFrame:
    """Score counts ``(config, score, pred, pos, neg)`` of the test rows.

    ``sides`` may be grouped by more features than asked for: rows are reduced to the finest
    vectors once, and every coarser feature set adds those records up.
    """
    per = sides.groupBy(*features).agg(*[F.sum(c).alias(c) for c in ("_n", "_p", "_pos", "_neg")])
    n = F.col("_n").cast("double")
    score = F.when(n > 0, F.col("_p") / n).otherwise(F.lit(prior))
    rows = per.filter("_pos + _neg > 0")
    return rows.select(*_scored(config, score), F.col("_pos").alias("pos"), F.col("_neg").alias("neg"))


def vector_folds(df: DataFrame, features: Sequence[str], k: int, label: str = "label", fold: str = "fold") -> DataFrame:
    """Rows and positives per vector: all (``_n``, ``_p``) and of each fold (``_n0``, ``_p0``, …)."""
    hit = F.col(label) == 1
    aggs = [_count(hit).alias("_p"), F.count("*").alias("_n")]
    for f in range(k):
        here = F.col(fold) == f
        aggs += [_count(here & hit).alias(f"_p{f}"), _count(here).alias(f"_n{f}")]
    return df.groupBy(*features).agg(*aggs)


def lookup_fold_counts(
    per_fold: DataFrame, features: Sequence[str], config: str, folds: BlockModel, k: int,
) -> DataFrame:
    """Score counts of every fold, each scored by the other folds; no row is read again."""
    names = ["_n", "_p", *[f"_{c}{f}" for f in range(k) for c in "np"]]
    per = per_fold.groupBy(*features).agg(*[F.sum(c).alias(c) for c in names])
    sizes = fold_sizes(folds.counts, k)
    positives, total = folds.counts.get(1, 0), sum(folds.counts.values())
    rows = []
    for f in range(k):
        train = (F.col("_n") - F.col(f"_n{f}")).cast("double")
        rest = total - sum(s[f] for s in sizes.values())
        prior = (positives - sizes.get(1, [0] * k)[f]) / max(rest, 1)
        score = F.when(train > 0, (F.col("_p") - F.col(f"_p{f}")) / train).otherwise(F.lit(prior))
        rows.append(
            F.struct(
                F.lit(f).alias("fold"), *_scored(config, score), F.col(f"_p{f}").alias("pos"),
                (F.col(f"_n{f}") - F.col(f"_p{f}")).alias("neg"),
            )
        )
    return per.select(F.inline(F.array(*rows))).filter("pos + neg > 0")
