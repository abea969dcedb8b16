"""Duplicates, label conflicts, the label ceiling and train/test overlap.

All counts are two-level aggregates: rows are reduced to one record per vector (partial
aggregation before the shuffle absorbs a vector that owns most rows), and the records are
reduced to one report row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.functions.columns import is_fractional, ratio, round_even, vector_key
from plumbrow.operators.skew import join_groups
from plumbrow.session import settle


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def label_rate(df: DataFrame, by: str, label: str, decimals: int = 4) -> DataFrame:
    """Rows and share of positive labels per partition."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), round_even(F.avg(F.col(label).cast("double")), decimals).alias("attack_rate")
    )


def round_features(df: DataFrame, features: Sequence[str], decimals: int) -> DataFrame:
    """Round fractional features; later steps then see near-equal vectors as equal."""
    fractional = [c for c in features if is_fractional(df.schema[c].dataType)]
    return df.withColumns({c: round_even(F.col(c), decimals) for c in fractional})


def hashed_vectors(df: DataFrame, features: Sequence[str], out: str = "vector") -> DataFrame:
    """Replace wide vectors or long texts by their SHA-256 before grouping on them."""
    keep = [c for c in df.columns if c not in features]
    return df.select(*keep, vector_key(df, features).alias(out))


# ---------------------------------------------------------------- duplicates and conflicts


def duplicates(df: DataFrame, features: Sequence[str], decimals: int = 4) -> DataFrame:
    """Rows beyond the first of each vector, and their share."""
    per = df.groupBy(*features).agg(F.count("*").alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    return per.agg(
        total.alias("n_rows"),
        F.count("*").alias("n_groups"),
        (total - F.count("*")).alias("duplicate_rows"),
        round_even(ratio(total - F.count("*"), total), decimals).alias("duplicate_rate"),
    )


def flag_duplicates(
    df: DataFrame, features: Sequence[str], key: Sequence[str], out: str = "is_duplicate",
) -> DataFrame:
    """1 on every row that is not the first (smallest key, a missing one first) of its vector.

    The first rows come from a grouped minimum and are matched on the unique row key, so the
    join is even however the vectors are distributed.
    """
    if len(key) == 1:  # a plain minimum keeps the hash aggregate
        firsts = df.groupBy(*features).agg(F.min(key[0]).alias("_first_0"), F.count(key[0]).alias("_n"), F.count("*").alias("_all"))
        firsts = firsts.select(F.when(F.col("_n") == F.col("_all"), F.col("_first_0")).alias("_first_0"), F.lit(0).alias(out))
    else:
        firsts = df.groupBy(*features).agg(F.min(F.struct(*key)).alias("_k"))
        firsts = firsts.select(*[F.col(f"_k.{k}").alias(f"_first_{i}") for i, k in enumerate(key)], F.lit(0).alias(out))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_first_{i}")) for i, k in enumerate(key)])
    joined = df.join(firsts, same, "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(1))).select(*df.columns, out)


def known_label(label: str) -> Column:
    """The label; a missing one ends the query."""
    return F.when(F.col(label).isNull(), F.raise_error(F.lit(f"missing values in {label}"))).otherwise(F.col(label))


def _by_vector(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.groupBy(*features).agg(
        F.count("*").alias("_n"),
        F.min(label).alias("_low"),
        F.max(label).alias("_high"),
        F.count(F.when(known_label(label) == 1, 1)).alias("_pos"),
    )


def label_conflicts(df: DataFrame, features: Sequence[str], label: str, decimals: int = 4) -> DataFrame:
    """Rows whose vector carries more than one label."""
    mixed = F.col("_low") != F.col("_high")
    rows = F.coalesce(F.sum(F.when(mixed, F.col("_n"))), F.lit(0))
    return _by_vector(df, features, label).agg(
        F.count(F.when(mixed, 1)).alias("conflicting_groups"),
        rows.alias("conflict_rows"),
        round_even(ratio(rows, F.coalesce(F.sum("_n"), F.lit(0))), decimals).alias("conflict_rate"),
    )


def conflict_rows(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The rows themselves, found by membership in the set of conflicting vectors."""
    mixed = _by_vector(df, features, label).filter("_low <> _high").select(*features, "_n")
    return join_groups(df, mixed, features, "_n", df.count(), "left_semi")


def unique_vectors(df: DataFrame, features: Sequence[str], label: str, value: int = 1) -> DataFrame:
    """Distinct vectors and rows of one class."""
    per = df.filter(F.col(label) == value).groupBy(*features).agg(F.count("*").alias("_n"))
    return per.agg(
        F.count("*").alias("unique_vectors"), F.coalesce(F.sum("_n"), F.lit(0)).alias("class_rows")
    )


def ceiling_columns() -> dict[str, Column]:
    """Report columns over one record per vector with ``_n`` rows and ``_pos`` positives.

    Fixed values: the field names of the published report.
    """
    pos, n = F.col("_pos"), F.col("_n")
    mixed = (pos > 0) & (pos < n)
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    mixed_rows = F.coalesce(F.sum(F.when(mixed, n)), F.lit(0))
    return {
        "n_rows": rows,
        "n_groups": F.count("*"),
        "duplicate_rate": round_even(ratio(rows - F.count("*"), rows), 4),
        "conflicting_groups": F.count(F.when(mixed, 1)),
        "rows_in_conflicting_groups": mixed_rows,
        "rows_in_conflicting_groups_pct": round_even(ratio(mixed_rows * 100, rows), 2),
        "deterministic_upper_bound": round_even(ratio(F.sum(F.greatest(pos, n - pos)), rows), 4),
    }


def label_ceiling(
    df: DataFrame, features: Sequence[str], label: str, rounding: int | None = None,
) -> DataFrame:
    """Best accuracy any function of the vector can reach, with duplicate and conflict counts."""
    if rounding is not None:
        df = round_features(df, features, rounding)
    return _report(_by_vector(df, features, label), ceiling_columns())


def with_group_id(
    df: DataFrame, features: Sequence[str], mode: str = "key", out: str = "group_id",
) -> DataFrame:
    """Identify equal vectors.

    ``key`` is a SHA-256 text computed on the row itself. ``dense`` numbers the distinct
    vectors 0, 1, … in their sort order: the sorted vectors are stored, each stored partition
    is counted, and the running counts shift the positions inside the partitions.
    """
    if mode == "key":
        return df.withColumn(out, vector_key(df, features))
    groups = df.groupBy(*features).agg(F.count("*").alias("_n")).orderBy(*features)
    stored = settle(groups.withColumn("_at", F.monotonically_increasing_id()))
    partition, position = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = stored.groupBy(partition.alias("_p")).agg(F.count("*").alias("groups"), F.sum("_n").alias("rows"))
    starts, seen, total = [], 0, 0
    for r in sizes.orderBy("_p").collect():  # one record per partition of the sort
        starts.append((r["_p"], seen))
        seen, total = seen + r["groups"], total + r["rows"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_p long, _start long"))
    numbered = stored.withColumn("_p", partition).join(offsets, on="_p")
    numbered = numbered.select(*features, "_n", (F.col("_start") + position).alias(out))
    return join_groups(df, numbered, features, "_n", total).drop("_n")


# ---------------------------------------------------------------- overlap


def side(split: Column, name: str) -> Column:
    """Rows of one side of a split."""
    return F.count(F.when(split == name, 1))


def _report(per: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return per.agg(*[c.alias(name) for name, c in columns.items()])


def overlap_columns(train: str, test: str) -> dict[str, Column]:
    """Report columns over one record per vector with its ``train`` and ``test`` rows."""
    a, b = F.col(train), F.col(test)
    shared = (a > 0) & (b > 0)
    n_test = F.coalesce(F.sum(b), F.lit(0))
    leaked = F.coalesce(F.sum(F.when(shared, b)), F.lit(0))
    return {
        "n_train": F.coalesce(F.sum(a), F.lit(0)),
        "n_test": n_test,
        "shared_groups": F.count(F.when(shared, 1)),
        "test_rows_whose_vector_also_in_train": leaked,
        "test_rows_leaked_pct": round_even(ratio(leaked * 100, n_test), 2),
    }


def overlap(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """Vectors on both sides of a split and the test rows they touch."""
    s = F.col(split)
    per = df.groupBy(*features).agg(side(s, "train").alias("_a"), side(s, "test").alias("_b"))
    return _report(per, overlap_columns("_a", "_b"))


def entity_overlap(df: DataFrame, entity: str, split: str = "split") -> DataFrame:
    """The same on one entity column. Rows without an entity count in the denominator only."""
    s = F.col(split)
    per = df.groupBy(entity).agg(side(s, "train").alias("_a"), side(s, "test").alias("_b"))
    known = F.col(entity).isNotNull()
    if is_fractional(df.schema[entity].dataType):
        known = known & ~F.isnan(entity)
    train, test = known & (F.col("_a") > 0), known & (F.col("_b") > 0)
    n_test = F.coalesce(F.sum("_b"), F.lit(0))
    leaked = F.coalesce(F.sum(F.when(train & test, F.col("_b"))), F.lit(0))
    return per.agg(
        F.count(F.when(train, 1)).alias("distinct_entities_train"),
        F.count(F.when(test, 1)).alias("distinct_entities_test"),
        F.count(F.when(train & test, 1)).alias("shared_entities"),
        leaked.alias("test_rows_with_entity_seen_in_train"),
        round_even(ratio(leaked * 100, n_test), 2).alias("test_rows_with_entity_seen_in_train_pct"),
    )


def shared_keys(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Key set intersection; both sides are reduced to distinct keys before they meet."""
    return a.select(*on).distinct().intersect(b.select(*on).distinct())


# ---------------------------------------------------------------- reports


def long_report(df: DataFrame, section: str, item: str = "all") -> DataFrame:
    """One wide report row to ``(section, item, metric, value)``."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]
    return df.select(F.inline(F.array(*pairs))).select(
        F.lit(section).alias("section"), F.lit(item).alias("item"), "metric", "value"
    )


def metric_delta(report: DataFrame, section: str, base: str, other: str, decimals: int = 4) -> DataFrame:
    """``other - base`` of every metric, matched by name inside a section."""
    value = lambda item: F.max(F.when(F.col("item") == item, F.col("value")))
    return (
        report.filter((F.col("section") == section) & F.col("item").isin(base, other))
        .groupBy("metric")
        .agg(round_even(value(other) - value(base), decimals).alias("delta"))
    )


def long_sections(per: DataFrame, sections: dict[str, dict[str, Column]]) -> DataFrame:
    """Several reports over the same records in one aggregate, as long rows."""
    flat = [(s, m, c) for s, columns in sections.items() for m, c in columns.items()]
    wide = per.agg(*[c.cast("double").alias(f"v{i}") for i, (_, _, c) in enumerate(flat)])
    rows = [
        F.struct(F.lit(s).alias("section"), F.lit("all").alias("item"), F.lit(m).alias("metric"), F.col(f"v{i}").alias("value"))
        for i, (s, m, _) in enumerate(flat)
    ]
    return wide.select(F.inline(F.array(*rows)))
