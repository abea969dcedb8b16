"""Projections, casts, missing values and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.functions.columns import finite, is_fractional, is_number, numeric_features

# Columns that identify a flow and would leak its origin.
LEAKY_COLUMNS = ("Unnamed: 0", "flow_id", "timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol")

EXACT_CELLS = 1_000_000  # values of all columns together that one task may rank
SKETCH = 10_000  # rank error of a sketch is rows / SKETCH


def drop_leaky(df: DataFrame, columns: Sequence[str] = LEAKY_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def keep_numeric(df: DataFrame, label: str | None = None) -> DataFrame:
    keep = numeric_features(df, label) + ([label] if label else [])
    return df.select(*keep)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns[:20]}")


def cast_features(df: DataFrame, features: Sequence[str], dtype: str = "double") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(dtype) for c in features})


def cast_label(df: DataFrame, label: str, dtype: str = "int") -> DataFrame:
    """Cast the label and refuse missing ones."""
    return df.withColumn(label, F.coalesce(F.col(label), F.raise_error(F.lit("missing label"))).cast(dtype))


def inf_to_null(df: DataFrame, features: Sequence[str]) -> DataFrame:
    fractional = [c for c in features if is_fractional(df.schema[c].dataType)]
    return df.withColumns({c: finite(F.col(c)) for c in fractional})


def class_rows(df: DataFrame, label: str, value: int = 1) -> DataFrame:
    return df.filter(F.col(label) == value)


def with_prediction(df: DataFrame, score: str = "score", threshold: float = 0.5, out: str = "pred") -> DataFrame:
    return df.withColumn(out, (F.col(score) >= threshold).cast("int"))


def label_from_name(path: Column, word: str) -> Column:
    """0 where the name contains ``word``, else 1."""
    return F.when(path.contains(word), 0).otherwise(1)


def column_profile(df: DataFrame, label: str) -> DataFrame:
    """One row per column: type, whether it is a feature, and its values that are not missing."""
    rows = []
    for i, f in enumerate(df.schema):
        role = "label" if f.name == label else "retained" if is_number(f.dataType) else "excluded"
        rows.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(role).alias("role"), F.col(f"n{i}").alias("n_values"),
            )
        )
    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"n{i}") for i, f in enumerate(df.schema)])
    return counts.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------- medians


def medians(
    df: DataFrame, features: Sequence[str], cells: int = EXACT_CELLS, sketch: int = SKETCH,
) -> dict[str, float | None]:
    """Exact interpolated medians of all features.

    Spark's exact ranks gather the distinct values of a column in one task, so they are asked for
    once few values are left: ``cells`` over all columns. Until then a quantile sketch brackets the
    middle ranks, the next pass counts the rows below the bracket, and sketches are repeated on the
    rows inside it. All columns narrow together; each pass returns one row. Where both middle
    values are equal that value is the median, infinities included.
    """
    if not features:
        return {}
    return _bracketed_medians(df, features, max(cells // len(features), 1), sketch)


def _bracketed_medians(
    df: DataFrame, features: Sequence[str], exact_rows: int, sketch: int,
) -> dict[str, float | None]:
    n_row = df.agg(*[F.count(c).alias(c) for c in features]).first()
    result: dict[str, float | None] = {c: None for c in features if n_row[c] == 0}
    # wanted ranks (0-based), and per column the open interval known to hold the unknown ones
    ranks = {c: ((n_row[c] - 1) // 2, n_row[c] // 2) for c in features if n_row[c]}
    known: dict[str, dict[int, float]] = {c: {} for c in ranks}
    low: dict[str, float | None] = {c: None for c in ranks}
    high: dict[str, float | None] = {c: None for c in ranks}
    offset = {c: 0 for c in ranks}  # rows at or below the lower end
    inside = {c: n_row[c] for c in ranks}
    pad = {c: 2.0 / sketch for c in ranks}

    def within(c: str) -> Column:
        v = F.col(c).cast("double")
        test = v.isNotNull()
        if low[c] is not None:
            test = test & (v > low[c])
        if high[c] is not None:
            test = test & (v < high[c])
        return F.when(test, v)

    def open_ranks(c: str) -> list[int]:
        return sorted({r - offset[c] for r in ranks[c] if r not in known[c]})

    todo = list(ranks)
    while todo:
        wide = [c for c in todo if inside[c] > exact_rows]
        aggs = []
        for i, c in enumerate(todo):
            rel = open_ranks(c)
            if c in wide:
                marks = [max(rel[0] / inside[c] - pad[c], 0.0), min((rel[-1] + 1) / inside[c] + pad[c], 1.0)]
                aggs.append(F.percentile_approx(f"v{i}", marks, sketch).alias(c))
            else:  # the half step keeps the wanted row clear of floating-point rounding
                disc = [
                    F.expr(f"percentile_disc({(r + 0.5) / inside[c]!r}) WITHIN GROUP (ORDER BY v{i})") for r in rel
                ]
                aggs.append(F.array(*disc).alias(c))
        found = df.select(*[within(c).alias(f"v{i}") for i, c in enumerate(todo)]).agg(*aggs).first()
        for c in todo:
            if c not in wide:
                for r, v in zip(open_ranks(c), found[c]):
                    known[c][r + offset[c]] = v
        if not wide:
            break
        checks = []
        for c in wide:
            a, b = found[c]
            v = within(c)
            checks += [
                F.count(F.when(v < a, 1)).alias(f"{c}_below"), F.count(F.when(v == a, 1)).alias(f"{c}_a"),
                F.count(F.when((v > a) & (v < b), 1)).alias(f"{c}_mid"),
                F.count(F.when(v == b, 1)).alias(f"{c}_b"),
            ]
        count = df.agg(*checks).first()
        for c in wide:
            a, b = found[c]
            below, at_a = count[f"{c}_below"], count[f"{c}_a"]
            mid, at_b = count[f"{c}_mid"], count[f"{c}_b"]
            for r in open_ranks(c):
                if below <= r < below + at_a:
                    known[c][r + offset[c]] = a
                elif a != b and below + at_a + mid <= r < below + at_a + mid + at_b:
                    known[c][r + offset[c]] = b
            left = open_ranks(c)
            if not left:
                inside[c] = 0
            elif below + at_a <= left[0] and left[-1] < below + at_a + mid:
                low[c], high[c] = a, b
                offset[c] += below + at_a
                inside[c] = mid
            else:  # the sketch missed the ranks: look again with a wider bracket
                pad[c] *= 4
        todo = [c for c in wide if inside[c]]
    for c in ranks:
        first, second = (known[c][r] for r in ranks[c])
        result[c] = first if first == second else first + (second - first) / 2
    return {c: result[c] for c in features}


def impute_median(
    df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None, legacy_inf: bool = False,
) -> DataFrame:
    """Infinities and missing values become the column median.

    Medians come from ``fit_on`` (the training rows; default all rows). With ``legacy_inf``
    they are taken before infinities are removed, so that infinite values still count.
    """
    source = df if fit_on is None else fit_on
    if legacy_inf:
        fractional = [c for c in features if is_fractional(df.schema[c].dataType)]
        source = source.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fractional})
    else:
        source = inf_to_null(source, features)
    values = medians(source, features)
    cleaned = inf_to_null(df, features)
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(values[c])) for c in features}
    return cleaned.withColumns(fill)


# ---------------------------------------------------------------- class weights


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight ``n / (classes * rows of the class)`` per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    weight = F.lit(float(total["n"] or 0)) / (F.lit(float(total["k"])) * F.col("n").cast("double"))
    return counts.withColumn("weight", weight)


def fit_balance(df: DataFrame, label: str) -> dict:
    return {r[label]: r["weight"] for r in class_weights(df, label).collect()}


def positive_weight(df: DataFrame, label: str) -> float:
    """Negatives per positive."""
    r = df.agg(F.count(F.when(F.col(label) == 0, 1)).alias("neg"), F.count(F.when(F.col(label) == 1, 1)).alias("pos"))
    n = r.first()
    return n["neg"] / max(n["pos"], 1)


def with_weight(df: DataFrame, label: str, weights: dict, out: str = "weight") -> DataFrame:
    pairs = [F.lit(x) for item in weights.items() for x in item]
    return df.withColumn(out, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(label)), F.lit(1.0)))


def moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum: one row per feature, one pass."""
    aggs = []
    for c in features:
        v = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("feature"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
                F.min(v).alias("min"), F.max(v).alias("max"),
            ).alias(c)
        )
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.col(f"`{c}`") for c in features])))

