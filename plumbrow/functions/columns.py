"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def numeric_features(df: DataFrame, label: str | None = None, drop: Sequence[str] = ()) -> list[str]:
    """Numeric column names without the label; booleans are not numbers."""
    skip = {label, *drop}
    return [f.name for f in df.schema if is_number(f.dataType) and f.name not in skip]


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """``num / den`` in double, ``empty`` where the denominator is zero."""
    den = den.cast("double")
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(empty).cast("double"))


def round_even(c: Column, decimals: int) -> Column:
    """Scale, round half to even, scale back: the rounding of numeric array libraries."""
    scale = float(10 ** abs(decimals))
    if decimals >= 0:
        return F.rint(c * scale) / scale
    return F.rint(c / scale) * scale


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def double_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def plain(df: DataFrame, name: str) -> Column:
    """A column whose equal values have one spelling: -0.0 is turned into 0.0."""
    c = F.col(name)
    return c + F.lit(0.0) if is_fractional(df.schema[name].dataType) else c


def digest(parts: Sequence[Column], seed: str | int) -> Column:
    """Hexadecimal MD5 of ``seed:part:part…``; the same values give the same digest anywhere.

    A part is spelt with its length, a missing one as ``-``, so that no two keys share a spelling.
    """
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_spelled(p.cast("string")) for p in parts]))


def _spelled(text: Column) -> Column:
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit("="), text), F.lit("-"))


def vector_key(df: DataFrame, features: Sequence[str]) -> Column:
    """SHA-256 of a whole feature vector, to carry wide vectors or long texts through a shuffle.

    Every part is written with its length, so that no two vectors share a spelling.
    """
    return F.sha2(F.concat_ws("|", *[_spelled(plain(df, name).cast("string")) for name in features]), 256)


def path_component(path: Column, name: str) -> Column:
    """True where ``name`` is one whole component of a path."""
    return F.array_contains(F.split(path, "/"), name)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | c.contains(w)
    return test


def has_suffix(c: Column, suffixes: Sequence[str]) -> Column:
    """Case-insensitive suffix test."""
    test = F.lit(False)
    for s in suffixes:
        test = test | F.lower(c).endswith(s.lower())
    return test


def code_names(code: Column, names: dict[int, str]) -> Column:
    """Label code to label name; unknown codes give NULL."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with microseconds."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1e6)
