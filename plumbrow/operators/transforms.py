"""Fit-on-train feature transforms over one ``array<double>`` column.

Estimators read the training rows once and keep a few numbers per position; the fitted
models are plain column expressions and apply unchanged to batch and streaming tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.functions.batches import map_rows
from plumbrow.functions.columns import clip, double_array

NARROW = 16  # positions of an array that are written out one by one


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Scalar columns to one ``array<double>`` column."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in features]))


def as_vector(df: DataFrame, column: str, out: str) -> DataFrame:
    """Array column to the vector type that Spark ML classifiers read."""
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def concat_arrays(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Side-by-side arrays of the same row become one."""
    return df.withColumn(out, F.concat(*columns))


def array_moments(df: DataFrame, column: str) -> DataFrame:
    """Per position: mean, population deviation, minimum, maximum."""
    return (
        df.select(F.posexplode(column).alias("pos", "v"))
        .withColumn("v", F.col("v").cast("double"))
        .groupBy("pos")
        .agg(
            F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
            F.min("v").alias("low"), F.max("v").alias("high"),
        )
    )


def _state(df: DataFrame, column: str) -> list:
    """The moments on the driver: one record per array position.

    Positions of narrow arrays are aggregates beside each other, without a row per position.
    """
    one = df.select(F.size(column).alias("d")).first()
    width = one["d"] or 0 if one else 0
    if 0 < width <= NARROW:
        aggregates = []
        for i in range(width):
            v = F.get(column, F.lit(i)).cast("double")
            named = {"mean": F.avg(v), "std": F.stddev_pop(v), "low": F.min(v), "high": F.max(v)}
            aggregates.append(F.struct(*[c.alias(n) for n, c in named.items()]))
        *moments, longest = df.agg(*aggregates, F.max(F.size(column))).first()
        if longest == width:
            return moments
    return array_moments(df, column).orderBy("pos").collect()


class _Column(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Input and output column with keyword construction."""

    def __init__(self, inputCol: str = "features", outputCol: str = "out", **values):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="out")
        self._set(inputCol=inputCol, outputCol=outputCol, **values)

    def _io(self) -> dict[str, str]:
        return {"inputCol": self.getInputCol(), "outputCol": self.getOutputCol()}

    def _value(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def _source(self) -> Column:
        return F.col(self.getInputCol()).cast("array<double>")


def _floats(name: str) -> Param:
    return Param(Params._dummy(), name, name, TypeConverters.toListFloat)


def each(x: Column, width: int, function: Callable[[Column, Column], Column]) -> Column:
    """``function`` of every value and its position; arrays of a known small width are written out, which Spark compiles."""
    general = F.transform(x, function)
    if not 0 < width <= NARROW:
        return general
    return F.when(F.size(x) == width, F.array(*[function(F.get(x, F.lit(i)), F.lit(i)) for i in range(width)])).otherwise(general)


class StandardizeModel(_Column, Model):
    mean, scale = _floats("mean"), _floats("scale")

    def _transform(self, df: DataFrame) -> DataFrame:
        mean, scale = double_array(self._value("mean")), double_array(self._value("scale"))
        scaled = lambda x, i: (x - mean[i]) / scale[i]
        return df.withColumn(self.getOutputCol(), each(self._source(), len(self._value("mean")), scaled))


class Standardize(_Column, Estimator):
    """``(x - mean) / population deviation``; a constant position is divided by 1."""

    def _fit(self, df: DataFrame) -> StandardizeModel:
        rows = _state(df, self.getInputCol())
        return StandardizeModel(mean=[r["mean"] for r in rows], scale=[r["std"] or 1.0 for r in rows], **self._io())


class BoundedScaleModel(_Column, Model):
    low, high = _floats("low"), _floats("high")
    clipped = Param(Params._dummy(), "clipped", "limit the result to [-1, 1]", TypeConverters.toBoolean)

    def _transform(self, df: DataFrame) -> DataFrame:
        low, high = self._value("low"), self._value("high")
        base, span = double_array(low), double_array([(h - l) or 1.0 for l, h in zip(low, high)])
        limit = self._value("clipped")

        def scaled(x: Column, i: Column) -> Column:
            y = 2 * (x - base[i]) / span[i] - 1
            return clip(y, -1.0, 1.0) if limit else y

        return df.withColumn(self.getOutputCol(), each(self._source(), len(low), scaled))


class BoundedScale(_Column, Estimator):
    """Training minimum and maximum to -1 and 1; a constant position becomes -1."""

    clipped = BoundedScaleModel.clipped

    def __init__(self, inputCol: str = "features", outputCol: str = "out", clipped: bool = True):
        super().__init__(inputCol, outputCol, clipped=clipped)

    def _fit(self, df: DataFrame) -> BoundedScaleModel:
        rows = _state(df, self.getInputCol())
        return BoundedScaleModel(
            low=[r["low"] for r in rows], high=[r["high"] for r in rows], clipped=self._value("clipped"), **self._io()
        )


def angle(x: Column) -> Column:
    return x * F.lit(math.pi)


class Elementwise(_Column, Transformer):
    """One function on every position: ``identity``, ``tanh``, ``cos`` or ``sin`` of ``pi * x``."""

    how = Param(Params._dummy(), "how", "function name", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        functions = {
            "identity": lambda x: x,
            "tanh": F.tanh,
            "cos": lambda x: F.cos(angle(x)),
            "sin": lambda x: F.sin(angle(x)),
        }
        return df.withColumn(self.getOutputCol(), F.transform(self._source(), functions[self._value("how")]))


class AngularEncode(_Column, Transformer):
    """All cosines, then all sines, of ``pi * x`` for bounded ``x``; twice as wide as the input.

    ``width`` is that of the input, or 0 where it is not known.
    """

    width = Param(Params._dummy(), "width", "input width", TypeConverters.toInt)

    def __init__(self, inputCol: str = "features", outputCol: str = "out", width: int = 0):
        super().__init__(inputCol, outputCol, width=width)

    def _transform(self, df: DataFrame) -> DataFrame:
        z, width = self._source(), self._value("width")
        pair = F.concat(each(z, width, lambda x, i: F.cos(angle(x))), each(z, width, lambda x, i: F.sin(angle(x))))
        return df.withColumn(self.getOutputCol(), pair)


def invert_angles(encoded: Column) -> Column:
    """Recover the bounded values from cosines and sines."""
    half = (F.size(encoded) / 2).cast("int")
    cosines, sines = F.slice(encoded, F.lit(1), half), F.slice(encoded, half + 1, half)
    return F.zip_with(cosines, sines, lambda c, s: F.atan2(s, c) / F.lit(math.pi))


class Quadratic(_Column, Transformer):
    """All values, then all products ``x_i * x_j`` with ``i <= j``: d + d(d+1)/2 wide."""

    def _transform(self, df: DataFrame) -> DataFrame:
        z = self._source()
        products = F.transform(
            z, lambda x, i: F.transform(F.slice(z, i + 1, F.size(z)), lambda y: x * y)
        )
        return df.withColumn(self.getOutputCol(), F.concat(z, F.flatten(products)))


class FourierFeaturesModel(_Column, Model):
    """``sqrt(2/D) * cos(x W + b)``; the weights travel with the function, rows come in Arrow batches."""

    weights, offsets = _floats("weights"), _floats("offsets")

    def _transform(self, df: DataFrame) -> DataFrame:
        b = np.array(self._value("offsets"))
        w = np.array(self._value("weights")).reshape(-1, len(b))

        scale = math.sqrt(2.0 / len(b))
        return df.withColumn(self.getOutputCol(), map_rows(self._source(), lambda x: scale * np.cos(x @ w + b)))


class FourierFeatures(_Column, Estimator):
    """Random Fourier map of the kernel ``exp(-gamma |x-y|^2)``.

    ``gamma`` is ``1/width`` (``inverse``), ``1/(width * variance)`` (``scale``) or a number;
    ``dims`` 0 means twice the input width.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toString)
    dims = Param(Params._dummy(), "dims", "output width", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self, inputCol: str = "features", outputCol: str = "out", gamma: str | float = "inverse",
                 dims: int = 0, seed: int = 42):
        super().__init__(inputCol, outputCol, gamma=str(gamma), dims=dims, seed=seed)

    def _fit(self, df: DataFrame) -> FourierFeaturesModel:
        gamma = self._value("gamma")
        if gamma == "scale":
            rows = _state(df, self.getInputCol())
            width = len(rows)
            means = np.array([r["mean"] for r in rows])
            variance = float(np.mean([r["std"] ** 2 for r in rows]) + means.var())
            g = 1.0 / (width * variance) if variance else 1.0
        else:
            width = df.select(F.size(self.getInputCol()).alias("d")).first()["d"]
            g = 1.0 / width if gamma == "inverse" else float(gamma)
        dims = self._value("dims") or 2 * width
        rng = np.random.default_rng(self._value("seed"))
        w = rng.normal(0.0, math.sqrt(2 * g), size=(width, dims))
        b = rng.uniform(0.0, 2 * math.pi, size=dims)
        return FourierFeaturesModel(weights=w.ravel().tolist(), offsets=b.tolist(), **self._io())


class Principal(_Column, Estimator):
    """Latent of ``k`` principal components; the input should be standardised."""

    k = Param(Params._dummy(), "k", "components", TypeConverters.toInt)

    def _fit(self, df: DataFrame) -> "LinearMapModel":
        from pyspark.ml.feature import PCA

        rows = as_vector(df.select(self.getInputCol()), self.getInputCol(), "v")
        matrix = PCA(k=self._value("k"), inputCol="v", outputCol="p").fit(rows).pc.toArray()
        signs = np.sign(matrix[np.abs(matrix).argmax(axis=0), np.arange(matrix.shape[1])])
        matrix = matrix * np.where(signs == 0, 1, signs)  # largest loading positive
        return LinearMapModel(weights=matrix.ravel().tolist(), width=matrix.shape[1], **self._io())


class LinearMapModel(_Column, Model):
    """``x W`` by Arrow batches."""

    weights = _floats("weights")
    width = Param(Params._dummy(), "width", "output width", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        w = np.array(self._value("weights")).reshape(-1, self._value("width"))

        return df.withColumn(self.getOutputCol(), map_rows(self._source(), lambda x: x @ w))


def center_distances(z: Column, centers: Sequence[Sequence[float]]) -> Column:
    """Euclidean distance to every centre."""

    def distance(center: Sequence[float]) -> Column:
        squares = F.zip_with(z, double_array(center), lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))

    return F.array(*[distance(c) for c in centers])


def nearest_one_hot(distances: Column, k: int) -> Column:
    """1 at the nearest centre (the first of equals), 0 elsewhere."""
    nearest = F.array_position(distances, F.array_min(distances))
    return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: (i.cast("long") == nearest).cast("double"))
