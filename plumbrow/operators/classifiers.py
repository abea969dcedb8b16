"""Classifiers on Spark ML, boosted trees and perceptrons of this library, and their scores.

A scored row is ``(label, score, pred)``: the positive-class probability, or the margin for
the support vector machine, and the predicted class.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from plumbrow.functions.batches import to_lists, to_matrix
from plumbrow.operators.boosting import Growth, fit_boosted
from plumbrow.operators.clean import fit_balance, positive_weight, with_weight
from plumbrow.operators.perceptron import fit_perceptron
from plumbrow.operators.transforms import FourierFeatures, as_vector, center_distances, nearest_one_hot
from plumbrow.parallel import all_results
from plumbrow.session import settle

DEEPEST = 30  # Spark's limit for tree depth
DEEP = 12  # trees of more levels are grown in groups
TREE_GROUPS = 12
SCORE_ROWS = 16_384  # rows that a task scores by the trees of one group
SCORED_GROUPS = 4  # at the same time
GROUP_ROWS = 5_000  # 60 trees over 500 rows took 5 s at once and 7 in groups, over 10,256 rows 21 and 15
MARGIN_BYTES = 32 << 20  # rows of a margin fit that one task keeps; a fit is many short jobs, with a task for every partition
TASK_BYTES = 256 << 20  # rows of a forest that one task keeps in memory and reads in every pass, about


def forest_parts(rows: DataFrame, column: str, trees: int) -> DataFrame:
    """Rows in so many partitions that what a forest keeps of each stays below ``TASK_BYTES``.

    Of a row it keeps a bin number a feature, a draw and a node a tree, and some 330 bytes. Files are split by their bytes, and well compressed
    ones hold any number of rows. Partitions that are small enough stay as they are.
    """
    parts = least_parts(rows, column, trees)
    return rows if parts <= rows.rdd.getNumPartitions() else rows.repartition(parts)


def least_parts(rows: DataFrame, column: str, trees: int) -> int:
    """Partitions that a forest needs at least."""
    return _least_parts(*_extent(rows, column), trees)


def _extent(rows: DataFrame, column: str) -> tuple[int, int]:
    n, width = rows.agg(F.count("*"), F.max(F.size(column))).first()
    return n, width or 0


def _least_parts(n: int, width: int, trees: int) -> int:
    return math.ceil(n * (4 * width + 8 * trees + 330) / TASK_BYTES)


@dataclass(frozen=True)
class GroupedForest:
    """Forests over the same rows whose trees vote as those of one forest."""

    forests: list[RandomForestClassificationModel]

    @property
    def numFeatures(self) -> int:
        return self.forests[0].numFeatures

    @property
    def getNumTrees(self) -> int:
        return sum(f.getNumTrees for f in self.forests)

    @property
    def totalNumNodes(self) -> int:
        return sum(f.totalNumNodes for f in self.forests)

    @property
    def featureImportances(self) -> DenseVector:
        total = sum(f.getNumTrees * f.featureImportances.toArray() for f in self.forests)
        return DenseVector(total / total.sum() if total.any() else total)

    def save(self, path: str) -> None:
        for i, forest in enumerate(self.forests):
            forest.save(f"{path}/{i:02d}")

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        """Rows of ``df`` with ``probability`` and ``prediction`` of all trees; of equal classes the first is predicted.

        Every task that scores reads the trees of its model anew, and deep trees have about as many nodes as rows. The rows are stored once, and a
        group's trees go to as few tasks as ``SCORE_ROWS`` asks for, in a query of their own; the votes meet again by row.
        """
        rows = settle(df.withColumn("_row", F.monotonically_increasing_id()))
        tasks = max(1, math.ceil(rows.count() / SCORE_ROWS))
        vectors = as_vector(rows.select("_row", F.col(column).alias("f")), "f", "v").select("_row", "v").coalesce(tasks)

        def votes(i: int, forest: RandomForestClassificationModel) -> DataFrame:
            model = forest.copy().setFeaturesCol("v").setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
            return settle(model.transform(vectors).select("_row", F.struct(F.lit(i).alias("i"), vector_to_array("_raw").alias("v")).alias("_own")))

        parts = all_results([lambda i=i, f=f: votes(i, f) for i, f in enumerate(self.forests)], SCORED_GROUPS)
        ordered = F.transform(F.sort_array(F.collect_list("_own")), lambda x: x["v"])  # sums do not depend on the order of arrival
        add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        rest = F.slice(ordered, 2, len(parts))
        total = reduce(DataFrame.union, parts).groupBy("_row").agg(F.aggregate(rest, F.element_at(ordered, 1), add).alias("_votes"))
        share = F.transform("_votes", lambda x: x / F.aggregate("_votes", F.lit(0.0), lambda a, b: a + b))
        first = F.array_position("_votes", F.array_max("_votes")) - 1
        scored = rows.join(total, on="_row").withColumns({"probability": array_to_vector(share), "prediction": first.cast("double")})
        return scored.drop("_row", "_votes")


def fit_deep_forest(rows: DataFrame, s: dict[str, Any], weight: str | None, label: str) -> RandomForestClassificationModel | GroupedForest:
    """A forest of deep trees, grown in groups of trees at the same time; each group reads as few partitions as it may.

    Spark sums a record of all bins for every node and partition, and a deep tree has about as many nodes as rows. A few partitions, with
    trees beside each other to fill the cores, make as many fewer records. Groups do not depend on the cluster. A table whose
    partitions alone fill the cores is read by all trees together, and so is a small one, where jobs outweigh records.
    """
    trees = s.get("trees", 200)
    groups = min(TREE_GROUPS, trees)
    sizes = [len(range(i, trees, groups)) for i in range(groups)]
    n, width = _extent(rows, "f")
    parts = max(1, _least_parts(n, width, sizes[0]))

    def fit(part: DataFrame, seed: int, size: int) -> RandomForestClassificationModel:
        estimator = _forest({**s, "trees": size, "seed": seed}).setFeaturesCol("v").setLabelCol(label)
        return (estimator.setWeightCol(weight) if weight else estimator).fit(as_vector(part, "f", "v"))

    if parts >= groups or n < GROUP_ROWS:
        return fit(forest_parts(rows, "f", trees), s["seed"], trees)
    part = rows.coalesce(1) if parts == 1 else rows.repartition(parts)
    fits = [lambda i=i, size=size: fit(part, s["seed"] + TREE_GROUPS * i, size) for i, size in enumerate(sizes)]
    return GroupedForest(all_results(fits, -(-groups // parts)))


def _forest(s: dict[str, Any]):
    depth = s.get("depth", DEEPEST)
    return RandomForestClassifier(
        numTrees=s.get("trees", 200), maxDepth=depth, maxBins=s.get("bins", 64), featureSubsetStrategy="sqrt",
        maxMemoryInMB=256, cacheNodeIds=depth > DEEP,  # a new table of nodes a level; few levels are found faster from the root
        checkpointInterval=10, seed=s["seed"],
    )


def _boosted(s: dict[str, Any]):
    return GBTClassifier(
        maxIter=s.get("rounds", 100), stepSize=s.get("rate", 0.1), maxDepth=s.get("depth", 3),
        maxBins=s.get("bins", 64), cacheNodeIds=True, checkpointInterval=10, seed=s["seed"],
    )


def _perceptron(s: dict[str, Any]):
    return MultilayerPerceptronClassifier(
        layers=[s["width"], *s.get("hidden", (64, 32)), 2], maxIter=s.get("rounds", 300), seed=s["seed"],
    )


def _margin(s: dict[str, Any]):
    return LinearSVC(regParam=1.0 / (s.get("c", 10.0) * s["rows"]), maxIter=s.get("rounds", 100), standardization=False)


FAMILIES: dict[str, Callable[[dict[str, Any]], Any]] = {
    "forest": _forest,
    "boosting": _boosted,
    "perceptron": _perceptron,
    "fourier_svm": _margin,
    "logistic": lambda s: LogisticRegression(maxIter=s.get("rounds", 100)),
}


def _histogram(rows: DataFrame, s: dict[str, Any], weight: str | None, label: str):
    growth = Growth(**{k: v for k, v in s.items() if k != "seed"})
    return fit_boosted(rows, growth, "f", label, weight)


def _relu_perceptron(rows: DataFrame, s: dict[str, Any], weight: str | None, label: str):
    hidden, epochs = s.get("hidden", (64, 32)), s.get("rounds", 300)
    return fit_perceptron(rows, hidden, epochs, s.get("batch", 200), seed=s["seed"], label=label, weight=weight)


#: Families fitted by this library on arrays; their models have ``probability``.
OWN: dict[str, Callable[[DataFrame, dict[str, Any], str | None, str], Any]] = {"histogram": _histogram, "relu_perceptron": _relu_perceptron}


@dataclass(frozen=True)
class Classifier:
    """A family, its settings and its class weighting.

    ``weighting`` is ``none``, ``balanced`` (n / (classes * rows of the class)) or
    ``positive`` (negatives per positive, on positives only).
    """

    family: str
    settings: dict[str, Any] = field(default_factory=dict)
    weighting: str = "none"
    seed: int = 42

    def with_settings(self, **changes) -> "Classifier":
        return replace(self, settings={**self.settings, **changes})

    def fit(self, train: DataFrame, column: str, label: str = "label") -> "FittedClassifier":
        """Fit on one array column. Fits read the rows several times: pass a stored table."""
        rows = train.select(label, F.col(column).cast("array<double>").alias("f"))
        lift = None
        settings = {**self.settings, "seed": self.seed}
        if self.family == "fourier_svm":
            lift = FourierFeatures(
                "f", "f", gamma=settings.get("gamma", "scale"), dims=settings.get("dims", 256), seed=self.seed
            ).fit(rows)
            rows = settle(lift.transform(rows))
            settings["rows"] = max(rows.count(), 1)
            rows = rows.coalesce(math.ceil(settings["rows"] * 8 * settings.get("dims", 256) / MARGIN_BYTES))
        weight = None if self.weighting == "none" else "w"
        if weight:
            if self.weighting == "balanced":
                weights = fit_balance(rows, label)
            else:
                weights = {0: 1.0, 1: positive_weight(rows, label)}
            rows = with_weight(rows, label, weights, weight)
        if self.family in OWN:
            return FittedClassifier(OWN[self.family](rows, settings, weight, label), column)
        if self.family == "perceptron":
            settings["width"] = len(rows.select("f").first()["f"])
        dealt = rows
        if self.family == "forest":
            if settings.get("depth", DEEPEST) > DEEP:
                return FittedClassifier(fit_deep_forest(rows, settings, weight, label), column)
            rows = forest_parts(dealt, "f", settings.get("trees", 200))
        estimator = FAMILIES[self.family](settings).setFeaturesCol("v").setLabelCol(label)
        if weight:
            estimator = estimator.setWeightCol(weight)
        if rows is dealt:
            return FittedClassifier(estimator.fit(as_vector(rows, "f", "v")), column, lift)
        vectors = as_vector(rows, "f", "v").drop("f").persist(StorageLevel.DISK_ONLY)  # Spark's fit would deal the rows again for each of its inputs
        try:
            return FittedClassifier(estimator.fit(vectors), column, lift)
        finally:
            vectors.unpersist()


# The study's configurations, with the growth that each boosting library has by default: 31 leaves and 20 rows a
# leaf, with early stopping in the first; 8 levels, a ridge of 1 and a curvature of 1 a leaf in XGBoost.
CONFIGURATIONS = {
    "random_forest_ablation": Classifier("forest", {"trees": 200}),
    "gradient_boosting": Classifier("boosting", {"rounds": 100, "rate": 0.1, "depth": 3}),
    "mlp": Classifier("relu_perceptron", {"hidden": (64, 32), "rounds": 300}),
    "svm": Classifier("fourier_svm", {"c": 10.0, "gamma": "scale"}),
    "RandomForest": Classifier("forest", {"trees": 300}, "balanced"),
    "HistGradBoost": Classifier("histogram", {"rounds": 400, "patience": 10}, "balanced"),
    "XGBoost": Classifier(
        "histogram", {"rounds": 400, "leaves": 0, "depth": 8, "bins": 256, "ridge": 1.0, "least_rows": 1, "least_curvature": 1.0}, "positive",
    ),
    "LightGBM": Classifier("histogram", {"rounds": 400}, "balanced"),
}
TOURNAMENT = ("RandomForest", "HistGradBoost", "XGBoost", "LightGBM")


@dataclass(frozen=True)
class FittedClassifier:
    model: Any
    column: str
    lift: Any = None

    def score(self, df: DataFrame, score: str = "score", pred: str = "pred") -> DataFrame:
        """Add the positive-class score and the predicted class."""
        if hasattr(self.model, "probability"):
            own = df.withColumn(score, self.model.probability(F.col(self.column).cast("array<double>")))
            return own.withColumn(pred, (F.col(score) > 0.5).cast("int"))
        if isinstance(self.model, GroupedForest):
            out = self.model.transform(df, self.column)
        else:
            rows = df.withColumn("f", F.col(self.column).cast("array<double>"))
            if self.lift is not None:
                rows = self.lift.transform(rows)
            out = self.model.transform(as_vector(rows, "f", "v"))
        source = "probability" if "probability" in out.columns else "rawPrediction"
        return out.select(
            *df.columns,
            F.element_at(vector_to_array(source), 2).alias(score),
            F.col("prediction").cast("int").alias(pred),
        )


def margin_to_probability(scored: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """Replace margins by probabilities of a logistic curve fitted on training margins."""
    vector = lambda df: as_vector(df.withColumn("m", F.array("score")), "m", "v")
    curve = LogisticRegression(featuresCol="v", labelCol=label, maxIter=100).fit(vector(train).select(label, "v"))
    slope, offset = float(curve.coefficients[0]), float(curve.intercept)
    return scored.withColumn("score", 1 / (1 + F.exp(-(F.col("score") * slope + offset))))


# ---------------------------------------------------------------- clusters


@dataclass(frozen=True)
class ClusterSummary:
    k: int
    trainingCost: float  # of the centres that the last step started from, as in Spark
    numIter: int


@dataclass(frozen=True)
class Clusters:
    """Centres of one start and what it took to find them."""

    centers: list[np.ndarray]
    summary: ClusterSummary

    def clusterCenters(self) -> list[np.ndarray]:
        return self.centers


def _nearest(starts: Sequence[np.ndarray]):
    """Function of one partition: for every start the sums and rows of its clusters and the cost, as one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(c.size + len(c) + 1) for c in starts]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = to_matrix(batch.column("z"))
            for centers, state in zip(starts, total):
                squares = np.stack([np.square(x - c).sum(axis=1) for c in centers], axis=1)
                own = squares.argmin(axis=1)
                for i in range(len(centers)):
                    mine = own == i
                    state[i * x.shape[1] : (i + 1) * x.shape[1]] += x[mine].sum(axis=0)
                    state[centers.size + i] += mine.sum()
                state[-1] += squares.min(axis=1).sum()
        yield pa.RecordBatch.from_arrays([to_lists(np.concatenate(total)[None, :])], ["v"])

    return run


def lloyd(rows: DataFrame, starts: Sequence[np.ndarray], steps: int = 300, tolerance: float = 1e-4) -> list[Clusters]:
    """K-Means steps from several starts, all of them in one job a step.

    ``rows`` has the column ``z`` (array). A start ends when none of its centres moved by more than ``tolerance``; an
    empty cluster keeps its centre.
    """
    centers, costs, taken, open_ = list(starts), [0.0] * len(starts), [0] * len(starts), list(range(len(starts)))
    for _ in range(steps):
        vectors = rows.mapInArrow(_nearest([centers[i] for i in open_]), "v array<double>").select(array_to_vector("v").alias("v"))
        found, at, moving = vectors.agg(Summarizer.sum(F.col("v")).alias("v")).first()["v"].toArray(), 0, []
        for i in open_:
            old = centers[i]
            sums, n = found[at : at + old.size].reshape(old.shape), found[at + old.size : at + old.size + len(old)]
            costs[i], at, taken[i] = float(found[at + old.size + len(old)]), at + old.size + len(old) + 1, taken[i] + 1
            centers[i] = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], old)
            if (np.square(centers[i] - old).sum(axis=1) > tolerance**2).any():
                moving.append(i)
        open_ = moving
        if not open_:
            break
    return [Clusters(list(c), ClusterSummary(len(c), cost, n)) for c, cost, n in zip(centers, costs, taken)]


def best_kmeans(
    df: DataFrame, column: str, k: int = 2, starts: int = 10, seed: int = 42, parallelism: int = 4,
) -> Clusters:
    """K-Means from several starts over the same cached rows; the lowest within-cluster cost wins.

    Spark draws the centres of every start; the steps of all starts are taken together, so that a pass over the rows
    serves each of them.
    """
    rows = df.select(F.col(column).cast("array<double>").alias("z")).persist()
    vectors = as_vector(rows, "z", "v").select("v")
    try:
        start = lambda i: np.array(KMeans(k=k, featuresCol="v", seed=seed + i, maxIter=0).fit(vectors).clusterCenters())
        fits = lloyd(rows, all_results([lambda i=i: start(i) for i in range(starts)], parallelism))
    finally:
        rows.unpersist()
    return min(fits, key=lambda m: m.summary.trainingCost)


def cluster_columns(df: DataFrame, column: str, model: Clusters, distances: str = "dist", one_hot: str = "hot") -> DataFrame:
    """Distances to the centres and the one-hot cluster of every row."""
    centers: Sequence = [c.tolist() for c in model.clusterCenters()]
    out = df.withColumn(distances, center_distances(F.col(column), centers))
    return out.withColumn(one_hot, nearest_one_hot(F.col(distances), len(centers)))
