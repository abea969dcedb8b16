"""A weighted ReLU classifier on the network of the autoencoder: one Spark job per epoch."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.functions.batches import map_rows
from plumbrow.operators.autoencoder import Network, fit_network


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(margin / 2))


@dataclass(frozen=True)
class ClassifierNetwork(Network):
    """Network with one linear output. A row holds the features, then its label and its weight."""

    penalty: float = 1e-4  # on squared weights, as a share of a step

    def gradient(self, flat: np.ndarray, x: np.ndarray, rng: np.random.Generator | None = None) -> np.ndarray:
        """Gradient of the weighted logistic loss, averaged over rows, with the penalty."""
        y, w = x[:, -2], x[:, -1]
        values = self.forward(flat, x[:, :-2], rng)
        delta = (w * (sigmoid(values[-1][:, 0]) - y) / len(x))[:, None]
        shrink = [np.concatenate([a.ravel(), np.zeros(len(b))]) for a, b in self.layers(flat)]
        return self.backward(flat, values, delta, rng) + self.penalty / len(x) * np.concatenate(shrink)

    def loss_sum(self, flat: np.ndarray, x: np.ndarray) -> float:
        """Sum over rows of the weighted logistic loss."""
        margin = self.forward(flat, x[:, :-2])[-1][:, 0]
        return float((x[:, -1] * (np.logaddexp(0, margin) - x[:, -2] * margin)).sum())


@dataclass(frozen=True)
class Perceptron:
    net: ClassifierNetwork
    weights: np.ndarray

    def probability(self, column: Column) -> Column:
        """Positive-class probability of an ``array<double>`` column."""
        net, flat = self.net, self.weights
        return F.element_at(map_rows(column, lambda x: sigmoid(net.forward(flat, x)[-1])), 1)


def fit_perceptron(
    rows: DataFrame, hidden: tuple[int, ...] = (64, 32), epochs: int = 300, batch: int = 200, patience: int = 10,
    valid: float = 0.1, penalty: float = 1e-4, rows_per_task: int = 16_384, seed: int = 42,
    column: str = "f", label: str = "label", weight: str | None = None,
) -> Perceptron:
    """Fit on an array column of a stored table; the weights of the epoch with the least held-out loss stay.

    Held-out rows are chosen by the hash of their values. Tables without any run all epochs. Rows without
    label or features are refused.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    held = F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1_000_000)) < int(valid * 1_000_000)
    data = rows.select(
        F.concat(F.col(column).cast("array<double>"), F.array(F.col(label).cast("double"), w.cast("double"))).alias("x"),
        held.cast("int").alias("held"),
    )
    shape = data.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d"), F.count_if(F.expr("x IS NULL OR exists(x, v -> v IS NULL)")).alias("bad")).first()
    if shape["bad"]:
        raise ValueError("rows without label or features")
    width = max((shape["d"] or 2) - 2, 0)
    net = ClassifierNetwork((width, *hidden, 1), (*["relu"] * len(hidden), "linear"), penalty=penalty)
    data = data.repartition(max(1, math.ceil(shape["n"] / rows_per_task)))
    best, _ = fit_network(data, net, epochs, batch, patience, seed)
    return Perceptron(replace(net), best)
