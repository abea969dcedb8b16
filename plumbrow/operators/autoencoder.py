"""A dense autoencoder fitted by one Spark job per epoch.

The standardised rows are dealt to parts of bounded size and stay cached on the executors, packed
as bytes, several parts to a task. In an epoch every part starts from the current weights and runs
mini-batch Adam over its own rows; a task emits the sum of its parts' weights and moments times their
rows as one vector. Spark sums the vectors and the driver receives one of them, three times the size of
the network. Validation rows are flagged by hash and score the incoming weights in the same job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from plumbrow.functions.batches import map_rows, to_lists, to_matrix
from plumbrow.operators.sampling import HashOrder, sample_uniform, validation_tail
from plumbrow.operators.transforms import _Column, _floats

PARTS_PER_TASK = 32  # parts that one task takes at most
MANY_TASKS = 48  # tasks of an epoch, before they take several parts
PART_BYTES = 16 << 20  # rows of such a task, about


@dataclass(frozen=True)
class Network:
    """Widths and activations of consecutive dense layers, with weights in one flat vector."""

    widths: tuple[int, ...]
    activations: tuple[str, ...]
    dropout: float = 0.0  # after the first layer, while training

    @property
    def size(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.widths, self.widths[1:]))

    def start(self, seed: int) -> np.ndarray:
        """Uniform weights scaled by fan-in plus fan-out, zero offsets."""
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(self.widths, self.widths[1:]):
            bound = math.sqrt(6.0 / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
        return np.concatenate(parts)

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.widths, self.widths[1:]):
            out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def forward(self, flat: np.ndarray, x: np.ndarray, rng: np.random.Generator | None = None) -> list[np.ndarray]:
        """Input and the output of every layer."""
        values = [x]
        for i, ((w, b), act) in enumerate(zip(self.layers(flat), self.activations)):
            h = values[-1] @ w + b
            h = np.maximum(h, 0) if act == "relu" else np.tanh(h) if act == "tanh" else h
            if rng is not None and i == 0 and self.dropout > 0:
                h = h * (rng.random(h.shape) >= self.dropout) / (1 - self.dropout)
            values.append(h)
        return values

    def gradient(self, flat: np.ndarray, x: np.ndarray, rng: np.random.Generator | None = None) -> np.ndarray:
        """Gradient of the mean squared reconstruction error."""
        values = self.forward(flat, x, rng)
        return self.backward(flat, values, 2.0 * (values[-1] - x) / x.size, rng)

    def backward(
        self, flat: np.ndarray, values: list[np.ndarray], delta: np.ndarray, rng: np.random.Generator | None = None,
    ) -> np.ndarray:
        """Gradient of the weights from the gradient ``delta`` of the output."""
        parts: list[np.ndarray] = []
        for i, (w, _) in reversed(list(enumerate(self.layers(flat)))):
            out, act = values[i + 1], self.activations[i]
            if act == "relu":
                delta = delta * (out > 0)
            elif act == "tanh":
                delta = delta * (1 - out * out)
            if rng is not None and i == 0 and self.dropout > 0:
                delta = delta / (1 - self.dropout) * (out != 0)
            parts = [(values[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
            delta = delta @ w.T
        return np.concatenate(parts)

    def loss_sum(self, flat: np.ndarray, x: np.ndarray) -> float:
        """Sum over rows of the mean squared error of a row."""
        return float(((self.forward(flat, x)[-1] - x) ** 2).mean(axis=1).sum())


@dataclass
class AdamState:
    """Weights, first and second moments (one flat vector each) and the step count."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0

    def advance(self, g: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        a = self.first / (1 - 0.9 ** self.steps)
        b = self.second / (1 - 0.999 ** self.steps)
        self.weights = self.weights - rate * a / (np.sqrt(b) + 1e-7)


def _epoch(net: Network, state: AdamState, epoch: int, seed: int, batch: int, rate: float, train: bool):
    """Function of one partition of packed rows: the sum over its parts of their parameters times their training rows.

    Three more values close the vector: training rows, validation loss, validation rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part, local = np.zeros(3 * net.size + 4), None, state
        rng, rows = None, 0

        def close() -> None:
            whole[:-3] += np.concatenate([local.weights, local.first, local.second, [local.steps]]) * rows
            whole[-3] += rows

        for packed in batches:
            for i in range(packed.num_rows):
                own, flags, values = (packed.column(c)[i] for c in PACKED)
                if own.as_py() != part:
                    close()
                    part, rows = own.as_py(), 0
                    rng = np.random.default_rng([seed, epoch, part])
                    local = AdamState(state.weights.copy(), state.first.copy(), state.second.copy(), state.steps)
                held = np.frombuffer(flags.as_buffer(), bool)
                x = np.frombuffer(values.as_buffer(), np.float64).reshape(len(held), -1)
                if held.any():
                    whole[-2] += net.loss_sum(state.weights, x[held])
                    whole[-1] += int(held.sum())
                if not train:
                    continue
                x = x[~held][rng.permutation(int((~held).sum()))]
                for at in range(0, len(x), batch):
                    step = x[at:at + batch]
                    local.advance(net.gradient(local.weights, step, rng if net.dropout else None), rate)
                rows += len(x)
        close()
        yield pa.RecordBatch.from_arrays([to_lists(whole[None, :])], ["v"])

    return run


PACKED = ["part", "held", "x"]


def _pack(chunk: int):
    """Function of one partition: its rows as bytes, up to ``chunk`` rows of a part at a time.

    Rows of a part stand together. Without a column ``part`` a partition is one part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        part, waiting, rows = None, [], 0

        def packed() -> pa.RecordBatch:
            x, held = (np.concatenate(c) for c in zip(*waiting))
            columns = [pa.array([part], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in (held, x))]
            return pa.RecordBatch.from_arrays(columns, PACKED)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, held = to_matrix(batch.column("x")), batch.column("held").to_numpy() == 1
            parts = batch.column("part").to_numpy() if "part" in batch.schema.names else np.full(len(held), here)
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges[:-1], edges[1:]):
                if rows and parts[a] != part:
                    yield packed()
                    waiting, rows = [], 0
                part = int(parts[a])
                while a < b:
                    c = min(b, a + chunk - rows)
                    waiting.append((x[a:c], held[a:c]))
                    a, rows = c, rows + c - a
                    if rows == chunk:
                        yield packed()
                        waiting, rows = [], 0
        if rows:
            yield packed()

    return run


def fit_network(
    data: DataFrame, net: Network, epochs: int, batch: int, patience: int, seed: int, rate: float = 0.001,
) -> tuple[np.ndarray, list[float]]:
    """Best weights by validation loss and the loss of every epoch.

    ``data`` has the columns ``x`` (array) and ``held`` and keeps its partitions; with a column ``part`` a partition
    holds several parts, one after the other, else it is one. Every epoch reads the rows as packed once.
    """
    chunk = int(data.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    packed = data.mapInArrow(_pack(chunk if chunk > 0 else 1 << 31), "part int, held binary, x binary").persist()
    try:
        return _epochs(packed, net, epochs, batch, patience, seed, rate)
    finally:
        packed.unpersist()


def _epochs(
    packed: DataFrame, net: Network, epochs: int, batch: int, patience: int, seed: int, rate: float,
) -> tuple[np.ndarray, list[float]]:
    state = AdamState(net.start(seed), np.zeros(net.size), np.zeros(net.size))
    best, best_loss, waited, losses = state.weights, math.inf, 0, []

    def job(epoch: int, train: bool) -> np.ndarray:
        run = _epoch(net, state, epoch, seed, batch, rate, train)
        vectors = packed.mapInArrow(run, "v array<double>").select(array_to_vector("v").alias("v"))
        return vectors.agg(Summarizer.sum(F.col("v")).alias("v")).first()["v"].toArray()

    for epoch in range(epochs + 1):
        *total, rows, loss, valid = job(epoch, train=epoch < epochs)
        if epoch > 0:  # the job scored the weights of the epoch before
            loss = loss / valid if valid else math.nan
            losses.append(loss)
            if math.isnan(loss) or loss < best_loss:
                best, best_loss, waited = state.weights, loss, 0
            else:
                waited += 1
                if waited >= patience:
                    break
        if epoch == epochs or not rows:
            break
        flat = np.array(total) / rows
        state = AdamState(*np.split(flat[:-1], 3), flat[-1])
    return best, losses


class EncoderModel(_Column, Model):
    """Rows to the latent layer by Arrow batches."""

    weights = _floats("weights")
    widths = Param(Params._dummy(), "widths", "layer widths up to the latent", TypeConverters.toListInt)
    activations = Param(Params._dummy(), "activations", "activations", TypeConverters.toListString)
    parameters = Param(Params._dummy(), "parameters", "parameters of the whole network", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        net = Network(tuple(self._value("widths")), tuple(self._value("activations")))
        flat = np.array(self._value("weights"))

        encoded = map_rows(self._source(), lambda x: net.forward(flat, x)[-1])
        return df.withColumn(self.getOutputCol(), encoded)


class AutoencoderFit(_Column, Estimator):
    """n - hidden - latent - hidden reversed - n with ReLU hidden layers and linear output.

    ``key`` names the row identity that decides sample, validation rows and partitions.
    ``maxRows`` 0 uses all rows. ``rowsPerTask`` sets the rows of a part, which train on their own in an epoch;
    a task of a large table takes several parts. ``digest`` names a column that holds the digest of the row order already.
    """

    key = Param(Params._dummy(), "key", "row identity", TypeConverters.toListString)
    hidden = Param(Params._dummy(), "hidden", "encoder widths", TypeConverters.toListInt)
    latent = Param(Params._dummy(), "latent", "latent width", TypeConverters.toInt)
    activation = Param(Params._dummy(), "activation", "latent activation", TypeConverters.toString)
    dropout = Param(Params._dummy(), "dropout", "dropout after the first layer", TypeConverters.toFloat)
    epochs = Param(Params._dummy(), "epochs", "maximum epochs", TypeConverters.toInt)
    batch = Param(Params._dummy(), "batch", "rows per step", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "epochs without gain", TypeConverters.toInt)
    valid = Param(Params._dummy(), "valid", "validation share", TypeConverters.toFloat)
    maxRows = Param(Params._dummy(), "maxRows", "training sample", TypeConverters.toInt)
    rowsPerTask = Param(Params._dummy(), "rowsPerTask", "rows per part", TypeConverters.toInt)
    digest = Param(Params._dummy(), "digest", "column with the digest of the row order", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(
        self, inputCol: str = "x", outputCol: str = "z", key: Sequence[str] = ("row_key",),
        hidden: Sequence[int] = (64, 32), latent: int = 16, activation: str = "relu", dropout: float = 0.0,
        epochs: int = 100, batch: int = 256, patience: int = 10, valid: float = 0.1, maxRows: int = 0,
        rowsPerTask: int = 16_384, seed: int = 42, digest: str = "",
    ):
        super().__init__(
            inputCol, outputCol, key=list(key), hidden=list(hidden), latent=latent, activation=activation,
            dropout=dropout, epochs=epochs, batch=batch, patience=patience, valid=valid, maxRows=maxRows,
            rowsPerTask=rowsPerTask, seed=seed, digest=digest,
        )

    def order(self) -> HashOrder:
        """The order that decides validation rows and parts."""
        return HashOrder(tuple(self._value("key")), (), f"{self._value('seed')}:tail", self._value("digest"))

    def _fit(self, df: DataFrame) -> EncoderModel:
        v = self._value
        key, seed, stored = v("key"), v("seed"), v("digest")
        rows = df.select(*key, *([stored] if stored else []), self._source().alias("x"))
        if v("maxRows"):
            rows = sample_uniform(rows, key, v("maxRows"), seed=f"{seed}:fit")
        rows = validation_tail(rows, key, v("valid"), seed=seed, out="held", stored=stored)
        shape = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
        hidden, width = v("hidden"), shape["d"]
        parts = max(1, math.ceil(shape["n"] / v("rowsPerTask")))  # by the rows alone: the fit is the same on any cluster
        together = max(1, min(PARTS_PER_TASK, parts // MANY_TASKS, PART_BYTES // (8 * v("rowsPerTask") * max(width or 1, 1))))
        tasks = math.ceil(parts / together)
        hashed = rows.withColumn("h", self.order().digest(rows)).withColumn("part", F.pmod(F.hash("h"), F.lit(parts)))
        hashed = hashed.withColumn("h", F.unhex("h"))  # the same order in half the bytes of the shuffle
        data = hashed.repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part", "h").select("x", "held", "part")
        widths = (width, *hidden, v("latent"), *reversed(hidden), width)
        relu = ["relu"] * len(hidden)
        net = Network(widths, (*relu, v("activation"), *relu, "linear"), v("dropout"))
        best, _ = fit_network(data, net, v("epochs"), v("batch"), v("patience"), seed)
        encoder = Network(widths[: len(hidden) + 2], net.activations[: len(hidden) + 1])
        return EncoderModel(
            weights=best[: encoder.size].tolist(), widths=list(encoder.widths),
            activations=list(encoder.activations), parameters=net.size, **self._io(),
        )
