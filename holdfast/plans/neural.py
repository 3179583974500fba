"""A neural classifier trained by whole-batch gradients that Spark sums, with row weights and embeddings.

Numbers and flags enter as they are, each text column through a table with a vector per value; a hidden
layer follows another up to one output. A training step is one job: every task computes the gradient of
its rows at the present weights, groups of tasks are summed by a second stage, and the driver adds the
few group sums and takes an Adam step. The held-out loss comes with the same job. No row is
copied: classes are balanced by the weight of each row.

The driver and every task hold the weights, which grow with the number of category values, as
the weights of any such model do; rows stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.session import stage_evenly

HIDDEN = (128, 64, 32)
WIDEST_EMBEDDING = 8
CHUNK = 4096


@dataclass(frozen=True)
class Settings:
    steps: int = 80
    patience: int = 10
    rate: float = 0.01
    penalty: float = 1e-4
    hidden: tuple[int, ...] = HIDDEN
    seed: int = 42


def start_weights(n_numbers: int, sizes: list[int], settings: Settings) -> list[np.ndarray]:
    """Embedding tables, then matrix and offset of every layer."""
    rng = np.random.default_rng(settings.seed)
    widths = [min(WIDEST_EMBEDDING, (n + 1) // 2) for n in sizes]
    weights = [rng.normal(0, 0.05, (n, w)) for n, w in zip(sizes, widths)]
    into = n_numbers + sum(widths)
    for out in (*settings.hidden, 1):
        weights += [rng.normal(0, math.sqrt(2 / max(into, 1)), (into, out)), np.zeros(out)]
        into = out
    return weights


def _layers(weights: list[np.ndarray], n_tables: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rest = weights[n_tables:]
    return list(zip(rest[::2], rest[1::2]))


def forward(weights: list[np.ndarray], numbers: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """Input, output of every hidden layer, and the margin as the last entry."""
    tables = weights[: codes.shape[1]]
    at = [np.concatenate([numbers, *[t[codes[:, k]] for k, t in enumerate(tables)]], axis=1)]
    layers = _layers(weights, codes.shape[1])
    for k, (matrix, offset) in enumerate(layers):
        out = at[-1] @ matrix + offset
        at.append(out if k == len(layers) - 1 else np.maximum(out, 0))
    return at


def loss_and_gradient(
    weights: list[np.ndarray], numbers: np.ndarray, codes: np.ndarray, label: np.ndarray, weight: np.ndarray
) -> tuple[float, list[np.ndarray]]:
    """Weighted sums over the rows of the logistic loss and of its gradient."""
    at = forward(weights, numbers, codes)
    margin = at[-1][:, 0]
    loss = float((weight * np.logaddexp(0, np.where(label == 1, -margin, margin))).sum())
    back = (weight * (1 / (1 + np.exp(-margin)) - label))[:, None]
    gradient = []
    for k, (matrix, _) in reversed(list(enumerate(_layers(weights, codes.shape[1])))):
        gradient = [at[k].T @ back, back.sum(axis=0), *gradient]
        back = back @ matrix.T
        if k:
            back = back * (at[k] > 0)
    tables, first = [], numbers.shape[1]
    for k in range(codes.shape[1]):
        table = np.zeros_like(weights[k])
        np.add.at(table, codes[:, k], back[:, first : first + table.shape[1]])
        tables.append(table)
        first += table.shape[1]
    return loss, [*tables, *gradient]


def flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def shaped(values: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([a.size for a in like])[:-1]
    return [part.reshape(a.shape) for part, a in zip(np.split(values, cuts), like)]


# --- Spark ---------------------------------------------------------------------------------------


def _inputs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    return tuple(batch.column(c).flatten().to_numpy().reshape(n, -1) for c in ("numbers", "codes"))


_SUMS = "part int, sums binary"


def _gradients(weights: list[np.ndarray]):
    """One row per task: loss and weight of fitted rows, of held-out rows, and the gradient."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 + sum(w.size for w in weights))
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                some = batch.slice(first, CHUNK)
                numbers, codes = _inputs(some)
                label, weight = (some.column(c).to_numpy() for c in ("label", "weight"))
                held = some.column("held_out").to_numpy(zero_copy_only=False)
                fit = ~held
                loss, gradient = loss_and_gradient(weights, numbers[fit], codes[fit], label[fit], weight[fit])
                total[:2] += loss, weight[fit].sum()
                total[4:] += flat(gradient)
                if held.any():
                    margin = forward(weights, numbers[held], codes[held])[-1][:, 0]
                    signed = np.where(label[held] == 1, -margin, margin)
                    total[2:4] += (weight[held] * np.logaddexp(0, signed)).sum(), weight[held].sum()
        yield _row(TaskContext.get().partitionId(), total)

    return compute


def _row(part: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.tobytes()])], names=["part", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, part = None, 0
    for batch in batches:
        for k in range(batch.num_rows):
            values = np.frombuffer(batch.column(1)[k].as_py())
            total = values.copy() if total is None else total + values
            part = batch.column(0)[k].as_py()
    if total is not None:
        yield _row(part, total)


def summed(rows: DataFrame, weights: list[np.ndarray]) -> np.ndarray:
    """Sums over all rows; the driver receives the square root of the number of tasks of them."""
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    parts = rows.mapInArrow(_gradients(weights), _SUMS)
    if groups > 1:
        parts = parts.repartition(groups, F.col("part")).sortWithinPartitions("part").mapInArrow(_add_up, _SUMS)
    found = sorted((r["part"], r["sums"]) for r in parts.collect())
    return sum(np.frombuffer(bytes(sums)) for _, sums in found) + np.zeros(4 + sum(w.size for w in weights))


def train(rows: DataFrame, n_numbers: int, sizes: list[int], settings: Settings) -> list[np.ndarray]:
    """Weights of the lowest held-out loss, or of the last step where nothing is held out.

    ``rows`` has numbers, codes, label, weight and held_out.
    """
    staged = stage_evenly(rows, "training_rows")
    weights = start_weights(n_numbers, sizes, settings)
    is_matrix = flat([np.full(w.shape, float(w.ndim == 2)) for w in weights])
    first, second = np.zeros(len(is_matrix)), np.zeros(len(is_matrix))
    best, lowest, since = weights, math.inf, 0
    for step in range(1, settings.steps + 1):
        sums = summed(staged, weights)
        if sums[1] <= 0:
            return weights
        if sums[3] > 0:
            held = sums[2] / sums[3]
            best, lowest, since = (weights, held, 0) if held < lowest else (best, lowest, since + 1)
            if since >= settings.patience:
                return best
        values = flat(weights)
        gradient = sums[4:] / sums[1] + settings.penalty * values * is_matrix
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights = shaped(values - settings.rate * move, weights)
    return weights if math.isinf(lowest) else best


class NeuralNet(Transformer, MLWritable, MLReadable):
    """Adds ``probability``, a vector of both classes' probabilities, from named number and code columns."""

    def __init__(self, numbers: list[str], codes: list[str], weights: list[np.ndarray]):
        super().__init__()
        self.numbers, self.codes, self.weights = numbers, codes, weights

    def columns(self) -> tuple[Column, Column]:
        numbers = F.array(*[F.col(f"`{c}`").cast("double") for c in self.numbers])
        codes = F.array(*[F.col(f"`{c}`").cast("int") for c in self.codes])
        return numbers, codes.cast("array<int>")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, n_numbers, n_codes = self.weights, len(self.numbers), len(self.codes)

        def score(numbers: pd.Series, codes: pd.Series) -> pd.Series:
            if not len(numbers):
                return pd.Series([], dtype=float)
            x = np.stack(numbers.to_numpy()).reshape(len(numbers), n_numbers)
            c = np.stack(codes.to_numpy()).reshape(len(numbers), n_codes).astype(np.int64)
            return pd.Series(1 / (1 + np.exp(-forward(weights, x, c)[-1][:, 0])))

        p = F.pandas_udf(score, "double")(*self.columns())
        both = F.transform(F.array(p), lambda v: F.array(1 - v, v))
        return dataset.withColumn("probability", array_to_vector(both[0]))

    def write(self) -> MLWriter:
        return _NetWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _NetReader()


class _NetWriter(MLWriter):
    def __init__(self, net: NeuralNet):
        super().__init__()
        self.net = net

    def saveImpl(self, path: str) -> None:
        net = self.net
        DefaultParamsWriter.saveMetadata(net, path, self.sparkSession, {"numbers": net.numbers, "codes": net.codes})
        rows = [(k, list(w.shape), w.astype("<f8").tobytes()) for k, w in enumerate(net.weights)]
        self.sparkSession.createDataFrame(rows, "k int, shape array<int>, data binary").write.parquet(f"{path}/weights")


class _NetReader(MLReader):
    def load(self, path: str) -> NeuralNet:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = sorted(self.sparkSession.read.parquet(f"{path}/weights").collect(), key=lambda r: r["k"])
        weights = [np.frombuffer(bytes(r["data"])).reshape(r["shape"]) for r in rows]
        net = NeuralNet(metadata["numbers"], metadata["codes"], weights)
        net._resetUid(metadata["uid"])
        return net
