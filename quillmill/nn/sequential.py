"""A chain of layers, trained on arrays or on a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from quillmill.errors import EmptyInput, InvalidInput, InvalidParameter, ModelIoError, ModelStructureMismatch, NeuralNetworkError, UnsupportedModelFormat
from quillmill.nn.layer import F32, Layer
from quillmill.nn.losses import Loss
from quillmill.nn.normalization import BatchNormalization
from quillmill.nn.optimizers import Optimizer
from quillmill.random import make_rng

FORMAT = 1


@dataclass
class History:
    loss: list[float] = field(default_factory=list)


def array_column(batch: pa.RecordBatch, name: str, shape: tuple[int, ...], kind: pa.DataType = pa.float32()) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        return col.flatten().cast(kind).to_numpy(zero_copy_only=False).reshape(batch.num_rows, *shape)
    return col.cast(kind).to_numpy(zero_copy_only=False).reshape(batch.num_rows, *shape)


class Sequential:
    def __init__(self, seed: int | None = None):
        self.layers: list[Layer] = []
        self.optimizer: Optimizer | None = None
        self.loss: Loss | None = None
        self.seed = seed

    def set_seed(self, seed: int) -> Sequential:
        self.seed = seed
        return self

    def add(self, layer: Layer) -> Sequential:
        self.layers.append(layer)
        return self

    def compile(self, optimizer: Optimizer, loss: Loss) -> Sequential:
        self.optimizer, self.loss = optimizer, loss
        return self

    def set_learning_rate(self, rate: float) -> Sequential:
        if self.optimizer is not None:
            if not 0 < rate < float("inf"):
                raise InvalidParameter("the rate must be positive")
            self.optimizer.learning_rate = rate
        return self

    def learning_rate(self) -> float | None:
        return self.optimizer.learning_rate if self.optimizer else None

    def _ready(self) -> None:
        if not self.layers or self.optimizer is None or self.loss is None:
            raise NeuralNetworkError("layers, an optimizer and a loss are needed")

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> float:
        p = x
        for layer in self.layers:
            p = layer.forward(p, True)
        value = self.loss.compute_loss(y, p)
        g = self.loss.compute_grad(y, p)
        for layer in reversed(self.layers):
            g = layer.backward(g)
        return value

    def train_batch(self, x, y) -> float:
        """The loss before the update."""
        self._ready()
        x, y = np.asarray(x, F32), np.asarray(y, F32)
        if not len(x) or len(x) != len(y):
            raise EmptyInput("x and y need the same rows, one at least")
        value = self._gradients(x, y)
        self.optimizer.apply(self.layers)
        return value

    def fit(self, x, y, epochs: int) -> History:
        return History([self.train_batch(x, y) for _ in range(epochs)])

    def fit_with_batches(self, x, y, epochs: int, batch_size: int) -> History:
        x, y = np.asarray(x, F32), np.asarray(y, F32)
        if not 0 < batch_size <= len(x):
            raise InvalidParameter("batch_size must be 1 to the number of rows")
        rng, out = make_rng(self.seed), History()
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for i in range(0, len(x), batch_size):
                at = order[i : i + batch_size]
                total += self.train_batch(x[at], y[at]) * len(at)
            out.loss.append(total / len(x))
        return out

    def evaluate(self, x, y) -> float:
        self._ready()
        return self.loss.compute_loss(np.asarray(y, F32), self.predict(x))

    def double(self) -> Sequential:
        """Weights and predictions in 64 bits from here on (fixed weights are given after it)."""
        for layer in self.layers:
            layer.double()
        return self

    def _dtype(self) -> type:
        return self.layers[0].dtype if self.layers else F32

    def predict(self, x) -> np.ndarray:
        x = np.asarray(x, self._dtype())
        for layer in self.layers:
            x = layer.predict(x)
        return x

    # ------------------------------------------------------------ DataFrames

    def fit_frame(self, df: DataFrame, x: str, y: str, epochs: int, x_shape: tuple[int, ...], y_shape: tuple[int, ...] = (1,), batch_size: int | None = None) -> History:
        """Training on rows that stay in their tasks: tasks send sums of gradients (weighted by rows), the driver updates.

        Without batch_size an epoch is one update from all rows, equal to fit() up to rounding. With it, rows are dealt to ceil(rows / batch_size) batches
        by a hash of their values (equal rows go together, so sizes vary about batch_size), whose order is drawn anew each epoch; each batch is
        an update and a Spark job, and as the rows are held in the order of their batches, it reads no more than its own. Random masks and noise are
        drawn anew for each update, task and piece of 1024 rows, from the layers' random_state.

        Batch normalisation needs the whole batch at once, so a network with it is trained on arrays.
        """
        self._ready()
        if any(isinstance(v, BatchNormalization) for v in self.layers):
            raise InvalidInput("batch normalisation needs the whole batch: use fit")
        if batch_size is not None and batch_size < 1:
            raise InvalidParameter("batch_size must be 1 or more")
        rows, n_batches = df.select(x, y), 1
        if batch_size is not None:
            n_batches = max(1, -(-rows.count() // batch_size))
        if n_batches > 1:
            rows = rows.withColumn("_batch", F.pmod(F.xxhash64(F.col(x), F.col(y)), F.lit(n_batches)))
            rows = rows.repartitionByRange("_batch").sortWithinPartitions("_batch")
        held, out, rng = rows.persist(StorageLevel.DISK_ONLY), History(), make_rng(self.seed)
        keys = [(i, k, v.shape) for i, layer in enumerate(self.layers) for k, v in layer.params.items()]
        size = sum(int(np.prod(s)) for _, _, s in keys) + 2

        def sums(batch: DataFrame) -> np.ndarray:
            """Sums over the rows of all gradients, of the loss and of 1."""
            seeds = {i: int(layer.rng.integers(1 << 62)) for i, layer in enumerate(self.layers) if hasattr(layer, "rng")}

            def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for i, seed in seeds.items():
                    self.layers[i].rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
                total = np.zeros(size)
                for b in it:
                    for i in range(0, b.num_rows, 1024):
                        piece = b.slice(i, 1024)
                        value, n = self._gradients(array_column(piece, x, x_shape), array_column(piece, y, y_shape)), piece.num_rows
                        total += n * np.concatenate([*(self.layers[j].grads[k].ravel() for j, k, _ in keys), [value, 1.0]])
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

            def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = sum((np.frombuffer(v, float) for b in it for v in b.column(0).to_pylist()), np.zeros(size))
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

            for layer in self.layers:
                layer._kept = None
            parts = batch.select(x, y).mapInArrow(part, "v binary").repartition(16).mapInArrow(add, "v binary").collect()
            return sum((np.frombuffer(bytes(r["v"]), float) for r in parts), np.zeros(size))

        try:
            for _ in range(epochs):
                seen = np.zeros(2)
                for k in rng.permutation(n_batches).tolist():
                    total = sums(held if n_batches == 1 else held.where(F.col("_batch") == k))
                    if not total[-1]:
                        continue  # no row's hash fell into the batch
                    seen += total[-2:]
                    flat, at = total[:-2] / total[-1], 0
                    for layer in self.layers:
                        layer.grads = {}
                    for j, name, s in keys:
                        n = int(np.prod(s))
                        self.layers[j].grads[name] = flat[at : at + n].reshape(s).astype(F32)
                        at += n
                    self.optimizer.apply(self.layers)
                if not seen[-1]:
                    raise EmptyInput("no rows")
                out.loss.append(float(seen[0] / seen[1]))
        finally:
            held.unpersist()
        return out

    def evaluate_frame(self, df: DataFrame, x: str, y: str, x_shape: tuple[int, ...], y_shape: tuple[int, ...] = (1,)) -> float:
        """The mean loss of df's rows, as evaluate() gives it for arrays; a pair of numbers leaves each task."""
        self._ready()
        for layer in self.layers:
            layer._kept = None

        def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for b in it:
                if b.num_rows:
                    total += self.loss.compute_loss(array_column(b, y, y_shape), self.predict(array_column(b, x, x_shape))) * b.num_rows
                    n += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([float(total)]), pa.array([n], pa.int64())], names=["total", "n"])

        r = df.select(x, y).mapInArrow(part, "total double, n long").agg(F.sum("total"), F.sum("n")).first()
        if not r[1]:
            raise EmptyInput("no rows")
        return r[0] / r[1]

    def predict_frame(self, df: DataFrame, x: str, x_shape: tuple[int, ...], out: str = "prediction") -> DataFrame:
        """df with the flattened output of each row's array: floats, or doubles of a network of 64 bits."""
        keep = df.drop(out)
        wide = self._dtype() is np.float64
        kind = pa.float64() if wide else pa.float32()
        schema = StructType(list(keep.schema.fields)).add(out, ArrayType(DoubleType() if wide else FloatType()))
        model = Sequential()
        model.layers = self.layers
        for layer in model.layers:
            layer._kept = None

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                y = model.predict(array_column(b, x, x_shape, kind)).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1), F32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(y), pa.list_(kind))], names=[*b.schema.names, out])

        return keep.mapInArrow(run, schema)

    # ------------------------------------------------------------ weights

    def get_weights(self) -> list[dict[str, np.ndarray]]:
        return [layer.state() for layer in self.layers]

    def summary(self) -> str:
        lines = [f"{'layer':<24}{'parameters':>12}"] + [f"{type(v).__name__:<24}{v.param_count():>12}" for v in self.layers]
        return "\n".join([*lines, f"{'all':<24}{sum(v.param_count() for v in self.layers):>12}"])

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per weight: format, layer, type, name, shape, values."""
        rows = [(FORMAT, i, type(v).__name__, k, list(w.shape), [float(q) for q in w.ravel()]) for i, v in enumerate(self.layers) for k, w in (v.state() or {"": np.zeros(0, F32)}).items()]
        spark.createDataFrame(rows, "format int, layer int, type string, name string, shape array<int>, values array<float>").coalesce(1).write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> Sequential:
        """Into layers of the same number, types and shapes."""
        try:
            rows = spark.read.parquet(path).collect()
        except Exception as e:
            raise ModelIoError(f"no weights at {path}") from e
        if any(r["format"] != FORMAT for r in rows):
            raise UnsupportedModelFormat("the weights have another format")
        if {(r["layer"], r["type"]) for r in rows} != {(i, type(v).__name__) for i, v in enumerate(self.layers)}:
            raise ModelStructureMismatch("the layers differ")
        for i, layer in enumerate(self.layers):
            mine = {r["name"]: np.array(r["values"], F32).reshape(r["shape"]) for r in rows if r["layer"] == i and r["name"]}
            if set(mine) != set(layer.state()) or any(mine[k].shape != v.shape for k, v in layer.state().items()):
                raise ModelStructureMismatch(f"the weights of layer {i} differ")
            layer.set_weights(**mine)
        return self


__all__ = ["History", "Sequential"]
